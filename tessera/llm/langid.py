"""Language identification by compression with per-language raw-content dictionaries.

For each language of the labelled documents a zstandard dictionary is filled with text of a bounded sample of them. A
text is reduced to its letters in lower case and cut into chunks of CHUNK bytes (whole texts, all chunks), every chunk is compressed with each dictionary, and
the language whose compressed chunks are the smallest in sum is chosen. The margin is what the second smallest takes
more, as a share of it; predictions with a margin under MARGIN are not accepted.

The sample: for each language, of the labelled documents with a letter, the one with the smallest hash in each of
SAMPLE_ROWS hash buckets, and of its text up to PIECE characters from the middle, as a dictionary holds about
SAMPLE_ROWS * PIECE characters; for the LANGS languages with the most labelled documents. It needs one aggregation with
map-side combination, so neither a frequent language nor a large table gathers in one task.

Defined results: a null text, and one without any letter, is `und` with score 0 and not accepted; ties go to the
language with more labelled documents and have margin 0; with a single learned language the margin is 1; with none every text is
`und`; repeated rows get the same prediction; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._common import annotate, as_rows
from tessera.session import written

#: Labelled documents in the sample of a language, and characters taken of each.
SAMPLE_ROWS, PIECE = 256, 400
#: Languages that are learned: those with the most labelled documents.
LANGS = 512
#: Bytes compressed at a time: a dictionary tells most about short stretches.
CHUNK = 1024
#: Predictions with a narrower margin are not accepted.
MARGIN = 0.005
LEVEL = 6
UNKNOWN = "und"
_OTHERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """What is compressed: the letters in lower case, one space for all between them."""
    return _OTHERS.sub(" ", text.lower()).encode()


def sample(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", rows: int = SAMPLE_ROWS) -> dict[str, list[str]]:
    """Language to sampled texts, most frequent language first; at most `rows` pieces for each of LANGS languages come to the driver."""
    hashed = F.xxhash64(F.col(key_col).cast("string"))
    piece = F.substring(F.col(text_col), F.greatest(F.lit(1), ((F.length(text_col) - PIECE) / 2).cast("int")), F.lit(PIECE))
    picked = (
        labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
        .select(F.col(lang_col).alias("lang"), hashed.alias("h"), piece.alias("piece"))
        .groupBy("lang", F.pmod("h", F.lit(rows)).alias("bucket"))
        .agg(F.min(F.struct("h", "piece")).alias("least"), F.count(F.lit(1)).alias("n"))
        .select("lang", "bucket", "least.piece", "n")
    )
    picked = written(picked)
    frequent = picked.groupBy("lang").agg(F.sum("n").alias("_n")).orderBy(F.desc("_n"), "lang").limit(LANGS).select("lang")
    found: dict[str, list[tuple[int, str, int]]] = {}
    for r in picked.join(F.broadcast(frequent), "lang").collect():
        found.setdefault(r.lang, []).append((r.bucket, r.piece, r.n))
    order = sorted(found, key=lambda lang: (-sum(n for _, _, n in found[lang]), lang))
    return {lang: [p for _, p, _ in sorted(found[lang])] for lang in order}


class Compressors:
    """One compressor with its dictionary for each language."""

    def __init__(self, pieces: dict[str, list[str]]) -> None:
        self.langs = list(pieces)
        self.compress = []
        for lang in self.langs:
            content = b" ".join(map(letters, pieces[lang])).ljust(64, b" ")
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            maker = zstandard.ZstdCompressor(dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False)
            self.compress.append(maker.compress)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and the margin."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        data = letters(text)
        chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
        sizes = sorted((sum([len(compress(c)) for c in chunks]), k) for k, compress in enumerate(self.compress))
        best = self.langs[sizes[0][1]]
        return best, (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0


_made: dict[int, Compressors] = {}


def _worker_compressors(pieces: dict[str, list[str]]) -> Compressors:
    key = hash(tuple((lang, tuple(of)) for lang, of in pieces.items()))
    if key not in _made:
        _made.clear()
        _made[key] = Compressors(pieces)
    return _made[key]


def predictor(pieces: dict[str, list[str]], margin: float = MARGIN) -> tuple[Callable[[pa.Array], list[pa.Array]], list[T.StructField]]:
    """The function for annotate(), and its fields: lang_pred, score, accepted."""

    def run(texts: pa.Array) -> list[pa.Array]:
        own = _worker_compressors(pieces)
        found = [own.predict(t.as_py()) for t in texts]
        langs, scores = [f[0] for f in found], [f[1] for f in found]
        accepted = [lang != UNKNOWN and score >= margin for lang, score in found]
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())]

    return run, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]


def held_out(key: str = "doc_id") -> Column:
    """Is the document outside of what may be learned from? One in five, by its id."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0


def predict(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", margin: float = MARGIN) -> DataFrame:
    """(row, lang_pred, score, accepted) for each document, learned from those of them that aren't held out."""
    pieces = sample(docs.where(~F.coalesce(held_out(key_col), F.lit(True))), text_col, lang_col, key_col)
    run, fields = predictor(pieces, margin)
    return annotate(as_rows(docs), text_col, run, fields)
