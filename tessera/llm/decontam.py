"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Texts are lower-cased in A-Z, and a word is a run of letters, digits and non-ASCII bytes. Each benchmark item gives its
windows of N words (one window of all its words, if it has fewer). The hashes of all windows are broadcast; documents
are scanned, hits of the hash are verified word by word, and the words inside occurring windows are marked.

A broadcast holds items of about BLOCK_BYTES of text. A larger benchmark is scanned in blocks of that size, one after
the other: each adds its marks to those of the one before.

Defined results: a null or empty text has no words and no hits; items without words take no part; equal items each
count; items without an id count as one, which has no name in the list; repeated documents are marked each; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import as_rows, grouped
from tessera.session import written

#: Words of a window.
WINDOW = 10
#: Bytes of benchmark text in one broadcast. Its set takes about 5 times as much, and 25 times if all words differ.
BLOCK_BYTES = 8_000_000
#: Windows of documents and of items that are compared at a time.
PAIRS = 1 << 20

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Documents are scanned together until they hold so many characters.
GROUP_CHARS = 3_000_000


def words_of(text: str) -> list[bytes]:
    """The normalised words of a text."""
    return text.encode().translate(_KEEP).split()


class WindowSet:
    """The windows of benchmark items, by number of words, in arrays: 16 bytes a window, 4 a word, and the words once."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW) -> None:
        names = sorted({str(i) for i, _ in items if i is not None})
        number = {name: k for k, name in enumerate(names)}
        self.names: list[str | None] = [*names, None]  # a null id is one item too, without a name
        self.ids: dict[bytes, int] = {}
        flat: list[np.ndarray] = []
        owner, size = [], []
        for item, text in items:
            words = words_of(text or "")
            if words:
                flat.append(np.fromiter((self.ids.setdefault(w, len(self.ids) + 1) for w in words), np.int32, len(words)))
                owner.append(len(names) if item is None else number[str(item)])
                size.append(len(words))
        self.words = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        self.mixed = self._mix(np.arange(len(self.ids) + 1, dtype=np.uint64))
        sizes, owners = np.array(size, np.int64), np.array(owner, np.int32)
        begins = np.cumsum(sizes) - sizes
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(np.minimum(sizes, window)).tolist():
            own = np.flatnonzero(np.minimum(sizes, window) == n)
            count = sizes[own] - n + 1
            start = np.repeat(begins[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
            of = np.repeat(owners[own], count)
            code = self._codes(self.words, start, n)
            order = np.lexsort((start, of, code))
            code, of, start = code[order], of[order], start[order]
            again = np.zeros(len(code), bool)  # the same window of the same item
            alike = 1 + np.flatnonzero((code[1:] == code[:-1]) & (of[1:] == of[:-1]))
            again[alike] = self._equal(self.words, start[alike], self.words, start[alike - 1], n)
            self.sizes[n] = code[~again], start[~again].astype(np.int32 if len(self.words) < 1 << 31 else np.int64), of[~again]

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = x * _FACTOR
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x[:1] = 0
        return x

    def _codes(self, words: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
        """A hash of the n words from each start."""
        h = np.zeros(len(start), np.uint64)
        for j in range(n):
            h = h * _FACTOR + self.mixed[words[start + j]]
        return h ^ (h >> np.uint64(29))

    @staticmethod
    def _equal(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
        same = np.ones(len(at), bool)
        for j in range(n):
            same &= a[at + j] == b[to + j]
        return same

    def scan(self, texts: list[list[bytes]]) -> list[tuple[np.ndarray, list[str | None]]]:
        """For each text's words: which of them are hit, and the items whose windows occur, by name."""
        get = self.ids.get
        starts = np.cumsum([0, *map(len, texts)])
        flat = np.fromiter((get(w, 0) for t in texts for w in t), np.int32, int(starts[-1]))
        hit = np.zeros(len(flat) + 1, np.int32)
        known = np.concatenate([[0], np.cumsum(flat > 0)])
        pairs = [np.zeros(0, np.int64)]
        for n, (codes, begins, owners) in self.sizes.items():
            # A window can only start where as many known words follow in the same text.
            at = np.flatnonzero(known[n:] - known[: len(flat) - n + 1] == n) if len(flat) >= n else np.zeros(0, np.int64)
            own = np.searchsorted(starts, at, "right") - 1
            inside = at + n <= starts[own + 1]
            at, own = at[inside], own[inside]
            code = self._codes(flat, at, n)
            first, last = np.searchsorted(codes, code, "left"), np.searchsorted(codes, code, "right")
            held = last - first
            at, own, first, held = at[held > 0], own[held > 0], first[held > 0], held[held > 0]
            for i, j in _runs(held, PAIRS):  # windows and the items that have them, so many at a time
                many = held[i:j]
                entry = np.repeat(first[i:j] - np.cumsum(many) + many, many) + np.arange(many.sum())
                place, doc = np.repeat(at[i:j], many), np.repeat(own[i:j], many)
                same = self._equal(flat, place, self.words, begins[entry], n)
                found = np.unique(place[same])
                np.add.at(hit, found, 1)
                np.add.at(hit, found + n, -1)
                pairs.append(np.unique(doc[same] * len(self.names) + owners[entry[same]]))
        covered = np.cumsum(hit[:-1]) > 0
        pair = np.unique(np.concatenate(pairs))
        edge = np.searchsorted(pair // len(self.names), np.arange(len(texts) + 1))
        items = [[self.names[k] for k in (pair[i:j] % len(self.names)).tolist()] for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        return [(covered[starts[k] : starts[k + 1]], items[k]) for k in range(len(texts))]


def _runs(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of counts with a sum of at most `most`, or of one count."""
    total, at = np.concatenate([[0], np.cumsum(counts)]), 0
    while at < len(counts):
        end = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        yield at, end
        at = end


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, str | None]]]:
    """The items in blocks of at most BLOCK_BYTES each; the size is checked before anything is collected."""
    items = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // (BLOCK_BYTES // 2)) if total > BLOCK_BYTES else 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r.item, r.text) for r in part.collect()]


def marked(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """(row, n_words, hits, items) for each document: all its columns, the positions of hit words, the ids of occurring items.

    With several blocks the scans follow one another, and each adds its marks to those of the one before; no rows move.
    The marks are written between blocks, and a block's broadcast is freed before the next one is made.
    """
    spark = docs.sparkSession
    empty = F.array().cast("array<int>")
    found = as_rows(docs).select("row", F.lit(0).cast("long").alias("n_words"), empty.alias("hits"), F.array().cast("array<string>").alias("items"))
    at = found.schema["row"].dataType.fieldNames().index(text_col)
    shared = None
    for block in _blocks(benchmark, "item_id", "text"):
        if shared is not None:
            found = written(found)
            shared.destroy()
        shared = spark.sparkContext.broadcast(WindowSet(block, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            windows = shared.value
            for batch in batches:
                sizes, hits, items = [], [], []
                for group in grouped((t.as_py() for t in batch.column(0).field(at)), GROUP_CHARS):
                    for covered, who in windows.scan([words_of(t) for t in group]):
                        sizes.append(len(covered))
                        hits.append(np.flatnonzero(covered).astype(np.int32))
                        items.append(who)
                for k, (old_hits, old_items) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                    if len(old_hits):
                        hits[k] = np.union1d(hits[k], np.array(old_hits.as_py(), np.int32))
                    if len(old_items):
                        items[k] = sorted({*items[k], *old_items.as_py()}, key=lambda name: (name is None, name))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                    ["row", "n_words", "hits", "items"],
                )

        found = found.mapInArrow(run, found.schema)
    return found


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row per document."""
    return marked(docs.select("doc_id", "text"), benchmark, window).select(
        "row.doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns."""
    return marked(docs, benchmark, window, text_col).where(F.size("hits") == 0).select("row.*")
