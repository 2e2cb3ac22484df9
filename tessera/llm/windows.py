"""Routing of word windows to shards, for the operators that remove text which other documents hold too.

A window is N consecutive words of one document. Of the anchors in it (all runs of M words) the one with the smallest
hash is its minimiser; it depends on the window's words only, so equal windows have equal minimisers. Consecutive
windows with the same minimiser occurrence form a segment, some 1 + (N - M) / 2 windows. Segments go to the shard of
their minimiser, and there alone can their windows meet equal ones. One shuffle moves them, compressed; then the
removed intervals of each document come back to it by its key.

- Before the shuffle a task drops segments that a smaller document of the same task holds word by word: these are
  removed wherever else they occur. A group of copies thus sends one segment a task, however many documents it has.
- A shard's segments are matched by the caller's function, one minimiser at a time.
- A minimiser with more than GROUP_SEGMENTS segments (a passage that very many documents share has a segment of other
  neighbours in each) is split: its windows are dealt anew by their next smallest anchor, which equal windows have in
  common too, and matched there by the same function. So is a whole shard of more than SHARD_SEGMENTS, block by block as
  it comes. Windows have N - M + 1 anchors, and those that agree in all of them are equal, so this ends.
- There are as many shards as the texts need at PART_BYTES each, and two for each shuffle partition at least.

Keys are the document's id and a 64-bit hash of its text, so that rows with equal ids are kept apart. Rows with a null
id or text are neither references nor do they lose words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import written

#: Characters of text that a task takes together before it sends segments (some 25 bytes of memory each).
GROUP_CHARS = 3_000_000
#: Segments of a minimiser that are matched together (20,000 make an automaton of 150 MB), and of a shard.
GROUP_SEGMENTS, SHARD_SEGMENTS = 10_000, 500_000
#: Bytes of text for each partition, about.
PART_BYTES = 16_000_000

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Anchors are told apart by 48 bits; words are compared when they are matched.
_CODE = np.uint64((1 << 48) - 1)
_hash = xxhash.xxh3_64_intdigest


@dataclass(frozen=True)
class Segment:
    """The words of one or more windows with the same minimiser, which begins at word `anchor`; `doc` is the smallest holder."""

    words: list[bytes]
    anchor: int
    doc: int


#: Segments of a minimiser and of a shard, beyond which they are split.
Limits = tuple[int, int]
#: For the segments of one minimiser, by document: for each, the smallest document that holds each of its windows.
Matcher = Callable[[list[Segment], int], list[list[int]]]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _prefix(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes, so that any stretch can be hashed from two of them."""
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(codes), _FACTOR)]))
    # p[i] = sum of codes[k] * F^-k for k < i, in arithmetic modulo 2^64 (F is odd, so it has an inverse)
    inverse = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
    down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(codes), inverse)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * down[:-1], dtype=np.uint64)])
    return np.stack([sums, powers])


def _stretch(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of words start to end."""
    return _mixed((prefix[0][end] - prefix[0][start]) * prefix[1][start] + (end - start).astype(np.uint64))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """For each `width` consecutive values the position of the leftmost least one, by doubling."""
    at = np.arange(len(values))
    span = 1
    while span < width:
        step = min(span, width - span)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        span += step
    return at


def segments_of(words: list[bytes], ends: np.ndarray, n: int, m: int) -> tuple[np.ndarray, ...]:
    """Start, number of windows, anchor position, anchor hash and segment hash of all segments of documents that end at `ends`."""
    total = len(words)
    codes = np.fromiter(map(_hash, words), np.uint64, total)
    prefix = _prefix(codes)
    at = np.arange(max(0, total - m + 1))
    anchors = _stretch(prefix, at, at + m)
    anchors &= _CODE
    best = _least(anchors, n - m + 1)
    doc_end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))[: len(best)]
    start = np.flatnonzero(np.arange(len(best)) + n <= doc_end)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    chosen = best[start]
    first = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (start[1:] != start[:-1] + 1)]))
    count = np.diff(np.concatenate([first, [len(start)]]))
    begin, anchor = start[first], chosen[first]
    return begin, count, anchor, anchors[anchor], _stretch(prefix, begin, begin + count + n - 1)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block; bytes of equal weight stand together."""
    sizes = np.array([len(a) for a in arrays], np.int64).tobytes()
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(sizes + planes)


def _unpacked(block: bytes, kinds: list[type]) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(block)
    sizes = np.frombuffer(data, np.int64, len(kinds))
    out, at = [], 8 * len(kinds)
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, size * width, at)
        out.append(np.ascontiguousarray(planes.reshape(width, size).T).view(kind).reshape(size) if size else np.zeros(0, kind))
        at += size * width
    return out


_META = [np.uint64, np.int32, np.int32, np.int32, np.int32, np.int64, np.int64]
#: Removed stretches of a document, or a message to a shard of the next level.
_FOUND = "doc_id long, text_hash long, starts array<int>, sizes array<int>, bucket int, meta binary, words binary"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("starts", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("bucket", pa.int32()), ("meta", pa.binary()), ("words", pa.binary())]
)


def _messages(bucket: np.ndarray, code: np.ndarray, anchor: np.ndarray, cuts: tuple[list[int], list[int]], blob: bytes, holders: np.ndarray, doc: np.ndarray, at: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> Iterator[tuple]:
    """(bucket, meta, words) for segments in the order of bucket and code; the holders of each in doc and at, its words blob[from:to]."""
    if not len(bucket):
        return
    held = np.concatenate([[0], np.cumsum(holders)])
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    squeeze = zstandard.ZstdCompressor(level=5).compress
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        a, b = held[x], held[y]
        own, of = np.unique(doc[a:b], return_inverse=True)
        steps = np.diff(code[x:y], prepend=np.uint64(0))
        meta = _packed(steps, anchor[x:y].astype(np.int32), holders[x:y].astype(np.int32), of.astype(np.int32), at[a:b].astype(np.int32), ids[own], hashes[own])
        yield int(bucket[x]), meta, squeeze(b"\n".join([blob[i:j] for i, j in zip(cuts[0][x:y], cuts[1][x:y], strict=True)]))


def _requests(ids: np.ndarray, hashes: np.ndarray, texts: list[bytes], n: int, m: int, buckets: int) -> Iterator[tuple]:
    """(bucket, meta, words, local answers) for a group of documents."""
    hashes = hashes.astype(np.int64)  # as wide as it is read
    words: list[bytes] = []
    ends = []
    for text in texts:
        words += text.split()
        ends.append(len(words))
    starts = np.array([0, *ends[:-1]], np.int64)
    begin, count, anchor, code, whole = segments_of(words, np.array(ends, np.int64), n, m)
    if not len(begin):
        return
    doc = np.searchsorted(starts, begin, "right") - 1
    bucket = (code % np.uint64(buckets)).astype(np.int64)
    offset = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    blob = b" ".join(words)
    del words

    def ordered(whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((ids[doc], whole, code, bucket))
        return order, np.concatenate([[True], (code[order][1:] != code[order][:-1]) | (whole[order][1:] != whole[order][:-1])])

    text = lambda k: blob[offset[begin[k]] : offset[begin[k] + count[k] + n - 1] - 1]
    order, new = ordered(whole)
    if any(text(order[i]) != text(order[i - 1]) for i in np.flatnonzero(~new).tolist()):  # other words with the same hash
        order, new = ordered(np.unique([text(k) for k in range(len(begin))], return_inverse=True)[1])
    begin, count, anchor, code, doc, bucket = (x[order] for x in (begin, count, anchor, code, doc, bucket))
    segment = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    # A smaller document of this group has the same segment: all its windows go.
    local = ids[doc] > ids[doc[head]][segment]
    at, size = (begin - starts[doc]).astype(np.int32), (count + n - 1).astype(np.int32)
    answers = (doc[local], at[local], size[local])
    sent = ~local
    holders = np.bincount(segment[sent], minlength=len(head))
    cuts = offset[begin[head]].tolist(), (offset[begin[head] + count[head] + n - 1] - 1).tolist()
    yield from _messages(bucket[head], code[head], (anchor - begin)[head], cuts, blob, holders, doc[sent], at[sent], ids, hashes)
    if len(answers[0]):
        order = np.argsort(answers[0], kind="stable")
        of, at, size = (z[order] for z in answers)
        own, inverse = np.unique(of, return_inverse=True)
        yield int(ids[own[0]]) % buckets, None, _packed(inverse.astype(np.int32), at, size, ids[own], hashes[own])


def _send(batches: Iterator[pa.RecordBatch], n: int, m: int, buckets: int) -> Iterator[pa.RecordBatch]:
    names = ["bucket", "meta", "words"]

    def flush() -> pa.RecordBatch | None:
        rows = list(_requests(np.array(ids, np.int64), np.array(hashes, np.int64), texts, n, m, buckets))
        kinds = (pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    ids: list[int] = []
    hashes: list[int] = []
    texts: list[bytes] = []
    held = 0
    for batch in batches:
        for i, h, text in zip(*batch.columns, strict=True):
            data = text.as_py().encode()
            if texts and held + len(data) > GROUP_CHARS:
                yield flush()
                ids, hashes, texts, held = [], [], [], 0
            ids.append(i.as_py())
            hashes.append(h.as_py())
            texts.append(data)
            held += len(data)
    if texts:
        yield flush()


class _Shard:
    """The segments of one bucket as they come, and what is found for them."""

    def __init__(self, n: int, m: int, matcher: Matcher, level: int, buckets: int, limits: Limits) -> None:
        self.n, self.m, self.matcher, self.level, self.buckets, self.limits = n, m, matcher, level, buckets, limits
        self.blocks: list[tuple[list[np.ndarray], bytes]] = []
        self.segments = 0
        self.last = level >= n - m  # no anchor is left to split by
        self.split = False
        self.found: list[tuple[int, int, int, int]] = []  # doc, text hash, start, size

    def add(self, meta: bytes, words: bytes) -> Iterator[pa.RecordBatch]:
        block = _unpacked(meta, _META), words
        self.segments += len(block[0][0])
        if not self.split and not self.last and self.segments > self.limits[1]:
            self.split = True
            for old in self.blocks:
                yield self.dealt(*old)
            self.blocks = []
        if self.split:
            yield self.dealt(*block)
        else:
            self.blocks.append(block)

    def dealt(self, meta: list[np.ndarray], packed: bytes, wanted: np.ndarray | None = None) -> pa.RecordBatch:
        """Messages to the next level: the windows of these segments by their next smallest anchor."""
        n, m = self.n, self.m
        steps, _, holders, of, at, ids, hashes = meta
        code = np.cumsum(steps, dtype=np.uint64)
        lines = zstandard.ZstdDecompressor().decompress(packed).split(b"\n")
        chosen = np.arange(len(code)) if wanted is None else np.flatnonzero(wanted)
        words: list[bytes] = []
        ends = []
        for k in chosen.tolist():
            words += lines[k].split(b" ")
            ends.append(len(words))
        sizes = np.diff([0, *ends])
        starts = np.array(ends, np.int64) - sizes
        prefix = _prefix(np.fromiter(map(_hash, words), np.uint64, len(words)))
        place = np.arange(max(0, len(words) - m + 1))
        anchors = _stretch(prefix, place, place + m) & _CODE
        windows = sizes - n + 1
        segment = np.repeat(np.arange(len(chosen)), windows)
        begin = np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows) + starts[segment]
        spot = np.empty(len(begin), np.int64)
        for i in range(0, len(begin), 1 << 16):
            around = anchors[begin[i : i + (1 << 16), None] + np.arange(n - m + 1)]
            spot[i : i + (1 << 16)] = begin[i : i + (1 << 16)] + np.argsort(around, axis=1, kind="stable")[:, self.level + 1]
        first = np.flatnonzero(np.concatenate([[True], (spot[1:] != spot[:-1]) | (segment[1:] != segment[:-1])]))
        count = np.diff(np.concatenate([first, [len(begin)]]))
        begin, spot, segment = begin[first], spot[first], segment[first]
        finer = _mixed(code[chosen][segment] * _FACTOR + anchors[spot]) & _CODE
        bucket = (finer % np.uint64(self.buckets)).astype(np.int64)
        order = np.lexsort((finer, bucket))
        begin, spot, segment, count, finer, bucket = (x[order] for x in (begin, spot, segment, count, finer, bucket))
        offset = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
        cuts = offset[begin].tolist(), (offset[begin + count + n - 1] - 1).tolist()
        held = np.concatenate([[0], np.cumsum(holders)])
        many = holders[chosen][segment].astype(np.int64)
        which = np.repeat(held[chosen][segment], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        rows = list(_messages(bucket, finer, spot - begin, cuts, b" ".join(words), many, of[which], at[which] + np.repeat(begin - starts[segment], many), ids, hashes))
        columns = [pa.array([r[k] for r in rows], _ARROW.field(4 + k).type) for k in range(3)]
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(rows), f.type) for f in list(_ARROW)[:4]), *columns], schema=_ARROW)

    def match(self) -> Iterator[pa.RecordBatch]:
        """Match the segments of all minimisers that several documents hold, but for those that are split."""
        if not self.blocks:
            return
        code = np.concatenate([np.cumsum(b[0][0], dtype=np.uint64) for b in self.blocks])
        anchor = np.concatenate([b[0][1] for b in self.blocks])
        holders = np.concatenate([b[0][2] for b in self.blocks])
        doc = np.concatenate([b[0][5][b[0][3]] for b in self.blocks])
        text = np.concatenate([b[0][6][b[0][3]] for b in self.blocks])
        at = np.concatenate([b[0][4] for b in self.blocks])
        held = np.concatenate([[0], np.cumsum(holders)])
        least = doc[held[:-1]]  # all holders that are sent with a segment have the same id
        order = np.lexsort((least, code))
        sorted_code, sorted_doc = code[order], least[order]
        edge = np.flatnonzero(np.concatenate([[True], sorted_code[1:] != sorted_code[:-1], [True]]))
        several = sorted_doc[edge[:-1]] != sorted_doc[edge[1:] - 1]
        large = several & (np.diff(edge) > self.limits[0]) & (not self.last)
        several &= ~large
        if large.any():
            split, begin = np.isin(code, sorted_code[edge[:-1][large]]), 0
            for meta, words in self.blocks:
                end = begin + len(meta[0])
                if split[begin:end].any():
                    yield self.dealt(meta, words, split[begin:end])
                begin = end
        wanted = np.zeros(len(code), bool)
        wanted[order[np.repeat(several, np.diff(edge))]] = True
        lines: dict[int, bytes] = {}
        begin = 0
        for meta, words in self.blocks:
            end = begin + len(meta[0])
            mine = np.flatnonzero(wanted[begin:end]).tolist()
            if mine:
                texts = zstandard.ZstdDecompressor().decompress(words).split(b"\n")
                lines.update((begin + i, texts[i]) for i in mine)
            begin = end
        bounds = held.tolist()
        for x, y in zip(edge[:-1][several].tolist(), edge[1:][several].tolist(), strict=True):
            group = order[x:y].tolist()
            kinds: dict[bytes, list[int]] = {}
            for s in group:  # by document, so the first of equal segments has the smallest
                kinds.setdefault(lines[s], []).append(s)
            if len(kinds) == 1:
                smallest = int(least[group[0]])
                for s in group:
                    if least[s] > smallest:
                        size = len(lines[s].split(b" "))
                        self.found += [(int(doc[h]), int(text[h]), int(at[h]), size) for h in range(bounds[s], bounds[s + 1])]
                continue
            segments = [Segment(key.split(b" "), int(anchor[of[0]]), int(least[of[0]])) for key, of in kinds.items()]
            for first, of in zip(self.matcher(segments, self.n), kinds.values(), strict=True):
                for s in of:
                    mine = int(least[s])
                    for start, size in _intervals([f < mine for f in first], self.n):
                        self.found += [(int(doc[h]), int(text[h]), int(at[h]) + start, size) for h in range(bounds[s], bounds[s + 1])]
        self.blocks = []

    def answers(self) -> Iterator[pa.RecordBatch]:
        yield from self.match()
        if self.found:
            table = np.array(self.found, np.int64)
            self.found = []
            yield _answers(table[:, 0], table[:, 1], table[:, 2], table[:, 3])


def _intervals(gone: list[bool], n: int) -> list[tuple[int, int]]:
    """Runs of windows that go, as start and number of words."""
    out: list[tuple[int, int]] = []
    for i, g in enumerate(gone):
        if g:
            if out and out[-1][0] + out[-1][1] == i + n - 1:
                out[-1] = (out[-1][0], out[-1][1] + 1)
            else:
                out.append((i, n))
    return out


def _answers(doc: np.ndarray, text: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """One row for each document."""
    order = np.lexsort((at, text, doc))
    doc, text, at, size = doc[order], text[order], at[order].astype(np.int32), size[order].astype(np.int32)
    edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]), [True]])).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(edge), pa.array(x)) for x in (at, size)]
    none = [pa.nulls(len(edge) - 1, f.type) for f in list(_ARROW)[4:]]
    return pa.RecordBatch.from_arrays([pa.array(doc[edge[:-1]]), pa.array(text[edge[:-1]]), *lists, *none], schema=_ARROW)


def _match(batches: Iterator[pa.RecordBatch], n: int, m: int, matcher: Matcher, level: int, buckets: int, limits: Limits) -> Iterator[pa.RecordBatch]:
    """The rows come sorted by bucket."""
    now, shard = None, _Shard(n, m, matcher, level, buckets, limits)
    for batch in batches:
        for bucket, meta, words in zip(*batch.columns, strict=True):
            if bucket.as_py() != now:
                yield from shard.answers()
                now, shard = bucket.as_py(), _Shard(n, m, matcher, level, buckets, limits)
            if meta.is_valid:
                yield from shard.add(meta.as_py(), words.as_py())
            else:  # answers that a task knew before the shuffle
                of, at, size, ids, hashes = _unpacked(words.as_py(), [np.int32, np.int32, np.int32, np.int64, np.int64])
                yield _answers(ids[of], hashes[of], at, size)
    yield from shard.answers()


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(text_col)


def removed(docs: DataFrame, matcher: Matcher, n: int, m: int, id_col: str = "doc_id", text_col: str = "text", limits: Limits = (GROUP_SEGMENTS, SHARD_SEGMENTS)) -> DataFrame:
    """(doc_id, text_hash, starts, sizes): the removed stretches of words of each document that has any."""
    source = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), _text_hash(text_col), F.col(text_col))
    held = source.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // PART_BYTES))
    buckets = 2 * parts
    sent = source.mapInArrow(lambda it: _send(it, n, m, buckets), "bucket int, meta binary, words binary")
    found = None
    for level in range(n - m + 1):
        dealt = sent.repartition(parts, "bucket").sortWithinPartitions("bucket")
        rows = written(dealt.mapInArrow(lambda it, level=level: _match(it, n, m, matcher, level, buckets, limits), _FOUND))
        answers = rows.where(F.col("bucket").isNull()).select("doc_id", "text_hash", "starts", "sizes")
        found = answers if found is None else found.unionByName(answers)
        sent = rows.where(F.col("bucket").isNotNull()).select("bucket", "meta", "words")
        if sent.isEmpty():
            break
    return found.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("sizes")).alias("sizes"))


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts = [squeeze(t.as_py().encode()) if t.is_valid else None for t in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.binary())], batch.schema.names)


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, n_words, n_removed, spans, kept): all other columns, the removed stretches of words, and the kept words joined by spaces."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    left = docs.select(F.struct(*others).alias("row"), F.col(id_col).cast("long").alias("_id"), _text_hash(text_col).alias("_hash"), F.col(text_col).alias("_text"))
    left = left.mapInArrow(_squeezed, T.StructType([*left.schema.fields[:3], T.StructField("_text", T.BinaryType())]))  # less to shuffle
    # Always the join that large tables need: a broadcast of few removed stretches would hide its share of the disk from a small run.
    joined = left.join(gone.hint("merge"), (F.col("_id") == F.col("doc_id")) & (F.col("_hash") == F.col("text_hash")), "left").select("row", "_text", "starts", "sizes")
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType(
        [joined.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sizes, lost, spans, kept = [], [], [], []
            for text, starts, counts in zip(*batch.columns[1:], strict=True):
                words = expand(text.as_py()).split() if text.is_valid else []
                sizes.append(len(words))
                if not starts.is_valid:
                    lost.append(0)
                    spans.append([])
                    kept.append(b" ".join(words))
                    continue
                edge = np.zeros(len(words) + 1, np.int64)
                at = np.array(starts.as_py(), np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + np.array(counts.as_py(), np.int64), -1)
                out = np.cumsum(edge[:-1]) > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8))).tolist()
                spans.append([{"start": a, "end": b} for a, b in zip(turns[::2], turns[1::2], strict=True)])
                lost.append(int(out.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~out).tolist()]))
            fields = [pa.array(sizes, pa.int64()), pa.array(lost, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *fields, pa.array(kept, pa.binary()).cast(pa.string())], schema.fieldNames())

    return joined.mapInArrow(run, schema)
