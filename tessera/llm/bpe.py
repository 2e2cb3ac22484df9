"""Byte-level BPE: encode whole texts with a rank file and decode the ids again.

Each match of the pre-tokenising pattern is encoded by itself. Its bytes are the leaves of a segment tree that holds,
for every live part, the rank of the pair it forms with its right neighbour; the root is the leftmost pair of minimum
rank. A merge changes three leaves, so it costs O(log n), and a match of n bytes O(n log n), also for the very long
ones. Results of short matches are kept in a cache of bounded size in each worker.

Defined results: a null text is encoded as the empty text; the empty text has no ids; repeated rows are encoded each;
columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a cache generation; two generations are kept.
CACHE_ENTRIES = 200_000
#: Texts are taken together until they hold so many characters, and their new matches are merged side by side.
GROUP_CHARS = 2_000_000

_NEVER = 1 << 62
_Found = tuple[str, bytes]  # ids printed with spaces between them, decoded bytes


class BytePairCodec:
    """Encoder and decoder for one rank file in tiktoken's format."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in lines if line.strip())}
        self.words = [b""] * (max(self.ranks.values()) + 1)
        for word, rank in self.ranks.items():
            self.words[rank] = word
        self.names = list(map(str, range(len(self.words))))
        self.find = regex.compile(pattern).findall
        get = self.ranks.get
        # Every pair of ids whose bytes together are a word, sorted, for look-ups of many pairs at once.
        pairs = [(get(w[:i]), get(w[i:]), rank) for w, rank in self.ranks.items() for i in range(1, len(w))]
        table = sorted(((a << 24) | b, rank) for a, b, rank in pairs if a is not None and b is not None)
        self.pair_codes = np.array([x[0] for x in table] + [_NEVER], np.int64)
        self.pair_ranks = np.array([x[1] for x in table] + [-1], np.int64)
        self.byte_ids = np.array([get(bytes([i]), -1) for i in range(256)], np.int64)
        #: Results by the text behind a space, and by text without one; each young and old.
        self.spaced: list[dict[str, _Found]] = [{}, {}]
        self.bare: list[dict[str, _Found]] = [{}, {}]

    def merge(self, word: bytes) -> list[int]:
        """The ids of one match."""
        ranks = self.ranks
        whole = ranks.get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        width = 1 << (n - 1).bit_length()
        shift = width.bit_length()
        mask = (1 << shift) - 1
        get = ranks.get
        # A leaf holds rank and position in one number, so that the minimum is the leftmost pair of the least rank.
        tree = [_NEVER] * (2 * width)
        for i in range(n - 1):
            rank = get(word[i : i + 2])
            if rank is not None:
                tree[width + i] = rank << shift | i
        for x in range(width - 1, 0, -1):
            tree[x] = min(tree[2 * x], tree[2 * x + 1])
        after = list(range(1, n + 1))  # start of the next live part
        before = list(range(-1, n))
        while (low := tree[1]) != _NEVER:
            i = low & mask
            j = after[i]
            k = after[j]
            after[i] = k
            before[k] = i
            changed = [(j, None), (i, get(word[i : after[k]]) if k < n else None)]
            if (p := before[i]) >= 0:
                changed.append((p, get(word[p:k])))
            for at, rank in changed:
                x = width + at
                tree[x] = _NEVER if rank is None else rank << shift | at
                while x > 1:
                    x >>= 1
                    low = min(tree[2 * x], tree[2 * x + 1])
                    if tree[x] == low:
                        break
                    tree[x] = low
        ids, i = [], 0
        while i < n:
            ids.append(ranks[word[i : after[i]]])
            i = after[i]
        return ids

    def _pair_keys(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaves for pairs of ids, -1 where there is no right part; a leaf is rank * 64 + position."""
        codes = (left << 24) | right
        slot = np.searchsorted(self.pair_codes, codes)
        hit = (self.pair_codes[slot] == codes) & (right >= 0) & (left >= 0)
        return np.where(hit, self.pair_ranks[slot] << 6 | at, _NEVER)

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """The ids of many matches: one segment tree a match, all trees updated side by side."""
        out: list[list[int]] = [[]] * len(words)
        shorts: dict[int, list[int]] = {4: [], 8: [], 16: [], 32: []}
        for at, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is not None:
                out[at] = [whole]
            elif len(word) > 32:
                out[at] = self.merge(word)
            else:
                shorts[max(4, 1 << (len(word) - 1).bit_length())].append(at)
        for width, chosen in shorts.items():
            for start in range(0, len(chosen), 20_000):
                part = chosen[start : start + 20_000]
                for at, ids in zip(part, self._merge_width([words[i] for i in part], width), strict=True):
                    out[at] = ids
        return out

    def _merge_width(self, words: list[bytes], width: int) -> list[list[int]]:
        n = len(words)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        size = np.fromiter(map(len, words), np.int64, n)
        col = np.arange(width)
        # One more column on the right: no part is there.
        ids = np.full((n, width + 1), -1, np.int64)
        ids[:, :width] = np.where(col < size[:, None], self.byte_ids[raw], -1)
        after = np.minimum(np.tile(np.arange(1, width + 2), (n, 1)), size[:, None])
        before = np.tile(np.arange(-1, width), (n, 1))
        tree = np.full((n, 2 * width), _NEVER, np.int64)
        tree[:, width:] = self._pair_keys(ids[:, :width].ravel(), ids[:, 1:].ravel(), np.tile(col, n)).reshape(n, width)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        live = np.flatnonzero(tree[:, 1] != _NEVER)
        while len(live):
            low = tree[live, 1]
            i = low & 63
            j = after[live, i]
            k = after[live, j]
            merged = low >> 6
            ids[live, i] = merged
            ids[live, j] = -1
            after[live, i] = k
            before[live, k] = i
            self._update(tree, live, width + j, np.full(len(live), _NEVER))
            self._update(tree, live, width + i, self._pair_keys(merged, ids[live, k], i))
            p = before[live, i]
            has = p >= 0
            rows, p = live[has], p[has]
            self._update(tree, rows, width + p, self._pair_keys(ids[rows, p], merged[has], p))
            live = live[tree[live, 1] != _NEVER]
        flat = ids[:, :width]
        kept = flat >= 0
        values = flat[kept].tolist()
        ends = np.cumsum(kept.sum(axis=1)).tolist()
        return [values[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    @staticmethod
    def _update(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        """Point updates, one leaf a tree: up from the leaf to the root."""
        tree[rows, leaf] = value
        x = leaf
        for _ in range((tree.shape[1] // 2).bit_length() - 1):
            value = np.minimum(value, tree[rows, x ^ 1])
            x = x >> 1
            tree[rows, x] = value

    def encode(self, text: str) -> list[int]:
        return [i for match in self.find(text) for i in self.merge(match.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))

    def _learn(self, cache: list[dict[str, _Found]], lead: str, missing: set[str]) -> None:
        """Encode and decode new pieces into the young cache."""
        pieces: list[tuple[str, list[str]]] = []
        single: list[str] = []
        for key in missing:
            if key.isascii() and key.isalpha():  # a match by itself
                single.append(key)
            else:
                pieces.append((key, self.find(lead + key)))
        new = list({m for _, matches in pieces for m in matches}.difference([lead + key for key in single]))
        encoded = self.merge_many([(lead + key).encode() for key in single] + [m.encode() for m in new])
        names, words = self.names, self.words
        done = [(" ".join([names[i] for i in ids]), b"".join([words[i] for i in ids])) for ids in encoded]
        young = cache[0]
        young.update(zip(single, done, strict=False))
        found = dict(zip(new, done[len(single) :], strict=True))
        cut = len(lead)
        for key, matches in pieces:
            parts = [found.get(m) or young[m[cut:]] for m in matches]
            young[key] = (" ".join([p[0] for p in parts]), b"".join([p[1] for p in parts])) if len(parts) > 1 else parts[0]

    def _see(self, cache: list[dict[str, _Found]], lead: str, words: set[str]) -> None:
        """Have all these words in the young cache; the cache holds two generations, and the older one goes when the younger is full."""
        young, old = cache
        if len(young) >= CACHE_ENTRIES:
            cache[:] = young, old = {}, young
        missing = words - young.keys()
        known = missing & old.keys()
        for word in known:
            young[word] = old[word]
        self._learn(cache, lead, missing - known)

    def round_trip(self, texts: list[str]) -> Iterator[tuple[int, str, bytes]]:
        """For each text: the number of ids, the ids printed with spaces between them, and the bytes that they decode to.

        A space or line feed that stands alone between two other characters starts a match or is one, so texts are cut
        in front of them, and equal pieces are encoded once. Other texts are cut by the pattern alone.
        """
        cut: list[list[list[str]] | list[str]] = []
        spaced: set[str] = set()
        bare: set[str] = set()
        for text in texts:
            if text and " ".join(text.split()) == text.replace("\n", " "):
                lines = [line.split(" ") for line in text.split("\n")]
                for line in lines:
                    bare.add(line[0])
                    spaced.update(line[1:])
                cut.append(lines)
            else:
                matches = self.find(text)
                bare.update(matches)
                cut.append(matches)
        self._see(self.spaced, " ", spaced)
        self._see(self.bare, "", bare | {"\n"})
        with_space, without = self.spaced[0], self.bare[0]
        feed = without["\n"]
        for pieces in cut:
            found: list[_Found] = []
            for piece in pieces:
                if isinstance(piece, str):
                    found.append(without[piece])
                else:
                    if found:
                        found.append(feed)
                    found.append(without[piece[0]])
                    found += [with_space[w] for w in piece[1:]]
            if found:
                ids, data = zip(*found, strict=True)
                printed = " ".join(ids)
                yield printed.count(" ") + 1, printed, b"".join(data)
            else:
                yield 0, "", b""


def _groups(texts: Iterator[str]) -> Iterator[list[str]]:
    """Texts in order, together as long as they hold at most GROUP_CHARS."""
    group: list[str] = []
    size = 0
    for text in texts:
        if group and size + len(text) > GROUP_CHARS:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


_codecs: dict[tuple[str, str], BytePairCodec] = {}


def codec(path: str, pattern: str) -> BytePairCodec:
    """The worker's codec for this rank file; built once in each Python worker."""
    key = (path, pattern)
    if key not in _codecs:
        _codecs[key] = BytePairCodec(path, pattern)
    return _codecs[key]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the ids of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            ids = [own.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "id long, ids array<int>")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, data binary): the bytes that each row's ids stand for; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            data = [own.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["id", "data"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, data binary")


def round_trip_digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, without moving the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        gc.disable()  # the caches are many small objects without cycles; walking them costs a third of the time
        try:
            for batch in batches:
                counts, ids_sha, data_sha = [], [], []
                for group in _groups(t.as_py() or "" for t in batch.column(1)):
                    for n, ids, data in own.round_trip(group):
                        counts.append(n)
                        ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                        data_sha.append(hashlib.sha256(data).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(data_sha, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        finally:
            gc.enable()

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
