"""Suffix-array dedup with sparse suffix arrays.

Only the suffixes that begin at minimisers are kept: of the anchors in any N consecutive words the one with the
smallest hash, so a passage of N words has at least one, chosen by its own words. Suffixes with the same minimiser meet
in one shard (see windows.py), each with as many words to the left and right as its windows have. There they are
sorted, and the common prefix with each neighbour in the order is found; a stretch of neighbours that all share at
least R words matches R words to the right of the minimiser. Within such a stretch matches are extended to the left by
comparing the words before the minimiser. A window of N words, L of them left and R right, is repeated where both hold,
and goes where a smaller document has it; overlapping windows grow into maximal spans.

Defined results: as in substring_dedup.py, with passages of N = 50 words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.llm.windows import GROUP_SEGMENTS, SHARD_SEGMENTS, Limits, Segment, removed, without

#: Words of the shortest passage that counts as repeated.
WINDOW = 50
#: Words of an anchor.
ANCHOR = 8


def _common(a: list[bytes], b: list[bytes]) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def match(segments: list[Segment], n: int) -> list[list[int]]:
    """For each segment of a minimiser the smallest holder of each window."""
    right = [s.words[s.anchor :] for s in segments]
    order = sorted(range(len(segments)), key=right.__getitem__)
    prefix = [_common(right[a], right[b]) for a, b in zip(order, order[1:], strict=False)]
    first = [[s.doc] * (len(s.words) - n + 1) for s in segments]
    most = max(s.anchor for s in segments)
    for left in range(most + 1):
        # Stretches of the order that share n - left words, and in them the segments by the words before the minimiser.
        groups: dict[tuple[bytes, ...], list[int]] = {}
        for k, i in enumerate(order):
            s = segments[i]
            start = s.anchor - left
            if 0 <= start < len(first[i]):
                groups.setdefault(tuple(s.words[start : s.anchor]), []).append(i)
            if k == len(prefix) or prefix[k] < n - left:
                for same in groups.values():
                    if len(same) > 1:
                        least = min(segments[j].doc for j in same)
                        for j in same:
                            first[j][segments[j].anchor - left] = least
                groups = {}
    return first


def deduplicated(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", limits: Limits = (GROUP_SEGMENTS, SHARD_SEGMENTS)) -> DataFrame:
    """(row, n_words, n_removed, spans, kept) for each document."""
    return without(docs, removed(docs, match, window, anchor, id_col, text_col, limits), id_col, text_col)
