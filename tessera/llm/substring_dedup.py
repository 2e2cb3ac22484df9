"""Substring dedup with suffix automata of reference shards.

The reference of a document are all documents with a smaller id, so the automata of all shards together grow with the
corpus and can't be broadcast whole. Segments are therefore dealt to the shard of their minimiser (see windows.py). A
shard builds one generalised suffix automaton over the segments of a minimiser, smallest document first, so that every
state keeps the smallest document that holds its words; then it streams the segments through it. The matching
statistics give, at each word, the state of the longest match; where that is at least N words long, the state of the
last N tells the smallest holder of the window. Windows with a smaller holder are removed, as maximal spans.

Defined results: a null text has no words; a null id neither loses words nor makes others lose any; of documents with
equal ids none is smaller; windows are judged on the input; documents under N words are kept whole; words are runs of
anything but the six ASCII white-space characters; other columns are ignored or passed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.llm.windows import GROUP_SEGMENTS, SHARD_SEGMENTS, Limits, Segment, removed, without

#: Words of a window: the length threshold of removed spans.
WINDOW = 13
#: Words of an anchor.
ANCHOR = 5


class SuffixAutomaton:
    """Generalised suffix automaton over words; each state keeps the document that made it first."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.size = [0]
        self.doc = [-1]

    def _state(self, steps: dict[bytes, int], link: int, size: int, doc: int) -> int:
        self.next.append(steps)
        self.link.append(link)
        self.size.append(size)
        self.doc.append(doc)
        return len(self.size) - 1

    def add(self, words: list[bytes], doc: int) -> None:
        """Take in a text; documents come in ascending order."""
        nxt, link, size = self.next, self.link, self.size
        last = 0
        for word in words:
            to = nxt[last].get(word)
            if to is not None:
                last = to if size[to] == size[last] + 1 else self._split(last, word, to)
                continue
            new = self._state({}, 0, size[last] + 1, doc)
            at = last
            while at >= 0 and word not in nxt[at]:
                nxt[at][word] = new
                at = link[at]
            if at >= 0:
                to = nxt[at][word]
                link[new] = to if size[to] == size[at] + 1 else self._split(at, word, to)
            last = new

    def _split(self, at: int, word: bytes, to: int) -> int:
        """A state of its own for the shorter words of a state; both were first held by the same document."""
        nxt, link = self.next, self.link
        copy = self._state(dict(nxt[to]), link[to], self.size[at] + 1, self.doc[to])
        link[to] = copy
        while at >= 0 and nxt[at].get(word) == to:
            nxt[at][word] = copy
            at = link[at]
        return copy

    def holders(self, words: list[bytes], n: int) -> list[int]:
        """For each window of n words the smallest document that holds it, or -1."""
        nxt, link, size, doc = self.next, self.link, self.size, self.doc
        state = matched = 0
        out = []
        for i, word in enumerate(words):
            while state and word not in nxt[state]:
                state = link[state]
                matched = size[state]
            if word in nxt[state]:
                state = nxt[state][word]
                matched += 1
            if matched >= n:
                while size[link[state]] >= n:
                    state = link[state]
                matched = min(matched, size[state])
            if i >= n - 1:
                out.append(doc[state] if matched >= n else -1)
        return out


def match(segments: list[Segment], n: int) -> list[list[int]]:
    """For each segment of a minimiser the smallest holder of each window."""
    automaton = SuffixAutomaton()
    for s in sorted(segments, key=lambda s: s.doc):
        automaton.add(s.words, s.doc)
    return [automaton.holders(s.words, n) for s in segments]


def deduplicated(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", limits: Limits = (GROUP_SEGMENTS, SHARD_SEGMENTS)) -> DataFrame:
    """(row, n_words, n_removed, spans, kept) for each document."""
    return without(docs, removed(docs, match, window, anchor, id_col, text_col, limits), id_col, text_col)
