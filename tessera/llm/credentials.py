"""Secret scans with multipart credential linking.

Base rules report strong secrets by themselves: assigned values, access identifiers and long hexadecimal runs. Weak
candidates are not worth a report alone: short or split identifiers, high-entropy runs (20 to 64 characters of mixed
kinds, outside urls and named values), assigned short values, hosts and addresses. Scopes are stretches of text between blank lines. Within a scope an interval
join brings together parts of three roles (identifier, secret, endpoint); a weak candidate is reported only if a part
of another role, weak or strong, lies within REACH characters of it, and a secret or an identifier is among them.

The join sorts the intervals of a document by place and sweeps them once, so its cost follows the number of
candidates and links, not its square: of the parts of a role and scope the furthest end up to each place is kept.

Defined results: a null text is scanned as the empty text; an empty text gives no spans; equal rows are scanned each;
positions are code points with exclusive ends; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._common import annotate, as_rows

#: Parts further apart than so many characters aren't linked.
REACH = 160

# The base rules, in the order in which kinds are listed, with the least length of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ["assign", "access", "hex", "weak_identifier", "weak_secret", "weak_endpoint"]

#: Weak candidates by role. Words of prose match none of them.
IDENTIFIER = re.compile(r"""\b(?:client_?id|access_?key(?:_?id)?|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{4,}""", re.I | re.A)
SECRET = re.compile(r"""\b(?:client_?secret|private_?key|auth|bearer|pwd|pass)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}""", re.I | re.A)
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,64}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"(?:https?|jdbc:\w+|postgres|mysql|redis|mongodb|amqp|s3)://[A-Za-z0-9.:@/_%-]{4,}|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5})?(?![0-9.])", re.A)
_BREAK = re.compile(r"\n[ \t]*\n")
_WORDS = ("passw", "secret", "token", "api")
_WEAK_WORDS = ("client", "access", "account", "user", "login", "private", "auth", "bearer", "pwd", "pass")

Span = tuple[str, int, int]


def base_spans(text: str, low: str) -> list[Span]:
    """The strong secrets: leftmost matches that don't overlap, per kind; what is too short is dropped afterwards."""
    found: list[Span] = []
    if any(w in low for w in _WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def _mixed(run: str) -> bool:
    """Lower-case and upper-case letters and digits, each at least twice: not prose, not a path of words."""
    return sum(c.isdigit() for c in run) > 1 and sum(c.islower() for c in run) > 1 and sum(c.isupper() for c in run) > 1


def _overlap(spans: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Tells whether an interval overlaps any of the spans: the furthest end of those that begin before its own end."""
    spans = sorted(spans)
    starts, ends = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))

    def inside(a: int, b: int) -> bool:
        at = bisect_left(starts, b)
        return at > 0 and ends[at - 1] > a

    return inside


def weak_spans(text: str, low: str) -> list[Span]:
    """Candidates that are reported only with a part of another role."""
    found: list[Span] = []
    if any(w in low for w in _WEAK_WORDS):
        found += [("weak_identifier", *m.span()) for m in IDENTIFIER.finditer(text)]
        found += [("weak_secret", *m.span()) for m in SECRET.finditer(text)]
    if any(w in low for w in _WORDS):
        found += [("weak_secret", *m.span()) for m in ASSIGN.finditer(text) if 6 <= len(m[2]) < ASSIGN_LEAST]
    found += [("weak_endpoint", *m.span()) for m in ENDPOINT.finditer(text)] if "." in text or "://" in text else []
    runs = [m.span() for m in RUN.finditer(text) if _mixed(m[0])]
    if runs:  # a run within a url or a named value is part of that candidate
        inside = _overlap([(a, b) for _, a, b in found])
        found += [("weak_secret", a, b) for a, b in runs if not inside(a, b)]
    found += [("weak_identifier", *m.span()) for m in ACCESS.finditer(text) if 12 <= len(m[0]) < ACCESS_LEAST] if "AKIA" in text else []
    return found


_ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "weak_identifier": "identifier", "weak_secret": "secret", "weak_endpoint": "endpoint"}


def linked(text: str, strong: list[Span], weak: list[Span]) -> list[Span]:
    """The weak candidates with a complementary part in their scope."""
    if not weak or len(strong) + len(weak) < 2:
        return []
    breaks = [m.start() for m in _BREAK.finditer(text)]
    inside = _overlap([(a, b) for _, a, b in strong])
    free = [(kind, a, b) for kind, a, b in weak if not inside(a, b)]  # a candidate inside a strong secret is that secret
    by_scope: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for kind, a, b in [*strong, *free]:
        by_scope.setdefault((_ROLE[kind], bisect_right(breaks, a)), []).append((a, b))
    for parts in by_scope.values():
        parts.sort()
    places = {of: [a for a, _ in parts] for of, parts in by_scope.items()}
    furthest = {of: list(accumulate((b for _, b in parts), max)) for of, parts in by_scope.items()}

    def near(role: str, a: int, b: int) -> bool:
        """Is there a part of this role in the same scope, within reach of the interval?"""
        of = role, bisect_right(breaks, a)
        at = bisect_right(places.get(of, []), b + REACH)  # parts that begin in time; does one of them end late enough?
        return at > 0 and furthest[of][at - 1] >= a - REACH

    need = {"identifier": ("secret",), "secret": ("identifier", "endpoint"), "endpoint": ("secret", "identifier")}
    return [(kind, a, b) for kind, a, b in dict.fromkeys(free) if any(near(role, a, b) for role in need[_ROLE[kind]])]


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans with the linked ones, each by start, then kind as listed."""
    low = text.lower()
    strong = base_spans(text, low)
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    strong.sort(key=order)
    return strong, sorted([*strong, *linked(text, strong, weak_spans(text, low))], key=order)


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def redacted(text: str, spans: list[Span], mark: str = "[REDACTED]") -> str:
    """The text with every span, overlapping ones together, replaced by one mark."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _spans(texts: pa.Array) -> list[pa.Array]:
    base, every, counts = [], [], {k: [] for k in KINDS[:3]}
    for text in texts:
        strong, spans = scan(text.as_py() or "")
        base.append(hashlib.sha256(written(strong).encode()).hexdigest())
        every.append(written(spans))
        for kind, of in counts.items():
            of.append(sum(s[0] == kind for s in strong))
    return [*[pa.array(counts[k], pa.int64()) for k in KINDS[:3]], pa.array(base, pa.string()), pa.array(every, pa.string())]


def report(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, n_assign, n_access, n_hex, base_sha256, spans) for each document."""
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    return annotate(as_rows(docs), text_col, _spans, fields)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """All columns of the documents, every reported span in the text replaced by a mark; null texts stay null."""

    def run(texts: pa.Array) -> list[pa.Array]:
        out = []
        for text in texts:
            text = text.as_py()
            spans = scan(text)[1] if text else []
            out.append(redacted(text, spans) if spans else text)
        return [pa.array(out, pa.string())]

    clean = annotate(as_rows(docs), text_col, run, [T.StructField("clean", T.StringType())])
    value = {text_col: F.col("clean")}
    if length_col:
        value[length_col] = F.when(F.col("clean") == F.col(f"row.`{text_col}`"), F.col(f"row.`{length_col}`")).otherwise(F.length("clean").cast(docs.schema[length_col].dataType))
    return clean.select(*[value.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
