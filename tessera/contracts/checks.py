"""Fail-closed contracts as expressions: ordered checks, of which the first that fails names the error.

Checks are SQL conditions over columns or struct fields. A check that can't be decided counts as failed, so that nulls
never pass. Items of a list are checked one after the other, all checks of an item before the next item.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Checks = list[tuple[str, str]]
NONE = "None"


def sha256_like(value: str) -> str:
    return rf"{value} RLIKE '^[0-9a-f]{{64}}\\z'"


def any_sha256_like(value: str) -> str:
    """Upper case too."""
    return rf"{value} RLIKE '^[0-9a-fA-F]{{64}}\\z'"


def empty(*values: str) -> str:
    return "(" + " OR ".join(f"coalesce({v}, '') = ''" for v in values) + ")"


def breaks_report(value: str) -> str:
    """Line feed, carriage return or NUL."""
    return rf"{value} RLIKE '[\\n\\r\\x00]'"


def breaks_line(value: str) -> str:
    """Line feed or carriage return only."""
    return rf"{value} RLIKE '[\\n\\r]'"


def token(value: str) -> str:
    """Not empty, without control characters or white space (ASCII)."""
    return rf"{value} RLIKE '^[^\\x00-\\x20\\x7F]+\\z'"


def unsafe_path(value: str) -> str:
    """Absolute, with a backslash, colon, NUL or line break, or with an empty, `.` or `..` part."""
    return rf"({value} RLIKE '[\\\\:\\x00\\n\\r]' OR exists(split({value}, '/'), p -> p IN ('', '.', '..')))"


def not_finite(*values: str) -> str:
    return "(" + " OR ".join(f"{v} IS NULL OR isnan({v}) OR abs({v}) = double('infinity')" for v in values) + ")"


def _case(checks: Checks) -> str:
    return "CASE " + " ".join(f"WHEN coalesce({condition}, true) THEN '{name}'" for name, condition in checks) + " END"


def of_items(items: str, checks: Checks) -> str:
    """SQL for the first error of a list; in conditions `x` is the item and `i` its number from 0."""
    return f"get(filter(transform({items}, (x, i) -> {_case(checks)}), e -> e IS NOT NULL), 0)"


def duplicated(items: str, field: str) -> str:
    """Does an earlier item have the same field?"""
    return f"exists(slice({items}, 1, i), p -> p.{field} = x.{field})"


def before(items: str, field: str) -> str:
    return f"get({items}, i - 1).{field}"


def running(items: str, field: str) -> str:
    """Sum of a field up to and with item `i`."""
    return f"aggregate(slice({items}, 1, i + 1), CAST(0 AS DECIMAL(38, 0)), (s, p) -> CAST(s + p.{field} AS DECIMAL(38, 0)))"


def first_error(*parts: Checks | str) -> Column:
    """Column with the first error: parts are checks, or SQL that gives an error name or null."""
    return F.expr("coalesce(" + ", ".join(p if isinstance(p, str) else _case(p) for p in parts) + f", '{NONE}')")


def over(value: str, most: int) -> str:
    return f"{value} > {most}"
