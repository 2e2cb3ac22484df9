"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_rows(df: DataFrame) -> DataFrame:
    """One column `row` with all columns of df, so that added columns can't clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def annotate(rows: DataFrame, column: str, compute: Callable[[pa.Array], list[pa.Array]], fields: list[T.StructField]) -> DataFrame:
    """Rows of as_rows() with more columns, computed a batch at a time from one field of the row."""
    at = rows.schema["row"].dataType.fieldNames().index(column)
    names = ["row", *[f.name for f in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            yield pa.RecordBatch.from_arrays([row, *compute(row.field(at))], names)

    return rows.select("row").mapInArrow(run, T.StructType([rows.schema["row"], *fields]))


#: Rows of a key that a join may always put into one task, and the keys for each partition that are looked up at most.
HUB, HUBS = 64, 4


def looked_up(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with `found`, which has one row a key and counts the key's rows in `_rows`, by a join that frequent keys don't skew.

    Keys with a large share of all rows are joined with a broadcast table: by their share there are at most HUBS for each
    shuffle partition. Keys are never null.
    """
    most = max(HUB, rows.count() // (HUBS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    added = [c for c in found.columns if c not in [*keys, "_rows"]]
    hubs = found.where(F.col("_rows") > most).select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*added).alias("_hub"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    seen = rows.join(F.broadcast(hubs), same, "left").drop(*[f"_{k}" for k in keys])
    rest = seen.where(F.col("_hub").isNull()).drop("_hub").join(found.where(F.col("_rows") <= most).drop("_rows"), keys)
    return seen.where(F.col("_hub").isNotNull()).select(*rows.columns, "_hub.*").unionByName(rest)


def with_totals(rows: DataFrame, keys: list[str], **totals: Column) -> DataFrame:
    """rows and the totals of their key's rows."""
    return looked_up(rows, rows.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()], F.count(F.lit(1)).alias("_rows")), keys)


def grouped(texts: Iterator[str | None], most: int) -> Iterator[list[str]]:
    """Texts in order (null: empty), together as long as they hold at most so many characters."""
    group: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if group and size + len(text) > most:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group
