"""Rasters derived from the driver's tables, one image a row; planes are arrays in row-major order.

Whole images stay in one row, so that every image operator is a projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import spread, table

GRAY, COLOR = 8, 4


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, width, height, lum array<double>, mask array<int>): 8 by 8, a mask value is 255 where the component is positive."""
    rows = spread(table(spark, sf_dir, "embeddings").where(F.size("embedding") == GRAY * GRAY))
    lum = F.transform("embedding", lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v.cast("double") * 2 + 1) / 2)))
    mask = F.transform("embedding", lambda v: F.when(v > 0, 255).otherwise(0))
    return rows.select(F.col("vec_id").alias("image_id"), F.lit(GRAY).alias("width"), F.lit(GRAY).alias("height"), lum.alias("lum"), mask.alias("mask"))


def rgba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, width, height, r, g, b, a array<int>): 4 by 4, straight sRGB bytes."""
    rows = spread(table(spark, sf_dir, "embeddings").where(F.size("embedding") == COLOR * COLOR * 4))
    u8 = F.transform("embedding", lambda v: (F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v.cast("double") * 3 + 1) / 2)) * 255 + 0.5).cast("int"))
    rows = rows.select(F.col("vec_id").alias("image_id"), u8.alias("u8"))
    plane = lambda c: F.transform(F.sequence(F.lit(0), F.lit(COLOR * COLOR - 1)), lambda i: F.get("u8", i * 4 + c))
    return rows.select("image_id", F.lit(COLOR).alias("width"), F.lit(COLOR).alias("height"), *[plane(k).alias(n) for k, n in enumerate("rgba")])


#: The same rasters for DuckDB, one pixel a row.
GRAY_SQL = f"""
px AS (
  SELECT vec_id AS image_id, (i - 1) // {GRAY} AS y, (i - 1) % {GRAY} AS x, greatest(0.0, least(1.0, (v::DOUBLE * 2 + 1) / 2)) AS l,
         CASE WHEN v > 0 THEN 255 ELSE 0 END AS cov
  FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE len(embedding) = {GRAY * GRAY})
)"""
RGBA_SQL = f"""
ch AS (
  SELECT vec_id AS image_id, (i - 1) // 4 AS p, (i - 1) % 4 AS c, floor(greatest(0.0, least(1.0, (v::DOUBLE * 3 + 1) / 2)) * 255 + 0.5)::INT AS u
  FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE len(embedding) = {COLOR * COLOR * 4})
), px AS (
  SELECT image_id, p, p // {COLOR} AS y, p % {COLOR} AS x, max(u) FILTER (c = 0) AS r, max(u) FILTER (c = 1) AS g, max(u) FILTER (c = 2) AS b, max(u) FILTER (c = 3) AS a
  FROM ch GROUP BY image_id, p
)"""
