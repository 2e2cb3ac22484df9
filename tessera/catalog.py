"""All registered queries of the raster, vector and evidence operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import contract_queries, file_queries, image_queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks to contour edges, back to rasters by scan lines, and their overlap."""
    return image_queries.mask_roundtrip(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return image_queries.queries() | file_queries.queries() | contract_queries.queries()


def oracle_sql() -> dict[str, str]:
    return image_queries.oracle_sql() | file_queries.oracle_sql() | contract_queries.oracle_sql()
