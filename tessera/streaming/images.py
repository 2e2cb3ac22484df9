"""The image operators over streams of files: all of them are stateless, so a stream is the same plan as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.images import certified_convert
from tessera.sources.binary import decoded, stream


def conversions(spark: SparkSession, path: str, form: str) -> DataFrame:
    """Streaming rows (path, error, bytes, certificate, ...) of the files that come under a path."""
    rows = decoded(stream(spark, path))
    return certified_convert(rows.withColumn("rgba", F.when(F.col("error") == "None", F.col("rgba"))), form, keep=("path",))


def to_parquet(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each file once into a Parquet table, also after a restart, by the sink's log and the checkpoint; ends when no more files wait."""
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
