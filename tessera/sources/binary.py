"""Raster files as tables: whole files with a typed error, formats by their first bytes, decoded pixels."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.images import remembered
from tessera.sources.decode import decode

#: Bytes of a file.
MOST = 64 << 20


def format_of(content: Column) -> Column:
    """PNG, JPEG, TIFF or WebP by magic bytes, whatever the file's name; else null."""
    begins = lambda at, magic: F.substring(content, at, len(magic) // 2) == F.expr(f"X'{magic}'")
    return (
        F.when(begins(1, "89504E470D0A1A0A"), "PNG")
        .when(begins(1, "FFD8FF"), "JPEG")
        .when(begins(1, "49492A00") | begins(1, "4D4D002A"), "TIFF")
        .when(begins(1, "52494646") & begins(9, "57454250"), "WebP")
    )


def load(spark: SparkSession, path: str, most: int = MOST) -> DataFrame:
    """(path, length, format, content, error) of the files under a path; files over the limit aren't read.

    Spark's scan passes over files without any bytes; rows of other origin get EmptyFile from checked().
    """
    files = spark.read.format("binaryFile").load(path)
    fits = files.where(F.col("length") <= most).select("path", "length", "content")
    large = files.where(F.col("length") > most).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return checked(fits.unionByName(large), most)


def checked(files: DataFrame, most: int = MOST) -> DataFrame:
    """Adds format and the first error of rows (path, length, content)."""
    form = format_of(F.col("content"))
    error = F.when(F.col("length") == 0, "EmptyFile").when(F.col("length") > most, "TooLarge").when(F.col("content").isNull(), "ReadFailed").when(form.isNull(), "UnsupportedFormat").otherwise("None")
    return files.withColumns({"format": form, "error": error})


def stream(spark: SparkSession, path: str, most: int = MOST) -> DataFrame:
    """The same rows as a stream of files that come under a path; all image operators are stateless and follow it."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return checked(spark.readStream.format("binaryFile").schema(schema).load(path).select("path", "length", "content"), most)


def decoded(files: DataFrame) -> DataFrame:
    """(path, format, error, width, height, rgba binary): pixels of files without an error, straight RGBA bytes in row-major order.

    A task decodes equal files once, as far as it remembers them.
    """

    def call(form: str | None, content: bytes) -> dict:
        error, image = decode(form, content)
        return {"error": error} if image is None else {"error": error, "width": image.shape[1], "height": image.shape[0], "rgba": image.tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = remembered(call)
        for batch in batches:
            for k in range(batch.num_rows):  # one image at a time, so that a batch's pixels are never all in memory
                path, form, error, content = (c[k].as_py() for c in batch.columns)
                found = one(form, content) if error == "None" else {"error": error}
                error, size = found["error"], [found.get(n) for n in ("width", "height", "rgba")]
                kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((path, form, error, *size), kinds, strict=True)], names)

    names = ["path", "format", "error", "width", "height", "rgba"]
    return files.select("path", "format", "error", "content").mapInArrow(run, "path string, format string, error string, width int, height int, rgba binary")
