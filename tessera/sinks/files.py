"""Files from rows: one export, and its certificate beside it, for each row."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_files(rows: DataFrame, folder: str, suffix: str) -> DataFrame:
    """(path, error, written): writes the bytes of rows without an error under a folder that all executors mount.

    Files are named by the input's name and a digest of its whole path, so equal names don't meet. A file is written
    beside its place and renamed, so a task that is run again leaves the same files, never halves of them.
    """
    has_certificate = "certificate" in rows.columns
    source = rows.select("path", "error", "bytes", F.col("certificate") if has_certificate else F.lit(None).cast("binary").alias("certificate"), F.substring(F.sha2("path", 256), 1, 12).alias("key"))

    def put(place: str, data: bytes) -> None:
        with open(f"{place}.{os.getpid()}.part", "wb") as out:
            out.write(data)
        os.replace(f"{place}.{os.getpid()}.part", place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            written = []
            for path, error, data, certificate, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = None
                if error == "None":
                    name = os.path.splitext(os.path.basename(path))[0]
                    put(place := os.path.join(folder, f"{name}-{key}.{suffix}"), data)
                    if certificate:
                        put(f"{place}.quality-certificate", certificate)
                written.append(place)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(written, pa.string())], ["path", "error", "written"])

    return source.mapInArrow(run, T.StructType([T.StructField(n, T.StringType()) for n in ("path", "error", "written")]))
