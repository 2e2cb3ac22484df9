"""Canonical texts that SQL functions of Spark can't write: numbers as C prints them with %.17e."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: The lines of a benchmark report, each of one or two fields.
_LINES = [
    ("schema", "schema_version"), ("benchmark", "benchmark_id", "benchmark_version"), ("run", "run_id"), ("dataset", "dataset_id", "dataset_version"), ("model", "model_id", "model_version"),
    ("architecture_revision", "architecture_revision"), ("training_code_revision", "training_code_revision"), ("degradation_pipeline_revision", "degradation_pipeline_revision"),
    ("training_artifact_sha256", "training_artifact_sha256"), ("runtime", "runtime_id", "runtime_version"), ("seed", "seed"), ("evaluated_samples", "evaluated_samples"),
]


def benchmark_text(result: dict) -> str:
    rows = [f"{name}={'@'.join(str(result[f]) for f in fields)}\n" for name, *fields in _LINES]
    return "".join([*rows, *(f"metric={m['name']}@{m['version']}|{m['unit']}|{m['aggregation']}|{m['value']:.17e}\n" for m in result["metrics"])])


def benchmark_reports(results: DataFrame, key: str, record: str) -> DataFrame:
    """(key, report) for rows with a benchmark result as a struct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if r is None else benchmark_text(r) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "report"])

    source = results.select(key, record)
    return source.mapInArrow(run, f"{key} {source.schema[key].dataType.simpleString()}, report string")
