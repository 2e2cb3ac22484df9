"""Registered queries of the contracts: records made from table rows, one field in each broken by the row's key.

Mutation number j of a record is used where key % (number of mutations + 1) = j; the rest are sound. The SQL for DuckDB
names the error that each mutation must give, so a query holds a validator against its own list of first errors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.contracts import checks, records
from tessera.contracts import reports as reports_
from tessera.operators import evidence
from tessera.session import table

API, RELEASE, INVENTORY, IDENTITY, VERSION, BACKEND = "api.v1", "release.v1", "inventory.v1", "identity.v1", "1.0.0", "tessera-reference"
_A, _B, _REVISION = "repeat('a', 64)", "repeat('b', 64)", "repeat('c', 40)"


@dataclass
class Record:
    """Base values of a record's fields as SQL, and its mutations (field, value, first error)."""

    base: dict[str, str]
    mutations: list[tuple[str, str, str]] = field(default_factory=list)

    def struct(self, key: str) -> str:
        n = len(self.mutations) + 1
        parts = []
        for name, value in self.base.items():
            cases = "".join(f" WHEN {j} THEN {v}" for j, (f, v, _) in enumerate(self.mutations, 1) if f == name)
            parts.append(f"CASE {key} % {n}{cases} ELSE {value} END AS {name}" if cases else f"{value} AS {name}")
        return f"struct({', '.join(parts)})"

    def expected(self, key: str, name: str = "error") -> str:
        cases = "".join(f" WHEN {j} THEN '{e}'" for j, (_, _, e) in enumerate(self.mutations, 1))
        return f"CASE {key} % {len(self.mutations) + 1}{cases} ELSE 'None' END AS {name}"


REQUEST = Record(
    {
        "schema_version": "'export.v1'", "export_id": "'export-1'", "format": "'svg'", "source_output_id": "'output-1'", "source_output_sha256": _A, "width": "640", "height": "480L",
        "estimated_output_bytes": "65536L",
    },
    [
        ("schema_version", "''", "MissingSchemaVersion"), ("export_id", "''", "MissingExportIdentity"), ("export_id", "'a\\nb'", "UnsafeTextField"), ("format", "'bmp'", "UnsupportedFormat"),
        ("source_output_id", "''", "MissingSourceOutputIdentity"), ("source_output_sha256", "repeat('A', 64)", "InvalidSourceOutputDigest"), ("source_output_id", "'other'", "SourceOutputIdentityMismatch"),
        ("source_output_sha256", _B, "SourceOutputDigestMismatch"), ("width", "0", "ZeroDimension"), ("height", "100000000L", "PixelBudgetExceeded"), ("estimated_output_bytes", "0L", "ZeroEstimatedOutputBytes"),
        ("estimated_output_bytes", "1073741824L", "OutputBudgetExceeded"),
    ],
)
_SOURCE = f"struct('output-1' AS output_id, {_A} AS output_sha256)"
_SVG = """'<svg xmlns="http://www.w3.org/2000/svg" width="4" height="4" viewBox="0 0 4 4">\\n  <path d="M 0 0 L 4 0 L 4 4 Z" fill="#000000" fill-rule="evenodd"/>\\n</svg>\\n'"""
ARTIFACT = Record(
    {
        "format": "'svg'", "export_id": "'export-1'", "source_output_id": "'output-1'", "source_output_sha256": _A, "bytes": f"encode({_SVG}, 'UTF-8')", "output_sha256": f"sha2({_SVG}, 256)",
        "peak_intermediate_bytes": "4096L", "execution_units": "3L",
    },
    [
        ("format", "'pdf'", "FormatMismatch"), ("export_id", "'export-2'", "ExportIdentityMismatch"), ("source_output_id", "'x'", "SourceOutputIdentityMismatch"), ("source_output_sha256", _B, "SourceOutputDigestMismatch"),
        ("bytes", "X''", "EmptyOutput"), ("bytes", "encode(repeat('x', 70000), 'UTF-8')", "OutputBudgetExceeded"), ("output_sha256", "'abc'", "InvalidOutputDigest"), ("output_sha256", _B, "OutputDigestMismatch"),
        ("peak_intermediate_bytes", "0L", "ZeroIntermediateBytes"), ("peak_intermediate_bytes", "1073741824L", "IntermediateBudgetExceeded"), ("execution_units", "0L", "ZeroExecutionUnits"),
        ("execution_units", "2000000L", "ExecutionBudgetExceeded"),
    ],
)
_META = "array(struct('title' AS key, 'a' AS value), struct('author' AS key, 'b' AS value))"
DESTINATION = Record(
    {"relative_path": "'out/a.svg'", "export_id": "'export-1'", "output_sha256": f"sha2({_SVG}, 256)", "metadata": _META},
    [
        ("relative_path", "''", "MissingRelativePath"), ("relative_path", "repeat('a', 241)", "PathTooLong"), ("relative_path", "'../a.svg'", "UnsafePath"), ("relative_path", "'/a.svg'", "UnsafePath"),
        ("relative_path", "'a\\\\b.svg'", "UnsafePath"), ("relative_path", "'a//b.svg'", "UnsafePath"), ("relative_path", "'c:a.svg'", "UnsafePath"), ("export_id", "'x'", "ArtifactIdentityMismatch"),
        ("output_sha256", _B, "ArtifactDigestMismatch"), ("metadata", "array_repeat(struct('k' AS key, 'v' AS value), 33)", "TooManyMetadataEntries"), ("metadata", "array(struct('' AS key, 'v' AS value))", "EmptyMetadataKey"),
        ("metadata", "array(struct(repeat('k', 65) AS key, 'v' AS value))", "MetadataKeyTooLong"), ("metadata", "array(struct('k' AS key, repeat('v', 1025) AS value))", "MetadataValueTooLong"),
        ("metadata", "array(struct('k' AS key, 'a\\rb' AS value))", "UnsafeMetadataText"), ("metadata", "array(struct('export_id' AS key, 'v' AS value))", "ReservedMetadataKey"),
        ("metadata", "array(struct('k' AS key, 'v' AS value), struct('k' AS key, 'w' AS value))", "DuplicateMetadataKey"),
    ],
)


def _metric(*rows: tuple[str, str, str, str]) -> str:
    return "array(" + ", ".join(f"struct({n} AS name, {v}D AS measured, {a}D AS minimum, {b}D AS maximum)" for n, v, a, b in rows) + ")"


_GOOD_METRICS = _metric(("'alpha_mae'", "0.01", "0.0", "0.02"), ("'vector_iou'", "0.995", "0.99", "1.0"))
CERTIFICATE = Record(
    {
        "input_sha256": _A, "output_sha256": f"sha2({_SVG}, 256)", "schema_version": "'certificate.v1'", "certificate_id": "'c-1'", "toolchain_revision": "'r1'", "sample_count": "100L",
        "execution_units": "5L", "metrics": _GOOD_METRICS,
    },
    [
        ("input_sha256", _B, "InputProvenanceMismatch"), ("output_sha256", _B, "OutputProvenanceMismatch"), ("schema_version", "''", "MissingIdentity"), ("certificate_id", "'a\\nb'", "MissingIdentity"),
        ("toolchain_revision", "''", "MissingToolchainRevision"), ("sample_count", "0L", "ZeroSamples"), ("sample_count", "1000001L", "SampleBudgetExceeded"), ("execution_units", "0L", "ZeroExecutionUnits"),
        ("execution_units", "100000001L", "ExecutionBudgetExceeded"), ("metrics", f"slice({_GOOD_METRICS}, 1, 0)", "EmptyMetrics"), ("metrics", _metric(("'a'", "1", "2", "1")), "InvalidMetric"),
        ("metrics", _metric(("'a'", "1", "0", "1"), ("'a'", "1", "0", "1")), "DuplicateMetric"), ("metrics", _metric(("'b'", "1", "0", "1"), ("'a'", "1", "0", "1")), "NonDeterministicMetricOrder"),
        ("metrics", _metric(("'a'", "2", "0", "1")), "ThresholdViolation"), ("metrics", "array(struct('a' AS name, double('nan') AS measured, 0D AS minimum, 1D AS maximum))", "InvalidMetric"),
    ],
)
ENVELOPE = Record(
    {"schema_version": f"'{API}'", "request_id": "'request-1'", "operation": "'version'", "input_bytes": "1024L", "output_bytes": "2048L", "work_units": "10L"},
    [
        ("schema_version", "'v0'", "UnsupportedSchema"), ("request_id", "''", "EmptyRequestId"), ("request_id", "repeat('r', 129)", "RequestIdTooLarge"), ("request_id", "'a\\nb'", "UnsafeRequestId"),
        ("input_bytes", "67108865L", "InputTooLarge"), ("output_bytes", "268435457L", "OutputTooLarge"), ("work_units", "1000001L", "WorkLimitExceeded"), ("operation", "'certified_export'", "MissingCertificateEvidence"),
        ("operation", "'other'", "UnsupportedOperation"),
    ],
)
_TEXT = "encode('certificate', 'UTF-8')"
CERTIFIED = Record(
    {**ENVELOPE.base, "operation": "'certified_export'", "certificate_sha256": "sha2('certificate', 256)"},
    [*ENVELOPE.mutations[:7], ("operation", "'version'", "UnsupportedOperation"), ("certificate_sha256", "''", "MissingCertificateEvidence"), ("certificate_sha256", "'x'", "InvalidCertificateArtifact"), ("certificate_sha256", _B, "CertificateProvenanceMismatch")],
)
_CERT = f"struct('c-1' AS certificate_id, 'r1' AS toolchain_revision, {_A} AS input_sha256, {_B} AS output_sha256, sha2('certificate', 256) AS certificate_sha256, {_TEXT} AS canonical_bytes)"


def _contribution(name: str, of: str, z: int, **change: str) -> str:
    base = {
        "contribution_id": f"'{name}'", "z_order": str(z), "kind": f"'{of}'", "routing_class": f"'{of}'", "coverage": "0.5D", "opacity": "1.0D", "source_id": "'s'", "source_revision": "'r'",
        "source_sha256": _A, "intermediate_bytes": "100L", "execution_units": "10L",
    } | change
    return "struct(" + ", ".join(f"{v} AS {k}" for k, v in base.items()) + ")"


def _contributions(**second: str) -> str:
    return f"array({_contribution('a', 'Vector', 0)}, {_contribution('b', 'Raster', 1, **second)})"


PLAN = Record(
    {"schema_version": "'plan.v1'", "plan_id": "'plan-1'", "width": "4L", "height": "1L", "contributions": _contributions()},
    [
        ("schema_version", "''", "MissingSchemaVersion"), ("plan_id", "''", "MissingPlanIdentity"), ("width", "0L", "ZeroDimension"), ("width", "300000000L", "PixelBudgetExceeded"),
        ("contributions", f"slice({_contributions()}, 1, 0)", "EmptyContributions"), ("contributions", f"array_repeat({_contribution('a', 'Vector', 0)}, 4097)", "TooManyContributions"),
        *[("contributions", _contributions(**{k: v}), e) for k, v, e in (
            ("contribution_id", "''", "MissingContributionIdentity"), ("contribution_id", "'a'", "DuplicateContributionIdentity"), ("z_order", "0", "NonCanonicalZOrder"), ("coverage", "0.0D", "InvalidCoverage"),
            ("coverage", "double('nan')", "InvalidCoverage"), ("opacity", "1.5D", "InvalidOpacity"), ("source_id", "''", "MissingSourceIdentity"), ("source_revision", "''", "MissingSourceRevision"),
            ("source_sha256", "'x'", "InvalidSourceDigest"), ("kind", "'Vector'", "RoutingKindMismatch"), ("intermediate_bytes", "0L", "ZeroIntermediateBytes"),
            ("intermediate_bytes", "4398046511104L", "IntermediateByteBudgetExceeded"), ("execution_units", "0L", "ZeroExecutionUnits"), ("execution_units", "1000000000L", "ExecutionBudgetExceeded"))],
        ("contributions", f"array({_contribution('a', 'Raster', 0)})", "MissingVectorContribution"), ("contributions", f"array({_contribution('a', 'Vector', 0)})", "MissingRasterContribution"),
    ],
)


def _outputs(**second: str) -> str:
    one = lambda name, **c: "struct(" + ", ".join(f"{v} AS {k}" for k, v in ({"contribution_id": f"'{name}'", "source_revision": "'r'", "source_sha256": _A} | c).items()) + ")"
    return f"array({one('a')}, {one('b', **second)})"


OUTPUT = Record(
    {
        "schema_version": "'output.v1'", "output_id": "'output-1'", "output_sha256": _A, "plan_id": "'plan-1'", "vector_topology_revision": "'t1'", "seam_error": "0.004D", "expected_vector_components": "2L",
        "actual_vector_components": "2L", "raster_fallback_replaced_vector": "false", "contributions": _outputs(),
    },
    [
        ("schema_version", "''", "MissingSchemaVersion"), ("output_id", "''", "MissingOutputIdentity"), ("output_sha256", "'x'", "InvalidOutputDigest"), ("plan_id", "'other'", "PlanIdentityMismatch"),
        ("vector_topology_revision", "''", "MissingTopologyRevision"), ("seam_error", "-1.0D", "InvalidSeamError"), ("seam_error", "0.011D", "SeamThresholdExceeded"),
        ("expected_vector_components", "0L", "InvalidTopologyExpectation"), ("actual_vector_components", "3L", "TopologyMismatch"), ("raster_fallback_replaced_vector", "true", "SilentRasterFallback"),
        ("contributions", f"slice({_outputs()}, 1, 1)", "ContributionCountMismatch"), ("contributions", _outputs(contribution_id="'c'"), "ContributionIdentityMismatch"),
        ("contributions", _outputs(source_revision="'q'"), "ContributionRevisionMismatch"), ("contributions", _outputs(source_sha256=_B), "ContributionDigestMismatch"),
    ],
)
_HYPER = "array(struct('lr' AS name, 0.1D AS value), struct('momentum' AS name, 0.9D AS value))"
_IDENTITIES = {n: f"'{n}'" for n in ("schema_version", "run_id", "dataset_id", "dataset_version", "model_id", "model_version", "architecture_revision", "training_code_revision", "degradation_pipeline_revision", "runtime_id", "runtime_version")}
RUN = Record(
    {**_IDENTITIES, "artifact_sha256": _A, "max_steps": "1000L", "batch_size": "32L", "hyperparameters": _HYPER},
    [
        ("schema_version", "''", "MissingSchemaVersion"), ("run_id", "''", "MissingRunIdentity"), ("dataset_version", "''", "MissingDatasetIdentity"), ("model_id", "''", "MissingModelIdentity"),
        ("architecture_revision", "''", "MissingArchitectureRevision"), ("training_code_revision", "''", "MissingTrainingCodeRevision"), ("degradation_pipeline_revision", "''", "MissingDegradationPipelineRevision"),
        ("runtime_id", "''", "MissingRuntimeIdentity"), ("artifact_sha256", "''", "MissingArtifactChecksum"), ("artifact_sha256", "repeat('A', 64)", "InvalidArtifactChecksum"), ("max_steps", "0L", "ZeroMaxSteps"),
        ("max_steps", "10000001L", "StepBudgetExceeded"), ("batch_size", "0L", "ZeroBatchSize"), ("batch_size", "65537L", "BatchBudgetExceeded"),
        ("hyperparameters", "array_repeat(struct('a' AS name, 1D AS value), 257)", "TooManyHyperparameters"), ("hyperparameters", "array(struct('' AS name, 1D AS value))", "MissingHyperparameterName"),
        ("hyperparameters", "array(struct('a' AS name, 1D AS value), struct('a' AS name, 1D AS value))", "DuplicateHyperparameterName"), ("hyperparameters", "array(struct('a' AS name, double('infinity') AS value))", "NonFiniteHyperparameterValue"),
        ("hyperparameters", "array(struct('b' AS name, 1D AS value), struct('a' AS name, 1D AS value))", "NonDeterministicHyperparameterOrder"),
    ],
)


def _bench(*rows: tuple[str, str]) -> str:
    return "array(" + ", ".join(f"struct({n} AS name, 'v1' AS version, 'db' AS unit, 'mean' AS aggregation, {v} AS value)" for n, v in rows) + ")"


BENCH = Record(
    {
        **_IDENTITIES, "benchmark_id": "'b'", "benchmark_version": "'1'", "training_artifact_sha256": _A, "seed": "7L", "evaluated_samples": "10L", "metrics": _bench(("'psnr'", "30.5D"), ("'ssim'", "0.1D")),
        "artifact_sha256": "sha2('artifact', 256)",
    },
    [
        ("schema_version", "''", "MissingSchemaVersion"), ("benchmark_id", "''", "MissingBenchmarkIdentity"), ("run_id", "''", "MissingRunIdentity"), ("dataset_id", "''", "MissingDatasetIdentity"),
        ("model_version", "''", "MissingModelIdentity"), ("architecture_revision", "''", "MissingArchitectureRevision"), ("training_code_revision", "''", "MissingTrainingCodeRevision"),
        ("degradation_pipeline_revision", "''", "MissingDegradationPipelineRevision"), ("training_artifact_sha256", "''", "MissingTrainingArtifactChecksum"), ("training_artifact_sha256", "'x'", "InvalidTrainingArtifactChecksum"),
        ("runtime_version", "''", "MissingRuntimeIdentity"), ("evaluated_samples", "0L", "ZeroEvaluatedSamples"), ("evaluated_samples", "10000001L", "SampleBudgetExceeded"),
        ("metrics", f"slice({_bench((chr(39) + 'a' + chr(39), '1D'))}, 1, 0)", "EmptyMetrics"), ("metrics", _bench(("''", "1D")), "MissingMetricMetadata"), ("metrics", _bench(("'a'", "double('nan')")), "NonFiniteMetricValue"),
        ("metrics", _bench(("'a'", "1D"), ("'a'", "1D")), "DuplicateMetricName"), ("metrics", _bench(("'b'", "1D"), ("'a'", "1D")), "NonDeterministicMetricOrder"), ("artifact_sha256", "'x'", "InvalidArtifactDigest"),
        ("artifact_sha256", _B, "ArtifactDigestMismatch"),
    ],
)
_MODEL = f"struct('m' AS model_id, '1' AS model_version, {_A} AS artifact_sha256)"
_BINDING = f"struct('{BACKEND}' AS backend_id, 'Cpu' AS requested_provider, 'Cpu' AS active_provider, true AS deterministic, false AS fallback_used)"


def _binding(**change: str) -> str:
    base = {"backend_id": f"'{BACKEND}'", "requested_provider": "'Cpu'", "active_provider": "'Cpu'", "deterministic": "true", "fallback_used": "false"} | change
    return "struct(" + ", ".join(f"{v} AS {k}" for k, v in base.items()) + ")"


def _pre(layout: str = "'NCHW'", channels: str = "1", mean: str = "array(0.5F)", scale: str = "array(0.5F)") -> str:
    return f"struct({layout} AS layout, {channels} AS channels, {mean} AS mean, {scale} AS scale)"


def _post(layout: str = "'NCHW'", channels: str = "1", low: str = "-1.0F", high: str = "1.0F") -> str:
    return f"struct({layout} AS layout, {channels} AS channels, {low} AS output_min, {high} AS output_max)"


CONTRACT = Record(
    {"model": _MODEL, "input": "array(1, 1, 8, 8)", "binding": _BINDING, "output": "array(1, 1, 16, 16)", "preprocess": _pre(), "postprocess": _post()},
    [
        ("model", f"struct('a b' AS model_id, '1' AS model_version, {_A} AS artifact_sha256)", "InvalidModelId"), ("model", f"struct('m' AS model_id, '' AS model_version, {_A} AS artifact_sha256)", "InvalidModelVersion"),
        ("input", "slice(array(1), 1, 0)", "InvalidTensorRank"), ("input", "array_repeat(1, 9)", "InvalidTensorRank"), ("input", "array(1, 0, 8, 8)", "ZeroTensorExtent"), ("input", "array(1, 1, 10000, 10000)", "TensorBudgetExceeded"),
        ("binding", _binding(backend_id="''"), "InvalidBackend"), ("binding", _binding(requested_provider="'Unknown'"), "InvalidProvider"), ("binding", _binding(fallback_used="true"), "SilentFallback"),
        ("binding", _binding(active_provider="'Gpu'"), "SilentFallback"), ("binding", _binding(deterministic="false"), "NonDeterministicProvider"), ("output", "slice(array(1), 1, 0)", "InvalidOutputTensor"),
        ("output", "array(1, 1, 0, 16)", "ZeroTensorExtent"), ("preprocess", _pre(layout="'Unknown'"), "InvalidTensorLayout"), ("preprocess", _pre(channels="2"), "InvalidChannelContract"),
        ("preprocess", _pre(mean="array(0.5F, 0.5F)"), "InvalidNormalization"), ("preprocess", _pre(scale="array(0.0F)"), "InvalidNormalization"), ("postprocess", _post(layout="'Unknown'"), "InvalidTensorLayout"),
        ("postprocess", _post(channels="3"), "InvalidChannelContract"), ("postprocess", _post(low="2.0F"), "InvalidPostprocessRange"),
    ],
)
_ARTIFACT_SHA = "sha2('weights', 256)"
RECEIPT = Record(
    {"loaded": "true", "model": f"struct('m' AS model_id, '1' AS model_version, {_ARTIFACT_SHA} AS artifact_sha256)", "loaded_artifact_sha256": _ARTIFACT_SHA, "binding": _BINDING, "artifact": "encode('weights', 'UTF-8')"},
    [
        ("loaded", "false", "ModelNotLoaded"), ("loaded_artifact_sha256", "'x'", "InvalidModelId"), ("loaded_artifact_sha256", _B, "ArtifactDigestMismatch"), ("binding", _binding(backend_id="'a b'"), "InvalidBackend"),
        ("binding", _binding(backend_id="'other'"), "UnsupportedExecution"), ("artifact", "X''", "EmptyModelArtifact"), ("artifact", "encode('other', 'UTF-8')", "ArtifactDigestMismatch"),
    ],
)
MANIFEST = Record(
    {"schema_version": f"'{RELEASE}'", "product_version": f"'{VERSION}'", "core_api_schema": f"'{API}'", "source_revision": _REVISION, "channel": "'stable'"},
    [
        ("schema_version", "'x'", "UnsupportedSchema"), ("product_version", "'x'", "UnsupportedProductVersion"), ("core_api_schema", "'x'", "UnsupportedCoreApiSchema"), ("source_revision", "repeat('C', 40)", "InvalidSourceRevision"),
        ("channel", "'beta'", "UnsupportedChannel"),
    ],
)


def _entries(**first: str) -> str:
    rows = []
    for k, path in enumerate(records.PACKAGE_PATHS):
        base = {"path": f"'{path}'", "size_bytes": f"{100 + k}L", "sha256": _A} | (first if not k else {})
        rows.append("struct(" + ", ".join(f"{v} AS {n}" for n, v in base.items()) + ")")
    return f"array({', '.join(rows)})"


_GOOD_MANIFEST = Record(MANIFEST.base)
INVENTORIES = Record(
    {"schema_version": f"'{INVENTORY}'", "release_manifest_sha256": f"sha2({records.release_report('(' + _GOOD_MANIFEST.struct('1') + ')')}, 256)", "entries": _entries()},
    [
        ("schema_version", "'x'", "UnsupportedSchema"), ("release_manifest_sha256", "'x'", "InvalidReleaseManifestDigest"), ("entries", f"slice({_entries()}, 1, 0)", "EmptyInventory"),
        ("entries", f"flatten(array_repeat({_entries()}, 6))", "TooManyEntries"), ("entries", f"concat({_entries()}, slice({_entries()}, 1, 1))", "DuplicatePath"), ("entries", _entries(path="'bin/other'"), "UnsupportedPath"),
        ("entries", _entries(sha256="'x'"), "InvalidEntryDigest"), ("entries", _entries(size_bytes="0L"), "InvalidEntrySize"), ("entries", _entries(size_bytes="536870912L"), "TotalSizeExceeded"),
    ],
)


def _seen(**first: str) -> str:
    rows = []
    for k, path in enumerate(records.PACKAGE_PATHS):
        base = {"path": f"'{path}'", "size_bytes": f"{100 + k}L", "sha256": _A, "kind": "'RegularFile'"} | (first if not k else {})
        rows.append("struct(" + ", ".join(f"{v} AS {n}" for n, v in base.items()) + ")")
    return f"array({', '.join(rows)})"


SEEN = Record(
    {"entries": _seen()},
    [
        ("entries", f"concat({_seen()}, slice({_seen()}, 1, 1))", "DuplicateObservedPath"), ("entries", _seen(path="'x'"), "UnexpectedEntry"), ("entries", _seen(kind="'Symlink'"), "NonRegularEntry"),
        ("entries", _seen(size_bytes="1L"), "SizeMismatch"), ("entries", _seen(sha256=_B), "DigestMismatch"), ("entries", f"slice({_seen()}, 1, 2)", "MissingEntry"),
    ],
)
SPEC = Record(
    {"width": "640L", "height": "480L", "layout": "'RGBA'", "channel_type": "'U8'", "alpha": "'Straight'"},
    [("width", "0L", "ZeroWidth"), ("height", "0L", "ZeroHeight"), ("layout", "'RGB'", "AlphaModeWithoutAlphaChannel"), ("alpha", "'None'", "MissingAlphaMode"), ("width", "9000000000000000000L", "SizeOverflow")],
)
LIMITS = Record(SPEC.base, [("width", "0L", "InvalidImageSpec"), ("width", "65537L", "WidthExceeded"), ("height", "65537L", "HeightExceeded"), ("height", "500000000L", "HeightExceeded")])


def _check(record: Record, validate, extra: dict[str, str] | None = None, source: str = "orders", key: str = "o_orderkey"):
    """Query and SQL of one validator over a table's keys."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = table(spark, d, source).select(F.expr(f"CAST({key} AS BIGINT)").alias("key"))
        rows = rows.select("key", F.expr(record.struct("key")).alias("rec"), *[F.expr(v).alias(n) for n, v in (extra or {}).items()])
        return rows.select("key", validate().alias("error"))

    return query, f"SELECT {key}::BIGINT AS key, {record.expected(key)} FROM {source}"


_REL = (RELEASE, VERSION, API)
_REQ, _ART = {"o": _SOURCE}, {"o": _SOURCE, "r": Record(REQUEST.base).struct("1")}
_PAIRS = {
    "image_spec_validate": _check(SPEC, lambda: records.image_spec("rec"), source="part", key="p_partkey"),
    "decode_limits_validate": _check(LIMITS, lambda: records.decode_limits("rec"), source="part", key="p_partkey"),
    "export_request_validate": _check(REQUEST, lambda: records.export_request("rec", "o"), _REQ),
    "export_artifact_validate": _check(ARTIFACT, lambda: records.export_artifact("r", "o", "rec"), _ART),
    "export_destination_validate": _check(DESTINATION, lambda: records.export_destination("rec", "a"), {"a": Record(ARTIFACT.base).struct("1")}),
    "certificate_validate": _check(CERTIFICATE, lambda: records.quality_certificate("rec", "r", "o", "a"), _ART | {"a": Record(ARTIFACT.base).struct("1")}),
    "api_request_validate": _check(ENVELOPE, lambda: records.request_envelope("rec", API)),
    "api_certified_validate": _check(CERTIFIED, lambda: records.certified_request("rec", "c", API), {"c": _CERT}),
    "hybrid_plan_validate": _check(PLAN, lambda: records.hybrid_plan("rec")),
    "hybrid_output_validate": _check(OUTPUT, lambda: records.hybrid_output("p", "rec"), {"p": Record(PLAN.base).struct("1")}),
    "training_run_validate": _check(RUN, lambda: records.training_run("rec")),
    "benchmark_validate": _check(BENCH, lambda: records.benchmark_result("rec", "a"), {"a": "encode('artifact', 'UTF-8')"}),
    "ml_execution_validate": _check(CONTRACT, lambda: records.execution_contract("rec")),
    "ml_runtime_load": _check(RECEIPT, lambda: records.runtime_load("rec", "rec.artifact", BACKEND)),
    "release_manifest_validate": _check(MANIFEST, lambda: records.release_manifest("rec", *_REL), source="supplier", key="s_suppkey"),
    "package_inventory_validate": _check(INVENTORIES, lambda: records.inventory("rec", INVENTORY), source="supplier", key="s_suppkey"),
    "package_contents_exact_set": _check(
        SEEN, lambda: records.package_contents("m", "v", "rec.entries", _REL, INVENTORY), {"m": _GOOD_MANIFEST.struct("1"), "v": Record(INVENTORIES.base).struct("1")}, "supplier", "s_suppkey"
    ),
}


def package_identity(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.expr(_GOOD_MANIFEST.struct("1")).alias("m"), F.expr(Record(INVENTORIES.base).struct("1")).alias("v"))
    good = f"struct(CASE s WHEN 1 THEN 'x' ELSE '{IDENTITY}' END AS schema_version, CASE s WHEN 2 THEN {_B} ELSE sha2({records.release_report('m')}, 256) END AS release_manifest_sha256, CASE s WHEN 3 THEN {_B} ELSE sha2({records.inventory_report('v')}, 256) END AS package_inventory_sha256)"
    rows = rows.withColumn("s", F.col("key") % 4).withColumn("i", F.expr(good))
    return rows.select("key", records.package_identity("i", "m", "v", IDENTITY, _REL, INVENTORY).alias("error"))


PACKAGE_IDENTITY = "SELECT s_suppkey AS key, CASE s_suppkey % 4 WHEN 1 THEN 'UnsupportedSchema' WHEN 2 THEN 'ReleaseManifestMismatch' WHEN 3 THEN 'PackageInventoryMismatch' ELSE 'None' END AS error FROM supplier"


def reports(spark: SparkSession, d: str) -> DataFrame:
    """Digests of the canonical texts of the sound records, with values from the row."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    envelope = "struct('api.v1' AS schema_version, name AS request_id, 'version' AS operation, key AS input_bytes, key * 2 AS output_bytes, key % 7 AS work_units)"
    request = f"struct('export.v1' AS schema_version, name AS export_id, 'pdf' AS format, 'o' AS source_output_id, {_A} AS source_output_sha256, key AS width, 9 AS height, 10 AS estimated_output_bytes)"
    artifact = f"struct(name AS export_id, 'pdf' AS format, 'o' AS source_output_id, {_A} AS source_output_sha256, sha2(name, 256) AS output_sha256, encode(name, 'UTF-8') AS bytes, key AS peak_intermediate_bytes, 5 AS execution_units)"
    plan = "struct(array(struct('s1' AS source_id), struct(name AS source_id)) AS contributions)"
    parts = f"array(struct('c1' AS contribution_id, 'r1' AS source_revision, {_A} AS source_sha256), struct('c2' AS contribution_id, name AS source_revision, sha2(name, 256) AS source_sha256))"
    hybrid = f"struct('h.v1' AS schema_version, name AS output_id, {_A} AS output_sha256, 'p' AS plan_id, 't' AS vector_topology_revision, key AS expected_vector_components, key + 1 AS actual_vector_components, key % 2 = 0 AS raster_fallback_replaced_vector, {parts} AS contributions)"
    place = "struct(concat('out/', name) AS relative_path, array(struct('k' AS key, name AS value)) AS metadata)"
    rows = rows.withColumns({"e": F.expr(envelope), "r": F.expr(request), "p": F.expr(place), "a": F.expr(artifact), "h": F.expr(plan), "o": F.expr(hybrid)})
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select(
        "key",
        sha(records.request_report("e")).alias("request"),
        sha(records.response_report("e", records.request_envelope("e", API), API)).alias("response"),
        sha(records.export_request_report("r")).alias("export_request"),
        sha(records.export_destination_report("p")).alias("destination"),
        sha(records.export_artifact_report("a")).alias("artifact"),
        sha(records.hybrid_output_report("h", "o")).alias("hybrid"),
    )


REPORTS = f"""
SELECT c_custkey AS key,
       sha256('schema_version=api.v1' || chr(10) || 'request_id=' || c_name || chr(10) || 'operation=version' || chr(10) || 'input_bytes=' || c_custkey || chr(10) || 'output_bytes=' || c_custkey * 2 || chr(10) || 'work_units=' || c_custkey % 7 || chr(10)) AS request,
       sha256('schema_version=api.v1' || chr(10) || 'request_id=' || c_name || chr(10) || 'operation=version' || chr(10) || 'status=success' || chr(10) || 'exit_code=0' || chr(10) || 'error=none' || chr(10)) AS response,
       sha256('schema_version=export.v1' || chr(10) || 'export_id=' || c_name || chr(10) || 'format=pdf' || chr(10) || 'source_output_id=o' || chr(10) || 'source_output_sha256=' || {_A} || chr(10) || 'width=' || c_custkey || chr(10) || 'height=9' || chr(10) || 'estimated_output_bytes=10' || chr(10)) AS export_request,
       sha256('path_bytes=' || strlen('out/' || c_name) || chr(10) || 'path=out/' || c_name || chr(10) || 'metadata_count=1' || chr(10) || 'metadata[0].key_bytes=1' || chr(10) || 'metadata[0].key=k' || chr(10) || 'metadata[0].value_bytes=' || strlen(c_name) || chr(10) || 'metadata[0].value=' || c_name || chr(10)) AS destination,
       sha256('export_id=' || c_name || chr(10) || 'format=pdf' || chr(10) || 'source_output_id=o' || chr(10) || 'source_output_sha256=' || {_A} || chr(10) || 'output_sha256=' || sha256(c_name) || chr(10) || 'output_bytes=' || strlen(c_name) || chr(10) || 'peak_intermediate_bytes=' || c_custkey || chr(10) || 'execution_units=5' || chr(10)) AS artifact,
       sha256('schema_version=h.v1' || chr(10) || 'output_id=' || c_name || chr(10) || 'output_sha256=' || {_A} || chr(10) || 'plan_id=p' || chr(10) || 'vector_topology_revision=t' || chr(10) || 'expected_vector_components=' || c_custkey || chr(10) || 'actual_vector_components=' || (c_custkey + 1) || chr(10) || 'raster_fallback_replaced_vector=' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END || chr(10) || 'contribution_count=2' || chr(10) || 'contribution[0].id=c1' || chr(10) || 'contribution[0].source_id=s1' || chr(10) || 'contribution[0].revision=r1' || chr(10) || 'contribution[0].sha256=' || {_A} || chr(10) || 'contribution[1].id=c2' || chr(10) || 'contribution[1].source_id=' || c_name || chr(10) || 'contribution[1].revision=' || c_name || chr(10) || 'contribution[1].sha256=' || sha256(c_name) || chr(10) || 'plan_contribution_count=2' || chr(10)) AS hybrid
FROM customer
"""


def tile_plan(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of images whose size follows the part, with their overlap clipped to the image."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_partkey") % 1000 + 1).cast("int").alias("w"), (F.col("p_size") * 10).cast("int").alias("h"))
    return tiles(rows, 256, 32).select("image_id", "x", "y", "core_w", "core_h", "left", "top", "right", "bottom")


def tiles(images: DataFrame, extent: int, overlap: int) -> DataFrame:
    """(image_id, x, y, core_w, core_h, left, top, right, bottom): a row-major grid of rows (image_id, w, h), with the halo of each tile."""
    rows = images.withColumn("y", F.explode(F.expr(f"sequence(0, h - 1, {extent})"))).withColumn("x", F.explode(F.expr(f"sequence(0, w - 1, {extent})")))
    rows = rows.withColumns({"core_w": F.least(F.lit(extent), F.col("w") - F.col("x")), "core_h": F.least(F.lit(extent), F.col("h") - F.col("y"))})
    low = lambda c: F.greatest(F.lit(0), F.col(c) - overlap)
    return rows.withColumns({"left": low("x"), "top": low("y"), "right": F.least(F.col("w"), F.col("x") + F.col("core_w") + overlap), "bottom": F.least(F.col("h"), F.col("y") + F.col("core_h") + overlap)})


TILE_PLAN = """
WITH i AS (SELECT p_partkey AS image_id, (p_partkey % 1000 + 1)::INT AS w, (p_size * 10)::INT AS h FROM part),
t AS (SELECT *, unnest(range(0, w, 256))::INT AS x FROM (SELECT *, unnest(range(0, h, 256))::INT AS y FROM i)),
c AS (SELECT *, least(256, w - x) AS core_w, least(256, h - y) AS core_h FROM t)
SELECT image_id, x, y, core_w, core_h, greatest(0, x - 32) AS "left", greatest(0, y - 32) AS top, least(w, x + core_w + 32) AS "right", least(h, y + core_h + 32) AS bottom FROM c
"""


def dataset_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    rows = rows.withColumn("sha", F.when(F.col("doc_id") % 17 == 0, "bad").otherwise(F.col("sha")))
    sample = "struct(sha AS content_sha256, 'MIT' AS license_id, 'own work' AS rights_statement, 'author' AS rights_grant_source, doc_id % 2 = 0 AS production_training_authorized)"
    rows = rows.withColumn("s", F.expr(sample))
    return rows.select("doc_id", records.split_of(F.col("sha"), 0x5A17).alias("split"), F.expr(records.rights_binding("s")).alias("binding"))


DATASET_SPLIT = r"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'bad' ELSE sha256(coalesce(text, '')) END AS sha FROM documents),
b AS (SELECT *, CASE WHEN sha = 'bad' THEN 0 ELSE xor(('0x' || substr(sha, 1, 16))::UBIGINT, 23063::UBIGINT) % 100 END AS k FROM d)
SELECT doc_id, CASE WHEN k < 80 THEN 'Train' WHEN k < 90 THEN 'Validation' ELSE 'Test' END AS split,
       sha256(encode(sha) || '\x00'::BLOB || 'MIT'::BLOB || '\x00'::BLOB || 'own work'::BLOB || '\x00'::BLOB || 'author'::BLOB || '\x00'::BLOB || CASE WHEN doc_id % 2 = 0 THEN '\x01'::BLOB ELSE '\x00'::BLOB END) AS binding FROM b
"""


def dataset_samples(samples: DataFrame, artifacts: DataFrame, seed: int, manifest: str = "manifest_id", idx: str = "idx") -> DataFrame:
    """Samples (manifest_id, idx, ...) with what their checks need: neighbours, running sums, counts so far and the artifact of the same place.

    A window over a manifest of at most SAMPLES rows is bounded by the contract; larger ones fail before (TooManySamples).
    """
    order = Window.partitionBy(manifest).orderBy(idx)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    same = lambda c: Window.partitionBy(manifest, c).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    rows = samples.join(artifacts, [manifest, idx], "left")
    rows = rows.withColumn("_s", F.struct("content_sha256", "license_id", "rights_statement", "rights_grant_source", "production_training_authorized"))
    return rows.withColumns(
        {
            "previous_id": F.lag("sample_id").over(order),
            "total_bytes": F.sum(F.col("byte_size").cast("decimal(38,0)")).over(upto),
            "same_id": F.count(F.lit(1)).over(same("sample_id")),
            "same_content": F.count(F.lit(1)).over(same("content_sha256")),
            "expected_binding": F.expr(records.rights_binding("_s")),
            "expected_split": records.split_of(F.col("content_sha256"), seed),
        }
    ).drop("_s")


def dataset_manifests(samples: DataFrame, artifacts: DataFrame, seed: int, manifest: str = "manifest_id", idx: str = "idx") -> DataFrame:
    """(manifest_id, error, index): the first failing sample of each manifest and its first error."""
    rows = dataset_samples(samples, artifacts, seed, manifest, idx).withColumn("e", checks.first_error(records.dataset_sample_checks(seed=seed)))
    first = F.min(F.when(F.col("e") != "None", F.struct(F.col(idx).alias("index"), F.col("e").alias("error"))))
    rows = rows.groupBy(manifest).agg(first.alias("f"), F.count(F.lit(1)).alias("n"))
    many = F.col("n") > records.SAMPLES
    return rows.select(manifest, F.when(many, "TooManySamples").otherwise(F.coalesce("f.error", F.lit("None"))).alias("error"), F.coalesce("f.index", F.col("n")).cast("long").alias("index"))


def _sample_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.floor(F.col("doc_id") / 10).alias("manifest_id"), (F.col("doc_id") % 10).cast("int").alias("idx"))
    rows = rows.withColumns({"sha": F.sha2("t", 256), "n": F.octet_length("t").cast("long"), "j": F.when(F.col("idx") == 4, F.col("manifest_id") % 11).otherwise(0)})
    s = F.struct(F.col("sha").alias("content_sha256"), F.lit("MIT").alias("license_id"), F.lit("own").alias("rights_statement"), F.lit("author").alias("rights_grant_source"), F.lit(True).alias("production_training_authorized"))
    rows = rows.withColumn("s", s).withColumn("bind", F.expr(records.rights_binding("s")))
    j = lambda k, bad, good: F.when(F.col("j") == k, bad).otherwise(good)
    samples = rows.select(
        "manifest_id", "idx", j(1, F.lit(""), j(2, F.lit("a"), F.format_string("s%010d", "doc_id"))).alias("sample_id"), F.lit("src").alias("source_id"), j(3, F.lit("bad"), F.col("sha")).alias("content_sha256"),
        j(4, F.lit("GPL"), F.lit("MIT")).alias("license_id"), j(5, F.lit(""), F.lit("own")).alias("rights_statement"), F.lit("author").alias("rights_grant_source"), j(6, F.lit(False), F.lit(True)).alias("production_training_authorized"),
        j(7, F.lit("x"), j(8, F.lit("b" * 64), F.col("bind"))).alias("rights_binding_sha256"), j(9, F.lit(0).cast("long"), F.col("n")).alias("byte_size"),
        j(10, F.lit("Nowhere"), records.split_of(F.col("sha"), 7)).alias("split"),
    )
    artifacts = rows.select("manifest_id", "idx", F.format_string("s%010d", "doc_id").alias("artifact_id"), F.col("n").alias("artifact_bytes"), F.col("sha").alias("artifact_sha256"))
    return samples, artifacts


def dataset_validate(spark: SparkSession, d: str) -> DataFrame:
    """Manifests of ten documents each; the fifth sample of most is broken, and copies within a manifest leak."""
    samples, artifacts = _sample_rows(spark, d)
    return dataset_manifests(samples, artifacts, 7)


DATASET_VALIDATE = """
WITH d AS (SELECT doc_id // 10 AS manifest_id, (doc_id % 10)::INT AS idx, sha256(coalesce(text, '')) AS sha, strlen(coalesce(text, '')) AS n FROM documents),
c AS (SELECT *, CASE WHEN idx = 4 THEN manifest_id % 11 ELSE 0 END AS j, count(*) OVER (PARTITION BY manifest_id, CASE WHEN idx = 4 AND manifest_id % 11 = 3 THEN 'bad' ELSE sha END ORDER BY idx) AS same FROM d),
e AS (SELECT *, CASE j WHEN 1 THEN 'MissingSampleIdentity' WHEN 2 THEN 'NonDeterministicSampleOrder' WHEN 3 THEN 'InvalidContentDigest' WHEN 5 THEN 'MissingRightsProvenance' WHEN 4 THEN 'LicenseNotAllowed'
        WHEN 6 THEN 'ProductionTrainingUnauthorized' WHEN 7 THEN 'InvalidRightsBinding' WHEN 8 THEN 'RightsBindingMismatch' WHEN 9 THEN 'ZeroSampleBytes'
        ELSE CASE WHEN n = 0 THEN 'ZeroSampleBytes' WHEN same > 1 THEN 'DuplicateContentDigest' WHEN j = 10 THEN 'SplitAssignmentMismatch' END END AS err FROM c)
SELECT manifest_id, coalesce(arg_min(err, idx) FILTER (err IS NOT NULL), 'None') AS error, coalesce(min(idx) FILTER (err IS NOT NULL), count(*))::BIGINT AS "index" FROM e GROUP BY manifest_id
"""


def duplicate_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Contents that occur in more than one document, and in how many splits by source."""
    rows = table(spark, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), "doc_id", "source")
    found = rows.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.countDistinct("source").alias("n_sources"))
    return found.where(F.col("n") > 1)


DUPLICATE_LEAKAGE = "SELECT sha256(coalesce(text, '')) AS sha, count(*) AS n, min(doc_id) AS first, count(DISTINCT source) AS n_sources FROM documents GROUP BY 1 HAVING count(*) > 1"


def tensor_shape(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.expr("CASE p_partkey % 5 WHEN 0 THEN slice(array(1), 1, 0) WHEN 1 THEN array_repeat(1, 9) WHEN 2 THEN array(p_size, 0, 3) WHEN 3 THEN array(p_size * 10000, 10000) ELSE array(p_size, 3, 8, 8) END").alias("dims"))
    return rows.select("key", records.tensor_shape("dims").alias("error"), F.when(records.tensor_shape("dims") == "None", F.expr(records.elements("dims"))).otherwise(0).alias("elements"))


TENSOR_SHAPE = """
SELECT p_partkey AS key, CASE p_partkey % 5 WHEN 0 THEN 'InvalidTensorRank' WHEN 1 THEN 'InvalidTensorRank' WHEN 2 THEN 'ZeroTensorExtent' WHEN 3 THEN CASE WHEN p_size * 100000000::BIGINT > 67108864 THEN 'TensorBudgetExceeded' ELSE 'None' END ELSE 'None' END AS error,
       CASE WHEN p_partkey % 5 = 4 THEN p_size * 192 ELSE 0 END::BIGINT AS elements FROM part
"""


def ml_execute(spark: SparkSession, d: str) -> DataFrame:
    """The reference runtime over embeddings as 8 by 8 tensors, enlarged to 16 by 16."""
    rows = table(spark, d, "embeddings").where(F.size("embedding") == 64).select(F.col("vec_id").alias("key"), F.col("embedding").alias("data"))
    receipt = f"struct(true AS loaded, {_MODEL} AS model, {_A} AS loaded_artifact_sha256, {_BINDING} AS binding)"
    rows = rows.withColumns({"e": F.expr(Record(CONTRACT.base).struct("1")), "l": F.expr(receipt)})
    error, output = records.execute("e", "l", "data", BACKEND)
    rows = rows.select("key", error.alias("error"), output.alias("o"))
    return rows.select("key", "error", F.size("o").alias("n"), F.round(F.get("o", F.lit(7)).cast("double"), 5).alias("at_7"), F.round(F.get("o", F.lit(255)).cast("double"), 5).alias("last"), F.round(F.array_max("o").cast("double"), 5).alias("most"))


ML_EXECUTE = """
WITH v AS (SELECT vec_id AS key, [greatest(-1, least(1, ((embedding[o * 64 // 256 + 1] - 0.5::FLOAT) / 0.5::FLOAT)::FLOAT)) FOR o IN range(256)] AS o FROM embeddings WHERE len(embedding) = 64)
SELECT key, 'None' AS error, len(o)::INT AS n, round(o[8]::DOUBLE, 5) AS at_7, round(o[256]::DOUBLE, 5) AS "last", round(list_max(o)::DOUBLE, 5) AS most FROM v
"""


def raster_formats(spark: SparkSession, d: str) -> DataFrame:
    """Formats by first bytes of contents made from the page's key, whatever follows."""
    from tessera.sources.binary import checked

    magic = "CASE page_id % 7 WHEN 0 THEN X'89504E470D0A1A0A' WHEN 1 THEN X'FFD8FF' WHEN 2 THEN X'49492A00' WHEN 3 THEN X'4D4D002A' WHEN 4 THEN X'524946460000000057454250' WHEN 5 THEN X'' ELSE X'47494638' END"
    rows = table(spark, d, "pages").select(F.col("page_id").alias("key"), F.concat(F.expr(magic), F.expr("CASE WHEN page_id % 7 = 5 THEN X'' ELSE encode(url, 'UTF-8') END")).alias("content"))
    rows = checked(rows.withColumn("length", F.octet_length("content").cast("long")), 100)
    return rows.select("key", "format", "error")


RASTER_FORMATS = """
WITH p AS (SELECT page_id AS key, page_id % 7 AS k, strlen(url) + CASE page_id % 7 WHEN 0 THEN 8 WHEN 1 THEN 3 WHEN 4 THEN 12 ELSE 4 END AS n FROM pages)
SELECT key, CASE k WHEN 0 THEN 'PNG' WHEN 1 THEN 'JPEG' WHEN 2 THEN 'TIFF' WHEN 3 THEN 'TIFF' WHEN 4 THEN 'WebP' END AS format,
       CASE WHEN k = 5 THEN 'EmptyFile' WHEN n > 100 THEN 'TooLarge' WHEN k = 6 THEN 'UnsupportedFormat' ELSE 'None' END AS error FROM p
"""


def text_predicates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select(F.col("page_id").alias("key"), "url", F.sha2("url", 256).alias("sha"), F.expr("substring_index(url, '://', -1)").alias("p"))
    conditions = {
        "lower_sha": checks.sha256_like("CASE WHEN key % 2 = 0 THEN upper(sha) ELSE sha END"), "any_sha": checks.any_sha256_like("CASE WHEN key % 2 = 0 THEN upper(sha) ELSE sha END"),
        "breaks": checks.breaks_report("concat(url, CASE WHEN key % 3 = 0 THEN char(13) ELSE '' END)"), "is_token": checks.token("CASE WHEN key % 4 = 0 THEN concat(url, ' ') ELSE url END"), "unsafe": checks.unsafe_path("p"),
    }
    return rows.select("key", *[F.expr(c).alias(n) for n, c in conditions.items()])


TEXT_PREDICATES = r"""
WITH q AS (SELECT page_id AS key, url, split_part(url, '://', -1) AS p FROM pages)
SELECT key, key % 2 <> 0 AS lower_sha, true AS any_sha, key % 3 = 0 AS breaks, key % 4 <> 0 AS is_token,
       contains(p, ':') OR contains(p, '\') OR len(list_filter(string_split(p, '/'), lambda x: x IN ('', '.', '..'))) > 0 AS unsafe FROM q
"""


def benchmark_report(spark: SparkSession, d: str) -> DataFrame:
    """Digests of whole benchmark reports with two metrics."""
    fields = "'bench.v1' AS schema_version, 'b' AS benchmark_id, '2' AS benchmark_version, concat('run-', o_orderkey) AS run_id, 'd' AS dataset_id, '3' AS dataset_version, o_orderpriority AS model_id, '1' AS model_version, "
    fields += f"'a' AS architecture_revision, 't' AS training_code_revision, 'p' AS degradation_pipeline_revision, {_A} AS training_artifact_sha256, 'cpu' AS runtime_id, '1' AS runtime_version, o_custkey AS seed, o_orderkey % 97 AS evaluated_samples"
    metric = lambda name, value: f"struct('{name}' AS name, '1' AS version, 'usd' AS unit, 'mean' AS aggregation, {value} AS value)"
    record = f"struct({fields}, array({metric('price', 'o_totalprice')}, {metric('share', 'o_totalprice / 700')}) AS metrics)"
    rows = reports_.benchmark_reports(table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.expr(record).alias("b")), "key", "b")
    return rows.select("key", F.sha2("report", 256).alias("sha256"))


BENCHMARK_REPORT = "SELECT o_orderkey AS key, sha256(" + " || ".join(
    f"{line} || chr(10)"
    for line in (
        "'schema=bench.v1'", "'benchmark=b@2'", "'run=run-' || o_orderkey", "'dataset=d@3'", "'model=' || o_orderpriority || '@1'", "'architecture_revision=a'", "'training_code_revision=t'", "'degradation_pipeline_revision=p'",
        f"'training_artifact_sha256=' || {_A}", "'runtime=cpu@1'", "'seed=' || o_custkey", "'evaluated_samples=' || o_orderkey % 97",
        "'metric=price@1|usd|mean|' || printf('%.17e', o_totalprice)", "'metric=share@1|usd|mean|' || printf('%.17e', o_totalprice / 700)",
    )
) + ") AS sha256 FROM orders"


def gates(spark: SparkSession, d: str) -> DataFrame:
    """Rows of measurements held against the production and quality gates."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), (1 - F.col("l_discount")).alias("iou"), (F.col("l_tax") / 4).alias("residual"), (F.col("l_quantity") / 50).alias("p95"))
    return rows.where(evidence.gates(F.col("iou"), F.col("residual"), F.col("p95"))).groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least"))


GATES = "SELECT l_linenumber AS line, count(*) AS n, min(l_orderkey) AS least FROM lineitem WHERE 1 - l_discount >= 0.95::DOUBLE AND l_tax / 4 <= 0.01::DOUBLE AND l_quantity / 50 <= 0.75::DOUBLE GROUP BY 1"


_MORE = {
    "package_identity": (package_identity, PACKAGE_IDENTITY), "canonical_reports": (reports, REPORTS), "tile_plan": (tile_plan, TILE_PLAN), "dataset_split": (dataset_split, DATASET_SPLIT),
    "dataset_validate": (dataset_validate, DATASET_VALIDATE), "duplicate_leakage": (duplicate_leakage, DUPLICATE_LEAKAGE), "tensor_shape_validate": (tensor_shape, TENSOR_SHAPE), "ml_reference_execute": (ml_execute, ML_EXECUTE),
    "raster_formats": (raster_formats, RASTER_FORMATS), "text_predicates": (text_predicates, TEXT_PREDICATES), "benchmark_report": (benchmark_report, BENCHMARK_REPORT), "production_gates": (gates, GATES),
}


def queries() -> dict:
    return {name: q for name, (q, _) in (_PAIRS | _MORE).items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in (_PAIRS | _MORE).items() if sql}
