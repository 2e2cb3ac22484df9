"""The contracts of images, exports, hybrid output, certificates, requests, data sets, runs, benchmarks, models and packages.

Every function takes SQL paths to struct columns and gives a Column with the first error. Paths can't begin with x or i,
which stand for the items of lists and their numbers. Field names are those of the records; schema names and limits are parameters. Canonical reports are Columns with the exact text that is digested.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.contracts.checks import (
    Checks, any_sha256_like, before, breaks_line, breaks_report, duplicated, empty, first_error, not_finite, of_items, over, running, sha256_like, token, unsafe_path,
)

# The limits of the records.
PIXELS, EXPORT_BYTES, INTERMEDIATE_BYTES, UNITS = 268_435_456, 536_870_912, 268_435_456, 1_000_000
HYBRID_ITEMS, HYBRID_BYTES, HYBRID_UNITS, SEAM = 4096, 4 << 40, 1_000_000_000, 0.01
CERTIFICATE_SAMPLES, CERTIFICATE_UNITS, CERTIFICATE_METRICS = 1_000_000, 100_000_000, 128
REQUEST_ID, REQUEST_INPUT, REQUEST_OUTPUT, REQUEST_WORK = 128, 64 << 20, 256 << 20, 1_000_000
SAMPLES, SAMPLE_BYTES, TOTAL_BYTES = 100_000, 512 << 20, 64 << 30
STEPS, BATCH, HYPERPARAMETERS = 10_000_000, 65_536, 256
EVALUATED, BENCHMARK_METRICS, BENCHMARK_BYTES = 10_000_000, 256, 64 << 20
TENSOR_RANK, TENSOR_ELEMENTS, MODEL_BYTES = 8, 67_108_864, 64 << 20
PACKAGE_ENTRIES, PACKAGE_BYTES = 16, 512 << 20
PACKAGE_PATHS = ("bin/cli", "release/release-manifest.txt", "release/package-inventory.txt")
LICENSES = ("CC0-1.0", "CC-BY-4.0", "MIT", "Apache-2.0")
RESERVED_KEYS = ("export_id", "format", "source_output_id", "source_output_sha256", "output_sha256")


def _bytes(value: str) -> str:
    return f"octet_length({value})"


def _different(a: str, b: str) -> str:
    return f"NOT ({a} <=> {b})"


# Images ---------------------------------------------------------------------------------------------------------------


def _image_spec(s: str) -> Checks:
    channels = f"CASE {s}.layout WHEN 'Gray' THEN 1 WHEN 'GrayAlpha' THEN 2 WHEN 'RGB' THEN 3 ELSE 4 END"
    size = f"CASE {s}.channel_type WHEN 'U8' THEN 1 WHEN 'U16' THEN 2 ELSE 4 END"
    product = f"CAST({s}.width AS DECIMAL(38, 0)) * {s}.height * {channels} * {size}"
    with_alpha = f"{s}.layout IN ('GrayAlpha', 'RGBA')"
    return [
        ("ZeroWidth", f"{s}.width = 0"),
        ("ZeroHeight", f"{s}.height = 0"),
        ("AlphaModeWithoutAlphaChannel", f"NOT {with_alpha} AND {s}.alpha <> 'None'"),
        ("MissingAlphaMode", f"{with_alpha} AND {s}.alpha = 'None'"),
        ("SizeOverflow", f"{product} > 18446744073709551615"),
    ]


def image_spec(s: str) -> Column:
    return first_error(_image_spec(s))


def decode_limits(s: str, width: int = 65_536, height: int = 65_536, pixels: int = PIXELS, size: int = 2 << 30) -> Column:
    invalid = " OR ".join(f"coalesce({c}, true)" for _, c in _image_spec(s))
    channels = f"CASE {s}.layout WHEN 'Gray' THEN 1 WHEN 'GrayAlpha' THEN 2 WHEN 'RGB' THEN 3 ELSE 4 END * CASE {s}.channel_type WHEN 'U8' THEN 1 WHEN 'U16' THEN 2 ELSE 4 END"
    area = f"CAST({s}.width AS DECIMAL(38, 0)) * {s}.height"
    return first_error(
        [
            ("InvalidImageSpec", invalid),
            ("WidthExceeded", over(f"{s}.width", width)),
            ("HeightExceeded", over(f"{s}.height", height)),
            ("PixelCountExceeded", over(area, pixels)),
            ("ByteBudgetExceeded", over(f"{area} * {channels}", size)),
        ]
    )


def tile_plan(width: str, height: str, extent: str, most: int = 1_000_000) -> Column:
    count = f"CAST(ceil({width} / {extent}) AS DECIMAL(38, 0)) * ceil({height} / {extent})"
    return first_error([("ZeroImageDimension", f"{width} = 0 OR {height} = 0"), ("ZeroTileExtent", f"{extent} = 0"), ("TooManyTiles", over(count, most))])


# Hybrid output --------------------------------------------------------------------------------------------------------


def hybrid_plan(p: str, pixels: int = PIXELS, items: int = HYBRID_ITEMS, size: int = HYBRID_BYTES, units: int = HYBRID_UNITS) -> Column:
    c = f"{p}.contributions"
    head = [
        ("MissingSchemaVersion", empty(f"{p}.schema_version")),
        ("MissingPlanIdentity", empty(f"{p}.plan_id")),
        ("ZeroDimension", f"{p}.width = 0 OR {p}.height = 0"),
        ("PixelBudgetExceeded", over(f"CAST({p}.width AS DECIMAL(38, 0)) * {p}.height", pixels)),
        ("EmptyContributions", f"size({c}) < 1"),
        ("TooManyContributions", over(f"size({c})", items)),
    ]
    each = [
        ("MissingContributionIdentity", empty("x.contribution_id")),
        ("DuplicateContributionIdentity", duplicated(c, "contribution_id")),
        ("NonCanonicalZOrder", "x.z_order <> i"),
        ("InvalidCoverage", f"{not_finite('x.coverage')} OR x.coverage <= 0 OR x.coverage > 1"),
        ("InvalidOpacity", f"{not_finite('x.opacity')} OR x.opacity < 0 OR x.opacity > 1"),
        ("MissingSourceIdentity", empty("x.source_id")),
        ("MissingSourceRevision", empty("x.source_revision")),
        ("InvalidSourceDigest", f"NOT {sha256_like('x.source_sha256')}"),
        ("RoutingKindMismatch", "x.kind NOT IN ('Vector', 'Raster') OR x.kind <> x.routing_class"),
        ("ZeroIntermediateBytes", "x.intermediate_bytes = 0"),
        ("IntermediateByteBudgetExceeded", over(running(c, "intermediate_bytes"), size)),
        ("ZeroExecutionUnits", "x.execution_units = 0"),
        ("ExecutionBudgetExceeded", over(running(c, "execution_units"), units)),
    ]
    tail = [("MissingVectorContribution", f"NOT exists({c}, x -> x.kind = 'Vector')"), ("MissingRasterContribution", f"NOT exists({c}, x -> x.kind = 'Raster')")]
    return first_error(head, of_items(c, each), tail)


def hybrid_output(p: str, o: str, seam: float = SEAM, items: int = HYBRID_ITEMS) -> Column:
    head = [
        ("MissingSchemaVersion", empty(f"{o}.schema_version")),
        ("MissingOutputIdentity", empty(f"{o}.output_id")),
        ("InvalidOutputDigest", f"NOT {sha256_like(f'{o}.output_sha256')}"),
        ("PlanIdentityMismatch", f"{_different(f'{o}.plan_id', f'{p}.plan_id')} OR {empty(f'{o}.plan_id')}"),
        ("MissingTopologyRevision", empty(f"{o}.vector_topology_revision")),
        ("InvalidSeamError", f"{not_finite(f'{o}.seam_error')} OR {o}.seam_error < 0"),
        ("SeamThresholdExceeded", f"{o}.seam_error > {seam}D"),
        ("InvalidTopologyExpectation", f"{o}.expected_vector_components = 0"),
        ("TopologyMismatch", f"{o}.expected_vector_components <> {o}.actual_vector_components"),
        ("SilentRasterFallback", f"{o}.raster_fallback_replaced_vector"),
        ("TooManyContributions", over(f"size({o}.contributions)", items)),
        ("ContributionCountMismatch", f"size({o}.contributions) <> size({p}.contributions)"),
    ]
    planned = f"get({p}.contributions, i)"
    each = [
        ("ContributionIdentityMismatch", f"x.contribution_id <> {planned}.contribution_id"),
        ("ContributionRevisionMismatch", f"x.source_revision <> {planned}.source_revision"),
        ("ContributionDigestMismatch", f"x.source_sha256 <> {planned}.source_sha256 OR NOT {sha256_like('x.source_sha256')}"),
    ]
    return first_error(head, of_items(f"{o}.contributions", each))


def _lines(*pairs: tuple[str, str]) -> str:
    return "concat(" + ", ".join(f"'{name}=', CAST({value} AS STRING), '\\n'" for name, value in pairs) + ")"


def hybrid_output_report(p: str, o: str) -> Column:
    names = ["schema_version", "output_id", "output_sha256", "plan_id", "vector_topology_revision", "expected_vector_components", "actual_vector_components", "raster_fallback_replaced_vector"]
    head = _lines(*[(n, f"{o}.{n}") for n in names], ("contribution_count", f"size({o}.contributions)"))
    one = "concat({})".format(
        ", ".join(
            f"'contribution[', i, '].{name}=', {value}, '\\n'"
            for name, value in (("id", "x.contribution_id"), ("source_id", f"get({p}.contributions, i).source_id"), ("revision", "x.source_revision"), ("sha256", "x.source_sha256"))
        )
    )
    return F.expr(f"concat({head}, array_join(transform({o}.contributions, (x, i) -> {one}), ''), {_lines(('plan_contribution_count', f'size({p}.contributions)'))})")


# Exports --------------------------------------------------------------------------------------------------------------


def _export_request(r: str, o: str, pixels: int, size: int) -> Checks:
    return [
        ("MissingSchemaVersion", empty(f"{r}.schema_version")),
        ("MissingExportIdentity", empty(f"{r}.export_id")),
        ("UnsafeTextField", " OR ".join(breaks_line(f"{r}.{f}") for f in ("schema_version", "export_id", "source_output_id"))),
        ("UnsupportedFormat", f"{r}.format NOT IN ('svg', 'pdf', 'eps', 'dxf')"),
        ("MissingSourceOutputIdentity", empty(f"{r}.source_output_id")),
        ("InvalidSourceOutputDigest", f"NOT {sha256_like(f'{r}.source_output_sha256')}"),
        ("SourceOutputIdentityMismatch", _different(f"{r}.source_output_id", f"{o}.output_id")),
        ("SourceOutputDigestMismatch", _different(f"{r}.source_output_sha256", f"{o}.output_sha256")),
        ("ZeroDimension", f"{r}.width = 0 OR {r}.height = 0"),
        ("PixelBudgetExceeded", over(f"CAST({r}.width AS DECIMAL(38, 0)) * {r}.height", pixels)),
        ("ZeroEstimatedOutputBytes", f"{r}.estimated_output_bytes = 0"),
        ("OutputBudgetExceeded", over(f"{r}.estimated_output_bytes", size)),
    ]


def export_request(r: str, o: str, pixels: int = PIXELS, size: int = EXPORT_BYTES) -> Column:
    return first_error(_export_request(r, o, pixels, size))


def export_request_report(r: str) -> Column:
    names = ["schema_version", "export_id", "format", "source_output_id", "source_output_sha256", "width", "height", "estimated_output_bytes"]
    return F.expr(_lines(*[(n, f"{r}.{n}") for n in names]))


def _ordered(text: str, marks: list[str]) -> str:
    """All marks occur, each first one behind the one before."""
    places = [f"locate('{m}', {text})" for m in marks]
    return "(" + " AND ".join([f"{places[0]} > 0", *[f"{a} < {b}" for a, b in zip(places, places[1:], strict=False)]]) + ")"


def structure_valid(form: str, text: str) -> str:
    """SQL: is the text (ASCII) an export of this format, with its parts in order where it has geometry?"""
    first = f"locate('<path ', {text})"
    later = " AND ".join(f"locate('{m}', {text}, {first}) > 0" for m in ('d="', 'fill-rule="evenodd"', "/>\\n"))
    svg = f"""startswith({text}, '<svg xmlns="http://www.w3.org/2000/svg"') AND endswith({text}, '</svg>\\n') AND ({first} = 0 OR (locate('viewBox="', {text}) > 0 AND {later}))"""
    parts = ["1 0 obj\\n", "stream\\n", "endstream\\n", "xref\\n", "trailer\\n", "startxref\\n"]
    declared = rf"CAST(regexp_extract({text}, 'startxref\\n([0-9]+)\\n', 1) AS BIGINT) = locate('xref\\n', {text}) - 1"
    pdf = f"startswith({text}, '%PDF-1.7\\n') AND endswith({text}, '%%EOF\\n') AND (locate(' geometry export\\n', {text}) = 0 OR ({_ordered(text, parts)} AND coalesce({declared}, false)))"
    marks = ["%%BoundingBox: ", "%%EndComments\\n", "newpath\\n", "eofill\\n", "showpage\\n"]
    eps = f"startswith({text}, '%!PS-Adobe-3.0 EPSF-3.0\\n') AND endswith({text}, '%%EOF\\n') AND ((locate('newpath\\n', {text}) = 0 AND locate('curveto\\n', {text}) = 0) OR {_ordered(text, marks)})"
    header = f"locate('2\\nHEADER\\n', {text})"
    ended = f"locate('0\\nENDSEC\\n', {text}, greatest(1, {header}))"
    entities = f"locate('2\\nENTITIES\\n', {text}, greatest(1, {ended}))"
    closed = f"locate('0\\nENDSEC\\n', {text}, greatest(1, {entities}))"
    dxf = f"startswith({text}, '0\\nSECTION\\n') AND endswith({text}, '0\\nEOF\\n') AND ((locate('0\\nLINE\\n', {text}) = 0 AND locate('0\\nSPLINE\\n', {text}) = 0) OR ({header} > 0 AND {header} < {ended} AND {ended} < {entities} AND {entities} < {closed}))"
    return f"CASE {form} WHEN 'svg' THEN {svg} WHEN 'pdf' THEN {pdf} WHEN 'eps' THEN {eps} WHEN 'dxf' THEN {dxf} ELSE false END"


def _artifact(r: str, o: str, a: str, pixels: int, size: int, intermediate: int, units: int) -> Checks:
    invalid = " OR ".join(f"coalesce({c}, true)" for _, c in _export_request(r, o, pixels, size))
    return [
        ("InvalidRequest", invalid),
        ("FormatMismatch", _different(f"{a}.format", f"{r}.format")),
        ("ExportIdentityMismatch", _different(f"{a}.export_id", f"{r}.export_id")),
        ("SourceOutputIdentityMismatch", _different(f"{a}.source_output_id", f"{r}.source_output_id")),
        ("SourceOutputDigestMismatch", _different(f"{a}.source_output_sha256", f"{r}.source_output_sha256")),
        ("EmptyOutput", f"{_bytes(f'{a}.bytes')} = 0"),
        ("OutputBudgetExceeded", f"{_bytes(f'{a}.bytes')} > {r}.estimated_output_bytes OR {over(_bytes(f'{a}.bytes'), size)}"),
        ("InvalidOutputDigest", f"NOT {sha256_like(f'{a}.output_sha256')}"),
        ("OutputDigestMismatch", f"sha2({a}.bytes, 256) <> {a}.output_sha256"),
        ("ZeroIntermediateBytes", f"{a}.peak_intermediate_bytes = 0"),
        ("IntermediateBudgetExceeded", over(f"{a}.peak_intermediate_bytes", intermediate)),
        ("ZeroExecutionUnits", f"{a}.execution_units = 0"),
        ("ExecutionBudgetExceeded", over(f"{a}.execution_units", units)),
        ("InvalidStructure", f"NOT ({structure_valid(f'{a}.format', f'CAST({a}.bytes AS STRING)')})"),
    ]


def export_artifact(r: str, o: str, a: str, pixels: int = PIXELS, size: int = EXPORT_BYTES, intermediate: int = INTERMEDIATE_BYTES, units: int = UNITS) -> Column:
    return first_error(_artifact(r, o, a, pixels, size, intermediate, units))


def export_artifact_report(a: str) -> Column:
    names = ["export_id", "format", "source_output_id", "source_output_sha256", "output_sha256"]
    return F.expr(_lines(*[(n, f"{a}.{n}") for n in names], ("output_bytes", _bytes(f"{a}.bytes")), ("peak_intermediate_bytes", f"{a}.peak_intermediate_bytes"), ("execution_units", f"{a}.execution_units")))


def export_destination(d: str, a: str) -> Column:
    m = f"{d}.metadata"
    head = [
        ("MissingRelativePath", empty(f"{d}.relative_path")),
        ("PathTooLong", over(_bytes(f"{d}.relative_path"), 240)),
        ("UnsafePath", unsafe_path(f"{d}.relative_path")),
        ("ArtifactIdentityMismatch", _different(f"{d}.export_id", f"{a}.export_id")),
        ("ArtifactDigestMismatch", _different(f"{d}.output_sha256", f"{a}.output_sha256")),
        ("TooManyMetadataEntries", over(f"size({m})", 32)),
    ]
    each = [
        ("EmptyMetadataKey", empty("x.key")),
        ("MetadataKeyTooLong", over(_bytes("x.key"), 64)),
        ("MetadataValueTooLong", over(_bytes("x.value"), 1024)),
        ("UnsafeMetadataText", f"{breaks_report('x.key')} OR {breaks_report('x.value')}"),
        ("ReservedMetadataKey", f"x.key IN {RESERVED_KEYS}"),
        ("DuplicateMetadataKey", duplicated(m, "key")),
    ]
    return first_error(head, of_items(m, each))


def export_destination_report(d: str) -> Column:
    each = "concat({})".format(
        ", ".join(f"'metadata[', i, '].{n}_bytes=', octet_length(x.{n}), '\\n', 'metadata[', i, '].{n}=', x.{n}, '\\n'" for n in ("key", "value"))
    )
    head = _lines(("path_bytes", _bytes(f"{d}.relative_path")), ("path", f"{d}.relative_path"), ("metadata_count", f"size({d}.metadata)"))
    return F.expr(f"concat({head}, array_join(transform({d}.metadata, (x, i) -> {each}), ''))")


# Certificates and requests --------------------------------------------------------------------------------------------


def quality_certificate(q: str, r: str, o: str, a: str) -> Column:
    m = f"{q}.metrics"
    invalid = " OR ".join(f"coalesce({c}, true)" for _, c in _artifact(r, o, a, PIXELS, EXPORT_BYTES, INTERMEDIATE_BYTES, UNITS))
    head = [
        ("InvalidExportArtifact", invalid),
        ("InputProvenanceMismatch", _different(f"{q}.input_sha256", f"{a}.source_output_sha256")),
        ("OutputProvenanceMismatch", _different(f"{q}.output_sha256", f"{a}.output_sha256")),
        *certificate_identity(q),
    ]
    return first_error(head, certificate_metrics(m))


def certificate_identity(q: str) -> Checks:
    m = f"{q}.metrics"
    return [
        ("MissingIdentity", f"{empty(f'{q}.schema_version', f'{q}.certificate_id')} OR {breaks_report(f'{q}.schema_version')} OR {breaks_report(f'{q}.certificate_id')}"),
        ("InvalidDigest", f"NOT {sha256_like(f'{q}.input_sha256')} OR NOT {sha256_like(f'{q}.output_sha256')}"),
        ("MissingToolchainRevision", f"{empty(f'{q}.toolchain_revision')} OR {breaks_report(f'{q}.toolchain_revision')}"),
        ("ZeroSamples", f"{q}.sample_count = 0"),
        ("SampleBudgetExceeded", over(f"{q}.sample_count", CERTIFICATE_SAMPLES)),
        ("ZeroExecutionUnits", f"{q}.execution_units = 0"),
        ("ExecutionBudgetExceeded", over(f"{q}.execution_units", CERTIFICATE_UNITS)),
        ("EmptyMetrics", f"size({m}) < 1"),
        ("TooManyMetrics", over(f"size({m})", CERTIFICATE_METRICS)),
    ]


def certificate_metrics(m: str) -> str:
    return of_items(
        m,
        [
            ("InvalidMetric", f"{empty('x.name')} OR {breaks_report('x.name')} OR {not_finite('x.measured', 'x.minimum', 'x.maximum')} OR x.minimum > x.maximum"),
            ("DuplicateMetric", f"i > 0 AND x.name = {before(m, 'name')}"),
            ("NonDeterministicMetricOrder", f"i > 0 AND x.name < {before(m, 'name')}"),
            ("ThresholdViolation", "x.measured < x.minimum OR x.measured > x.maximum"),
        ],
    )


def _common_request(r: str, schema: str) -> Checks:
    return [
        ("UnsupportedSchema", _different(f"{r}.schema_version", f"'{schema}'")),
        ("EmptyRequestId", empty(f"{r}.request_id")),
        ("RequestIdTooLarge", over(_bytes(f"{r}.request_id"), REQUEST_ID)),
        ("UnsafeRequestId", breaks_report(f"{r}.request_id")),
        ("InputTooLarge", over(f"{r}.input_bytes", REQUEST_INPUT)),
        ("OutputTooLarge", over(f"{r}.output_bytes", REQUEST_OUTPUT)),
        ("WorkLimitExceeded", over(f"{r}.work_units", REQUEST_WORK)),
    ]


def request_envelope(r: str, schema: str) -> Column:
    return first_error(_common_request(r, schema), [("MissingCertificateEvidence", f"{r}.operation = 'certified_export'"), ("UnsupportedOperation", f"{r}.operation <> 'version'")])


def certified_request(r: str, c: str, schema: str) -> Column:
    digests = " OR ".join(f"NOT {sha256_like(v)}" for v in (f"{r}.certificate_sha256", f"{c}.certificate_sha256", f"{c}.input_sha256", f"{c}.output_sha256"))
    texts = f"{empty(f'{c}.certificate_id', f'{c}.toolchain_revision')} OR {_bytes(f'{c}.canonical_bytes')} = 0 OR {breaks_report(f'{c}.certificate_id')} OR {breaks_report(f'{c}.toolchain_revision')}"
    return first_error(
        _common_request(r, schema),
        [
            ("UnsupportedOperation", f"{r}.operation <> 'certified_export'"),
            ("MissingCertificateEvidence", empty(f"{r}.certificate_sha256")),
            ("InvalidCertificateArtifact", f"{digests} OR {texts}"),
            ("InvalidCertificateArtifact", f"sha2({c}.canonical_bytes, 256) <> {c}.certificate_sha256"),
            ("CertificateProvenanceMismatch", _different(f"{r}.certificate_sha256", f"{c}.certificate_sha256")),
        ],
    )


def snake(error: Column) -> Column:
    """Error names as they stand in reports: UnsafeRequestId becomes unsafe_request_id."""
    return F.lower(F.regexp_replace(error, "(?<=[a-z0-9])(?=[A-Z])", "_"))


def operation_name(value: Column) -> Column:
    return F.when(value.isin("version", "certified_export"), value).otherwise("unsupported")


def request_report(r: str) -> Column:
    names = [(n, f"{r}.{n}") for n in ("input_bytes", "output_bytes", "work_units")]
    operation = f"CASE WHEN {r}.operation IN ('version', 'certified_export') THEN {r}.operation ELSE 'unsupported' END"
    return F.expr(_lines(("schema_version", f"{r}.schema_version"), ("request_id", f"{r}.request_id"), ("operation", operation), *names))


def certified_request_report(r: str) -> Column:
    return F.concat(request_report(r), F.lit("certificate_sha256="), F.expr(f"coalesce({r}.certificate_sha256, '')"), F.lit("\n"))


def response_report(r: str, error: Column, schema: str) -> Column:
    """The response that a request with this first error gets: exit code 0 or 65."""
    good = error == "None"
    lines = [
        ("schema_version", F.lit(schema)),
        ("request_id", F.expr(f"{r}.request_id")),
        ("operation", operation_name(F.expr(f"{r}.operation"))),
        ("status", F.when(good, "success").otherwise("error")),
        ("exit_code", F.when(good, "0").otherwise("65")),
        ("error", snake(error)),
    ]
    return F.concat(*[x for name, value in lines for x in (F.lit(f"{name}="), value, F.lit("\n"))])


def certified_response_report(r: str, c: str, error: Column, schema: str) -> Column:
    """A refused request gets no digest back."""
    digest = F.when(error == "None", F.expr(f"{c}.certificate_sha256")).otherwise("")
    return F.concat(response_report(r, error, schema), F.lit("certificate_sha256="), digest, F.lit("\n"))


# Data sets, runs, benchmarks ------------------------------------------------------------------------------------------


def split_of(digest: Column, seed: int) -> Column:
    """Train, Validation or Test by the first 16 digits, as unsigned 64 bits, mixed with the seed; a bad digest is Train."""
    signed = F.conv(F.substring(digest, 1, 16), 16, -10).cast("bigint").bitwiseXOR(F.lit(seed))
    unsigned = F.when(signed < 0, signed.cast("decimal(20,0)") + F.expr("CAST('18446744073709551616' AS DECIMAL(20, 0))")).otherwise(signed.cast("decimal(20,0)"))
    bucket = unsigned % 100
    return F.when(~digest.rlike(r"^[0-9a-fA-F]{64}\z"), "Train").when(bucket < 80, "Train").when(bucket < 90, "Validation").otherwise("Test")


def rights_binding(s: str) -> str:
    """SQL for the digest that binds content, licence, statement, source and authorisation."""
    fields = ", X'00', ".join(f"encode({s}.{f}, 'UTF-8')" for f in ("content_sha256", "license_id", "rights_statement", "rights_grant_source"))
    return f"sha2(concat({fields}, X'00', CASE WHEN {s}.production_training_authorized THEN X'01' ELSE X'00' END), 256)"


def dataset_sample_checks(licenses: tuple[str, ...] = LICENSES, seed: int = 0) -> Checks:
    """Checks of one sample row of dataset_samples(), in order."""
    return [
        ("MissingSampleIdentity", empty("sample_id", "source_id")),
        ("NonDeterministicSampleOrder", "previous_id IS NOT NULL AND previous_id <> '' AND sample_id < previous_id"),
        ("InvalidContentDigest", f"NOT {any_sha256_like('content_sha256')}"),
        ("MissingRightsProvenance", empty("license_id", "rights_statement", "rights_grant_source")),
        ("LicenseNotAllowed", "license_id NOT IN (" + ", ".join(f"'{x}'" for x in licenses) + ")"),
        ("ProductionTrainingUnauthorized", "NOT production_training_authorized"),
        ("InvalidRightsBinding", f"NOT {any_sha256_like('rights_binding_sha256')}"),
        ("RightsBindingMismatch", "expected_binding <> rights_binding_sha256"),
        ("ZeroSampleBytes", "byte_size = 0"),
        ("SampleByteBudgetExceeded", over("byte_size", SAMPLE_BYTES)),
        ("TotalByteBudgetExceeded", over("total_bytes", TOTAL_BYTES)),
        ("ArtifactIdentityMismatch", _different("artifact_id", "sample_id")),
        ("ArtifactByteSizeMismatch", _different("artifact_bytes", "byte_size")),
        ("ContentDigestMismatch", _different("artifact_sha256", "lower(content_sha256)")),
        ("DuplicateSampleId", "same_id > 1"),
        ("DuplicateContentDigest", "same_content > 1"),
        ("SplitAssignmentMismatch", _different("split", "expected_split")),
    ]


def training_run(t: str) -> Column:
    h = f"{t}.hyperparameters"
    head = [
        ("MissingSchemaVersion", empty(f"{t}.schema_version")),
        ("MissingRunIdentity", empty(f"{t}.run_id")),
        ("MissingDatasetIdentity", empty(f"{t}.dataset_id", f"{t}.dataset_version")),
        ("MissingModelIdentity", empty(f"{t}.model_id", f"{t}.model_version")),
        ("MissingArchitectureRevision", empty(f"{t}.architecture_revision")),
        ("MissingTrainingCodeRevision", empty(f"{t}.training_code_revision")),
        ("MissingDegradationPipelineRevision", empty(f"{t}.degradation_pipeline_revision")),
        ("MissingRuntimeIdentity", empty(f"{t}.runtime_id", f"{t}.runtime_version")),
        ("MissingArtifactChecksum", empty(f"{t}.artifact_sha256")),
        ("InvalidArtifactChecksum", f"NOT {sha256_like(f'{t}.artifact_sha256')}"),
        ("ZeroMaxSteps", f"{t}.max_steps = 0"),
        ("StepBudgetExceeded", over(f"{t}.max_steps", STEPS)),
        ("ZeroBatchSize", f"{t}.batch_size = 0"),
        ("BatchBudgetExceeded", over(f"{t}.batch_size", BATCH)),
        ("TooManyHyperparameters", over(f"size({h})", HYPERPARAMETERS)),
    ]
    each = [
        ("MissingHyperparameterName", empty("x.name")),
        ("DuplicateHyperparameterName", duplicated(h, "name")),
        ("NonFiniteHyperparameterValue", not_finite("x.value")),
        ("NonDeterministicHyperparameterOrder", f"i > 0 AND x.name <= {before(h, 'name')}"),
    ]
    return first_error(head, of_items(h, each))


def benchmark_result(b: str, artifact: str) -> Column:
    m = f"{b}.metrics"
    head = [
        ("MissingSchemaVersion", empty(f"{b}.schema_version")),
        ("MissingBenchmarkIdentity", empty(f"{b}.benchmark_id", f"{b}.benchmark_version")),
        ("MissingRunIdentity", empty(f"{b}.run_id")),
        ("MissingDatasetIdentity", empty(f"{b}.dataset_id", f"{b}.dataset_version")),
        ("MissingModelIdentity", empty(f"{b}.model_id", f"{b}.model_version")),
        ("MissingArchitectureRevision", empty(f"{b}.architecture_revision")),
        ("MissingTrainingCodeRevision", empty(f"{b}.training_code_revision")),
        ("MissingDegradationPipelineRevision", empty(f"{b}.degradation_pipeline_revision")),
        ("MissingTrainingArtifactChecksum", empty(f"{b}.training_artifact_sha256")),
        ("InvalidTrainingArtifactChecksum", f"NOT {any_sha256_like(f'{b}.training_artifact_sha256')}"),
        ("MissingRuntimeIdentity", empty(f"{b}.runtime_id", f"{b}.runtime_version")),
        ("ZeroEvaluatedSamples", f"{b}.evaluated_samples = 0"),
        ("SampleBudgetExceeded", over(f"{b}.evaluated_samples", EVALUATED)),
        ("EmptyMetrics", f"size({m}) < 1"),
        ("TooManyMetrics", over(f"size({m})", BENCHMARK_METRICS)),
    ]
    each = [
        ("MissingMetricMetadata", empty("x.name", "x.version", "x.unit", "x.aggregation")),
        ("NonFiniteMetricValue", not_finite("x.value")),
        ("DuplicateMetricName", f"i > 0 AND x.name = {before(m, 'name')}"),
        ("NonDeterministicMetricOrder", f"i > 0 AND x.name < {before(m, 'name')}"),
    ]
    tail = [
        ("InvalidArtifactDigest", f"NOT {any_sha256_like(f'{b}.artifact_sha256')}"),
        ("EmptyArtifact", f"coalesce({_bytes(artifact)}, 0) = 0"),
        ("ArtifactBudgetExceeded", over(_bytes(artifact), BENCHMARK_BYTES)),
        ("ArtifactDigestMismatch", _different(f"sha2({artifact}, 256)", f"{b}.artifact_sha256")),
    ]
    return first_error(head, of_items(m, each), tail)


# Models ---------------------------------------------------------------------------------------------------------------


def _shape(dims: str, error: str) -> Checks:
    """Extents are taken one by one: the first that is zero or exceeds the budget names the error."""
    upto = f"aggregate(slice({dims}, 1, i + 1), CAST(1 AS DECIMAL(38, 0)), (s, p) -> CAST(least(s, 1000000000000) * p AS DECIMAL(38, 0)))"
    each = of_items(dims, [("ZeroTensorExtent", "x = 0"), ("TensorBudgetExceeded", over(upto, TENSOR_ELEMENTS))])
    return [(error, f"size({dims}) < 1 OR size({dims}) > {TENSOR_RANK}"), ("ZeroTensorExtent", f"{each} <=> 'ZeroTensorExtent'"), ("TensorBudgetExceeded", f"{each} <=> 'TensorBudgetExceeded'")]


def tensor_shape(dims: str, error: str = "InvalidTensorRank") -> Column:
    return first_error(_shape(dims, error))


def elements(dims: str) -> str:
    return f"aggregate({dims}, 1L, (s, p) -> s * p)"


def _model(m: str) -> Checks:
    return [("InvalidModelId", f"NOT {token(f'{m}.model_id')} OR NOT {sha256_like(f'{m}.artifact_sha256')}"), ("InvalidModelVersion", f"NOT {token(f'{m}.model_version')}")]


def _binding(b: str) -> Checks:
    return [
        ("InvalidBackend", f"NOT {token(f'{b}.backend_id')}"),
        ("InvalidProvider", f"{b}.requested_provider = 'Unknown' OR {b}.active_provider = 'Unknown'"),
        ("SilentFallback", f"{b}.fallback_used OR {b}.active_provider <> {b}.requested_provider"),
        ("NonDeterministicProvider", f"NOT {b}.deterministic"),
    ]


def _channels(dims: str, layout: str) -> str:
    return f"CASE {layout} WHEN 'NCHW' THEN get({dims}, 1) WHEN 'NHWC' THEN get({dims}, 3) ELSE 0 END"


def _layout(part: str, dims: str) -> Checks:
    return [
        ("InvalidTensorLayout", f"{part}.layout = 'Unknown' OR size({dims}) <> 4"),
        ("InvalidChannelContract", f"{part}.channels NOT IN (1, 3, 4) OR {_channels(dims, f'{part}.layout')} <> {part}.channels"),
    ]


def _execution(e: str) -> Checks:
    pre, post = f"{e}.preprocess", f"{e}.postprocess"
    bad = f"size({pre}.mean) <> {pre}.channels OR size({pre}.scale) <> {pre}.channels OR exists({pre}.mean, v -> {not_finite('v')}) OR exists({pre}.scale, v -> {not_finite('v')} OR v = 0)"
    return [
        *_model(f"{e}.model"),
        *_shape(f"{e}.input", "InvalidTensorRank"),
        *_binding(f"{e}.binding"),
        *_shape(f"{e}.output", "InvalidOutputTensor"),
        *_layout(pre, f"{e}.input"),
        ("InvalidNormalization", bad),
        *_layout(post, f"{e}.output"),
        ("InvalidPostprocessRange", f"{not_finite(f'{post}.output_min', f'{post}.output_max')} OR {post}.output_min > {post}.output_max"),
    ]


def execution_contract(e: str) -> Column:
    return first_error(_execution(e))


def _load_receipt(r: str) -> Checks:
    bad = f"NOT {token(f'{r}.model.model_id')} OR NOT {token(f'{r}.model.model_version')} OR NOT {sha256_like(f'{r}.model.artifact_sha256')} OR NOT {sha256_like(f'{r}.loaded_artifact_sha256')}"
    return [
        ("ModelNotLoaded", f"NOT {r}.loaded"),
        ("InvalidModelId", bad),
        ("ArtifactDigestMismatch", f"{r}.loaded_artifact_sha256 <> {r}.model.artifact_sha256"),
        *_binding(f"{r}.binding"),
    ]


def model_load(r: str) -> Column:
    return first_error(_load_receipt(r))


def _reference(b: str, backend: str) -> str:
    return f"{b}.backend_id = '{backend}' AND {b}.requested_provider = 'Cpu' AND {b}.active_provider = 'Cpu' AND {b}.deterministic AND NOT {b}.fallback_used"


def runtime_load(r: str, artifact: str, backend: str, size: int = MODEL_BYTES) -> Column:
    return first_error(
        _load_receipt(r),
        [
            ("UnsupportedExecution", f"NOT ({_reference(f'{r}.binding', backend)})"),
            ("EmptyModelArtifact", f"coalesce({_bytes(artifact)}, 0) = 0"),
            ("ModelArtifactBudgetExceeded", over(_bytes(artifact), size)),
            ("ArtifactDigestMismatch", f"sha2({artifact}, 256) <> {r}.loaded_artifact_sha256"),
        ],
    )


def _inference(e: str, r: str, given: str, capacity: str) -> Checks:
    return [
        *_execution(e),
        *_load_receipt(r),
        ("ArtifactDigestMismatch", f"{_different(f'{e}.model', f'{r}.model')} OR {_different(f'{e}.binding', f'{r}.binding')}"),
        ("TensorElementCountMismatch", f"{given} <> {elements(f'{e}.input')} OR {capacity} <> {elements(f'{e}.output')}"),
    ]


def inference_request(e: str, r: str, given: str, capacity: str) -> Column:
    return first_error(_inference(e, r, given, capacity))


def execute(e: str, r: str, data: str, backend: str) -> tuple[Column, Column]:
    """(error, output array<float>) of the deterministic reference runtime: nearest gather, normalise, clamp, in float32."""
    pre, post = f"{e}.preprocess", f"{e}.postprocess"
    error = first_error(
        [("ModelNotLoaded", f"NOT {r}.loaded"), ("UnsupportedExecution", f"NOT ({_reference(f'{e}.binding', backend)})")],
        _inference(e, r, f"size({data})", elements(f"{e}.output")),
        [("NonFiniteTensorData", f"exists({data}, v -> {not_finite('v')})")],
    )
    source = f"CAST((CAST(o AS BIGINT) * size({data})) DIV {elements(f'{e}.output')} AS INT)"
    plane = f"(get({e}.input, 2) * get({e}.input, 3))"
    channel = f"CASE WHEN {pre}.layout = 'NHWC' THEN {source} % get({e}.input, 3) ELSE CAST({source} DIV {plane} AS INT) % get({e}.input, 1) END"
    value = f"CAST((get({data}, {source}) - get({pre}.mean, {channel})) / get({pre}.scale, {channel}) AS FLOAT)"
    bounded = f"greatest({post}.output_min, least({post}.output_max, {value}))"
    output = F.expr(f"transform(sequence(0, CAST({elements(f'{e}.output')} AS INT) - 1), o -> {bounded})")
    return error, F.when(error == "None", output)


# Packages -------------------------------------------------------------------------------------------------------------


def _release(m: str, schema: str, version: str, api: str) -> Checks:
    return [
        ("UnsupportedSchema", _different(f"{m}.schema_version", f"'{schema}'")),
        ("UnsupportedProductVersion", _different(f"{m}.product_version", f"'{version}'")),
        ("UnsupportedCoreApiSchema", _different(f"{m}.core_api_schema", f"'{api}'")),
        ("InvalidSourceRevision", rf"NOT {m}.source_revision RLIKE '^[0-9a-f]{{40}}\\z'"),
        ("UnsupportedChannel", f"{m}.channel NOT IN ('candidate', 'stable')"),
    ]


def release_manifest(m: str, schema: str, version: str, api: str) -> Column:
    return first_error(_release(m, schema, version, api))


def release_report(m: str) -> str:
    return _lines(("schema", f"{m}.schema_version"), *[(n, f"{m}.{n}") for n in ("product_version", "core_api_schema", "source_revision", "channel")])


def _inventory(v: str, schema: str, paths: tuple[str, ...]) -> list[Checks | str]:
    e = f"{v}.entries"
    head = [
        ("UnsupportedSchema", _different(f"{v}.schema_version", f"'{schema}'")),
        ("InvalidReleaseManifestDigest", f"NOT {sha256_like(f'{v}.release_manifest_sha256')}"),
        ("EmptyInventory", f"size({e}) < 1"),
        ("TooManyEntries", over(f"size({e})", PACKAGE_ENTRIES)),
        ("DuplicatePath", f"size(array_distinct(transform({e}, x -> x.path))) <> size({e})"),
    ]
    each = [
        ("UnsupportedPath", f"x.path NOT IN {paths}"),
        ("InvalidEntryDigest", f"NOT {sha256_like('x.sha256')}"),
        ("InvalidEntrySize", "x.size_bytes = 0"),
        ("TotalSizeExceeded", over(running(e, "size_bytes"), PACKAGE_BYTES)),
    ]
    return [head, of_items(e, each)]


def inventory(v: str, schema: str, paths: tuple[str, ...] = PACKAGE_PATHS) -> Column:
    return first_error(*_inventory(v, schema, paths))


def inventory_report(v: str) -> str:
    rows = f"array_join(transform(array_sort(transform({v}.entries, x -> struct(x.path AS path, x.size_bytes AS size_bytes, x.sha256 AS sha256))), x -> concat('file=', x.path, '|', x.size_bytes, '|', x.sha256, '\\n')), '')"
    return f"concat({_lines(('schema', f'{v}.schema_version'), ('release_manifest_sha256', f'{v}.release_manifest_sha256'))}, {rows})"


def _error_sql(parts: list[Checks | str]) -> str:
    from tessera.contracts.checks import _case

    return "coalesce(" + ", ".join(p if isinstance(p, str) else _case(p) for p in parts) + ")"


def _package_head(m: str, v: str, release: tuple[str, str, str], schema: str, paths: tuple[str, ...]) -> Checks:
    return [
        ("InvalidReleaseManifest", " OR ".join(f"coalesce({c}, true)" for _, c in _release(m, *release))),
        ("InvalidPackageInventory", f"{_error_sql(_inventory(v, schema, paths))} IS NOT NULL"),
    ]


def package_contents(m: str, v: str, seen: str, release: tuple[str, str, str], schema: str, paths: tuple[str, ...] = PACKAGE_PATHS) -> Column:
    """release: schema, product version, API schema of the manifest."""
    expected = f"get(filter({v}.entries, e -> e.path = x.path), 0)"
    head = [
        *_package_head(m, v, release, schema, paths),
        ("ReleaseManifestMismatch", f"{v}.release_manifest_sha256 <> sha2({release_report(m)}, 256)"),
        ("DuplicateObservedPath", f"size(array_distinct(transform({seen}, x -> x.path))) <> size({seen})"),
    ]
    each = [
        ("UnexpectedEntry", f"x.path NOT IN {paths}"),
        ("UnexpectedEntry", f"{expected} IS NULL"),
        ("NonRegularEntry", "x.kind <> 'RegularFile'"),
        ("SizeMismatch", f"x.size_bytes <> {expected}.size_bytes"),
        ("DigestMismatch", f"x.sha256 <> {expected}.sha256"),
    ]
    return first_error(head, of_items(seen, each), [("MissingEntry", f"size({seen}) <> size({v}.entries)")])


def package_identity(i: str, m: str, v: str, identity_schema: str, release: tuple[str, str, str], schema: str, paths: tuple[str, ...] = PACKAGE_PATHS) -> Column:
    digest = f"sha2({release_report(m)}, 256)"
    return first_error(
        [
            ("UnsupportedSchema", _different(f"{i}.schema_version", f"'{identity_schema}'")),
            *_package_head(m, v, release, schema, paths),
            ("ReleaseManifestMismatch", f"{v}.release_manifest_sha256 <> {digest} OR {i}.release_manifest_sha256 <> {digest}"),
            ("PackageInventoryMismatch", f"{i}.package_inventory_sha256 <> sha2({inventory_report(v)}, 256)"),
        ]
    )


def identity_report(i: str) -> str:
    return _lines(("schema", f"{i}.schema_version"), ("release_manifest_sha256", f"{i}.release_manifest_sha256"), ("package_inventory_sha256", f"{i}.package_inventory_sha256"))
