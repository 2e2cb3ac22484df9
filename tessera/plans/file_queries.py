"""Registered queries of decoders, exports and certificates over images derived from `part`, with SQL for DuckDB.

The images are 32 by 32: a light ground with two dark blocks, whose contours, and so whose exports, are known exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import images
from tessera.plans import encoded
from tessera.sinks import encoders
from tessera.session import spread, table
from tessera.sources.binary import checked, decoded


def logos(spark: SparkSession, d: str) -> DataFrame:
    """(image_id, width, height, rgba, k, s): the place of the blocks follows the part's key, their colour key and size."""
    rows = spread(table(spark, d, "part")).select(F.col("p_partkey").alias("image_id"), (F.col("p_partkey") % 11).cast("int").alias("k"), F.col("p_size").alias("s"))
    light, dark = "'FFFFFFFF'", "concat(lpad(hex(20 + k * 3), 2, '0'), '14', lpad(hex(s % 60), 2, '0'), 'FF')"
    line = f"concat(repeat({light}, 3 + k), repeat({dark}, 6), repeat({light}, 4), repeat({dark}, 7), repeat({light}, 12 - k))"
    pixels = F.unhex(F.expr(f"concat(repeat({light}, 160), repeat({line}, 19), repeat({light}, 256))"))
    return rows.select("image_id", F.lit(32).alias("width"), F.lit(32).alias("height"), pixels.alias("rgba"), "k", "s")


_LOGOS = """
l AS (SELECT p_partkey AS image_id, (p_partkey % 11)::INT AS k, p_size AS s FROM part),
i AS (SELECT image_id, k, s, unhex(repeat('ffffffff', 160) || repeat(repeat('ffffffff', 3 + k) || repeat(printf('%02x14%02xff', 20 + k * 3, s % 60), 6) || repeat('ffffffff', 4) || repeat(printf('%02x14%02xff', 20 + k * 3, s % 60), 7)
      || repeat('ffffffff', 12 - k), 19) || repeat('ffffffff', 256)) AS rgba FROM l)
"""


# Exports --------------------------------------------------------------------------------------------------------------


def certified_convert(spark: SparkSession, d: str, form: str = "svg") -> DataFrame:
    """The certificate's digest leaves out the line of the input chain, which hashes the enlarged image."""
    found = images.certified_convert(logos(spark, d), form)
    body = F.regexp_replace(F.col("certificate").cast("string"), "input_sha256=[0-9a-f]{64}\n", "")
    columns = ["image_id", "error", "output_sha256", "used_curves", "layers", F.octet_length("bytes").alias("n_bytes"), F.round("vector_iou", 6).alias("vector_iou")]
    return found.select(*columns, F.sha2(body, 256).alias("certificate_body_sha256"))


def _convert_sql(form: str) -> str:
    """Two blocks with corners rounded by 0.5: their commands as lists of numbers, then the text of the format."""
    r, t = "0.5", "0.22385762508460333"
    corners = "[{{n: 'M', v: [{a} + R, 5]}}, {{n: 'L', v: [{b} - R, 5]}}, {{n: 'C', v: [{b} - T, 5, {b}, 5 + T, {b}, 5 + R]}}, {{n: 'L', v: [{b}, 24 - R]}}, {{n: 'C', v: [{b}, 24 - T, {b} - T, 24, {b} - R, 24]}}, "
    corners += "{{n: 'L', v: [{a} + R, 24]}}, {{n: 'C', v: [{a} + T, 24, {a}, 24 - T, {a}, 24 - R]}}, {{n: 'L', v: [{a}, 5 + R]}}, {{n: 'C', v: [{a}, 5 + T, {a} + T, 5, {a} + R, 5]}}, {{n: 'Z', v: []::DOUBLE[]}}]"
    blocks = " || ".join(corners.format(a=f"({a} + k)", b=f"({b} + k)").replace("R", r).replace("T", t) for a, b in ((3, 9), (13, 20)))
    nl = "chr(10)"
    lines = lambda *rows: " || ".join(f"{row} || {nl}" for row in rows)
    names = {"eps": "map {'M': 'moveto', 'L': 'lineto', 'C': 'curveto', 'Z': 'closepath'}", "pdf": "map {'M': 'm', 'L': 'l', 'C': 'c', 'Z': 'h'}"}
    turned = "list_transform(c.v, lambda x, j: printf('%.6f', CASE WHEN j % 2 = 0 THEN 32 - x ELSE x END))"
    page = f"array_to_string(list_transform(cmds, lambda c: array_to_string(list_concat({turned}, [{names.get(form)}[c.n]]), ' ') || {nl}), '')"
    if form == "svg":
        data = "array_to_string(list_transform(cmds, lambda c: array_to_string(list_concat([c.n], list_transform(c.v, lambda x: printf('%.6f', x))), ' ')), ' ')"
        head = '\'<svg xmlns="http://www.w3.org/2000/svg" width="32" height="32" viewBox="0 0 32 32">\''
        text = lines(head, f"'  <path d=\"' || {data} || '\" fill=\"#' || printf('%02x14%02x', 20 + k * 3, s % 60) || '\" fill-rule=\"evenodd\"/>'", "'</svg>'")
    elif form == "eps":
        head = lines("'%!PS-Adobe-3.0 EPSF-3.0'", "'%%BoundingBox: 0 0 32 32'", "'%%LanguageLevel: 2'", "'%%Pages: 1'", "'%%EndComments'", "'newpath'")
        text = f"{head} || {page} || " + lines("'0 0 0 setrgbcolor'", "'eofill'", "'showpage'", "'%%EOF'")
    elif form == "pdf":
        first = lines(
            "'%PDF-1.7'", f"'% {encoders.PRODUCER} geometry export'", "'1 0 obj'", "'<< /Type /Catalog /Pages 2 0 R >>'", "'endobj'", "'2 0 obj'", "'<< /Type /Pages /Kids [3 0 R] /Count 1 >>'", "'endobj'", "'3 0 obj'",
            "'<< /Type /Page /Parent 2 0 R /MediaBox [0 0 32 32] /Resources << >> /Contents 4 0 R >>'", "'endobj'", "'4 0 obj'",
        )
        stream = f"({lines(repr('q'), repr('0 0 0 rg'))} || {page} || {lines(repr('f*'), repr('Q'))})"
        body = f"({first} || '<< /Length ' || length({stream}) || ' >>' || {nl} || 'stream' || {nl} || {stream} || 'endstream' || {nl} || 'endobj' || {nl})"
        place = lambda k: f"printf('%010d 00000 n ', strpos({body}, chr(10) || '{k} 0 obj'))"
        table_ = lines("'xref'", "'0 5'", "'0000000000 65535 f '", *[place(k) for k in range(1, 5)], "'trailer'", "'<< /Size 5 /Root 1 0 R >>'", "'startxref'", f"length({body})", "'%%EOF'")
        text = f"{body} || {table_}"
    else:
        point = lambda x, y, codes: f"'{codes[0]}', printf('%.6f', {x}), '{codes[1]}', printf('%.6f', {y}), '{codes[2]}', '0.000000'"
        old = "cmds[j - 1].v"
        line = f"['0', 'LINE', '8', '0', {point(f'{old}[-2]', f'{old}[-1]', (10, 20, 30))}, {point('c.v[1]', 'c.v[2]', (11, 21, 31))}]"
        knots = ", ".join(f"'40', '{v}.000000'" for v in (0, 0, 0, 0, 1, 1, 1, 1))
        spots = ", ".join(point(x, y, (10, 20, 30)) for x, y in ((f"{old}[-2]", f"{old}[-1]"), ("c.v[1]", "c.v[2]"), ("c.v[3]", "c.v[4]"), ("c.v[5]", "c.v[6]")))
        spline = f"['0', 'SPLINE', '8', '0', '70', '8', '71', '3', '72', '8', '73', '4', '74', '0', {knots}, {spots}]"
        rows = f"flatten(list_transform(cmds, lambda c, j: CASE c.n WHEN 'L' THEN {line} WHEN 'C' THEN {spline} ELSE []::VARCHAR[] END))"
        head = "0 SECTION 2 HEADER 9 $ACADVER 1 AC1015 9 $EXTMIN 10 0 20 0 9 $EXTMAX 10 32 20 32 0 ENDSEC 0 SECTION 2 ENTITIES".split()
        text = f"array_to_string(list_concat({head}, list_concat({rows}, ['0', 'ENDSEC', '0', 'EOF'])), {nl}) || {nl}"
    metrics = [("alpha_mae", "0", "0", "0.02"), ("export_bytes", "n", "1", "4096"), ("peak_intermediate_bytes", "n", "1", "268435456"), ("seam_error", "0", "0", "0.01"), ("vector_iou", "1", "0.98999999999999999", "1"), ("work_units", "1 + n // 1024", "1", "1000000")]
    if form == "svg":
        metrics += [("boundary_p95_pixels", "0", "0", "32"), ("color_mae", "0", "0", "1"), ("component_count_delta", "0", "0", "1024"), ("hole_count_delta", "0", "0", "1024"), ("visible_residual_ratio", "0", "0", "1")]
    rows = ["'schema_version=1'", "'certificate_id=conversion'", "'output_sha256=' || sha256(t)", "'toolchain_revision=1'", "'sample_count=2048'", "'execution_units=' || (1 + n // 1024)"]
    for k, (name, measured, low, high) in enumerate(sorted(metrics)):
        rows += [f"'metric[{k}].name={name}'", f"'metric[{k}].measured=' || ({measured})", f"'metric[{k}].minimum={low}'", f"'metric[{k}].maximum={high}'"]
    return f"""
    WITH l AS (SELECT p_partkey AS image_id, (p_partkey % 11)::INT AS k, p_size AS s FROM part), c AS (SELECT image_id, k, s, {blocks} AS cmds FROM l), w AS (SELECT image_id, {text} AS t FROM c), z AS (SELECT image_id, t, length(t) AS n FROM w)
    SELECT image_id, 'None' AS error, sha256(t) AS output_sha256, true AS used_curves, 1::INT AS layers, n::INT AS n_bytes, 1.0::DOUBLE AS vector_iou, sha256({lines(*rows)}) AS certificate_body_sha256 FROM z
    """


def _exports(spark: SparkSession, d: str) -> DataFrame:
    """The logos with their SVG; every fourth one is painted white, every seventh one's text is cut."""
    source = logos(spark, d)
    text = F.col("bytes").cast("string")
    painted = F.when(F.col("image_id") % 4 == 0, F.regexp_replace(text, "#[0-9a-f]{6}", "#ffffff")).when(F.col("image_id") % 7 == 0, F.substring(text, 1, 200)).otherwise(text)
    return images.certified_convert(source, "svg", ("image_id", "width", "height", "rgba")).withColumn("bytes", painted.cast("binary"))


def final_evidence(spark: SparkSession, d: str) -> DataFrame:
    found = images.final_evidence(_exports(spark, d))
    measures = [F.coalesce(F.round(n, 6), F.lit(-1.0)).alias(n) for n in ("color_mae", "visible_residual_ratio", "component_iou", "boundary_p95_pixels")]
    return found.select("image_id", "valid", *measures, *[F.coalesce(n, F.lit(-1)).alias(n) for n in ("reference_components", "candidate_components", "reference_holes", "candidate_holes")], "passes")


#: Bytes that can't be measured have the worst values, and no counts.
FINAL_EVIDENCE = """
WITH l AS (SELECT p_partkey AS image_id, (p_partkey % 11)::INT AS k, p_size AS s, p_partkey % 4 = 0 AS white, p_partkey % 4 <> 0 AND p_partkey % 7 = 0 AS cut FROM part)
SELECT image_id, NOT cut AS valid, CASE WHEN cut THEN 1.0 WHEN white THEN round((255 - (20 + k * 3) + 235 + 255 - s % 60) / 765.0::DOUBLE, 6) ELSE 0.0 END::DOUBLE AS color_mae, CASE WHEN cut OR white THEN 1.0 ELSE 0.0 END::DOUBLE AS visible_residual_ratio,
       CASE WHEN cut THEN 0.0 ELSE 1.0 END::DOUBLE AS component_iou, CASE WHEN cut THEN 'infinity'::DOUBLE ELSE 0.0 END AS boundary_p95_pixels, CASE WHEN cut THEN -1 ELSE 2 END::INT AS reference_components,
       CASE WHEN cut THEN -1 ELSE 2 END::INT AS candidate_components, CASE WHEN cut THEN -1 ELSE 0 END::INT AS reference_holes, CASE WHEN cut THEN -1 ELSE 0 END::INT AS candidate_holes, NOT cut AND NOT white AS passes FROM l
"""


def rasterize_svg(spark: SparkSession, d: str) -> DataFrame:
    found = images.rasterized(_exports(spark, d))
    return found.select("image_id", F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("height", F.lit(0)).alias("height"), F.sha2("pixels", 256).alias("pixels_sha256"))


RASTERIZE_SVG = """
WITH l AS (SELECT p_partkey AS image_id, (p_partkey % 11)::INT AS k, p_size AS s, p_partkey % 4 = 0 AS white, p_partkey % 4 <> 0 AND p_partkey % 7 = 0 AS cut FROM part),
c AS (SELECT image_id, k, cut, CASE WHEN white THEN 'ffffffff' ELSE printf('%02x14%02xff', 20 + k * 3, s % 60) END AS c FROM l),
i AS (SELECT image_id, cut, unhex(repeat('00000000', 160) || repeat(repeat('00000000', 3 + k) || repeat(c, 6) || repeat('00000000', 4) || repeat(c, 7) || repeat('00000000', 12 - k), 19) || repeat('00000000', 256)) AS px FROM c)
SELECT image_id, CASE WHEN cut THEN 0 ELSE 32 END::INT AS width, CASE WHEN cut THEN 0 ELSE 32 END::INT AS height, CASE WHEN NOT cut THEN sha256(px) END AS pixels_sha256 FROM i
"""


def pam_files(spark: SparkSession, d: str) -> DataFrame:
    file = encoders.pam(F.col("width"), F.col("height"), F.col("rgba"))
    return logos(spark, d).select("image_id", file.alias("f")).select("image_id", F.sha2("f", 256).alias("sha256"), F.octet_length("f").alias("n_bytes"))


_PAM = "encode('P7' || chr(10) || 'WIDTH 32' || chr(10) || 'HEIGHT 32' || chr(10) || 'DEPTH 4' || chr(10) || 'MAXVAL 255' || chr(10) || 'TUPLTYPE RGB_ALPHA' || chr(10) || 'ENDHDR' || chr(10)) || rgba"
PAM_FILES = f"WITH {_LOGOS} SELECT image_id, sha256({_PAM}) AS sha256, octet_length({_PAM})::INT AS n_bytes FROM i"


# Decoders -------------------------------------------------------------------------------------------------------------


def _read(files: DataFrame) -> DataFrame:
    """Rows (image_id, content) as a table of binary files: every fifth one cut short, every seventh of one byte."""
    broken = F.when(F.col("image_id") % 5 == 0, F.expr("substring(content, 1, CAST(length(content) * 0.6 AS INT))")).when(F.col("image_id") % 7 == 0, F.expr("X'00'")).otherwise(F.col("content"))
    files = files.select(F.col("image_id").cast("string").alias("path"), broken.alias("content"))
    rows = decoded(checked(files.select("path", F.octet_length("content").cast("long").alias("length"), "content")))
    return rows.select(F.col("path").cast("long").alias("image_id"), "format", "error", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("width", "height")], F.sha2("rgba", 256).alias("pixels_sha256"))


def _decoded_sql(form: str, cut: str, source: str = _LOGOS) -> str:
    """cut: the error of a file cut short."""
    whole = "image_id % 5 <> 0 AND image_id % 7 <> 0"
    return f"""
    WITH {source}
    SELECT image_id, CASE WHEN image_id % 5 = 0 OR image_id % 7 <> 0 THEN '{form}' END AS format, CASE WHEN image_id % 5 = 0 THEN '{cut}' WHEN image_id % 7 = 0 THEN 'UnsupportedFormat' ELSE 'None' END AS error,
           CASE WHEN {whole} THEN 32 ELSE 0 END::INT AS width, CASE WHEN {whole} THEN 32 ELSE 0 END::INT AS height, CASE WHEN {whole} THEN sha256(rgba) END AS pixels_sha256 FROM i
    """


def decode_tiff(spark: SparkSession, d: str) -> DataFrame:
    """Uncompressed TIFF files built in SQL."""
    tag = lambda n, kind, v: f"'{n:04X}{kind:04X}00000001' || lpad(hex({v} * {65536 if kind == 3 else 1}), 8, '0')"
    entries = [tag(256, 4, 32), tag(257, 4, 32), "'010200030000000400000086'", tag(259, 3, 1), tag(262, 3, 2), tag(273, 4, 142), tag(277, 3, 4), tag(278, 4, 32), tag(279, 4, 4096), "'015200030000000100020000'"]
    head = "unhex('4D4D002A00000008' || '000A' || " + " || ".join(entries) + " || '00000000' || '0008000800080008')"
    return _read(logos(spark, d).select("image_id", F.concat(F.expr(head), F.col("rgba")).alias("content")))


def _encoded(df: DataFrame, encode: Callable[[dict], bytes]) -> DataFrame:
    """(image_id, content): a file of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [encode(row) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], ["image_id", "content"])

    return df.mapInArrow(run, f"image_id {df.schema['image_id'].dataType.simpleString()}, content binary")


def _image(row: dict) -> np.ndarray:
    return np.frombuffer(row["rgba"], np.uint8).reshape(row["height"], row["width"], 4)


def decode_png(spark: SparkSession, d: str) -> DataFrame:
    return _read(_encoded(logos(spark, d), lambda row: encoded.png(_image(row))))


def decode_webp(spark: SparkSession, d: str) -> DataFrame:
    return _read(_encoded(logos(spark, d), lambda row: encoded.webp(_image(row))))


def decode_jpeg(spark: SparkSession, d: str) -> DataFrame:
    """16 flat blocks; images with even ids are gray, others have three components."""

    def file(row: dict) -> bytes:
        b, k, s = np.arange(16), row["k"], row["s"]
        planes = [(23 * k + 13 * b + s) % 256, 120 + (5 * b + k) % 17, 118 + (7 * b + s) % 21]
        return encoded.jpeg(np.stack(planes[: 1 if row["image_id"] % 2 == 0 else 3], axis=1).reshape(4, 4, -1))

    return _read(_encoded(logos(spark, d).drop("rgba"), file))


_FLAT = """
b AS (SELECT p_partkey AS image_id, range AS b, (23 * (p_partkey % 11) + 13 * range + p_size) % 256 AS y, 120 + (5 * range + p_partkey % 11) % 17 - 128 AS u, 118 + (7 * range + p_size) % 21 - 128 AS v FROM part, range(16)),
c AS (SELECT image_id, b, CASE WHEN image_id % 2 = 0 THEN [y, y, y] ELSE [y + 1.402::DOUBLE * v, y - 0.344136::DOUBLE * u - 0.714136::DOUBLE * v, y + 1.772::DOUBLE * u] END AS rgb FROM b),
x AS (SELECT image_id, b, repeat(array_to_string(list_transform(rgb, lambda z: printf('%02x', greatest(0, least(255, floor(z + 0.5::DOUBLE)))::INT)), '') || 'ff', 8) AS line FROM c),
r AS (SELECT image_id, b // 4 AS row, repeat(string_agg(line, '' ORDER BY b), 8) AS lines FROM x GROUP BY image_id, b // 4),
i AS (SELECT image_id, unhex(string_agg(lines, '' ORDER BY row)) AS rgba FROM r GROUP BY image_id)
"""

_FORMS = {f"certified_convert_{form}": form for form in encoders.FORMATS}


def queries() -> dict:
    converted = {name: lambda s, d, form=form: certified_convert(s, d, form) for name, form in _FORMS.items()}
    return converted | {"pam_files": pam_files, "decode_tiff": decode_tiff, "decode_png": decode_png, "decode_jpeg": decode_jpeg, "decode_webp": decode_webp, "final_evidence": final_evidence, "rasterize_svg": rasterize_svg}


def oracle_sql() -> dict[str, str]:
    read = {"decode_tiff": _decoded_sql("TIFF", "TruncatedPixelData"), "decode_png": _decoded_sql("PNG", "MalformedContainer"), "decode_jpeg": _decoded_sql("JPEG", "TruncatedPixelData", _FLAT), "decode_webp": _decoded_sql("WebP", "MalformedContainer")}
    return {name: _convert_sql(form) for name, form in _FORMS.items()} | {"pam_files": PAM_FILES, "final_evidence": FINAL_EVIDENCE, "rasterize_svg": RASTERIZE_SVG} | read
