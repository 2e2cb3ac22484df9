"""Registered queries of the image operators over rasters derived from the driver's tables, with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import pixel
from tessera.operators import evidence, geometry, images, neighbourhood, resample
from tessera.plans.rasters import GRAY_SQL, RGBA_SQL, gray, rgba
from tessera.session import spread, table


def _floats(df: DataFrame, column: str = "lum", out: str = "f") -> DataFrame:
    return df.withColumn(out, F.transform(column, lambda v: v.cast("float")))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """(image_id, width, height, f): the gray rasters as floats."""
    return _floats(gray(spark, d)).select("image_id", "width", "height", "f")


def _rounded(column: str, digits: int = 5) -> F.Column:
    return F.round(F.col(column).cast("double"), digits).alias(column)


def _long(df: DataFrame, column: str, name: str = "v", digits: int = 4) -> DataFrame:
    """(image_id, p, v): one pixel a row."""
    # The outer form: below the other one the optimiser puts a filter that computes the whole column once more.
    return df.select("image_id", F.posexplode_outer(column).alias("p", "v")).select("image_id", "p", F.round(F.col("v").cast("double"), digits).alias(name))


# Pixels ---------------------------------------------------------------------------------------------------------------


def srgb_linear(spark: SparkSession, d: str) -> DataFrame:
    v = gray(spark, d).select("image_id", F.posexplode("lum").alias("p", "e"))
    lin = pixel.srgb_to_linear(F.col("e"))
    back = pixel.linear_to_srgb(lin)
    return v.select("image_id", "p", F.round(lin, 6).alias("linear"), F.round(back, 6).alias("srgb"), pixel.unit_to_u8(F.col("e")).alias("u8"))


SRGB_LINEAR = f"""
WITH {GRAY_SQL}, a AS (SELECT image_id, y * 8 + x AS p, l, CASE WHEN l <= 0.04045 THEN l / 12.92 ELSE pow((l + 0.055) / 1.055, 2.4) END AS lin FROM px)
SELECT image_id, p::INT AS p, round(lin, 6) AS linear, round(CASE WHEN lin <= 0.0031308 THEN lin * 12.92 ELSE 1.055 * pow(lin, 1 / 2.4) - 0.055 END, 6) AS srgb,
       floor(l * 255 + 0.5)::INT AS u8 FROM a
"""


def alpha_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = rgba(spark, d).select("image_id", F.posexplode(F.arrays_zip("r", "g", "b", "a")).alias("p", "v"))
    unit = [F.col(f"v.{c}") / 255.0 for c in "rgba"]
    rows = rows.select("image_id", "p", "v", pixel.premultiply(*unit).alias("m"))
    rows = rows.select("image_id", "p", "v", "m", pixel.unpremultiply(*[F.col(f"m.{c}") for c in "rgba"]).alias("s"))
    whole = pixel.unpremultiply_u8(F.col("v.r"), F.col("v.a"))
    return rows.select("image_id", "p", *[F.round(f"m.{c}", 6).alias(f"pre_{c}") for c in "rgba"], *[F.round(f"s.{c}", 6).alias(f"post_{c}") for c in "rgb"], whole.alias("u8_r"))


ALPHA_ROUNDTRIP = f"""
WITH {RGBA_SQL}
SELECT image_id, p::INT AS p, round(r / 255.0 * (a / 255.0), 6)::DOUBLE AS pre_r, round(g / 255.0 * (a / 255.0), 6)::DOUBLE AS pre_g, round(b / 255.0 * (a / 255.0), 6)::DOUBLE AS pre_b,
       round(a / 255.0, 6)::DOUBLE AS pre_a, CASE WHEN a > 0 THEN round(r / 255.0, 6) ELSE 0 END::DOUBLE AS post_r, CASE WHEN a > 0 THEN round(g / 255.0, 6) ELSE 0 END::DOUBLE AS post_g,
       CASE WHEN a > 0 THEN round(b / 255.0, 6) ELSE 0 END::DOUBLE AS post_b, CASE WHEN a > 0 THEN least(255, (r * 255 + a // 2) // a) ELSE 0 END::INT AS u8_r
FROM px
"""


def color_bins(spark: SparkSession, d: str) -> DataFrame:
    rows = rgba(spark, d).select("image_id", F.explode(F.arrays_zip("r", "g", "b", "a")).alias("v"))
    c = [F.col(f"v.{n}") for n in "rgb"]
    u = [x / 255.0 for x in c]
    cover = F.when(F.max(F.when(F.col("v.a") != 255, 1).otherwise(0)).over(_by_image()) == 1, F.col("v.a")).otherwise(pixel.dark_coverage(*c))
    rows = rows.select("image_id", pixel.color_bin(*u).alias("bin"), pixel.color_key(*c).alias("key"), cover.alias("cover"), pixel.luminance(*u).alias("lum"))
    return rows.groupBy("image_id", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least_key"), F.sum(F.when(pixel.is_foreground(F.col("cover")), 1).otherwise(0)).alias("n_fg"), F.round(F.max("lum"), 4).alias("max_lum"))


def _by_image():
    from pyspark.sql import Window

    return Window.partitionBy("image_id")


COLOR_BINS = f"""
WITH {RGBA_SQL}, v AS (
  SELECT image_id, least(7, floor(r / 255.0 * 8)) * 64 + least(7, floor(g / 255.0 * 8)) * 8 + least(7, floor(b / 255.0 * 8)) AS bin, (r >> 3) * 1024 + (g >> 3) * 32 + (b >> 3) AS k,
         CASE WHEN max((a <> 255)::INT) OVER (PARTITION BY image_id) = 1 THEN a WHEN 54 * r + 183 * g + 19 * b < 32768 THEN 255 ELSE 0 END AS cover,
         0.2126::DOUBLE * r / 255 + 0.7152::DOUBLE * g / 255 + 0.0722::DOUBLE * b / 255 AS lum FROM px)
SELECT image_id, bin::INT AS bin, count(*) AS n, min(k) AS least_key, sum((cover >= 128)::INT)::BIGINT AS n_fg, round(max(lum), 4) AS max_lum FROM v GROUP BY image_id, bin
"""


# Content --------------------------------------------------------------------------------------------------------------


def content_route(spark: SparkSession, d: str) -> DataFrame:
    planes = {c: F.transform(c, lambda v: (v / 255.0).cast("float")) for c in "rgba"}
    found = neighbourhood.classify(neighbourhood.features(rgba(spark, d).withColumns(planes), "r", "g", "b", "a"))
    names = ["edge_density", "flat_region_ratio", "color_complexity", "texture_energy", "alpha_transition_ratio"]
    return found.select("image_id", *[_rounded(n) for n in names], "kind", "route", _rounded("confidence", 4))


CONTENT_ROUTE = f"""
WITH {RGBA_SQL}, f AS (SELECT image_id, x, y, (r / 255.0)::FLOAT AS r, (g / 255.0)::FLOAT AS g, (b / 255.0)::FLOAT AS b, (a / 255.0)::FLOAT AS a FROM px),
l AS (SELECT *, 0.2126::DOUBLE * r::DOUBLE + 0.7152::DOUBLE * g::DOUBLE + 0.0722::DOUBLE * b::DOUBLE AS lum FROM f),
s AS (
  SELECT image_id, abs(lum - lag(lum) OVER (PARTITION BY image_id, y ORDER BY x)) AS d, abs(a - lag(a) OVER (PARTITION BY image_id, y ORDER BY x)) AS da FROM l
  UNION ALL SELECT image_id, abs(lum - lag(lum) OVER (PARTITION BY image_id, x ORDER BY y)), abs(a - lag(a) OVER (PARTITION BY image_id, x ORDER BY y)) FROM l
), t AS (
  SELECT image_id, count(*)::DOUBLE AS n, sum((d >= 0.12::DOUBLE)::INT) AS e, sum((d <= 0.025::DOUBLE)::INT) AS fl, sum(CASE WHEN d < 0.12::DOUBLE THEN d * d ELSE 0 END) AS sq, sum((da::DOUBLE >= 0.1::DOUBLE)::INT) AS al
  FROM s WHERE d IS NOT NULL GROUP BY image_id
), c AS (
  SELECT image_id, count(DISTINCT least(7, floor(r * 8)) * 64 + least(7, floor(g * 8)) * 8 + least(7, floor(b * 8))) / 16.0::DOUBLE AS cc FROM f GROUP BY image_id
), q AS (
  SELECT image_id, e / n AS edge, fl / n AS flat, cc, least(1.0, 2 * sqrt(sq / n)) AS tex, al / n AS alpha, greatest(e / n, al / n) AS se FROM t JOIN c USING (image_id)
), k AS (
  SELECT *, CASE WHEN cc <= 0.10 AND flat >= 0.68 AND se >= 0.14 THEN 'LineArt' WHEN cc <= 0.20 AND flat >= 0.58 AND se >= 0.04 AND tex <= 0.18 THEN 'Logo'
              WHEN cc >= 0.18 AND se >= 0.08 AND flat >= 0.30 THEN 'Mixed' WHEN cc >= 0.30 AND tex >= 0.08 AND flat <= 0.52 THEN 'Photo' ELSE 'Uncertain' END AS kind FROM q
)
SELECT image_id, round(edge, 5) AS edge_density, round(flat, 5) AS flat_region_ratio, round(cc, 5) AS color_complexity, round(tex, 5) AS texture_energy, round(alpha, 5) AS alpha_transition_ratio, kind,
       CASE kind WHEN 'LineArt' THEN 'VectorReconstruction' WHEN 'Logo' THEN 'VectorReconstruction' WHEN 'Mixed' THEN 'Hybrid' WHEN 'Photo' THEN 'PhotoRestoration' ELSE 'ConservativeRaster' END AS route,
       round(least(1.0, greatest(0.0, CASE kind WHEN 'LineArt' THEN 0.55 + 0.25 * flat + 0.20 * se WHEN 'Logo' THEN 0.50 + 0.30 * flat + 0.20 * (1 - cc)
             WHEN 'Mixed' THEN 0.46 + 0.18 * se + 0.18 * cc + 0.18 * flat WHEN 'Photo' THEN 0.48 + 0.26 * cc + 0.26 * tex ELSE 0.35 END)), 4)::DOUBLE AS confidence FROM k
"""


# Masks and contours ---------------------------------------------------------------------------------------------------


def mask_edges(spark: SparkSession, d: str) -> DataFrame:
    return geometry.mask_edges(gray(spark, d)).select("image_id", "ax", "ay", "bx", "by")


_EDGES = f"""
{GRAY_SQL}, e AS (
  SELECT p.image_id, x + s.ax AS ax, y + s.ay AS ay, x + s.bx AS bx, y + s.b_y AS b_y
  FROM px p CROSS JOIN (VALUES (0, -1, 0, 0, 1, 0), (1, 0, 1, 0, 1, 1), (0, 1, 1, 1, 0, 1), (-1, 0, 0, 1, 0, 0)) s(dx, dy, ax, ay, bx, b_y)
  WHERE cov >= 128 AND NOT EXISTS (SELECT 1 FROM px q WHERE q.image_id = p.image_id AND q.x = p.x + s.dx AND q.y = p.y + s.dy AND q.cov >= 128)
)"""
MASK_EDGES = f'WITH {_EDGES} SELECT image_id, ax::INT AS ax, ay::INT AS ay, bx::INT AS bx, b_y::INT AS "by" FROM e'


def mask_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return geometry.roundtrip_iou(gray(spark, d)).select("image_id", "n_edges", "both", "either", "iou")


MASK_ROUNDTRIP = f"""
WITH {_EDGES}, drawn AS (
  SELECT p.image_id, p.x, p.y, p.cov, (SELECT count(*) FROM e WHERE e.image_id = p.image_id AND least(ay, b_y) <= p.y AND greatest(ay, b_y) > p.y AND ay <> b_y AND p.x + 0.5 < ax) % 2 AS inside FROM px p
), n AS (SELECT image_id, count(*) AS n_edges FROM e GROUP BY image_id)
SELECT image_id, coalesce(any_value(n_edges), 0) AS n_edges, sum((cov >= 128 AND inside = 1)::INT)::BIGINT AS both, sum((cov >= 128 OR inside = 1)::INT)::BIGINT AS either,
       CASE WHEN sum((cov >= 128 OR inside = 1)::INT) = 0 THEN 1.0 ELSE sum((cov >= 128 AND inside = 1)::INT) / sum((cov >= 128 OR inside = 1)::INT)::DOUBLE END AS iou
FROM drawn LEFT JOIN n USING (image_id) GROUP BY image_id
"""


def _two_masks(spark: SparkSession, d: str) -> DataFrame:
    """The mask of each raster and that of the next brighter threshold."""
    return gray(spark, d).withColumn("other", F.transform("lum", lambda v: F.when(v > 0.55, 255).otherwise(0)))


def mask_overlap(spark: SparkSession, d: str) -> DataFrame:
    return geometry.overlap(_two_masks(spark, d), "mask", "other").select("image_id", "both", "either", _rounded("iou", 6), _rounded("disagreement", 6))


MASK_OVERLAP = f"""
WITH {GRAY_SQL}, m AS (SELECT image_id, cov >= 128 AS a, l > 0.55::DOUBLE AS b FROM px)
SELECT image_id, sum((a AND b)::INT)::INT AS both, sum((a OR b)::INT)::INT AS either, CASE WHEN sum((a OR b)::INT) = 0 THEN 1.0 ELSE round(sum((a AND b)::INT) / sum((a OR b)::INT)::DOUBLE, 6) END AS iou,
       round(avg((a <> b)::INT), 6) AS disagreement FROM m GROUP BY image_id
"""


def topology(spark: SparkSession, d: str) -> DataFrame:
    return images.topology(gray(spark, d))


TOPOLOGY = f"""
WITH RECURSIVE {GRAY_SQL}, n AS (SELECT image_id, y * 8 + x AS p, x, y, cov >= 128 AS fg FROM px),
g AS (SELECT a.image_id, a.p, b.p AS q FROM n a JOIN n b ON a.image_id = b.image_id AND a.fg = b.fg AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
r AS (SELECT image_id, p, p AS s FROM n UNION SELECT g.image_id, g.q, r.s FROM r JOIN g ON g.image_id = r.image_id AND g.p = r.p WHERE r.s < g.q OR r.s < r.p OR true),
c AS (SELECT image_id, p, min(s) AS root FROM r GROUP BY image_id, p),
z AS (SELECT c.image_id, root, bool_or(fg) AS fg, bool_or(x IN (0, 7) OR y IN (0, 7)) AS border FROM c JOIN n ON n.image_id = c.image_id AND n.p = c.p GROUP BY c.image_id, root)
SELECT image_id, sum(fg::INT)::INT AS components, sum((NOT fg AND NOT border)::INT)::INT AS holes FROM z GROUP BY image_id
"""


def boundary_p95(spark: SparkSession, d: str) -> DataFrame:
    return images.boundary_distance(_two_masks(spark, d), "mask", "other").withColumn("p95", F.round("p95", 6))


BOUNDARY_P95 = f"""
WITH {GRAY_SQL}, m AS (SELECT image_id, x, y, 0 AS k, (cov >= 128)::INT AS v FROM px UNION ALL SELECT image_id, x, y, 1, (l > 0.55::DOUBLE)::INT FROM px),
b AS (
  SELECT image_id, k, x, y FROM (
    SELECT *, lag(v) OVER r AS a1, lead(v) OVER r AS a2, lag(v) OVER c AS a3, lead(v) OVER c AS a4 FROM m
    WINDOW r AS (PARTITION BY image_id, k, y ORDER BY x), c AS (PARTITION BY image_id, k, x ORDER BY y))
  WHERE coalesce(a1 <> v, true) OR coalesce(a2 <> v, true) OR coalesce(a3 <> v, true) OR coalesce(a4 <> v, true)
), n AS (
  SELECT s.image_id, s.k, s.x, s.y, min((s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y)) AS d FROM b s JOIN b t ON s.image_id = t.image_id AND s.k <> t.k GROUP BY ALL
), q AS (SELECT image_id, k, count(*) AS c, list_sort(list(sqrt(d::DOUBLE)))[(count(*) - 1) * 95 // 100 + 1] AS p FROM n GROUP BY image_id, k)
SELECT image_id, max(c) FILTER (k = 0)::INT AS n_points, max(c) FILTER (k = 1)::INT AS n_other, round(max(p), 6) AS p95 FROM q GROUP BY image_id
"""


def pixel_errors(spark: SparkSession, d: str) -> DataFrame:
    """Each raster against the one a step darker, with alpha one step off."""
    rows = rgba(spark, d)
    rows = rows.withColumns({**{f"{c}2": F.transform(c, lambda v: F.greatest(F.lit(0), v - F.pmod(v, F.lit(3)))) for c in "rgb"}, "a2": F.transform("a", lambda v: F.greatest(F.lit(0), v - 5))})
    found = evidence.pixel_errors(rows)
    gate = (F.col("visible_residual_ratio") <= evidence.MAX_RESIDUAL) & (F.col("alpha_mae") <= evidence.MAX_ALPHA_MAE)
    return found.select("image_id", *[_rounded(n, 6) for n in ("color_mae", "visible_residual_ratio", "alpha_mae")], gate.alias("passes"))


PIXEL_ERRORS = f"""
WITH {RGBA_SQL}, t AS (SELECT image_id, a >= 128 AS s, greatest(0, a - 5) >= 128 AS d, r % 3 + g % 3 + b % 3 AS c, a - greatest(0, a - 5) AS w FROM px), u AS (
SELECT image_id, CASE WHEN sum((s AND d)::INT) = 0 THEN 0 ELSE sum(CASE WHEN s AND d THEN c ELSE 0 END) / (sum((s AND d)::INT) * 3 * 255.0::DOUBLE) END AS m,
       CASE WHEN sum((s OR d)::INT) = 0 THEN 0 ELSE sum(((s OR d) AND (s <> d OR c <> 0))::INT) / sum((s OR d)::INT)::DOUBLE END AS v, sum(w) / (count(*) * 255.0::DOUBLE) AS am FROM t GROUP BY image_id)
SELECT image_id, round(m, 6) AS color_mae, round(v, 6) AS visible_residual_ratio, round(am, 6) AS alpha_mae, v <= 0.01::DOUBLE AND am <= 0.02::DOUBLE AS passes FROM u
"""


# Neighbourhoods -------------------------------------------------------------------------------------------------------


def local_range(spark: SparkSession, d: str) -> DataFrame:
    rows = neighbourhood.local_range(_floats(gray(spark, d)).select("image_id", "width", "height", "f"), "f")
    rows = rows.select("image_id", F.posexplode_outer(F.arrays_zip("low", "high", "mean")).alias("p", "v"))
    return rows.select("image_id", "p", *[F.round(F.col(f"v.{c}").cast("double"), 4).alias(c) for c in ("low", "high", "mean")])


_NEAR = """
near AS (SELECT a.image_id, a.x, a.y, min(b.f) AS lo, max(b.f) AS hi, avg(b.f::DOUBLE)::FLOAT AS mean, any_value(a.f) AS f FROM px1 a JOIN px1 b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.image_id, a.x, a.y)
"""
LOCAL_RANGE = f"""
WITH {GRAY_SQL}, px1 AS (SELECT image_id, x, y, l::FLOAT AS f FROM px), {_NEAR}
SELECT image_id, (y * 8 + x)::INT AS p, round(lo::DOUBLE, 4) AS low, round(hi::DOUBLE, 4) AS high, round(mean::DOUBLE, 4) AS mean FROM near
"""


def _wide(spark: SparkSession, d: str) -> DataFrame:
    """16 by 4: one raster has two blocks."""
    rows = spread(table(spark, d, "embeddings").where(F.size("embedding") == 64))
    f = F.transform("embedding", lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v.cast("double") + 1) / 2)).cast("float"))
    return rows.select(F.col("vec_id").alias("image_id"), F.lit(16).alias("width"), F.lit(4).alias("height"), f.alias("f"))


_WIDE_SQL = """
px1 AS (SELECT vec_id AS image_id, (i - 1) // 16 AS y, (i - 1) % 16 AS x, greatest(0.0, least(1.0, (v::DOUBLE + 1) / 2))::FLOAT AS f
        FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE len(embedding) = 64))
"""


def denoise(spark: SparkSession, d: str) -> DataFrame:
    return _long(neighbourhood.denoise(_wide(spark, d), "f", "out", 0.2), "out")


DENOISE = f"""
WITH {_WIDE_SQL}, {_NEAR}
SELECT image_id, (y * 16 + x)::INT AS p, round(greatest(0, least(1, f + 0.2::FLOAT * (mean - f)))::DOUBLE, 4) AS v FROM near
"""


def deblock(spark: SparkSession, d: str) -> DataFrame:
    return _long(neighbourhood.deblock(_wide(spark, d), "f", 0.5), "f")


DEBLOCK = f"""
WITH {_WIDE_SQL}, {_NEAR}, s AS (SELECT *, lag(f) OVER w AS l, lead(f) OVER w AS r FROM near WINDOW w AS (PARTITION BY image_id, y ORDER BY x))
SELECT image_id, (y * 16 + x)::INT AS p, round((CASE
  WHEN x = 7 AND abs(r - f) <= 0.25::FLOAT THEN greatest(0, least(1, greatest(lo, least(hi, f + 0.5::FLOAT * 0.5::FLOAT * (0.5::FLOAT * (f + r) - f)))))
  WHEN x = 8 AND abs(f - l) <= 0.25::FLOAT THEN greatest(0, least(1, greatest(lo, least(hi, f + 0.5::FLOAT * 0.5::FLOAT * (0.5::FLOAT * (l + f) - f))))) ELSE f END)::DOUBLE, 4) AS v FROM s
"""


def restore(spark: SparkSession, d: str) -> DataFrame:
    """With denoising off, the sharpening of the source is all that is left beside deblocking."""
    return _long(neighbourhood.restore(_sized(spark, d), ["f"], ["out"], 0.0, 0.0, 0.4), "out")


RESTORE = f"""
WITH {GRAY_SQL}, px1 AS (SELECT image_id, x, y, l::FLOAT AS f FROM px), {_NEAR}
SELECT image_id, (y * 8 + x)::INT AS p, round(greatest(0, least(1, greatest(lo, least(hi, f + 0.4::FLOAT * (f - mean)))))::DOUBLE, 4) AS v FROM near
"""


def restore_rgba(spark: SparkSession, d: str) -> DataFrame:
    """Premultiplied colour with the default strengths; results stay under the alpha."""
    unit = {c: F.transform(c, lambda v: (v / 255.0).cast("float")) for c in "rgba"}
    rows = rgba(spark, d).withColumns(unit).withColumns({c: F.zip_with(c, "a", lambda v, a: (v * a).cast("float")) for c in "rgb"})
    rows = neighbourhood.restore(rows, list("rgb"), [f"out_{c}" for c in "rgb"], alpha="a")
    under = F.forall(F.flatten(F.array(*[F.zip_with(f"out_{c}", "a", lambda v, a: v <= a) for c in "rgb"])), lambda v: v)
    return rows.select("image_id", under.alias("under_alpha"), *[F.round(F.aggregate(f"out_{c}", F.lit(0.0), lambda s, v: s + v.cast("double")), 4).alias(f"sum_{c}") for c in "rgb"])


_RESTORE_CHANNEL = """
{c}1 AS (SELECT image_id, x, y, ({c} / 255.0)::FLOAT * (a / 255.0)::FLOAT AS f, (a / 255.0)::FLOAT AS a FROM px),
{c}2 AS (SELECT p.image_id, p.x, p.y, sum(q.f::DOUBLE) AS s, sum(q.a::DOUBLE) AS w, min(q.f) AS lo, max(q.f) AS hi, any_value(p.f) AS f, any_value(p.a) AS a FROM {c}1 p JOIN {c}1 q ON p.image_id = q.image_id AND abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1 GROUP BY p.image_id, p.x, p.y),
{c}3 AS (SELECT *, CASE WHEN a <= 0 OR w <= 0 THEN 0::FLOAT ELSE greatest(0::FLOAT, least(a, (s / w * a::DOUBLE)::FLOAT)) END AS mean FROM {c}2),
{c}4 AS (SELECT image_id, x, y, lo, hi, a, greatest(0::FLOAT, least(a, f + 0.2::FLOAT * (mean - f))) AS f FROM {c}3),
{c}5 AS (SELECT p.image_id, p.x, p.y, sum(q.f::DOUBLE) AS s, sum(q.a::DOUBLE) AS w, any_value(p.lo) AS lo, any_value(p.hi) AS hi, any_value(p.f) AS f, any_value(p.a) AS a FROM {c}4 p JOIN {c}4 q ON p.image_id = q.image_id AND abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1 GROUP BY p.image_id, p.x, p.y),
{c}6 AS (SELECT *, CASE WHEN a <= 0 OR w <= 0 THEN 0::FLOAT ELSE greatest(0::FLOAT, least(a, (s / w * a::DOUBLE)::FLOAT)) END AS mean FROM {c}5),
{c}7 AS (SELECT image_id, a, greatest(0::FLOAT, least(a, greatest(lo, least(hi, f + 0.15::FLOAT * (f - mean))))) AS v FROM {c}6)"""
#: The images are smaller than a block, so deblocking changes nothing.
RESTORE_RGBA = f"""
WITH {RGBA_SQL}, {", ".join(_RESTORE_CHANNEL.format(c=c).strip() for c in "rgb")}, t AS (SELECT image_id, 'r' AS c, a, v FROM r7 UNION ALL SELECT image_id, 'g', a, v FROM g7 UNION ALL SELECT image_id, 'b', a, v FROM b7)
SELECT image_id, bool_and(v <= a) AS under_alpha, {", ".join(f"round(sum(v::DOUBLE) FILTER (c = '{c}'), 4) AS sum_{c}" for c in "rgb")} FROM t GROUP BY image_id
"""


def super_resolve(spark: SparkSession, d: str) -> DataFrame:
    return _long(neighbourhood.super_resolve(_sized(spark, d), "f", "out", 2), "out")


SUPER_RESOLVE = f"""
WITH {GRAY_SQL}, t AS (SELECT x, y, greatest(0, least(7, (x + 0.5) / 2 - 0.5))::DOUBLE AS sx, greatest(0, least(7, (y + 0.5) / 2 - 0.5))::DOUBLE AS sy FROM range(16) a(x), range(16) b(y)),
u AS (SELECT x, y, floor(sx) AS x0, least(7, floor(sx) + 1) AS x1, floor(sy) AS y0, least(7, floor(sy) + 1) AS y1, (sx - floor(sx))::FLOAT AS tx, (sy - floor(sy))::FLOAT AS ty FROM t), f AS (SELECT image_id, x, y, l::FLOAT AS f FROM px)
SELECT a.image_id, (u.y * 16 + u.x)::INT AS p, round(greatest(least(a.f, b.f, c.f, e.f), least(greatest(a.f, b.f, c.f, e.f), (a.f + tx * (b.f - a.f)) + ty * ((c.f + tx * (e.f - c.f)) - (a.f + tx * (b.f - a.f)))))::DOUBLE, 4) AS v
FROM u JOIN f a ON a.x = x0 AND a.y = y0 JOIN f b ON b.image_id = a.image_id AND b.x = x1 AND b.y = y0 JOIN f c ON c.image_id = a.image_id AND c.x = x0 AND c.y = y1 JOIN f e ON e.image_id = a.image_id AND e.x = x1 AND e.y = y1
"""


# Resampling -----------------------------------------------------------------------------------------------------------


def tap_table(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "nation").select((F.col("n_nationkey") % 12 + 1).cast("int").alias("source"), (F.col("n_nationkey") % 7 + 2).cast("int").alias("target")).distinct()
    return resample.tap_rows(spark, sizes).select("source", "target", "place", "ord", "at", F.round("weight", 8).alias("weight"))


TAP_TABLE = """
WITH s AS (SELECT DISTINCT (n_nationkey % 12 + 1)::INT AS source, (n_nationkey % 7 + 2)::INT AS target FROM nation),
p AS (SELECT source, target, unnest(range(target))::INT AS place, target::DOUBLE / source AS scale, least(1.0, target::DOUBLE / source) AS narrow FROM s),
c AS (SELECT *, (place + 0.5) / scale - 0.5 AS centre FROM p),
r AS (SELECT *, unnest(range(ceil(centre - 3.0 / narrow)::BIGINT, floor(centre + 3.0 / narrow)::BIGINT + 1)) AS raw FROM c),
x AS (SELECT *, abs((centre - raw) * narrow) AS d FROM r),
w AS (SELECT *, CASE WHEN d >= 3 THEN 0 WHEN d < 1e-12 THEN 1.0 ELSE sin(d * pi()) / (d * pi()) * (CASE WHEN d / 3 < 1e-12 THEN 1.0 ELSE sin(d / 3 * pi()) / (d / 3 * pi()) END) END * narrow AS w FROM x)
SELECT source, target, place, (row_number() OVER (PARTITION BY source, target, place ORDER BY raw) - 1)::INT AS ord, greatest(0, least(source - 1, raw))::INT AS at,
       round(w / sum(w) OVER (PARTITION BY source, target, place), 8) AS weight FROM w WHERE abs(w) > 1e-15
"""


def resize_lanczos3(spark: SparkSession, d: str) -> DataFrame:
    return _long(resample.resize_plane(_sized(spark, d), "f", "out", (16, 16)), "out")


_RESIZE_SQL = """
taps AS (
  WITH p AS (SELECT range AS place, range::DOUBLE AS pd FROM range({target})), c AS (SELECT place, (pd + 0.5) / {scale} - 0.5 AS centre FROM p),
  r AS (SELECT *, unnest(range(ceil(centre - {reach})::BIGINT, floor(centre + {reach})::BIGINT + 1)) AS raw FROM c), x AS (SELECT *, abs((centre - raw) * {narrow}) AS d FROM r),
  w AS (SELECT *, {kernel} * {narrow} AS w FROM x)
  SELECT place, raw, greatest(0, least(7, raw)) AS at, w / sum(w) OVER (PARTITION BY place) AS w FROM w WHERE abs(w) > 1e-15
), hor AS (SELECT image_id, y, t.place AS x, sum(l::FLOAT::DOUBLE * w)::FLOAT AS f FROM px JOIN taps t ON px.x = t.at GROUP BY image_id, y, t.place),
ver AS (SELECT image_id, x, t.place AS y, sum(f::DOUBLE * w)::FLOAT AS f FROM hor JOIN taps t ON hor.y = t.at GROUP BY image_id, x, t.place),
lim AS (SELECT image_id, a.place AS x, b.place AS y, min(l::FLOAT) AS lo, max(l::FLOAT) AS hi FROM px JOIN taps a ON px.x = a.at JOIN taps b ON px.y = b.at GROUP BY image_id, a.place, b.place)
SELECT image_id, (y * {target} + x)::INT AS p, round(greatest(lo, least(hi, f))::DOUBLE, 4) AS v FROM ver JOIN lim USING (image_id, x, y)
"""
_LANCZOS = "CASE WHEN d >= 3 THEN 0 WHEN d < 1e-12 THEN 1.0 ELSE sin(d * pi()) / (d * pi()) * sin(d / 3 * pi()) / (d / 3 * pi()) END"
_CUBIC = "CASE WHEN d < 1 THEN 1.5 * d * d * d - 2.5 * d * d + 1 WHEN d < 2 THEN -0.5 * d * d * d + 2.5 * d * d - 4 * d + 2 ELSE 0 END"
RESIZE_LANCZOS3 = f"WITH {GRAY_SQL}, " + _RESIZE_SQL.format(target=16, scale="2.0::DOUBLE", reach="3.0::DOUBLE", narrow="1.0::DOUBLE", kernel=_LANCZOS)


def resize_bicubic(spark: SparkSession, d: str) -> DataFrame:
    found = images.resized(_sized(spark, d), ["f"], 12, 12, "bicubic")
    return _long(found, "pixels")


RESIZE_BICUBIC = f"WITH {GRAY_SQL}, " + _RESIZE_SQL.format(target=12, scale="1.5::DOUBLE", reach="2.0::DOUBLE", narrow="1.0::DOUBLE", kernel=_CUBIC)


def downscale_bilinear(spark: SparkSession, d: str) -> DataFrame:
    return _long(resample.resize_plane(_sized(spark, d), "f", "out", (4, 4), "bilinear"), "out")


DOWNSCALE = f"WITH {GRAY_SQL}, " + _RESIZE_SQL.format(target=4, scale="0.5::DOUBLE", reach="2.0::DOUBLE", narrow="0.5::DOUBLE", kernel="CASE WHEN d < 1 THEN 1 - d ELSE 0 END")


# Colours --------------------------------------------------------------------------------------------------------------


def source_fill(spark: SparkSession, d: str) -> DataFrame:
    return geometry.source_fill(geometry.color_pixels(rgba(spark, d)))


_FG = f"{RGBA_SQL}, fg AS (SELECT image_id, p, r, g, b, a AS w FROM px WHERE a >= 128)"
_MEAN = "((sum({c} * w) + sum(w) // 2) // sum(w))::INT AS {c}"
SOURCE_FILL = f"WITH {_FG} SELECT image_id, {', '.join(_MEAN.format(c=c) for c in 'rgb')} FROM fg GROUP BY image_id"


def palette(spark: SparkSession, d: str) -> DataFrame:
    return geometry.palette(geometry.color_pixels(rgba(spark, d)), 4)


_PALETTE = f"""
{_FG}, q AS (SELECT image_id, (r >> 3) * 1024 + (g >> 3) * 32 + (b >> 3) AS key, sum(w)::BIGINT AS weight, {', '.join(_MEAN.format(c=c) for c in 'rgb')} FROM fg GROUP BY ALL),
pal AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY weight DESC, key)::INT AS rank, key, weight, r, g, b FROM q QUALIFY rank <= {{most}})"""
PALETTE = f"WITH {_PALETTE.format(most=4)} SELECT * FROM pal"


def nearest_color(spark: SparkSession, d: str) -> DataFrame:
    px = geometry.color_pixels(rgba(spark, d))
    return geometry.nearest_color(px, geometry.palette(px, 4))


NEAREST = f"""
WITH {_PALETTE.format(most=4)}, m AS (SELECT fg.image_id, p, rank, (fg.r - pal.r) * (fg.r - pal.r) + (fg.g - pal.g) * (fg.g - pal.g) + (fg.b - pal.b) * (fg.b - pal.b) AS distance FROM fg JOIN pal USING (image_id))
SELECT image_id, p::INT AS p, rank, distance FROM m QUALIFY row_number() OVER (PARTITION BY image_id, p ORDER BY distance, rank) = 1
"""


def alpha_composite(spark: SparkSession, d: str) -> DataFrame:
    """Three layers: the first three pixels of each raster, one with hidden colour."""
    layer = lambda k: F.struct(*[(F.get(c, F.lit(k)) / 255.0).alias(c) for c in "rgb"], F.when(F.col("image_id") % 10 == 0, 0.0).otherwise(F.get("a", F.lit(k)) / 255.0).alias("a"))
    out = geometry.composite(F.array(layer(0), layer(1), layer(2)))
    return rgba(spark, d).select("image_id", out.alias("o")).select("image_id", "o.error", "o.layer", *[F.round(f"o.{c}", 6).alias(c) for c in "rgba"])


ALPHA_COMPOSITE = f"""
WITH {RGBA_SQL}, v AS (SELECT image_id, p, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b, CASE WHEN image_id % 10 = 0 THEN 0 ELSE a / 255.0::DOUBLE END AS a FROM px WHERE p < 3),
w AS (SELECT image_id, min(p) FILTER (a = 0 AND (r <> 0 OR g <> 0 OR b <> 0)) AS bad, {', '.join(f'max({c}) FILTER (p = {k}) AS {c}{k}' for k in range(3) for c in 'rgba')} FROM v GROUP BY image_id),
x AS (SELECT *, a2 + (a1 + a0 * (1 - a1)) * (1 - a2) AS oa, {', '.join(f'{c}2 * a2 + ({c}1 * a1 + {c}0 * a0 * (1 - a1)) * (1 - a2) AS v{c}' for c in 'rgb')} FROM w)
SELECT image_id, CASE WHEN bad IS NULL THEN 'None' ELSE 'HiddenRgbInTransparentPixel' END AS error, coalesce(bad, -1)::INT AS layer,
       {', '.join(f'CASE WHEN bad IS NULL THEN round(CASE WHEN oa > 0 THEN v{c} / oa ELSE 0 END, 6) END AS {c}' for c in 'rgb')}, CASE WHEN bad IS NULL THEN round(oa, 6) END AS a FROM x
"""


# Vectors ----------------------------------------------------------------------------------------


def contour_trace(spark: SparkSession, d: str) -> DataFrame:
    found = images.contours(gray(spark, d))
    points = F.aggregate("paths", F.lit(0), lambda s, p: s + F.size(p["points"]))
    return found.select("image_id", "error", F.size("paths").alias("n_paths"), F.size(F.filter("paths", lambda p: p["hole"])).alias("n_holes"), points.alias("n_points"))


#: Contours are told by topology: each 4-connected part of the foreground has one around it, each 8-connected part of the ground that
#: the frame doesn't reach is a hole. A lattice corner with one or three foreground pixels around it is a node; one with two across are two.
CONTOURS = f"""
WITH RECURSIVE {GRAY_SQL}, n AS (
  SELECT i.image_id, x.range - 1 AS x, y.range - 1 AS y, (y.range * 10 + x.range)::INT AS p, coalesce(px.cov >= 128, false) AS fg FROM (SELECT DISTINCT image_id FROM px) i CROSS JOIN range(10) x CROSS JOIN range(10) y
  LEFT JOIN px ON px.image_id = i.image_id AND px.x = x.range - 1 AND px.y = y.range - 1
), g AS (
  SELECT a.image_id, a.p, b.p AS q FROM n a JOIN n b ON a.image_id = b.image_id AND a.fg = b.fg AND a.p <> b.p AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (NOT a.fg OR abs(a.x - b.x) + abs(a.y - b.y) = 1)
), r AS (SELECT image_id, p, p AS s FROM n UNION SELECT g.image_id, g.q, r.s FROM r JOIN g ON g.image_id = r.image_id AND g.p = r.p WHERE r.s < g.q),
c AS (SELECT image_id, p, min(s) AS root FROM r GROUP BY image_id, p),
m AS (SELECT n.image_id, count(DISTINCT root) FILTER (fg) AS parts, count(DISTINCT root) FILTER (NOT fg) - 1 AS holes FROM n JOIN c ON c.image_id = n.image_id AND c.p = n.p GROUP BY n.image_id),
k AS (
  SELECT a.image_id, a.fg::INT + b.fg::INT + d.fg::INT + e.fg::INT AS around, a.fg = e.fg AS across FROM n a JOIN n b ON b.image_id = a.image_id AND b.p = a.p + 1 JOIN n d ON d.image_id = a.image_id AND d.p = a.p + 10
  JOIN n e ON e.image_id = a.image_id AND e.p = a.p + 11 WHERE a.x < 8 AND a.y < 8
), o AS (SELECT image_id, sum(CASE WHEN around IN (1, 3) THEN 1 WHEN around = 2 AND across THEN 2 ELSE 0 END) AS nodes FROM k GROUP BY image_id)
SELECT image_id, CASE WHEN parts = 0 THEN 'NoForeground' ELSE 'None' END AS error, (parts + holes)::INT AS n_paths, holes::INT AS n_holes, nodes::INT AS n_points FROM m JOIN o USING (image_id)
"""


def fit_curves(spark: SparkSession, d: str) -> DataFrame:
    return images.curves(gray(spark, d)).select("image_id", "error", "used_curves", "source_nodes", "recovered_nodes", _rounded("raster_iou", 6), F.sha2(F.array_join("data", "\n"), 256).alias("data_sha256"))


def gated_simplify(spark: SparkSession, d: str) -> DataFrame:
    return images.simplified(gray(spark, d)).select("image_id", "error", "total_nodes", "removed", _rounded("raster_iou", 6))


def queries() -> dict:
    return {
        "mask_roundtrip_iou": mask_roundtrip, "mask_edges": mask_edges, "mask_overlap": mask_overlap, "srgb_linear_roundtrip": srgb_linear, "alpha_roundtrip": alpha_roundtrip,
        "color_bins": color_bins, "content_route": content_route, "topology_components": topology, "boundary_p95": boundary_p95, "pixel_errors": pixel_errors,
        "local_range_3x3": local_range, "denoise_3x3": denoise, "deblock_8": deblock, "sharpen": restore, "restore_rgba": restore_rgba, "super_resolve_2x": super_resolve,
        "taps_lanczos3": tap_table, "resize_lanczos3": resize_lanczos3, "resize_bicubic": resize_bicubic, "downscale_bilinear": downscale_bilinear, "source_fill": source_fill,
        "palette_topk": palette, "nearest_color": nearest_color, "alpha_composite": alpha_composite, "contour_trace": contour_trace, "fit_curves": fit_curves,
        "gated_simplify": gated_simplify,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "mask_roundtrip_iou": MASK_ROUNDTRIP, "mask_edges": MASK_EDGES, "mask_overlap": MASK_OVERLAP, "srgb_linear_roundtrip": SRGB_LINEAR, "alpha_roundtrip": ALPHA_ROUNDTRIP,
        "color_bins": COLOR_BINS, "content_route": CONTENT_ROUTE, "topology_components": TOPOLOGY, "boundary_p95": BOUNDARY_P95, "pixel_errors": PIXEL_ERRORS,
        "local_range_3x3": LOCAL_RANGE, "denoise_3x3": DENOISE, "deblock_8": DEBLOCK, "sharpen": RESTORE, "super_resolve_2x": SUPER_RESOLVE, "taps_lanczos3": TAP_TABLE,
        "resize_lanczos3": RESIZE_LANCZOS3, "resize_bicubic": RESIZE_BICUBIC, "downscale_bilinear": DOWNSCALE, "source_fill": SOURCE_FILL, "palette_topk": PALETTE,
        "nearest_color": NEAREST, "alpha_composite": ALPHA_COMPOSITE, "contour_trace": CONTOURS, "restore_rgba": RESTORE_RGBA,
    }
