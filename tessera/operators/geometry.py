"""Relational geometry: contour edges of masks, even-odd scan-line rasters, overlap of masks, palettes.

Edges are rows (image_id, ax, ay, bx, by). Rasterising deals them by image and scan line, so that one large image is
spread over its lines, and never compares an edge with a pixel of another line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.pixel import color_distance, color_key
from tessera.operators.neighbourhood import shifted


def mask_edges(df: DataFrame, mask: str = "mask", threshold: int = 128, id_col: str = "image_id") -> DataFrame:
    """(image_id, width, ord, ax, ay, bx, by): border edges of the foreground, clockwise, in row-major order of their pixels."""
    sides = []
    for dx, dy, (ax, ay, bx, by) in ((0, -1, (0, 0, 1, 0)), (1, 0, (1, 0, 1, 1)), (0, 1, (1, 1, 0, 1)), (-1, 0, (0, 1, 0, 0))):
        edge = f"struct(CAST(i % width + {ax} AS INT) AS ax, CAST(i DIV width + {ay} AS INT) AS ay, CAST(i % width + {bx} AS INT) AS bx, CAST(i DIV width + {by} AS INT) AS by)"
        sides.append(f"CASE WHEN coalesce({shifted(mask, dx, dy)}, 0) < {threshold} THEN {edge} END")
    every = f"flatten(transform(sequence(0, width * height - 1), i -> CASE WHEN get({mask}, i) >= {threshold} THEN array({', '.join(sides)}) ELSE array() END))"
    kept = F.filter(F.expr(every), lambda e: e.isNotNull())
    return df.select(id_col, "width", F.posexplode(kept).alias("ord", "e")).select(id_col, "width", "ord", "e.*")


def scan_hits(edges: DataFrame, id_col: str = "image_id") -> DataFrame:
    """(image_id, width, y, hit): where edges cross the centre line of row y; horizontal edges cross none."""
    low, high = F.least("ay", "by").cast("double"), F.greatest("ay", "by").cast("double")
    first, last = F.ceil(low - 0.5), F.ceil(high - 0.5) - 1
    rows = edges.where(last >= first).withColumn("y", F.explode(F.sequence(first, last)))
    t = (F.col("y") + 0.5 - F.col("ay")) / (F.col("by") - F.col("ay"))
    return rows.select(id_col, "width", F.col("y").cast("int").alias("y"), (F.col("ax") + (F.col("bx") - F.col("ax")) * t).alias("hit"))


def rasterize(edges: DataFrame, id_col: str = "image_id") -> DataFrame:
    """(image_id, y, inside array<int>): pixels of each crossed row whose centre lies before an odd number of hits."""
    lines = scan_hits(edges, id_col).groupBy(id_col, "width", "y").agg(F.collect_list("hit").alias("hits"))
    inside = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda x: F.size(F.filter("hits", lambda h: x + 0.5 < h)) % 2)
    return lines.select(id_col, "y", inside.alias("inside"))


def roundtrip_iou(df: DataFrame, mask: str = "mask", id_col: str = "image_id") -> DataFrame:
    """(image_id, n_edges, both, either, iou): each mask against the raster of its own contour edges."""
    edges = mask_edges(df, mask, id_col=id_col)
    counts = edges.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_edges"))
    raster = rasterize(edges, id_col)  # rows of the drawn raster, joined to the mask's rows
    rows = df.select(id_col, F.posexplode(F.expr(f"transform(sequence(0, height - 1), y -> slice({mask}, y * width + 1, width))")).alias("y", "line"))
    joined = rows.join(raster, [id_col, "y"], "left")
    drawn = F.coalesce("inside", F.transform("line", lambda v: F.lit(0)))
    both = F.size(F.filter(F.zip_with("line", drawn, lambda m, d: (m >= 128) & (d == 1)), lambda v: v))
    either = F.size(F.filter(F.zip_with("line", drawn, lambda m, d: (m >= 128) | (d == 1)), lambda v: v))
    sums = joined.groupBy(id_col).agg(F.sum(both).alias("both"), F.sum(either).alias("either"))
    iou = F.when(F.col("either") == 0, 1.0).otherwise(F.col("both") / F.col("either"))
    return sums.join(counts, id_col, "left").select(id_col, F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "both", "either", iou.alias("iou"))


def overlap(df: DataFrame, a: str, b: str, threshold: int = 128) -> DataFrame:
    """Adds both, either, iou and disagreement of two masks of the same row; masks of other sizes don't overlap at all."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct((x >= threshold).alias("x"), (y >= threshold).alias("y")))
    count = lambda f: F.size(F.filter("_pairs", f))
    df = df.withColumn("_pairs", pairs).withColumns({"both": count(lambda p: p["x"] & p["y"]), "either": count(lambda p: p["x"] | p["y"]), "_differ": count(lambda p: p["x"] != p["y"])})
    same = F.size(a) == F.size(b)
    iou = F.when(~same, 0.0).when(F.col("either") == 0, 1.0).otherwise(F.col("both") / F.col("either"))
    differ = F.when(~same | (F.size(a) < 1), 1.0).otherwise(F.col("_differ") / F.size(a))
    return df.withColumns({"iou": iou, "disagreement": differ}).drop("_pairs", "_differ")


def color_pixels(df: DataFrame, id_col: str = "image_id", planes: tuple[str, str, str] = ("r", "g", "b"), coverage: str = "a") -> DataFrame:
    """(image_id, p, r, g, b, w): foreground pixels with their coverage."""
    zipped = F.arrays_zip(*planes, coverage)
    rows = df.select(id_col, F.posexplode(zipped).alias("p", "v"))
    return rows.select(id_col, "p", *[F.col(f"v.{c}").alias(n) for c, n in zip(planes, "rgb", strict=True)], F.col(f"v.{coverage}").alias("w")).where(F.col("w") >= 128)


def _weighted(c: str) -> Column:
    return F.expr(f"CAST((sum({c} * w) + sum(w) DIV 2) DIV sum(w) AS INT)")


def source_fill(pixels: DataFrame, id_col: str = "image_id") -> DataFrame:
    """(image_id, r, g, b): mean foreground colour by coverage, rounded half up."""
    return pixels.groupBy(id_col).agg(*[_weighted(c).alias(c) for c in "rgb"])


def palette(pixels: DataFrame, most: int = 32, id_col: str = "image_id") -> DataFrame:
    """(image_id, rank, key, weight, r, g, b): the heaviest colours of five bits a channel, ties to the smaller key."""
    counted = pixels.withColumn("key", color_key(F.col("r"), F.col("g"), F.col("b"))).groupBy(id_col, "key")
    counted = counted.agg(F.sum("w").alias("weight"), *[_weighted(c).alias(c) for c in "rgb"])
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("weight"), "key"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= most).select(id_col, "rank", "key", "weight", "r", "g", "b")


def nearest_color(pixels: DataFrame, colors: DataFrame, id_col: str = "image_id") -> DataFrame:
    """(image_id, p, rank, distance): each pixel's nearest palette colour, ties to the first; at most 32 a pixel are compared."""
    q = colors.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("rank", "r", "g", "b"))).alias("palette"))
    d = F.transform("palette", lambda c: F.struct(color_distance([c["r"], c["g"], c["b"]], [F.col("r"), F.col("g"), F.col("b")]).alias("distance"), c["rank"].alias("rank")))
    return pixels.join(q, id_col).select(id_col, "p", F.array_min(d).alias("m")).select(id_col, "p", "m.rank", "m.distance")


def composite(layers: Column) -> Column:
    """Premultiplied source-over of an array of structs r, g, b, a, from the first (lowest) on: struct(error, layer, r, g, b, a)."""
    sound = lambda v: ~F.isnan(v) & (v >= 0) & (v <= 1)
    bad = F.transform(
        layers,
        lambda p, i: F.when(~(sound(p["r"]) & sound(p["g"]) & sound(p["b"]) & sound(p["a"])), F.struct(F.lit("InvalidChannel").alias("error"), i.alias("layer"))).when(
            (p["a"] == 0) & ((p["r"] != 0) | (p["g"] != 0) | (p["b"] != 0)), F.struct(F.lit("HiddenRgbInTransparentPixel").alias("error"), i.alias("layer"))
        ),
    )
    first = F.get(F.filter(bad, lambda e: e.isNotNull()), F.lit(0))
    zero = F.struct(*[F.lit(0.0).alias(n) for n in "rgba"])
    over = lambda s, p: F.struct(*[(p[n] * (p["a"] if n != "a" else F.lit(1.0)) + s[n] * (1 - p["a"])).alias(n) for n in "rgba"])
    done = F.aggregate(layers, zero, over)
    straight = [F.when(done["a"] > 0, done[n] / done["a"]).otherwise(0.0).alias(n) for n in "rgb"]
    good = F.struct(F.lit("None").alias("error"), F.lit(-1).alias("layer"), *straight, done["a"].alias("a"))
    none = [F.lit(None).cast("double").alias(n) for n in "rgba"]
    empty = F.struct(F.lit("EmptyLayers").alias("error"), F.lit(-1).alias("layer"), *none)
    return F.when(F.size(layers) < 1, empty).when(first.isNotNull(), F.struct(first["error"].alias("error"), first["layer"].alias("layer"), *none)).otherwise(good)
