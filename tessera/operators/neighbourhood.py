"""Operators on the neighbourhood of pixels, over planes of one image a row; no rows move.

Restoration and enlargement compute stacks of images (see planes.py). The content features are expressions: out-of-range
neighbours are null there and skipped, which clips windows at the image's edge.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import planes

# Thresholds of the content features and of the routing rules.
EDGE, FLAT, ALPHA_STEP = 0.12, 0.025, 0.10
BLOCK, JUMP = 8, 0.25


def shifted(plane: str, dx: int, dy: int, width: str = "width", height: str = "height") -> str:
    """SQL for the value of the pixel dx, dy away from pixel number i, null outside."""
    ok = []
    if dx:
        ok.append(f"i % {width} + {dx} >= 0 AND i % {width} + {dx} < {width}")
    if dy:
        ok.append(f"i DIV {width} + {dy} >= 0 AND i DIV {width} + {dy} < {height}")
    value = f"get({plane}, CAST(i + {dy} * {width} + {dx} AS INT))"
    return f"CASE WHEN {' AND '.join(ok)} THEN {value} END" if ok else value


def bound(names: dict[str, str], body: str) -> Column:
    """body, an SQL expression, in which each name stands for a value that is computed once a row.

    A column that a lambda function reads would be put into it by the optimiser, and computed for every pixel.
    """
    for name, value in reversed(names.items()):
        body = f"get(transform(array({value}), {name} -> {body}), 0)"
    return F.expr(body)


def _pixels(body: str) -> str:
    return f"transform(sequence(0, width * height - 1), i -> {body})"


def local_range(df: DataFrame, plane: str, low: str = "low", high: str = "high", mean: str = "mean") -> DataFrame:
    """Least, greatest and mean value of each pixel's 3 by 3 window, clipped at the edges."""
    return planes.with_planes(df, [plane], [low, high, mean], lambda x: {low: planes.local_extent(x, np.minimum), high: planes.local_extent(x, np.maximum), mean: planes.local_mean(x)})


def denoise(df: DataFrame, plane: str, out: str, strength: float = 0.2, alpha: str | None = None) -> DataFrame:
    """Blend of each pixel with its 3 by 3 mean; planes are float arrays."""
    return planes.with_planes(df, [plane, *([alpha] if alpha else [])], [out], lambda x, a=None: {out: planes.denoised(x, strength, a)})


def deblock(df: DataFrame, plane: str, strength: float = 0.15, alpha: str | None = None) -> DataFrame:
    """Pull both sides of block boundaries together: columns first, then rows of the result."""
    if strength <= 0:
        return df
    return planes.with_planes(df, [plane, *([alpha] if alpha else [])], [plane], lambda x, a=None: {plane: planes.deblocked(x, strength, a, BLOCK, JUMP)})


def restore(df: DataFrame, colors: list[str], outs: list[str], denoise_strength: float = 0.2, deblock_strength: float = 0.15, sharpen_strength: float = 0.15, alpha: str | None = None) -> DataFrame:
    """Denoise, deblock, sharpen each colour plane; sharpened values stay within the source's local range and the alpha."""

    def kernel(*stacks: np.ndarray) -> planes.Stacks:
        a = stacks[len(colors)] if alpha else None
        found = {}
        for out, x in zip(outs, stacks, strict=False):
            base = planes.denoised(x, denoise_strength, a)
            if deblock_strength > 0:
                base = planes.deblocked(base, deblock_strength, a, BLOCK, JUMP)
            found[out] = planes.sharpened(x, base, sharpen_strength, a)
        return found

    return planes.with_planes(df, [*colors, *([alpha] if alpha else [])], outs, kernel)


def features(df: DataFrame, r: str, g: str, b: str, a: str | None = None) -> DataFrame:
    """The five content features of images with planes in 0 to 1, and `valid`."""
    at = lambda p: f"get({p}, i)"
    sound = " AND ".join(f"forall({p}, v -> v IS NOT NULL AND NOT isnan(v) AND v >= 0 AND v <= 1) AND size({p}) = width * height" for p in (r, g, b, *([a] if a else [])))
    df = df.withColumn("valid", F.expr(f"width > 0 AND height > 0 AND {sound}"))
    lum = f"0.2126D * CAST({at(r)} AS DOUBLE) + 0.7152D * CAST({at(g)} AS DOUBLE) + 0.0722D * CAST({at(b)} AS DOUBLE)"
    cell = lambda p: f"least(7, CAST({at(p)} * 8 AS INT))"
    df = df.withColumn("_bins", F.expr(f"size(array_distinct(transform(sequence(0, width * height - 1), i -> {cell(r)} * 64 + {cell(g)} * 8 + {cell(b)})))"))
    steps = lambda p, kind: f"flatten(transform(sequence(0, width * height - 1), i -> array({', '.join(f'abs({at(p)} - {shifted(p, dx, dy)})' for dx, dy in ((-1, 0), (0, -1)))})))"
    df = df.withColumn("_steps", bound({"light": _pixels(lum)}, f"filter({steps('light', 'DOUBLE')}, d -> d IS NOT NULL)"))
    alpha = f"size(filter({steps(a, 'DOUBLE')}, d -> d IS NOT NULL AND d >= {ALPHA_STEP}D))" if a else "0"
    df = df.withColumn("_alpha", F.expr(alpha))
    n = F.greatest(F.lit(1), F.size("_steps")).cast("double")
    squares = F.aggregate(F.filter("_steps", lambda d: d < EDGE), F.lit(0.0), lambda s, d: s + d * d)
    return df.withColumns(
        {
            "edge_density": F.size(F.filter("_steps", lambda d: d >= EDGE)) / n,
            "flat_region_ratio": F.size(F.filter("_steps", lambda d: d <= FLAT)) / n,
            "color_complexity": F.col("_bins") / F.least(F.lit(512), F.col("width") * F.col("height")).cast("double"),
            "texture_energy": F.least(F.lit(1.0), F.sqrt(squares / n) * 2),
            "alpha_transition_ratio": F.col("_alpha") / n,
        }
    ).drop("_bins", "_steps", "_alpha")


def classify(df: DataFrame) -> DataFrame:
    """kind, route and confidence from the five features, by ordered rules; null where a feature is not finite."""
    names = ["edge_density", "flat_region_ratio", "color_complexity", "texture_energy", "alpha_transition_ratio"]
    finite = F.lit(True)
    for n in names:
        finite = finite & F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    edge, flat, color, texture, alpha = (unit(F.col(n)) for n in names)
    edge = F.greatest(edge, alpha)
    rules = [
        ("LineArt", "VectorReconstruction", (color <= 0.10) & (flat >= 0.68) & (edge >= 0.14), 0.55 + 0.25 * flat + 0.20 * edge),
        ("Logo", "VectorReconstruction", (color <= 0.20) & (flat >= 0.58) & (edge >= 0.04) & (texture <= 0.18), 0.50 + 0.30 * flat + 0.20 * (1 - color)),
        ("Mixed", "Hybrid", (color >= 0.18) & (edge >= 0.08) & (flat >= 0.30), 0.46 + 0.18 * edge + 0.18 * color + 0.18 * flat),
        ("Photo", "PhotoRestoration", (color >= 0.30) & (texture >= 0.08) & (flat <= 0.52), 0.48 + 0.26 * color + 0.26 * texture),
        ("Uncertain", "ConservativeRaster", F.lit(True), F.lit(0.35)),
    ]
    pick = F.coalesce(*[F.when(c, F.struct(F.lit(k).alias("kind"), F.lit(r).alias("route"), unit(v).alias("confidence"))) for k, r, c, v in rules])
    return df.withColumn("_c", F.when(finite, pick)).select("*", "_c.kind", "_c.route", "_c.confidence").drop("_c")


def super_resolve(df: DataFrame, plane: str, out: str, scale: int = 2, alpha: str | None = None) -> DataFrame:
    """Half-pixel bilinear enlargement, kept within its four sources and under the interpolated alpha; `out` is scale times as wide and high."""
    if scale not in (2, 4):
        raise ValueError("scale is 2 or 4")
    return planes.with_planes(df, [plane, *([alpha] if alpha else [])], [out], lambda x, a=None: {out: planes.enlarged(x, scale, a)})
