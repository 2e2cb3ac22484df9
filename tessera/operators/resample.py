"""Resampling: tap tables as relational rows, and resizing of whole images.

resize() takes one image in numpy; resize_plane() does the same for tables of images, all of one size at a time.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import planes

SUPPORT = {"bilinear": 1.0, "bicubic": 2.0, "lanczos3": 3.0}
_TINY = 1e-15


def kernel(name: str, x: float) -> float:
    x = abs(x)
    if x >= SUPPORT[name]:
        return 0.0
    if name == "bilinear":
        return 1.0 - x
    if name == "bicubic":  # a = -0.5
        return 1.5 * x * x * x - 2.5 * x * x + 1.0 if x < 1 else -0.5 * x * x * x + 2.5 * x * x - 4.0 * x + 2.0
    sinc = lambda v: 1.0 if abs(v) < 1e-12 else math.sin(math.pi * v) / (math.pi * v)
    return sinc(x) * sinc(x / 3.0)


def taps(source: int, target: int, name: str = "lanczos3") -> list[list[tuple[int, float]]]:
    """For each target place the source places and weights, in order; places beyond the edge are put on it, again and again."""
    scale = target / source
    narrow = min(1.0, scale)
    reach = SUPPORT[name] / narrow
    table = []
    for place in range(target):
        centre = (place + 0.5) / scale - 0.5
        row = []
        for at in range(math.ceil(centre - reach), math.floor(centre + reach) + 1):
            weight = kernel(name, (centre - at) * narrow) * narrow
            if abs(weight) > _TINY:
                row.append((min(max(at, 0), source - 1), weight))
        total = sum(w for _, w in row)
        if not row or abs(total) <= _TINY:
            nearest = math.floor(abs(centre) + 0.5) * (1 if centre >= 0 else -1)
            row, total = [(min(max(nearest, 0), source - 1), 1.0)], 1.0
        table.append([(at, w / total) for at, w in row])
    return table


@lru_cache(maxsize=256)
def _table(source: int, target: int, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The tap table as source places and weights, one row a target place; shorter rows repeat their first place with weight 0."""
    rows = taps(source, target, name)
    most = max(map(len, rows))
    at = np.array([[p for p, _ in row] + [row[0][0]] * (most - len(row)) for row in rows])
    return at, np.array([[w for _, w in row] + [0.0] * (most - len(row)) for row in rows])


def _fold(image: np.ndarray, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted sums along the first axis, tap by tap in double precision."""
    total = np.zeros((len(at), *image.shape[1:]))
    wide = image.astype(np.float64)
    for k in range(at.shape[1]):
        total += wide[at[:, k]] * weight[:, k].reshape(-1, *[1] * (image.ndim - 1))
    return total.astype(np.float32)


def _extent(image: np.ndarray, at: np.ndarray, pick: np.ufunc) -> np.ndarray:
    found = image[at[:, 0]]
    for k in range(1, at.shape[1]):
        pick(found, image[at[:, k]], out=found)
    return found


def resize(image: np.ndarray, width: int, height: int, name: str = "lanczos3", clamp: bool = True) -> tuple[str, np.ndarray | None]:
    """(error, image): float32 images of height, width, channels; results kept within the range of their sources."""
    if image.ndim != 3 or not image.shape[0] or not image.shape[1]:
        return "ZeroSourceDimension", None
    if not width or not height:
        return "ZeroTargetDimension", None
    if not 1 <= image.shape[2] <= 4:
        return "InvalidChannelCount", None
    if not np.isfinite(image).all():
        return "NonFiniteSample", None
    return "None", _resized(image.astype(np.float32), width, height, name, clamp)


def _resized(image: np.ndarray, width: int, height: int, name: str, clamp: bool) -> np.ndarray:
    if (height, width) == image.shape[:2]:
        return image
    across, down = _table(image.shape[1], width, name), _table(image.shape[0], height, name)
    out = _fold(_fold(image.transpose(1, 0, 2), *across).transpose(1, 0, 2), *down)
    if clamp:
        low, high = (_extent(_extent(image.transpose(1, 0, 2), across[0], pick).transpose(1, 0, 2), down[0], pick) for pick in (np.minimum, np.maximum))
        out = np.clip(out, low, high)
    return out


def tap_rows(spark: SparkSession, sizes: DataFrame, name: str = "lanczos3") -> DataFrame:
    """(source, target, place, at, ord, weight) for rows (source, target): the tap tables as a relation."""
    support = SUPPORT[name]
    scaled = sizes.select("source", "target", (F.col("target") / F.col("source")).alias("scale")).withColumn("narrow", F.least(F.lit(1.0), F.col("scale")))
    placed = scaled.withColumn("place", F.explode(F.expr("sequence(0, target - 1)"))).withColumn("centre", (F.col("place") + 0.5) / F.col("scale") - 0.5)
    reach = F.lit(support) / F.col("narrow")
    spread = placed.withColumn("raw", F.explode(F.sequence(F.ceil(F.col("centre") - reach), F.floor(F.col("centre") + reach))))
    x = F.abs((F.col("centre") - F.col("raw")) * F.col("narrow"))
    weighted = spread.withColumn("w", kernel_column(name, x) * F.col("narrow")).where(F.abs("w") > _TINY)
    groups = weighted.groupBy("source", "target", "place").agg(F.sort_array(F.collect_list(F.struct("raw", "w"))).alias("row"))
    total = F.aggregate("row", F.lit(0.0), lambda s, t: s + t["w"])
    edge = F.transform("row", lambda t, i: F.struct(i.alias("ord"), F.greatest(F.lit(0), F.least(F.col("source") - 1, t["raw"].cast("int"))).alias("at"), (t["w"] / F.col("_total")).alias("weight")))
    return groups.withColumn("_total", total).select("source", "target", "place", F.explode(edge).alias("t")).select("source", "target", "place", "t.ord", "t.at", "t.weight")


def kernel_column(name: str, x: Column) -> Column:
    if name == "bilinear":
        return F.when(x < 1, 1 - x).otherwise(0.0)
    if name == "bicubic":
        return F.when(x < 1, 1.5 * x * x * x - 2.5 * x * x + 1).when(x < 2, -0.5 * x * x * x + 2.5 * x * x - 4 * x + 2).otherwise(0.0)
    sinc = lambda v: F.when(F.abs(v) < 1e-12, F.lit(1.0)).otherwise(F.sin(v * math.pi) / (v * math.pi))
    return F.when(x < 3, sinc(x) * sinc(x / 3)).otherwise(0.0)


def resize_plane(df: DataFrame, plane: str, out: str, target: tuple[int, int], name: str = "lanczos3", clamp: bool = True) -> DataFrame:
    """Planes of any size enlarged or reduced to `target` (width, height); the images of one size in a batch are computed together."""

    def kernel(x: np.ndarray) -> planes.Stacks:
        return {out: _resized(x.transpose(1, 2, 0), *target, name, clamp).transpose(2, 0, 1)}  # the images are channels

    return planes.with_planes(df, [plane], [out], kernel)
