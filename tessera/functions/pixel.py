"""Scalar pixel functions as Column expressions: colour transfer, alpha, rounding, keys and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sRGB transfer curve, Rec. 709 luminance and the integer luminance of masks.
SRGB_LOW, LINEAR_LOW, SLOPE, OFFSET, GAMMA = 0.04045, 0.0031308, 12.92, 0.055, 2.4
RED, GREEN, BLUE = 0.2126, 0.7152, 0.0722
MASK_RED, MASK_GREEN, MASK_BLUE, MASK_LIMIT = 54, 183, 19, 128 * 256
#: Coverage from which a pixel is foreground.
FOREGROUND = 128


def clamp_unit(v: Column) -> Column:
    """v within 0 and 1; NaN stays NaN, although Spark orders it last."""
    return F.when(F.isnan(v), v).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def srgb_to_linear(e: Column) -> Column:
    return F.when(e <= SRGB_LOW, e / SLOPE).otherwise(F.pow((e + OFFSET) / (1 + OFFSET), F.lit(GAMMA)))


def linear_to_srgb(v: Column) -> Column:
    return F.when(v <= LINEAR_LOW, v * SLOPE).otherwise((1 + OFFSET) * F.pow(v, F.lit(1 / GAMMA)) - OFFSET)


def premultiply(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Struct r, g, b, a; all zero where alpha is not positive."""
    on = a > 0
    return F.struct(*[F.when(on, c * a).otherwise(F.lit(0.0)).alias(n) for n, c in zip("rgb", (r, g, b), strict=True)], F.when(on, a).otherwise(F.lit(0.0)).alias("a"))


def unpremultiply(r: Column, g: Column, b: Column, a: Column) -> Column:
    on = a > 0
    return F.struct(*[F.when(on, c / a).otherwise(F.lit(0.0)).alias(n) for n, c in zip("rgb", (r, g, b), strict=True)], F.when(on, a).otherwise(F.lit(0.0)).alias("a"))


def unit_to_u8(v: Column) -> Column:
    """Rounded half up by truncation; null for NaN."""
    return F.when(~F.isnan(v), (clamp_unit(v) * 255 + 0.5)).cast("int")


def unpremultiply_u8(v: Column, a: Column) -> Column:
    """Integer un-premultiplication, rounded; zero where alpha is zero."""
    return F.when(a > 0, F.least(F.lit(255), F.expr("0") + F.floor((v * 255 + F.floor(a / 2)) / a))).otherwise(F.lit(0)).cast("int")


def luminance(r: Column, g: Column, b: Column) -> Column:
    return RED * r + GREEN * g + BLUE * b


def is_foreground(coverage: Column) -> Column:
    return coverage >= FOREGROUND


def dark_coverage(r: Column, g: Column, b: Column) -> Column:
    """Coverage of an opaque pixel: 255 if it is dark."""
    return F.when(MASK_RED * r + MASK_GREEN * g + MASK_BLUE * b < MASK_LIMIT, F.lit(255)).otherwise(F.lit(0))


def color_key(r: Column, g: Column, b: Column) -> Column:
    """Five bits a channel."""
    return F.shiftright(r, 3) * 1024 + F.shiftright(g, 3) * 32 + F.shiftright(b, 3)


def color_distance(a: list[Column], b: list[Column]) -> Column:
    d = [(x - y) * (x - y) for x, y in zip(a, b, strict=True)]
    return d[0] + d[1] + d[2]


def color_bin(r: Column, g: Column, b: Column) -> Column:
    """One of 512 bins, eight a channel."""
    one = lambda v: F.least(F.lit(7), (v * 8).cast("int"))
    return one(r) * 64 + one(g) * 8 + one(b)
