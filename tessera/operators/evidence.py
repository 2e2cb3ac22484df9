"""Evidence of final outputs: topology, boundaries, colour and alpha errors, rasters of serialised SVG bytes, gates."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.vector import even_odd, iou

# Production gates, quality gates, subdivisions of serialised cubics.
MIN_COMPONENT_IOU, MAX_RESIDUAL, MAX_BOUNDARY = 0.95, 0.01, 0.75
MAX_ALPHA_MAE, MIN_VECTOR_IOU = 0.02, 0.99
STEPS = 32
MAX_PIXELS = 1_000_000


# One image ------------------------------------------------------------------------------------------------------------


def regions(mask: np.ndarray) -> np.ndarray:
    """Numbers of 4-connected regions of equal value: runs of rows, joined with the runs above that they touch."""
    h, w = mask.shape
    starts = np.ones((h, w), bool)
    starts[:, 1:] = mask[:, 1:] != mask[:, :-1]
    run = (np.cumsum(starts.ravel()) - 1).reshape(h, w)
    same = mask[1:] == mask[:-1]
    pairs = np.unique(run[:-1][same] * (run.size + 1) + run[1:][same])
    parent = list(range(int(run[-1, -1]) + 1))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in zip((pairs // (run.size + 1)).tolist(), (pairs % (run.size + 1)).tolist(), strict=True):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(len(parent))], np.int64)[run]


def topology(mask: np.ndarray) -> tuple[int, int]:
    """(foreground components, holes): holes are background regions that don't touch the border."""
    if not mask.size:
        return 0, 0
    label = regions(mask)
    border = np.concatenate([label[0], label[-1], label[:, 0], label[:, -1]])
    return len(np.unique(label[mask])), len(np.setdiff1d(label[~mask], border))


def boundary(mask: np.ndarray) -> np.ndarray:
    """Points x, y on the image's border or next to a pixel of the other value, in row-major order."""
    edge = np.zeros(mask.shape, bool)
    edge[[0, -1], :] = True
    edge[:, [0, -1]] = True
    across, down = mask[:, 1:] != mask[:, :-1], mask[1:] != mask[:-1]
    edge[:, 1:] |= across
    edge[:, :-1] |= across
    edge[1:] |= down
    edge[:-1] |= down
    y, x = np.nonzero(edge)
    return np.stack([x, y], axis=1)


def _squared_distances(mask: np.ndarray) -> np.ndarray:
    """Squared distance of every pixel to the nearest set pixel: down the columns, then the lower envelope along rows."""
    h, w = mask.shape
    far = float(h + w) ** 2
    column = np.full((h, w), far)
    run = np.full(w, np.inf)
    for y in range(h):
        run = np.where(mask[y], 0, run + 1)
        column[y] = np.minimum(column[y], run**2)
    run = np.full(w, np.inf)
    for y in range(h - 1, -1, -1):
        run = np.where(mask[y], 0, run + 1)
        column[y] = np.minimum(column[y], run**2)
    out = column.copy()
    for step in range(1, w):  # until no shift can be nearer
        if step * step >= out.max():
            break
        out[:, step:] = np.minimum(out[:, step:], column[:, :-step] + step * step)
        out[:, :-step] = np.minimum(out[:, :-step], column[:, step:] + step * step)
    return out


def boundary_p95(a: np.ndarray, b: np.ndarray) -> float:
    """The larger of both directed distances at index (n - 1) * 95 // 100 of the sorted ones."""

    def directed(points: np.ndarray, to: np.ndarray) -> float:
        if not len(points) or not len(to):
            return math.inf
        target = np.zeros(a.shape, bool)
        target[to[:, 1], to[:, 0]] = True
        d = np.sort(np.sqrt(_squared_distances(target)[points[:, 1], points[:, 0]]))
        return float(d[(len(d) - 1) * 95 // 100])

    p, q = boundary(a), boundary(b)
    if len(p) and np.array_equal(p, q):
        return 0.0
    return max(directed(p, q), directed(q, p))


_ATTRIBUTE = r'{}="([^"]*)"'
_NUMBER = re.compile(r"[ \t\r\n]*([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+))")
_COUNTS = {"M": 2, "L": 2, "C": 6, "Z": 0}


def _attribute(element: str, name: str) -> str | None:
    found = re.search(_ATTRIBUTE.format(re.escape(name)), element)
    return found[1] if found else None


def parse_path(data: str) -> list[np.ndarray] | None:
    """Closed subpaths as points; only M, L, C and Z, numbers without exponents; cubics in STEPS parts."""
    at, out, points = 0, [], None
    while True:
        at = len(data) - len(data[at:].lstrip(" \t\r\n"))
        if at >= len(data):
            break
        name = data[at]
        at += 1
        if name not in _COUNTS:
            return None
        v = []
        for _ in range(_COUNTS[name]):
            found = _NUMBER.match(data, at)
            if not found:
                return None
            v.append(float(found[1]))
            at = found.end()
        if name == "M":
            points = [(v[0], v[1])]
            out.append(points)
        elif points is None:
            return None
        elif name == "L":
            points.append((v[0], v[1]))
        elif name == "C":
            (x, y), t = points[-1], np.arange(1, STEPS + 1) / STEPS
            u = 1.0 - t
            a, b, c, d = u * u * u, 3.0 * (u * u) * t, 3.0 * u * (t * t), t * t * t
            xs, ys = (a * s + b * p + c * q + d * e for s, p, q, e in ((x, v[0], v[2], v[4]), (y, v[1], v[3], v[5])))
            points += zip(xs.tolist(), ys.tolist(), strict=True)
            points[-1] = (v[4], v[5])
        else:
            if len(points) < 3:
                return None
            points = None
    return [np.array(p) for p in out] if out and points is None else None


def rasterize_svg(data: bytes, most: int = MAX_PIXELS) -> np.ndarray | None:
    """RGBA image (height, width, 4) of the serialised subset, later paths over earlier ones; None if it isn't that."""
    text = data.decode("latin-1")
    end = text.find(">")
    if not text.startswith("<svg ") or end < 0 or not text.endswith("</svg>\n"):
        return None
    size = [_attribute(text[: end + 1], n) for n in ("width", "height")]
    if not all(s and re.fullmatch("[0-9]+", s) and 0 < int(s) < 1 << 32 for s in size):
        return None
    width, height = map(int, size)
    if width * height > most:
        return None
    image, at, paths = np.zeros((height, width, 4), np.uint8), end + 1, 0
    while (start := text.find("<path ", at)) >= 0:
        stop = text.find("/>\n", start)
        if stop < 0:
            return None
        element = text[start : stop + 3]
        d, fill, rule = (_attribute(element, n) for n in ("d", "fill", "fill-rule"))
        if d is None or rule != "evenodd" or not fill or not re.fullmatch("#[0-9a-f]{6}", fill):
            return None
        polygons = parse_path(d)
        if polygons is None:
            return None
        image[even_odd(polygons, width, height)] = [*bytes.fromhex(fill[1:]), 255]
        paths, at = paths + 1, stop + 3
    return image if paths else None


def quality(reference_alpha: np.ndarray, alpha: np.ndarray, reference_mask: np.ndarray, mask: np.ndarray, most: int = MAX_PIXELS) -> dict:
    """error, alpha_mae and vector_iou of planes of equal size; masks hold 0 and 1."""
    out = {"error": "None", "alpha_mae": 1.0, "vector_iou": 0.0}
    n = reference_alpha.size
    if not n or any(x.size != n for x in (alpha, reference_mask, mask)):
        return out | {"error": "InvalidQualityFixture"}
    if n > most:
        return out | {"error": "SampleBudgetExceeded"}
    if reference_mask.max() > 1 or mask.max() > 1:
        return out | {"error": "InvalidQualityFixture"}
    mae = int(np.abs(reference_alpha.astype(np.int64) - alpha.astype(np.int64)).sum()) / (255.0 * n)
    out |= {"alpha_mae": mae, "vector_iou": iou(reference_mask.astype(bool), mask.astype(bool))}
    return out | {"error": "ThresholdViolation" if mae > MAX_ALPHA_MAE or out["vector_iou"] < MIN_VECTOR_IOU else "None"}


def svg_evidence(data: bytes, rgba: np.ndarray, alpha: np.ndarray, mask: np.ndarray, most: int = MAX_PIXELS) -> dict:
    """Everything that is measured on the final bytes against the source; `valid` only if all of it could be."""
    out = {"valid": False, "output_sha256": "", "color_mae": 1.0, "component_iou": 0.0, "boundary_p95_pixels": math.inf, "visible_residual_ratio": 1.0}
    image = rasterize_svg(data, most)
    if image is None or image.shape[:2] != mask.shape or rgba.shape != image.shape:
        return out
    drawn, seen = image[..., 3] >= 128, alpha >= 128
    both, either = drawn & seen, drawn | seen
    delta = np.abs(image[..., :3].astype(np.int64) - rgba[..., :3].astype(np.int64))
    residual = (drawn != seen) | (both & (delta > 0).any(axis=2))
    measured = quality(alpha, image[..., 3], mask, drawn.astype(np.uint8), most)
    if measured["error"] != "None":
        return out | {"quality": measured}
    c1, h1 = topology(mask.astype(bool))
    c2, h2 = (c1, h1) if np.array_equal(mask.astype(bool), drawn) else topology(drawn)
    p95 = boundary_p95(mask.astype(bool), drawn)
    return out | {
        "valid": math.isfinite(p95),
        "quality": measured,
        "output_sha256": hashlib.sha256(data).hexdigest(),
        "color_mae": int(delta[both].sum()) / (255.0 * 3 * int(both.sum())) if both.any() else 0.0,
        "visible_residual_ratio": int((residual & either).sum()) / int(either.sum()) if either.any() else 0.0,
        "reference_components": c1,
        "candidate_components": c2,
        "reference_holes": h1,
        "candidate_holes": h2,
        "component_iou": iou(mask.astype(bool), drawn) if c1 == c2 else 0.0,
        "boundary_p95_pixels": p95,
    }


def passes_gates(evidence: dict) -> bool:
    return bool(
        evidence["valid"] and evidence["component_iou"] >= MIN_COMPONENT_IOU and evidence["visible_residual_ratio"] <= MAX_RESIDUAL and evidence["boundary_p95_pixels"] <= MAX_BOUNDARY
    )


def gates(component_iou: Column, residual: Column, boundary_p95: Column) -> Column:
    """passes_gates() for columns of valid measurements."""
    return (component_iou >= MIN_COMPONENT_IOU) & (residual <= MAX_RESIDUAL) & (boundary_p95 <= MAX_BOUNDARY)


# Tables of images -----------------------------------------------------------------------------------------------------


def pixel_errors(df: DataFrame, threshold: int = 128) -> DataFrame:
    """Adds color_mae, visible_residual_ratio and alpha_mae of planes r, g, b, a against r2, g2, b2, a2."""
    px = "transform(sequence(0, size(a) - 1), i -> struct(get(a, i) >= {t} AS s, get(a2, i) >= {t} AS d, abs(get(r, i) - get(r2, i)) AS x, abs(get(g, i) - get(g2, i)) AS y, abs(get(b, i) - get(b2, i)) AS z, abs(get(a, i) - get(a2, i)) AS w))"
    df = df.withColumn("_p", F.expr(px.format(t=threshold)))
    total = lambda value, keep: F.expr(f"aggregate(filter(_p, p -> {keep}), 0L, (s, p) -> s + {value})")
    df = df.withColumns(
        {
            "_color": total("p.x + p.y + p.z", "p.s AND p.d"),
            "_both": total("1", "p.s AND p.d"),
            "_either": total("1", "p.s OR p.d"),
            "_residual": total("1", "(p.s OR p.d) AND (p.s <> p.d OR p.x + p.y + p.z <> 0)"),
            "_alpha": total("p.w", "true"),
        }
    )
    return df.withColumns(
        {
            "color_mae": F.when(F.col("_both") == 0, 0.0).otherwise(F.col("_color") / (F.col("_both") * 3 * 255.0)),
            "visible_residual_ratio": F.when(F.col("_either") == 0, 0.0).otherwise(F.col("_residual") / F.col("_either")),
            "alpha_mae": F.col("_alpha") / (F.size("a") * 255.0),
        }
    ).drop("_p", "_color", "_both", "_either", "_residual", "_alpha")
