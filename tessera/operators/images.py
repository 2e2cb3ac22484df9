"""Image operators that are sequential by nature, run over tables of images: one image a call, no rows move.

Rows carry width, height and planes as arrays; results are columns of the row. Each call holds one image at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.operators import evidence, resample, vector
from tessera.operators.planes import lists
from tessera.sinks import encoders

#: Bytes of inputs and results that a task remembers, to compute rows with equal inputs once.
REMEMBERED = 32 << 20

PATHS = T.ArrayType(T.StructType([T.StructField("points", T.ArrayType(T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())]))), T.StructField("hole", T.BooleanType())]))


def over_images(df: DataFrame, inputs: list[str], fields: list[T.StructField], call: Callable[..., dict], keep: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Rows (keep columns, fields): call(*inputs of a row) gives the fields of the row as a dict; arrays come as numpy ones.

    The fields follow from the inputs alone, so a task calls once for rows whose inputs are equal, as far as it remembers them.
    """
    source = df.select(*keep, *[c for c in inputs if c not in keep])
    names = source.columns
    schema = T.StructType([*[source.schema[k] for k in keep], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        one = remembered(call)
        for batch in batches:
            columns = [_values(batch.column(names.index(c))) for c in inputs]
            rows = [one(*row) for row in zip(*columns, strict=True)]
            kept = [batch.column(names.index(k)) for k in keep]
            values = [pa.array([r.get(f.name) for r in rows], out.field(f.name).type) for f in fields]
            yield pa.RecordBatch.from_arrays([*kept, *values], schema=out)

    return source.mapInArrow(run, schema)


def remembered(call: Callable[..., dict], most: int = REMEMBERED) -> Callable[..., dict]:
    """call() with its results kept by all inputs, about `most` bytes of both; rows with arrays aren't kept."""
    known: dict[tuple, dict] = {}
    held = 0

    def one(*row: object) -> dict:
        nonlocal held
        if any(isinstance(v, np.ndarray | list) for v in row):
            return call(*row)
        found = known.get(row)
        if found is None:
            found = call(*row)
            size = 1000 + sum(len(v) for v in (*row, *found.values()) if isinstance(v, bytes | str))
            if held + size > most:
                known.clear()
                held = 0
            if size <= most:
                known[row] = found
                held += size
        return found

    return one


def _values(column: pa.Array) -> list:
    """Python values of a column; rows of arrays of numbers as slices of the column's buffer (null: None)."""
    if not pa.types.is_list(column.type) or pa.types.is_nested(column.type.value_type):
        return column.to_pylist()
    values, offsets = lists(column)
    rows = [values[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return [r if ok else None for r, ok in zip(rows, column.is_valid().to_pylist(), strict=True)] if column.null_count else rows


def _plane(values: np.ndarray, width: int, height: int, kind: type = np.int64) -> np.ndarray:
    return values.astype(kind).reshape(height, width)


def contours(df: DataFrame, mask: str = "mask", threshold: int = 128, max_nodes: int = vector.MAX_NODES) -> DataFrame:
    """(image_id, error, paths): traced contours."""

    def call(w: int, h: int, values: np.ndarray) -> dict:
        if len(values) != w * h:
            return {"error": "SizeMismatch"}
        error, paths = vector.trace(_plane(values, w, h), threshold, max_nodes)
        return {"error": error, "paths": [{"points": [{"x": x, "y": y} for x, y in p], "hole": hole} for p, hole in paths]}

    return over_images(df, ["width", "height", mask], [T.StructField("error", T.StringType()), T.StructField("paths", PATHS)], call)


_CURVES = [T.StructField("error", T.StringType()), T.StructField("used_curves", T.BooleanType()), T.StructField("source_nodes", T.IntegerType()), T.StructField("recovered_nodes", T.IntegerType())]
_CURVES += [T.StructField("raster_iou", T.DoubleType()), T.StructField("disagreement", T.DoubleType()), T.StructField("data", T.ArrayType(T.StringType()))]


def curves(df: DataFrame, mask: str = "mask", tolerance: float = vector.TOLERANCE, radius: float = vector.RADIUS) -> DataFrame:
    """(image_id, error, used_curves, ..., data): certified curves of a mask's contours, as path data."""

    def call(w: int, h: int, values: np.ndarray) -> dict:
        plane = _plane(values, w, h)
        error, paths = vector.trace(plane)
        if error != "None":
            return {"error": error}
        found = vector.recover(paths, plane >= 128, tolerance, radius)
        report = found["certification"] or {}
        return found | {"raster_iou": report.get("raster_iou"), "disagreement": report.get("disagreement_ratio"), "data": [encoders.path_data(p) for p in found["paths"]]}

    return over_images(df, ["width", "height", mask], _CURVES, call)


def simplified(df: DataFrame, mask: str = "mask") -> DataFrame:
    """(image_id, error, total_nodes, removed, raster_iou): contours thinned as far as the gate allows."""

    def call(w: int, h: int, values: np.ndarray) -> dict:
        plane = _plane(values, w, h)
        error, paths = vector.trace(plane)
        if error != "None":
            return {"error": error}
        report, _, removed = vector.simplify_gated(paths, plane >= 128)
        return report | {"removed": removed}

    fields = [T.StructField("error", T.StringType()), T.StructField("total_nodes", T.IntegerType()), T.StructField("removed", T.IntegerType()), T.StructField("raster_iou", T.DoubleType())]
    return over_images(df, ["width", "height", mask], fields, call)


def topology(df: DataFrame, mask: str = "mask", threshold: int = 128) -> DataFrame:
    """(image_id, components, holes)."""

    def call(w: int, h: int, values: np.ndarray) -> dict:
        return dict(zip(("components", "holes"), evidence.topology(_plane(values, w, h) >= threshold), strict=True))

    return over_images(df, ["width", "height", mask], [T.StructField("components", T.IntegerType()), T.StructField("holes", T.IntegerType())], call)


def boundary_distance(df: DataFrame, a: str, b: str, threshold: int = 128) -> DataFrame:
    """(image_id, n_points, n_other, p95): boundary points of two masks of a row, and the larger of both directed distances."""

    def call(w: int, h: int, one: np.ndarray, two: np.ndarray) -> dict:
        p, q = _plane(one, w, h) >= threshold, _plane(two, w, h) >= threshold
        return {"n_points": len(evidence.boundary(p)), "n_other": len(evidence.boundary(q)), "p95": evidence.boundary_p95(p, q)}

    return over_images(df, ["width", "height", a, b], [T.StructField("n_points", T.IntegerType()), T.StructField("n_other", T.IntegerType()), T.StructField("p95", T.DoubleType())], call)


def resized(df: DataFrame, planes: list[str], width: int, height: int, name: str = "lanczos3", clamp: bool = True) -> DataFrame:
    """(image_id, error, width, height, pixels array<float>): images of any size resampled, channels interleaved."""

    def call(w: int, h: int, *values: np.ndarray) -> dict:
        if any(len(v) != w * h for v in values):
            return {"error": "SourceSizeMismatch"}
        error, image = resample.resize(np.stack([_plane(v, w, h, np.float32) for v in values], axis=-1), width, height, name, clamp)
        return {"error": error, "out_width": width, "out_height": height, "pixels": None if image is None else image.ravel().tolist()}

    fields = [T.StructField("error", T.StringType()), T.StructField("out_width", T.IntegerType()), T.StructField("out_height", T.IntegerType()), T.StructField("pixels", T.ArrayType(T.FloatType()))]
    return over_images(df, ["width", "height", *planes], fields, call)


# The certified conversion ---------------------------------------------------------------------------------------------


def linear(srgb: np.ndarray) -> np.ndarray:
    e = srgb.astype(np.float64) / 255.0
    return np.where(e <= 0.04045, e / 12.92, ((e + 0.055) / 1.055) ** 2.4)


def _u8(v: np.ndarray) -> np.ndarray:
    return (np.clip(v, 0.0, 1.0) * 255.0 + 0.5).astype(np.uint8)


def surface(image: np.ndarray, transparent: bool) -> tuple[np.ndarray, np.ndarray]:
    """(straight sRGB bytes, coverage) of a premultiplied linear float image."""
    v = np.clip(image.astype(np.float64), 0.0, 1.0)
    a = v[..., 3:]
    straight = np.divide(v[..., :3], a, out=np.zeros_like(v[..., :3]), where=a > 0)
    curve = np.where(straight <= 0.0031308, straight * 12.92, 1.055 * np.maximum(straight, 0) ** (1 / 2.4) - 0.055)
    rgb, alpha = _u8(curve), _u8(a[..., 0])
    return np.concatenate([rgb, alpha[..., None]], axis=-1), alpha if transparent else dark(rgb)


def dark(rgb: np.ndarray) -> np.ndarray:
    weight = rgb[..., 0].astype(np.int64) * 54 + rgb[..., 1].astype(np.int64) * 183 + rgb[..., 2].astype(np.int64) * 19
    return np.where(weight < 128 * 256, 255, 0).astype(np.uint8)


def features(image: np.ndarray) -> dict[str, float] | None:
    """The five content features of a float image, as neighbourhood.features() has them."""
    if image.shape[2] not in (3, 4) or not np.isfinite(image).all() or image.min() < 0 or image.max() > 1:
        return None
    lum = image[..., 0].astype(np.float64) * 0.2126 + image[..., 1].astype(np.float64) * 0.7152 + image[..., 2].astype(np.float64) * 0.0722
    d = np.concatenate([np.abs(np.diff(lum, axis=1)).ravel(), np.abs(np.diff(lum, axis=0)).ravel()])
    n = max(1, len(d))
    cell = np.minimum(7, (image[..., :3] * np.float32(8)).astype(np.int64)) @ np.array([64, 8, 1])
    alpha = 0
    if image.shape[2] == 4:
        alpha = sum(int((np.abs(np.diff(image[..., 3], axis=k).astype(np.float64)) >= 0.10).sum()) for k in (0, 1))
    return {
        "edge_density": int((d >= 0.12).sum()) / n,
        "flat_region_ratio": int((d <= 0.025).sum()) / n,
        "color_complexity": len(np.unique(cell)) / min(512, lum.size),
        "texture_energy": min(1.0, 2 * float(np.sqrt((d[d < 0.12] ** 2).sum() / n))),
        "alpha_transition_ratio": alpha / n,
    }


def is_vector(f: dict[str, float]) -> bool:
    """The two rules that route an image to vector reconstruction."""
    edge = max(f["edge_density"], f["alpha_transition_ratio"])
    line = f["color_complexity"] <= 0.10 and f["flat_region_ratio"] >= 0.68 and edge >= 0.14
    return line or (f["color_complexity"] <= 0.20 and f["flat_region_ratio"] >= 0.58 and edge >= 0.04 and f["texture_energy"] <= 0.18)


def convert(rgba: np.ndarray, form: str, input_sha: str, name: str = "conversion", revision: str = "1", schema: str = "1") -> dict:
    """One image through the whole certified conversion: error, bytes, certificate and what was measured."""
    h, w = rgba.shape[:2]
    alpha = rgba[..., 3]
    transparent = bool((alpha != 255).any())
    unit = alpha.astype(np.float64)[..., None] / 255.0
    image = np.concatenate([np.where(unit > 0, linear(rgba[..., :3]) * unit, 0.0), unit], axis=-1).astype(np.float32)
    found = features(image)
    if found is None:
        return {"error": "InvalidAnalysis"}
    if not is_vector(found):
        return {"error": "RouteRejected"} | found
    error, large = resample.resize(image, 2 * w, 2 * h)
    if error != "None":
        return {"error": error}
    upscale_sha = hashlib.sha256(_u8(large.astype(np.float64)).tobytes()).hexdigest()
    mask = alpha if transparent else dark(rgba[..., :3])
    error, small = resample.resize(large, w, h)
    _, coverage = surface(small, transparent)
    error, paths = vector.trace(coverage)
    if error != "None":
        return {"error": error}
    curve = vector.recover(paths, coverage >= 128)
    if curve["error"] != "None":
        return {"error": curve["error"]}
    layers = vector.paint_layers(rgba[..., :3], mask, curve["paths"])
    if layers is None:
        return {"error": "PaintRejected"}
    fidelity = vector.certify_curves(curve["paths"], mask >= 128)
    if fidelity["error"] != "None":
        return {"error": fidelity["error"]}
    error, data = encoders.encode(form, w, h, curve["paths"], layers)
    if error != "None" or len(data) > max(4096, 4 * w * h):
        return {"error": error if error != "None" else "OutputBudgetExceeded"}
    chain = hashlib.sha256((input_sha + upscale_sha).encode()).hexdigest()
    output_sha, seam, units = hashlib.sha256(data).hexdigest(), fidelity["disagreement_ratio"], 1 + len(data) // 1024
    binary = (mask >= 128).astype(np.uint8)
    if form == "svg":
        seen = evidence.svg_evidence(data, rgba, mask, binary)
        if not evidence.passes_gates(seen):
            return {"error": "EvidenceRejected"}
        measured = seen["quality"]
    else:
        error, traced = vector.trace(mask)
        drawn = vector.even_odd(vector.polygons_of(traced), w, h).astype(np.uint8)
        measured = evidence.quality(mask, drawn * np.uint8(255), binary, drawn)
        if measured["error"] != "None":
            return {"error": measured["error"]}
        seen = {}
    size = float(len(data))
    metrics = [("alpha_mae", measured["alpha_mae"], 0.0, evidence.MAX_ALPHA_MAE), ("vector_iou", measured["vector_iou"], evidence.MIN_VECTOR_IOU, 1.0)]
    metrics += [("export_bytes", size, 1.0, float(max(4096, 4 * w * h))), ("peak_intermediate_bytes", size, 1.0, float(256 << 20))]
    metrics += [("seam_error", seam, 0.0, 0.01), ("work_units", float(units), 1.0, 1e6)]
    if form == "svg":
        apart = lambda kind: float(abs(seen[f"reference_{kind}"] - seen[f"candidate_{kind}"]))
        metrics += [("boundary_p95_pixels", seen["boundary_p95_pixels"], 0.0, float(max(w, h))), ("color_mae", seen["color_mae"], 0.0, 1.0)]
        metrics += [("component_count_delta", apart("components"), 0.0, float(w * h)), ("hole_count_delta", apart("holes"), 0.0, float(w * h))]
        metrics += [("visible_residual_ratio", seen["visible_residual_ratio"], 0.0, 1.0)]
    if 2 * w * h > 1_000_000:
        return {"error": "SampleBudgetExceeded"}
    if any(not low <= v <= high for _, v, low, high in metrics):
        return {"error": "ThresholdViolation"}
    text = encoders.certificate(schema, name, chain, output_sha, revision, 2 * w * h, units, sorted(metrics))
    return {
        "error": "None", "bytes": data, "output_sha256": output_sha, "certificate": text, "certificate_sha256": hashlib.sha256(text).hexdigest(),
        "used_curves": curve["used_curves"], "layers": len(layers), "vector_iou": measured["vector_iou"], "raster_iou": fidelity["raster_iou"],
    }


_CONVERTED = [T.StructField("error", T.StringType()), T.StructField("bytes", T.BinaryType()), T.StructField("output_sha256", T.StringType()), T.StructField("certificate", T.BinaryType())]
_CONVERTED += [T.StructField("certificate_sha256", T.StringType()), T.StructField("used_curves", T.BooleanType()), T.StructField("layers", T.IntegerType())]
_CONVERTED += [T.StructField("vector_iou", T.DoubleType()), T.StructField("raster_iou", T.DoubleType())]


def certified_convert(images: DataFrame, form: str, keep: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Rows (width, height, rgba binary) to exports with their certificates; refused images stay as rows with an error."""

    def call(w: int | None, h: int | None, data: bytes | None) -> dict:
        if not data or not w or not h:
            return {"error": "InvalidInput"}
        return convert(np.frombuffer(data, np.uint8).reshape(h, w, 4), form, hashlib.sha256(data).hexdigest())

    return over_images(images, ["width", "height", "rgba"], _CONVERTED, call, keep)


_EVIDENCE = [T.StructField("valid", T.BooleanType()), *(T.StructField(n, T.DoubleType()) for n in ("color_mae", "visible_residual_ratio", "component_iou", "boundary_p95_pixels"))]
_EVIDENCE += [*(T.StructField(f"{of}_{n}", T.IntegerType()) for n in ("components", "holes") for of in ("reference", "candidate")), T.StructField("passes", T.BooleanType())]


def final_evidence(images: DataFrame, svg: str = "bytes", keep: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """What is measured on final SVG bytes against their source, for rows (width, height, rgba, svg), and whether it passes the gates."""

    def call(w: int | None, h: int | None, data: bytes | None, text: bytes | None) -> dict:
        if not data or not w or not h or text is None:
            return {"valid": False, "passes": False}
        rgba = np.frombuffer(data, np.uint8).reshape(h, w, 4)
        mask = rgba[..., 3] if (rgba[..., 3] != 255).any() else dark(rgba[..., :3])
        seen = evidence.svg_evidence(text, rgba, mask, (mask >= 128).astype(np.uint8))
        return seen | {"passes": evidence.passes_gates(seen)}

    return over_images(images, ["width", "height", "rgba", svg], _EVIDENCE, call, keep)


def rasterized(images: DataFrame, svg: str = "bytes", keep: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keep columns, width, height, pixels binary) of serialised SVG bytes; null where they aren't of the exported subset."""

    def call(text: bytes | None) -> dict:
        image = None if text is None else evidence.rasterize_svg(text)
        return {} if image is None else {"width": image.shape[1], "height": image.shape[0], "pixels": image.tobytes()}

    return over_images(images, [svg], [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("pixels", T.BinaryType())], call, keep)
