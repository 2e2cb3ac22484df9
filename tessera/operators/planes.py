"""Planes of images as stacks of numpy arrays: the images of one size in a batch are computed together.

A plane is an array in row-major order, in a column beside `width` and `height`. Kernels take and give stacks of shape
(images, height, width) and work on whole stacks, so a pixel costs a few vector operations and no interpreted
expression. No rows move; a task holds one Arrow batch and the stacks of CHUNK pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pixels that a kernel takes at a time, unless one image has more.
CHUNK = 1 << 20

Stacks = dict[str, np.ndarray]


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets): row k of a list column is values[offsets[k]:offsets[k + 1]]; null rows are empty."""
    if column.null_count:
        column = column.fill_null([])
    return column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()


def with_planes(df: DataFrame, inputs: list[str], outputs: list[str], kernel: Callable[..., Stacks], kind: type = np.float32) -> DataFrame:
    """df with float planes `outputs` added or replaced; kernel(one stack an input) gives them by name.

    Rows with a null plane or size, or a plane of another length, get null planes.
    """
    kept = [f for f in df.schema if f.name not in outputs]
    names = df.columns
    schema = T.StructType([*kept, *[T.StructField(o, T.ArrayType(T.FloatType())) for o in outputs]])

    def computed(batch: pa.RecordBatch) -> list[pa.Array]:
        n = batch.num_rows
        width, height = (batch.column(names.index(c)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("width", "height"))
        planes = [lists(batch.column(names.index(c))) for c in inputs]
        good = (width > 0) & (height > 0)
        for _, offsets in planes:
            good &= np.diff(offsets) == width * height
        done: dict[str, list[np.ndarray | None]] = {o: [None] * n for o in outputs}
        sizes, group = np.unique(np.stack([width, height], axis=1), axis=0, return_inverse=True)
        for k, (w, h) in enumerate(sizes.tolist()):
            rows = np.flatnonzero(good & (group.ravel() == k))
            step = max(1, CHUNK // max(1, w * h))
            for part in (rows[i : i + step] for i in range(0, len(rows), step)):
                place = np.arange(w * h)
                stacks = [values[offsets[part, None] + place].reshape(-1, h, w).astype(kind) for values, offsets in planes]
                for name, stack in kernel(*stacks).items():
                    for row, plane in zip(part.tolist(), stack.astype(np.float32).reshape(len(part), -1), strict=True):
                        done[name][row] = plane
        return [_listed(done[o]) for o in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(names.index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*own, *computed(batch)], schema.fieldNames())

    return df.mapInArrow(run, schema)


def _listed(rows: list[np.ndarray | None]) -> pa.Array:
    sizes = np.array([0 if r is None else len(r) for r in rows], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = np.concatenate([r for r in rows if r is not None]) if any(r is not None for r in rows) else np.zeros(0, np.float32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.float32()), mask=pa.array([r is None for r in rows], pa.bool_()))


# Kernels: float32 in, float32 out, sums in double precision ---------------------------------------------------------------


def local_extent(x: np.ndarray, pick: np.ufunc) -> np.ndarray:
    """Least or greatest value of the clipped 3 by 3 window: along the rows, then along the columns."""
    for axis in (2, 1):
        y = x.swapaxes(axis, 2)
        out = y.copy()
        pick(out[..., 1:], y[..., :-1], out=out[..., 1:])
        pick(out[..., :-1], y[..., 1:], out=out[..., :-1])
        x = out.swapaxes(axis, 2)
    return x


def _window_sum(x: np.ndarray) -> np.ndarray:
    _, h, w = x.shape
    framed = np.pad(x.astype(np.float64), ((0, 0), (1, 1), (1, 1)))
    total = np.zeros(x.shape)
    for dy in range(3):
        for dx in range(3):
            total += framed[:, dy : dy + h, dx : dx + w]
    return total


def local_mean(x: np.ndarray, alpha: np.ndarray | None = None) -> np.ndarray:
    """Mean of the clipped 3 by 3 window, summed row by row; with an alpha, of a premultiplied plane by it.

    A weighted mean is put back to the pixel's own alpha; it is zero where either alpha is.
    """
    if alpha is None:
        return (_window_sum(x) / _window_sum(np.ones((1, *x.shape[1:])))).astype(np.float32)
    weight = _window_sum(alpha)
    mean = np.divide(_window_sum(x), weight, out=np.zeros(x.shape), where=weight > 0) * alpha.astype(np.float64)
    return np.where((alpha <= 0) | (weight <= 0), np.float32(0), np.maximum(np.float32(0), np.minimum(alpha, mean.astype(np.float32))))


def _bounded(x: np.ndarray, alpha: np.ndarray | None) -> np.ndarray:
    return np.maximum(np.float32(0), np.minimum(np.float32(1) if alpha is None else alpha, x))


def denoised(x: np.ndarray, strength: float, alpha: np.ndarray | None = None) -> np.ndarray:
    return _bounded(x + np.float32(strength) * (local_mean(x, alpha) - x), alpha)


def deblocked(x: np.ndarray, strength: float, alpha: np.ndarray | None, block: int, jump: float) -> np.ndarray:
    """Both sides of block boundaries pulled together: columns first, then rows of the result."""
    pull, half = np.float32(strength) * np.float32(0.5), np.float32(0.5)
    for axis in (2, 1):
        if x.shape[axis] < 3:
            continue
        low, high = (local_extent(x, pick).swapaxes(axis, 2) for pick in (np.minimum, np.maximum))
        own, top = x.swapaxes(axis, 2), None if alpha is None else alpha.swapaxes(axis, 2)
        out = own.copy()
        edge = np.arange(block - 1, own.shape[2] - 1, block)  # the last place of each block that another follows
        left, right = own[..., edge], own[..., edge + 1]
        smooth = np.abs(right - left) <= np.float32(jump)
        for at in (edge, edge + 1):
            v = own[..., at]
            moved = np.maximum(low[..., at], np.minimum(high[..., at], v + pull * (half * (left + right) - v)))
            out[..., at] = np.where(smooth, _bounded(moved, None if top is None else top[..., at]), v)
        x = out.swapaxes(axis, 2)
    return x


def sharpened(source: np.ndarray, base: np.ndarray, strength: float, alpha: np.ndarray | None = None) -> np.ndarray:
    """base away from its local mean, within the local range of the source and the alpha."""
    sharp = base + np.float32(strength) * (base - local_mean(base, alpha))
    return _bounded(np.maximum(local_extent(source, np.minimum), np.minimum(local_extent(source, np.maximum), sharp)), alpha)


def enlarged(x: np.ndarray, scale: int, alpha: np.ndarray | None = None) -> np.ndarray:
    """Half-pixel bilinear enlargement, kept within its four sources and under the interpolated alpha."""
    _, h, w = x.shape
    one = np.float32(1)

    def spots(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(n * scale, dtype=np.float32) + np.float32(0.5)) / np.float32(scale) - np.float32(0.5)
        at = np.maximum(np.float32(0), np.minimum(np.float32(n - 1), at))
        first = np.floor(at).astype(np.int64)
        return first, np.minimum(n - 1, first + 1), at - np.floor(at)

    (x0, x1, tx), (y0, y1, ty) = spots(w), spots(h)
    ty = ty[:, None]

    def four(p: np.ndarray) -> list[np.ndarray]:
        return [p[:, rows][:, :, columns] for rows in (y0, y1) for columns in (x0, x1)]

    def blend(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        top, bottom = a + tx * (b - a), c + tx * (d - c)
        return top + ty * (bottom - top)

    corners = four(x)
    low, high = np.minimum.reduce(corners), np.maximum.reduce(corners)
    value = np.maximum(low, np.minimum(high, blend(*corners)))
    if alpha is not None:
        value = np.maximum(np.float32(0), np.minimum(np.maximum(np.float32(0), np.minimum(one, blend(*four(alpha)))), value))
    return np.maximum(np.float32(0), np.minimum(one, value))
