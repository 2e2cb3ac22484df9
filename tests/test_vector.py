import math
import random

import numpy as np
import pytest

from tessera.operators import evidence, images, resample, vector
from tessera.sinks import encoders


def mask(text: str) -> np.ndarray:
    return np.array([[255 if c == "#" else 0 for c in row] for row in text.split()], np.int64)


def drawn(paths, m):
    return vector.even_odd(vector.polygons_of(paths), m.shape[1], m.shape[0])


def test_rectangle():
    m = np.zeros((5, 6), np.int64)
    m[1:4, 2:5] = 255
    error, paths = vector.trace(m)
    assert error == "None" and paths == [([(2, 1), (5, 1), (5, 4), (2, 4)], False)]
    assert vector.iou(m >= 128, drawn(paths, m)) == 1.0


@pytest.mark.parametrize(
    ("text", "count"),
    [("####### #.....# #.###.# #.#.#.# #.###.# #.....# #######", 4), ("#. .#", 2), ("..... .###. .#.#. .###. .....", 2), ("##.## ##.## ..... ##.##", 4)],
)
def test_roundtrip_and_count(text, count):
    m = mask(text)
    error, paths = vector.trace(m)
    assert error == "None" and len(paths) == count
    assert (drawn(paths, m) == (m >= 128)).all()


def test_random_masks_come_back():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        m = (rnd.random((rnd.integers(1, 12), rnd.integers(1, 12))) < rnd.random()).astype(np.int64) * 255
        error, paths = vector.trace(m)
        assert error == ("None" if m.any() else "NoForeground")
        assert (drawn(paths, m) == (m >= 128)).all()


def test_errors_of_trace():
    assert vector.trace(np.zeros((0, 3)))[0] == "ZeroDimension"
    assert vector.trace(np.zeros((3, 3)))[0] == "NoForeground"
    checker = (np.indices((64, 64)).sum(axis=0) % 2 == 0) * 255
    assert vector.trace(checker, max_nodes=8)[0] == "NodeBudgetExceeded"


def test_soft_edges_follow_the_threshold():
    m = np.array([[127, 128], [255, 0]])
    _, paths = vector.trace(m)
    assert (drawn(paths, m) == (m >= 128)).all()


def circle(n=128, r=40):
    y, x = np.mgrid[:n, :n]
    return np.where((x - n / 2 + 0.5) ** 2 + (y - n / 2 + 0.5) ** 2 <= r * r, 255, 0)


def test_circle_gets_curves():
    m = circle()
    _, paths = vector.trace(m)
    found = vector.recover(paths, m >= 128)
    assert found["error"] == "None" and found["used_curves"] and found["recovered_nodes"] < found["source_nodes"]
    assert found["certification"]["raster_iou"] >= 0.995


def test_exact_polygon_and_radius_errors():
    _, paths = vector.trace(mask("#### #### ####"))
    assert vector.fit(paths, -1)[0] == "InvalidRadius" and vector.fit([])[0] == "InvalidScene"
    assert vector.fit([([(0, 0), (0, 0), (1, 1)], False)])[0] == "DegeneratePath"
    error, curves = vector.fit(paths)
    assert error == "None" and curves[0] == [("M", 0.0, 0.0), ("L", 4.0, 0.0), ("L", 4.0, 3.0), ("L", 0.0, 3.0), ("Z",)]
    assert encoders.path_data(curves[0]) == "M 0.000000 0.000000 L 4.000000 0.000000 L 4.000000 3.000000 L 0.000000 3.000000 Z"


def test_self_intersection():
    assert vector.self_intersects([(0, 0), (4, 4), (4, 0), (0, 4)])
    assert not vector.self_intersects([(0, 0), (4, 0), (4, 4), (0, 4)])
    assert vector.self_intersects([(0, 0), (0, 0), (1, 1)])
    assert vector.self_intersects([(0, 0), (2, 0), (2, 2), (1, 0), (0, 2)])  # touches an edge


def test_gated_simplification_keeps_fidelity():
    m = mask("######## ######## ######## #######. ######## ########")
    _, paths = vector.trace(np.kron(m, np.ones((6, 6), np.int64)))
    reference = np.kron(m, np.ones((6, 6), np.int64)) >= 128
    report, fewer, removed = vector.simplify_gated(paths, reference, min_iou=0.9, most=0.1)
    assert report["error"] == "None" and removed > 0
    assert sum(len(p) for p, _ in fewer) + removed == sum(len(p) for p, _ in paths)


def brute_p95(a, b):
    def directed(p, q):
        d = sorted(min(math.dist(s, t) for t in q) for s in p)
        return d[(len(d) - 1) * 95 // 100]

    p, q = evidence.boundary(a).tolist(), evidence.boundary(b).tolist()
    return max(directed(p, q), directed(q, p))


def test_boundary_distance_like_brute_force():
    rnd = np.random.default_rng(2)
    for _ in range(30):
        h, w = rnd.integers(1, 14, 2)
        a, b = rnd.random((h, w)) < 0.5, rnd.random((h, w)) < 0.5
        assert evidence.boundary_p95(a, b) == pytest.approx(brute_p95(a, b))


def brute_topology(m):
    def fill(value):
        seen, found = set(), []
        for start in zip(*np.nonzero(m == value), strict=True):
            if start in seen:
                continue
            todo, own = [start], {start}
            while todo:
                y, x = todo.pop()
                for p in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if 0 <= p[0] < m.shape[0] and 0 <= p[1] < m.shape[1] and m[p] == value and p not in own:
                        own.add(p)
                        todo.append(p)
            seen |= own
            found.append(own)
        return found

    inner = [r for r in fill(False) if not any(y in (0, m.shape[0] - 1) or x in (0, m.shape[1] - 1) for y, x in r)]
    return len(fill(True)), len(inner)


def test_topology_like_flood_fill():
    rnd = np.random.default_rng(3)
    for _ in range(100):
        m = rnd.random(rnd.integers(1, 11, 2)) < rnd.random()
        assert evidence.topology(m) == brute_topology(m)


def test_svg_bytes_come_back():
    _, paths = vector.trace(mask("...... .####. .#..#. .#..#. .####. ......"))
    data = encoders.svg(6, 6, [], [((10, 20, 30), vector.fit(paths)[1])]).encode()
    image = evidence.rasterize_svg(data)
    assert (image[..., 3] > 0).sum() == 12 and tuple(image[1, 1]) == (10, 20, 30, 255)
    for bad in (data[:-1], data.replace(b"evenodd", b"nonzero"), data.replace(b"#0a", b"#0A"), data.replace(b"M ", b"Q ", 1), b""):
        assert evidence.rasterize_svg(bad) is None


def test_quality_gates_at_the_boundary():
    reference, candidate = np.zeros(100, np.uint8), np.full(100, 5, np.uint8)
    candidate[:10] = 6
    ones, one_off = np.ones(100, np.uint8), np.ones(100, np.uint8)
    one_off[-1] = 0
    exact = evidence.quality(reference, candidate, ones, one_off)
    assert exact == {"error": "None", "alpha_mae": 0.02, "vector_iou": 0.99}
    candidate[10] = 6
    assert evidence.quality(reference, candidate, ones, one_off)["error"] == "ThresholdViolation"
    assert evidence.quality(reference, candidate, ones, ones * 2)["error"] == "InvalidQualityFixture"


def test_taps_and_resize():
    for name in resample.SUPPORT:
        for row in resample.taps(7, 12, name):
            assert sum(w for _, w in row) == pytest.approx(1)
    flat = np.full((5, 7, 3), 0.375, np.float32)
    error, out = resample.resize(flat, 13, 4)
    assert error == "None" and out.shape == (4, 13, 3) and np.abs(out - 0.375).max() < 1e-6
    ramp = np.linspace(0, 1, 8, dtype=np.float32).reshape(1, 8, 1)
    _, wide = resample.resize(ramp, 64, 1, "bilinear")
    centre = (np.arange(64) + 0.5) / 8 - 0.5
    assert np.abs(wide[0, 8:-8, 0] - centre[8:-8] / 7).max() < 0.02
    step = np.array([0, 0, 1, 1], np.float32).reshape(1, 4, 1)
    _, out = resample.resize(step, 32, 1)
    assert out.min() >= 0 and out.max() <= 1
    checker = (np.indices((64, 64)).sum(axis=0) % 2).astype(np.float32)[..., None]
    _, small = resample.resize(checker, 8, 8)
    assert abs(small.mean() - 0.5) < 0.01 and small.min() > 0.4 and small.max() < 0.6
    wavy = np.random.default_rng(1).random((7, 5, 1)).astype(np.float32)
    _, a = resample.resize(wavy, 40, 56)
    _, b = resample.resize(wavy.transpose(1, 0, 2), 56, 40)
    assert np.abs(a - b.transpose(1, 0, 2)).max() < 1e-5
    for bad, want in ((np.zeros((0, 2, 1)), "ZeroSourceDimension"), (np.zeros((2, 2, 5)), "InvalidChannelCount"), (np.full((2, 2, 1), np.nan), "NonFiniteSample")):
        assert resample.resize(bad, 2, 3)[0] == want
    assert resample.resize(flat, 0, 3)[0] == "ZeroTargetDimension"


def logo():
    rgba = np.zeros((32, 32, 4), np.uint8)
    rgba[..., :3] = 255
    rgba[..., 3] = 0
    rgba[4:20, 4:28] = (120, 12, 12, 255)
    rgba[22:28, 8:24] = (20, 40, 160, 255)
    return rgba


@pytest.mark.parametrize("form", encoders.FORMATS)
def test_certified_conversion_of_a_logo(form):
    found = images.convert(logo(), form, "0" * 64)
    assert found["error"] == "None" and found["vector_iou"] >= 0.99 and found["layers"] == 2
    assert found == images.convert(logo(), form, "0" * 64)
    lines = found["certificate"].decode().splitlines()
    names = [x.split("=", 1)[1] for x in lines if ".name=" in x]
    assert names == sorted(names) and len(names) == (11 if form == "svg" else 6)


def test_conversion_refuses_other_content():
    noise = np.random.default_rng(1).integers(0, 256, (24, 24, 4)).astype(np.uint8)
    noise[..., 3] = 255
    assert images.convert(noise, "svg", "0" * 64)["error"] == "RouteRejected"


def test_pdf_offsets():
    _, paths = vector.trace(mask("..... .###. .###. ....."))
    text = encoders.pdf(5, 4, vector.fit(paths)[1])
    assert text.index("xref\n") == int(text.split("startxref\n")[1].split("\n")[0])
    rows = text[text.index("xref\n") :].split("\n")[3:7]
    for k, row in enumerate(rows, 1):
        assert text[int(row[:10]) :].startswith(f"{k} 0 obj\n")


_ = random


def brute_simplified(paths, reference, **gates):
    """Every trial certified as a whole scene, from the first point on after each removal."""
    removed = 0
    while vector.certify_polygons(paths, reference, **gates)["error"] == "None":
        trials = ((k, i) for k, (points, _) in enumerate(paths) for i in range(len(points) if len(points) > 3 else 0))
        fewer = lambda k, i: [(p[:i] + p[i + 1 :] if j == k else p, hole) for j, (p, hole) in enumerate(paths)]
        found = next((t for k, i in trials if vector.certify_polygons(t := fewer(k, i), reference, **gates)["error"] == "None"), None)
        if found is None:
            break
        paths, removed = found, removed + 1
    return paths, removed


@pytest.mark.parametrize("gates", [{}, {"min_iou": 0.9, "most": 0.1}])
def test_gated_simplification_like_brute_force(gates):
    rnd = np.random.default_rng(8)
    for k in range(6):
        y, x = np.mgrid[:9, :9]
        m = rnd.random((9, 9)) < 0.5 if k % 2 else (x - 4) ** 2 + (y - 4) ** 2 < 4 * k + 4
        error, paths = vector.trace(np.where(m, 255, 0))
        if error == "None":
            _, got, removed = vector.simplify_gated(paths, m, **gates)
            assert (got, removed) == brute_simplified(paths, m, **gates)


def test_self_intersection_like_all_pairs():
    rnd = np.random.default_rng(9)
    for _ in range(300):
        ring = [tuple(p) for p in rnd.integers(0, 7, (int(rnd.integers(3, 9)), 2)).tolist()]
        n = len(ring)
        edges = [(np.array(ring[i]), np.array(ring[(i + 1) % n])) for i in range(n)]
        want = any((a == b).all() for a, b in edges) or any(
            bool(vector._touch(*edges[i], *edges[j])) for i in range(n) for j in range(i + 2, n) if (i, j) != (0, n - 1)
        )
        assert vector.self_intersects(ring) == want


def test_equal_inputs_are_computed_once():
    calls = []

    def call(w, data):
        calls.append((w, data))
        return {"size": 0 if data is None else len(data), "bytes": data}

    one = images.remembered(call, 3000)
    rows = [(1, b"a"), (1, b"a"), (2, b"a"), (1, None), (1, None), (1, b"a")]
    assert [one(*r)["bytes"] for r in rows] == [d for _, d in rows] and len(calls) == 4  # the fourth empties what is held
    assert one(1, b"x" * 5000)["size"] == 5000 and one(1, b"a")["size"] == 1
    grid = np.zeros(3)
    assert one(1, grid)["bytes"] is grid and one(1, grid)["bytes"] is grid and len(calls) == 8
