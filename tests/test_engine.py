import hashlib
import os

import numpy as np
import pytest

from tessera import cli
from tessera.contracts import records
from tessera.functions import pixel
from tessera.operators import images, neighbourhood, resample
from tests.test_decoders import png, tiff


def logo(shift=0):
    image = np.full((32, 32, 4), 255, np.uint8)
    image[5:24, 3 + shift : 20 + shift] = (20, 20, 60, 255)
    image[5:24, 9 + shift : 13 + shift] = 255
    return image


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    for k in range(3):
        (folder / f"logo{k}.png").write_bytes(png(logo(k), 3, (0, 1, 4)))
    (folder / "scan.tif").write_bytes(tiff(logo(4), 3, ">", 5))
    (folder / "broken.png").write_bytes(png(logo(), 3)[:-5])
    (folder / "text.txt").write_bytes(b"hello")
    (folder / "empty.bin").write_bytes(b"")
    return str(folder)


def test_probe(spark, files, capsys):
    assert cli.main(["--probe-input", f"{files}/logo0.png"], spark) == 0
    assert "status=accepted\nformat=PNG\n" in capsys.readouterr().out
    assert cli.main(["--probe-input", files], spark) == 65
    out = capsys.readouterr().out
    assert out.count("status=accepted") == 4 and "error=malformed_container" in out and "error=unsupported_format" in out
    assert cli.main(["--probe-input", f"{files}/empty.bin"], spark) == 65


def test_convert_writes_pam(spark, files, tmp_path):
    assert cli.main(["--convert", f"{files}/scan.tif", str(tmp_path)], spark) == 0
    [name] = os.listdir(tmp_path)
    data = (tmp_path / name).read_bytes()
    assert data == b"P7\nWIDTH 32\nHEIGHT 32\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n" + logo(4).tobytes()


def test_certified_convert_is_the_same_again(spark, files, tmp_path):
    for k in range(2):
        assert cli.main(["--certified-convert", f"{files}/logo*.png", str(tmp_path / str(k)), "svg"], spark) == 0
    read = lambda k: {n: (tmp_path / str(k) / n).read_bytes() for n in os.listdir(tmp_path / str(k))}
    assert read(0) == read(1) and len(read(0)) == 6


def test_certified_export_refuses_another_digest(spark, capsys):
    assert cli.main(["--certified-export", "r-1"], spark) == 0
    first = capsys.readouterr().out
    digest = first.split("certificate_sha256=")[1].strip()
    assert cli.main(["--certified-export", "r-1", digest], spark) == 0 and capsys.readouterr().out == first
    assert cli.main(["--certified-export", "r-1", "0" * 64], spark) == 65
    assert "error=certificate_provenance_mismatch\ncertificate_sha256=\n" in capsys.readouterr().out


def test_usage(capsys):
    assert cli.main(["--other"]) == 64 and cli.main(["--certified-convert", "a", "b", "gif"]) == 64 and cli.main([]) == 0


def test_stream_of_files(spark, files, tmp_path):
    from tessera.streaming.images import conversions, to_parquet

    for _ in range(2):  # a restart adds nothing
        to_parquet(conversions(spark, files, "dxf"), f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(rows) == 6 and sum(r.error == "None" for r in rows) == 4
    assert all(r.output_sha256 == hashlib.sha256(r.bytes).hexdigest() for r in rows if r.error == "None")


def test_planes_of_tables_like_single_images(spark):
    rnd = np.random.default_rng(4)
    planes = [(k, 9, 10, rnd.random(90).astype(np.float32).tolist()) for k in range(4)]
    df = spark.createDataFrame(planes, "image_id long, width int, height int, f array<float>")
    native = {r.image_id: r.out for r in resample.resize_plane(df, "f", "out", (13, 7)).collect()}
    plain = {r.image_id: r.pixels for r in images.resized(df, ["f"], 13, 7).collect()}
    assert all(np.abs(np.array(native[k]) - np.array(plain[k])).max() < 1e-6 for k in native)
    rgb = df.select("image_id", "width", "height", *[df.f.alias(c) for c in "rgb"])
    found = {r.image_id: r for r in neighbourhood.classify(neighbourhood.features(rgb, "r", "g", "b")).collect()}
    for k, _, _, f in planes:
        want = images.features(np.repeat(np.array(f, np.float32).reshape(10, 9, 1), 3, axis=2))
        assert all(found[k][n] == pytest.approx(v) for n, v in want.items())


def test_restoration_invariants(spark):
    flat = [0.5] * 16
    hard = [0.0] * 8 + [1.0] * 8
    soft = [0.40] * 8 + [0.55] * 8
    df = spark.createDataFrame([(0, 4, 4, flat), (1, 16, 1, hard), (2, 16, 1, soft)], "image_id long, width int, height int, f array<float>")
    out = {r.image_id: r.f for r in neighbourhood.deblock(df, "f", 0.5).collect()}
    assert out[0] == flat and out[1] == hard
    assert 0.40 < out[2][7] < out[2][8] < 0.55
    done = {r.image_id: r.out for r in neighbourhood.restore(df, ["f"], ["out"]).collect()}
    assert all(min(a) - 1e-6 <= v <= max(a) + 1e-6 for a, b in zip((flat, hard, soft), (done[0], done[1], done[2]), strict=True) for v in b)


@pytest.mark.parametrize(
    ("features", "kind"),
    [((0.30, 0.82, 0.04, 0.05, 0.0), "LineArt"), ((0.10, 0.74, 0.12, 0.08, 0.02), "Logo"), ((0.18, 0.24, 0.58, 0.31, 0.01), "Photo"), ((0.18, 0.46, 0.36, 0.12, 0.03), "Mixed"), ((0.01, 0.40, 0.05, 0.01, 0.0), "Uncertain"), ((0.0, 0.90, 0.06, 0.0, 0.18), "LineArt"), ((float("nan"), 0.9, 0.1, 0.0, 0.0), None)],
)
def test_routing_rules(spark, features, kind):
    names = ["edge_density", "flat_region_ratio", "color_complexity", "texture_energy", "alpha_transition_ratio"]
    df = spark.createDataFrame([features], ", ".join(f"{n} double" for n in names))
    assert neighbourhood.classify(df).first().kind == kind


def test_color_roundtrip_and_rounding(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.001, 0.03, 0.2, 0.5, 0.99, 1.0, float("nan"), -1.0, 2.0)], "v double")
    rows = df.select("v", pixel.linear_to_srgb(pixel.srgb_to_linear(df.v)).alias("back"), pixel.clamp_unit(df.v).alias("unit"), pixel.unit_to_u8(df.v).alias("u8")).collect()
    assert all(abs(r.back - r.v) < 1e-12 for r in rows[:7]) and np.isnan(rows[7].unit) and rows[8].unit == 0 and rows[9].u8 == 255


def test_split_of_bad_digest_is_train(spark):
    df = spark.createDataFrame([("f" * 64,), ("F" * 64,), ("x",), ("0" * 64 + "\n",)], "d string")
    got = [r.s for r in df.select(records.split_of(df.d, 0x5A17).alias("s")).collect()]
    bucket = ((1 << 64) - 1 ^ 0x5A17) % 100
    want = "Train" if bucket < 80 else "Validation" if bucket < 90 else "Test"
    assert got == [want, want, "Train", "Train"]
