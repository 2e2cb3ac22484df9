import struct
import zlib

import numpy as np
import pytest

from tessera.sources import decode as d


def rgba(w, h, kind):
    y, x = np.mgrid[:h, :w]
    v = (11 * x + 7 * y) % 256
    color = [v, v, v] if kind < 3 else [9 * x % 256, 13 * y % 256, 5 * (x + y) % 256]
    alpha = (255 * y // max(1, h - 1)) if kind == 2 else 255 * x // max(1, w - 1) if kind == 4 else np.full((h, w), 255)
    return np.stack([*color, alpha], axis=-1).astype(np.uint8)


def samples(image, kind):
    return {1: image[..., :1], 2: image[..., [0, 3]], 3: image[..., :3], 4: image}[kind]


# PNG


def chunk(name, body):
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def png(image, kind, filters=(0,), extra=b"", level=6):
    raw, (h, w) = samples(image, kind), image.shape[:2]
    step = raw.shape[2]
    lines, above = [], np.zeros(w * step, np.int64)
    for y in range(h):
        line = raw[y].reshape(-1).astype(np.int64)
        left = np.concatenate([np.zeros(step, np.int64), line[:-step]])
        corner = np.concatenate([np.zeros(step, np.int64), above[:-step]])
        p = left + above - corner
        da, db, dc = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, above, corner))
        f = filters[y % len(filters)]
        guess = [0, left, above, (left + above) // 2, paeth][f]
        lines.append(bytes([f]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        above = line
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[kind], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + extra + chunk(b"IDAT", zlib.compress(b"".join(lines), level)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
@pytest.mark.parametrize("filters", [(0,), (1,), (2,), (3,), (4,), (0, 1, 2, 3, 4)])
def test_png_matrix(kind, filters):
    image = rgba(13, 9, kind)
    error, got = d.decode("PNG", png(image, kind, filters))
    assert error == "None" and (got == image).all()
    assert (d.decode("PNG", png(image, kind, filters, level=0))[1] == image).all()


def test_png_color_chunks():
    image = rgba(4, 3, 3)
    primaries = struct.pack(">8I", *d.CHROMATICITIES)
    for extra, want in [
        (chunk(b"sRGB", b"\0"), "None"),
        (chunk(b"gAMA", struct.pack(">I", 45455)), "None"),
        (chunk(b"gAMA", struct.pack(">I", 100000)), "UnsupportedFeature"),
        (chunk(b"cHRM", primaries), "None"),
        (chunk(b"cHRM", struct.pack(">8I", *[c + 1001 for c in d.CHROMATICITIES])), "UnsupportedFeature"),
        (chunk(b"iCCP", b"x"), "UnsupportedFeature"),
        (chunk(b"sRGB", b"\0") * 2, "MalformedContainer"),
        (chunk(b"PLTE", b"\0\0\0"), "UnsupportedFeature"),
        (chunk(b"tEXt", b"a"), "None"),
    ]:
        assert d.decode("PNG", png(image, 3, extra=extra))[0] == want


def test_png_rejections():
    good = png(rgba(5, 4, 4), 4)
    cases = {
        good[:-1]: "MalformedContainer",
        good + b"\0": "MalformedContainer",
        good.replace(b"IHDR", b"IHDX"): "MalformedContainer",
        b"\x89PNG": "MalformedContainer",
        good[:8] + chunk(b"IHDR", struct.pack(">IIBBBBB", 0, 1, 8, 6, 0, 0, 0)): "DimensionLimitExceeded",
        good[:8] + chunk(b"IHDR", struct.pack(">IIBBBBB", 32768, 32768, 8, 6, 0, 0, 0)): "PixelBudgetExceeded",
        good[:8] + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 4, 16, 6, 0, 0, 0)): "UnsupportedFeature",
        good[:8] + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 4, 8, 6, 0, 0, 1)): "UnsupportedFeature",
    }
    for data, want in cases.items():
        assert d.decode("PNG", data) == (want, None)
    damaged = bytearray(good)
    damaged[45] ^= 1
    assert d.decode("PNG", bytes(damaged))[0] == "MalformedContainer"


# TIFF


def tiff(image, kind, order="<", rows=None, extra=2, **change):
    raw, (h, w) = samples(image, kind), image.shape[:2]
    n, rows = raw.shape[2], rows or h
    strips = [raw[y : y + rows].tobytes() for y in range(0, h, rows)]
    tags = {256: (4, [w]), 257: (4, [h]), 258: (3, [8] * n), 259: (3, [1]), 262: (3, [1 if kind < 3 else 2]), 277: (3, [n]), 278: (4, [rows]), 279: (4, [len(s) for s in strips])}
    if kind in (2, 4):
        tags[338] = (3, [extra])
    tags[273] = (4, [0] * len(strips))
    tags |= {int(k[1:]): v for k, v in change.items()}
    tail_at = 8 + 2 + 12 * len(tags) + 4
    size = {3: 2, 4: 4}
    room = sum(len(v) * size[t] for t, v in tags.values() if len(v) * size[t] > 4)
    if "t273" not in change:
        at = tail_at + room
        tags[273] = (4, [at + sum(len(s) for s in strips[:k]) for k in range(len(strips))])
    out, tail = b"", b""
    for tag, (t, v) in sorted(tags.items()):
        body = struct.pack(f"{order}{len(v)}{'H' if t == 3 else 'I'}", *v)
        if len(body) > 4:
            tail += body
            body = struct.pack(order + "I", tail_at + len(tail) - len(body))
        out += struct.pack(order + "HHI", tag, t, len(v)) + body.ljust(4, b"\0")
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)
    return head + struct.pack(order + "H", len(tags)) + out + struct.pack(order + "I", 0) + tail + b"".join(strips)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("kind", [1, 2, 3, 4])
@pytest.mark.parametrize("rows", [None, 4, 1])
def test_tiff_matrix(order, kind, rows):
    image = rgba(13, 9, kind)
    error, got = d.decode("TIFF", tiff(image, kind, order, rows))
    assert error == "None" and (got == image).all()


def test_tiff_associated_alpha():
    image = np.zeros((1, 3, 4), np.uint8)
    image[0] = [(10, 20, 30, 40), (7, 8, 9, 0), (200, 100, 50, 100)]
    _, got = d.decode("TIFF", tiff(image, 4, extra=1))
    assert got[0].tolist() == [[64, 128, 191, 40], [0, 0, 0, 0], [255, 255, 128, 100]]


def test_tiff_rejections():
    image = rgba(5, 4, 3)
    for change, want in [
        ({"t259": (3, [5])}, "UnsupportedFeature"),
        ({"t258": (3, [16, 16, 16])}, "UnsupportedFeature"),
        ({"t284": (3, [2])}, "UnsupportedFeature"),
        ({"t262": (3, [3])}, "UnsupportedFeature"),
        ({"t256": (4, [0])}, "DimensionLimitExceeded"),
        ({"t279": (4, [59])}, "UnsupportedFeature"),
        ({"t273": (4, [10**6])}, "TruncatedPixelData"),
        ({"t278": (4, [0])}, "MalformedContainer"),
        ({"t278": (4, [2])}, "MalformedContainer"),
    ]:
        assert d.decode("TIFF", tiff(image, 3, **change)) == (want, None)
    assert d.decode("TIFF", b"II*\0\xff\xff\0\0")[0] == "MalformedContainer"


# JPEG: a small baseline encoder with flat codes


def jpeg(planes, sampling, size, quant=1):
    """planes: one or three arrays, already subsampled and padded to whole units."""
    h, w = size
    out = b"\xff\xd8\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([quant]) * 64
    n = len(planes)
    out += b"\xff\xc0" + struct.pack(">HBHHB", 8 + 3 * n, 8, h, w, n)
    out += b"".join(bytes([k + 1, s[0] << 4 | s[1], 0]) for k, s in enumerate(sampling))
    dc, ac = list(range(12)), [r << 4 | s for r in range(16) for s in range(1, 11)] + [0, 0xF0]
    out += b"\xff\xc4" + struct.pack(">HB", 19 + len(dc), 0) + bytes([0] * 3 + [12] + [0] * 12) + bytes(dc)
    out += b"\xff\xc4" + struct.pack(">HB", 19 + len(ac), 16) + bytes([0] * 7 + [len(ac)] + [0] * 8) + bytes(ac)
    out += b"\xff\xda" + struct.pack(">HB", 6 + 2 * n, n) + b"".join(bytes([k + 1, 0]) for k in range(n)) + b"\0\x3f\0"
    bits, last = [], [0] * n

    def put(value, count):
        bits.extend(value >> (count - 1 - i) & 1 for i in range(count))

    def amount(v):
        s = abs(v).bit_length()
        return s, v if v >= 0 else v + (1 << s) - 1

    top_h, top_v = max(s[0] for s in sampling), max(s[1] for s in sampling)
    for my in range(-(-h // (8 * top_v))):
        for mx in range(-(-w // (8 * top_h))):
            for k, (sh, sv) in enumerate(sampling):
                for by in range(sv):
                    for bx in range(sh):
                        y, x = (my * sv + by) * 8, (mx * sh + bx) * 8
                        block = planes[k][y : y + 8, x : x + 8].astype(float) - 128
                        q = np.round(d._COSINES.T @ block @ d._COSINES / 4 / quant).astype(int).reshape(-1)[d._ZIGZAG]
                        s, v = amount(int(q[0]) - last[k])
                        last[k] = int(q[0])
                        put(s, 4)
                        put(v, s)
                        run = 0
                        end = max([0, *np.flatnonzero(q).tolist()])
                        for c in q[1 : end + 1]:
                            if c == 0:
                                run += 1
                                continue
                            while run > 15:
                                put(ac.index(0xF0), 8)
                                run -= 16
                            s, v = amount(int(c))
                            put(ac.index(run << 4 | s), 8)
                            put(v, s)
                            run = 0
                        if end < 63:
                            put(ac.index(0), 8)
    bits += [1] * (-len(bits) % 8)
    body = np.packbits(bits).tobytes().replace(b"\xff", b"\xff\0")
    return out + body + b"\xff\xd9"


def padded(plane, h, w):
    return np.pad(plane, ((0, h - plane.shape[0]), (0, w - plane.shape[1])), mode="edge")


def test_jpeg_gray_ramp_is_exact_nearly():
    y, x = np.mgrid[:16, :24]
    v = np.minimum(255, 16 + 6 * x + 4 * y)
    error, got = d.decode("JPEG", jpeg([v], [(1, 1)], (16, 24)))
    assert error == "None" and np.abs(got[..., 0].astype(int) - v).max() <= 1 and (got[..., 3] == 255).all()


@pytest.mark.parametrize(("sampling", "most"), [((1, 1), 5), ((2, 1), 6), ((2, 2), 8)])
def test_jpeg_smooth_color(sampling, most):
    y, x = np.mgrid[:24, :32]
    rgb = np.minimum(255, np.stack([40 + 5 * x, 30 + 7 * y, 20 + 3 * (x + y)], axis=-1)).astype(float)
    light = rgb @ [0.299, 0.587, 0.114]
    cb, cr = 128 + (rgb[..., 2] - light) / 1.772, 128 + (rgb[..., 0] - light) / 1.402
    sh, sv = sampling
    small = [c.reshape(24 // sv, sv, 32 // sh, sh).mean(axis=(1, 3)) for c in (cb, cr)]
    units = [padded(light, -(-24 // (8 * sv)) * 8 * sv, -(-32 // (8 * sh)) * 8 * sh)]
    units += [padded(c, -(-24 // (8 * sv)) * 8, -(-32 // (8 * sh)) * 8) for c in small]
    error, got = d.decode("JPEG", jpeg(units, [sampling, (1, 1), (1, 1)], (24, 32)))
    assert error == "None" and np.abs(got[..., :3] - rgb).max() <= most


def test_jpeg_rejections():
    v = np.full((8, 8), 99)
    good = jpeg([v], [(1, 1)], (8, 8))
    for data, want in [
        (good.replace(b"\xff\xc0", b"\xff\xc2"), "UnsupportedFeature"),
        (good[:-2], "MalformedContainer"),
        (good[:-4], "TruncatedPixelData"),
        (good[:2] + b"\xff\xdd\0\4\0\1" + good[2:], "UnsupportedFeature"),
        (b"\xff\xd8\xff\xd9", "MalformedContainer"),
        (good[:20], "TruncatedPixelData"),
    ]:
        assert d.decode("JPEG", data)[0] == want, data[:40]


# WebP: streams written bit by bit


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, count):
        self.bits.extend(value >> i & 1 for i in range(count))

    def simple(self, *symbols):
        """A code of one or two symbols."""
        self.put(1, 1)
        self.put(len(symbols) - 1, 1)
        self.put(1, 1)
        for s in symbols:
            self.put(s, 8)

    def flat(self, size, used):
        """All symbols below `used` (a power of two) with codes of equal length."""
        n = used.bit_length() - 1
        self.put(0, 1)
        self.put(19 - 4, 4)
        for k in d.LENGTH_ORDER:
            self.put(1 if k in (0, n) else 0, 3)
        self.put(0, 1)
        for s in range(size):
            self.put(int(s < used) if n > 0 else 0, 1)

    def file(self, name=b"VP8L"):
        body = b"\x2f" + np.packbits(np.array(self.bits + [0] * (-len(self.bits) % 8), np.uint8), bitorder="little").tobytes()
        inner = b"WEBP" + name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
        return b"RIFF" + struct.pack("<I", len(inner)) + inner


def head(w, h):
    out = Writer()
    out.put(w - 1, 14)
    out.put(h - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    return out


def rev(code, n):
    return int(format(code, f"0{n}b")[::-1], 2)


def plain(image, transforms=(), cache=0):
    """All literals with codes of eight bits."""
    out = head(image.shape[1], image.shape[0])
    for t in transforms:
        t(out)
    out.put(0, 1)
    out.put(0, 1)
    out.put(0, 1)
    out.flat(280, 256)
    for _ in range(3):
        out.flat(256, 256)
    out.simple(0)
    for r, g, b, a in image.reshape(-1, 4).tolist():
        for v in (g, r, b, a):
            out.put(rev(v, 8), 8)
    return out


def test_webp_literals():
    y, x = np.mgrid[:11, :19]
    image = np.stack([13 * x + 7 * y, 3 * x + 29 * y, 47 * x + 11 * y, 9 * x], axis=-1).astype(np.uint8)
    error, got = d.decode("WebP", plain(image).file())
    assert error == "None" and (got == image).all()


def test_webp_subtract_green():
    image = np.random.default_rng(1).integers(0, 256, (6, 5, 4)).astype(np.uint8)
    sent = image.copy()
    sent[..., 0] -= image[..., 1]
    sent[..., 2] -= image[..., 1]

    def green(out):
        out.put(1, 1)
        out.put(2, 2)

    assert (d.decode("WebP", plain(sent, [green]).file())[1] == image).all()


def sub_image(out, value):
    """One colour everywhere, without cache."""
    out.put(0, 1)
    for v in (value[1], value[0], value[2], value[3]):
        out.simple(v)
    out.simple(0)


@pytest.mark.parametrize("mode", range(14))
def test_webp_predictors(mode):
    image = np.random.default_rng(mode).integers(0, 256, (5, 6, 4)).astype(np.int64)
    flat, w = image.reshape(-1, 4), 6
    sent = np.zeros_like(flat)
    for n in range(len(flat)):
        y, x = divmod(n, w)
        if not y:
            guess = flat[n - 1] if x else np.array([0, 0, 0, 255])
        elif not x:
            guess = flat[n - w]
        else:
            l, t, tl, tr = (flat[k] for k in (n - 1, n - w, n - w - 1, n - w + 1))  # noqa: E741
            half = lambda a, b: (a + b) // 2
            near = l if np.abs(t - tl).sum() < np.abs(l - tl).sum() else t
            m = half(l, t)
            guess = [
                np.array([0, 0, 0, 255]), l, t, tr, tl, half(half(l, tr), t), half(l, tl), half(l, t), half(tl, t), half(t, tr), half(half(l, tl), half(t, tr)), near,
                np.clip(l + t - tl, 0, 255), np.clip(m + ((m - tl) / 2).astype(np.int64), 0, 255),
            ][mode]
        sent[n] = (flat[n] - guess) % 256

    def predictor(out):
        out.put(1, 1)
        out.put(0, 2)
        out.put(1, 3)
        sub_image(out, (0, mode, 0, 0))

    assert (d.decode("WebP", plain(sent.reshape(image.shape), [predictor]).file())[1] == image).all()


def test_webp_cross_color():
    image = np.random.default_rng(3).integers(0, 256, (4, 5, 4)).astype(np.int64)
    signed = lambda v: (v + 128) % 256 - 128
    g2r, g2b, r2b = 40, -70, 25
    green, red = signed(image[..., 1]), signed(image[..., 0])
    sent = image.copy()
    sent[..., 0] = (image[..., 0] - (g2r * green >> 5)) % 256
    sent[..., 2] = (image[..., 2] - (g2b * green >> 5) - (r2b * red >> 5)) % 256

    def cross(out):
        out.put(1, 1)
        out.put(1, 2)
        out.put(1, 3)
        sub_image(out, (r2b % 256, g2b % 256, g2r % 256, 255))

    assert (d.decode("WebP", plain(sent, [cross]).file())[1] == image).all()


def test_webp_copies_and_cache():
    out = head(4, 4)
    out.put(0, 1)
    out.put(1, 1)
    out.put(2, 4)  # four cached colours
    out.put(0, 1)
    # green: literals 7 and 9, copy of length 3 (symbol 258), cache entries 280..283
    lengths = {7: 2, 9: 3, 258: 3, 280: 3, 281: 3, 282: 3, 283: 3}
    out.put(0, 1)
    out.put(15, 4)
    for k in d.LENGTH_ORDER:
        out.put({0: 1, 2: 2, 3: 2}.get(k, 0), 3)
    out.put(0, 1)
    meta = {0: (0, 1), 2: (2, 2), 3: (3, 2)}
    for s in range(284):
        out.put(rev(*meta[lengths.get(s, 0)]), meta[lengths.get(s, 0)][1])
    codes, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - last
        codes[s] = (code, n)
        code, last = code + 1, n
    for v in (100, 200, 255):
        out.simple(v)
    out.simple(1)  # distance symbol 1: plane code 2, one to the left

    def green(s):
        out.put(rev(*codes[s]), codes[s][1])

    first, second = 0xFF640700 | 200, 0xFF640900 | 200
    slot = lambda p: (p * d.HASH & 0xFFFFFFFF) >> 30
    green(7)
    green(9)
    green(258)  # three more of the second
    green(280 + slot(first) if slot(first) != slot(second) else 7)
    for _ in range(10):
        green(9)
    error, got = d.decode("WebP", out.file())
    want = [7, 9, 9, 9, 9, 7, *[9] * 10]
    assert error == "None" and got.reshape(-1, 4).tolist() == [[100, g, 200, 255] for g in want]


def test_webp_palette():
    out = head(5, 2)
    out.put(1, 1)
    out.put(3, 2)
    out.put(1, 8)  # two colours: eight indices a byte
    out.put(0, 1)
    out.simple(10, 20)  # green
    out.simple(1)
    out.simple(2)
    out.simple(255, 0)
    out.simple(0)
    for bit in (0, 1, 1, 0):  # colour one: green 10, alpha 255 (second of 0, 255); difference: green 20, alpha 0
        out.put(bit, 1)
    out.put(0, 1)
    out.put(0, 1)
    out.put(0, 1)
    out.flat(280, 256)
    for _ in range(3):
        out.simple(0)
    out.simple(0)
    for packed in (0b01101, 0b10010):
        out.put(rev(packed, 8), 8)
    error, got = d.decode("WebP", out.file())
    assert error == "None"
    assert got[..., 1].tolist() == [[30, 10, 30, 30, 10], [10, 30, 10, 10, 30]] and got[0, 0].tolist() == [2, 30, 4, 255]


def test_webp_rejections():
    good = plain(rgba(4, 3, 4)).file()
    for data, want in [
        (good[:-8], "MalformedContainer"),
        (good.replace(b"VP8L", b"VP8 "), "UnsupportedFeature"),
        (good.replace(b"VP8L", b"ALPH"), "UnsupportedFeature"),
        (good.replace(b"WEBP", b"WEBQ"), "MalformedContainer"),
        (good.replace(b"\x2f", b"\x2e", 1), "MalformedContainer"),
        (head(4, 3).file(), "MalformedContainer"),
    ]:
        assert d.decode("WebP", data)[0] == want


def test_unknown_format():
    assert d.decode(None, b"GIF89a") == ("UnsupportedFeature", None)


def test_webp_literals_are_looked_up_at_once(monkeypatch):
    """A run of literals takes a few steps a pixel: read() is left for the lengths of the codes and the last bytes."""
    from tessera.plans import encoded

    reads = []
    real = d._Bits.read
    monkeypatch.setattr(d._Bits, "read", lambda self, n, *error: (reads.append(n), real(self, n, *error))[1])
    image = np.random.default_rng(3).integers(0, 256, (40, 40, 4)).astype(np.uint8)
    assert (d.decode_webp(encoded.webp(image)) == image).all()
    assert len(reads) < image.size / 4
