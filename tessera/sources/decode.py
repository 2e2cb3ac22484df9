"""Decoders of TIFF, PNG, baseline JPEG and lossless WebP to straight RGBA bytes.

decode() gives ("None", image) or (error, None) and raises nothing. Decoders stop at the first fault, in the order of
the file; limits are checked before pixels are allocated. Errors: MalformedContainer, UnsupportedFeature,
DimensionLimitExceeded, PixelBudgetExceeded, TruncatedPixelData.
"""

from __future__ import annotations

import math
import struct
import zlib
from functools import lru_cache

import numpy as np

MAX_SIDE, MAX_PIXELS, MAX_JPEG_PIXELS = 32_768, 67_108_864, 16_777_216


class Fault(Exception):
    """Stops a decoder; the text is the error."""


MALFORMED, UNSUPPORTED, SIDE, BUDGET, TRUNCATED = "MalformedContainer", "UnsupportedFeature", "DimensionLimitExceeded", "PixelBudgetExceeded", "TruncatedPixelData"


def _require(good: object, error: str = MALFORMED) -> None:
    if not good:
        raise Fault(error)


def _check_size(width: int, height: int, most: int = MAX_PIXELS) -> None:
    _require(0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE, SIDE)
    _require(width * height <= most, BUDGET)


def decode(form: str | None, content: bytes) -> tuple[str, np.ndarray | None]:
    """(error, image of height, width, 4)."""
    try:
        how = {"TIFF": decode_tiff, "PNG": decode_png, "JPEG": decode_jpeg, "WebP": decode_webp}.get(form or "")
        _require(how, UNSUPPORTED)
        return "None", how(content)
    except Fault as fault:
        return str(fault), None
    except MemoryError:
        return BUDGET, None
    except Exception:  # any other fault of a damaged file: the row says so, the job goes on
        return MALFORMED, None


def _rgba(samples: np.ndarray) -> np.ndarray:
    """From 1 (gray), 2 (gray, alpha), 3 or 4 channels."""
    h, w, n = samples.shape
    out = np.full((h, w, 4), 255, np.uint8)
    out[..., :3] = samples[..., :1] if n < 3 else samples[..., :3]
    if n in (2, 4):
        out[..., 3] = samples[..., -1]
    return out


# TIFF -----------------------------------------------------------------------------------------------------------------

# Tags.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, COUNTS, PLANAR, EXTRA = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 338


def decode_tiff(data: bytes) -> np.ndarray:
    """First directory, uncompressed, eight bits, chunky; gray or RGB, with or without one alpha channel."""
    _require(len(data) >= 8 and data[:2] in (b"II", b"MM"))
    order = "<" if data[:2] == b"II" else ">"

    def read(kind: str, at: int) -> int:
        size = struct.calcsize(kind)
        _require(0 <= at <= len(data) - size)
        return struct.unpack_from(order + kind, data, at)[0]

    _require(read("H", 2) == 42)
    start = read("I", 4)
    count = read("H", start)
    _require(count <= 256 and start + 2 + 12 * count + 4 <= len(data))
    entries: dict[int, tuple[int, int, int]] = {}
    for k in range(count):
        at = start + 2 + 12 * k
        entries.setdefault(read("H", at), (read("H", at + 2), read("I", at + 4), at + 8))

    def values(tag: int) -> list[int] | None:
        if tag not in entries:
            return None
        kind, n, at = entries[tag]
        if kind not in (3, 4) or not n:
            return None
        code, size = ("H", 2) if kind == 3 else ("I", 4)
        if n * size > 4:
            at = read("I", at)
        if at + n * size > len(data):
            return None
        return list(struct.unpack_from(f"{order}{n}{code}", data, at))

    def one(tag: int) -> int | None:
        found = values(tag)
        return found[0] if found and len(found) == 1 else None

    width, height, compression, photometric = map(one, (WIDTH, HEIGHT, COMPRESSION, PHOTOMETRIC))
    samples = 1 if one(SAMPLES) is None else one(SAMPLES)
    offsets, sizes, bits = map(values, (STRIPS, COUNTS, BITS))
    _require(None not in (width, height, compression, photometric) and offsets and sizes and bits and samples)
    _check_size(width, height)
    _require(compression == 1 and one(PLANAR) in (None, 1) and len(bits) == samples and set(bits) == {8}, UNSUPPORTED)
    _require((photometric, samples) in ((1, 1), (1, 2), (2, 3), (2, 4)), UNSUPPORTED)
    extra = values(EXTRA) if samples in (2, 4) else [2]
    _require(extra and len(extra) == 1 and extra[0] in (1, 2), UNSUPPORTED)
    rows = height if one(ROWS) is None else one(ROWS)
    _require(rows)
    strips = -(-height // rows)
    _require(len(offsets) == len(sizes) == strips)
    line, parts = width * samples, []
    for k, (at, size) in enumerate(zip(offsets, sizes, strict=True)):
        own = min(rows, height - k * rows) * line
        _require(size == own, UNSUPPORTED)
        _require(at + own <= len(data), TRUNCATED)
        parts.append(data[at : at + own])
    out = _rgba(np.frombuffer(b"".join(parts), np.uint8).reshape(height, width, samples))
    if extra[0] == 1:  # associated alpha: back to straight, rounded
        a = out[..., 3:].astype(np.int64)
        straight = np.minimum(255, (out[..., :3].astype(np.int64) * 255 + a // 2) // np.maximum(a, 1))
        out[..., :3] = np.where(a > 0, straight, 0)
    return out


# PNG ------------------------------------------------------------------------------------------------------------------

# File gamma of sRGB, and its chromaticities (white, red, green, blue), times 100000.
GAMMA = 45455
CHROMATICITIES, NEAR = (31270, 32900, 64000, 33000, 30000, 60000, 15000, 6000), 1000


def _png_color(name: bytes, data: bytes, late: bool, seen: set[bytes]) -> None:
    """Colour chunks that mean sRGB are accepted, others can't be honoured."""
    if name not in (b"sRGB", b"gAMA", b"cHRM", b"iCCP"):
        return
    _require(not late)
    _require(name != b"iCCP", UNSUPPORTED)
    _require(name not in seen and len(data) == {b"sRGB": 1, b"gAMA": 4, b"cHRM": 32}[name])
    seen.add(name)
    if name == b"sRGB":
        _require(data[0] <= 3)
    if name == b"cHRM":
        _require(all(abs(a - b) <= NEAR for a, b in zip(struct.unpack(">8I", data), CHROMATICITIES, strict=True)), UNSUPPORTED)


def _inflate(data: bytes, size: int) -> bytes:
    """Exactly one zlib stream of exactly this size."""
    _require(len(data) >= 2 and not data[1] & 0x20, MALFORMED if len(data) < 2 else UNSUPPORTED)
    flow = zlib.decompressobj()
    try:
        out = flow.decompress(data, size + 1)
    except zlib.error:
        raise Fault(MALFORMED) from None
    _require(len(out) <= size, MALFORMED)
    _require(flow.eof, TRUNCATED)
    _require(not flow.unused_data)
    _require(len(out) == size, TRUNCATED)
    return out


def _unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    kinds, lines = rows[:, 0], rows[:, 1:]
    _require(not len(kinds) or kinds.max() <= 4)
    out = np.zeros(lines.shape, np.uint8)
    above = np.zeros(lines.shape[1], np.uint8)
    for y, kind in enumerate(kinds.tolist()):
        line = lines[y]
        if kind == 2:
            line = line + above
        elif kind == 1:
            line = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind > 2:
            own, up = bytearray(line.tobytes()), above.tobytes()
            for x in range(len(own)):
                a = own[x - step] if x >= step else 0
                b = up[x]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = up[x - step] if x >= step else 0
                    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if da <= db and da <= dc else b if db <= dc else c
                own[x] = (own[x] + guess) & 255
            line = np.frombuffer(bytes(own), np.uint8)
        out[y] = above = line
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Eight bits, gray or RGB with or without alpha, not interlaced, sRGB."""
    _require(data[:8] == b"\x89PNG\r\n\x1a\n")
    at, packed, held, seen, gamma = 8, [], 0, set(), GAMMA
    head: tuple | None = None
    closed = ended = False
    while at < len(data) and not ended:
        _require(at + 12 <= len(data))
        size, name = struct.unpack_from(">I4s", data, at)
        _require(at + 12 + size <= len(data))
        body = data[at + 8 : at + 8 + size]
        _require(zlib.crc32(name + body) == struct.unpack_from(">I", data, at + 8 + size)[0])
        at += 12 + size
        _require(head or name == b"IHDR")
        if name == b"IHDR":
            _require(not head and size == 13)
            width, height, *rest = head = struct.unpack(">IIBBBBB", body)
            _check_size(width, height)
            _require(rest[0] == 8 and rest[2:] == [0, 0, 0] and rest[1] in (0, 2, 4, 6), UNSUPPORTED)
        elif name == b"IDAT":
            _require(not closed)
            packed.append(body)
            held += size
            _require(held <= 5 * MAX_PIXELS, BUDGET)
        elif name == b"IEND":
            _require(packed and not size)
            ended = True
        else:
            closed = closed or bool(packed)
            _require(name[0] & 0x20, UNSUPPORTED)
            _png_color(name, body, bool(packed), seen)
            if name == b"gAMA":
                gamma = struct.unpack(">I", body)[0]
    _require(head and packed and ended and at == len(data))
    _require(gamma == GAMMA, UNSUPPORTED)
    width, height, _, color, *_ = head
    step = {0: 1, 2: 3, 4: 2, 6: 4}[color]
    raw = np.frombuffer(_inflate(b"".join(packed), height * (width * step + 1)), np.uint8).reshape(height, -1)
    return _rgba(_unfilter(raw, step).reshape(height, width, step))


# JPEG -----------------------------------------------------------------------------------------------------------------


def _zigzag() -> np.ndarray:
    """Row-major places of the 64 coefficients in scan order: diagonals, turned round every time."""
    spots = [(r, c) for r in range(8) for c in range(8)]
    spots.sort(key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in spots])


_ZIGZAG = _zigzag()
_COSINES = np.array([[(math.sqrt(0.5) if u == 0 else 1.0) * math.cos((2 * x + 1) * u * math.pi / 16) for u in range(8)] for x in range(8)])


class _Entropy:
    """Bits of a scan, with stuffed zeros taken out, over a window of bytes that moves along; ends at the first marker."""

    def __init__(self, data: bytes, at: int) -> None:
        end = data.find(b"\xff", at)
        while end >= 0 and data[end + 1 : end + 2] == b"\x00":
            end = data.find(b"\xff", end + 2)
        end = len(data) if end < 0 else end
        self.rest = data[end:]
        self.body = data[at:end].replace(b"\xff\x00", b"\xff")
        self.at = self.bits = self.left = 0

    def _fill(self) -> None:
        part = self.body[self.at : self.at + 64]
        self.at += len(part)
        self.bits = ((self.bits & ((1 << self.left) - 1)) << (8 * len(part))) | int.from_bytes(part, "big")
        self.left += 8 * len(part)

    def peek(self, n: int) -> int:
        """The next n bits, ones behind the end."""
        if self.left < n and self.at < len(self.body):
            self._fill()
        short = n - self.left
        return ((self.bits << short) | ((1 << short) - 1)) & ((1 << n) - 1) if short > 0 else (self.bits >> -short) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        if self.left < n and self.at < len(self.body):
            self._fill()
        _require(n <= self.left, TRUNCATED)
        self.left -= n
        return (self.bits >> self.left) & ((1 << n) - 1)


def _huffman(counts: bytes, symbols: bytes) -> dict[int, int]:
    """length << 16 | code to symbol."""
    table, code, k = {}, 0, 0
    for length, count in enumerate(counts, 1):
        for _ in range(count):
            _require(code < 1 << length)
            table[length << 16 | code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


def _symbol(reader: _Entropy, table: dict[int, int]) -> int:
    word = reader.peek(16)
    for length in range(1, 17):
        found = table.get(length << 16 | word >> (16 - length))
        if found is not None:
            reader.take(length)
            return found
    raise Fault(TRUNCATED)


def _extended(reader: _Entropy, size: int) -> int:
    if not size:
        return 0
    value = reader.take(size)
    return value if value >> (size - 1) else value - (1 << size) + 1


def _block(reader: _Entropy, dc: dict[int, int], ac: dict[int, int], quant: np.ndarray, previous: int) -> tuple[int, np.ndarray]:
    """(DC value, 64 coefficients in row-major order)."""
    size = _symbol(reader, dc)
    _require(size <= 11, TRUNCATED)
    previous += _extended(reader, size)
    values = np.zeros(64)
    values[0] = previous
    k = 1
    while k < 64:
        both = _symbol(reader, ac)
        run, size = both >> 4, both & 15
        if not size:
            if run != 15:
                _require(run == 0, TRUNCATED)
                break
            k += 16
            _require(k <= 64, TRUNCATED)
            continue
        k += run
        _require(k < 64 and size <= 10, TRUNCATED)
        values[k] = _extended(reader, size)
        k += 1
    out = np.zeros(64)
    out[_ZIGZAG] = values * quant
    return previous, out


def _samples(blocks: np.ndarray) -> np.ndarray:
    """Inverse cosine transform of blocks (..., 8, 8), rounded half away from zero into bytes."""
    return np.clip(np.floor(_COSINES @ blocks @ _COSINES.T / 4 + 128 + 0.5), 0, 255)


def _spread(plane: np.ndarray, size: int, axis: int, same: bool) -> np.ndarray:
    """A subsampled axis enlarged by triangular weights 3 and 1."""
    logical = plane.shape[axis]
    out = np.arange(size)
    if same:
        return np.take(plane, np.minimum(out, logical - 1), axis)
    now = np.minimum(out // 2, logical - 1)
    other = np.where(out % 2, np.minimum(now + 1, logical - 1), np.maximum(now - 1, 0))
    first, second = np.where(out % 2, now, other), np.where(out % 2, other, now)
    weight = np.where(out % 2, 0.25, 0.75).reshape([-1 if a == axis else 1 for a in range(2)])
    return (1.0 - weight) * np.take(plane, first, axis) + weight * np.take(plane, second, axis)


def decode_jpeg(data: bytes) -> np.ndarray:
    """Baseline, eight bits, one or three components in one scan, without restarts; sampling of 1 or 2."""
    _require(len(data) >= 4 and data[:2] == b"\xff\xd8")
    at, quant, codes, frame = 2, {}, {}, None
    while at < len(data):
        _require(data[at] == 0xFF)
        while at < len(data) and data[at] == 0xFF:
            at += 1
        _require(at < len(data), TRUNCATED)
        marker = data[at]
        _require(marker not in (0xD8, 0xD9, 0x01) and not 0xD0 <= marker <= 0xD7)
        _require(at + 3 <= len(data))
        size = struct.unpack_from(">H", data, at + 1)[0] - 2
        _require(size >= 0)
        at += 3
        _require(at + size <= len(data), TRUNCATED)
        body = data[at : at + size]
        at += size
        if marker == 0xDB:
            while body:
                _require(body[0] < 4 and len(body) >= 65, UNSUPPORTED)
                quant[body[0]] = np.frombuffer(body[1:65], np.uint8).astype(np.float64)
                _require(quant[body[0]].all(), UNSUPPORTED)
                body = body[65:]
        elif marker == 0xC4:
            while body:
                _require(len(body) >= 17 and body[0] >> 4 < 2 and body[0] & 15 < 4)
                total = sum(body[1:17])
                _require(0 < total <= 256 and len(body) >= 17 + total)
                codes[body[0]] = _huffman(body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif marker == 0xC0:
            _require(not frame and len(body) >= 6 and body[0] == 8 and body[5] in (1, 3) and len(body) == 6 + 3 * body[5], UNSUPPORTED)
            height, width = struct.unpack_from(">HH", body, 1)
            _require(height and width)
            parts = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, len(body), 3)]
            _require(all(h in (1, 2) and v in (1, 2) and q < 4 for _, h, v, q in parts) and (len(parts) == 3 or parts[0][1:3] == (1, 1)), UNSUPPORTED)
            frame = width, height, parts
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise Fault(UNSUPPORTED)
        elif marker == 0xDD:
            _require(size == 2)
            _require(body == b"\0\0", UNSUPPORTED)
        elif marker == 0xDA:
            _require(frame, UNSUPPORTED)
            n = len(frame[2])
            _require(size == 4 + 2 * n and body[0] == n and body[-3:] == b"\0\x3f\0", UNSUPPORTED)
            ids = [p[0] for p in frame[2]]
            chosen = dict(zip(body[1 : 1 + 2 * n : 2], body[2 : 2 + 2 * n : 2], strict=True))
            _require(set(chosen) == set(ids) and len(chosen) == n, MALFORMED if n == 3 else UNSUPPORTED)
            return _scan(data, at, frame, quant, codes, [chosen[i] for i in ids])
    raise Fault(TRUNCATED)


def _scan(data: bytes, at: int, frame: tuple, quant: dict, codes: dict, selectors: list[int]) -> np.ndarray:
    width, height, parts = frame
    _check_size(width, height, MAX_JPEG_PIXELS)
    _require(sum(h * v for _, h, v, _ in parts) <= 10, UNSUPPORTED)
    tables = []
    for (_, _, _, q), s in zip(parts, selectors, strict=True):
        _require(q in quant and s >> 4 in codes and (s & 15 | 16) in codes)
        tables.append((codes[s >> 4], codes[s & 15 | 16], quant[q]))
    top_h, top_v = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-width // (8 * top_h)), -(-height // (8 * top_v))
    grids = [np.zeros((down * v, across * h, 64)) for _, h, v, _ in parts]
    reader, previous = _Entropy(data, at), [0] * len(parts)
    for y in range(down):
        for x in range(across):
            for k, (_, h, v, _) in enumerate(parts):
                for dy in range(v):
                    for dx in range(h):
                        previous[k], grids[k][y * v + dy, x * h + dx] = _block(reader, *tables[k], previous[k])
    _require(reader.left + 8 * (len(reader.body) - reader.at) < 8 and reader.rest[:2] == b"\xff\xd9")
    planes = []
    for grid, (_, h, v, _) in zip(grids, parts, strict=True):
        plane = _samples(grid.reshape(*grid.shape[:2], 8, 8)).transpose(0, 2, 1, 3).reshape(grid.shape[0] * 8, -1)
        plane = plane[: -(-height * v // top_v), : -(-width * h // top_h)]
        planes.append(_spread(_spread(plane, height, 0, v == top_v), width, 1, h == top_h))
    if len(planes) == 1:
        return _rgba(planes[0][..., None].astype(np.uint8))
    light, cb, cr = planes[0], planes[1] - 128.0, planes[2] - 128.0
    color = np.stack([light + 1.402 * cr, light - 0.344136 * cb - 0.714136 * cr, light + 1.772 * cb], axis=-1)
    return _rgba(np.clip(np.where(color < 0, 0, np.floor(color + 0.5)), 0, 255).astype(np.uint8))


# WebP -----------------------------------------------------------------------------------------------------------------

# Fixed values of the lossless format: order of code lengths; offsets (dy * 16 + 8 - dx) of the short distance codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PLANE_CODES = (
    0x18, 0x07, 0x17, 0x19, 0x28, 0x06, 0x27, 0x29, 0x16, 0x1A, 0x26, 0x2A, 0x38, 0x05, 0x37, 0x39, 0x15, 0x1B, 0x36, 0x3A,
    0x25, 0x2B, 0x48, 0x04, 0x47, 0x49, 0x14, 0x1C, 0x35, 0x3B, 0x46, 0x4A, 0x24, 0x2C, 0x58, 0x45, 0x4B, 0x34, 0x3C, 0x03,
    0x57, 0x59, 0x13, 0x1D, 0x56, 0x5A, 0x23, 0x2D, 0x44, 0x4C, 0x55, 0x5B, 0x33, 0x3D, 0x68, 0x02, 0x67, 0x69, 0x12, 0x1E,
    0x66, 0x6A, 0x22, 0x2E, 0x54, 0x5C, 0x43, 0x4D, 0x65, 0x6B, 0x32, 0x3E, 0x78, 0x01, 0x77, 0x79, 0x53, 0x5D, 0x11, 0x1F,
    0x64, 0x6C, 0x42, 0x4E, 0x76, 0x7A, 0x21, 0x2F, 0x75, 0x7B, 0x31, 0x3F, 0x63, 0x6D, 0x52, 0x5E, 0x00, 0x74, 0x7C, 0x41,
    0x4F, 0x10, 0x20, 0x62, 0x6E, 0x30, 0x73, 0x7D, 0x51, 0x5F, 0x40, 0x72, 0x7E, 0x61, 0x6F, 0x50, 0x71, 0x7F, 0x60, 0x70,
)
HASH = 0x1E35A7BD
_OPAQUE = 0xFF000000


#: Bits of a code up to which it is looked up at once; the mark of a code that is found there.
FLAT, FOUND = 9, 1 << 24


class _Bits:
    """Bits from the least significant on."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.word, self.have = data, 0, 0, 0

    def read(self, n: int, error: str = MALFORMED) -> int:
        while self.have < n:
            part = self.data[self.at : self.at + 8]
            _require(part, error)
            self.word |= int.from_bytes(part, "little") << self.have
            self.at, self.have = self.at + len(part), self.have + 8 * len(part)
        value = self.word & ((1 << n) - 1)
        self.word, self.have = self.word >> n, self.have - n
        return value

    def fill(self) -> None:
        """At least 15 bits, if there are as many."""
        part = self.data[self.at : self.at + 8]
        self.word |= int.from_bytes(part, "little") << self.have
        self.at, self.have = self.at + len(part), self.have + 8 * len(part)

    def remaining(self) -> int:
        return self.have + 8 * (len(self.data) - self.at)


class _Code:
    """A complete prefix code, or one symbol that takes no bits.

    `flat` tells for each value of the next bits (`mask`) the code at their begin as FOUND | length << 16 | symbol; codes
    of more than FLAT bits are 0 there and stand in `table`.
    """

    def __init__(self, lengths: bytes) -> None:
        used = [(n, s) for s, n in enumerate(lengths) if n]
        _require(used)
        self.table: dict[tuple[int, int], int] = {}
        if len(used) == 1:
            self.flat, self.mask = [FOUND | used[0][1]], 0
            return
        _require(sum(1 << (15 - n) for n, _ in used) == 1 << 15)
        used.sort()
        size = 1 << min(FLAT, used[-1][0])
        self.flat, self.mask = [0] * size, size - 1
        code = last = 0
        for n, s in used:
            code <<= n - last
            turned = int(f"{code:0{n}b}"[::-1], 2)
            if 1 << n <= size:
                self.flat[turned :: 1 << n] = [FOUND | n << 16 | s] * (size >> n)
            else:
                self.table[n, turned] = s
            code, last = code + 1, n

    def read(self, bits: _Bits, error: str = MALFORMED) -> int:
        if bits.have < 15:
            bits.fill()
        found = self.flat[bits.word & self.mask]
        if found:
            n, symbol = found >> 16 & 15, found & 0xFFFF
        else:
            n, symbol = next((n, s) for n in range(FLAT + 1, 16) if (s := self.table.get((n, bits.word & ((1 << n) - 1)))) is not None)
        _require(n <= bits.have, error)
        bits.word, bits.have = bits.word >> n, bits.have - n
        return symbol


#: Codes by their lengths: files of one encoder often have the same.
_code = lru_cache(maxsize=256)(_Code)


def _read_code(bits: _Bits, size: int) -> _Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1), *([bits.read(8)] if two else [])]
        _require(max(symbols) < size and len(set(symbols)) == len(symbols))
        return _code(bytes(int(s in symbols) for s in range(max(symbols) + 1)))
    lengths = [0] * 19
    present = bits.read(4) + 4
    _require(present <= 19)
    for k in LENGTH_ORDER[:present]:
        lengths[k] = bits.read(3)
    meta = _code(bytes(lengths))
    most = size
    if bits.read(1):
        most = 2 + bits.read(2 + 2 * bits.read(3))
        _require(most <= size)
    found: list[int] = []
    last = 8
    while len(found) < size and most:
        most -= 1
        value = meta.read(bits)
        if value < 16:
            found.append(value)
            last = value or last
            continue
        extra, least = ((2, 3), (3, 3), (7, 11))[value - 16]
        again = bits.read(extra) + least
        _require(len(found) + again <= size)
        found += [last if value == 16 else 0] * again
    return _code(bytes(found))


def _copy_value(bits: _Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra, TRUNCATED) + 1


def _distance(width: int, code: int) -> int:
    if code > len(PLANE_CODES):
        return code - len(PLANE_CODES)
    plane = PLANE_CODES[code - 1]
    return max(1, (plane >> 4) * width + 8 - (plane & 15))


def _parts(size: int, bits: int) -> int:
    return (size + (1 << bits) - 1) >> bits


def _literals(bits: _Bits, codes: list[_Code], pixels: list[int], end: int) -> None:
    """Append pixels, to `end` at most, as long as they are literals of codes that are looked up at once, and not near the end of the data."""
    (greens, g_mask), (reds, r_mask), (blues, b_mask), (alphas, a_mask) = ((c.flat, c.mask) for c in codes[:4])
    data, at, word, have = bits.data, bits.at, bits.word, bits.have
    for _ in range(end - len(pixels)):
        if have < 4 * FLAT:
            part = data[at : at + 8]
            if len(part) < 8:
                break
            word |= int.from_bytes(part, "little") << have
            at, have = at + 8, have + 64
        g = greens[word & g_mask]
        if not g or g & 0xFF00:
            break
        rest = word >> (g >> 16 & 15)
        r = reds[rest & r_mask]
        rest >>= r >> 16 & 15
        b = blues[rest & b_mask]
        rest >>= b >> 16 & 15
        a = alphas[rest & a_mask]
        if not (r and b and a):
            break
        word = rest >> (a >> 16 & 15)
        have -= (g >> 16 & 15) + (r >> 16 & 15) + (b >> 16 & 15) + (a >> 16 & 15)
        pixels.append((a & 255) << 24 | (r & 255) << 16 | (g & 255) << 8 | b & 255)
    bits.at, bits.word, bits.have = at, word, have


def _entropy_pixels(bits: _Bits, width: int, height: int, top: bool, depth: int) -> list[int]:
    """Pixels before the transforms, as ARGB numbers."""
    cache_bits = 0
    if bits.read(1):
        cache_bits = bits.read(4)
        _require(1 <= cache_bits <= 11)
    zones: list[int] = []
    zone_bits = zone_width = 0
    if top and bits.read(1):
        zone_bits = bits.read(3) + 2
        zone_width = _parts(width, zone_bits)
        zones = [p >> 8 & 0xFFFF for p in _stream(bits, zone_width, _parts(height, zone_bits), False, depth + 1)]
    groups = max(zones, default=0) + 1
    _require(groups <= bits.remaining() // 5)
    cache = [0] * (1 << cache_bits) if cache_bits else []
    codes = [[_read_code(bits, n) for n in (280 + len(cache), 256, 256, 256, 40)] for _ in range(groups)]
    total, pixels, shift = width * height, [], 32 - cache_bits
    while len(pixels) < total:
        n = len(pixels)
        y, x = divmod(n, width)
        group = codes[zones[(y >> zone_bits) * zone_width + (x >> zone_bits)] if zones else 0]
        tile = (1 << zone_bits) - 1
        _literals(bits, group, pixels, min(total, n + min(width - x, tile + 1 - (x & tile))) if zones else total)
        if len(pixels) == n:
            green, red, blue, alpha, distance = group
            code = green.read(bits, TRUNCATED)
            if code < 256:
                r, b, a = red.read(bits, TRUNCATED), blue.read(bits, TRUNCATED), alpha.read(bits, TRUNCATED)
                pixels.append(a << 24 | r << 16 | code << 8 | b)
            elif code < 280:
                length = _copy_value(bits, code - 256)
                back = _distance(width, _copy_value(bits, distance.read(bits, TRUNCATED)))
                _require(back <= n and length <= total - n)
                for _ in range(length):
                    pixels.append(pixels[-back])
            else:
                _require(code - 280 < len(cache))
                pixels.append(cache[code - 280])
        if cache:
            for p in pixels[n:]:
                cache[(p * HASH & 0xFFFFFFFF) >> shift] = p
    return pixels


def _add(a: int, b: int) -> int:
    return (((a & 0xFF00FF00) + (b & 0xFF00FF00)) & 0xFF00FF00) | (((a & 0x00FF00FF) + (b & 0x00FF00FF)) & 0x00FF00FF)


def _mean(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _each(f, *pixels: int) -> int:
    return sum(min(255, max(0, f(*(p >> s & 255 for p in pixels)))) << s for s in (0, 8, 16, 24))


def _half(a: int, c: int) -> int:
    """a + (a - c) / 2, the half rounded towards zero."""
    d = a - c
    return a + (d // 2 if d >= 0 else -(-d // 2))


def _nearer(top: int, left: int, corner: int) -> int:
    """Of left and top the one that is nearer to left + top - corner, over all channels."""
    to_left = sum(abs((top >> s & 255) - (corner >> s & 255)) for s in (0, 8, 16, 24))
    to_top = sum(abs((left >> s & 255) - (corner >> s & 255)) for s in (0, 8, 16, 24))
    return left if to_left < to_top else top


_PREDICT = [
    lambda l, t, tl, tr: _OPAQUE,
    lambda l, t, tl, tr: l,
    lambda l, t, tl, tr: t,
    lambda l, t, tl, tr: tr,
    lambda l, t, tl, tr: tl,
    lambda l, t, tl, tr: _mean(_mean(l, tr), t),
    lambda l, t, tl, tr: _mean(l, tl),
    lambda l, t, tl, tr: _mean(l, t),
    lambda l, t, tl, tr: _mean(tl, t),
    lambda l, t, tl, tr: _mean(t, tr),
    lambda l, t, tl, tr: _mean(_mean(l, tl), _mean(t, tr)),
    lambda l, t, tl, tr: _nearer(t, l, tl),
    lambda l, t, tl, tr: _each(lambda a, b, c: a + b - c, l, t, tl),
    lambda l, t, tl, tr: _each(_half, _mean(l, t), tl),
]


def _undo_predictor(pixels: list[int], width: int, height: int, bits: int, modes: list[int]) -> list[int]:
    tiles = _parts(width, bits)
    out: list[int] = []
    for n, residual in enumerate(pixels):
        y, x = divmod(n, width)
        if not y:
            guess = out[-1] if x else _OPAQUE
        elif not x:
            guess = out[n - width]
        else:
            mode = modes[(y >> bits) * tiles + (x >> bits)] >> 8 & 15
            guess = _PREDICT[mode if mode < 14 else 0](out[-1], out[n - width], out[n - width - 1], out[n - width + 1])
        out.append(_add(residual, guess))
    return out


def _signed(v: int) -> int:
    return v - 256 if v > 127 else v


def _undo_cross(pixels: list[int], width: int, height: int, bits: int, codes: list[int]) -> list[int]:
    tiles = _parts(width, bits)
    out = []
    for n, p in enumerate(pixels):
        y, x = divmod(n, width)
        c = codes[(y >> bits) * tiles + (x >> bits)]
        green = _signed(p >> 8 & 255)
        red = (p >> 16 & 255) + (_signed(c & 255) * green >> 5) & 255
        blue = (p & 255) + (_signed(c >> 8 & 255) * green >> 5) + (_signed(c >> 16 & 255) * _signed(red) >> 5) & 255
        out.append(p & 0xFF00FF00 | red << 16 | blue)
    return out


def _undo_green(pixels: list[int]) -> list[int]:
    return [p & 0xFF00FF00 | ((p >> 16 & 255) + (p >> 8 & 255) & 255) << 16 | ((p & 255) + (p >> 8 & 255) & 255) for p in pixels]


def _undo_index(pixels: list[int], narrow: int, width: int, height: int, bits: int, colors: list[int]) -> list[int]:
    each = 8 >> bits
    mask, per = (1 << each) - 1, 1 << bits
    return [colors[(pixels[y * narrow + (x >> bits)] >> 8 & 255) >> each * (x & per - 1) & mask] for y in range(height) for x in range(width)]


def _stream(bits: _Bits, width: int, height: int, top: bool, depth: int = 0) -> list[int]:
    _require(depth <= 4, UNSUPPORTED)
    _require(width and height)
    _require(width * height <= MAX_PIXELS, BUDGET)
    undo, now, seen = [], width, set()
    while top and bits.read(1):
        kind = bits.read(2)
        _require(kind not in seen)
        seen.add(kind)
        if kind < 2:
            step = bits.read(3) + 2
            tiles = _stream(bits, _parts(now, step), _parts(height, step), False, depth + 1)
            undo.append((_undo_predictor if kind == 0 else _undo_cross, (now, height, step, tiles)))
        elif kind == 2:
            undo.append((_undo_green, ()))
        else:
            count = bits.read(8) + 1
            step = 0 if count > 16 else 1 if count > 4 else 2 if count > 2 else 3
            colors: list[int] = []
            for p in _stream(bits, count, 1, False, depth + 1):
                colors.append(_add(p, colors[-1]) if colors else p)
            _require(count <= 1 << (8 >> step))
            colors += [0] * ((1 << (8 >> step)) - count)
            undo.append((_undo_index, (_parts(now, step), now, height, step, colors)))
            now = _parts(now, step)
    pixels = _entropy_pixels(bits, now, height, top, depth)
    for how, given in reversed(undo):
        pixels = how(pixels, *given)
    return pixels


def decode_webp(data: bytes) -> np.ndarray:
    """A RIFF file with one lossless image; lossy images, animations and colour profiles aren't supported."""
    _require(len(data) >= 12 and data[:4] == b"RIFF" and data[8:12] == b"WEBP")
    size = struct.unpack_from("<I", data, 4)[0]
    _require(4 <= size <= len(data) - 8)
    end, at, image, foreign = 8 + size, 12, b"", False
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, at)
        _require(size <= end - at - 8)
        if name == b"VP8L":
            _require(not image)
            image = data[at + 8 : at + 8 + size]
        foreign = foreign or name in (b"VP8 ", b"ALPH", b"ANIM", b"ANMF", b"ICCP")
        at += 8 + size + (size & 1)
    _require(not foreign and image, UNSUPPORTED)
    _require(image[0] == 0x2F)
    bits = _Bits(image[1:])
    width, height, _ = bits.read(14) + 1, bits.read(14) + 1, bits.read(1)
    _require(bits.read(3) == 0, UNSUPPORTED)
    _check_size(width, height)
    argb = np.array(_stream(bits, width, height, True), np.uint32).reshape(height, width)
    return np.stack([argb >> 16 & 255, argb >> 8 & 255, argb & 255, argb >> 24], axis=-1).astype(np.uint8)
