"""Small encoders for the files that the decoding queries read: PNG of all filters, baseline JPEG of flat blocks, literal WebP."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from tessera.sources.decode import LENGTH_ORDER


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def png(image: np.ndarray) -> bytes:
    """RGBA rows, filtered by all five kinds in turn."""
    h, w, step = image.shape
    row = image.reshape(h, w * step).astype(np.int64)
    above = np.vstack([np.zeros((1, w * step), np.int64), row[:-1]])
    shift = lambda x: np.hstack([np.zeros((h, step), np.int64), x[:, :-step]])
    left, corner = shift(row), shift(above)
    guess = left + above - corner
    far = [np.abs(guess - x) for x in (left, above, corner)]
    paeth = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], above, corner))
    kinds = np.arange(h) % 5
    sent = row - np.choose(kinds[:, None], [0 * row, left, above, (left + above) // 2, paeth])
    raw = np.hstack([kinds[:, None], sent % 256]).astype(np.uint8).tobytes()
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw)) + _chunk(b"IEND", b"")


def jpeg(blocks: np.ndarray) -> bytes:
    """Blocks (rows, columns, components) of one value each; all quantisers are 1, codes of equal length."""
    rows, columns, n = blocks.shape
    out = b"\xff\xd8\xff\xdb" + struct.pack(">HB", 67, 0) + b"\1" * 64
    out += b"\xff\xc0" + struct.pack(">HBHHB", 8 + 3 * n, 8, 8 * rows, 8 * columns, n) + b"".join(bytes([k + 1, 0x11, 0]) for k in range(n))
    out += b"\xff\xc4" + struct.pack(">HB", 31, 0) + bytes([0] * 3 + [12] + [0] * 12) + bytes(range(12))  # sizes of differences: 4 bits
    out += b"\xff\xc4" + struct.pack(">HB", 20, 0x10) + bytes([1] + [0] * 15) + b"\0"  # the end of a block: one bit
    out += b"\xff\xda" + struct.pack(">HB", 6 + 2 * n, n) + b"".join(bytes([k + 1, 0]) for k in range(n)) + b"\0\x3f\0"
    bits, last = [], [0] * n
    for value in blocks.reshape(-1, n).tolist():
        for k, v in enumerate(value):
            step, last[k] = 8 * (v - 128) - last[k], 8 * (v - 128)
            size = abs(step).bit_length()
            code = step if step >= 0 else step + (1 << size) - 1
            bits.append(f"{size:04b}" + (f"{code:0{size}b}" if size else "") + "0")
    text = "".join(bits)
    text += "1" * (-len(text) % 8)
    return out + int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\0") + b"\xff\xd9"


def webp(image: np.ndarray) -> bytes:
    """Lossless, without transforms; every pixel a literal of four codes of eight bits."""
    h, w, _ = image.shape
    put = lambda value, count: [value >> i & 1 for i in range(count)]

    def flat(size: int) -> list[int]:
        """A code with 256 symbols of eight bits each, the rest unused."""
        lengths = [bit for k in LENGTH_ORDER for bit in put(1 if k in (0, 8) else 0, 3)]
        return [0, *put(15, 4), *lengths, 0, *[int(s < 256) for s in range(size)]]

    single = [1, 0, 1, *put(0, 8)]
    bits = [*put(w - 1, 14), *put(h - 1, 14), 1, *put(0, 3), 0, 0, 0, *flat(280), *flat(256), *flat(256), *flat(256), *single]
    pixels = np.unpackbits(np.ascontiguousarray(image[..., [1, 0, 2, 3]]).ravel())  # a code is sent from its highest bit on
    body = b"\x2f" + np.packbits(np.concatenate([np.array(bits, np.uint8), pixels]), bitorder="little").tobytes()
    inner = b"WEBPVP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", len(inner)) + inner
