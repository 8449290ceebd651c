"""Pixels of PNG files in numpy and zlib: decoding, cropping, resampling, a perceptual hash. One image at a time, inside a task.

Colours of 1 to 16 bits, grey, palettes and alpha become 8-bit RGB; alpha is left out. Interlaced and damaged files raise ValueError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Weights of red, green and blue in a grey value, out of 65536; bits of a resampling weight; grid of the hash.
LUMA, WEIGHT_BITS, GRID = (19595, 38470, 7471), 22, (9, 8)


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("cut chunk")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError("chunk checksum")
        yield kind, body
        at += 12 + size


def _unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Bytes of scan lines without their filters. A byte depends on its left, upper and upper left neighbours, which lie on the two
    diagonals before its own: whole diagonals are settled at once."""
    kinds, raw = lines[:, 0], lines[:, 1:]
    if (kinds > 4).any():
        raise ValueError("unknown filter")
    if not kinds.any():
        return raw
    height, width = raw.shape[0], raw.shape[1] // step
    raw = raw.reshape(height, width, step).astype(np.int32)
    out = np.zeros((height + 1, width + 1, step), np.int32)  # a row above and a column to the left, of zeros
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        a, b, c, kind = out[y + 1, x], out[y, x + 1], out[y, x], kinds[y][:, None]
        p = a + b - c
        near = np.where((abs(p - a) <= abs(p - b)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - b) <= abs(p - c), b, c))
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [a, b, (a + b) >> 1, near], 0)
        out[y + 1, x + 1] = (raw[y, x] + guess) & 255
    return out[1:, 1:].reshape(height, -1).astype(np.uint8)


def decoded(data: bytes) -> SimpleNamespace:
    """rgb (height x width x 3, uint8) and the bodies of `pHYs` and `iCCP` where they are there."""
    head, packed, palette, kept = None, [], None, {}
    for kind, body in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">2I5B", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind in (b"pHYs", b"iCCP"):
            kept[kind] = body
    if head is None or head[3] not in CHANNELS or (head[3] == 3 and palette is None):
        raise ValueError("no sound header")
    width, height, depth, colour, _, _, laced = head
    if laced:
        raise ValueError("interlaced")
    n = CHANNELS[colour]
    line = (width * depth * n + 7) // 8
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as e:
        raise ValueError("image data") from e
    if not width or not height or lines.size != height * (line + 1):
        raise ValueError("image data size")
    flat = _unfiltered(lines.reshape(height, line + 1), max(1, depth * n // 8))
    if depth == 16:
        flat = flat[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(flat, axis=1).reshape(height, -1, depth)
        flat = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[:, :width]
        if colour == 0:
            flat = flat * np.uint8(255 // ((1 << depth) - 1))
    pixels = flat.reshape(height, width, n)
    if colour == 3:
        if pixels.max() >= len(palette):
            raise ValueError("palette")
        rgb = palette[pixels[:, :, 0]]
    else:
        rgb = pixels[:, :, :3] if n >= 3 else np.repeat(pixels[:, :, :1], 3, 2)
    return SimpleNamespace(rgb=np.ascontiguousarray(rgb), kept=kept)


def encoded(rgb: np.ndarray, kept: dict[bytes, bytes] | None = None) -> bytes:
    """A PNG of 8-bit RGB, each line as differences to the line above."""
    height, width, _ = rgb.shape
    flat = rgb.reshape(height, -1)
    up = flat.copy()
    up[1:] -= flat[:-1]
    body = zlib.compress(np.hstack([np.full((height, 1), 2, np.uint8), up]).tobytes(), 6)
    parts = [(b"IHDR", struct.pack(">2I5B", width, height, 8, 2, 0, 0, 0)), *(kept or {}).items(), (b"IDAT", body), (b"IEND", b"")]
    return SIGNATURE + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in parts)


def crop(data: bytes, bbox: tuple[float, float, float, float], dpi: int = 300) -> bytes:
    """K4: the part of a PNG inside a box of fractions, as a PNG at `dpi` with the image's colour profile; what lies outside the image is black."""
    image = decoded(data)
    height, width, _ = image.rgb.shape
    x0, y0, x1, y1 = (round(v * n) for v, n in zip(bbox, (width, height, width, height), strict=True))
    if x1 <= x0 or y1 <= y0:
        raise ValueError("empty box")
    out = np.zeros((y1 - y0, x1 - x0, 3), np.uint8)
    inside = image.rgb[max(y0, 0) : max(y1, 0), max(x0, 0) : max(x1, 0)]
    top, left = max(-y0, 0), max(-x0, 0)
    out[top : top + inside.shape[0], left : left + inside.shape[1]] = inside
    per_metre = round(dpi / 0.0254)
    profile = {k: v for k, v in image.kept.items() if k == b"iCCP"}
    return encoded(out, profile | {b"pHYs": struct.pack(">2IB", per_metre, per_metre, 1)})


def weights(size: int, wanted: int) -> np.ndarray:
    """A `size` x `wanted` matrix of windowed sinc weights (three lobes), each column a whole number of 2**WEIGHT_BITS in all, but for rounding."""
    scale = size / wanted
    wide = max(scale, 1.0)
    centre = (np.arange(wanted) + 0.5) * scale
    first, last = np.maximum((centre - 3 * wide + 0.5).astype(int), 0), np.minimum((centre + 3 * wide + 0.5).astype(int), size)
    x = np.arange(size)[:, None]
    t = (x - centre + 0.5) / wide
    w = np.where((x >= first) & (x < last) & (abs(t) < 3), np.sinc(t) * np.sinc(t / 3), 0.0)
    w /= w.sum(axis=0)
    return np.trunc(w * (1 << WEIGHT_BITS) + np.copysign(0.5, w))


def _product(rows: np.ndarray, w: np.ndarray) -> np.ndarray:
    sums = rows.astype(np.float64) @ w  # whole numbers far below 2**53: exact
    return np.clip(np.floor((sums + (1 << (WEIGHT_BITS - 1))) / (1 << WEIGHT_BITS)), 0, 255)


def resampled(grey: np.ndarray, width: int, height: int) -> np.ndarray:
    """A grey image at another size: along the rows first, then along the columns, each in 8 bits."""
    across = _product(grey, weights(grey.shape[1], width))
    return _product(across.T, weights(grey.shape[0], height)).T.astype(np.uint8)


def grey(rgb: np.ndarray) -> np.ndarray:
    return ((rgb.astype(np.uint32) @ np.array(LUMA, np.uint32) + 0x8000) >> 16).astype(np.uint8)


def perceptual_hash(rgb: np.ndarray) -> str:
    """16 hex digits; bit row * 8 + column is set where a cell of the 9 x 8 grid is larger than its right neighbour."""
    cells = resampled(grey(rgb), *GRID)
    bits = (cells[:, :-1] > cells[:, 1:]).ravel()
    return np.packbits(bits, bitorder="little")[::-1].tobytes().hex()
