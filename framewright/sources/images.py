"""Image bytes to pixels: the portable gray and colour maps (plain and raw) and 8-bit PNG, for scans of extracted frames."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np

#: Weights of red, green and blue in a gray value.
GRAY = (0.299, 0.587, 0.114)
#: Magic number, then width, height and largest value, with comments between.
HEAD = re.compile(rb"\s*P([2356])((?:\s+|#[^\n]*\n)+)(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s")
PNG = b"\x89PNG\r\n\x1a\n"


def gray(pixels: np.ndarray) -> np.ndarray:
    """Height x width whole numbers of an image with one to four channels; alpha is left out."""
    if pixels.shape[2] < 3:
        return pixels[:, :, 0].astype(np.int32)
    return np.floor(pixels[:, :, :3] @ np.array(GRAY) + 0.5).astype(np.int32)


def maps(data: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """The images of a file of portable maps, one after the other, each with the comments of its header."""
    at = 0
    while data[at:].strip():
        m = HEAD.match(data, at)
        if not m:
            raise ValueError("not a portable map")
        kind, width, height, most = m[1], int(m[3]), int(m[4]), int(m[5])
        channels = 3 if kind in b"36" else 1
        size, at = width * height * channels, m.end()
        if kind in b"23":
            end = data.find(b"P", at)  # there are only digits before the next one
            end = len(data) if end < 0 else end
            values, at = np.array(data[at:end].split()[:size], np.int64), end
        else:
            wide = np.dtype(">u2") if most > 255 else np.dtype("u1")
            values = np.frombuffer(data, wide, size, at).astype(np.int64)
            at += size * wide.itemsize
        if len(values) != size or (values > most).any():
            raise ValueError("the map is cut off or holds values that are too large")
        yield m[2].decode("ascii", "replace"), gray(values.reshape(height, width, channels))


def png(data: bytes) -> np.ndarray:
    """An 8-bit image without interlacing: gray or colour, with or without alpha."""
    at, head, packed = len(PNG), None, []
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[6]:
        raise ValueError("not an 8-bit image without interlacing")
    width, height, channels = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height + 1, width + 1, channels), np.int64)  # with a line above and a pixel to the left
    for y in range(height):
        rule, line, row, above = int(lines[y, 0]), lines[y, 1:].reshape(width, channels).astype(np.int64), out[y + 1], out[y]
        if rule in (0, 2):
            row[1:] = (line + above[1:] * (rule == 2)) & 255
        elif rule == 1:
            row[1:] = np.cumsum(line, 0) & 255
        elif rule in (3, 4):
            for x in range(width):
                left, up, corner = row[x], above[x + 1], above[x]
                if rule == 3:
                    guess = (left + up) // 2
                else:
                    d = np.abs(np.stack([up - corner, left - corner, left + up - 2 * corner]))
                    guess = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], up, corner))
                row[x + 1] = (line[x] + guess) & 255
        else:
            raise ValueError("unknown filter")
    return gray(out[1:, 1:])


def images_of(data: bytes) -> list[tuple[str, np.ndarray]]:
    """The images of a file, each with its comments."""
    return [("", png(data))] if data.startswith(PNG) else list(maps(data))
