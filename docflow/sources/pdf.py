"""Contracts of page sources: PDF metadata text, page selections, PNG headers and pixels.

Rasterising needs an external program and stays a port; what is text or array
work is done here.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_PAGES, LAST_PAGE = 16, 100_000
MAX_EDGE, MAX_PIXELS = 16384, 1 << 24


def snapshot(content: Column, most: int) -> Column:
    """A PDF's bytes, null for other files and for more than ``most`` bytes."""
    fine = (F.substring(content, 1, 5) == F.lit(b"%PDF-")) & (F.octet_length(content) <= most)
    return F.when(fine, content)


def page_geometry(text: Column, page: int) -> Column:
    """struct(width, height, rotation) from metadata text, null unless exactly one valid size and rotation."""
    number = r"([0-9]{1,9}(?:\.[0-9]{1,9})?)"
    head = rf"(?m)^[ \t]*Page[ \t]+{page}[ \t]+"
    size = head + rf"size:[ \t]+{number}[ \t]+x[ \t]+{number}[ \t]+pts(?:[ \t]+\([A-Za-z0-9]+\))?[ \t]*\r?$"
    sizes = F.regexp_count(text, F.lit(head + "size:"))
    rotations = F.regexp_extract_all(text, F.lit(head + r"rot:[ \t]+([0-9]+)[ \t]*\r?$"), F.lit(1))
    w = F.regexp_extract(text, size, 1).try_cast("decimal(20,9)")
    h = F.regexp_extract(text, size, 2).try_cast("decimal(20,9)")
    rotation = F.get(rotations, F.lit(0))
    fine = (sizes == 1) & (F.size(rotations) == 1) & rotation.isin("0", "90", "180", "270") & (w > 0) & (h > 0)
    return F.when(fine, F.struct(w.alias("width"), h.alias("height"), rotation.cast("int").alias("rotation")))


def raster_size(points: Column, dpi: int) -> Column:
    """Pixels of a side, rounded up."""
    return F.ceil(points * dpi / 72).cast("int")


def page_selection(text: Column) -> Column:
    """``1,3-5`` as an array of pages; null if the grammar, the order or the count is broken."""
    parts = F.split(text, ",", -1)
    grammar = text.rlike(r"\A[1-9][0-9]{0,5}(?:-[1-9][0-9]{0,5})?(?:,[1-9][0-9]{0,5}(?:-[1-9][0-9]{0,5})?)*\z")

    def bounds(part: Column) -> Column:
        ends = F.transform(F.split(part, "-", -1), lambda x: x.try_cast("int"))
        return F.struct(F.get(ends, F.lit(0)).alias("a"), F.element_at(ends, -1).alias("b"))

    ranges = F.transform(parts, bounds)
    sized = F.forall(ranges, lambda x: (x["a"] <= x["b"]) & (x["b"] - x["a"] < MAX_PAGES) & (x["b"] <= LAST_PAGE))
    pages = F.flatten(F.transform(ranges, lambda x: F.sequence(x["a"], x["b"])))
    rising = F.forall(F.sequence(F.lit(0), F.size(pages) - 2), lambda i: F.get(pages, i) < F.get(pages, i + 1))
    return F.when(grammar, F.when(sized, F.when((F.size(pages) <= MAX_PAGES) & ((F.size(pages) < 2) | rising), pages)))


def png_extent(content: Column) -> Column:
    """struct(width, height) by the header of any PNG, else null."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    head = F.substring(content, 1, 16) == F.lit(b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR")
    return F.when(head, F.struct(number(17).alias("width"), number(21).alias("height")))


def png_size(content: Column) -> Column:
    """struct(width, height) of an 8-bit RGB, not interlaced PNG by its header, else null."""
    return F.when(F.substring(content, 25, 5) == F.lit(b"\x08\x02\x00\x00\x00"), png_extent(content))


def read_png(data: bytes) -> np.ndarray:
    """Pixels (height, width, 3) of an 8-bit gray, gray-alpha, RGB or RGBA PNG; alpha is dropped.

    Animated, interlaced, damaged or too large files are rejected.
    """
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, head = 8, [], None
    while at + 12 <= len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(part) < size or zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged chunk")
        if kind == b"acTL":
            raise ValueError("animated")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
        at += 12 + size
    else:
        raise ValueError("no end chunk")
    if head is None:
        raise ValueError("no header")
    w, h, depth, colour, _, _, interlace = head
    depths = {0: 1, 4: 2, 2: 3, 6: 4}
    if depth != 8 or colour not in depths or interlace or not (0 < w <= MAX_EDGE and 0 < h <= MAX_EDGE) or w * h > MAX_PIXELS:
        raise ValueError("unsupported format")
    n = depths[colour]
    stride = w * n
    raw = zlib.decompressobj().decompress(b"".join(body), (stride + 1) * h + 1)
    if len(raw) != (stride + 1) * h:
        raise ValueError("wrong size")
    lines = np.frombuffer(raw, dtype=np.uint8).reshape(h, stride + 1)
    out = np.zeros((h, stride), dtype=np.uint8)
    above = np.zeros(stride, dtype=np.uint8)
    for y in range(h):
        above = out[y] = _unfilter(int(lines[y, 0]), lines[y, 1:], above, n)
    pixels = out.reshape(h, w, n)
    return np.repeat(pixels[:, :, :1], 3, axis=2) if n < 3 else pixels[:, :, :3].copy()


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, n), axis=0, dtype=np.uint8).reshape(-1)
    if kind not in (3, 4):
        raise ValueError("unknown filter")
    out, up = [0] * n + line.tolist(), [0] * n + above.tolist()
    for i in range(n, len(out)):
        a, b, c = out[i - n], up[i], up[i - n]
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[i] = (out[i] + guess) & 255
    return np.array(out[n:], dtype=np.uint8)


def write_png(pixels: np.ndarray) -> bytes:
    """An RGB image (height, width, 3) as a PNG without filters."""
    h, w, _ = pixels.shape
    lines = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, w * 3).astype(np.uint8)], axis=1)
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")
