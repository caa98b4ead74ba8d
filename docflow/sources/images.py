"""Page images to normalised tiles: one output row per tile, so memory stays bounded."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from docflow.operators.geometry import TILE, resize_plan
from docflow.sources.pdf import png_extent, read_png, write_png

# Fixed values of the resampler: fixed-point bits and the filter's half width.
FIXED_BITS, LOBES = 22, 3
TILES = "image_id long, tile int, row int, col int, rows int, cols int, values array<float>, error string"


def weights(size: int, wanted: int) -> np.ndarray:
    """Rows of Lanczos weights as ``_weights`` has them; small ones (128 KB) are kept for the next image of the same size."""
    return _kept_weights(size, wanted) if size * wanted <= 1 << 14 else _weights(size, wanted)


def _weights(size: int, wanted: int) -> np.ndarray:
    """Rows of integer Lanczos weights, one per output position, over all input positions."""
    ratio = size / wanted
    stretch = max(1.0, ratio)
    reach = LOBES * stretch
    out = np.zeros((wanted, size))
    for i in range(wanted):
        middle = (i + 0.5) * ratio
        first = max(0, int(middle - reach + 0.5))
        last = min(size, int(middle + reach + 0.5))
        x = (np.arange(first, last) - middle + 0.5) * (1.0 / stretch)
        window = np.where((x >= -LOBES) & (x < LOBES), np.sinc(x) * np.sinc(x / LOBES), 0.0)
        total = window.sum()
        share = window / total if total else window
        out[i, first:last] = np.trunc(share * (1 << FIXED_BITS) + np.where(share < 0, -0.5, 0.5))
    return out


_kept_weights = lru_cache(256)(_weights)


def _along(pixels: np.ndarray, wanted: int, axis: int) -> np.ndarray:
    """Resample one axis; sums of integers below 2**53 are exact as doubles."""
    if pixels.shape[axis] == wanted:
        return pixels
    moved = np.moveaxis(pixels, axis, 0).astype(np.float64)
    sums = np.tensordot(weights(pixels.shape[axis], wanted), moved, axes=1) + (1 << (FIXED_BITS - 1))
    clipped = np.clip(np.floor(np.maximum(sums, 0) / (1 << FIXED_BITS)), 0, 255).astype(np.uint8)
    return np.ascontiguousarray(np.moveaxis(clipped, 0, axis))


def resize(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """(h, w, 3) resampled, first along rows and then along columns."""
    return _along(_along(pixels, width, 1), height, 0)


_VALUES = ((np.arange(256) * (1.0 / 255.0)).astype(np.float32) - np.float32(0.5)) / np.float32(0.5)


def normalise(tile: np.ndarray) -> np.ndarray:
    """Channel, row, column order, -1 to 1 in single precision."""
    return _VALUES[np.moveaxis(tile, 2, 0)].reshape(-1)


def tiles(pixels: np.ndarray, sizes: dict) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, col, values) of every tile by the sizes of ``geometry.resize_plan``, the whole image last (row and col 0)."""
    second = resize(resize(pixels, sizes["w1"], sizes["h1"]), sizes["w2"], sizes["h2"])
    for r in range(sizes["rows"]):
        for c in range(sizes["cols"]):
            yield r + 1, c + 1, normalise(second[r * TILE : (r + 1) * TILE, c * TILE : (c + 1) * TILE])
    whole = resize(second, TILE, TILE) if sizes["rows"] else second[:TILE, :TILE]
    yield 0, 0, normalise(whole)


def preprocess(images: DataFrame) -> DataFrame:
    """Rows of (image_id, content) to one row per tile; an unreadable image is one row with its error.

    Sizes are planned by columns from the header; pixels are read where they are resized.
    """
    extent = png_extent(F.col("content"))
    rows = images.select("image_id", "content", extent.alias("e")).select("image_id", "content", resize_plan(F.col("e.height"), F.col("e.width")).alias("plan"))
    target = to_arrow_schema(T.StructType.fromDDL(TILES))

    def out(*row) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, target)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    pixels = read_png(row["content"])
                except Exception as e:  # noqa: BLE001
                    yield out(row["image_id"], None, None, None, None, None, None, str(e)[:200])
                    continue
                grid = row["plan"]["rows"], row["plan"]["cols"]
                for i, (r, c, values) in enumerate(tiles(pixels, row["plan"])):
                    yield out(row["image_id"], i, r, c, *grid, values, None)

    return rows.mapInArrow(run, TILES)


def crop_picture(content: bytes, box: tuple[int, int, int, int], grid: int = 500) -> bytes:
    """The PNG of a grid box of a page; a box that is empty in source pixels is refused."""
    pixels = read_png(content)
    h, w = pixels.shape[:2]
    left, right = box[0] * w // grid, box[2] * w // grid
    top, bottom = box[1] * h // grid, box[3] * h // grid
    if left >= right or top >= bottom:
        raise ValueError("empty crop")
    return write_png(pixels[top:bottom, left:right])


PIXELS = "height int, width int, pixels binary, error string"


def _udf(kind, f):
    """An Arrow UDF of a function of one row's values; nulls in any of them give null."""

    @F.arrow_udf(kind)
    def run(*columns: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in columns))
        return pa.array([None if any(v is None for v in row) else f(*row) for row in rows], to_arrow_type(kind))

    return run


def png_column(pixels: Column, height: Column, width: Column) -> Column:
    """A PNG of height * width * 3 bytes of pixels, null where their number doesn't fit."""

    def write(data, h, w):
        return write_png(np.frombuffer(data, np.uint8).reshape(h, w, 3)) if h > 0 and w > 0 and len(data) == h * w * 3 else None

    return _udf(T.BinaryType(), write)(pixels, height.cast("int"), width.cast("int"))


def pixels_column(content: Column) -> Column:
    """struct(height, width, pixels, error) of a PNG."""

    def read(data):
        try:
            found = read_png(bytes(data))
        except Exception as e:  # noqa: BLE001
            return {"height": None, "width": None, "pixels": None, "error": str(e)[:200]}
        return {"height": found.shape[0], "width": found.shape[1], "pixels": found.tobytes(), "error": None}

    return _udf(T.StructType.fromDDL(PIXELS), read)(content)


def crop_column(content: Column, box: Column) -> Column:
    """The PNG of a grid box (array of l, t, r, b) of a page, null where the box is empty in source pixels."""

    def crop(data, own):
        try:
            return crop_picture(bytes(data), tuple(own))
        except ValueError:
            return None

    return _udf(T.BinaryType(), crop)(content, box.cast("array<int>"))


def resize_column(content: Column, height: Column, width: Column) -> Column:
    """The PNG of an image resampled to a height and width."""

    def scale(data, h, w):
        return write_png(resize(read_png(bytes(data)), w, h))

    return _udf(T.BinaryType(), scale)(content, height.cast("int"), width.cast("int"))
