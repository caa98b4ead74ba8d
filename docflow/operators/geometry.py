"""Boxes, image plans and array layouts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docflow.functions.bound import bound

GRID, LONGEST_EDGE, TILE, SLOTS = 500, 2048, 512, 64


def to_grid(value: Column, size: Column) -> Column:
    """A pixel coordinate on the 500 grid: half-even, at most 499."""
    return F.least(F.rint(F.lit(float(GRID)) * (value.cast("double") / size)), F.lit(GRID - 1.0)).cast("int")


def box_to_grid(l: Column, t: Column, r: Column, b: Column, w: Column, h: Column) -> Column:  # noqa: E741
    """Grid box, or null for an inverted or outside one; nothing is clipped."""
    fine = (l >= 0) & (l <= r) & (r <= w) & (t >= 0) & (t <= b) & (b <= h)
    return F.when(fine, F.array(to_grid(l, w), to_grid(t, h), to_grid(r, w), to_grid(b, h)))


_LOC = "<loc_[0-9]{1,5}>"


def convert_locations(raw: Column, width: Column, height: Column) -> Column:
    """Tagged text in pixel coordinates on the grid: struct(raw, boxes, error), raw null with an error.

    Locations must come in runs of exactly four that form a box within the image;
    nothing is clipped or repaired, and only location tokens change.
    """
    box = f"(?:{_LOC}){{4}}"
    rest = F.split(raw, box, -1)
    boxes = F.regexp_extract_all(raw, F.lit(f"({box})"), F.lit(1))
    runs = F.regexp_extract_all(raw, F.lit(f"((?:{_LOC})+)"), F.lit(1))
    numbers = F.transform(
        boxes, lambda b: F.transform(F.regexp_extract_all(b, F.lit("<loc_([0-9]+)>"), F.lit(1)), lambda n: n.cast("int"))
    )
    grids = F.transform(numbers, lambda n: box_to_grid(n[0], n[1], n[2], n[3], width, height))
    written = F.transform(grids, lambda g: F.array_join(F.transform(g, lambda v: F.concat(F.lit("<loc_"), v.cast("string"), F.lit(">"))), ""))
    known = width.between(1, 20000) & height.between(1, 20000)
    error = (
        F.when(~F.coalesce(known, F.lit(False)), "image size")
        .when(raw.isNull() | (raw == "") | (F.octet_length(raw) > 2_000_000), "target")
        .when(F.exists(rest, lambda x: F.contains(x, F.lit("<loc_"))), "orphan location")
        .when(F.exists(runs, lambda x: F.regexp_count(x, F.lit("<loc_")) != 4), "location count")
        .when(F.exists(grids, lambda g: g.isNull()), "box")
    )
    text = F.concat(F.array_join(F.zip_with(F.slice(rest, 1, F.size(written)), written, lambda a, b: F.concat(a, b)), ""), F.element_at(rest, -1))
    return F.struct(F.when(error.isNull(), text).alias("raw"), F.size(boxes).alias("boxes"), error.alias("error"))


def without_locations(raw: Column) -> Column:
    return F.regexp_replace(raw, "<loc_[0-9]+>", "")


def audit_locations(raw: Column, width: Column, height: Column) -> Column:
    """A label's conversion with proof: digests before, after and without locations, and whether only those changed."""
    done = convert_locations(raw, width, height)
    return F.struct(
        F.sha2(raw, 256).alias("original_sha256"),
        F.sha2(done["raw"], 256).alias("converted_sha256"),
        F.sha2(without_locations(raw), 256).alias("content_sha256"),
        F.coalesce(without_locations(raw) == without_locations(done["raw"]), F.lit(False)).alias("content_kept"),
        done["boxes"].alias("boxes"),
        done["error"].alias("error"),
    )


def crop(value: Column, size: Column) -> Column:
    """A grid coordinate in source pixels."""
    return F.floor(value * size / GRID).cast("int")


def resize_plan(height: Column, width: Column) -> Column:
    """First and second size and the tile grid (0 by 0 where one tile is enough)."""
    ratio = width.cast("double") / height
    wide = width >= height
    w1 = F.when(wide, F.lit(LONGEST_EDGE)).otherwise(F.floor(F.lit(float(LONGEST_EDGE)) * ratio)).cast("int")
    h1 = F.when(wide, F.floor(F.lit(float(LONGEST_EDGE)) / ratio)).otherwise(F.lit(LONGEST_EDGE)).cast("int")
    even = lambda x: x + x % 2
    h1, w1 = F.when(w1 == LONGEST_EDGE, even(h1)).otherwise(h1), F.when(w1 == LONGEST_EDGE, w1).otherwise(even(w1))
    h1, w1 = F.greatest(h1, F.lit(1)), F.greatest(w1, F.lit(1))
    ratio = w1.cast("double") / h1
    up = lambda x: (F.lit(TILE) * F.ceil(x.cast("double") / TILE)).cast("int")
    w2 = F.when(w1 >= h1, up(w1)).otherwise(up(F.floor(up(h1) * ratio)))
    h2 = F.when(w1 >= h1, up(F.floor(up(w1) / ratio))).otherwise(up(h1))
    split = (h2 > TILE) | (w2 > TILE)
    tiles = lambda x: F.when(split, (x / TILE).cast("int")).otherwise(F.lit(0))
    return F.struct(
        h1.cast("int").alias("h1"), w1.cast("int").alias("w1"), h2.alias("h2"), w2.alias("w2"), tiles(h2).alias("rows"), tiles(w2).alias("cols")
    )


def image_prompt(rows: Column, cols: Column, slots: int = SLOTS) -> Column:
    """Markers of all tiles row by row, and of the global image."""
    images = F.repeat(F.lit("<image>"), F.lit(slots))
    tile = lambda r, c: F.concat(F.lit("<fake_token_around_image><row_"), r.cast("string"), F.lit("_col_"), c.cast("string"), F.lit(">"), images)
    line = lambda r: F.concat(F.array_join(F.transform(F.sequence(F.lit(1), cols), lambda c: tile(r, c)), ""), F.lit("\n"))
    grid = F.when(rows > 0, F.concat(F.array_join(F.transform(F.sequence(F.lit(1), rows), line), ""), F.lit("\n"))).otherwise("")
    return F.concat(grid, F.lit("<fake_token_around_image><global-img>"), images, F.lit("<fake_token_around_image>"))


def layout(size: Column, patch: Column, factor: Column, hidden: Column) -> Column:
    """struct(patches, tokens, connector_width) of an image side; null where the sides don't divide."""
    side = F.try_divide(size, patch).cast("int")
    fine = (patch > 0) & (factor > 0) & (hidden > 0) & (size > 0) & (size % patch == 0) & (side % factor == 0)
    tokens = F.try_divide(side, factor).cast("int")
    return F.when(
        fine,
        F.struct((side * side).alias("patches"), (tokens * tokens).alias("tokens"), (hidden * factor * factor).alias("connector_width")),
    )


def gather(values: Column, places: list[int]) -> Column:
    """values at the given places, in order."""
    where = F.array(*[F.lit(i) for i in places])
    return F.transform(where, lambda i: F.element_at(values, i + 1))


def patchify(values: Column, channels: int, height: int, width: int, patch: int) -> Column:
    """Row-major (channels, height, width) as patches, each ordered channel, row, column."""
    if height % patch or width % patch:
        raise ValueError("sides must be multiples of the patch")
    places = [
        (c * height + y * patch + dy) * width + x * patch + dx
        for y in range(height // patch)
        for x in range(width // patch)
        for c in range(channels)
        for dy in range(patch)
        for dx in range(patch)
    ]
    return gather(values, places)


def pixel_shuffle(values: Column, side: int, channels: int, factor: int) -> Column:
    """(side * side, channels) features with each factor-by-factor square moved into channels."""
    if side % factor:
        raise ValueError("side must be a multiple of the factor")
    n = side // factor
    places = [
        ((y * factor + dy) * side + x * factor + dx) * channels + c
        for y in range(n)
        for x in range(n)
        for dy in range(factor)
        for dx in range(factor)
        for c in range(channels)
    ]
    return gather(values, places)


def mask_positions(mask: Column, side: int) -> Column:
    """Bucket positions of a side-by-side patch mask, null unless it's a filled top-left rectangle.

    A coordinate's fraction of its extent is compared with the grid's fractions in single precision.
    """
    at = lambda y, x: F.element_at(mask, F.lit(1) + y * side + x)
    line = F.sequence(F.lit(0), F.lit(side - 1))
    height = F.size(F.filter(line, lambda y: at(y, F.lit(0)) == 1))
    width = F.size(F.filter(line, lambda x: at(F.lit(0), x) == 1))
    fractions = F.array(*[(F.lit(float(i)).cast("float") / F.lit(side)).cast("float") for i in range(1, side)])

    def bucket(place: Column, extent: Column) -> Column:
        part = (place.cast("float") * (F.lit(1.0).cast("float") / extent).cast("float")).cast("float")
        return F.size(F.filter(fractions, lambda f: part >= f))

    slots = F.array(*[F.struct(F.lit(i // side).alias("y"), F.lit(i % side).alias("x"), F.lit(i + 1).alias("at")) for i in range(side * side)])
    inside = lambda s, h, w: (s["y"] < h) & (s["x"] < w)

    def placed(h: Column, w: Column) -> Column:
        """Positions by the buckets of all rows and columns, of which there are a side each."""
        good = (F.size(mask) == side * side) & (h > 0) & (w > 0) & F.forall(slots, lambda s: inside(s, h, w) == (F.element_at(mask, s["at"]) == 1))
        buckets = F.struct(F.transform(line, lambda i: bucket(i, h)).alias("y"), F.transform(line, lambda i: bucket(i, w)).alias("x"))
        place = lambda s, b: F.when(inside(s, h, w), F.get(b["y"], s["y"]) * side + F.get(b["x"], s["x"])).otherwise(0).cast("int")
        return F.when(good, bound(buckets, lambda b: F.transform(slots, lambda s: place(s, b))))

    return bound(F.struct(height.alias("h"), width.alias("w")), lambda x: placed(x["h"], x["w"]))
