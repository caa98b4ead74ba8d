"""Builders of tagged text, the inverse of parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docflow.operators import geometry

NOT_BLANK = r"[^ \t\n\r\f]"


def leaf(tag: str, text: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>"), text, F.lit(f"</{tag}>"))


def page(body: Column) -> Column:
    return F.concat(F.lit("<doctag>"), body, F.lit("</doctag>"))


def text_page(text: Column) -> Column:
    """A text element for each line that isn't blank."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(NOT_BLANK))
    return page(F.array_join(F.transform(lines, lambda x: leaf("text", x)), ""))


#: Tags that a reviewed target may have, fixed.
TARGET_TAGS = ("text", "page_header", "page_footer", "section_header_level_1")


def target_valid(text: Column) -> Column:
    """A reviewed text isn't blank and holds no markup, complete entity or control character."""
    bad = r"[<>]|&#?[\p{L}\p{N}_]+;|[\x00-\x1F]"
    return F.coalesce(text.rlike(r"[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]") & ~text.rlike(bad), F.lit(False))


def make_target(elements: Column, most: int = 100, tags: tuple = TARGET_TAGS) -> Column:
    """A page of reviewed (tag, text) pairs; null if one is unfit or their number isn't 1 to ``most``."""
    good = F.size(elements).between(1, most) & F.forall(elements, lambda e: e["tag"].isin(*tags) & target_valid(e["text"]))
    body = F.transform(elements, lambda e: F.concat(F.lit("<"), e["tag"], F.lit(">"), e["text"], F.lit("</"), e["tag"], F.lit(">")))
    made = page(F.array_join(body, ""))
    return F.when(F.coalesce(good, F.lit(False)) & (F.octet_length(made) <= 2_000_000), made)


def make_reference(elements: Column, box: Column, width: Column, height: Column, tags: tuple = TARGET_TAGS) -> Column:
    """A page of reviewed pairs with one picture in its place: the pair of tag ``picture`` and a null text.

    ``box`` (l, t, r, b) is in pixels and not empty; it's put on the grid.
    """
    single = F.size(F.filter(elements, lambda e: e["tag"] == "picture")) == 1
    good = single & F.forall(
        elements, lambda e: F.when(e["tag"] == "picture", e["text"].isNull()).otherwise(e["tag"].isin(*tags) & target_valid(e["text"]))
    )
    grid = geometry.box_to_grid(box["l"], box["t"], box["r"], box["b"], width, height)
    filled = (box["l"] < box["r"]) & (box["t"] < box["b"]) & grid.isNotNull()
    spots = F.array_join(F.transform(grid, lambda v: F.concat(F.lit("<loc_"), v.cast("string"), F.lit(">"))), "")
    body = F.transform(
        elements, lambda e: F.concat(F.lit("<"), e["tag"], F.lit(">"), F.coalesce(e["text"], spots), F.lit("</"), e["tag"], F.lit(">"))
    )
    return F.when(F.coalesce(good & filled, F.lit(False)), page(F.array_join(body, "")))


def picture_record(line: Column) -> Column:
    """One exported picture's tab-separated record as a struct; null where it is malformed."""
    fields = F.split(line, "\t", -1)
    location = F.transform(F.split(fields[1], ",", -1), lambda v: v.try_cast("int"))
    width, height = fields[3].try_cast("int"), fields[4].try_cast("int")
    fine = (
        (F.size(fields) == 6) & (fields[0] == "PICTURE") & (F.size(location) == 4)
        & F.forall(location, lambda v: v.between(0, 499)) & width.isNotNull() & height.isNotNull()
    )
    return F.when(
        F.coalesce(fine, F.lit(False)),
        F.struct(
            location.alias("location"),
            F.nullif(fields[2], F.lit("none")).alias("classification"),
            F.array(width, height).alias("size"),
            F.when(fields[5] == "", F.array().cast("array<string>")).otherwise(F.split(fields[5], ",", -1)).alias("signature"),
        ),
    )


def otsl(rows: Column) -> Column:
    """A table page from an array of rows, each an array of marker-and-text strings."""
    body = F.array_join(F.transform(rows, lambda r: F.concat(F.array_join(r, ""), F.lit("<nl>"))), "")
    return page(F.concat(F.lit("<otsl>"), body, F.lit("</otsl>")))


def cell(marker: str, text: Column | None = None) -> Column:
    return F.lit(f"<{marker}>") if text is None else F.concat(F.lit(f"<{marker}>"), text.cast("string"))


def grid_slots(cells: Column) -> Column:
    """Every slot a cell covers, as (r, c) structs: for coverage checks of authored grids."""
    return F.flatten(
        F.transform(
            cells,
            lambda x: F.flatten(
                F.transform(
                    F.sequence(x["r"], x["r"] + x["rs"] - 1),
                    lambda r: F.transform(F.sequence(x["c"], x["c"] + x["cs"] - 1), lambda c: F.struct(r.alias("r"), c.alias("c"))),
                )
            ),
        )
    )


def covered_once(cells: Column, rows: Column, columns: Column) -> Column:
    """Whether the cells cover each slot of the grid exactly once."""
    slots = grid_slots(cells)
    inside = F.forall(slots, lambda s: (s["r"] >= 0) & (s["r"] < rows) & (s["c"] >= 0) & (s["c"] < columns))
    return inside & (F.size(slots) == rows * columns) & (F.size(F.array_distinct(slots)) == F.size(slots))
