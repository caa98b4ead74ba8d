"""Registered queries of images, composed documents and positions, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docflow.functions import render, tables
from docflow.functions.doctags import parse_doctags
from docflow.operators import compose, geometry
from docflow.plans.catalogue import _ITEMS, _order_tables, _table, query
from docflow.sources import images

# ------------------------------------------------------------------- images


def _images(spark, d):
    """A small PNG for each part: its red falls with the row, its green rises with the column, its blue is the part's key."""
    k, h, w = F.col("p_partkey"), F.col("p_size") % 9 + 4, F.col("p_partkey") % 11 + 5
    line = F.sequence(F.lit(0), h * w - 1)
    byte = lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")
    cells = F.transform(line, lambda i: F.concat(byte(255 - F.floor(i / w) * 7), byte(i % w * 11), byte(k % 256)))
    rows = _table(spark, d, "part", 10_000).select("p_partkey", "p_size", h.alias("h"), w.alias("w"), F.unhex(F.array_join(cells, "")).alias("data"))
    return rows.select("p_partkey", "p_size", "h", "w", "data", images.png_column(F.col("data"), F.col("h"), F.col("w")).alias("png"))


_PIXELS = """
i AS (SELECT p_partkey AS k, p_size, p_size % 9 + 4 AS h, p_partkey % 11 + 5 AS w FROM part),
hexed AS (SELECT *, list_transform(range(0, 256), lambda v: lower(lpad(to_hex(v), 2, '0'))) AS bytes FROM i)"""


def _area(top, bottom, left, right):
    """Hexadecimal pixels of the rows and columns from one bound to before the other, in SQL."""
    pixel = "bytes[(255 - y * 7 + 1)::INTEGER] || bytes[(x * 11 + 1)::INTEGER] || bytes[(k % 256 + 1)::INTEGER]"
    return f"array_to_string(flatten(list_transform(range(({top})::BIGINT, ({bottom})::BIGINT), lambda y: list_transform(range(({left})::BIGINT, ({right})::BIGINT), lambda x: {pixel}))), '')"


@query(f"WITH {_PIXELS} SELECT k AS p_partkey, h::INTEGER AS height, w::INTEGER AS width, md5({_area('0', 'h', '0', 'w')}) AS pixels_md5 FROM hexed")
def q_png_pixels(spark, d):
    """Images written and read back, pixel by pixel."""
    rows = _images(spark, d).select("p_partkey", images.pixels_column(F.col("png")).alias("x"))
    return rows.select("p_partkey", "x.height", "x.width", F.md5(F.lower(F.hex("x.pixels")).cast("binary")).alias("pixels_md5"))


_BOX = ("p_partkey % 300", "p_size * 4", "p_partkey % 300 + p_size * 4", "p_size * 4 + 150")


@query(
    f"""WITH {_PIXELS}, b AS (SELECT *, ((k % 300) * w) // 500 AS l, ((p_size * 4) * h) // 500 AS t, ((k % 300 + p_size * 4) * w) // 500 AS r, ((p_size * 4 + 150) * h) // 500 AS bt FROM hexed)
    SELECT k AS p_partkey, CASE WHEN l < r AND t < bt THEN (r - l)::INTEGER END AS width, CASE WHEN l < r AND t < bt THEN (bt - t)::INTEGER END AS height,
    CASE WHEN l < r AND t < bt THEN md5({_area('t', 'bt', 'l', 'r')}) END AS pixels_md5 FROM b"""
)
def q_picture_crops(spark, d):
    """Pictures cut out of their pages by grid boxes; some boxes are empty in source pixels."""
    box = F.array(*[F.expr(x) for x in _BOX])
    rows = _images(spark, d).select("p_partkey", images.pixels_column(images.crop_column(F.col("png"), box)).alias("x"))
    return rows.select("p_partkey", "x.width", "x.height", F.md5(F.lower(F.hex("x.pixels")).cast("binary")).alias("pixels_md5"))


@query(
    f"""WITH {_PIXELS} SELECT k AS p_partkey, (2 * h)::INTEGER AS height, (w + 3)::INTEGER AS width, true AS keeps_blue, md5({_area('0', 'h', '0', 'w')}) AS same_md5 FROM hexed"""
)
def q_image_resize(spark, d):
    """A resampled image keeps a channel that is the same everywhere; to its own size it stays as it is."""
    rows = _images(spark, d).select(
        "p_partkey", images.pixels_column(images.resize_column(F.col("png"), F.col("h") * 2, F.col("w") + 3)).alias("x"),
        images.pixels_column(images.resize_column(F.col("png"), F.col("h"), F.col("w"))).alias("y"),
    )
    blues = F.regexp_replace(F.hex("x.pixels"), "....(..)", "$1")
    blue = F.repeat(F.lpad(F.hex(F.col("p_partkey") % 256), 2, "0"), F.col("x.height") * F.col("x.width"))
    return rows.select("p_partkey", "x.height", "x.width", (blues == blue).alias("keeps_blue"), F.md5(F.lower(F.hex("y.pixels")).cast("binary")).alias("same_md5"))


# ------------------------------------------------------- positions and paths


@query(
    """WITH g AS (SELECT p_partkey AS k, p_size % 6 + 1 AS h, p_partkey % 6 + 1 AS w, p_partkey % 9 = 4 AS broken FROM part),
    f AS (SELECT *, [(i::FLOAT / 6::FLOAT)::FLOAT FOR i IN range(1, 6)] AS edges FROM g)
    SELECT k AS p_partkey, CASE WHEN NOT (broken AND h > 1 AND w > 1) THEN array_to_string(list_transform(range(0, 36), lambda i: CASE WHEN i // 6 < h AND i % 6 < w THEN
      len(list_filter(edges, lambda e: ((i // 6)::FLOAT * (1::FLOAT / h::FLOAT)::FLOAT)::FLOAT >= e)) * 6 + len(list_filter(edges, lambda e: ((i % 6)::FLOAT * (1::FLOAT / w::FLOAT)::FLOAT)::FLOAT >= e)) ELSE 0 END), ',') END AS positions FROM f"""
)
def q_mask_positions(spark, d):
    """Positions of patches in rectangles of every size; every ninth mask has a hole in its last place."""
    k, h, w = F.col("p_partkey"), F.col("p_size") % 6 + 1, F.col("p_partkey") % 6 + 1
    last = (h - 1) * 6 + w - 1
    mask = F.transform(F.sequence(F.lit(0), F.lit(35)), lambda i: ((F.floor(i / 6) < h) & (i % 6 < w) & ~((k % 9 == 4) & (h > 1) & (w > 1) & (i == last))).cast("int"))
    rows = _table(spark, d, "part", 20_000).select("p_partkey", mask.alias("mask"))
    return rows.select("p_partkey", F.array_join(geometry.mask_positions(F.col("mask"), 6).cast("array<string>"), ",").alias("positions"))


@query(
    """WITH t AS (SELECT page_id, page_id % 5 AS turn, regexp_replace(substr(url, 1, 40), '[^a-z0-9]', '-', 'g') AS name FROM pages)
    SELECT page_id, CASE WHEN turn IN (0, 4) THEN '![Picture](assets/' || name || CASE turn WHEN 4 THEN '.v2' ELSE '' END || ')' || chr(10) END AS markdown FROM t"""
)
def q_picture_paths(spark, d):
    """Pages of one picture with a path from their url: sound, climbing, in another folder, too long, with a point."""
    turn, name = F.col("page_id") % 5, F.regexp_replace(F.substring("url", 1, 40), "[^a-z0-9]", "-")
    path = (
        F.when(turn == 1, F.concat(F.lit("assets/.."), name)).when(turn == 2, F.concat(F.lit("other/"), name))
        .when(turn == 3, F.concat(F.lit("assets/"), name, F.repeat(F.lit("x"), 256))).when(turn == 4, F.concat(F.lit("assets/"), name, F.lit(".v2")))
        .otherwise(F.concat(F.lit("assets/"), name))
    )
    raw = F.lit("<doctag><picture><loc_1><loc_2><loc_30><loc_40></picture></doctag>")
    rows = _table(spark, d, "pages").select("page_id", path.alias("path"), parse_doctags(raw).alias("p"))
    return rows.select("page_id", render.to_markdown(F.col("p"), pictures=F.array("path")).alias("markdown"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 8 BETWEEN 1 AND 5 THEN repeat('#', (p_size % 8 + 1)::INTEGER) || ' ' || p_name || chr(10) END AS markdown,
    CASE WHEN p_size % 8 BETWEEN 1 AND 5 THEN (p_size % 8)::INTEGER END AS level FROM part"""
)
def q_heading_levels(spark, d):
    """Headings of levels 0 to 7, of which 1 to 5 are known."""
    tag = F.concat(F.lit("section_header_level_"), (F.col("p_size") % 8).cast("string"))
    raw = F.concat(F.lit("<doctag><"), tag, F.lit(">"), "p_name", F.lit("</"), tag, F.lit("></doctag>"))
    rows = _table(spark, d, "part").select("p_partkey", parse_doctags(raw).alias("p"))
    return rows.select("p_partkey", render.to_markdown(F.col("p")).alias("markdown"), F.get("p.elements", F.lit(0))["level"].alias("level"))


# -------------------------------------------------------- composed documents


def _composed(spark, d):
    """A document for each customer: its orders' tables, one a page."""
    owners = _table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    pages = _order_tables(spark, d).join(owners, "l_orderkey")
    pages = pages.withColumn("page", F.row_number().over(Window.partitionBy("o_custkey").orderBy("l_orderkey"))).withColumn("position", F.col("page"))
    return compose.compose(pages, "o_custkey", "page").select("o_custkey", "markdown")


_READ = f"""{_ITEMS},
pg AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
cell AS (
  SELECT o_custkey, page, 0 AS r, unnest([0, 1, 2]) AS c, unnest(['line', 'quantity', 'flag']) AS text FROM pg
  UNION ALL SELECT o_custkey, page, r, unnest([0, 1, 2]), unnest([l_linenumber::VARCHAR, q::VARCHAR, l_returnflag]) FROM items JOIN pg ON o_orderkey = l_orderkey)"""


@query(f"WITH {_READ} SELECT o_custkey, page::BIGINT AS page, r::INTEGER AS r, c::INTEGER AS c, text FROM cell")
def q_composed_cells(spark, d):
    """Every cell of every table, read back from the composed documents."""
    return tables.composed_pieces(_composed(spark, d)).where("kind = 'cell'").select("o_custkey", "page", "r", "c", "text")


@query(
    f"""WITH {_READ} SELECT o_custkey, count(DISTINCT page)::BIGINT AS pages, count(DISTINCT page)::BIGINT AS tables, count(*)::BIGINT AS cells,
    CASE o_custkey % 4 WHEN 1 THEN 'page,rules' WHEN 2 THEN 'unreadable' WHEN 3 THEN CASE WHEN count(DISTINCT page) > 1 THEN 'rules' ELSE '' END ELSE '' END AS problems FROM cell GROUP BY 1"""
)
def q_composed_checks(spark, d):
    """Structure of the composed documents, some with a loose page, a broken table, or a rule too many."""
    turn, own = F.col("o_custkey") % 4, F.col("markdown")
    told = (
        F.when(turn == 1, F.concat(F.lit("no number\n\n---\n\n\n---\n\n"), own)).when(turn == 2, F.concat(own, F.lit("\n| a | b\n")))
        .when(turn == 3, F.regexp_replace(own, "\n---\n\n# Page 2\n", "\n---\n\n\n---\n\n# Page 2\n")).otherwise(own)
    )
    found = tables.check_composed(tables.composed_pieces(_composed(spark, d).withColumn("markdown", told)), "o_custkey")
    return found.select("o_custkey", "pages", "tables", "cells", F.array_join("problems", ",").alias("problems"))


