"""Composed documents read back, and images by columns."""

import numpy as np
from pyspark.sql import functions as F

from docflow.functions import tables
from docflow.sources import images, pdf

WHOLE = "# Page 3\n\nText \\# here\n\n| a | b |\n| --- | --- |\n| x\\|y | 1<br>2 |\n\n---\n\n# Page 9\n\n<table>\n<tr><td colspan=\"2\">A</td></tr>\n<tr><td>b</td><td>c &lt; d</td></tr>\n</table>\n"


def test_pieces_of_a_composed_document():
    got = list(tables.read_composed(WHOLE))
    assert got == [
        (3, None, "heading", None, None, None, None, "Page 3"),
        (3, 0, "text", None, None, None, None, "Text \\# here"),
        (3, 1, "cell", 0, 0, 1, 1, "a"), (3, 1, "cell", 0, 1, 1, 1, "b"), (3, 1, "cell", 1, 0, 1, 1, "x|y"), (3, 1, "cell", 1, 1, 1, 1, "1\n2"),
        (None, None, "rule", None, None, None, None, "---"),
        (9, None, "heading", None, None, None, None, "Page 9"),
        (9, 0, "cell", 0, 0, 1, 2, "A"), (9, 0, "cell", 1, 0, 1, 1, "b"), (9, 0, "cell", 1, 1, 1, 1, "c < d"),
    ]


def test_broken_documents_are_rows_too(spark):
    rows = [(1, WHOLE), (2, None), (3, ""), (4, WHOLE + "\n| a | b |\n"), (5, WHOLE.replace("# Page 9", "# Chapter")), (6, WHOLE.replace("---\n\n# P", "---\n\n\n---\n\n# P"))]
    documents = spark.createDataFrame(rows, "doc long, markdown string")
    found = {r["doc"]: tuple(r)[1:] for r in tables.check_composed(tables.composed_pieces(documents), "doc").collect()}
    assert found[1] == (2, 2, 7, []) and 2 not in found
    assert found[3][3] == ["page", "rules"]
    assert found[4] == (2, 2, 7, ["unreadable"])
    assert found[5][0] == 1 and found[5][3] == ["rules"]
    assert found[6][3] == ["rules"]


def test_images_by_columns(spark):
    rng = np.random.default_rng(2)
    pixels = rng.integers(0, 256, (12, 7, 3), dtype=np.uint8)
    rows = spark.createDataFrame([(1, bytearray(pixels.tobytes()), 12, 7), (2, bytearray(b"short"), 12, 7), (3, None, 1, 1)], "i int, data binary, h int, w int")
    png = images.png_column(F.col("data"), F.col("h"), F.col("w"))
    got = {r["i"]: r for r in rows.select("i", png.alias("png"), images.pixels_column(png).alias("x")).collect()}
    assert bytes(got[1]["x"]["pixels"]) == pixels.tobytes() and (got[1]["x"]["height"], got[1]["x"]["width"]) == (12, 7)
    assert got[2]["png"] is None and got[2]["x"] is None and got[3]["png"] is None
    bad = spark.createDataFrame([(bytearray(b"no image"),)], "c binary").select(images.pixels_column(F.col("c")).alias("x")).first()["x"]
    assert bad["error"] == "not a PNG" and bad["pixels"] is None
    scaled = rows.where("i = 1").select(images.resize_column(png, F.lit(5), F.lit(20)).alias("y")).first()["y"]
    assert (pdf.read_png(bytes(scaled)) == images.resize(pixels, 20, 5)).all()
    cut = lambda box: images.crop_column(png, F.array(*[F.lit(v) for v in box]))
    y = rows.where("i = 1").select(cut((0, 0, 250, 250)).alias("a"), cut((10, 10, 20, 20)).alias("b")).first()
    assert (pdf.read_png(bytes(y["a"])) == pixels[:6, :3]).all() and y["b"] is None
