import pytest
from pyspark.sql import functions as F

from docflow import cli
from docflow.functions import tables
from docflow.operators import corpus, geometry, score


def test_arguments():
    got = cli.parse(["--input", "a.pdf", "--output", "o", "--pages", "1,3-5", "--resume"])
    assert got["pages"] == [1, 3, 4, 5] and got["dpi"] == 144 and got["resume"] and got["device"] == "cpu"
    assert cli.parse(["--help"]) is None


@pytest.mark.parametrize(
    "bad",
    [[], ["--input", "a"], ["--input", "a", "--output", "--x"], ["--input", "a", "--input", "b", "--output", "o"], ["--nope", "1"],
     ["--input", "a", "--output", "o", "--pages", "3,1"], ["--input", "a", "--output", "o", "--dpi", "301"],
     ["--input", "a", "--output", "o", "--pages", "1-17"], ["--input", "a", "--output", "o", "--device", "tpu"]],
)
def test_bad_arguments(bad):
    with pytest.raises(cli.UsageError):
        cli.parse(bad)


def test_identity_ignores_order():
    assert cli.identity({"a": "1", "b": "2"}) == cli.identity({"b": "2", "a": "1"}) != cli.identity({"a": "2", "b": "1"})


def test_tables_read_back():
    html = '<table>\n<tr><td rowspan="2">a<br>b</td><td>&lt;</td></tr>\n<tr><td>c</td></tr>\n</table>'
    assert tables.read_html(html) == [(0, 0, 2, 1, "a\nb"), (0, 1, 1, 1, "<"), (1, 1, 1, 1, "c")]
    assert tables.read_markdown("| a | b\\|c |\n| --- | --- |\n| 1\\. &amp; |  |\n") == [["a", "b|c"], ["1. &", ""]]
    for bad in ('<table><tr><td>a</td></tr><tr><td>b</td><td>c</td></tr></table>', '<table><tr><td rowspan="2">a</td></tr></table>'):
        with pytest.raises(ValueError):
            tables.read_html(bad)


def test_masks(spark):
    mask = lambda m: spark.range(1).select(geometry.mask_positions(F.array(*[F.lit(v) for v in m]), 2).alias("x")).first()["x"]
    assert mask([1, 1, 1, 1]) == [0, 1, 2, 3]
    assert mask([1, 0, 0, 0]) == [0, 0, 0, 0]
    assert mask([0, 1, 0, 0]) is None and mask([1, 1, 1, 0]) is None


def test_picture_scores(spark):
    box = "array<struct<l:int,t:int,r:int,b:int>>"
    rows = [(1, True, True, True, True, [(0, 0, 10, 10)], [(0, 0, 10, 9)]), (2, True, True, True, True, [(0, 0, 10, 10)], [(5, 5, 15, 15)]), (3, False, True, True, True, [(0, 0, 1, 1)], [(0, 0, 1, 1)])]
    pages = spark.createDataFrame(rows, f"i int, strict boolean, markdown_exact boolean, structure_exact boolean, asset_verified boolean, expected_boxes {box}, actual_boxes {box}")
    got = {r["i"]: (r["picture_iou"], r["accepted"]) for r in score.score_pictures(pages, 0.8).collect()}
    assert got[1] == (0.9, True) and got[2][1] is False and got[3] == (None, False)


def test_selection_prefers_the_base_on_ties(spark):
    rows = [("base", 0, 1, 5, 2), ("later", 1, 1, 5, 2)]
    scores = spark.createDataFrame(rows, "candidate string, place int, accepted int, character_edits int, word_edits int")
    assert score.choose_least_edits(scores).first()["candidate"] == "base"


def test_fixed_splits(spark):
    lock = spark.createDataFrame([("u", 1, "train"), ("u", 2, "final")], "url string, page long, split string")
    rows = spark.createDataFrame([("u", 1), ("v", 1)], "url string, page long")
    got = {(r["url"], r["page"]): (r["split"], r["problem"]) for r in corpus.assign_splits(rows, lock).collect()}
    assert got == {("u", 1): ("train", None), ("u", 2): ("final", "missing"), ("v", 1): (None, "not listed")}


def test_unknown_fields(spark):
    config = F.create_map(F.lit("a"), F.lit(1), F.lit("z"), F.lit(2))
    assert spark.range(1).select(corpus.unknown_fields(config, ["a", "b"]).alias("x")).first()["x"] == ["z"]
