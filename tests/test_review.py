"""Reviewed targets, final sets and pruned scans."""

import pytest
from pyspark.sql import functions as F

from docflow.operators import review

URL = "https://example.org/a.pdf"
ROWS = "row long, url string, page long, response string"
REVIEWS = "row long, source string, page long, decision string, elements array<struct<tag:string,text:string>>"
GOOD = ((1, URL, 3, '{"natural_text": "label"}'), (1, "a", 3, "approved", [("text", "fine")]))


@pytest.mark.parametrize(
    ("row", "told", "problem"),
    [
        ({}, {}, None),
        ({0: 2}, {}, "row"),
        ({1: URL + "x"}, {}, "identity"),
        ({2: None}, {}, "identity"),
        ({}, {1: "b"}, "identity"),
        ({}, {3: None}, "decision"),
        ({3: "{}"}, {}, "label"),
        ({3: '{"natural_text": " \\n"}'}, {}, "label"),
        ({3: '{"natural_text": "a", "natural_text": "b"}'}, {}, "label"),
        ({}, {4: []}, "target"),
        ({}, {4: [("title", "fine")]}, "target"),
        ({}, {4: None}, "target"),
        ({3: '{"natural_text": null}'}, {3: "excluded-blank", 4: []}, None),
        ({3: "{}"}, {3: "excluded-blank", 4: []}, None),
        ({3: "[]"}, {3: "excluded-blank", 4: []}, "blank evidence"),
        ({3: None}, {3: "excluded-blank", 4: []}, "blank evidence"),
        ({3: "{}"}, {3: "excluded-blank"}, "blank evidence"),
    ],
)
def test_decisions(spark, row, told, problem):
    own = spark.createDataFrame([tuple(row.get(i, v) for i, v in enumerate(GOOD[0]))], ROWS)
    reviews = spark.createDataFrame([tuple(told.get(i, v) for i, v in enumerate(GOOD[1]))], REVIEWS)
    sources = spark.createDataFrame([("a", URL)], "source string, url string")
    (r,) = review.dispatch(own, reviews, sources).collect()
    assert r["problem"] == problem and (r["id"] is None) == (problem is not None)
    assert (r["target"] is not None) == (problem is None and r["decision"] == "approved")


def test_a_review_given_twice(spark):
    own, reviews = spark.createDataFrame([GOOD[0]], ROWS), spark.createDataFrame([GOOD[1]] * 2, REVIEWS)
    sources = spark.createDataFrame([("a", URL)], "source string, url string")
    assert [r["problem"] for r in review.dispatch(own, reviews, sources).collect()] == ["repeated"] * 2


CASE = "name string, row long, page long, decision string, width int, height int, elements array<struct<tag:string,text:string>>, box array<int>"


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        ({}, None), ({"page": 2}, "changed"), ({"width": 0}, "image size"), ({"height": None}, "image size"), ({"box": [0, 0, 101, 50]}, "picture"), ({"box": [9, 0, 9, 50]}, "picture"),
        ({"box": None}, "picture"), ({"box": [0, 0, 9]}, "picture"), ({"elements": [("picture", "x")]}, "picture"), ({"elements": [("picture", None), ("text", "x")]}, "picture"),
        ({"box": [0, 0, 100, 50]}, None), ({"name": "b"}, "not listed"),
    ],
)
def test_final_pictures(spark, change, problem):
    case = {"name": "a", "row": 1, "page": 1, "decision": "picture-reference", "width": 100, "height": 50, "elements": [("picture", None)], "box": [10, 5, 60, 45]} | change
    fixed = spark.createDataFrame([("a", 1, 1, "picture-reference")], "name string, row long, page long, decision string")
    got = {r["name"]: (r["target"], r["problem"]) for r in review.final_targets(spark.createDataFrame([tuple(case.values())], CASE), fixed).collect()}
    assert got[case["name"]][1] == problem
    if not change:
        assert got["a"][0] == "<doctag><picture><loc_50><loc_50><loc_300><loc_450></picture></doctag>"
    if "name" in change:
        assert got["a"] == (None, "missing")


def scanned(spark, df):
    """Rows that came out of the table's scan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    text, found, open_ = plan.toString(), 0, [plan]
    while open_:
        node = open_.pop()
        if node.nodeName().startswith("Scan parquet"):
            found = max(found, node.metrics().get("numOutputRows").get().value())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            open_.append(node.plan())
        children = node.children()
        open_ += [children.apply(i) for i in range(children.size())]
    return found, text


def test_only_row_groups_with_wanted_rows_are_read(spark, tmp_path):
    at = str(tmp_path / "images")
    wide = spark.range(40_000).select(F.col("id"), F.repeat(F.md5(F.col("id").cast("string")), 4).alias("content"))
    wide.repartitionByRange(4, "id").sortWithinPartitions("id").write.option("parquet.block.size", 64 << 10).parquet(at)
    wanted = spark.createDataFrame([(17,), (18,), (30_123,), (30_123,), (99_999,)], "id long")
    rows = review.wanted_rows(spark, at, wanted, "id")
    assert sorted(r["id"] for r in rows.collect()) == [17, 18, 30_123]
    read, plan = scanned(spark, rows)
    assert 0 < read < 10_000 and "PushedFilters" in plan
    assert review.wanted_rows(spark, at, wanted.limit(0), "id").count() == 0


def test_few_ranges_hold_all_ids(spark):
    ids = [*range(0, 10_000, 7), 5_000_000, -(2**62), 2**62]
    wanted = spark.createDataFrame([(i,) for i in ids], "id long")
    ranges = review.id_ranges(wanted, "id", 16)
    assert len(ranges) <= 16 and all(any(a <= i <= z for a, z in ranges) for i in ids)
    assert review.id_ranges(spark.createDataFrame([(3,), (None,)], "id long"), "id") == [(3, 3)]
