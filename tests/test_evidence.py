"""Scores, targets, seals and jobs against plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docflow.functions import render, strictjson, tables
from docflow.functions.doctags import parse_doctags, parse_page
from docflow.operators import build, corpus, geometry, jobs, score, supervise
from docflow.streaming import journal


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_coverage_words(spark):
    random.seed(3)
    words = lambda n: " ".join(random.choice(["a", "bé", "c", "dd", "日"]) for _ in range(n))
    rows = [(i, words(random.randint(0, 12)), f"<text>{words(random.randint(0, 12))}</text>", "eos", 0, True) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, expected string, raw string, stop_reason string, n_diagnostics int, markdown_written boolean")
    for r in score.score_coverage(df).collect():
        a, b = r["expected_text"].split(), r["recognized_text"].split()
        assert r["word_edits"] == plain_distance(a, b) and r["character_edits"] == plain_distance(r["expected_text"], r["recognized_text"])
        assert r["inventory_matches"] == sum(min(a.count(w), b.count(w)) for w in set(a))
        assert r["accepted"] == (a == b)


@pytest.mark.parametrize(
    ("raw", "want", "error"),
    [
        ("a<loc_0><loc_0><loc_100><loc_50>b", "a<loc_0><loc_0><loc_499><loc_499>b", None),
        ("<loc_1><loc_1><loc_3><loc_3>x<loc_0><loc_0><loc_0><loc_0>", "<loc_5><loc_10><loc_15><loc_30>x<loc_0><loc_0><loc_0><loc_0>", None),
        ("plain", "plain", None),
        ("<loc_1><loc_1><loc_3>", None, "orphan location"),
        ("<loc_1>" * 8, None, "location count"),
        ("<loc_3><loc_1><loc_1><loc_3>", None, "box"),
        ("<loc_1><loc_1><loc_101><loc_3>", None, "box"),
        ("<loc_123456>", None, "orphan location"),
        ("", None, "target"),
        (None, None, "target"),
    ],
)
def test_locations_are_never_clipped(spark, raw, want, error):
    x = one(spark, geometry.convert_locations(F.lit(raw).cast("string"), F.lit(100), F.lit(50)))
    assert (x["raw"], x["error"]) == (want, error)


@pytest.mark.parametrize("name", ["a/../b", "..", "", "/a", "//a", "x" * 241])
def test_paths_stay_beneath_their_root(spark, name):
    assert one(spark, corpus.safe_relative(F.lit(name))) is False
    assert all(one(spark, corpus.safe_relative(F.lit(x))) for x in ("a/b.c", "a//b", "./a", "..a/b.."))


def test_bad_seals_never_fail(spark):
    policy = F.struct(*[F.lit("x").alias(n) for n in ("workflow_sha256", "selection_protocol_sha256", "final_cases", "development_evidence")])
    for seal in (None, "", "{", "[]", "{}", '{"selected_files": 3}'):
        assert "fields" in one(spark, corpus.seal_problems(F.lit(seal).cast("string"), policy))


def good_seal():
    digest, revision = "0" * 64, "a" * 40
    return {
        "schema_version": 1, "status": "selection-sealed", "selection_criterion": "validation-only", "final_content_opened": False,
        "workflow_sha256": digest, "selection_protocol_sha256": digest, "selection_report": "out/r.json", "selection_report_sha256": digest,
        "selected_id": "step-40", "selected_kind": "adapter", "selected_files": {"a/w.bin": digest}, "final_cases": ["p1", "p2"],
        "development_evidence": {"y": digest, "x": digest}, "source_revision": revision,
    }


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({}, []),
        ({"schema_version": "1"}, ["schema"]),
        ({"schema_version": 2}, ["schema"]),
        ({"final_content_opened": "false"}, ["final opened"]),
        ({"final_content_opened": True}, ["final opened"]),
        ({"final_content_opened": None}, ["final opened"]),
        ({"selected_id": 40}, ["identity"]),
        ({"selected_id": ""}, ["identity"]),
        ({"final_cases": ["p2", "p1"]}, ["final cases"]),
        ({"final_cases": "[p1]"}, ["final cases"]),
        ({"development_evidence": {"x": "0" * 64, "y": "0" * 64}}, []),
        ({"development_evidence": {"x": "0" * 64, "y": 0}}, ["evidence"]),
        ({"selected_files": {}}, ["payload"]),
        ({"selected_kind": "base"}, ["payload"]),
        ({"selected_kind": "base", "selected_files": {}}, []),
        ({"selected_files": {"../w": "0" * 64}}, ["digests"]),
        ({"selected_files": {"w": 7}}, ["digests"]),
        ({"selected_files": ["w"]}, ["kind", "payload", "digests"]),
        ({"selection_report": 5}, ["report path"]),
        ({"more": 1}, ["fields"]),
    ],
)
def test_seals_by_typed_values(spark, change, want):
    seal = good_seal()
    policy = F.struct(
        *[F.lit(seal[n]).alias(n) for n in ("workflow_sha256", "selection_protocol_sha256")],
        *[F.lit(json.dumps(seal[n])).alias(n) for n in ("final_cases", "development_evidence")],
    )
    assert one(spark, corpus.seal_problems(F.lit(json.dumps(seal | change)), policy)) == want


def test_seals_with_repeated_keys_or_more_text_are_refused(spark):
    policy = F.struct(*[F.lit("x").alias(n) for n in ("workflow_sha256", "selection_protocol_sha256", "final_cases", "development_evidence")])
    whole = json.dumps(good_seal())
    for seal in (whole[:-1] + ', "selected_id": "other"}', whole + " x", whole + whole, whole.replace('"y"', '"x"')):
        assert "fields" in one(spark, corpus.seal_problems(F.lit(seal), policy))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"b": 1, "a": [1, "2", null]} ', '{"a":[1,"2",null],"b":1}'), ("3", "3"), ('"x"', '"x"'), ("", None), (" ", None), ("1,2", None), ('1,"k":2', None),
        ("1],[2", None), ('1},{"v":2', None), ('{"a":1,"a":1}', None), ('{"a":{"b":1,"b":2}}', None), ("{", None), ("nan", None), ("1 2", None), ("{} {}", None),
    ],
)
def test_strict_json(spark, text, want):
    assert one(spark, strictjson.canonical(strictjson.parsed(F.lit(text)))) == want


def test_labels(spark):
    raw = "<doctag><loc_12><loc_500></text><loc_" + "9" * 40 + "><loc_007>"
    x = one(spark, corpus.inspect_label(F.lit(raw)))
    assert (x["locations"], x["out_of_range"], x["largest_location"], x["tags"]) == (4, 2, None, ["doctag", "text"])
    assert one(spark, corpus.inspect_label(F.lit("<loc_0>")))["largest_location"] == 0
    good = "doc_" + "0" * 40 + "_p00012"
    assert one(spark, corpus.page_identity(F.lit(good)))["page"] == 12
    assert one(spark, corpus.page_identity(F.lit(good + "\n"))) is None


def test_supervision_checks_ids(spark):
    tokens = F.array(*[F.lit(t) for t in (9, 5, 6, 7, 1)])
    for eos, image, pad, size in ((9, 9, 0, 20), (1, 9, 9, 20), (1, 30, 0, 20), (1, 9, 0, 1)):
        with pytest.raises(ValueError):
            supervise.answer_supervision(tokens, F.lit(2), eos, image, None, pad, size)
    assert one(spark, supervise.answer_supervision(tokens, F.lit(2), 1, 9, vocabulary=9 + 1)) is not None
    assert one(spark, supervise.answer_supervision(F.array(F.lit(9), F.lit(-5), F.lit(6), F.lit(1)), F.lit(1), 1, 9)) is None
    assert one(spark, supervise.task_valid(F.lit("a\0b"))) is False


def test_targets_parse_back(spark):
    elements = F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(x).alias("text")) for t, x in (("text", "a b"), ("page_header", "é"))])
    made = one(spark, build.make_target(elements))
    assert [(e["kind"], e["text"]) for e in parse_page(made)["elements"]] == [("text", "a b"), ("page-header", "é")]
    blank = F.array(F.struct(F.lit("text").alias("tag"), F.lit("  ").alias("text")))
    assert one(spark, build.make_target(blank)) is None


def test_two_pages_read_back_as_two_tables(spark):
    """A combined document has its page headings, one rule, and both tables with all their cells."""
    from docflow.operators import compose

    raw = "<doctag><otsl><ched>a<ched>b<nl><fcel>{0}<fcel>x|y<nl></otsl></doctag>"
    rows = spark.createDataFrame([(1, p, p, raw.format(p)) for p in (27, 28)], "doc long, page long, position long, raw string")
    pages = rows.select("doc", "page", "position", parse_doctags(F.col("raw")).alias("parsed"))
    md = compose.compose(pages, "doc", "page").first()["markdown"]
    lines = md.split("\n")
    assert [x for x in lines if x.startswith("# ")] == ["# Page 27", "# Page 28"] and lines.count("---") == 1
    parts = md.split("\n---\n")
    assert [tables.read_markdown(p.split("\n\n", 1)[1].strip("\n")) for p in (parts[0], parts[1].lstrip("\n"))] == [
        [["a", "b"], [str(n), "x|y"]] for n in (27, 28)
    ]


def test_later_batches_overtake_earlier_ones(spark, tmp_path):
    at, out, marks = (str(tmp_path / x) for x in ("journal", "pages", "marks"))
    row = lambda page, attempt, text: ("j", page, attempt, f"<doctag><text>{text}</text></doctag>", [1], "eos", None)
    for rows in ([row(1, 1, "old"), row(2, 1, "two")], [row(1, 2, "new")]):
        spark.createDataFrame(rows, jobs.RECORD).coalesce(1).write.mode("append").parquet(at)
        journal.start(spark, at, out, marks).awaitTermination()
    got = {r["page"]: r["markdown"] for r in journal.pages(spark, out).collect()}
    assert got == {1: "new\n", 2: "two\n"}


def test_nested_lists_and_many_tables(spark):
    raw = (
        "<doctag><ordered_list><list_item>a</list_item><list_item>b</list_item></ordered_list>"
        + "".join(f"<otsl><fcel>{i}<nl></otsl>" for i in range(3))
        + "</doctag>"
    )
    md = spark.createDataFrame([(raw,)], "raw string").select(parse_doctags(F.col("raw")).alias("p")).select(render.to_markdown(F.col("p")).alias("m")).first()["m"]
    assert md == "1. a\n2. b\n\n" + "\n\n".join(f"|  |\n| --- |\n| {i} |" for i in range(3)) + "\n"
