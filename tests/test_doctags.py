import pytest
from pyspark.sql import functions as F

from docflow.functions import render
from docflow.functions.doctags import parse_doctags, parse_page


def page(x):
    return f"<doctag>{x}</doctag>"


def codes(raw, stop="eos"):
    return [d["code"] for d in parse_page(raw, stop)["diagnostics"]]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (page("<text>a</text>"), []),
        (page("<text>a"), ["mismatched-close", "unclosed-tag"]),
        ("<doctag><text>a", ["unclosed-tag", "unclosed-tag"]),
        (page("<text>a</title></text>"), ["mismatched-close"]),
        ("<text>a</text>", ["document-wrapper", "outside-content"]),
        (page("") + page(""), ["document-wrapper"]),
        (page("") + "x", ["outside-content"]),
        (page("") + "<end_of_utterance>", []),
        (page("") + "<end_of_utterance><end_of_utterance>", ["end-marker"]),
        ("<end_of_utterance>" + page(""), ["end-marker"]),
        (page("<text><loc_1><loc_2><loc_3><loc_500>a</text>"), ["location"]),
        (page("<text><loc_1>a</text>"), ["location"]),
        (page("<text><loc_9><loc_2><loc_3><loc_4>a</text>"), ["location"]),
        (page("<text>a<loc_1><loc_2><loc_3><loc_4></text>"), ["location"]),
        (page("<text><loc_no>a</text>"), ["location"]),
        (page("<text><text>a</text></text>"), ["unsupported-structure"]),
        (page("<ordered_list><text>a</text></ordered_list>"), ["unsupported-structure"]),
        (page("<section_header_level_6>a</section_header_level_6>"), ["unsupported-tag"]),
        (page("loose"), ["unsupported-tag"]),
        (page("<text>&lt;</text>"), ["ambiguous-entity"]),
        (page("<text>a\x01</text>"), ["control-character"]),
        (page("<text>a</text>") + "<", ["malformed-token", "outside-content"]),
        (page("<text x>a</text x>"), ["malformed-token", "unsupported-tag"]),
        (page("<picture></picture>"), ["location", "picture-location"]),
        (page("<picture><loc_1><loc_1><loc_1><loc_2></picture>"), ["location"]),
        (page("<picture><loc_1><loc_1><loc_2><loc_2>text</picture>"), ["picture-content"]),
        (page("<picture><loc_1><loc_1><loc_2><loc_2><icon><logo></picture>"), ["picture-classification"]),
        (page("<otsl><fcel>a<nl></otsl>"), []),
        (page("<otsl><fcel><nl></otsl>"), ["table-content"]),
        (page("<otsl><ecel>a<nl></otsl>"), ["table-content"]),
        (page("<otsl><fcel>a</otsl>"), ["table-shape"]),
        (page("<otsl></otsl>"), ["table-shape"]),
        (page("<otsl><fcel>a<nl><fcel>b<fcel>c<nl></otsl>"), ["table-shape"]),
        (page("<otsl><lcel><nl></otsl>"), ["table-span"]),
        (page("<otsl><fcel>a<lcel><nl><ucel><fcel>b<nl></otsl>"), ["table-span"]),
        (page("<otsl><fcel>a<lcel><nl><ucel><xcel><nl></otsl>"), []),
        (page("<otsl><fcel>a<nl><ched>b<nl></otsl>"), ["table-header"]),
        (page("<otsl><rhed>a<nl></otsl>"), ["table-header"]),
    ],
)
def test_diagnostics(raw, want):
    assert codes(raw) == want


def test_length_stop_comes_first():
    assert codes(page("<text>&lt;</text>"), "length") == ["generation-truncated", "ambiguous-entity"]


def test_budgets_are_fatal_not_diagnostics():
    deep = "<text>" * 70
    assert parse_page(page(deep))["fatal_error"] == "depth budget"
    assert parse_page("x" * 11, max_characters=10)["fatal_error"] == "character budget"
    assert parse_page(page("a<b>" * 40), max_nodes=20)["fatal_error"] == "node budget"
    assert parse_page(page("<otsl>" + "<fcel>a" * 129 + "<nl></otsl>"))["fatal_error"] == "table budget"
    assert parse_page(None)["fatal_error"] and parse_page("", "later")["fatal_error"]


def test_every_prefix_blocks():
    raw = page("<title>T</title><otsl><ched>a<ched>b<nl><fcel>1<lcel><nl></otsl><picture><loc_1><loc_1><loc_2><loc_2></picture>")
    assert codes(raw) == []
    assert all(codes(raw[:i]) for i in range(len(raw)))


def test_spans_and_offsets():
    raw = page("é<otsl><fcel> a <lcel><nl><ucel><xcel><nl></otsl>")
    p = parse_page(raw)
    first = p["cells"][0]
    assert (first["rs"], first["cs"], first["text"]) == (2, 2, "a")
    assert raw[first["start"] : first["end"]] == "<fcel> a "
    assert [c["rs"] for c in p["cells"]] == [2, 0, 0, 0]


@pytest.mark.parametrize(
    ("raw", "md"),
    [
        (page(""), ""),
        (page("<text>1.5 a*b & c. x=~y</text>"), "1\\.5 a\\*b &amp; c. x\\=\\~y\n"),
        (page("<title>A\nB</title><section_header_level_2>x</section_header_level_2>"), "# A B\n\n### x\n"),
        (page("<ordered_list><list_item>a\nb</list_item><list_item>c</list_item></ordered_list>"), "1. a\n   b\n2. c\n"),
        (page("<unordered_list><list_item>a</list_item></unordered_list>"), "- a\n"),
        (page("<list_item>a</list_item>"), "- a\n"),
        (page("<otsl><ched>a<ched>b<nl><fcel>1|2<ecel><nl></otsl>"), "| a | b |\n| --- | --- |\n| 1\\|2 |  |\n"),
        (page("<otsl><fcel>a\r\nb<nl></otsl>"), "|  |\n| --- |\n| a<br>b |\n"),
        (page('<otsl><fcel>"a"<lcel><nl><fcel>b<fcel>c<nl></otsl>'),
         '<table>\n<tr><td colspan="2">&quot;a&quot;</td></tr>\n<tr><td>b</td><td>c</td></tr>\n</table>\n'),
        (page("<text>a"), None),
        (page("<picture><loc_1><loc_1><loc_2><loc_2></picture>"), None),
    ],
)
def test_markdown(spark, raw, md):
    rows = spark.createDataFrame([(raw,)], "raw string").select(parse_doctags(F.col("raw")).alias("p"))
    assert rows.select(render.to_markdown(F.col("p")).alias("m")).first()["m"] == md


def test_partial_and_pictures(spark):
    raws = [(page("<text>a"),), (page("<picture><loc_1><loc_1><loc_2><loc_2></picture>"),)]
    rows = spark.createDataFrame(raws, "raw string").select("raw", parse_doctags(F.col("raw")).alias("p"))
    partial = [r["m"] for r in rows.select(render.to_markdown(F.col("p"), True).alias("m")).collect()]
    assert partial[0].startswith("> WARNING: Partial/unverified conversion (2 diagnostics).") and partial[1] is None
    paths = F.array(F.lit("assets/p-1.png"))
    shown = rows.where("raw like '%picture%'").select(render.to_markdown(F.col("p"), pictures=paths).alias("m")).first()["m"]
    assert shown == "![Picture](assets/p-1.png)\n"
    unsafe = F.array(F.lit("assets/../x"))
    assert rows.select(render.to_markdown(F.col("p"), pictures=unsafe).alias("m")).collect()[1]["m"] is None


def test_the_parser_runs_once_per_row(spark):
    rows = spark.range(50).select(parse_doctags(F.lit("<doctag><text>a</text></doctag>")).alias("p"))
    rows = rows.where("size(p.diagnostics) = 0").select(F.explode("p.elements").alias("e"), "p.fatal_error")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
