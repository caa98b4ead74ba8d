"""Replays, exact medians, run checks and growing components against plain versions."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from docflow.operators import graph, replay, score


def pages(spark, rows):
    return spark.createDataFrame(rows, "page long, raw string, stop_reason string, reference string")


def page(text):
    return f"<doctag><text>{text}</text></doctag>"


def test_only_changed_pages_are_computed_again(spark):
    rows = [(i, page(f"page {i}"), "eos", f"page {i}") for i in range(12)] + [(12, None, None, None)]
    payload = ["raw", "stop_reason", "reference"]
    kept = replay.run(pages(spark, rows), replay.recognise, payload, "1")
    later = [(i, page("new") if i == 3 else raw, None if i == 4 else stop, ref) for i, raw, stop, ref in rows if i != 5] + [(99, page("more"), "eos", "more")]
    seen = spark.sparkContext.accumulator(0)

    def counted(rows):
        seen.add(rows.count())
        return replay.recognise(rows)

    done = replay.replay(kept, pages(spark, later), ["page"], payload, counted, "1")
    assert {r["page"] for r in done.where("replayed").collect()} == {3, 4, 99} and seen.value == 3
    whole = replay.run(pages(spark, later), replay.recognise, payload, "1")
    columns = whole.columns
    assert score.replay_differences(whole, done.select(*columns)).count() == 0
    again = replay.replay(kept, pages(spark, rows), ["page"], payload, replay.recognise, "2")
    assert again.where("NOT replayed").count() == 0
    assert replay.audit_run(kept, ["page"], payload, replay.recognise, "1").count() == 0


def test_summaries_differ_where_their_pages_do(spark):
    rows = spark.createDataFrame([("a", 1, 2.0), ("b", 1, None), ("c", 1, 1.0)], "split string, pages int, cer double")
    other = spark.createDataFrame([("a", 1, 2.0), ("b", 2, None), ("d", 1, 1.0)], "split string, pages int, cer double")
    got = {r["split"]: r["same"] for r in replay.compare_summaries(rows, other, "split").collect()}
    assert got == {"a": True, "b": False, "c": None, "d": None}
    assert all(r["same"] for r in replay.compare_summaries(rows, rows, "split").collect())


def test_medians_by_counting_are_exact(spark):
    rng = random.Random(5)
    groups = {
        "odd": [rng.random() * 10**rng.randrange(-8, 9) for _ in range(1001)], "even": [rng.lognormvariate(0, 3) for _ in range(1000)],
        "same": [0.1 + 0.2] * 500, "ties": [float(rng.randrange(4)) for _ in range(999)], "zeros": [0.0] * 7 + [1e-300], "one": [5e-324],
        "two": [1.0, 1.0000000000000002], "large": [1.7e308, 1.6e308, 1.0], None: [2.0, 8.0],
    }
    rows = [(k, v) for k, values in groups.items() for v in values] + [("odd", float("nan")), ("odd", -1.0), ("odd", float("inf")), ("odd", None), ("none", -2.0)]
    rng.shuffle(rows)
    samples = spark.createDataFrame(rows, "stage string, seconds double")
    got = {r["stage"]: r for r in score.timing_summary(samples, "stage").collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        r = got[k]
        assert (r["samples"], r["least"], r["most"]) == (len(values), min(values), max(values))
        low, high = statistics.median_low(values), statistics.median_high(values)
        assert r["median"] == (low if low == high else (low + high) / 2), k
    plain = score.timing_summary(samples.drop("stage")).first()
    whole = [v for values in groups.values() for v in values]
    assert plain["samples"] == len(whole) and plain["median"] == statistics.median(whole)


def test_medians_without_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 50, float(i * 7919 % 1000)) for i in range(3000)], "g int, seconds double")
    want = {tuple(r) for r in score.timing_summary(rows, "g").collect()}
    monkeypatch.setattr(score, "MANY_GROUPS", 0)
    assert {tuple(r) for r in score.timing_summary(rows, "g").collect()} == want
    assert score.timing_summary(rows.limit(0), "g").count() == 0


def timed(change=lambda r: [r]):
    rows = []
    for case in ("grid", "page"):
        for repeat in range(3):
            for stage, seconds in (("decode", 1.0), ("vision", 2.0), ("generation", 3.0)):
                rows += change((1, case, repeat, 5, stage, seconds))
    return rows


@pytest.mark.parametrize(
    ("change", "want"),
    [
        (lambda r: [r], []),
        (lambda r: [r] if r[1] == "grid" else [], ["cases"]),
        (lambda r: [r, (*r[:1], "other", *r[2:])] if r[1] == "grid" else [r], ["cases"]),
        (lambda r: [(*r[:3], None, *r[4:])], ["tokens"]),
        (lambda r: [r] if r[2] < 2 else [], ["repeats"]),
        (lambda r: [r, r] if r[4] == "vision" else [r], ["repeats", "total"]),
        (lambda r: [r] if r[4] != "vision" else [], ["repeats"]),
        (lambda r: [(*r[:5], float("nan"))] if r[4] == "decode" else [r], ["samples", "total"]),
        (lambda r: [(*r[:5], 2.9999)] if r[4] == "generation" else [r], ["total"]),
        (lambda r: [(*r[:5], 2.9999999)] if r[4] == "generation" else [r], []),
        (lambda r: [], ["cases", "tokens", "repeats", "samples", "total"]),
    ],
)
def test_run_problems(spark, change, want):
    runs = spark.createDataFrame([(1, "float32", 3)], "run int, dtype string, repeats int")
    samples = spark.createDataFrame(timed(change), "run int, case string, repeat int, tokens int, stage string, seconds double")
    policy = {"dtype": "float32", "repeats": 3}
    (r,) = replay.run_problems(runs, samples, policy, ["page", "grid"], ["vision", "decode", "generation"], "generation").collect()
    assert r["problems"] == want
    (r,) = replay.run_problems(runs.withColumn("dtype", F.lit("float16")), samples, policy, ["page", "grid"], ["vision", "decode", "generation"], "generation").collect()
    assert r["problems"] == ["policy", *want]


def all_at_once(rows):
    found = graph.shared_keys(rows, "id", "a", "b")
    linked = graph.components(found.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    return rows.select(F.col("id").alias("node")).join(linked, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def test_components_grow_as_if_made_at_once(spark):
    rng = random.Random(2)
    rows = [(i, f"a{rng.randrange(60)}" if rng.random() < 0.7 else None, f"b{rng.randrange(90)}" if rng.random() < 0.7 else None) for i in range(120)]
    table = lambda part: spark.createDataFrame(part, "id long, a string, b string")
    rng.shuffle(rows)
    steps = [rows[:70], rows[70:71], rows[71:100], [], rows[100:]]
    labels = all_at_once(table(steps[0]))
    index = graph.key_index(table(steps[0]), labels, "id", "a", "b")
    done = list(steps[0])
    for new in steps[1:]:
        labels, index = graph.extend(labels, index, table(new), "id", "a", "b")
        done += new
    want = all_at_once(table(done))
    assert {tuple(r) for r in labels.collect()} == {tuple(r) for r in want.collect()}
    full = graph.key_index(table(done), want, "id", "a", "b")
    assert {tuple(r) for r in index.collect()} == {tuple(r) for r in full.collect()}


def test_digests_tell_nulls_from_texts(spark):
    rows = spark.createDataFrame([("a", None), ("a", ""), ("a", "null"), (None, "a"), ("", "a")], "x string, y string")
    assert rows.select(replay.input_digest("x", "y")).distinct().count() == 5
