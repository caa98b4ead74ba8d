import random
import time
import zlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from docflow.functions.doctags import parse_doctags
from docflow.operators import build, compose, corpus, geometry, graph, jobs, score, supervise
from docflow.sources import pdf


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(90, 91), (91, 92)], "a long, b long")
    got = {r["node"]: r["label"] for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(31)}, 90: 90, 91: 90, 92: 90}
    assert graph.components(edges.limit(0)).collect() == []


def test_preflight_reasons(spark):
    rows = [
        ("a", "s1", "train", "i1", "t1", "c1", True, "t1"),
        ("b", "s2", "final", "i2", "t2", "c1", True, "t2"),
        ("c", "s3", "train", "i3", "t3", "c3", False, None),
        ("d", "s4", "train", "i4", "t4", "c4", True, "t4"),
    ]
    pages = spark.createDataFrame(rows, "id string, source_id string, split string, image string, target string, content string, renderable boolean, approved_target string")
    sources = spark.createDataFrame([("s1", True, True, True, False), ("s2", True, True, False, True), ("s3", True, True, False, False)], "source_id string, allowed boolean, reviewed boolean, quarantined boolean, development boolean")
    got = {r["id"]: r["reasons"] for r in corpus.evaluate_candidates(pages, sources).collect()}
    assert got == {
        "a": ["quarantined-source", "cross-split-component", "duplicate-page"],
        "b": ["quarantined-component", "cross-split-component", "development-source-in-final", "duplicate-page"],
        "c": ["target-not-reviewed", "native-target-rejected"],
        "d": ["source-not-approved", "source-review-incomplete"],
    }


@pytest.mark.parametrize(("a", "b", "n"), [("", "", 0), ("a b", "a c d", 2), ("x y z", "", 3), ("a b c", "b c", 1)])
def test_edit_distance(a, b, n):
    assert score.edit_distance(a.split(), b.split()) == n


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


@pytest.mark.parametrize("band", [1, 2, 5, 32])
def test_banded_distance_by_the_whole_table(band, monkeypatch):
    monkeypatch.setattr(score, "FIRST_BAND", band)
    rng = random.Random(band)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(14))) for _ in range(2))
        assert score.edit_distance(a, b) == plain_distance(a, b)
    for _ in range(10):
        a = [rng.choice("abcdé😀") for _ in range(300)]
        b = list(a)
        for _ in range(rng.randrange(80)):
            k = rng.randrange(len(b) - 3)
            b[k : k + rng.randrange(3)] = rng.choices("abcdé😀", k=rng.randrange(3))
        assert score.edit_distance(a, "".join(b)) == plain_distance(a, b)
    whole = "".join(rng.choice("abcdefgh ") for _ in range(100_000))
    assert score.edit_distance(whole, whole.replace("e", "")) == whole.count("e")


def test_unreviewed_pages_stay_null_and_failures_score_as_empty(spark):
    rows = [("t", "ab cd", "ab cd", "eos", 0, None), ("t", "ab cd", "ab cd", "length", 0, None), ("t", None, "x", "eos", 0, None), ("t", "ab", None, "eos", 0, "boom")]
    cases = spark.createDataFrame(rows, "split string, reference string, markdown string, stop_reason string, n_diagnostics int, error string")
    scored = score.score_cases(cases).collect()
    assert [r["accepted"] for r in scored] == [True, False, None, False]
    assert [r["character_edits"] for r in scored] == [0, 5, None, 2]
    s = score.summarize(score.score_cases(cases)).first()
    assert (s["pages"], s["reviewed"], s["accepted"], s["character_edits"], s["reference_characters"]) == (4, 3, 1, 7, 12)


def test_composition_order_is_checked(spark):
    raw = build.page(build.leaf("text", F.col("t")))
    rows = spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 2, "b"), (2, 5, 1, "x"), (2, 4, 2, "y")], "doc long, page long, position long, t string")
    pages = rows.select("doc", "page", "position", raw.alias("raw"), F.lit("eos").alias("stop_reason"), parse_doctags(raw).alias("parsed"))
    got = {r["doc"]: r for r in compose.compose(pages, "doc", "page").collect()}
    assert got[1]["markdown"] == "# Page 1\n\na\n\n---\n\n# Page 2\n\nb\n" and got[1]["status"] == "complete"
    assert got[2]["status"] == "failed" and got[2]["fatal_error"] == "page order"


def test_bundles_refuse_existing_folders(spark, tmp_path):
    files = spark.createDataFrame([(1, "page-1.doctags", "x"), (1, "MANIFEST", "{}")], "doc long, path string, content string")
    compose.write_bundle(files, str(tmp_path / "out"))
    with pytest.raises(Exception, match="exists"):
        compose.write_bundle(files, str(tmp_path / "out"))


def test_jobs_resume_and_isolate_failures(spark, tmp_path):
    selected = spark.createDataFrame([("j", p) for p in range(1, 6)], "job string, page long")
    at = str(tmp_path / "journal")

    def failing(page):
        if page == 3:
            raise RuntimeError("page failed")
        return "<doctag></doctag>", [1, 2], "eos"

    first = jobs.run_job(spark, selected, failing, at).withColumn("n_diagnostics", F.lit(0))
    assert jobs.job_report(first).first()["status"] == "failed"
    todo = jobs.missing_pages(selected, spark.read.schema(jobs.RECORD).parquet(at))
    assert [r["page"] for r in todo.collect()] == [3]
    again = jobs.run_job(spark, selected, lambda p: ("<doctag></doctag>", [1], "eos"), at)
    assert again.count() == 5 and jobs.valid_records(again).count() == 5
    report = jobs.job_report(again.withColumn("n_diagnostics", F.lit(0))).first()
    assert (report["pages"], report["status"]) == (5, "complete")
    kept = spark.read.schema(jobs.RECORD).parquet(at)
    assert kept.count() == 6 and [r["attempt"] for r in kept.where("page = 3").orderBy("attempt").collect()] == [1, 2]


def test_a_changed_request_is_refused(spark, tmp_path):
    selected = spark.createDataFrame([("j", 1), ("j", 2)], "job string, page long")
    at, made = str(tmp_path / "journal"), lambda p: ("<doctag></doctag>", [1], "eos")
    jobs.run_job(spark, selected, made, at, {"model": "a", "dpi": 144})
    jobs.run_job(spark, selected.orderBy(F.desc("page")), made, at, {"dpi": 144, "model": "a"})
    for rows, request in ((selected, {"model": "b", "dpi": 144}), (selected.where("page = 1"), {"model": "a", "dpi": 144}), (selected, None)):
        with pytest.raises(jobs.RequestChanged):
            jobs.run_job(spark, rows, made, at, request)
    assert not (tmp_path / "journal" / "_lock").exists()


def test_a_locked_journal_is_left_alone(spark, tmp_path):
    selected = spark.createDataFrame([("j", 1)], "job string, page long")
    (tmp_path / "journal").mkdir()
    (tmp_path / "journal" / "_lock").write_text("")
    with pytest.raises(jobs.JobLocked):
        jobs.run_job(spark, selected, lambda p: ("<doctag></doctag>", [1], "eos"), str(tmp_path / "journal"))
    assert [f.name for f in (tmp_path / "journal").iterdir()] == ["_lock"]


def test_two_runs_at_once_give_an_attempt_each(spark, tmp_path):
    selected = spark.createDataFrame([("j", p) for p in range(4)], "job string, page long")
    at = str(tmp_path / "journal")
    slow = tmp_path / "slow"

    def made(page):
        while not slow.exists():
            time.sleep(0.05)
        return "<doctag></doctag>", [1], "eos"

    with ThreadPoolExecutor(3) as pool:
        first = pool.submit(jobs.run_job, spark, selected, made, at)
        while not (tmp_path / "journal" / "_lock").exists():
            time.sleep(0.05)
        with pytest.raises(jobs.JobLocked):
            jobs.run_job(spark, selected, made, at)
        others = [pool.submit(jobs.run_job, spark, selected, made, at, None, False) for _ in range(2)]
        while len(list((tmp_path / "journal" / "_claims").glob("attempt-*"))) < 3:
            time.sleep(0.05)
        assert not list((tmp_path / "journal").glob("attempt=*"))
        slow.write_text("go")
        counts = [x.result().count() for x in (first, *others)]
    assert counts == [4, 4, 4]
    assert sorted(p.name for p in (tmp_path / "journal").glob("attempt=*")) == ["attempt=1", "attempt=2", "attempt=3"]
    latest = jobs.latest_records(jobs.read_journal(spark, at))
    assert {r["attempt"] for r in latest.collect()} == {3}


def test_a_run_that_dies_publishes_nothing(spark, tmp_path, monkeypatch):
    selected = spark.createDataFrame([("j", 1)], "job string, page long")
    at, made = str(tmp_path / "journal"), lambda p: ("<doctag></doctag>", [1], "eos")

    def dies(self, old, new):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(jobs._Folder, "move", dies)
        with pytest.raises(OSError):
            jobs.run_job(spark, selected, made, at)
    assert jobs.read_journal(spark, at).count() == 0
    (r,) = jobs.run_job(spark, selected, made, at).collect()
    assert r["attempt"] == 2


def test_supervision(spark):
    tokens = F.array(*[F.lit(t) for t in (9, 5, 6, 7, 1)])
    x = one(spark, supervise.answer_supervision(tokens, F.lit(2), 1, 9, F.lit(7), 0))
    assert (x["ids"], x["labels"], x["mask"]) == ([9, 5, 6, 7, 1, 0, 0], [-100, -100, 6, 7, 1, -100, -100], [1] * 5 + [0] * 2)
    for bad in ((9, 5, 6, 7), (9, 5, 1, 7, 1), (9, 5, 9, 7, 1)):
        assert one(spark, supervise.answer_supervision(F.array(*[F.lit(t) for t in bad]), F.lit(2), 1, 9)) is None


def test_patchify_and_shuffle_against_numpy(spark):
    values = list(range(2 * 4 * 6))
    column = F.array(*[F.lit(float(v)) for v in values])
    a = np.array(values, dtype=float).reshape(2, 4, 6)
    want = a.reshape(2, 2, 2, 3, 2).transpose(1, 3, 0, 2, 4).reshape(-1)
    assert one(spark, geometry.patchify(column, 2, 4, 6, 2)) == want.tolist()
    f = np.arange(48, dtype=float).reshape(4, 4, 3)
    want = f.reshape(2, 2, 2, 2, 3).transpose(0, 2, 1, 3, 4).reshape(-1)
    assert one(spark, geometry.pixel_shuffle(column, 4, 3, 2)) == want.tolist()


@pytest.mark.parametrize(("h", "w", "want"), [(512, 512, (2048, 2048, 2048, 2048, 4, 4)), (100, 4000, (52, 2048, 512, 2048, 1, 4)), (3000, 100, (2048, 68, 2048, 512, 4, 1))])
def test_resize_plan(spark, h, w, want):
    assert tuple(one(spark, geometry.resize_plan(F.lit(h), F.lit(w)))) == want


def test_grid_boxes_are_never_clipped(spark):
    box = lambda *v: geometry.box_to_grid(*[F.lit(x) for x in v])
    assert one(spark, box(0, 0, 1000, 10, 1000, 20)) == [0, 0, 499, 250]
    assert one(spark, box(10, 0, 5, 10, 1000, 20)) is None and one(spark, box(0, 0, 1001, 10, 1000, 20)) is None
    assert one(spark, box(1, 1, 3, 3, 1000, 1000)) == [0, 0, 2, 2]


@pytest.mark.parametrize(("text", "pages"), [("1,3-5", [1, 3, 4, 5]), ("7", [7]), ("3,1", None), ("1-", None), ("1-17", None), ("2,2", None), ("0", None), ("", None)])
def test_page_selection(spark, text, pages):
    assert one(spark, pdf.page_selection(F.lit(text))) == pages


def test_png(spark):
    rng = np.random.default_rng(0)
    pixels = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    data = pdf.write_png(pixels)
    assert (pdf.read_png(data) == pixels).all()
    row = spark.createDataFrame([(bytearray(data),)], "content binary").select(pdf.png_size(F.col("content")).alias("x")).first()["x"]
    assert tuple(row) == (7, 5)
    with pytest.raises(ValueError):
        pdf.read_png(data[:-20])
    broken = bytearray(data)
    broken[45] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        pdf.read_png(bytes(broken))


def test_coverage_of_grids(spark):
    cells = lambda rows: F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("r", "c", "rs", "cs"), x)]) for x in rows])
    good, overlap = [(0, 0, 2, 1), (0, 1, 1, 1), (1, 1, 1, 1)], [(0, 0, 2, 2), (0, 1, 1, 1)]
    assert one(spark, build.covered_once(cells(good), F.lit(2), F.lit(2))) is True
    assert one(spark, build.covered_once(cells(overlap), F.lit(2), F.lit(2))) is False


def _table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_against_the_table():
    import random

    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(90))] for _ in range(2))
        assert score.edit_distance(a, b) == _table_distance(a, b)


def test_word_rates_take_whole_texts(spark, tmp_path):
    from docflow.plans import catalogue

    texts = ["The one line", "Here\nare three\nlines été", None, "\nfirst line empty, see  日本 the\trest", "é", "nothing lost\nbut lines"]
    rows = [(i, t, "en") for i, t in enumerate(texts, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    edits = words = 0
    for _, text, _ in rows:
        own = (text or "").split()
        if own:
            edits += _table_distance(own, (text or "").replace("e", "").split())
            words += len(own)
    got = catalogue.QUERIES["q_wer_micro"](spark, str(tmp_path)).first()
    assert (got["word_edits"], got["reference_words"]) == (edits, words)
