"""What only shows in larger tables: numbers with more digits, tasks that grow, work done again and again."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from docflow.functions import doctags, tables
from docflow.operators import geometry, score
from docflow.plans import catalogue
from docflow.sources import images
from docflow.sources.tables import read_table


def against_sql(spark, folder, name, table):
    """The rows of a query and of its SQL twin over one table of a folder."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    df = catalogue.QUERIES[name](spark, str(folder))
    names = ", ".join(f'"{c}"' for c in df.columns)
    want = con.sql(f"SELECT {names} FROM ({catalogue.ORACLES[name]})").fetchall()
    return sorted(map(str, map(tuple, df.collect()))), sorted(map(str, want))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_page_numbers_of_six_digits_are_kept(spark, tmp_path):
    pages = pa.table({"page_id": [7, 99_999, 100_000, 1_234_567], "url": ["a", "b", "c", "d"], "html": [""] * 4})
    pq.write_table(pages, tmp_path / "pages.parquet")
    got, want = against_sql(spark, tmp_path, "q_page_identity", "pages")
    assert got == want


def test_rows_of_heavy_work_are_dealt_over_tasks_that_do_not_grow(spark, tmp_path):
    pq.write_table(pa.table({"p_partkey": list(range(1000))}), tmp_path / "part.parquet")
    rows = read_table(spark, str(tmp_path), "part", 50)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 20 and sum(sizes) == 1000 and max(sizes) <= 60
    for name in ("q_image_resize", "q_png_pixels", "q_picture_crops", "q_relocate", "q_seal_problems"):
        assert "Exchange RoundRobinPartitioning" in plan(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")), name


def test_resized_images_by_kept_weights():
    assert images.weights(10, 20) is images.weights(10, 20)  # small ones once
    assert images.weights(2000, 20) is not images.weights(2000, 20)  # large ones aren't held


def test_long_texts_are_scored_in_a_band_and_words_in_one_go(spark):
    text = " ".join(f"w{i % 5000}" for i in range(30_000))
    rows = spark.createDataFrame([(text, text.replace("w7 ", "x ") + " end", "eos", 0, True)], "expected string, raw string, stop_reason string, n_diagnostics int, markdown_written boolean")
    scored = score.score_coverage(rows)
    assert "levenshtein(" not in plan(scored) and "array_position" not in plan(scored)
    r = scored.first()
    assert (r["character_edits"], r["word_edits"], r["inventory_matches"]) == (16, 7, 30_000 - 6)


def test_no_band_begins_below_the_distance(monkeypatch):
    passes = []
    monkeypatch.setattr(score, "_banded", lambda *x, own=score._banded: passes.append(x[-1]) or own(*x))
    whole = "the quick brown fox " * 200
    assert score.edit_distance(whole, whole.replace("o", "")) == 400 and not passes
    words = [f"w{i}" for i in range(2000)]
    assert score.edit_distance(words, [w if i % 10 else w + "x" for i, w in enumerate(words)]) == 200 and passes == [200]


def test_table_scores_need_no_join(spark):
    a = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (2, 7)], "k int, v int")
    b = spark.createDataFrame([(1, 5), (1, 9), (3, 7)], "k int, v int")
    found = score.multiset_overlap(a, b, ["v"], ["k"])
    assert "Join" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [(1, 3, 2, 1), (2, 1, 0, 0), (3, 0, 1, 0)]


def test_composed_documents_are_read_once(spark):
    documents = spark.createDataFrame([(1, "# Page 1\n\n| a |\n| --- |\n| b |\n\ntext\n")], "doc long, markdown string")
    found = tables.check_composed(tables.composed_pieces(documents), "doc")
    assert plan(found).count("MapInArrow") == 1 and tuple(found.first()) == (1, 1, 1, 2, [])


def test_mask_extents_are_taken_once(spark):
    mask = geometry.mask_positions(F.col("mask"), 6)
    rows = spark.createDataFrame([([1] * 36,)], "mask array<int>").select(mask.alias("p"))
    assert plan(rows).count("filter(") <= 4  # two extents, two kinds of buckets
    assert rows.first()["p"] == list(range(36))


def test_pages_are_parsed_in_portions():
    page = "x" * (doctags.PORTION // 4 + 1)
    portions = doctags._portions(pa.array([page, None, page, page, page, page, ""]))
    assert len(portions) == 2 and [a for a, _ in portions] == [0, 4] and sum(n for _, n in portions) == 7


def test_plain_tables_need_no_spans(monkeypatch):
    monkeypatch.setattr(doctags, "_extents", None)
    done = doctags.parse_page("<doctag><otsl><ched>a<nl><fcel>b<nl></otsl></doctag>")
    assert [(c["r"], c["rs"], c["cs"], c["text"]) for c in done["cells"]] == [(0, 1, 1, "a"), (1, 1, 1, "b")] and not done["diagnostics"]
