import json
import os
import random
import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from docflow.operators import geometry, jobs
from docflow.sources import images, pdf, tensors
from docflow.streaming import journal


def slow_resize(pixels, wanted, axis):
    """Position by position with Python integers."""
    w = images.weights(pixels.shape[axis], wanted).astype(int)
    moved = np.moveaxis(pixels, axis, 0).astype(int)
    out = np.zeros((wanted, *moved.shape[1:]), dtype=np.uint8)
    for i in range(wanted):
        total = (1 << 21) + sum(int(k) * moved[j] for j, k in enumerate(w[i]) if k)
        out[i] = np.clip(np.where(total <= 0, 0, total >> 22), 0, 255)
    return np.moveaxis(out, 0, axis)


def test_resize_is_exact():
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (23, 31, 3), dtype=np.uint8)
    for size in ((11, 40), (64, 7), (31, 23)):
        want = slow_resize(slow_resize(pixels, size[0], 1), size[1], 0) if size != (31, 23) else pixels
        assert (images.resize(pixels, *size) == want).all()
    flat = np.full((9, 9, 3), 77, np.uint8)
    assert (images.resize(flat, 30, 4) == 77).all()


def test_tiles(spark):
    pixels = np.zeros((100, 900, 3), np.uint8)
    content = bytearray(pdf.write_png(pixels))
    rows = spark.createDataFrame([(1, content), (2, bytearray(b"no image"))], "image_id long, content binary")
    got = images.preprocess(rows).select("image_id", "row", "col", "rows", "cols", F.size("values").alias("n"), "error").collect()
    first = [tuple(r)[1:6] for r in got if r["image_id"] == 1]
    rows_, cols = spark.range(1).select(geometry.resize_plan(F.lit(100), F.lit(900)).alias("p")).first()["p"][4:]
    assert len(first) == rows_ * cols + 1 and first[-1] == (0, 0, rows_, cols, 3 * 512 * 512)
    assert [r["error"] for r in got if r["image_id"] == 2] == ["not a PNG"]


def test_crop():
    pixels = np.arange(40 * 50 * 3, dtype=np.uint32).reshape(40, 50, 3).astype(np.uint8)
    data = pdf.write_png(pixels)
    assert (pdf.read_png(images.crop_picture(data, (100, 250, 300, 499))) == pixels[20:39, 10:30]).all()
    with pytest.raises(ValueError):
        images.crop_picture(data, (1, 1, 2, 2))


def tensor_file(head, payload=b"\0" * 16):
    head = json.dumps(head).encode() if isinstance(head, dict) else head
    return bytearray(struct.pack("<Q", len(head)) + head + payload)


def test_tensor_headers(spark):
    good = {"a": {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}, "b": {"dtype": "BF16", "shape": [2, 2], "data_offsets": [8, 16]}}
    files = [
        tensor_file(good),
        tensor_file(good, b"\0" * 15),
        tensor_file({"a": {"dtype": "I8", "shape": [16], "data_offsets": [0, 16]}}),
        tensor_file(b'{"a": 1, "a": 2}'),
        bytearray(b"x"),
    ]
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "i long, content binary")
    got = rows.select("i", tensors.tensor_header(F.col("content")).alias("h")).orderBy("i").collect()
    assert [t["name"] for t in got[0]["h"]["tensors"]] == ["a", "b"]
    assert all(r["h"]["error"] for r in got[1:])


def test_difference_report(spark):
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(1.0), F.lit(2.5))
    x = spark.range(1).select(tensors.difference_report(a, b, 0.1, 0.1).alias("x")).first()["x"]
    assert (x["largest"], x["outside"], x["finite"]) == (0.5, 1, True)


def shown(rows):
    return sorted((tuple(str(v) for v in (r["job"], r["page"], r["attempt"], r["codes"], r["markdown"], r["error"])) for r in rows.collect()))


def test_stream_equals_batch(spark, tmp_path):
    at, out, marks = (str(tmp_path / x) for x in ("journal", "out", "check"))
    rng = random.Random(3)

    def row(page, attempt):
        if rng.random() < 0.3:
            return ("j" if page % 3 else None, page, attempt, None, None, None, f"boom {attempt}")
        text = f"<doctag><text>page {page} of {attempt}</text></doctag>" + "x" * (rng.random() < 0.2)
        return ("j" if page % 3 else None, page, attempt, text, [1], rng.choice(["eos", "eos", "length", "other"]), None)

    rows = [row(rng.randrange(25), rng.choice([None, 1, 2, 3])) for _ in range(200)]
    rows += rng.sample(rows, 40)  # repeated records
    for batch in range(4):
        part = spark.createDataFrame(rows[batch::4], jobs.RECORD)
        part.repartition(2).write.mode("append").parquet(at)
        journal.start(spark, at, out, marks, files_per_trigger=1 + batch % 2).awaitTermination()
    whole = journal.convert(jobs.latest_records(spark.createDataFrame(rows, jobs.RECORD)))
    assert shown(journal.pages(spark, out)) == shown(whole)
    written = spark.read.parquet(out).count()
    assert whole.count() <= written < len(rows) / 2


def test_failed_then_good_then_late(spark, tmp_path):
    at, out, marks = (str(tmp_path / x) for x in ("journal", "out", "check"))
    raw = "<doctag><text>{}</text></doctag>"
    steps = [
        [("j", 1, 1, None, None, None, "boom"), ("j", 2, 3, raw.format("kept"), [1], "eos", None)],
        [("j", 1, 2, raw.format("good"), [1], "eos", None)],
        [("j", 2, 1, raw.format("older"), [1], "eos", None), ("j", 1, 9, None, None, None, "a failure doesn't undo a page")],
    ]
    for rows in steps:
        spark.createDataFrame(rows, jobs.RECORD).coalesce(1).write.mode("append").parquet(at)
        journal.start(spark, at, out, marks).awaitTermination()
    assert {r["page"]: (r["attempt"], r["markdown"]) for r in journal.pages(spark, out).collect()} == {1: (2, "good\n"), 2: (3, "kept\n")}
    # files written long before the watermark are too late
    spark.createDataFrame([("j", 3, 1, raw.format("new"), [1], "eos", None)], jobs.RECORD).coalesce(1).write.mode("append").parquet(at)
    journal.start(spark, at, out, marks).awaitTermination()
    known = set(Path(at).glob("*.parquet"))
    spark.createDataFrame([("j", 4, 1, raw.format("late"), [1], "eos", None)], jobs.RECORD).coalesce(1).write.mode("append").parquet(at)
    for f in set(Path(at).glob("*.parquet")) - known:
        os.utime(f, (1_600_000_000, 1_600_000_000))
    journal.start(spark, at, out, marks).awaitTermination()
    assert {r["page"] for r in journal.pages(spark, out).collect()} == {1, 2, 3}


def published(spark, at, rows, day):
    """Rows appended to a journal by a file that was written on the given day."""
    known = set(Path(at).glob("*.parquet"))
    spark.createDataFrame(rows, jobs.RECORD).coalesce(1).write.mode("append").parquet(at)
    for f in set(Path(at).glob("*.parquet")) - known:
        os.utime(f, (1_600_000_000 + day * 86_400,) * 2)


def test_a_page_never_falls_back(spark, tmp_path):
    at, out, marks = (str(tmp_path / x) for x in ("journal", "out", "check"))
    good = ("j", 1, 2, "<doctag><text>good</text></doctag>", [1], "eos", None)
    published(spark, at, [good], 0)
    journal.start(spark, at, out, marks).awaitTermination()
    published(spark, at, [("j", 2, 1, None, None, None, "boom")], 15)  # page 1 was written two weeks ago
    journal.start(spark, at, out, marks).awaitTermination()
    published(spark, at, [("j", 1, 3, None, None, None, "timeout"), ("j", 1, 1, "<doctag><text>older</text></doctag>", [1], "eos", None)], 16)
    journal.start(spark, at, out, marks).awaitTermination()
    assert {r["page"]: (r["attempt"], r["markdown"], r["error"]) for r in journal.pages(spark, out).collect()} == {1: (2, "good\n", None), 2: (1, None, "boom")}
    assert spark.read.parquet(out).count() == 2


def test_no_page_of_a_stream_is_a_python_group(spark, tmp_path):
    at, out, marks = (str(tmp_path / x) for x in ("journal", "out", "check"))
    published(spark, at, [("j", p, a, f"<doctag><text>{p} {a}</text></doctag>", [1], "eos", None) for p in range(40) for a in (1, 2, 2)], 0)
    query = journal.start(spark, at, out, marks)
    query.awaitTermination()
    told = [s for p in query.recentProgress for s in p["stateOperators"]]
    assert {s["operatorName"] for s in told} == {"dedupeWithinWatermark"}
    assert told[0]["numRowsTotal"] == 80  # repeated records are kept once
    assert [r["markdown"] for r in journal.pages(spark, out).orderBy("page").collect()] == [f"{p} 2\n" for p in range(40)]


def test_a_batch_that_was_not_committed_replaces_itself(spark, tmp_path):
    at, out, marks = (str(tmp_path / x) for x in ("journal", "out", "check"))
    row = lambda page, attempt: ("j", page, attempt, f"<doctag><text>{attempt}</text></doctag>", [1], "eos", None)
    published(spark, at, [row(1, 1), row(2, 2)], 0)
    journal.start(spark, at, out, marks).awaitTermination()
    published(spark, at, [row(1, 2), row(2, 1), row(3, 1)], 1)
    query = journal.start(spark, at, out, marks)
    query.awaitTermination()
    number = next(p["batchId"] for p in query.recentProgress if p["numInputRows"])
    for log in ("offsets", "commits"):
        for f in Path(marks, log).iterdir():
            if int(f.name.strip(".").split(".")[0]) >= number + (log == "offsets"):
                f.unlink()
    before = shown(journal.pages(spark, out))
    rows = spark.read.parquet(out).count()
    again = journal.start(spark, at, out, marks)
    again.awaitTermination()
    assert number in [p["batchId"] for p in again.recentProgress if p["numInputRows"]]
    assert shown(journal.pages(spark, out)) == before and spark.read.parquet(out).count() == rows == 4
