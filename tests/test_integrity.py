"""Inventories, relocation and tensor files against plain versions."""

import hashlib
import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from docflow.operators import inventory
from docflow.sources import tensors


def files(spark, rows):
    return spark.createDataFrame(rows, inventory.IDENTITY)


def test_identities_of_files_links_and_folders(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 3_000_000)
    (tmp_path / "empty").write_bytes(b"")
    os.symlink(tmp_path / "a.bin", tmp_path / "link")
    (tmp_path / "folder").mkdir()
    names = ["a.bin", "empty", "link", "folder", "none"]
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in names], "path string")
    got = {os.path.basename(r["path"]): tuple(r)[1:] for r in inventory.file_identities(paths).collect()}
    assert got["a.bin"] == ("file", 3_000_000, hashlib.sha256(b"x" * 3_000_000).hexdigest())
    assert got["empty"] == ("file", 0, hashlib.sha256(b"").hexdigest())
    assert [got[n][0] for n in ("link", "folder", "none")] == ["link", "folder", "missing"]
    uri = spark.createDataFrame([(f"file://{tmp_path}/a.bin",), (f"file:{tmp_path}/a.bin",)], "path string")
    assert {r["bytes"] for r in inventory.file_identities(uri).collect()} == {3_000_000}


def test_trees_by_subtree(spark):
    x = [("a/b/c.txt", "file", 3, "1"), ("a/d.txt", "file", 4, "2"), ("e.txt", "file", 5, "3"), ("f/g", "file", 1, "4")]
    y = [("a/b/c.txt", "file", 3, "1"), ("a/d.txt", "file", 4, "9"), ("e.txt", "link", None, None), ("h/i", "file", 1, "4")]
    left, right = files(spark, x), files(spark, y)
    states = {r["folder"]: r["state"] for r in inventory.tree_diff(left, right).collect()}
    assert states == {"": "changed", "a": "changed", "a/b": "same", "f": "missing", "h": "extra"}
    assert {tuple(r) for r in inventory.file_diff(left, right).collect()} == {("a/d.txt", "changed"), ("e.txt", "linked"), ("f/g", "missing"), ("h/i", "extra")}
    assert inventory.file_diff(left, left).count() == 0
    assert inventory.tree(left.limit(0)).count() == 0


def test_moved_content_changes_a_tree(spark):
    """Equal digests under other names, or of two files that swap their contents."""
    x = files(spark, [("a/x", "file", 1, "1"), ("a/y", "file", 1, "2")])
    y = files(spark, [("a/x", "file", 1, "2"), ("a/y", "file", 1, "1")])
    assert {r["state"] for r in inventory.tree_diff(x, y).collect()} == {"changed"}


def test_folder_inventories(spark):
    rows = [("m1", n, "file", 1, "0" * 64) for n in inventory.ADAPTER_FILES] + [("m2", n, "file", 1, "0" * 64) for n in (*inventory.ADAPTER_FILES, "more")]
    rows += [("m3", inventory.ADAPTER_FILES[0], "link", None, None), ("m4", inventory.ADAPTER_FILES[1], "file", 7, "1" * 64)]
    table = spark.createDataFrame(rows, "folder string, name string, kind string, bytes long, sha256 string")
    got = {r["folder"]: r["files"] for r in inventory.folder_inventory(table, "folder", "name", inventory.ADAPTER_FILES).collect()}
    assert got["m2"] is None and got["m3"] is None
    assert json.loads(got["m1"]) == {n: {"sha256": "0" * 64, "bytes": 1} for n in inventory.ADAPTER_FILES}
    assert json.loads(got["m4"]) == {inventory.ADAPTER_FILES[0]: None, inventory.ADAPTER_FILES[1]: {"sha256": "1" * 64, "bytes": 7}}


def bundle(**change):
    one = {"sha256": "0" * 64, "bytes": 3}
    base = {n: one if n in inventory.NEEDED_BASE_FILES else None for n in inventory.BASE_FILES}
    adapter = dict.fromkeys(inventory.ADAPTER_FILES, one)
    whole = {
        "manifest": {"schema_version": 1, "base_files": base, "adapter_files": adapter}, "base_files": base, "adapter_files": adapter,
        "config": {"r": 8, "base_model_name_or_path": "/old/"}, "target": "/new//",
    }
    return {k: v if isinstance(v, str) else json.dumps(v) for k, v in (whole | {k: f(whole[k]) for k, f in change.items()}).items()}


@pytest.mark.parametrize(
    ("change", "error"),
    [
        ({}, None),
        ({"manifest": lambda m: {**m, "schema_version": True}}, "manifest"),
        ({"manifest": lambda m: {**m, "schema_version": 1.5}}, "manifest"),
        ({"manifest": lambda m: {**m, "more": 1}}, "manifest"),
        ({"manifest": lambda m: json.dumps(m)[:-1] + ',"schema_version":1}'}, "manifest"),
        ({"manifest": lambda m: {**m, "base_files": {**m["base_files"], "config.json": None}}}, "base inventory"),
        ({"manifest": lambda m: {**m, "adapter_files": {n: {"sha256": "0" * 64, "bytes": "3"} for n in inventory.ADAPTER_FILES}}}, "adapter inventory"),
        ({"manifest": lambda m: {**m, "adapter_files": {n: {"sha256": "0" * 64, "bytes": -3} for n in inventory.ADAPTER_FILES}}}, "adapter inventory"),
        ({"adapter_files": lambda a: {**a, "adapter_config.json": {"sha256": "1" * 64, "bytes": 3}}}, "adapter changed"),
        ({"base_files": lambda b: dict(reversed(b.items()))}, None),
        ({"base_files": lambda b: {**b, "README.md": {"sha256": "1" * 64, "bytes": 3}}}, "base changed"),
        ({"config": lambda c: {**c, "revision": "main"}}, "config"),
        ({"config": lambda c: {**c, "revision": None}}, None),
        ({"config": lambda c: {**c, "base_model_name_or_path": "hub/model"}}, "config"),
        ({"config": lambda c: [c]}, "config"),
    ],
)
def test_relocation(spark, change, error):
    (r,) = inventory.relocate(spark.createDataFrame([bundle(**change)])).collect()
    assert r["error"] == error and (r["receipt"] is None) == (error is not None)
    if error is None:
        staged = json.loads(r["staged_config"])
        assert staged["base_model_name_or_path"] == "/new/" and staged["r"] == 8
        receipt = json.loads(r["receipt"])
        assert receipt["changed_config_fields"] == ["base_model_name_or_path"] and receipt["source_base"] == "/old/"
        assert receipt["staged_config_sha256"] == hashlib.sha256(r["staged_config"].encode()).hexdigest()


def write(path, head, payload):
    head = json.dumps(head).encode()
    path.write_bytes(struct.pack("<Q", len(head)) + head + payload)


def test_payloads_by_ranges(spark, tmp_path):
    left, right = tmp_path / "left", tmp_path / "right"
    left.mkdir(), right.mkdir()
    values = np.arange(10_000, dtype="<f4")
    moved = values.copy()
    moved[7_777] += 1
    odd = values.astype("<f2")[:100]
    broken = odd.copy()
    broken[3] = np.inf

    def head(a, b):
        return {"a": {"dtype": "F32", "shape": a, "data_offsets": [0, 40_000]}, "b": {"dtype": "F16", "shape": b, "data_offsets": [40_000, 40_200]}}

    write(left / "same.st", head([100, 100], [100]), values.tobytes() + odd.tobytes())
    write(right / "same.st", {"__metadata__": {"k": "v"}, **head([100, 100], [100])}, values.tobytes() + odd.tobytes())
    write(left / "moved.st", head([100, 100], [100]), values.tobytes() + odd.tobytes())
    write(right / "moved.st", head([100, 100], [10, 10]), moved.tobytes() + odd.tobytes())
    write(left / "odd.st", head([100, 100], [100]), values.tobytes() + odd.tobytes())
    write(right / "odd.st", head([100, 100], [100]), values.tobytes() + broken.tobytes())
    write(left / "bad.st", head([100, 100], [100]), values.tobytes())
    (right / "more.st").write_bytes(b"")
    x, y = (tensors.tensor_ranges(spark, str(at), 4096) for at in (left, right))
    assert x.where("file = 'same.st' AND tensor = 'a'").count() == 10
    got = {(r["file"], r["tensor"]): (r["state"], r["differing"]) for r in tensors.compare_payloads(x, y).collect()}
    assert got == {
        ("same.st", "a"): ("equal", 0), ("same.st", "b"): ("equal", 0), ("moved.st", "a"): ("changed", 1), ("moved.st", "b"): ("shape", 0),
        ("odd.st", "a"): ("equal", 0), ("odd.st", "b"): ("nonfinite", 1), ("bad.st", None): ("unreadable", 0), ("more.st", None): ("unreadable", 0),
    }


def test_files_written_are_files_read(spark, tmp_path):
    rows = [(f"d/{t % 2}.st", f"t{t}", [5, 3], at, [float(t * 100 + at * 3 + i) for i in range(3)]) for t in range(5) for at in range(5)]
    table = spark.createDataFrame(rows, "file string, tensor string, shape array<long>, at long, values array<double>").repartition(7)
    written = {r["file"]: r["tensors"] for r in tensors.write_tensor_files(table, str(tmp_path)).collect()}
    assert written == {"d/0.st": 3, "d/1.st": 2} and not list(tmp_path.rglob("*.part"))
    for r in tensors.tensor_ranges(spark, str(tmp_path)).collect():
        t = int(r["tensor"][1:])
        assert r["error"] is None and np.frombuffer(r["content"], "<f4").tolist() == [float(t * 100 + i) for i in range(15)]
    content = spark.createDataFrame([(bytearray((tmp_path / "d/0.st").read_bytes()),)], "c binary")
    assert len(content.select(tensors.tensor_header(F.col("c")).alias("h")).first()["h"]["tensors"]) == 3
