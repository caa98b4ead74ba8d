from collections import Counter

import corpus_pipeline as cp

from docflow.llm import packing, pii, quality


def test_stages_and_run(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in cp.STAGES:
        before = docs.count()
        docs = stage(spark, docs, d)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert docs.columns == list(cp.COLUMNS) and 0 < docs.count() <= before
    kept = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "pii_redaction")).collect()}
    assert not any(pii.base_spans(t) for t in kept.values())
    first = {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "quality_rules")).collect()}
    judged = quality.op9_quality_rules(spark, d).collect()
    assert first == {r["doc_id"] for r in judged if r["kept"]}
    rows = docs.collect()
    assert {r["doc_id"] for r in rows} == set(kept)
    again = cp.run(spark, d).collect()
    digest = lambda x: Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in x)
    assert digest(again) == digest(rows)
    assert max(Counter(r["sequence_id"] for r in rows).values()) >= 1 and packing.CAPACITY == 2048


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    for docs in (odd_docs, no_docs):
        for i, (name, stage) in enumerate(cp.STAGES):
            docs = stage(spark, docs, "/root/testdata/sf0.001")
        docs.collect()
