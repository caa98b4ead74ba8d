import re
from collections import Counter

from docflow.llm import quality


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(w, w[1:], w[2:]))
    counts = Counter(windows)
    cover = {i + k for i, x in enumerate(windows) if counts[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return (
        n,
        sum(map(len, w)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(cover),
        n < 50 or 100 * len(cover) > 50 * n,
    )


def test_measures(spark, odd_docs, no_docs):
    more = [(90, "a b c " * 3), (91, "x y z x y z x"), (92, "a a a a"), (93, "# | <b> &\n\n# | <b> &\n \n"), (94, "q w e r q w e")]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = sorted(
        (
            (r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
             r["fail_bits"] & quality.mask("base") != 0)
            for r in quality.ledger(docs).collect()
        ),
        key=str,
    )
    assert got == sorted(((r["doc_id"], *plain(r["text"])) for r in docs.collect()), key=str)
    assert quality.ledger(no_docs).collect() == []


def test_query_and_ablations(spark, sf_dir):
    rows = quality.op9_quality_rules(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in rows:
        assert tuple(r)[1:7] == plain(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])
    found = quality.ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for a in quality.ablations(found).collect():
        bit = 1 << quality.BIT[a["rule"]]
        assert a["n_failed"] == sum(bool(r["fail_bits"] & bit) for r in rows)
        assert a["n_only_this"] == sum(r["fail_bits"] & quality.mask("v1") == bit for r in rows)


def test_reject_keeps_columns_and_good_rows(spark, odd_docs):
    good = " ".join(f"word{i}" for i in range(80))
    docs = odd_docs.limit(3).unionByName(odd_docs.limit(1).selectExpr("77L AS doc_id", f"'{good}' AS text", *[c for c in odd_docs.columns[2:]]))
    kept = quality.reject(docs)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [77]
