import hashlib
import math
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from docflow.llm import imatch

M32 = 2**32 - 1


def signed(x, bits=64):
    return x - 2**bits if x >> (bits - 1) else x


def xx(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed=seed)


def murmur(longs):
    """32-bit Murmur3 of a list of longs, each seeded by the one before."""

    def rotated(x, n):
        return ((x << n) | (x >> (32 - n))) & M32

    h = 42
    for x in longs:
        x &= 2**64 - 1
        for part in (x & M32, x >> 32):
            k = rotated(part * 0xCC9E2D51 & M32, 15) * 0x1B873593 & M32
            h = (rotated(h ^ k, 13) * 5 + 0xE6546B64) & M32
        h ^= 8
        for shift, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            h = (h ^ (h >> shift)) * times & M32
    return signed(h, 32)


def plain(rows, band):
    """The docstring read plainly: (doc_id, n_chars, edited hash, fingerprints, likeness) of each row."""

    def words(text):
        return {w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w}

    def zeros(x):
        return next((i for i in range(15) if x >> i & 1), 15)

    rows = [(i, t or "") for i, t, *_ in rows]
    df = Counter(w for _, t in rows for w in words(t))
    least, most = len(rows) * math.exp(-band[1]), max(1, len(rows) * math.exp(-band[0]))
    lexicon = {}
    for w, n in df.items():
        if least <= n <= most:
            term = signed(xx(w.encode()))
            lexicon[w] = term, [zeros(xx(term.to_bytes(8, "little", signed=True), xx(i.to_bytes(4, "little")))) for i in range(imatch.LEXICONS)]

    def printed(text):
        found = sorted(lexicon[w] for w in words(text) if w in lexicon)
        if not found:
            return -1, signed(xx(text.encode()))
        size = min(14, int(math.log2(len(found))))
        return size, [[murmur(x) if (x := [t for t, of in found if of[i] >= size + k]) else 0 for i in range(imatch.LEXICONS)] for k in (0, 1)]

    def like(a, b):
        if a == b:
            return 1.0
        if min(a[0], b[0]) < 0 or abs(a[0] - b[0]) > 1:
            return 0.0
        same = range(max(a[0], b[0]), min(a[0], b[0]) + 2)
        pairs = [p for s in same for p in zip(a[1][s - a[0]], b[1][s - b[0]]) if any(p)]
        return sum(x == y for x, y in pairs) / len(pairs) if pairs else 0.0

    def shown(x):
        if x[0] < 0:
            return f"text:{x[1] & (2**64 - 1):x}"
        return f"{x[0]}:" + ".".join(f"{h & M32:x}" if h else "" for h in sum(x[1], []))

    def digest(i, t):
        return hashlib.md5(f"{'' if i is None else i}:{t}".encode()).digest()

    each = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, digest(*r)))
    out = {}
    for (i, t), (_, following) in zip(each, [*each[1:], *each[:1]]):
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        own, changed, after = printed(t), printed(edited), printed(following)
        out[i, t] = i, len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(own), shown(changed), like(own, changed), like(own, after)
    return sorted((out[r] for r in rows), key=repr)


def shown(df):
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_odd_documents_against_a_plain_version(odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert shown(imatch.fingerprint_pairs(odd_docs, (0.0, 9.0))) == plain(rows, (0.0, 9.0))


def test_documents_against_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert shown(imatch.fingerprint_pairs(docs, imatch.IDF_BAND)) == plain(rows, imatch.IDF_BAND)


def test_without_broadcast(spark, odd_docs, monkeypatch):
    want = shown(imatch.fingerprint_pairs(odd_docs))
    monkeypatch.setattr(imatch, "MOST_BROADCAST", 0)
    assert shown(imatch.fingerprint_pairs(odd_docs)) == want


def test_none_and_one(spark, no_docs):
    assert imatch.fingerprint_pairs(no_docs).count() == 0
    (r,) = imatch.fingerprint_pairs(spark.createDataFrame([(1, "only one here")], "doc_id long, text string")).collect()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"only one honl").hexdigest()


def test_edits_are_near_and_neighbours_are_not(spark, sf_dir):
    rows = imatch.op11_document_fingerprints(spark, "/root/testdata/sf0.01")
    r = rows.select(F.avg("near_edited").alias("e"), F.avg("near_next").alias("n"), F.avg((F.col("near_edited") > F.col("near_next")).cast("int")).alias("w")).first()
    assert r["e"] > 0.4 and r["n"] < 0.02 and r["w"] > 0.95


def test_no_python_on_the_way(spark, odd_docs):
    plan = imatch.fingerprint_pairs(odd_docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("same", [("a b c", "a b c"), ("", ""), ("A b", "a B")])
def test_equal_texts_equal_fingerprints(spark, same):
    rows = [(i, t) for i, t in enumerate(same)] + [(9, "other words"), (10, "and more")]
    got = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprint_pairs(spark.createDataFrame(rows, "doc_id long, text string"), (0.0, 9.0)).collect()}
    assert got[0] == got[1] != got[9]
