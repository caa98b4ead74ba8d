import random
import re

import numpy as np
import pytest

from docflow.llm import neardup
from docflow.llm.components import components


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size, percent):
    sets = [(doc_id, shingles(text, size)) for doc_id, text in rows]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, (_, s) in enumerate(sets):
        near = {j for x in s for j in where[x] if j < i}
        for j in near:
            t = sets[j][1]
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    lowest = {}
    for i, (doc_id, _) in enumerate(sets):
        if doc_id is not None:
            lowest[root(i)] = min(doc_id, lowest.get(root(i), doc_id))
    out = []
    for i, (doc_id, s) in enumerate(sets):
        c = lowest.get(root(i)) if s else doc_id
        out.append((doc_id, len(s), c, doc_id == c if doc_id is not None and c is not None else c is None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_query_matches_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(neardup.op4_minhash_near_dedup(spark, sf_dir)) == brute(docs, 3, 85)


def test_groups_of_edited_copies(spark):
    random.seed(5)
    vocabulary = ["w%d" % i for i in range(400)]
    rows, n = [], 0
    for group in range(12):
        base = [random.choice(vocabulary) for _ in range(random.choice([4, 9, 40, 200]))]
        for copy in range(random.choice([1, 2, 15])):
            own = list(base)
            for _ in range(random.randint(0, max(1, len(own) // 14))):
                own[random.randrange(len(own))] = random.choice(vocabulary)
            rows.append((n, " ".join(own)))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(neardup.near_duplicates(docs, 3, 85)) == brute(rows, 3, 85)
    assert rows_of(neardup.near_duplicates(docs, 5, 80)) == brute(rows, 5, 80)


def test_odd_rows(odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    assert rows_of(neardup.near_duplicates(odd_docs, 3, 85)) == brute(rows, 3, 85)
    assert neardup.near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("n", [3, 50, 3000])
def test_estimates_are_close(n):
    rng = np.random.default_rng(n)
    x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
    y = np.unique(np.concatenate([x[: int(0.9 * n)], rng.integers(0, 2**63, n - int(0.9 * n), dtype=np.uint64)]))
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    a, b = (np.frombuffer(neardup.sketch(s), dtype="<u2") for s in (x, y))
    chance = neardup.expected_collisions(np.array([len(x)]), np.array([len(y)]))[0]
    assert abs(((a == b).sum() - chance) / (neardup.REGISTERS - chance) - true) < 0.2


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(1000, i) for i in range(1001, 1060)]
    edges = spark.createDataFrame([*path, *star, (5, 5), (None, 3)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 1000 for i in range(1000, 1060)}}
    assert components(edges.limit(0)).collect() == []


def test_a_large_group_around_the_threshold(spark, monkeypatch):
    random.seed(11)
    base = ["b%d" % i for i in range(120)]
    rows = []
    for n in range(260):
        own = list(base)
        for _ in range(random.randint(0, 7)):
            own[random.randrange(len(own))] = "x%d" % random.randrange(40)
        rows.append((n, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(neardup, "OUTSIDE_HASHES", 3000)
    monkeypatch.setattr(neardup, "FAMILY_HASHES", 9000)
    assert rows_of(neardup.near_duplicates(docs, 3, 85)) == brute(rows, 3, 85)


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 90, rng.integers(1, 60)).astype(np.uint64)) for _ in range(40)]
    got = neardup.overlaps(sets[:25], sets[25:], columns=16)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[25:]] for a in sets[:25]]


def test_keep_one_judges_rows_by_id_and_text(spark):
    a, b = "one two three four five six seven eight", "quite another text of nine words in a row"
    rows = [(1, a), (2, b), (2, a), (None, a), (None, "only here and nowhere else at all"), (7, ""), (7, ""), (None, None), (None, None), (8, " "), (7, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS k1", "'c' AS id", "'c' AS whole", "'c' AS fp", "'c' AS __key")
    got = neardup.keep_one(docs)
    assert got.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    want = [(1, a), (2, b), (None, "only here and nowhere else at all"), (7, ""), (None, None), (8, " ")]
    assert kept == sorted(want, key=str)


def test_many_tiny_sets_in_a_family(spark, monkeypatch):
    """Ten-shingle texts in one large bucket family: blocks are bounded by classes, the result is whole."""
    random.seed(3)
    rows = []
    for n in range(220):
        own = ["t%d" % i for i in range(12)]
        own[random.choice([0, 11])] = "y%d" % random.randrange(60)
        rows.append((n, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(neardup, "OUTSIDE_CLASSES", 20)
    monkeypatch.setattr(neardup, "FAMILY_CLASSES", 40)
    assert rows_of(neardup.near_duplicates(docs, 3, 80)) == brute(rows, 3, 80)


@pytest.mark.parametrize("small", [2, 32, 1000])
def test_the_border_between_small_and_large_buckets_does_not_show(spark, monkeypatch, small):
    random.seed(9)
    base = ["b%d" % i for i in range(60)]
    rows = []
    for n in range(80):
        own = list(base)
        for _ in range(random.randint(0, 4)):
            own[random.randrange(60)] = "x%d" % random.randrange(20)
        rows.append((n, " ".join(own)))
    monkeypatch.setattr(neardup, "SMALL", small)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(neardup.near_duplicates(docs, 3, 85)) == brute(rows, 3, 85)
