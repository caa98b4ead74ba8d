import random

import numpy as np

from docflow.llm import decontaminate as d


def plain_score(a, b):
    """Smith-Waterman cell by cell."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(
                0, h[i - 1][j - 1] + (d.MATCH if x == y else d.MISMATCH), h[i - 1][j] + d.GAP, h[i][j - 1] + d.GAP
            )
            best = max(best, h[i][j])
    return best


def test_alignment_against_a_plain_table():
    random.seed(2)
    for _ in range(60):
        a = [random.randrange(6) for _ in range(random.randint(1, 12))]
        b = [random.randrange(6) for _ in range(random.randint(0, 25))]
        score, start, end = d.align(np.array(a), np.array(b, dtype=int))
        assert score == plain_score(a, b)
        if score:
            assert 0 <= start < end <= len(b)
            assert d.align(np.array(a), np.array(b[start:end]))[0] == score


def brute(docs, items):
    out = set()
    strip = lambda t: [w.strip(d._EDGE.decode()) or w for w in (t or "").lower().split()]
    for doc_id, text in docs:
        w = strip(text)
        for item_id, item in items:
            v = strip(item)
            if v and len({*v} & {*w}) >= 0.4 * len({*v}):
                if d.align(*(np.array([hash(x) for x in y]) for y in (v, w)))[0] >= d.SHARE * d.MATCH * len(v):
                    out.add((doc_id, item_id))
    return out


def test_query_matches_alignment_of_all_pairs(spark):
    at = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in d.op8_benchmark_decontamination(spark, at).collect()}
    assert got == brute(docs, items) and got


def test_edited_copies(spark):
    random.seed(4)
    words = ["v%d" % i for i in range(3000)]
    item = [random.choice(words) for _ in range(40)]
    edited = list(item)
    for i in (5, 13, 22, 31):
        edited[i] = "other"
    del edited[17]
    edited.insert(27, "more")
    noise = lambda n: [random.choice(words) for _ in range(n)]
    rows = [
        (1, " ".join(noise(300) + item + noise(50))),
        (2, " ".join(noise(30) + edited + noise(500)).upper()),
        (3, " ".join(noise(600))),
        (4, " ".join(noise(60) + item[:12] + noise(60))),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    assert {r["doc_id"] for r in d.contaminated(docs, items).collect()} == {1, 2}
    assert {r["doc_id"] for r in d.clean_only(docs, items).collect()} == {3, 4}


def test_odd_rows(spark, odd_docs, no_docs):
    kind = "item_id long, text string, seeds string"
    items = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "word", "c"), (4, "tie tie tie. tie tie tie.", "c")], kind)
    got = sorted((r["doc_id"], r["item_id"]) for r in d.contaminated(odd_docs, items).collect())
    assert got == [(4, 3), (4, 3), (7, 4)]
    left = d.clean_only(odd_docs, items)
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count() - 3
    assert d.contaminated(no_docs, items).collect() == []
    assert d.contaminated(odd_docs, items.limit(0)).collect() == []


def test_seeds_do_not_thin_out(monkeypatch):
    """With the same word shares, an item keeps the same seeds in a corpus of any size."""
    text = " ".join(f"w{i % 40}" for i in range(0, 400, 7))
    items, parts = d._items([{"item_id": 1, "text": text}])

    def seeds(times):
        def counts(docs, vocabulary):
            return {int(w): times * (200 + 800 * i) for i, w in enumerate(vocabulary)}, times * 4_000_000

        monkeypatch.setattr(d, "_frequencies", counts)
        return d._rare(items, parts, None).seeds.tolist()

    assert 0 < len(seeds(1)) and seeds(1) == seeds(1200)


def test_recall_by_edit_rate(spark):
    """Against the alignment of all pairs: copies with every k-th word replaced are found down to SHARE."""
    random.seed(6)
    words = ["v%d" % i for i in range(2000)]
    items = [(i, " ".join(random.choice(words) for _ in range(30))) for i in range(12)]
    rows = []
    for i, text in items:
        for k in (2, 3, 4, 6, 10):
            own = text.split()
            own[k - 1 :: k] = ["x%d" % random.randrange(500) for _ in own[k - 1 :: k]]
            rows.append((10 * i + k % 10, " ".join([*random.choices(words, k=40), *own, *random.choices(words, k=20)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in d.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    number = {w: i for i, w in enumerate(sorted({w for _, t in [*rows, *items] for w in t.split()}))}
    want = set()
    for j, text in rows:
        for i, item in items:
            a, b = (np.array([number[w] for w in t.split()]) for t in (item, text))
            if d.align(a, b)[0] >= d.SHARE * d.MATCH * len(a):
                want.add((j, i))
    assert got == want and len(want) >= 4 * len(items)


def changed(kind, k, own, rng):
    """A copy with an edit behind every k-th word (or after each for k = 1)."""
    out = []
    for i, w in enumerate(own):
        last = i % k == k - 1
        if kind == "replace" and last:
            out.append(f"x{rng.randrange(500)}")
        elif kind != "delete" or not last:
            out.append(w)
        if last and kind.startswith("insert"):
            out += [f"x{rng.randrange(500)}" for _ in range(int(kind[6:]))]
    return out


def all_pairs(rows, items):
    number = {w: i for i, w in enumerate(sorted({w for _, t in [*rows, *items] for w in t.split()}))}
    coded = lambda t: np.array([number[w] for w in t.split()])
    items = [(i, coded(t)) for i, t in items]
    return {(j, i) for j, t in rows for i, a in items if d.align(a, coded(t))[0] >= d.SHARE * d.MATCH * len(a)}


def found_pairs(spark, rows, items):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in d.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_recall_by_kind_and_rate_of_edits(spark):
    """Against the alignment of all pairs: insertions, deletions and replacements down to SHARE, each rate by itself."""
    rng = random.Random(8)
    words = [f"v{i}" for i in range(4000)]
    items = [(i, " ".join(rng.choices(words, k=60))) for i in range(6)]
    kinds = [("insert1", 1), ("insert1", 2), ("insert1", 3), ("insert2", 2), ("insert2", 3), ("delete", 3), ("delete", 4), ("replace", 3), ("replace", 5)]
    rows = [
        (100 * e + i, " ".join([*rng.choices(words, k=50), *changed(kind, k, text.split(), rng), *rng.choices(words, k=30)]))
        for e, (kind, k) in enumerate(kinds) for i, text in items
    ]
    want, got = all_pairs(rows, items), found_pairs(spark, rows, items)
    assert got == want
    for e, kind in enumerate(kinds):
        reached = {p for p in want if p[0] // 100 == e}
        assert len(reached) == len(items), kind


def test_recall_of_mixed_edits(spark):
    """Random edits of all kinds at once: nine of ten copies that reach SHARE are found at every rate."""
    rng = random.Random(9)
    words = [f"v{i}" for i in range(4000)]
    items = [(i, " ".join(rng.choices(words, k=50))) for i in range(8)]
    rates, rows = (0.1, 0.2, 0.3, 0.4), []
    for e, rate in enumerate(rates):
        for n in range(5):
            for i, text in items:
                own = []
                for w in text.split():
                    kind = rng.choice(["insert", "delete", "replace"]) if rng.random() < rate else "keep"
                    own += {"keep": [w], "insert": [w, f"x{rng.randrange(900)}"], "delete": [], "replace": [f"x{rng.randrange(900)}"]}[kind]
                rows.append((1000 * e + 100 * n + i, " ".join([*rng.choices(words, k=40), *own, *rng.choices(words, k=40)])))
    want, got = all_pairs(rows, items), found_pairs(spark, rows, items)
    assert got <= want
    for e, rate in enumerate(rates):
        reached = {p for p in want if p[0] // 1000 == e}
        assert not reached or len(got & reached) >= 0.9 * len(reached), rate
    assert sum(p[0] // 1000 >= 2 for p in want) > 40


def test_a_very_common_seed(spark):
    """An item of one word over and over: its seeds are everywhere in a text of the same word."""
    rows = [(1, "same " * 20_000), (2, "other words of no item at all " * 50)]
    assert found_pairs(spark, rows, [(1, "same " * 30), (2, "same " * 10 + "but different")]) == {(1, 1), (1, 2)}
