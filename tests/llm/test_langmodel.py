import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from docflow.llm import langmodel


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def brute(rows):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(t for (_, text), h in zip(rows, held) if not h for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for (i, text), h in zip(rows, held):
        own = tokens(text)
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own)
        out.append((i, h, len(own), sum(counts[t] > 0 for t in own), n, base))
    return out


def same(df, rows):
    got = sorted(df.collect(), key=lambda r: str(tuple(r)[:5]))
    want = sorted(brute(rows), key=lambda r: str(r[:5]))
    assert [tuple(r)[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(sorted(got, key=lambda r: (str(r[:5]), r[5])), sorted(want, key=lambda r: (str(r[:5]), r[5]))):
        assert g["base_score"] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert g["score"] <= 0 and math.isfinite(g["score"])
    return got


def test_query_matches_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = same(langmodel.op10_lm_scoring(spark, sf_dir), docs)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_rare_tokens_go_through_the_join(spark, sf_dir, monkeypatch):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    monkeypatch.setattr(langmodel, "FREQUENT", 40)
    same(langmodel.op10_lm_scoring(spark, sf_dir), docs)


def test_odd_rows(odd_docs, no_docs):
    same(langmodel.score_documents(odd_docs), [tuple(r) for r in odd_docs.select("doc_id", "text").collect()])
    assert langmodel.score_documents(no_docs).collect() == []


def test_filter_never_underestimates():
    rng = np.random.default_rng(3)
    keys = rng.integers(-(2**62), 2**62, 20_000)
    levels = rng.integers(1, 12, len(keys))
    rows = langmodel._slice_of(keys)
    bits = np.zeros((langmodel.SLICES, langmodel.SLICE_BITS // 8), dtype=np.uint8)
    for s in range(langmodel.SLICES):
        own = rows == s
        bits[s] = np.frombuffer(langmodel.LogFrequencyFilter.slice_bits(keys[own], levels[own]), dtype=np.uint8)
    found = langmodel.LogFrequencyFilter(bits)
    assert (found.levels(keys) >= levels).all()
    assert (found.levels(keys) == levels).mean() > 0.98
    assert (found.levels(rng.integers(-(2**62), 2**62, 20_000)) > 0).mean() < 0.05


def test_levels_stand_for_their_counts():
    for c in (1, 2, 3, 10, 1000, 10**6):
        q = math.floor(math.log(c) / math.log(langmodel.BASE) + 1e-9) + 1
        assert langmodel.value(np.array([q]))[0] == pytest.approx(c, rel=0.35)


def brute_scores(rows):
    """Scores of the quantised bigram model over all words, without a filter."""
    uni, bi = Counter(), Counter()
    for i, text in rows:
        if not langmodel.in_fold(i):
            own = tokens(text)
            uni.update(own)
            bi.update(zip([None, *own[:-1]], own))

    def quantised(c):
        q = math.floor(math.log(c) / math.log(langmodel.BASE) + 1e-9) + 1 if c else 0
        return float(langmodel.value(np.array([q]))[0])

    n, once = sum(uni.values()), sum(c == 1 for c in uni.values())
    unseen, seen = min(0.5, max(1, once) / max(n, 2)), 1 - once / max(n, 1) or 0.5
    out = []
    for i, text in rows:
        own, score = tokens(text), 0.0
        for a, b in zip([None, *own[:-1]], own):
            before, c = quantised(uni[a]), quantised(uni[b])
            single = min(seen * c / max(n, 1), 1.0) if c else unseen
            both = min(quantised(bi[a, b]), before)
            score += math.log10((both + langmodel.PRIOR * single) / (before + langmodel.PRIOR))
        out.append((i, score))
    return out


@pytest.mark.parametrize("capacity", [None, 20_000, 0])
def test_no_ngram_is_left_out(spark, sf_dir, monkeypatch, capacity):
    """All words have bigrams; what the filter can't hold is joined: scores don't depend on its size."""
    if capacity is not None:
        monkeypatch.setattr(langmodel, "CAPACITY", capacity)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r["doc_id"], r["score"]) for r in langmodel.op10_lm_scoring(spark, sf_dir).collect())
    for (i, x), (j, y) in zip(got, sorted(brute_scores(docs)), strict=True):
        assert i == j and x == pytest.approx(y, rel=1e-9 if capacity == 0 else 1e-3)
