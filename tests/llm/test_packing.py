import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from docflow.llm import packing


def check_packed(rows, capacity):
    spans = defaultdict(list)
    for r in rows:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in spans.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(spans)


def brute_pieces(rows, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    out = Counter()
    for doc_id, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], dtype="<u4")
            out[(doc_id, piece, at, len(part), zlib.crc32(part.tobytes()))] += 1
    return out


def test_query_matches_brute_force(spark, sf_dir):
    rows = packing.op1_best_fit_packing(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert got == brute_pieces([tuple(r) for r in docs], 2048)
    bins = check_packed(rows, 2048)
    counts = Counter(r["length"] for r in rows)
    assert bins <= sum(m for _, m in packing.best_fit(counts, 2048))


def test_odd_rows(odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs, capacity=64).collect()
    docs = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert got == brute_pieces(docs, 64)
    check_packed(rows, 64)
    assert packing.pack_documents(no_docs).collect() == []


def test_ids_are_kept(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "<|endoftext|> it's")], "doc_id long, text string")
    for r in packing.tokenize_pieces(docs, packing.tokenizer_path(), keep_ids=True).collect():
        assert r["token_ids"][-1] == 0
        assert zlib.crc32(np.array(r["token_ids"], dtype="<u4").tobytes()) == r["ids_crc32"]


def optimum(lengths, capacity):
    """Exact number of bins by trying every place."""
    best = [len(lengths)]
    lengths = sorted(lengths, reverse=True)

    def put(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= lengths[i]}.values():
            put(i + 1, [*rooms[:j], rooms[j] - lengths[i], *rooms[j + 1 :]])
        put(i + 1, [*rooms, capacity - lengths[i]])

    put(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(12))
def test_bin_completion_is_optimal_on_small_cases(seed):
    random.seed(seed)
    lengths = [random.randint(8, 60) for _ in range(11)]
    found = packing.bin_completion(Counter(lengths), 100)
    assert Counter({n: c for n, c in Counter(lengths).items()}) == sum(
        (Counter({n: k * m for n, k in p}) for p, m in found), Counter()
    )
    assert sum(m for _, m in found) == optimum(lengths, 100)


def test_bin_completion_beats_best_fit():
    counts = Counter({6: 1, 5: 1, 4: 2, 3: 3})  # 28 in bins of 10
    assert packing.lower_bound(counts, 10) == 3
    assert sum(m for _, m in packing.bin_completion(counts, 10)) == 3


def test_bad_lengths():
    assert packing.bin_completion({}) == []
    with pytest.raises(ValueError):
        packing.bin_completion({3000: 1})


SIGNS = "aAbBzİıΣσςΟΔéÉé̈ﬁßẞſ日本😀'sStT.,!?-_  ‍09²½ÅKẛ̣한ᄒµªÿ÷×"


@pytest.mark.parametrize("limit", [packing.WORD_CACHE, 200])
def test_ids_of_any_script_are_the_tokenizers(limit):
    import pyarrow as pa

    random.seed(1)
    encoder = packing.WordEncoder(packing.tokenizer_path(), limit)
    texts = [None, "", "ΟΔΟΣ. ŞİRKETİ. ΑΘΗΝΑΣ, J̌ x", "a<|endoftext|>b <|ENDOFTEXT|>. the<|startoftext|>", "p" * 100_000 + " r", "\x00 \x0b\x0c x"]
    for _ in range(2000):
        words = ["".join(random.choice(SIGNS) for _ in range(random.randint(1, 6))) for _ in range(random.randint(0, 9))]
        texts.append(random.choice([" ", "\n", " \t "]).join(words))
    for i in range(0, len(texts), 300):
        ids, ends = encoder.encode(pa.array(texts[i : i + 300], pa.string()))
        start = 0
        for text, end in zip(texts[i : i + 300], ends.tolist()):
            assert ids[start:end].tolist() == encoder.plain(text or "")
            start = end
