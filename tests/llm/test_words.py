import numpy as np
import pyarrow as pa

from docflow.llm import words

TEXTS = [
    "The cat  sat\n\x0bon", None, "", " a ", "cat", "Cat the", "é日本 É x\x00y", "z" * 2000 + " " + "z" * 2000 + " q",
    "p" * 400_000 + " r " + "P" * 400_000, "a" * 511 + "b " + "a" * 512 + "b", "   ",
]


def split(text):
    return (text or "").encode().lower().split()


def test_words_are_told_apart_and_folded():
    texts = pa.array(TEXTS)
    got = words.words_of(texts)
    flat = [w for t in TEXTS for w in split(t)]
    assert got.ends.tolist() == [0, *np.cumsum([len(split(t)) for t in TEXTS])]
    of = {}
    for word, value in zip(flat, got.hashes.tolist(), strict=True):
        assert of.setdefault(word, value) == value
    assert len(set(of.values())) == len(of)
    part = words.words_of(texts.slice(3, 4))
    assert part.hashes.tolist() == got.hashes[got.ends[3] : got.ends[7]].tolist()
    large = words.words_of(texts.cast(pa.large_string()))
    assert large.hashes.tolist() == got.hashes.tolist()


def test_case_counts_without_folding():
    data, offsets = words.bytes_of(pa.array(["Ab ab AB"]))
    spans = words.spans(data, offsets)
    assert len(set(words.hasher(2, False).hashes(data, *spans).tolist())) == 3
    assert len(set(words.hasher(2, True).hashes(data, *spans).tolist())) == 1


def test_edges_are_left_out():
    edge = np.zeros(256, dtype=bool)
    edge[list(b".,;:!?")] = True
    got = words.words_of(pa.array(["..a.b, c! ... x.", "c", "...", ""]), edge)
    assert got.hashes.tolist() == words.words_of(pa.array(["a.b c ... x", "c", "...", ""])).hashes.tolist()


def test_chunks_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(words, "CHUNK_BYTES", 50)
    texts = [None, "x" * 10, "", "y" * 200, "z" * 49, "w", None] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["i", "t"])
    parts = list(words.chunks(iter([batch, batch.slice(0, 0)])))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 50 for p in parts)


def test_binary_values():
    got = words.as_binary(np.arange(5, dtype=np.uint64), np.array([2, 0, 3]))
    assert [np.frombuffer(x, np.uint64).tolist() for x in got.to_pylist()] == [[0, 1], [], [2, 3, 4]]
