"""Benchmark decontamination: rare n-gram seeds, then local alignment.

Word n-grams of the test items are seeds: three words in a row, and three of
four with the third left open. In the texts three words in a row are looked up, and
three with one or two more before the third, and three with one between each.
A seed's hash knows its words but not their places, so each form of the one meets each form
of the other: a word put in, left out or replaced behind two others still leaves
a seed. An aligned word costs on average at most one inserted word or half a
replaced or lost one if the score is to reach ``SHARE`` = 0.5, so somewhere in such a
copy two words follow each other and the third is at most that far off, or one inserted
word stands before each: these forms are all that is needed, but where the ends of
an item make up the average.

Rarity comes from the corpus: a seed is used if, by the corpus frequencies of its
words, at most ``EXPECTED`` of ``SEED_WORDS`` places would have it by chance in
one form, however large the corpus is: an item's seeds don't thin out as it grows. Where words
without such a seed could make up a copy by themselves, their seeds are used too. Copies of a leaked passage, however many,
don't make its own seeds look common.
Passages around seed hits are aligned with the item by Smith-Waterman over words; a document is contaminated by an
item if the aligned score reaches ``SHARE`` of the item's perfect score, which
also finds edited copies.

The benchmark is read to every worker only while it is small: its words are
counted first, and above ``MOST_WORDS`` it is dealt with in blocks of items,
each within that bound.

Defined results: words are cut at ASCII white space and compared without
A-Z case and without punctuation at their ends; a null or empty text or item
has no words and matches nothing; items shorter than an n-gram are one seed as
a whole. Repeated rows give a row each; items with one item_id are one item
if their texts are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm.common import need, table
from docflow.llm.words import chunks, mix
from docflow.llm.words import words_of as hashed_words

N = 3
#: Places of a seed's words in an item, by the words that it has at least, and in a text.
SHAPES = {1: ((0,),), 2: ((0, 1),), N: ((0, 1, 2), (0, 1, 3))}
TEXT_SHAPES = {1: ((0,),), 2: ((0, 1), (0, 2), (0, 3)), N: ((0, 1, 2), (0, 1, 3), (0, 1, 4), (0, 2, 4))}
EXPECTED = 1.0
#: Words that chance places are counted in; a smaller corpus counts as it is.
SEED_WORDS = 4_000_000
SHARE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of items that one block holds.
MOST_WORDS = 2_000_000
_EDGE = b".,;:!?\"'()[]{}<>*#%&$|"
_MUL = np.uint64(0x9E3779B97F4A7C15)


_STRIPPED = np.zeros(256, dtype=bool)
_STRIPPED[list(_EDGE)] = True


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and where each text starts and the last ends."""
    words = hashed_words(texts, _STRIPPED)
    return words.hashes, words.ends


def _mask(sorted_hashes: np.ndarray) -> np.ndarray:
    """A small table over leading bits that most other hashes miss."""
    out = np.zeros(1 << 20, dtype=bool)
    out[(sorted_hashes >> np.uint64(44)).astype(np.int64)] = True
    return out


def _found(sorted_hashes: np.ndarray, mask: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``hashes`` are among the sorted ones, and where there."""
    maybe = np.flatnonzero(mask[(hashes >> np.uint64(44)).astype(np.int64)])
    at = np.searchsorted(sorted_hashes, hashes[maybe])
    at[at == len(sorted_hashes)] = 0
    hit = sorted_hashes[at] == hashes[maybe] if len(sorted_hashes) else np.zeros(len(maybe), bool)
    return maybe[hit], at[hit]


def grams(flat: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Hashes of the words at all places of a shape in a row of words; shapes of as many words have the same hashes."""
    size = max(0, len(flat) - shape[-1])
    with np.errstate(over="ignore"):
        out = flat[:size] + np.uint64(len(shape))
        for i in shape[1:]:
            out = mix(out * _MUL + flat[i : size + i])
    return out


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman over words: best score, and where it starts and ends in the passage.

    Rows of the table are computed at once; a gap in the passage is a running
    maximum along the row.
    """
    width = len(passage)
    steps = np.arange(width + 1) * -GAP
    score = np.zeros(width + 1, dtype=np.int64)
    start = np.arange(width + 1)
    best = (0, 0, 0)
    for word in item:
        diagonal = score[:-1] + np.where(passage == word, MATCH, MISMATCH)
        up = score[1:] + GAP
        new, own = np.zeros(width + 1, dtype=np.int64), np.arange(width + 1)
        new[1:] = np.maximum(np.maximum(diagonal, up), 0)
        own[1:] = np.where(diagonal >= up, start[:-1], start[1:])
        own[1:] = np.where(new[1:] > 0, own[1:], np.arange(1, width + 1))
        lifted = new + steps
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(width + 1), 0))
        score, start = top - steps, own[source]
        at = int(score.argmax())
        if score[at] > best[0]:
            best = (int(score[at]), int(start[at]), at)
    return best


@dataclass
class Items:
    """A block of items as arrays: bounded by MOST_WORDS."""

    ids: list
    words: list[np.ndarray]
    seeds: np.ndarray  # sorted
    owners: np.ndarray  # item per seed
    places: np.ndarray  # place of the seed in its item
    reach: np.ndarray  # place of its last word
    mask: np.ndarray | None = None  # of the seeds, made where it is used
    last: np.ndarray | None = None  # behind the seeds equal to one, likewise
    kinds: np.ndarray | None = None  # words of a seed of each item, likewise


def _items(rows: list) -> tuple[Items, np.ndarray]:
    """Items with all their seeds, and each seed's words (short seeds padded with 0)."""
    flat, ends = words_of(pa.array([r["text"] for r in rows], pa.string()))
    words = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
    seeds, owners, places, reach, own = [], [], [], [], []
    for i, w in enumerate(words):
        for shape in SHAPES.get(min(N, len(w)), ()):
            g = grams(w, shape)
            seeds.append(g)
            owners.append(np.full(len(g), i))
            places.append(np.arange(len(g)))
            reach.append(np.arange(len(g)) + shape[-1])
            padded = np.zeros((len(g), N), dtype=np.uint64)
            for k, at in enumerate(shape):
                padded[:, k] = w[at : at + len(g)]
            own.append(padded)
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    s, o, p, r = cat(seeds, np.uint64), cat(owners, np.int64), cat(places, np.int64), cat(reach, np.int64)
    parts = np.concatenate(own) if own else np.zeros((0, N), np.uint64)
    order = np.argsort(s, kind="stable")
    return Items([r["item_id"] for r in rows], words, s[order], o[order], p[order], r[order]), parts[order]


def _frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[dict[int, int], int]:
    """Corpus counts of the items' words (no more rows than words), and of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total, mask = np.zeros(len(vocabulary) + 1, dtype=np.int64), 0, _mask(vocabulary)
        for batch in chunks(batches):
            flat, _ = words_of(batch.column(1))
            counts += np.bincount(_found(vocabulary, mask, flat)[1], minlength=len(counts))
            total += len(flat)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*some.tolist(), -1], pa.int64()), pa.array([*counts[some].tolist(), total], pa.int64())],
            names=["word", "c"],
        )

    rows = need(docs, doc_id="long", text="string").mapInArrow(run, "word long, c long")
    got = {r["word"]: r["c"] for r in rows.groupBy("word").agg(F.sum("c").alias("c")).collect()}
    total = got.pop(-1, 0)
    return {int(vocabulary[i]): c for i, c in got.items()}, total


def _rare(items: Items, parts: np.ndarray, docs: DataFrame) -> Items:
    """Only seeds that chance would hardly make, and those of the words that such seeds leave open.

    If the words of an item in no rare seed are enough for a score of ``SHARE``, a
    copy of them alone has to be found too: the item keeps the seeds that lie
    wholly among them. An item without a rare seed so keeps all of its seeds.
    """
    if not len(items.seeds):
        return items
    vocabulary = np.unique(parts[parts != 0])
    counts, total = _frequencies(docs, vocabulary)
    share = np.array([counts.get(int(w), 0) for w in vocabulary], dtype=float) / max(total, 1)
    at = np.searchsorted(vocabulary, parts)
    at[at == len(vocabulary)] = 0
    p = np.where(parts == 0, 1.0, share[at])
    rare = min(total, SEED_WORDS) * p.prod(axis=1) <= EXPECTED
    sizes = np.array([len(w) for w in items.words], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    begin, end = starts[items.owners] + items.places, starts[items.owners] + items.reach
    steps = np.zeros(starts[-1] + 1, dtype=np.int64)
    np.add.at(steps, begin[rare], 1)
    np.add.at(steps, end[rare] + 1, -1)
    bare = np.cumsum(steps) == 0
    bare[starts[1:] - 1] = False  # between items
    n_bare = np.add.reduceat(bare, starts[:-1]) if len(sizes) else sizes
    open_items = (sizes > 0) & (n_bare >= SHARE * sizes)
    rare |= open_items[items.owners] & bare[begin] & bare[end]
    return Items(items.ids, items.words, items.seeds[rare], items.owners[rare], items.places[rare], items.reach[rare])


def _hits(flat: np.ndarray, ends: np.ndarray, items: Items, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, item and place where the item would begin, for every seed that stands in one text in the shape."""
    if items.mask is None:
        items.mask = _mask(items.seeds)
        items.last = np.searchsorted(items.seeds, items.seeds, side="right")
        items.kinds = np.array([min(N, len(w)) for w in items.words], dtype=np.int64)
    places, at = _found(items.seeds, items.mask, grams(flat, shape))
    text = np.searchsorted(ends, places, side="right") - 1
    inside = places + shape[-1] < ends[text + 1]
    places, at, text = places[inside], at[inside], text[inside]
    times = items.last[at] - at
    first = np.repeat(at - np.concatenate([[0], np.cumsum(times)[:-1]]) if len(at) else at, times)
    seeds = first + np.arange(len(first))
    owners = items.owners[seeds]
    fit = items.kinds[owners] == len(shape)
    return np.repeat(text, times)[fit], owners[fit], (np.repeat(places, times) - items.places[seeds])[fit]


def _windows(begins: list[int], size: int) -> list[tuple[int, int]]:
    """Windows of twice the item around the places where it would begin, merged where they meet."""
    out: list[tuple[int, int]] = []
    for b in begins:
        a, z = b - size // 2 - 1, b + size + size // 2 + 1
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], z
        else:
            out.append((a, z))
    return out


def _matches(flat: np.ndarray, ends: np.ndarray, items: Items) -> list[tuple]:
    """(text, item, score, start, end) of every contaminated pair among a chunk of texts."""
    shortest = min((len(w) for w in items.words if len(w)), default=N)
    shapes = [shape for n in range(min(N, shortest), N + 1) for shape in TEXT_SHAPES[n]]
    found = [_hits(flat, ends, items, shape) for shape in shapes]
    texts, owners, begins = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.lexsort((begins, owners, texts))
    texts, owners, begins = texts[order], owners[order], begins[order]
    new = np.flatnonzero((np.diff(texts, prepend=-1) != 0) | (np.diff(owners, prepend=-1) != 0))
    out = []
    for i, z in zip(new.tolist(), [*new[1:].tolist(), len(texts)]):
        text, item = int(texts[i]), int(owners[i])
        w = items.words[item]
        best, need_score = (0, 0, 0), SHARE * MATCH * len(w)
        for low, high in _windows(np.unique(begins[i:z]).tolist(), len(w)):
            low, high = max(low, int(ends[text])), min(high, int(ends[text + 1]))
            # no more can be matched than the window has of the item's words
            if MATCH * int(np.isin(w, flat[low:high]).sum()) < need_score:
                continue
            score, start, end = align(w, flat[low:high])
            if score > best[0]:
                best = (score, low + start - int(ends[text]), low + end - int(ends[text]))
        if best[0] >= need_score:
            out.append((text, item, best[0] / (MATCH * len(w)), best[1], best[2]))
    return out


def _blocks(benchmark: DataFrame) -> list[list]:
    """Distinct items in blocks of at most MOST_WORDS words; one block for usual benchmarks."""
    items = need(benchmark, item_id="long", text="string").distinct()
    sized = items.withColumn("size", F.length("text"))
    whole = sized.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-whole // (2 * MOST_WORDS)))
    return [
        items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i).orderBy("item_id", "text").collect()
        for i in range(parts)
    ]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word: one row for each row and item that it holds.

    ``score`` is the alignment's share of the item's perfect score.
    """
    found = None
    for rows in _blocks(benchmark):
        part = _marked(docs, rows)
        found = part if found is None else found.unionByName(part)
    return found


def _prepared(docs: DataFrame, rows: list):
    items, parts = _items(rows)
    return docs.sparkSession.sparkContext.broadcast(_rare(items, parts, docs))


def _marked(docs: DataFrame, rows: list) -> DataFrame:
    shared = _prepared(docs, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in chunks(batches):
            if not len(items.seeds):
                continue
            ids = batch.column(0).to_pylist()
            got = _matches(*words_of(batch.column(1)), items)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[t] for t, *_ in got], pa.int64()),
                    pa.array([items.ids[i] for _, i, *_ in got], pa.int64()),
                    pa.array([x[2] for x in got], pa.float64()),
                    pa.array([x[3] for x in got], pa.int64()),
                    pa.array([x[4] for x in got], pa.int64()),
                ],
                names=["doc_id", "item_id", "score", "start_word", "end_word"],
            )

    return need(docs, doc_id="long", text="string").mapInArrow(
        run, "doc_id long, item_id long, score double, start_word long, end_word long"
    )


def clean_only(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, columns unchanged.

    Each row is judged where it is: no join by id, no shuffle of texts.
    """
    kept = docs
    for rows in _blocks(benchmark):
        kept = _without(kept, rows)
    return kept


def _without(docs: DataFrame, rows: list) -> DataFrame:
    shared = _prepared(docs, rows)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in chunks(batches, at):
            keep = np.ones(batch.num_rows, dtype=bool)
            if len(items.seeds):
                for t, *_ in _matches(*words_of(batch.column(at)), items):
                    keep[t] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and the alignment."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
