"""Language-model scores from a log-frequency Bloom filter.

The model is a bigram model over all tokens that backs off to a unigram model.
Counts cover every training document and every bigram in it. They are quantised
on a logarithmic scale, and an n-gram with level q is put into the filter as the
q items (n-gram, 1) ... (n-gram, q); a count is read back by probing 1, 2, ...
until an item is absent. The filter has a fixed number of bits. If the corpus
has more items than it holds at half load, the n-grams of the lowest levels are
not put in (of the last level that finds room, a share by hash is); positions that need one of them are joined with the table of those
n-grams instead. So what is broadcast is bounded and no n-gram is lost: the
scores are the same by either way, up to the filter's false positives.

The exact counts of the base score don't come from the filter: a bounded table
of the most frequent tokens is looked up in place, all other tokens of a
document are joined with the full count table.

Tokens are told apart by 64-bit hashes. Defined results: a null or empty text
has the end token only; a null doc_id counts as the empty text for the fold;
equal rows get equal results; with no training token, V and N are 0.
"""

from __future__ import annotations

import gc
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm.common import durable, need, table
from docflow.llm.words import chunks, mix, words_of

FOLDS, HELD_OUT = 7, 2
#: Tokens whose exact counts every worker holds: 12 bytes each.
FREQUENT = 1 << 19
#: Filter: bits, slices, probes per item, base of the count scale.
FILTER_BITS = 1 << 29
SLICES = 256
#: Steps of a level's share.
TICKETS = 1 << 10
PROBES = 5
BASE = 1.5
#: Weight of the unigram model in a bigram's estimate, in counts.
PRIOR = 100.0
END = -0x5851F42D4C957F2D
#: Distinct hashes that a counting task holds before it passes them on.
COUNT_BUFFER = 1_500_000

SLICE_BITS = FILTER_BITS // SLICES
CAPACITY = int(FILTER_BITS * math.log(2) / PROBES)
_SALT = np.uint64(0x9E3779B97F4A7C15)


def in_fold(doc_id: int | None) -> bool:
    """Held out: crc32 of the id as text, modulo FOLDS."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of the texts, each text closed by END, and the texts' token counts."""
    words = words_of(texts)
    return np.insert(words.hashes.view(np.int64), words.ends[1:], END), np.diff(words.ends) + 1


class _Counts:
    """Counts of 64-bit keys, merged in place."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += len(self.parts[-1][0])

    def flush(self) -> pa.RecordBatch:
        keys = np.concatenate([k for k, _ in self.parts]) if self.parts else np.zeros(0, np.int64)
        n = np.concatenate([c for _, c in self.parts]) if self.parts else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        sums = np.add.reduceat(n, first) if len(keys) else n
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(keys[first], pa.int64()), pa.array(sums, pa.int64())], ["key", "c"])


def _counted(docs: DataFrame, keys_of) -> DataFrame:
    """(key, c): counts over the training documents of ``keys_of(tokens, lengths)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in chunks(batches):
            mine = batch.filter(pa.array([not in_fold(i) for i in batch.column(0).to_pylist()], pa.bool_()))
            if mine.num_rows:
                counts.add(keys_of(*token_hashes(mine.column(1))))
            if counts.size > COUNT_BUFFER:
                yield counts.flush()
        yield counts.flush()

    rows = need(docs, doc_id="long", text="string").mapInArrow(run, "key long, c long")
    return rows.groupBy("key").agg(F.sum("c").alias("c"))


def _top(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (sorted) and counts of at most ``most`` of the most frequent keys.

    The cut is a count from a histogram of eighths of octaves, at most 512 rows.
    """
    eighth = F.floor(8 * F.log2("c"))
    bins = sorted(((r["b"], r["n"]) for r in counts.groupBy(eighth.alias("b")).agg(F.count("*").alias("n")).collect()))
    total, cut = 0, None
    for b, n in reversed(bins):
        if total + n > most:
            break
        total, cut = total + n, b
    if cut is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    got = counts.where(eighth >= F.lit(cut)).toArrow()
    keys, c = got.column("key").to_numpy().astype(np.int64), got.column("c").to_numpy().astype(np.int64)
    order = np.argsort(keys)
    return keys[order], c[order]


def level(c):
    """Quantised count as a column or number: 1 for 1, one more for each factor BASE."""
    return (F.floor(F.log(c) / F.lit(math.log(BASE)) + F.lit(1e-9)) + 1).cast("long")


def value(q: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of its range, exact for 0 and 1."""
    low = np.ceil(np.power(BASE, q - 1) - 1e-6)
    high = np.ceil(np.power(BASE, q) - 1e-6) - 1
    return np.where(q > 0, (low + np.maximum(low, high)) / 2, 0.0)


def _value(q):
    """``value`` as a column."""
    low, high = (F.ceil(F.pow(F.lit(BASE), q - d) - 1e-6) for d in (1, 0))
    return F.when(q > 0, (low + F.greatest(low, high - 1)) / 2.0).otherwise(0.0)


def _places(keys: np.ndarray, j: int) -> list[np.ndarray]:
    """Bit numbers in its slice of item (key, j), one array per probe."""
    with np.errstate(over="ignore"):
        h = mix(keys.view(np.uint64) + np.uint64(j) * _SALT)
        step = mix(h ^ _SALT) | np.uint64(1)
        return [((h + np.uint64(i) * step) % np.uint64(SLICE_BITS)).astype(np.int64) for i in range(PROBES)]


def _slice_of(keys: np.ndarray) -> np.ndarray:
    return keys & (SLICES - 1)


def _ticket(keys: np.ndarray) -> np.ndarray:
    """A number below TICKETS per key, of other bits than the slice's."""
    return (keys >> 12) & (TICKETS - 1)


class LogFrequencyFilter:
    """Levels of n-gram keys by repeated membership probes."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits  # uint8, SLICES rows

    @staticmethod
    def slice_bits(keys: np.ndarray, levels: np.ndarray) -> bytes:
        """One slice's bits with all its items put in."""
        bits = np.zeros(SLICE_BITS // 8, dtype=np.uint8)
        for j in range(1, int(levels.max(initial=0)) + 1):
            for at in _places(keys[levels >= j], j):
                np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        return bits.tobytes()

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels by probing items 1, 2, ...; a key leaves at its first bit that isn't set."""
        out = np.zeros(len(keys), dtype=np.int64)
        flat, width = self.bits.reshape(-1), SLICE_BITS // 8
        first = _slice_of(keys) * width
        live, j = np.arange(len(keys)), 1
        while len(live):
            with np.errstate(over="ignore"):
                h = mix(keys[live].view(np.uint64) + np.uint64(j) * _SALT)
                step = mix(h ^ _SALT) | np.uint64(1)
                for _ in range(PROBES):
                    at = (h % np.uint64(SLICE_BITS)).astype(np.int64)
                    hit = (flat[first[live] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1
                    live, h, step = live[hit], h[hit], step[hit]
                    h += step
            out[live] = j
            j += 1
        return out


def _before(tokens: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
    """The token before each one; ``start`` before the first of a text."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)] = start
    return before


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((left.view(np.uint64) * _SALT + right.view(np.uint64)) ^ np.uint64(0x1234567)).view(np.int64)


def _bigram_keys(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Keys of the bigrams; the first token's context is END."""
    return pair_keys(_before(tokens, lengths, END), tokens)


@dataclass
class Model:
    """What the workers get: bounded arrays and a few numbers."""

    n: int  # training tokens
    v: int  # distinct training tokens
    keys: np.ndarray  # frequent tokens, sorted
    counts: np.ndarray
    bits: np.ndarray
    low: list[tuple[int, int]]  # of unigrams and bigrams: least level that the filter holds, tickets of the level below
    unseen: float  # probability of all tokens without a count
    seen: float  # what is left for the others

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.n + self.v + 1))

    def probability(self, both: np.ndarray, before: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Of a token, from the counts of the bigram, the context and the token."""
        # quantised counts may sum to a little more than there is
        single = np.where(own > 0, np.minimum(self.seen * own / max(self.n, 1), 1.0), self.unseen)
        return (np.minimum(both, before) + PRIOR * single) / (before + PRIOR)

    def scores(self, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
        """Sum of log10 probabilities of the tokens given the one before, and what it lacks, per text.

        Positions with an n-gram that the filter may have left out are not summed but
        listed: keys and levels (-1 where to be joined) of bigram, context and token.
        """
        kept = LogFrequencyFilter(self.bits)
        some, back = np.unique(tokens, return_inverse=True)
        single = self._held(kept.levels(some), some, 0)
        left = _before(back, lengths, int(np.searchsorted(some, END)))
        pairs, place = np.unique(left * len(some) + back, return_inverse=True)
        a, b = pairs // len(some), pairs % len(some)
        keys = pair_keys(some[a], some[b])
        both = self._held(kept.levels(keys), keys, 1)
        lacking = (both < 0) | (single[a] < 0) | (single[b] < 0)
        each = np.log10(self.probability(value(both), value(single[a]), value(single[b])))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        sums = np.add.reduceat(np.where(lacking, 0.0, each)[place], starts)
        at = np.flatnonzero(lacking[place])
        text = np.searchsorted(starts, at, side="right") - 1
        asked, times = np.unique(text * len(pairs) + place[at], return_counts=True)
        text, of = asked // len(pairs), asked % len(pairs)
        before_key, own_key = (np.where(single[x[of]] < 0, some[x[of]], 0) for x in (a, b))
        columns = [keys[of], before_key, own_key, both[of], single[a[of]], single[b[of]], times]
        ends = np.searchsorted(text, np.arange(len(lengths) + 1))
        rows = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in columns], names=list(ASKED))
        return sums, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    def _held(self, levels: np.ndarray, keys: np.ndarray, order: int) -> np.ndarray:
        """Levels as read, -1 where the n-gram may be among those left out; a lower level is a false positive."""
        low, tickets = self.low[order]
        least = low - (_ticket(keys) < tickets)
        return np.where((least > 1) & (levels < least), -1, levels)


ASKED = ("both_key", "before_key", "own_key", "both", "before", "own", "t")


def _least(low: tuple[int, int]):
    """The least level held of each key, as a column."""
    ticket = F.shiftright("key", 12).bitwiseAND(F.lit(TICKETS - 1))
    return F.lit(low[0]) - (ticket < low[1]).cast("long")


def _filter(unigrams: DataFrame, bigrams: DataFrame) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The filter's bits, and for unigrams and bigrams the least level it holds and the tickets held of the level below."""
    both = [x.select("key", level(F.col("c")).alias("q")) for x in (unigrams, bigrams)]
    low, room = [], CAPACITY
    for order, items in enumerate(both):
        sizes = sorted(((r["q"], r["n"]) for r in items.groupBy("q").agg(F.count("*").alias("n")).collect()), reverse=True)
        free, own = room // 2 if order == 0 else room, (1, 0)
        for q, n in sizes:
            if q * n > free:
                own = (q + 1, int(TICKETS * free / (q * n)))
                free -= q * n * own[1] // TICKETS
                room -= q * n * own[1] // TICKETS
                break
            free, room = free - q * n, room - q * n
        low.append(own)

    def build(group: pa.Table) -> pa.Table:
        keys, q = group.column("key").to_numpy(), group.column("q").to_numpy()
        return pa.table(
            {
                "slice": group.column("slice").slice(0, 1),
                "bits": pa.array([LogFrequencyFilter.slice_bits(keys, q)], pa.binary()),
            }
        )

    chosen = [x.where(F.col("q") >= _least(y)) for x, y in zip(both, low)]
    built = durable(
        chosen[0].unionByName(chosen[1])
        .select(F.col("key").bitwiseAND(F.lit(SLICES - 1)).alias("slice"), "key", "q")
        .groupBy("slice")
        .applyInArrow(build, "slice long, bits binary")
    )
    bits = np.zeros((SLICES, SLICE_BITS // 8), dtype=np.uint8)
    _drop_shuffles(unigrams.sparkSession)
    for r in built.toLocalIterator():
        bits[r["slice"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return bits, low


def _drop_shuffles(spark: SparkSession) -> None:
    """The counts are stored: Spark deletes their shuffle files once the plans behind them are collected."""
    gc.collect()
    spark._jvm.System.gc()


def train(docs: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """The model, and the full count tables (key, c) of unigrams and bigrams, durable."""
    unigrams = durable(_counted(docs, lambda tokens, lengths: tokens))
    whole = unigrams.agg(
        F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("once")
    ).first()
    n, v, once = whole["n"] or 0, whole["v"], whole["once"] or 0
    keys, counts = _top(unigrams, FREQUENT)
    bigrams = durable(_counted(docs, _bigram_keys))
    _drop_shuffles(docs.sparkSession)
    bits, low = _filter(unigrams, bigrams)
    unseen = min(0.5, max(1, once) / max(n, 2))
    return Model(n, v, keys, counts, bits, low, unseen, 1 - once / max(n, 1) or 0.5), unigrams, bigrams


def _left_out(scored: DataFrame, model: Model, unigrams: DataFrame, bigrams: DataFrame) -> DataFrame:
    """(row, more_score): the log10 probabilities of the positions that a row lacks."""
    rows = scored.select("row", F.inline("asked"))
    for name, counts, low in (
        ("both", bigrams, model.low[1]), ("before", unigrams, model.low[0]), ("own", unigrams, model.low[0])
    ):
        if low[0] > 1:
            side = counts.withColumn("q", level(F.col("c"))).where(F.col("q") < _least(low))
            side = side.select(F.col("key").alias(f"{name}_key"), "q")
            # what is known needs no partner: its rows are spread, however frequent the n-gram is
            key = F.when(F.col(name) < 0, F.col(f"{name}_key")).otherwise(F.xxhash64("row", "own", "t"))
            rows = rows.withColumn(f"{name}_key", key).join(side, f"{name}_key", "left")
            known = F.when(F.col(name) < 0, F.coalesce("q", F.lit(0))).otherwise(F.col(name))
            rows = rows.withColumn(name, known).drop("q", f"{name}_key")
    both, before, own = (_value(F.col(c)) for c in ("both", "before", "own"))
    single = F.when(own > 0, F.least(F.lit(float(model.seen)) * own / F.lit(float(max(model.n, 1))), F.lit(1.0)))
    p = (F.least(both, before) + PRIOR * F.coalesce(single, F.lit(float(model.unseen)))) / (before + PRIOR)
    return rows.groupBy("row").agg(F.sum(F.col("t") * F.log10(p)).alias("more_score"))


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per input row."""
    model, unigrams, bigrams = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "held_out", "n_tokens", "known", "base", "score", "rare", "asked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in chunks(batches):
            ids = batch.column(0).to_pylist()
            tokens, lengths = token_hashes(batch.column(1))
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
            some, back = np.unique(tokens, return_inverse=True)
            at = np.searchsorted(m.keys, some)
            at[at == len(m.keys)] = 0
            found = m.keys[at] == some if len(m.keys) else np.zeros(len(some), bool)
            c = np.where(found, m.counts[at], 0) if len(m.keys) else np.zeros(len(some), np.int64)
            known = found[back]
            base = np.where(known, m.base(c)[back], 0.0)
            score, asked = m.scores(tokens, lengths)
            rare = tokens[~known]
            ends = np.concatenate([[0], np.cumsum(np.add.reduceat((~known).astype(np.int64), starts))])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([in_fold(i) for i in ids], pa.bool_()),
                    pa.array(lengths),
                    pa.array(np.add.reduceat(known.astype(np.int64), starts)),
                    pa.array(np.add.reduceat(base, starts)),
                    pa.array(score),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rare, pa.int64())),
                    asked,
                ],
                names=names,
            )

    scored = durable(
        need(docs, doc_id="long", text="string").mapInArrow(
            run,
            "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>, "
            f"asked array<struct<{','.join(f'{x}:long' for x in ASKED)}>>",
        )
    ).withColumn("row", F.monotonically_increasing_id())
    rare = scored.select("row", F.explode("rare").alias("key")).groupBy("key", "row").agg(F.count("*").alias("t"))
    total = F.lit(float(model.n + model.v + 1))
    rest = (
        rare.join(unigrams, "key", "left")
        .withColumn("c", F.coalesce("c", F.lit(0)))
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("c") > 0, F.col("t")).otherwise(0)).alias("more_known"),
            F.sum(F.col("t") * F.log10((F.col("c") + 1) / total)).alias("more_base"),
        )
    )
    if max(model.low)[0] > 1:
        rest = rest.join(_left_out(scored, model, unigrams, bigrams), "row", "full")
    else:
        rest = rest.withColumn("more_score", F.lit(0.0))
    return scored.drop("rare", "asked").join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of all documents."""
    return score_documents(table(spark, sf_dir, "documents"))
