"""Best-fit packing of tokenised documents by bin completion.

Packing depends on piece lengths only, and there are at most ``capacity``
different lengths. So the corpus is reduced to a histogram of lengths (one
pre-aggregated shuffle, at most ``capacity`` rows), bin completion with branch
and bound runs on that histogram, and the resulting filling patterns are dealt
back to the pieces by their rank within their length. The driver therefore
works on bounded data at any corpus size, and the packing is global: there are
no per-partition remainders.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docflow.llm.common import durable, need, table
from docflow.llm.words import bytes_of, chunks, hasher, held, spans

CAPACITY = 2048
SEPARATOR_ID = 0
#: Searches: fillings tried for one bin, and bins that may be reopened in all.
FILL_NODES = 600
BACKTRACKS = 60
#: Branches kept for one bin, and pieces from which on all branches are kept.
MOST_FILLINGS = 3
FEW_PIECES = 40
#: Distinct words that a worker keeps with their ids, some 50 bytes each: 25 MB.
WORD_CACHE = 500_000
#: Words that are looked up at once.
WORD_BLOCK = 1 << 19
#: Rows of one (length, bucket) group that is sorted together, about.
RANK_GROUP = 1000
RANK_BUCKETS = 4096

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---------------------------------------------------------------- tokenising


#: Byte-level tokenizers write printable Latin-1 bytes as themselves, the others as 256, 257, ... in order.
_ODD = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF)]
BYTE_SIGNS = {b: 256 + i for i, b in enumerate(_ODD)}


class WordEncoder:
    """Token ids of texts, word by word, with a cache of bounded size.

    The tokenizer splits at white space before it does anything that looks
    across characters, so a text's ids are those of its words in turn. Words
    are cut at ASCII blanks only; any other space stays inside a word and is
    left to the tokenizer. Words are found and told apart by two 64-bit hashes;
    only distinct words that the cache lacks become Python strings.

    Words of ASCII or Latin-1 letters with plain punctuation behind are split:
    their letters have no other form under NFC and one lower case, so the ids
    are those of the letters and of the punctuation, and the letters' bytes go
    to the BPE model directly, in the signs that byte-level tokenizers have for
    them. All others go to the tokenizer whole.
    """

    SPLIT = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!#*%&$;:?)]*)")

    def __init__(self, path: str, limit: int = WORD_CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.tails: dict[str, list[int]] = {"": []}
        self.first = np.zeros(0, np.uint64)  # sorted hashes of the cached words
        self.second = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)  # where a word's ids begin
        self.size = np.zeros(0, np.int64)
        self.used = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def plain(self, text: str) -> list[int]:
        """Ids of any text by the tokenizer itself."""
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct words."""
        split = [self.SPLIT.fullmatch(w) for w in words]
        cores = {m[1].lower() for m in split if m}
        model = self.tokenizer.model
        known = {c: [t.id for t in model.tokenize(c if c.isascii() else c.encode().decode("latin-1").translate(BYTE_SIGNS))] for c in cores}
        rest = [w for w, m in zip(words, split) if not m]
        for i in range(0, len(rest), 2000):
            part = rest[i : i + 2000]
            # pretokenized: each word goes through normal form and splitting by itself
            got = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids, of = got.ids, np.array(got.word_ids, dtype=np.int64)
            cuts = np.searchsorted(of, np.arange(len(part) + 1)).tolist()
            known.update((w, ids[a:b]) for w, a, b in zip(part, cuts, cuts[1:]))
        out = []
        for word, m in zip(words, split):
            if m is None:
                out.append(known[word])
                continue
            tail = m[2]
            if tail not in self.tails:
                if len(self.tails) > 10_000:
                    self.tails = {"": []}
                self.tails[tail] = self.plain(tail)
            out.append(known[m[1].lower()] + self.tails[tail])
        return out

    def _forget(self) -> None:
        """Keep the more frequently used half of the words."""
        keep = np.sort(np.argsort(self.used, kind="stable")[len(self.used) - self.limit // 2 :])
        ids = _ragged(self.ids, self.at[keep], self.size[keep])
        self.first, self.second, self.size = self.first[keep], self.second[keep], self.size[keep]
        self.used = self.used[keep] >> 1
        self.at, self.ids = np.cumsum(self.size) - self.size, ids

    def _put(self, first: np.ndarray, second: np.ndarray, found: list[list[int]]) -> None:
        clash = np.isin(self.first, first)
        if clash.any():  # the same first hash, another word: the new one takes the place
            self.first, self.second, self.at, self.size, self.used = (
                x[~clash] for x in (self.first, self.second, self.at, self.size, self.used)
            )
        size = np.array([len(x) for x in found], dtype=np.int64)
        at = len(self.ids) + np.cumsum(size) - size
        where = np.searchsorted(self.first, first)
        self.first, self.second = np.insert(self.first, where, first), np.insert(self.second, where, second)
        self.at, self.size = np.insert(self.at, where, at), np.insert(self.size, where, size)
        self.used = np.insert(self.used, where, 0)
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))])

    def _block(self, raw: bytes, starts: np.ndarray, stops: np.ndarray, first: np.ndarray, second: np.ndarray):
        """Ids of a row of words, and each word's number of ids."""
        some, at, back, times = np.unique(first, return_index=True, return_inverse=True, return_counts=True)
        if (second[at][back] != second).any():  # two words of one hash among these
            found = self.learn([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), stops.tolist())])
            return np.fromiter(chain.from_iterable(found), np.uint32), np.array([len(x) for x in found], dtype=np.int64)
        if len(self.first) > self.limit:
            self._forget()
        place = np.searchsorted(self.first, some)
        held = np.zeros(len(some), dtype=bool)
        inside = np.flatnonzero(place < len(self.first))
        own = place[inside]
        held[inside] = (self.first[own] == some[inside]) & (self.second[own] == second[at[inside]])
        fresh = np.flatnonzero(~held)
        if len(fresh):
            spots = at[fresh]
            words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[spots].tolist(), stops[spots].tolist())]
            self._put(some[fresh], second[spots], self.learn(words))
            place = np.searchsorted(self.first, some)
        self.used[place] += times
        size = self.size[place][back]
        return _ragged(self.ids, self.at[place][back], size), size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids end; null is empty."""
        data, offsets = bytes_of(texts)
        starts, stops = spans(data, offsets)
        ends = np.searchsorted(starts, offsets)
        raw = data.tobytes()
        ids, sizes = [], []
        for i in range(0, len(starts), WORD_BLOCK):
            a, b = starts[i : i + WORD_BLOCK], stops[i : i + WORD_BLOCK]
            hashes = [hasher(seed, False).hashes(data, a, b) for seed in (2, 3)]
            own, size = self._block(raw, a, b, *hashes)
            ids.append(own)
            sizes.append(size)
        total = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
        return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), total[ends[1:]]


def _ragged(values: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[a : a + n] for each a and n, in a row."""
    begin = np.cumsum(size) - size
    return values[np.repeat(at - begin, size) + np.arange(int(size.sum()))]


def encoder_of(path: str) -> WordEncoder:
    """The worker process's encoder, kept from task to task."""
    return held(f"encoder {path}", lambda: WordEncoder(path))


def tokenize_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False
) -> DataFrame:
    """Documents as pieces of at most ``capacity`` token ids.

    Each document's ids are the tokenizer's ids of its whole text followed by
    ``SEPARATOR_ID``. A null or empty text gives one piece of one id. Only
    longer documents are cut. A null doc_id stays null. With ``keep_ids`` the
    ids themselves follow as ``token_ids``.
    """
    schema = PIECE_SCHEMA + (", token_ids array<long>" if keep_ids else "")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if keep_ids:
        names.append("token_ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        for batch in chunks(batches):
            ids, stops = encoder.encode(batch.column(1))
            ids = np.insert(ids, stops, SEPARATOR_ID).astype("<u4")
            stops = stops + np.arange(1, len(stops) + 1)
            sizes = np.diff(stops, prepend=0)
            pieces = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(sizes[row] - start, capacity)
            begin = (stops - sizes)[row] + start
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
            columns = [
                batch.column(0).take(pa.array(row)),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array([0, *(begin + length).tolist()], pa.int32()), pa.array(ids.astype(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return need(docs, doc_id="long", text="string").mapInArrow(cut, schema)


# ------------------------------------------------------------ bin completion


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2 bound on the number of bins."""
    lengths = sorted(counts)
    total = sum(n * c for n, c in counts.items())
    best = -(-total // capacity)
    for k in [0, *[n for n in lengths if 2 * n <= capacity]]:
        big = sum(c for n, c in counts.items() if n > capacity - k)
        middle = {n: c for n, c in counts.items() if capacity - k >= n and 2 * n > capacity}
        small = sum(n * c for n, c in counts.items() if k <= n and 2 * n <= capacity)
        room = sum((capacity - n) * c for n, c in middle.items())
        extra = -(-(small - room) // capacity) if small > room else 0
        best = max(best, big + sum(middle.values()) + extra)
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing on a histogram: patterns with their multiplicities.

    Bins of equal content are one entry, so the work depends on the number of
    different lengths and contents, not on the number of pieces.
    """
    open_bins: dict[int, dict[tuple, int]] = {}  # room -> content -> bins
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in open_bins if r >= length), default=None)
            if room is None:
                per = capacity // length
                bins, rest = divmod(left, per)
                if bins:
                    open_bins.setdefault(capacity - per * length, {})[((length, per),)] = bins
                if rest:
                    open_bins.setdefault(capacity - rest * length, {})[((length, rest),)] = 1
                break
            content, bins = next(iter(open_bins[room].items()))
            per = min(room // length, left)
            used = min(bins, left // per)
            if used == bins:
                del open_bins[room][content]
                if not open_bins[room]:
                    del open_bins[room]
            else:
                open_bins[room][content] = bins - used
            put = (*content, (length, per))
            kept = open_bins.setdefault(room - per * length, {})
            kept[put] = kept.get(put, 0) + used
            left -= used * per
    return [(content, bins) for kept in open_bins.values() for content, bins in kept.items()]


def fillings(counts: dict[int, int], room: int, nodes: int, most: int = MOST_FILLINGS) -> list[tuple[tuple[int, int], ...]]:
    """Undominated fillings of ``room``, least waste first, at most ``most``.

    Depth first over falling lengths. A branch is left when even filling it
    whole can't beat the waste of the fillings kept. A filling is dominated if
    some piece that is left would still fit into its waste, or could replace a
    smaller one inside it; neither can give fewer bins.
    """
    lengths = [n for n in sorted(counts, reverse=True) if n <= room and counts[n]]
    found: list[tuple[int, tuple]] = []
    # what the lengths from here on can fill at most
    rest = [0] * (len(lengths) + 1)
    for i in range(len(lengths) - 1, -1, -1):
        rest[i] = rest[i + 1] + lengths[i] * counts[lengths[i]]
    stack: list[tuple[int, int, tuple]] = [(0, room, ())]
    while stack and nodes:
        nodes -= 1
        i, left, chosen = stack.pop()
        while i < len(lengths) and lengths[i] > left:
            i += 1
        worst = found[-1][0] if len(found) >= most else room + 1
        if left - rest[i] >= worst:
            continue
        if i == len(lengths) or left == 0:
            if not _dominated(counts, lengths, left, chosen):
                found.append((left, chosen))
                found.sort(key=lambda x: x[0])
                del found[most:]
                if left == 0 and most <= MOST_FILLINGS:
                    if len(found) >= most:
                        break
                    nodes = min(nodes, 64)  # a filling without waste: look a little for others
            continue
        n = lengths[i]
        for k in range(0, min(counts[n], left // n) + 1):  # pushed last, tried first: as many as fit
            stack.append((i + 1, left - k * n, (*chosen, (n, k)) if k else chosen))
    return [chosen for _, chosen in found] or [()]


def _dominated(counts: dict[int, int], lengths: list[int], waste: int, chosen: tuple) -> bool:
    if not waste:
        return False
    used = dict(chosen)
    for n in lengths:
        if counts[n] > used.get(n, 0) and (n <= waste or any(m < n <= m + waste for m, _ in chosen)):
            return True
    return False


def bin_completion(
    counts: dict[int, int], capacity: int = CAPACITY, fill_nodes: int = FILL_NODES, backtracks: int = BACKTRACKS
) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ``((length, times), ...)`` with multiplicities, as few bins as found.

    Branch and bound over bins: the largest length left opens the next bin, its
    undominated fillings are the branches, and a branch is cut when the bins
    used plus the space bound of what remains reach the incumbent. Best-fit
    decreasing gives the first incumbent. A filling is applied as often as the
    counts allow at once, so depth doesn't grow with the number of pieces; once
    ``FEW_PIECES`` are left, bins are filled one by one and no branch is dropped. The
    search ends at the lower bound or after ``backtracks`` reopened bins.
    """
    counts = {int(n): int(c) for n, c in counts.items() if c}
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError("lengths must be 1..capacity")
    best = best_fit(counts, capacity)
    incumbent, bound = sum(m for _, m in best), lower_bound(counts, capacity)

    def branches(left: dict[int, int]) -> list[tuple[tuple, int]]:
        top = max(left)
        own = dict(left)
        own[top] -= 1
        out = []
        few = sum(left.values()) <= FEW_PIECES
        for fill in fillings(own, capacity - top, fill_nodes, 1000 if few else MOST_FILLINGS):
            pattern = {n: k for n, k in fill}
            pattern[top] = pattern.get(top, 0) + 1
            times = 1 if few else min(left[n] // k for n, k in pattern.items())
            out.append((tuple(sorted(pattern.items(), reverse=True)), times))
        return out

    if sum(counts.values()) <= FEW_PIECES:
        backtracks *= 100
    path: list[tuple[tuple, int]] = []
    stack = [(counts, 0, 0, iter(branches(counts)))] if incumbent > bound else []
    while stack:
        left, bins, depth, tries = stack[-1]
        step = next(tries, None)
        if step is None:
            stack.pop()
            backtracks -= 1
            if backtracks < 0:
                break
            continue
        del path[depth:]
        path.append(step)
        pattern, times = step
        after = dict(left)
        for n, k in pattern:
            after[n] -= k * times
            if not after[n]:
                del after[n]
        bins += times
        if bins + -(-sum(n * c for n, c in after.items()) // capacity) >= incumbent:
            backtracks -= 1
            if backtracks < 0:
                break
            continue
        if not after:
            best, incumbent = list(path), bins
            if incumbent <= bound:
                break
            continue
        stack.append((after, bins, len(path), iter(branches(after))))
    return best


# ------------------------------------------------------------------- dealing


def _ranked(pieces: DataFrame, total: int) -> DataFrame:
    """Adds ``rank``: 0, 1, ... within each length over all pieces.

    A length may hold a third of all rows, so the rows of a length are ranked in
    hash buckets and the buckets' counts give each bucket its first rank.
    """
    buckets = max(1, min(RANK_BUCKETS, total // RANK_GROUP))
    salted = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = salted.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    firsts = sizes.select(
        "length",
        "bucket",
        (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("first"),
    )
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return (
        salted.withColumn("within", F.row_number().over(within) - 1)
        .join(firsts, ["length", "bucket"])
        .withColumn("rank", F.col("first") + F.col("within"))
        .drop("bucket", "first", "within")
    )


def _intervals(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[str, np.ndarray]:
    """Rank ranges of each length: which bins and offsets they get."""
    taken: dict[int, int] = {}
    rows, bin_id = [], 0
    for pattern, times in patterns:
        offset = 0
        for length, k in pattern:
            first = taken.get(length, 0)
            rows.append((length, first, k, bin_id, offset))
            taken[length] = first + k * times
            offset += length * k
        bin_id += times
    rows.sort()
    return dict(zip(("length", "first", "k", "bin", "offset"), np.array(rows, dtype=np.int64).reshape(-1, 5).T))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1..capacity.

    Every piece gets one place; places in a sequence are gapless from 0. Rows
    that are equal in every column are interchangeable. Empty in, empty out.
    """
    pieces = durable(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    at = _intervals(bin_completion(counts, capacity))
    ranked = _ranked(pieces, sum(counts.values()))
    columns = pieces.columns
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # lexicographic search by (length, first) in one sorted key
        span = np.int64(1) << 50
        keys = at["length"] * span + at["first"]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)
            i = np.searchsorted(keys, length * span + rank, side="right") - 1
            turn, slot = np.divmod(rank - at["first"][i], at["k"][i])
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in columns],
                    pa.array(at["bin"][i] + turn),
                    pa.array(at["offset"][i] + slot * length),
                ],
                names=[*columns, "sequence_id", "offset"],
            )

    return ranked.select(*columns, "rank").mapInArrow(place, schema)


def tokenizer_path() -> str:
    """The default vocabulary file of the box's public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack whole documents."""
    return pack(tokenize_pieces(docs, path or tokenizer_path(), capacity), capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
