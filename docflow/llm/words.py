"""Words of whole texts as 64-bit hashes, by array operations on UTF-8 bytes.

No Python object is made per word. Words are cut at ASCII white space and never
span texts. A word's hash is a polynomial over random values of its bytes, read
off running sums, and then mixed; words longer than ``LONG`` bytes are hashed
one by one instead, so that structured long words can't collide.

Memory is bounded by the size of a chunk: some 24 bytes per word and, for one
block of ``BLOCK`` bytes at a time, some 40 per byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
LONG = 512
CHUNK_BYTES = 3_000_000

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_M1, _M2, _M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiplications with shifts)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class Hasher:
    """One family of word hashes; ``fold`` reads A-Z as a-z."""

    def __init__(self, seed: int, fold: bool = True):
        rng = np.random.default_rng(seed)
        self.seed, self.fold = seed, fold
        self.values = rng.integers(1, 2**64, 256, dtype=np.uint64)
        if fold:
            self.values[0x41:0x5B] = self.values[0x61:0x7B]
        base = int(rng.integers(2**40, 2**63, dtype=np.uint64)) | 1
        self.powers, self.inverse = (self._powers(x) for x in (base, pow(base, -1, 2**64)))

    @staticmethod
    def _powers(x: int) -> np.ndarray:
        out = np.full(BLOCK + 1, x, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def hashes(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The hash of each word data[start:stop]; words in order, not overlapping."""
        out = np.empty(len(starts), dtype=np.uint64)
        sums = np.zeros(BLOCK + 1, dtype=np.uint64)
        i, n = 0, len(starts)
        with np.errstate(over="ignore"):
            while i < n:
                at = int(starts[i])
                j = int(np.searchsorted(stops, at + BLOCK, side="right"))
                if j <= i:  # a word longer than a block
                    i += 1
                    continue
                size = int(stops[j - 1]) - at
                term = np.take(self.values, data[at : at + size])
                term *= self.powers[:size]
                np.cumsum(term, out=sums[1 : size + 1])
                a, b = starts[i:j] - at, stops[i:j] - at
                own = (sums[b] - sums[a]) * self.inverse[a]
                own += (b - a).view(np.uint64) * _M3
                out[i:j] = mix(own)
                i = j
        for i in np.flatnonzero(stops - starts > LONG).tolist():
            out[i] = self._long(data[starts[i] : stops[i]].tobytes())
        return out

    def _long(self, word: bytes) -> int:
        import xxhash

        return xxhash.xxh3_64_intdigest(word.lower() if self.fold else word, seed=self.seed)


_HASHERS: dict[tuple[int, bool], Hasher] = {}


def hasher(seed: int = 1, fold: bool = True) -> Hasher:
    """The process's hasher of that seed: tables of constants, some 4 MB."""
    if (seed, fold) not in _HASHERS:
        _HASHERS[seed, fold] = Hasher(seed, fold)
    return _HASHERS[seed, fold]


_HELD: dict[str, object] = {}


def held(name: str, make=lambda: None):
    """A worker process's one large object: kept from task to task, dropped when another operator's code runs there."""
    if name not in _HELD:
        _HELD.clear()
        pa.default_memory_pool().release_unused()
        _HELD[name] = make()
    return _HELD[name]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and each text's first byte, the last text's end added; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, kind)
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word."""
    word = ~SPACE[data]
    begin, last = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begin[cut] = word[cut]
    last[cut - 1] = word[cut - 1]
    return np.flatnonzero(begin), np.flatnonzero(last) + 1


def bare(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words without the ``edge`` bytes at their ends; words of edge bytes only stay whole."""
    inner = np.flatnonzero(~edge[data] & ~SPACE[data])
    if not len(inner):
        return starts, stops
    lo = np.searchsorted(inner, starts)
    hi = np.searchsorted(inner, stops)
    some = lo < hi
    return (
        np.where(some, inner[np.minimum(lo, len(inner) - 1)], starts),
        np.where(some, inner[np.maximum(hi, 1) - 1] + 1, stops),
    )


@dataclass
class Words:
    """The words of some texts in a row."""

    hashes: np.ndarray
    ends: np.ndarray  # words before each text, and of all


def words_of(texts: pa.Array, edge: np.ndarray | None = None, seed: int = 1) -> Words:
    """Word hashes of every text of a string array, A-Z folded; ``edge``: bytes left out at a word's ends."""
    data, offsets = bytes_of(texts)
    starts, stops = spans(data, offsets)
    ends = np.searchsorted(starts, offsets)
    if edge is not None:
        starts, stops = bare(data, starts, stops, edge)
    return Words(hasher(seed).hashes(data, starts, stops), ends)


def chunks(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about CHUNK_BYTES of text, or of one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = bytes_of(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + CHUNK_BYTES, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def as_binary(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A row of 64-bit numbers as one binary value per count."""
    offsets = np.concatenate([[0], np.cumsum(counts * data.itemsize)])
    kind = pa.binary() if offsets[-1] < 2**31 else pa.large_binary()
    offsets = offsets.astype(np.int32 if kind == pa.binary() else np.int64)
    return pa.Array.from_buffers(kind, len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
