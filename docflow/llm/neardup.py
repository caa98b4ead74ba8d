"""Near-duplicate documents by HyperMinHash sketches, banding and exact checks.

One pass over the texts gives each document a sketch of ``REGISTERS`` 16-bit
registers (leading-zero count and mantissa of the smallest shingle hash of a
bucket). Documents with equal sets collapse into classes before anything is
compared. A second pass stores the sorted shingle hashes of the classes that
share a band bucket with another; no text is read again. Banded registers propose pairs: first a star from each band bucket's
hub, and then, only where a bucket still spans several components, the pairs
across components. A collision-corrected estimate drops pairs that are far from
the threshold; every other pair is checked on the full shingle sets. Families of
large buckets are compared in bounded blocks that emit spanning links only.

Shingles and classes are told apart by 64-bit hashes. A link at the threshold
shares none of the 32 bands with a probability of (1 - 0.85 ** 4) ** 32, about
5e-11, and links above it are missed less often.

Defined results: a document with fewer words than a shingle has the whole
sequence as its one shingle; without words its set is empty and it is linked
with nothing (its component is its own doc_id). Equal rows get equal results.
Rows with a null doc_id count as members of their component but never name it;
a component of null ids only has a null component_id and is kept. Two rows with
one doc_id but different texts are judged by their texts; ``keep_one`` keeps the
one of the smaller (doc_id, hash of the text), ids before null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm.common import durable, need, table
from docflow.llm.components import components
from docflow.llm.words import as_binary, chunks, held, mix, words_of

#: Registers, their mantissa bits, and registers in a band.
BUCKET_BITS = 7
REGISTERS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
BAND = 4
BANDS = REGISTERS // BAND
#: Pairs estimated below threshold - MARGIN are dropped: over six standard deviations.
MARGIN = 0.2
#: 64-bit words of the filter that says which documents' sets are wanted; fixed, so 8 MB at any size.
FILTER_WORDS = 1 << 20
#: Buckets of up to SMALL classes are compared pair by pair, larger ones in blocks.
SMALL = 32
#: Members of a family's main component that all outside it are compared with first.
CORE_HUBS = 4
#: Hashes of a block's outside classes, and of the part of the family it is compared with.
OUTSIDE_HASHES = 100_000
FAMILY_HASHES = 400_000
#: And their classes, which bound a block's table of intersections to some 8 MB.
OUTSIDE_CLASSES = 500
FAMILY_CLASSES = 2000
#: Documents that are sketched at once.
SKETCHED = 2000

_ODD = np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _weight(i: int) -> np.uint64:
    return _ODD[i % 64] * np.uint64(2 * (i // 64) + 1)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and each text's number of them."""
    words = words_of(texts)
    flat, ends = words.hashes, words.ends
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(flat) - size + 1), dtype=np.uint64)
        for i in range(size if len(rolled) else 0):
            rolled += flat[i : len(flat) - size + 1 + i] * _weight(i)
        rolled = mix(rolled)
        sets, counts = [], np.zeros(len(texts), dtype=np.int64)
        for i, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
            if b - a >= size:
                own = np.sort(rolled[a : b - size + 1])
                new = np.ones(len(own), dtype=bool)
                np.not_equal(own[1:], own[:-1], out=new[1:])
                own = own[new]
            elif b > a:  # the whole sequence, told from longer ones by its length
                own = np.array([(b - a) * 0x9E3779B97F4A7C15 % 2**64], dtype=np.uint64)
                for i_word in range(b - a):
                    own += flat[a + i_word : a + i_word + 1] * _weight(i_word)
                own = mix(own)
            else:
                continue
            sets.append(own)
            counts[i] = len(own)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), counts


def _probes() -> np.ndarray:
    """For each bucket the order in which an empty one borrows from the others."""
    rng = np.random.default_rng(20240601)
    return np.argsort(rng.random((REGISTERS, REGISTERS)), axis=1)


PROBES = _probes()


def sketches_of(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Registers of sets of sorted distinct hashes, a row per set; all zero for an empty set.

    The leading bits choose the bucket, so the first hash of a bucket is its
    smallest. A register holds the leading zeros of the other bits plus one, and
    the bits that follow the leading one. Empty buckets borrow from others.
    """
    out = np.zeros((len(counts), REGISTERS), dtype="<u2")
    cuts = np.concatenate([[0], np.cumsum(counts)])
    for i in range(0, len(counts), SKETCHED):
        part = counts[i : i + SKETCHED]
        _fill(out[i : i + SKETCHED], flat[cuts[i] : cuts[i + len(part)]], part)
    return out


def _fill(out: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> None:
    have = np.zeros((len(counts), REGISTERS), dtype=bool)
    row = np.repeat(np.arange(len(counts)), counts)
    place = row * REGISTERS + (flat >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    rest = (flat[first] << np.uint64(BUCKET_BITS)) >> np.uint64(11)  # 53 bits, exact as doubles
    mantissa, exponent = np.frexp(rest.astype(np.float64))
    zeros = np.minimum(53 - exponent, 62)
    register = ((zeros + 1) << MANTISSA_BITS) | np.floor(
        np.maximum(2 * mantissa - 1, 0) * (1 << MANTISSA_BITS)
    ).astype(np.int64)
    out.reshape(-1)[place[first]], have.reshape(-1)[place[first]] = register, True
    rows, empty = np.nonzero(~have & (counts > 0)[:, None])
    for i in range(0, len(rows), 20_000):
        r, e = rows[i : i + 20_000], empty[i : i + 20_000]
        order = PROBES[e]
        source = order[np.arange(len(e)), have[r[:, None], order].argmax(axis=1)]
        out[r, e] = out[r, source]


def sketch(hashes: np.ndarray) -> bytes:
    """Registers of one set of sorted distinct hashes."""
    return sketches_of(hashes, np.array([len(hashes)])).tobytes()


def fingerprint(hashes: np.ndarray) -> int:
    """A signed 64-bit hash of a whole set."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def fingerprints(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    cuts = np.concatenate([[0], np.cumsum(counts)]).tolist()
    return np.array([fingerprint(flat[a:b]) for a, b in zip(cuts, cuts[1:])], dtype=np.int64)


def sketches(docs: DataFrame, size: int, keys: bool = False) -> DataFrame:
    """doc_id, n_shingles, fp, sketch of each document; the last two null for empty sets.

    With ``keys`` two 64-bit hashes of the text, k1 and k2, follow.
    """
    rows = need(docs, doc_id="long", text="string")
    names = ["doc_id", "n_shingles", "fp", "sketch"]
    schema = "doc_id long, n_shingles long, fp long, sketch binary"
    if keys:
        rows = rows.select("doc_id", "text", *text_keys(F.col("text")))
        names, schema = [*names, "k1", "k2"], f"{schema}, k1 long, k2 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("near duplicates")
        for batch in chunks(batches):
            flat, counts = shingle_sets(batch.column(1), size)
            none = pa.array(counts == 0)
            columns = [
                batch.column(0),
                pa.array(counts),
                pc.if_else(none, None, pa.array(fingerprints(flat, counts), pa.int64())),
                pc.if_else(none, None, as_binary(sketches_of(flat, counts).reshape(-1), np.full(len(counts), REGISTERS))),
            ]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[2:]], names=names)

    return rows.mapInArrow(run, schema)


def text_keys(text):
    """Two independent 64-bit hashes of a text as columns k1 and k2."""
    return [F.xxhash64(F.lit(i), text).alias(f"k{i}") for i in (1, 2)]


def _slot(fp: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(fp.astype(np.uint64) ^ (doc_id.astype(np.uint64) * _ODD[0])) % np.uint64(64 * FILTER_WORDS)


def _filter_of(wanted: DataFrame, lo=None) -> np.ndarray:
    """A one-hash Bloom filter over (fp, lo) as FILTER_WORDS 64-bit words; without ``lo`` over fp.

    Its size doesn't depend on the data. A fuller filter lets more sets through,
    which the joins then drop; it never loses one.
    """

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            lo = batch.column(1).to_numpy(zero_copy_only=False)
            at = _slot(fp.view(np.uint64), lo.view(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(at & 63)], names=["word", "bit"])

    rows = (
        wanted.select("fp", F.coalesce(F.lit(None).cast("long") if lo is None else F.col(lo), F.lit(0)).alias("lo"))
        .mapInArrow(slots, "word long, bit long")
        .groupBy("word")
        .agg(F.expr("bit_or(shiftleft(1L, CAST(bit AS INT)))").alias("bits"))
        .toArrow()
    )
    bits = np.zeros(FILTER_WORDS, dtype=np.uint64)
    if rows.num_rows:
        bits[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return bits


def _passed(bits: np.ndarray, fp: np.ndarray, own: np.ndarray) -> np.ndarray:
    at = _slot(fp.view(np.uint64), own.view(np.uint64))
    return ((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def _stored_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """fp and full set (sorted 64-bit hashes) of the classes in ``wanted`` (fp, lo), perhaps more; durable.

    A class's set comes from its document ``lo``: copies are left out by the
    filter, and only repeated rows are left for the last step to combine.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(wanted, "lo"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in chunks(batches):
            flat, counts = shingle_sets(batch.column(1), size)
            fp, own = fingerprints(flat, counts), batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            keep = _passed(bits, fp, own) & (counts > 0)
            sets = pa.RecordBatch.from_arrays([pa.array(fp), as_binary(flat, counts)], names=["fp", "hashes"])
            yield sets.filter(pa.array(keep))

    rows = need(docs, doc_id="long", text="string").mapInArrow(run, "fp long, hashes binary")
    return durable(rows.dropDuplicates(["fp"]))


def _wanted_sets(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of the stored sets that are in ``wanted`` (fp), perhaps more: what the joins would drop isn't shuffled."""
    shared = sets.sparkSession.sparkContext.broadcast(_filter_of(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(_passed(shared.value, fp, np.zeros(len(fp), np.int64))))

    return sets.mapInArrow(run, "fp long, hashes binary")


def _banded(classes: DataFrame) -> DataFrame:
    """key, fp: one row for each class and band."""
    width = 2 * BAND
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    return classes.select("fp", "sketch", band.alias("band")).select(
        F.xxhash64("band", F.substring("sketch", F.col("band") * width + 1, F.lit(width))).alias("key"), "fp"
    )


def expected_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Registers of two disjoint sets that agree by chance (HyperMinHash, Yu and Weber)."""
    big, small = np.maximum(n, m), np.maximum(np.minimum(n, m), 1)
    phi = 4 * (big / small) / (1 + big / small) ** 2
    return 0.169919487159739093975315012348 * 2.0 ** (BUCKET_BITS - MANTISSA_BITS) * phi


def _likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose estimate is not far below the threshold."""
    left = classes.select(F.col("fp").alias("a"), F.col("sketch").alias("sa"), F.col("n_shingles").alias("na"))
    right = classes.select(F.col("fp").alias("b"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("nb"))
    sized = (F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold - 1e-9))

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sa, sb = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(n, REGISTERS)
                for c in ("sa", "sb")
            )
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb"))
            chance = expected_collisions(na, nb)
            j = ((sa == sb).sum(axis=1) - chance) / (REGISTERS - chance)
            good = pa.array(j >= threshold - MARGIN)
            yield batch.select(["a", "b"]).filter(good)

    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where(sized)
        .select("a", "b", "sa", "sb", "na", "nb")
        .mapInArrow(estimate, "a long, b long")
    )


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold on their full sets; durable."""
    own = _wanted_sets(sets, pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("ha"), batch.column("hb"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    full = (
        pairs.join(own.select(F.col("fp").alias("a"), F.col("hashes").alias("ha")), "a")
        .join(own.select(F.col("fp").alias("b"), F.col("hashes").alias("hb")), "b")
        .select("a", "b", "ha", "hb")
        .mapInArrow(compare, "a long, b long")
    )
    return durable(full)


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members (key, fp, hub, g) with the components of fp (label) and hub (main)."""
    node = labels.select(F.col("node").alias("fp"), "label")
    hub = labels.select(F.col("node").alias("hub"), F.col("label").alias("main"))
    return (
        members.join(node, "fp", "left")
        .join(hub, "hub", "left")
        .withColumns({"label": F.coalesce("label", "fp"), "main": F.coalesce("main", "hub")})
    )


def _across_small(members: DataFrame, labels: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Likely pairs across components inside buckets of at most SMALL classes; their hubs are done."""
    rows = durable(_labelled(members.where(F.col("g").between(3, SMALL) & (F.col("fp") != F.col("hub"))), labels))
    outside = rows.where("label <> main").select("key", F.col("fp").alias("a"), F.col("label").alias("la"))
    other = rows.select("key", F.col("fp").alias("b"), F.col("label").alias("lb"), (F.col("label") == F.col("main")).alias("inside"))
    across = (
        outside.join(other, "key")
        .where((F.col("la") != F.col("lb")) & (F.col("inside") | (F.col("a") < F.col("b"))))
        .select("a", "b")
        .distinct()
    )
    return durable(_likely(across, classes, threshold))


def _across_large(
    stored: DataFrame, members: DataFrame, classes: DataFrame, links: DataFrame, labels: DataFrame, percent: int
) -> DataFrame | None:
    """links with those across components inside larger buckets, or None where there is nothing to add.

    Buckets that overlap make a family. Its largest component is the main one;
    the classes outside it are first checked against a few of the main
    component's best linked members, and those that stay outside then against
    the whole family, block by block, on full sets. A block emits one link for
    each class and component at most, so no pair list is ever made.
    """
    rows = durable(_labelled(members.where(F.col("g") > SMALL), labels))
    open_keys = rows.where("label <> main").select("key").distinct()
    rows = durable(rows.join(open_keys, "key", "left_semi").select("fp", "hub"))
    if not rows.take(1):
        return None
    family = components(rows.select(F.col("fp").alias("a"), F.col("hub").alias("b")))

    def placed(labels: DataFrame) -> DataFrame:
        """fp, family, label, outside."""
        own = (
            family.select(F.col("node").alias("fp"), F.col("label").alias("family"))
            .join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left")
            .withColumn("label", F.coalesce("label", "fp"))
        )
        counts = own.groupBy("family", "label").agg(F.count(F.lit(1)).alias("n"))
        main = counts.groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
        return durable(own.join(main, "family").withColumn("outside", F.col("label") != F.col("main")).drop("main"))

    own = placed(labels)
    degree = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("d"))
    hubs = (
        own.where("NOT outside")
        .join(degree, "fp", "left")
        .groupBy("family", F.pmod(F.xxhash64("fp"), F.lit(CORE_HUBS)).alias("part"))
        .agg(F.max_by("fp", F.struct(F.coalesce("d", F.lit(0)), "fp")).alias("b"))
    )
    tries = durable(own.where("outside").select(F.col("fp").alias("a"), "family").join(hubs, "family").select("a", "b"))
    links = durable(links.unionByName(_confirmed(stored, tries, percent)))
    own = placed(components(links))

    sized = own.join(classes.select("fp", "n_shingles"), "fp")
    whole = sized.groupBy("family").agg(
        F.ceil(F.sum(F.when(F.col("outside"), _load(OUTSIDE_HASHES, OUTSIDE_CLASSES)).otherwise(0.0))).alias("blocks"),
        F.ceil(F.sum(_load(FAMILY_HASHES, FAMILY_CLASSES))).alias("parts"),
    )
    sets = _wanted_sets(stored, sized.select("fp"))
    dealt = durable(sized.join(whole.where("blocks > 0"), "family").join(sets, "fp"))
    one = F.array(F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")))
    part = F.array(F.pmod(F.xxhash64("fp", F.lit(2)), F.col("parts")))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)

    def cut(rows: DataFrame, blocks, parts, first: bool) -> DataFrame:
        return rows.select(
            "family", F.explode(blocks).alias("block"), parts.alias("parts"), "fp", "label", "n_shingles", "hashes"
        ).select("family", "block", F.explode("parts").alias("part"), "fp", "label", "hashes", F.lit(first).alias("first"))

    pieces = cut(dealt.where("outside"), one, every("parts"), True).unionByName(cut(dealt, every("blocks"), part, False))

    def compare(group: pa.Table) -> pa.Table:
        first = group.column("first").to_numpy(zero_copy_only=False)
        fp = group.column("fp").to_numpy()
        label = group.column("label").to_numpy()
        sets = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in group.column("hashes")]
        pairs: list[tuple[int, int]] = []
        x, y = np.flatnonzero(first), np.flatnonzero(~first)
        if len(x) and len(y):
            both = overlaps([sets[i] for i in x], [sets[i] for i in y])
            nx, ny = (np.array([len(sets[i]) for i in z]) for z in (x, y))
            near = 100 * both >= percent * (nx[:, None] + ny[None, :] - both)
            near &= label[x][:, None] != label[y][None, :]
            for i, j in enumerate(near):
                hits = y[np.flatnonzero(j)]
                for k in np.unique(label[hits], return_index=True)[1]:
                    pairs.append((int(fp[x[i]]), int(fp[hits[k]])))
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    extra = pieces.groupBy("family", "block", "part").applyInArrow(compare, "a long, b long")
    return durable(links.unionByName(extra))


def _load(hashes: int, classes: int):
    """A class's share of a block, by its hashes or as one of the block's classes."""
    return F.greatest(F.col("n_shingles") / hashes, F.lit(1.0 / classes))


def overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of membership matrices."""
    owner_l = np.repeat(np.arange(len(left)), [len(s) for s in left])
    owner_r = np.repeat(np.arange(len(right)), [len(s) for s in right])
    flat_l, flat_r = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(flat_l, flat_r)
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    if not len(shared):
        return out.astype(np.int64)

    def places(flat: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(shared, flat)
        at[at == len(shared)] = 0
        hit = shared[at] == flat
        at, owner = at[hit], owner[hit]
        order = np.argsort(at, kind="stable")
        return at[order], owner[order]

    (al, ol), (ar, orr) = places(flat_l, owner_l), places(flat_r, owner_r)
    for start in range(0, len(shared), columns):
        cut_l = slice(*np.searchsorted(al, [start, start + columns]))
        cut_r = slice(*np.searchsorted(ar, [start, start + columns]))
        ml = np.zeros((len(left), columns), dtype=np.float32)
        mr = np.zeros((len(right), columns), dtype=np.float32)
        ml[ol[cut_l], al[cut_l] - start] = 1
        mr[orr[cut_r], ar[cut_r] - start] = 1
        out += ml @ mr.T
    return np.rint(out).astype(np.int64)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per input row.

    Links join documents whose sets of ``size``-word shingles have
    100 * intersection >= percent * union. The default is five words and 0.8.
    """
    found = durable(sketches(docs, size))
    classes, labels = _linked(docs, found, size, percent)
    named = classes.select("fp", "lo").join(labels, "fp")
    lowest = named.groupBy("label").agg(F.min("lo").alias("component"))
    component = named.join(lowest, "label").select("fp", "component")
    return (
        found.select("doc_id", "n_shingles", "fp")
        .join(component, "fp", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
    )


def _linked(docs: DataFrame, found: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The classes (fp, lo, n_shingles, sketch) of stored sketches, and their components (fp, label)."""
    threshold = percent / 100
    classes = durable(
        found.where("fp IS NOT NULL")
        .groupBy("fp")
        .agg(F.min("doc_id").alias("lo"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    )
    banded = _banded(classes)
    hubs = banded.groupBy("key").agg(F.min("fp").alias("hub"), F.count(F.lit(1)).alias("g")).where("g > 1")
    members = durable(banded.join(hubs, "key"))
    star = members.where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()
    shared = members.select("fp").distinct().join(classes.select("fp", "lo"), "fp")
    sets = _stored_sets(docs, shared, size)
    links = _confirmed(sets, durable(_likely(star, classes, threshold)), percent)
    labels = components(links)

    more = _across_small(members, labels, classes, threshold)
    if more.take(1):
        links = durable(links.unionByName(_confirmed(sets, more, percent)))
        labels = components(links)
    links = _across_large(sets, members, classes, links, labels, percent)
    if links is not None:
        labels = components(links)
    return classes, (
        classes.select("fp")
        .join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left")
        .withColumn("label", F.coalesce("label", "fp"))
    )


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs of which one of each component stays, columns unchanged.

    A row is known by its doc_id and text, a component keeps the row of the
    smallest doc_id (null last), and of rows that agree in both one stays. Rows
    without words have no copies: they stay, once per doc_id and text. Texts are
    shuffled once, after equal rows of a task are combined; the verdicts hold
    hashes of texts only.
    """
    found = durable(sketches(docs, size, keys=True))
    _, labels = _linked(docs, found, size, percent)
    own = [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "k1", "k2"]
    key = F.struct("no_id", "id", "k1", "k2")
    rows = found.select("fp", *own)
    best = rows.where("fp IS NOT NULL").join(labels, "fp").groupBy("label").agg(F.min(key).alias("key")).select("key.*")
    bare = rows.where("fp IS NULL").select("no_id", "id", "k1", "k2").distinct()
    kept = durable(best.unionByName(bare))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    id_of = F.col("`doc_id`").cast("long")
    keyed = docs.select(
        whole, id_of.isNull().alias("no_id"), F.coalesce(id_of, F.lit(0)).alias("id"), *text_keys(F.col("`text`").cast("string"))
    )
    once = keyed.groupBy("no_id", "id", "k1", "k2").agg(F.first("whole").alias("whole"))
    return once.join(kept, ["no_id", "id", "k1", "k2"], "left_semi").select("whole.*")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked at 3-word shingles and a similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)
