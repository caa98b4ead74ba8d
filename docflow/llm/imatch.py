"""Document fingerprints: I-Match with randomised lexicons.

Terms are kept whose inverse document frequency lies in a band (``IDF_BAND``),
distinct and sorted; then subsets of them are hashed that randomised lexicons
select. There are ``LEXICONS`` random orders of the lexicon and for each of them
nested lexicons, each with half of the terms of the one before. A text with n
terms is hashed with the two sizes that leave it one to two and half a term to
one on average, so that short and long texts bear a change alike, and near texts
share at least one of the two sizes. Two fingerprints are as like as the share
of equal hashes among the sizes they share.

Everything is columns and joins. Terms are counted once over all documents; the
lexicon has at most (mean distinct terms) * exp(IDF_BAND[1]) terms at any size of
the corpus, is counted before it is broadcast, and joined by shuffle above
``MOST_BROADCAST``. Texts move once, to meet the heads that their predecessors
need, which move too. Documents are put in order by Spark's range sort of ids
alone; neighbours across its partitions are found from one row a partition.

Defined results: a null text is empty; a null id comes first; rows that are equal in id
and text are one document in the order, and each is returned; among
different texts of one id the MD5 decides the order; a text without a term of
the band has the hash of its whole text as fingerprint, so equal texts always
have equal fingerprints, with likeness 1; a single document is its own next; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docflow.llm.common import ascii_lower, durable, need, table

#: Terms are kept with log(documents / documents that have the term) within it.
IDF_BAND = (2.5, 8.0)
#: Random orders of the lexicon: 4 bits each in one long.
LEXICONS = 16
#: Lexicons of up to so many terms are broadcast (about 40 bytes each).
MOST_BROADCAST = 1_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """The distinct lower-case words of a text, and the empty string."""
    return F.array_distinct(F.concat(F.split(ascii_lower(text), SEPARATORS), F.array(F.lit(""))))


def _sizes(term: Column) -> Column:
    """Per random order the smallest of the nested lexicons that has the term, as 4 bits: the trailing zeros of a hash."""

    def zeros(x):
        few = x.bitwiseAND(F.lit(2**15 - 1)).bitwiseOR(F.lit(2**15))
        return F.bit_count(few.bitwiseXOR(few - 1)).cast("long") - 1

    out = F.lit(0).cast("long")
    for i in range(LEXICONS):
        out = out.bitwiseOR(F.shiftleft(zeros(F.xxhash64(F.lit(i), term)), 4 * i))
    return out


def lexicon(docs: DataFrame, band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """term (64-bit hash), sizes, top: the terms of the band over all rows of docs (text)."""
    n_docs = docs.count()
    words = docs.select(F.explode(terms(F.col("text"))).alias("word")).where("word <> ''")
    counts = words.groupBy(F.xxhash64("word").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    least, most = n_docs * math.exp(-band[1]), max(1.0, n_docs * math.exp(-band[0]))
    kept = counts.where((F.col("n") >= least) & (F.col("n") <= most)).select("term", _sizes(F.col("term")).alias("sizes"))
    top = F.greatest(*[F.shiftright("sizes", 4 * i).bitwiseAND(F.lit(15)) for i in range(LEXICONS)])
    return kept.select("term", "sizes", top.cast("int").alias("top"))


def _reached(found: str, size: Column) -> Column:
    return F.filter(found, lambda t: t["top"] >= size)


def _chosen(ordered: Column, shift: int, least: Column) -> Column:
    return F.filter(ordered, lambda t: F.shiftright(t["sizes"], shift).bitwiseAND(F.lit(15)) >= least)


def fingerprints(rows: DataFrame, **inputs: tuple[str, str]) -> DataFrame:
    """Adds columns struct(size, hashes, whole), named by the keyword, each from (array of struct(term, sizes, top), text hash).

    Every column is built of columns of the step before, so that nothing is
    evaluated again for each of the hashes.
    """
    out = rows.columns
    for name, (found, _) in inputs.items():
        n = F.size(found)
        size = F.when(n > 0, F.least(F.lit(14), F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int"))).otherwise(-1)
        rows = rows.withColumn(f"{name}_size", size)
    for name, (found, _) in inputs.items():
        size = F.col(f"{name}_size")
        rows = rows.withColumn(f"{name}_sorted", F.array_sort(_reached(found, size)))
    for name, (_, text_hash) in inputs.items():
        size, ordered, hashes = F.col(f"{name}_size"), F.col(f"{name}_sorted"), []
        for i in range(2 * LEXICONS):
            chosen = _chosen(ordered, 4 * (i % LEXICONS), size + i // LEXICONS)
            hashes.append(F.hash(F.transform(chosen, lambda t: t["term"])))
        none = F.hash(F.array().cast("array<bigint>"))
        hashes = F.when(size >= 0, F.transform(F.array(*hashes), lambda h: F.when(h != none, h).otherwise(F.lit(0))))
        hashes = hashes.otherwise(F.array().cast("array<int>"))
        rows = rows.withColumn(name, F.struct(size.alias("size"), hashes.alias("hashes"), F.when(size < 0, F.col(text_hash)).alias("whole")))
    return rows.select(*out, *inputs)


def likeness(rows: DataFrame, name: str, x: str, y: str) -> DataFrame:
    """Adds the share of equal hashes of the lexicon sizes that the fingerprints x and y share, from 0 to 1."""
    a, b, out = F.col(x), F.col(y), rows.columns
    step = b["size"] - a["size"]
    left = F.when(step == 1, F.slice(a["hashes"], LEXICONS + 1, LEXICONS)).when(step == -1, F.slice(a["hashes"], 1, LEXICONS)).otherwise(a["hashes"])
    right = F.when(step == 1, F.slice(b["hashes"], 1, LEXICONS)).when(step == -1, F.slice(b["hashes"], LEXICONS + 1, LEXICONS)).otherwise(b["hashes"])
    pairs = F.filter(F.arrays_zip(left.alias("l"), right.alias("r")), lambda p: (p["l"] != 0) | (p["r"] != 0))
    rows = rows.withColumn("pairs_", pairs)
    equal = F.size(F.filter("pairs_", lambda p: p["l"] == p["r"])) / F.size("pairs_")
    apart = (a["size"] < 0) | (b["size"] < 0) | (F.abs(step) > 1) | (F.size("pairs_") == 0)
    return rows.select(*out, F.when(a.eqNullSafe(b), 1.0).when(apart, 0.0).otherwise(equal).alias(name))


def written(x: Column) -> Column:
    """A fingerprint as text: size and hexadecimal hashes, or the whole text's hash."""
    hashes = F.transform(x["hashes"], lambda h: F.when(h == 0, "").otherwise(F.lower(F.hex(h.cast("long").bitwiseAND(F.lit(2**32 - 1))))))
    return F.when(x["size"] < 0, F.concat(F.lit("text:"), F.lower(F.hex(x["whole"])))).otherwise(
        F.concat(x["size"].cast("string"), F.lit(":"), F.array_join(hashes, "."))
    )


def _documents(docs: DataFrame) -> DataFrame:
    """key, doc_id, text: the key is the document's, equal for equal rows."""
    rows = need(docs, doc_id="long", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "text")
    return rows.select(F.unhex(F.md5(named)).alias("key"), "doc_id", "text")


def followers(rows: DataFrame) -> DataFrame:
    """key, before, take, copies: for every document the one before it and how many code points that takes from it."""
    each = rows.select("key", "doc_id", F.length("text").alias("n_chars")).groupBy("key", "doc_id", "n_chars")
    each = each.agg(F.count(F.lit(1)).alias("copies")).orderBy(F.col("doc_id").asc_nulls_first(), "key")
    placed = durable(each.select("key", "n_chars", "copies", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    by = Window.partitionBy("part").orderBy("at")
    # one row for each partition of the sort, whatever the number of documents
    firsts = placed.groupBy("part").agg(F.min_by("key", "at").alias("first"))
    parts = Window.orderBy("part")
    start = F.first("first").over(parts)
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(parts), start).alias("next_first"))
    linked = placed.withColumn("next", F.lead("key").over(by)).join(F.broadcast(firsts), "part")
    return linked.select(
        F.coalesce("next", "next_first").alias("key"), F.col("key").alias("before"),
        F.floor(F.col("n_chars") / 4).cast("int").alias("take"), "copies",
    )


def edited_texts(rows: DataFrame) -> DataFrame:
    """key, next_key, copies, doc_id, text, edited: the last quarter replaced by the next document's first code points."""
    doc = F.first(F.struct("doc_id", "text")).alias("doc")
    whole = rows.groupBy("key").agg(doc)
    head = F.expr("substring(doc.text, 1, take)")
    heads = whole.join(followers(rows), "key").select(
        F.col("before").alias("key"), F.col("key").alias("next_key"), "take", "copies", head.alias("head"), F.col("doc.doc_id").alias("next_doc_id")
    )
    kept = F.expr("substring(doc.text, 1, length(doc.text) - take)")
    return whole.join(heads, "key").select(
        "key", "next_key", "copies", "doc.doc_id", "next_doc_id", "doc.text", F.concat(kept, "head").alias("edited")
    )


def fingerprint_pairs(docs: DataFrame, band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """Per document its fingerprint, its edited text's, and their likeness to each other and to the next document's."""
    rows = _documents(docs)
    words = durable(lexicon(rows, band))
    few = words.count() <= MOST_BROADCAST
    mark = F.xxhash64(F.lit(""))
    words = words.unionByName(words.sparkSession.range(1).select(mark.alias("term"), F.lit(0).cast("long").alias("sizes"), F.lit(-1).alias("top")))
    both = edited_texts(rows).select(
        "key", "next_key", "copies", "doc_id", "next_doc_id", F.length("text").cast("long").alias("n_chars"),
        F.unhex(F.sha2("edited", 256)).alias("edited_sha256"),
        F.xxhash64("text").alias("hash"), F.xxhash64("edited").alias("edited_hash"),
        F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("x"),
    )
    carried = [c for c in both.columns if c != "x"]
    split = both.select(*carried, "x.which", F.explode(terms(F.col("x.text"))).alias("word")).withColumn("term", F.xxhash64("word")).drop("word")
    hits = split.join(F.broadcast(words) if few else words, "term")
    found = hits.groupBy(*carried).agg(F.collect_list(F.struct("which", "term", "sizes", "top")).alias("found"))

    def of(which):
        return F.filter("found", lambda t: (t["which"] == which) & (t["top"] >= 0))

    found = found.select(*carried, of(0).alias("own_terms"), of(1).alias("changed_terms"))
    printed = fingerprints(found, own=("own_terms", "hash"), changed=("changed_terms", "edited_hash"))
    printed = durable(likeness(printed, "near_edited", "own", "changed").drop("own_terms", "changed_terms", "hash", "edited_hash"))
    after = printed.select(F.col("key").alias("next_key"), F.col("own").alias("next_own"))
    return likeness(printed.join(after, "next_key"), "near_next", "own", "next_own").select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"),
        written(F.col("own")).alias("fingerprint"), written(F.col("changed")).alias("edited_fingerprint"),
        "near_edited", "near_next", "next_doc_id",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    ).drop("copy")


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_pairs(table(spark, sf_dir, "documents"))
