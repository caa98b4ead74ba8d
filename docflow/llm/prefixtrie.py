"""Conversation prefix trie by leaf-peeling message passing.

A node is a distinct sequence of first turns. Its key is its depth and the
running XOR of 128 bits of hash per turn (of place, role and text), a window
over one conversation, so texts never move and nobody builds a sequence.

The conversations whose smallest member a node has own a run of nodes each, up
to the conversation's end. Nodes of such a run with one child are joined to the
node below them, so a long tail that no other conversation shares is one stretch
instead of many rounds. Then leaves are peeled: each stretch holds a counter of
children that are still open; stretches at zero send the totals of their
subtrees to their parents, summed before they are shuffled, until only the
root's stretch finishes. Rounds are as many as stretches lie on a path.

Rows with one key: a parent with very many children gets one row per task of
the messages; children look up their parent in a sort-merge join, whose large
side Spark deals out again. Members that end at one node meet in chunks of
``2 ** CHUNK_BITS`` neighbouring ids and are hashed over a stream of chunks.

Defined results: null roles and texts are empty; a null turn comes first; rows
of one turn follow by the digest of role and text, equal ones stay repeated;
rows without a conversation id belong to no conversation and are left out; an
empty table gives no node, not even a root; extra columns are ignored. Two
sequences count as equal if 128 bits of hash agree at one depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docflow.llm.common import crc32_sql, durable, need, table
from docflow.llm.streams import EMPTY_SHA256, sha256_by_key

#: Conversation ids of one chunk share all but this many low bits.
CHUNK_BITS = 12
#: Blocks of so many ids share their first turns with the block's first conversation, up to MOST_SHARED - 1 turns.
BLOCK, MOST_SHARED = 100, 6
NODE = ("depth", "p1", "p2")
PARENT = ("q0", "q1", "q2")


def _turns(rows: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest, n_chars of every turn."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    small = need(rows, conv_id="long", turn="long", role="string", text="string").where("conv_id IS NOT NULL")
    small = small.select("conv_id", "turn", digest.alias("digest"), F.length(text).cast("long").alias("n_chars"))
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return small.select("conv_id", F.row_number().over(by).alias("pos"), "digest", "n_chars")


def shared_turns(conv: Column) -> Column:
    """How many first turns a conversation takes from its block's first conversation."""
    return (F.crc32(conv.cast("string").cast("binary")) % MOST_SHARED).cast("int")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all conversation ids, turns of the rebuilt conversations as conv_id, part, pos, digest, n_chars).

    A block's first turns go to its up to BLOCK conversations; nothing else is repeated.
    """
    convs = turns.select("conv_id").distinct()
    taken = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"), shared_turns(F.col("conv_id")).alias("h"))
    first = turns.where((F.col("conv_id") % BLOCK == 0) & (F.col("pos") < MOST_SHARED)).withColumnRenamed("conv_id", "base")
    shared = first.join(taken.where("h > 0"), "base").where("pos <= h").select("conv_id", F.lit(0).alias("part"), "pos", "digest", "n_chars")
    own = turns.where(F.col("pos") > shared_turns(F.col("conv_id"))).select("conv_id", F.lit(1).alias("part"), "pos", "digest", "n_chars")
    return convs, shared.unionByName(own)


def paths(rows: DataFrame) -> DataFrame:
    """The node (depth, p1, p2) of every turn, its parent (q0, q1, q2), n_chars, and whether the conversation ends there."""
    by = Window.partitionBy("conv_id").orderBy("part", "pos")
    placed = rows.select("*", F.row_number().over(by).alias("depth"), F.lead("pos").over(by).isNull().alias("ends"))
    hashed = placed.select(
        "*", F.xxhash64("depth", "digest").alias("x1"), F.xxhash64(F.lit("second"), "digest", "depth").alias("x2")
    )
    to_here = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefixed = hashed.select("*", F.bit_xor("x1").over(to_here).alias("p1"), F.bit_xor("x2").over(to_here).alias("p2"))
    return prefixed.select(
        "conv_id", "depth", "p1", "p2", (F.col("depth") - 1).alias("q0"),
        F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("q2"),
        "n_chars", "ends",
    )


def nodes(convs: DataFrame, walked: DataFrame) -> DataFrame:
    """Each node once: conv_id (smallest member), n_convs, value (its own saved tokens), n_children, parent."""
    members = F.count(F.lit(1)).alias("n_convs")
    inner = walked.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), members, F.max("n_chars").alias("n_chars"),
        *[F.min(q).alias(q) for q in PARENT],
    )
    root = convs.agg(F.min("conv_id").alias("conv_id"), members).where("n_convs > 0")
    none = F.lit(None)
    root = root.select(
        F.lit(0).alias("depth"), *[F.lit(0).cast("long").alias(p) for p in NODE[1:]], "conv_id", "n_convs",
        F.lit(0).cast("long").alias("n_chars"), none.cast("int").alias("q0"), *[none.cast("long").alias(q) for q in PARENT[1:]],
    )
    found = durable(inner.unionByName(root))
    children = found.where("q0 IS NOT NULL").groupBy(*[F.col(q).alias(p) for q, p in zip(PARENT, NODE)])
    children = children.agg(F.count(F.lit(1)).alias("n_children"))
    return found.join(children, list(NODE), "left").select(
        *NODE, *PARENT, "conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("n_chars")).alias("value"),
    )


def stretches(found: DataFrame) -> DataFrame:
    """``nodes`` with stretch (numbered within the owner from its end), below (saved from here to the stretch's bottom) and parent_conv_id, parent_stretch."""
    up = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = found.withColumn("stretch", F.sum((F.col("n_children") != 1).cast("int")).over(up))
    inside = Window.partitionBy("conv_id", "stretch").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = durable(cut.withColumn("below", F.sum("value").over(inside)))
    above = cut.select(*[F.col(p).alias(q) for p, q in zip(NODE, PARENT)], F.col("conv_id").alias("parent_conv_id"), F.col("stretch").alias("parent_stretch"))
    return durable(cut.join(above, list(PARENT), "left"))


def peel(cut: DataFrame) -> DataFrame:
    """conv_id, stretch, leaves, received: per stretch its leaves and what its bottom's children have saved.

    Every round writes the open stretches with what they have received; those
    whose counter came to zero are the next round's senders.
    """
    top = F.min_by(F.struct("parent_conv_id", "parent_stretch"), "depth")
    state = cut.groupBy("conv_id", "stretch").agg(
        F.max_by("n_children", "depth").alias("open"), F.max("below").alias("own"), top.alias("top"),
    ).select(
        "conv_id", "stretch", "open", "own", "top.parent_conv_id", "top.parent_stretch",
        (F.col("open") == 0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("received"),
    )
    state, finished = durable(state), []
    while True:
        done, waiting = state.where("open = 0"), state.where("open > 0")
        finished.append(done)
        if waiting.isEmpty():
            break
        sent = done.groupBy(F.col("parent_conv_id").alias("conv_id"), F.col("parent_stretch").alias("stretch")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("leaves").alias("more_leaves"), F.sum(F.col("received") + F.col("own")).alias("more_saved")
        )
        zero = F.lit(0).cast("long")
        state = durable(
            waiting.join(sent, ["conv_id", "stretch"], "left").select(
                "conv_id", "stretch", (F.col("open") - F.coalesce("n", zero)).alias("open"), "own", "parent_conv_id", "parent_stretch",
                (F.col("leaves") + F.coalesce("more_leaves", zero)).alias("leaves"),
                (F.col("received") + F.coalesce("more_saved", zero)).alias("received"),
            )
        )
    out = finished[0]
    for done in finished[1:]:
        out = out.unionByName(done)
    return out.select("conv_id", "stretch", "leaves", "received")


def end_hashes(convs: DataFrame, walked: DataFrame) -> DataFrame:
    """Per node at which conversations end: the SHA-256 of their ids in order."""
    turnless = convs.join(walked.where("ends"), "conv_id", "left_anti")
    at_root = turnless.select("conv_id", F.lit(0).alias("depth"), *[F.lit(0).cast("long").alias(p) for p in NODE[1:]])
    ends = walked.where("ends").select("conv_id", *NODE).unionByName(at_root)
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))
    chunks = ends.groupBy(*NODE, F.shiftright("conv_id", CHUNK_BITS).alias("at")).agg(F.array_join(ids, ",").alias("piece"))
    hashed = sha256_by_key(chunks.select(F.concat_ws(":", *NODE).alias("key"), "at", "piece"), ",")
    part = F.split("key", ":")
    return hashed.select(part[0].cast("int").alias("depth"), part[1].cast("long").alias("p1"), part[2].cast("long").alias("p2"), F.col("sha256").alias("ends_sha256"))


def trie(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per node of the trie of ``rows`` (conv_id, part, pos, digest, n_chars); conversations without rows end at the root."""
    walked = durable(paths(rows))
    cut = stretches(nodes(convs, walked))
    full = cut.join(peel(cut), ["conv_id", "stretch"]).join(end_hashes(convs, walked), list(NODE), "left")
    return full.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), (F.col("received") + F.col("below")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of a conversation table as it stands: no turns are shared between conversations but equal ones."""
    placed = durable(_turns(turns))
    return trie(placed.select("conv_id").distinct(), placed.withColumn("part", F.lit(1)))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on its block's first turns."""
    placed = durable(_turns(table(spark, sf_dir, "conversations")))
    return trie(*rebuilt(placed))


def _oracle() -> str:
    return f"""
WITH digested AS (
  SELECT conv_id, turn, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
         length(coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos FROM digested),
named AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS name FROM t),
c AS (SELECT conv_id, conv_id - conv_id % {BLOCK} AS base, {crc32_sql("name")} % {MOST_SHARED} AS h FROM named),
r AS (
  SELECT c.conv_id, 0 AS part, pos, digest, n FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, pos, digest, n FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
p AS (SELECT conv_id, list(digest) OVER w AS k, n, lead(n) OVER w IS NULL AS ends
      FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
m AS (
  SELECT conv_id, []::VARCHAR[] AS k, 0 AS n, conv_id NOT IN (SELECT conv_id FROM p) AS ends FROM c
  UNION ALL SELECT * FROM p),
v AS (
  SELECT k, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(n) AS value,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM m GROUP BY k),
kids AS (SELECT k[:-2] AS k, count(*) AS n_children FROM v WHERE len(k) > 0 GROUP BY 1),
w AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN kids USING (k)),
up AS (SELECT k[:d] AS k, value, n_children FROM (SELECT *, unnest(range(0, len(k) + 1)) AS d FROM w)),
total AS (SELECT k, sum(value)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM up GROUP BY k)
SELECT w.conv_id, len(w.k)::BIGINT AS depth, parent.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
FROM w JOIN total USING (k) LEFT JOIN v parent ON len(w.k) > 0 AND parent.k = w.k[:-2]
"""


ORACLE_SQL = _oracle()
