"""Connected components of an edge table, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import durable

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in edges (a, b): label is the component's smallest node.

    In each round every root with a smaller root next to it hooks to the
    smallest of them, and labels are then shortened until they are roots again.
    Roots that are left are no two neighbours, so at least half of those that
    still had edges go in each round. Edges inside one component leave the edge
    table. Nothing but emptiness checks reaches the driver. Null ends and loops
    are no edges; no edges give no rows.
    """
    edges = durable(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    live = edges
    for _ in range(MAX_ROUNDS):
        hooks = live.groupBy(F.col("b").alias("label")).agg(F.min("a").alias("to"))
        hooked = labels.join(hooks, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = _flat(durable(hooked))
        live = durable(
            live.join(labels.select(F.col("node").alias("a"), F.col("label").alias("x")), "a")
            .join(labels.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        if not live.take(1):
            return labels
    raise RuntimeError("components did not settle")


def _flat(labels: DataFrame) -> DataFrame:
    """label := label of label until nothing changes; hooks only go down, so it ends."""
    while True:
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = durable(labels.join(up, "label").select("node", "label", "above"))
        labels = jumped.select("node", F.col("above").alias("label"))
        if not jumped.where("label <> above").take(1):
            return labels
