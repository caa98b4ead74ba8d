"""Connected components of an edge table, and tables that cut the lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.sources.files import stored


def shared_keys(rows: DataFrame, node: str, *keys: str) -> DataFrame:
    """(node, key, hub): for every key value that several rows have, each of them and the smallest: linear, no pairs."""
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("x")
    long = rows.select(F.col(node).alias("node"), values).select("node", "x.key", "x.value").where("value IS NOT NULL")
    hubs = long.groupBy("key", "value").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return stored(long.join(hubs, ["key", "value"]).select("node", "key", "hub"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, for nodes with an edge.

    Roots hook to their smallest neighbour, then every label becomes a root's
    again; settled edges leave. Only emptiness reaches the driver.
    """
    live = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    labels = live.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    while live.take(1):
        hooks = live.groupBy(F.col("b").alias("label")).agg(F.min("a").alias("to"))
        labels = stored(labels.join(hooks, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        while True:
            above = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
            step = stored(labels.join(above, "label"))
            labels = step.select("node", F.col("above").alias("label"))
            if not step.where("above <> label").take(1):
                break
        x = labels.select(F.col("node").alias("a"), F.col("label").alias("x"))
        y = labels.select(F.col("node").alias("b"), F.col("label").alias("y"))
        live = stored(
            live.join(x, "a").join(y, "b").where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
    return labels


def key_index(rows: DataFrame, labels: DataFrame, node: str, *keys: str) -> DataFrame:
    """(key, value, label): one row per key value, with the component of the rows that have it; kept for ``extend``."""
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("x")
    long = rows.select(F.col(node).alias("node"), values).select("node", "x.key", "x.value").where("value IS NOT NULL")
    labelled = long.join(labels, "node", "left").select("key", "value", F.coalesce("label", "node").alias("label"))
    return labelled.groupBy("key", "value").agg(F.min("label").alias("label"))


def extend(labels: DataFrame, index: DataFrame, new: DataFrame, node: str, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(labels, index) with new rows added, as if all rows had been labelled at once.

    ``labels``: (node, label) of all rows so far. A graph is built of the new rows
    and of the components that they touch, each contracted to its label; only
    the new rows' keys are looked at. Labels are the smallest nodes, before and after.
    """
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("x")
    long = stored(new.select(F.col(node).alias("node"), values).select("node", "x.key", "x.value").where("value IS NOT NULL"))
    touched = long.groupBy("key", "value").agg(F.min("node").alias("hub"))
    touched = stored(touched.join(index, ["key", "value"], "left"))
    edges = long.join(touched, ["key", "value"]).select(F.col("node").alias("a"), F.coalesce("label", "hub").alias("b"))
    moved = components(edges).withColumnRenamed("node", "old").withColumnRenamed("label", "new")
    moved = stored(moved)
    before = labels.join(moved, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label"))
    own = new.select(F.col(node).alias("node")).join(moved, F.col("node") == F.col("old"), "left").select("node", F.coalesce("new", "node").alias("label"))
    entries = index.unionByName(touched.where("label IS NULL").select("key", "value", F.col("hub").alias("label")))
    entries = entries.join(moved, F.col("label") == F.col("old"), "left").select("key", "value", F.coalesce("new", "label").alias("label"))
    return before.unionByName(own), entries
