"""Input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables of long texts, whose rows cost far more than their bytes.
TEXT_TABLES = frozenset({"documents", "pages", "conversations"})
#: Tables of texts up to this size are dealt over the cores.
SMALL_BYTES = 16 << 20


def read_table(spark: SparkSession, folder: str, name: str, rows_per_task: int | None = None) -> DataFrame:
    """One input table, read lazily by Spark's own reader.

    A file with one row group is one task, however many cores there are. So a
    small table of texts is dealt out, which shuffles ``SMALL_BYTES`` at most;
    larger tables have row groups enough and are never shuffled here.

    ``rows_per_task`` is for work that costs far more than moving the rows: they
    are dealt over tasks of that many at most, so that no task grows with the
    table. Rows are counted from the files' footers.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if rows_per_task is not None:
        return df.repartition(max(-(-df.count() // rows_per_task), spark.sparkContext.defaultParallelism))
    if name in TEXT_TABLES:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size <= SMALL_BYTES:
            return df.repartition(spark.sparkContext.defaultParallelism)
    return df
