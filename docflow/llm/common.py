"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.sources.tables import read_table

table = read_table


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: written as a table to the shared checkpoint folder and read back.

    The folder comes from ``spark.checkpoint.dir``; a temporary one is set only
    where the session names none and runs on a single machine. A table, not an RDD
    checkpoint: it survives lost executors alike, is compressed, has known sizes
    for join planning, and carries no constraints of the plan that made it, which
    would otherwise pile up over iterations.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/docflow-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """Where the cluster's machines share files."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.partition("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="docflow-checkpoint-"))
    return sc.getCheckpointDir()


def mark(spark: SparkSession) -> int:
    """How many durable tables this application has written: ``release`` from there deletes what follows."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0) -> int:
    """Delete this application's durable tables, once results that read them are written."""
    own = _written.get(spark.sparkContext.applicationId, [])
    paths = own[since:]
    del own[since:]
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(hadoop).delete(place, True)
    return len(paths)


def need(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, cast to their types; others are dropped.

    Extra columns of the input can so never clash with columns an operator adds.
    """
    return df.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in columns.items()])


def unused(names: list[str], name: str) -> str:
    """``name``, longer where a column has it already."""
    taken = {x.lower() for x in names}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text):
    """Lower-case A-Z only, everything else unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text in DuckDB SQL: each byte and eight steps (-1) folded one after the other."""
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [ascii(({text})[i]), -1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[]))"
    step = "CASE WHEN x < 0 THEN xor(c >> 1, 3988292384 * (c & 1)) ELSE xor(c, x) END"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda c, x: {step}), 4294967295)"
