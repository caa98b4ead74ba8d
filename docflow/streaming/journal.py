"""Generation records as a stream: what overtakes the pages written so far is parsed, an append-only table of pages comes out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.functions.doctags import parse_doctags
from docflow.functions.render import to_markdown
from docflow.operators.jobs import RECORD, record_rank

#: By the time files were written: how far behind the newest a file may come, and how long a record is known as a repeated one.
KEEP = "7 days"
WRITTEN = "job string, page long, rank struct<valid: boolean, attempt: int, tie: bigint>, batch long"


def read_journal(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """The records of a journal as they are published, with ``seen``, when their file was written."""
    files = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return files.select("*", F.col("_metadata.file_modification_time").alias("seen"))


def convert(records: DataFrame, *kept: str) -> DataFrame:
    """Records to (job, page, attempt, codes, markdown, error) and the columns kept: the same plan for streams and tables."""
    parsed = records.select("job", "page", "attempt", "error", *kept, parse_doctags(F.col("raw"), F.col("stop_reason")).alias("p"))
    done = F.col("error").isNull()
    return parsed.select(
        "job", "page", "attempt", F.when(done, F.col("p.diagnostics.code")).alias("codes"), F.when(done, to_markdown(F.col("p"))).alias("markdown"), "error", *kept
    )


def arriving(records: DataFrame) -> DataFrame:
    """Records with their ``rank``, without those later than the watermark and those that repeat one of the last ``KEEP``.

    The state is a page's ranks, and Spark drops it behind the watermark. None of it passes through Python.
    """
    rows = records.withWatermark("seen", KEEP).select("job", "page", "attempt", "raw", "stop_reason", "error", "seen", record_rank().alias("rank"))
    return rows.dropDuplicatesWithinWatermark(["job", "page", "rank"])


def overtaking(records: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """Each page's best record, if it is better than all that was written of the page: valid, of the highest attempt, else the last failure.

    Both sides meet in one grouping; written rows bring their ranks only, and win if ranks are equal.
    """
    columns = ["attempt", "raw", "stop_reason", "error", "rank"]
    rows = records.select("job", "page", F.struct("rank", F.lit(False).alias("written")).alias("by"), F.struct(*columns).alias("record"))
    if written is not None:
        none = F.lit(None).cast(rows.schema["record"].dataType).alias("record")
        rows = rows.union(written.select("job", "page", F.struct("rank", F.lit(True).alias("written")), none))
    best = rows.groupBy("job", "page").agg(F.max_by("record", "by").alias("record"))
    return best.where(F.col("record").isNotNull()).select("job", "page", "record.*")


def start(spark: SparkSession, journal: str, target: str, checkpoint: str, files_per_trigger: int = 64):
    """Convert what arrives and counts; each batch is written under its number, so a replayed batch replaces itself.

    What counts is told by the ranks in the batches of lower numbers, so the target
    belongs to the stream as its checkpoint does, and no page ever falls back.
    """

    def write(batch: DataFrame, number: int) -> None:
        written = batch.sparkSession.read.schema(WRITTEN).parquet(target).where(F.col("batch") < number) if number else None
        convert(overtaking(batch, written), "rank").write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = arriving(read_journal(spark, journal, files_per_trigger))
    return stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pages(spark: SparkSession, target: str) -> DataFrame:
    """(job, page, attempt, codes, markdown, error): each page as the stream has written it last.

    The stream writes a page again only when a better record has come, so this
    looks at little more than one row for each page.
    """
    rows = spark.read.parquet(target)
    best = rows.groupBy("job", "page").agg(F.max_by(F.struct("attempt", "codes", "markdown", "error"), "batch").alias("best"))
    return best.select("job", "page", "best.*")
