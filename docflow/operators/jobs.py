"""Page jobs: resume plans, the generator port, journals and reports.

A journal is a folder of records by attempt. Beside them lie hidden files: the
request that the job was started with, a claim for each attempt, and a lock
while a run that wants the journal for itself is on.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "job string, page long, attempt int, raw string, token_ids array<long>, stop_reason string, error string"
MAX_RAW, MAX_ATTEMPTS = 262_144, 10_000


def missing_pages(selected: DataFrame, journal: DataFrame) -> DataFrame:
    """Selected (job, page) rows that no valid journal record covers."""
    return selected.join(valid_records(journal), ["job", "page"], "left_anti")


def is_valid() -> Column:
    """A record that can be reused: text within its budget, ids that aren't negative, a known stop reason."""
    return F.coalesce(
        F.col("error").isNull()
        & (F.length("raw") <= MAX_RAW)
        & F.col("stop_reason").isin("eos", "length")
        & ~F.exists(F.coalesce("token_ids", F.array().cast("array<long>")), lambda t: t < 0),
        F.lit(False),
    )


def valid_records(journal: DataFrame) -> DataFrame:
    return journal.where(is_valid())


def record_rank() -> Column:
    """What a record is preferred by: valid, then its attempt, then a hash, so that no tie is left to chance."""
    tie = F.xxhash64("raw", "token_ids", "stop_reason", "error")
    return F.struct(is_valid().alias("valid"), F.coalesce("attempt", F.lit(0)).alias("attempt"), tie.alias("tie"))


def latest_records(journal: DataFrame) -> DataFrame:
    """One record per (job, page): the valid one of the highest attempt, else the last failure."""
    columns = [c for c in journal.columns if c not in ("job", "page")]
    best = journal.groupBy("job", "page").agg(F.max_by(F.struct(*columns), record_rank()).alias("best"))
    return best.select("job", "page", "best.*").select(*journal.columns)


def next_attempt(journal: DataFrame) -> DataFrame:
    """(job, attempt): the next unused attempt number of each job, null beyond MAX_ATTEMPTS."""
    following = F.max(F.coalesce("attempt", F.lit(0))) + 1
    return journal.groupBy("job").agg(F.when(following <= MAX_ATTEMPTS, following).cast("int").alias("attempt"))


def generate(pages: DataFrame, generator: Callable[[int], tuple[str, list[int], str]]) -> DataFrame:
    """One record per (job, page, attempt) from the generator; an exception becomes that page's error only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page in batch.column("page").to_pylist():
                try:
                    out.append((*generator(page), None))
                except Exception as e:  # noqa: BLE001
                    out.append((None, None, None, str(e)[:200]))
            raw, ids, stop, error = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(raw, pa.string()),
                    pa.array([None if x is None else list(x) for x in ids], pa.list_(pa.int64())),
                    pa.array(stop, pa.string()),
                    pa.array(error, pa.string()),
                ],
                names=["job", "page", "attempt", "raw", "token_ids", "stop_reason", "error"],
            )

    return pages.select("job", "page", F.col("attempt").cast("int").alias("attempt")).mapInArrow(run, RECORD)


class JobLocked(RuntimeError):
    """Another run holds the journal, or one has died with its lock; nobody but its operator may tell which."""


class RequestChanged(ValueError):
    """The journal was started with other pages or options."""


class _Folder:
    """The few file operations a journal needs, by Hadoop's file system of its path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path
        self.files = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.local = self.files.getUri().getScheme() == "file"

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def create(self, name: str, text: str) -> bool:
        """Write a file that must not exist; whether it is ours.

        A local file is opened exclusively, as Hadoop's local file system looks
        before it writes; others create atomically.
        """
        at = self._at(name)
        self.files.mkdirs(at.getParent())
        if self.local:
            try:
                fd = os.open(at.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            except FileExistsError:
                return False
            with os.fdopen(fd, "w") as f:
                f.write(text)
            return True
        try:
            out = self.files.create(at, False)
        except Exception as e:  # noqa: BLE001  py4j wraps the Java exception
            if "AlreadyExists" in str(e):
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def read(self, name: str) -> str:
        source = self.files.open(self._at(name))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def names(self, name: str) -> list[str]:
        at = self._at(name)
        return [f.getPath().getName() for f in self.files.listStatus(at)] if self.files.exists(at) else []

    def move(self, old: str, new: str) -> None:
        if self.files.exists(self._at(new)) or not self.files.rename(self._at(old), self._at(new)):
            raise RuntimeError(f"{new} can't be published")

    def delete(self, name: str) -> None:
        self.files.delete(self._at(name), True)


def selection_digest(selected: DataFrame) -> str:
    """Count and order-free hash of the distinct (job, page) rows of a selection."""
    rows = selected.select("job", "page").distinct()
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("job", "page")).alias("a"), F.bit_xor(F.xxhash64("page", "job")).alias("b")).first()
    return f"{r['n']}:{(r['a'] or 0) & (2**64 - 1):016x}{(r['b'] or 0) & (2**64 - 1):016x}"


def claim_attempt(folder: _Folder) -> int:
    """The next attempt number, which no other run has or will get."""
    taken = [int(n.removeprefix("attempt-")) for n in folder.names("_claims")]
    number = max(taken, default=0) + 1
    while not folder.create(f"_claims/attempt-{number:05d}", ""):
        number += 1
    if number > MAX_ATTEMPTS:
        raise RuntimeError(f"the journal has used its {MAX_ATTEMPTS} attempts")
    return number


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """The published records of a journal; none where nothing is published yet."""
    if not any(n.startswith("attempt=") for n in _Folder(spark, path).names("")):
        return spark.createDataFrame([], RECORD)
    return spark.read.schema(RECORD).parquet(path)


def run_job(
    spark: SparkSession, selected: DataFrame, generator: Callable, journal_path: str, request: dict | None = None, exclusive: bool = True
) -> DataFrame:
    """Generate what the journal lacks, publish it as an attempt, return the latest record of each selected page.

    ``request`` has all that generation depends on (model, options). It is kept
    with a digest of the selection; a run with another one is refused. Records
    are written aside and become the attempt by one rename, so readers see whole
    attempts only, and a second run calls the generator for failed pages only.

    An exclusive run holds the journal's lock and raises ``JobLocked`` if another
    does; a lock whose owner has died stays until an operator removes it. Runs
    that aren't exclusive may go on at once: each claims an attempt of its own,
    and the higher one counts where both made a page.
    """
    folder = _Folder(spark, journal_path)
    wanted = json.dumps({"schema": 1, "request": request or {}, "selection": selection_digest(selected)}, sort_keys=True)
    if exclusive and not folder.create("_lock", ""):
        raise JobLocked(f"{journal_path} is locked")
    try:
        if not folder.create("_request.json", wanted) and folder.read("_request.json") != wanted:
            raise RequestChanged("the job was started with another selection or other options")
        number = claim_attempt(folder)
        todo = missing_pages(selected.select("job", "page").distinct(), read_journal(spark, journal_path))
        staged = f"_staged/{number:05d}-{uuid.uuid4().hex}"
        generate(todo.withColumn("attempt", F.lit(number)), generator).drop("attempt").write.parquet(f"{journal_path}/{staged}")
        folder.move(staged, f"attempt={number}")
    finally:
        if exclusive:
            folder.delete("_lock")
    return latest_records(read_journal(spark, journal_path).join(selected.select("job", "page").distinct(), ["job", "page"], "left_semi"))


def job_report(records: DataFrame, n_diagnostics: str = "n_diagnostics") -> DataFrame:
    """Per job: failed with any failed page, blocked with any diagnostic, else complete."""
    failed, noted = F.count_if(F.col("error").isNotNull()), F.count_if(F.col(n_diagnostics) > 0)
    return records.groupBy("job").agg(
        F.count(F.lit(1)).alias("pages"),
        failed.alias("failed_pages"),
        noted.alias("noted_pages"),
        F.when(failed > 0, "failed").when(noted > 0, "blocked").otherwise("complete").alias("status"),
    )
