"""Replays of stored runs: only rows whose inputs have changed are computed again, and runs are checked by what a replay gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.doctags import parse_doctags
from docflow.functions.render import to_markdown
from docflow.operators import score
from docflow.sources.files import stored as written

DIGEST = "input_sha256"


def input_digest(*columns: str, version: str = "") -> Column:
    """SHA-256 of a row's inputs and of the version of the code that reads them; nulls differ from empty texts."""
    return F.sha2(F.to_json(F.struct(F.lit(version).alias("version"), *[F.col(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


def recognise(rows: DataFrame) -> DataFrame:
    """Adds what a run keeps of raw page text: codes, text, markdown, and its scores against the reference."""
    parsed = rows.withColumn("p", parse_doctags(F.col("raw"), F.col("stop_reason")))
    read = parsed.select(
        *rows.columns,
        F.transform("p.diagnostics", lambda x: x["code"]).alias("codes"),
        F.array_join(F.transform("p.elements", lambda e: e["text"]), "\n").alias("text"),
        to_markdown(F.col("p")).alias("markdown"),
        F.size("p.diagnostics").alias("n_diagnostics"),
        F.col("p.fatal_error").alias("error"),
    )
    # read once: the parse is one evaluation per row, and the scores look at it from several sides
    return score.score_cases(written(read)).drop("expected", "n_diagnostics")


def run(inputs: DataFrame, compute: Callable[[DataFrame], DataFrame], payload: list[str], version: str = "") -> DataFrame:
    """A run to keep: the outputs of every row with the digest of its inputs."""
    return compute(inputs.withColumn(DIGEST, input_digest(*payload, version=version)))


def replay(
    stored: DataFrame, inputs: DataFrame, key: list[str], payload: list[str], compute: Callable[[DataFrame], DataFrame], version: str = ""
) -> DataFrame:
    """The run over ``inputs`` with ``replayed``: a stored row is taken over if its key and inputs are as they were.

    Digests meet before anything is parsed, so the cost is that of the changed
    rows and one pass over key and payload. Rows that are no longer among the
    inputs are left out; of stored rows that repeat a key one is taken.
    """
    fresh = inputs.withColumn(DIGEST, input_digest(*payload, version=version))
    on = [*key, DIGEST]
    known = stored.dropDuplicates(on)
    kept = known.join(fresh.select(*on), on, "left_semi").withColumn("replayed", F.lit(False))
    todo = fresh.join(known.select(*on), on, "left_anti")
    done = compute(todo).withColumn("replayed", F.lit(True))
    return kept.unionByName(done.select(*kept.columns))


def audit_run(stored: DataFrame, key: list[str], payload: list[str], compute: Callable[[DataFrame], DataFrame], version: str = "") -> DataFrame:
    """key, differing: what a full recomputation of a stored run's own inputs doesn't give again, by column.

    ``input`` stands for a stored digest that isn't its inputs'. No rows: the run is what it claims to be.
    """
    again = run(stored.select(*key, *payload), compute, payload, version)
    outputs = [c for c in again.columns if c not in {*key, *payload, DIGEST}]
    both = stored.alias("x").join(again.alias("y"), key)
    names = [F.when(~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")), F.lit("input" if c == DIGEST else c)) for c in [DIGEST, *outputs]]
    return both.select(*key, F.array_compact(F.array(*names)).alias("differing")).where(F.size("differing") > 0)


def compare_summaries(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """by, same: whether two summaries have the same row, with null for a row that only one of them has."""
    columns = [c for c in left.columns if c != by]
    rows = lambda df, name: df.select(by, F.struct(*columns).alias(name))
    both = rows(left, "x").join(rows(right, "y"), by, "full_outer")
    return both.select(by, F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.col("x").eqNullSafe(F.col("y"))).alias("same"))


def run_problems(runs: DataFrame, samples: DataFrame, policy: dict, cases: list[str], stages: list[str], total: str) -> DataFrame:
    """run, problems: what keeps a timed run from being compared, in order.

    ``runs``: run and the columns of ``policy``, which must have its values.
    ``samples``: run, case, repeat, tokens (their number), stage, seconds. Every case is there with exactly
    ``policy["repeats"]`` repeats of every stage, seconds are finite and not
    negative, tokens are not empty and the total isn't shorter than its stages.
    """
    parts = [s for s in stages if s != total]
    seconds = F.col("seconds")
    fine = F.coalesce((seconds >= 0) & (seconds < float("inf")), F.lit(False))
    each = samples.groupBy("run", "case", "repeat").agg(
        F.count_if(~fine).alias("bad"), F.count_if(F.coalesce(F.col("tokens") <= 0, F.lit(True))).alias("tokenless"),
        F.array_sort(F.collect_set(F.when(F.col("stage").isin(*stages), F.col("stage")))).alias("stages"), F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("stage") == total, seconds)).alias("whole"), F.sum(F.when(F.col("stage").isin(*parts), seconds)).alias("parts"),
    )
    wanted = F.array(*[F.lit(s) for s in sorted(stages)])
    per_case = each.groupBy("run", "case").agg(
        F.count(F.lit(1)).alias("repeats"), F.sum("bad").alias("bad"), F.sum("tokenless").alias("tokenless"),
        F.bool_and((F.col("stages") == wanted) & (F.col("n") == len(stages))).alias("complete"),
        F.bool_and(F.coalesce(F.col("whole") + 1e-6 >= F.col("parts"), F.lit(False))).alias("long_enough"),
    )
    per_run = per_case.groupBy("run").agg(
        (F.array_sort(F.collect_set("case")) == F.array(*[F.lit(c) for c in sorted(cases)])).alias("cases"),
        F.bool_and((F.col("repeats") == policy["repeats"]) & F.col("complete")).alias("repeats_fine"),
        (F.sum("tokenless") == 0).alias("tokens"), (F.sum("bad") == 0).alias("samples"), F.bool_and("long_enough").alias("totals"),
    )
    same = F.coalesce(F.array(*[F.col(k).eqNullSafe(F.lit(v)) for k, v in policy.items()]), F.array())
    rules = (("policy", F.forall(same, lambda x: x)), ("cases", F.col("cases")), ("tokens", F.col("tokens")), ("repeats", F.col("repeats_fine")), ("samples", F.col("samples")), ("total", F.col("totals")))
    problems = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules]))
    return runs.join(per_run, "run", "left").select("run", problems.alias("problems"))
