"""Registered queries of replayed runs, streams, timed runs and growing components, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docflow.operators import build, corpus, graph, replay, score
from docflow.operators.jobs import RECORD
from docflow.plans.catalogue import _WS, _table, query
from docflow.sources.files import shared_folder, stored
from docflow.streaming import journal

# ---------------------------------------------------------- stored runs

KEY, PAYLOAD = ["conv_id", "turn"], ["raw", "stop_reason", "reference"]


def _pages(spark, d):
    """Turns as recognised pages, with themselves as the reference; every 11th was cut short."""
    return _table(spark, d, "conversations").select(
        "conv_id", "turn", "role", build.text_page(F.col("text")).alias("raw"),
        F.when((F.col("conv_id") + F.col("turn")) % 11 == 0, "length").otherwise("eos").alias("stop_reason"), F.col("text").alias("reference"),
    )


def _changed(pages):
    """Later inputs: every fifth turn has its letter e in capitals, every 13th conversation is gone."""
    louder = F.when(F.col("turn") % 5 == 1, build.text_page(F.replace("reference", F.lit("e"), F.lit("E")))).otherwise(F.col("raw"))
    return pages.where("conv_id % 13 <> 12").withColumn("raw", louder)


def _kept(spark, d):
    return stored(replay.run(_pages(spark, d).drop("role"), replay.recognise, PAYLOAD, "1"))


_TURNS = f"""
t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, CASE WHEN turn % 5 = 1 THEN replace(coalesce(text, ''), 'e', 'E') ELSE coalesce(text, '') END AS later, (conv_id + turn) % 11 = 0 AS cut FROM conversations),
l AS (SELECT *, array_to_string(list_filter(string_split(later, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\r\\f]')), chr(10)) AS shown FROM t)"""


@query(
    f"""WITH {_TURNS} SELECT conv_id, turn, later <> text AS replayed, md5(shown) AS text_md5, CASE WHEN cut THEN 'generation-truncated' ELSE '' END AS codes FROM l WHERE conv_id % 13 <> 12"""
)
def q_replay_run(spark, d):
    """The stored run taken over to later inputs: pages whose digests are new are parsed, rendered and scored again."""
    inputs = _changed(_pages(spark, d)).drop("role")
    done = replay.replay(_kept(spark, d), inputs, KEY, PAYLOAD, replay.recognise, "1")
    return done.select("conv_id", "turn", "replayed", F.md5("text").alias("text_md5"), F.array_join("codes", ",").alias("codes"))


@query(
    """SELECT conv_id, turn, CASE conv_id % 9 WHEN 3 THEN 'markdown' WHEN 4 THEN 'input' WHEN 5 THEN 'character_edits,accepted' END AS differing FROM conversations
    WHERE (conv_id % 9 = 4) OR (conv_id % 9 IN (3, 5) AND (conv_id + turn) % 11 <> 0)"""
)
def q_audit_run(spark, d):
    """A stored run in which markdown, digests and scores were tampered with, against its own recomputation."""
    turn, whole = F.col("conv_id") % 9, (F.col("conv_id") + F.col("turn")) % 11 != 0
    told = _kept(spark, d).withColumns({
        "markdown": F.when((turn == 3) & whole, F.concat("markdown", F.lit("."))).otherwise(F.col("markdown")),
        replay.DIGEST: F.when(turn == 4, F.reverse(replay.DIGEST)).otherwise(F.col(replay.DIGEST)),
        "character_edits": F.when((turn == 5) & whole, F.col("character_edits") + 1).otherwise(F.col("character_edits")),
        "accepted": F.when((turn == 5) & whole, ~F.col("accepted")).otherwise(F.col("accepted")),
    })
    found = replay.audit_run(told, KEY, PAYLOAD, replay.recognise, "1")
    return found.select("conv_id", "turn", F.array_join("differing", ",").alias("differing"))


@query(
    f"""WITH {_TURNS}, s AS (SELECT role, bool_or(later <> text AND NOT cut AND conv_id % 13 <> 12) AS louder, bool_or(conv_id % 13 = 12) AS fewer FROM l GROUP BY role)
    SELECT role AS split, NOT louder AND NOT fewer AS same FROM s"""
)
def q_replay_summary(spark, d):
    """Summaries by role of the stored run and of its replay on later inputs: no role's totals stay if one of its pages has changed."""
    roles = _pages(spark, d).select("conv_id", "turn", F.col("role").alias("split"))
    kept = _kept(spark, d)
    done = replay.replay(kept, _changed(_pages(spark, d)).drop("role"), KEY, PAYLOAD, replay.recognise, "1")
    before, after = (score.summarize(x.withColumn("expected", corpus.normalized(F.col("reference"))).join(roles, KEY)) for x in (kept, done))
    return replay.compare_summaries(before, after, "split")


# ------------------------------------------------------------- timed runs

_STAGES = ("preprocess", "vision", "decode", "generation")


@query(
    """WITH r AS (SELECT DISTINCT user_id AS run FROM events WHERE user_id < 400)
    SELECT run, CASE run % 8 WHEN 1 THEN 'policy' WHEN 2 THEN 'cases' WHEN 3 THEN 'tokens' WHEN 4 THEN 'repeats' WHEN 5 THEN 'samples,total' WHEN 6 THEN 'total' WHEN 7 THEN 'repeats' ELSE '' END AS problems FROM r"""
)
def q_run_problems(spark, d):
    """Timed runs of two cases: by turn sound, another policy, a case too few, no tokens, four repeats, a negative time, a short total, a missing stage."""
    runs = _table(spark, d, "events").where("user_id < 400").groupBy(F.col("user_id").alias("run")).agg(F.max("value").alias("top"))
    turn = F.col("run") % 8
    kinds = runs.select("run", F.when(turn == 1, "float16").otherwise("float32").alias("dtype"), F.lit(3).alias("repeats"))
    many = F.when(turn == 4, 4).otherwise(3)
    rows = runs.select(
        "run", "top", F.explode(F.when(turn == 2, F.array(F.lit("grid"))).otherwise(F.array(F.lit("grid"), F.lit("page")))).alias("case"), many.alias("many")
    ).select("run", "top", "case", F.explode(F.sequence(F.lit(1), "many")).alias("repeat"))
    rows = rows.select("*", F.explode(F.array(*[F.lit(s) for s in _STAGES])).alias("stage")).where(~((turn == 7) & (F.col("stage") == "vision") & (F.col("repeat") == 2)))
    each = F.abs(F.col("top")) + 1
    seconds = F.when(F.col("stage") != "generation", each).when((turn == 6) & (F.col("case") == "page"), each * 2).otherwise(each * 3)
    seconds = F.when((turn == 5) & (F.col("stage") == "generation") & (F.col("repeat") == 1), -seconds).otherwise(seconds)
    rows = rows.withColumns({"seconds": seconds, "tokens": F.when(turn == 3, 0).otherwise(7)})
    found = replay.run_problems(kinds, rows, {"dtype": "float32", "repeats": 3}, ["grid", "page"], list(_STAGES), "generation")
    return found.select("run", F.array_join("problems", ",").alias("problems"))


# --------------------------------------------------- components that grow


@query(
    f"""WITH RECURSIVE c AS (SELECT doc_id AS id, source || lang || (doc_id // 40) AS shelf, sha256(trim(regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g'), ' ')) AS content FROM documents),
    k AS (SELECT id, 's:' || shelf AS v FROM c UNION ALL SELECT id, 'c:' || content FROM c),
    hub AS (SELECT v, min(id) AS h FROM k GROUP BY v), e AS (SELECT DISTINCT id AS x, h AS y FROM k JOIN hub USING (v)),
    b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
    r AS (SELECT id AS x, id AS y FROM c UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x)
    SELECT x AS doc_id, min(y) AS component FROM r GROUP BY x"""
)
def q_growing_components(spark, d):
    """Components by shelf and content, of nine tenths of the documents first, and then with the others added."""
    rows = stored(_table(spark, d, "documents").select(
        "doc_id", F.concat("source", "lang", F.floor(F.col("doc_id") / 40).cast("string")).alias("shelf"), corpus.fingerprint(F.coalesce("text", F.lit(""))).alias("content")
    ))
    old, new = rows.where("doc_id % 10 <> 7"), rows.where("doc_id % 10 = 7")
    found = graph.shared_keys(old, "doc_id", "shelf", "content")
    linked = graph.components(found.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    labels = old.select(F.col("doc_id").alias("node")).join(linked, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    labels = stored(labels)
    index = stored(graph.key_index(old, labels, "doc_id", "shelf", "content"))
    after, _ = graph.extend(labels, index, new, "doc_id", "shelf", "content")
    return after.select(F.col("node").alias("doc_id"), F.col("label").alias("component"))


# ------------------------------------------------------------------- stream


@query(
    """SELECT conv_id::VARCHAR AS job, turn AS page, CASE WHEN conv_id % 3 = 1 THEN 2 ELSE 1 END AS attempt,
    CASE WHEN conv_id % 3 = 2 THEN NULL WHEN conv_id % 3 = 1 THEN 'again ' || role || chr(10) ELSE 'first ' || role || chr(10) END AS markdown,
    CASE WHEN conv_id % 3 = 2 THEN 'timeout' END AS error FROM conversations"""
)
def q_stream_pages(spark, d):
    """Records of two attempts come as two publications of a journal: good at once, failed and then good, failed for good."""
    turn = F.col("conv_id") % 3
    at = f"{shared_folder(spark)}/journal-{uuid.uuid4().hex}"
    for attempt, word in ((1, "first"), (2, "again")):
        failed = (turn == 2) | ((turn == 1) & (attempt == 1))
        rows = _table(spark, d, "conversations").where(F.lit(attempt == 1) | (turn == 1)).select(
            F.col("conv_id").cast("string").alias("job"), F.col("turn").alias("page"), F.lit(attempt).alias("attempt"),
            F.when(~failed, build.page(build.leaf("text", F.concat_ws(" ", F.lit(word), "role")))).alias("raw"), F.array(F.lit(1).cast("long")).alias("token_ids"),
            F.when(~failed, "eos").alias("stop_reason"), F.when(failed, "timeout").alias("error"),
        )
        rows.select(*[c.split()[0] for c in RECORD.split(", ")]).drop("attempt").write.parquet(f"{at}/journal/attempt={attempt}")
        journal.start(spark, f"{at}/journal", f"{at}/pages", f"{at}/marks").awaitTermination()
    return journal.pages(spark, f"{at}/pages").select("job", "page", "attempt", "markdown", "error")
