"""Conversation structure repair by signature deduplication.

A conversation's rows are encoded as one letter a row (role and fault), so its
structure is a short string. Conversations share few such signatures: each
distinct one is solved once, by a memoised recursion from its end; the cheapest
script is joined back to every conversation that has the signature and replayed
on its rows.

Letters: ``d`` a row that must go (blank or a copy of an earlier row), else the
role's initial ``s``, ``u``, ``a`` or ``x`` for any other, upper-case where the
text is truncated. A script has one letter per edit, in order: ``k`` keep, ``d``
delete, ``u`` / ``a`` rerole, ``U`` / ``A`` insert an empty turn; the audit is
the script with ``K``, ``D``, ``R``, ``I`` instead.

Rows are numbered and duplicates are found by windows over one conversation,
which spill; texts move to the replay by (conversation, row), so that a long
conversation is dealt out again. The hash of a repaired conversation is taken
over a sorted stream and holds one batch of rows. Signature and script are one
value per conversation, one letter a row.

Defined results: null roles and texts are one space; a null turn comes first;
rows of one turn follow by role and text; a null conversation id is one
conversation of its own; a conversation without rows has zeros, an empty audit
and the hash of the empty string; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docflow.llm.common import crc32_sql, durable, need, table
from docflow.llm.streams import EMPTY_SHA256, sha256_by_key

BLANKS = " \t\n\x0b\x0c\r"
#: Costs of the edits, and of leaving a truncated row in.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Grammar ``(s?(ua)+)?``: state 0 nothing yet, 1 after s, 2 after u, 3 after a.
#: The role that an inserted or reroled turn must have, and the state after it.
NEXT = (("u", 2), ("u", 2), ("a", 3), ("u", 2))


@lru_cache(maxsize=None)
def _best(letter: str, after: tuple[int, ...]) -> tuple[tuple[tuple[str, int], ...], tuple[int, ...], int]:
    """One row: per state what is written up to this row and the state after it.

    ``after`` has the costs of the rest per state, less the smallest, so there
    are few different ones. Also returned: the costs from here on, less their
    smallest, and that. An empty letter stands for the end of the conversation.
    """
    rows = []
    for state, (role, to) in enumerate(NEXT):
        if not letter:
            rows.append((0, "", "", 0) if state in (0, 3) else None)
            continue
        extra = TRUNCATED * letter.isupper()
        options = [(DELETE + after[state], "D", "d", state)]
        if letter != "d":
            options.append((REROLE + extra + after[to], "R", role, to))
            if letter.lower() == role:
                options.append((extra + after[to], "K", "k", to))
            elif letter.lower() == "s" and state == 0:
                options.append((extra + after[1], "K", "k", 1))
        rows.append(min(options))
    costs, written = [], []
    for state in range(4):
        options, at, prefix = [], state, ""
        for inserted in range(3):  # a third insertion comes back to a state that was there before
            if rows[at] is not None:
                cost, audit, out, to = rows[at]
                options.append((INSERT * inserted + cost, "I" * inserted + audit, prefix + out, to))
            prefix += NEXT[at][0].upper()
            at = NEXT[at][1]
        cost, _, out, to = min(options)
        costs.append(cost)
        written.append((out, to))
    least = min(costs)
    return tuple(written), tuple(c - least for c in costs), least


def solve(signature: str) -> tuple[int, str]:
    """Cost and script of the cheapest repair; of equal costs the audit that is ASCII-least.

    The recursion goes from each row to the rest behind it. It is evaluated from
    the end, as a conversation may be longer than Python's stack is deep.
    """
    written, costs, total = _best("", (0, 0, 0, 0))
    steps = [written]
    for letter in reversed(signature):
        written, costs, least = _best(letter, costs)
        steps.append(written)
        total += least
    out, state = [], 0
    for written in reversed(steps):
        text, state = written[state]
        out.append(text)
    return total + costs[0], "".join(out)


def _solved(signatures: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([solve(x) for x in signatures], columns=["cost", "script"])


def _rows(turns: DataFrame) -> DataFrame:
    """conv (the id as text, empty for null), turn, role, text: no nulls but in turn."""
    rows = need(turns, conv_id="long", turn="long", role="string", text="string")
    return rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "turn",
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )


def damage(rows: DataFrame) -> DataFrame:
    """The rows of ``_rows`` damaged by the CRC of conversation and turn: dropped, emptied, stripped, repeated, reroled."""
    name = F.concat(F.when(F.col("conv") == "", " ").otherwise(F.col("conv")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(name.cast("binary")) % 20
    return rows.withColumn("damage", kind).where("damage <> 0").select(
        "conv", "turn",
        F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(0), (F.col("damage") == 3).cast("int"))).alias("copy"),
    ).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """Rows with pos (from 1), fault (blank, duplicate, truncated or null), letter, fresh turn and illegal pair."""
    by = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    same = Window.partitionBy("conv", "role", F.md5("text")).orderBy("pos")
    initial = F.substring("role", 1, 1)
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    before, last_turn = F.lag(initial).over(by), F.lag("turn").over(by)
    seen = rows.select(
        "*",
        F.row_number().over(by).alias("pos"),
        (before.isNotNull() & ~F.concat(before, initial).isin("su", "ua", "au")).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(last_turn)).alias("fresh"),
    ).withColumn("copy", F.row_number().over(same) > 1)
    fault = (
        F.when(bare == "", "blank").when(F.col("copy"), "duplicate")
        .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    )
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return seen.withColumn("fault", fault).select(
        "conv", "pos", "turn", "role", "text", "illegal", "fresh", "fault",
        F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(role)).otherwise(role).alias("letter"),
    )


def signatures(found: DataFrame) -> DataFrame:
    """Per conversation its counts and its signature."""
    letters = F.array_sort(F.collect_list(F.struct("pos", "letter")))
    count = lambda what: F.sum(what.cast("long"))
    return found.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - count(F.col("fresh")), F.lit(0).cast("long")).alias("gaps"),
        *[count(F.coalesce(F.col("fault") == x, F.lit(False))).alias(x) for x in ("blank", "duplicate", "truncated")],
        count(F.col("illegal")).alias("illegal"),
        F.array_join(F.transform(letters, lambda x: x["letter"]), "").alias("signature"),
    )


def solved(convs: DataFrame) -> DataFrame:
    """``signatures`` with cost, script and audit: each distinct signature is solved once."""
    each = convs.select("signature").distinct().withColumn("x", F.pandas_udf(_solved, "cost long, script string")("signature"))
    each = each.select("signature", "x.cost", "x.script", F.translate("x.script", "kduaUA", "KDRRII").alias("audit"))
    return convs.join(each, "signature")


def replay(found: DataFrame, scripts: DataFrame) -> DataFrame:
    """key (conversation), at, piece: the repaired lines that stand at a row, joined by newlines."""

    def inserted(x):
        return F.replace(F.replace(x, F.lit("U"), F.lit("\nuser:")), F.lit("A"), F.lit("\nassistant:"))

    edits = scripts.select("conv", F.posexplode(F.regexp_extract_all("script", F.lit("[UA]*[kdua]"), F.lit(0))).alias("at", "edit"))
    edits = edits.select("conv", (F.col("at") + 1).alias("pos"), F.rtrim("edit", F.lit("kdua")).alias("before"), F.right("edit", F.lit(1)).alias("edit"))
    role = F.when(F.col("edit") == "u", "user").when(F.col("edit") == "a", "assistant").otherwise(F.col("role"))
    line = F.when(F.col("edit") == "d", "").otherwise(F.concat(F.lit("\n"), role, F.lit(":"), "text"))
    rows = found.join(edits, ["conv", "pos"]).select("conv", "pos", F.concat(inserted(F.col("before")), line).alias("piece"))
    end = F.regexp_extract("script", "([UA]*)$", 1)
    ends = scripts.select("conv", (F.length("signature") + 1).alias("pos"), inserted(end).alias("piece"))
    pieces = rows.unionByName(ends).where("piece <> ''")
    return pieces.select(F.col("conv").alias("key"), F.col("pos").alias("at"), F.substring("piece", 2, 2**31 - 1).alias("piece"))


def repair(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (conv, turn, role, text without nulls but in turn) its faults, audit and repaired hash."""
    found = durable(faults(rows))
    convs = durable(solved(signatures(found)))
    hashes = sha256_by_key(replay(found, convs), "\n").select(F.col("key").alias("conv"), F.col("sha256").alias("repaired_sha256"))
    return convs.join(hashes, "conv", "left").withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)))


def repair_damaged(turns: DataFrame) -> DataFrame:
    """The damaged conversations repaired: a row for every conversation id of the table."""
    rows = _rows(turns)
    done = repair(damage(rows))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return rows.select("conv").distinct().join(done, "conv", "left").select(
        F.expr("try_cast(conv AS BIGINT)").alias("conv_id"),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"),
        F.coalesce("signature", F.lit("")).alias("signature"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged by rule, and repaired."""
    return repair_damaged(table(spark, sf_dir, "conversations"))


def _oracle() -> str:
    """The recursion over every distinct signature from its end, a list of (cost, audit, script) per state."""

    def edit(cost, audit, script, rest):
        return f"{{'c': {cost} + {rest}.c, 'a': '{audit}' || {rest}.a, 'p': '{script}' || {rest}.p}}"

    extra = f"(CASE WHEN l IN ('S', 'U', 'A', 'X') THEN {TRUNCATED} ELSE 0 END)"
    rows, kept = [], []
    for state, (role, to) in enumerate(NEXT):
        options = [edit(DELETE, "D", "d", f"f[{state + 1}]")]
        free = f"CASE WHEN l <> 'd' THEN {edit(f'{REROLE} + {extra}', 'R', role, f'f[{to + 1}]')} END"
        keeps = [f"CASE WHEN lower(l) = '{role}' THEN {edit(extra, 'K', 'k', f'f[{to + 1}]')} END"]
        if state == 0:
            keeps.append(f"CASE WHEN lower(l) = 's' THEN {edit(extra, 'K', 'k', 'f[2]')} END")
        rows.append(f"list_min([{', '.join([*options, free, *keeps])}])")
    for state in range(4):
        at, options, script = state, [], ""
        for k in range(3):
            options.append(edit(INSERT * k, "I" * k, script, f"b[{at + 1}]"))
            script += NEXT[at][0].upper()
            at = NEXT[at][1]
        kept.append(f"list_min([{', '.join(options)}])")
    end = "[{'c': 0, 'a': '', 'p': ''}, {'c': 6, 'a': 'II', 'p': 'UA'}, {'c': 3, 'a': 'I', 'p': 'A'}, {'c': 0, 'a': '', 'p': ''}]"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    name = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    return f"""
WITH RECURSIVE
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {name} AS name FROM conversations),
hit AS (SELECT *, {crc32_sql("name")} % 20 AS k FROM named),
damaged AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE k WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hit WHERE k <> 0),
numbered AS (
  SELECT *, row_number() OVER w AS pos, lag(role[1]) OVER w || role[1] AS pair, rtrim(text, {blanks}) AS bare
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
judged AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS r
  FROM numbered),
convs AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
         string_agg(CASE fault WHEN 'truncated' THEN upper(r) WHEN '' THEN r ELSE 'd' END, '' ORDER BY pos) AS signature
  FROM judged GROUP BY conv_id),
solved AS (
  SELECT DISTINCT signature, length(signature) AS i, {end} AS f FROM convs
  UNION ALL
  SELECT signature, i - 1, [{", ".join(kept)}]
  FROM (SELECT signature, i, [{", ".join(rows)}] AS b FROM (SELECT signature, i, f, signature[i] AS l FROM solved WHERE i > 0))),
scripts AS (SELECT conv_id, f[1].c AS cost, f[1].a AS audit, f[1].p AS script FROM convs JOIN solved USING (signature) WHERE i = 0),
edits AS (
  SELECT conv_id, unnest(regexp_extract_all(script || '$', '[UA]*[kdua$]')) AS edit,
         generate_subscripts(regexp_extract_all(script || '$', '[UA]*[kdua$]'), 1) AS pos FROM scripts),
pieces AS (
  SELECT e.conv_id, e.pos,
         list_transform(regexp_extract_all(edit, '[UA]'), lambda x: CASE x WHEN 'U' THEN 'user:' ELSE 'assistant:' END)
         || CASE right(edit, 1) WHEN 'k' THEN [role || ':' || text] WHEN 'u' THEN ['user:' || text] WHEN 'a' THEN ['assistant:' || text] ELSE [] END AS lines
  FROM edits e LEFT JOIN judged j ON e.conv_id IS NOT DISTINCT FROM j.conv_id AND e.pos = j.pos),
repaired AS (
  SELECT conv_id, sha256(coalesce(string_agg(array_to_string(lines, chr(10)), chr(10) ORDER BY pos) FILTER (len(lines) > 0), '')) AS h
  FROM pieces GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, coalesce(h, '{EMPTY_SHA256}') AS repaired_sha256, coalesce(signature, '') AS signature
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN convs c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN scripts s ON o.conv_id IS NOT DISTINCT FROM s.conv_id
LEFT JOIN repaired r ON o.conv_id IS NOT DISTINCT FROM r.conv_id
"""


ORACLE_SQL = _oracle()
