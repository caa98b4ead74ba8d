"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements
and one bit per failed rule; policies are versioned masks over those bits, so
changing a policy or measuring what a single rule costs needs no text again.
Only DataFrame functions are used, and no row leaves its task: there is no
shuffle on the main path.

Defined results: a null or empty text has no words and fails ``few_words``;
lines are split at ``\\n`` only; equal rows get equal results each; an empty
table gives an empty table; further input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm.common import need, table

SYMBOL = r"[#*$%&|<>]"

MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_lines",
    "n_dup_lines",
    "n_repeat_words",
    "n_upper",
    "n_letters",
)

#: (rule, SQL condition under which a document fails); the place is the bit.
#: Integer arithmetic only, so that every engine decides alike.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines"),
    ("upper_case", "100 * n_upper > 40 * word_chars"),
    ("few_letters", "100 * n_letters < 50 * word_chars"),
    ("short_words", "2 * word_chars < 5 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
)
BIT = {name: i for i, (name, _) in enumerate(RULES)}

#: Versioned policies: the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(name for name, _ in RULES),
}
POLICY = "v1"


def mask(policy: str) -> int:
    """The bits of a policy."""
    return sum(1 << BIT[name] for name in POLICIES[policy])


def bound(value: Column, then) -> Column:
    """``then(value)`` with the value computed once per row, also inside lambdas."""
    return F.transform(F.array(value), then)[0]


def words_of(text: Column) -> Column:
    """Words between ASCII white space: plain replacements and a split at one character."""
    for blank in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(text, " ", -1), "")


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, all places counted.

    Windows are sorted by their 64-bit hash; equal neighbours are repeats. The
    places of repeated windows, in order, cover three words each less overlaps.
    """

    def windows(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 3)
        hashed = F.transform(
            places,
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
        )
        return F.when(F.size(w) >= 4, bound(F.sort_array(hashed), repeated)).otherwise(F.lit(0))

    def repeated(s: Column) -> Column:
        same = F.filter(
            s,
            lambda x, k: (F.get(s, k + 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k - 1)["h"].eqNullSafe(x["h"])),
        )
        return F.when(
            F.size(same) > 0, bound(F.sort_array(F.transform(same, lambda x: x["i"])), covered)
        ).otherwise(F.lit(0))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda at, k: F.coalesce(F.least(F.get(p, k + 1) - at, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    return bound(words, windows).cast("long")


def _measured(rows: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and the measurements of column ``text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = words_of(text)

    def counted(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"))

    def lined(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        )

    found = rows.select(
        *keep,
        bound(words, counted).alias("by_word"),
        bound(lines, lined).alias("by_line"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace(text, r"\P{L}+", "")).cast("long").alias("n_letters"),
    )
    by = {"n_words": "by_word", "n_repeat_words": "by_word", "n_lines": "by_line", "n_dup_lines": "by_line"}
    return found.select(*keep, *[F.col(f"{by[m]}.{m}" if m in by else m) for m in MEASURES])


def _ledger(rows: DataFrame, *keep: str) -> DataFrame:
    bits = " | ".join(f"(CASE WHEN {fails} THEN {1 << i}L ELSE 0L END)" for i, (_, fails) in enumerate(RULES))
    return _measured(rows, *keep).withColumn("fail_bits", F.expr(bits))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, measurements of the whole text, and ``fail_bits``: bit i is set if rule i fails.

    One row per input row.
    """
    return _ledger(need(docs, doc_id="long", text="string"), "doc_id")


def apply_policy(found: DataFrame, policy: str = POLICY) -> DataFrame:
    """Adds ``policy`` and ``kept``: no rule of the policy fails."""
    return found.withColumns(
        {"policy": F.lit(policy), "kept": F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0}
    )


def ablations(found: DataFrame, policy: str = POLICY) -> DataFrame:
    """Per rule of a policy: rows it fails, and rows only it rejects.

    Rows are first counted by their bits (at most 2 ** rules groups, combined
    before the shuffle); the rules are then read off those groups.
    """
    groups = found.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    own = F.explode(
        F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << BIT[name]).alias("bit")) for name in POLICIES[policy]])
    )
    hit = F.col("fail_bits").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == F.col("r.bit")
    return (
        groups.select("fail_bits", "n", own.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(alone, F.col("n"))), F.lit(0)).alias("n_only_this"),
        )
    )


def reject(docs: DataFrame, policy: str = POLICY) -> DataFrame:
    """The input's rows that the policy keeps, columns unchanged.

    Each row carries its own verdict, so repeated and null ids need no join and
    no text is shuffled.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("whole"), F.col("`text`").cast("string").alias("text"))
    return apply_policy(_ledger(rows, "whole"), policy).where("kept").select("whole.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, base verdict and policy verdict of every document."""
    base = F.col("fail_bits").bitwiseAND(F.lit(mask("base"))) != 0
    return apply_policy(ledger(table(spark, sf_dir, "documents"))).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        "kept",
        "fail_bits",
        "n_lines",
        "n_upper",
        "n_letters",
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT row_id, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
g AS (
  SELECT row_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
g3 AS (
  SELECT row_id, i, count(*) OVER (PARTITION BY row_id, words[i], words[i + 1], words[i + 2]) AS n FROM g),
rep AS (
  SELECT row_id, count(DISTINCT i + k) AS n_repeat_words
  FROM g3, (VALUES (0), (1), (2)) AS t(k) WHERE n > 1 GROUP BY row_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(text, '\P{Lu}+', '', 'g'))::BIGINT AS n_upper,
         length(regexp_replace(text, '\P{L}+', '', 'g'))::BIGINT AS n_letters
  FROM w LEFT JOIN rep USING (row_id)),
b AS (
  SELECT *, (@bits)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & @base) <> 0 AS base_failed, (fail_bits & @policy) = 0 AS kept,
       fail_bits, n_lines, n_upper, n_letters
FROM b
"""
for _name, _value in (
    ("@bits", " + ".join(f"CASE WHEN {fails} THEN {1 << i} ELSE 0 END" for i, (_, fails) in enumerate(RULES))),
    ("@base", mask("base")),
    ("@policy", mask(POLICY)),
):
    ORACLE_SQL = ORACLE_SQL.replace(_name, str(_value))
