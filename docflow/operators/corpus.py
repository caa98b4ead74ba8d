"""Corpus audit: fingerprints, label inspection, duplicate components, preflight, isolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions import strictjson
from docflow.functions.bound import bound
from docflow.operators.graph import components, shared_keys

#: White space as Unicode-aware string splitting has it.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
PAGE_ID = r"\A(doc_[0-9a-f]{40})_p([0-9]{5,})\z"


def normalized(text: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, SPACE, " "), r"\A | \z", "")


def fingerprint(raw: Column) -> Column:
    """SHA-256 of the content without locations and spacing."""
    return F.sha2(normalized(F.regexp_replace(raw, "<loc_[0-9]+>", "")), 256)


def page_digits(page: Column) -> Column:
    """A page's number as ids have it: five digits at least, and never cut."""
    digits = page.cast("string")
    return F.lpad(digits, F.greatest(F.lit(5), F.length(digits)), F.lit("0"))


def page_identity(identifier: Column) -> Column:
    """struct(source_id, page) of a page's id, null for any other text. Pages beyond 38 digits are no ids."""
    page = F.regexp_extract(identifier, PAGE_ID, 2).try_cast("decimal(38,0)")
    return F.when(
        identifier.rlike(PAGE_ID) & page.isNotNull(),
        F.struct(F.regexp_extract(identifier, PAGE_ID, 1).alias("source_id"), page.alias("page")),
    )


def inspect_label(raw: Column) -> Column:
    """Digest, length, locations (count, largest, out of range) and other tags of a label, opening and closing.

    Locations may have any number of digits; the largest is null beyond 38 of them.
    """
    found = F.regexp_extract_all(raw, F.lit("<loc_([0-9]+)>"), F.lit(1))
    numbers = F.transform(found, lambda x: F.ltrim(x, F.lit("0")))
    largest = F.array_max(F.transform(numbers, lambda x: F.struct(F.length(x).alias("n"), x.alias("digits"))))
    value = F.when(largest["n"] == 0, "0").otherwise(largest["digits"]).try_cast("decimal(38,0)")
    tags = F.regexp_extract_all(raw, F.lit(r"</?([^<>]+)>"), F.lit(1))
    return F.struct(
        F.sha2(raw, 256).alias("sha256"),
        F.length(raw).alias("characters"),
        F.size(numbers).alias("locations"),
        value.alias("largest_location"),
        F.size(F.filter(numbers, lambda x: (F.length(x) > 3) | (x.try_cast("int") >= 500))).alias("out_of_range"),
        F.array_sort(F.array_distinct(F.filter(tags, lambda t: ~t.startswith("loc_")))).alias("tags"),
    )


def safe_relative(name: Column) -> Column:
    """A bounded relative path that stays beneath its root; empty and ``.`` parts don't count, ``..`` is refused."""
    parts = F.split(name, "/", -1)
    fine = F.length(name).between(1, 240) & ~F.startswith(name, F.lit("/")) & ~F.array_contains(parts, "..")
    return F.coalesce(fine, F.lit(False))


#: The fields of a selection seal and the kinds of their values, fixed.
SEAL_FIELDS = {
    "schema_version": "integer",
    "status": "string",
    "selection_criterion": "string",
    "final_content_opened": "boolean",
    "workflow_sha256": "string",
    "selection_protocol_sha256": "string",
    "selection_report": "string",
    "selection_report_sha256": "string",
    "selected_id": "string",
    "selected_kind": "string",
    "selected_files": "object",
    "final_cases": "array",
    "development_evidence": "object",
    "source_revision": "string",
}
#: Per problem the fields it looks at and what must hold of their values.
SEAL_RULES = (
    ("schema", ("schema_version",), lambda v, _: v == 1),
    ("status", ("status", "selection_criterion"), lambda v, w, _: (v == "selection-sealed") & (w == "validation-only")),
    ("final opened", ("final_content_opened",), lambda v, _: ~v),
    ("workflow", ("workflow_sha256",), lambda v, policy: v == policy["workflow_sha256"]),
    ("protocol", ("selection_protocol_sha256",), lambda v, policy: v == policy["selection_protocol_sha256"]),
    ("revision", ("source_revision",), lambda v, _: v.rlike(r"\A[0-9a-f]{40}\z")),
    ("identity", ("selected_id",), lambda v, _: v != ""),
    ("final cases", ("final_cases",), lambda v, policy: v == strictjson.canonical(strictjson.parsed(policy["final_cases"]))),
    ("evidence", ("development_evidence",), lambda v, policy: v == strictjson.canonical(strictjson.parsed(policy["development_evidence"]))),
    ("report path", ("selection_report",), lambda v, _: safe_relative(v)),
    ("kind", ("selected_kind", "selected_files"), lambda v, files, _: v.isin("base", "adapter") & files.isNotNull()),
    ("payload", ("selected_kind", "selected_files"), lambda v, files, _: (v == "base") == (files == "{}")),
)


def seal_problems(seal: Column, policy: Column) -> Column:
    """What keeps a seal from being accepted, in order; an empty array for a good one.

    ``seal`` is JSON text, read strictly: repeated keys, text behind the value
    and values of another kind than ``SEAL_FIELDS`` has are problems, the order of
    keys isn't. ``policy``: struct of workflow_sha256, selection_protocol_sha256,
    final_cases and development_evidence (JSON text of what it must hold).
    """
    return bound(strictjson.parsed(seal), lambda whole: bound(_seal_values(whole), lambda found: _seal_problems(whole, found, policy)))


def _seal_values(whole: Column) -> Column:
    """A seal's fields as a struct: null where the kind isn't the one of ``SEAL_FIELDS``, arrays and objects as canonical text."""

    def values(found):
        own = lambda n, kind: strictjson.exactly(found[n], kind) if kind not in ("array", "object") else F.when(strictjson.is_kind(found[n], kind), strictjson.canonical(found[n]))
        files = F.map_entries(strictjson.fields(found["selected_files"]))
        return F.struct(*[own(n, kind).alias(n) for n, kind in SEAL_FIELDS.items()], files.alias("files"))

    return bound(strictjson.record(whole, SEAL_FIELDS), values)


def _seal_problems(whole: Column, found: Column, policy: Column) -> Column:
    keys = F.coalesce(F.map_keys(strictjson.fields(whole)), F.array().cast("array<string>"))
    yes = lambda c: F.coalesce(c, F.lit(False))

    problems = [F.when(~yes(F.array_sort(keys) == F.array(*[F.lit(k) for k in sorted(SEAL_FIELDS)])), "fields")]
    problems += [F.when(~yes(rule(*[found[x] for x in names], policy)), name) for name, names, rule in SEAL_RULES]
    digests = F.forall(found["files"], lambda e: yes(safe_relative(e["key"]) & strictjson.exactly(e["value"], "string").rlike(r"\A[0-9a-f]{64}\z")))
    return F.array_compact(F.array(*problems, F.when(~yes(digests), "digests")))


GROUND_TRUTH = (
    "texts array<struct<text:string>>, tables array<struct<data:struct<num_rows:int,num_cols:int,"
    "table_cells:array<struct<start_row_offset_idx:int,start_col_offset_idx:int,row_span:int,col_span:int,text:string>>>>>"
)


def ground_truth(document: Column) -> Column:
    """A nested ground-truth document (JSON text) as struct(text, tables), null where it's no such document.

    tables: array of rows, columns and cells (r, c, rs, cs, text), in order.
    """
    parsed = F.from_json(document, GROUND_TRUTH)
    cell = lambda x: F.struct(
        x["start_row_offset_idx"].alias("r"), x["start_col_offset_idx"].alias("c"),
        x["row_span"].alias("rs"), x["col_span"].alias("cs"), x["text"].alias("text"),
    )
    tables = F.transform(
        F.coalesce(parsed["tables"], F.array().cast("array<struct<data:struct<num_rows:int,num_cols:int,table_cells:array<struct<start_row_offset_idx:int,start_col_offset_idx:int,row_span:int,col_span:int,text:string>>>>>")),
        lambda t: F.struct(
            t["data"]["num_rows"].alias("rows"), t["data"]["num_cols"].alias("columns"), F.transform(t["data"]["table_cells"], cell).alias("cells")
        ),
    )
    return F.when(parsed["texts"].isNotNull(), F.struct(F.array_join(F.transform(parsed["texts"], lambda x: x["text"]), "\n\n").alias("text"), tables.alias("tables")))


def source_id(url: Column) -> Column:
    return F.concat(F.lit("doc_"), F.sha1(url))


def reviewed_source(r: Column) -> Column:
    """Four filled-in texts of at most 2000 characters, web addresses with hosts, both flags strictly true."""
    fields = ("original_source_url", "license_url", "reviewer", "decision_note")
    filled = F.lit(True)
    for name in fields:
        filled = filled & (F.length(normalized(r[name])) > 0) & (F.length(r[name]) <= 2000)
    web = r["original_source_url"].rlike(r"\Ahttps?://[^/?#\s]+") & r["license_url"].rlike(r"\Ahttps?://[^/?#\s]+")
    return F.coalesce(filled & web & r["training_approved"] & r["privacy_cleared"], F.lit(False))


def first_rows(rows: DataFrame, position: str, count: int) -> DataFrame:
    """The first rows in stored order; the order is a column, as Spark keeps none."""
    return rows.orderBy(position).limit(count)


def evaluate_candidates(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Reasons against each candidate page, none dropped: adds component, reasons, eligible.

    pages: id, source_id, split, image, target, content, renderable, approved_target.
    sources: source_id, allowed, reviewed, quarantined, development (one row per source).
    """
    shared = shared_keys(pages, "id", "source_id", "image", "target", "content")
    labels = components(shared.select(F.col("hub").alias("a"), F.col("node").alias("b")))
    twice = shared.where("key <> 'source_id'").select(F.col("node").alias("id"), F.lit(True).alias("twice")).distinct()
    rows = (
        pages.join(labels.withColumnsRenamed({"node": "id", "label": "component"}), "id", "left")
        .join(twice, "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
        .join(sources, "source_id", "left")
    )
    whole = rows.groupBy("component").agg(
        (F.min("split") != F.max("split")).alias("crosses"),
        F.bool_or(F.coalesce("quarantined", F.lit(False))).alias("q"),
        F.bool_or(F.coalesce("development", F.lit(False))).alias("d"),
    )
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(yes("quarantined"), "quarantined-source").when(F.col("q"), "quarantined-component"),
            F.when(~yes("allowed"), "source-not-approved"),
            F.when(~yes("reviewed"), "source-review-incomplete"),
            F.when(~F.col("approved_target").eqNullSafe(F.col("target")), "target-not-reviewed"),
            F.when(~F.col("renderable"), "native-target-rejected"),
            F.when(F.col("crosses"), "cross-split-component"),
            F.when(F.col("d") & (F.col("split") == "final"), "development-source-in-final"),
            F.when(yes("twice"), "duplicate-page"),
        )
    )
    judged = rows.join(whole, "component").withColumn("reasons", reasons)
    return judged.withColumn("eligible", F.size("reasons") == 0)


def reason_counts(judged: DataFrame) -> DataFrame:
    return judged.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def isolation(train: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """(key, value) that both sets share, and those that repeat within train: none means isolated."""
    found = None
    for k in keys:
        shared = train.select(F.col(k).alias("value")).where("value IS NOT NULL").distinct()
        shared = shared.join(other.select(F.col(k).alias("value")), "value", "left_semi")
        part = shared.select(F.lit(k).alias("key"), "value", F.lit("shared").alias("problem"))
        twice = train.groupBy(F.col(k).alias("value")).count().where("count > 1 AND value IS NOT NULL")
        part = part.unionByName(twice.select(F.lit(k).alias("key"), "value", F.lit("repeated").alias("problem")))
        found = part if found is None else found.unionByName(part)
    return found


def manifest_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, state): missing, extra, changed or same, from (name, sha256) inventories."""
    both = left.select("name", F.col("sha256").alias("x")).join(right.select("name", F.col("sha256").alias("y")), "name", "full_outer")
    state = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").when(F.col("x") != F.col("y"), "changed").otherwise("same")
    return both.select("name", state.alias("state"))


def take_per(rows: DataFrame, key: str, order: str, count: int) -> DataFrame:
    """The first rows of each key; ties by the whole order column only."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("rank") <= count)


def assign_splits(rows: DataFrame, lock: DataFrame) -> DataFrame:
    """rows (url, page, ...) with the split that ``lock`` (url, page, split) fixes; problem names what's wrong.

    The fixed list is complete: a row outside it, a listed page without a row and a repeated page are problems.
    """
    both = rows.join(lock.select("url", "page", "split", F.lit(True).alias("locked")), ["url", "page"], "full_outer")
    seen = rows.select("url", "page", F.lit(True).alias("present")).groupBy("url", "page").agg(F.count("present").alias("n"))
    problem = F.when(F.col("locked").isNull(), "not listed").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    named = F.concat(source_id(F.col("url")), F.lit("_p"), page_digits(F.col("page")))
    return both.join(seen, ["url", "page"], "left").withColumns({"problem": problem, "id": named}).drop("locked", "n")


def withhold(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """Answers of the training split only."""
    return rows.withColumn(answer, F.when(F.col("split") == "train", F.col(answer)))


def isolation_broken(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """n_broken: rows that have an answer outside train, or none inside."""
    return rows.agg(F.count_if(F.col(answer).isNotNull() != (F.col("split") == "train")).alias("n_broken"))


def unknown_fields(config: Column, allowed: list[str]) -> Column:
    """Keys of a map column that a closed-world configuration doesn't know."""
    return F.array_sort(F.array_except(F.map_keys(config), F.array(*[F.lit(k) for k in allowed])))


def repeated_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, copies) of values that are not unique in a field that must be; nulls are no values."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x"))
    counted = long.select("x.field", "x.value").where("value IS NOT NULL").groupBy("field", "value").agg(F.count(F.lit(1)).alias("copies"))
    return counted.where("copies > 1")
