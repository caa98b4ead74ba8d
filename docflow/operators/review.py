"""Reviewed pages: decisions dispatched to targets, the closed final set, and scans of wanted rows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.functions import strictjson
from docflow.operators import build, corpus, geometry

#: Tags of a final text page: those of a reviewed target, and a title.
FINAL_TAGS = (*build.TARGET_TAGS, "title")
#: Ranges that a set of wanted ids is described by, at most.
MOST_RANGES = 256


def first_problem(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that doesn't hold (or is null), null if all do."""
    return F.coalesce(*[F.when(~F.coalesce(fine, F.lit(False)), name) for name, fine in rules])


def dispatch(rows: DataFrame, reviews: DataFrame, sources: DataFrame) -> DataFrame:
    """row, id, source_id, decision, target, response_sha256, problem: reviewed rows with the target that their decision gives.

    ``rows``: row, url, page, response (JSON text). ``reviews``: row, source, page,
    decision, elements (array of tag and text). ``sources``: source, url. An
    approved page needs a label and fit elements, a blank one neither; any other decision is
    a problem, as is a review without its row, of another source or page, or given twice.
    """
    twice = reviews.groupBy("row").agg(F.count(F.lit(1)).alias("times"))
    told = reviews.alias("v").join(twice, "row").join(sources.withColumnRenamed("url", "source_url"), "source", "left")
    told = told.select("row", "times", "source_url", F.col("page").alias("told_page"), "decision", "elements")
    both = told.join(rows.withColumn("found", F.lit(True)), "row", "left")
    label = strictjson.field(strictjson.parsed(F.col("response")), "natural_text")
    text = F.when(strictjson.is_kind(label, "string"), F.try_variant_get(label, "$", "string"))
    approved, blank = F.col("decision") == "approved", F.col("decision") == "excluded-blank"
    target = F.when(approved, build.make_target(F.col("elements")))
    none = (label.isNull() | strictjson.is_kind(label, "null")) & strictjson.is_kind(strictjson.parsed(F.col("response")), "object")
    problem = first_problem(
        ("row", F.col("found")),
        ("repeated", F.col("times") == 1),
        ("identity", (F.col("url") == F.col("source_url")) & (F.col("page") == F.col("told_page"))),
        ("decision", approved | blank),
        ("label", ~approved | (F.length(corpus.normalized(text)) > 0)),
        ("target", ~approved | target.isNotNull()),
        ("blank evidence", ~blank | (none & (F.size("elements") == 0))),
    )
    own = corpus.source_id(F.col("url"))
    checked = both.withColumns({"problem": problem, "made": target, "source_id": own})
    fine = F.col("problem").isNull()
    return checked.select(
        "row", F.when(fine, F.concat("source_id", F.lit("_p"), corpus.page_digits(F.col("page")))).alias("id"),
        F.when(fine, F.col("source_id")).alias("source_id"), "decision", F.when(fine, F.col("made")).alias("target"),
        F.sha2("response", 256).alias("response_sha256"), "problem",
    )


def final_targets(cases: DataFrame, fixed: DataFrame) -> DataFrame:
    """name, target, problem of a final set that must be exactly the ``fixed`` cases (name, row, page, decision).

    ``cases`` has these and width, height, elements (array of tag and text) and box
    (array of l, t, r, b in pixels). A picture page is one picture in a box within its
    image, put on the grid; a text page has fit elements only.
    """
    picture, text = F.col("decision") == "picture-reference", F.col("decision") == "text-reference"
    keys = ("row", "page", "decision")
    both = cases.join(fixed.select("name", F.struct(*keys).alias("wanted"), F.lit(True).alias("listed")), "name", "full_outer")
    times = cases.groupBy("name").agg(F.count(F.lit(1)).alias("times"))
    both = both.join(times, "name", "left")
    box = F.col("box")
    inside = (F.size(box) == 4) & (box[0] >= 0) & (box[0] < box[2]) & (box[2] <= F.col("width")) & (box[1] >= 0) & (box[1] < box[3]) & (box[3] <= F.col("height"))
    alone = (F.size("elements") == 1) & (F.get("elements", F.lit(0))["tag"] == "picture") & F.get("elements", F.lit(0))["text"].isNull()
    raw = F.concat(F.lit("<doctag><picture>"), F.array_join(F.transform(box, lambda v: F.concat(F.lit("<loc_"), v.cast("string"), F.lit(">"))), ""), F.lit("</picture></doctag>"))
    pictured = geometry.convert_locations(raw, F.col("width"), F.col("height"))["raw"]
    written = build.make_target(F.col("elements"), tags=FINAL_TAGS)
    problem = first_problem(
        ("not listed", F.col("listed")),
        ("missing", F.col("times").isNotNull()),
        ("repeated", F.col("times") == 1),
        ("changed", F.struct(*keys).eqNullSafe(F.col("wanted"))),
        ("decision", picture | text),
        ("image size", (F.col("width") > 0) & (F.col("height") > 0)),
        ("picture", ~picture | (alone & inside & pictured.isNotNull())),
        ("text", ~text | written.isNotNull()),
    )
    target = F.when(picture, pictured).when(text, written)
    return both.withColumns({"problem": problem, "target": target}).select("name", F.when(F.col("problem").isNull(), F.col("target")).alias("target"), "problem")


def id_ranges(wanted: DataFrame, key: str, most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges that hold all wanted ids, and nothing between equal parts of their span that has none."""
    ids = wanted.select(F.col(key).cast("long").alias("id")).where("id IS NOT NULL")
    ends = ids.agg(F.min("id").alias("least"), F.max("id").alias("last")).first()
    if ends["least"] is None:
        return []
    step = (ends["last"] - ends["least"]) // most + 1
    part = F.floor((F.col("id").cast("decimal(20,0)") - F.lit(ends["least"])) / F.lit(step)).cast("long")
    found = ids.groupBy(part.alias("part")).agg(F.min("id").alias("a"), F.max("id").alias("z"))
    return sorted((r["a"], r["z"]) for r in found.collect())


def wanted_rows(spark: SparkSession, path: str, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of a Parquet table whose integer key is among the wanted ones.

    The wanted ids' ranges, few at any number of ids, are pushed into the scan, so
    files and row groups outside them aren't read, wide columns least of all;
    an exact semi join follows. It pays where the table lies in order of its key.
    """
    ranges = id_ranges(wanted, key)
    rows = spark.read.parquet(path)
    if not ranges:
        return rows.limit(0)
    near = F.lit(False)
    for a, z in ranges:
        near = near | F.col(key).between(a, z)
    return rows.where(near).join(wanted.select(key).distinct(), key, "left_semi")
