"""Many pages to one document, and documents to bundle artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions.render import to_markdown

MAX_PAGES, MAX_OUTPUT = 256, 8_000_000


def check_pages(pages: DataFrame, doc: str, page: str, position: str, most: int = MAX_PAGES) -> DataFrame:
    """(doc, fatal_error): page numbers must be positive and rise in input order; never sorted for the caller."""
    order = Window.partitionBy(doc).orderBy(position)
    steps = pages.select(doc, (F.col(page) > F.coalesce(F.lag(page).over(order), F.lit(0))).alias("rises"))
    return steps.groupBy(doc).agg(
        F.when(F.count(F.lit(1)) > most, "page count").when(~F.bool_and(F.coalesce("rises", F.lit(False))), "page order").alias("fatal_error")
    )


def compose(pages: DataFrame, doc: str, page: str, allow_partial: bool = False, most: int = MAX_PAGES) -> DataFrame:
    """One row per document: status, n_pages, failed_pages, markdown (null where blocked), fatal_error.

    ``pages`` has doc, page, position and parsed. Only the rendered text is
    shuffled, once, by document.
    """
    rendered = pages.select(
        doc,
        page,
        "position",
        (F.size("parsed.diagnostics") > 0).alias("failed"),
        to_markdown(F.col("parsed"), allow_partial).alias("md"),
    )
    order = Window.partitionBy(doc).orderBy("position")
    numbered = rendered.withColumn("rises", F.col(page) > F.coalesce(F.lag(page).over(order), F.lit(0)))
    entry = F.struct("position", F.concat(F.lit("# Page "), F.col(page).cast("string"), F.lit("\n\n"), F.col("md")).alias("text"))
    whole = numbered.groupBy(doc).agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count_if("failed").alias("failed_pages"),
        F.bool_and(F.col("md").isNotNull() | F.col("failed")).alias("renders"),
        F.bool_and("rises").alias("rises"),
        F.array_sort(F.collect_list(entry)).alias("entries"),
    )
    body = F.array_join(F.transform("entries", lambda e: e["text"]), "\n---\n\n")
    warning = F.concat(
        F.lit("> WARNING: Partial/unverified multi-page conversion ("),
        F.col("failed_pages").cast("string"),
        F.lit(" affected pages). Retain raw DocTags and page diagnostics.\n\n"),
    )
    text = F.when(F.col("failed_pages") > 0, F.concat(warning, body)).otherwise(body)
    fatal = (
        F.when(F.col("n_pages") > most, "page count")
        .when(~F.col("rises"), "page order")
        .when(~F.col("renders"), "unrenderable page")
        .when(F.length(text) > MAX_OUTPUT, "output budget")
    )
    clean = F.col("failed_pages") == 0
    status = F.when(clean, "complete").otherwise("partial" if allow_partial else "blocked")
    shown = fatal.isNull() & (clean | F.lit(allow_partial))
    return whole.select(
        doc,
        F.when(fatal.isNull(), status).otherwise("failed").alias("status"),
        "n_pages",
        "failed_pages",
        F.when(shown, text).alias("markdown"),
        fatal.alias("fatal_error"),
    )


def bundle_artifacts(pages: DataFrame, documents: DataFrame, doc: str, page: str) -> DataFrame:
    """(doc, path, content) of every file of each bundle; a bundle's manifest row is named MANIFEST.

    Raw text is always kept; Markdown only where the document isn't blocked.
    """
    name = F.concat(F.lit("page-"), F.col(page).cast("string"))
    raw = pages.select(doc, F.concat(name, F.lit(".doctags")).alias("path"), F.col("raw").alias("content"))
    notes = F.to_json(F.struct(F.col(page).alias("page"), F.col("stop_reason"), F.col("parsed.diagnostics").alias("diagnostics")))
    data = pages.select(doc, F.concat(name, F.lit(".json")).alias("path"), notes.alias("content"))
    whole = documents.where("markdown IS NOT NULL").select(doc, F.lit("document.md").alias("path"), F.col("markdown").alias("content"))
    manifest = documents.select(doc, F.lit("MANIFEST").alias("path"), F.to_json(F.struct(F.lit(1).alias("schema_version"), "status", "n_pages")).alias("content"))
    return raw.unionByName(data).unionByName(whole).unionByName(manifest)


def write_bundle(artifacts: DataFrame, path: str) -> None:
    """Contents first, manifests second: a bundle without its manifest isn't finished. Existing folders are refused."""
    artifacts.where("path <> 'MANIFEST'").write.mode("errorifexists").parquet(f"{path}/content")
    artifacts.where("path = 'MANIFEST'").write.mode("errorifexists").parquet(f"{path}/manifest")
