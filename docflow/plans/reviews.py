"""Registered queries of reviewed pages, page order and selections, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.operators import compose, corpus, review
from docflow.plans.catalogue import _table, query


def _pairs(*pairs):
    return F.array(*[F.struct(F.lit(tag).alias("tag"), text.alias("text")) for tag, text in pairs])


@query(
    """WITH p AS (SELECT page_id AS k, url, page_id % 9 AS turn, sha1(url) AS s FROM pages),
    r AS (SELECT *, CASE turn WHEN 2 THEN '{"natural_text":' || k || '}' WHEN 4 THEN '{"natural_text":null}' WHEN 5 THEN '{"natural_text":"x"}' ELSE '{"natural_text":"label ' || k || '"}' END AS response FROM p)
    SELECT k AS row, CASE WHEN turn IN (0, 4, 8) THEN 'doc_' || s || '_p' || lpad((k % 100 + 1)::VARCHAR, 5, '0') END AS id,
    CASE turn WHEN 4 THEN 'excluded-blank' WHEN 5 THEN 'excluded-blank' WHEN 6 THEN 'maybe' ELSE 'approved' END AS decision,
    CASE WHEN turn IN (0, 8) THEN '<doctag><page_header>page ' || k || '</page_header><text>text of ' || k || '</text></doctag>' END AS target,
    CASE WHEN turn <> 7 THEN sha256(response) END AS response_sha256,
    [NULL, 'identity', 'label', 'target', NULL, 'blank evidence', 'decision', 'row', NULL][turn + 1] AS problem FROM r"""
)
def q_review_dispatch(spark, d):
    """Reviews of the pages' labels: by turn approved, of another page, without a label, unfit, blank, blank with a label, undecided, without a row."""
    k, turn = F.col("page_id"), F.col("page_id") % 9
    name = k.cast("string")
    pages = _table(spark, d, "pages")
    response = (
        F.when(turn == 2, F.concat(F.lit('{"natural_text":'), name, F.lit("}"))).when(turn == 4, '{"natural_text":null}').when(turn == 5, '{"natural_text":"x"}')
        .otherwise(F.concat(F.lit('{"natural_text":"label '), name, F.lit('"}')))
    )
    rows = pages.where(turn != 7).select(k.alias("row"), "url", (k % 100 + 1).alias("page"), response.alias("response"))
    text = F.when(turn == 3, "a < b").otherwise(F.concat(F.lit("text of "), name))
    elements = F.when(turn.isin(4, 5), F.array().cast("array<struct<tag:string,text:string>>")).otherwise(_pairs(("page_header", F.concat(F.lit("page "), name)), ("text", text)))
    decision = F.when(turn.isin(4, 5), "excluded-blank").when(turn == 6, "maybe").otherwise("approved")
    reviews = pages.select(k.alias("row"), name.alias("source"), F.when(turn == 1, k).otherwise(k % 100 + 1).alias("page"), decision.alias("decision"), elements.alias("elements"))
    reviews = reviews.withColumn("page", F.when(F.col("row") % 9 == 1, F.lit(-1)).otherwise(F.col("page")))
    found = review.dispatch(rows, reviews, pages.select(name.alias("source"), "url"))
    return found.select("row", "id", "decision", "target", "response_sha256", "problem")


@query(
    """WITH s AS (SELECT s_suppkey AS k, s_name, s_suppkey % 8 AS turn FROM supplier),
    g AS (SELECT *, [least(499, round_even(500.0::DOUBLE * (v::DOUBLE / CASE WHEN i % 2 = 1 THEN 400 ELSE 300 END), 0)::INTEGER) FOR v, i IN [k % 100, 10, k % 100 + 50, 60]] AS box FROM s)
    SELECT s_name AS name, CASE WHEN turn IN (0, 5) THEN '<doctag><picture>' || array_to_string(list_transform(box, lambda v: '<loc_' || v || '>'), '') || '</picture></doctag>'
      WHEN turn IN (1, 7) THEN '<doctag><title>' || s_name || '</title><text>page ' || k || '</text></doctag>' END AS target,
    [NULL, NULL, 'picture', 'text', 'changed', NULL, 'missing', NULL][turn + 1] AS problem FROM g
    UNION ALL SELECT 'more-' || s_name, NULL, 'not listed' FROM s WHERE turn = 7"""
)
def q_final_targets(spark, d):
    """A closed set of final pages: by turn pictures, texts, a box outside its image, a tag unknown, another page, one missing, one too many."""
    k, turn = F.col("s_suppkey"), F.col("s_suppkey") % 8
    picture = turn.isin(0, 2, 4, 5, 6)
    decision = F.when(picture, "picture-reference").otherwise("text-reference").alias("decision")
    rows = _table(spark, d, "supplier")
    fixed = rows.select(F.col("s_name").alias("name"), k.alias("row"), (k * 3).alias("page"), decision)
    title = _pairs(("title", F.col("s_name")), ("text", F.concat(F.lit("page "), k.cast("string"))))
    odd = _pairs(("marginalia", F.col("s_name")), ("text", F.lit("x")))
    elements = F.when(picture, _pairs(("picture", F.lit(None).cast("string")))).when(turn == 3, odd).otherwise(title)
    left = k % 100
    box = F.array(left, F.lit(10).cast("long"), F.when(turn == 2, F.lit(401).cast("long")).otherwise(left + 50), F.lit(60).cast("long"))
    cases = rows.where(turn != 6).select(
        F.col("s_name").alias("name"), k.alias("row"), F.when(turn == 4, k).otherwise(k * 3).alias("page"), decision,
        F.lit(400).alias("width"), F.lit(300).alias("height"), elements.alias("elements"), F.when(picture, box).alias("box"),
    )
    more = cases.where(F.col("row") % 8 == 7).withColumn("name", F.concat(F.lit("more-"), "name"))
    return review.final_targets(cases.unionByName(more), fixed)


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def q_wanted_rows(spark, d):
    """Documents with a toxic label, of which only the row groups that can hold one are read."""
    wanted = _table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return review.wanted_rows(spark, f"{d}/documents.parquet", wanted, "doc_id").select("doc_id", "lang", "n_chars")


@query(
    """WITH p AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 211 = 0 THEN -1 ELSE 1 END * row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page FROM orders),
    s AS (SELECT o_custkey, page > coalesce(lag(page) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS rises FROM p)
    SELECT o_custkey, CASE WHEN count(*) > 12 THEN 'page count' WHEN NOT bool_and(rises) THEN 'page order' END AS fatal_error FROM s GROUP BY o_custkey"""
)
def q_page_order(spark, d):
    """Customers' orders as pages, some numbered below zero; more than twelve are too many."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    pages = _table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.when(F.col("o_orderkey") % 211 == 0, -1).otherwise(1) * number).alias("page"))
    return compose.check_pages(pages, "o_custkey", "page", "o_orderkey", 12)


@query("SELECT lang, doc_id, rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 7")
def q_first_per_language(spark, d):
    rows = _table(spark, d, "documents").select("lang", "doc_id")
    return corpus.take_per(rows, "lang", "doc_id", 7).select("lang", "doc_id", F.col("rank").cast("long").alias("rank"))
