"""Registered queries of corpus evidence, targets, scores of whole documents, runs and jobs, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.functions import render, tables
from docflow.functions.doctags import CODES, parse_doctags
from docflow.operators import build, corpus, geometry, jobs, score, supervise
from docflow.plans.catalogue import _ITEMS, _TOK, _order_tables, _table, _tokens, normalized_sql, query
from docflow.sources import pdf, tensors

# ------------------------------------------------------------------ parsing

#: One page per diagnostic code, and the codes it gives, in order.
FAULTS = (
    ("generation-truncated", "<doctag><text>a</text></doctag>", "generation-truncated"),
    ("malformed-token", "<doctag><text>a</text></doctag><", "malformed-token,outside-content"),
    ("mismatched-close", "<doctag><text>a</title></text></doctag>", "mismatched-close"),
    ("unclosed-tag", "<doctag><text>a", "unclosed-tag,unclosed-tag"),
    ("document-wrapper", "<text>a</text>", "document-wrapper,outside-content"),
    ("end-marker", "<end_of_utterance><doctag></doctag>", "end-marker"),
    ("outside-content", "<doctag></doctag>x", "outside-content"),
    ("unsupported-structure", "<doctag><text>a<title>b</title></text></doctag>", "unsupported-structure"),
    ("unsupported-tag", "<doctag>loose</doctag>", "unsupported-tag"),
    ("location", "<doctag><text><loc_9><loc_2><loc_3><loc_4>a</text></doctag>", "location"),
    ("ambiguous-entity", "<doctag><text>&lt;</text></doctag>", "ambiguous-entity"),
    ("control-character", "<doctag><text>a\x01</text></doctag>", "control-character"),
    ("picture-content", "<doctag><picture><loc_1><loc_1><loc_2><loc_2>x</picture></doctag>", "picture-content"),
    ("picture-classification", "<doctag><picture><loc_1><loc_1><loc_2><loc_2><icon><logo></picture></doctag>", "picture-classification"),
    ("picture-location", "<doctag><picture></picture></doctag>", "location,picture-location"),
    ("table-content", "<doctag><otsl><fcel><nl></otsl></doctag>", "table-content"),
    ("table-shape", "<doctag><otsl><fcel>a<nl><fcel>b<fcel>c<nl></otsl></doctag>", "table-shape"),
    ("table-span", "<doctag><otsl><fcel>a<lcel><nl><ucel><fcel>b<nl></otsl></doctag>", "table-span"),
    ("table-header", "<doctag><otsl><rhed>a<nl></otsl></doctag>", "table-header"),
)
assert [f[0] for f in FAULTS] == list(CODES)


def _pick(index, values):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _faulty(spark, d):
    """Every document's first 20 characters that are letters before a page with the fault of its turn; turn 19 has none."""
    turn = F.col("doc_id") % 20
    word = F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z]", ""), 1, 20)
    body = F.coalesce(_pick(turn, [f[1] for f in FAULTS]), F.lit("<doctag><text>fine</text></doctag>"))
    raw = F.replace(body, F.lit("<doctag>"), F.concat(F.lit("<doctag><title>t"), word, F.lit("</title>")))
    stop = F.when(turn == 0, "length").otherwise("eos")
    return _table(spark, d, "documents").select("doc_id", raw.alias("raw"), parse_doctags(raw, stop).alias("p"))


_FAULT_CODES = ", ".join(f"'{f[2]}'" for f in FAULTS)


@query(f"SELECT doc_id, coalesce([{_FAULT_CODES}][(doc_id % 20 + 1)::INTEGER], '') AS codes, doc_id % 20 = 19 AS renderable FROM documents")
def q_all_codes(spark, d):
    rows = _faulty(spark, d).withColumn("probe", score.probe(F.col("p"), render.to_markdown(F.col("p"))))
    codes = F.array_join(F.transform("p.diagnostics", lambda x: x["code"]), ",")
    return rows.select("doc_id", codes.alias("codes"), F.col("probe.renderable").alias("renderable"))


@query(
    """SELECT doc_id, CASE doc_id % 20 WHEN 4 THEN '' WHEN 12 THEN 'title:0,picture:0' WHEN 13 THEN 'title:0,picture:0' WHEN 14 THEN 'title:0,picture:0'
    WHEN 15 THEN 'title:0,table:0' WHEN 16 THEN 'title:0,table:0' WHEN 17 THEN 'title:0,table:0' WHEN 18 THEN 'title:0,table:0' WHEN 5 THEN 'title:0' WHEN 6 THEN 'title:0'
    WHEN 8 THEN 'title:0,unknown:0' ELSE 'title:0,text:0' END AS signature FROM documents"""
)
def q_signature(spark, d):
    return _faulty(spark, d).select("doc_id", F.array_join(score.signature(F.col("p")), ",").alias("signature"))


@query(
    f"""WITH {_ITEMS}, n AS (SELECT l_orderkey, count(*) AS k FROM items GROUP BY 1)
    SELECT l_orderkey, (r - 1)::INTEGER AS r, 1 AS c, l_linenumber::VARCHAR AS text, 1 AS rs FROM items JOIN n USING (l_orderkey) WHERE k > 1
    UNION ALL SELECT l_orderkey, 0, 0, l_orderkey::VARCHAR, k::INTEGER FROM n WHERE k > 1"""
)
def q_table_round_trip(spark, d):
    rows = _table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("lines"))
    first = F.transform(
        "lines", lambda n, i: F.array(F.when(i == 0, build.cell("fcel", F.col("l_orderkey"))).otherwise(build.cell("ucel")), build.cell("fcel", n))
    )
    md = rows.where("size(lines) > 1").select("l_orderkey", parse_doctags(build.otsl(first)).alias("p")).select("l_orderkey", render.to_markdown(F.col("p")).alias("md"))
    return tables.html_cells(md, "l_orderkey", "md").select("l_orderkey", "r", "c", "text", "rs")


# ----------------------------------------------------------- labels and boxes


def _identities(spark, d):
    name = F.concat(corpus.source_id(F.col("url")), F.when(F.col("page_id") % 7 == 3, "_q").otherwise("_p"), corpus.page_digits(F.col("page_id")))
    return _table(spark, d, "pages").select("page_id", "url", name.alias("id"))


@query(
    """SELECT page_id, CASE WHEN page_id % 7 <> 3 THEN 'doc_' || sha1(url) END AS source_id, CASE WHEN page_id % 7 <> 3 THEN page_id END AS page FROM pages"""
)
def q_page_identity(spark, d):
    x = corpus.page_identity(F.col("id"))
    return _identities(spark, d).select("page_id", x["source_id"].alias("source_id"), x["page"].cast("long").alias("page"))


def _located(spark, d):
    """Pages of one located text; by turn: sound, five locations, an orphan, inverted, outside."""
    k, turn = F.col("p_partkey"), F.col("p_partkey") % 5
    loc = lambda v: F.concat(F.lit("<loc_"), v.cast("string"), F.lit(">"))
    left, right = k % 50, k % 50 + F.col("p_size")
    box = F.concat(
        loc(F.when(turn == 3, right + 1).otherwise(left)), loc(k % 30), loc(F.when(turn == 4, F.lit(5000)).otherwise(right)), loc(k % 30 + 40)
    )
    extra = F.when(turn == 1, "<loc_7>").when(turn == 2, "x<loc_7>").otherwise("")
    raw = F.concat(F.lit("<doctag><text>"), box, extra, F.lit("part "), k.cast("string"), F.lit("</text></doctag>"))
    return _table(spark, d, "part").select("p_partkey", raw.alias("raw"), (F.lit(200) + k % 300).alias("w"), (F.lit(100) + k % 70).alias("h"))


_LOCATED = """
b AS (SELECT p_partkey AS k, p_partkey % 5 AS turn, p_partkey % 50 AS l, p_partkey % 30 AS t, p_partkey % 50 + p_size AS r, p_partkey % 30 + 40 AS bt,
      200 + p_partkey % 300 AS w, 100 + p_partkey % 70 AS h FROM part),
g AS (SELECT k, turn, [l, t, r, bt] AS old, [least(499, round_even(500.0::DOUBLE * (l::DOUBLE / w), 0)::INTEGER), least(499, round_even(500.0::DOUBLE * (t::DOUBLE / h), 0)::INTEGER),
      least(499, round_even(500.0::DOUBLE * (r::DOUBLE / w), 0)::INTEGER), least(499, round_even(500.0::DOUBLE * (bt::DOUBLE / h), 0)::INTEGER)] AS new FROM b)"""


@query(
    f"""WITH {_LOCATED} SELECT k AS p_partkey, CASE WHEN turn = 0 THEN '<doctag><text>' || array_to_string(list_transform(new, lambda v: '<loc_' || v || '>'), '') || 'part ' || k || '</text></doctag>' END AS raw,
    [NULL, 'orphan location', 'orphan location', 'box', 'box'][turn + 1] AS error FROM g"""
)
def q_convert_locations(spark, d):
    done = _located(spark, d).select("p_partkey", geometry.convert_locations(F.col("raw"), F.col("w"), F.col("h")).alias("x"))
    return done.select("p_partkey", "x.raw", "x.error")


@query(
    f"""WITH {_LOCATED} SELECT turn, count(*)::BIGINT AS pages, sum(1)::BIGINT AS boxes, bool_and(turn = 0) AS content_kept,
    count(DISTINCT '<doctag><text>' || CASE WHEN turn = 2 THEN 'x' ELSE '' END || 'part ' || k || '</text></doctag>')::BIGINT AS contents FROM g GROUP BY turn"""
)
def q_geometry_audit(spark, d):
    x = _located(spark, d).select((F.col("p_partkey") % 5).alias("turn"), geometry.audit_locations(F.col("raw"), F.col("w"), F.col("h")).alias("x"))
    return x.groupBy("turn").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum("x.boxes").alias("boxes"),
        F.bool_and("x.content_kept").alias("content_kept"),
        F.count_distinct("x.content_sha256").alias("contents"),
    )


@query(
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN (16 * (p_size / 3)::INTEGER * 16 * (p_size / 3)::INTEGER)::BIGINT END AS patches,
    CASE WHEN p_size % 3 = 0 THEN (4 * (p_size / 3)::INTEGER * 4 * (p_size / 3)::INTEGER)::BIGINT END AS tokens, CASE WHEN p_size % 3 = 0 THEN 768 * 16 END AS connector_width FROM part"""
)
def q_vision_layout(spark, d):
    size = F.when(F.col("p_size") % 3 == 0, F.col("p_size") / 3 * 256).otherwise(F.col("p_size") * 16 + 1).cast("int")
    x = geometry.layout(size, F.lit(16), F.lit(4), F.lit(768))
    return _table(spark, d, "part").select(
        "p_partkey", x["patches"].cast("long").alias("patches"), x["tokens"].cast("long").alias("tokens"), x["connector_width"].alias("connector_width")
    )


@query(
    """SELECT vec_id, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE * 0.01))) AS largest, len(list_filter(embedding, lambda x: abs(x::DOUBLE * 0.01) > 0.0005 + 0.001 * abs(x::DOUBLE * 1.01)))::INTEGER AS outside,
    true AS finite FROM embeddings"""
)
def q_tensor_difference(spark, d):
    a = F.transform("embedding", lambda x: x.cast("double"))
    moved = F.transform("embedding", lambda x: x.cast("double") + x.cast("double") * F.lit(0.01))
    x = tensors.difference_report(a, moved, 0.0005, 0.001)
    rows = _table(spark, d, "embeddings").select("vec_id", x.alias("x"))
    return rows.select("vec_id", "x.largest", "x.outside", "x.finite")


# ------------------------------------------------------- targets and evidence


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE md5('<doctag><page_header>' || p_brand || '</page_header><text>' || p_name || '</text></doctag>') END AS target_md5 FROM part"""
)
def q_make_target(spark, d):
    turn = F.col("p_partkey") % 4
    text = F.when(turn == 1, "a < b").when(turn == 2, "a &amp; b").otherwise(F.col("p_name"))
    elements = F.array(
        F.struct(F.when(turn == 3, "marginalia").otherwise("page_header").alias("tag"), F.col("p_brand").alias("text")),
        F.struct(F.lit("text").alias("tag"), text.alias("text")),
    )
    return _table(spark, d, "part").select("p_partkey", F.md5(build.make_target(elements)).alias("target_md5"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '<doctag><text>' || p_brand || '</text><picture>' || array_to_string(list_transform([p_partkey % 100, 10, p_partkey % 100 + p_size, 60],
    lambda v, i: '<loc_' || least(499, round_even(500.0::DOUBLE * (v::DOUBLE / CASE WHEN i % 2 = 1 THEN 400 ELSE 300 END), 0)::INTEGER) || '>'), '') || '</picture></doctag>' END AS reference FROM part"""
)
def q_make_reference(spark, d):
    k, turn = F.col("p_partkey"), F.col("p_partkey") % 3
    elements = F.array(
        F.struct(F.lit("text").alias("tag"), F.col("p_brand").alias("text")),
        F.struct(F.when(turn == 1, "text").otherwise("picture").alias("tag"), F.when(turn == 1, "b").alias("text")),
    )
    left = k % 100
    box = F.struct(left.alias("l"), F.lit(10).alias("t"), F.when(turn == 2, left).otherwise(left + F.col("p_size")).alias("r"), F.lit(60).alias("b"))
    return _table(spark, d, "part").select("p_partkey", build.make_reference(elements, box, F.lit(400), F.lit(300)).alias("reference"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size || ',10,' || (p_size + 100) || ',60' END AS location, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 1 THEN 'icon' END AS classification,
    CASE WHEN p_partkey % 3 = 0 THEN (100 + p_size)::INTEGER END AS width FROM part"""
)
def q_picture_record(spark, d):
    s, turn = F.col("p_size"), F.col("p_partkey") % 3
    place = F.concat_ws(",", s.cast("string"), F.lit("10"), F.when(turn == 1, "x").otherwise((s + 100).cast("string")), F.when(turn == 2, "500").otherwise("60"))
    line = F.concat_ws("\t", F.lit("PICTURE"), place, F.when(F.col("p_partkey") % 2 == 1, "icon").otherwise("none"), (s + 100).cast("string"), F.lit("50"), F.lit("text:0"))
    rows = _table(spark, d, "part").select("p_partkey", build.picture_record(line).alias("x"))
    return rows.select(
        "p_partkey", F.array_join(F.col("x.location").cast("array<string>"), ",").alias("location"), "x.classification", F.get("x.size", F.lit(0)).alias("width")
    )


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 4 THEN 'order ' || o_orderkey || chr(10) || chr(10) || o_orderpriority END AS text, CASE WHEN o_orderkey % 5 <> 4 THEN 1 END AS tables,
    CASE WHEN o_orderkey % 5 <> 4 THEN o_orderstatus || '|' || o_custkey END AS cells FROM orders"""
)
def q_ground_truth(spark, d):
    cell = lambda i, text: F.struct(
        F.lit(0).alias("start_row_offset_idx"), F.lit(i).alias("start_col_offset_idx"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), text.alias("text")
    )
    table = F.struct(
        F.struct(
            F.lit(1).alias("num_rows"), F.lit(2).alias("num_cols"),
            F.array(cell(0, F.col("o_orderstatus")), cell(1, F.col("o_custkey").cast("string"))).alias("table_cells"),
        ).alias("data")
    )
    texts = F.array(F.struct(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("text")), F.struct(F.col("o_orderpriority").alias("text")))
    document = F.when(F.col("o_orderkey") % 5 == 4, "{").otherwise(F.to_json(F.struct(texts.alias("texts"), F.array(table).alias("tables"))))
    x = _table(spark, d, "orders").select("o_orderkey", corpus.ground_truth(document).alias("x"))
    cells = F.array_join(F.transform(F.get("x.tables", F.lit(0))["cells"], lambda c: c["text"]), "|")
    return x.select("o_orderkey", "x.text", F.when(F.col("x").isNotNull(), F.size("x.tables")).alias("tables"), cells.alias("cells"))


_SEAL_BAD = ("", "fields", "status", "final opened", "revision", "report path", "payload", "digests")


@query(f"SELECT o_orderkey, [{', '.join(repr(x) for x in _SEAL_BAD)}][(o_orderkey % 8 + 1)::INTEGER] AS problems FROM orders")
def q_seal_problems(spark, d):
    turn = F.col("o_orderkey") % 8
    hex64 = F.col("hex64")
    fields = {
        "schema_version": F.lit(1),
        "status": F.when(turn == 2, "open").otherwise("selection-sealed"),
        "selection_criterion": F.lit("validation-only"),
        "final_content_opened": turn == 3,
        "workflow_sha256": hex64,
        "selection_protocol_sha256": hex64,
        "selection_report": F.when(turn == 5, "../report.json").otherwise("out/report.json"),
        "selection_report_sha256": hex64,
        "selected_id": F.col("o_orderkey").cast("string"),
        "selected_kind": F.lit("adapter"),
        "selected_files": F.when(turn == 6, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("a/w.bin"), F.when(turn == 7, "beef").otherwise(hex64))),
        "final_cases": F.array(F.lit("p1")),
        "development_evidence": F.create_map(F.lit("x"), hex64),
        "source_revision": F.when(turn == 4, "main").otherwise(F.sha1(F.col("o_orderkey").cast("string"))),
    }
    whole = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))
    longer = F.regexp_replace(whole, r"\A\{", '{"extra":0,')
    policy = F.struct(
        hex64.alias("workflow_sha256"), hex64.alias("selection_protocol_sha256"), F.lit('["p1"]').alias("final_cases"),
        F.concat(F.lit('{"x":"'), hex64, F.lit('"}')).alias("development_evidence"),
    )
    problems = corpus.seal_problems(F.when(turn == 1, longer).otherwise(whole), policy)
    rows = _table(spark, d, "orders", 20_000).select("o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("hex64"))
    return rows.select("o_orderkey", F.array_join(problems, ",").alias("problems"))


@query(
    """SELECT page_id, page_id % 6 = 0 AS reviewed FROM pages"""
)
def q_reviewed_source(spark, d):
    turn = F.col("page_id") % 6
    review = F.struct(
        F.when(turn == 1, "ftp://x").otherwise(F.col("url")).alias("original_source_url"),
        F.lit("https://example.org/license").alias("license_url"),
        F.when(turn == 2, " \t").otherwise("reviewer").alias("reviewer"),
        F.when(turn == 3, F.repeat(F.lit("x"), 2001)).otherwise("fine").alias("decision_note"),
        F.when(turn == 4, F.lit(None).cast("boolean")).otherwise(True).alias("training_approved"),
        (turn != 5).alias("privacy_cleared"),
    )
    return _table(spark, d, "pages").select("page_id", corpus.reviewed_source(review).alias("reviewed"))


@query(
    """WITH p AS (SELECT page_id, 'u' || (page_id % 20) AS url, page_id // 20 AS page FROM pages),
    l AS (SELECT url, page, CASE WHEN page_id % 3 = 0 THEN 'final' ELSE 'train' END AS split FROM p WHERE page_id % 11 <> 0),
    r AS (SELECT url, page FROM p WHERE page_id % 13 <> 0)
    SELECT coalesce(r.url, l.url) AS url, coalesce(r.page, l.page)::BIGINT AS page, split, CASE WHEN l.url IS NULL THEN 'not listed' WHEN r.url IS NULL THEN 'missing' END AS problem
    FROM r FULL JOIN l ON r.url = l.url AND r.page = l.page"""
)
def q_assign_splits(spark, d):
    rows = _table(spark, d, "pages").select(
        "page_id", F.concat(F.lit("u"), (F.col("page_id") % 20).cast("string")).alias("url"), F.floor(F.col("page_id") / 20).alias("page")
    )
    lock = rows.where("page_id % 11 <> 0").select("url", "page", F.when(F.col("page_id") % 3 == 0, "final").otherwise("train").alias("split"))
    return corpus.assign_splits(rows.where("page_id % 13 <> 0").select("url", "page"), lock).select("url", "page", "split", "problem")


@query(
    """SELECT count(*) FILTER (conv_id % 10 = 7 AND turn % 2 = 0)::BIGINT AS n_broken FROM conversations"""
)
def q_withheld_answers(spark, d):
    m = F.col("conv_id") % 10
    rows = _table(spark, d, "conversations").select(F.when(m < 8, "train").otherwise("final").alias("split"), "turn", m.alias("m"), F.coalesce("text", F.lit("")).alias("answer"))
    kept = corpus.withhold(rows)
    broken = kept.withColumn("answer", F.when((F.col("m") == 7) & (F.col("turn") % 2 == 0), F.lit(None)).otherwise(F.col("answer")))
    return corpus.isolation_broken(broken)


# ---------------------------------------------------------- training examples


@query(
    """SELECT conv_id, turn, CASE WHEN conv_id % 6 <> 1 THEN md5('<|im_start|>User:<image>' || text || '<end_of_utterance>' || chr(10) || 'Assistant:') END AS prompt_md5 FROM conversations WHERE text IS NOT NULL"""
)
def q_prompt(spark, d):
    task = F.when(F.col("conv_id") % 6 == 1, F.concat("text", F.lit("<row_1"))).otherwise(F.col("text"))
    rows = _table(spark, d, "conversations").where("text IS NOT NULL")
    return rows.select("conv_id", "turn", F.md5(supervise.prompt(F.lit("<image>"), task)).alias("prompt_md5"))


@query(
    """WITH t AS (SELECT conv_id, turn, list_transform(list_filter(string_split(coalesce(text, ''), ' '), lambda w: length(w) > 0), lambda w: length(w) + 9) AS w FROM conversations)
    SELECT conv_id, turn, CASE WHEN conv_id % 4 <> 1 AND len(w) >= 1 AND len(w) <= 8188 THEN len(w) + 1 END::INTEGER AS supervised FROM t"""
)
def q_training_example(spark, d):
    words = F.filter(F.split(F.coalesce("text", F.lit("")), " ", -1), lambda w: F.length(w) > 0)
    ids = F.transform(words, lambda w: F.length(w) + 9)
    prompt = F.array(F.lit(9), F.lit(9), F.when(F.col("conv_id") % 4 == 1, 12).otherwise(11))
    full = F.concat(F.array(F.lit(9), F.lit(9), F.lit(11)), ids, F.array(F.lit(1)))
    x = supervise.training_example(full, prompt, 1, 9)
    rows = _table(spark, d, "conversations").select("conv_id", "turn", x.alias("x"))
    return rows.select("conv_id", "turn", F.when(F.col("x").isNotNull(), F.size(F.filter("x.labels", lambda v: v != supervise.IGNORE))).alias("supervised"))


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'do_pad' WHEN 2 THEN 'extra' ELSE 'resample' END AS problems FROM part"""
)
def q_policy_problems(spark, d):
    turn = F.col("p_partkey") % 4
    entry = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    found = F.array(
        entry("do_pad", F.when(turn == 1, "false").otherwise("true")),
        F.when(turn != 3, entry("resample", F.lit("1"))),
        F.when(turn == 2, entry("extra", F.lit("0"))),
    )
    problems = supervise.policy_problems(F.map_from_entries(F.array_compact(found)), {"do_pad": "true", "resample": "1"})
    return _table(spark, d, "part").select("p_partkey", F.array_join(problems, ",").alias("problems"))


# --------------------------------------------------------------------- scores


def _recognised(spark, d):
    """Conversation turns as recognised pages: letters e are lost in two of three, every 10th page stops early, every 15th fails."""
    text, k = F.coalesce("text", F.lit("")), F.col("conv_id") + F.col("turn")
    seen = F.when(k % 3 == 0, text).otherwise(F.replace(text, F.lit("e"), F.lit("")))
    return _table(spark, d, "conversations", 2_000).select(
        "conv_id", "turn", F.col("role").alias("split"), text.alias("expected"), k.alias("k"),
        F.concat(F.lit("<doctag><text>"), seen, F.lit("</text></doctag>")).alias("raw"), seen.alias("seen"),
        F.when(k % 10 == 0, "length").otherwise("eos").alias("stop_reason"), F.lit(0).alias("n_diagnostics"), (k % 10 != 0).alias("markdown_written"),
        F.when(k % 15 == 0, "timeout").alias("error"),
    )


# The twin's distance counts bytes, so word edits have none; the letters lost here are single bytes.
_RECOGNISED = f"""
a AS (SELECT conv_id, turn, role AS split, conv_id + turn AS k, coalesce(text, '') AS t, CASE WHEN (conv_id + turn) % 3 = 0 THEN coalesce(text, '') ELSE replace(coalesce(text, ''), 'e', '') END AS seen FROM conversations),
n AS (SELECT *, {normalized_sql("t")} AS e, {normalized_sql("seen")} AS f FROM a),
x AS (SELECT *, list_filter(string_split(e, ' '), lambda x: x <> '') AS we, list_filter(string_split(f, ' '), lambda x: x <> '') AS wf FROM n)"""
_MATCHES = "list_sum(list_transform(list_intersect(we, wf), lambda w: least(len(list_filter(we, lambda v: v = w)), len(list_filter(wf, lambda v: v = w)))))"


@query(
    f"""WITH {_RECOGNISED} SELECT conv_id, turn, levenshtein(e, f)::BIGINT AS character_edits, len(we)::BIGINT AS reference_words, coalesce({_MATCHES}, 0)::BIGINT AS inventory_matches,
    e = f AND k % 10 <> 0 AS accepted FROM x"""
)
def q_score_coverage(spark, d):
    rows = score.score_coverage(_recognised(spark, d).drop("k", "seen"))
    return rows.select("conv_id", "turn", "character_edits", "reference_words", "inventory_matches", "accepted")


_NO_TABLES = "array<struct<rows:int,columns:int,renderable:boolean,cells:array<struct<r:int,c:int,rs:int,cs:int,text:string>>>>"


def _benchmarked(spark, d):
    """Recognised turns as benchmark documents with one table each: its one cell is the role; turns by 4 have another text, by 7 none."""
    cell = lambda text: F.struct(F.lit(0).alias("r"), F.lit(0).alias("c"), F.lit(1).alias("rs"), F.lit(1).alias("cs"), text.alias("text"))
    table = lambda text: F.array(F.struct(F.lit(1).alias("rows"), F.lit(1).alias("columns"), F.lit(True).alias("renderable"), F.array(cell(text)).alias("cells")))
    k = F.col("k")
    found = F.when(k % 7 == 0, F.lit(None).cast(_NO_TABLES)).when(k % 4 == 0, table(F.lit("other"))).otherwise(table(F.concat(F.lit(" "), "split")))
    return score.score_document(
        _recognised(spark, d).select(
            "conv_id", "turn", "split", F.col("expected").alias("markdown_reference"), F.lit(None).cast("string").alias("text_reference"),
            table(F.col("split")).alias("expected_tables"), F.when(F.col("markdown_written"), F.col("seen")).alias("markdown"),
            "raw", "stop_reason", "n_diagnostics", "error", found.alias("tables"),
        )
    )


_BENCHMARKED = f"""{_RECOGNISED},
y AS (SELECT *, k % 10 <> 0 AND k % 15 <> 0 AS strict, k % 7 <> 0 AND k % 4 <> 0 AS tabled FROM x),
z AS (SELECT conv_id, turn, split, k, strict AS strict_export, e = CASE WHEN strict THEN f ELSE '' END AS markdown_exact, tabled AS tables_exact, CASE WHEN strict THEN levenshtein(e, f) ELSE length(e) END::BIGINT AS character_edits,
      length(e) AS reference_characters, len(we)::BIGINT AS reference_words, levenshtein(e, f)::BIGINT AS raw_text_character_edits, tabled::BIGINT AS exact_cell_matches,
      k % 15 = 0 AS execution_error FROM y)"""


@query(
    f"""WITH {_BENCHMARKED} SELECT conv_id, turn, strict_export, markdown_exact, tables_exact, strict_export AND markdown_exact AND tables_exact AS accepted, character_edits, reference_words,
    raw_text_character_edits, exact_cell_matches FROM z"""
)
def q_score_document(spark, d):
    return _benchmarked(spark, d).select(
        "conv_id", "turn", "strict_export", "markdown_exact", "tables_exact", "accepted", "character_edits", "reference_words", "raw_text_character_edits", "exact_cell_matches"
    )


@query(
    f"""WITH {_BENCHMARKED} SELECT split, count(*)::BIGINT AS pages, count(*) FILTER (strict_export)::BIGINT AS strict_exports, count(*) FILTER (strict_export AND markdown_exact AND tables_exact)::BIGINT AS accepted,
    count(*) FILTER (execution_error)::BIGINT AS execution_failures, sum(character_edits)::DOUBLE / sum(reference_characters) AS markdown_cer,
    sum(raw_text_character_edits)::DOUBLE / sum(reference_characters) AS raw_text_cer FROM z GROUP BY split"""
)
def q_run_summary(spark, d):
    return score.run_summary(_benchmarked(spark, d), "split").drop("markdown_wer", "raw_text_wer")


@query(
    f"""WITH {_ITEMS}, a AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linenumber % 3 = 0) AS bad FROM items GROUP BY 1)
    SELECT l_orderkey, (3 * (n + 1))::BIGINT AS expected_cells, CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE 3 * (n + 1) - bad END::BIGINT AS exact_cell_matches, bad = 0 AND l_orderkey % 5 <> 0 AS exact_table,
    bad = 0 AND l_orderkey % 5 <> 0 AS table_accepted FROM a"""
)
def q_score_page(spark, d):
    page = _order_tables(spark, d)
    wide = "array<struct<r:int,c:int,rs:int,cs:int,text:string>>"
    cells = F.transform("parsed.cells", lambda x: F.struct(x["r"], x["c"], x["rs"], x["cs"], x["text"])).cast(wide)
    # every third line's quantity was read wrong
    line = F.map_from_entries(F.transform(F.filter("parsed.cells", lambda x: x["c"] == 0), lambda x: F.struct(x["r"], x["text"])))
    wrong = F.transform(
        "parsed.cells",
        lambda x: F.struct(
            x["r"], x["c"], x["rs"], x["cs"],
            F.when((x["c"] == 1) & (x["r"] > 0) & (F.element_at(line, x["r"]).cast("int") % 3 == 0), F.concat(x["text"], F.lit("?"))).otherwise(x["text"]),
        ),
    ).cast(wide)
    first = F.get("parsed.tables", F.lit(0))
    table = lambda c: F.array(F.struct(first["rows"].alias("rows"), first["columns"].alias("columns"), (F.col("l_orderkey") % 5 != 0).alias("renderable"), c.alias("cells")))
    rows = page.select(
        "l_orderkey", "raw", table(cells).alias("expected_tables"), table(wrong).alias("tables"), F.lit("eos").alias("stop_reason"), F.lit(0).alias("n_diagnostics"), F.lit(True).alias("markdown_written")
    )
    return score.score_page(rows).select("l_orderkey", "expected_cells", "exact_cell_matches", "exact_table", "table_accepted")


@query(
    """WITH s AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'final' ELSE 'regression' END AS split, event_id % 3 AS p, value > 50 AS ok, event_id % 7 AS n FROM events)
    SELECT split, count(*) FILTER (p = 0)::BIGINT AS base_pages, count(*) FILTER (p = 0 AND ok)::BIGINT AS base_accepted, sum(n) FILTER (p = 0)::BIGINT AS base_exact_cells,
    count(*) FILTER (p = 1)::BIGINT AS adapted_pages, count(*) FILTER (p = 1 AND ok)::BIGINT AS adapted_accepted, sum(n) FILTER (p = 1)::BIGINT AS adapted_exact_cells FROM s GROUP BY split"""
)
def q_split_phase_grid(spark, d):
    rows = _table(spark, d, "events").select(
        F.when(F.col("user_id") % 2 == 0, "final").otherwise("regression").alias("split"),
        F.when(F.col("event_id") % 3 == 0, "base").when(F.col("event_id") % 3 == 1, "adapted").otherwise("other").alias("phase"),
        (F.col("value") > 50).alias("accepted"),
        (F.col("event_id") % 7).alias("exact_cell_matches"),
    )
    return score.split_phase_grid(rows, ["base", "adapted"])


@query(
    """WITH g AS (SELECT user_id % 20 AS step, event_id % 30 AS c FROM events WHERE NOT (user_id % 20 = 3 AND event_id % 30 = 4)), n AS (SELECT count(DISTINCT c) AS n FROM g)
    SELECT step, n - count(DISTINCT c) AS missing, count(*) - count(DISTINCT c) AS repeated FROM g, n GROUP BY step, n HAVING n - count(DISTINCT c) > 0 OR count(*) - count(DISTINCT c) > 0"""
)
def q_grid_complete(spark, d):
    rows = _table(spark, d, "events").select((F.col("user_id") % 20).alias("step"), (F.col("event_id") % 30).alias("c"))
    return score.grid_complete(rows.where("NOT (step = 3 AND c = 4)"), "step", "c")


@query(
    """SELECT o_orderkey AS name, CASE WHEN o_orderkey % 11 = 0 THEN 'recorded-execution-error' WHEN o_orderkey % 7 = 0 THEN 'missing-output' ELSE 'output' END AS status,
    CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 3 = 0) THEN 'inconsistent output' END AS problem FROM orders"""
)
def q_load_outputs(spark, d):
    cases = _table(spark, d, "orders").select(F.col("o_orderkey").alias("name"), "o_orderstatus")
    outputs = cases.where("name % 7 <> 0").select(
        "name", F.col("o_orderstatus").alias("raw"), F.when(F.col("name") % 5 == 0, "?").otherwise(F.col("o_orderstatus")).alias("stored_raw"),
        F.array_repeat(F.lit(1), F.when(F.col("name") % 3 == 0, 5).otherwise(4)).alias("token_ids"), F.lit("eos").alias("stop_reason"),
    )
    errors = cases.where("name % 11 = 0").select("name", F.lit("timeout").alias("error"))
    return score.load_outputs(cases.select("name"), outputs, errors, 4).select("name", "status", "problem")


@query(
    f"""WITH {_ITEMS} SELECT l_orderkey, CASE WHEN l_orderkey % 4 <> 1 THEN '<otsl><ched>line<ched>quantity<ched>flag<nl>' || string_agg('<fcel>' || l_linenumber || '<fcel>' || q || '<fcel>' || l_returnflag || '<nl>', '' ORDER BY r) || '</otsl>' END AS markup
    FROM items GROUP BY l_orderkey"""
)
def q_single_table(spark, d):
    raw = F.when(F.col("l_orderkey") % 4 == 1, F.concat("raw", "raw")).otherwise(F.col("raw"))
    return _order_tables(spark, d).select("l_orderkey", score.single_table(raw).alias("markup"))


@query(
    """SELECT user_id AS name, count(*)::BIGINT AS runtimes, count(DISTINCT CASE WHEN event_id % 50 = 0 THEN 'x' ELSE 'y' END) = 1 AS agree FROM events GROUP BY user_id"""
)
def q_runtimes_agree(spark, d):
    rows = _table(spark, d, "events").select(
        F.col("user_id").alias("name"), F.array(F.lit(1)).alias("token_ids"), F.when(F.col("event_id") % 50 == 0, "x").otherwise("y").alias("raw"), F.lit("eos").alias("stop_reason")
    )
    return score.runtimes_agree(rows, "name")


@query(
    """WITH s AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, max(event_id) OVER (PARTITION BY user_id) % 5 AS m FROM events)
    SELECT run, count(*)::BIGINT AS steps, CASE WHEN any_value(m) = 1 AND count(*) > 1 THEN 'step' WHEN any_value(m) = 2 THEN 'loss' WHEN any_value(m) = 3 AND count(*) > 1 THEN 'handles' WHEN any_value(m) = 4 THEN 'base' ELSE '' END AS problems FROM s GROUP BY run"""
)
def q_trajectories(spark, d):
    from pyspark.sql import Window

    own = Window.partitionBy("user_id")
    rows = _table(spark, d, "events").select(
        F.col("user_id").alias("run"), F.row_number().over(own.orderBy("event_id")).alias("i"), F.count(F.lit(1)).over(own).alias("n"), (F.max("event_id").over(own) % 5).alias("m")
    )
    last = F.col("i") == F.col("n")
    steps = rows.select(
        "run",
        (F.col("i") + F.when((F.col("m") == 1) & last, 1).otherwise(0)).alias("step"),
        F.when((F.col("m") == 2) & last, F.lit(float("nan"))).otherwise(1.0 / F.col("i")).alias("loss"),
        F.when((F.col("m") == 3) & last, 9).otherwise(8).alias("handles"),
        (~((F.col("m") == 4) & last)).alias("base_unchanged"),
        F.lit(True).alias("adapter_changed"),
    )
    return score.trajectory_problems(steps).select("run", "steps", F.array_join("problems", ",").alias("problems"))


@query(
    """SELECT 'restored' AS resumed, count(*) FILTER (event_id > 100)::BIGINT AS steps, 0::BIGINT AS differing FROM events
    UNION ALL SELECT 'discarded', count(*) FILTER (event_id > 100), count(*) FILTER (event_id > 100 AND event_id % 2 = 0) FROM events"""
)
def q_resume_proof(spark, d):
    """A restored run repeats every loss exactly; the negative control, with its state discarded, must not."""
    whole = _table(spark, d, "events").select(F.col("event_id").alias("step"), F.col("value").alias("loss"))
    later = whole.where("step > 100")
    discarded = later.withColumn("loss", F.when(F.col("step") % 2 == 0, F.col("loss") + 1).otherwise(F.col("loss")))
    restored = score.resumed_equal(whole, later, 100).select(F.lit("restored").alias("resumed"), "steps", "differing")
    return restored.unionByName(score.resumed_equal(whole, discarded, 100).select(F.lit("discarded").alias("resumed"), "steps", "differing"))


@query(
    """SELECT p_partkey, p_partkey % 3 <> 2 AS picture_count_exact, CASE WHEN p_partkey % 3 <> 2 THEN ((100 - s) * 50)::DOUBLE / (10000 - (100 - s) * 50) END AS picture_iou,
    p_partkey % 3 = 0 AND ((100 - s) * 50)::DOUBLE / (10000 - (100 - s) * 50) >= 0.7 AS accepted FROM (SELECT p_partkey, (p_partkey % 40)::INTEGER AS s FROM part)"""
)
def q_score_pictures(spark, d):
    k = F.col("p_partkey")
    box = lambda left: F.struct(left.cast("int").alias("l"), F.lit(0).alias("t"), (left + 100).cast("int").alias("r"), F.lit(50).alias("b"))
    moved = box(k % 40)
    rows = _table(spark, d, "part").select(
        "p_partkey", F.lit(True).alias("strict"), (k % 3 == 0).alias("markdown_exact"), F.lit(True).alias("structure_exact"), F.lit(True).alias("asset_verified"),
        F.array(box(F.lit(0))).alias("expected_boxes"), F.when(k % 3 == 2, F.array(moved, moved)).otherwise(F.array(moved)).alias("actual_boxes"),
    )
    return score.score_pictures(rows, 0.7).select("p_partkey", "picture_count_exact", "picture_iou", "accepted")


@query(
    """WITH s AS (SELECT 'c' || (user_id % 10) AS candidate, user_id % 10 AS place, count(*) FILTER (value > 50)::BIGINT AS accepted, sum(event_id % 9)::BIGINT AS character_edits, sum(event_id % 5)::BIGINT AS word_edits FROM events GROUP BY 1, 2)
    SELECT * FROM s ORDER BY accepted DESC, character_edits, word_edits, place LIMIT 1"""
)
def q_choose_least_edits(spark, d):
    rows = _table(spark, d, "events").select(
        F.concat(F.lit("c"), (F.col("user_id") % 10).cast("string")).alias("candidate"), (F.col("user_id") % 10).alias("place"),
        F.when(F.col("value") > 50, 1).otherwise(0).alias("accepted"), (F.col("event_id") % 9).alias("character_edits"), (F.col("event_id") % 5).alias("word_edits"),
    )
    return score.choose_least_edits(rows)


@query(
    """WITH s AS (SELECT 'r' || (event_id % 3) AS runtime, user_id % 20 AS "case", event_id % 2 AS stage, value AS seconds FROM events),
    o AS (SELECT "case", count(DISTINCT CASE WHEN "case" = 5 THEN runtime ELSE 'same' END) = 1 AS same_output FROM s GROUP BY 1)
    SELECT runtime, "case", median(seconds) FILTER (stage = 0) AS load, median(seconds) FILTER (stage = 1) AS decode, any_value(same_output) AS same_output FROM s JOIN o USING ("case") GROUP BY 1, 2"""
)
def q_compare_runs(spark, d):
    rows = _table(spark, d, "events").select(
        F.concat(F.lit("r"), (F.col("event_id") % 3).cast("string")).alias("runtime"), (F.col("user_id") % 20).alias("case"),
        F.when(F.col("event_id") % 2 == 0, "load").otherwise("decode").alias("stage"), F.col("value").alias("seconds"),
    )
    outputs = rows.select("runtime", "case", F.when(F.col("case") == 5, F.col("runtime")).otherwise("same").alias("output"))
    return score.compare_runs(rows, outputs, ["load", "decode"])


@query(
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'name' ELSE 'name,size' END AS fields FROM part"""
)
def q_differing_fields(spark, d):
    turn = F.col("p_partkey") % 3
    left = F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.lit(None).cast("int").alias("none"))
    right = F.struct(
        F.when(turn > 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).alias("name"), (F.col("p_size") + F.when(turn == 2, 1).otherwise(0)).alias("size"), F.lit(None).cast("int").alias("none")
    )
    rows = _table(spark, d, "part").select("p_partkey", left.alias("a"), right.alias("b"))
    return rows.select("p_partkey", F.array_join(score.differing_fields("a", "b", ["name", "size", "none"]), ",").alias("fields"))


# ----------------------------------------------------------------------- jobs


def _attempts(spark, d):
    """Orders as pages of their customer's job: every 5th failed once and then succeeded, every 35th failed twice."""
    k = F.col("o_orderkey")
    tries = F.when(k % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = _table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("job"), k.alias("page"), F.explode(tries).alias("attempt"))
    failed = ((F.col("page") % 5 == 0) & (F.col("attempt") == 1)) | (F.col("page") % 35 == 0)
    return rows.select(
        "job", "page", "attempt", F.when(~failed, "<doctag></doctag>").alias("raw"), F.array(F.lit(1).cast("long")).alias("token_ids"),
        F.when(~failed, "eos").alias("stop_reason"), F.when(failed, "timeout").alias("error"),
    )


@query(
    """SELECT o_custkey::VARCHAR AS job, count(*)::BIGINT AS pages, count(*) FILTER (o_orderkey % 35 = 0)::BIGINT AS failed_pages, CASE WHEN count(*) FILTER (o_orderkey % 35 = 0) > 0 THEN 'failed' ELSE 'complete' END AS status FROM orders GROUP BY 1"""
)
def q_resumed_jobs(spark, d):
    latest = jobs.latest_records(_attempts(spark, d)).withColumn("n_diagnostics", F.lit(0))
    return jobs.job_report(latest).select("job", "pages", "failed_pages", "status")


@query("SELECT o_custkey::VARCHAR AS job, max(CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE 2 END)::INTEGER AS attempt FROM orders GROUP BY 1")
def q_next_attempt(spark, d):
    return jobs.next_attempt(_attempts(spark, d))


# ------------------------------------------------- tables of runs and sources


@query(
    """WITH s AS (SELECT user_id AS run, event_id AS step, value AS loss FROM events)
    SELECT run, step, loss - lag(loss) OVER (PARTITION BY run ORDER BY step) AS change, min(loss) OVER (PARTITION BY run ORDER BY step) AS least FROM s"""
)
def q_loss_table(spark, d):
    steps = _table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("loss"))
    return score.loss_table(steps).select("run", "step", "change", "least")


@query(
    """SELECT 'recomputed' AS side, count(*)::BIGINT AS rows FROM orders WHERE o_orderkey % 40 = 0 UNION ALL SELECT 'stored', count(*) FROM orders WHERE o_orderkey % 40 = 0 OR o_orderkey % 40 = 1"""
)
def q_replay_identity(spark, d):
    rows = _table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    again = rows.where("o_orderkey % 40 <> 1").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 40 == 0, "?").otherwise(F.col("o_orderstatus")))
    return score.replay_differences(rows, again)


@query(
    """WITH f AS (SELECT 'document' AS field, md5(coalesce(text, '')) AS value FROM documents UNION ALL SELECT 'row', doc_id::VARCHAR FROM documents)
    SELECT field, value, count(*)::BIGINT AS copies FROM f GROUP BY ALL HAVING count(*) > 1"""
)
def q_repeated_fields(spark, d):
    rows = _table(spark, d, "documents").select(F.md5(F.coalesce("text", F.lit(""))).alias("document"), F.col("doc_id").alias("row"))
    return corpus.repeated_fields(rows, ["document", "row"])


@query(
    f"""WITH {_TOK}, e AS (SELECT conv_id, turn, ids, n, unnest(range(0, n)) AS position FROM s WHERE n >= 4 AND n <= 8192)
    SELECT conv_id, turn, position::INTEGER AS position, ids[position + 1]::INTEGER AS id, CASE WHEN position >= 2 THEN ids[position + 1] ELSE -100 END::INTEGER AS label, 1 AS mask FROM e"""
)
def q_accounting_export(spark, d):
    x = supervise.answer_supervision(F.col("ids"), F.lit(2), 1, 9)
    return supervise.export_rows(_tokens(spark, d).select("conv_id", "turn", x.alias("x")), ["conv_id", "turn"], "x")


@query(
    """SELECT page_id, CASE WHEN page_id % 3 <> 1 AND length('%PDF-' || page_id) + octet_length(encode(url)) <= 60 THEN sha256('%PDF-' || page_id || url) END AS sha256 FROM pages"""
)
def q_pdf_snapshot(spark, d):
    head = F.when(F.col("page_id") % 3 == 1, "%PNG-").otherwise("%PDF-")
    content = F.concat(head, F.col("page_id").cast("string"), F.col("url")).cast("binary")
    return _table(spark, d, "pages").select("page_id", F.sha2(pdf.snapshot(content, 60), 256).alias("sha256"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 <> 1 THEN (100 + p_size)::BIGINT END AS width, CASE WHEN p_partkey % 3 <> 1 THEN p_partkey END AS height FROM part")
def q_png_size(spark, d):
    size = lambda c: F.lpad(F.hex(c.cast("long")), 8, "0")
    kind = F.when(F.col("p_partkey") % 3 == 1, "0803000000").otherwise("0802000000")
    content = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), size(F.col("p_size") + 100), size(F.col("p_partkey")), kind, F.lit("00000000")))
    rows = _table(spark, d, "part").select("p_partkey", pdf.png_size(content).alias("x"))
    return rows.select("p_partkey", "x.width", "x.height")
