"""The registered queries of the engine proper and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.functions import render
from docflow.functions.doctags import parse_doctags
from docflow.operators import build, compose, corpus, geometry, jobs, score, supervise
from docflow.sources import pdf
from docflow.sources.files import stored
from docflow.sources.tables import read_table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


_table = read_table


def _parsed_documents(spark: SparkSession, d: str) -> DataFrame:
    raw = build.text_page(F.col("text"))
    return _table(spark, d, "documents").select("doc_id", "text", parse_doctags(raw).alias("parsed"))


_LINES = """
lines AS (
  SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)),
                             lambda x: regexp_matches(x, '[^ \\t\\n\\r\\f]')) AS own FROM documents)"""
_ESCAPED = r"""replace(replace(replace(regexp_replace(regexp_replace({x}, '([\\`*_{{}}\[\]()#+\-!|~=])', '\\\1', 'g'),
  '([0-9])\.', '\1\\.', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"""


def escaped_sql(x: str) -> str:
    return _ESCAPED.format(x=x)


@query(
    f"WITH {_LINES} SELECT doc_id, (i - 1)::INTEGER AS ordinal, 'text' AS kind, length(own[i])::INTEGER AS n_chars, "
    "md5(own[i]) AS text_md5 FROM (SELECT doc_id, own, unnest(range(1, len(own) + 1)) AS i FROM lines)"
)
def q_parse_elements(spark, d):
    e = F.explode("parsed.elements")
    rows = _parsed_documents(spark, d).select("doc_id", e.alias("e"))
    return rows.select("doc_id", "e.ordinal", "e.kind", F.length("e.text").alias("n_chars"), F.md5("e.text").alias("text_md5"))


@query(
    f"WITH {_LINES}, m AS (SELECT doc_id, CASE WHEN len(own) = 0 THEN '' ELSE array_to_string(list_transform(own, lambda x: "
    f"{escaped_sql('x')}), chr(10) || chr(10)) || chr(10) END AS md FROM lines) "
    "SELECT doc_id, length(md)::INTEGER AS n_chars, md5(md) AS markdown_md5 FROM m"
)
def q_markdown_page(spark, d):
    md = render.to_markdown(F.col("parsed"))
    rows = _parsed_documents(spark, d).select("doc_id", md.alias("md"))
    return rows.select("doc_id", F.length("md").alias("n_chars"), F.md5("md").alias("markdown_md5"))


@query(
    """SELECT doc_id, CASE doc_id % 8 WHEN 1 THEN 'mismatched-close,unclosed-tag' WHEN 2 THEN 'location'
    WHEN 3 THEN 'document-wrapper' WHEN 4 THEN 'outside-content' WHEN 5 THEN 'ambiguous-entity'
    WHEN 6 THEN 'unsupported-tag' WHEN 7 THEN 'generation-truncated' ELSE '' END AS codes,
    doc_id % 8 = 0 AS strict FROM documents"""
)
def q_diag_mutations(spark, d):
    rows = _table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 8).alias("m"))
    raw = (
        F.when(F.col("m") == 1, "<doctag><text>abc</doctag>")
        .when(F.col("m") == 2, "<doctag><text><loc_500><loc_1><loc_501><loc_2>abc</text></doctag>")
        .when(F.col("m") == 3, "<doctag><text>abc</text></doctag><doctag></doctag>")
        .when(F.col("m") == 4, "<doctag><text>abc</text></doctag> tail")
        .when(F.col("m") == 5, "<doctag><text>a &lt; b</text></doctag>")
        .when(F.col("m") == 6, "<doctag><marginalia>abc</marginalia></doctag>")
        .otherwise("<doctag><text>abc</text></doctag>")
    )
    stop = F.when(F.col("m") == 7, "length").otherwise("eos")
    p = rows.select("doc_id", parse_doctags(raw, stop).alias("p"))
    return p.select("doc_id", F.array_join("p.diagnostics.code", ",").alias("codes"), (F.size("p.diagnostics") == 0).alias("strict"))


def _order_tables(spark, d) -> DataFrame:
    """One table page per order: a header and a row for each line item."""
    text = lambda c: F.col(c).cast("long").cast("string")
    row = F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("q"), "l_returnflag", F.array(build.cell("fcel", text("l_linenumber")), build.cell("fcel", text("l_quantity")), build.cell("fcel", F.col("l_returnflag"))).alias("cells"))
    head = F.array(build.cell("ched", F.lit("line")), build.cell("ched", F.lit("quantity")), build.cell("ched", F.lit("flag")))
    rows = _table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    raw = build.otsl(F.concat(F.array(head), F.transform("rows", lambda r: r["cells"])))
    return rows.select("l_orderkey", raw.alias("raw"), parse_doctags(raw).alias("parsed"))


_ITEMS = """
items AS (
  SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS q, l_returnflag,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, q, l_returnflag) AS r FROM lineitem)"""


@query(
    f"""WITH {_ITEMS}
    SELECT DISTINCT l_orderkey, 0 AS r, c::INTEGER AS c, 'column-header' AS kind, t AS text
    FROM items, (VALUES (0, 'line'), (1, 'quantity'), (2, 'flag')) AS h(c, t)
    UNION ALL SELECT l_orderkey, r::INTEGER, 0, 'data', l_linenumber::VARCHAR FROM items
    UNION ALL SELECT l_orderkey, r::INTEGER, 1, 'data', q::VARCHAR FROM items
    UNION ALL SELECT l_orderkey, r::INTEGER, 2, 'data', l_returnflag FROM items"""
)
def q_otsl_cells(spark, d):
    cells = _order_tables(spark, d).select("l_orderkey", F.explode("parsed.cells").alias("x"))
    return cells.select("l_orderkey", "x.r", "x.c", "x.kind", "x.text")


@query(
    f"""WITH {_ITEMS}
    SELECT l_orderkey, md5('| line | quantity | flag |' || chr(10) || '| --- | --- | --- |' || chr(10) ||
      string_agg('| ' || l_linenumber || ' | ' || q || ' | ' || l_returnflag || ' |', chr(10) ORDER BY r) || chr(10)) AS markdown_md5
    FROM items GROUP BY l_orderkey"""
)
def q_table_markdown(spark, d):
    return _order_tables(spark, d).select("l_orderkey", F.md5(render.to_markdown(F.col("parsed"))).alias("markdown_md5"))


@query(
    f"""WITH {_ITEMS}, n AS (SELECT l_orderkey, count(*) AS k FROM items GROUP BY l_orderkey)
    SELECT l_orderkey, md5(CASE WHEN k > 1 THEN '<table>' || chr(10) ||
      string_agg('<tr>' || CASE WHEN r = 1 THEN '<td rowspan="' || k || '">' || l_orderkey || '</td>' ELSE '' END ||
        '<td>' || l_linenumber || '</td></tr>' || chr(10), '' ORDER BY r) || '</table>' || chr(10)
      ELSE '|  |  |' || chr(10) || '| --- | --- |' || chr(10) || max('| ' || l_orderkey || ' | ' || l_linenumber || ' |') || chr(10) END) AS html_md5
    FROM items JOIN n USING (l_orderkey) GROUP BY l_orderkey, k"""
)
def q_table_merged_html(spark, d):
    rows = _table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("lines"))
    first = F.transform(
        "lines",
        lambda n, i: F.array(
            F.when(i == 0, build.cell("fcel", F.col("l_orderkey"))).otherwise(build.cell("ucel")), build.cell("fcel", n)
        ),
    )
    parsed = rows.select("l_orderkey", build.otsl(first).alias("raw")).select("l_orderkey", parse_doctags(F.col("raw")).alias("parsed"))
    return parsed.select("l_orderkey", F.md5(render.to_markdown(F.col("parsed"))).alias("html_md5"))


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' ELSE 'table-header' END AS codes, p_partkey % 4 = 0 AS renderable FROM part"""
)
def q_header_policy(spark, d):
    rows = _table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 4).alias("m"), F.col("p_size").cast("string").alias("s"))
    body = (
        F.when(F.col("m") == 0, F.concat(F.lit("<ched>a<ched>b<nl><fcel>x<fcel>"), "s", F.lit("<nl>")))
        .when(F.col("m") == 1, F.concat(F.lit("<fcel>x<fcel>"), "s", F.lit("<nl><ched>a<ched>b<nl>")))
        .when(F.col("m") == 2, F.concat(F.lit("<ched>a<ched>b<nl><rhed>x<fcel>"), "s", F.lit("<nl>")))
        .otherwise(F.concat(F.lit("<ched>a<ched>b<nl><ucel><fcel>"), "s", F.lit("<nl>")))
    )
    p = rows.select("p_partkey", parse_doctags(build.page(F.concat(F.lit("<otsl>"), body, F.lit("</otsl>")))).alias("p"))
    return p.select(
        "p_partkey", F.array_join("p.diagnostics.code", ",").alias("codes"), F.get("p.tables", F.lit(0))["renderable"].alias("renderable")
    )


@query(
    """WITH b AS (SELECT p_partkey, p_size AS l, p_size + 10 AS t, p_size + 100 AS r, p_size + 60 AS bt, (p_partkey % 40)::INTEGER AS s FROM part)
    SELECT p_partkey, floor(l * 1600 / 500)::INTEGER AS crop_left, floor(bt * 900 / 500)::INTEGER AS crop_bottom,
    ((100 - s) * (50 - least(s, 50)))::DOUBLE / (10000 - (100 - s) * (50 - least(s, 50))) AS iou FROM b"""
)
def q_picture_boxes(spark, d):
    box = lambda s: F.struct((F.col("p_size") + s).alias("l"), (F.col("p_size") + 10 + s).alias("t"), (F.col("p_size") + 100 + s).alias("r"), (F.col("p_size") + 60 + s).alias("b"))
    shift = (F.col("p_partkey") % 40).cast("int")
    return _table(spark, d, "part").select(
        "p_partkey",
        geometry.crop(F.col("p_size"), F.lit(1600)).alias("crop_left"),
        geometry.crop(F.col("p_size") + 60, F.lit(900)).alias("crop_bottom"),
        score.box_iou(box(0), box(shift)).alias("iou"),
    )


def _customer_pages(spark, d) -> DataFrame:
    """Orders as pages of their customer's document, numbered in key order; every 50th order has a bad page."""
    from pyspark.sql import Window

    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = _table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(order).alias("page"), "o_orderstatus")
    text = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" is "), "o_orderstatus")
    raw = F.when(F.col("o_orderkey") % 50 == 0, F.concat(F.lit("<doctag><text>"), text, F.lit("</doctag>"))).otherwise(build.page(build.leaf("text", text)))
    return rows.select("o_custkey", "page", F.col("page").alias("position"), raw.alias("raw"), F.lit("eos").alias("stop_reason"), parse_doctags(raw).alias("parsed"))


_PAGES = """
p AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderkey % 50 = 0 AS bad,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page FROM orders)"""


@query(
    f"""WITH {_PAGES}
    SELECT o_custkey, CASE WHEN bool_or(bad) THEN 'blocked' ELSE 'complete' END AS status, count(*)::BIGINT AS n_pages,
      count(*) FILTER (bad)::BIGINT AS failed_pages,
      CASE WHEN NOT bool_or(bad) THEN md5(string_agg('# Page ' || page || chr(10) || chr(10) || 'order ' || o_orderkey || ' is ' || o_orderstatus || chr(10),
        chr(10) || '---' || chr(10) || chr(10) ORDER BY page)) END AS markdown_md5
    FROM p GROUP BY o_custkey"""
)
def q_multipage(spark, d):
    whole = compose.compose(_customer_pages(spark, d), "o_custkey", "page")
    return whole.select("o_custkey", "status", "n_pages", "failed_pages", F.md5("markdown").alias("markdown_md5"))


@query(
    f"""WITH {_PAGES}, s AS (SELECT o_custkey, bool_or(bad) AS blocked, count(*) AS n FROM p GROUP BY o_custkey)
    SELECT CASE WHEN blocked THEN 'blocked' ELSE 'complete' END AS status, count(*)::BIGINT AS documents,
      sum(2 * n + 1 + CASE WHEN blocked THEN 0 ELSE 1 END)::BIGINT AS artifacts FROM s GROUP BY 1"""
)
def q_bundle_status(spark, d):
    pages = stored(_customer_pages(spark, d))  # read from several sides
    whole = compose.compose(pages, "o_custkey", "page")
    files = compose.bundle_artifacts(pages, whole, "o_custkey", "page").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return whole.join(files, "o_custkey").groupBy("status").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("artifacts"))


_AUDIT = r"""
a AS (SELECT page_id, sha256(html) AS sha256, length(html)::INTEGER AS characters,
      list_sort(list_distinct(list_filter(regexp_extract_all(html, '</?([^<>]+)>', 1), lambda t: NOT starts_with(t, 'loc_')))) AS tags FROM pages)"""


@query(f"WITH {_AUDIT} SELECT page_id, sha256, characters, array_to_string(tags, ',') AS tags FROM a")
def q_label_audit(spark, d):
    rows = _table(spark, d, "pages").select("page_id", corpus.inspect_label(F.col("html")).alias("x"))
    return rows.select("page_id", "x.sha256", "x.characters", F.array_join("x.tags", ",").alias("tags"))


@query(
    f"""WITH {_AUDIT} SELECT count(*)::BIGINT AS labels, count(DISTINCT sha256)::BIGINT AS contents, count(*) FILTER (characters > 3000)::BIGINT AS long_labels,
    min(characters)::INTEGER AS least, max(characters)::INTEGER AS most FROM a"""
)
def q_audit_summary(spark, d):
    x = _table(spark, d, "pages").select(corpus.inspect_label(F.col("html")).alias("x"))
    n = F.col("x.characters")
    return x.agg(
        F.count(F.lit(1)).alias("labels"), F.count_distinct("x.sha256").alias("contents"), F.count_if(n > 3000).alias("long_labels"), F.min(n).alias("least"), F.max(n).alias("most")
    )


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 20")
def q_select_first_en(spark, d):
    return corpus.first_rows(_table(spark, d, "documents").where("lang = 'en'"), "doc_id", 20).select("doc_id", "n_chars")


_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def normalized_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'), ' ')"


@query(
    f"""SELECT sha256({normalized_sql("coalesce(text, '')")}) AS fingerprint, count(*)::BIGINT AS copies, min(doc_id) AS first_doc
    FROM documents GROUP BY 1 HAVING count(*) > 1"""
)
def q_fingerprint_dups(spark, d):
    rows = _table(spark, d, "documents").select("doc_id", corpus.fingerprint(F.coalesce("text", F.lit(""))).alias("fingerprint"))
    return rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query("SELECT page_id, 'doc_' || sha1(url) AS source_id, regexp_matches(url, '^https?://[^/?#\\s]+') AS web FROM pages")
def q_source_ids(spark, d):
    return _table(spark, d, "pages").select("page_id", corpus.source_id(F.col("url")).alias("source_id"), F.col("url").rlike(r"\Ahttps?://[^/?#\s]+").alias("web"))


def _candidates(spark, d):
    docs = _table(spark, d, "documents").join(_table(spark, d, "labels"), "doc_id", "left")
    md = F.md5(F.coalesce("text", F.lit("")))
    return docs.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("s"), (F.col("doc_id") % 5000).cast("string")).alias("source_id"),
        F.when(F.col("doc_id") % 10 == 0, "final").when(F.col("doc_id") % 10 == 1, "validation").otherwise("train").alias("split"),
        F.concat(F.lit("i"), F.col("doc_id").cast("string")).alias("image"),
        md.alias("target"),
        corpus.fingerprint(F.coalesce("text", F.lit(""))).alias("content"),
        (F.coalesce("quality", F.lit(1)) == 1).alias("renderable"),
        F.when(F.coalesce("quality", F.lit(1)) == 1, md).alias("approved_target"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic"),
    )


def _judged(spark, d):
    pages = _candidates(spark, d)
    sources = pages.groupBy("source_id").agg(
        F.lit(True).alias("allowed"), F.lit(True).alias("reviewed"), F.bool_or("toxic").alias("quarantined"), F.bool_or(F.col("id") % 97 == 0).alias("development")
    )
    return corpus.evaluate_candidates(pages, sources)


_PREFLIGHT = f"""
c AS (SELECT d.doc_id AS id, 's' || (d.doc_id % 5000) AS source_id,
      CASE WHEN d.doc_id % 10 = 0 THEN 'final' WHEN d.doc_id % 10 = 1 THEN 'validation' ELSE 'train' END AS split,
      md5(coalesce(text, '')) AS target, sha256({normalized_sql("coalesce(text, '')")}) AS content,
      coalesce(quality, 1) = 1 AS renderable, coalesce(toxic, 0) = 1 AS toxic FROM documents d LEFT JOIN labels USING (doc_id)),
k AS (SELECT id, 's:' || source_id AS v FROM c UNION ALL SELECT id, 't:' || target FROM c UNION ALL SELECT id, 'c:' || content FROM c),
e AS (SELECT DISTINCT a.id AS x, b.id AS y FROM k a JOIN k b USING (v)),
r AS (SELECT id AS x, id AS y FROM c UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
comp AS (SELECT x AS id, min(y) AS component FROM r GROUP BY x),
src AS (SELECT source_id, bool_or(toxic) AS quarantined, bool_or(id % 97 = 0) AS development FROM c GROUP BY source_id),
j AS (SELECT c.*, component, quarantined, development, count(*) OVER (PARTITION BY target) AS nt, count(*) OVER (PARTITION BY content) AS nc
      FROM c JOIN comp USING (id) JOIN src USING (source_id)),
w AS (SELECT component, min(split) <> max(split) AS crosses, bool_or(quarantined) AS q, bool_or(development) AS d FROM j GROUP BY component),
f AS (SELECT id, component, list_filter([CASE WHEN quarantined THEN 'quarantined-source' WHEN q THEN 'quarantined-component' END,
      CASE WHEN NOT renderable THEN 'target-not-reviewed' END, CASE WHEN NOT renderable THEN 'native-target-rejected' END,
      CASE WHEN crosses THEN 'cross-split-component' END, CASE WHEN d AND split = 'final' THEN 'development-source-in-final' END,
      CASE WHEN nt > 1 OR nc > 1 THEN 'duplicate-page' END], lambda x: x IS NOT NULL) AS reasons FROM j JOIN w USING (component))"""


@query(f"WITH RECURSIVE {_PREFLIGHT} SELECT id, component, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS eligible FROM f")
def q_preflight(spark, d):
    return _judged(spark, d).select("id", "component", F.array_join("reasons", ",").alias("reasons"), "eligible")


@query(f"WITH RECURSIVE {_PREFLIGHT} SELECT reason, count(*)::BIGINT AS n FROM (SELECT unnest(reasons) AS reason FROM f) GROUP BY reason")
def q_reason_hist(spark, d):
    return corpus.reason_counts(_judged(spark, d))


@query(
    """WITH t AS (SELECT md5(coalesce(text, '')) AS v FROM documents WHERE source <> 'src0'), o AS (SELECT md5(coalesce(text, '')) AS v FROM documents WHERE source = 'src0')
    SELECT 'target' AS key, v AS value, 'shared' AS problem FROM (SELECT DISTINCT v FROM t) WHERE v IN (SELECT v FROM o)
    UNION ALL SELECT 'target', v, 'repeated' FROM t GROUP BY v HAVING count(*) > 1"""
)
def q_isolation(spark, d):
    rows = _table(spark, d, "documents").select("source", F.md5(F.coalesce("text", F.lit(""))).alias("target"))
    return corpus.isolation(rows.where("source <> 'src0'"), rows.where("source = 'src0'"), "target")


@query(
    """SELECT conv_id, turn, CASE WHEN conv_id % 10 < 8 THEN 'train' WHEN conv_id % 10 = 8 THEN 'validation' ELSE 'final' END AS split,
    CASE WHEN conv_id % 10 < 8 THEN text END AS answer FROM conversations"""
)
def q_label_withhold(spark, d):
    m = F.col("conv_id") % 10
    split = F.when(m < 8, "train").when(m == 8, "validation").otherwise("final")
    return _table(spark, d, "conversations").select("conv_id", "turn", split.alias("split"), F.when(split == "train", F.col("text")).alias("answer"))


@query(
    """WITH b AS (SELECT p_partkey, 100 + (p_partkey % 900)::INTEGER AS w, (p_partkey % 100)::INTEGER AS l, (p_partkey % 100)::INTEGER + p_size AS r FROM part)
    SELECT p_partkey, CASE WHEN r <= w THEN least(499, round_even(500.0::DOUBLE * (l::DOUBLE / w), 0))::INTEGER END AS grid_left,
    CASE WHEN r <= w THEN least(499, round_even(500.0::DOUBLE * (r::DOUBLE / w), 0))::INTEGER END AS grid_right FROM b"""
)
def q_pixel_to_grid(spark, d):
    w, left = F.lit(100) + (F.col("p_partkey") % 900).cast("int"), (F.col("p_partkey") % 100).cast("int")
    box = geometry.box_to_grid(left, F.lit(0), left + F.col("p_size"), F.lit(10), w, F.lit(20))
    return _table(spark, d, "part").select("p_partkey", F.get(box, F.lit(0)).alias("grid_left"), F.get(box, F.lit(2)).alias("grid_right"))


_PLAN = """
s AS (SELECT p_partkey, 200 + (p_partkey * 37 % 3000)::INTEGER AS h, 200 + (p_partkey * 91 % 3000)::INTEGER AS w FROM part),
a AS (SELECT *, CASE WHEN w >= h THEN 2048 ELSE floor(2048::DOUBLE * (w::DOUBLE / h))::INTEGER END AS wa,
      CASE WHEN w >= h THEN floor(2048::DOUBLE / (w::DOUBLE / h))::INTEGER ELSE 2048 END AS ha FROM s),
b AS (SELECT p_partkey, greatest(1, CASE WHEN wa = 2048 THEN ha + ha % 2 ELSE ha END) AS h1, greatest(1, CASE WHEN wa = 2048 THEN wa ELSE wa + wa % 2 END) AS w1 FROM a),
c AS (SELECT *, (512 * ceil(w1 / 512.0))::INTEGER AS uw, (512 * ceil(h1 / 512.0))::INTEGER AS uh, w1::DOUBLE / h1 AS ratio FROM b),
p AS (SELECT p_partkey, h1, w1, CASE WHEN w1 >= h1 THEN (512 * ceil(floor(uw / ratio) / 512))::INTEGER ELSE uh END AS h2,
      CASE WHEN w1 >= h1 THEN uw ELSE (512 * ceil(floor(uh * ratio) / 512))::INTEGER END AS w2 FROM c),
q AS (SELECT *, CASE WHEN h2 > 512 OR w2 > 512 THEN h2 // 512 ELSE 0 END::INTEGER AS rows, CASE WHEN h2 > 512 OR w2 > 512 THEN w2 // 512 ELSE 0 END::INTEGER AS cols FROM p)"""


def _plans(spark, d):
    h, w = F.lit(200) + (F.col("p_partkey") * 37 % 3000).cast("int"), F.lit(200) + (F.col("p_partkey") * 91 % 3000).cast("int")
    return _table(spark, d, "part").select("p_partkey", geometry.resize_plan(h, w).alias("plan"))


@query(f"WITH {_PLAN} SELECT p_partkey, h1::INTEGER AS h1, w1::INTEGER AS w1, h2, w2, rows, cols FROM q")
def q_resize_plan(spark, d):
    return _plans(spark, d).select("p_partkey", "plan.*")


@query(
    f"""WITH {_PLAN} SELECT p_partkey, md5(CASE WHEN rows > 0 THEN array_to_string(list_transform(range(1, rows + 1), lambda r: array_to_string(list_transform(range(1, cols + 1),
    lambda c: '<fake_token_around_image><row_' || r || '_col_' || c || '>' || repeat('<image>', 64)), '') || chr(10)), '') || chr(10) ELSE '' END
    || '<fake_token_around_image><global-img>' || repeat('<image>', 64) || '<fake_token_around_image>') AS prompt_md5 FROM q"""
)
def q_image_prompt(spark, d):
    return _plans(spark, d).select("p_partkey", F.md5(geometry.image_prompt(F.col("plan.rows"), F.col("plan.cols"))).alias("prompt_md5"))


def _places_sql(places: str) -> str:
    return f"SELECT vec_id, array_to_string(list_transform({places}, lambda i: round(embedding[i + 1]::DOUBLE, 4)::DECIMAL(9, 4)::VARCHAR), ',') AS vals FROM embeddings"


_PATCH_PLACES = str([y * 16 + dy * 8 + x * 2 + dx for y in range(4) for x in range(4) for dy in range(2) for dx in range(2)])
_SHUFFLE_PLACES = str([((y * 2 + dy) * 4 + x * 2 + dx) * 4 + c for y in range(2) for x in range(2) for dy in range(2) for dx in range(2) for c in range(4)])


def _listed(values):
    return F.array_join(F.transform(values, lambda v: F.round(v.cast("double"), 4).cast("decimal(9,4)").cast("string")), ",").alias("vals")


@query(_places_sql(_PATCH_PLACES))
def q_patchify(spark, d):
    return _table(spark, d, "embeddings").select("vec_id", _listed(geometry.patchify(F.col("embedding"), 1, 8, 8, 2)))


@query(_places_sql(_SHUFFLE_PLACES))
def q_pixel_shuffle(spark, d):
    return _table(spark, d, "embeddings").select("vec_id", _listed(geometry.pixel_shuffle(F.col("embedding"), 4, 4, 2)))


def _tokens(spark, d):
    """Word lengths as token ids after two image slots (id 9), closed by id 1; ids start at 10."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), " ", -1), lambda w: F.length(w) > 0)
    ids = F.concat(F.array(F.lit(9), F.lit(9)), F.transform(words, lambda w: F.length(w) + 9), F.array(F.lit(1)))
    return _table(spark, d, "conversations").select("conv_id", "turn", ids.alias("ids"))


_TOK = """
t AS (SELECT conv_id, turn, list_concat([9, 9], list_concat(list_transform(list_filter(string_split(coalesce(text, ''), ' '), lambda w: length(w) > 0),
      lambda w: length(w) + 9), [1])) AS ids FROM conversations),
s AS (SELECT *, len(ids) AS n FROM t)"""


@query(
    f"""WITH {_TOK} SELECT conv_id, turn, CASE WHEN n >= 4 AND n <= 8192 THEN array_to_string(list_concat(ids, [1, 1]), ' ') END AS ids,
    CASE WHEN n >= 4 AND n <= 8192 THEN array_to_string(list_concat(list_transform(ids, lambda x, i: CASE WHEN i > 2 THEN x ELSE -100 END), [-100, -100]), ' ') END AS labels,
    CASE WHEN n >= 4 AND n <= 8192 THEN (n)::BIGINT END AS mask_sum FROM s"""
)
def q_supervision(spark, d):
    x = supervise.answer_supervision(F.col("ids"), F.lit(2), 1, 9, F.size("ids") + 2)
    rows = _tokens(spark, d).select("conv_id", "turn", x.alias("x"))
    return rows.select(
        "conv_id",
        "turn",
        F.array_join(F.col("x.ids").cast("array<string>"), " ").alias("ids"),
        F.array_join(F.col("x.labels").cast("array<string>"), " ").alias("labels"),
        F.aggregate("x.mask", F.lit(0).cast("long"), lambda a, b: a + b).alias("mask_sum"),
    )


@query(
    f"""WITH {_TOK} SELECT conv_id, turn, n::INTEGER AS sequence_tokens, 2 AS prompt_tokens, (n - 2)::INTEGER AS supervised_tokens, 2 AS image_tokens,
    (8192 - n)::INTEGER AS context_remaining FROM s WHERE n >= 4 AND n <= 8192"""
)
def q_token_accounting(spark, d):
    x = supervise.answer_supervision(F.col("ids"), F.lit(2), 1, 9)
    rows = _tokens(spark, d).select("conv_id", "turn", x.alias("x")).where("x IS NOT NULL")
    return rows.select("conv_id", "turn", supervise.accounting(F.col("x"), F.lit(2), 9).alias("a")).select("conv_id", "turn", "a.*")


@query(
    f"""WITH {_TOK}, w AS (SELECT conv_id, turn, list_filter(range(0, n), lambda i: ids[i + 1] = 12) AS places FROM s)
    SELECT conv_id, turn, CASE WHEN turn % 3 <> 2 THEN array_to_string(list_transform(places, lambda p, i: p || ':' || (100 + i - 1)), ',') END AS slots FROM w"""
)
def q_image_slot_rank(spark, d):
    """Words of three letters stand for image slots; every third turn has a feature too many."""
    rows = _tokens(spark, d).withColumn("n", F.size(F.filter("ids", lambda t: t == 12)) + (F.col("turn") % 3 == 2).cast("int"))
    features = F.transform(F.slice(F.sequence(F.lit(0), F.col("n")), F.lit(1), F.col("n")), lambda i: i + 100)
    merged = supervise.merge_slots(F.col("ids"), 12, features)
    placed = F.filter(F.transform(merged, lambda f, i: F.concat_ws(":", i, f)), lambda x: F.contains(x, F.lit(":")))
    return rows.select("conv_id", "turn", F.when(merged.isNotNull(), F.array_join(placed, ",")).alias("slots"))


def _scored(spark, d):
    """Each document against a copy without its letter e; every 10th page fails, every 7th has no reference."""
    text = F.coalesce("text", F.lit(""))
    rows = _table(spark, d, "documents", 500).select(
        F.col("doc_id"),
        F.col("lang").alias("split"),
        F.when((F.col("doc_id") % 7 != 0) & (F.length(corpus.normalized(text)) > 0), text).alias("reference"),
        F.replace(text, F.lit("e"), F.lit("")).alias("markdown"),
        F.when(F.col("doc_id") % 10 == 0, "length").otherwise("eos").alias("stop_reason"),
        F.lit(0).alias("n_diagnostics"),
        F.lit(None).cast("string").alias("error"),
    )
    return score.score_cases(rows)


# what is left of a text is a subsequence of it, so the distance is the difference of the lengths
_CER = f"""
l AS (SELECT doc_id, lang AS split, {normalized_sql("coalesce(text, '')")} AS line, {normalized_sql("replace(coalesce(text, ''), 'e', '')")} AS cut FROM documents),
x AS (SELECT doc_id, split, doc_id % 10 <> 0 AS strict, CASE WHEN doc_id % 7 <> 0 AND length(line) > 0 THEN line END AS expected,
      CASE WHEN doc_id % 10 <> 0 THEN cut ELSE '' END AS actual FROM l),
y AS (SELECT *, length(expected) - length(actual) AS e FROM x)"""


@query(
    f"""WITH {_CER} SELECT doc_id, strict, CASE WHEN expected IS NOT NULL THEN e::BIGINT END AS character_edits,
    length(expected)::BIGINT AS reference_characters, CASE WHEN expected IS NOT NULL THEN strict AND expected = actual END AS accepted FROM y"""
)
def q_cer(spark, d):
    return _scored(spark, d).select("doc_id", "strict", "character_edits", "reference_characters", "accepted")


@query(None)
def q_wer_micro(spark, d):
    return score.summarize(_scored(spark, d)).select("split", "word_edits", "reference_words", "wer")


@query(
    f"""WITH {_CER} SELECT split, count(*)::BIGINT AS pages, count(expected)::BIGINT AS reviewed, count(*) FILTER (strict)::BIGINT AS strict_exports,
    count(*) FILTER (strict AND expected = actual)::BIGINT AS accepted, sum(e)::BIGINT AS character_edits, sum(length(expected))::BIGINT AS reference_characters,
    sum(e)::DOUBLE / sum(length(expected)) AS cer FROM y GROUP BY split"""
)
def q_summary_by_split(spark, d):
    return score.summarize(_scored(spark, d)).drop("word_edits", "reference_words", "wer")


@query(
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS q, l_returnflag AS f FROM lineitem),
    b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN q + 1 ELSE q END AS q, f FROM a),
    x AS (SELECT l_orderkey, l_linenumber, q, f, count(*) AS n FROM a GROUP BY ALL), y AS (SELECT l_orderkey, l_linenumber, q, f, count(*) AS m FROM b GROUP BY ALL)
    SELECT l_orderkey, sum(coalesce(n, 0))::BIGINT AS n_left, sum(coalesce(m, 0))::BIGINT AS n_right, sum(least(coalesce(n, 0), coalesce(m, 0)))::BIGINT AS matches
    FROM x FULL JOIN y USING (l_orderkey, l_linenumber, q, f) GROUP BY l_orderkey"""
)
def q_table_score(spark, d):
    a = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"), F.col("l_returnflag").alias("f"))
    b = a.withColumn("q", F.when(F.col("l_linenumber") % 3 == 0, F.col("q") + 1).otherwise(F.col("q")))
    return score.multiset_overlap(a, b, ["l_linenumber", "q", "f"], ["l_orderkey"])


@query(
    """WITH a AS (SELECT lang, unnest(string_split_regex(trim(lower(coalesce(text, ''))), ' +')) AS w FROM documents),
    b AS (SELECT unnest(string_split_regex(trim(lower(text)), ' +')) AS w FROM benchmark),
    x AS (SELECT lang, w, count(*) AS n FROM a WHERE w <> '' GROUP BY ALL), y AS (SELECT w, count(*) AS m FROM b WHERE w <> '' GROUP BY ALL)
    SELECT lang, sum(least(n, m))::BIGINT AS matches FROM x JOIN y USING (w) GROUP BY lang"""
)
def q_word_inventory(spark, d):
    words = lambda c: F.explode(F.split(F.trim(F.lower(F.coalesce(c, F.lit("")))), " +", -1)).alias("w")
    a = _table(spark, d, "documents").select("lang", words("text")).where("w <> ''").groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    b = _table(spark, d, "benchmark").select(words("text")).where("w <> ''").groupBy("w").agg(F.count(F.lit(1)).alias("m"))
    return a.join(b, "w").groupBy("lang").agg(F.sum(F.least("n", "m")).alias("matches"))


@query(
    """WITH s AS (SELECT user_id % 10 AS step, count(*) FILTER (value > 50)::BIGINT AS accepted, count(*)::BIGINT AS cells FROM events GROUP BY 1)
    SELECT step, accepted, cells FROM s ORDER BY accepted DESC, cells DESC, step LIMIT 1"""
)
def q_select_candidate(spark, d):
    rows = _table(spark, d, "events").select((F.col("user_id") % 10).alias("step"), F.when(F.col("value") > 50, 1).otherwise(0).alias("accepted"), F.lit(1).alias("cells"))
    return score.choose_candidate(rows)


@query(
    """SELECT event_type AS stage, count(*)::BIGINT AS samples, median(value) AS median, min(value) AS least, max(value) AS most
    FROM events WHERE value >= 0 GROUP BY 1"""
)
def q_stage_summary(spark, d):
    return score.timing_summary(_table(spark, d, "events").withColumnRenamed("event_type", "stage"), "stage", value="value")


@query(
    """WITH s AS (SELECT user_id % 100 AS run, row_number() OVER (PARTITION BY user_id % 100 ORDER BY event_id) + CASE WHEN user_id % 100 = 7 AND event_id % 11 = 0 THEN 1 ELSE 0 END AS step FROM events),
    g AS (SELECT run, step = coalesce(lag(step) OVER (PARTITION BY run ORDER BY step), 0) + 1 AS ok FROM s)
    SELECT run, bool_and(ok) AS contiguous, count(*)::BIGINT AS steps FROM g GROUP BY run"""
)
def q_checkpoint_steps(spark, d):
    from pyspark.sql import Window

    run = F.col("user_id") % 100
    place = F.row_number().over(Window.partitionBy(run).orderBy("event_id"))
    step = place + F.when((run == 7) & (F.col("event_id") % 11 == 0), 1).otherwise(0)
    return score.contiguous_steps(_table(spark, d, "events").select(run.alias("run"), step.alias("step")), "run", "step")


def _journal(spark, d):
    rows = _table(spark, d, "orders")
    return rows.where("o_orderkey % 3 <> 0").select(
        F.col("o_custkey").cast("string").alias("job"),
        F.col("o_orderkey").alias("page"),
        F.lit("<doctag></doctag>").alias("raw"),
        F.array(F.lit(1).cast("long")).alias("token_ids"),
        F.lit("eos").alias("stop_reason"),
        F.when(F.col("o_orderkey") % 5 == 0, "timeout").alias("error"),
    )


@query("SELECT o_custkey::VARCHAR AS job, o_orderkey AS page FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0")
def q_resume_plan(spark, d):
    pages = _table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("job"), F.col("o_orderkey").alias("page"))
    return jobs.missing_pages(pages, _journal(spark, d))


@query(
    """SELECT o_custkey::VARCHAR AS job, count(*)::BIGINT AS pages, count(*) FILTER (o_orderkey % 5 = 0)::BIGINT AS failed_pages, count(*) FILTER (o_orderkey % 7 = 0)::BIGINT AS noted_pages,
    CASE WHEN count(*) FILTER (o_orderkey % 5 = 0) > 0 THEN 'failed' WHEN count(*) FILTER (o_orderkey % 7 = 0) > 0 THEN 'blocked' ELSE 'complete' END AS status
    FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1"""
)
def q_job_report(spark, d):
    return jobs.job_report(_journal(spark, d).withColumn("n_diagnostics", F.when(F.col("page") % 7 == 0, 1).otherwise(0)))


@query(
    """WITH a AS (SELECT doc_id::VARCHAR AS name, sha256(coalesce(text, '')) AS x FROM documents WHERE doc_id % 11 <> 0),
    b AS (SELECT doc_id::VARCHAR AS name, sha256(coalesce(text, '') || CASE WHEN doc_id % 13 = 0 THEN '!' ELSE '' END) AS y FROM documents WHERE doc_id % 17 <> 0)
    SELECT name, CASE WHEN y IS NULL THEN 'missing' WHEN x IS NULL THEN 'extra' WHEN x <> y THEN 'changed' ELSE 'same' END AS state FROM a FULL JOIN b USING (name)"""
)
def q_manifest_diff(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    name = F.col("doc_id").cast("string").alias("name")
    a = docs.where("doc_id % 11 <> 0").select(name, F.sha2("text", 256).alias("sha256"))
    changed = F.concat("text", F.when(F.col("doc_id") % 13 == 0, "!").otherwise(""))
    return corpus.manifest_diff(a, docs.where("doc_id % 17 <> 0").select(name, F.sha2(changed, 256).alias("sha256")))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 4 <> 3 THEN (100 + p_size) END::INTEGER AS width_points,
    CASE WHEN p_partkey % 4 <> 3 THEN ceil((100 + p_size) * 150 / 72.0)::INTEGER END AS width_pixels, CASE WHEN p_partkey % 4 <> 3 THEN ((p_partkey % 4) * 90)::INTEGER END AS rotation FROM part"""
)
def q_pdf_geometry(spark, d):
    size, m = (F.col("p_size") + 100).cast("string"), F.col("p_partkey") % 4
    label = F.when(F.col("p_partkey") % 2 == 0, " (A4)").otherwise("")
    text = F.concat(F.lit("Pages: 9\nPage    1 size: "), size, F.lit(" x 200.5 pts"), label, F.lit("\nPage    1 rot:  "), F.when(m == 3, "45").otherwise((m * 90).cast("string")), F.lit("\n"))
    g = _table(spark, d, "part").select("p_partkey", pdf.page_geometry(text, 1).alias("g"))
    return g.select("p_partkey", F.col("g.width").cast("int").alias("width_points"), pdf.raster_size(F.col("g.width"), 150).alias("width_pixels"), F.col("g.rotation").alias("rotation"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size || ',' || (p_size + 2) || ',' || (p_size + 3) WHEN p_partkey % 3 = 1 THEN p_size::VARCHAR END AS pages FROM part"""
)
def q_page_selection(spark, d):
    s, m = F.col("p_size"), F.col("p_partkey") % 3
    text = (
        F.when(m == 0, F.concat(s.cast("string"), F.lit(","), (s + 2).cast("string"), F.lit("-"), (s + 3).cast("string")))
        .when(m == 1, s.cast("string"))
        .otherwise(F.concat((s + 1).cast("string"), F.lit(","), s.cast("string")))
    )
    return _table(spark, d, "part").select("p_partkey", F.array_join(pdf.page_selection(text).cast("array<string>"), ",").alias("pages"))


from docflow.plans import evidence, integrity, pictures, replays, reviews  # noqa: E402, F401  register their queries
