"""Registered queries of strict JSON, inventories, relocation and tensor files, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docflow.functions import strictjson
from docflow.operators import inventory
from docflow.plans.catalogue import _table, query
from docflow.sources import tensors
from docflow.sources.files import shared_folder

# -------------------------------------------------------------- strict JSON


@query(
    """WITH t AS (SELECT event_id, event_id % 5 AS turn, props ->> '$.k' AS k, event_type AS e, user_id AS u FROM events)
    SELECT event_id, CASE WHEN turn IN (0, 4) THEN k::BIGINT END AS k, turn = 3 AS k_is_text,
    CASE turn WHEN 0 THEN '{"k":' || k || '}' WHEN 3 THEN '{"k":"' || k || '"}' WHEN 4 THEN '{"a":{"e":"' || e || '","u":' || u || '},"k":' || k || '}' END AS canonical FROM t"""
)
def q_strict_json(spark, d):
    """By turn: as stored, a repeated key, more text behind the value, a number as text, keys in another order."""
    turn, k = F.col("event_id") % 5, F.get_json_object("props", "$.k")
    text = (
        F.when(turn == 0, F.col("props")).when(turn == 1, F.format_string('{"k": %s, "x": 1, "k": %s}', k, k)).when(turn == 2, F.concat("props", F.lit(", 1")))
        .when(turn == 3, F.format_string(' {"k" : "%s"} ', k))
        .otherwise(F.format_string('{"k": %s, "a": {"u": %s, "e": "%s"}}', k, F.col("user_id").cast("string"), "event_type"))
    )
    rows = _table(spark, d, "events").select("event_id", strictjson.parsed(text).alias("v"))
    kind = strictjson.is_kind(strictjson.field(F.col("v"), "k"), "string")
    return rows.select("event_id", strictjson.typed(F.col("v"), "k", "integer").alias("k"), kind.alias("k_is_text"), strictjson.canonical(F.col("v")).alias("canonical"))


# -------------------------------------------------------------- inventories


def _inventories(spark, d):
    """The documents as files of lang/source folders, and as they are found later: changed, gone, linked, and more of them."""
    text = F.coalesce("text", F.lit(""))
    rows = _table(spark, d, "documents").select(
        "doc_id", F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
        F.lit("file").alias("kind"), F.octet_length(text).cast("long").alias("bytes"), F.sha2(text, 256).alias("sha256"),
    )
    few = F.col("doc_id") % 40
    later = rows.where(few != 11).withColumns({
        "kind": F.when(few == 12, "link").otherwise(F.col("kind")),
        "bytes": F.when(few == 12, F.lit(None)).otherwise(F.col("bytes")),
        "sha256": F.when(few == 12, F.lit(None)).when(few == 13, F.sha2("sha256", 256)).otherwise(F.col("sha256")),
    })
    more = rows.where(few == 14).withColumn("path", F.concat(F.lit("new/"), "path"))
    columns = ("path", "kind", "bytes", "sha256")
    return rows.select(*columns), later.unionByName(more).select(*columns)


_FILES = """
f AS (SELECT doc_id, doc_id % 40 AS few, lang || '/' || source || '/' || doc_id || '.txt' AS path, strlen(coalesce(text, ''))::BIGINT AS bytes FROM documents)"""


@query(
    f"""WITH {_FILES} SELECT path, CASE few WHEN 11 THEN 'missing' WHEN 12 THEN 'linked' ELSE 'changed' END AS state FROM f WHERE few IN (11, 12, 13)
    UNION ALL SELECT 'new/' || path, 'extra' FROM f WHERE few = 14"""
)
def q_file_diff(spark, d):
    return inventory.file_diff(*_inventories(spark, d))


@query(
    f"""WITH {_FILES}, s AS (
      SELECT path, 1 AS l, (few <> 11)::INTEGER AS r, bytes AS lb, CASE WHEN few IN (11, 12) THEN 0 ELSE bytes END AS rb, few NOT IN (11, 12, 13) AS same FROM f
      UNION ALL SELECT 'new/' || path, 0, 1, 0, bytes, false FROM f WHERE few = 14),
    u AS (SELECT *, unnest([array_to_string(string_split(path, '/')[:n], '/') FOR n IN range(0, len(string_split(path, '/')))]) AS folder FROM s)
    SELECT folder, CASE WHEN sum(l) = 0 THEN 'extra' WHEN sum(r) = 0 THEN 'missing' WHEN bool_and(same) THEN 'same' ELSE 'changed' END AS state,
    sum(l)::BIGINT AS left_files, sum(r)::BIGINT AS right_files, sum(lb)::BIGINT AS left_bytes, sum(rb)::BIGINT AS right_bytes FROM u GROUP BY folder"""
)
def q_tree_diff(spark, d):
    return inventory.tree_diff(*_inventories(spark, d))


# --------------------------------------------------------------- relocation


def _identities(names, seed):
    """JSON text of an identity for each of the names that end in json, null for the others."""
    one = [F.concat(F.lit(f'"{n}":{{"bytes":{len(n)},"sha256":"'), F.sha2(F.concat(seed, F.lit(n)), 256), F.lit('"}')) if n.endswith(("json", "safetensors")) else F.lit(f'"{n}":null') for n in names]
    return F.concat(F.lit("{"), F.concat_ws(",", *one), F.lit("}"))


def _identities_sql(names, seed):
    one = [f"""'"{n}":{{"bytes":{len(n)},"sha256":"' || sha256({seed} || '{n}') || '"}}'""" if n.endswith(("json", "safetensors")) else f"""'"{n}":null'""" for n in names]
    return "'{' || " + " || ',' || ".join(one) + " || '}'"


_BUNDLES = f"""
b AS (SELECT c_custkey AS k, c_custkey % 8 AS turn, c_name, {_identities_sql(inventory.ADAPTER_FILES, "c_name")} AS adapter, {_identities_sql(inventory.BASE_FILES, "c_mktsegment")} AS base FROM customer),
m AS (SELECT *, '{{"schema_version":' || CASE turn WHEN 1 THEN '"1"' ELSE '1' END || ',"base_files":' || CASE turn WHEN 2 THEN '{{}}' ELSE base END || ',"adapter_files":'
      || CASE turn WHEN 3 THEN '[]' ELSE adapter END || '}}' AS manifest FROM b),
s AS (SELECT *, '{{"base_model_name_or_path":"/new/base/","r":' || k || ',"revision":null}}' AS staged FROM m)"""


@query(
    f"""WITH {_BUNDLES} SELECT k AS c_custkey, ['', 'manifest', 'base inventory', 'adapter inventory', 'adapter changed', 'base changed', 'config', 'config'][turn + 1] AS error,
    CASE WHEN turn = 0 THEN staged END AS staged_config,
    CASE WHEN turn = 0 THEN '{{"changed_config_fields":["base_model_name_or_path"],"schema_version":1,"source_manifest_sha256":"' || sha256(manifest) || '","source_base":"/old/' || c_name
      || '","staged_config_sha256":"' || sha256(staged) || '","target_base":"/new/base/"}}' END AS receipt FROM s"""
)
def q_relocate(spark, d):
    turn, name = F.col("c_custkey") % 8, F.col("c_name")
    adapter, base = F.col("adapter"), F.col("base")
    manifest = F.concat(
        F.lit('{"schema_version":'), F.when(turn == 1, '"1"').otherwise("1"), F.lit(',"base_files":'), F.when(turn == 2, "{}").otherwise(base),
        F.lit(',"adapter_files":'), F.when(turn == 3, "[]").otherwise(adapter), F.lit("}"),
    )
    source = F.when(turn == 6, "hub/base").otherwise(F.concat(F.lit("/old/"), name))
    config = F.concat(
        F.lit('{"r": '), F.col("c_custkey").cast("string"), F.lit(', "revision": '), F.when(turn == 7, '"main"').otherwise("null"),
        F.lit(', "base_model_name_or_path": "'), source, F.lit('"}'),
    )
    told = _table(spark, d, "customer", 10_000).select(
        "c_custkey", "c_name", _identities(inventory.ADAPTER_FILES, name).alias("adapter"), _identities(inventory.BASE_FILES, F.col("c_mktsegment")).alias("base")
    )
    rows = told.select(
        "c_custkey", manifest.alias("manifest"), config.alias("config"), F.lit("/new/base").alias("target"),
        F.when(turn == 4, F.replace(adapter, F.lit('"bytes":'), F.lit('"bytes":1'))).otherwise(adapter).alias("adapter_files"),
        F.when(turn == 5, F.replace(base, F.lit(":null"), F.lit(':{"bytes":0,"sha256":""}'))).otherwise(base).alias("base_files"),
    )
    return inventory.relocate(rows).select("c_custkey", F.coalesce("error", F.lit("")).alias("error"), "staged_config", "receipt")


# ------------------------------------------------------------- tensor files


@query(
    """WITH e AS (SELECT label, vec_id % 60 = 1 AS gone, vec_id % 50 = 2 AS moved, vec_id % 70 = 3 AS odd FROM embeddings),
    t AS (SELECT label, count(*) AS n, count(*) FILTER (NOT gone) AS m, count(*) FILTER (odd AND NOT gone) AS nonfinite, count(*) FILTER (moved AND NOT gone) AS moved FROM e WHERE label % 3 <> 1 OR NOT gone GROUP BY 1)
    SELECT 'part-' || (label % 3) || '.st' AS file, 'layer.' || label AS tensor, (64 * n)::BIGINT AS values,
    CASE WHEN label = 9 THEN 0 ELSE nonfinite END AS nonfinite,
    CASE WHEN label = 9 THEN 'missing' WHEN n <> m THEN 'shape' WHEN nonfinite > 0 THEN 'nonfinite' WHEN moved > 0 THEN 'changed' ELSE 'equal' END AS state FROM t"""
)
def q_checkpoint_compare(spark, d):
    """Embeddings as tensor files by label, and as they are written later: vectors lost, moved or not finite, a tensor missing."""
    rows = _table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    gone = F.col("vec_id") % 60 == 1
    rows = rows.where((F.col("label") % 3 != 1) | ~gone)
    at = f"{shared_folder(spark)}/tensors-{uuid.uuid4().hex}"
    moved = F.transform("embedding", lambda x: F.when(F.col("vec_id") % 50 == 2, x + F.lit(1.0)).otherwise(x))
    odd = F.transform(moved, lambda x, i: F.when((i == 5) & (F.col("vec_id") % 70 == 3), F.lit(float("nan"))).otherwise(x))
    later = rows.where(~gone & (F.col("label") != 9)).withColumn("embedding", odd)
    for name, side in (("left", rows), ("right", later)):
        sizes = side.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        named = side.join(F.broadcast(sizes), "label").select(  # one row for each label, which are few
            F.format_string("part-%d.st", F.col("label") % 3).alias("file"), F.format_string("layer.%d", "label").alias("tensor"),
            F.array(F.col("n"), F.lit(64).cast("long")).alias("shape"), F.col("vec_id").alias("at"), F.col("embedding").alias("values"),
        )
        tensors.write_tensor_files(named, f"{at}/{name}").write.format("noop").mode("overwrite").save()
    left, right = (tensors.tensor_ranges(spark, f"{at}/{name}", 1 << 14) for name in ("left", "right"))
    return tensors.compare_payloads(left, right).select("file", "tensor", "values", "nonfinite", "state")
