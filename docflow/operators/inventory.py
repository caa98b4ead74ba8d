"""Inventories of files: identities, trees of digests, differences by subtree, manifests and relocation.

An inventory is a table of path, kind (file, link, folder, other, missing),
bytes and sha256. Digests of folders are sums over all that lies beneath, so
two trees are compared folder by folder before any file is.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions import strictjson
from docflow.functions.bound import bound
from docflow.sources.files import opened

# The files of a flat model folder and of an adapter.
BASE_FILES = (
    "config.json", "model.safetensors", "tokenizer.json", "tokenizer_config.json", "special_tokens_map.json",
    "added_tokens.json", "vocab.json", "merges.txt", "generation_config.json", "chat_template.json",
    "chat_template.jinja", "preprocessor_config.json", "processor_config.json", "README.md",
)
ADAPTER_FILES = ("adapter_config.json", "adapter_model.safetensors")
NEEDED_BASE_FILES = ("config.json", "model.safetensors")
BASE_FIELD = "base_model_name_or_path"
IDENTITY = "path string, kind string, bytes long, sha256 string"
BLOCK = 1 << 20


def identify(path: str) -> tuple[str, int | None, str | None]:
    """(kind, bytes, sha256) of what lies at a path or URI, read in blocks of ``BLOCK`` bytes; links aren't followed."""
    system, at = opened(path)
    if isinstance(system, pafs.LocalFileSystem) and os.path.islink(at):
        return "link", None, None
    info = system.get_file_info(at)
    if info.type != pafs.FileType.File:
        return {pafs.FileType.Directory: "folder", pafs.FileType.NotFound: "missing"}.get(info.type, "other"), None, None
    digest, size = hashlib.sha256(), 0
    with system.open_input_stream(at) as stream:
        while block := stream.read(BLOCK):
            digest.update(block)
            size += len(block)
    return "file", size, digest.hexdigest()


def file_identities(paths: DataFrame) -> DataFrame:
    """An inventory of the paths of a table (path): each is read once, in a task, and never held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("path").to_pylist()
            kinds, sizes, digests = zip(*map(identify, names)) if names else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(kinds, pa.string()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())],
                names=["path", "kind", "bytes", "sha256"],
            )

    return paths.select("path").mapInArrow(run, IDENTITY)


def folders(path: Column) -> Column:
    """All folders above a relative path, the root (an empty string) first."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def tree(inventory: DataFrame) -> DataFrame:
    """folder, files, bytes, digest: what lies beneath each folder of an inventory of relative paths.

    A digest is the XOR of the SHA-256 of everything beneath (path, kind, bytes
    and digest), so it is summed up before the shuffle and no folder, however
    large, is gathered. It tells equal trees from changed ones; against forgery
    compare the files' own digests.
    """
    line = F.concat_ws("\0", "path", "kind", F.coalesce(F.col("bytes").cast("string"), F.lit("")), F.coalesce("sha256", F.lit("")))
    rows = inventory.select(F.explode(folders(F.col("path"))).alias("folder"), F.sha2(line, 256).alias("own"), "bytes")
    part = lambda i: F.conv(F.substring("own", 1 + 12 * i, 12), 16, 10).cast("long")
    sums = [F.bit_xor(part(i)).alias(f"x{i}") for i in range(5)]
    whole = rows.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), *sums)
    digest = F.concat(*[F.lpad(F.lower(F.hex(f"x{i}")), 12, "0") for i in range(5)])
    return whole.select("folder", "files", "bytes", digest.alias("digest"))


def _state(left: Column, right: Column, equal: Column) -> Column:
    return F.when(left.isNull(), "extra").when(right.isNull(), "missing").when(equal, "same").otherwise("changed")


def tree_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """folder, state (same, changed, missing or extra on the right), files and bytes of both sides."""
    x, y = tree(left).alias("x"), tree(right).alias("y")
    both = x.join(y, "folder", "full_outer")
    names = [F.coalesce(f"{side}.{c}", F.lit(0)).alias(f"{where}_{c}") for side, where in (("x", "left"), ("y", "right")) for c in ("files", "bytes")]
    return both.select("folder", _state(F.col("x.digest"), F.col("y.digest"), F.col("x.digest") == F.col("y.digest")).alias("state"), *names)


def file_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """path, state of every file that isn't the same: missing, extra, changed, or linked where the right one is a link.

    Only files whose own folder differs are compared with each other.
    """
    own = F.regexp_extract("path", r"\A(.*)/[^/]*\z", 1)
    trees = tree(left).select("folder", "digest").join(tree(right).select("folder", F.col("digest").alias("other")), "folder", "full_outer")
    open_folders = trees.where(~F.col("digest").eqNullSafe(F.col("other"))).select("folder")
    x, y = (side.withColumn("folder", own).join(open_folders, "folder", "left_semi").alias(name) for side, name in ((left, "x"), (right, "y")))
    both = x.join(y, "path", "full_outer")
    equal = F.col("x.sha256").eqNullSafe(F.col("y.sha256")) & F.col("x.bytes").eqNullSafe(F.col("y.bytes")) & (F.col("x.kind") == F.col("y.kind"))
    state = F.when((F.col("y.kind") == "link") & F.col("x.kind").isNotNull() & (F.col("x.kind") != "link"), "linked")
    return both.select("path", state.otherwise(_state(F.col("x.kind"), F.col("y.kind"), equal)).alias("state")).where("state <> 'same'")


def identity_json(kind: Column, size: Column, sha256: Column) -> Column:
    """A file's identity as struct(sha256, bytes), null for what isn't a regular file."""
    return F.when(kind == "file", F.struct(sha256.alias("sha256"), size.alias("bytes")))


def folder_inventory(inventory: DataFrame, folder: str, name: str, names: tuple[str, ...]) -> DataFrame:
    """folder, files: per folder the JSON object of the identities of the given names, null where there is none.

    A folder that has other names too, or a given one that is no regular file,
    has null as files. A folder's rows are reduced to one per given name before they move.
    """
    known = F.col(name).isin(*names)
    own = identity_json(F.col("kind"), F.col("bytes"), F.col("sha256"))
    columns = [F.max(F.when(F.col(name) == n, own)).alias(f"f{i}") for i, n in enumerate(names)]
    odd = F.bool_or(~known | (F.col("kind") != "file")).alias("odd")
    found = inventory.groupBy(folder).agg(odd, *columns)
    pairs = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.col(f"f{i}"))])
    return found.select(folder, F.when(~F.col("odd"), F.to_json(pairs, {"ignoreNullFields": "false"})).alias("files"))


def inventory_fits(value: Column, names: tuple[str, ...], needed: tuple[str, ...]) -> Column:
    """Whether a JSON value is an inventory of exactly these names: an identity each, or null for one that isn't needed."""
    return bound(strictjson.fields(value), lambda files: _files_fit(files, names, needed))


def _files_fit(files: Column, names: tuple[str, ...], needed: tuple[str, ...]) -> Column:
    keys = F.array_sort(F.map_keys(files)) == F.array(*[F.lit(n) for n in sorted(names)])

    def fits(entry):
        absent = strictjson.is_kind(entry["value"], "null") & ~entry["key"].isin(*needed)
        return absent | bound(strictjson.fields(entry["value"]), identity)

    def identity(own):
        digest = strictjson.exactly(own["sha256"], "string").rlike(r"\A[0-9a-f]{64}\z")
        size = strictjson.exactly(own["bytes"], "integer") >= 0
        return F.coalesce((F.size(own) == 2) & digest & size, F.lit(False))

    return F.coalesce(keys & F.forall(F.map_entries(files), fits), F.lit(False))


def relocate(bundles: DataFrame) -> DataFrame:
    """Adds error, staged_config and receipt to sealed bundles that move to another base folder.

    Columns: manifest, config (JSON texts as stored), adapter_files, base_files
    (JSON of the inventories as found now, see ``folder_inventory``), target (the
    base's new folder). Exactly one field of the config is written anew. The first
    rule that a bundle breaks is its error; then there is no receipt.
    """
    target = F.concat(F.regexp_replace("target", "/+$", ""), F.lit("/"))
    made = bound(
        F.struct(strictjson.parsed(F.col("manifest")).alias("manifest"), strictjson.parsed(F.col("config")).alias("config"), target.alias("target")),
        lambda x: _relocated(x["manifest"], x["config"], x["target"]),
    )
    rows = bundles.withColumn("made", made).select(*bundles.columns, "made.*")
    receipt = F.struct(
        F.array_compact(F.array(F.when(F.col("source_base") != F.col("target_base"), BASE_FIELD))).alias("changed_config_fields"),
        F.lit(1).alias("schema_version"),
        F.sha2("manifest", 256).alias("source_manifest_sha256"),
        "source_base",
        F.sha2("staged_config", 256).alias("staged_config_sha256"),
        "target_base",
    )
    return rows.withColumn("receipt", F.when(F.col("error").isNull(), F.to_json(receipt))).drop("source_base", "target_base")


def _relocated(manifest: Column, config: Column, target: Column) -> Column:
    """struct(error, staged_config, source_base, target_base) of a bundle; staged only without an error."""
    wanted = F.array(*[F.lit(x) for x in ("adapter_files", "base_files", "schema_version")])
    part = lambda name: strictjson.field(manifest, name)
    same = lambda name, found: F.coalesce(
        strictjson.canonical(part(name)) == strictjson.canonical(strictjson.parsed(F.col(found))), F.lit(False)
    )
    source, revision = strictjson.typed(config, BASE_FIELD, "string"), strictjson.field(config, "revision")
    yes = lambda c: F.coalesce(c, F.lit(False))
    rules = (
        ("manifest", yes(F.array_sort(F.map_keys(strictjson.fields(manifest))) == wanted) & yes(strictjson.typed(manifest, "schema_version", "integer") == 1)),
        ("base inventory", inventory_fits(part("base_files"), BASE_FILES, NEEDED_BASE_FILES)),
        ("adapter inventory", inventory_fits(part("adapter_files"), ADAPTER_FILES, ADAPTER_FILES)),
        ("adapter changed", same("adapter_files", "adapter_files")),
        ("base changed", same("base_files", "base_files")),
        ("config", yes(F.startswith(source, F.lit("/"))) & (revision.isNull() | strictjson.is_kind(revision, "null"))),
    )
    error = F.coalesce(*[F.when(~fine, name) for name, fine in rules])
    return bound(
        error,
        lambda e: F.struct(
            e.alias("error"), F.when(e.isNull(), strictjson.with_field(config, BASE_FIELD, target)).alias("staged_config"),
            source.alias("source_base"), target.alias("target_base"),
        ),
    )
