"""Tensor files: headers checked, payloads read by ranges and compared, files written.

A file is eight bytes of length, a JSON header of names, kinds, shapes and byte
ranges, and the payload. ``TensorRanges`` is a data source with a partition for
each range of a tensor, so no file and no tensor is ever in one cell.
"""

from __future__ import annotations

import json
import math
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docflow.sources.files import opened

BYTES = {"F32": 4, "F16": 2, "BF16": 2}


def unique_object(pairs: list) -> dict:
    """For JSON readers: a repeated key is an error, not a silent overwrite."""
    found = dict(pairs)
    if len(found) != len(pairs):
        raise ValueError("repeated key")
    return found


def read_header(data: bytes) -> list[dict]:
    """Tensors in name order; raises for any range, shape, kind or gap that doesn't fit the file."""
    size = header_size(data[:8], len(data))
    return check_header(data[8 : 8 + size], len(data) - 8 - size)


def header_size(first: bytes, length: int) -> int:
    """Bytes of the header of a file that begins so and is so long."""
    if len(first) < 8:
        raise ValueError("short file")
    (size,) = struct.unpack("<Q", first)
    if size > length - 8:
        raise ValueError("header beyond the file")
    return size


def check_header(header: bytes, payload: int) -> list[dict]:
    """The tensors of a header, whose ranges must fill a payload of so many bytes."""
    head = json.loads(header, object_pairs_hook=unique_object)
    out, at = [], 0
    for name, t in sorted(((k, v) for k, v in head.items() if k != "__metadata__"), key=lambda x: x[1]["data_offsets"]):
        begin, end = t["data_offsets"]
        if t["dtype"] not in BYTES or any(type(n) is not int or n < 1 for n in t["shape"]):
            raise ValueError(f"unsupported tensor {name}")
        if begin != at or end - begin != BYTES[t["dtype"]] * math.prod(t["shape"]) or end > payload:
            raise ValueError(f"bad range of {name}")
        at = end
        out.append({"name": name, "dtype": t["dtype"], "shape": t["shape"], "begin": begin, "end": end})
    if at != payload:
        raise ValueError("unclaimed bytes")
    return sorted(out, key=lambda x: x["name"])


HEADER_DDL = "tensors array<struct<name:string,dtype:string,shape:array<long>,begin:long,end:long>>, error string"


def tensor_header(content: Column) -> Column:
    """struct(tensors, error) of a file's bytes."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = T.StructType.fromDDL(HEADER_DDL)

    @F.arrow_udf(kind)
    def run(files: pa.Array) -> pa.Array:
        out = []
        for data in files.to_pylist():
            try:
                out.append({"tensors": read_header(data), "error": None})
            except Exception as e:  # noqa: BLE001
                out.append({"tensors": None, "error": str(e)[:200]})
        return pa.array(out, type=to_arrow_type(kind))

    return run(content)


def difference_report(a: Column, b: Column, atol: float, rtol: float) -> Column:
    """Largest error, values outside tolerance, and whether all are finite, of two equally long arrays."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(F.abs(x - y).alias("e"), (F.lit(atol) + F.lit(rtol) * F.abs(y)).alias("t")))
    finite = lambda v: F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(
        F.size(a) == F.size(b),
        F.struct(
            F.array_max(F.transform(pairs, lambda p: p["e"])).alias("largest"),
            F.size(F.filter(pairs, lambda p: p["e"] > p["t"])).alias("outside"),
            (finite(a) & finite(b)).alias("finite"),
        ),
    )


RANGES = "file string, tensor string, dtype string, shape array<long>, chunk long, n_values long, n_nonfinite long, content binary, error string"
#: Bytes of a range: a cell and a partition hold no more.
RANGE_BYTES = 8 << 20


class Range(InputPartition):
    """Part of one tensor's payload, or a file that can't be read as tensors."""

    def __init__(self, path: str, file: str, tensor: dict | None = None, chunk: int = 0, begin: int = 0, size: int = 0, error: str | None = None):
        super().__init__((path, chunk))
        self.path, self.file, self.tensor, self.chunk, self.begin, self.size, self.error = path, file, tensor, chunk, begin, size, error


class TensorRanges(DataSource):
    """``spark.read.format("tensor_ranges").load(folder)``; option ``rangeBytes``.

    Only headers are read where the plan is made. A file with a bad header is one
    row with its error.
    """

    @classmethod
    def name(cls) -> str:
        return "tensor_ranges"

    def schema(self) -> str:
        return RANGES

    def reader(self, schema) -> DataSourceReader:
        return _RangeReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)) // 4 * 4)


class _RangeReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int):
        self.folder, self.range_bytes = folder, range_bytes

    def partitions(self) -> list[Range]:
        system, at = opened(self.folder)
        out: list[Range] = []
        found = system.get_file_info(pafs.FileSelector(at, recursive=True))
        for info in sorted((f for f in found if f.type == pafs.FileType.File), key=lambda f: f.path):
            path, file = f"{self.folder.rstrip('/')}/{os.path.relpath(info.path, at)}", os.path.relpath(info.path, at)
            try:
                with system.open_input_file(info.path) as f:
                    size = header_size(f.read(8), info.size)
                    tensors = check_header(f.read(size), info.size - 8 - size)
            except Exception as e:  # noqa: BLE001
                out.append(Range(path, file, error=str(e)[:200]))
                continue
            for t in tensors:
                length, start = t["end"] - t["begin"], 8 + size + t["begin"]
                for chunk in range(max(1, -(-length // self.range_bytes))):
                    part = min(self.range_bytes, length - chunk * self.range_bytes)
                    out.append(Range(path, file, t, chunk, start + chunk * self.range_bytes, part))
        return out

    def read(self, part: Range) -> Iterator[tuple]:
        if part.error is not None:
            yield (part.file, None, None, None, None, None, None, None, part.error)
            return
        system, at = opened(part.path)
        with system.open_input_file(at) as f:
            data = f.read_at(part.size, part.begin)
        t = part.tensor
        n, odd = values_of(data, t["dtype"])
        yield (part.file, t["name"], t["dtype"], t["shape"], part.chunk, n, odd, data, None if len(data) == part.size else "file cut short")


def values_of(data: bytes, dtype: str) -> tuple[int, int]:
    """(values, values that are infinite or no number), by the exponent's bits."""
    kind, exponent = {"F32": ("<u4", 0x7F800000), "F16": ("<u2", 0x7C00), "BF16": ("<u2", 0x7F80)}[dtype]
    bits = np.frombuffer(data[: len(data) // BYTES[dtype] * BYTES[dtype]], kind)
    return len(bits), int(((bits & exponent) == exponent).sum())


def tensor_ranges(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The ranges of all tensors of all files beneath a folder (a path or URI that all machines see)."""
    spark.dataSource.register(TensorRanges)
    return spark.read.format("tensor_ranges").option("rangeBytes", str(range_bytes)).load(folder)


def compare_payloads(left: DataFrame, right: DataFrame) -> DataFrame:
    """file, tensor, state, values, nonfinite, differing: two sets of ranges tensor by tensor.

    Ranges are reduced to digests where they are read. States: equal, changed,
    shape, missing or extra on the right, nonfinite (on either side), unreadable.
    """

    def side(rows, name):
        own = rows.select(
            "file", F.coalesce("tensor", F.lit("")).alias("tensor"), F.coalesce("chunk", F.lit(0).cast("long")).alias("chunk"),
            F.struct("dtype", "shape", "n_values", "n_nonfinite", F.sha2("content", 256).alias("sha256"), "error").alias(name),
        )
        return own

    both = side(left, "x").join(side(right, "y"), ["file", "tensor", "chunk"], "full_outer")
    x, y, zero = F.col("x"), F.col("y"), F.lit(0).cast("long")
    any_of = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    per = both.groupBy("file", "tensor").agg(
        F.greatest(F.sum(F.coalesce(x["n_values"], zero)), F.sum(F.coalesce(y["n_values"], zero))).alias("values"),
        F.sum(F.coalesce(x["n_nonfinite"], zero) + F.coalesce(y["n_nonfinite"], zero)).alias("nonfinite"),
        F.count_if(~x["sha256"].eqNullSafe(y["sha256"])).alias("differing"),
        F.bool_and(x.isNull()).alias("extra"), F.bool_and(y.isNull()).alias("missing"),
        any_of(x["error"].isNotNull() | y["error"].isNotNull()).alias("bad"),
        any_of((x["shape"] != y["shape"]) | (x["dtype"] != y["dtype"])).alias("other_shape"),
    )
    state = (
        F.when(F.col("bad"), "unreadable").when(F.col("extra"), "extra").when(F.col("missing"), "missing").when(F.col("other_shape"), "shape")
        .when(F.col("nonfinite") > 0, "nonfinite").when(F.col("differing") > 0, "changed").otherwise("equal")
    )
    return per.select("file", F.when(~F.col("bad"), F.col("tensor")).alias("tensor"), state.alias("state"), "values", "nonfinite", "differing")


def write_tensor_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes files of F32 tensors; returns file, tensors, bytes, once it is run.

    ``rows``: file, tensor, shape, at, values (array of floats): a tensor's values
    in order of ``at``. A file is written by one task as a sorted stream, a batch
    at a time, under another name until it is whole; headers are put together
    from counts before.
    """
    sizes = rows.groupBy("file", "tensor").agg(F.first("shape").alias("shape"), (F.sum(F.size("values")) * 4).cast("long").alias("size"))
    heads = sizes.groupBy("file").agg(F.to_json(F.array_sort(F.collect_list(F.struct("tensor", "shape", "size")))).alias("head"))
    first = heads.select("file", F.lit(None).cast("string").alias("tensor"), F.lit(None).cast("long").alias("at"), "head", F.lit(None).cast("array<float>").alias("values"))
    body = rows.select("file", "tensor", F.col("at").cast("long").alias("at"), F.lit(None).cast("string").alias("head"), F.col("values").cast("array<float>").alias("values"))
    stream = first.unionByName(body).repartition("file").sortWithinPartitions("file", F.col("tensor").asc_nulls_first(), "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = opened(folder)
        file, out, done, count = None, None, [], 0

        def finish():
            nonlocal out
            size = out.tell()
            out.close()
            system.move(f"{at}/{file}.part", f"{at}/{file}")
            done.append((file, count, size))
            out = None

        for batch in batches:
            for name, head, values in zip(batch.column("file").to_pylist(), batch.column("head").to_pylist(), batch.column("values")):
                if head is None:
                    out.write(np.asarray(values.values, dtype="<f4").tobytes())
                    continue
                if out is not None:
                    finish()
                file, begin, entries = name, 0, {}
                for t in json.loads(head):
                    entries[t["tensor"]] = {"dtype": "F32", "shape": t["shape"], "data_offsets": [begin, begin + t["size"]]}
                    begin += t["size"]
                text, count = json.dumps(entries).encode(), len(entries)
                system.create_dir(os.path.dirname(f"{at}/{file}"), recursive=True)
                out = system.open_output_stream(f"{at}/{file}.part")
                out.write(struct.pack("<Q", len(text)) + text)
        if out is not None:
            finish()
        files, counts, lengths = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(counts, pa.int64()), pa.array(lengths, pa.int64())], names=["file", "tensors", "bytes"])

    return stream.select("file", "head", "values").mapInArrow(run, "file string, tensors long, bytes long")
