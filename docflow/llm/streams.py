"""SHA-256 over rows that belong together, taken over a sorted stream."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def sha256_by_key(rows: DataFrame, separator: str) -> DataFrame:
    """key, sha256 from rows of key, at, piece: the pieces of a key by ``at``, joined by the separator.

    A hash can't be taken in parts, so a key's pieces meet in one task; it holds
    one batch of rows and sorts with spills, whatever the size of the key. A key
    without pieces has no row.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = digest = None
        for batch in batches:
            keys, digests = [], []
            for name, piece in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist()):
                if digest is None or name != key:
                    if digest is not None:
                        keys.append(key)
                        digests.append(digest.hexdigest())
                    key, digest = name, hashlib.sha256()
                else:
                    digest.update(separator.encode())
                digest.update(piece.encode())
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "sha256": pa.array(digests, pa.string())})
        if digest is not None:
            yield pa.RecordBatch.from_pydict({"key": [key], "sha256": [digest.hexdigest()]})

    sorted_rows = rows.repartition("key").sortWithinPartitions("key", "at").select("key", "piece")
    return sorted_rows.mapInArrow(hashes, "key string, sha256 string")
