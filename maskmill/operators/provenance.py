"""Digests of rows and tables."""

from __future__ import annotations

import hashlib
import json
import os
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def array_digest(dtype: str, shape: tuple[int, ...], data: Column) -> Column:
    """sha256 of dtype, shape (little-endian int64) and bytes."""
    head = dtype.encode() + b"".join(struct.pack("<q", n) for n in shape)
    return F.sha2(F.concat(F.unhex(F.lit(head.hex())), data), 256)


def row_digest(*columns: str) -> Column:
    """sha256 of the values as a JSON list of texts; null is its own value, and quotes,
    backslashes and controls are escaped, so different rows have different texts."""
    return F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in columns])), 256)


#: Hexadecimal digits of a lane, and lanes of a digest.
LANE, LANES = 15, 4


def table_digest(df: DataFrame, *columns: str, keys: tuple[str, ...] = (), required: bool = False) -> DataFrame:
    """Digest of a table as a multiset of rows, per ``keys``.

    The digests of the rows, in four lanes of sixty bits, are summed up; the table's
    digest is over the sums and the number of rows. Sums combine before the shuffle, so
    the order of rows does not matter and no task sees more than its own rows. An empty
    group has no row; with ``required`` an empty table is an error.
    """
    rows = df.select(*keys, row_digest(*columns).alias("d"))
    lanes = [F.sum(F.conv(F.substring("d", 1 + LANE * i, LANE), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(LANES)]
    sums = rows.groupBy(*keys).agg(F.count("*").alias("row_count"), *lanes) if keys else rows.agg(F.count("*").alias("row_count"), *lanes).filter("row_count > 0")
    if required and sums.isEmpty():
        raise ValueError("an empty table has no digest")
    parts = [F.col("row_count").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(LANES)]]
    return sums.select(*keys, "row_count", F.sha2(F.concat_ws(":", *parts), 256).alias("digest"))


def canonical_digest(value) -> str:
    """sha256 of a small value as JSON with sorted keys and no blanks."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()


def files_digest(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """Digest of a set of files (binary source) by name and content, in any order."""
    return table_digest(files.select(F.col(name).alias("name"), F.sha2(content, 256).alias("sha256")), "name", "sha256")


def contract_digest(manifest: str, *sidecars: str) -> str:
    """Digest of a manifest file with those of its sidecar files that exist, by name."""

    def of(path: str) -> str:
        with open(path, "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()

    return canonical_digest({"manifest": of(manifest)} | {os.path.basename(p): of(p) for p in sidecars if os.path.exists(p)})
