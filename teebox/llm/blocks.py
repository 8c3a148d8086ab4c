"""Blocks of documents and questions about 64-bit hashes that many blocks share.

A block is a bounded share of the documents, dealt by a hash of id and text so that neither a
repeated id nor a repeated text lands in one block alone.  Blocks ask about their distinct
hashes: the hashes travel as packed parcels, one per (block, bucket), where a bucket is a range
of hash values; a bucket's task answers for all blocks.  A hash counts once per block, however
often it occurs there, so a hot hash cannot fill a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teebox.llm import scratch

ROWS = 2000  # documents per block, on average


def row_key(doc_id: Column, text: Column) -> Column:
    """A row's id and the SHA-256 of its text; rows without an id or with a repeated one are told apart by their text."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.sha2(F.coalesce(text, F.lit("")), 256))


def blocked(docs: DataFrame) -> DataFrame:
    """``docs`` with a block number ``blk``, dealt out by it."""
    parts = scratch.partitions(docs.sparkSession)
    n = max(4 * parts, -(-docs.count() // ROWS))
    return docs.withColumn("blk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("long")).repartition(parts, "blk")


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash; grows with the hash."""
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def parcels(blk: int, buckets: int, hashes: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """(bucket, blk, packed arrays...) of sorted distinct hashes and what belongs to them."""
    which = bucket_of(hashes, buckets)
    cut = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])) if len(which) else np.zeros(0, np.int64)
    end = np.append(cut[1:], len(which))
    return [(int(which[a]), blk, *(c[a:b].tobytes() for c in (hashes, *columns))) for a, b in zip(cut, end)]


def as_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def unpacked(column, dtype: str = "<u8") -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in column.to_pylist()]


ASK = pa.schema([("bucket", pa.int64()), ("blk", pa.int64()), ("hashes", pa.binary()), ("again", pa.binary())])
REPLY = pa.schema([("blk", pa.int64()), ("hashes", pa.binary())])


def ask_repeated(blk: int, buckets: int, hashes: np.ndarray) -> pa.Table:
    """Parcels of a block's distinct hashes, with a flag where the block itself holds one twice."""
    names, n = np.unique(hashes, return_counts=True)
    return as_table(parcels(blk, buckets, names, (n > 1).astype(np.uint8)), ASK)


def repeated(asked: DataFrame) -> DataFrame:
    """For each block the hashes of its parcels that occur at least twice overall."""

    def answer(table: pa.Table) -> pa.Table:
        hashes, again = unpacked(table["hashes"]), unpacked(table["again"], "u1")
        names, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(inverse, weights=1 + np.concatenate(again))
        rows, at = [], 0
        for blk, h in zip(table["blk"].to_pylist(), hashes):
            hit = h[total[inverse[at : at + len(h)]] > 1]
            at += len(h)
            if len(hit):
                rows.append((blk, hit.tobytes()))
        return as_table(rows, REPLY)

    return asked.groupBy("bucket").applyInArrow(answer, "blk long, hashes binary")


def replies(table: pa.Table) -> np.ndarray:
    """Sorted hashes of a block's replies."""
    found = unpacked(table["hashes"])
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def among(h: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which hashes are in the sorted names."""
    if not len(names):
        return np.zeros(len(h), bool)
    return names[np.minimum(np.searchsorted(names, h), len(names) - 1)] == h
