"""Tables in buckets of their key, so that a join on it needs no shuffle.

A table is written into ``buckets`` hash buckets of ``keys``, sorted inside each, under a path in
the shared folder, and registered in the session's catalog; a persistent catalog keeps it for
later sessions.  Two tables of equal bucket counts and keys join, and aggregate, on these keys
without an Exchange.  The planner uses the buckets only when a query asks for all their
keys, so holes and shots are bucketed by the key they are joined on, (round_id, hole_number).

The bucket count is fixed by the writer from the table's size (``bucket_count``): a task reads one
bucket of each side, whatever the session's number of shuffle partitions.  A key as fine as a
hole of a round can't be hot.  The rows are dealt out to the buckets before the write, so a
bucket is one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

HOLE_KEY = ("round_id", "hole_number")
ROUND_KEY = ("round_id",)
BUCKET_BYTES = 256 << 20


def bucket_count(total_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """A power of two, so that tables written at different sizes keep bucket counts that divide each other."""
    wanted = max(1, -(-total_bytes // bucket_bytes))
    return 1 << (wanted - 1).bit_length()


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int, keys: tuple[str, ...] = HOLE_KEY) -> DataFrame:
    """Write ``df`` as table ``name`` at ``path``, in place of what is there, and read it back.

    Rows with a null key go to a bucket like any others.  An empty table is a table without files.
    """
    dealt = df.repartition(buckets, *keys)
    dealt.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)


def bucketed_holes_and_shots(spark: SparkSession, holes: DataFrame, shots: DataFrame, root: str, prefix: str, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Holes and shots, bucketed alike by (round_id, hole_number) below ``root``."""
    written = (write_bucketed(df, f"{prefix}_{name}", f"{root.rstrip('/')}/{name}", buckets) for name, df in (("holes", holes), ("shots", shots)))
    return tuple(written)


def append_bucketed(df: DataFrame, name: str, path: str, buckets: int, keys: tuple[str, ...], order: tuple[str, ...]) -> None:
    """Add ``df`` to the bucketed table ``name`` at ``path`` as it is dealt out: a task writes a file for each bucket it has rows of."""
    df.write.mode("append").format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*order).saveAsTable(name)


def stored_bucketed(spark: SparkSession, name: str, path: str, schema: T.StructType, buckets: int, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The bucketed table at ``path``; a session whose catalog doesn't know it registers it, and nothing is written."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS `{name}` ({columns}) USING parquet"
        f" CLUSTERED BY ({', '.join(keys)}) SORTED BY ({', '.join(order)}) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    return spark.table(name)
