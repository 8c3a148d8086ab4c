"""Silver table storage: every write is a load of its own, and a table is read as its last rows.

A load writes plain Parquet to ``<root>/<table>/load=<name>/`` and touches nothing else.  It
becomes visible, in all tables at once, by its row in ``<root>/ingest_log/load=<name>/``, which is
written last.  So a crash between steps leaves the tables as they were; running the load again
overwrites its own folders only; and the cost of a load grows with the load.

Reading keeps, of each key, the row of the latest load and, inside a load, of the latest document
(``doc_id`` sorts by it).  ``replace_table`` is the overwrite: earlier loads of the table are no
longer read (also the way to compact a table).  Annotations live in a table of their own and win
over what a load brings.  A missing table reads as an empty frame with the declared schema.  One
writer a root.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from teebox.schemas import KEYS, TABLES, conform, empty

S, L = T.StringType(), T.LongType()
COUNTERS = ("documents", "scorecards", "skipped", "rounds", "holes", "shots", "quarantined")
LOG = T.StructType([T.StructField(n, t) for n, t in (("loaded_at", L), ("replaces", S), *((c, L) for c in COUNTERS), ("load", S))])
ANNOTATIONS = T.StructType(
    [T.StructField(n, t) for n, t in (("round_id", L), ("exclude_from_stats", T.BooleanType()), ("comment", S), ("noted_at", L))]
)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath, jvm


def write_load(df: DataFrame, root: str, name: str, load: str) -> None:
    """The rows of one load of a table; a repeated load overwrites its own folder."""
    df.write.mode("overwrite").parquet(f"{root}/{name}/load={load}")


def commit_load(spark: SparkSession, root: str, load: str, counts: dict[str, int], replaces: str | None = None) -> None:
    """The log row that makes a load visible."""
    row = {f.name: counts.get(f.name) for f in LOG.fields if f.name != "load"} | {"loaded_at": time.time_ns(), "replaces": replaces}
    schema = T.StructType([f for f in LOG.fields if f.name != "load"])
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{root}/ingest_log/load={load}")


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """One row a committed load: its time and counters."""
    return spark.read.schema(LOG).parquet(f"{root}/ingest_log") if exists(spark, f"{root}/ingest_log") else empty(spark, LOG)


def read_loads(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All rows of the committed loads of a table, with ``load``, ``loaded_at`` and ``doc_id``."""
    schema = T.StructType([*TABLES[name].fields, T.StructField("doc_id", T.StringType()), T.StructField("load", T.StringType())])
    log = read_log(spark, root)
    since = F.max(F.when(F.col("replaces") == name, F.col("loaded_at"))).over(Window.partitionBy(F.lit(0)))
    seen = log.withColumn("since", since).filter("since IS NULL OR loaded_at >= since").select("load", "loaded_at")
    rows = spark.read.schema(schema).parquet(f"{root}/{name}") if exists(spark, f"{root}/{name}") else empty(spark, schema)
    return rows.join(seen, "load")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One row a key: the last one loaded; rounds with their annotations."""
    last = Window.partitionBy(*KEYS[name]).orderBy(F.col("loaded_at").desc(), F.col("doc_id").desc_nulls_last())
    rows = read_loads(spark, root, name).withColumn("_nth", F.row_number().over(last)).filter("_nth = 1")
    rows = conform(rows.drop("_nth", "load", "loaded_at", "doc_id"), TABLES[name])
    return _annotated(spark, root, rows) if name == "rounds" else rows


def replace_table(spark: SparkSession, df: DataFrame, root: str, name: str) -> str:
    """Overwrite a table: ``df`` becomes its only visible load.  Returns the load's name."""
    load = f"replace-{uuid.uuid4().hex}"
    write_load(conform(df, TABLES[name], keep_extra=False).withColumn("doc_id", F.lit(None).cast("string")), root, name, load)
    commit_load(spark, root, load, {}, replaces=name)
    return load


def save_annotations(annotations: DataFrame, root: str) -> None:
    """Append (round_id, exclude_from_stats, comment): null keeps the value, an empty comment clears it."""
    notes = conform(annotations.withColumn("noted_at", F.lit(time.time_ns())), ANNOTATIONS, keep_extra=False)
    notes.write.mode("append").parquet(f"{root}/annotations")


def _annotated(spark: SparkSession, root: str, rounds: DataFrame) -> DataFrame:
    if not exists(spark, f"{root}/annotations"):
        return rounds
    notes = spark.read.schema(ANNOTATIONS).parquet(f"{root}/annotations")
    at = F.col("noted_at")
    latest = notes.groupBy("round_id").agg(
        F.max_by("exclude_from_stats", F.when(F.col("exclude_from_stats").isNotNull(), at)).alias("_flag"),
        F.max_by("comment", F.when(F.col("comment").isNotNull(), at)).alias("_comment"),
    )
    joined = rounds.join(latest, "round_id", "left")
    joined = joined.withColumn("exclude_from_stats", F.coalesce("_flag", "exclude_from_stats"))
    joined = joined.withColumn("comment", F.nullif(F.coalesce(F.col("_comment"), F.col("comment")), F.lit("")))
    return joined.select(*rounds.columns)


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Stable digest of (path, size, modification time) of files or folders, on any file system."""
    import hashlib

    parts = []
    for p in paths:
        fs, hpath, _ = _fs(spark, p)
        if not fs.exists(hpath):
            parts.append(f"{p}:missing")
            continue
        summary = fs.getContentSummary(hpath)
        status = fs.getFileStatus(hpath)
        parts.append(f"{p}:{summary.getLength()}:{summary.getFileCount()}:{status.getModificationTime()}")
    return hashlib.sha1("|".join(parts).encode()).hexdigest()[:16]


def stored_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Bytes of the files and folders that exist, on any file system."""
    places = [_fs(spark, p)[:2] for p in paths]
    return sum(fs.getContentSummary(path).getLength() for fs, path in places if fs.exists(path))


def exists(spark: SparkSession, path: str) -> bool:
    fs, hpath, _ = _fs(spark, path)
    return bool(fs.exists(hpath))


def mark_done(spark: SparkSession, path: str) -> None:
    fs, hpath, _ = _fs(spark, f"{path}/_TEEBOX_DONE")
    fs.create(hpath, True).close()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
