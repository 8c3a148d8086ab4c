"""Golf-shaped views over the driver's synthetic tables.

The test data holds no golf tables, so rounds, holes and shots are derived
from ``orders``, ``lineitem`` and ``events`` by deterministic integer
arithmetic (the mapping is documented in FIXTURES.md).  Everything here is
narrow per-row work except the shot numbering, which is one window keyed by
(order, line); holes are produced by a generator (``explode(sequence)``), not
by a join, and round totals are folded over the same generated array so no
join back is needed.  So tables clustered by order before they are derived are clustered by
round after it: orders move, not the holes made of them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from teebox.schemas import HOLES, ROUNDS, SHOTS, conform
from teebox.sources.buckets import ROUND_KEY, append_bucketed, bucket_count, stored_bucketed

# The club-name override table of the fixture (key, name).  A
# non-integer key is dropped and an empty name falls back to the recorded club.
CLUB_NAME_OVERRIDES: dict[str, str] = {"3": "My Wedge", "5": "", "x": "bad key"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- hole rules
def _par(r: Column, h: Column) -> Column:
    return F.lit(3) + (r * 7 + h * 5) % 3


def _strokes(r: Column, h: Column) -> Column:
    return F.when((r + h) % 97 == 0, F.lit(None)).otherwise(
        _par(r, h) - 1 + (r * 13 + h * 11 + (r % 7) * (h % 3)) % 5
    )


def _putts(r: Column, h: Column) -> Column:
    return F.when((r + h) % 89 == 0, F.lit(None)).otherwise(1 + (r * 3 + h * 7) % 3)


def _n_holes(r: Column) -> Column:
    return F.when(r % 5 == 0, F.lit(9)).when(r % 5 == 4, F.lit(12)).otherwise(F.lit(18))


def _sum_non_null(values: Column) -> Column:
    kept = F.filter(values, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, x: a + x))


def _source(spark: SparkSession, sf_dir: str, name: str, key: str, clustered: bool | int) -> DataFrame:
    """A source table, dealt out by its key if asked: a number is that of the buckets its rounds are stored in."""
    rows = read(spark, sf_dir, name)
    if not clustered:
        return rows
    return rows.repartition(key) if clustered is True else rows.repartition(clustered, F.col(key).cast("bigint"))


def golf_rounds(spark: SparkSession, sf_dir: str, clustered: bool | int = False) -> DataFrame:
    """One round per order; totals folded over the round's generated holes."""
    o = _source(spark, sf_dir, "orders", "o_orderkey", clustered)
    o = o.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    o = o.sortWithinPartitions("o_orderkey") if clustered else o
    r = F.col("o_orderkey")
    holes = F.sequence(F.lit(1), _n_holes(r))
    df = o.select(
        r.alias("round_id"),
        r.alias("scorecard_id"),
        F.col("o_custkey").alias("player_profile_id"),
        F.when(r % 113 == 5, F.lit(None)).otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("played_on"),
        F.col("o_orderpriority").alias("course_name"),
        (r % 17 == 0).alias("exclude_from_stats"),
        _sum_non_null(F.transform(holes, lambda h: _strokes(r, h))).alias("total_score"),
        _sum_non_null(F.transform(holes, lambda h: _par(r, h))).alias("total_par"),
    ).withColumn(
        "start_time",
        F.when(
            F.col("played_on").isNotNull(),
            F.concat(F.col("played_on"), F.lit("T"), F.lpad((6 + F.col("round_id") % 12).cast("string"), 2, "0"), F.lit(":00:00")),
        ),
    )
    return conform(df, ROUNDS)


def golf_holes(spark: SparkSession, sf_dir: str, clustered: bool | int = False) -> DataFrame:
    """An order's holes come out together and in order, so sorted orders give sorted holes."""
    o = _source(spark, sf_dir, "orders", "o_orderkey", clustered).select("o_orderkey")
    o = o.sortWithinPartitions("o_orderkey") if clustered else o
    base = o.select(
        F.col("o_orderkey").alias("round_id"),
        F.explode(F.sequence(F.lit(1), _n_holes(F.col("o_orderkey")))).alias("hole_number"),
    )
    r, h = F.col("round_id"), F.col("hole_number")
    f = (r * 5 + h * 3) % 6
    par = _par(r, h)
    df = base.select(
        "round_id",
        "hole_number",
        par.alias("par"),
        _strokes(r, h).alias("strokes"),
        _putts(r, h).alias("putts"),
        F.when((r + h) % 11 == 0, F.lit(1)).otherwise(F.lit(0)).alias("penalties"),
        F.when(par == 3, F.lit(None))
        .when(f.isin(0, 1), F.lit("HIT"))
        .when(f == 2, F.lit("LEFT"))
        .when(f == 3, F.lit("RIGHT"))
        .when(f == 4, F.lit("SHORT"))
        .otherwise(F.lit("NO_FAIRWAY"))
        .alias("fairway_shot_outcome"),
        F.when((par == 3) | (f == 5), F.lit(None)).otherwise(f.isin(0, 1)).alias("fairway_hit"),
    ).withColumn("gir", (F.col("strokes") - F.col("putts")) <= (F.col("par") - 2))
    return conform(df, HOLES)


def golf_shots(spark: SparkSession, sf_dir: str, clustered: bool | int = False) -> DataFrame:
    """Clustered by order, the window deals nothing out again, and leaves each file sorted by its shots' key."""
    li = _source(spark, sf_dir, "lineitem", "l_orderkey", clustered)
    order = [
        F.col(c).asc_nulls_last()
        for c in (
            "l_partkey",
            "l_suppkey",
            "l_extendedprice",
            "l_shipdate",
            "l_quantity",
            "l_discount",
            "l_tax",
            "l_returnflag",
            "l_linestatus",
        )
    ]
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*order)
    club_id = F.col("l_suppkey") % 14
    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    df = li.select(
        F.col("l_orderkey").alias("round_id"),
        F.col("l_linenumber").alias("hole_number"),
        F.row_number().over(w).alias("shot_number"),
        club_id.alias("club_id"),
        F.when(club_id == 13, F.lit(None)).otherwise(F.concat(F.lit("Club "), club_id.cast("string"))).alias("club"),
        F.when(rf == "R", F.lit("PUTT"))
        .when((rf == "A") & (ls == "O"), F.lit("APPROACH"))
        .when(rf == "A", F.lit("CHIP"))
        .when(ls == "O", F.lit("LAYUP"))
        .otherwise(F.lit("RECOVERY"))
        .alias("shot_type"),
        F.when(F.col("l_quantity") == 50, F.lit(None))
        .when(rf == "R", F.col("l_quantity") * F.lit(0.4))
        .when(F.col("l_orderkey") % 41 == 0, F.col("l_extendedprice") / 50)
        .otherwise(F.col("l_extendedprice") / 350)
        .alias("distance_meters"),
        F.when(F.col("l_discount") < 0.03, F.lit("Green"))
        .when(F.col("l_discount") < 0.07, F.lit("Fairway"))
        .alias("lie"),
    )
    return conform(df, SHOTS)


def golf_tables(spark: SparkSession, sf_dir: str, clustered: bool | int = False) -> dict[str, DataFrame]:
    """``clustered``: every round whole in one partition, its rows in order of the table's key."""
    return {
        "rounds": golf_rounds(spark, sf_dir, clustered),
        "holes": golf_holes(spark, sf_dir, clustered),
        "shots": golf_shots(spark, sf_dir, clustered),
    }


SOURCE_TABLES = ("orders", "lineitem")


SCHEMAS = {"rounds": ROUNDS, "holes": HOLES, "shots": SHOTS}
TABLE_ORDER = {"rounds": ("round_id",), "holes": ("round_id", "hole_number"), "shots": ("round_id", "hole_number", "shot_number")}
# bytes of the source files for each bucket; holes and shots are many times as large in memory, and a round report's task sorts all of its bucket's
SOURCE_BYTES = 4 << 20


@dataclass(frozen=True)
class _Stored:
    """Golf tables in buckets of ``round_id`` below a folder of the shared one; their names in the catalog hold that folder's hash."""

    spark: SparkSession
    root: str
    buckets: int

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str, kind: str) -> _Stored:
        from teebox.session import checkpoint_dir
        from teebox.sources.tables import fingerprint, stored_bytes

        paths = [f"{sf_dir}/{t}.parquet" for t in SOURCE_TABLES]
        buckets = max(8, bucket_count(stored_bytes(spark, paths), SOURCE_BYTES))
        return cls(spark, f"{checkpoint_dir(spark).rstrip('/')}/{kind}/{fingerprint(spark, paths)}-{buckets}", buckets)

    def _place(self, table: str) -> tuple[str, str]:
        return f"teebox_{hashlib.sha1(self.root.encode()).hexdigest()[:16]}_{table}", f"{self.root}/{table}"

    @property
    def done(self) -> bool:
        from teebox.sources.tables import exists

        return exists(self.spark, f"{self.root}/_TEEBOX_DONE")

    def write(self, table: str, *parts: DataFrame) -> None:
        """The rows of all parts, in place of what an unfinished build left."""
        from teebox.sources.tables import remove_folder

        name, path = self._place(table)
        self.spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        remove_folder(self.spark, path)
        for part in parts:
            append_bucketed(part, name, path, self.buckets, ROUND_KEY, TABLE_ORDER[table])

    def finish(self) -> None:
        from teebox.sources.tables import mark_done

        mark_done(self.spark, self.root)

    def tables(self) -> dict[str, DataFrame]:
        return {t: stored_bucketed(self.spark, *self._place(t), SCHEMAS[t], self.buckets, ROUND_KEY, TABLE_ORDER[t]) for t in SCHEMAS}


def materialized_golf_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The golf tables, derived once per input folder and stored as Parquet.

    Stored under the session's checkpoint folder (shared on a cluster) keyed
    by a fingerprint of the source files, so a change of input rebuilds
    them.  Each table is in hash buckets of ``round_id``, sorted
    by the table key within files, the layout a silver table would have: they join, and aggregate by
    round, without a shuffle.  The number of buckets follows the size of the source files.
    """
    stored = _Stored.of(spark, sf_dir, "teebox-golf")
    if not stored.done:
        for name, df in golf_tables(spark, sf_dir, clustered=stored.buckets).items():
            stored.write(name, df)
        stored.finish()
    return stored.tables()


def materialized_export_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every round as an export document, stored once as gzipped JSON Lines (the bronze layer).

    Returns (doc_id, doc) read back from the text files, as an ingest would
    see them.
    """
    from teebox.session import checkpoint_dir
    from teebox.sources.exports import export_documents
    from teebox.sources.tables import exists, fingerprint, mark_done

    key = fingerprint(spark, [f"{sf_dir}/{t}.parquet" for t in SOURCE_TABLES])
    root = f"{checkpoint_dir(spark).rstrip('/')}/teebox-docs/{key}"
    if not exists(spark, f"{root}/_TEEBOX_DONE"):
        g = materialized_golf_tables(spark, sf_dir)
        # a round recorded twice alike makes one document
        docs = export_documents(g["rounds"].dropDuplicates(), g["holes"], g["shots"])
        docs.select("doc").write.mode("overwrite").text(f"{root}/docs", compression="gzip")
        mark_done(spark, root)
    raw = spark.read.text(f"{root}/docs")
    doc_id = F.concat(F.col("_metadata.file_path"), F.lit("#"), F.xxhash64("value").cast("string"))
    return raw.select(doc_id.alias("doc_id"), F.col("value").alias("doc"))


def two_source_rounds(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """Rounds recorded twice: scorecards plus activity rows to reconcile.

    round_id % 10 = 3: the round is known only as an activity.
    round_id % 10 = 7: an activity twin (the id negated, so that ids never meet) one hour later,
    same player and date, with a location name.
    """
    base = golf_rounds(spark, sf_dir) if base is None else base
    r = F.col("round_id")
    lone = r % 10 == 3
    main = base.withColumn("scorecard_id", F.when(lone, F.lit(None)).otherwise(r)).withColumn(
        "activity_id", F.when(lone, r)
    ).withColumn("data_source", F.when(lone, F.lit("activities")).otherwise(F.lit("scorecard")))
    twins = (
        base.filter(r % 10 == 7)
        .withColumn("round_id", -r)
        .withColumn("scorecard_id", F.lit(None).cast("bigint"))
        .withColumn("activity_id", F.col("round_id"))
        .withColumn("location_name", F.concat(F.lit("Loc "), F.col("course_name")))
        .withColumn("course_name", F.lit(None).cast("string"))
        .withColumn("data_source", F.lit("activities"))
        .withColumn(
            "start_time",
            F.when(
                F.col("played_on").isNotNull(),
                F.concat(
                    F.col("played_on"),
                    F.lit("T"),
                    F.lpad((7 + (-r) % 12).cast("string"), 2, "0"),
                    F.lit(":00:00"),
                ),
            ),
        )
    )
    return conform(main.unionByName(twins), ROUNDS)


def two_source_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Two-source rounds, some of an unknown player, with the holes and shots of both sources.

    The player is unknown on activity twins of round_id % 30 = 7 and on rounds of round_id % 50 = 1.
    Twins of round_id % 20 = 7 have holes and shots of their own, equal to their scorecard's.
    Stored once per input folder, like the tables they are made of; only the twins' rows are dealt out anew.
    """
    stored = _Stored.of(spark, sf_dir, "teebox-two-sources")
    if not stored.done:
        g = materialized_golf_tables(spark, sf_dir)
        rounds = two_source_rounds(spark, sf_dir, g["rounds"])
        r = F.col("round_id")
        unknown = F.when(r < 0, -r % 30 == 7).otherwise(r % 50 == 1)
        rounds = rounds.withColumn("player_profile_id", F.when(~unknown, F.col("player_profile_id")))
        stored.write("rounds", rounds.repartition(stored.buckets, "round_id"))
        for t in ("holes", "shots"):
            twins = g[t].filter(r % 20 == 7).withColumn("round_id", -r)
            stored.write(t, g[t], twins.repartition(stored.buckets, "round_id"))
        stored.finish()
    return stored.tables()


def device_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded device messages (file_id, seq, name, fields) from ``events``."""
    ev = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "props")
    t = F.col("event_type")
    return ev.select(
        F.col("user_id").alias("file_id"),
        F.col("event_id").alias("seq"),
        F.when(t == "signup", F.lit("session"))
        .when(t == "view", F.lit("record"))
        .when(t == "click", F.lit("lap"))
        .when(t == "error", F.lit("unknown_140"))
        .otherwise(t)
        .alias("name"),
        F.col("props").alias("fields"),
    )
