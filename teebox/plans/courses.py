"""Course products: hole difficulty, next-round focus, round list, course list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teebox.functions import expressions as X
from teebox.functions.expressions import as_double, pct, round_date, table_round

HOLE_METRICS = (
    "avg_strokes",
    "avg_to_par",
    "par_or_better_pct",
    "bogey_or_worse_pct",
    "double_or_worse_pct",
    "gir_pct",
    "fairway_hit_pct",
    "three_putt_pct",
    "penalty_rate",
    "avg_putts",
)


def course_hole_stats(rounds: DataFrame, holes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Difficulty of each hole number over the rounds given (per ``by`` group).

    ``par`` is the first known par in round order (lowest round id).
    """
    by = list(by)
    if by:
        joined = holes.join(rounds.select("round_id", *by).hint("merge"), on="round_id", how="inner")
    else:
        joined = holes.join(rounds.select("round_id").hint("merge"), on="round_id", how="left_semi")
    tp = X.to_par()
    keys = [*by, "hole_number"]
    table = joined.groupBy(*keys).agg(
        F.countDistinct("round_id").alias("rounds_played"),
        F.min_by(F.col("par"), F.when(F.col("par").isNotNull(), F.col("round_id"))).alias("par"),
        F.avg(as_double("strokes")).alias("avg_strokes"),
        F.avg(tp).alias("avg_to_par"),
        pct(tp <= 0).alias("par_or_better_pct"),
        pct(tp >= 1).alias("bogey_or_worse_pct"),
        pct(tp >= 2).alias("double_or_worse_pct"),
        pct(F.col("gir").cast("boolean")).alias("gir_pct"),
        pct(F.col("fairway_hit").cast("boolean")).alias("fairway_hit_pct"),
        pct(as_double("putts") >= 3).alias("three_putt_pct"),
        F.avg(F.coalesce(as_double("penalties"), F.lit(0.0))).alias("penalty_rate"),
        F.avg(as_double("putts")).alias("avg_putts"),
    )
    ordered = table.orderBy(
        *[F.col(c).asc_nulls_last() for c in by],
        F.col("avg_to_par").desc_nulls_last(),
        F.col("penalty_rate").desc_nulls_last(),
        F.col("hole_number").asc_nulls_last(),
    )
    return ordered.select(
        *keys, "rounds_played", "par", *[table_round(m, 2).alias(m) for m in HOLE_METRICS]
    )


# Focus lists as (output name, metric, suffix, highest first).
FOCUS_LISTS = (
    ("hardest_holes", "avg_to_par", " to par", True),
    ("penalty_holes", "penalty_rate", " penalties", True),
    ("three_putt_holes", "three_putt_pct", "% 3-putts", True),
    ("gir_trouble_holes", "gir_pct", "% GIR", False),
)
FOCUS_LIMIT = 3


def _focus_text(metric: str, suffix: str, highest: bool) -> Column:
    v = F.col(metric).cast("double")
    item = F.struct((-v if highest else v).alias("k"), F.col("hole_number").cast("bigint").alias("h"), v.alias("v"))
    items = F.collect_list(F.when(v.isNotNull() & F.col("hole_number").isNotNull(), item))
    top = F.slice(F.array_sort(items), 1, FOCUS_LIMIT)
    shown = F.transform(top, lambda x: F.format_string(f"%d (%.2f{suffix.replace('%', '%%')})", x["h"], x["v"]))
    return F.array_join(shown, ", ")


def course_focus(hole_stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Top three holes for each focus list, from the (rounded) hole table.

    A group's list holds one entry per hole number, so it is small whatever
    the number of rounds.
    """
    by = list(by)
    aggs = [F.coalesce(_focus_text(m, s, h), F.lit("")).alias(name) for name, m, s, h in FOCUS_LISTS]
    return hole_stats.groupBy(*by).agg(*aggs) if by else hole_stats.agg(*aggs)


def rounds_list(rounds: DataFrame) -> DataFrame:
    """Rounds for display: newest first, undated last; exclusion flag shown."""
    out = rounds.select(
        "round_id",
        "played_on",
        X.display_course_name().alias("display_course_name"),
        F.coalesce(F.col("exclude_from_stats").cast("boolean"), F.lit(False)).alias("exclude_from_stats"),
        "comment",
        round_date("played_on").alias("_d"),
    )
    return out.orderBy(F.col("_d").desc_nulls_last(), F.col("round_id").desc_nulls_last()).drop("_d")


def courses(rounds: DataFrame) -> DataFrame:
    """Known courses with round counts and first/last dates; a null name is dropped."""
    named = rounds.withColumn("display_course_name", X.display_course_name()).filter(
        F.col("display_course_name").isNotNull()
    )
    table = named.groupBy("display_course_name").agg(
        F.countDistinct("round_id").alias("rounds_played"),
        F.min("played_on").alias("first_played"),
        F.max("played_on").alias("last_played"),
    )
    return table.withColumnRenamed("display_course_name", "course_name").orderBy(
        F.col("rounds_played").desc_nulls_last(), F.col("course_name").asc_nulls_last()
    )
