"""Outlier trim: drop values more than ``k`` sample deviations from their group mean.

A row is kept when its value is null, its group has fewer than ``min_rows``
rows (null values count as rows), the group's deviation is null or zero, or
``|value - mean| <= k * sd``.  A null group key finds no statistics, so such
rows are never trimmed.

Plan: a partial/final hash aggregate builds one statistics row per group,
which is joined back to the rows.  No window: a window would sort every group
inside one task, and one club can hold a third of all shots.  The join is left
to the planner: AQE turns it into a broadcast at run time when the statistics
turn out small, and splits skewed partitions when they do not.

Groups inside one round are small, and as many as the rounds, so there a window does both: rows
in buckets of ``round_id`` stay where they are, while a join on all of the keys would move them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A distance is an outlier beyond 2 sample standard deviations,
# and groups with fewer than 5 rows are never trimmed.
STDDEV_THRESHOLD = 2.0
MIN_GROUP_SIZE = 5


def _stats(value: str) -> dict[str, Column]:
    v = F.col(value).try_cast("double")
    return {"_trim_n": F.count(F.lit(1)), "_trim_mean": F.avg(v), "_trim_sd": F.stddev_samp(v)}


def outlier_stats(df: DataFrame, keys: Sequence[str], value: str = "distance_meters") -> DataFrame:
    aggs = [c.alias(name) for name, c in _stats(value).items()]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def with_group_stats(df: DataFrame, keys: Sequence[str], value: str = "distance_meters") -> DataFrame:
    """``df`` with the statistics of each row's group, null where a key is null (a null group's are not applied)."""
    if "round_id" not in keys:
        return df.join(outlier_stats(df, keys, value), on=list(keys), how="left")
    group, known = Window.partitionBy(*keys), F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return df.select("*", *[F.when(known, c.over(group)).alias(name) for name, c in _stats(value).items()])


def keep_condition(value: str = "distance_meters", k: float = STDDEV_THRESHOLD, min_rows: int = MIN_GROUP_SIZE):
    v = F.col(value).try_cast("double")
    n, mean, sd = F.col("_trim_n"), F.col("_trim_mean"), F.col("_trim_sd")
    return (
        v.isNull()
        | (n < min_rows)
        | sd.isNull()
        | (sd == 0)
        | (F.abs(v - mean) <= sd * k)
    )


def trim_outliers(
    df: DataFrame,
    keys: Sequence[str] = (),
    value: str = "distance_meters",
    *,
    k: float = STDDEV_THRESHOLD,
    min_rows: int = MIN_GROUP_SIZE,
) -> DataFrame:
    """Rows of ``df`` that survive the trim, with ``df``'s columns."""
    keys = list(keys)
    if not keys:
        # Exactly one statistics row: broadcast it on a constant key.
        one = F.lit(0).alias("_trim_all")
        joined = df.select("*", one).join(F.broadcast(outlier_stats(df, keys, value).select("*", one)), on="_trim_all", how="inner")
    else:
        joined = with_group_stats(df, keys, value)
    return joined.filter(keep_condition(value, k, min_rows)).select(*df.columns)
