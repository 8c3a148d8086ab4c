"""Rolling trends: each round against its trailing window and the window before.

The reference recomputes up to three full summaries per round (quadratic).
Here the per-round components are computed once (one aggregate over holes),
and the window values are sums of those components over two row frames:

  current  = ROWS BETWEEN N-1 PRECEDING AND CURRENT ROW
  previous = ROWS BETWEEN 2N-1 PRECEDING AND N PRECEDING

Window values are pooled (sum of hits over sum of tries; sum of per-18
values over the number of 9/18-hole rounds), exactly as recomputing the
summary over the window's rounds would give.  The frames run over round-sized
rows (never holes).  Every round gets its place in its history; a history is
cut into blocks of equal length by place, the last 2N-1 rounds of a block also
go to the next one, and plain row frames run per block.  So no history, however
long, is sorted inside one task, and nothing is run while the plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from teebox.functions.expressions import py_round, round_date, trend_course_name
from teebox.operators.per18 import hole_components, per18, ratio

# The six trend metrics, (metric, round column, window column, delta column).
TREND_METRICS = (
    ("average_to_par", "round_to_par", "window_average_to_par", "delta_average_to_par"),
    ("gir_pct", "round_gir_pct", "window_gir_pct", "delta_gir_pct"),
    ("fir_pct", "round_fir_pct", "window_fir_pct", "delta_fir_pct"),
    ("scrambling_pct", "round_scrambling_pct", "window_scrambling_pct", "delta_scrambling_pct"),
    ("three_putts_per_18", "round_three_putts_per_18", "window_three_putts_per_18", "delta_three_putts_per_18"),
    ("penalties_per_18", "round_penalties_per_18", "window_penalties_per_18", "delta_penalties_per_18"),
)


def _parts(hc: Column) -> dict[str, tuple[Column, Column]]:
    """Per metric: (numerator, denominator) contributed by one round."""
    delta = F.col("total_score").cast("double") - F.col("total_par").cast("double")
    ok_delta = per18(delta, hc)
    return {
        "average_to_par": (ok_delta, F.when(ok_delta.isNotNull(), F.lit(1)).otherwise(F.lit(0))),
        "gir_pct": (F.col("gir_hits"), F.col("gir_known")),
        "fir_pct": (F.col("fir_hits"), F.col("fir_known")),
        "scrambling_pct": (F.col("scramble_hits"), F.col("scramble_tries")),
        "three_putts_per_18": (per18(F.col("three_putts"), hc), F.when(per18(F.lit(1), hc).isNotNull(), F.lit(1)).otherwise(F.lit(0))),
        "penalties_per_18": (per18(F.col("penalties_sum"), hc), F.when(per18(F.lit(1), hc).isNotNull(), F.lit(1)).otherwise(F.lit(0))),
    }


PERCENT_METRICS = {"gir_pct", "fir_pct", "scrambling_pct"}


def _value(num: Column, den: Column, metric: str) -> Column:
    """Pooled value rounded like the summary (share first, then percent); 0 when nothing contributes."""
    v = F.coalesce(ratio(num, den), F.lit(0.0))
    return py_round(v * 100 if metric in PERCENT_METRICS else v, 2)


#: Width of a round-id range in one calendar entry, and rounds in one block of a history.
ID_RANGE = 1 << 20
BLOCK_ROUNDS = 1 << 17


def _numbered(rounds: DataFrame, by: list[str]) -> DataFrame:
    """Rounds with ``_pos``, the 0-based place in their history (date, then id; missing ones last).

    A calendar entry (history, day, id range) holds at most ``ID_RANGE`` distinct ids and is
    numbered on its own.  The rounds before it come from a running sum over the calendar,
    which holds one count an entry and never the rounds.
    """
    entry = [*by, "_d", "_range"]
    base = rounds.select(
        *by,
        "round_id",
        "played_on",
        trend_course_name().alias("course_name"),
        "total_score",
        "total_par",
        round_date("played_on").alias("_d"),
        F.floor(F.col("round_id") / F.lit(ID_RANGE)).cast("bigint").alias("_range"),
    )
    earlier = Window.partitionBy(*by).orderBy(F.col("_d").asc_nulls_last(), F.col("_range").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    calendar = (
        base.groupBy(*entry)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*[F.col(c).alias(f"_k_{c}") for c in entry], F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*entry).orderBy(*[F.col(c).asc_nulls_last() for c in ("round_id", "played_on", "course_name", "total_score", "total_par")])
    placed = base.withColumn("_place", F.row_number().over(inside) - 1)
    same = F.lit(True)
    for c in entry:
        same = same & placed[c].eqNullSafe(calendar[f"_k_{c}"])
    return placed.join(calendar, same).select(*base.columns, (F.col("_before") + F.col("_place")).alias("_pos"))


def _per_round(rounds: DataFrame, holes: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    base = _numbered(rounds, by).join(hole_components(holes, ["round_id"]).hint("merge"), on="round_id", how="left")
    hc = F.col("hole_count")
    cols: list[Column] = []
    names: list[str] = []
    for metric, (num, den) in _parts(hc).items():
        cols += [F.coalesce(num, F.lit(0.0)).cast("double").alias(f"_n_{metric}"), F.coalesce(den, F.lit(0)).cast("double").alias(f"_d_{metric}")]
        names += [f"_n_{metric}", f"_d_{metric}"]
    base = base.select(*by, "round_id", "played_on", "course_name", "_pos", F.coalesce(hc, F.lit(0)).cast("bigint").alias("hole_count"), *cols)
    return base, names


def _frame_sums(base: DataFrame, by: list[str], names: list[str], window: int, block_rounds: int) -> DataFrame:
    """Both frames' sums, block by block: a block's rounds and the 2N-1 rounds before it."""
    halo = 2 * window - 1
    size = max(block_rounds, halo)
    own = F.floor(F.col("_pos") / F.lit(size)).cast("bigint")
    blocks = F.when(F.col("_pos") % size >= size - halo, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = base.select("*", F.explode(blocks).alias("_block"))
    w = Window.partitionBy(*by, "_block").orderBy("_pos")
    cur = w.rowsBetween(-(window - 1), 0)
    prev = w.rowsBetween(-halo, -window)
    out = [F.col(c) for c in dealt.columns]
    out += [F.count("round_id").over(cur).alias("_cnt_cur"), F.count("round_id").over(prev).alias("_cnt_prev")]
    for c in names:
        out += [F.coalesce(F.sum(c).over(cur), F.lit(0.0)).alias(f"{c}_cur"), F.coalesce(F.sum(c).over(prev), F.lit(0.0)).alias(f"{c}_prev")]
    return dealt.select(*out).filter(F.col("_block") == own)


def round_trends(
    rounds: DataFrame,
    holes: DataFrame,
    window: int = 5,
    by: Sequence[str] = (),
    *,
    block_rounds: int = BLOCK_ROUNDS,
) -> DataFrame:
    """One row per round with round, window and delta values of six metrics; unsorted.

    One plan at every size: ``block_rounds`` only says how many rounds of a
    history one task sorts; it never changes a value.  A window of 0 or less gives no rows.
    """
    by = list(by)
    if window <= 0:
        return round_trends(rounds, holes, 1, by).limit(0)
    base, names = _per_round(rounds, holes, by)
    sums = _frame_sums(base, by, names, window, block_rounds)

    out: list[Column] = [F.col(c) for c in by]
    out += [
        F.col("round_id"),
        F.col("played_on"),
        F.col("course_name"),
        F.col("hole_count"),
        F.lit(window).cast("bigint").alias("window"),
        F.col("_cnt_cur").cast("bigint").alias("rounds_in_window"),
        F.col("_cnt_prev").cast("bigint").alias("rounds_in_previous_window"),
    ]
    metrics = [m[0] for m in TREND_METRICS]
    round_vals = {m: _value(F.col(f"_n_{m}"), F.col(f"_d_{m}"), m) for m in metrics}
    window_vals = {m: _value(F.col(f"_n_{m}_cur"), F.col(f"_d_{m}_cur"), m) for m in metrics}
    prev_vals = {m: _value(F.col(f"_n_{m}_prev"), F.col(f"_d_{m}_prev"), m) for m in metrics}
    for metric, rcol, _, _ in TREND_METRICS:
        out.append(round_vals[metric].alias(rcol))
    for metric, _, wcol, _ in TREND_METRICS:
        out.append(window_vals[metric].alias(wcol))
    has_prev = F.col("_cnt_prev") > 0
    for metric, _, _, dcol in TREND_METRICS:
        out.append(F.when(has_prev, py_round(window_vals[metric] - prev_vals[metric], 2)).alias(dcol))
    return sums.select(*out).filter(F.col("round_id").isNotNull())


def metric_trend_series(trends: DataFrame, metrics: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Long form: one row per (round, metric) with round, window and delta values."""
    known = {m[0]: m for m in TREND_METRICS}
    chosen = list(metrics) if metrics else list(known)
    for m in chosen:
        if m not in known:
            raise ValueError(f"Unsupported trend metric: {m}. Use one of: {', '.join(sorted(known))}.")
    items = [
        F.struct(
            F.lit(m).alias("metric"),
            F.col(known[m][1]).alias("round_value"),
            F.col(known[m][2]).alias("window_value"),
            F.col(known[m][3]).alias("delta_value"),
        )
        for m in chosen
    ]
    exploded = trends.select(*by, "played_on", "round_id", "course_name", "window", F.explode(F.array(*items)).alias("_m"))
    return exploded.select(*by, "played_on", "round_id", "course_name", "window", "_m.*")
