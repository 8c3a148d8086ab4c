"""Season summary, one-round summary and practice priorities.

Plan shape (``by`` empty, the single-player case):

  holes  --HashAggregate(round_id)--> components --HashAggregate--> 1 row
  rounds --join components.hole_count--> HashAggregate --> 1 row
  shots  --HashAggregate(round_id)--> counts --join hole_count--> 1 row
  shots(TEE/PUTT) --trim--> HashAggregate --> 1 row
  shots --count breakdowns--> 1 row

The one-row pieces are joined on a constant key.  With ``by`` (for example
``player_profile_id``) every piece is keyed by the group instead, and the
pieces are joined on the group columns; nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teebox.functions.expressions import exact_mean, py_round
from teebox.operators.breakdown import count_breakdown
from teebox.operators.per18 import hole_components, per18, ratio
from teebox.operators.trim import trim_outliers

ALL = "_all"

# Output fields of the summary, in order (integers first, then doubles, then text).
INT_FIELDS = ("rounds_played", "rounds_18_hole", "rounds_9_hole", "rounds_other_hole_count")
SUMMARY_FIELDS = (
    "rounds_played",
    "rounds_18_hole",
    "rounds_9_hole",
    "rounds_other_hole_count",
    "average_score",
    "average_to_par",
    "gir_pct",
    "gir_per_18",
    "fir_pct",
    "fir_per_18",
    "fairway_hit_pct",
    "scrambling_pct",
    "scrambles_per_18",
    "birdie_or_better_pct",
    "par_pct",
    "bogey_or_worse_pct",
    "bogeys_or_worse_per_18",
    "double_bogey_or_worse_pct",
    "double_bogeys_or_worse_per_18",
    "three_putt_pct",
    "three_putts_per_18",
    "penalty_hole_pct",
    "par_3_average_to_par",
    "par_4_average_to_par",
    "par_5_average_to_par",
    "average_putts_per_hole",
    "average_putts_per_round",
    "average_putts_per_18",
    "average_hole_score",
    "penalties",
    "penalties_per_round",
    "penalties_per_18",
    "total_shots",
    "average_shots_per_round",
    "average_shots_per_18",
    "average_tee_shot_distance_m",
    "average_putt_distance_m",
    "shot_type_breakdown",
    "club_usage_top5",
)
COUNT_FIELDS = {"rounds_played", "rounds_18_hole", "rounds_9_hole", "rounds_other_hole_count", "penalties", "total_shots"}
TEXT_FIELDS = {"shot_type_breakdown", "club_usage_top5"}


# ----------------------------------------------------------------- helpers
def group_keys(by: Sequence[str]) -> list[str]:
    return list(by) if by else [ALL]


def keyed(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df if by else df.withColumn(ALL, F.lit(0))


def attach(frame: DataFrame, rounds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Give ``frame`` the group columns it lacks, taken from its round."""
    missing = [c for c in by if c not in frame.columns]
    if not missing:
        return keyed(frame, by)
    return frame.join(rounds.select("round_id", *missing).hint("merge"), on="round_id", how="inner")


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on the group keys, null-safe (a null group is a group)."""
    r = right
    renamed = {k: f"__r_{k}" for k in keys}
    for k, v in renamed.items():
        r = r.withColumnRenamed(k, v)
    cond = [left[k].eqNullSafe(r[v]) for k, v in renamed.items()]
    return left.join(r, on=cond, how="left").drop(*renamed.values())


def _count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


# ------------------------------------------------------------------ pieces
def per_round_table(rounds: DataFrame, holes: DataFrame, shots: DataFrame | None, by: Sequence[str] = ()) -> DataFrame:
    """One row per round id seen in rounds, holes or shots (grouped: in rounds), with every per-round component.

    Three aggregates keyed by ``round_id`` (hole components, shot counts and
    the rounds' own fields) joined on that key: all three sides are hashed
    on ``round_id`` once, so the joins add no exchange.  ``round_id`` is the
    rounds' key (canonical rounds are unique by construction).  Grouped output keeps
    the rounds' own id, so a grouping by it adds none either.
    """
    how = "left" if by else "full"
    comps = hole_components(holes, ["round_id"])
    r = rounds.select(*by, "round_id", "total_score", "total_par", F.lit(1).alias("_in_rounds"))
    table = r.join(comps, on="round_id", how=how)
    if shots is not None:
        counts = shots.groupBy("round_id").agg(F.count(F.lit(1)).alias("_shots"))
        table = table.join(counts, on="round_id", how=how)
    return table


def _main_aggs(with_shots: bool) -> list[Column]:
    s = lambda c: F.sum(c)
    hc, sc = F.col("hole_count"), F.col("scored_count")
    in_rounds = F.col("_in_rounds").isNotNull()
    score, par = F.col("total_score").cast("double"), F.col("total_par").cast("double")
    aggs = [
        F.count("_in_rounds").alias("rounds_played"),
        F.avg(F.when(in_rounds, per18(score, hc))).alias("average_score"),
        F.avg(F.when(in_rounds, per18(score - par, hc))).alias("average_to_par"),
        _count_if(hc == 18).alias("rounds_18_hole"),
        _count_if(hc == 9).alias("rounds_9_hole"),
        F.count(hc).alias("_rounds_seen"),
        (ratio(s("gir_hits"), s("gir_known")) * 100).alias("gir_pct"),
        F.avg(per18(F.col("gir_hits"), hc)).alias("gir_per_18"),
        (ratio(s("fir_hits"), s("fir_known")) * 100).alias("fir_pct"),
        F.avg(per18(F.col("fir_hits"), hc)).alias("fir_per_18"),
        (ratio(s("scramble_hits"), s("scramble_tries")) * 100).alias("scrambling_pct"),
        F.avg(per18(F.col("scramble_hits"), sc)).alias("scrambles_per_18"),
        (ratio(s("birdies"), s("scored_count")) * 100).alias("birdie_or_better_pct"),
        (ratio(s("pars"), s("scored_count")) * 100).alias("par_pct"),
        (ratio(s("bogeys"), s("scored_count")) * 100).alias("bogey_or_worse_pct"),
        F.avg(per18(F.col("bogeys"), sc)).alias("bogeys_or_worse_per_18"),
        (ratio(s("doubles"), s("scored_count")) * 100).alias("double_bogey_or_worse_pct"),
        F.avg(per18(F.col("doubles"), sc)).alias("double_bogeys_or_worse_per_18"),
        (ratio(s("three_putts"), s("putts_known")) * 100).alias("three_putt_pct"),
        F.avg(per18(F.col("three_putts"), hc)).alias("three_putts_per_18"),
        (ratio(s("penalty_holes"), s("penalties_known")) * 100).alias("penalty_hole_pct"),
        ratio(s("par3_to_par_sum"), s("par3_holes")).alias("par_3_average_to_par"),
        ratio(s("par4_to_par_sum"), s("par4_holes")).alias("par_4_average_to_par"),
        ratio(s("par5_to_par_sum"), s("par5_holes")).alias("par_5_average_to_par"),
        ratio(s("putts_sum"), s("putts_known")).alias("average_putts_per_hole"),
        F.avg("putts_sum").alias("average_putts_per_round"),
        F.avg(per18(F.col("putts_sum"), hc)).alias("average_putts_per_18"),
        ratio(s("strokes_sum"), s("strokes_known")).alias("average_hole_score"),
        s("penalties_sum").cast("bigint").alias("penalties"),
        F.avg(per18(F.col("penalties_sum"), hc)).alias("penalties_per_18"),
        F.avg(per18(F.col("gir_known"), hc)).alias("gir_opportunities_per_18"),
        F.avg(per18(F.col("fir_known"), hc)).alias("fairway_opportunities_per_18"),
    ]
    if with_shots:
        aggs += [
            F.sum("_shots").cast("bigint").alias("total_shots"),
            F.avg(per18(F.col("_shots"), hc)).alias("average_shots_per_18"),
        ]
    return aggs


def _distance_piece(shots: DataFrame, keys: list[str]) -> DataFrame:
    typed = shots.filter(F.col("shot_type").isin("TEE", "PUTT")).select(*keys, "shot_type", "distance_meters")
    kept = trim_outliers(typed, [*keys, "shot_type"])
    d = F.col("distance_meters").try_cast("double")
    return kept.groupBy(*keys).agg(
        exact_mean(F.when(F.col("shot_type") == "TEE", d)).alias("average_tee_shot_distance_m"),
        exact_mean(F.when(F.col("shot_type") == "PUTT", d)).alias("average_putt_distance_m"),
    )


def combine(pieces: list[DataFrame], keys: list[str]) -> DataFrame:
    """Merge per-group pieces that share only their keys: a union and one aggregate, no joins.

    The keys of rounds get new names for the union: under these it knows that its pieces are dealt out alike, so
    those in buckets of ``round_id`` are not dealt out anew.
    """
    names = [f"_key_{k}" if "round_id" in keys else k for k in keys]
    renamed = [p.withColumnsRenamed(dict(zip(keys, names, strict=True))) for p in pieces]
    merged = renamed[0]
    for p in renamed[1:]:
        merged = merged.unionByName(p, allowMissingColumns=True)
    values = [c for c in merged.columns if c not in names]
    combined = merged.groupBy(*names).agg(*[F.max(c).alias(c) for c in values])
    return combined.withColumnsRenamed(dict(zip(names, keys, strict=True)))


def summary_components(
    rounds: DataFrame, holes: DataFrame, shots: DataFrame | None, by: Sequence[str] = ()
) -> DataFrame:
    """Unrounded summary values (plus the opportunity counts practice priorities need)."""
    by = list(by)
    keys = group_keys(by)
    table = per_round_table(rounds, holes, shots, by)
    aggs = _main_aggs(shots is not None)
    main = table.groupBy(*by).agg(*aggs) if by else table.agg(*aggs).withColumn(ALL, F.lit(0))
    pieces = [main]
    if shots is not None:
        shots_k = attach(shots, rounds, by)
        pieces.append(_distance_piece(shots_k, keys))
        counts = shots_k.groupBy(*keys, "shot_type", "club").agg(F.count(F.lit(1)).alias("_n"))
        pieces.append(count_breakdown(counts, "shot_type", keys, out="shot_type_breakdown", weight="_n"))
        pieces.append(count_breakdown(counts, "club", keys, limit=5, out="club_usage_top5", weight="_n"))
    return combine(pieces, keys) if len(pieces) > 1 else main


def _finish(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """Round, fill and order the summary fields; zero everything when no rounds."""
    have = F.col("rounds_played") > 0
    for name, default in (("total_shots", F.lit(0).cast("bigint")),):
        if name not in values.columns:
            values = values.withColumn(name, default)
    cols: list[Column] = list(map(F.col, by))
    for name in SUMMARY_FIELDS:
        if name == "rounds_played":
            c = F.coalesce(F.col(name), F.lit(0)).cast("bigint")
        elif name == "rounds_other_hole_count":
            c = F.coalesce(F.col("_rounds_seen") - F.col("rounds_18_hole") - F.col("rounds_9_hole"), F.lit(0))
        elif name == "fairway_hit_pct":
            c = py_round(F.coalesce(F.col("fir_pct"), F.lit(0.0)), 2)
        elif name == "penalties_per_round":
            c = py_round(F.coalesce(F.col("penalties"), F.lit(0)) / F.col("rounds_played"), 2)
        elif name == "average_shots_per_round":
            c = py_round(F.coalesce(F.col("total_shots"), F.lit(0)) / F.col("rounds_played"), 2)
        elif name in COUNT_FIELDS:
            c = F.coalesce(F.col(name), F.lit(0))
        elif name in TEXT_FIELDS:
            c = F.coalesce(F.col(name), F.lit("")) if name in values.columns else F.lit("")
        elif name in values.columns:
            c = py_round(F.coalesce(F.col(name), F.lit(0.0)), 2)
        else:
            c = F.lit(0.0)
        if name in COUNT_FIELDS:
            c = F.when(have, c).otherwise(F.lit(0)).cast("bigint")
        elif name in TEXT_FIELDS:
            c = F.when(have, c).otherwise(F.lit(""))
        else:
            c = F.when(have, c).otherwise(F.lit(0.0)).cast("double")
        cols.append(c.alias(name))
    return values.select(*cols)


# ---------------------------------------------------------------- products
def summary(rounds: DataFrame, holes: DataFrame, shots: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Season summary: one row (or one row per ``by`` group) with 39 fields."""
    return _finish(summary_components(rounds, holes, shots, by), by)


def round_stats(rounds: DataFrame, holes: DataFrame, shots: DataFrame | None = None) -> DataFrame:
    """The summary of every round on its own, with the round's flag and comment.

    Equal to running the one-round summary for each round id; the exclusion
    flag does not apply to single-round views.
    """
    values = _finish(summary_components(rounds, holes, shots, by=["round_id"]), ["round_id"])
    meta = rounds.select(
        "round_id",
        F.coalesce(F.col("exclude_from_stats").cast("boolean"), F.lit(False)).alias("exclude_from_stats"),
        F.when(F.length(F.col("comment")) > 0, F.col("comment")).otherwise(F.lit("")).alias("comment"),
    )
    return values.join(meta.hint("merge"), on="round_id", how="left")


# Practice candidates as (label, weight, detail template); the
# template's first field is the per-18 figure with two decimals.
PRACTICE_CANDIDATES = (
    ("Penalty control", 1.0, "{} penalties per 18; focus on tee-shot and recovery discipline."),
    ("Lag putting", 1.0, "{} three-putts per 18; prioritize pace control from long range."),
    (
        "Scrambling",
        0.5,
        "{} failed saves per 18 after missed GIR; practice chips and first putts inside scoring range.",
    ),
    ("Approach play", 0.15, "{} missed greens per 18; tighten start lines and distance control into greens."),
    (
        "Driving accuracy",
        0.1,
        "{} missed fairways per 18; favor stock tee-shot shapes and conservative targets.",
    ),
)


def practice_focus(
    rounds: DataFrame, holes: DataFrame, shots: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Top three practice priorities scored in strokes per 18 holes."""
    by = list(by)
    values = summary_components(rounds, holes, shots, by)
    r2 = lambda name: py_round(F.coalesce(F.col(name), F.lit(0.0)), 2)
    opp = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    missed_gir = F.greatest(F.lit(0.0), opp("gir_opportunities_per_18") - r2("gir_per_18"))
    failed = F.greatest(F.lit(0.0), missed_gir - r2("scrambles_per_18"))
    missed_fw = F.greatest(F.lit(0.0), opp("fairway_opportunities_per_18") - r2("fir_per_18"))
    figures = [r2("penalties_per_18"), r2("three_putts_per_18"), failed, missed_gir, missed_fw]
    items = []
    for (label, weight, template), figure in zip(PRACTICE_CANDIDATES, figures, strict=True):
        head, tail = template.split("{}")
        text = F.concat(F.lit(f"{label}: {head}"), F.format_string("%.2f", py_round(figure, 2)), F.lit(tail))
        items.append(F.struct((-(figure * F.lit(weight))).alias("neg"), F.lit(label).alias("label"), text.alias("text")))
    ranked = F.slice(F.array_sort(F.filter(F.array(*items), lambda x: x["neg"] < 0)), 1, 3)
    have = (F.col("rounds_played") > 0) & (F.coalesce(F.col("_rounds_seen"), F.lit(0)) > 0)
    cols: list[Column] = list(map(F.col, by))
    cols.append(F.when(have, F.col("rounds_played")).otherwise(F.lit(0)).cast("bigint").alias("rounds_played"))
    for i in range(3):
        cols.append(
            F.when(have, F.coalesce(F.get(F.col("_ranked"), i)["text"], F.lit(""))).otherwise(F.lit("")).alias(f"priority_{i + 1}")
        )
    total = F.aggregate(F.col("_ranked"), F.lit(0.0), lambda acc, x: acc - x["neg"])
    cols.append(F.when(have, py_round(total, 2)).otherwise(F.lit(0.0)).alias("estimated_strokes_to_save_per_18"))
    return values.withColumn("_ranked", ranked).select(*cols)
