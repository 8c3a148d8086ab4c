"""Composite reports: one nested row per course, or per round.

Each report is the join of products already keyed by the same group
(course name, or round id).  Per-group lists (a course's holes, a round's
holes, clubs, shots and second-shot groups) are bounded by the size of one
course or one round, so collecting them per group is safe at any scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teebox.operators.upsert import annotate, upsert
from teebox.plans import courses as co
from teebox.plans import shots as sh
from teebox.plans import summary as sm
from teebox.plans.scope import filter_course, resolve_round, restrict, with_display_course

COURSE = "display_course_name"


def _nest(df: DataFrame, keys: list[str], name: str, order: list[str]) -> DataFrame:
    """Collect the non-key columns of ``df`` into one sorted array per key."""
    fields = [c for c in df.columns if c not in keys]
    item = F.struct(*[F.col(c) for c in order], F.struct(*fields).alias("row"))
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["row"]).alias(name))


def course_report_flat(rounds: DataFrame, holes: DataFrame, shots: DataFrame) -> DataFrame:
    """Per course: the course summary fields and the four focus lists."""
    r = with_display_course(rounds)
    summary = sm.summary(r, holes, shots, by=[COURSE])
    hole_stats = co.course_hole_stats(r, holes, by=[COURSE])
    focus = co.course_focus(hole_stats, by=[COURSE])
    return summary.join(focus, on=COURSE, how="left")


def course_report(rounds: DataFrame, holes: DataFrame, shots: DataFrame) -> DataFrame:
    """Per course: ``summary`` struct, ``focus`` struct and ``holes`` list (hardest first)."""
    r = with_display_course(rounds)
    summary = sm.summary(r, holes, shots, by=[COURSE])
    hole_stats = co.course_hole_stats(r, holes, by=[COURSE])
    focus = co.course_focus(hole_stats, by=[COURSE])
    ranked = hole_stats.withColumn("_k1", -F.col("avg_to_par")).withColumn("_k2", -F.col("penalty_rate"))
    holes_list = _nest(ranked, [COURSE], "holes", ["_k1", "_k2", "hole_number"])
    holes_list = holes_list.withColumn(
        "holes", F.transform("holes", lambda x: x.dropFields("_k1", "_k2"))
    )
    return (
        summary.select(COURSE, F.struct(*[c for c in summary.columns if c != COURSE]).alias("summary"))
        .join(focus.select(COURSE, F.struct(*[c for c in focus.columns if c != COURSE]).alias("focus")), COURSE, "left")
        .join(holes_list, COURSE, "left")
    )


def round_report(rounds: DataFrame, holes: DataFrame, shots: DataFrame) -> DataFrame:
    """Per round: ``summary`` struct plus ``holes``, ``clubs``, ``shots`` and ``second_shots`` lists.

    Every part is aggregated by the round, and one union and one aggregate gather them: tables in
    buckets of ``round_id`` need no shuffle, and a task works on one part after the other instead of
    holding them all sorted for joins.  Each list sorts by the first fields of its rows.
    """
    club_rows = sh.round_clubs(shots, arranged=False)
    parts = {
        "holes": sh.round_holes(holes, arranged=False),
        "clubs": club_rows.select("round_id", (-F.col("shots")).alias("_k"), *[c for c in club_rows.columns if c != "round_id"]),
        "shots": sh.round_shots(shots, arranged=False),
        "second_shots": sh.second_shots(holes, shots, by=["round_id"], arranged=False),
    }

    def items(part: DataFrame, name: str) -> DataFrame:
        return part.select(F.col("round_id").alias("_round"), F.struct(*[c for c in part.columns if c != "round_id"]).alias(name))

    rows = items(sm.round_stats(rounds, holes, shots), "summary")
    for name, part in parts.items():  # a null id has a summary, but no rows of its own
        rows = rows.unionByName(items(part.filter(F.col("round_id").isNotNull()), name), allowMissingColumns=True)
    lists = [F.array_sort(F.collect_list(name)).alias(name) for name in parts]
    gathered = rows.groupBy("_round").agg(F.collect_list("summary").alias("_summaries"), *lists)
    gathered = gathered.withColumn("clubs", F.transform("clubs", lambda x: x.dropFields("_k")))
    # a round listed twice has two summaries, one known from its holes alone none
    return gathered.select(
        F.col("_round").alias("round_id"), F.explode("_summaries").alias("summary"), *[F.when(F.size(name) > 0, F.col(name)).alias(name) for name in parts]
    )


def one_round(rounds: DataFrame, holes: DataFrame, shots: DataFrame, round_id: int | None = None, last_round: bool = False):
    """(canonical row, holes, shots) of one selected round: by its id, a matched activity's id, or the last one.

    The flag that excludes a round does not apply to a single round.
    """
    selected, row = resolve_round(rounds, round_id, last_round)
    mine = F.col("round_id") == F.lit(selected)
    return row, holes.filter(mine), shots.filter(mine)


def course_reports(rounds: DataFrame, holes: DataFrame, shots: DataFrame, course: str) -> DataFrame:
    """The nested report of one course; an unknown name fails with it."""
    of_course = filter_course(rounds, course)
    return course_report(of_course, restrict(holes, of_course), restrict(shots, of_course))


def annotate_round(
    rounds: DataFrame, round_id: int | None = None, last_round: bool = False, exclude: bool | None = None, comment: str | None = None
) -> DataFrame:
    """The rounds table with one selected round's flag or comment set; an empty comment clears it.

    The selector resolves as for a report, and the canonical row replaces the stored one whole.
    """
    _, row = resolve_round(rounds, round_id, last_round)
    row = row.select(*rounds.columns)
    note = row.select("round_id", F.lit(exclude).cast("boolean").alias("exclude_from_stats"), F.lit(comment).cast("string").alias("comment"))
    return upsert(rounds, annotate(row, note), ["round_id"])
