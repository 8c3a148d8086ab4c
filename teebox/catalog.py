"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the whole driver tables (through the golf-shaped views of
``teebox.sources.fixtures``) and runs one product the way the command line
of the reference would: scope first (date window, exclusion), then the
product.  The SQL oracle for each lives in ``teebox.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teebox.plans import courses as co
from teebox.plans import scope as sc
from teebox.plans import shots as sh
from teebox.plans import summary as sm
from teebox.plans import trends as tr
from teebox.operators.trim import trim_outliers
from teebox.operators import matching as mt
from teebox.operators import upsert as up
from teebox.plans import messages as msg
from teebox.plans import reports as rp
from teebox.sources import exports as ex
from teebox.sources.fixtures import CLUB_NAME_OVERRIDES, device_messages, two_source_rounds, two_source_tables
from teebox.sources.fixtures import materialized_golf_tables as golf_tables

Query = Callable[[SparkSession, str], DataFrame]


def _tables(spark: SparkSession, sf_dir: str):
    g = golf_tables(spark, sf_dir)
    shots = sc.prepared_shots(spark, g["shots"], CLUB_NAME_OVERRIDES)
    return g["rounds"], g["holes"], shots


def _scoped(spark: SparkSession, sf_dir: str) -> sc.Scope:
    rounds, holes, shots = _tables(spark, sf_dir)
    return sc.scoped_tables(rounds, holes, shots)


def q_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scoped(spark, sf_dir)
    return sm.summary(s.rounds, s.holes, s.shots)


def q_round_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds, holes, shots = _tables(spark, sf_dir)
    return sm.round_stats(rounds, holes, shots)


def q_practice_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scoped(spark, sf_dir)
    return sm.practice_focus(s.rounds, s.holes, s.shots)


def q_second_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scoped(spark, sf_dir)
    return sh.second_shots(s.holes, s.shots)


def q_tee_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scoped(spark, sf_dir)
    return sh.tee_shots(s.holes, s.shots)


def q_putting(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scoped(spark, sf_dir)
    return sh.putting(s.holes, s.shots)


def _club_scope(spark: SparkSession, sf_dir: str):
    """Club products: shots of the rounds in scope; holes unfiltered (the join narrows them)."""
    g = golf_tables(spark, sf_dir)
    return sc.club_scope(spark, g["rounds"], g["holes"], g["shots"], overrides=CLUB_NAME_OVERRIDES)


def q_club_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes, _, resolved = _club_scope(spark, sf_dir)
    return sh.club_context(holes, resolved)


def q_club_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, raw, resolved = _club_scope(spark, sf_dir)
    return sh.club_inventory(raw, resolved)


def q_trim_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, shots = _tables(spark, sf_dir)
    rows = shots.select("round_id", "hole_number", "shot_number", "club", "shot_type", "distance_meters")
    return trim_outliers(rows, ["club", "shot_type"])


def q_round_clubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, shots = _tables(spark, sf_dir)
    return sh.round_clubs(shots)


def q_round_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, shots = _tables(spark, sf_dir)
    return sh.round_shots(shots)


def q_round_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, holes, _ = _tables(spark, sf_dir)
    return sh.round_holes(holes)


def _course_rounds(spark: SparkSession, sf_dir: str):
    s = _scoped(spark, sf_dir)
    return sc.with_display_course(s.rounds), golf_tables(spark, sf_dir)["holes"]


def q_course_hole_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds, holes = _course_rounds(spark, sf_dir)
    return co.course_hole_stats(rounds, holes, by=["display_course_name"])


def q_course_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds, holes = _course_rounds(spark, sf_dir)
    return co.course_focus(co.course_hole_stats(rounds, holes, by=["display_course_name"]), by=["display_course_name"])


def q_rounds_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds, _, _ = _tables(spark, sf_dir)
    return co.rounds_list(rounds)


def q_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.courses(_scoped(spark, sf_dir).rounds)


TREND_WINDOW = 5
TREND_BY = ["player_profile_id"]


def _player_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scoped(spark, sf_dir)
    return tr.round_trends(s.rounds, s.holes, TREND_WINDOW, by=TREND_BY)


def q_round_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trends per player (the reference's single-player history, for every player), newest first."""
    return _player_trends(spark, sf_dir).orderBy(
        *[F.col(c).asc_nulls_last() for c in TREND_BY], F.col("played_on").desc_nulls_last(), F.col("round_id").desc_nulls_last()
    )


def q_metric_trend_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.metric_trend_series(_player_trends(spark, sf_dir), by=TREND_BY)


def q_canonical_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.canonical_rounds(two_source_tables(spark, sf_dir)["rounds"])


def q_round_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.match_pairs(two_source_tables(spark, sf_dir)["rounds"])


def q_last_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest canonical round of every player, whole (the selector behind a "last round" report)."""
    return mt.last_round(mt.canonical_rounds(two_source_tables(spark, sf_dir)["rounds"]), by=["player_profile_id"])


def q_last_round_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of the last canonical round of both sources, with its flag and comment."""
    t = two_source_tables(spark, sf_dir)
    rounds, holes, shots = rp.one_round(t["rounds"], t["holes"], t["shots"], last_round=True)
    return sm.round_stats(rounds, holes, sc.prepared_shots(spark, shots, CLUB_NAME_OVERRIDES))


def _reconciled(spark: SparkSession, sf_dir: str, include_excluded: bool = False) -> sc.Reconciled:
    """Both sources in scope, reconciled, with the configured club names."""
    t = two_source_tables(spark, sf_dir)
    return sc.reconciled_tables(t["rounds"], t["holes"], sc.prepared_shots(spark, t["shots"], CLUB_NAME_OVERRIDES), include_excluded=include_excluded)


def q_reconciled_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts canonical rounds; holes and shots of every round in scope, matched activities included."""
    r = _reconciled(spark, sf_dir)
    return sm.summary(r.rounds, r.holes, r.shots)


def q_reconciled_practice_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reconciled(spark, sf_dir)
    return sm.practice_focus(r.rounds, r.holes, r.shots)


def q_reconciled_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _reconciled(spark, sf_dir).canonical
    return tr.round_trends(s.rounds, s.holes, TREND_WINDOW, by=TREND_BY)


def q_reconciled_rounds_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.rounds_list(_reconciled(spark, sf_dir, include_excluded=True).rounds)


def q_reconciled_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.courses(_reconciled(spark, sf_dir).rounds)


def _reconciled_clubs(spark: SparkSession, sf_dir: str):
    """Club products: shots of canonical rounds under recorded and configured names; holes unfiltered."""
    t = two_source_tables(spark, sf_dir)
    rounds = sc.reconciled_tables(t["rounds"], t["holes"], t["shots"]).rounds
    return sc.club_scope(spark, rounds, t["holes"], t["shots"], overrides=CLUB_NAME_OVERRIDES)


def q_reconciled_club_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes, _, resolved = _reconciled_clubs(spark, sf_dir)
    return sh.club_context(holes, resolved)


def q_reconciled_club_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, raw, resolved = _reconciled_clubs(spark, sf_dir)
    return sh.club_inventory(raw, resolved)


def q_reconciled_course_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _reconciled(spark, sf_dir).canonical
    return rp.course_report_flat(s.rounds, s.holes, s.shots)


# The scope query's window is the named period "last-year" seen from this day.
SCOPE_TODAY = "1997-03-15"


def q_scoped_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of the window (exclusions dropped) with their in-scope hole and shot counts."""
    from datetime import date

    from pyspark.sql import functions as F

    rounds, holes, shots = _tables(spark, sf_dir)
    start, end = sc.resolve_date_window(period="last-year", today=date.fromisoformat(SCOPE_TODAY))
    s = sc.scoped_tables(rounds, holes, shots, date_from=start, date_to=end)
    hc = s.holes.groupBy("round_id").agg(F.count(F.lit(1)).alias("holes"))
    shc = s.shots.groupBy("round_id").agg(F.count(F.lit(1)).alias("shots"))
    out = s.rounds.select("round_id", "played_on").join(hc, "round_id", "left").join(shc, "round_id", "left")
    return out.select(
        "round_id", "played_on",
        F.coalesce("holes", F.lit(0)).cast("bigint").alias("holes"),
        F.coalesce("shots", F.lit(0)).cast("bigint").alias("shots"),
    )


UPSERT_COLUMNS = [
    "round_id", "scorecard_id", "activity_id", "played_on", "course_name", "location_name",
    "exclude_from_stats", "comment", "data_source", "player_profile_id",
]


def _reimport(spark: SparkSession, sf_dir: str, preserve: list[str]) -> DataFrame:
    """Re-import of every round (renamed courses, reset flags) plus activity rows, upserted into the stored rounds."""
    existing, _, _ = _tables(spark, sf_dir)
    incoming = (
        two_source_rounds(spark, sf_dir, golf_tables(spark, sf_dir)["rounds"])
        .withColumn("course_name", F.concat(F.lit("Re "), F.col("course_name")))
        .withColumn("exclude_from_stats", F.lit(False))
        .withColumn("comment", F.lit(None).cast("string"))
    )
    return up.upsert(existing, incoming, ["round_id"], preserve=preserve).select(*UPSERT_COLUMNS)


def q_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A re-import that keeps the user's annotations."""
    return _reimport(spark, sf_dir, ["exclude_from_stats", "comment"])


def q_upsert_whole_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A re-import that replaces rows whole."""
    return _reimport(spark, sf_dir, [])


# Rounds this far over par get flagged, with this comment.
BLOWUP_TO_PAR = 30
BLOWUP_COMMENT = "blow-up round"


def q_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    rounds, _, _ = _tables(spark, sf_dir)
    ann = rounds.filter(F.col("total_score") - F.col("total_par") >= BLOWUP_TO_PAR).select(
        "round_id", F.lit(True).alias("exclude_from_stats"), F.lit(BLOWUP_COMMENT).alias("comment")
    )
    return up.annotate(rounds, ann).select(*UPSERT_COLUMNS)


def q_message_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msg.message_inventory(device_messages(spark, sf_dir))


def _normalized(spark: SparkSession, sf_dir: str) -> ex.Normalized:
    """Every round exported as a nested JSON document, then parsed back into tables."""
    from teebox.sources.fixtures import materialized_export_documents

    return ex.normalize_documents(materialized_export_documents(spark, sf_dir))


def q_normalize_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalized(spark, sf_dir).rounds.select(
        "round_id", "scorecard_id", "played_on", "start_time", "course_name", "total_score", "total_par",
        "exclude_from_stats", "comment", "player_profile_id",
    )


def q_normalize_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalized(spark, sf_dir).holes.select(
        "round_id", "hole_number", "par", "strokes", "putts", "fairway_hit", "gir", "penalties", "fairway_shot_outcome",
    )


def q_normalize_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalized(spark, sf_dir).shots.select(
        "round_id", "hole_number", "shot_number", "scorecard_id", "shot_order", "club", "club_id",
        "distance_meters", "lie", "shot_type",
    )


# So many rounds are listed in one summary payload.
LISTED = 50


def q_export_scorecards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary payloads of 50 rounds each, details and shot payloads put together to one document a scorecard.

    Returns what each document holds, read from its JSON.
    """
    from teebox.sources.fixtures import materialized_export_documents

    v = F.explode(F.array(F.parse_json("doc")))
    docs = materialized_export_documents(spark, sf_dir).select(v.alias("v"))
    text = lambda path: F.to_json(F.try_variant_get("v", path, "variant"))
    sid = F.try_variant_get("v", "$.summary.scorecardSummaries[0].id", "bigint")
    details = docs.select(sid.alias("scorecard_id"), text("$.details[0]").alias("detail"))
    shots = docs.select(sid.alias("scorecard_id"), text("$.shots[0].payload").alias("payload"))
    rounds, _, _ = _tables(spark, sf_dir)
    row = F.struct(F.col("round_id").alias("id"), F.col("start_time").alias("startTime"), F.col("course_name").alias("courseName"))
    page = F.floor(F.col("round_id") / LISTED).alias("pageNumber")
    pages = rounds.groupBy(page).agg(F.collect_list(row).alias("scorecardSummaries"), F.count(F.lit(1)).alias("totalRows"))
    summaries = pages.select(F.to_json(F.struct("pageNumber", "totalRows", "scorecardSummaries")).alias("summary"))
    out = ex.export_scorecards(summaries, details, shots, "teebox-export", "2025-06-02T00:00:00+00:00")
    d = F.col("d")
    get = lambda path, kind: F.try_variant_get(d, path, kind)
    holes = get("$.shots[0].payload.holeShots", "array<struct<holeNumber:bigint,shots:array<variant>>>")
    return out.select("scorecard_id", F.explode(F.array(F.parse_json("doc"))).alias("d")).select(
        "scorecard_id",
        get("$.exportedAt", "string").alias("exported_at"),
        get("$.source", "string").alias("source"),
        get("$.summary.pageNumber", "bigint").alias("page_number"),
        get("$.summary.totalRows", "bigint").alias("total_rows"),
        F.size(get("$.summary.scorecardSummaries", "array<variant>")).cast("bigint").alias("listed"),
        get("$.summary.scorecardSummaries[0].id", "bigint").alias("listed_id"),
        get("$.summary.scorecardSummaries[0].courseName", "string").alias("course_name"),
        F.size(get("$.details", "array<variant>")).cast("bigint").alias("details"),
        F.coalesce(F.size(get("$.details[0].scorecardDetails[0].scorecard.holes", "array<variant>")), F.lit(0)).cast("bigint").alias("holes"),
        get("$.shots[0].scorecardId", "bigint").alias("shots_id"),
        F.aggregate(holes, F.lit(0).cast("bigint"), lambda n, h: n + F.size(h["shots"])).alias("shots"),
    )


# The first drop of export files holds rounds played before this day.
FIRST_DROP_BEFORE = "1998-01-01"


def q_incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two drops of export files (older rounds, then every round again, re-sends
    included) ingested by the streaming file source; returns the stored rounds."""
    import uuid

    from teebox.session import checkpoint_dir
    from teebox.sources.fixtures import materialized_export_documents
    from teebox.sources.tables import read_table
    from teebox.streaming import ingest

    run = f"{checkpoint_dir(spark).rstrip('/')}/teebox-ingest-{uuid.uuid4().hex}"
    docs = materialized_export_documents(spark, sf_dir)
    started = F.get_json_object("doc", "$.summary.scorecardSummaries[0].startTime")
    drops = [docs.filter(started < F.lit(FIRST_DROP_BEFORE)), docs]
    for i, drop in enumerate(drops):
        drop.select("doc").write.text(f"{run}/src/{i}", compression="gzip")
        q = ingest.start_ingest(spark, f"{run}/src/*", f"{run}/tables", f"{run}/checkpoint", force=True)
        q.awaitTermination()
    return read_table(spark, f"{run}/tables", "rounds").select(
        "round_id", "scorecard_id", "played_on", "start_time", "course_name", "total_score", "total_par",
        "exclude_from_stats", "comment", "player_profile_id",
    )

def q_course_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every course's report: course summary plus next-round focus lists."""
    s = _scoped(spark, sf_dir)
    rounds, holes, shots = _tables(spark, sf_dir)
    return rp.course_report_flat(s.rounds, holes, shots)


def q_round_second_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-shot table of every round (the one-round view, for all rounds at once)."""
    _, holes, shots = _tables(spark, sf_dir)
    return sh.second_shots(holes, shots, by=["round_id"])


def q_round_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds, holes, shots = _tables(spark, sf_dir)
    return rp.round_report(rounds, holes, shots)


# The course and hole the scoped club query looks at.
CLUB_COURSE = "1-URGENT"
CLUB_HOLE = 1


def q_club_context_course_hole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Club context limited to one course and one hole (the --course/--hole scope)."""
    g = golf_tables(spark, sf_dir)
    holes, _, resolved = sc.club_scope(
        spark, g["rounds"], g["holes"], g["shots"], course=CLUB_COURSE, hole=CLUB_HOLE, overrides=CLUB_NAME_OVERRIDES
    )
    return sh.club_context(holes, resolved)


QUERIES: dict[str, Query] = {
    "summary": q_summary,
    "round_stats": q_round_stats,
    "practice_focus": q_practice_focus,
    "second_shots": q_second_shots,
    "tee_shots": q_tee_shots,
    "putting": q_putting,
    "club_context": q_club_context,
    "club_inventory": q_club_inventory,
    "trim_outliers": q_trim_outliers,
    "round_clubs": q_round_clubs,
    "round_shots": q_round_shots,
    "round_holes": q_round_holes,
    "course_hole_stats": q_course_hole_stats,
    "course_focus": q_course_focus,
    "rounds_list": q_rounds_list,
    "courses": q_courses,
    "round_trends": q_round_trends,
    "metric_trend_series": q_metric_trend_series,
    "canonical_rounds": q_canonical_rounds,
    "last_round_stats": q_last_round_stats,
    "reconciled_summary": q_reconciled_summary,
    "reconciled_practice_focus": q_reconciled_practice_focus,
    "reconciled_trends": q_reconciled_trends,
    "reconciled_rounds_list": q_reconciled_rounds_list,
    "reconciled_courses": q_reconciled_courses,
    "reconciled_club_context": q_reconciled_club_context,
    "reconciled_club_inventory": q_reconciled_club_inventory,
    "reconciled_course_report": q_reconciled_course_report,
    "round_aliases": q_round_aliases,
    "last_round": q_last_round,
    "scoped_tables": q_scoped_tables,
    "upsert": q_upsert,
    "upsert_whole_rows": q_upsert_whole_rows,
    "annotate": q_annotate,
    "message_inventory": q_message_inventory,
    "normalize_rounds": q_normalize_rounds,
    "normalize_holes": q_normalize_holes,
    "normalize_shots": q_normalize_shots,
    "export_scorecards": q_export_scorecards,
    "incremental_ingest": q_incremental_ingest,
    "course_report": q_course_report,
    "round_second_shots": q_round_second_shots,
    "round_report": q_round_report,
    "club_context_course_hole": q_club_context_course_hole,
}
