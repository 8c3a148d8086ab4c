"""Column expressions shared by the products.

All of these are built-in Catalyst expressions (``when`` chains, string and
array functions), so they stay inside whole-stage codegen; no Python UDF.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\f\v"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Strip leading/trailing whitespace of any kind (not only spaces)."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def as_double(c: str | Column) -> Column:
    return col(c).try_cast("double")


def pct(cond: Column) -> Column:
    """Share of rows where ``cond`` holds, in percent; null predicates are skipped."""
    return F.avg(cond.cast("double")) * 100


def to_par() -> Column:
    """strokes - par as a double; null when either side is null (unscored hole)."""
    return as_double("strokes") - as_double("par")


def round_date(c: str | Column = "played_on") -> Column:
    """ISO date from the first ten characters; anything else is null."""
    return F.try_to_date(F.substring(col(c), 1, 10), "yyyy-MM-dd")


def fill_str(c: str | Column, default: str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(default))


# ----------------------------------------------------------------- shot types
def normalized_shot_type() -> Column:
    """First shot of a hole that is not a putt is a tee shot; a null type stays null."""
    t = F.col("shot_type").cast("string")
    return F.when((F.col("shot_number").cast("bigint") == 1) & (t != "PUTT"), F.lit("TEE")).otherwise(t)


# ------------------------------------------------------------- classifiers
def _outcome() -> Column:
    return F.upper(F.col("fairway_shot_outcome").cast("string"))


def start_lie() -> Column:
    """Second-shot start lie inferred from the tee-shot outcome."""
    o, hit = _outcome(), F.col("fairway_hit")
    return (
        F.when(o == "HIT", F.lit("fairway"))
        .when(o.isin("LEFT", "RIGHT", "SHORT", "LONG"), F.lit("off_fairway"))
        .when(o == "NO_FAIRWAY", F.lit("no_fairway"))
        .when(hit, F.lit("fairway"))
        .when(~hit, F.lit("off_fairway"))
        .otherwise(F.lit("unknown"))
    )


def fairway_result() -> Column:
    o, hit = _outcome(), F.col("fairway_hit")
    return (
        F.when(o == "HIT", F.lit("fairway"))
        .when(o == "LEFT", F.lit("miss_left"))
        .when(o == "RIGHT", F.lit("miss_right"))
        .when(o == "NO_FAIRWAY", F.lit("no_fairway"))
        .when(hit, F.lit("fairway"))
        .when(~hit, F.lit("missed_fairway"))
        .otherwise(F.lit("unknown"))
    )


def miss_direction() -> Column:
    o, hit = _outcome(), F.col("fairway_hit")
    return (
        F.when(o == "LEFT", F.lit("left"))
        .when(o == "RIGHT", F.lit("right"))
        .when(o == "HIT", F.lit("none"))
        .when(o == "NO_FAIRWAY", F.lit("not_applicable"))
        .when(hit, F.lit("none"))
        .otherwise(F.lit("unknown"))
    )


def club_context() -> Column:
    """Where in the hole a club was used; the first matching rule wins."""
    t, n, par = F.col("shot_type"), F.col("shot_number"), F.col("par")
    tee = (
        F.when(par == 3, F.lit("tee_par_3"))
        .when(par == 4, F.lit("tee_par_4"))
        .when(par == 5, F.lit("tee_par_5"))
        .otherwise(F.lit("tee_other"))
    )
    return (
        F.when(t == "PUTT", F.lit("putt"))
        .when(n == 1, tee)
        .when((n == 2) & (par == 4), F.lit("approach_par_4"))
        .when((n == 2) & (par == 5), F.lit("second_par_5"))
        .when(t.isin("CHIP", "PITCH", "BUNKER"), F.lit("short_game"))
        .when(F.lower(F.col("lie")).contains("green"), F.lit("putt"))
        .when(t.isin("LAYUP", "RECOVERY"), F.lower(t))
        .otherwise(F.lit("other"))
    )


# First-putt distance buckets, half-open upper bounds in metres,
# with their labels in order; the last label takes everything beyond.
PUTT_BUCKET_BOUNDS = (1.0, 2.0, 3.0, 5.0, 10.0, 15.0)
PUTT_BUCKET_LABELS = ("0-1m", "1-2m", "2-3m", "3-5m", "5-10m", "10-15m", "15m+")


def putt_bucket(c: str | Column) -> tuple[Column, Column]:
    """(label, sort key) of a first-putt distance."""
    d = col(c)
    label = F.lit(PUTT_BUCKET_LABELS[-1])
    order = F.lit(len(PUTT_BUCKET_BOUNDS))
    for i in range(len(PUTT_BUCKET_BOUNDS) - 1, -1, -1):
        label = F.when(d < PUTT_BUCKET_BOUNDS[i], F.lit(PUTT_BUCKET_LABELS[i])).otherwise(label)
        order = F.when(d < PUTT_BUCKET_BOUNDS[i], F.lit(i)).otherwise(order)
    return label, order


# ------------------------------------------------------------ course names
def display_course_name() -> Column:
    """Course name unless blank, else the location name."""
    c = F.col("course_name").cast("string")
    return F.when(strip(c) != "", c).otherwise(F.col("location_name").cast("string"))


def trend_course_name() -> Column:
    """First non-blank of display name, course name, location name (value untrimmed)."""
    parts = []
    for v in (display_course_name(), F.col("course_name").cast("string"), F.col("location_name").cast("string")):
        parts.append(F.when(strip(v) != "", v))
    return F.coalesce(*parts)


# ------------------------------------------------------------ club names
def override_rows(overrides: Mapping[object, object]) -> list[tuple[int, str]]:
    """Integer-keyed override rows; keys that are not integers are dropped."""
    rows = []
    for key, value in overrides.items():
        try:
            k = int(key)  # type: ignore[arg-type]
        except (TypeError, ValueError):
            continue
        rows.append((k, None if value is None else str(value)))
    return rows


# ----------------------------------------------------------------- averages
# Distances are summed exactly at micrometre precision.
EXACT_SUM_TYPE = "decimal(38,6)"


def exact_mean(c: str | Column) -> Column:
    """Mean whose value does not depend on row order or partitioning.

    A floating-point sum depends on the order rows arrive in, so the same
    data split over a different number of tasks can land a mean on the other
    side of a rounding tie.  Summing exactly (fixed-point) and dividing once
    gives one answer on any cluster size.
    """
    x = col(c).try_cast(EXACT_SUM_TYPE)
    return F.sum(x).cast("double") / F.count(x)


# ----------------------------------------------------------------- rounding
def py_round(c: str | Column, digits: int) -> Column:
    """Round like Python's ``round`` on a float: the binary value decides, exact ties go to even.

    The engine's ``round`` rounds the shortest decimal string half-up, which
    turns 132.105 (really 132.10499...) into 132.11; scaling first keeps the
    binary value's side of the tie.
    """
    m = float(10**digits)
    return F.bround(col(c) * F.lit(m), 0) / F.lit(m)


def table_round(c: str | Column, digits: int) -> Column:
    """Round like a columnar engine's ``round``: scale, round half away from zero, unscale."""
    m = float(10**digits)
    return F.round(col(c) * F.lit(m), 0) / F.lit(m)


# The ISO forms a start time may have; a zone is an offset or Z.
START_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
START_ZONE = r":.*(Z|[+-]\d{2}:?\d{2})$"


def wall_micros(start: str, zone: str | None = None) -> Column:
    """Microseconds of a start time's wall clock, null if it is none.

    A time with an offset is first moved to ``zone`` (None: the session's time zone); one
    without is taken as it is, so no daylight-saving rule of the session touches it.
    """
    text = strip(F.col(start))
    moved = text.try_cast("timestamp").cast("timestamp_ntz")
    if zone is not None:
        moved = F.convert_timezone(None, F.lit(zone), moved)
    wall = F.when(text.rlike(START_TIME), F.when(text.rlike(START_ZONE), moved).otherwise(text.try_cast("timestamp_ntz")))
    days = F.unix_date(wall.cast("date")).cast("long") * 86_400_000_000
    clock = (F.hour(wall) * 60 + F.minute(wall)).cast("long") * 60_000_000
    return days + clock + (F.date_part(F.lit("SECOND"), wall) * 1_000_000).cast("long")
