"""Reconcile rounds recorded twice: device activities matched to scorecards.

A row is a *scorecard* when it has a scorecard id, else an *activity* when it
has an activity id, else a scorecard (which stays, but is no candidate).  The
activities of a day, in order of start time and id, each take one unused
scorecard of that day.  Candidates are the unused ones of the same player (an
unknown player fits everyone); if there are none, all unused ones of the day.
Of the candidates the nearest start within the tolerance (inclusive) is taken,
the earlier of two equally near; when none is timed within it, the only
candidate left, however far off.  Matched pairs merge (scorecard values win,
nulls included; activity id and an empty location come from the activity);
matched activities disappear.

``by`` names the columns that tell datasets apart (owner, tenant): rows of
different datasets never meet.  Without it the table is one dataset.

The rule is sequential within a day.  It is run in parallel like this:

  1. only days holding both kinds take part;
  2. a day of more than ``whole_day`` candidates is cut into *sessions* wherever no start lies within the tolerance
     of the one before.  A gap that wide never falls inside a bucket of the
     tolerance's length, so the cuts come from each bucket's first and last
     start, a few rows a day.  Rounds without a start are the day's last session;
  3. sessions run in parallel, each one walked in order by ``mapInArrow``.  A
     nearest start always lies in the activity's own session.  What a session
     has to know of the others is how many cards of a player they still hold
     when it begins and, when it is one, which (a count and an xor of ids), and
     which of its own cards an earlier session took as its only candidate;
  4. the first pass takes it that no session used a card before; later passes take
     the cards used by earlier sessions in the pass before, and repeat only the
     days whose counts that changes.  The day's first session is right after the
     first pass, the second after the second, and so on, so the passes end, at the
     latest, after as many as the day has sessions, with the sequential result.

A day that isn't cut is one session.  One session is one task: it holds the session's scorecards, and streams its
activities.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from teebox.functions.expressions import display_course_name, wall_micros
from teebox.session import checkpoint_dir, ship_package
from teebox.sources.tables import remove_folder

TOLERANCE_SECONDS = 2 * 3600
WHOLE_DAY = 20_000  # candidates; a day of no more is one session
UNTIMED = 1 << 30  # the session of rounds without a start: the last of its day
OUTSIDE, CARD, ACTIVITY = 0, 1, 2  # kinds of rows a session reads, in this order
PAIRS = "_day string, _session int, activity_round_id long, scorecard_round_id long"


def with_kind(rounds: DataFrame) -> DataFrame:
    is_card = F.col("scorecard_id").isNotNull() | F.col("activity_id").isNull()
    return rounds.withColumn("_is_activity", ~is_card)


# ---------------------------------------------------------- one session's walk
class _Line:
    """Cards in order of (start, id), from which cards are removed."""

    def __init__(self, cards: list[tuple[int, int]]):
        self.cards = cards
        self.starts = [start for start, _ in cards]
        self.right = list(range(len(cards) + 1))  # the next card that is left, itself included
        self.left = list(range(len(cards) + 1))  # the same backwards, shifted by one

    @staticmethod
    def _find(links: list[int], i: int) -> int:
        end = i
        while links[end] != end:
            end = links[end]
        while links[i] != end:
            links[i], i = end, links[i]
        return end

    def remove(self, i: int) -> None:
        self.right[i] = i + 1
        self.left[i + 1] = i

    def first(self, i: int = 0) -> int | None:
        i = self._find(self.right, i)
        return i if i < len(self.cards) else None

    def nearest(self, start: int, tolerance: int) -> tuple[int, int, int] | None:
        """(distance, start, id) of the nearest card within the tolerance; the earlier start, then the smaller id."""
        at = bisect_left(self.starts, start)
        found = []
        before = self._find(self.left, at) - 1
        if before >= 0:
            found.append(self.first(bisect_left(self.starts, self.starts[before])))
        after = self.first(at)
        if after is not None:
            found.append(after)
        near = [(abs(self.starts[i] - start), *self.cards[i]) for i in found]
        best = min(near, default=None)
        return best if best is not None and best[0] <= tolerance else None


class _Rest:
    """How many cards other sessions hold, and an xor of their ids and players."""

    __slots__ = ("n", "ids", "players", "unknown")

    def __init__(self, n: int = 0, ids: int = 0, players: int = 0, unknown: int = 0):
        self.n, self.ids, self.players, self.unknown = n, ids, players, unknown

    def take(self, card: int, player: int | None) -> None:
        self.n -= 1
        self.ids ^= card
        self.players ^= player or 0
        self.unknown ^= player is None


class _Session:
    """Cards of one session, and the matching of its activities in order."""

    def __init__(self, tolerance: int):
        self.tolerance = tolerance
        self.outside, self.total, self.taken = {}, _Rest(), set()
        self.timed: list[tuple[int, int, int | None]] = []
        self.untimed: dict[int | None, dict[int, None]] = {}
        self.here: dict[int | None, int] = {}
        self.lines: dict | None = None

    def add_outside(self, whole: bool | None, player: int | None, n: int, ids: int, players: int, unknown: int) -> None:
        if whole is None:
            self.taken.add(ids)
        elif whole:
            self.total = _Rest(n, ids, players, unknown)
        else:
            self.outside[player] = _Rest(n, ids, players, unknown)

    def add_card(self, card: int, player: int | None, start: int | None) -> None:
        if card in self.taken:
            return
        self.here[player] = self.here.get(player, 0) + 1
        if start is None:
            self.untimed.setdefault(player, {})[card] = None
        else:
            self.timed.append((start, card, player))

    def _index(self) -> None:
        """A line of all timed cards and one of each player's; places of a card in both."""
        self.left = sum(self.here.values())
        split: dict = {}
        self.at = {}
        for i, (start, card, player) in enumerate(self.timed):
            line = split.setdefault(player, [])
            self.at[card] = (player, i, len(line))
            line.append((start, card))
        self.lines = {player: _Line(line) for player, line in split.items()}
        self.all = _Line([(start, card) for start, card, _ in self.timed])

    def match(self, player: int | None, start: int | None) -> int | None:
        """The card that the next activity takes."""
        if self.lines is None:
            self._index()
        pool = None if player is None else [player, None]
        if pool is not None:
            n = sum(self.here.get(p, 0) + (self.outside[p].n if p in self.outside else 0) for p in pool)
            if n == 0:
                pool = None
        if pool is None:
            n = self.left + self.total.n
        if n == 0:
            return None
        lines = [self.all] if pool is None else [self.lines[p] for p in pool if p in self.lines]
        if start is not None:
            near = [x for x in (line.nearest(start, self.tolerance) for line in lines) if x]
            if near:
                return self._take(min(near)[2])
        return self._only(pool, lines) if n == 1 else None

    def _only(self, pool: list | None, lines: list[_Line]) -> int:
        for line in lines:
            i = line.first()
            if i is not None:
                return self._take(line.cards[i][1])
        for p in self.untimed if pool is None else pool:
            for card in self.untimed.get(p, ()):
                del self.untimed[p][card]
                self.here[p] -= 1
                self.left -= 1
                return card
        if pool is None:
            card, owner = self.total.ids, None if self.total.unknown else self.total.players
        else:
            owner = next(p for p in pool if p in self.outside and self.outside[p].n)
            card = self.outside[owner].ids
        self.total.take(card, owner)
        if owner in self.outside:
            self.outside[owner].take(card, owner)
        return card

    def _take(self, card: int) -> int:
        player, i, j = self.at[card]
        self.all.remove(i)
        self.lines[player].remove(j)
        self.here[player] -= 1
        self.left -= 1
        return card


def _walk(batches: Iterator[pa.RecordBatch], tolerance: int) -> Iterator[pa.RecordBatch]:
    """Pairs of the sessions of one sorted partition."""
    session, current = None, None
    for batch in batches:
        out = []
        for day, number, kind, round_id, player, start, whole, n, ids, players, unknown in zip(*(c.to_pylist() for c in batch.columns)):
            if (day, number) != current:
                session, current = _Session(tolerance), (day, number)
            if kind == OUTSIDE:
                session.add_outside(whole, player, n, ids, players, unknown)
            elif kind == CARD:
                session.add_card(round_id, player, start)
            else:
                card = session.match(player, start)
                if card is not None:
                    out.append((day, number, round_id, card))
        columns = zip(*out) if out else ([], [], [], [])
        types = (pa.string(), pa.int32(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["_day", "_session", "activity_round_id", "scorecard_round_id"])


# -------------------------------------------------------------- the whole table
class _Shelf:
    """Tables of one run in the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{checkpoint_dir(spark).rstrip('/')}/teebox-matching/{uuid.uuid4().hex}", 0

    def written(self, df: DataFrame, name: str = "step") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{name}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "step") -> None:
        remove_folder(self.spark, f"{self.root}/{name}")


def _candidates(rounds: DataFrame, by: Sequence[str], zone: str | None) -> DataFrame:
    """_day, _kind, round_id, _player, _start of every row that may take part."""
    kinded = with_kind(rounds).filter(F.col("played_on").isNotNull() & F.col("round_id").isNotNull())
    # a round with neither id stays in the list but is no candidate
    kinded = kinded.filter(F.col("_is_activity") | F.col("scorecard_id").isNotNull())
    return kinded.select(
        (F.to_json(F.struct(*by, "played_on")) if by else F.col("played_on")).alias("_day"),
        F.when(F.col("_is_activity"), ACTIVITY).otherwise(CARD).alias("_kind"),
        "round_id",
        F.col("player_profile_id").alias("_player"),
        wall_micros("start_time", zone).alias("_start"),
    )


def _sessions(rows: DataFrame, tolerance: int, whole_day: int) -> DataFrame:
    """The candidates of contested days, with their session (0 on all of a day that isn't cut)."""
    rows = rows.withColumn("_bucket", F.floor(F.col("_start") / tolerance))
    spans = rows.groupBy("_day", "_bucket").agg(F.min("_start").alias("_first"), F.max("_start").alias("_last"), F.min("_kind").alias("_a"), F.max("_kind").alias("_b"), F.count(F.lit(1)).alias("_n"))
    day = Window.partitionBy("_day")
    order = day.orderBy("_bucket")
    gap = (F.col("_first") - F.lag("_last").over(order) > tolerance).cast("int")
    numbered = (
        spans.withColumn("_gap", F.coalesce(gap, F.lit(0)))
        .withColumn("_number", F.when(F.sum("_n").over(day) <= whole_day, 0).when(F.col("_first").isNull(), UNTIMED).otherwise(F.sum("_gap").over(order)).cast("int"))
        .withColumn("_contested", F.min("_a").over(day) != F.max("_b").over(day))
    )
    numbered = numbered.filter("_contested").select("_day", F.coalesce("_bucket", F.lit(UNTIMED)).alias("_bucket"), F.col("_number").alias("_session"))
    rows = rows.withColumn("_bucket", F.coalesce("_bucket", F.lit(UNTIMED)))
    return rows.join(numbered, ["_day", "_bucket"]).select("_day", "_session", "_kind", "round_id", "_player", "_start")


def _outside(rows: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """For each session: cards of other sessions that no earlier session has used, in all and by player.

    Players that no activity of the session belongs to are left out, but for the unknown one.
    Its own cards that an earlier session has used come as rows of their own, without ``_whole``.
    """
    cards = rows.filter(F.col("_kind") == CARD).select("_day", F.col("_session").alias("_at"), "round_id", "_player")
    if pairs is None:
        cards = cards.withColumn("_used", F.lit(None).cast("int"))
    else:
        # until the passes end two sessions may hold the same card: the earlier one has it
        used = pairs.groupBy("_day", F.col("scorecard_round_id").alias("round_id")).agg(F.min("_session").alias("_used"))
        cards = cards.join(used, ["_day", "round_id"], "left")

    def rest(*columns):
        return [F.sum(columns[0]).alias("n")] + [F.bit_xor(c).alias(name) for c, name in zip(columns[1:], ("ids", "players", "unknown"))]

    held = cards.groupBy("_day", "_at", "_used", "_player").agg(
        *rest(F.lit(1), F.col("round_id"), F.coalesce("_player", F.lit(0)), F.col("_player").isNull().cast("long"))
    )
    asking = rows.filter(F.col("_kind") == ACTIVITY).select("_day", "_session", "_player").distinct()
    sessions = asking.select("_day", "_session").distinct()
    free = (F.col("_at") != F.col("_session")) & (F.col("_used").isNull() | (F.col("_used") >= F.col("_session")))
    left = held.join(sessions, "_day").filter(free)
    again = rest("n", "ids", "players", "unknown")
    by_player = left.groupBy("_day", "_session", "_player").agg(*again)
    players = asking.unionByName(sessions.withColumn("_player", F.lit(None).cast("long"))).distinct()
    same = [by_player["_day"] == players["_day"], by_player["_session"] == players["_session"], by_player["_player"].eqNullSafe(players["_player"])]
    wanted = by_player.join(players, same, "left_semi").withColumn("_whole", F.lit(False))
    whole = by_player.groupBy("_day", "_session").agg(*again).withColumn("_player", F.lit(None).cast("long")).withColumn("_whole", F.lit(True))
    taken = cards.filter(F.col("_used") < F.col("_at")).select("_day", F.col("_at").alias("_session"), F.col("round_id").alias("ids"))
    return wanted.unionByName(whole).unionByName(taken, allowMissingColumns=True)


def _matched(rows: DataFrame, outside: DataFrame, tolerance: int) -> DataFrame:
    read = rows.unionByName(outside.withColumn("_kind", F.lit(OUTSIDE)), allowMissingColumns=True)
    read = read.select("_day", "_session", "_kind", "round_id", "_player", "_start", "_whole", "n", "ids", "players", "unknown")
    ordered = read.repartition("_day", "_session").sortWithinPartitions("_day", "_session", "_kind", F.col("_start").asc_nulls_last(), F.col("round_id").asc_nulls_last())

    def run(batches):
        return _walk(batches, tolerance)

    return ordered.mapInArrow(run, PAIRS)


def match_pairs(rounds: DataFrame, tolerance_seconds: float = TOLERANCE_SECONDS, by: Sequence[str] = (), zone: str | None = None, whole_day: int = WHOLE_DAY) -> DataFrame:
    """(activity_round_id, scorecard_round_id) for every matched activity.

    ``zone``: where start times with an offset are read (the session's time zone
    if None); those without one are taken as they are.
    """
    ship_package(rounds.sparkSession)
    tolerance = int(tolerance_seconds * 1_000_000)
    shelf = _Shelf(rounds.sparkSession)
    rows = shelf.written(_sessions(shelf.written(_candidates(rounds, by, zone)), tolerance, whole_day))
    cut = rows.join(rows.filter(F.col("_session") != 0).select("_day").distinct(), "_day", "left_semi")
    outside = shelf.written(_outside(cut, None))
    pairs = shelf.written(_matched(rows, outside, tolerance))
    # a day of one session is settled; the others are looked at until nothing changes
    rows = cut
    while not outside.isEmpty():
        now = shelf.written(_outside(rows, pairs))
        changed = shelf.written(now.exceptAll(outside).unionByName(outside.exceptAll(now)).select("_day").distinct())
        if changed.isEmpty():
            break
        rows = shelf.written(rows)
        again = _matched(rows.join(changed, "_day", "left_semi"), now.join(changed, "_day", "left_semi"), tolerance)
        pairs = shelf.written(pairs.join(changed, "_day", "left_anti").unionByName(again))
        outside = now
    pairs = shelf.written(pairs.select("activity_round_id", "scorecard_round_id"), "pairs")
    shelf.drop()
    return pairs


def canonical_rounds(rounds: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Scorecards (merged with their matched activity) plus unmatched activities."""
    pairs = match_pairs(rounds) if pairs is None else pairs
    cols = rounds.columns
    kinded = with_kind(rounds)
    cards = kinded.filter(~F.col("_is_activity")).drop("_is_activity")
    acts = kinded.filter(F.col("_is_activity")).drop("_is_activity")
    act_side = acts.select(
        F.col("round_id").alias("_a_round_id"),
        F.col("activity_id").alias("_a_activity_id"),
        F.col("location_name").alias("_a_location_name"),
    )
    # pairs meet their activities first: a few rows move, the cards stay where they are
    found = pairs.join(act_side.hint("merge"), pairs["activity_round_id"] == F.col("_a_round_id"), "left")
    merged = cards.join(found.hint("merge"), cards["round_id"] == F.col("scorecard_round_id"), "left")
    matched = F.col("_a_round_id").isNotNull()
    loc = F.col("location_name")
    merged = merged.select(
        *[
            (
                F.when(matched & F.col("activity_id").isNull(), F.col("_a_activity_id")).otherwise(F.col("activity_id"))
                if c == "activity_id"
                else F.when(matched & (loc.isNull() | (loc == "")), F.col("_a_location_name")).otherwise(loc)
                if c == "location_name"
                else F.when(matched, F.lit("scorecard+activity")).otherwise(F.col("data_source"))
                if c == "data_source"
                else F.col(c)
            ).alias(c)
            for c in cols
        ]
    )
    unmatched = acts.join(pairs.hint("merge"), acts["round_id"] == pairs["activity_round_id"], "left_anti").select(*cols)
    return merged.unionByName(unmatched)


def last_round(rounds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The most recent round, whole, with its display course name: by played_on, start_time and round_id, all descending, nulls last.

    One row for each ``by`` group; a hot group is folded by partial aggregates, never sorted.
    """
    order = F.struct("played_on", "start_time", "round_id")
    named = rounds.withColumn("display_course_name", display_course_name())
    whole = F.max_by(F.struct(*named.columns), order).alias("_row")
    return (named.groupBy(*by).agg(whole) if by else named.agg(whole)).select("_row.*").filter(F.col("round_id").isNotNull())
