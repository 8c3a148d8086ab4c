"""Reconciliation against the plain sequential rule, whatever the cut into sessions."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from teebox.operators.matching import CARD, _candidates, _sessions, canonical_rounds, last_round, match_pairs
from teebox.operators.upsert import upsert
from teebox.plans.reports import annotate_round, course_reports, one_round, round_report
from teebox.plans.scope import filter_round, reconciled_tables


def start(row):
    try:
        return datetime.fromisoformat((row["start_time"] or "").strip())
    except ValueError:
        return None


def sequential(rows):
    """Every day's activities in order, each taking its card; see the module's docstring."""
    days, pairs = {}, set()
    for r in rows:
        kind = 0 if r["scorecard_id"] is not None else 1 if r["activity_id"] is not None else None
        if kind is not None and r["played_on"] is not None:
            days.setdefault(r["played_on"], ([], []))[kind].append(r)
    order = lambda r: (start(r) is None, start(r) or datetime.min, r["round_id"])
    for cards, activities in days.values():
        left = sorted(cards, key=order)
        for a in sorted(activities, key=order):
            fits = lambda c: None in (c["player_profile_id"], a["player_profile_id"]) or c["player_profile_id"] == a["player_profile_id"]
            pool = [c for c in left if fits(c)] or left
            near = [(abs(start(c) - start(a)), i) for i, c in enumerate(pool) if start(c) and start(a) and abs(start(c) - start(a)).total_seconds() <= 7200]
            card = pool[min(near)[1]] if near else pool[0] if len(pool) == 1 else None
            if card:
                left.remove(card)
                pairs.add((a["round_id"], card["round_id"]))
    return pairs


def random_rounds(seed, n=900):
    rng = random.Random(seed)
    rows = []
    for i in range(1, n + 1):
        day = None if rng.random() < 0.03 else rng.choice(["2024-01-01", "2024-01-02", f"2024-05-{rng.randint(1, 28):02d}", f"20{rng.randint(10, 99)}-03-{rng.randint(1, 28):02d}"])
        clock = f"{rng.choice([0, 1, 5, 6, 9, 13, 14, 18, 22]):02d}:{rng.choice([0, 0, 15, rng.randint(0, 59)]):02d}:00"
        kind = rng.random()
        rows.append({
            "round_id": i, "scorecard_id": i if kind < 0.5 else None, "activity_id": i if 0.5 <= kind < 0.97 else None, "played_on": day,
            "start_time": rng.choice([None, "bad", ""]) if rng.random() < 0.12 else f"{day or '2024-01-01'}T{clock}",
            "player_profile_id": None if rng.random() < 0.25 else rng.randint(1, rng.choice([2, 9, 40])),
        })
    return rows


@pytest.mark.parametrize("seed,whole_day", [(0, 0), (1, 60), (2, 20_000)])
def test_same_pairs_as_the_sequential_rule(mk, seed, whole_day):
    rows = random_rounds(seed)
    assert {tuple(p) for p in match_pairs(mk("rounds", rows), whole_day=whole_day).collect()} == sequential(rows)


def test_hot_day_of_unknown_players_runs_in_many_sessions(mk):
    rng = random.Random(7)
    rows = [
        {"round_id": i, "scorecard_id": i if i % 2 else None, "activity_id": None if i % 2 else i, "played_on": "1970-01-01",
         "start_time": f"1970-01-01T{rng.choice([0, 4, 8, 12, 16, 20]):02d}:{rng.randint(0, 59):02d}:00", "player_profile_id": None}
        for i in range(1, 601)
    ]
    frame = mk("rounds", rows)
    cut = _sessions(_candidates(frame, (), None), 7200 * 1_000_000, 100)
    assert cut.select("_session").distinct().count() == 6 and cut.filter(F.col("_kind") == CARD).count() == 300
    assert {tuple(p) for p in match_pairs(frame, whole_day=100).collect()} == sequential(rows)


def test_unknown_player_fits_everyone_and_a_stranger_takes_what_is_left(mk):
    rows = [
        {"round_id": 1, "scorecard_id": 1, "played_on": "2024-02-01", "start_time": "2024-02-01T09:00:00", "player_profile_id": 8},
        {"round_id": 2, "scorecard_id": 2, "played_on": "2024-02-01", "start_time": "2024-02-01T09:30:00", "player_profile_id": None},
        {"round_id": 3, "activity_id": 3, "played_on": "2024-02-01", "start_time": "2024-02-01T09:05:00", "player_profile_id": 9},
        {"round_id": 4, "activity_id": 4, "played_on": "2024-02-01", "start_time": "2024-02-01T09:10:00", "player_profile_id": 7},
    ]
    # 3 prefers the unknown player's card to the nearer one of player 8; 4 finds no card that fits and takes it
    assert sorted(map(tuple, match_pairs(mk("rounds", rows)).collect())) == [(3, 2), (4, 1)]


def test_datasets_never_meet(mk):
    rows = [
        {"round_id": 1, "scorecard_id": 1, "played_on": "2024-02-01", "start_time": "2024-02-01T09:00:00", "player_profile_id": 8},
        {"round_id": 2, "activity_id": 2, "played_on": "2024-02-01", "start_time": "2024-02-01T09:00:00", "player_profile_id": 9},
    ]
    frame = mk("rounds", rows)
    assert match_pairs(frame).count() == 1
    assert match_pairs(frame, by=["player_profile_id"]).count() == 0


def test_zone_of_start_times(mk):
    rows = [
        {"round_id": 1, "scorecard_id": 1, "played_on": "2024-07-01", "start_time": "2024-07-01T14:00:00", "player_profile_id": 1},
        {"round_id": 3, "scorecard_id": 3, "played_on": "2024-07-01", "start_time": "2024-07-01T20:00:00", "player_profile_id": 1},
        {"round_id": 2, "activity_id": 2, "played_on": "2024-07-01", "start_time": " 2024-07-01T18:30:00Z ", "player_profile_id": 1},
    ]
    frame = mk("rounds", rows)
    assert [tuple(p) for p in match_pairs(frame).collect()] == [(2, 3)]
    assert [tuple(p) for p in match_pairs(frame, zone="America/New_York").collect()] == [(2, 1)]


def test_reconciled_scope_carries_two_sets_of_ids(mk):
    rounds = mk("rounds", [
        {"round_id": 10, "scorecard_id": 10, "played_on": "2024-02-01", "start_time": "2024-02-01T09:00:00", "course_name": " ", "player_profile_id": 8},
        {"round_id": 20, "activity_id": 20, "played_on": "2024-02-01", "start_time": "2024-02-01T09:40:00", "location_name": "Dunes", "player_profile_id": 8},
        {"round_id": 30, "activity_id": 30, "played_on": "2024-02-02", "location_name": "Heath"},
        {"round_id": 40, "scorecard_id": 40, "played_on": "2024-02-03", "exclude_from_stats": True},
    ])
    holes = mk("holes", [{"round_id": r, "hole_number": 1} for r in (10, 20, 30, 40, 50)])
    shots = mk("shots", [{"round_id": r, "hole_number": 1, "shot_number": 1} for r in (10, 20, 30, 40, 50)])
    scope = reconciled_tables(rounds, holes, shots)
    assert {r.round_id: r.display_course_name for r in scope.rounds.collect()} == {10: "Dunes", 30: "Heath"}
    assert sorted(r.round_id for r in scope.holes.collect()) == [10, 20, 30]
    assert sorted(r.round_id for r in scope.shots.collect()) == [10, 20, 30]
    assert sorted(r.round_id for r in scope.canonical.holes.collect()) == [10, 30]
    assert sorted(r.round_id for r in scope.canonical.shots.collect()) == [10, 30]
    assert [tuple(a) for a in scope.aliases.collect()] == [(20, 10)]


def test_last_round_is_a_whole_canonical_row(mk):
    rounds = mk("rounds", [
        {"round_id": 1, "scorecard_id": 1, "played_on": "2025-06-01", "start_time": "2025-06-01T07:00:00", "course_name": "Moor"},
        {"round_id": 2, "activity_id": 2, "played_on": "2025-06-01", "start_time": "2025-06-01T08:30:00", "location_name": "Village"},
    ])
    row = last_round(canonical_rounds(rounds)).collect()[0]
    assert (row.round_id, row.activity_id, row.location_name, row.display_course_name, row.data_source) == (1, 2, "Village", "Moor", "scorecard+activity")
    assert last_round(rounds.limit(0)).count() == 0


@pytest.fixture()
def two_days(mk):
    rounds = mk("rounds", [
        {"round_id": 10, "scorecard_id": 10, "played_on": "2024-02-01", "start_time": "2024-02-01T09:00:00", "course_name": "Dunes", "exclude_from_stats": True, "comment": "wet"},
        {"round_id": 20, "activity_id": 20, "played_on": "2024-02-01", "start_time": "2024-02-01T09:40:00"},
        {"round_id": 30, "scorecard_id": 30, "played_on": "2024-01-09", "course_name": "Heath"},
        {"round_id": 40, "scorecard_id": 40, "played_on": None, "course_name": "Heath"},
    ])
    holes = mk("holes", [{"round_id": r, "hole_number": h, "par": 4, "strokes": 4 + r // 10} for r in (10, 20, 30, 40) for h in range(1, 10)])
    shots = mk("shots", [{"round_id": r, "hole_number": 1, "shot_number": n, "club": "Iron", "shot_type": "CHIP"} for r in (10, 20, 30, 40) for n in (1, 2)])
    return rounds, holes, shots


def test_alias_own_id_and_last_select_the_same_report(two_days):
    reports = []
    for choice in ({"round_id": 10}, {"round_id": 20}, {"last_round": True}):
        reports.append([r.asDict(recursive=True) for r in round_report(*one_round(*two_days, **choice)).collect()])
    assert reports[0] == reports[1] == reports[2] and len(reports[0]) == 1
    report = reports[0][0]
    assert report["round_id"] == 10 and report["summary"]["comment"] == "wet" and report["summary"]["exclude_from_stats"] is True
    assert report["summary"]["average_hole_score"] == 5.0 and len(report["holes"]) == 9 and len(report["shots"]) == 2
    undated = round_report(*one_round(*two_days, round_id=40)).collect()
    assert [r.round_id for r in undated] == [40]


def test_selected_id_reaches_the_scan(two_days, tmp_path, spark):
    rounds, holes, shots = two_days
    holes.write.parquet(f"{tmp_path}/holes")
    _, mine, _ = one_round(rounds, spark.read.parquet(f"{tmp_path}/holes"), shots, round_id=20)
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(round_id,10)" in plan


def test_unknown_course_or_round_fails_with_its_name(two_days, mk):
    with pytest.raises(ValueError, match="Round not found: 99"):
        one_round(*two_days, round_id=99)
    with pytest.raises(ValueError, match="No rounds"):
        one_round(mk("rounds", []), *two_days[1:], last_round=True)
    with pytest.raises(ValueError, match="either"):
        one_round(*two_days, round_id=10, last_round=True)
    with pytest.raises(Exception, match="Course not found: Nowhere"):
        course_reports(*two_days, "Nowhere").collect()
    with pytest.raises(Exception, match="Round not found: 99"):
        filter_round(two_days[0], 99).count()
    report = course_reports(*two_days, "Heath").collect()
    assert [(r.display_course_name, r.summary.rounds_played, len(r.holes)) for r in report] == [("Heath", 2, 9)]


def test_annotation_follows_the_selector_and_clears(two_days):
    rounds = two_days[0]
    by_id = lambda df: {r.round_id: r for r in df.collect()}
    noted = by_id(annotate_round(rounds, round_id=20, exclude=False, comment="dry"))
    assert set(noted) == {10, 20, 30, 40}
    # the alias leads to the scorecard, whose canonical row (with the activity's id) is stored whole
    assert (noted[10].exclude_from_stats, noted[10].comment, noted[10].activity_id) == (False, "dry", 20)
    assert noted[20].comment is None and noted[30].exclude_from_stats is None
    cleared = by_id(annotate_round(rounds, last_round=True, comment=""))
    assert cleared[10].comment is None and cleared[10].exclude_from_stats is True


def test_duplicates_of_a_batch_resolve_alike(mk):
    incoming = mk("rounds", [{"round_id": 1, "course_name": c} for c in "abcdef"])
    won = {upsert(mk("rounds", []), incoming.repartition(n), ["round_id"]).collect()[0].course_name for n in (1, 3, 5)}
    assert len(won) == 1
