from teebox.plans.trends import metric_trend_series, round_trends


def _data(mk):
    """Five full rounds: (strokes over par, greens hit, penalty holes) a round, oldest first."""
    season = [(12, 3, 4), (6, 6, 0), (9, 9, 2), (3, 6, 1), (0, 12, 1)]
    rounds = mk("rounds", [
        {"round_id": i, "played_on": f"2024-04-{2 * i:02d}", "course_name": "Kestrel Moor" if i < 4 else "Harbour Links",
         "total_score": 70 + over, "total_par": 70}
        for i, (over, _, _) in enumerate(season, 1)
    ])
    holes = mk("holes", [
        {"round_id": i, "hole_number": h, "par": 4, "strokes": 4 + (h <= over), "putts": 3 if h == i else 2,
         "gir": h <= greens, "fairway_hit": h % 2 == 0, "penalties": int(h <= pens)}
        for i, (over, greens, pens) in enumerate(season, 1) for h in range(1, 19)
    ])
    return rounds, holes


def test_round_trends_window_two(mk):
    rounds, holes = _data(mk)
    rows = {r.round_id: r for r in round_trends(rounds, holes, window=2).collect()}
    assert set(rows) == {1, 2, 3, 4, 5}
    last = rows[5]
    assert last.course_name == "Harbour Links" and last.round_to_par == 0.0 and last.hole_count == 18
    # rounds 4 and 5 against 2 and 3
    assert last.window_average_to_par == 1.5 and last.delta_average_to_par == -6.0
    assert last.window_gir_pct == 50.0 and last.delta_gir_pct == 8.33
    assert last.window_penalties_per_18 == 1.0 and last.delta_penalties_per_18 == 0.0
    assert last.window_three_putts_per_18 == 1.0 and last.window_fir_pct == 50.0
    # rounds 2 and 3 against the first alone
    assert rows[3].rounds_in_window == 2 and rows[3].rounds_in_previous_window == 1
    assert rows[3].window_average_to_par == 7.5 and rows[3].delta_average_to_par == -4.5
    assert rows[1].rounds_in_window == 1 and rows[1].rounds_in_previous_window == 0
    assert rows[1].delta_average_to_par is None


def test_window_covering_everything_equals_summary(mk):
    from teebox.plans.summary import summary

    rounds, holes = _data(mk)
    latest = max(round_trends(rounds, holes, window=10).collect(), key=lambda r: r.played_on)
    s = summary(rounds, holes, None).collect()[0]
    assert latest.window_average_to_par == s.average_to_par
    assert latest.window_gir_pct == s.gir_pct
    assert latest.window_three_putts_per_18 == s.three_putts_per_18


def test_trends_by_player_match_single_runs(mk):
    from pyspark.sql import functions as F

    rounds, holes = _data(mk)
    two = rounds.withColumn("player_profile_id", F.lit(1)).unionByName(
        rounds.withColumn("player_profile_id", F.lit(2)).withColumn("round_id", F.col("round_id") + 10)
    )
    holes2 = holes.unionByName(holes.withColumn("round_id", F.col("round_id") + 10))
    by = {(r.player_profile_id, r.round_id % 10): r.window_average_to_par for r in round_trends(two, holes2, 2, by=["player_profile_id"]).collect()}
    single = {r.round_id: r.window_average_to_par for r in round_trends(rounds, holes, 2).collect()}
    for (player, rid), v in by.items():
        assert v == single[rid]


def test_metric_series_and_bad_window(mk):
    rounds, holes = _data(mk)
    t = round_trends(rounds, holes, window=2)
    series = metric_trend_series(t, ["gir_pct"]).collect()
    assert {r.metric for r in series} == {"gir_pct"} and len(series) == 5
    assert round_trends(rounds, holes, window=0).count() == 0
    import pytest

    with pytest.raises(ValueError):
        metric_trend_series(t, ["nope"])


def _rule(rounds, by_player, window):
    """The rule in plain Python: per history by (date, id), missing ones last; mean over par of both windows."""
    groups = {}
    for r in rounds:
        groups.setdefault(r["player_profile_id"] if by_player else None, []).append(r)
    want = {}
    for rows in groups.values():
        rows.sort(key=lambda r: (r["played_on"] is None, r["played_on"] or "", r["round_id"]))
        for i, r in enumerate(rows):
            cur, prev = rows[max(0, i - window + 1):i + 1], rows[max(0, i - 2 * window + 1):max(0, i - window + 1)]
            mean = [sum(x["total_score"] - x["total_par"] for x in part) / len(part) if part else None for part in (cur, prev)]
            want[r["round_id"]] = (len(cur), len(prev), mean[0], None if mean[1] is None else mean)
    return want


def test_blocks_equal_the_rule_with_a_hot_and_an_unknown_player(spark, mk):
    rows, hole_rows = [], []
    rid = 0
    for player, n in ((1, 60), (2, 3), (None, 24)):
        for i in range(n):
            rid += 1
            # some undated, several a day, ids in two far ranges
            day = f"2025-{1 + i // 28:02d}-{1 + i % 28 // 2:02d}" if i % 13 else None
            ident = rid + (1 << 21) * (rid % 2)
            rows.append({"round_id": ident, "player_profile_id": player, "played_on": day, "course_name": "C",
                         "total_score": 80 + 4 * (rid % 7), "total_par": 72})
            hole_rows += [{"round_id": ident, "hole_number": h, "par": 4, "strokes": 4, "putts": 2} for h in range(1, 19)]
    rounds, holes = mk("rounds", rows), mk("holes", hole_rows)
    for by in ([], ["player_profile_id"]):
        for w, block in ((1, 4), (4, 7), (4, 1 << 17)):
            got = round_trends(rounds, holes, w, by, block_rounds=block).collect()
            want = _rule(rows, bool(by), w)
            assert len(got) == len(want)
            for r in got:
                n_cur, n_prev, mean, both = want[r.round_id]
                assert (r.rounds_in_window, r.rounds_in_previous_window) == (n_cur, n_prev)
                assert r.window_average_to_par == round(mean, 2)
                if both is None:
                    assert r.delta_average_to_par is None
                else:
                    assert abs(r.delta_average_to_par - (both[0] - both[1])) < 0.011


def test_no_rounds_no_trends_and_null_ids_take_a_place(mk):
    rounds, holes = _data(mk)
    assert round_trends(mk("rounds", []), holes, 3).count() == 0
    more = rounds.unionByName(mk("rounds", [{"round_id": None, "played_on": "2024-04-09"}]))
    rows = {r.round_id: r for r in round_trends(more, holes, 2).collect()}
    assert set(rows) == {1, 2, 3, 4, 5}
    # the row without an id stands between rounds 4 (8 April) and 5 (10 April) and counts as none
    assert rows[5].rounds_in_window == 1 and rows[4].rounds_in_window == 2
