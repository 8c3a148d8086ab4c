"""ANSI SQL for every registered query, runnable by DuckDB on the raw tables.

Each statement rebuilds the golf-shaped views from ``orders``/``lineitem``/
``events`` as CTEs (same arithmetic as ``teebox.sources.fixtures``) and then
computes the product the way the reference defines it.  This is the
correctness oracle only; it is never run on Spark.
"""

from __future__ import annotations

import re

# ------------------------------------------------------------------ fixture
FIXTURE = """
g_rounds_base AS (
  SELECT o_orderkey AS round_id, o_custkey AS player_profile_id,
         CASE WHEN o_orderkey % 113 = 5 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS played_on,
         o_orderpriority AS course_name,
         o_orderkey % 17 = 0 AS exclude_from_stats,
         CASE o_orderkey % 5 WHEN 0 THEN 9 WHEN 4 THEN 12 ELSE 18 END AS n_holes
  FROM orders
),
g_holes_gen AS (
  SELECT round_id, CAST(UNNEST(generate_series(1, n_holes)) AS BIGINT) AS h FROM g_rounds_base
),
g_holes_par AS (
  SELECT round_id, h, 3 + (round_id * 7 + h * 5) % 3 AS par, (round_id * 5 + h * 3) % 6 AS f FROM g_holes_gen
),
g_holes_val AS (
  SELECT round_id, h, par, f,
         CASE WHEN (round_id + h) % 97 = 0 THEN NULL
              ELSE par - 1 + (round_id * 13 + h * 11 + (round_id % 7) * (h % 3)) % 5 END AS strokes,
         CASE WHEN (round_id + h) % 89 = 0 THEN NULL ELSE 1 + (round_id * 3 + h * 7) % 3 END AS putts
  FROM g_holes_par
),
g_holes AS (
  SELECT round_id, CAST(h AS INTEGER) AS hole_number, CAST(par AS INTEGER) AS par,
         CAST(strokes AS INTEGER) AS strokes, CAST(putts AS INTEGER) AS putts,
         CASE WHEN par = 3 OR f = 5 THEN NULL ELSE f IN (0, 1) END AS fairway_hit,
         (strokes - putts) <= (par - 2) AS gir,
         CAST(CASE WHEN (round_id + h) % 11 = 0 THEN 1 ELSE 0 END AS INTEGER) AS penalties,
         CASE WHEN par = 3 THEN NULL WHEN f IN (0, 1) THEN 'HIT' WHEN f = 2 THEN 'LEFT' WHEN f = 3 THEN 'RIGHT'
              WHEN f = 4 THEN 'SHORT' ELSE 'NO_FAIRWAY' END AS fairway_shot_outcome
  FROM g_holes_val
),
g_rounds AS (
  SELECT b.round_id, b.round_id AS scorecard_id, CAST(NULL AS BIGINT) AS activity_id, b.played_on,
         CASE WHEN b.played_on IS NULL THEN NULL
              ELSE b.played_on || 'T' || lpad(CAST(6 + b.round_id % 12 AS VARCHAR), 2, '0') || ':00:00' END AS start_time,
         b.course_name, CAST(NULL AS VARCHAR) AS location_name,
         CAST(t.total_score AS INTEGER) AS total_score, CAST(t.total_par AS INTEGER) AS total_par,
         b.exclude_from_stats, CAST(NULL AS VARCHAR) AS comment, b.player_profile_id
  FROM g_rounds_base b
  LEFT JOIN (SELECT round_id, SUM(strokes) AS total_score, SUM(par) AS total_par FROM g_holes GROUP BY round_id) t
    USING (round_id)
),
g_shots AS (
  SELECT l_orderkey AS round_id, l_linenumber AS hole_number,
         CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber
              ORDER BY l_partkey ASC NULLS LAST, l_suppkey ASC NULLS LAST, l_extendedprice ASC NULLS LAST,
                       l_shipdate ASC NULLS LAST, l_quantity ASC NULLS LAST, l_discount ASC NULLS LAST,
                       l_tax ASC NULLS LAST, l_returnflag ASC NULLS LAST, l_linestatus ASC NULLS LAST) AS INTEGER) AS shot_number,
         l_suppkey % 14 AS club_id,
         CASE WHEN l_suppkey % 14 = 13 THEN NULL ELSE 'Club ' || CAST(l_suppkey % 14 AS VARCHAR) END AS club,
         CASE WHEN l_returnflag = 'R' THEN 'PUTT' WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'APPROACH'
              WHEN l_returnflag = 'A' THEN 'CHIP' WHEN l_linestatus = 'O' THEN 'LAYUP' ELSE 'RECOVERY' END AS shot_type,
         CASE WHEN l_quantity = 50 THEN NULL WHEN l_returnflag = 'R' THEN l_quantity * 0.4E0
              WHEN l_orderkey % 41 = 0 THEN l_extendedprice / 50 ELSE l_extendedprice / 350 END AS distance_meters,
         CASE WHEN l_discount < 0.03 THEN 'Green' WHEN l_discount < 0.07 THEN 'Fairway' END AS lie
  FROM lineitem
),
g_overrides AS (
  SELECT * FROM (VALUES (CAST(3 AS BIGINT), 'My Wedge'), (CAST(5 AS BIGINT), '')) AS t(club_id, name)
),
t_shots AS (
  SELECT round_id, hole_number, shot_number, club_id, club, distance_meters, lie,
         CASE WHEN shot_number = 1 AND shot_type <> 'PUTT' THEN 'TEE' ELSE shot_type END AS shot_type
  FROM g_shots
),
p_shots AS (
  SELECT s.round_id, s.hole_number, s.shot_number, s.club_id,
         COALESCE(NULLIF(o.name, ''), s.club) AS club, s.distance_meters, s.lie, s.shot_type
  FROM t_shots s LEFT JOIN g_overrides o ON s.club_id = o.club_id
),
s_rounds AS (SELECT * FROM g_rounds WHERE NOT COALESCE(exclude_from_stats, FALSE)),
s_holes AS (SELECT * FROM g_holes WHERE round_id IN (SELECT round_id FROM s_rounds)),
s_shots AS (SELECT * FROM p_shots WHERE round_id IN (SELECT round_id FROM s_rounds))
"""


def with_fixture(*ctes: str) -> str:
    body = ",\n".join([FIXTURE.strip()] + [c.strip() for c in ctes if c.strip()])
    return "WITH " + body + "\n"


def pyround(expr: str, digits: int = 2) -> str:
    """Python-style rounding of a double: scale, round half to even, unscale."""
    m = f"1{'0' * digits}.0E0"
    return f"(ROUND_EVEN(({expr}) * {m}, 0) / {m})"


def tround(expr: str, digits: int = 2) -> str:
    """Columnar-engine rounding: scale, round half away from zero, unscale."""
    m = f"1{'0' * digits}.0E0"
    return f"(ROUND(({expr}) * {m}, 0) / {m})"


def r2(expr: str) -> str:
    return pyround(f"COALESCE({expr}, 0.0E0)")


def ok18(value: str, count: str) -> str:
    return f"CASE WHEN {count} IN (9, 18) THEN ({value}) * 18.0E0 / {count} END"


def pctsql(num: str, den: str) -> str:
    return f"CAST({num} AS DOUBLE) / NULLIF({den}, 0) * 100"


# ----------------------------------------------------------------- summary
def _summary_ctes(rounds: str, holes: str, shots: str, key: str | None) -> tuple[list[str], str, str]:
    """CTEs computing the summary per ``key`` (None = one row overall)."""
    k = f"{key}, " if key else ""
    gk = f"GROUP BY {key}" if key else ""
    tp = "(CAST(strokes AS DOUBLE) - CAST(par AS DOUBLE))"
    sc = "(strokes IS NOT NULL AND par IS NOT NULL)"
    ctes = [
        f"""comps AS (
  SELECT {k}round_id, COUNT(*) AS hole_count,
         SUM(CASE WHEN {sc} THEN 1 ELSE 0 END) AS scored_count,
         SUM(CASE WHEN gir THEN 1 ELSE 0 END) AS gir_hits, COUNT(gir) AS gir_known,
         SUM(CASE WHEN fairway_hit THEN 1 ELSE 0 END) AS fir_hits, COUNT(fairway_hit) AS fir_known,
         SUM(CASE WHEN {sc} AND gir = FALSE AND {tp} <= 0 THEN 1 ELSE 0 END) AS scr_hits,
         SUM(CASE WHEN {sc} AND gir = FALSE THEN 1 ELSE 0 END) AS scr_tries,
         SUM(CASE WHEN {sc} AND {tp} <= -1 THEN 1 ELSE 0 END) AS birdies,
         SUM(CASE WHEN {sc} AND {tp} = 0 THEN 1 ELSE 0 END) AS pars,
         SUM(CASE WHEN {sc} AND {tp} >= 1 THEN 1 ELSE 0 END) AS bogeys,
         SUM(CASE WHEN {sc} AND {tp} >= 2 THEN 1 ELSE 0 END) AS doubles,
         SUM(CASE WHEN {sc} AND par = 3 THEN {tp} END) AS p3s, SUM(CASE WHEN {sc} AND par = 3 THEN 1 ELSE 0 END) AS p3n,
         SUM(CASE WHEN {sc} AND par = 4 THEN {tp} END) AS p4s, SUM(CASE WHEN {sc} AND par = 4 THEN 1 ELSE 0 END) AS p4n,
         SUM(CASE WHEN {sc} AND par = 5 THEN {tp} END) AS p5s, SUM(CASE WHEN {sc} AND par = 5 THEN 1 ELSE 0 END) AS p5n,
         COUNT(putts) AS putts_known, COALESCE(SUM(CAST(putts AS DOUBLE)), 0) AS putts_sum,
         SUM(CASE WHEN putts >= 3 THEN 1 ELSE 0 END) AS three_putts,
         COUNT(penalties) AS pen_known, COALESCE(SUM(CAST(penalties AS DOUBLE)), 0) AS pen_sum,
         SUM(CASE WHEN penalties >= 1 THEN 1 ELSE 0 END) AS pen_holes,
         COUNT(strokes) AS strokes_known, COALESCE(SUM(CAST(strokes AS DOUBLE)), 0) AS strokes_sum
  FROM {holes} GROUP BY {k}round_id
)""",
        f"""hp AS (
  SELECT {k}SUM(CASE WHEN hole_count = 18 THEN 1 ELSE 0 END) AS r18,
         SUM(CASE WHEN hole_count = 9 THEN 1 ELSE 0 END) AS r9, COUNT(*) AS seen,
         {pctsql('SUM(gir_hits)', 'SUM(gir_known)')} AS gir_pct,
         AVG({ok18('gir_hits', 'hole_count')}) AS gir_per_18,
         {pctsql('SUM(fir_hits)', 'SUM(fir_known)')} AS fir_pct,
         AVG({ok18('fir_hits', 'hole_count')}) AS fir_per_18,
         {pctsql('SUM(scr_hits)', 'SUM(scr_tries)')} AS scrambling_pct,
         AVG({ok18('scr_hits', 'scored_count')}) AS scrambles_per_18,
         {pctsql('SUM(birdies)', 'SUM(scored_count)')} AS birdie_or_better_pct,
         {pctsql('SUM(pars)', 'SUM(scored_count)')} AS par_pct,
         {pctsql('SUM(bogeys)', 'SUM(scored_count)')} AS bogey_or_worse_pct,
         AVG({ok18('bogeys', 'scored_count')}) AS bogeys_or_worse_per_18,
         {pctsql('SUM(doubles)', 'SUM(scored_count)')} AS double_bogey_or_worse_pct,
         AVG({ok18('doubles', 'scored_count')}) AS double_bogeys_or_worse_per_18,
         {pctsql('SUM(three_putts)', 'SUM(putts_known)')} AS three_putt_pct,
         AVG({ok18('three_putts', 'hole_count')}) AS three_putts_per_18,
         {pctsql('SUM(pen_holes)', 'SUM(pen_known)')} AS penalty_hole_pct,
         SUM(p3s) / NULLIF(SUM(p3n), 0) AS par_3_average_to_par,
         SUM(p4s) / NULLIF(SUM(p4n), 0) AS par_4_average_to_par,
         SUM(p5s) / NULLIF(SUM(p5n), 0) AS par_5_average_to_par,
         SUM(putts_sum) / NULLIF(SUM(putts_known), 0) AS average_putts_per_hole,
         AVG(putts_sum) AS average_putts_per_round,
         AVG({ok18('putts_sum', 'hole_count')}) AS average_putts_per_18,
         SUM(strokes_sum) / NULLIF(SUM(strokes_known), 0) AS average_hole_score,
         SUM(pen_sum) AS penalties,
         AVG({ok18('pen_sum', 'hole_count')}) AS penalties_per_18,
         AVG({ok18('gir_known', 'hole_count')}) AS gir_opp,
         AVG({ok18('fir_known', 'hole_count')}) AS fir_opp
  FROM comps {gk}
)""",
        f"""rp AS (
  SELECT {('r.' + key + ', ') if key else ''}COUNT(*) AS rounds_played,
         AVG({ok18('CAST(r.total_score AS DOUBLE)', 'c.hole_count')}) AS average_score,
         AVG({ok18('CAST(r.total_score AS DOUBLE) - CAST(r.total_par AS DOUBLE)', 'c.hole_count')}) AS average_to_par
  FROM {rounds} r LEFT JOIN (SELECT round_id, hole_count FROM comps) c ON r.round_id = c.round_id
  {('GROUP BY r.' + key) if key else ''}
)""",
        f"""sp AS (
  SELECT {('s.' + key + ', ') if key else ''}SUM(s.n) AS total_shots,
         AVG({ok18('s.n', 'c.hole_count')}) AS average_shots_per_18
  FROM (SELECT {k}round_id, COUNT(*) AS n FROM {shots} GROUP BY {k}round_id) s
  LEFT JOIN (SELECT round_id, hole_count FROM comps) c ON s.round_id = c.round_id
  {('GROUP BY s.' + key) if key else ''}
)""",
        f"""dst AS (
  SELECT {k}shot_type, COUNT(*) AS n, AVG(distance_meters) AS m, STDDEV_SAMP(distance_meters) AS sd
  FROM {shots} WHERE shot_type IN ('TEE', 'PUTT') GROUP BY {k}shot_type
)""",
        f"""dp AS (
  SELECT {('s.' + key + ', ') if key else ''}
         {xmean("CASE WHEN s.shot_type = 'TEE' THEN s.distance_meters END")} AS average_tee_shot_distance_m,
         {xmean("CASE WHEN s.shot_type = 'PUTT' THEN s.distance_meters END")} AS average_putt_distance_m
  FROM {shots} s JOIN dst d ON s.shot_type = d.shot_type {('AND s.' + key + ' = d.' + key) if key else ''}
  WHERE s.distance_meters IS NULL OR d.n < 5 OR d.sd IS NULL OR d.sd = 0 OR ABS(s.distance_meters - d.m) <= 2 * d.sd
  {('GROUP BY s.' + key) if key else ''}
)""",
        f"""bt AS (
  SELECT {k}string_agg(shot_type || ': ' || CAST(n AS VARCHAR), ', ' ORDER BY n DESC, shot_type) AS shot_type_breakdown
  FROM (SELECT {k}shot_type, COUNT(*) AS n FROM {shots} WHERE shot_type IS NOT NULL GROUP BY {k}shot_type) x {gk}
)""",
        f"""bc AS (
  SELECT {k}string_agg(club || ': ' || CAST(n AS VARCHAR), ', ' ORDER BY n DESC, club) AS club_usage_top5
  FROM (SELECT *, ROW_NUMBER() OVER ({('PARTITION BY ' + key) if key else ''} ORDER BY n DESC, club) AS rk
        FROM (SELECT {k}club, COUNT(*) AS n FROM {shots} WHERE club IS NOT NULL GROUP BY {k}club) y) x
  WHERE rk <= 5 {gk}
)""",
    ]
    if key:
        frm = (
            f"rp LEFT JOIN hp USING ({key}) LEFT JOIN sp USING ({key}) LEFT JOIN dp USING ({key}) "
            f"LEFT JOIN bt USING ({key}) LEFT JOIN bc USING ({key})"
        )
    else:
        frm = "rp, hp, sp, dp, bt, bc"
    return ctes, frm, key or ""


def _summary_select(key: str | None) -> str:
    have = "rp.rounds_played > 0"

    def num(expr: str) -> str:
        return f"CAST(CASE WHEN {have} THEN {r2(expr)} ELSE 0.0E0 END AS DOUBLE)"

    def cnt(expr: str) -> str:
        return f"CAST(CASE WHEN {have} THEN COALESCE({expr}, 0) ELSE 0 END AS BIGINT)"

    def txt(expr: str) -> str:
        return f"CASE WHEN {have} THEN COALESCE({expr}, '') ELSE '' END"

    fields = [
        ("rounds_played", cnt("rp.rounds_played")),
        ("rounds_18_hole", cnt("r18")),
        ("rounds_9_hole", cnt("r9")),
        ("rounds_other_hole_count", cnt("seen - r18 - r9")),
        ("average_score", num("average_score")),
        ("average_to_par", num("average_to_par")),
        ("gir_pct", num("gir_pct")),
        ("gir_per_18", num("gir_per_18")),
        ("fir_pct", num("fir_pct")),
        ("fir_per_18", num("fir_per_18")),
        ("fairway_hit_pct", num("fir_pct")),
        ("scrambling_pct", num("scrambling_pct")),
        ("scrambles_per_18", num("scrambles_per_18")),
        ("birdie_or_better_pct", num("birdie_or_better_pct")),
        ("par_pct", num("par_pct")),
        ("bogey_or_worse_pct", num("bogey_or_worse_pct")),
        ("bogeys_or_worse_per_18", num("bogeys_or_worse_per_18")),
        ("double_bogey_or_worse_pct", num("double_bogey_or_worse_pct")),
        ("double_bogeys_or_worse_per_18", num("double_bogeys_or_worse_per_18")),
        ("three_putt_pct", num("three_putt_pct")),
        ("three_putts_per_18", num("three_putts_per_18")),
        ("penalty_hole_pct", num("penalty_hole_pct")),
        ("par_3_average_to_par", num("par_3_average_to_par")),
        ("par_4_average_to_par", num("par_4_average_to_par")),
        ("par_5_average_to_par", num("par_5_average_to_par")),
        ("average_putts_per_hole", num("average_putts_per_hole")),
        ("average_putts_per_round", num("average_putts_per_round")),
        ("average_putts_per_18", num("average_putts_per_18")),
        ("average_hole_score", num("average_hole_score")),
        ("penalties", cnt("penalties")),
        ("penalties_per_round", num("COALESCE(penalties, 0) / rp.rounds_played")),
        ("penalties_per_18", num("penalties_per_18")),
        ("total_shots", cnt("total_shots")),
        ("average_shots_per_round", num("COALESCE(total_shots, 0) / rp.rounds_played")),
        ("average_shots_per_18", num("average_shots_per_18")),
        ("average_tee_shot_distance_m", num("average_tee_shot_distance_m")),
        ("average_putt_distance_m", num("average_putt_distance_m")),
        ("shot_type_breakdown", txt("shot_type_breakdown")),
        ("club_usage_top5", txt("club_usage_top5")),
    ]
    cols = ([f"rp.{key} AS {key}"] if key else []) + [f"{expr} AS {name}" for name, expr in fields]
    return ",\n       ".join(cols)


def summary_sql(rounds: str = "s_rounds", holes: str = "s_holes", shots: str = "s_shots", key: str | None = None, extra_ctes: tuple[str, ...] = ()) -> str:
    ctes, frm, _ = _summary_ctes(rounds, holes, shots, key)
    return with_fixture(*extra_ctes, *ctes) + f"SELECT {_summary_select(key)}\nFROM {frm}"


def round_stats_sql() -> str:
    ctes, frm, _ = _summary_ctes("g_rounds", "g_holes", "p_shots", "round_id")
    body = with_fixture(*ctes) + f"SELECT {_summary_select('round_id')}\nFROM {frm}"
    return (
        f"SELECT q.*, COALESCE(g.exclude_from_stats, FALSE) AS exclude_from_stats,\n"
        f"       CASE WHEN length(g.comment) > 0 THEN g.comment ELSE '' END AS comment\n"
        f"FROM ({body}) q LEFT JOIN ({with_fixture()} SELECT * FROM g_rounds) g ON q.round_id = g.round_id"
    )


def practice_focus_sql() -> str:
    ctes, frm, _ = _summary_ctes("s_rounds", "s_holes", "s_shots", None)
    vals = f"""vals AS (
  SELECT rp.rounds_played, COALESCE(hp.seen, 0) AS seen,
         {pyround('COALESCE(penalties_per_18, 0.0E0)')} AS pen18,
         {pyround('COALESCE(three_putts_per_18, 0.0E0)')} AS tp18,
         GREATEST(0.0E0, COALESCE(gir_opp, 0.0E0) - {pyround('COALESCE(gir_per_18, 0.0E0)')}) AS mg,
         GREATEST(0.0E0, COALESCE(fir_opp, 0.0E0) - {pyround('COALESCE(fir_per_18, 0.0E0)')}) AS mf,
         {pyround('COALESCE(scrambles_per_18, 0.0E0)')} AS scr18
  FROM {frm}
)"""
    cands = """cands AS (
  SELECT 1 AS one, pen18 AS score, 'Penalty control' AS label,
         printf('%.2f', pen18) || ' penalties per 18; focus on tee-shot and recovery discipline.' AS detail FROM vals
  UNION ALL SELECT 1, tp18, 'Lag putting',
         printf('%.2f', tp18) || ' three-putts per 18; prioritize pace control from long range.' FROM vals
  UNION ALL SELECT 1, GREATEST(0.0E0, mg - scr18) * 0.5E0, 'Scrambling',
         printf('%.2f', GREATEST(0.0E0, mg - scr18)) || ' failed saves per 18 after missed GIR; practice chips and first putts inside scoring range.' FROM vals
  UNION ALL SELECT 1, mg * 0.15E0, 'Approach play',
         printf('%.2f', mg) || ' missed greens per 18; tighten start lines and distance control into greens.' FROM vals
  UNION ALL SELECT 1, mf * 0.1E0, 'Driving accuracy',
         printf('%.2f', mf) || ' missed fairways per 18; favor stock tee-shot shapes and conservative targets.' FROM vals
),
ranked AS (
  SELECT score, label || ': ' || detail AS text, ROW_NUMBER() OVER (ORDER BY score DESC, label) AS rk
  FROM cands WHERE score > 0
)"""
    sel = """SELECT CAST(CASE WHEN v.rounds_played > 0 AND v.seen > 0 THEN v.rounds_played ELSE 0 END AS BIGINT) AS rounds_played,
       CASE WHEN v.rounds_played > 0 AND v.seen > 0 THEN COALESCE((SELECT text FROM ranked WHERE rk = 1), '') ELSE '' END AS priority_1,
       CASE WHEN v.rounds_played > 0 AND v.seen > 0 THEN COALESCE((SELECT text FROM ranked WHERE rk = 2), '') ELSE '' END AS priority_2,
       CASE WHEN v.rounds_played > 0 AND v.seen > 0 THEN COALESCE((SELECT text FROM ranked WHERE rk = 3), '') ELSE '' END AS priority_3,
       CAST(CASE WHEN v.rounds_played > 0 AND v.seen > 0 THEN (ROUND_EVEN(COALESCE((SELECT SUM(score) FROM ranked WHERE rk <= 3), 0.0E0) * 100.0E0, 0) / 100.0E0) ELSE 0.0E0 END AS DOUBLE) AS estimated_strokes_to_save_per_18
FROM vals v"""
    return with_fixture(*ctes, vals, cands) + sel


# ------------------------------------------------------------ shot tables
TO_PAR = "CAST(h.strokes AS DOUBLE) - CAST(h.par AS DOUBLE)"


def xmean(expr: str) -> str:
    """Order-independent mean: exact fixed-point sum, one division."""
    return f"(CAST(SUM(CAST({expr} AS DECIMAL(38,6))) AS DOUBLE) / COUNT(CAST({expr} AS DECIMAL(38,6))))"


def _pct(cond: str) -> str:
    return f"AVG(CAST(({cond}) AS DOUBLE)) * 100"


def _outcome_sql(rows: str, keys: list[str], count_name: str, extra: str = "") -> list[str]:
    k = ", ".join(keys)
    on = " AND ".join(f"r.{c} = t.{c}" for c in keys)
    return [
        f"""ost AS (
  SELECT {k}, COUNT(*) AS {count_name}, COUNT(DISTINCT round_id) AS rounds,
         {_pct('to_par <= 0')} AS par_or_better_pct, {_pct('to_par >= 1')} AS bogey_or_worse_pct,
         {_pct('to_par >= 2')} AS double_or_worse_pct, AVG(to_par) AS avg_to_par,
         COUNT(*) AS tn, AVG(distance_meters) AS tm, STDDEV_SAMP(distance_meters) AS tsd {extra}
  FROM {rows} GROUP BY {k}
)""",
        f"""odist AS (
  SELECT {", ".join("r." + c for c in keys)}, {xmean('r.distance_meters')} AS avg_distance_m,
         STDDEV_SAMP(r.distance_meters) AS distance_stddev_m
  FROM {rows} r LEFT JOIN ost t ON {on}
  WHERE r.distance_meters IS NULL OR t.tn < 5 OR t.tsd IS NULL OR t.tsd = 0
        OR ABS(r.distance_meters - t.tm) <= t.tsd * 2
  GROUP BY {", ".join("r." + c for c in keys)}
)""",
    ]


def _outcome_select(keys: list[str], count_name: str, extra_cols: str = "") -> str:
    on = " AND ".join(f"o.{c} = d.{c}" for c in keys)
    return f"""SELECT {", ".join("o." + c for c in keys)}, o.{count_name}, o.rounds{extra_cols},
       {tround('d.avg_distance_m', 1)} AS avg_distance_m, {tround('d.distance_stddev_m', 1)} AS distance_stddev_m,
       {tround('o.par_or_better_pct')} AS par_or_better_pct, {tround('o.bogey_or_worse_pct')} AS bogey_or_worse_pct,
       {tround('o.double_or_worse_pct')} AS double_or_worse_pct, {tround('o.avg_to_par')} AS avg_to_par
FROM ost o LEFT JOIN odist d ON {on}"""


def second_shots_sql(holes: str = "s_holes", shots: str = "s_shots", key: str | None = None) -> str:
    rows = f"""rows AS (
  SELECT s.round_id, TRIM(COALESCE(s.club, 'Unknown')) AS club, s.distance_meters, CAST(h.par AS BIGINT) AS par,
         CASE WHEN upper(h.fairway_shot_outcome) = 'HIT' THEN 'fairway'
              WHEN upper(h.fairway_shot_outcome) IN ('LEFT', 'RIGHT', 'SHORT', 'LONG') THEN 'off_fairway'
              WHEN upper(h.fairway_shot_outcome) = 'NO_FAIRWAY' THEN 'no_fairway'
              WHEN h.fairway_hit THEN 'fairway' WHEN NOT h.fairway_hit THEN 'off_fairway' ELSE 'unknown' END AS inferred_start_lie,
         {TO_PAR} AS to_par
  FROM {shots} s JOIN {holes} h ON s.round_id = h.round_id AND s.hole_number = h.hole_number
  WHERE s.shot_number = 2 AND h.par IN (4, 5)
)"""
    keys = ([key] if key else []) + ["par", "club", "inferred_start_lie"]
    return with_fixture(rows, *_outcome_sql("rows", keys, "second_shots")) + _outcome_select(keys, "second_shots")


def tee_shots_sql() -> str:
    rows = f"""rows AS (
  SELECT s.round_id, TRIM(COALESCE(s.club, 'Unknown')) AS club, s.distance_meters, CAST(h.par AS BIGINT) AS par,
         CASE WHEN upper(h.fairway_shot_outcome) = 'HIT' THEN 'fairway'
              WHEN upper(h.fairway_shot_outcome) = 'LEFT' THEN 'miss_left'
              WHEN upper(h.fairway_shot_outcome) = 'RIGHT' THEN 'miss_right'
              WHEN upper(h.fairway_shot_outcome) = 'NO_FAIRWAY' THEN 'no_fairway'
              WHEN h.fairway_hit THEN 'fairway' WHEN NOT h.fairway_hit THEN 'missed_fairway' ELSE 'unknown' END AS fairway_result,
         {TO_PAR} AS to_par
  FROM s_shots s JOIN s_holes h ON s.round_id = h.round_id AND s.hole_number = h.hole_number
  WHERE s.shot_number = 1
)"""
    keys = ["par", "club", "fairway_result"]
    return with_fixture(rows, *_outcome_sql("rows", keys, "tee_shots")) + _outcome_select(keys, "tee_shots")


def _canon_scope_ctes(course: str | None = None, hole: int | None = None) -> list[str]:
    """Club products: raw (typed, not renamed) shots of in-scope rounds, and all holes."""
    rounds = "s_rounds" if course is None else (
        f"(SELECT * FROM s_rounds WHERE (CASE WHEN trim(course_name) <> '' THEN course_name ELSE location_name END) = '{course}')"
    )
    hole_f = "" if hole is None else f" AND hole_number = {hole}"
    return [
        f"c_raw AS (SELECT * FROM t_shots WHERE round_id IN (SELECT round_id FROM {rounds}){hole_f})",
        f"c_res AS (SELECT * FROM p_shots WHERE round_id IN (SELECT round_id FROM {rounds}){hole_f})",
        f"c_holes AS (SELECT * FROM g_holes WHERE round_id IN (SELECT round_id FROM {rounds}){hole_f})"
        if course is not None or hole is not None else "c_holes AS (SELECT * FROM g_holes)",
    ]


def club_context_sql(course: str | None = None, hole: int | None = None) -> str:
    rows = f"""rows AS (
  SELECT round_id, club, lie, shot_type, distance_meters, to_par,
         CASE WHEN shot_type = 'PUTT' THEN 'putt'
              WHEN shot_number = 1 THEN CASE WHEN par = 3 THEN 'tee_par_3' WHEN par = 4 THEN 'tee_par_4'
                                             WHEN par = 5 THEN 'tee_par_5' ELSE 'tee_other' END
              WHEN shot_number = 2 AND par = 4 THEN 'approach_par_4'
              WHEN shot_number = 2 AND par = 5 THEN 'second_par_5'
              WHEN shot_type IN ('CHIP', 'PITCH', 'BUNKER') THEN 'short_game'
              WHEN contains(lower(lie), 'green') THEN 'putt'
              WHEN shot_type IN ('LAYUP', 'RECOVERY') THEN lower(shot_type)
              ELSE 'other' END AS context
  FROM (
    SELECT s.round_id, CAST(s.shot_number AS BIGINT) AS shot_number, TRIM(COALESCE(s.club, 'Unknown')) AS club,
           TRIM(COALESCE(s.lie, 'Unknown')) AS lie, TRIM(COALESCE(s.shot_type, 'UNKNOWN')) AS shot_type,
           s.distance_meters, CAST(h.par AS BIGINT) AS par, {TO_PAR} AS to_par
    FROM c_res s JOIN c_holes h ON s.round_id = h.round_id AND s.hole_number = h.hole_number
  ) x
)"""
    modes = """mt AS (
  SELECT club, context, shot_type AS mode_type FROM (
    SELECT club, context, shot_type, ROW_NUMBER() OVER (PARTITION BY club, context ORDER BY COUNT(*) DESC, shot_type) AS rk
    FROM rows GROUP BY club, context, shot_type) WHERE rk = 1
),
ml AS (
  SELECT club, context, lie AS mode_lie FROM (
    SELECT club, context, lie, ROW_NUMBER() OVER (PARTITION BY club, context ORDER BY COUNT(*) DESC, lie) AS rk
    FROM rows GROUP BY club, context, lie) WHERE rk = 1
)"""
    keys = ["club", "context"]
    sel = _outcome_select(keys, "shots", ", COALESCE(mt.mode_type, 'Unknown') AS shot_type, COALESCE(ml.mode_lie, 'Unknown') AS lie")
    sel += " LEFT JOIN mt ON o.club = mt.club AND o.context = mt.context LEFT JOIN ml ON o.club = ml.club AND o.context = ml.context"
    return with_fixture(*_canon_scope_ctes(course, hole), rows, modes, *_outcome_sql("rows", keys, "shots")) + sel


def club_inventory_sql() -> str:
    ctes = _canon_scope_ctes() + [
        """firsts AS (
  SELECT club_id, COALESCE(club, 'Unknown') AS default_name FROM (
    SELECT club_id, club, ROW_NUMBER() OVER (PARTITION BY club_id ORDER BY round_id, hole_number, shot_number) AS rk FROM c_raw)
  WHERE rk = 1
)""",
        """conf AS (
  SELECT club_id, COALESCE(club, 'Unknown') AS configured_name FROM (
    SELECT club_id, club, ROW_NUMBER() OVER (PARTITION BY club_id ORDER BY round_id, hole_number, shot_number) AS rk FROM c_res)
  WHERE rk = 1
)""",
        """s1 AS (
  SELECT club_id, COUNT(*) AS shots, AVG(distance_meters) AS tm, STDDEV_SAMP(distance_meters) AS tsd FROM c_raw GROUP BY club_id
)""",
        f"""d1 AS (
  SELECT r.club_id, {xmean('r.distance_meters')} AS a, STDDEV_SAMP(r.distance_meters) AS sd
  FROM c_raw r JOIN s1 t ON r.club_id = t.club_id
  WHERE r.distance_meters IS NULL OR t.shots < 5 OR t.tsd IS NULL OR t.tsd = 0 OR ABS(r.distance_meters - t.tm) <= t.tsd * 2
  GROUP BY r.club_id
)""",
        """s2 AS (
  SELECT club_id, shot_type, COUNT(*) AS n, AVG(distance_meters) AS tm, STDDEV_SAMP(distance_meters) AS tsd
  FROM c_raw GROUP BY club_id, shot_type
)""",
        f"""d2 AS (
  SELECT r.club_id, r.shot_type, {tround(xmean('r.distance_meters'), 1)} AS a, {tround('STDDEV_SAMP(r.distance_meters)', 1)} AS sd
  FROM c_raw r JOIN s2 t ON r.club_id = t.club_id AND r.shot_type = t.shot_type
  WHERE r.distance_meters IS NULL OR t.n < 5 OR t.tsd IS NULL OR t.tsd = 0 OR ABS(r.distance_meters - t.tm) <= t.tsd * 2
  GROUP BY r.club_id, r.shot_type
)""",
        """bt AS (
  SELECT club_id,
         string_agg(CASE WHEN shot_type IS NULL OR shot_type = '' THEN 'Unknown' ELSE shot_type END || ': ' || CAST(n AS VARCHAR),
                    ', ' ORDER BY rk) AS shot_type_breakdown
  FROM (SELECT club_id, shot_type, n,
               ROW_NUMBER() OVER (PARTITION BY club_id ORDER BY n DESC, shot_type ASC NULLS LAST) AS rk FROM s2)
  WHERE rk <= 4 GROUP BY club_id
)""",
        """pv AS (
  SELECT club_id,
         MAX(CASE WHEN shot_type = 'TEE' THEN a END) AS tee_avg_m, MAX(CASE WHEN shot_type = 'TEE' THEN sd END) AS tee_distance_stddev_m,
         MAX(CASE WHEN shot_type = 'APPROACH' THEN a END) AS approach_avg_m, MAX(CASE WHEN shot_type = 'APPROACH' THEN sd END) AS approach_distance_stddev_m,
         MAX(CASE WHEN shot_type = 'LAYUP' THEN a END) AS layup_avg_m, MAX(CASE WHEN shot_type = 'LAYUP' THEN sd END) AS layup_distance_stddev_m,
         MAX(CASE WHEN shot_type = 'CHIP' THEN a END) AS chip_avg_m, MAX(CASE WHEN shot_type = 'CHIP' THEN sd END) AS chip_distance_stddev_m
  FROM d2 GROUP BY club_id
)""",
    ]
    sel = f"""SELECT s1.club_id, f.default_name, s1.shots, {tround('d1.a', 1)} AS avg_distance_m, {tround('d1.sd', 1)} AS distance_stddev_m,
       COALESCE(c.configured_name, f.default_name) AS configured_name, bt.shot_type_breakdown,
       pv.tee_avg_m, pv.tee_distance_stddev_m, pv.approach_avg_m, pv.approach_distance_stddev_m,
       pv.layup_avg_m, pv.layup_distance_stddev_m, pv.chip_avg_m, pv.chip_distance_stddev_m
FROM s1 LEFT JOIN firsts f ON s1.club_id IS NOT DISTINCT FROM f.club_id LEFT JOIN d1 ON s1.club_id = d1.club_id
LEFT JOIN conf c ON s1.club_id = c.club_id LEFT JOIN bt ON s1.club_id = bt.club_id LEFT JOIN pv ON s1.club_id = pv.club_id"""
    return with_fixture(*ctes) + sel


def putting_sql() -> str:
    ctes = [
        """fp AS (
  SELECT d AS start_distance_m, p AS putts FROM (
    SELECT s.distance_meters AS d, CAST(h.putts AS BIGINT) AS p,
           ROW_NUMBER() OVER (PARTITION BY s.round_id, s.hole_number ORDER BY s.shot_number ASC NULLS FIRST) AS rk
    FROM s_shots s JOIN s_holes h ON s.round_id = h.round_id AND s.hole_number = h.hole_number
    WHERE s.shot_type = 'PUTT')
  WHERE rk = 1 AND d IS NOT NULL AND p IS NOT NULL
)""",
        """fb AS (
  SELECT *, CASE WHEN start_distance_m < 1 THEN '0-1m' WHEN start_distance_m < 2 THEN '1-2m'
                 WHEN start_distance_m < 3 THEN '2-3m' WHEN start_distance_m < 5 THEN '3-5m'
                 WHEN start_distance_m < 10 THEN '5-10m' WHEN start_distance_m < 15 THEN '10-15m' ELSE '15m+' END AS distance_bucket
  FROM fp
)""",
    ]
    sel = f"""SELECT distance_bucket, COUNT(*) AS holes, {tround(xmean('start_distance_m'), 1)} AS avg_start_distance_m,
       {tround(_pct('putts = 1'))} AS one_putt_pct, {tround(_pct('putts = 2'))} AS two_putt_pct,
       {tround(_pct('putts >= 3'))} AS three_putt_plus_pct
FROM fb GROUP BY distance_bucket"""
    return with_fixture(*ctes) + sel


def trim_outliers_sql() -> str:
    ctes = [
        """tst AS (
  SELECT club, shot_type, COUNT(*) AS n, AVG(distance_meters) AS m, STDDEV_SAMP(distance_meters) AS sd
  FROM p_shots GROUP BY club, shot_type
)"""
    ]
    sel = """SELECT s.round_id, s.hole_number, s.shot_number, s.club, s.shot_type, s.distance_meters
FROM p_shots s LEFT JOIN tst t ON s.club = t.club AND s.shot_type = t.shot_type
WHERE s.distance_meters IS NULL OR t.n < 5 OR t.sd IS NULL OR t.sd = 0 OR ABS(s.distance_meters - t.m) <= t.sd * 2"""
    return with_fixture(*ctes) + sel


def round_clubs_sql() -> str:
    ctes = [
        """rc AS (
  SELECT round_id, COALESCE(club, 'Unknown') AS club, COALESCE(shot_type, 'UNKNOWN') AS shot_type, distance_meters FROM p_shots
)""",
        """rs AS (
  SELECT round_id, club, COUNT(*) AS shots, AVG(distance_meters) AS m, STDDEV_SAMP(distance_meters) AS sd FROM rc GROUP BY round_id, club
)""",
        f"""rd AS (
  SELECT r.round_id, r.club, {xmean('r.distance_meters')} AS a, STDDEV_SAMP(r.distance_meters) AS s
  FROM rc r JOIN rs t ON r.round_id = t.round_id AND r.club = t.club
  WHERE r.distance_meters IS NULL OR t.shots < 5 OR t.sd IS NULL OR t.sd = 0 OR ABS(r.distance_meters - t.m) <= t.sd * 2
  GROUP BY r.round_id, r.club
)""",
        """rb AS (
  SELECT round_id, club, string_agg(shot_type || ': ' || CAST(n AS VARCHAR), ', ' ORDER BY rk) AS shot_type_breakdown
  FROM (SELECT round_id, club, shot_type, n, ROW_NUMBER() OVER (PARTITION BY round_id, club ORDER BY n DESC, shot_type) AS rk
        FROM (SELECT round_id, club, shot_type, COUNT(*) AS n FROM rc GROUP BY round_id, club, shot_type))
  WHERE rk <= 4 GROUP BY round_id, club
)""",
    ]
    sel = f"""SELECT rs.round_id, rs.club, rs.shots, {tround('rd.a', 1)} AS avg_distance_m, {tround('rd.s', 1)} AS distance_stddev_m,
       rb.shot_type_breakdown
FROM rs LEFT JOIN rd ON rs.round_id = rd.round_id AND rs.club = rd.club
LEFT JOIN rb ON rs.round_id = rb.round_id AND rs.club = rb.club"""
    return with_fixture(*ctes) + sel


def round_shots_sql() -> str:
    return with_fixture() + f"""SELECT round_id, CAST(hole_number AS BIGINT) AS hole_number, CAST(shot_number AS BIGINT) AS shot_number,
       COALESCE(club, 'Unknown') AS club, {tround('distance_meters', 1)} AS distance_meters,
       COALESCE(shot_type, 'UNKNOWN') AS shot_type, lie, CAST(NULL AS VARCHAR) AS result
FROM p_shots"""


def round_holes_sql() -> str:
    return with_fixture() + """SELECT round_id, CAST(hole_number AS BIGINT) AS hole_number, CAST(par AS BIGINT) AS par,
       CAST(strokes AS BIGINT) AS strokes, CAST(strokes AS BIGINT) - CAST(par AS BIGINT) AS to_par,
       CAST(putts AS BIGINT) AS putts, gir, fairway_hit, COALESCE(CAST(penalties AS BIGINT), 0) AS penalties
FROM g_holes"""


# ------------------------------------------------------------------ courses
def _course_holes_ctes(rounds: str = "s_rounds") -> list[str]:
    tp = "(CAST(strokes AS DOUBLE) - CAST(par AS DOUBLE))"
    return [
        f"""cr AS (
  SELECT round_id, CASE WHEN trim(course_name) <> '' THEN course_name ELSE location_name END AS display_course_name
  FROM {rounds}
)""",
        f"""chs AS (
  SELECT c.display_course_name, h.hole_number, COUNT(DISTINCT h.round_id) AS rounds_played,
         arg_min(h.par, h.round_id) FILTER (WHERE h.par IS NOT NULL) AS par,
         AVG(CAST(h.strokes AS DOUBLE)) AS avg_strokes, AVG({tp}) AS avg_to_par,
         {_pct(tp + ' <= 0')} AS par_or_better_pct, {_pct(tp + ' >= 1')} AS bogey_or_worse_pct,
         {_pct(tp + ' >= 2')} AS double_or_worse_pct, {_pct('h.gir')} AS gir_pct,
         {_pct('h.fairway_hit')} AS fairway_hit_pct, {_pct('h.putts >= 3')} AS three_putt_pct,
         AVG(COALESCE(CAST(h.penalties AS DOUBLE), 0.0E0)) AS penalty_rate, AVG(CAST(h.putts AS DOUBLE)) AS avg_putts
  FROM g_holes h JOIN cr c ON h.round_id = c.round_id
  GROUP BY c.display_course_name, h.hole_number
)""",
        f"""chr AS (
  SELECT display_course_name, hole_number, rounds_played, par,
         {tround('avg_strokes')} AS avg_strokes, {tround('avg_to_par')} AS avg_to_par,
         {tround('par_or_better_pct')} AS par_or_better_pct, {tround('bogey_or_worse_pct')} AS bogey_or_worse_pct,
         {tround('double_or_worse_pct')} AS double_or_worse_pct, {tround('gir_pct')} AS gir_pct,
         {tround('fairway_hit_pct')} AS fairway_hit_pct, {tround('three_putt_pct')} AS three_putt_pct,
         {tround('penalty_rate')} AS penalty_rate, {tround('avg_putts')} AS avg_putts
  FROM chs
)""",
    ]


def course_hole_stats_sql() -> str:
    return with_fixture(*_course_holes_ctes()) + "SELECT * FROM chr"


def _focus_sql(metric: str, suffix: str, highest: bool) -> str:
    order = f"{metric} DESC" if highest else f"{metric} ASC"
    sfx = suffix.replace("%", "%%")
    return f"""(SELECT display_course_name, string_agg(printf('%d ({'%.2f'}{sfx})', hole_number, {metric}), ', ' ORDER BY rk) AS v
   FROM (SELECT display_course_name, hole_number, {metric},
                ROW_NUMBER() OVER (PARTITION BY display_course_name ORDER BY {order}, hole_number) AS rk
         FROM chr WHERE {metric} IS NOT NULL AND hole_number IS NOT NULL)
   WHERE rk <= 3 GROUP BY display_course_name)"""


def course_focus_sql() -> str:
    parts = [
        ("hardest_holes", "avg_to_par", " to par", True),
        ("penalty_holes", "penalty_rate", " penalties", True),
        ("three_putt_holes", "three_putt_pct", "% 3-putts", True),
        ("gir_trouble_holes", "gir_pct", "% GIR", False),
    ]
    sel = "SELECT g.display_course_name"
    joins = " FROM (SELECT DISTINCT display_course_name FROM chr) g"
    for i, (name, m, sfx, hi) in enumerate(parts):
        sel += f", COALESCE(f{i}.v, '') AS {name}"
        joins += f" LEFT JOIN {_focus_sql(m, sfx, hi)} f{i} ON g.display_course_name IS NOT DISTINCT FROM f{i}.display_course_name"
    return with_fixture(*_course_holes_ctes()) + sel + joins


def rounds_list_sql() -> str:
    return with_fixture() + """SELECT round_id, played_on,
       CASE WHEN trim(course_name) <> '' THEN course_name ELSE location_name END AS display_course_name,
       COALESCE(exclude_from_stats, FALSE) AS exclude_from_stats, comment
FROM g_rounds"""


def courses_sql() -> str:
    return with_fixture() + """SELECT course_name, COUNT(DISTINCT round_id) AS rounds_played, MIN(played_on) AS first_played,
       MAX(played_on) AS last_played
FROM (SELECT round_id, played_on, CASE WHEN trim(course_name) <> '' THEN course_name ELSE location_name END AS course_name
      FROM s_rounds)
WHERE course_name IS NOT NULL GROUP BY course_name"""


# ------------------------------------------------------------------- trends
TREND_NAMES = [
    ("average_to_par", "round_to_par", "window_average_to_par", "delta_average_to_par"),
    ("gir_pct", "round_gir_pct", "window_gir_pct", "delta_gir_pct"),
    ("fir_pct", "round_fir_pct", "window_fir_pct", "delta_fir_pct"),
    ("scrambling_pct", "round_scrambling_pct", "window_scrambling_pct", "delta_scrambling_pct"),
    ("three_putts_per_18", "round_three_putts_per_18", "window_three_putts_per_18", "delta_three_putts_per_18"),
    ("penalties_per_18", "round_penalties_per_18", "window_penalties_per_18", "delta_penalties_per_18"),
]


def round_trends_sql(window: int = 5, key: str = "player_profile_id") -> str:
    tp = "(CAST(strokes AS DOUBLE) - CAST(par AS DOUBLE))"
    sc = "(strokes IS NOT NULL AND par IS NOT NULL)"
    ok = "hc IN (9, 18)"
    ctes = [
        f"""tc AS (
  SELECT round_id, COUNT(*) AS hc, SUM(CASE WHEN gir THEN 1 ELSE 0 END) AS gh, COUNT(gir) AS gk,
         SUM(CASE WHEN fairway_hit THEN 1 ELSE 0 END) AS fh, COUNT(fairway_hit) AS fk,
         SUM(CASE WHEN {sc} AND gir = FALSE AND {tp} <= 0 THEN 1 ELSE 0 END) AS sh,
         SUM(CASE WHEN {sc} AND gir = FALSE THEN 1 ELSE 0 END) AS st,
         SUM(CASE WHEN putts >= 3 THEN 1 ELSE 0 END) AS tpc, COALESCE(SUM(CAST(penalties AS DOUBLE)), 0) AS pen
  FROM s_holes GROUP BY round_id
)""",
        f"""tb AS (
  SELECT r.{key}, r.round_id, r.played_on,
         COALESCE(CASE WHEN trim(CASE WHEN trim(r.course_name) <> '' THEN r.course_name ELSE r.location_name END) <> ''
                       THEN CASE WHEN trim(r.course_name) <> '' THEN r.course_name ELSE r.location_name END END,
                  CASE WHEN trim(r.course_name) <> '' THEN r.course_name END,
                  CASE WHEN trim(r.location_name) <> '' THEN r.location_name END) AS course_name,
         try_strptime(substr(r.played_on, 1, 10), '%Y-%m-%d') AS d, c.hc,
         COALESCE(CASE WHEN c.{ok} THEN (CAST(r.total_score AS DOUBLE) - CAST(r.total_par AS DOUBLE)) * 18.0E0 / c.hc END, 0) AS n1,
         CASE WHEN c.{ok} AND r.total_score IS NOT NULL AND r.total_par IS NOT NULL THEN 1 ELSE 0 END AS d1,
         COALESCE(c.gh, 0) AS n2, COALESCE(c.gk, 0) AS d2, COALESCE(c.fh, 0) AS n3, COALESCE(c.fk, 0) AS d3,
         COALESCE(c.sh, 0) AS n4, COALESCE(c.st, 0) AS d4,
         COALESCE(CASE WHEN c.{ok} THEN c.tpc * 18.0E0 / c.hc END, 0) AS n5, CASE WHEN c.{ok} THEN 1 ELSE 0 END AS d5,
         COALESCE(CASE WHEN c.{ok} THEN c.pen * 18.0E0 / c.hc END, 0) AS n6, CASE WHEN c.{ok} THEN 1 ELSE 0 END AS d6
  FROM s_rounds r LEFT JOIN tc c ON r.round_id = c.round_id
)""",
    ]
    wspec = f"PARTITION BY {key} ORDER BY d ASC NULLS LAST, round_id ASC NULLS LAST"
    cur = f"OVER ({wspec} ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    prev = f"OVER ({wspec} ROWS BETWEEN {2 * window - 1} PRECEDING AND {window} PRECEDING)"

    def val(n: str, d: str, i: int) -> str:
        v = f"COALESCE(CAST({n} AS DOUBLE) / NULLIF({d}, 0), 0.0E0)"
        if i in (2, 3, 4):
            v = f"({v}) * 100"
        return pyround(v)

    cols = [f"{key}", "round_id", "played_on", "course_name", "CAST(COALESCE(hc, 0) AS BIGINT) AS hole_count",
            f"CAST({window} AS BIGINT) AS window", f"COUNT(round_id) {cur} AS rounds_in_window",
            f"COUNT(round_id) {prev} AS rounds_in_previous_window"]
    for i, (_, rcol, _, _) in enumerate(TREND_NAMES, start=1):
        cols.append(f"{val(f'n{i}', f'd{i}', i)} AS {rcol}")
    for i, (_, _, wcol, _) in enumerate(TREND_NAMES, start=1):
        cols.append(f"{val(f'SUM(n{i}) {cur}', f'SUM(d{i}) {cur}', i)} AS {wcol}")
    for i, (_, _, _, dcol) in enumerate(TREND_NAMES, start=1):
        w = val(f"SUM(n{i}) {cur}", f"SUM(d{i}) {cur}", i)
        p = val(f"SUM(n{i}) {prev}", f"SUM(d{i}) {prev}", i)
        cols.append(f"CASE WHEN COUNT(round_id) {prev} > 0 THEN {pyround(f'{w} - {p}')} END AS {dcol}")
    sel = "SELECT * FROM (SELECT " + ",\n       ".join(cols) + "\nFROM tb) WHERE round_id IS NOT NULL"
    return with_fixture(*ctes) + sel


def metric_trend_series_sql(window: int = 5, key: str = "player_profile_id") -> str:
    inner = round_trends_sql(window, key)
    parts = []
    for metric, rcol, wcol, dcol in TREND_NAMES:
        parts.append(
            f"SELECT {key}, played_on, round_id, course_name, \"window\", '{metric}' AS metric, "
            f"{rcol} AS round_value, {wcol} AS window_value, {dcol} AS delta_value FROM t"
        )
    return f"WITH t AS ({inner})\n" + "\nUNION ALL\n".join(parts)


# ------------------------------------------------------------------- scope
def scoped_tables_sql() -> str:
    return with_fixture(
        """w_rounds AS (
  SELECT * FROM g_rounds
  WHERE try_strptime(substr(played_on, 1, 10), '%Y-%m-%d') >= DATE '1996-01-01'
    AND try_strptime(substr(played_on, 1, 10), '%Y-%m-%d') <= DATE '1996-12-31'
    AND NOT COALESCE(exclude_from_stats, FALSE)
)"""
    ) + """SELECT r.round_id, r.played_on,
       CAST(COALESCE((SELECT COUNT(*) FROM g_holes h WHERE h.round_id = r.round_id), 0) AS BIGINT) AS holes,
       CAST(COALESCE((SELECT COUNT(*) FROM p_shots s WHERE s.round_id = r.round_id), 0) AS BIGINT) AS shots
FROM w_rounds r"""


# ------------------------------------------------------------------ upserts
UPSERT_COLS = ["round_id", "scorecard_id", "activity_id", "played_on", "course_name", "location_name",
               "exclude_from_stats", "comment", "data_source", "player_profile_id"]


def upsert_sql(preserve: bool = True) -> str:
    inc = """inc AS (
  SELECT round_id, CASE WHEN round_id % 10 = 3 THEN NULL ELSE round_id END AS scorecard_id,
         CASE WHEN round_id % 10 = 3 THEN round_id END AS activity_id, played_on,
         'Re ' || course_name AS course_name, location_name, FALSE AS exclude_from_stats,
         CAST(NULL AS VARCHAR) AS comment,
         CASE WHEN round_id % 10 = 3 THEN 'activities' ELSE 'scorecard' END AS data_source, player_profile_id
  FROM g_rounds
  UNION ALL
  SELECT -round_id, CAST(NULL AS BIGINT), -round_id, played_on, CAST(NULL AS VARCHAR),
         'Loc ' || course_name, FALSE, CAST(NULL AS VARCHAR), 'activities', player_profile_id
  FROM g_rounds WHERE round_id % 10 = 7
)"""
    ex = """ex AS (
  SELECT round_id, scorecard_id, activity_id, played_on, course_name, location_name, exclude_from_stats, comment,
         CAST(NULL AS VARCHAR) AS data_source, player_profile_id FROM g_rounds
)"""
    cols = []
    for c in UPSERT_COLS:
        if c == "round_id":
            cols.append("COALESCE(i.round_id, e.round_id) AS round_id")
        elif preserve and c in ("exclude_from_stats", "comment"):
            cols.append(f"CASE WHEN i.round_id IS NOT NULL THEN COALESCE(e.{c}, i.{c}) ELSE e.{c} END AS {c}")
        else:
            cols.append(f"CASE WHEN i.round_id IS NOT NULL THEN i.{c} ELSE e.{c} END AS {c}")
    return with_fixture(inc, ex) + "SELECT " + ", ".join(cols) + " FROM ex e FULL OUTER JOIN inc i ON e.round_id = i.round_id"


def annotate_sql() -> str:
    cols = []
    for c in UPSERT_COLS:
        if c == "exclude_from_stats":
            cols.append("CASE WHEN total_score - total_par >= 30 THEN TRUE ELSE exclude_from_stats END AS exclude_from_stats")
        elif c == "comment":
            cols.append("CASE WHEN total_score - total_par >= 30 THEN 'blow-up round' ELSE comment END AS comment")
        elif c == "data_source":
            cols.append("CAST(NULL AS VARCHAR) AS data_source")
        else:
            cols.append(c)
    return with_fixture() + "SELECT " + ", ".join(cols) + " FROM g_rounds"


def message_inventory_sql() -> str:
    msgs = """msgs AS (
  SELECT user_id AS file_id, event_id AS seq,
         CASE event_type WHEN 'signup' THEN 'session' WHEN 'view' THEN 'record' WHEN 'click' THEN 'lap'
                         WHEN 'error' THEN 'unknown_140' ELSE event_type END AS name,
         props AS fields
  FROM events
)"""
    return with_fixture(msgs) + """SELECT f.file_id,
       COALESCE((SELECT '{' || string_agg('"' || name || '":' || CAST(n AS VARCHAR), ',' ORDER BY name) || '}'
                 FROM (SELECT name, COUNT(*) AS n FROM msgs m WHERE m.file_id = f.file_id AND name IS NOT NULL GROUP BY name)), '{}') AS message_counts,
       COALESCE((SELECT '{' || string_agg('"' || name || '":' || CAST(n AS VARCHAR), ',' ORDER BY name) || '}'
                 FROM (SELECT name, COUNT(*) AS n FROM msgs m WHERE m.file_id = f.file_id AND name LIKE 'unknown\\_%' ESCAPE '\\' GROUP BY name)), '{}') AS unknown_message_counts,
       (SELECT fields FROM msgs m WHERE m.file_id = f.file_id AND name = 'session' ORDER BY seq LIMIT 1) AS session,
       CAST((SELECT COUNT(*) FROM msgs m WHERE m.file_id = f.file_id AND name = 'lap') AS BIGINT) AS lap_count,
       CAST((SELECT COUNT(*) FROM msgs m WHERE m.file_id = f.file_id AND name = 'record') AS BIGINT) AS record_count
FROM (SELECT DISTINCT file_id FROM msgs) f"""


# ----------------------------------------------------------- reconciliation
ROUND_COLS = ["round_id", "scorecard_id", "activity_id", "played_on", "start_time", "course_name", "location_name", "total_score",
              "total_par", "exclude_from_stats", "comment", "player_profile_id", "data_source"]
ROUND_NULLS = [("tee_name", "VARCHAR"), ("strokes_gained_handicap", "DOUBLE"), ("summary_json", "VARCHAR"), ("scorecard_json", "VARCHAR")]


def on_two_sources(sql: str, pooled: bool = False, include_excluded: bool = False) -> str:
    """A product's SQL over both sources, reconciled: s_rounds are the canonical rounds.

    Holes and shots in scope are those of all rounds in scope (``pooled``), or of the canonical ones.
    """
    scope = "" if include_excluded else "WHERE NOT COALESCE(exclude_from_stats, FALSE)"
    one = re.sub(r"\b(g_rounds|g_holes|g_shots|t_shots|p_shots)\b", r"\1_one", FIXTURE.strip().split("s_rounds AS")[0].rstrip().rstrip(","))
    twice = [f"{t} AS (SELECT * FROM {t}_one UNION ALL SELECT * REPLACE (-round_id AS round_id) FROM {t}_one WHERE round_id % 20 = 7)" for t in ("g_holes", "t_shots", "p_shots")]
    pick = """CASE WHEN len(near) > 0 THEN list_sort(list_transform(near, lambda x: {'d': abs(x.t - a.t), 't': x.t, 'i': x.id}))[1].i
                WHEN len(pool) = 1 THEN pool[1].id END"""
    group = "list({'id': round_id, 'p': player_profile_id, 't': t} ORDER BY t NULLS LAST, round_id)"
    merged = []
    for c in ROUND_COLS:
        if c == "activity_id":
            merged.append("COALESCE(c.activity_id, CASE WHEN p.act IS NOT NULL THEN a.activity_id END) AS activity_id")
        elif c == "location_name":
            merged.append("CASE WHEN p.act IS NOT NULL AND COALESCE(c.location_name, '') = '' THEN a.location_name ELSE c.location_name END AS location_name")
        elif c == "data_source":
            merged.append("CASE WHEN p.act IS NOT NULL THEN 'scorecard+activity' ELSE c.data_source END AS data_source")
        else:
            merged.append(f"c.{c}")
    ids = "k_scope" if pooled else "k_rounds"
    ctes = [
        one,
        *twice,
        """g_rounds AS (
  SELECT round_id, CASE WHEN round_id % 10 = 3 THEN NULL ELSE round_id END AS scorecard_id,
         CASE WHEN round_id % 10 = 3 THEN round_id END AS activity_id, played_on, start_time, course_name, location_name,
         total_score, total_par, exclude_from_stats, comment, CASE WHEN round_id % 50 <> 1 THEN player_profile_id END AS player_profile_id,
         CASE WHEN round_id % 10 = 3 THEN 'activities' ELSE 'scorecard' END AS data_source
  FROM g_rounds_one
  UNION ALL
  SELECT -round_id, NULL, -round_id, played_on,
         played_on || 'T' || lpad(CAST(7 + round_id % 12 AS VARCHAR), 2, '0') || ':00:00', NULL, 'Loc ' || course_name,
         total_score, total_par, exclude_from_stats, comment, CASE WHEN round_id % 30 <> 7 THEN player_profile_id END, 'activities'
  FROM g_rounds_one WHERE round_id % 10 = 7
)""",
        f"""k_scope AS (
  SELECT *, epoch(TRY_CAST(start_time AS TIMESTAMP)) AS t, scorecard_id IS NULL AND activity_id IS NOT NULL AS act FROM g_rounds {scope}
)""",
        f"k_cards AS (SELECT played_on, {group} AS cards FROM k_scope WHERE NOT act AND scorecard_id IS NOT NULL AND played_on IS NOT NULL GROUP BY played_on)",
        f"k_acts AS (SELECT played_on, {group} AS acts FROM k_scope WHERE act AND played_on IS NOT NULL GROUP BY played_on)",
        f"""k_steps AS (
  SELECT played_on, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS act, CAST(NULL AS BIGINT) AS card
  FROM k_acts JOIN k_cards USING (played_on)
  UNION ALL
  SELECT played_on, k + 1, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, a.id, pick
  FROM (
    SELECT played_on, k, used, a, {pick} AS pick FROM (
      SELECT played_on, k, used, a, pool, list_filter(pool, lambda x: abs(x.t - a.t) <= 7200) AS near FROM (
        SELECT played_on, k, used, a, CASE WHEN len(same) > 0 THEN same ELSE cand END AS pool FROM (
          SELECT played_on, k, used, a, cand, list_filter(cand, lambda x: x.p IS NULL OR a.p IS NULL OR x.p = a.p) AS same FROM (
            SELECT s.played_on, s.k, s.used, acts[s.k + 1] AS a, list_filter(cards, lambda x: NOT list_contains(s.used, x.id)) AS cand
            FROM k_steps s JOIN k_acts USING (played_on) JOIN k_cards USING (played_on) WHERE s.k < len(acts)))))
  )
)""",
        "k_pairs AS (SELECT act, card FROM k_steps WHERE card IS NOT NULL)",
        f"""k_rounds AS (
  SELECT {", ".join(merged)} FROM k_scope c LEFT JOIN k_pairs p ON c.round_id = p.card LEFT JOIN k_scope a ON p.act = a.round_id WHERE NOT c.act
  UNION ALL
  SELECT {", ".join(ROUND_COLS)} FROM k_scope WHERE act AND round_id NOT IN (SELECT act FROM k_pairs)
)""",
        "s_rounds AS (SELECT * FROM k_rounds)",
        f"s_holes AS (SELECT * FROM g_holes WHERE round_id IN (SELECT round_id FROM {ids}))",
        f"s_shots AS (SELECT * FROM p_shots WHERE round_id IN (SELECT round_id FROM {ids}))",
    ]
    return sql.replace("WITH " + FIXTURE.strip(), "WITH RECURSIVE " + ",\n".join(ctes))


_DISPLAY = "CASE WHEN trim(course_name) <> '' THEN course_name ELSE location_name END AS display_course_name"
_WHOLE_ROUND = ", ".join(ROUND_COLS + [f"CAST(NULL AS {t}) AS {c}" for c, t in ROUND_NULLS])


def canonical_rounds_sql() -> str:
    return on_two_sources(with_fixture() + f"SELECT {_WHOLE_ROUND} FROM s_rounds", include_excluded=True)


def round_aliases_sql() -> str:
    return on_two_sources(with_fixture() + "SELECT act AS activity_round_id, card AS scorecard_round_id FROM k_pairs", include_excluded=True)


def last_round_sql() -> str:
    last = f"""SELECT {_WHOLE_ROUND}, {_DISPLAY} FROM s_rounds
QUALIFY ROW_NUMBER() OVER (PARTITION BY player_profile_id ORDER BY played_on DESC NULLS LAST, start_time DESC NULLS LAST, round_id DESC NULLS LAST) = 1"""
    return on_two_sources(with_fixture() + last, include_excluded=True)


def last_round_stats_sql() -> str:
    last = "SELECT round_id FROM s_rounds ORDER BY played_on DESC NULLS LAST, start_time DESC NULLS LAST, round_id DESC LIMIT 1"
    narrow = [f"{new} AS (SELECT * FROM {old} WHERE round_id = ({last}))" for old, new in (("s_rounds", "l_rounds"), ("g_holes", "l_holes"), ("p_shots", "l_shots"))]
    meta = with_fixture() + f"SELECT round_id, COALESCE(exclude_from_stats, FALSE) AS exclude_from_stats, COALESCE(comment, '') AS comment FROM s_rounds WHERE round_id = ({last})"
    body = summary_sql("l_rounds", "l_holes", "l_shots", key="round_id", extra_ctes=tuple(narrow))
    return on_two_sources(f"SELECT q.*, m.exclude_from_stats, m.comment FROM ({body}) q JOIN ({meta}) m ON q.round_id = m.round_id", include_excluded=True)


def reconciled_rounds_list_sql() -> str:
    rows = f"SELECT round_id, played_on, {_DISPLAY}, COALESCE(exclude_from_stats, FALSE) AS exclude_from_stats, comment FROM s_rounds"
    return on_two_sources(with_fixture() + rows, include_excluded=True)


# ------------------------------------------------------------------- ingest
def normalize_rounds_sql() -> str:
    return with_fixture() + """SELECT round_id, round_id AS scorecard_id, played_on, start_time, course_name,
       total_score, total_par, FALSE AS exclude_from_stats, CAST(NULL AS VARCHAR) AS comment, player_profile_id
FROM g_rounds"""


def normalize_holes_sql() -> str:
    return with_fixture() + """SELECT round_id, hole_number, par, strokes, putts, fairway_hit, gir, penalties, fairway_shot_outcome
FROM g_holes"""


def normalize_shots_sql() -> str:
    return with_fixture() + """SELECT round_id, hole_number, shot_number, round_id AS scorecard_id, shot_number AS shot_order,
       CASE WHEN club IS NULL AND club_id = 13 THEN 'Putter' ELSE club END AS club, club_id,
       distance_meters, lie, shot_type
FROM g_shots"""


def export_scorecards_sql() -> str:
    return with_fixture() + """SELECT r.round_id AS scorecard_id, '2025-06-02T00:00:00+00:00' AS exported_at, 'teebox-export' AS source,
       CAST(floor(r.round_id / 50.0) AS BIGINT) AS page_number,
       count(*) OVER (PARTITION BY floor(r.round_id / 50.0)) AS total_rows,
       1 AS listed, r.round_id AS listed_id, r.course_name, 1 AS details,
       COALESCE(h.n, 0) AS holes, r.round_id AS shots_id, s.n AS shots
FROM g_rounds r
LEFT JOIN (SELECT round_id, count(*) AS n FROM g_holes GROUP BY round_id) h ON h.round_id = r.round_id
LEFT JOIN (SELECT round_id, count(*) AS n FROM g_shots GROUP BY round_id) s ON s.round_id = r.round_id
QUALIFY s.n IS NOT NULL"""


# ------------------------------------------------------------------ reports
def course_report_sql() -> str:
    ctes = (
        """cr_rounds AS (
  SELECT *, CASE WHEN trim(course_name) <> '' THEN course_name ELSE location_name END AS display_course_name FROM s_rounds
)""",
        """cr_holes AS (SELECT h.*, r.display_course_name FROM g_holes h JOIN cr_rounds r ON h.round_id = r.round_id)""",
        """cr_shots AS (SELECT s.*, r.display_course_name FROM p_shots s JOIN cr_rounds r ON s.round_id = r.round_id)""",
    )
    summary = summary_sql("cr_rounds", "cr_holes", "cr_shots", key="display_course_name", extra_ctes=ctes)
    focus = course_focus_sql()
    return (
        f"SELECT s.*, f.hardest_holes, f.penalty_holes, f.three_putt_holes, f.gir_trouble_holes\n"
        f"FROM ({summary}) s LEFT JOIN ({focus}) f ON s.display_course_name IS NOT DISTINCT FROM f.display_course_name"
    )


def round_second_shots_sql() -> str:
    return second_shots_sql("g_holes", "p_shots", key="round_id")


# --------------------------------------------------------------- registry
def ORACLE_SQL() -> dict[str, str]:  # noqa: N802
    return {
        "summary": summary_sql(),
        "round_stats": round_stats_sql(),
        "practice_focus": practice_focus_sql(),
        "second_shots": second_shots_sql(),
        "tee_shots": tee_shots_sql(),
        "putting": putting_sql(),
        "club_context": club_context_sql(),
        "club_inventory": club_inventory_sql(),
        "trim_outliers": trim_outliers_sql(),
        "round_clubs": round_clubs_sql(),
        "round_shots": round_shots_sql(),
        "round_holes": round_holes_sql(),
        "course_hole_stats": course_hole_stats_sql(),
        "course_focus": course_focus_sql(),
        "rounds_list": rounds_list_sql(),
        "courses": courses_sql(),
        "round_trends": round_trends_sql(),
        "metric_trend_series": metric_trend_series_sql(),
        "last_round": last_round_sql(),
        "scoped_tables": scoped_tables_sql(),
        "upsert": upsert_sql(),
        "upsert_whole_rows": upsert_sql(preserve=False),
        "annotate": annotate_sql(),
        "message_inventory": message_inventory_sql(),
        "normalize_rounds": normalize_rounds_sql(),
        "normalize_holes": normalize_holes_sql(),
        "normalize_shots": normalize_shots_sql(),
        "export_scorecards": export_scorecards_sql(),
        "incremental_ingest": normalize_rounds_sql(),
        "canonical_rounds": canonical_rounds_sql(),
        "round_aliases": round_aliases_sql(),
        "last_round_stats": last_round_stats_sql(),
        "reconciled_summary": on_two_sources(summary_sql(), pooled=True),
        "reconciled_practice_focus": on_two_sources(practice_focus_sql(), pooled=True),
        "reconciled_trends": on_two_sources(round_trends_sql()),
        "reconciled_rounds_list": reconciled_rounds_list_sql(),
        "reconciled_courses": on_two_sources(courses_sql()),
        "reconciled_club_context": on_two_sources(club_context_sql()),
        "reconciled_club_inventory": on_two_sources(club_inventory_sql()),
        "reconciled_course_report": on_two_sources(course_report_sql()),
        "course_report": course_report_sql(),
        "round_second_shots": round_second_shots_sql(),
        "club_context_course_hole": club_context_sql("1-URGENT", 1),
    }
