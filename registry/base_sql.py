"""Common table expressions of the reference SQL, as plain text for DuckDB.

They state the rules directly (joins on earlier dates, unions of both sides), without any
of the compaction the Spark operators use.
"""

from __future__ import annotations

LAMBDA = "(CAST(0.693 AS DOUBLE) / 30)"


def rnd(x: str, digits: int = 6) -> str:
    return f"(FLOOR(CAST({x} AS DOUBLE) * {10**digits} + 0.5 + 1e-9) / {10**digits}.0)"


def div(num: str, den: str, empty: str = "0.0", times: str = "1.0") -> str:
    n, d = f"CAST({num} AS DOUBLE)", f"CAST({den} AS DOUBLE)"
    return f"(CASE WHEN {d} <> 0 THEN {n} / {d} * {times} ELSE {empty} END)"


def decay(day: str, as_of: str) -> str:
    return f"GREATEST(0.01, LEAST(1.0, EXP(-{LAMBDA} * ({as_of} - {day}))))"


def share(a: str, b: str) -> str:
    return (
        f"(CASE WHEN ({a}) + ({b}) > 0 THEN CAST({a} AS DOUBLE) / (({a}) + ({b})) * 100.0 "
        "ELSE 50.0 END)"
    )


CTES: dict[str, str] = {}

CTES["fx_map_results"] = """
SELECT CAST(l_orderkey AS BIGINT) AS match_id,
       CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS map_number,
       CASE l_returnflag WHEN 'A' THEN 'Hardpoint' WHEN 'N' THEN 'Search & Destroy' ELSE 'Overload' END AS mode,
       p_brand AS map_name,
       CAST(l_quantity AS INT) AS team_a_score, CAST(p_size AS INT) AS team_b_score,
       l_partkey AS lp, l_suppkey AS ls
FROM lineitem JOIN part ON l_partkey = p_partkey"""

CTES["fx_matches"] = """
SELECT t.match_id, t.league_id, t.team_a, t.team_b,
       CASE WHEN wa > wb THEN t.team_a ELSE t.team_b END AS winner,
       CAST(wa AS INT) AS team_a_score, CAST(wb AS INT) AS team_b_score,
       CONCAT('Stage ', CAST(t.match_id % 3 AS VARCHAR)) AS tournament, t.match_date
FROM (SELECT o.*, CONCAT('L', CAST(league_id AS VARCHAR), '-T', CAST(ia AS VARCHAR)) AS team_a,
             CONCAT('L', CAST(league_id AS VARCHAR), '-T', CAST(ib AS VARCHAR)) AS team_b
      FROM (SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS match_date,
                   o_custkey % 20 AS league_id,
                   CAST(FLOOR(o_custkey / 20.0) AS BIGINT) % 12 AS ia,
                   (CAST(FLOOR(o_custkey / 20.0) AS BIGINT) + 1 + o_orderkey % 11) % 12 AS ib
            FROM orders) o) t
JOIN (SELECT match_id, SUM(CASE WHEN team_a_score > team_b_score THEN 1 ELSE 0 END) AS wa,
             SUM(CASE WHEN team_b_score > team_a_score THEN 1 ELSE 0 END) AS wb
      FROM fx_map_results GROUP BY match_id) s ON t.match_id = s.match_id"""

CTES["fx_player_map_stats"] = """
SELECT match_id, map_number, CONCAT(team, '-P', CAST(pno AS VARCHAR)) AS player_name, team, mode, map_name,
       kills, deaths, damage, rating,
       CASE WHEN deaths > 0 THEN CAST(kills AS DOUBLE) / deaths ELSE CAST(kills AS DOUBLE) END AS kd
FROM (SELECT m.match_id, r.map_number, r.mode, r.map_name,
             CASE WHEN side = 0 THEN m.team_a ELSE m.team_b END AS team,
             (YEAR(m.match_date) - 1995 + CASE WHEN k = 3 AND m.match_id % 5 = 0 THEN 4 ELSE k END) % 7 AS pno,
             CAST(10 + (lp + 7 * k + 3 * side) % 23 AS INT) AS kills,
             CAST((ls + 5 * k + 11 * side) % 29 AS INT) AS deaths,
             CAST(1500 + (13 * lp + 101 * k + 57 * side) % 3000 AS INT) AS damage,
             CAST(50 + (lp + ls + 17 * k + 29 * side) % 101 AS DOUBLE) / 100.0 AS rating
      FROM fx_matches m JOIN fx_map_results r ON m.match_id = r.match_id
      CROSS JOIN (VALUES (0), (1), (2), (3)) kk(k) CROSS JOIN (VALUES (0), (1)) ss(side))"""

CTES["fx_player_match_stats"] = """
SELECT match_id, player_name, team, CAST(SUM(kills) AS BIGINT) AS kills, CAST(SUM(deaths) AS BIGINT) AS deaths,
       CASE WHEN SUM(deaths) > 0 THEN CAST(SUM(kills) AS DOUBLE) / CAST(SUM(deaths) AS DOUBLE)
            ELSE CAST(SUM(kills) AS DOUBLE) END AS kd,
       CAST(SUM(damage) AS BIGINT) AS damage, AVG(rating) AS rating
FROM fx_player_map_stats GROUP BY match_id, player_name, team"""

CTES["fx_fixtures"] = """
SELECT match_id AS fixture_id, team_a, team_b, match_date AS as_of_date
FROM fx_matches"""

CTES["map_facts"] = """
SELECT m.match_id, r.map_number, r.mode, r.map_name, m.match_date, m.team_a, m.team_b,
       r.team_a_score, r.team_b_score,
       CASE WHEN r.team_a_score > r.team_b_score THEN m.team_a ELSE m.team_b END AS map_winner
FROM fx_matches m JOIN fx_map_results r ON m.match_id = r.match_id"""

CTES["map_rows"] = """
SELECT match_id, map_number, mode, map_name, match_date, 'a' AS side, team_a AS team, team_b AS opponent,
       team_a_score AS score_for, team_b_score AS score_against,
       CASE WHEN map_winner = team_a THEN 1 ELSE 0 END AS won FROM map_facts
UNION ALL
SELECT match_id, map_number, mode, map_name, match_date, 'b', team_b, team_a, team_b_score, team_a_score,
       CASE WHEN map_winner = team_b THEN 1 ELSE 0 END FROM map_facts"""

CTES["card"] = """
SELECT m.*, COALESCE(c.n, 0) AS maps_played, COALESCE(c.a, 0) AS maps_a,
       COALESCE(c.n, 0) - COALESCE(c.a, 0) AS maps_b
FROM fx_matches m LEFT JOIN (
  SELECT match_id, CAST(COUNT(*) AS BIGINT) AS n,
         CAST(SUM(CASE WHEN team_a_score > team_b_score THEN 1 ELSE 0 END) AS BIGINT) AS a
  FROM fx_map_results GROUP BY match_id) c ON m.match_id = c.match_id"""

CTES["series_rows"] = """
SELECT match_id, match_date, league_id, 'a' AS side, team_a AS team, team_b AS opponent,
       team_a_score AS score_for, team_b_score AS score_against,
       CASE WHEN winner = team_a THEN 1 ELSE 0 END AS won, maps_played, maps_a AS maps_won FROM card
UNION ALL
SELECT match_id, match_date, league_id, 'b', team_b, team_a, team_b_score, team_a_score,
       CASE WHEN winner = team_b THEN 1 ELSE 0 END, maps_played, maps_b FROM card"""

CTES["rosters"] = """
SELECT match_id, team, LIST(DISTINCT player_name ORDER BY player_name) AS roster,
       STRING_AGG(DISTINCT player_name, '|' ORDER BY player_name) AS roster_key
FROM fx_player_match_stats GROUP BY match_id, team"""

CTES["hist"] = """
SELECT s.*, r.roster, r.roster_key FROM series_rows s
LEFT JOIN rosters r ON s.match_id = r.match_id AND s.team = r.team"""

CTES["map_hist"] = """
SELECT s.*, r.roster, r.roster_key FROM map_rows s
LEFT JOIN rosters r ON s.match_id = r.match_id AND s.team = r.team"""

CTES["today"] = "SELECT MAX(match_date) AS d FROM fx_matches"

CTES["cur"] = """
SELECT team, match_id, match_date, roster, roster_key FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY team ORDER BY match_date DESC, match_id DESC) AS rn FROM hist)
WHERE rn = 1"""

CTES["cur_hist"] = f"""
SELECT h.*, LEN(LIST_INTERSECT(c.roster, h.roster)) / 4.0::DOUBLE AS o,
       {decay('h.match_date', 't.d')} AS dec
FROM hist h JOIN cur c ON h.team = c.team CROSS JOIN today t"""

CTES["cur_maps"] = f"""
SELECT h.*, LEN(LIST_INTERSECT(c.roster, h.roster)) / 4.0::DOUBLE AS o,
       {decay('h.match_date', 't.d')} AS dec,
       CAST(h.score_for - h.score_against AS DOUBLE) AS diff,
       GREATEST(0.5, LEAST(1.5, 1.0 + ABS(h.score_for - h.score_against) / CAST(300 AS DOUBLE))) AS mw
FROM map_hist h JOIN cur c ON h.team = c.team CROSS JOIN today t"""


def record_columns(n: str, w: str, won: str, maps_won: str, maps: str) -> str:
    return f"""CAST({n} AS BIGINT) AS matches_played, {rnd(w, 2)} AS weighted_matches,
  {rnd(div(won, w, times='100.0'), 1)} AS win_rate, {rnd(div(maps_won, maps, times='100.0'), 1)} AS map_win_rate,
  {rnd(won, 2)} AS weighted_wins, {rnd(maps_won, 2)} AS weighted_maps_won,
  {rnd(maps, 2)} AS weighted_maps_played"""


CTES["cur_record"] = f"""
SELECT team, {record_columns('SUM(CASE WHEN o > 0 THEN 1 ELSE 0 END)', 'SUM(o * dec)', 'SUM(o * dec * won)',
                             'SUM(o * dec * maps_won)', 'SUM(o * dec * maps_played)')}
FROM cur_hist GROUP BY team"""

CTES["cur_momentum"] = f"""
SELECT team, {rnd(div('SUM(w * r)', 'SUM(w)'), 3)} AS momentum FROM (
  SELECT team, o * dec * (6 - rn) / CAST(5 AS DOUBLE) AS w, CASE WHEN won = 1 THEN 1.0 ELSE -1.0 END AS r FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY team ORDER BY match_date DESC, match_id DESC) AS rn FROM cur_hist)
  WHERE rn <= 5) GROUP BY team"""

CTES["cur_modes"] = f"""
SELECT team, mode, {rnd(div('SUM(o * dec * mw * won)', 'SUM(o * dec * mw)', times='100.0'), 1)} AS win_rate,
  {rnd('SUM(o * dec * mw)', 1)} AS weighted_maps,
  {rnd(div('SUM(o * dec * diff)', 'SUM(CASE WHEN o > 0 THEN 1 ELSE 0 END)'), 1)} AS avg_score_diff,
  CAST(SUM(CASE WHEN o > 0 THEN 1 ELSE 0 END) AS BIGINT) AS maps_played,
  {rnd(div('SUM(o * dec * diff)', 'SUM(o * dec)'), 1)} AS weighted_score_diff
FROM cur_maps GROUP BY team, mode"""

CTES["cur_performance"] = f"""
SELECT team, mode, map_name, SUM(o) AS weighted_plays, SUM(o * won) AS weighted_wins,
  {div('SUM(o * won)', 'SUM(o)', times='100.0')} AS win_rate
FROM cur_maps WHERE o > 0 GROUP BY team, mode, map_name"""

CTES["players"] = """
SELECT player_name, ARG_MAX(team, ROW(match_date, match_id)) AS current_team, CAST(COUNT(*) AS BIGINT) AS total_matches,
  AVG(kills) AS avg_kills, AVG(deaths) AS avg_deaths, AVG(kd) AS avg_kd, AVG(damage) AS avg_damage,
  AVG(rating) AS avg_rating, CAST(SUM(kills) AS BIGINT) AS total_kills,
  CAST(SUM(deaths) AS BIGINT) AS total_deaths, CAST(SUM(damage) AS BIGINT) AS total_damage
FROM fx_player_match_stats s JOIN (SELECT match_id, match_date FROM fx_matches) m USING (match_id)
GROUP BY player_name"""

CTES["cur_quality"] = f"""
SELECT c.team, {rnd('AVG(p.avg_kd)', 2)} AS avg_kd, {rnd('AVG(p.avg_rating)', 2)} AS avg_rating,
  {rnd('AVG(p.avg_damage)', 0)} AS avg_damage, CAST(COUNT(p.player_name) AS BIGINT) AS player_count
FROM (SELECT team, UNNEST(roster) AS player_name FROM cur) c LEFT JOIN players p USING (player_name)
GROUP BY c.team"""

CTES["pairs"] = """
SELECT LEAST(team_a, team_b) AS team_1, GREATEST(team_a, team_b) AS team_2, CAST(COUNT(*) AS BIGINT) AS n,
  SUM(CASE WHEN winner = LEAST(team_a, team_b) THEN 1 ELSE 0 END) AS w1
FROM fx_matches GROUP BY 1, 2"""

CTES["pair_modes"] = """
SELECT LEAST(team_a, team_b) AS team_1, GREATEST(team_a, team_b) AS team_2, mode, CAST(COUNT(*) AS BIGINT) AS n,
  SUM(CASE WHEN map_winner = LEAST(team_a, team_b) THEN 1 ELSE 0 END) AS w1
FROM map_facts GROUP BY 1, 2, 3"""


def side_form(x: str) -> str:
    cols = ["matches_played", "weighted_matches", "win_rate", "map_win_rate"]
    return ", ".join(f"{x}r.{c} AS {x}_{c}" for c in cols) + ", " + ", ".join(
        [f"{x}m.momentum AS {x}_momentum"]
        + [f"{x}q.{c} AS {x}_{c}" for c in ("avg_kd", "avg_rating", "avg_damage", "player_count")]
    )


CTES["scored_base"] = f"""
SELECT f.*, {side_form('a')}, {side_form('b')}, COALESCE(p.n, 0) AS h_total,
  COALESCE(CASE WHEN f.team_a = p.team_1 THEN w1 ELSE n - w1 END, 0) AS h_a,
  COALESCE(CASE WHEN f.team_a = p.team_1 THEN n - w1 ELSE w1 END, 0) AS h_b
FROM fx_fixtures f
JOIN cur_record ar ON ar.team = f.team_a JOIN cur_record br ON br.team = f.team_b
JOIN cur_momentum am ON am.team = f.team_a JOIN cur_momentum bm ON bm.team = f.team_b
JOIN cur_quality aq ON aq.team = f.team_a JOIN cur_quality bq ON bq.team = f.team_b
LEFT JOIN pairs p ON p.team_1 = LEAST(f.team_a, f.team_b) AND p.team_2 = GREATEST(f.team_a, f.team_b)"""


def quality(x: str, y: str) -> str:
    return (
        f"(CASE WHEN {x}_player_count > 0 AND {y}_player_count > 0 THEN "
        f"{share(f'{x}_avg_kd', f'{y}_avg_kd')} * 0.6 + {share(f'{x}_avg_rating', f'{y}_avg_rating')} * 0.3 + "
        f"{share(f'{x}_avg_damage', f'{y}_avg_damage')} * 0.1 ELSE 50.0 END)"
    )


def _side_prob(x: str, y: str) -> str:
    chem = (
        f"(CASE WHEN {x}_win_rate + {y}_win_rate > 0 AND {x}_map_win_rate + {y}_map_win_rate > 0 THEN "
        f"{share(f'{x}_win_rate', f'{y}_win_rate')} * 0.7 + {share(f'{x}_map_win_rate', f'{y}_map_win_rate')} * 0.3 "
        f"ELSE {share(f'{x}_win_rate', f'{y}_win_rate')} END)"
    )
    total = "(a_weighted_matches + b_weighted_matches)"
    cw = f"(CASE WHEN {total} >= 8 THEN 0.7 WHEN {total} >= 4 THEN 0.5 ELSE 0.3 END)"
    base = f"({chem} * {cw} + {quality(x, y)} * (1.0 - {cw}))"
    prob = f"({base} * 0.85 + (50.0 + {x}_momentum * 25.0) * 0.15)"
    hw = "LEAST(h_total * 0.05, 0.15)"
    return (
        f"(CASE WHEN h_total > 0 THEN {prob} * (1.0 - {hw}) + CAST(h_{x} AS DOUBLE) / h_total * 100.0 * {hw} "
        f"ELSE {prob} END)"
    )


CTES["scored"] = f"""
SELECT *, {rnd('pa / (pa + pb) * 100.0', 1)} AS team_a_probability, {rnd('pb / (pa + pb) * 100.0', 1)} AS team_b_probability
FROM (SELECT *, CAST({_side_prob('a', 'b')} AS DOUBLE) AS pa, CAST({_side_prob('b', 'a')} AS DOUBLE) AS pb FROM scored_base)"""


def _mode_prob(x: str, y: str) -> str:
    total = "(a_maps + b_maps)"
    cw = f"(CASE WHEN {total} >= 6 THEN 0.7 WHEN {total} >= 3 THEN 0.5 ELSE 0.3 END)"
    prob = f"({share(f'{x}_rate', f'{y}_rate')} * {cw} + {quality(x, y)} * (1.0 - {cw}))"
    mw, hw = "LEAST(n_mode * 0.08, 0.20)", "LEAST(h_total * 0.05, 0.10)"
    return (
        f"(CASE WHEN n_mode > 0 THEN {prob} * (1.0 - {mw}) + CAST(mode_{x} AS DOUBLE) / n_mode * 100.0 * {mw} "
        f"WHEN h_total > 0 THEN {prob} * (1.0 - {hw}) + CAST(h_{x} AS DOUBLE) / h_total * 100.0 * {hw} "
        f"ELSE {prob} END)"
    )


CTES["mode_scored"] = f"""
SELECT *, pa / (pa + pb) * 100.0 AS prob_a, pb / (pa + pb) * 100.0 AS prob_b FROM (
  SELECT *, CAST({_mode_prob('a', 'b')} AS DOUBLE) AS pa, CAST({_mode_prob('b', 'a')} AS DOUBLE) AS pb FROM (
    SELECT s.*, md.mode, COALESCE(am.win_rate, 0.0) AS a_rate, COALESCE(bm.win_rate, 0.0) AS b_rate,
      COALESCE(am.weighted_maps, 0.0) AS a_maps, COALESCE(bm.weighted_maps, 0.0) AS b_maps,
      COALESCE(p.n, 0) AS n_mode,
      COALESCE(CASE WHEN s.team_a = p.team_1 THEN p.w1 ELSE p.n - p.w1 END, 0) AS mode_a,
      COALESCE(CASE WHEN s.team_a = p.team_1 THEN p.n - p.w1 ELSE p.w1 END, 0) AS mode_b
    FROM scored_base s
    CROSS JOIN (VALUES ('Hardpoint'), ('Search & Destroy'), ('Overload')) md(mode)
    LEFT JOIN cur_modes am ON am.team = s.team_a AND am.mode = md.mode
    LEFT JOIN cur_modes bm ON bm.team = s.team_b AND bm.mode = md.mode
    LEFT JOIN pair_modes p ON p.team_1 = LEAST(s.team_a, s.team_b)
      AND p.team_2 = GREATEST(s.team_a, s.team_b) AND p.mode = md.mode))"""

CTES["walked"] = """
SELECT w.*, CASE WHEN 2 * h + 2 * s + o >= 3 THEN 1 ELSE 0 END AS a_takes
FROM (SELECT fixture_id, team_a, team_b,
        MAX(CASE WHEN mode = 'Hardpoint' AND prob_a > prob_b + 1e-9 THEN 1 ELSE 0 END) AS h,
        MAX(CASE WHEN mode = 'Search & Destroy' AND prob_a > prob_b + 1e-9 THEN 1 ELSE 0 END) AS s,
        MAX(CASE WHEN mode = 'Overload' AND prob_a > prob_b + 1e-9 THEN 1 ELSE 0 END) AS o
      FROM mode_scored GROUP BY fixture_id, team_a, team_b) w"""

CTES["walk_result"] = """
SELECT fixture_id, team_a, team_b, CASE WHEN a_takes = 1 THEN team_a ELSE team_b END AS predicted_winner,
  CONCAT('3-', CAST(last_slot - 3 AS VARCHAR)) AS predicted_score, last_slot AS maps_played FROM (
  SELECT *, CASE WHEN h + s + o IN (0, 3) THEN 3
                 WHEN (CASE WHEN a_takes = 1 THEN 2 * h + s + o ELSE 4 - (2 * h + s + o) END) = 3 THEN 4
                 ELSE 5 END AS last_slot FROM walked)"""

CTES["probes"] = "SELECT DISTINCT team, roster_key, roster, match_date AS as_of_date FROM hist"

CTES["asof_pairs"] = f"""
SELECT p.team, p.roster_key, p.as_of_date, h.match_id, h.match_date, h.opponent, h.won, h.maps_won, h.maps_played,
  LEN(LIST_INTERSECT(p.roster, h.roster)) / 4.0::DOUBLE AS o, {decay('h.match_date', 'p.as_of_date')} AS dec
FROM probes p LEFT JOIN hist h ON h.team = p.team AND h.match_date < p.as_of_date"""

CTES["asof_record"] = f"""
SELECT team, roster_key, as_of_date, {record_columns(
    'SUM(CASE WHEN o > 0 THEN 1 ELSE 0 END)', 'COALESCE(SUM(o * dec), 0)', 'COALESCE(SUM(o * dec * won), 0)',
    'COALESCE(SUM(o * dec * maps_won), 0)', 'COALESCE(SUM(o * dec * maps_played), 0)')}
FROM asof_pairs GROUP BY team, roster_key, as_of_date"""

CTES["asof_ranked"] = """
SELECT *, ROW_NUMBER() OVER (PARTITION BY team, roster_key, as_of_date ORDER BY match_date DESC, match_id DESC) AS rn
FROM asof_pairs WHERE match_id IS NOT NULL"""

CTES["asof_momentum"] = f"""
SELECT p.team, p.roster_key, p.as_of_date, {rnd('COALESCE(SUM(w * r) / NULLIF(SUM(w), 0), 0)', 3)} AS momentum
FROM probes p LEFT JOIN (
  SELECT team, roster_key, as_of_date, o * dec * (6 - rn) / CAST(5 AS DOUBLE) AS w,
    CASE WHEN won = 1 THEN 1.0 ELSE -1.0 END AS r FROM asof_ranked WHERE rn <= 5) x
  USING (team, roster_key, as_of_date)
GROUP BY p.team, p.roster_key, p.as_of_date"""

CTES["opp_roster"] = "SELECT match_id, team AS opponent, roster_key AS opponent_key FROM hist"

CTES["context_rows"] = """
SELECT r.*, r.o * r.dec AS w, COALESCE(rec.win_rate, 0.0) AS opp_rate,
  ROW_NUMBER() OVER (PARTITION BY r.team, r.roster_key, r.as_of_date ORDER BY r.rn) AS vn
FROM asof_ranked r
LEFT JOIN opp_roster x ON x.match_id = r.match_id AND x.opponent = r.opponent
LEFT JOIN asof_record rec ON rec.team = r.opponent AND rec.roster_key = x.opponent_key AND rec.as_of_date = r.match_date
WHERE r.rn <= 20 AND r.o > 0"""

CTES["asof_context"] = f"""
SELECT p.team, p.roster_key, p.as_of_date,
  {rnd(div('COALESCE(SUM(w * won), 0)', 'COALESCE(SUM(w), 0)', times='100.0'), 1)} AS recent_win_rate,
  {rnd(div('COALESCE(SUM(w * maps_won), 0)', 'COALESCE(SUM(w * maps_played), 0)', times='100.0'), 1)} AS recent_map_win_rate,
  {rnd(div('COALESCE(SUM(o), 0)', 'COUNT(x.match_id)', times='100.0'), 1)} AS roster_stability,
  {rnd('COALESCE(MAX(CASE WHEN rn = 1 THEN p.as_of_date - x.match_date END), 30)', 1)} AS rest_days,
  {rnd(div('COALESCE(SUM(w * opp_rate), 0)', 'COALESCE(SUM(w), 0)'), 1)} AS opponent_strength
FROM probes p LEFT JOIN (SELECT * FROM context_rows WHERE vn <= 5) x USING (team, roster_key, as_of_date)
GROUP BY p.team, p.roster_key, p.as_of_date"""

CTES["pool_seen"] = """
SELECT p.team, p.as_of_date, h.mode, h.map_name, SUM(LEN(LIST_INTERSECT(p.roster, h.roster)) / CAST(4 AS DOUBLE)) AS plays,
  SUM(LEN(LIST_INTERSECT(p.roster, h.roster)) / CAST(4 AS DOUBLE) * h.won) AS won
FROM (SELECT team, as_of_date, roster FROM (
    SELECT d.team, d.as_of_date, h.roster, ROW_NUMBER() OVER (PARTITION BY d.team, d.as_of_date
      ORDER BY h.match_date DESC, h.match_id DESC) AS rn
    FROM (SELECT DISTINCT team, match_date AS as_of_date FROM hist) d JOIN hist h ON h.team = d.team AND h.match_date < d.as_of_date)
  WHERE rn = 1) p
JOIN map_hist h ON h.team = p.team AND h.match_date < p.as_of_date
WHERE LEN(LIST_INTERSECT(p.roster, h.roster)) > 0 GROUP BY ALL"""

CTES["asof_quality"] = f"""
SELECT team, roster_key, as_of_date, {rnd('COALESCE(AVG(kd), 0)', 2)} AS avg_kd,
  {rnd('COALESCE(AVG(rating), 0)', 2)} AS avg_rating, {rnd('COALESCE(AVG(damage), 0)', 0)} AS avg_damage,
  CAST(COUNT(kd) AS BIGINT) AS player_count
FROM (SELECT p.team, p.roster_key, p.as_of_date, p.player_name, AVG(s.kd) AS kd, AVG(s.rating) AS rating,
        AVG(s.damage) AS damage
      FROM (SELECT team, roster_key, as_of_date, UNNEST(roster) AS player_name FROM probes) p
      LEFT JOIN (SELECT s.*, m.match_date FROM fx_player_match_stats s JOIN fx_matches m USING (match_id)) s
        ON s.player_name = p.player_name AND s.match_date < p.as_of_date
      GROUP BY 1, 2, 3, 4)
GROUP BY team, roster_key, as_of_date"""

CTES["h2h_before"] = """
SELECT f.match_id AS fixture_id, f.team_a, f.team_b, f.match_date AS as_of_date, CAST(COUNT(m.match_id) AS BIGINT) AS h_total,
  CAST(COALESCE(SUM(CASE WHEN m.winner = f.team_a THEN 1 ELSE 0 END), 0) AS BIGINT) AS h_a,
  CAST(COALESCE(SUM(CASE WHEN m.winner = f.team_b THEN 1 ELSE 0 END), 0) AS BIGINT) AS h_b
FROM fx_matches f LEFT JOIN fx_matches m
  ON LEAST(m.team_a, m.team_b) = LEAST(f.team_a, f.team_b) AND GREATEST(m.team_a, m.team_b) = GREATEST(f.team_a, f.team_b)
  AND m.match_date < f.match_date
GROUP BY 1, 2, 3, 4"""

CTES["predictions"] = """
SELECT match_id AS fixture_id, match_date, team_a, team_b,
  CASE WHEN match_id % 2 = 0 THEN team_a ELSE team_b END AS statistical_winner,
  CONCAT('3-', CAST(match_id % 3 AS VARCHAR)) AS statistical_score,
  CAST(30 + (match_id * 7) % 40 AS DOUBLE) AS statistical_probability,
  CASE WHEN match_id % 3 = 0 THEN team_a ELSE team_b END AS elo_winner,
  CONCAT(CAST(match_id % 4 AS VARCHAR), '-3') AS elo_score,
  CAST(30 + (match_id * 11) % 40 AS DOUBLE) AS elo_probability,
  CASE WHEN match_id % 4 = 0 THEN NULL WHEN match_id % 5 < 3 THEN team_a ELSE team_b END AS ml_winner,
  CASE WHEN match_id % 4 = 0 THEN NULL ELSE CONCAT('3-', CAST(match_id % 2 AS VARCHAR)) END AS ml_score,
  CASE WHEN match_id % 4 = 0 THEN NULL ELSE CAST(30 + (match_id * 13) % 40 AS DOUBLE) END AS ml_probability,
  CASE WHEN match_id % 2 = 0 THEN team_a ELSE team_b END AS ensemble_winner,
  CONCAT('3-', CAST(match_id % 3 AS VARCHAR)) AS ensemble_score,
  CAST(30 + (match_id * 7) % 40 AS DOUBLE) AS ensemble_probability,
  ABS(CAST(30 + (match_id * 7) % 40 AS DOUBLE) * 2 - 100) AS ensemble_confidence,
  CASE WHEN match_id % 9 = 0 THEN NULL ELSE winner END AS actual_winner,
  CASE WHEN match_id % 9 = 0 THEN NULL
       ELSE CONCAT(CAST(team_a_score AS VARCHAR), '-', CAST(team_b_score AS VARCHAR)) END AS actual_score
FROM fx_matches"""


def _needs() -> dict[str, list[str]]:
    import re

    names = list(CTES)
    return {
        n: [m for m in names if m != n and re.search(rf"\b{m}\b", CTES[n])] for n in names
    }


def sql(select: str) -> str:
    """A complete statement: the needed table expressions, in order, then the select."""
    import re

    needs = _needs()
    wanted: set[str] = set()
    todo = [n for n in CTES if re.search(rf"\b{n}\b", select)]
    while todo:
        n = todo.pop()
        if n not in wanted:
            wanted.add(n)
            todo += needs[n]
    parts = [f"{n} AS ({CTES[n].strip()})" for n in CTES if n in wanted]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + select.strip()
