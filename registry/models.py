"""Queries over form, scoring, ratings, learning and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchlake.functions.scalar import decay, rounded, score_text
from matchlake.operators import history as H
from matchlake.operators import map_pool as MP
from matchlake.operators import perspective as P
from matchlake.operators import ratings as E
from matchlake.operators import rollups as R
from matchlake.operators import scoring as S
from matchlake.params import ModelParams
from matchlake.plans import evaluation as V
from matchlake.plans import learning as L
from matchlake.plans import predict as M
from matchlake.sources.store import record_results, save_predictions, staged
from registry.base_sql import decay as sql_decay
from registry.base_sql import div, rnd, sql
from registry.catalogue import long, query, r6


def form_history(t):
    return t.form_history


def map_history(t):
    return P.map_history(t.matches, t.map_results, t.player_match_stats)


def today(t):
    return H.latest_date(t.form_history)


# ---- current form -----------------------------------------------------------


@query("decay_weight", sql(f"""SELECT match_id, {rnd(sql_decay('match_date', 'd'))} AS weight
FROM fx_matches CROSS JOIN today"""))
def _(t):
    return r6(t.matches.select("match_id", decay("match_date", today(t)).alias("weight")))


RECORD = "matches_played, weighted_matches, win_rate, map_win_rate, weighted_wins, weighted_maps_won, weighted_maps_played"


@query("weighted_record", sql(f"SELECT team, {RECORD} FROM cur_record"))
def _(t):
    rows = form_history(t)
    return H.weighted_record(rows, H.current_rosters(rows), today(t))


@query("momentum", sql("SELECT team, momentum FROM cur_momentum"))
def _(t):
    rows = form_history(t)
    return H.momentum(rows, H.current_rosters(rows), today(t))


@query("mode_stats", sql("SELECT * FROM cur_modes"))
def _(t):
    return H.mode_stats(map_history(t), H.current_rosters(form_history(t)), today(t))


@query("map_performance", sql(f"""SELECT team, mode, map_name, weighted_plays, weighted_wins, {rnd('win_rate')} AS win_rate
FROM cur_performance"""))
def _(t):
    return r6(H.map_performance(map_history(t), H.current_rosters(form_history(t))))


@query("team_form", sql(f"""SELECT r.team, {', '.join('r.' + c.strip() for c in RECORD.split(','))}, m.momentum,
  q.avg_kd, q.avg_rating, q.avg_damage, q.player_count
FROM cur_record r JOIN cur_momentum m USING (team) JOIN cur_quality q USING (team)"""))
def _(t):
    form = H.current_form(
        form_history(t), R.player_overall(t.player_match_stats, t.matches), today(t)
    )
    return form.select(
        "team", *[c.strip() for c in RECORD.split(",")], "momentum", "avg_kd", "avg_rating",
        "avg_damage", "player_count",
    )


# ---- point in time ----------------------------------------------------------


@query("weighted_record_asof", sql(f"SELECT team, roster_key, as_of_date, {RECORD} FROM asof_record"))
def _(t):
    rows = form_history(t)
    return H.weighted_record_asof(rows, H.side_probes(rows))


@query("squad_matches_played", sql("""SELECT p.team, p.roster_key, p.as_of_date, CAST(COUNT(h.match_id) AS BIGINT) AS matches_played
FROM (SELECT r.team, MAKE_DATE(CAST(MAX(YEAR(m.match_date)) AS BIGINT), 12, 31) AS as_of_date, LIST(DISTINCT u.name) AS squad,
        STRING_AGG(DISTINCT u.name, '|' ORDER BY u.name) AS roster_key
      FROM rosters r JOIN fx_matches m ON m.match_id = r.match_id, UNNEST(r.roster) u(name)
      GROUP BY r.team, YEAR(m.match_date) // 2) p
LEFT JOIN hist h ON h.team = p.team AND h.match_date < p.as_of_date AND LIST_HAS_ANY(p.squad, h.roster)
GROUP BY ALL"""))
def _(t):
    """Matches with anyone of a team's squad of two years, squads of up to seven players."""
    rows = form_history(t)
    squads = (
        rows.select("team", F.year("match_date").alias("year"), F.explode("roster").alias("player_name"))
        .groupBy("team", F.floor(F.col("year") / 2).alias("season"))
        .agg(F.array_join(F.sort_array(F.collect_set("player_name")), "|").alias("roster_key"), F.max("year").alias("year"))
        .select("team", "roster_key", F.make_date("year", F.lit(12), F.lit(31)).alias("as_of_date"))
    )
    return H.matches_played_asof(rows, squads).select("team", "roster_key", "as_of_date", F.col("n").alias("matches_played"))


LATER, FAST = 10_000, ModelParams(decay_rate=0.693 / 7)


@query("weighted_record_short", sql(f"""SELECT team, roster_key, as_of_date + {LATER} AS as_of_date,
  {rnd('COALESCE(SUM(o * GREATEST(0.01, LEAST(1.0, EXP(-(0.693 / 7::DOUBLE) * (as_of_date - match_date))))), 0)', 2)} AS weighted_matches
FROM asof_pairs GROUP BY ALL"""))
def _(t):
    """Weighted matches at a half-life of seven days, on days of the 2020s."""
    rows = form_history(t).withColumn("match_date", F.date_add("match_date", LATER))
    return H.weighted_record_asof(rows, H.side_probes(rows), FAST, counts=False).select(*H.PROBE, "weighted_matches")


@query("momentum_asof", sql("SELECT * FROM asof_momentum"))
def _(t):
    rows = form_history(t)
    return H.momentum_asof(rows, H.side_probes(rows))


@query("recent_context", sql("SELECT * FROM asof_context"))
def _(t):
    rows = form_history(t)
    probes = H.side_probes(rows)
    own = H.weighted_record_asof(rows, probes, counts=False)
    return H.recent_context_asof(rows, probes, own).drop("momentum")


@query("roster_quality_asof", sql("SELECT * FROM asof_quality"))
def _(t):
    return H.roster_quality_asof(t.player_match_stats, t.matches, H.side_probes(form_history(t)))


MODES = (("m0", "Hardpoint"), ("m1", "Search & Destroy"), ("m2", "Overload"))


def _mode_asof_sql():
    cols = []
    for m, mode in MODES:
        here = f"CASE WHEN h.mode = '{mode}' THEN o * dec * mw ELSE 0 END"
        won = f"CASE WHEN h.mode = '{mode}' THEN o * dec * mw * won ELSE 0 END"
        cols.append(f"""{rnd(div(f'COALESCE(SUM({won}), 0)', f'COALESCE(SUM({here}), 0)', times='100.0'), 1)} AS {m}_win_rate,
  {rnd(f'COALESCE(SUM({here}), 0)', 1)} AS {m}_weighted_maps""")
    return sql(f"""SELECT team, roster_key, as_of_date, {', '.join(cols)} FROM (
  SELECT p.team, p.roster_key, p.as_of_date, h.mode, h.won, LEN(LIST_INTERSECT(p.roster, h.roster)) / 4.0::DOUBLE AS o,
    {sql_decay('h.match_date', 'p.as_of_date')} AS dec,
    GREATEST(0.5, LEAST(1.5, 1.0 + ABS(h.score_for - h.score_against) / CAST(300 AS DOUBLE))) AS mw
  FROM probes p LEFT JOIN map_hist h ON h.team = p.team AND h.match_date < p.as_of_date) h
GROUP BY team, roster_key, as_of_date""")


@query("mode_stats_asof", _mode_asof_sql())
def _(t):
    rows = form_history(t)
    return H.mode_stats_asof(rows, H.side_probes(rows))


@query("roster_asof", sql("""SELECT team, as_of_date, roster_key FROM (
  SELECT p.team, p.as_of_date, h.roster_key, ROW_NUMBER() OVER (PARTITION BY p.team, p.as_of_date
    ORDER BY h.match_date DESC, h.match_id DESC) AS rn
  FROM (SELECT DISTINCT team, match_date AS as_of_date FROM hist) p
  LEFT JOIN hist h ON h.team = p.team AND h.match_date < p.as_of_date) WHERE rn = 1"""))
def _(t):
    rows = form_history(t)
    return H.rosters_asof(rows, rows.select("team", "match_date")).select(
        "team", F.col("match_date").alias("as_of_date"), "roster_key"
    )


def _all_fixtures(t):
    return t.matches.select(
        F.col("match_id").alias("fixture_id"), "team_a", "team_b",
        F.col("match_date").alias("as_of_date"),
    )


@query("h2h_before", sql("SELECT * FROM h2h_before"))
def _(t):
    fixtures = _all_fixtures(t)
    pairs = H.pair_form_asof(H.pair_events(t.matches, t.map_results), fixtures)
    met = H.head_to_head(fixtures, pairs)
    return met.select("fixture_id", "team_a", "team_b", "as_of_date", "h_total", "h_a", "h_b")


@query("h2h_leaky", sql("""SELECT f.match_id AS fixture_id, CAST(COUNT(m.match_id) AS BIGINT) AS h_total,
  CAST(COALESCE(SUM(CASE WHEN m.winner = f.team_a THEN 1 ELSE 0 END), 0) AS BIGINT) AS h_a,
  CAST(COALESCE(SUM(CASE WHEN m.winner = f.team_b THEN 1 ELSE 0 END), 0) AS BIGINT) AS h_b
FROM fx_matches f LEFT JOIN fx_matches m ON (m.team_a = f.team_a AND m.team_b = f.team_b)
  OR (m.team_a = f.team_b AND m.team_b = f.team_a AND m.match_date < f.match_date) GROUP BY f.match_id"""))
def _(t):
    met = H.h2h_reference_leak(t.matches, _all_fixtures(t))
    return long(met.select("fixture_id", "h_total", "h_a", "h_b"), "h_total", "h_a", "h_b")


# ---- scoring ----------------------------------------------------------------


def score_current(t, map_pool=False):
    return M.score_current(
        t.fixtures, t.matches, t.map_results, t.player_match_stats, map_pool=map_pool,
        form_history=t.form_history,
    )


@query("win_probability", sql(f"""SELECT fixture_id, team_a, team_b, team_a_probability, team_b_probability,
  {rnd('ABS(team_a_probability - team_b_probability)')} AS confidence FROM scored"""))
def _(t):
    return r6(
        score_current(t), "fixture_id", "team_a", "team_b", "team_a_probability",
        "team_b_probability", "confidence",
    )


@query("mode_probability", sql(f"""SELECT fixture_id, mode, {rnd('prob_a', 1)} AS team_a_probability,
  {rnd('prob_b', 1)} AS team_b_probability,
  CASE WHEN prob_a > prob_b + 1e-9 THEN team_a ELSE team_b END AS predicted_winner FROM mode_scored"""))
def _(t):
    df = score_current(t)
    entries = [
        F.struct(
            F.lit(mode).alias("mode"),
            rounded(f"{m}_prob_a", 1).alias("team_a_probability"),
            rounded(f"{m}_prob_b", 1).alias("team_b_probability"),
            F.when(S.ahead(F.col(f"{m}_prob_a"), F.col(f"{m}_prob_b")), F.col("team_a"))
            .otherwise(F.col("team_b"))
            .alias("predicted_winner"),
        )
        for m, mode in MODES
    ]
    return df.select("fixture_id", F.inline(F.array(*entries)))


@query("series_walk", sql("""SELECT fixture_id, predicted_winner, predicted_score, CAST(maps_played AS INT) AS maps_predicted
FROM walk_result"""))
def _(t):
    return score_current(t).select(
        "fixture_id", "predicted_winner", "predicted_score",
        F.size("map_predictions").alias("maps_predicted"),
    )


@query("pick_pool", sql(f"""SELECT f.fixture_id, s.slot AS map_number, s.mode, r.map_name AS predicted_map,
  {rnd('r.a_rate', 1)} AS team_a_winrate, {rnd('r.b_rate', 1)} AS team_b_winrate,
  {rnd('r.a_plays', 1)} AS team_a_plays, {rnd('r.b_plays', 1)} AS team_b_plays,
  {rnd('(r.a_rate - r.b_rate) * LEAST(r.a_plays + r.b_plays, 10) / CAST(10 AS DOUBLE)')} AS advantage_a
FROM fx_fixtures f CROSS JOIN (VALUES (1, 'Hardpoint', 1), (2, 'Search & Destroy', 1), (3, 'Overload', 1),
  (4, 'Hardpoint', 2), (5, 'Search & Destroy', 2)) s(slot, mode, k)
JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY fixture_id, mode ORDER BY a_plays + b_plays DESC, map_name) AS rn FROM (
  SELECT f.fixture_id, p.mode, p.map_name, COALESCE(a.weighted_plays, 0) AS a_plays, COALESCE(b.weighted_plays, 0) AS b_plays,
    COALESCE(a.win_rate, 50.0) AS a_rate, COALESCE(b.win_rate, 50.0) AS b_rate
  FROM fx_fixtures f CROSS JOIN (SELECT DISTINCT mode, map_name FROM fx_map_results) p
  LEFT JOIN cur_performance a ON a.team = f.team_a AND a.mode = p.mode AND a.map_name = p.map_name
  LEFT JOIN cur_performance b ON b.team = f.team_b AND b.mode = p.mode AND b.map_name = p.map_name)) r
  ON r.fixture_id = f.fixture_id AND r.mode = s.mode AND r.rn = s.k"""))
def _(t):
    rows = H.map_performance(map_history(t), H.current_rosters(form_history(t)))
    pool = S.pool_rows(t.map_results)
    plays = staged(S.team_plays(staged(rows), pool))
    df = S.with_map_pool(t.fixtures, plays, pool)
    return r6(df.select("fixture_id", F.inline("predicted_maps")).drop("reason"))


def _pool_asof_sql():
    return sql(f"""SELECT f.fixture_id, s.slot AS map_number, s.mode, r.map_name AS predicted_map,
  {rnd('r.a_rate', 1)} AS team_a_winrate, {rnd('r.b_rate', 1)} AS team_b_winrate,
  {rnd('r.a_plays', 1)} AS team_a_plays, {rnd('r.b_plays', 1)} AS team_b_plays,
  {rnd('(r.a_rate - r.b_rate) * LEAST(r.a_plays + r.b_plays, 10) / CAST(10 AS DOUBLE)')} AS advantage_a,
  CASE WHEN r.a_plays + r.b_plays > 0 THEN 'most played' ELSE 'unplayed' END AS reason
FROM fx_fixtures f CROSS JOIN (VALUES (1, 'Hardpoint', 1), (2, 'Search & Destroy', 1), (3, 'Overload', 1),
  (4, 'Hardpoint', 2), (5, 'Search & Destroy', 2)) s(slot, mode, k)
JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY fixture_id, mode ORDER BY a_plays + b_plays DESC, map_name) AS rn FROM (
  SELECT f.fixture_id, p.mode, p.map_name, COALESCE(a.plays, 0) AS a_plays, COALESCE(b.plays, 0) AS b_plays,
    COALESCE(a.won / a.plays * 100.0, 50.0) AS a_rate, COALESCE(b.won / b.plays * 100.0, 50.0) AS b_rate
  FROM fx_fixtures f JOIN (SELECT mode, map_name, MIN(match_date) AS first FROM map_rows GROUP BY ALL) p ON p.first < f.as_of_date
  LEFT JOIN pool_seen a ON a.team = f.team_a AND a.as_of_date = f.as_of_date AND a.mode = p.mode AND a.map_name = p.map_name
  LEFT JOIN pool_seen b ON b.team = f.team_b AND b.as_of_date = f.as_of_date AND b.mode = p.mode AND b.map_name = p.map_name)) r
  ON r.fixture_id = f.fixture_id AND r.mode = s.mode AND r.rn = s.k""")


@query("pick_pool_asof", _pool_asof_sql())
def _(t):
    """The pool of every fixture on its own day, with the rosters of the latest earlier matches."""
    cards = staged(P.nested_cards(t.nested))
    fixtures = cards.select(F.col("match_id").alias("fixture_id"), "team_a", "team_b", F.col("match_date").alias("as_of_date"))
    # rosters follow from team and day, so a pair is worked out once a day
    pair = ["team_a", "team_b", "as_of_date"]
    pairs = M.with_rosters_asof(fixtures.select(*pair).distinct(), P.card_sides(cards))
    pools = MP.pools_asof(pairs, P.card_history(cards)).select(*pair, "predicted_maps")
    picked = fixtures.join(pools, pair).select("fixture_id", F.inline("predicted_maps"))
    return r6(picked.filter(F.col("team_a_plays").isNotNull()))


def _single_sql(symmetric: bool, compat: bool) -> str:
    def rate(x):
        base = f"COALESCE({x}.won / CAST({x}.n AS DOUBLE){' * 100.0' if compat else ''}, 0.5)"
        return f"(CASE WHEN {base} = 0 THEN 0.5 ELSE {base} END)" if compat else base

    def shrunk(x):
        w = f"LEAST(COALESCE({x}.n, 0) / CAST(10 AS DOUBLE), 1.0)"
        return f"(({rate(x)} * {w} + 0.5) / ({w} + 1.0))"

    if symmetric:
        x, y = "pa * (1 - pb)", "pb * (1 - pa)"
    else:
        x, y = "pa", "(1 - pb)"
    prob = f"CASE WHEN na = 0 AND nb = 0 THEN 50.0 WHEN {x} + {y} > 0 THEN {x} / ({x} + {y}) * 100.0 ELSE 50.0 END"
    return sql(f"""SELECT match_id, map_number, {rnd('prob', 1)} AS team_a_probability, {rnd('100.0 - prob', 1)} AS team_b_probability,
  CASE WHEN (na = 0 AND nb = 0) OR prob > 100.0 - prob + 1e-9 THEN team_a ELSE team_b END AS predicted_winner,
  CASE WHEN na = 0 AND nb = 0 THEN 'no_data' WHEN na >= 5 AND nb >= 5 THEN 'high' WHEN na >= 3 OR nb >= 3 THEN 'medium'
    ELSE 'low' END AS data_quality, CAST(na AS BIGINT) AS team_a_matches, CAST(nb AS BIGINT) AS team_b_matches
FROM (SELECT *, CAST({prob} AS DOUBLE) AS prob FROM (
  SELECT f.match_id, f.map_number, f.team_a, f.team_b, COALESCE(a.n, 0) AS na, COALESCE(b.n, 0) AS nb,
    {shrunk('a')} AS pa, {shrunk('b')} AS pb
  FROM map_facts f
  LEFT JOIN (SELECT team, mode, map_name, COUNT(*) AS n, SUM(won) AS won FROM map_rows GROUP BY 1, 2, 3) a ON a.team = f.team_a AND a.mode = f.mode AND a.map_name = f.map_name
  LEFT JOIN (SELECT team, mode, map_name, COUNT(*) AS n, SUM(won) AS won FROM map_rows GROUP BY 1, 2, 3) b ON b.team = f.team_b AND b.mode = f.mode AND b.map_name = f.map_name))""")


def _single(t, **options):
    rows = P.map_rows(t.matches, t.map_results)
    requests = P.map_facts(t.matches, t.map_results).select(
        "match_id", "map_number", "team_a", "team_b", "mode", "map_name"
    )
    out = S.predict_maps(requests, R.team_map_mode(rows), **options)
    return out.drop("team_a", "team_b", "mode", "map_name", "confidence")


@query("single_map", _single_sql(False, False))
def _(t):
    return _single(t)


@query("single_map_symmetric", _single_sql(True, False))
def _(t):
    return _single(t, symmetric=True)


@query("single_map_compat", _single_sql(False, True))
def _(t):
    return _single(t, compat=True)


def _rotation_sql():
    def shrunk(x):
        w = f"LEAST(COALESCE({x}.n, 0) / CAST(10 AS DOUBLE), 1.0)"
        return f"((COALESCE({x}.won / CAST({x}.n AS DOUBLE), 0.5) * {w} + 0.5) / ({w} + 1.0))"

    return sql(f"""SELECT fixture_id, CASE WHEN a_takes THEN team_a ELSE team_b END AS predicted_winner,
  CONCAT('3-', CAST(last_slot - 3 AS VARCHAR)) AS predicted_score, CAST(last_slot AS INT) AS maps_predicted,
  {rnd('CASE WHEN last_slot = 3 THEN (mh + ms + mc) / 3 WHEN last_slot = 4 THEN (2 * mh + ms + mc) / 4 ELSE (2 * mh + 2 * ms + mc) / 5 END', 1)} AS confidence
FROM (SELECT *, CASE WHEN h + s + c IN (0, 3) THEN 3 WHEN (CASE WHEN a_takes THEN 2 * h + s + c ELSE 4 - (2 * h + s + c) END) = 3
    THEN 4 ELSE 5 END AS last_slot
  FROM (SELECT *, 2 * h + 2 * s + c >= 3 AS a_takes FROM (
    SELECT fixture_id, team_a, team_b,
      MAX(CASE WHEN mode = 'Hardpoint' THEN aw END) AS h, MAX(CASE WHEN mode = 'Search & Destroy' THEN aw END) AS s,
      MAX(CASE WHEN mode = 'Control' THEN aw END) AS c, MAX(CASE WHEN mode = 'Hardpoint' THEN m END) AS mh,
      MAX(CASE WHEN mode = 'Search & Destroy' THEN m END) AS ms, MAX(CASE WHEN mode = 'Control' THEN m END) AS mc
    FROM (SELECT *, CASE WHEN (na = 0 AND nb = 0) OR prob > 100.0 - prob + 1e-9 THEN 1 ELSE 0 END AS aw,
            {rnd('ABS(2 * prob - 100.0)', 1)} AS m
          FROM (SELECT *, CASE WHEN na = 0 AND nb = 0 THEN 50.0 ELSE pa / (pa + 1 - pb) * 100.0 END AS prob FROM (
            SELECT f.*, md.mode, COALESCE(a.n, 0) AS na, COALESCE(b.n, 0) AS nb, {shrunk('a')} AS pa, {shrunk('b')} AS pb
            FROM fx_fixtures f CROSS JOIN (VALUES ('Hardpoint'), ('Search & Destroy'), ('Control')) md(mode)
            LEFT JOIN (SELECT team, mode, COUNT(*) AS n, SUM(won) AS won FROM map_rows GROUP BY 1, 2) a
              ON a.team = f.team_a AND a.mode = md.mode
            LEFT JOIN (SELECT team, mode, COUNT(*) AS n, SUM(won) AS won FROM map_rows GROUP BY 1, 2) b
              ON b.team = f.team_b AND b.mode = md.mode)))
    GROUP BY fixture_id, team_a, team_b)))""")


@query("series_rotation", _rotation_sql())
def _(t):
    stats = R.mode_rollup(R.team_map_mode(P.map_rows(t.matches, t.map_results)))
    return S.predict_rotation(t.fixtures, stats).select(
        "fixture_id", "predicted_winner", "predicted_score", "maps_predicted", "confidence"
    )


def _conversion_sql():
    def win(p, n):
        from math import comb

        return "(" + " + ".join(
            f"{comb(n - 1 + k, k)} * POW({p}, {n}) * POW(1.0::DOUBLE - {p}, {k})" for k in range(n)
        ) + ")"

    # invert on a fine grid of map probabilities by linear search of the bracketing pair,
    # then refine by the secant rule: exact to the digits compared
    steps = ", ".join(f"s{i} AS (SELECT fixture_id, team_a, team_b, target, "
                      f"CASE WHEN {win('((lo + hi) / 2)', 3)} < target THEN (lo + hi) / 2 ELSE lo END AS lo, "
                      f"CASE WHEN {win('((lo + hi) / 2)', 3)} < target THEN hi ELSE (lo + hi) / 2 END AS hi FROM s{i - 1})"
                      for i in range(1, 41))
    base = sql("""SELECT fixture_id, team_a, team_b, statistical_probability / 100.0 AS target FROM predictions""")
    best = ", ".join(
        f"{rnd(f'{c} * POW(f, 4) * POW(1.0::DOUBLE - f, {k}) * 100.0', 8)} AS c{k}" for k, c in enumerate((1, 4, 10, 20))
    )
    return f"""WITH RECURSIVE base AS ({base}),
s0 AS (SELECT fixture_id, team_a, team_b, target, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM base), {steps},
p AS (SELECT fixture_id, team_a, team_b, (lo + hi) / 2 AS p FROM s40),
w AS (SELECT *, {win('p', 4)} * 100.0 AS lw FROM p),
g AS (SELECT *, CASE WHEN lw > 50.0 + 1e-6 THEN p ELSE 1.0 - p END AS f FROM w),
k AS (SELECT *, {best} FROM g)
SELECT fixture_id, {rnd('p')} AS map_probability_a, {rnd('lw')} AS long_probability_a,
  CASE WHEN lw > 50.0 + 1e-6 THEN team_a ELSE team_b END AS long_winner,
  CASE WHEN c3 >= GREATEST(c0, c1, c2) THEN '4-3' WHEN c2 >= GREATEST(c0, c1) THEN '4-2' WHEN c1 >= c0 THEN '4-1'
    ELSE '4-0' END AS long_score, {rnd('GREATEST(c0, c1, c2, c3)')} AS long_score_probability FROM k"""


@query("series_conversion", _conversion_sql())
def _(t):
    df = predictions(t).withColumnRenamed("statistical_probability", "team_a_probability")
    out = S.convert_series_length(df.select("fixture_id", "team_a", "team_b", "team_a_probability"))
    return r6(
        out, "fixture_id", "map_probability_a", "long_probability_a", "long_winner", "long_score",
        "long_score_probability",
    )


@query("prediction_summary", sql("""SELECT s.fixture_id, s.team_a, s.team_b, team_a_probability, team_b_probability,
  w.predicted_winner, w.predicted_score, FLOOR(ABS(team_a_probability - team_b_probability) * 1000000 + 0.5 + 1e-9) / 1000000.0 AS confidence,
  a_win_rate AS team_a_win_rate, a_map_win_rate AS team_a_map_win_rate, a_avg_kd AS team_a_avg_kd,
  b_win_rate AS team_b_win_rate, b_map_win_rate AS team_b_map_win_rate, b_avg_kd AS team_b_avg_kd
FROM scored s JOIN walk_result w USING (fixture_id)"""))
def _(t):
    return r6(M.prediction_summary(score_current(t)))


@query("view_agreement", sql("""SELECT s.fixture_id,
  CASE WHEN team_a_probability > team_b_probability THEN s.team_a ELSE s.team_b END AS overall_winner,
  (CASE WHEN team_a_probability > team_b_probability THEN s.team_a ELSE s.team_b END) = w.predicted_winner AS views_agree
FROM scored s JOIN walk_result w USING (fixture_id)"""))
def _(t):
    return M.with_agreement(score_current(t)).select("fixture_id", "overall_winner", "views_agree")


def _cmp(m):
    return f"CASE WHEN a_{m} > b_{m} THEN '>' WHEN b_{m} > a_{m} THEN '<' ELSE '=' END AS cmp_{m}"


@query("metric_comparison", sql(f"""SELECT fixture_id, {', '.join(_cmp(m) for m in
  ('win_rate', 'map_win_rate', 'avg_kd', 'avg_rating'))} FROM scored"""))
def _(t):
    return S.compare_metrics(score_current(t)).select(
        "fixture_id", "cmp_win_rate", "cmp_map_win_rate", "cmp_avg_kd", "cmp_avg_rating"
    )


@query("confidence_labels", sql("""SELECT fixture_id, CASE WHEN c > 30 THEN 'HIGH' WHEN c > 15 THEN 'MODERATE' ELSE 'LOW' END AS confidence_text,
  CASE WHEN c >= 30 THEN 'HIGH' WHEN c >= 20 THEN 'MODERATE' WHEN c >= 10 THEN 'LOW' ELSE 'VERY LOW' END AS confidence_level,
  CASE WHEN a_momentum > 0.3 THEN 'hot' WHEN a_momentum < -0.3 THEN 'cold' ELSE 'steady' END AS form_a,
  CASE WHEN b_momentum > 0.3 THEN 'hot' WHEN b_momentum < -0.3 THEN 'cold' ELSE 'steady' END AS form_b
FROM (SELECT *, FLOOR(ABS(team_a_probability - team_b_probability) * 10 + 0.5) / 10.0 AS c FROM scored)"""))
def _(t):
    df = score_current(t).withColumn("confidence", rounded("confidence", 1))
    return M.with_labels(df).select(
        "fixture_id", "confidence_text", "confidence_level", "form_a", "form_b"
    )


@query("map_count", sql("""SELECT fixture_id, CASE WHEN GREATEST(p, 100 - p) >= 70 THEN CASE WHEN p > 100 - p THEN '3-0' ELSE '0-3' END
  WHEN GREATEST(p, 100 - p) >= 60 THEN CASE WHEN p > 100 - p THEN '3-1' ELSE '1-3' END
  ELSE CASE WHEN p > 100 - p THEN '3-2' ELSE '2-3' END END AS score
FROM (SELECT fixture_id, statistical_probability AS p FROM predictions)"""))
def _(t):
    from matchlake.functions.scalar import map_count

    p = F.col("statistical_probability")
    return predictions(t).select("fixture_id", map_count(p, 100.0 - p).alias("score"))


@query("full_prediction")
def _(t):
    """The complete statistical record with map pool and map-by-map predictions."""
    df = score_current(t, map_pool=True)
    return df.select(
        "fixture_id", "team_a", "team_b", "team_a_probability", "team_b_probability",
        "predicted_winner", "predicted_score", "confidence", "reason",
        F.to_json("map_predictions").alias("map_predictions"),
        F.to_json("predicted_maps").alias("predicted_maps"),
    )


# ---- ratings ----------------------------------------------------------------


@query("expected_score", sql(f"""SELECT fixture_id,
  {rnd('1.0 / (1.0 + POW(10.0::DOUBLE, (elo_probability - statistical_probability) * 10 / CAST(400 AS DOUBLE)))')} AS expected_a FROM predictions"""))
def _(t):
    df = predictions(t)
    a, b = (F.col(c) * 10.0 for c in ("statistical_probability", "elo_probability"))
    return r6(df.select("fixture_id", S.expected_score(a, b).alias("expected_a")))


def rating_history(t):
    return staged(E.rating_history(t.matches, t.player_match_stats))


@query("rating_history")
def _(t):
    return r6(rating_history(t))


@query("rating_board")
def _(t):
    return r6(E.leaderboard(E.rating_board(rating_history(t)), min_matches=0, limit=None))


@query("rating_input", sql("""SELECT m.league_id, m.match_id, m.match_date, m.team_a, m.team_b, a.roster_key AS key_a,
  b.roster_key AS key_b, m.team_a_score AS score_a, m.team_b_score AS score_b
FROM fx_matches m JOIN rosters a ON a.match_id = m.match_id AND a.team = m.team_a
JOIN rosters b ON b.match_id = m.match_id AND b.team = m.team_b WHERE LEN(a.roster) = 4 AND LEN(b.roster) = 4"""))
def _(t):
    return E.rating_input(t.matches, t.player_match_stats)


@query("rating_prediction")
def _(t):
    """Rating model on current rosters."""
    rows = form_history(t)
    current = H.current_rosters(rows)
    ratings = E.ratings_now(E.rating_board(rating_history(t)), current)
    df = t.fixtures
    for side in ("a", "b"):
        df = df.join(
            current.select(
                F.col("team").alias(f"team_{side}"),
                F.col("roster_key").alias(f"{side}_roster_key"),
            ),
            f"team_{side}",
        )
    out = E.with_rating_prediction(E.attach_ratings(df, ratings))
    return r6(
        out, "fixture_id", "rating_a", "rating_b", "elo_probability_a", "elo_probability_b",
        "elo_winner", "elo_score", "elo_confidence", "rating_difference",
    )


@query("rating_asof")
def _(t):
    return r6(E.ratings_asof(rating_history(t), H.side_probes(form_history(t))))


# ---- ensemble and explanations ----------------------------------------------


def predictions(t):
    """Model columns by arithmetic on the match id: a log with known content."""
    i = F.col("match_id")
    a, b = F.col("team_a"), F.col("team_b")

    def prob(k):
        return (30 + (i * k) % 40).cast("double")

    stat = F.when(i % 2 == 0, a).otherwise(b)
    three = F.concat(F.lit("3-"), i % 3)
    ml = i % 4 != 0
    done = i % 9 != 0
    return t.matches.select(
        i.alias("fixture_id"),
        "match_date",
        "team_a",
        "team_b",
        stat.alias("statistical_winner"),
        three.alias("statistical_score"),
        prob(7).alias("statistical_probability"),
        F.when(i % 3 == 0, a).otherwise(b).alias("elo_winner"),
        F.concat(i % 4, F.lit("-3")).alias("elo_score"),
        prob(11).alias("elo_probability"),
        F.when(ml, F.when(i % 5 < 3, a).otherwise(b)).alias("ml_winner"),
        F.when(ml, F.concat(F.lit("3-"), i % 2)).alias("ml_score"),
        F.when(ml, prob(13)).alias("ml_probability"),
        stat.alias("ensemble_winner"),
        three.alias("ensemble_score"),
        prob(7).alias("ensemble_probability"),
        F.abs(prob(7) * 2 - 100).alias("ensemble_confidence"),
        F.when(done, F.col("winner")).alias("actual_winner"),
        F.when(done, score_text("team_a_score", "team_b_score")).alias("actual_score"),
        F.col("match_date").cast("timestamp").alias("prediction_timestamp"),
        F.when(done, F.col("match_date").cast("timestamp")).alias("result_timestamp"),
        F.lit(None).cast("string").alias("notes"),
    )


def _models(t):
    base = predictions(t).select(
        "fixture_id", "team_a", "team_b", "statistical_winner", "statistical_score",
        "statistical_probability", "elo_winner", "elo_score",
        F.col("elo_probability").alias("elo_probability_a"), "ml_winner", "ml_score",
        F.col("ml_probability").alias("ml_probability_a"),
    )
    return base


AGREE = """(statistical_winner = elo_winner AND COALESCE(ml_winner = statistical_winner, TRUE)) AS models_agree,
  CASE WHEN ml_winner IS NULL THEN 'statistical,elo' ELSE 'statistical,elo,ml' END AS models_used"""


@query("ensemble_fallback", sql(f"""SELECT fixture_id, statistical_winner AS ensemble_winner, statistical_score AS ensemble_score,
  {rnd('statistical_probability', 1)} AS ensemble_probability, {rnd('ABS(2 * statistical_probability - 100)', 1)} AS ensemble_confidence,
  {AGREE} FROM predictions"""))
def _(t):
    return M.with_ensemble(_models(t)).select(
        "fixture_id", "ensemble_winner", "ensemble_score", "ensemble_probability",
        "ensemble_confidence", "models_agree", "models_used",
    )


@query("ensemble_weighted", sql(f"""SELECT fixture_id, CASE WHEN p > 50 THEN team_a ELSE team_b END AS ensemble_winner,
  p AS ensemble_probability, {rnd('ABS(2 * p - 100)', 1)} AS ensemble_confidence, {AGREE} FROM (SELECT *,
  {rnd('''CASE WHEN ml_winner IS NULL THEN (statistical_probability * 0.4 + elo_probability * 0.35) / CAST(0.75 AS DOUBLE)
    ELSE statistical_probability * 0.4 + elo_probability * 0.35 + ml_probability * 0.25 END''', 1)} AS p FROM predictions)"""))
def _(t):
    return M.with_ensemble(_models(t), "weighted").select(
        "fixture_id", "ensemble_winner", "ensemble_probability", "ensemble_confidence",
        "models_agree", "models_used",
    )


@query("predict_single", sql("""SELECT fixture_id, team_a, team_b, elo_winner AS predicted_winner, elo_score AS predicted_score,
  elo_probability AS team_a_probability FROM predictions"""))
def _(t):
    return M.predict_single(M.with_ensemble(_models(t)), "elo")


def _rated_fixtures(t):
    """Scored fixtures with arithmetic ratings, so that the rules can be stated in SQL."""
    df = M.with_statistical_columns(score_current(t))
    i = F.col("fixture_id")
    return df.withColumns(
        {
            "rating_a": (1450 + i % 131).cast("double"),
            "rating_b": (1450 + (i * 7) % 131).cast("double"),
            "models_agree": i % 3 == 0,
        }
    )


@query("explanation", sql("""SELECT fixture_id, CASE WHEN lm > 0.3 THEN 'momentum' WHEN lw > 10 THEN 'win rate'
  WHEN lr > 0.05 THEN 'player quality' WHEN p > 45 AND p < 55 THEN 'toss-up' ELSE 'mixed' END AS statistical_reason,
  CASE WHEN ABS(gap) < 20 THEN 'even' WHEN gap > 50 THEN 'team_a clearly higher' WHEN gap < -50 THEN 'team_b clearly higher'
    WHEN gap > 0 THEN 'team_a slightly higher' ELSE 'team_b slightly higher' END AS rating_reason,
  CASE WHEN h_total = 0 THEN 'no meetings' WHEN h_a > h_b * 1.5 THEN 'team_a dominates' WHEN h_b > h_a * 1.5 THEN 'team_b dominates'
    ELSE 'close' END AS meetings_reason
FROM (SELECT s.fixture_id, h_total, h_a, h_b, team_a_probability AS p, (s.fixture_id % 131) - ((s.fixture_id * 7) % 131) AS gap,
    CASE WHEN w.predicted_winner = s.team_a THEN a_momentum - b_momentum ELSE -(a_momentum - b_momentum) END AS lm,
    CASE WHEN w.predicted_winner = s.team_a THEN a_win_rate - b_win_rate ELSE -(a_win_rate - b_win_rate) END AS lw,
    CASE WHEN w.predicted_winner = s.team_a THEN a_avg_rating - b_avg_rating ELSE -(a_avg_rating - b_avg_rating) END AS lr
  FROM scored s JOIN walk_result w USING (fixture_id))"""))
def _(t):
    return M.explain(_rated_fixtures(t)).select(
        "fixture_id", "statistical_reason", "rating_reason", "meetings_reason"
    )


@query("which_model", sql("""SELECT fixture_id, CASE WHEN h_total >= 3 THEN 'learned'
  WHEN ABS((fixture_id % 131) - ((fixture_id * 7) % 131)) > 50 THEN 'rating'
  WHEN ABS(a_momentum - b_momentum) > 0.5 THEN 'statistical' ELSE 'ensemble' END AS trusted_model FROM scored"""))
def _(t):
    return M.trusted_model(_rated_fixtures(t)).select("fixture_id", "trusted_model")


@query("which_model_short", sql("""SELECT fixture_id, CASE WHEN fixture_id % 3 = 0 THEN 'ensemble' WHEN h_total >= 3 THEN 'learned'
  WHEN ABS((fixture_id % 131) - ((fixture_id * 7) % 131)) > 50 THEN 'rating' ELSE 'statistical' END AS trusted_model FROM scored"""))
def _(t):
    return M.trusted_model(_rated_fixtures(t), short=True).select("fixture_id", "trusted_model")


# ---- learning ---------------------------------------------------------------


def _features_sql():
    return sql(f"""SELECT f.fixture_id, f.as_of_date, CAST(CASE WHEN m.winner = f.team_a THEN 1 ELSE 0 END AS DOUBLE) AS label,
  {rnd('a.win_rate - b.win_rate')} AS win_rate_diff, {rnd('a.map_win_rate - b.map_win_rate')} AS map_win_rate_diff,
  {rnd('qa.avg_kd - qb.avg_kd')} AS kd_diff, {rnd('qa.avg_rating - qb.avg_rating')} AS rating_diff,
  {rnd('qa.avg_damage - qb.avg_damage')} AS damage_diff, {rnd('ma.momentum - mb.momentum')} AS momentum_diff,
  a.weighted_matches AS weighted_matches_a, b.weighted_matches AS weighted_matches_b,
  {rnd('a.weighted_matches * b.weighted_matches')} AS experience_interaction,
  {rnd("CASE WHEN f.h_total >= 3 THEN (f.h_a - f.h_b) / CAST(f.h_total AS DOUBLE) * LEAST(f.h_total / CAST(5 AS DOUBLE), 1.0) ELSE 0.0 END")} AS h2h_diff,
  {rnd('ca.recent_win_rate - cb.recent_win_rate')} AS recent_win_rate_diff,
  {rnd('ca.recent_map_win_rate - cb.recent_map_win_rate')} AS recent_map_win_rate_diff,
  {rnd('ca.roster_stability - cb.roster_stability')} AS roster_stability_diff,
  {rnd('ca.rest_days - cb.rest_days')} AS rest_days_diff,
  {rnd('ca.opponent_strength - cb.opponent_strength')} AS opponent_strength_diff
FROM h2h_before f JOIN fx_matches m ON m.match_id = f.fixture_id
JOIN rosters ra ON ra.match_id = m.match_id AND ra.team = m.team_a JOIN rosters rb ON rb.match_id = m.match_id AND rb.team = m.team_b
JOIN asof_record a ON a.team = m.team_a AND a.roster_key = ra.roster_key AND a.as_of_date = m.match_date
JOIN asof_record b ON b.team = m.team_b AND b.roster_key = rb.roster_key AND b.as_of_date = m.match_date
JOIN asof_quality qa ON qa.team = m.team_a AND qa.roster_key = ra.roster_key AND qa.as_of_date = m.match_date
JOIN asof_quality qb ON qb.team = m.team_b AND qb.roster_key = rb.roster_key AND qb.as_of_date = m.match_date
JOIN asof_momentum ma ON ma.team = m.team_a AND ma.roster_key = ra.roster_key AND ma.as_of_date = m.match_date
JOIN asof_momentum mb ON mb.team = m.team_b AND mb.roster_key = rb.roster_key AND mb.as_of_date = m.match_date
JOIN asof_context ca ON ca.team = m.team_a AND ca.roster_key = ra.roster_key AND ca.as_of_date = m.match_date
JOIN asof_context cb ON cb.team = m.team_b AND cb.roster_key = rb.roster_key AND cb.as_of_date = m.match_date
WHERE LEN(ra.roster) = 4 AND LEN(rb.roster) = 4 AND a.matches_played >= 10 AND b.matches_played >= 10""")


def training_set(t, **options):
    return L.training_set(
        t.matches, t.map_results, t.player_match_stats, form_history=t.form_history, **options
    )


@query("training_features", _features_sql())
def _(t):
    return r6(training_set(t).drop("position"))


@query("training_positions", sql("""SELECT match_id AS fixture_id, CAST(ROW_NUMBER() OVER (ORDER BY match_date, match_id) AS BIGINT)
  AS match_number FROM fx_matches"""))
def _(t):
    return long(
        V.match_list(t.matches).select(F.col("match_id").alias("fixture_id"), "match_number"),
        "match_number",
    )


@query("learned_scores")
def _(t):
    """The setting that validates best, trained on all matches, calibrated, applied to all fixtures."""
    t = t.kept()
    model = L.train(training_set(t))
    features = L.fixture_features(
        t.fixtures, t.matches, t.map_results, t.player_match_stats, form_history=t.form_history
    )
    return L.score(features, model).select(
        "fixture_id", "ml_probability_a", "ml_probability_b", "ml_winner", "ml_score", "ml_confidence"
    )


@query("feature_importance")
def _(t):
    model = L.train(training_set(t))
    return r6(L.feature_importance(t.spark, model))


@query("candidate_report")
def _(t):
    """Chronological validation of all settings over all folds."""
    model = L.train(training_set(t))
    return L.candidate_report(t.spark, model.candidates)


@query("legacy_records", sql("""SELECT r.team, last_10, players, head_to_head FROM (
  SELECT team, STRING_AGG(CONCAT(kind, ':', CAST(w AS VARCHAR), '-', CAST(n - w AS VARCHAR)), ';' ORDER BY kind) AS last_10 FROM (
    SELECT team, kind, CAST(SUM(won) AS BIGINT) AS w, COUNT(*) AS n FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY team, kind ORDER BY match_date DESC, match_id DESC, map_number DESC) AS rn FROM (
        SELECT team, 'Series' AS kind, match_date, match_id, 0 AS map_number, won FROM series_rows
        UNION ALL SELECT team, mode, match_date, match_id, map_number, won FROM map_rows)) WHERE rn <= 10 GROUP BY team, kind)
  GROUP BY team) r
LEFT JOIN (SELECT team, STRING_AGG(player_name, ';' ORDER BY player_name) AS players FROM (
  SELECT DISTINCT team, player_name FROM fx_player_match_stats) GROUP BY team) p USING (team)
LEFT JOIN (SELECT team, STRING_AGG(CONCAT(opponent, ':', CAST(n AS VARCHAR)), ';' ORDER BY opponent) AS head_to_head FROM (
  SELECT team, opponent, COUNT(*) AS n FROM series_rows WHERE won = 1 GROUP BY team, opponent) GROUP BY team) h USING (team)"""))
def _(t):
    rows = L.legacy_records(
        t.matches, P.map_rows(t.matches, t.map_results), t.player_match_stats
    )

    def text(column, fn):
        return F.array_join(F.transform(column, fn), ";").alias(column)

    return rows.select(
        "team",
        text("last_10", lambda x: F.concat(x["kind"], F.lit(":"), x["wins"], F.lit("-"), x["losses"])),
        text("players", lambda x: x["player_name"]),
        text("head_to_head", lambda x: F.concat(x["opponent"], F.lit(":"), x["wins"])),
    )


# ---- evaluation -------------------------------------------------------------


@query("match_list", sql("""SELECT match_id, match_date, winner, CONCAT(CAST(team_a_score AS VARCHAR), '-', CAST(team_b_score AS VARCHAR)) AS score,
  CAST(ROW_NUMBER() OVER (ORDER BY match_date, match_id) AS BIGINT) AS match_number FROM fx_matches"""))
def _(t):
    return long(V.match_list(t.matches).drop("team_a", "team_b"), "match_number")


def _long_sql(where: str, model: str) -> str:
    return f"""SELECT '{model}' AS model, {model}_winner AS pw, {model}_score AS ps, actual_winner AS aw, actual_score AS sc
FROM predictions WHERE {model}_winner IS NOT NULL {where}"""


def _all_models(where: str) -> str:
    return " UNION ALL ".join(_long_sql(where, m) for m in ("statistical", "elo", "ml", "ensemble"))


@query("accuracy_stats", sql(f"""SELECT model, total, correct, correct_score, {rnd('correct * 100.0 / total')} AS accuracy,
  {rnd('correct_score * 100.0 / total')} AS score_accuracy, CASE WHEN model = 'ensemble' THEN ht END AS high_conf_total,
  CASE WHEN model = 'ensemble' THEN hc END AS high_conf_correct,
  CASE WHEN model = 'ensemble' THEN {rnd('hc * 100.0 / ht')} END AS high_conf_accuracy
FROM (SELECT model, CAST(COUNT(*) AS BIGINT) AS total, CAST(SUM(CASE WHEN pw = aw THEN 1 ELSE 0 END) AS BIGINT) AS correct,
  CAST(SUM(CASE WHEN pw = aw AND ps = sc THEN 1 ELSE 0 END) AS BIGINT) AS correct_score
  FROM ({_all_models('AND actual_winner IS NOT NULL')}) GROUP BY model)
CROSS JOIN (SELECT CAST(COUNT(*) AS BIGINT) AS ht, CAST(SUM(CASE WHEN ensemble_winner = actual_winner THEN 1 ELSE 0 END) AS BIGINT) AS hc
  FROM predictions WHERE actual_winner IS NOT NULL AND ensemble_confidence > 30)"""))
def _(t):
    return r6(V.log_accuracy(predictions(t)))


@query("backtest_accuracy", sql(f"""SELECT model, CAST(COUNT(*) AS BIGINT) AS total,
  CAST(SUM(CASE WHEN pw = aw THEN 1 ELSE 0 END) AS BIGINT) AS correct,
  CAST(SUM(CASE WHEN ps = sc THEN 1 ELSE 0 END) AS BIGINT) AS correct_score,
  {rnd('SUM(CASE WHEN pw = aw THEN 1 ELSE 0 END) * 100.0 / COUNT(*)')} AS accuracy,
  {rnd('SUM(CASE WHEN ps = sc THEN 1 ELSE 0 END) * 100.0 / COUNT(*)')} AS score_accuracy
FROM ({_all_models('')}) GROUP BY model"""))
def _(t):
    return r6(V.backtest_accuracy(predictions(t)))


@query("accuracy_summary", sql(f"""SELECT {rnd('AVG(acc)')} AS mean_accuracy, FIRST(model ORDER BY acc DESC, model) AS best_model
FROM (SELECT model, SUM(CASE WHEN pw = aw THEN 1 ELSE 0 END) * 100.0 / CAST(COUNT(*) AS DOUBLE) AS acc FROM ({_all_models('')}) GROUP BY model)"""))
def _(t):
    return r6(V.accuracy_summary(V.backtest_accuracy(predictions(t))))


@query("confidence_buckets", sql(f"""SELECT CASE WHEN ensemble_confidence < 20 THEN 'low' WHEN ensemble_confidence < 40 THEN 'medium'
  ELSE 'high' END AS bucket, CAST(COUNT(*) AS BIGINT) AS total,
  CAST(SUM(CASE WHEN ensemble_winner = actual_winner THEN 1 ELSE 0 END) AS BIGINT) AS correct,
  {rnd('SUM(CASE WHEN ensemble_winner = actual_winner THEN 1 ELSE 0 END) * 100.0 / COUNT(*)')} AS accuracy FROM predictions GROUP BY 1"""))
def _(t):
    return r6(V.confidence_buckets(predictions(t)))


@query("all_models_wrong", sql("""SELECT fixture_id FROM predictions WHERE NOT (COALESCE(statistical_winner = actual_winner, FALSE)
  OR COALESCE(elo_winner = actual_winner, FALSE) OR COALESCE(ml_winner = actual_winner, FALSE)) ORDER BY match_date, fixture_id LIMIT 10"""))
def _(t):
    return V.all_wrong(predictions(t), 10).select("fixture_id")


@query("pending_predictions", sql("""SELECT match_date, team_a, team_b, ensemble_winner AS predicted_winner, ensemble_score AS predicted_score,
  ensemble_probability AS probability, ensemble_confidence AS confidence FROM predictions WHERE actual_winner IS NULL"""))
def _(t):
    return V.pending(predictions(t))


@query("recent_scored", sql("""SELECT match_date, team_a, team_b, predicted_winner, actual_winner, correct FROM (
  SELECT match_date, team_a, team_b, ensemble_winner AS predicted_winner, actual_winner, ensemble_winner = actual_winner AS correct,
    ROW_NUMBER() OVER (ORDER BY match_date DESC, team_a, team_b) AS rn
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_date, team_a, team_b ORDER BY fixture_id DESC) AS c FROM predictions)
  WHERE c = 1 AND actual_winner IS NOT NULL) WHERE rn <= 10"""))
def _(t):
    from matchlake.sources.store import keep_last

    log = keep_last(predictions(t), ["match_date", "team_a", "team_b"], ["fixture_id"])
    return V.recent_scored(log, 10).select(
        "match_date", "team_a", "team_b", "predicted_winner", "actual_winner", "correct"
    )


@query("snapshot_scores", sql("""SELECT p.fixture_id AS match_id, p.statistical_winner AS predicted_winner, m.winner AS actual_winner,
  CASE WHEN m.match_id IS NULL THEN NULL ELSE CONCAT(CAST(m.team_a_score AS VARCHAR), '-', CAST(m.team_b_score AS VARCHAR)) END AS actual_score,
  m.match_id IS NOT NULL AS found, p.statistical_winner = m.winner AS correct
FROM predictions p LEFT JOIN (SELECT * FROM fx_matches WHERE match_id % 10 <> 0) m ON m.match_id = p.fixture_id"""))
def _(t):
    snapshot = predictions(t).select(
        F.col("fixture_id").alias("match_id"), F.col("statistical_winner").alias("predicted_winner")
    )
    return V.score_snapshot(snapshot, t.matches.filter(F.col("match_id") % 10 != 0))


def _log(t):
    from matchlake.sources.store import keep_last

    rows = keep_last(predictions(t), ["match_date", "team_a", "team_b"], ["fixture_id"])
    return rows.drop("fixture_id")


@query("prediction_log_save", sql("""SELECT match_date, team_a, team_b, CASE WHEN YEAR(match_date) >= 2000 THEN 'second' END AS notes,
  CASE WHEN YEAR(match_date) >= 2000 THEN NULL ELSE actual_winner END AS actual_winner
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_date, team_a, team_b ORDER BY fixture_id DESC) AS c FROM predictions) WHERE c = 1"""))
def _(t):
    log = _log(t)
    again = log.filter(F.year("match_date") >= 2000).withColumns(
        {
            "notes": F.lit("second"),
            "actual_winner": F.lit(None).cast("string"),
            "actual_score": F.lit(None).cast("string"),
        }
    )
    return save_predictions(log, again).select(
        "match_date", "team_a", "team_b", "notes", "actual_winner"
    )


@query("prediction_log_results", sql("""SELECT match_date, team_a, team_b, COALESCE(actual_winner, team_a) AS actual_winner,
  COALESCE(actual_score, '3-2') AS actual_score
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_date, team_a, team_b ORDER BY fixture_id DESC) AS c FROM predictions) WHERE c = 1"""))
def _(t):
    log = _log(t)
    results = log.filter(F.col("actual_winner").isNull()).select(
        "match_date", "team_a", "team_b", F.col("team_a").alias("winner"), F.lit("3-2").alias("score"),
        F.col("prediction_timestamp").alias("result_timestamp"),
    )
    return record_results(log, results)[0].select(
        "match_date", "team_a", "team_b", "actual_winner", "actual_score"
    )


@query("prediction_log_unmatched", sql("""SELECT match_date + 4000 AS match_date, team_a, team_b, winner FROM fx_matches WHERE match_id % 3 = 0"""))
def _(t):
    late = F.when(F.col("match_id") % 3 == 0, 4000).otherwise(0)
    results = t.matches.select(
        F.date_add("match_date", late).alias("match_date"), "team_a", "team_b", "winner",
        score_text("team_a_score", "team_b_score").alias("score"),
        F.col("match_date").cast("timestamp").alias("result_timestamp"),
    )
    return record_results(_log(t), results)[1].select("match_date", "team_a", "team_b", "winner")


@query("strict_backtest")
def _(t):
    """All four models on every match after the 20th, each from earlier matches only."""
    t = t.kept()
    fixtures = V.backtest_fixtures(t.matches, 20)
    scored = staged(
        M.score_asof(
            fixtures, t.matches, t.map_results, t.player_match_stats, context=True, form_history=t.form_history
        ).withColumns(L.feature_columns())
    )
    data = staged(training_set(t))
    versions = L.chosen_versions(data, data.count())
    learned = L.score_versions(scored, versions, L.version_days(data, versions))
    ratings = E.ratings_asof(rating_history(t), M.fixture_probes(scored))
    return r6(V.backtest_accuracy(M.compare_models(learned, ratings, mode="weighted"), text_scores=False))


def _backtest_versions_sql():
    return f"""WITH feats AS ({_features_sql()}),
numbered AS (SELECT *, ROW_NUMBER() OVER (ORDER BY as_of_date, fixture_id) AS position, COUNT(*) OVER () AS n FROM feats),
sizes AS (SELECT MAX(n) AS n, LEAST(5, GREATEST(2, MAX(n) // 20), MAX(n) - 1) AS splits FROM numbered),
starts AS (SELECT unnest(range(1, splits + 1)) AS version, n, splits FROM sizes),
bounds AS (SELECT version, n - splits * (n // (splits + 1)) + (version - 1) * (n // (splits + 1)) AS start FROM starts),
known AS (SELECT b.version, b.start, COUNT(*) AS trained_rows, CAST(SUM(label) AS BIGINT) AS positives, MAX(as_of_date) AS last_day
  FROM bounds b JOIN numbered x ON x.position <= b.start GROUP BY ALL),
spans AS (SELECT *, LEAD(last_day) OVER (ORDER BY version) AS next_day FROM known)
SELECT CAST(version AS INTEGER) AS version, CAST(start AS BIGINT) AS start, trained_rows, positives, last_day,
  (SELECT COUNT(*) FROM (SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_orderdate AS DATE) AS day,
     ROW_NUMBER() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS no
     FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) o
   WHERE no > 20 AND day > last_day AND (next_day IS NULL OR day <= next_day)) AS fixtures
FROM spans"""


@query("backtest_versions", _backtest_versions_sql())
def _(t):
    """Model versions of the replay: what each was trained on and how many fixtures it scores."""
    data = staged(training_set(t))
    versions = L.chosen_versions(data, data.count())
    days = L.version_days(data, versions)
    rows = [(i + 1, v.start, v.rows, v.positives, day) for i, (v, day) in enumerate(zip(versions, days))]
    known = t.spark.createDataFrame(rows, "version int, start long, trained_rows long, positives long, last_day date")
    fixtures = V.backtest_fixtures(t.matches, 20).select(L.version_of(F.col("as_of_date"), days).alias("version"))
    counts = fixtures.groupBy("version").agg(F.count(F.lit(1)).alias("fixtures"))
    return known.join(counts, "version", "left").fillna(0, ["fixtures"])


@query("asof_predictions")
def _(t):
    """Point-in-time statistical prediction of the upcoming fixtures."""
    df = M.score_asof(
        t.fixtures, t.matches, t.map_results, t.player_match_stats, form_history=t.form_history
    )
    return df.select(
        "fixture_id", "team_a_probability", "team_b_probability", "predicted_winner",
        "predicted_score", "reason",
    )
