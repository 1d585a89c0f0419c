import itertools
import random

import pytest
from pyspark.sql import functions as F

from matchlake.operators import history as H
from matchlake.operators import rollups as R
from matchlake.operators import perspective as P
from matchlake.operators import scoring as S
from matchlake.params import DEFAULTS
from matchlake.plans import catalog
from matchlake.plans import evaluation as V
from matchlake.plans import learning as L
from matchlake.plans import predict as M
from matchlake.sources.store import staged


@pytest.fixture(scope="module")
def scored(tables):
    df = M.score_current(tables.fixtures, tables.matches, tables.map_results, tables.player_match_stats,
                         form_history=tables.form_history)
    return staged(df.drop("_metadata"))


def test_swapping_sides_swaps_probabilities(tables, scored):
    turned = tables.fixtures.select("fixture_id", F.col("team_b").alias("team_a"), F.col("team_a").alias("team_b"), "as_of_date")
    other = M.score_current(turned, tables.matches, tables.map_results, tables.player_match_stats,
                            map_pool=False, form_history=tables.form_history)
    a = {r.fixture_id: r for r in scored.collect()}
    for r in other.collect():
        assert r.team_a_probability == pytest.approx(a[r.fixture_id].team_b_probability, abs=0.11)
        assert r.m0_prob_a == pytest.approx(a[r.fixture_id].m0_prob_b, abs=1e-6)


def test_series_stops_at_three(scored):
    for r in scored.collect():
        wins = [m["predicted_winner"] for m in r.map_predictions]
        assert max(wins.count(r.team_a), wins.count(r.team_b)) == 3 and wins[-1] == r.predicted_winner
        assert r.predicted_score == f"3-{len(wins) - 3}"
        assert len(r.predicted_maps) == 5


def test_unknown_team_has_a_reason(spark, tables):
    fixtures = spark.createDataFrame([(1, "L0-T1", "nobody")], "fixture_id long, team_a string, team_b string")
    row = M.score_current(fixtures, tables.matches, tables.map_results, tables.player_match_stats,
                          form_history=tables.form_history).first()
    assert row.reason == "no roster for one or both teams" and row.predicted_winner is None


def test_walk_of_every_outcome(spark):
    for marks in itertools.product([True, False], repeat=5):
        a = b = 0
        for m in marks:
            if a < 3 and b < 3:
                a, b = a + m, b + (not m)
        got = spark.range(1).select(S.walk([F.lit(m) for m in marks], 3).alias("w")).first().w
        assert (got.a, got.b) == (a, b)


def test_single_map_depends_on_side_order(spark):
    def prob(x, y, **k):
        n = F.lit(0.0)
        return spark.range(1).select(S.single_map_probability(F.lit(x), n + 1e9, F.lit(y), n + 1e9, **k)[0]).first()[0]

    # shrunk rates of .6 and .5 come from raw rates .7 and .5
    assert prob(0.7, 0.5) == pytest.approx(54.545, abs=1e-2)
    assert prob(0.5, 0.7) == pytest.approx(55.556, abs=1e-2)
    assert prob(0.7, 0.5, symmetric=True) + prob(0.5, 0.7, symmetric=True) == pytest.approx(100)


def test_published_series_conversions(spark):
    df = spark.createDataFrame([("x", "y", p) for p in (50.3, 54.4, 55.5)], "team_a string, team_b string, team_a_probability double")
    rows = S.convert_series_length(df).collect()
    assert [round(r.map_probability_a, 4) for r in rows] == [0.5016, 0.5235, 0.5294]
    assert [r.long_score for r in rows] == ["4-2"] * 3
    assert [r.long_score_probability for r in rows] == pytest.approx([15.72, 17.05, 17.40], abs=0.01)
    assert [r.long_probability_a for r in rows] == pytest.approx([50.3, 55.1, 56.4], abs=0.06)


def test_short_map_pool_is_reused(spark):
    plays = spark.createDataFrame([("A", "Hardpoint", "Den", 2.0, 1.0, 50.0)], "team string, mode string, map_name string, "
                                  "weighted_plays double, weighted_wins double, win_rate double")
    pool = spark.createDataFrame([("Hardpoint", "Den"), ("Search & Destroy", "B"), ("Search & Destroy", "A")], "mode string, map_name string")
    fixtures = spark.createDataFrame([("A", "B")], "team_a string, team_b string")
    row = S.with_map_pool(fixtures, S.team_plays(plays, pool), pool).first()
    got = [(m["predicted_map"], m["reason"]) for m in row.predicted_maps]
    assert got == [("Den", "most played"), ("A", "most played"), ("Unknown", "no map data"), ("Den", "pool used up"), ("B", "most played")]


def test_rotation_over_given_maps(tables):
    stats = staged(R.team_map_mode(P.map_rows(tables.matches, tables.map_results)))
    names = ["Brand#11"] * 5
    with pytest.raises(ValueError):
        S.predict_rotation(tables.fixtures, R.mode_rollup(stats), stats, names[:3])
    got = S.predict_rotation(tables.fixtures, R.mode_rollup(stats), stats, names).collect()
    assert got and all(m["map_name"] == "Brand#11" for r in got for m in r.map_predictions)
    assert all(m["data_quality"] == "no_data" for r in got for m in r.map_predictions if m["mode"] == "Control")


def test_large_rosters_are_counted_exactly(spark):
    rng = random.Random(5)
    names = "abcdefgh"
    rows = []
    for i in range(120):
        size = rng.choice([1, 3, 4, 4, 5, 6])
        roster = sorted(rng.sample(names, size))
        rows.append(("T", i, 18000 + rng.randrange(500), rng.randrange(2), roster, "|".join(roster)))
    df = spark.createDataFrame(rows, "team string, match_id int, d int, won int, roster array<string>, roster_key string")
    df = df.withColumn("match_date", F.date_from_unix_date("d")).withColumns({"maps_won": F.col("won"), "maps_played": F.lit(2)})
    got = H.weighted_record_asof(df, H.side_probes(df)).collect()
    for r in got:
        now = set(r.roster_key.split("|"))
        day = (r.as_of_date - __import__("datetime").date(1970, 1, 1)).days
        past = [(len(now & set(x[4])) / 4, x[2], x[3]) for x in rows if x[2] < day]
        assert r.matches_played == sum(o > 0 for o, _, _ in past)
        w = sum(o * max(0.01, 2.718281828459045 ** (-0.0231 * (day - d))) for o, d, _ in past)
        assert r.weighted_matches == pytest.approx(w, abs=0.0051)


def test_wins_equal_losses(tables):
    record = R.team_record(P.series_rows(tables.matches, tables.map_results))
    row = record.agg(F.sum("wins"), F.sum("losses"), F.sum("maps_won"), F.sum("maps_lost")).first()
    assert row[0] == row[1] and row[2] == row[3]


def test_fold_bounds():
    assert L.fold_bounds(100) == [(20, 36), (36, 52), (52, 68), (68, 84), (84, 100)]
    assert L.fold_bounds(45) == [(15, 30), (30, 45)]
    with pytest.raises(ValueError):
        L.fold_bounds(2)


@pytest.fixture(scope="module")
def learned(spark):
    rng = random.Random(11)
    rows = []
    for i in range(240):
        x = [rng.gauss(0, 1) for _ in L.FEATURES]
        label = float(x[0] + 0.5 * x[9] + rng.gauss(0, 0.5) > 0)
        rows.append((i, label, i + 1, *x))
    schema = "fixture_id long, label double, position long, " + ", ".join(f"{f} double" for f in L.FEATURES)
    data = spark.createDataFrame(rows, schema)
    return data, L.train(data, L.CANDIDATES[:2] + L.CANDIDATES[4:5], max_splits=2)


def test_training_and_validation(spark, learned, tmp_path):
    data, model = learned
    assert model.rows == 240 and model.best.mean_accuracy > 0.8
    assert [c.fold_size for c in model.candidates] == [[80, 80]] * 3
    report = L.candidate_report(spark, model.candidates).collect()
    assert [r.place for r in report] == [1, 2, 3] and report[0].mean_accuracy >= report[-1].mean_accuracy
    assert L.feature_importance(spark, model).first().feature == "win_rate_diff"
    assert model.metrics["calibrated_brier"] < 0.25
    fixtures = data.withColumns({"team_a": F.lit("A"), "team_b": F.lit("B")})
    fixtures = fixtures.withColumn("rest_days_diff", F.when(F.col("fixture_id") != 0, F.col("rest_days_diff")))
    got = {r.fixture_id: r for r in L.score(fixtures, model).collect()}
    assert got[0].ml_winner is None and got[0].ml_probability_a is None
    assert all(abs(r.ml_probability_a + r.ml_probability_b - 100) < 0.11 for i, r in got.items() if i)
    model.save(str(tmp_path / "m"))
    again = L.score(fixtures, L.load_model(str(tmp_path / "m"))).collect()
    assert {r.fixture_id: r.ml_probability_a for r in again} == {i: r.ml_probability_a for i, r in got.items()}


def test_first_block_option(learned):
    data, model = learned
    assert L.out_of_fold(data, 240, model.best, 2).count() == 160
    whole = L.out_of_fold(data, 240, model.best, 2, first_block_zero=True)
    assert whole.count() == 240 and whole.filter("probability_a = 0").count() == 80


def test_too_little_data(spark, learned):
    with pytest.raises(ValueError):
        L.train(learned[0].limit(10))


def test_scores_compared_winner_first(spark):
    df = spark.createDataFrame([("A", "1-3", "B", "3-1"), ("B", "3-1", "B", "1-3")],
                               "statistical_winner string, statistical_score string, actual_winner string, actual_score string")
    by_text = V.backtest_accuracy(df).first()
    aligned = V.backtest_accuracy(df, text_scores=False).first()
    assert (by_text.correct_score, aligned.correct_score, aligned.correct) == (0, 1, 1)


def test_accuracy_needs_enough_predictions(tables):
    from registry.models import predictions

    assert V.log_accuracy(predictions(tables), 10**6).count() == 0


def test_catalog(spark, tables, tmp_path):
    facts = {"matches": tables.matches, "map_results": tables.map_results,
             "player_match_stats": tables.player_match_stats, "player_map_stats": tables.player_map_stats}
    written = catalog.update_stats(spark, facts, str(tmp_path / "stats"))
    catalog.register(written)
    assert catalog.query(spark, "select count(*) from team_stats").first()[0] == 240
    out = tmp_path / "out"
    for text in ["drop view team_stats", "set a=b", f"insert overwrite directory '{out}' using parquet select 1",
                 f"with t as (select 1 a) insert overwrite directory '{out}' using parquet select * from t",
                 "create table x as select 1", "select 1) t; drop view team_stats; select * from (select 1"]:
        with pytest.raises(ValueError):
            catalog.query(spark, text)
    assert catalog.query(spark, "with t as (select 1 a) select a from t -- all").first()[0] == 1
    assert not out.exists()


def test_methods(tables, scored):
    with pytest.raises(ValueError):
        M.predict_single(scored, "other")
    assert DEFAULTS.decay_horizon == 199
