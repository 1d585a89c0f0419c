"""Scoring of whole fixture tables: statistical model, ratings, ensemble, explanations.

Fixtures: (fixture_id, team_a, team_b[, as_of_date]). The *current* view scores every
fixture from one day with each team's latest roster. The *point-in-time* view needs
``as_of_date`` per fixture and uses earlier matches only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.functions.scalar import confidence_image, confidence_text, form_mark, margin_note
from matchlake.functions.scalar import rounded
from matchlake.operators.asof import asof_latest
from matchlake.operators import history as H
from matchlake.operators import map_pool as MP
from matchlake.operators import perspective as P
from matchlake.operators import ratings as E
from matchlake.operators import rollups as R
from matchlake.operators import scoring as S
from matchlake.params import DEFAULTS, ModelParams
from matchlake.sources.store import staged

STATISTICAL = ["statistical_winner", "statistical_score", "statistical_probability"]


def _statistical(df: DataFrame, p: ModelParams) -> DataFrame:
    """Probability, mode walk and agreement; fixtures without a roster get a reason."""
    missing = F.col("a_roster").isNull() | F.col("b_roster").isNull() | (
        F.size("a_roster") == 0
    ) | (F.size("b_roster") == 0)
    df = df.withColumn("reason", F.when(missing, F.lit("no roster for one or both teams")))
    df = S.with_win_probability(df, p)
    df = S.with_series_walk(S.with_mode_probabilities(df, p), p)
    blank = ["team_a_probability", "team_b_probability", "confidence", "predicted_winner",
             "predicted_score", "map_predictions"]
    return df.withColumns({c: F.when(F.col("reason").isNull(), F.col(c)) for c in blank})


def score_current(
    fixtures: DataFrame,
    matches: DataFrame,
    map_results: DataFrame,
    player_match_stats: DataFrame,
    as_of: Column | None = None,
    p: ModelParams = DEFAULTS,
    map_pool: bool = True,
    form_history: DataFrame | None = None,
) -> DataFrame:
    """Full statistical prediction of every fixture seen from one day.

    ``form_history`` can be handed in when it is already at hand as a table. Form is one
    row per team and is read for both sides, so it is staged.
    """
    if form_history is None:
        form_history = staged(P.form_history(matches, map_results, player_match_stats, p))
    as_of = H.latest_date(form_history) if as_of is None else as_of
    players = R.player_overall(player_match_stats, matches)
    form = staged(H.current_form(form_history, players, as_of, p))
    pairs = H.pair_form(H.pair_events(matches, map_results, p), p)
    df = S.attach_form(H.head_to_head(fixtures, pairs), form)
    df = _statistical(df, p)
    if map_pool:
        maps = P.map_history(matches, map_results, player_match_stats)
        pool = S.pool_rows(map_results, p)
        best = H.map_performance(maps, H.current_rosters(form_history), p)
        df = S.with_map_pool(df, staged(S.team_plays(best, pool)), pool, p)
    return df


def with_rosters_asof(
    fixtures: DataFrame, form_history: DataFrame, match_rosters: bool = False
) -> DataFrame:
    """Roster keys per side: of the latest earlier match, or of the fixture's own match."""
    if match_rosters:
        rosters = form_history.select(
            F.col("match_id").alias("fixture_id"), "side", "roster_key"
        ).groupBy("fixture_id").agg(
            F.max(F.when(F.col("side") == "a", F.col("roster_key"))).alias("a_roster_key"),
            F.max(F.when(F.col("side") == "b", F.col("roster_key"))).alias("b_roster_key"),
        )
        return fixtures.join(rosters, "fixture_id", "left")
    seats = P.sides(fixtures, {"team": ("team_a", "team_b")}, ["as_of_date"])
    latest = asof_latest(
        form_history.select("team", "match_id", "roster_key", "match_date"),
        seats.select("team", F.col("as_of_date").alias("match_date")), ["team"], "match_date", ["match_id"], ["roster_key"],
    )
    df = fixtures
    for side in ("a", "b"):
        df = df.join(
            latest.select(
                F.col("team").alias(f"team_{side}"),
                F.col("match_date").alias("as_of_date"),
                F.col("roster_key").alias(f"{side}_roster_key"),
            ),
            [f"team_{side}", "as_of_date"],
            "left",
        )
    return df


def fixture_probes(fixtures: DataFrame) -> DataFrame:
    """(team, roster, day) of both sides of fixtures that already have roster keys."""
    return P.sides(
        fixtures,
        {"team": ("team_a", "team_b"), "roster_key": ("a_roster_key", "b_roster_key")},
        ["as_of_date"],
    ).filter(F.col("roster_key").isNotNull() & (F.col("roster_key") != ""))


def score_asof(
    fixtures: DataFrame,
    matches: DataFrame,
    map_results: DataFrame,
    player_match_stats: DataFrame,
    p: ModelParams = DEFAULTS,
    match_rosters: bool = False,
    context: bool = False,
    form_history: DataFrame | None = None,
    map_pool: bool = False,
) -> DataFrame:
    """Leakage-free statistical prediction of every fixture on its own day.

    ``map_pool`` adds the maps each series is likely to be played on, as of that day.
    """
    if form_history is None:
        form_history = staged(P.form_history(matches, map_results, player_match_stats, p))
    fixtures = staged(with_rosters_asof(fixtures, form_history, match_rosters))
    form = staged(
        H.form_asof(
            form_history, player_match_stats, matches, fixture_probes(fixtures), p, context
        )
    )
    pairs = H.pair_form_asof(H.pair_events(matches, map_results, p), fixtures, p)
    df = _statistical(S.attach_form(H.head_to_head(fixtures, pairs), form), p)
    if map_pool:
        df = MP.with_map_pool_asof(df, staged(P.map_history(matches, map_results, player_match_stats)), p)
    return df


def with_statistical_columns(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "statistical_winner": F.col("predicted_winner"),
            "statistical_score": F.col("predicted_score"),
            "statistical_probability": F.col("team_a_probability"),
        }
    )


def with_ensemble(
    df: DataFrame, mode: str = "fallback", p: ModelParams = DEFAULTS
) -> DataFrame:
    """Combine ``statistical_*``, ``elo_*`` and ``ml_*`` columns (a null winner is absent).

    ``fallback`` takes the statistical result and only reports agreement, as the models are
    run today; ``weighted`` is the documented mean with weights renormalised over the
    models present.
    """
    stat, elo, ml = (F.col(f"{m}_winner") for m in ("statistical", "elo", "ml"))
    base = stat
    probabilities = {
        "statistical": (F.col("statistical_probability"), p.weight_statistical),
        "elo": (F.col("elo_probability_a"), p.weight_rating),
        "ml": (F.col("ml_probability_a"), p.weight_learned),
    }
    used = F.concat_ws(
        ",", *[F.when(F.col(f"{m}_winner").isNotNull(), F.lit(m)) for m in probabilities]
    )
    agree = F.coalesce(elo == base, F.lit(True)) & F.coalesce(ml == base, F.lit(True))
    if mode == "fallback":
        prob, winner, score = F.col("statistical_probability"), stat, F.col("statistical_score")
    else:
        weight = total = F.lit(0.0)
        for m, (value, w) in probabilities.items():
            here = F.col(f"{m}_winner").isNotNull()
            total = total + F.when(here, value * w).otherwise(0.0)
            weight = weight + F.when(here, F.lit(w)).otherwise(0.0)
        prob = rounded(F.when(weight > 0, total / weight), 1)
        winner = F.when(prob > 50.0, F.col("team_a")).when(prob.isNotNull(), F.col("team_b"))
        score = F.coalesce(
            F.when(stat == winner, F.col("statistical_score")),
            F.when(elo == winner, F.col("elo_score")),
            F.when(ml == winner, F.col("ml_score")),
        )
    valid = base.isNotNull()
    return df.withColumns(
        {
            "ensemble_probability": F.when(valid, rounded(prob, 1)),
            "ensemble_winner": F.when(valid, winner),
            "ensemble_score": F.when(valid, score),
            "models_used": F.when(valid, used),
            "models_agree": F.when(valid, agree),
        }
    ).withColumn(
        "ensemble_confidence",
        rounded(F.abs(F.col("ensemble_probability") * 2.0 - 100.0), 1),
    )


def compare_models(
    scored: DataFrame, ratings: DataFrame, mode: str = "fallback", p: ModelParams = DEFAULTS
) -> DataFrame:
    """Statistical, rating and (if ``ml_*`` columns are there) learned results side by side."""
    df = with_statistical_columns(scored)
    df = E.with_rating_prediction(E.attach_ratings(df, ratings), p)
    for name, kind in (("ml_winner", "string"), ("ml_score", "string"),
                       ("ml_probability_a", "double")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return with_ensemble(df, mode, p)


def predict_single(compared: DataFrame, method: str = "ensemble") -> DataFrame:
    """One model's winner, score and probability."""
    probability = {
        "statistical": "statistical_probability",
        "elo": "elo_probability_a",
        "ml": "ml_probability_a",
        "ensemble": "ensemble_probability",
    }
    if method not in probability:
        raise ValueError(f"unknown method: {method}")
    return compared.select(
        "fixture_id",
        "team_a",
        "team_b",
        F.col(f"{method}_winner").alias("predicted_winner"),
        F.col(f"{method}_score").alias("predicted_score"),
        F.col(probability[method]).alias("team_a_probability"),
    )


def prediction_summary(scored: DataFrame) -> DataFrame:
    """The small projection that is enough for a caller of the prediction service."""
    return scored.select(
        "fixture_id",
        "team_a",
        "team_b",
        "team_a_probability",
        "team_b_probability",
        "predicted_winner",
        "predicted_score",
        "confidence",
        *[
            F.col(f"{side}_{c}").alias(f"team_{side}_{c}")
            for side in ("a", "b")
            for c in ("win_rate", "map_win_rate", "avg_kd")
        ],
    )


def with_agreement(scored: DataFrame) -> DataFrame:
    """Does the mode walk name the side that the overall comparison favours?"""
    overall = F.when(
        F.col("team_a_probability") > F.col("team_b_probability"), F.col("team_a")
    ).otherwise(F.col("team_b"))
    same = overall == F.col("predicted_winner")
    return scored.withColumns(
        {
            "overall_winner": overall,
            "views_agree": same,
            "agreement": F.when(same, "HIGH").otherwise("MODERATE"),
            "margin_note": margin_note("confidence"),
        }
    )


def with_labels(df: DataFrame, confidence: str = "confidence") -> DataFrame:
    return df.withColumns(
        {
            "confidence_text": confidence_text(confidence),
            "confidence_level": confidence_image(confidence),
            "form_a": form_mark("a_momentum"),
            "form_b": form_mark("b_momentum"),
        }
    )


def explain(compared: DataFrame) -> DataFrame:
    """Reason of the statistical verdict (first rule that holds), rating gap, meetings."""
    a_won = F.col("statistical_winner") == F.col("team_a")

    def lead(metric):
        gap = F.col(f"a_{metric}") - F.col(f"b_{metric}")
        return F.when(a_won, gap).otherwise(-gap)

    prob = F.col("statistical_probability")
    gap = F.col("rating_a") - F.col("rating_b")
    n, a, b = F.col("h_total"), F.col("h_a"), F.col("h_b")
    return compared.withColumns(
        {
            "statistical_reason": F.when(lead("momentum") > 0.3, "momentum")
            .when(lead("win_rate") > 10, "win rate")
            .when(lead("avg_rating") > 0.05, "player quality")
            .when((prob > 45) & (prob < 55), "toss-up")
            .otherwise("mixed"),
            "rating_reason": F.when(F.abs(gap) < 20, "even")
            .when(gap > 50, "team_a clearly higher")
            .when(gap < -50, "team_b clearly higher")
            .when(gap > 0, "team_a slightly higher")
            .otherwise("team_b slightly higher"),
            "meetings_reason": F.when(n == 0, "no meetings")
            .when(a > b * 1.5, "team_a dominates")
            .when(b > a * 1.5, "team_b dominates")
            .otherwise("close"),
        }
    )


def trusted_model(compared: DataFrame, short: bool = False) -> DataFrame:
    """Which model to trust; ``short`` is the two-test variant for disagreeing models."""
    gap = F.coalesce(F.abs(F.col("rating_a") - F.col("rating_b")), F.lit(0.0))
    form = F.coalesce(F.abs(F.col("a_momentum") - F.col("b_momentum")), F.lit(0.0))
    choice = F.when(F.col("h_total") >= 3, "learned").when(gap > 50, "rating")
    if short:
        choice = F.when(F.col("models_agree"), "ensemble").otherwise(
            choice.otherwise("statistical")
        )
    else:
        choice = choice.when(form > 0.5, "statistical").otherwise("ensemble")
    return compared.withColumn("trusted_model", choice)
