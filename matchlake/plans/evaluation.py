"""Backtests and the accuracy log: comparisons of predicted and actual results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.functions.scalar import flag, ratio, score_part, score_text
from matchlake.operators.asof import running_number
from matchlake.params import DEFAULTS, ModelParams
from matchlake.schemas import MODELS, PREDICTION_KEY


def match_list(matches: DataFrame) -> DataFrame:
    """Matches with score text and their chronological number."""
    listed = matches.select(
        "match_id",
        "match_date",
        "team_a",
        "team_b",
        "winner",
        score_text("team_a_score", "team_b_score").alias("score"),
    )
    return running_number(
        listed, [], F.col("match_date"), ["match_date", "match_id"], "match_number"
    )


def backtest_fixtures(matches: DataFrame, start_match: int = 20) -> DataFrame:
    """Every match after the first ``start_match`` ones as a fixture on its own day."""
    return (
        match_list(matches)
        .filter(F.col("match_number") > start_match)
        .select(
            F.col("match_id").alias("fixture_id"),
            "team_a",
            "team_b",
            F.col("match_date").alias("as_of_date"),
            "match_number",
            F.col("winner").alias("actual_winner"),
            F.col("score").alias("actual_score"),
        )
    )


def _models(df: DataFrame, models=MODELS) -> list[str]:
    return [m for m in models if f"{m}_winner" in df.columns]


def long_form(df: DataFrame, models=MODELS) -> DataFrame:
    """One row per (prediction, model that made one)."""
    entries = [
        F.struct(
            F.lit(m).alias("model"),
            F.col(f"{m}_winner").alias("predicted_winner"),
            F.col(f"{m}_score").alias("predicted_score"),
        )
        for m in _models(df, models)
    ]
    return (
        df.withColumn("_m", F.explode(F.array(*entries)))
        .withColumns({c: F.col(f"_m.{c}") for c in ("model", "predicted_winner", "predicted_score")})
        .drop("_m")
        .filter(F.col("predicted_winner").isNotNull())
    )


def _same_score(side_oriented: bool) -> Column:
    """Equal texts, or equal once both texts are put winner first."""
    if side_oriented:
        return F.col("predicted_score") == F.col("actual_score")

    def winner_first(text):
        a, b = score_part(text, 0), score_part(text, 1)
        return score_text(F.greatest(a, b), F.least(a, b))

    return (winner_first("predicted_score") == winner_first("actual_score")) & (
        F.col("predicted_winner") == F.col("actual_winner")
    )


def _accuracy(long: DataFrame, correct_score: Column) -> DataFrame:
    right = F.col("predicted_winner") == F.col("actual_winner")
    counted = long.withColumns({"_w": flag(right), "_s": flag(correct_score)})
    total = F.count(F.lit(1))
    return counted.groupBy("model").agg(
        total.alias("total"),
        F.sum("_w").alias("correct"),
        F.sum("_s").alias("correct_score"),
        ratio(F.sum("_w"), total, times=100).alias("accuracy"),
        ratio(F.sum("_s"), total, times=100).alias("score_accuracy"),
    )


def backtest_accuracy(compared: DataFrame, text_scores: bool = True) -> DataFrame:
    """Accuracy per model; the exact score counts independently of the winner.

    ``text_scores=False`` compares scores winner first, so that models which write the
    score by side and models which write it winner first are measured alike.
    """
    return _accuracy(long_form(compared), _same_score(text_scores))


def log_accuracy(log: DataFrame, min_predictions: int = 1, p: ModelParams = DEFAULTS) -> DataFrame:
    """Accuracy per model of the logged predictions; the score counts only for right winners.

    Empty when there are fewer than ``min_predictions`` scored predictions.
    """
    scored = log.filter(F.col("actual_winner").isNotNull())
    right = F.col("predicted_winner") == F.col("actual_winner")
    table = _accuracy(long_form(scored), right & _same_score(True))
    sure = F.col("ensemble_winner").isNotNull() & (F.col("ensemble_confidence") > p.high_confidence)
    high = scored.filter(sure).agg(
        F.lit("ensemble").alias("model"),
        F.count(F.lit(1)).alias("high_conf_total"),
        F.sum(flag(F.col("ensemble_winner") == F.col("actual_winner"))).alias("high_conf_correct"),
    )
    enough = scored.agg(F.count(F.lit(1))).scalar() >= min_predictions
    return (
        table.join(high, "model", "left")
        .withColumn(
            "high_conf_accuracy",
            F.when(
                F.col("high_conf_total") > 0,
                F.col("high_conf_correct") / F.col("high_conf_total") * 100.0,
            ),
        )
        .filter(enough)
    )


def confidence_buckets(compared: DataFrame) -> DataFrame:
    """Ensemble accuracy by confidence: below 20, below 40, from 40."""
    c = F.col("ensemble_confidence")
    bucket = F.when(c < 20, "low").when(c < 40, "medium").otherwise("high")
    rows = compared.filter(F.col("ensemble_winner").isNotNull() & c.isNotNull())
    right = flag(F.col("ensemble_winner") == F.col("actual_winner"))
    return rows.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(right).alias("correct"),
        ratio(F.sum(right), F.count(F.lit(1)), times=100).alias("accuracy"),
    )


def all_wrong(compared: DataFrame, limit: int | None = 10) -> DataFrame:
    """Predictions in which no available model named the winner, in order of play."""
    right = [
        F.coalesce(F.col(f"{m}_winner") == F.col("actual_winner"), F.lit(False))
        for m in _models(compared)
    ]
    hit = right[0]
    for more in right[1:]:
        hit = hit | more
    rows = compared.filter(~hit)
    if limit is None:
        return rows
    order = [c for c in ("match_number", "match_date", "fixture_id") if c in rows.columns]
    return rows.orderBy(*order).limit(limit)


def accuracy_summary(accuracy: DataFrame) -> DataFrame:
    """Mean accuracy over the models and the best of them (first by name on a tie)."""
    return accuracy.agg(
        F.avg("accuracy").alias("mean_accuracy"),
        F.min_by("model", F.struct(-F.col("accuracy"), F.col("model"))).alias("best_model"),
    )


def pending(log: DataFrame) -> DataFrame:
    return (
        log.filter(F.col("actual_winner").isNull())
        .select(
            *PREDICTION_KEY,
            F.col("ensemble_winner").alias("predicted_winner"),
            F.col("ensemble_score").alias("predicted_score"),
            F.col("ensemble_probability").alias("probability"),
            F.col("ensemble_confidence").alias("confidence"),
        )
        .orderBy(*PREDICTION_KEY)
    )


def recent_scored(log: DataFrame, limit: int = 10) -> DataFrame:
    return (
        log.filter(F.col("actual_winner").isNotNull())
        .orderBy(F.desc("result_timestamp"), *PREDICTION_KEY)
        .select(
            *PREDICTION_KEY,
            F.col("ensemble_winner").alias("predicted_winner"),
            F.col("ensemble_score").alias("predicted_score"),
            F.col("ensemble_probability").alias("probability"),
            "actual_winner",
            "actual_score",
            (F.col("ensemble_winner") == F.col("actual_winner")).alias("correct"),
        )
        .limit(limit)
    )


def score_snapshot(snapshot: DataFrame, matches: DataFrame) -> DataFrame:
    """Stored predictions (match_id, predicted_winner) against what was played later."""
    actual = matches.select(
        "match_id",
        F.col("winner").alias("actual_winner"),
        score_text("team_a_score", "team_b_score").alias("actual_score"),
    )
    return snapshot.join(actual, "match_id", "left").withColumns(
        {
            "found": F.col("actual_winner").isNotNull(),
            "correct": F.col("predicted_winner") == F.col("actual_winner"),
        }
    )


def prediction_log(compared: DataFrame, made_at: Column, notes: str | None = None) -> DataFrame:
    """Compared fixtures in the layout of the prediction log."""
    probability = {"statistical": "statistical_probability", "elo": "elo_probability_a",
                   "ml": "ml_probability_a", "ensemble": "ensemble_probability"}
    columns = [F.col("as_of_date").alias("match_date"), F.col("team_a"), F.col("team_b")]
    for m in MODELS:
        columns += [
            F.col(f"{m}_winner"),
            F.col(f"{m}_score"),
            F.col(probability[m]).alias(f"{m}_probability"),
        ]
    return compared.select(
        *columns,
        "ensemble_confidence",
        F.lit(None).cast("string").alias("actual_winner"),
        F.lit(None).cast("string").alias("actual_score"),
        made_at.alias("prediction_timestamp"),
        F.lit(None).cast("timestamp").alias("result_timestamp"),
        F.lit(notes).cast("string").alias("notes"),
    )
