"""Roster ratings: a chronological fold per league, and lookups on its output.

Rating updates depend on each other through shared teams, so a league is folded in order.
Leagues are independent and run in parallel. Each match is first reduced to one narrow
row; a partition is sorted by Spark (spilling if need be) and streamed in Arrow batches,
so a hot league costs time in one task but never has to fit in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.functions.scalar import roster_key, roster_of, rounded, score_band
from matchlake.operators.asof import asof_latest, asof_sums
from matchlake.operators.perspective import lineups, roster_from_lineup, sides
from matchlake.operators.scoring import expected_score
from matchlake.params import DEFAULTS, ModelParams

RATED_SCHEMA = (
    "league_id long, match_id long, match_date date, team_a string, team_b string, "
    "key_a string, key_b string, before_a double, before_b double, expected_a double, "
    "after_a double, after_b double, matches_a int, matches_b int, new_a boolean, new_b boolean"
)


class LeagueRatings:
    """Ratings of one league.

    Inheritance is an overlap-weighted mean over the team's rosters. The overlap is a sum
    over players, so per (team, player) only the sum and number of the ratings of rosters
    with that player are kept, and a new roster is priced in as many steps as it has players.
    """

    def __init__(self, p: ModelParams = DEFAULTS, state: dict | None = None):
        self.p = p
        self.board: dict[tuple[str, str], list] = dict(state or {})
        self.sums: dict[tuple[str, str], list[float]] = {}
        for (team, key), (rating, _, _) in self.board.items():
            self._shift(team, key, rating, 1)

    def _shift(self, team: str, key: str, rating: float, count: int) -> None:
        for player in key.split("|"):
            cell = self.sums.setdefault((team, player), [0.0, 0])
            cell[0] += rating
            cell[1] += count

    def rating(self, team: str, key: str, day) -> tuple[float, int, bool]:
        """Current rating, rated matches, and whether the roster was just created."""
        known = self.board.get((team, key))
        if known is not None:
            return known[0], known[1], False
        cells = [self.sums.get((team, player)) for player in key.split("|")]
        weight = sum(c[1] for c in cells if c)
        start = self.p.rating_start
        if weight:
            mean = sum(c[0] for c in cells if c) / weight
            start = mean * self.p.rating_keep + start * (1 - self.p.rating_keep)
        self.board[(team, key)] = [start, 0, day]
        self._shift(team, key, start, 1)
        return start, 0, True

    def play(self, day, team_a, key_a, team_b, key_b, score_a, score_b) -> tuple:
        ra, na, new_a = self.rating(team_a, key_a, day)
        rb, nb, new_b = self.rating(team_b, key_b, day)
        expected = 1 / (1 + 10 ** ((rb - ra) / self.p.rating_scale))
        k = self.p.rating_k * (1.0 if abs(score_a - score_b) <= 1 else self.p.rating_blowout)
        change = k * ((1 if score_a > score_b else 0) - expected)
        for team, key, old, n, delta in (
            (team_a, key_a, ra, na, change),
            (team_b, key_b, rb, nb, -change),
        ):
            self.board[(team, key)] = [old + delta, n + 1, day]
            self._shift(team, key, delta, 0)
        return ra, rb, expected, ra + change, rb - change, na + 1, nb + 1, new_a, new_b


def rating_input(
    matches: DataFrame, player_match_stats: DataFrame, p: ModelParams = DEFAULTS
) -> DataFrame:
    """One narrow row per match that has a complete roster on both sides.

    Ids keep their type, so matches of documents (text ids) come in as they are. Without
    ``league_id`` all matches form one league.
    """
    if "league_id" not in matches.columns:
        matches = matches.withColumn("league_id", F.lit(0))
    rows = matches.join(lineups(player_match_stats), "match_id")
    return (
        rows.withColumn("_ra", roster_from_lineup(F.col("team_a")))
        .withColumn("_rb", roster_from_lineup(F.col("team_b")))
        .filter((F.size("_ra") == p.roster_size) & (F.size("_rb") == p.roster_size))
        .select(
            F.col("league_id").cast("long").alias("league_id"),
            "match_id",
            "match_date",
            "team_a",
            "team_b",
            roster_key("_ra").alias("key_a"),
            roster_key("_rb").alias("key_b"),
            F.col("team_a_score").cast("int").alias("score_a"),
            F.col("team_b_score").cast("int").alias("score_b"),
        )
    )


def fold_batch(pdf: pd.DataFrame, leagues: dict[int, LeagueRatings]) -> pd.DataFrame:
    """Play the rows of one ordered batch; ``leagues`` keeps the state between batches."""
    out = []
    for r in pdf.itertuples(index=False):
        out.append(
            (r.league_id, r.match_id, r.match_date, r.team_a, r.team_b, r.key_a, r.key_b)
            + leagues[r.league_id].play(
                r.match_date, r.team_a, r.key_a, r.team_b, r.key_b, r.score_a, r.score_b
            )
        )
    names = [c.strip().split(" ")[0] for c in RATED_SCHEMA.split(",")]
    frame = pd.DataFrame(out, columns=names)
    order = ["before_a", "before_b", "expected_a", "after_a", "after_b"]
    return frame.astype({c: "float64" for c in order})


def rating_history(
    matches: DataFrame, player_match_stats: DataFrame, p: ModelParams = DEFAULTS
) -> DataFrame:
    """Rating of both rosters before and after every rated match, in (date, id) order."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: dict[int, LeagueRatings] = {}
        for pdf in batches:
            for league in pdf["league_id"].unique():
                if league not in current:
                    # rows are sorted by league: earlier leagues are finished
                    current = {k: v for k, v in current.items() if k in set(pdf["league_id"])}
                    current[league] = LeagueRatings(p)
            yield fold_batch(pdf, current)

    rows = rating_input(matches, player_match_stats, p)
    schema = RATED_SCHEMA.replace("match_id long", f"match_id {dict(rows.dtypes)['match_id']}")
    return (
        rows.repartition("league_id")
        .sortWithinPartitions("league_id", "match_date", "match_id")
        .mapInPandas(fold, schema)
    )


def rating_sides(history: DataFrame) -> DataFrame:
    """One row per (rated match, side)."""
    return sides(
        history,
        {
            "team": ("team_a", "team_b"),
            "roster_key": ("key_a", "key_b"),
            "before": ("before_a", "before_b"),
            "after": ("after_a", "after_b"),
            "matches": ("matches_a", "matches_b"),
            "created": ("new_a", "new_b"),
        },
        ["league_id", "match_id", "match_date"],
    )


def rating_board(history: DataFrame) -> DataFrame:
    """Latest rating of every (team, roster)."""
    order = F.struct("match_date", "match_id")
    return (
        rating_sides(history)
        .groupBy("team", "roster_key")
        .agg(F.max_by(F.struct("after", "matches", "match_date"), order).alias("_l"))
        .select(
            "team",
            "roster_key",
            F.col("_l.after").alias("rating"),
            F.col("_l.matches").alias("matches"),
            F.col("_l.match_date").alias("last_update"),
        )
    )


def leaderboard(board: DataFrame, min_matches: int = 0, limit: int | None = None) -> DataFrame:
    out = board.filter(F.col("matches") >= min_matches).orderBy(
        F.desc("rating"), "team", "roster_key"
    )
    return out if limit is None else out.limit(limit)


def _inherited(total: Column, count: Column, p: ModelParams) -> Column:
    mean = total / count * p.rating_keep + p.rating_start * (1 - p.rating_keep)
    return F.when(count > 0, mean).otherwise(F.lit(p.rating_start))


def ratings_now(
    board: DataFrame, rosters: DataFrame, p: ModelParams = DEFAULTS
) -> DataFrame:
    """Rating of (team, roster) rows; a roster not yet rated inherits from its players."""
    asked = rosters.select("team", "roster_key").distinct()
    per_player = (
        board.select("team", "rating", F.explode(roster_of("roster_key")).alias("player"))
        .groupBy("team", "player")
        .agg(F.sum("rating").alias("s"), F.count(F.lit(1)).alias("c"))
    )
    known = asked.join(board, ["team", "roster_key"], "left")
    fresh = (
        known.filter(F.col("rating").isNull())
        .select("team", "roster_key", F.explode(roster_of("roster_key")).alias("player"))
        .join(per_player, ["team", "player"], "left")
        .groupBy("team", "roster_key")
        .agg(
            _inherited(
                F.coalesce(F.sum("s"), F.lit(0.0)), F.coalesce(F.sum("c"), F.lit(0)), p
            ).alias("_inherited")
        )
    )
    return known.join(fresh, ["team", "roster_key"], "left").select(
        "team",
        "roster_key",
        F.coalesce("rating", "_inherited").alias("rating"),
        F.coalesce("matches", F.lit(0)).alias("matches"),
    )


def ratings_asof(history: DataFrame, probes: DataFrame, p: ModelParams = DEFAULTS) -> DataFrame:
    """Rating of (team, roster) before a day.

    The inheritance of rosters not rated by then uses running sums of rating changes per
    (team, player), so no roster is ever compared with another.
    """
    keys = ["team", "roster_key", "as_of_date"]
    rows = rating_sides(history).withColumnRenamed("match_date", "as_of_date")
    asked = probes.select(*keys).distinct()
    known = asof_latest(
        rows.withColumnRenamed("after", "rating"),
        asked,
        ["team", "roster_key"],
        "as_of_date",
        ["match_id"],
        ["rating", "matches"],
    )
    created = F.col("created")
    changes = rows.select(
        "team",
        "as_of_date",
        F.explode(roster_of("roster_key")).alias("player"),
        F.when(created, F.col("after")).otherwise(F.col("after") - F.col("before")).alias("delta"),
        created.cast("int").alias("born"),
    )
    fresh = known.filter(F.col("rating").isNull()).select(
        *keys, F.explode(roster_of("roster_key")).alias("player")
    )
    sums = asof_sums(
        changes,
        fresh,
        ["team", "player"],
        "as_of_date",
        {"s": (F.col("delta"), 1), "c": (F.col("born"), 1)},
        carry=["roster_key"],
    )
    inherited = sums.groupBy(*keys).agg(_inherited(F.sum("s"), F.sum("c"), p).alias("_inherited"))
    return known.join(inherited, keys, "left").select(
        *keys,
        F.coalesce("rating", "_inherited", F.lit(p.rating_start)).alias("rating"),
        F.coalesce("matches", F.lit(0)).alias("matches"),
    )


def attach_ratings(df: DataFrame, ratings: DataFrame) -> DataFrame:
    """``rating_a`` / ``rating_b`` by (team, roster) and, if present, day."""
    day = ["as_of_date"] if "as_of_date" in ratings.columns else []
    for side in ("a", "b"):
        df = df.join(
            ratings.select(
                F.col("team").alias(f"team_{side}"),
                F.col("roster_key").alias(f"{side}_roster_key"),
                *day,
                F.col("rating").alias(f"rating_{side}"),
                F.col("matches").alias(f"rated_matches_{side}"),
            ),
            [f"team_{side}", f"{side}_roster_key", *day],
            "left",
        )
    return df


def with_rating_prediction(df: DataFrame, p: ModelParams = DEFAULTS) -> DataFrame:
    """Rating model columns (``elo_*``); null where a side has no rating."""
    prob = F.col("_prob")
    return (
        df.withColumn("_prob", expected_score(F.col("rating_a"), F.col("rating_b"), p))
        .withColumns(
            {
                "elo_probability_a": rounded(prob * 100.0, 1),
                "elo_probability_b": rounded((1.0 - prob) * 100.0, 1),
                "elo_winner": F.when(prob > 0.5, F.col("team_a")).when(
                    prob.isNotNull(), F.col("team_b")
                ),
                "elo_score": F.when(prob.isNotNull(), score_band(prob)),
                "elo_confidence": F.abs(prob * 2.0 - 1.0) * 100.0,
                "rating_difference": F.abs(F.col("rating_a") - F.col("rating_b")),
            }
        )
        .drop("_prob")
    )
