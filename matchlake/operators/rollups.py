"""Statistics tables: every one is a single grouped aggregate with map-side partials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.scalar import flag, ratio, rounded, signed
from matchlake.operators.perspective import canonical_pair, map_facts, series_card, sides


# sort key of a leaderboard -> column
PLAYER_SORTS = {
    "rating": "avg_rating",
    "kd": "avg_kd",
    "kills": "avg_kills",
    "damage": "avg_damage",
}


def n_rows() -> Column:
    return F.count(F.lit(1))


def map_kd() -> Column:
    """Kills per death; the kills themselves when nobody died."""
    return F.when(F.col("deaths") > 0, F.col("kills").cast("double") / F.col("deaths")).otherwise(
        F.col("kills").cast("double")
    )


def with_map_kd(player_map_stats: DataFrame) -> DataFrame:
    if "kd" in player_map_stats.columns:
        return player_map_stats
    return player_map_stats.withColumn("kd", map_kd())


# ---- teams ------------------------------------------------------------------


def team_record(series_rows: DataFrame) -> DataFrame:
    return series_rows.groupBy("team").agg(
        n_rows().alias("total_matches"),
        F.sum("won").alias("wins"),
        (n_rows() - F.sum("won")).alias("losses"),
        ratio(F.sum("won"), n_rows(), times=100).alias("win_rate"),
        F.sum("maps_won").alias("maps_won"),
        (F.sum("maps_played") - F.sum("maps_won")).alias("maps_lost"),
        ratio(F.sum("maps_won"), F.sum("maps_played"), times=100).alias("map_win_rate"),
    )


def _map_aggs() -> list[Column]:
    return [
        F.sum("won").alias("wins"),
        (n_rows() - F.sum("won")).alias("losses"),
        ratio(F.sum("won"), n_rows(), times=100).alias("win_rate"),
        F.coalesce(F.avg("score_for"), F.lit(0.0)).alias("avg_score_for"),
        F.coalesce(F.avg("score_against"), F.lit(0.0)).alias("avg_score_against"),
    ]


def team_mode(map_rows: DataFrame) -> DataFrame:
    return map_rows.groupBy("team", "mode").agg(*_map_aggs())


def team_map_mode(map_rows: DataFrame) -> DataFrame:
    return map_rows.groupBy("team", "map_name", "mode").agg(
        *_map_aggs(), n_rows().alias("total_played"), F.max("match_date").alias("last_played")
    )


def team_levels(map_rows: DataFrame) -> DataFrame:
    """Team, team x mode and team x map x mode in one pass over the maps."""
    levels = [
        [F.col("team")],
        [F.col("team"), F.col("mode")],
        [F.col("team"), F.col("mode"), F.col("map_name")],
    ]
    return map_rows.groupingSets(levels, "team", "mode", "map_name").agg(
        F.grouping_id("team", "mode", "map_name").cast("int").alias("level"),
        *_map_aggs(),
        n_rows().alias("total_played"),
        F.max("match_date").alias("last_played"),
    )


def mode_rollup(team_map_mode_stats: DataFrame) -> DataFrame:
    """Mode level from the map level; score averages are averages of averages."""
    played = F.sum("wins") + F.sum("losses")
    return team_map_mode_stats.groupBy("team", "mode").agg(
        F.sum("wins").alias("wins"),
        F.sum("losses").alias("losses"),
        ratio(F.sum("wins"), played, empty=0.5).alias("win_rate"),
        F.avg("avg_score_for").alias("avg_score_for"),
        F.avg("avg_score_against").alias("avg_score_against"),
        played.alias("matches"),
    )


def team_card(matches: DataFrame, map_results: DataFrame) -> DataFrame:
    """Matches, wins, rate and the list of modes, one row per team.

    The list is bounded by the number of modes because modes are aggregated first.
    """
    from matchlake.operators.perspective import map_rows, series_rows

    overall = series_rows(matches, map_results).groupBy("team").agg(
        n_rows().alias("matches"),
        F.sum("won").alias("wins"),
        rounded(ratio(F.sum("won"), n_rows(), times=100), 1).alias("win_rate"),
    )
    modes = (
        map_rows(matches, map_results)
        .groupBy("team", "mode")
        .agg(
            n_rows().alias("maps"),
            F.sum("won").alias("wins"),
            rounded(ratio(F.sum("won"), n_rows(), times=100), 1).alias("win_rate"),
        )
        .groupBy("team")
        .agg(
            F.sort_array(F.collect_list(F.struct("mode", "maps", "wins", "win_rate"))).alias("modes")
        )
    )
    return overall.join(modes, "team", "left")


def team_list(matches: DataFrame) -> DataFrame:
    return sides(matches, {"team": ("team_a", "team_b")}, []).select("team").distinct()


def team_map_mode_list(
    stats: DataFrame, team: str | None = None, map_name: str | None = None, mode: str | None = None
) -> DataFrame:
    """Optional filters combined with AND; most played first."""
    for column, value in (("team", team), ("map_name", map_name), ("mode", mode)):
        if value is not None:
            stats = stats.filter(F.col(column) == value)
    return stats.orderBy(F.desc("total_played"), "team", "map_name", "mode")


# ---- pairs ------------------------------------------------------------------


def pair_rows(matches: DataFrame, map_results: DataFrame) -> DataFrame:
    """One row per match under its pair, with the maps won by either side."""
    card = series_card(matches, map_results).withColumn("_a_first", F.col("team_a") < F.col("team_b"))
    maps_1 = F.when(F.col("_a_first"), F.col("maps_a")).otherwise(F.col("maps_b"))
    maps_2 = F.when(F.col("_a_first"), F.col("maps_b")).otherwise(F.col("maps_a"))
    return card.select(
        *canonical_pair(), "winner", "match_date", maps_1.alias("m1"), maps_2.alias("m2")
    )


def pair_record(matches: DataFrame, map_results: DataFrame) -> DataFrame:
    return (
        pair_rows(matches, map_results)
        .groupBy("team_1", "team_2")
        .agg(
            n_rows().alias("meetings"),
            F.sum(flag(F.col("winner") == F.col("team_1"))).alias("team_1_wins"),
            F.sum(flag(F.col("winner") == F.col("team_2"))).alias("team_2_wins"),
            F.sum("m1").alias("team_1_map_wins"),
            F.sum("m2").alias("team_2_map_wins"),
            F.max("match_date").alias("last_match_date"),
        )
    )


def pair_maps(matches: DataFrame, map_results: DataFrame) -> DataFrame:
    return map_facts(matches, map_results).select(
        *canonical_pair(), "mode", "map_name", "map_winner", "match_date"
    )


def _pair_map_aggs() -> list[Column]:
    return [
        n_rows().alias("meetings"),
        F.sum(flag(F.col("map_winner") == F.col("team_1"))).alias("team_1_wins"),
        F.sum(flag(F.col("map_winner") == F.col("team_2"))).alias("team_2_wins"),
        F.max("match_date").alias("last_played"),
    ]


def pair_mode(matches: DataFrame, map_results: DataFrame) -> DataFrame:
    return pair_maps(matches, map_results).groupBy("team_1", "team_2", "mode").agg(
        *_pair_map_aggs()
    )


def pair_map_mode(matches: DataFrame, map_results: DataFrame) -> DataFrame:
    return pair_maps(matches, map_results).groupBy(
        "team_1", "team_2", "map_name", "mode"
    ).agg(*_pair_map_aggs())


def meetings(matches: DataFrame, by_year: bool = False, year: int | None = None) -> DataFrame:
    """Number of meetings per pair, optionally per year or for one year."""
    pairs = matches.select(*canonical_pair(), F.year("match_date").alias("year"))
    if year is not None:
        pairs = pairs.filter(F.col("year") == year)
    keys = ["team_1", "team_2"] + (["year"] if by_year or year is not None else [])
    return pairs.groupBy(*keys).agg(n_rows().alias("meetings"))


# ---- players ----------------------------------------------------------------


def series_totals(player_map_stats: DataFrame, digits: int | None = None) -> DataFrame:
    """Series figures of a player from the maps; ``digits`` rounds k/d and rating."""
    kills, deaths = F.sum("kills"), F.sum("deaths")
    kd = F.when(deaths > 0, kills.cast("double") / deaths).otherwise(kills.cast("double"))
    rating = F.avg("rating")
    if digits is not None:
        kd, rating = rounded(kd, digits), rounded(rating, digits)
    return player_map_stats.groupBy("match_id", "player_name", "team").agg(
        kills.alias("kills"),
        deaths.alias("deaths"),
        kd.alias("kd"),
        signed(kills - deaths).alias("plus_minus"),
        F.sum("damage").alias("damage"),
        rating.alias("rating"),
    )


def _player_aggs(count_name: str) -> list[Column]:
    return [
        n_rows().alias(count_name),
        F.avg("kills").alias("avg_kills"),
        F.avg("deaths").alias("avg_deaths"),
        F.avg("kd").alias("avg_kd"),
        F.avg("damage").alias("avg_damage"),
        F.avg("rating").alias("avg_rating"),
        F.sum("kills").alias("total_kills"),
        F.sum("deaths").alias("total_deaths"),
        F.sum("damage").alias("total_damage"),
    ]


def dated_players(player_match_stats: DataFrame, matches: DataFrame) -> DataFrame:
    if "match_date" in player_match_stats.columns:
        return player_match_stats
    return player_match_stats.join(matches.select("match_id", "match_date"), "match_id", "left")


def player_overall(player_match_stats: DataFrame, matches: DataFrame) -> DataFrame:
    """Career figures; the team is the one of the latest match."""
    return dated_players(player_match_stats, matches).groupBy("player_name").agg(
        F.max_by("team", F.struct("match_date", "match_id")).alias("current_team"),
        *_player_aggs("total_matches"),
    )


def player_mode(player_map_stats: DataFrame) -> DataFrame:
    return with_map_kd(player_map_stats).groupBy("player_name", "mode").agg(
        *_player_aggs("maps_played")
    )


def player_map_mode(player_map_stats: DataFrame) -> DataFrame:
    return with_map_kd(player_map_stats).groupBy("player_name", "map_name", "mode").agg(
        *_player_aggs("maps_played")
    )


def top_players(
    stats: DataFrame,
    sort_by: str = "rating",
    limit: int = 20,
    mode: str | None = None,
    map_name: str | None = None,
    team: str | None = None,
) -> DataFrame:
    """Best players of a statistics table (overall, by mode or by map and mode)."""
    for column, value in (("mode", mode), ("map_name", map_name), ("current_team", team)):
        if value is not None:
            stats = stats.filter(F.col(column) == value)
    return stats.orderBy(F.desc(PLAYER_SORTS[sort_by]), "player_name").limit(limit)


def top_players_per_group(
    stats: DataFrame, groups: list[str], sort_by: str = "rating", limit: int = 5
) -> DataFrame:
    """Best players of every group; the limit is applied before the shuffle as well."""
    order = Window.partitionBy(*groups).orderBy(F.desc(PLAYER_SORTS[sort_by]), "player_name")
    return stats.withColumn("position", F.row_number().over(order)).filter(
        F.col("position") <= limit
    )


# ---- lists ------------------------------------------------------------------


def map_pool(map_results: DataFrame, mode: str | None = None) -> DataFrame:
    """Distinct (mode, map) pairs."""
    pool = map_results.select("mode", "map_name").distinct()
    return pool if mode is None else pool.filter(F.col("mode") == mode)


def recent_matches(matches: DataFrame, limit: int = 20, team: str | None = None) -> DataFrame:
    if team is not None:
        matches = matches.filter((F.col("team_a") == team) | (F.col("team_b") == team))
    return matches.orderBy(F.desc("match_date"), F.desc("match_id")).limit(limit)


def distinct_maps(map_results: DataFrame) -> DataFrame:
    """Exact duplicates of an extracted map removed."""
    return map_results.dropDuplicates(
        ["match_id", "mode", "map_name", "team_a_score", "team_b_score"]
    )


def mean_or_zero(column, digits: int = 2) -> Column:
    """Average that ignores missing values and is 0 for an empty group."""
    return F.coalesce(rounded(F.avg(column), digits), F.lit(0.0))
