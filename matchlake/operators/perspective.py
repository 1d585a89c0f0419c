"""Facts seen from one side: the building blocks every roll-up starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.functions.scalar import flag, margin_weight, roster_key
from matchlake.params import DEFAULTS, TEAM_LOGOS, TEAM_SHORT_NAMES, ModelParams


def winner(a="team_a", b="team_b", score_a="team_a_score", score_b="team_b_score", tie="team_b"):
    """Name of the winner. A level score goes to team_b, or to nobody with ``tie='null'``."""
    a, b, sa, sb = (F.col(c) if isinstance(c, str) else c for c in (a, b, score_a, score_b))
    if tie == "null":
        return F.when(sa > sb, a).when(sb > sa, b)
    return F.when(sa > sb, a).otherwise(b)


def sides(df: DataFrame, pairs: dict[str, tuple], keep: list[str]) -> DataFrame:
    """One row per side: every pair (value for a, value for b) becomes one column.

    An explode of two structs: no self-union, so the input is read and shuffled once.
    """

    def side(i: int, label: str) -> Column:
        fields = [F.lit(label).alias("side")]
        for name, pair in pairs.items():
            value = pair[i]
            fields.append((F.col(value) if isinstance(value, str) else value).alias(name))
        return F.struct(*fields)

    both = F.explode(F.array(side(0, "a"), side(1, "b"))).alias("_s")
    return df.select(*keep, both).select(*keep, "_s.*")


def with_map_winner(map_facts: DataFrame) -> DataFrame:
    return map_facts.withColumn("map_winner", winner())


def map_facts(matches: DataFrame, map_results: DataFrame) -> DataFrame:
    """Maps with the context of their match (inner join on match_id), or as they are where they carry it."""
    if "series_winner" in map_results.columns:
        return with_map_winner(map_results.select(
            "match_id", "team_a", "team_b", "match_date", "series_winner", "map_number", "mode", "map_name",
            "team_a_score", "team_b_score",
        ))
    context = matches.select(
        "match_id", "team_a", "team_b", "match_date", F.col("winner").alias("series_winner")
    )
    maps = map_results.select(
        "match_id", "map_number", "mode", "map_name", "team_a_score", "team_b_score"
    )
    return with_map_winner(context.join(maps, "match_id"))


def map_rows(matches: DataFrame, map_results: DataFrame) -> DataFrame:
    """One row per (map, side)."""
    a_won = F.col("team_a_score") > F.col("team_b_score")
    return sides(
        map_facts(matches, map_results),
        {
            "team": ("team_a", "team_b"),
            "opponent": ("team_b", "team_a"),
            "score_for": ("team_a_score", "team_b_score"),
            "score_against": ("team_b_score", "team_a_score"),
            "won": (flag(a_won), 1 - flag(a_won)),
        },
        ["match_id", "map_number", "mode", "map_name", "match_date"],
    )


def series_card(matches: DataFrame, map_results: DataFrame) -> DataFrame:
    """Matches with the number of maps played and won by either side.

    A left join: a match without maps is still a match. Matches that carry these numbers need none.
    """
    if "maps_played" not in matches.columns:
        a_won = F.col("team_a_score") > F.col("team_b_score")
        b_won = F.col("team_b_score") > F.col("team_a_score")
        per_match = map_results.groupBy("match_id").agg(
            F.count(F.lit(1)).alias("maps_played"),
            F.sum(flag(a_won)).alias("maps_a"),
            F.sum(flag(b_won)).alias("strict_b"),
        )
        matches = matches.join(per_match, "match_id", "left")
    zero = F.lit(0).cast("long")
    return matches.withColumns(
        {
            "maps_played": F.coalesce("maps_played", zero),
            "maps_a": F.coalesce("maps_a", zero),
            "maps_b": F.coalesce(F.col("maps_played") - F.col("maps_a"), zero),
            "strict_b": F.coalesce("strict_b", zero),
        }
    )


def series_score(map_results: DataFrame) -> DataFrame:
    """Series score from the maps; only strict wins count."""
    a, b = F.col("team_a_score"), F.col("team_b_score")
    return map_results.groupBy("match_id").agg(
        F.sum(flag(a > b)).alias("maps_a"),
        F.sum(flag(b > a)).alias("maps_b"),
        F.sum(flag(a == b)).alias("maps_level"),
    )


def series_rows(matches: DataFrame, map_results: DataFrame) -> DataFrame:
    """One row per (match, side) with series and map results."""
    a_won = F.col("winner") == F.col("team_a")
    b_won = F.col("winner") == F.col("team_b")
    keep = ["match_id", "match_date"] + [c for c in ("league_id",) if c in matches.columns]
    return sides(
        series_card(matches, map_results),
        {
            "team": ("team_a", "team_b"),
            "opponent": ("team_b", "team_a"),
            "score_for": ("team_a_score", "team_b_score"),
            "score_against": ("team_b_score", "team_a_score"),
            "won": (flag(a_won), flag(b_won)),
            "maps_played": ("maps_played", "maps_played"),
            "maps_won": ("maps_a", "maps_b"),
        },
        keep,
    )


def mode_list(p: ModelParams = DEFAULTS) -> list[str]:
    """Distinct modes of the scored series, in order; mode i owns the columns ``m<i>_*``."""
    return list(dict.fromkeys(p.series_modes))


def form_rows(
    matches: DataFrame, map_results: DataFrame, p: ModelParams = DEFAULTS
) -> DataFrame:
    """Series rows that also carry the sums of every scored mode (``m<i>_*``).

    Maps are reduced to one row per match before anything else, so every later step works
    on series instead of maps. Per mode: n maps, weight by margin, weight of the wins,
    sum of score differences.
    """
    a, b = F.col("team_a_score"), F.col("team_b_score")
    weight = margin_weight(a - b, p)
    aggs = [
        F.count(F.lit(1)).alias("maps_played"),
        F.sum(flag(a > b)).alias("maps_a"),
    ]
    for i, mode in enumerate(mode_list(p)):
        here = F.col("mode") == mode
        aggs += [
            F.sum(flag(here)).alias(f"m{i}_n"),
            F.sum(F.when(here, weight).otherwise(0.0)).alias(f"m{i}_w"),
            F.sum(F.when(here & (a > b), weight).otherwise(0.0)).alias(f"m{i}_wa"),
            F.sum(F.when(here, a - b).otherwise(0)).alias(f"m{i}_diff"),
        ]
    per_match = map_results.groupBy("match_id").agg(*aggs)
    names = [c for c in per_match.columns if c != "match_id"]
    card = matches.join(per_match, "match_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in names}
    )
    a_won = F.col("winner") == F.col("team_a")
    b_won = F.col("winner") == F.col("team_b")
    pairs = {
        "team": ("team_a", "team_b"),
        "opponent": ("team_b", "team_a"),
        "won": (flag(a_won), flag(b_won)),
        "maps_played": ("maps_played", "maps_played"),
        "maps_won": (F.col("maps_a"), F.col("maps_played") - F.col("maps_a")),
    }
    for i, _ in enumerate(mode_list(p)):
        w, wa, diff = F.col(f"m{i}_w"), F.col(f"m{i}_wa"), F.col(f"m{i}_diff")
        pairs[f"m{i}_n"] = (f"m{i}_n", f"m{i}_n")
        pairs[f"m{i}_w"] = (w, w)
        pairs[f"m{i}_won"] = (wa, w - wa)
        pairs[f"m{i}_diff"] = (diff, -diff)
    keep = ["match_id", "match_date"] + [c for c in ("league_id",) if c in matches.columns]
    return sides(card, pairs, keep)


def form_history(
    matches: DataFrame,
    map_results: DataFrame,
    player_match_stats: DataFrame,
    p: ModelParams = DEFAULTS,
) -> DataFrame:
    """Form rows with rosters: the input of every roster-weighted scoring step."""
    return with_rosters(form_rows(matches, map_results, p), player_match_stats)


def canonical_pair(a="team_a", b="team_b") -> list[Column]:
    """The two names in alphabetical order."""
    return [F.least(a, b).alias("team_1"), F.greatest(a, b).alias("team_2")]


def lineups(player_match_stats: DataFrame) -> DataFrame:
    """Per match one sorted array of (team, player).

    Keyed by match_id alone, so that it joins to matches and maps on the partitioning
    those already have.
    """
    return player_match_stats.groupBy("match_id").agg(
        F.sort_array(F.collect_set(F.struct("team", "player_name"))).alias("lineup")
    )


def roster_from_lineup(team: Column, lineup="lineup") -> Column:
    """Sorted players of one team; an empty array when the match has none for it."""
    mine = F.filter(F.col(lineup), lambda x: x["team"] == team)
    return F.coalesce(
        F.transform(mine, lambda x: x["player_name"]), F.array().cast("array<string>")
    )


def with_rosters(rows: DataFrame, player_match_stats: DataFrame) -> DataFrame:
    """Adds ``roster``, ``roster_key`` and ``opponent_key`` to (match, side) or (map, side) rows."""
    return (
        rows.join(lineups(player_match_stats), "match_id", "left")
        .withColumn("roster", roster_from_lineup(F.col("team")))
        .withColumn("roster_key", roster_key("roster"))
        .withColumn("opponent_key", roster_key(roster_from_lineup(F.col("opponent"))))
        .drop("lineup")
    )


def rosters(player_match_stats: DataFrame) -> DataFrame:
    """One row per (match, team) with its sorted players."""
    return (
        player_match_stats.groupBy("match_id", "team")
        .agg(F.sort_array(F.collect_set("player_name")).alias("roster"))
        .withColumn("roster_key", roster_key("roster"))
    )


def history(matches: DataFrame, map_results: DataFrame, player_match_stats: DataFrame) -> DataFrame:
    """Series rows with rosters: the input of every roster-weighted operator."""
    return with_rosters(series_rows(matches, map_results), player_match_stats)


def map_history(matches: DataFrame, map_results: DataFrame, player_match_stats: DataFrame):
    return with_rosters(map_rows(matches, map_results), player_match_stats)


def nested_cards(nested: DataFrame) -> DataFrame:
    """Matches with the roster keys of both sides and their maps as (mode, map_name, won by a), from rows that hold both."""
    won = F.transform("maps", lambda m: F.struct(
        m["mode"].alias("mode"), m["map_name"].alias("map_name"), flag(m["team_a_score"] > m["team_b_score"]).alias("won"),
    ))
    return nested.select(
        "match_id", "match_date", "team_a", "team_b",
        *[roster_key(roster_from_lineup(F.col(f"team_{s}"))).alias(f"{s}_roster_key") for s in ("a", "b")], won.alias("maps"),
    )


def card_sides(cards: DataFrame) -> DataFrame:
    """(match, side) rows of cards with their roster keys."""
    keys = {"team": ("team_a", "team_b"), "roster_key": ("a_roster_key", "b_roster_key")}
    return sides(cards, keys, ["match_id", "match_date"])


def card_history(cards: DataFrame) -> DataFrame:
    """(map, side) rows of cards, without scores: what ``map_history`` holds of plays and wins."""
    maps = cards.select("match_date", "team_a", "team_b", "a_roster_key", "b_roster_key", F.inline("maps"))
    return sides(
        maps,
        {
            "team": ("team_a", "team_b"), "roster_key": ("a_roster_key", "b_roster_key"),
            "won": (F.col("won"), 1 - F.col("won")),
        },
        ["match_date", "mode", "map_name"],
    )


def results_list(matches: DataFrame, team: str | None = None) -> DataFrame:
    """Team history with WIN/LOSS and opponent, newest first."""
    a_won = F.col("winner") == F.col("team_a")
    rows = sides(
        matches,
        {
            "team": ("team_a", "team_b"),
            "opponent": ("team_b", "team_a"),
            "result": (
                F.when(a_won, "WIN").otherwise("LOSS"),
                F.when(F.col("winner") == F.col("team_b"), "WIN").otherwise("LOSS"),
            ),
        },
        ["match_id", "match_date"],
    )
    if team is not None:
        rows = rows.filter(F.col("team") == team)
    return rows.orderBy("team", F.desc("match_date"), F.desc("match_id"))


def map_log(
    matches: DataFrame, map_results: DataFrame, map_name: str, team: str | None = None
) -> DataFrame:
    """All plays of one map with their match context, newest first."""
    facts = map_facts(matches, map_results).filter(F.col("map_name") == map_name)
    if team is not None:
        facts = facts.filter((F.col("team_a") == team) | (F.col("team_b") == team))
    return facts.orderBy(F.desc("match_date"), F.desc("match_id"), "map_number")


def alias_table(spark, names: dict[str, str] | None = None) -> DataFrame:
    names = TEAM_SHORT_NAMES if names is None else names
    return spark.createDataFrame(sorted(names.items()), "team string, short_name string")


def logo_table(spark) -> DataFrame:
    return spark.createDataFrame(sorted(TEAM_LOGOS.items()), "logo string, team string")


def plain_name(team) -> Column:
    """The name with everything but letters and digits removed."""
    return F.regexp_replace(team, r"[^\p{L}\p{N}]", "")


def with_short_name(
    df: DataFrame, aliases: DataFrame, team: str = "team", out: str = "short_name"
) -> DataFrame:
    """Short name by lookup, otherwise the plain name. The optimiser sizes the alias side."""
    table = aliases.select(F.col("team").alias("_t"), F.col("short_name").alias("_s"))
    return (
        df.join(table, F.col(team) == F.col("_t"), "left")
        .withColumn(out, F.coalesce("_s", plain_name(F.col(team))))
        .drop("_t", "_s")
    )
