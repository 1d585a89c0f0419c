"""Guards and data-quality findings, as rows rather than log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.functions.dates import date_repair_reason
from matchlake.operators.perspective import lineups
from matchlake.params import DEFAULTS, ModelParams


def roster_sizes(matches: DataFrame, player_match_stats: DataFrame) -> DataFrame:
    """Number of distinct players per side of every match."""
    rows = matches.join(lineups(player_match_stats), "match_id", "left")

    def size(team):
        return F.coalesce(
            F.size(F.filter("lineup", lambda x: x["team"] == F.col(team))), F.lit(0)
        )

    return rows.withColumns({"players_a": size("team_a"), "players_b": size("team_b")}).drop(
        "lineup"
    )


def split_complete(
    matches: DataFrame,
    player_match_stats: DataFrame,
    exact: bool = False,
    p: ModelParams = DEFAULTS,
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) matches: at least, or exactly, a full roster on both sides."""
    sized = roster_sizes(matches, player_match_stats)
    n = p.roster_size
    if exact:
        ok = (F.col("players_a") == n) & (F.col("players_b") == n)
    else:
        ok = (F.col("players_a") >= n) & (F.col("players_b") >= n)
    rejected = sized.filter(~ok).withColumn(
        "reason",
        F.concat(
            F.lit("incomplete rosters: "), F.col("players_a"), F.lit(" vs "), F.col("players_b")
        ),
    )
    return sized.filter(ok), rejected


def _finding(df: DataFrame, rule: str, detail) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"), F.col("match_id").cast("string").alias("key"), detail.alias("detail")
    )


def level_maps(map_results: DataFrame) -> DataFrame:
    rows = map_results.filter(F.col("team_a_score") == F.col("team_b_score"))
    return _finding(
        rows,
        "level_map",
        F.concat_ws(" ", F.col("map_number"), F.col("mode"), F.col("team_a_score")),
    )


def duplicate_ids(documents: DataFrame, key: str = "match_id") -> DataFrame:
    twice = documents.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return _finding(
        twice.withColumnRenamed(key, "match_id") if key != "match_id" else twice,
        "duplicate_id",
        F.concat(F.col("n"), F.lit(" copies")),
    )


def swapped_dates(matches_raw: DataFrame, column: str = "date") -> DataFrame:
    rows = matches_raw.withColumn("_r", date_repair_reason(column)).filter(F.col("_r") != "kept")
    return _finding(rows, "date", F.concat_ws(" ", F.col("_r"), F.col(column)))


def unresolved_sides(player_map_stats: DataFrame) -> DataFrame:
    """Per-map player rows whose side is neither team_a nor team_b."""
    rows = player_map_stats.filter(F.col("team").isNull())
    return _finding(rows, "side", F.concat_ws(" ", F.col("map_number"), F.col("player_name")))


def misaligned_maps(map_results: DataFrame, player_map_stats: DataFrame, limit: int = 100):
    """Maps whose mode does not fit the kills recorded at their position.

    Round-based modes never reach ``limit`` kills over both sides; respawn modes do.
    """
    kills = player_map_stats.groupBy("match_id", "map_number").agg(F.sum("kills").alias("kills"))
    rows = map_results.select("match_id", "map_number", "mode").join(
        kills, ["match_id", "map_number"]
    )
    rounds = F.col("mode") == "Search & Destroy"
    odd = rows.filter((rounds & (F.col("kills") > limit)) | (~rounds & (F.col("kills") <= limit)))
    return _finding(
        odd, "position", F.concat_ws(" ", F.col("map_number"), F.col("mode"), F.col("kills"))
    )


def winner_mismatch(matches: DataFrame, map_results: DataFrame) -> DataFrame:
    """Matches whose stored score is not the number of maps won."""
    from matchlake.operators.perspective import series_score

    rows = matches.join(series_score(map_results), "match_id").filter(
        (F.col("team_a_score") != F.col("maps_a")) | (F.col("team_b_score") != F.col("maps_b"))
    )
    return _finding(rows, "series_score", F.concat_ws("-", F.col("maps_a"), F.col("maps_b")))


def dq_report(
    matches: DataFrame,
    map_results: DataFrame,
    player_map_stats: DataFrame,
    documents: DataFrame | None = None,
) -> DataFrame:
    """All findings as (rule, key, detail)."""
    findings = [
        level_maps(map_results),
        unresolved_sides(player_map_stats),
        misaligned_maps(map_results, player_map_stats),
        winner_mismatch(matches, map_results),
    ]
    if documents is not None:
        findings += [
            duplicate_ids(documents.select(F.col("match_info.match_id").alias("match_id"))),
            swapped_dates(documents.select("match_info.match_id", "match_info.date")),
        ]
    report = findings[0]
    for more in findings[1:]:
        report = report.unionByName(more)
    return report


SIDES = ("team_a", "team_b")
FOUND = "array<struct<rule:string,detail:string>>"


def document_findings(documents: DataFrame, limit: int = 100) -> DataFrame:
    """(rule, key, detail) of every document by itself, in one pass over the documents.

    The rules are those of ``dq_report`` over the lists of a document: level maps, dates, sides,
    positions and the series score; one more row of rule ``copy`` stands for the document itself.
    Missing lists have no findings; a document without a date has an invalid one.
    """
    info = F.col("match_info")
    rows = F.col("player_stats")["per_map"]

    def found(rule, *detail, sep=" "):
        return F.struct(F.lit(rule).alias("rule"), F.concat_ws(sep, *detail).alias("detail"))

    def of_map(rule):
        every = F.filter(F.transform("map_results", rule), lambda x: x.isNotNull())
        return F.coalesce(every, F.array().cast(FOUND))

    def level(m, i):
        a = m["team_a_score"]
        return F.when(a == m["team_b_score"], found("level_map", i + 1, m["mode"], a))

    def position(m, i):
        kills = F.aggregate(
            F.filter(rows, lambda r: r["map_number"] == i + 1),
            F.lit(None).cast("long"),
            lambda acc, r: F.coalesce(acc + r["kills"], r["kills"].cast("long"), acc),
        )
        rounds = m["mode"] == "Search & Destroy"
        odd = (rounds & (kills > limit)) | (~rounds & (kills <= limit))
        return F.when(odd, found("position", i + 1, m["mode"], kills))

    def wins(first, second):
        return F.size(F.filter("map_results", lambda m: m[first] > m[second]))

    unresolved = F.transform(
        F.filter(rows, lambda r: ~F.coalesce(r["team"].isin(*SIDES), F.lit(False))),
        lambda r: found("side", r["map_number"], r["player_name"]),
    )
    a, b = wins("team_a_score", "team_b_score"), wins("team_b_score", "team_a_score")
    differs = (info["team_a_score"] != a) | (info["team_b_score"] != b)
    reason = date_repair_reason(info["date"])
    none = F.array().cast(FOUND)
    every = F.concat(
        of_map(level),
        of_map(position),
        F.coalesce(unresolved, none),
        F.when(differs, F.array(found("series_score", a, b, sep="-"))).otherwise(none),
        F.when(reason != "kept", F.array(found("date", reason, info["date"]))).otherwise(none),
        F.array(found("copy")),
    )
    return documents.select(info["match_id"].alias("key"), F.explode(every).alias("f")).select(
        "f.rule", "key", "f.detail"
    )


def document_report(documents: DataFrame) -> DataFrame:
    """All six rules on documents as (rule, key, detail, n): one scan and one grouped pass.

    Equal findings of several copies are one row with their number; the copies themselves are
    counted in the same pass, and an id with more than one is a finding. A document without an id
    is no copy of another.
    """
    counted = document_findings(documents).groupBy("rule", "key", "detail").agg(
        F.count(F.lit(1)).alias("n")
    )
    copy = F.col("rule") == "copy"
    return counted.filter(~copy | ((F.col("n") > 1) & F.col("key").isNotNull())).select(
        F.when(copy, "duplicate_id").otherwise(F.col("rule")).alias("rule"),
        "key",
        F.when(copy, F.concat("n", F.lit(" copies"))).otherwise(F.col("detail")).alias("detail"),
        "n",
    )
