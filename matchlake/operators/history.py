"""Form of teams: decayed by time and weighted by how much of the roster is still there.

Two views of the same rules. The *current* view looks at the whole history from one
``as_of`` day. The *point-in-time* view (``*_asof``) looks, for every probe (team, roster,
day), only at earlier days.

The overlap of two rosters is a sum over shared players, so a roster-weighted sum equals
the sum, over the roster's players, of that player's own decayed history. The
point-in-time view uses this: it keeps running sums per (team, player) and never pairs
matches of rosters with each other. Counts of matches go through a dictionary of the rosters of a team,
which is as long as its line-ups and not as its matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.scalar import (
    decay,
    flag,
    margin_weight,
    or_zero,
    overlap,
    ratio,
    roster_of,
    rounded,
)
from matchlake.operators.asof import (
    asof_decayed,
    asof_recent,
    asof_sums,
    bounded_window,
    running_number,
)
from matchlake.operators.perspective import canonical_pair, mode_list, sides
from matchlake.params import DEFAULTS, ModelParams
from matchlake.sources.store import staged


def latest_date(matches: DataFrame) -> Column:
    """Latest match day as a scalar subquery: the default ``as_of``, without an action."""
    return matches.agg(F.max("match_date")).scalar()


# ---- rosters ----------------------------------------------------------------


def known_by(history: DataFrame, as_of: Column | None) -> DataFrame:
    """Rows of matches up to a day; undated ones are always known."""
    if as_of is None:
        return history
    return history.filter(F.col("match_date").isNull() | (F.col("match_date") <= as_of))


def current_rosters(history: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Roster of each team's latest match up to ``as_of``; the later match id decides a tie."""
    row = F.struct("match_id", "match_date", "roster", "roster_key")
    return (
        known_by(history, as_of).groupBy("team")
        .agg(F.max_by(row, F.struct("match_date", "match_id")).alias("_r"))
        .select("team", "_r.*")
    )


def rosters_asof(history: DataFrame, probes: DataFrame) -> DataFrame:
    """Roster of each team's latest match before every probe day."""
    from matchlake.operators.asof import asof_latest

    return asof_latest(
        history, probes, ["team"], "match_date", ["match_id"], ["match_id", "roster", "roster_key"]
    )


def roster_overlaps(history: DataFrame, p: ModelParams = DEFAULTS) -> DataFrame:
    """Overlap of the current roster with every past one of the same team."""
    current = current_rosters(history).select("team", F.col("roster").alias("current"))
    return history.join(current, "team").select(
        "match_id",
        "team",
        "match_date",
        overlap("current", "roster", p.roster_size).alias("overlap"),
    )


def roster_similarity(history: DataFrame, declared: DataFrame) -> DataFrame:
    """Share of the declared roster that played, with the declared size as denominator."""
    named = declared.select("team", F.col("roster").alias("declared"))
    shared = F.size(F.array_intersect("declared", "roster"))
    return history.join(named, "team").select(
        "match_id", "team", ratio(shared, F.size("declared")).alias("similarity")
    )


def roster_quality(current: DataFrame, player_stats: DataFrame) -> DataFrame:
    """Mean of the players' career averages; players without figures are not counted."""
    player = current.select("team", F.explode_outer("roster").alias("player_name"))
    found = player_stats.select(
        "player_name", "avg_kd", "avg_rating", "avg_damage", F.lit(1).alias("_found")
    )
    return player.join(found, "player_name", "left").groupBy("team").agg(
        *_quality_aggs("avg_kd", "avg_rating", "avg_damage")
    )


def _quality_aggs(kd: str, rating: str, damage: str) -> list[Column]:
    n = F.sum(or_zero("_found"))

    def mean(column, digits):
        total = F.sum(F.when(F.col("_found") == 1, or_zero(column)).otherwise(0.0))
        return rounded(ratio(total, n), digits)

    return [
        mean(kd, 2).alias("avg_kd"),
        mean(rating, 2).alias("avg_rating"),
        mean(damage, 0).alias("avg_damage"),
        n.cast("long").alias("player_count"),
    ]


# ---- current view -----------------------------------------------------------


def _record_columns(n, weight, wins, maps_won, maps_played) -> list[Column]:
    """Roundings of the record; they are part of the rule, later steps use them."""
    return [
        n.cast("long").alias("matches_played"),
        rounded(weight, 2).alias("weighted_matches"),
        rounded(ratio(wins, weight, times=100), 1).alias("win_rate"),
        rounded(ratio(maps_won, maps_played, times=100), 1).alias("map_win_rate"),
        rounded(wins, 2).alias("weighted_wins"),
        rounded(maps_won, 2).alias("weighted_maps_won"),
        rounded(maps_played, 2).alias("weighted_maps_played"),
    ]


def _against_current(ledger: DataFrame, current: DataFrame, p: ModelParams) -> DataFrame:
    """Ledger rows with ``o``, the overlap of their roster with the team's current one."""
    now = current.select("team", F.col("roster").alias("_now"))
    return ledger.join(now, "team").withColumn(
        "o", overlap("_now", roster_of("roster_key"), p.roster_size)
    )


def weighted_record(
    history: DataFrame, current: DataFrame, as_of: Column, p: ModelParams = DEFAULTS
) -> DataFrame:
    """Roster-weighted, time-decayed record of every team.

    Matches are summed per (team, roster) first; the overlap then multiplies the sums.
    """
    w = decay("match_date", as_of, p)
    ledger = known_by(history, as_of).groupBy("team", "roster_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(w).alias("w"),
        F.sum(w * F.col("won")).alias("w_won"),
        F.sum(w * F.col("maps_won")).alias("w_maps_won"),
        F.sum(w * F.col("maps_played")).alias("w_maps"),
    )
    o = F.col("o")
    return (
        _against_current(ledger, current, p)
        .groupBy("team")
        .agg(
            *_record_columns(
                F.sum(F.when(o > 0, F.col("n")).otherwise(0)),
                F.sum(o * F.col("w")),
                F.sum(o * F.col("w_won")),
                F.sum(o * F.col("w_maps_won")),
                F.sum(o * F.col("w_maps")),
            )
        )
    )


def momentum(
    history: DataFrame, current: DataFrame, as_of: Column, p: ModelParams = DEFAULTS
) -> DataFrame:
    """Balance of the newest matches, -1..1.

    The cut to the newest matches comes before the roster filter, so positions keep gaps.
    """
    newest = Window.partitionBy("team").orderBy(F.desc("match_date"), F.desc("match_id"))
    n = p.momentum_last
    last = (
        known_by(history, as_of).select("team", "match_date", "match_id", "won", "roster_key")
        .withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") <= n)
    )
    w = F.col("o") * (n + 1 - F.col("_rn")) / F.lit(float(n)) * decay("match_date", as_of, p)
    result = F.when(F.col("won") == 1, 1.0).otherwise(-1.0)
    return (
        _against_current(last, current, p)
        .groupBy("team")
        .agg(rounded(ratio(F.sum(w * result), F.sum(w)), 3).alias("momentum"))
    )


def _mode_columns(n, weight, won, diff) -> dict[str, Column]:
    """The score difference divides a weighted sum by a plain count; the true mean is beside it."""
    return {
        "win_rate": rounded(ratio(won, weight, times=100), 1),
        "weighted_maps": rounded(weight, 1),
        "avg_score_diff": rounded(ratio(diff, n), 1),
        "maps_played": n.cast("long"),
    }


def mode_stats(
    map_history: DataFrame, current: DataFrame, as_of: Column, p: ModelParams = DEFAULTS
) -> DataFrame:
    """Mode record of every team: wins weighted by margin, roster and time."""
    w = decay("match_date", as_of, p)
    diff = F.col("score_for") - F.col("score_against")
    m = margin_weight(diff, p)
    ledger = known_by(map_history, as_of).groupBy("team", "roster_key", "mode").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(w * m).alias("w"),
        F.sum(w * m * F.col("won")).alias("w_won"),
        F.sum(w * diff).alias("w_diff"),
        F.sum(w).alias("w_plain"),
    )
    o = F.col("o")
    diff_sum = F.sum(o * F.col("w_diff"))
    columns = _mode_columns(
        F.sum(F.when(o > 0, F.col("n")).otherwise(0)),
        F.sum(o * F.col("w")),
        F.sum(o * F.col("w_won")),
        diff_sum,
    )
    columns["weighted_score_diff"] = rounded(ratio(diff_sum, F.sum(o * F.col("w_plain"))), 1)
    return (
        _against_current(ledger, current, p)
        .groupBy("team", "mode")
        .agg(*[c.alias(name) for name, c in columns.items()])
    )


def map_performance(
    map_history: DataFrame, current: DataFrame, p: ModelParams = DEFAULTS
) -> DataFrame:
    """Plays and wins per map weighted by roster only (no decay); empty cells dropped."""
    ledger = map_history.groupBy("team", "roster_key", "mode", "map_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("won").alias("won")
    )
    plays, wins = F.sum(F.col("o") * F.col("n")), F.sum(F.col("o") * F.col("won"))
    return (
        _against_current(ledger, current, p)
        .filter(F.col("o") > 0)
        .groupBy("team", "mode", "map_name")
        .agg(
            plays.alias("weighted_plays"),
            wins.alias("weighted_wins"),
            ratio(wins, plays, times=100).alias("win_rate"),
        )
    )


def current_form(
    form_history: DataFrame,
    player_stats: DataFrame,
    as_of: Column,
    p: ModelParams = DEFAULTS,
) -> DataFrame:
    """One row per team with everything the statistical model needs (``m<i>_*`` per mode)."""
    form_history = known_by(form_history, as_of)
    current = current_rosters(form_history)
    w = decay("match_date", as_of, p)
    modes = range(len(mode_list(p)))
    sums = {"w": w, "w_won": w * F.col("won"), "w_maps_won": w * F.col("maps_won")}
    sums["w_maps"] = w * F.col("maps_played")
    plain = {"n": F.lit(1)}
    for i in modes:
        sums |= {f"m{i}_{c}": w * F.col(f"m{i}_{c}") for c in ("w", "won", "diff")}
        plain[f"m{i}_n"] = F.col(f"m{i}_n")
    ledger = form_history.groupBy("team", "roster_key").agg(
        *[F.sum(c).alias(name) for name, c in (sums | plain).items()]
    )
    o = F.col("o")
    total = {c: F.sum(o * F.col(c)) for c in sums}
    counted = {c: F.sum(F.when(o > 0, F.col(c)).otherwise(0)) for c in plain}
    columns = _record_columns(
        counted["n"], total["w"], total["w_won"], total["w_maps_won"], total["w_maps"]
    )
    for i in modes:
        columns += [
            c.alias(f"m{i}_{name}")
            for name, c in _mode_columns(
                counted[f"m{i}_n"], total[f"m{i}_w"], total[f"m{i}_won"], total[f"m{i}_diff"]
            ).items()
        ]
    record = _against_current(ledger, current, p).groupBy("team").agg(*columns)
    return (
        current.select("team", "roster", "roster_key")
        .join(record, "team")
        .join(momentum(form_history, current, as_of, p), "team")
        .join(roster_quality(current, player_stats), "team")
    )


# ---- point-in-time view -----------------------------------------------------


def side_probes(history: DataFrame) -> DataFrame:
    """Every (team, roster, day) of the history as a probe."""
    return history.select("team", "roster_key", F.col("match_date").alias("as_of_date"))


def _by_player(history: DataFrame, values: list[str]) -> DataFrame:
    """History per (team, player, day); days of one roster are summed before the explode."""
    daily = history.groupBy("team", "roster_key", "match_date").agg(
        *[F.sum(c).alias(c) for c in values]
    )
    return daily.filter(F.col("roster_key") != "").select(
        "team",
        F.explode(roster_of("roster_key")).alias("player_name"),
        F.col("match_date").alias("as_of_date"),
        *values,
    )


def roster_links(history: DataFrame, probes: DataFrame) -> DataFrame:
    """Pairs (team, roster_key, other) of an asked and a played roster that share a player.

    An inverted index from player to roster proposes the pairs; each is kept at the first
    shared player in sorted order, so it stands there once whatever the size of the rosters.
    A roster that first played after the other was last asked for is not proposed.
    """
    def listed(rows, day):
        return (
            rows.filter(F.col("roster_key") != "").groupBy("team", "roster_key").agg(day.alias("day"))
            .withColumn("players", F.array_sort(F.array_distinct(roster_of("roster_key"))))
        )

    asked = listed(probes, F.max("as_of_date")).select(
        "team", "roster_key", F.col("day").alias("last"), F.col("players").alias("asked"),
        F.explode("players").alias("player_name"),
    )
    played = listed(history, F.min("match_date")).select(
        "team", F.col("roster_key").alias("other"), F.col("day").alias("first"), F.col("players").alias("played"),
        F.explode("players").alias("player_name"),
    )
    shared_first = F.get(F.array_intersect("asked", "played"), 0) == F.col("player_name")
    return (
        asked.join(played, ["team", "player_name"])
        .filter(F.col("first") < F.col("last")).filter(shared_first)
        .select("team", "roster_key", "other")
    )


def matches_played_asof(history: DataFrame, probes: DataFrame) -> DataFrame:
    """Earlier matches that share at least one player, per probe; rosters of any size.

    Matches are counted per (team, roster, day) before they go to the rosters they count
    for; one running sum then answers all days of a roster.
    """
    probes = probes.select("team", "roster_key", "as_of_date").filter(F.col("roster_key") != "").distinct()
    daily = history.groupBy("team", "roster_key", "match_date").agg(F.count(F.lit(1)).alias("n"))
    counted = (
        daily.withColumnRenamed("roster_key", "other")
        .join(roster_links(history, probes), ["team", "other"])
        .select("team", "roster_key", F.col("match_date").alias("as_of_date"), "n")
    )
    return asof_sums(
        counted, probes, ["team", "roster_key"], "as_of_date", {"n": (F.col("n"), 1)}
    )


def weighted_sums_asof(
    history: DataFrame, probes: DataFrame, values: list[str], p: ModelParams = DEFAULTS
) -> DataFrame:
    """Decayed, roster-weighted sums of ``values`` before every probe (team, roster, day)."""
    probes = probes.select("team", "roster_key", "as_of_date").distinct()
    per_player = asof_decayed(
        _by_player(history, values),
        probes.filter(F.col("roster_key") != "").select(
            "team",
            "roster_key",
            "as_of_date",
            F.explode(roster_of("roster_key")).alias("player_name"),
        ),
        ["team", "player_name"],
        "as_of_date",
        values,
        p,
        carry=["roster_key"],
    )
    return per_player.groupBy("team", "roster_key", "as_of_date").agg(
        *[(F.sum(c) / float(p.roster_size)).alias(c) for c in values]
    )


RECORD_VALUES = ["n", "won", "maps_won", "maps_played"]


def mode_values(p: ModelParams = DEFAULTS) -> list[str]:
    return [f"m{i}_{c}" for i, _ in enumerate(mode_list(p)) for c in ("w", "won")]


def form_sums_asof(
    form_history: DataFrame, probes: DataFrame, p: ModelParams = DEFAULTS, modes: bool = True
) -> DataFrame:
    """The sums behind the record and the mode statistics, from one pass over the history."""
    values = RECORD_VALUES + (mode_values(p) if modes else [])
    return weighted_sums_asof(form_history.withColumn("n", F.lit(1)), probes, values, p)


def _record_of_sums(n) -> list[Column]:
    # zero history leaves rounding noise of the running sums behind
    clean = [F.when(F.col(c) > 1e-9, F.col(c)).otherwise(0.0) for c in RECORD_VALUES]
    return _record_columns(n, *clean)


def _modes_of_sums(p: ModelParams) -> list[Column]:
    columns = []
    for i, _ in enumerate(mode_list(p)):
        w = F.when(F.col(f"m{i}_w") > 1e-9, F.col(f"m{i}_w")).otherwise(0.0)
        columns += [
            rounded(ratio(F.col(f"m{i}_won"), w, times=100), 1).alias(f"m{i}_win_rate"),
            rounded(w, 1).alias(f"m{i}_weighted_maps"),
        ]
    return columns


PROBE = ["team", "roster_key", "as_of_date"]


def weighted_record_asof(
    history: DataFrame,
    probes: DataFrame,
    p: ModelParams = DEFAULTS,
    counts: bool = True,
    sums: DataFrame | None = None,
) -> DataFrame:
    """The weighted record before every probe; ``counts=False`` leaves out matches_played.

    ``sums`` can be handed in where :func:`form_sums_asof` has been worked out already.
    """
    if sums is None:
        sums = form_sums_asof(history, probes, p, modes=False)
    if not counts:
        return sums.select(*PROBE, *_record_of_sums(F.lit(0))[1:])
    played = matches_played_asof(history, probes).withColumnRenamed("n", "_played")
    return sums.join(played, PROBE, "left").select(*PROBE, *_record_of_sums(F.coalesce("_played", F.lit(0))))


def mode_stats_asof(
    form_history: DataFrame, probes: DataFrame, p: ModelParams = DEFAULTS
) -> DataFrame:
    """Mode win rates and weights before every probe, one column set per scored mode."""
    sums = weighted_sums_asof(form_history, probes, mode_values(p), p)
    return sums.select(*PROBE, *_modes_of_sums(p))


def roster_quality_asof(
    player_match_stats: DataFrame, matches: DataFrame, probes: DataFrame
) -> DataFrame:
    """Roster quality from the players' averages before every probe day."""
    events = player_match_stats.join(
        matches.select("match_id", F.col("match_date").alias("as_of_date")), "match_id"
    )
    asked = (
        probes.filter(F.col("roster_key") != "")
        .select(
            "team",
            "roster_key",
            "as_of_date",
            F.explode(roster_of("roster_key")).alias("player_name"),
        )
        .distinct()
    )
    seen = asof_sums(
        events,
        asked,
        ["player_name"],
        "as_of_date",
        {
            "_n": (F.lit(1), 1),
            "_kd": (F.col("kd"), 1),
            "_rating": (F.col("rating"), 1),
            "_damage": (F.col("damage"), 1),
        },
        carry=["team", "roster_key"],
    )
    means = seen.withColumns(
        {c: ratio(c, "_n") for c in ("_kd", "_rating", "_damage")}
        | {"_found": flag(F.col("_n") > 0)}
    )
    return means.groupBy("team", "roster_key", "as_of_date").agg(
        *_quality_aggs("_kd", "_rating", "_damage")
    )


def recent_matches_asof(
    history: DataFrame, probes: DataFrame, k: int, extra: list[str] | None = None
) -> DataFrame:
    """The k newest earlier matches of the team of every probe, newest first."""
    return asof_recent(
        history.withColumn("as_of_date", F.col("match_date")),
        probes.select("team", "roster_key", "as_of_date"),
        ["team"],
        "as_of_date",
        ["match_id"],
        ["won", "roster", "maps_played", "maps_won", *(extra or [])],
        k,
        carry=["roster_key"],
    )


def _with_weighed(recent: DataFrame, p: ModelParams, fields: list[str]) -> DataFrame:
    """``_w``: the entries of ``recent`` with their overlap ``o`` and weight ``w``.

    Each array step is its own column, so it is evaluated once per row.
    """
    def weigh(x):
        o = overlap(F.col("_now"), x["roster"], p.roster_size)
        return F.struct(o.alias("o"), x["day"].alias("day"), *[x[f].alias(f) for f in fields])

    return recent.withColumn("_now", roster_of("roster_key")).withColumn(
        "_w", F.transform("recent", weigh)
    )


def _sums(array, start: list[str], step) -> Column:
    """Several running sums over one pass of an array."""
    zero = F.struct(*[F.lit(0.0).alias(name) for name in start])

    def add(acc, x):
        values = step(x)
        return F.struct(*[(acc[name] + values[name]).alias(name) for name in start])

    return F.aggregate(array, zero, add)


def with_momentum(recent: DataFrame, p: ModelParams = DEFAULTS) -> DataFrame:
    """Momentum from ``recent``, a newest-first array of earlier matches."""
    n = p.momentum_last
    placed = F.transform(
        F.slice("_w", 1, n),
        lambda x, i: F.struct(
            (x["o"] * ((n - i) / F.lit(float(n))) * decay(x["day"], F.col("as_of_date"), p)).alias(
                "w"
            ),
            F.when(x["won"] == 1, 1.0).otherwise(-1.0).alias("r"),
        ),
    )
    sums = _sums("_p", ["w", "wr"], lambda x: {"w": x["w"], "wr": x["w"] * x["r"]})
    value = rounded(ratio(F.col("_s.wr"), F.col("_s.w")), 3)
    return (
        recent.withColumn("_p", placed)
        .withColumn("_s", sums)
        .withColumn("momentum", F.coalesce(value, F.lit(0.0)))
        .drop("_p", "_s")
    )


def with_context(recent: DataFrame, p: ModelParams = DEFAULTS) -> DataFrame:
    """Recent rates, roster stability, rest days and opponent strength from ``recent``.

    ``recent`` holds at most 4 times ``context_last`` (12 at least) earlier matches; the first ``context_last``
    of them with a shared player count.
    """
    used = F.slice(F.filter("_w", lambda x: x["o"] > 0), 1, p.context_last)

    def step(x):
        w = x["o"] * decay(x["day"], F.col("as_of_date"), p)
        return {
            "o": x["o"],
            "w": w,
            "won": w * x["won"],
            "maps_won": w * x["maps_won"],
            "maps": w * x["maps_played"],
            "rate": w * F.coalesce(x["opponent_rate"], F.lit(0.0)),
        }

    sums = _sums("_u", ["o", "w", "won", "maps_won", "maps", "rate"], step)
    first = F.get("_w", 0)
    rest = F.when(
        first["o"] > 0, F.date_diff("as_of_date", first["day"]).cast("double")
    ).otherwise(F.lit(p.default_rest_days))

    def rate(num, den, times=100.0):
        return F.coalesce(rounded(ratio(num, den, times=times), 1), F.lit(0.0))

    return (
        recent.withColumn("_u", used)
        .withColumn("_s", sums)
        .withColumns(
            {
                "recent_win_rate": rate("_s.won", "_s.w"),
                "recent_map_win_rate": rate("_s.maps_won", "_s.maps"),
                "roster_stability": rate("_s.o", F.size("_u")),
                "rest_days": rounded(rest, 1),
                "opponent_strength": rate("_s.rate", "_s.w", 1.0),
            }
        )
        .drop("_u", "_s")
    )


def momentum_asof(
    history: DataFrame, probes: DataFrame, p: ModelParams = DEFAULTS
) -> DataFrame:
    recent = recent_matches_asof(history, probes, p.momentum_last)
    return with_momentum(_with_weighed(recent, p, ["won"]), p).select(
        "team", "roster_key", "as_of_date", "momentum"
    )


def with_opponent_rate(history: DataFrame, records: DataFrame) -> DataFrame:
    """Adds the opponent's own win rate on the day of each match."""
    rate = records.select(
        F.col("team").alias("opponent"),
        F.col("roster_key").alias("opponent_key"),
        F.col("as_of_date").alias("match_date"),
        F.col("win_rate").alias("opponent_rate"),
    )
    return history.join(rate, ["opponent", "opponent_key", "match_date"], "left")


def recent_context_asof(
    history: DataFrame, probes: DataFrame, records: DataFrame, p: ModelParams = DEFAULTS
) -> DataFrame:
    """Momentum and recent context of every probe from one as-of pass.

    ``records`` is the weighted record of every match side (for the opponents).
    """
    recent = recent_matches_asof(
        with_opponent_rate(history, records), probes, max(4 * p.context_last, 12), ["opponent_rate"]
    )
    fields = ["won", "maps_won", "maps_played", "opponent_rate"]
    weighed = _with_weighed(recent, p, fields)
    return with_context(with_momentum(weighed, p), p).drop("recent", "_now", "_w")


def form_asof(
    form_history: DataFrame,
    player_match_stats: DataFrame,
    matches: DataFrame,
    probes: DataFrame,
    p: ModelParams = DEFAULTS,
    context: bool = True,
    modes: bool = True,
) -> DataFrame:
    """Everything known about every (team, roster) before a day, one row per probe.

    Record, mode statistics and the opponents' records come from one pass over the history:
    with ``context`` the sides of the history are asked for together with the probes.
    """
    probes = staged(probes.select(*PROBE).distinct())
    asked = probes.unionByName(side_probes(form_history)).distinct() if context else probes
    sums = form_sums_asof(form_history, asked, p, modes)
    mine = sums
    if context:
        sums = staged(sums)
        mine = sums.join(probes, PROBE, "left_semi")
    played = matches_played_asof(form_history, probes).withColumnRenamed("n", "_played")
    columns = _record_of_sums(F.coalesce("_played", F.lit(0))) + (_modes_of_sums(p) if modes else [])
    form = mine.join(played, PROBE, "left").select(*PROBE, *columns)
    form = form.join(roster_quality_asof(player_match_stats, matches, probes), PROBE)
    if context:
        own = weighted_record_asof(form_history, probes, p, counts=False, sums=sums)
        form = form.join(recent_context_asof(form_history, probes, own, p), PROBE)
    else:
        form = form.join(momentum_asof(form_history, probes, p), PROBE)
    return form.withColumn("roster", roster_of("roster_key"))


# ---- pairs ------------------------------------------------------------------


def pair_events(
    matches: DataFrame, map_results: DataFrame, p: ModelParams = DEFAULTS
) -> DataFrame:
    """One row per match of a pair: series win and, per scored mode, maps and map wins."""
    first = F.col("team_a") < F.col("team_b")
    a_won = F.col("team_a_score") > F.col("team_b_score")
    modes = list(enumerate(mode_list(p)))
    aggs = []
    for i, mode in modes:
        here = F.col("mode") == mode
        aggs += [F.sum(flag(here)).alias(f"m{i}_n"), F.sum(flag(here & a_won)).alias(f"m{i}_a")]
    maps = map_results.groupBy("match_id").agg(*aggs)
    columns = []
    for i, _ in modes:
        n, a = or_zero(f"m{i}_n"), or_zero(f"m{i}_a")
        columns += [n.alias(f"m{i}_n"), F.when(first, a).otherwise(n - a).alias(f"m{i}_won")]
    return matches.join(maps, "match_id", "left").select(
        *canonical_pair(),
        F.col("match_date").alias("as_of_date"),
        F.lit(1).alias("n"),
        flag(F.col("winner") == F.least("team_a", "team_b")).alias("won"),
        *columns,
    )


def pair_values(p: ModelParams = DEFAULTS) -> list[str]:
    return ["n", "won"] + [f"m{i}_{c}" for i, _ in enumerate(mode_list(p)) for c in ("n", "won")]


def pair_form(events: DataFrame, p: ModelParams = DEFAULTS) -> DataFrame:
    """All meetings of every pair."""
    return events.groupBy("team_1", "team_2").agg(
        *[F.sum(c).alias(f"h_{c}") for c in pair_values(p)]
    )


def pair_form_asof(events: DataFrame, probes: DataFrame, p: ModelParams = DEFAULTS) -> DataFrame:
    """Meetings of every pair strictly before a day; probes have team_a, team_b, as_of_date."""
    asked = probes.select(*canonical_pair(), "as_of_date")
    return asof_sums(
        events,
        asked,
        ["team_1", "team_2"],
        "as_of_date",
        {f"h_{c}": (F.col(c), 1) for c in pair_values(p)},
    )


def head_to_head(fixtures: DataFrame, pairs: DataFrame) -> DataFrame:
    """Fixtures with the pair's record turned to the fixture's own sides."""
    keys = ["team_1", "team_2"] + (["as_of_date"] if "as_of_date" in pairs.columns else [])
    values = [c for c in pairs.columns if c.startswith("h_")]
    joined = fixtures.withColumns(
        {"team_1": F.least("team_a", "team_b"), "team_2": F.greatest("team_a", "team_b")}
    ).join(pairs, keys, "left")
    a_first = F.col("team_a") == F.col("team_1")
    columns = {}
    for c in values:
        if not c.endswith("won"):
            continue
        stem = c[: -len("won")]
        n, won = or_zero(f"{stem}n").cast("long"), or_zero(c).cast("long")
        columns[f"{stem}total"] = n
        columns[f"{stem}a"] = F.when(a_first, won).otherwise(n - won)
        columns[f"{stem}b"] = F.when(a_first, n - won).otherwise(won)
    return joined.withColumns(columns).drop("team_1", "team_2", *values)


def h2h_reference_leak(matches: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Meetings as the original query counts them: the day cut binds only to the reversed
    orientation, so meetings in the fixture's own orientation count even when later."""
    same = matches.groupBy("team_a", "team_b").agg(
        F.count(F.lit(1)).alias("s_n"),
        F.sum(flag(F.col("winner") == F.col("team_a"))).alias("s_a"),
    )
    reverse = matches.select(
        F.col("team_b").alias("team_a"),
        F.col("team_a").alias("team_b"),
        F.col("match_date").alias("as_of_date"),
        flag(F.col("winner") == F.col("team_b")).alias("a_won"),
    )
    earlier = asof_sums(
        reverse,
        fixtures.select("team_a", "team_b", "as_of_date"),
        ["team_a", "team_b"],
        "as_of_date",
        {"r_n": (F.lit(1), 1), "r_a": (F.col("a_won"), 1)},
    )
    n = or_zero("s_n") + or_zero("r_n")
    a = or_zero("s_a") + or_zero("r_a")
    return (
        fixtures.join(same, ["team_a", "team_b"], "left")
        .join(earlier, ["team_a", "team_b", "as_of_date"], "left")
        .withColumns({"h_total": n, "h_a": a, "h_b": n - a})
        .drop("s_n", "s_a", "r_n", "r_a")
    )


# ---- ordered windows --------------------------------------------------------


def month_of(day) -> Column:
    return F.trunc(day, "month")


def trailing_results(rows: DataFrame, n: int = 10, keys: list[str] | None = None) -> DataFrame:
    """Wins, losses and rate of the last n results up to and including each row."""
    keys = keys or ["team"]
    order = ["match_date", "match_id"]
    if "map_number" in rows.columns:
        order = order + ["map_number"]

    def build(w):
        frame = w.rowsBetween(-(n - 1), 0)
        wins, games = F.sum("won").over(frame), F.count(F.lit(1)).over(frame)
        return {
            "last_wins": wins,
            "last_losses": games - wins,
            "last_rate": rounded(ratio(wins, games, times=100), 2),
        }

    return bounded_window(rows, keys, month_of("match_date"), order, n, build)


def recent_form(player_match_stats: DataFrame, matches: DataFrame, n: int = 5) -> DataFrame:
    """Mean k/d of a player's last n matches up to and including each match."""
    dated = player_match_stats.select("match_id", "player_name", "kd").join(
        matches.select("match_id", "match_date"), "match_id"
    )

    def build(w):
        return {"recent_kd": F.avg("kd").over(w.rowsBetween(-(n - 1), 0))}

    return bounded_window(
        dated, ["player_name"], month_of("match_date"), ["match_date", "match_id"], n, build
    )


def career_means(player_match_stats: DataFrame) -> DataFrame:
    return player_match_stats.groupBy("player_name").agg(
        F.avg("kd").alias("career_kd"), F.avg("rating").alias("career_rating")
    )


def meeting_numbers(matches: DataFrame) -> DataFrame:
    """Running number of the meeting of a pair within a year."""
    rows = matches.select(
        "match_id", *canonical_pair(), "match_date", F.year("match_date").alias("year")
    )
    return running_number(
        rows,
        ["team_1", "team_2", "year"],
        F.col("match_date"),
        ["match_date", "match_id"],
        "meeting_no",
    )


def rolling_results(
    matches: DataFrame, map_rows: DataFrame, size: int | None = None
) -> DataFrame:
    """Per team the 'W'/'L' letters of the series and of every mode, oldest first.

    With ``size`` only the newest letters, pruned to that number before the shuffle.
    """
    series = sides(
        matches,
        {
            "team": ("team_a", "team_b"),
            "won": (
                flag(F.col("winner") == F.col("team_a")),
                flag(F.col("winner") == F.col("team_b")),
            ),
        },
        ["match_id", "match_date"],
    ).select("team", F.lit("Series").alias("kind"), "match_date", "match_id",
             F.lit(0).alias("map_number"), "won")
    maps = map_rows.select(
        "team", F.col("mode").alias("kind"), "match_date", "match_id", "map_number", "won"
    )
    rows = series.unionByName(maps)
    if size is not None:
        newest = Window.partitionBy("team", "kind").orderBy(
            F.desc("match_date"), F.desc("match_id"), F.desc("map_number")
        )
        rows = rows.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= size)
    letter = F.when(F.col("won") == 1, "W").otherwise("L")
    entry = F.struct("match_date", "match_id", "map_number", letter.alias("r"))
    return rows.groupBy("team", "kind").agg(
        F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["r"]).alias("results")
    )
