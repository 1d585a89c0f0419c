"""Scoring rules as column expressions over one row per fixture.

A fixture row carries the form of both sides (``a_*`` and ``b_*``), the head-to-head
record (``h_*``) and, per scored mode i, ``a_m<i>_*``, ``b_m<i>_*`` and ``h_m<i>_*``.
Nothing in this module shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.functions.scalar import (
    as_lit,
    or_zero,
    ratio,
    rounded,
    score_text,
    share,
)
from matchlake.operators.perspective import mode_list
from matchlake.params import DEFAULTS, ModelParams

# differences below this are a tie: sums of doubles may differ in the last digit
TIE = 1e-9


def ahead(x, y) -> Column:
    return x > y + F.lit(TIE)


def attach_form(fixtures: DataFrame, form: DataFrame) -> DataFrame:
    """Both sides' form beside each fixture. Point-in-time form has an ``as_of_date`` and
    is looked up by (team, roster, day), current form by team."""
    out = fixtures
    asof = "as_of_date" in form.columns
    for side in ("a", "b"):
        skip = {"team", "as_of_date"}
        keys = [F.col("team").alias(f"team_{side}")]
        on = [f"team_{side}"]
        if asof:
            keys += [F.col("as_of_date"), F.col("roster_key").alias(f"{side}_roster_key")]
            on += ["as_of_date", f"{side}_roster_key"]
            skip.add("roster_key")
        values = [F.col(c).alias(f"{side}_{c}") for c in form.columns if c not in skip]
        out = out.join(form.select(*keys, *values), on, "left")
    return out


def _quality_probability(x: str, y: str, p: ModelParams) -> Column:
    mixed = (
        share(f"{x}_avg_kd", f"{y}_avg_kd") * p.quality_kd
        + share(f"{x}_avg_rating", f"{y}_avg_rating") * p.quality_rating
        + share(f"{x}_avg_damage", f"{y}_avg_damage") * p.quality_damage
    )
    known = (F.col(f"{x}_player_count") > 0) & (F.col(f"{y}_player_count") > 0)
    return F.when(known, mixed).otherwise(F.lit(50.0))


def _chemistry_weight(history: Column, high: float, mid: float, p: ModelParams) -> Column:
    return (
        F.when(history >= high, F.lit(p.chemistry_high))
        .when(history >= mid, F.lit(p.chemistry_mid))
        .otherwise(F.lit(p.chemistry_low))
    )


def _pull(prob: Column, wins: Column, total: Column, weight: Column) -> Column:
    """Move a probability towards a head-to-head share by ``weight``."""
    return prob * (1 - weight) + ratio(wins, total, times=100) * weight


def _normalised(a: Column, b: Column) -> tuple[Column, Column]:
    return a / (a + b) * 100.0, b / (a + b) * 100.0


def win_probability(p: ModelParams = DEFAULTS) -> tuple[Column, Column]:
    """Percent for team_a and team_b, unrounded."""
    history = F.col("a_weighted_matches") + F.col("b_weighted_matches")
    chem = _chemistry_weight(history, p.series_history_high, p.series_history_mid, p)
    h2h_weight = F.least(F.col("h_total") * p.h2h_step, F.lit(p.h2h_max))

    def side(x, y):
        wins, maps = share(f"{x}_win_rate", f"{y}_win_rate"), share(
            f"{x}_map_win_rate", f"{y}_map_win_rate"
        )
        any_win = F.col(f"{x}_win_rate") + F.col(f"{y}_win_rate") > 0
        any_map = F.col(f"{x}_map_win_rate") + F.col(f"{y}_map_win_rate") > 0
        chemistry = F.when(
            any_win & any_map, wins * p.win_share + maps * (1 - p.win_share)
        ).otherwise(wins)
        base = chemistry * chem + _quality_probability(x, y, p) * (1 - chem)
        form = F.lit(50.0) + F.col(f"{x}_momentum") * p.momentum_span
        prob = base * (1 - p.momentum_share) + form * p.momentum_share
        return F.when(
            F.col("h_total") > 0, _pull(prob, F.col(f"h_{x}"), F.col("h_total"), h2h_weight)
        ).otherwise(prob)

    return _normalised(side("a", "b"), side("b", "a"))


def mode_probability(i: int, p: ModelParams = DEFAULTS) -> tuple[Column, Column]:
    """Percent of winning a map of scored mode ``i`` for team_a and team_b, unrounded."""
    history = or_zero(f"a_m{i}_weighted_maps") + or_zero(f"b_m{i}_weighted_maps")
    chem = _chemistry_weight(history, p.mode_history_high, p.mode_history_mid, p)
    n_mode, n_all = F.col(f"h_m{i}_total"), F.col("h_total")
    w_mode = F.least(n_mode * p.mode_h2h_step, F.lit(p.mode_h2h_max))
    w_all = F.least(n_all * p.h2h_step, F.lit(p.mode_h2h_fallback_max))

    def side(x, y):
        chemistry = share(or_zero(f"{x}_m{i}_win_rate"), or_zero(f"{y}_m{i}_win_rate"))
        prob = chemistry * chem + _quality_probability(x, y, p) * (1 - chem)
        return (
            F.when(n_mode > 0, _pull(prob, F.col(f"h_m{i}_{x}"), n_mode, w_mode))
            .when(n_all > 0, _pull(prob, F.col(f"h_{x}"), n_all, w_all))
            .otherwise(prob)
        )

    return _normalised(side("a", "b"), side("b", "a"))


def walk(a_wins: list[Column], first_to: int) -> Column:
    """Wins of both sides when slots are played in order until one has ``first_to``."""

    def play(acc, won):
        open_ = (acc["a"] < first_to) & (acc["b"] < first_to)
        return F.when(
            open_,
            F.struct(
                (acc["a"] + won.cast("int")).alias("a"), (acc["b"] + (~won).cast("int")).alias("b")
            ),
        ).otherwise(acc)

    start = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))
    return F.aggregate(F.array(*a_wins), start, play)


def with_series_result(
    df: DataFrame, a_wins: list[Column], slots: list[Column], first_to: int, out: str
) -> DataFrame:
    """Adds map wins, winner, winner-first score and the played slots as an array.

    Play stops once, so the played slots are the first a + b of them.
    """
    a, b = F.col("_walk")["a"], F.col("_walk")["b"]
    a_ahead = a > b
    return (
        df.withColumn("_walk", walk(a_wins, first_to))
        .withColumns(
            {
                "team_a_map_wins": a,
                "team_b_map_wins": b,
                out: F.slice(F.array(*slots), F.lit(1), a + b),
                "predicted_winner": F.when(a_ahead, F.col("team_a")).otherwise(F.col("team_b")),
                "predicted_score": F.when(a_ahead, score_text(a, b)).otherwise(score_text(b, a)),
            }
        )
        .drop("_walk")
    )


def with_win_probability(df: DataFrame, p: ModelParams = DEFAULTS) -> DataFrame:
    a, b = win_probability(p)
    return df.withColumns(
        {"team_a_probability": rounded(a, 1), "team_b_probability": rounded(b, 1)}
    ).withColumn("confidence", F.abs(F.col("team_a_probability") - F.col("team_b_probability")))


def with_mode_probabilities(df: DataFrame, p: ModelParams = DEFAULTS) -> DataFrame:
    """``m<i>_prob_a`` / ``m<i>_prob_b`` (unrounded) for every scored mode."""
    columns = {}
    for i, _ in enumerate(mode_list(p)):
        columns[f"m{i}_prob_a"], columns[f"m{i}_prob_b"] = mode_probability(i, p)
    return df.withColumns(columns)


def with_series_walk(df: DataFrame, p: ModelParams = DEFAULTS) -> DataFrame:
    """Series winner, score and the played maps, from the mode probabilities."""
    index = {mode: i for i, mode in enumerate(mode_list(p))}
    wins, slots = [], []
    for number, mode in enumerate(p.series_modes, 1):
        i = index[mode]
        won = ahead(F.col(f"m{i}_prob_a"), F.col(f"m{i}_prob_b"))
        wins.append(won)
        slots.append(
            F.struct(
                F.lit(number).alias("map_number"),
                F.lit(mode).alias("mode"),
                F.when(won, F.col("team_a")).otherwise(F.col("team_b")).alias("predicted_winner"),
                rounded(f"m{i}_prob_a", 1).alias("team_a_probability"),
                rounded(f"m{i}_prob_b", 1).alias("team_b_probability"),
            )
        )
    return with_series_result(df, wins, slots, p.first_to, "map_predictions")


# ---- map pool ---------------------------------------------------------------


def pool_rows(map_results: DataFrame, p: ModelParams = DEFAULTS) -> DataFrame:
    """Every map of every scored mode."""
    return (
        map_results.filter(F.col("mode").isin(mode_list(p))).select("mode", "map_name").distinct()
    )


def team_plays(map_performance: DataFrame, pool: DataFrame) -> DataFrame:
    """Per team and mode an array with one entry per map of the pool, in the pool's order.

    Both sides of a fixture then line up by position. The arrays are as long as the pool
    of one mode, whatever the number of plays.
    """
    teams = map_performance.select("team", "mode").distinct()
    entry = F.struct("map_name", "plays", "rate")
    filled = (
        teams.join(pool, "mode")
        .join(map_performance, ["team", "mode", "map_name"], "left")
        .select(
            "team",
            "mode",
            "map_name",
            or_zero("weighted_plays").cast("double").alias("plays"),
            F.coalesce("win_rate", F.lit(50.0)).alias("rate"),
        )
    )
    return filled.groupBy("team", "mode").agg(F.sort_array(F.collect_list(entry)).alias("plays"))


def with_map_pool(
    fixtures: DataFrame, plays: DataFrame, pool: DataFrame, p: ModelParams = DEFAULTS
) -> DataFrame:
    """Most played unused map per slot.

    Plays do not change between slots, so the k-th slot of a mode takes the k-th ranked
    map; when the pool is shorter than that, its first map is used again.
    """
    modes = mode_list(p)
    wide = plays.groupBy("team").agg(
        *[F.max(F.when(F.col("mode") == m, F.col("plays"))).alias(f"p{i}")
          for i, m in enumerate(modes)]
    )
    # the view is the same on every day: each pair is worked out once
    df = fixtures.select("team_a", "team_b").distinct()
    for side in ("a", "b"):
        df = df.join(
            wide.select(
                F.col("team").alias(f"team_{side}"),
                *[F.col(f"p{i}").alias(f"_{side}{i}") for i in range(len(modes))],
            ),
            f"team_{side}",
            "left",
        )
    names = pool.groupBy("mode").agg(F.sort_array(F.collect_set("map_name")).alias("maps"))
    lists = names.agg(
        *[F.max(F.when(F.col("mode") == m, F.col("maps"))).alias(f"l{i}")
          for i, m in enumerate(modes)]
    ).select(F.struct(*[f"l{i}" for i in range(len(modes))]).alias("l"))
    df = df.withColumn("_pool", lists.scalar())

    def nothing(name):
        return F.struct(
            name.alias("map_name"), F.lit(0.0).alias("plays"), F.lit(50.0).alias("rate")
        )

    def merged(x, y):
        return F.struct(
            (-(x["plays"] + y["plays"])).alias("order"),
            x["map_name"].alias("map_name"),
            x["plays"].alias("a_plays"),
            y["plays"].alias("b_plays"),
            x["rate"].alias("a_rate"),
            y["rate"].alias("b_rate"),
        )

    # a side without plays of a mode has an untouched pool
    for i in range(len(modes)):
        blank = F.transform(F.col(f"_pool.l{i}"), nothing)
        df = df.withColumns(
            {f"_{s}{i}": F.coalesce(F.col(f"_{s}{i}"), blank) for s in ("a", "b")}
        )
    df = df.withColumns(
        {
            f"_r{i}": F.sort_array(F.zip_with(f"_a{i}", f"_b{i}", merged))
            for i in range(len(modes))
        }
    )
    # only the ranks that slots can take go on
    need = {mode: p.series_modes.count(mode) for mode in modes}
    df = df.withColumns({f"_r{i}": F.slice(f"_r{i}", 1, need[m]) for i, m in enumerate(modes)})
    used: dict[str, int] = {}
    slots = []
    for number, mode in enumerate(p.series_modes, 1):
        k = used.get(mode, 0)
        used[mode] = k + 1
        i = modes.index(mode)
        pick, first = F.get(f"_r{i}", F.lit(k)), F.get(F.col(f"_pool.l{i}"), 0)
        trust = F.least(pick["a_plays"] + pick["b_plays"], F.lit(10.0)) / 10.0
        slots.append(
            F.struct(
                F.lit(number).alias("map_number"),
                F.lit(mode).alias("mode"),
                F.coalesce(pick["map_name"], first, F.lit("Unknown")).alias("predicted_map"),
                rounded(pick["a_rate"], 1).alias("team_a_winrate"),
                rounded(pick["b_rate"], 1).alias("team_b_winrate"),
                rounded(pick["a_plays"], 1).alias("team_a_plays"),
                rounded(pick["b_plays"], 1).alias("team_b_plays"),
                ((pick["a_rate"] - pick["b_rate"]) * trust).alias("advantage_a"),
                F.when(pick.isNotNull(), F.lit("most played"))
                .when(first.isNotNull(), F.lit("pool used up"))
                .otherwise(F.lit("no map data"))
                .alias("reason"),
            )
        )
    done = df.select(
        F.col("team_a").alias("_a"), F.col("team_b").alias("_b"), F.array(*slots).alias("predicted_maps")
    )
    same = F.col("team_a").eqNullSafe(F.col("_a")) & F.col("team_b").eqNullSafe(F.col("_b"))
    return fixtures.join(done, same).drop("_a", "_b")


# ---- single maps and rotations ----------------------------------------------


def shrunk(rate: Column, matches: Column) -> Column:
    """Win rate pulled towards one half by sample size."""
    w = F.least(matches / 10.0, F.lit(1.0))
    return (rate * w + 0.5) / (w + 1.0)


def single_map_probability(
    rate_a: Column, n_a: Column, rate_b: Column, n_b: Column, symmetric: bool = False
) -> tuple[Column, Column]:
    """Percent for both sides. The default form depends on the order of the sides."""
    a, b = shrunk(rate_a, n_a), shrunk(rate_b, n_b)
    if symmetric:
        x, y = a * (1 - b), b * (1 - a)
    else:
        x, y = a, 1 - b
    prob_a = F.when(x + y > 0, x / (x + y) * 100.0).otherwise(50.0)
    none = (n_a == 0) & (n_b == 0)
    prob_a = F.when(none, F.lit(50.0)).otherwise(prob_a)
    return prob_a, F.lit(100.0) - prob_a


def data_quality(n_a: Column, n_b: Column) -> Column:
    return (
        F.when((n_a == 0) & (n_b == 0), "no_data")
        .when((n_a >= 5) & (n_b >= 5), "high")
        .when((n_a >= 3) | (n_b >= 3), "medium")
        .otherwise("low")
    )


def quality_points(label: Column) -> Column:
    return F.when(label == "high", 3).when(label == "medium", 2).when(label == "low", 1).otherwise(0)


def mean_quality(points: Column) -> Column:
    return F.when(points >= 2.5, "high").when(points >= 1.5, "medium").otherwise("low")


def _map_columns(prefix_a: str, prefix_b: str, symmetric: bool, compat: bool) -> dict[str, Column]:
    n_a, n_b = or_zero(f"{prefix_a}_n"), or_zero(f"{prefix_b}_n")

    def rate(prefix):
        value = F.coalesce(F.col(f"{prefix}_rate"), F.lit(0.5))
        return F.when(value == 0, F.lit(0.5)).otherwise(value) if compat else value

    prob_a, prob_b = single_map_probability(rate(prefix_a), n_a, rate(prefix_b), n_b, symmetric)
    none = (n_a == 0) & (n_b == 0)
    return {
        "prob_a": prob_a,
        "prob_b": prob_b,
        "a_wins": none | ahead(prob_a, prob_b),
        "margin": rounded(F.abs(prob_a - prob_b), 1),
        "quality": data_quality(n_a, n_b),
    }


def predict_maps(
    requests: DataFrame, team_map_mode: DataFrame, symmetric: bool = False, compat: bool = False
) -> DataFrame:
    """Outcome of single maps: requests have team_a, team_b, mode and map_name.

    ``compat`` keeps the original's use of the stored percentage as if it were a share and
    its reading of a rate of 0 as unknown.
    """
    scale = 1.0 if compat else 100.0
    df = requests
    for side in ("a", "b"):
        df = df.join(
            team_map_mode.select(
                F.col("team").alias(f"team_{side}"),
                "mode",
                "map_name",
                F.col("total_played").alias(f"{side}_n"),
                (F.col("win_rate") / scale).alias(f"{side}_rate"),
            ),
            [f"team_{side}", "mode", "map_name"],
            "left",
        )
    c = _map_columns("a", "b", symmetric, compat)
    return df.select(
        *requests.columns,
        rounded(c["prob_a"], 1).alias("team_a_probability"),
        rounded(c["prob_b"], 1).alias("team_b_probability"),
        F.when(c["a_wins"], F.col("team_a")).otherwise(F.col("team_b")).alias("predicted_winner"),
        c["margin"].alias("confidence"),
        c["quality"].alias("data_quality"),
        or_zero("a_n").cast("long").alias("team_a_matches"),
        or_zero("b_n").cast("long").alias("team_b_matches"),
    )


def predict_rotation(
    fixtures: DataFrame,
    mode_rollup: DataFrame,
    team_map_mode: DataFrame | None = None,
    map_names: list[str] | None = None,
    p: ModelParams = DEFAULTS,
    symmetric: bool = False,
    compat: bool = False,
) -> DataFrame:
    """Series from single-map predictions over a rotation of modes, or over given maps."""
    rotation = list(p.rotation_modes)
    if map_names is not None and len(map_names) != len(rotation):
        raise ValueError(f"map_names must have {len(rotation)} maps")
    if map_names is None:
        wanted = [(mode, None) for mode in dict.fromkeys(rotation)]
        source = mode_rollup.select(
            "team", "mode", F.col("matches").alias("n"), F.col("win_rate").alias("rate"),
            F.lit(None).cast("string").alias("map_name"),
        )
        slot_keys = [(mode, None) for mode in rotation]
    else:
        slot_keys = list(zip(rotation, map_names))
        wanted = list(dict.fromkeys(slot_keys))
        source = team_map_mode.select(
            "team", "mode", F.col("total_played").alias("n"),
            (F.col("win_rate") / (1.0 if compat else 100.0)).alias("rate"), "map_name",
        )
    picks = []
    for j, (mode, name) in enumerate(wanted):
        here = F.col("mode") == mode
        if name is not None:
            here = here & (F.col("map_name") == name)
        picks += [
            F.max(F.when(here, F.col("n"))).alias(f"r{j}_n"),
            F.max(F.when(here, F.col("rate"))).alias(f"r{j}_rate"),
        ]
    wide = source.groupBy("team").agg(*picks)
    df = fixtures
    for side in ("a", "b"):
        df = df.join(
            wide.select(
                F.col("team").alias(f"team_{side}"),
                *[F.col(c).alias(f"{side}_{c}") for c in wide.columns if c != "team"],
            ),
            f"team_{side}",
            "left",
        )
    position = {key: j for j, key in enumerate(wanted)}
    for j, _ in enumerate(wanted):
        c = _map_columns(f"a_r{j}", f"b_r{j}", symmetric, compat)
        df = df.withColumns({f"_{j}_{name}": column for name, column in c.items()})
    wins, slots = [], []
    for number, key in enumerate(slot_keys, 1):
        j = position[key]
        wins.append(F.col(f"_{j}_a_wins"))
        slots.append(
            F.struct(
                F.lit(number).alias("map_number"),
                F.lit(key[0]).alias("mode"),
                F.lit(key[1] or "Unknown").alias("map_name"),
                rounded(f"_{j}_prob_a", 1).alias("team_a_probability"),
                rounded(f"_{j}_prob_b", 1).alias("team_b_probability"),
                F.when(F.col(f"_{j}_a_wins"), F.col("team_a"))
                .otherwise(F.col("team_b"))
                .alias("predicted_winner"),
                F.col(f"_{j}_margin").alias("confidence"),
                F.col(f"_{j}_quality").alias("data_quality"),
            )
        )
    df = with_series_result(df, wins, slots, p.first_to, "map_predictions")
    maps = F.col("map_predictions")
    n = F.size(maps)
    total = F.aggregate(maps, F.lit(0.0), lambda acc, x: acc + x["confidence"])
    points = F.aggregate(
        maps, F.lit(0.0), lambda acc, x: acc + quality_points(x["data_quality"])
    )
    return df.withColumns(
        {
            "confidence": rounded(total / n, 1),
            "data_quality": mean_quality(points / n),
            "maps_predicted": n,
        }
    ).select(
        *fixtures.columns, "predicted_winner", "predicted_score", "team_a_map_wins",
        "team_b_map_wins", "confidence", "data_quality", "map_predictions", "maps_predicted",
    )


# ---- series length ----------------------------------------------------------


def _choose(n: int, k: int) -> int:
    from math import comb

    return comb(n, k)


def series_win(p_map: Column, wins: int) -> Column:
    """Chance of winning a first-to-``wins`` series at map probability p."""
    q = F.lit(1.0) - p_map
    total = F.lit(0.0)
    for k in range(wins):
        total = total + F.pow(p_map, F.lit(wins)) * F.pow(q, F.lit(k)) * float(
            _choose(wins - 1 + k, k)
        )
    return total


def implied_map_probability(series_prob: Column, wins: int, steps: int = 40) -> Column:
    """Map probability that gives the series probability, by repeated halving."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def halve(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2.0
        low = series_win(mid, wins) < series_prob
        return F.struct(
            F.when(low, mid).otherwise(acc["lo"]).alias("lo"),
            F.when(low, acc["hi"]).otherwise(mid).alias("hi"),
        )

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda acc: (acc["lo"] + acc["hi"]) / 2.0
    )


def convert_series_length(
    df: DataFrame, prob_a: str = "team_a_probability", wins_from: int = 3, wins_to: int = 4
) -> DataFrame:
    """From a first-to-3 percentage to a longer series: probability and likeliest score."""
    df = df.withColumn("map_probability_a", implied_map_probability(F.col(prob_a) / 100.0, wins_from))
    pa = F.col("map_probability_a")
    df = df.withColumn("long_probability_a", series_win(pa, wins_to) * 100.0)
    # equal chances (one half exactly) must not be decided by the last digit of a double
    a_ahead = F.col("long_probability_a") > 50.0 + 1e-6
    fav = F.when(a_ahead, pa).otherwise(1.0 - pa)
    scores = [
        F.struct(
            rounded(
                F.pow(fav, F.lit(wins_to))
                * F.pow(1.0 - fav, F.lit(k))
                * float(_choose(wins_to - 1 + k, k))
                * 100.0,
                8,
            ).alias("chance"),
            F.lit(f"{wins_to}-{k}").alias("score"),
        )
        for k in range(wins_to)
    ]
    return (
        df.withColumn("_best", F.array_max(F.array(*scores)))
        .withColumns(
            {
                "long_winner": F.when(a_ahead, F.col("team_a")).otherwise(F.col("team_b")),
                "long_score": F.col("_best")["score"],
                "long_score_probability": F.col("_best")["chance"],
                "long_confidence": F.abs(F.col("long_probability_a") * 2.0 - 100.0),
            }
        )
        .drop("_best")
    )


def compare_metrics(df: DataFrame) -> DataFrame:
    """'>', '<' or '=' of team_a against team_b per metric."""
    def sign(metric):
        a, b = F.col(f"a_{metric}"), F.col(f"b_{metric}")
        return F.when(a > b, ">").when(b > a, "<").otherwise("=")

    return df.withColumns(
        {f"cmp_{m}": sign(m) for m in ("win_rate", "map_win_rate", "avg_kd", "avg_rating")}
    )


def expected_score(rating_a, rating_b, p: ModelParams = DEFAULTS) -> Column:
    """Win probability of a from two ratings."""
    gap = (as_lit(rating_b) - as_lit(rating_a)) / p.rating_scale
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), gap))


