"""Map pool at a point in time: the maps two rosters have played most before their fixture.

What a roster has played of a map is a sum over its players, so a running count per (team, player,
map) answers every roster and day. Plays travel once per roster and day; players are told apart
inside a (team, block of days): a block holds a bounded number of plays, gets the counts at its start,
and reads off the played maps of each probe. All pairs of a day then meet the lists of that day in
one group, where two sides are added up as arrays; no list is copied to the pairs that need it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from matchlake.functions.scalar import roster_of, rounded
from matchlake.operators.asof import day_number
from matchlake.operators.perspective import mode_list, sides
from matchlake.params import DEFAULTS, ModelParams
from matchlake.sources.store import staged

#: Daily counts of a team in one block; a block ends with a month.
BLOCK_PLAYS = 50_000
#: Pairs of a day that meet in one group, about; days with more are cut into parts.
PAIRS_AT_ONCE = 20_000
#: Maps at the head of each list that are added up before the threshold is looked at.
PREFIX = 6
#: Numbers of one array of sums or counts; larger ones are worked out piece by piece.
CELLS_AT_ONCE = 1_000_000

PAIR = ["team_a", "a_roster_key", "team_b", "b_roster_key", "as_of_date"]
#: What has been played of each map, one entry per (mode, map).
_PLAYED = "modes array<int>, names array<string>, plays array<double>, won array<double>"
#: One entry per slot, modes after each other, in a mode most played first; ``firsts`` has one per mode.
_PICKED = (
    "names array<string>, a_plays array<double>, b_plays array<double>, a_won array<double>, b_won array<double>, "
    "firsts array<string>"
)


def _blocked(plays: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with the block of their day; blocks follow the months of a team."""
    month = F.trunc(F.date_from_unix_date("day"), "month").alias("month")
    seen = plays.select("team", month, F.lit(1).alias("n"))
    asked = probes.select("team", month, F.lit(0).alias("n"))
    before = Window.partitionBy("team").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    blocks = staged(
        seen.unionByName(asked).groupBy("team", "month").agg(F.sum("n").alias("n"))
        .withColumn("block", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / F.lit(BLOCK_PLAYS)).cast("int"))
        .drop("n")
    )
    put = [df.withColumn("month", month).join(blocks, ["team", "month"]).drop("month") for df in (plays, probes)]
    return put[0], put[1]


def _codes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, list]:
    """(place of every value among the sorted distinct values, those values); nulls are at -1."""
    coded = pc.dictionary_encode(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    values = coded.dictionary.to_pylist()
    order = sorted(range(len(values)), key=values.__getitem__)
    place = np.full(len(values) + 1, -1)
    place[order] = np.arange(len(values))
    return place[pc.fill_null(coded.indices, len(values)).to_numpy(zero_copy_only=False)], [values[i] for i in order]


def _lists(values: pa.Array, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _played_block(rows: pa.Table, size: float, schema: pa.Schema) -> pa.Table:
    """Played maps of the probes (kind 2) of a block from its start (0) and its plays (1)."""
    kind = rows["kind"].to_numpy()
    who, keys = _codes(rows["who"])
    named, names = _codes(rows["map_name"])
    rosters = [list(dict.fromkeys(k.split("|"))) for k in keys]
    players = {p: i for i, p in enumerate(dict.fromkeys(p for r in rosters for p in r))}
    seats = [np.array([players[p] for p in r], np.int64) for r in rosters]
    counts = np.flatnonzero(kind < 2)
    cells, cell = np.unique(rows["mode"].to_numpy()[counts] * max(len(names), 1) + named[counts], return_inverse=True)
    day = np.where(kind == 0, np.iinfo(np.int64).min, rows["day"].to_numpy().astype(np.int64))
    order = np.argsort(day[counts], kind="stable")
    counts, cell = counts[order], cell[order]
    # a row of a roster counts for each of its players
    many = np.array([len(x) for x in seats], np.int64)
    first = np.cumsum(many) - many
    times = many[who[counts]]
    begins = np.concatenate([[0], np.cumsum(times)])
    seat = np.arange(begins[-1]) - np.repeat(begins[:-1] - first[who[counts]], times)
    at = np.concatenate([*seats, np.zeros(0, np.int64)])[seat] * len(cells) + np.repeat(cell, times)
    added = [np.repeat(rows[c].to_numpy()[counts].astype(float), times) for c in ("plays", "won")]
    state = np.zeros((2, len(players), len(cells)))
    flat = state.reshape(2, -1)
    probes = np.flatnonzero(kind == 2)
    probes = probes[np.argsort(day[probes], kind="stable")]
    upto = begins[np.searchsorted(day[counts], day[probes], side="left")]  # strictly earlier days
    step, done, out = max(1, CELLS_AT_ONCE // max(len(cells), 1)), 0, []
    for low in range(0, len(probes), step):
        some = probes[low : low + step]
        seen = np.empty((len(some), 2, len(cells)))
        for i, (probe, to) in enumerate(zip(some, upto[low : low + step])):
            if to > done:
                for k in (0, 1):
                    np.add.at(flat[k], at[done:to], added[k][done:to])
                done = to
            seen[i] = state[:, seats[who[probe]]].sum(axis=1)
        of, what = np.nonzero(seen[:, 0] > 0)
        lengths = np.bincount(of, minlength=len(some))
        code = cells[what]
        values = (
            pa.array(code // max(len(names), 1), pa.int32()), pa.array(names, pa.string()).take(pa.array(code % max(len(names), 1))),
            pa.array(seen[of, 0, what] / size), pa.array(seen[of, 1, what] / size),
        )
        mine = rows.take(pa.array(some))
        out.append(pa.Table.from_arrays(
            [mine["team"], mine["who"], mine["day"], mine["part"], *[_lists(v, lengths) for v in values]], schema.names
        ).cast(schema))
    return pa.concat_tables(out) if out else schema.empty_table()


def played_asof(map_history: DataFrame, probes: DataFrame, p: ModelParams = DEFAULTS) -> DataFrame:
    """Maps of the scored modes with weighted plays and wins, per probe (team, roster_key, as_of_date, part).

    Lists hold what has been played, in no order; modes are numbers. Only earlier days count; a roster that has
    played nothing has empty lists.
    """
    number = F.coalesce(*[F.when(F.col("mode") == m, F.lit(i)) for i, m in enumerate(mode_list(p))])
    known = map_history.filter(F.col("match_date").isNotNull() & (F.col("roster_key") != ""))
    cell = ["team", "roster_key", "mode", "map_name"]
    plays = (
        known.select("team", "roster_key", number.alias("mode"), "map_name", day_number("match_date").alias("day"), "won")
        .filter(F.col("mode").isNotNull())
        .groupBy(*cell, "day").agg(F.count(F.lit(1)).alias("plays"), F.sum("won").cast("long").alias("won"))
    )
    asked = (
        probes.filter((F.col("roster_key") != "") & F.col("as_of_date").isNotNull())
        .select("team", "roster_key", day_number("as_of_date").alias("day"), "part").distinct()
    )
    plays, asked = _blocked(staged(plays), staged(asked))
    # counts at the start of a block: what the cell has added up to in the last block it was played in
    added = (
        plays.groupBy(*cell, "block").agg(F.sum("plays").alias("plays"), F.sum("won").alias("won"))
        .withColumn("who", F.explode(F.array_distinct(roster_of("roster_key"))))
        .groupBy("team", "who", "mode", "map_name", "block").agg(F.sum("plays").alias("plays"), F.sum("won").alias("won"))
    )
    last = asked.groupBy("team").agg(F.max("block").alias("last"))
    along = Window.partitionBy("team", "who", "mode", "map_name").orderBy("block")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    carried = (
        added.withColumns({
            "plays": F.sum("plays").over(upto), "won": F.sum("won").over(upto), "next": F.lead("block").over(along),
        })
        .join(last, "team").withColumn("until", F.coalesce("next", "last")).filter(F.col("until") > F.col("block"))
        .withColumn("block", F.explode(F.sequence(F.col("block") + 1, F.col("until"))))
    )
    columns = ["team", "block", "kind", "day", "part", "who", "mode", "map_name", "plays", "won"]
    zero = F.lit(0)
    rows = (
        carried.withColumns({"kind": zero, "day": zero, "part": zero}).select(*columns)
        .unionByName(plays.withColumns({"kind": F.lit(1), "part": zero, "who": F.col("roster_key")}).select(*columns))
        .unionByName(asked.withColumns({
            "kind": F.lit(2), "who": F.col("roster_key"), "mode": zero, "map_name": F.lit(None).cast("string"),
            "plays": zero.cast("long"), "won": zero.cast("long"),
        }).select(*columns))
    )
    kinds = f"team string, roster_key string, day int, part int, {_PLAYED}"
    arrow, size = _arrow(rows, kinds), float(p.roster_size)

    def played(block: pa.Table) -> pa.Table:
        return _played_block(block, size, arrow)

    listed = rows.groupBy("team", "block").applyInArrow(played, kinds)
    return listed.withColumn("day", F.date_from_unix_date("day")).withColumnRenamed("day", "as_of_date")


def _arrow(df: DataFrame, kinds: str) -> pa.Schema:
    return to_arrow_schema(df.sparkSession.createDataFrame([], kinds).schema)


def _most_played(plays: np.ndarray, known: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """The k known columns with the most plays of rows a and b together, -1 where there are fewer.

    Equal plays go by column. Threshold merge: the columns at the head of any row are added up; they hold
    the answer if the k-th of them has more plays than the next entries of both rows together, because no
    column behind can have more. Otherwise all columns are added up.
    """

    def best(pairs: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, least = np.full((len(pairs), k), -1), np.full(len(pairs), -1.0)
        step = max(1, CELLS_AT_ONCE // max(len(columns), 1))
        for low in range(0, len(pairs) if len(columns) else 0, step):
            some = pairs[low : low + step]
            total = plays[np.ix_(a[some], columns)] + plays[np.ix_(b[some], columns)]
            total[:, ~known[columns]] = -1
            here = np.arange(len(some))
            for j in range(k):
                at = total.argmax(axis=1)
                least[low : low + step] = value = total[here, at]
                out[low : low + step, j] = np.where(value >= 0, columns[at], -1)
                total[here, at] = -1
        return out, least

    everything, width = np.arange(len(a)), plays.shape[1]
    if width <= PREFIX:
        return best(everything, np.arange(width))[0]
    ranked = np.argpartition(-plays, PREFIX, axis=1)
    behind = plays[np.arange(len(plays)), ranked[:, PREFIX]]
    heads = np.unique(ranked[:, :PREFIX])
    out, least = best(everything, heads)
    if len(heads) < width:
        unsettled = np.flatnonzero(least <= behind[a] + behind[b])
        out[unsettled] = best(unsettled, np.arange(width))[0]
    return out


def _pick(pairs: pa.Table, lists: pa.Table, need: list[int], schema: pa.Schema) -> pa.Table:
    """Maps of the pairs of one day; of the lists that without a team is the pool of the day."""
    if not pairs.num_rows:
        return schema.empty_table()
    sides_of = list(zip(lists["team"].to_pylist(), lists["roster_key"].to_pylist()))
    place = {x: i for i, x in enumerate(sides_of) if x[0] is not None}
    pool = next((i for i, x in enumerate(sides_of) if x[0] is None), len(sides_of))
    a, b = (
        np.array([place.get(x, len(sides_of)) for x in zip(pairs[f"team_{s}"].to_pylist(), pairs[f"{s}_roster_key"].to_pylist())])
        for s in "ab"
    )
    parts = {c: lists[c].combine_chunks().flatten() for c in ("modes", "names", "plays", "won")}
    owner = np.repeat(np.arange(len(sides_of)), pc.list_value_length(lists["modes"]).to_numpy())
    mode, (named, names) = parts["modes"].to_numpy(), _codes(parts["names"])
    values = {c: [] for c in ("names", "a_plays", "b_plays", "a_won", "b_won")}
    firsts, label = [], np.array([*names, None], object)
    for i, k in enumerate(need):
        here = np.flatnonzero(mode == i)
        # the columns are the maps of the mode; the last row is a side that has played nothing
        maps, column = np.unique(named[here], return_inverse=True)
        dense = {c: np.zeros((len(sides_of) + 1, len(maps))) for c in ("plays", "won")}
        for c in dense:
            dense[c][owner[here], column] = parts[c].to_numpy()[here]
        known = np.zeros(len(maps), bool)
        known[column[owner[here] == pool]] = True
        best = _most_played(dense["plays"], known, a, b, k)
        found, at = best >= 0, np.maximum(best, 0)
        values["names"].append(label[np.where(found, maps[at] if len(maps) else -1, -1)])
        for c in dense:
            for s, row in (("a", a), ("b", b)):
                values[f"{s}_{c}"].append(np.where(found, dense[c][row[:, None], at], 0.0) if len(maps) else np.zeros(at.shape))
        firsts.append(names[maps[known.argmax()]] if known.any() else None)
    n = pairs.num_rows
    slots = [_lists(pa.array(np.concatenate(v, axis=1).ravel(), schema.field(c).type.value_type), np.full(n, sum(need))) for c, v in values.items()]
    return pa.Table.from_arrays(
        [*[pairs[c] for c in PAIR], *slots, _lists(pa.array(firsts * n, pa.string()), np.full(n, len(need)))], schema.names
    ).cast(schema)


def _picker(need: list[int], schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    return lambda pairs, lists: _pick(pairs, lists, need, schema)


def pools_asof(pairs: DataFrame, map_history: DataFrame, p: ModelParams = DEFAULTS) -> DataFrame:
    """``predicted_maps`` per distinct pair: per slot of a series the most played unused map before its day.

    Pairs have team_a, team_b, as_of_date and the roster keys of both sides (null: nothing
    played). The pool of a day are the maps anyone has played before; unplayed ones follow by name,
    and when the pool is used up its first map comes again.
    """
    modes = mode_list(p)
    need = [p.series_modes.count(m) for m in modes]
    pairs = staged(pairs.select(*PAIR).distinct())
    parts = pairs.groupBy(F.col("as_of_date").alias("_day")).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(PAIRS_AT_ONCE)).cast("int").alias("_parts")
    )
    pairs = pairs.join(parts, F.col("as_of_date").eqNullSafe(F.col("_day"))).select(
        *PAIR, F.pmod(F.xxhash64(*PAIR), F.col("_parts")).cast("int").alias("part")
    )
    seats = sides(pairs, {"team": ("team_a", "team_b"), "roster_key": ("a_roster_key", "b_roster_key")}, ["as_of_date", "part"])
    number = F.coalesce(*[F.when(F.col("mode") == m, F.lit(i)) for i, m in enumerate(modes)])
    pool = (
        map_history.filter(F.col("match_date").isNotNull() & F.col("mode").isin(modes))
        .groupBy(number.alias("mode"), "map_name").agg(F.min("match_date").alias("first"))
        .agg(F.collect_list(F.struct("mode", "map_name", "first")).alias("pool"))
    )
    known = F.filter("_all", lambda e: e["first"] < F.col("as_of_date"))
    none = F.lit(None).cast("string")
    zeros = F.transform("pool", lambda e: F.lit(0.0))
    days = pairs.select("as_of_date", "part").distinct().withColumn("_all", pool.scalar()).withColumn("pool", known).select(
        none.alias("team"), none.alias("roster_key"), "as_of_date", "part",
        F.transform("pool", lambda e: e["mode"]).alias("modes"), F.transform("pool", lambda e: e["map_name"]).alias("names"),
        zeros.alias("plays"), zeros.alias("won"),
    ).filter(F.size("modes") > 0)
    kinds = f"team_a string, a_roster_key string, team_b string, b_roster_key string, as_of_date date, {_PICKED}"
    lists = played_asof(map_history, seats, p).unionByName(days)
    picked = pairs.groupBy("as_of_date", "part").cogroup(lists.groupBy("as_of_date", "part")).applyInArrow(
        _picker(need, _arrow(pairs, kinds)), kinds
    )
    used: dict[str, int] = {}
    slots = []
    for slot, mode in enumerate(p.series_modes, 1):
        i, k = modes.index(mode), used.get(mode, 0)
        used[mode] = k + 1
        at = F.lit(sum(need[:i]) + k)
        name, first = F.get("names", at), F.get("firsts", F.lit(i))

        def rate(s, at=at):
            n = F.get(f"{s}_plays", at)
            return F.when(n > 0, F.get(f"{s}_won", at) / n * 100.0).otherwise(50.0)

        plays = F.get("a_plays", at) + F.get("b_plays", at)
        figures = {
            "team_a_winrate": rounded(rate("a"), 1), "team_b_winrate": rounded(rate("b"), 1),
            "team_a_plays": rounded(F.get("a_plays", at), 1), "team_b_plays": rounded(F.get("b_plays", at), 1),
            "advantage_a": (rate("a") - rate("b")) * (F.least(plays, F.lit(10.0)) / 10.0),
        }
        slots.append(F.struct(
            F.lit(slot).alias("map_number"), F.lit(mode).alias("mode"),
            F.coalesce(name, first, F.lit("Unknown")).alias("predicted_map"),
            *[F.when(name.isNotNull(), v).alias(c) for c, v in figures.items()],
            F.when(name.isNotNull() & (plays > 0), F.lit("most played")).when(name.isNotNull(), F.lit("unplayed"))
            .when(first.isNotNull(), F.lit("pool used up")).otherwise(F.lit("no map data")).alias("reason"),
        ))
    return picked.select(*PAIR, F.array(*slots).alias("predicted_maps"))


def with_map_pool_asof(fixtures: DataFrame, map_history: DataFrame, p: ModelParams = DEFAULTS) -> DataFrame:
    """Adds ``predicted_maps`` of ``pools_asof`` to fixtures that have the columns of a pair."""
    done = pools_asof(fixtures, map_history, p).select(
        *[F.col(c).alias(f"_k{j}") for j, c in enumerate(PAIR)], "predicted_maps"
    )
    same = F.lit(True)
    for j, c in enumerate(PAIR):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{j}"))
    return fixtures.join(done, same).drop(*[f"_k{j}" for j in range(len(PAIR))])
