"""Point-in-time and ordered operators that survive hot keys.

A plain ``Window.partitionBy(key)`` puts all rows of a key into one task. Everything here
first reduces a key to at most one row per day (or per bucket), so the per-key window
only ever sees the calendar, however many rows the key has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.params import DEFAULTS, ModelParams

# the exponents of a block of days stay below this, far inside the range of doubles
BLOCK_EXPONENT = 300.0


def day_number(day) -> Column:
    return F.unix_date(F.col(day) if isinstance(day, str) else day)


def asof_sums(
    events: DataFrame,
    probes: DataFrame,
    keys: list[str],
    day: str,
    sums: dict[str, tuple[Column, int]],
    carry: list[str] | None = None,
) -> DataFrame:
    """Running sums of events as seen from probe days.

    For every distinct probe (keys, day, carry) and every ``name: (value, lag)`` the sum of
    ``value`` over the events of the same keys that are at least ``lag`` days older.
    Events are summed per day before they are shuffled to their key; the frames are
    running sums, so the cost is linear in days. ``carry`` columns ride along with the
    probe, which saves the join back.
    """
    carry = carry or []
    values = {f"_v{i}": value for i, (value, _) in enumerate(sums.values())}
    daily = (
        events.filter(F.col(day).isNotNull())  # undated events are not earlier than any day
        .select(*keys, day_number(day).alias("_d"), *[v.alias(n) for n, v in values.items()])
        .groupBy(*keys, "_d")
        .agg(*[F.sum(n).alias(n) for n in values])
        .withColumn("_probe", F.lit(False))
    )
    asked = (
        probes.select(*keys, *carry, day_number(day).alias("_d"))
        .distinct()
        .withColumn("_probe", F.lit(True))
    )
    order = Window.partitionBy(*keys).orderBy("_d")
    merged = daily.unionByName(asked, allowMissingColumns=True)
    out = [
        F.sum(f"_v{i}").over(order.rangeBetween(Window.unboundedPreceding, -lag)).alias(name)
        for i, (name, (_, lag)) in enumerate(sums.items())
    ]
    return (
        merged.select(*keys, *carry, "_d", "_probe", *out)
        .filter("_probe")
        .select(
            *keys,
            *carry,
            F.date_from_unix_date("_d").alias(day),
            *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in sums],
        )
    )


def asof_decayed(
    events: DataFrame,
    probes: DataFrame,
    keys: list[str],
    day: str,
    values: list[str],
    p: ModelParams = DEFAULTS,
    carry: list[str] | None = None,
) -> DataFrame:
    """Decayed sums of ``values`` over strictly earlier events, for every distinct probe.

    A decayed sum is a difference of two running sums of ``value * exp(rate * day)`` while the
    decay is above its floor, and the floor times a plain sum beyond. Days are counted from the
    origin of their block, so a running sum is a mantissa beside the origin of its block and no
    exponent grows with the calendar, whatever the half-life. What reaches over the end of
    a block stands in the next one too, re-based to its origin.
    """
    carry = carry or []
    beyond = p.decay_horizon + 1
    length = max(beyond, int(BLOCK_EXPONENT / p.decay_rate))
    d, block = F.col("_d"), F.col("_b")
    origin = block * length

    def number(name):
        return F.floor(name / F.lit(length)).cast("int")

    daily = (
        events.filter(F.col(day).isNotNull()).select(*keys, day_number(day).alias("_d"), *values)
        .groupBy(*keys, "_d").agg(*[F.sum(v).alias(v) for v in values])
        .withColumn("_o", number(d))
        .withColumn("_b", F.explode(
            F.when(number(d + beyond) > F.col("_o"), F.array("_o", F.col("_o") + 1)).otherwise(F.array("_o"))
        ))
    )
    grown = F.exp((d - origin) * F.lit(p.decay_rate))
    daily = daily.select(
        *keys, "_d", "_b", F.lit(False).alias("_probe"),
        *[(F.col(v) * grown).alias(f"_x{i}") for i, v in enumerate(values)],
        *[F.when(block == F.col("_o"), F.col(v)).alias(f"_v{i}") for i, v in enumerate(values)],
    )
    asked = (
        probes.select(*keys, *carry, day_number(day).alias("_d")).distinct()
        .withColumn("_b", number(d)).withColumn("_probe", F.lit(True))
    )
    # both windows use the partitioning of one shuffle
    inside = Window.partitionBy(*keys, "_b").orderBy("_d")
    overall = Window.partitionBy(*keys).orderBy("_d")
    first = Window.unboundedPreceding
    sums = {}
    for i, _ in enumerate(values):
        sums[f"_s{i}"] = F.sum(f"_v{i}").over(overall.rangeBetween(first, -beyond))
    for i, _ in enumerate(values):
        sums[f"_e{i}"] = F.sum(f"_x{i}").over(inside.rangeBetween(first, -1))
        sums[f"_f{i}"] = F.sum(f"_x{i}").over(inside.rangeBetween(first, -beyond))
    shrunk = F.exp((d - origin) * F.lit(-p.decay_rate))

    def zero(name):
        return F.coalesce(F.col(name), F.lit(0.0))

    return (
        daily.unionByName(asked, allowMissingColumns=True).withColumns(sums).filter("_probe")
        .select(
            *keys, *carry, F.date_from_unix_date("_d").alias(day),
            *[
                (shrunk * (zero(f"_e{i}") - zero(f"_f{i}")) + zero(f"_s{i}") * p.decay_floor).alias(v)
                for i, v in enumerate(values)
            ],
        )
    )


def asof_recent(
    events: DataFrame,
    probes: DataFrame,
    keys: list[str],
    day: str,
    order: list[str],
    payload: list[str],
    k: int,
    out: str = "recent",
    carry: list[str] | None = None,
) -> DataFrame:
    """The k newest events strictly before each probe day, newest first, as one array.

    ``order`` breaks ties inside a day. A day keeps its newest k events (limited before
    the shuffle), and a day's history is at most the k days up to it.
    """
    carry = carry or []
    inside = Window.partitionBy(*keys, day).orderBy(*[F.desc(c) for c in order])
    newest = (
        events.select(*keys, day, *order, *[c for c in payload if c not in order])
        .withColumn("_rn", F.row_number().over(inside))
        .filter(F.col("_rn") <= k)
    )
    entry = F.struct("_rn", F.col(day).alias("day"), *[F.col(c) for c in order], *[
        F.col(c) for c in payload if c not in order
    ])
    daily = newest.groupBy(*keys, day).agg(F.sort_array(F.collect_list(entry)).alias("_day"))
    asked = probes.select(*keys, day, *carry).distinct().withColumn("_kind", F.lit(0))
    rows = daily.withColumn("_kind", F.lit(1)).unionByName(asked, allowMissingColumns=True)
    # ordinal of the event day; on one day the probe comes first, so its ordinal is that of
    # the last strictly earlier day. Both windows use the partitioning of one shuffle.
    forward = Window.partitionBy(*keys).orderBy(day, "_kind")
    ordinal = F.count("_day").over(forward.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy(*keys).orderBy(F.desc("_e")).rangeBetween(0, k - 1)
    return (
        rows.withColumn("_e", ordinal)
        .withColumn("_all", F.collect_list("_day").over(back))
        .filter(F.col("_kind") == 0)
        .select(*keys, day, *carry, F.slice(F.flatten("_all"), 1, k).alias(out))
    )


def asof_latest(
    events: DataFrame, probes: DataFrame, keys: list[str], day: str, order: list[str],
    payload: list[str],
) -> DataFrame:
    """The newest event strictly before each probe day (null where there is none)."""
    entry = F.struct(*[F.col(c) for c in payload])
    daily = events.groupBy(*keys, day).agg(
        F.max_by(entry, F.struct(*[F.col(c) for c in order])).alias("_e")
    )
    asked = probes.select(*keys, day).distinct().withColumn("_kind", F.lit(0))
    forward = Window.partitionBy(*keys).orderBy(day, "_kind")
    seen = F.last("_e", ignorenulls=True).over(forward.rowsBetween(Window.unboundedPreceding, -1))
    return (
        daily.withColumn("_kind", F.lit(1))
        .unionByName(asked, allowMissingColumns=True)
        .withColumn("_e", seen)
        .filter(F.col("_kind") == 0)
        .select(*keys, day, *[F.col("_e")[c].alias(c) for c in payload])
    )


def running_number(
    df: DataFrame, keys: list[str], bucket: Column, order: list, name: str
) -> DataFrame:
    """1-based position inside a group, computed per (group, bucket) plus an offset.

    ``bucket`` must be non-decreasing in ``order``, for example the day or the month.
    """
    rows = df.withColumn("_b", bucket)
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    over_buckets = Window.partitionBy(*keys).orderBy("_b") if keys else Window.orderBy("_b")
    offsets = (
        rows.groupBy(*keys, "_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
            F.col("_b").alias("_bk"),
            F.coalesce(
                F.sum("_n").over(over_buckets.rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ).alias("_before"),
        )
    )
    on = F.col("_b").eqNullSafe(F.col("_bk"))
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"_k{i}"))
    numbered = rows.withColumn("_rn", F.row_number().over(inside)).join(offsets, on)
    return numbered.withColumn(name, F.col("_rn") + F.col("_before")).drop(
        "_rn", "_before", "_b", "_bk", *[f"_k{i}" for i in range(len(keys))]
    )


def bounded_window(
    df: DataFrame,
    keys: list[str],
    bucket: Column,
    order: list[str],
    reach: int,
    build: Callable[[Window], dict[str, Column]],
) -> DataFrame:
    """Window functions that look back at most ``reach`` rows.

    Every (key, bucket) is its own window partition; it is given the last ``reach`` rows
    of the earlier buckets so that frames at its start are complete.
    """
    columns = df.columns
    rows = df.withColumn("_b", bucket)
    newest = Window.partitionBy(*keys, "_b").orderBy(*[F.desc(c) for c in order])
    tails = (
        rows.withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") <= reach)
        .groupBy(*keys, "_b")
        .agg(
            F.sort_array(
                F.collect_list(F.struct((-F.col("_rn")).alias("_o"), F.struct(*columns).alias("_r")))
            ).alias("_tail")
        )
    )
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(-reach, -1)
    merged = F.flatten(F.collect_list("_tail").over(earlier))
    last_ones = F.slice(
        F.col("_m"), F.greatest(F.size("_m") - F.lit(reach - 1), F.lit(1)), F.lit(reach)
    )
    halo = (
        tails.select("_b", merged.alias("_m"))
        .filter(F.size("_m") > 0)
        .select("_b", F.explode(last_ones).alias("_x"))
        .select("_x._r.*", "_b", F.lit(True).alias("_halo"))
    )
    window = Window.partitionBy(*keys, "_b").orderBy(*order)
    full = rows.withColumn("_halo", F.lit(False)).unionByName(halo)
    built = build(window)
    return (
        full.withColumns(built).filter(~F.col("_halo")).select(*columns, *built.keys())
    )
