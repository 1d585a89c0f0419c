"""Ordered operators against brute force, with one key holding most of the rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from matchlake.operators import asof as A

DAY0 = dt.date(2020, 1, 1)


def events(n=600, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}"
        rows.append((key, DAY0 + dt.timedelta(days=rng.randrange(90)), i, rng.randrange(10)))
    return rows


SCHEMA = "k string, day date, id int, v int"


def test_asof_sums(spark):
    rows = events()
    df = spark.createDataFrame(rows, SCHEMA)
    probes = df.select("k", "day", (F.col("id") % 3).alias("tag"))
    got = A.asof_sums(df, probes, ["k"], "day", {"s1": (F.col("v"), 1), "s9": (F.col("v"), 9)}, ["tag"]).collect()
    assert len(got) == len({(r[0], r[1], r[2] % 3) for r in rows})
    for r in got:
        mine = [(x[1], x[3]) for x in rows if x[0] == r.k]
        assert r.s1 == sum(v for d, v in mine if d < r.day)
        assert r.s9 == sum(v for d, v in mine if (r.day - d).days >= 9)


def test_asof_recent(spark):
    rows = events()
    df = spark.createDataFrame(rows, SCHEMA)
    asked = df.select("k", (F.col("day") + 1).alias("day")).union(df.select("k", "day"))
    got = A.asof_recent(df, asked, ["k"], "day", ["id"], ["v"], 4).collect()
    for r in got:
        mine = sorted(((x[1], x[2]) for x in rows if x[0] == r.k and x[1] < r.day), reverse=True)
        assert [(x["day"], x["id"]) for x in (r.recent or [])] == mine[:4]


def test_asof_latest(spark):
    rows = events()
    df = spark.createDataFrame(rows, SCHEMA)
    got = A.asof_latest(df, df.select("k", "day"), ["k"], "day", ["id"], ["id", "v"]).collect()
    for r in got:
        mine = [(x[1], x[2]) for x in rows if x[0] == r.k and x[1] < r.day]
        assert r.id == (max(mine)[1] if mine else None)


def test_running_number(spark):
    rows = events()
    df = spark.createDataFrame(rows, SCHEMA)
    got = A.running_number(df, ["k"], F.col("day"), ["day", "id"], "no").collect()
    for r in got:
        mine = sorted((x[1], x[2]) for x in rows if x[0] == r.k)
        assert r.no == mine.index((r.day, r.id)) + 1
    everywhere = A.running_number(df, [], F.col("day"), ["day", "id"], "no").collect()
    assert sorted(r.no for r in everywhere) == list(range(1, len(rows) + 1))


def test_bounded_window(spark):
    rows = events()
    df = spark.createDataFrame(rows, SCHEMA)
    got = A.bounded_window(
        df, ["k"], F.trunc("day", "month"), ["day", "id"], 7,
        lambda w: {"s": F.sum("v").over(w.rowsBetween(-6, 0))},
    ).collect()
    assert len(got) == len(rows)
    for r in got:
        mine = sorted((x[1], x[2], x[3]) for x in rows if x[0] == r.k)
        i = mine.index((r.day, r.id, r.v))
        assert r.s == sum(x[2] for x in mine[max(0, i - 6): i + 1])


def test_windows_limit_rows_before_the_shuffle(spark):
    df = spark.createDataFrame(events(), SCHEMA)
    plan = A.asof_recent(df, df, ["k"], "day", ["id"], ["v"], 4)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
