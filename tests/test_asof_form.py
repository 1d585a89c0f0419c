import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from matchlake.operators import history as H
from matchlake.operators.asof import asof_decayed
from matchlake.params import ModelParams

DAY0 = datetime.date(2026, 1, 1)


def rows(seed, sizes, days=400, start=DAY0):
    r = random.Random(seed)
    out = []
    for i in range(300):
        t = r.choice("AAB")
        roster = sorted(r.sample([f"{t}{k}" for k in range(12)], r.choice(sizes)))
        out.append((i, t, roster, "|".join(roster), start + datetime.timedelta(days=r.randrange(days)), r.randrange(2), 5, r.randrange(6)))
    return out


SCHEMA = "match_id int, team string, roster array<string>, roster_key string, match_date date, won int, maps_played int, maps_won int"


@pytest.mark.parametrize("sizes", [(4,), (6,), (9,), (1, 4, 6, 9)])
def test_matches_played_with_rosters_of_any_size(spark, sizes):
    data = rows(sum(sizes), sizes)
    df = spark.createDataFrame(data, SCHEMA)
    got = {(r.team, r.roster_key, r.as_of_date): r.n for r in H.matches_played_asof(df, H.side_probes(df)).collect()}
    assert len(got) == len({(r[1], r[3], r[4]) for r in data})
    for (team, key, day), n in got.items():
        mine = set(key.split("|"))
        assert n == sum(1 for r in data if r[1] == team and r[4] < day and mine & set(r[2])), (team, key, day)


def test_links_are_not_repeated(spark):
    df = spark.createDataFrame(rows(7, (6, 9)), SCHEMA)
    links = H.roster_links(df, H.side_probes(df))
    assert links.count() == links.distinct().count()


@pytest.mark.parametrize("half_life,floor,start,days", [
    (30, 0.01, DAY0, 400), (7, 0.01, DAY0, 400), (7, 0.01, datetime.date(1901, 1, 1), 60_000), (1, 0.5, DAY0, 900),
    (7, 1e-40, DAY0, 3000), (0.2, 0.001, DAY0, 3000),
])
def test_decay_at_any_half_life(spark, half_life, floor, start, days):
    p = ModelParams(decay_rate=math.log(2) / half_life, decay_floor=floor)
    r = random.Random(3)
    events = [(r.choice("xy"), start + datetime.timedelta(days=r.randrange(days)), float(r.randrange(5))) for _ in range(500)]
    events += [("x", None, 100.0)]
    probes = [(r.choice("xyz"), start + datetime.timedelta(days=r.randrange(days + 50))) for _ in range(150)]
    got = asof_decayed(
        spark.createDataFrame(events, "k string, day date, v double"), spark.createDataFrame(probes, "k string, day date"),
        ["k"], "day", ["v"], p,
    ).collect()
    assert len(got) == len(set(probes))
    for row in got:
        direct = sum(
            v * min(1.0, max(floor, math.exp(-p.decay_rate * (row.day - d).days)))
            for k, d, v in events if k == row.k and d and d < row.day
        )
        assert math.isclose(row.v, direct, rel_tol=1e-9, abs_tol=1e-9), (row, direct)


def test_form_in_one_pass_equals_its_parts(spark, tables):
    probes = H.side_probes(tables.form_history).filter(F.col("team") == "L1-T1")
    form = H.form_asof(tables.form_history, tables.player_match_stats, tables.matches, probes)
    parts = H.weighted_record_asof(tables.form_history, probes).join(
        H.mode_stats_asof(tables.form_history, probes), ["team", "roster_key", "as_of_date"]
    )
    want = {tuple(r) for r in parts.collect()}
    assert want and {tuple(r) for r in form.select(*parts.columns).collect()} == want
