import datetime
import random
from collections import defaultdict

import pytest

from matchlake.operators import map_pool as mp
from matchlake.params import DEFAULTS

DAY0 = datetime.date(2024, 1, 1)
MODES = ["Hardpoint", "Search & Destroy", "Overload"]


def brute(history, fixtures):
    """Straight from the definition, fixture by fixture."""
    out = {}
    for fid, a, ra, b, rb, day in fixtures:
        slots, used = [], defaultdict(list)
        for number, mode in enumerate(DEFAULTS.series_modes, 1):
            pool = sorted({h[3] for h in history if h[2] == mode and h[4] and h[4] < day})
            score = {}
            for name in pool:
                sides = []
                for team, roster in ((a, ra), (b, rb)):
                    plays = won = 0.0
                    for t, key, m, n, d, w in history:
                        if t == team and roster and d and d < day and m == mode and n == name:
                            o = len(set(key.split("|")) & set(roster.split("|"))) / 4 if key else 0
                            plays, won = plays + o, won + o * w
                    sides += [plays, won / plays * 100 if plays else 50.0]
                score[name] = sides
            left = [n for n in pool if n not in used[mode]]
            if left:
                pick = min(left, key=lambda n: (-(score[n][0] + score[n][2]), n))
                used[mode].append(pick)
                slots.append((number, pick, "most played" if score[pick][0] + score[pick][2] else "unplayed", score[pick][0], score[pick][2]))
            else:
                slots.append((number, pool[0] if pool else "Unknown", "pool used up" if pool else "no map data", None, None))
        out[fid] = slots
    return out


def world(seed, days):
    r = random.Random(seed)
    players = {t: [f"{t}{i}" for i in range(7)] for t in "ABC"}
    def roster(t):
        return "|".join(sorted(r.sample(players[t], r.choice([2, 4, 4, 6]))))
    history, fixtures = [], []
    for d in range(days):
        day = DAY0 + datetime.timedelta(days=d * 9)
        for _ in range(r.randrange(4)):
            t = r.choice("AAB")
            key = roster(t)
            history += [(t, key, r.choice([*MODES, "Control"]), f"m{min(int(r.expovariate(0.3)), 11)}", day, r.randrange(2)) for _ in range(3)]
        a, b = r.sample("ABC", 2)
        fixtures.append((d, a, roster(a) if r.random() < 0.9 else None, b, roster(b), day))
    history += [("A", "", MODES[0], "no roster", DAY0, 1), ("A", "A1|A2", MODES[0], "undated", None, 1)]
    return history, fixtures + [(900, "A", "A0", "B", None, DAY0), (901, "A", "A0", "B", None, DAY0)]


@pytest.mark.parametrize("seed,block,prefix", [(1, 50_000, 6), (2, 20, 1), (3, 1, 2)])
def test_against_brute_force(spark, monkeypatch, seed, block, prefix):
    monkeypatch.setattr(mp, "BLOCK_PLAYS", block)
    monkeypatch.setattr(mp, "PREFIX", prefix)
    history, fixtures = world(seed, 60)
    h = spark.createDataFrame(history, "team string, roster_key string, mode string, map_name string, match_date date, won int")
    f = spark.createDataFrame(
        fixtures, "fixture_id long, team_a string, a_roster_key string, team_b string, b_roster_key string, as_of_date date"
    )
    got = {r.fixture_id: r.predicted_maps for r in mp.with_map_pool_asof(f, h).collect()}
    assert len(got) == len(fixtures)
    for fid, slots in brute(history, fixtures).items():
        for have, (number, name, reason, a, b) in zip(got[fid], slots):
            assert (have.map_number, have.predicted_map, have.reason) == (number, name, reason), fid
            assert (have.team_a_plays is None) == (a is None)
            if a is not None:
                assert abs(have.team_a_plays - a) < 0.06 and abs(have.team_b_plays - b) < 0.06


def test_without_any_history(spark):
    history, fixtures = world(4, 3)
    h = spark.createDataFrame(history, "team string, roster_key string, mode string, map_name string, match_date date, won int").limit(0)
    f = spark.createDataFrame(
        fixtures, "fixture_id long, team_a string, a_roster_key string, team_b string, b_roster_key string, as_of_date date"
    )
    rows = mp.with_map_pool_asof(f, h).collect()
    assert len(rows) == len(fixtures) and {s.reason for r in rows for s in r.predicted_maps} == {"no map data"}
    assert mp.with_map_pool_asof(f.limit(0), h).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_most_played_of_two_rows(monkeypatch, seed):
    import numpy as np

    r = np.random.default_rng(seed)
    monkeypatch.setattr(mp, "PREFIX", int(r.integers(1, 8)))
    monkeypatch.setattr(mp, "CELLS_AT_ONCE", int(r.integers(1, 60)))
    width, k = int(r.integers(0, 15)), int(r.integers(1, 4))
    plays = r.integers(0, 4, (6, width)) / 4 * (r.random((6, width)) < 0.5)
    known = (r.random(width) < 0.7) | (plays.sum(axis=0) > 0)
    a, b = r.integers(0, 6, 30), r.integers(0, 6, 30)
    got = mp._most_played(plays, known, a, b, k)
    for row, x, y in zip(got, a, b):
        ranked = sorted(np.flatnonzero(known), key=lambda c: (-(plays[x, c] + plays[y, c]), c))[:k]
        assert list(row) == [*ranked, *[-1] * (k - len(ranked))]


def test_days_in_parts_and_no_list_beside_a_pair(spark, monkeypatch):
    history, fixtures = world(5, 40)
    # two fixtures more on every day, so that days have several pairs
    fixtures += [(f[0] + 100 * i, f[1], "A0|A3", "C", f"C{i}", f[5]) for f in fixtures[:40] for i in (1, 2)]
    h = spark.createDataFrame(history, "team string, roster_key string, mode string, map_name string, match_date date, won int")
    f = spark.createDataFrame(
        fixtures, "fixture_id long, team_a string, a_roster_key string, team_b string, b_roster_key string, as_of_date date"
    )
    whole = mp.with_map_pool_asof(f, h)
    # what a side has played meets its pairs in one group a day, not in joins that copy it to every pair
    assert whole._jdf.queryExecution().executedPlan().toString().count("FlatMapCoGroupsInArrow") == 1
    monkeypatch.setattr(mp, "PAIRS_AT_ONCE", 1)
    parts = mp.with_map_pool_asof(f, h)
    assert whole.count() == len(fixtures) and parts.exceptAll(whole).count() == 0 and whole.exceptAll(parts).count() == 0


def test_cards_hold_line_ups_and_map_history(tables):
    from matchlake.operators import perspective as P

    cards = P.nested_cards(tables.nested)
    want = P.map_history(tables.matches, tables.map_results, tables.player_match_stats)
    got = P.card_history(cards)
    want = want.select(*got.columns)
    assert got.count() > 0 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    sides, rows = P.card_sides(cards), tables.form_history.select("match_id", "match_date", "side", "team", "roster_key")
    sides = sides.select(*rows.columns)
    assert sides.exceptAll(rows).count() == 0 and rows.exceptAll(sides).count() == 0
