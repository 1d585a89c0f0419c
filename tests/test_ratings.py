"""Rating fold against a plain restatement of the rules on one league."""

import pytest
from pyspark.sql import functions as F

from matchlake.operators import history as H
from matchlake.operators import ratings as E
from matchlake.sources.store import staged


def play_all(rows):
    """All rosters of a team are compared with the new one: the direct form of inheritance."""
    board, log = {}, {}

    def rating(team, key):
        if (team, key) not in board:
            total = weight = 0.0
            for (t, k), (r, _) in board.items():
                w = len(set(k.split("|")) & set(key.split("|"))) / 4.0 if t == team else 0
                total, weight = total + r * w, weight + w
            board[(team, key)] = (total / weight * 0.8 + 300.0 if weight else 1500.0, 0)
        return board[(team, key)]

    for r in sorted(rows, key=lambda r: (r.match_date, r.match_id)):
        (ra, na), (rb, nb) = rating(r.team_a, r.key_a), rating(r.team_b, r.key_b)
        e = 1 / (1 + 10 ** ((rb - ra) / 400))
        k = 32 * (1.0 if abs(r.score_a - r.score_b) <= 1 else 0.8)
        d = k * ((r.score_a > r.score_b) - e)
        board[(r.team_a, r.key_a)] = (ra + d, na + 1)
        board[(r.team_b, r.key_b)] = (rb - d, nb + 1)
        log[r.match_id] = (ra, rb, ra + d, rb - d)
    return board, log


@pytest.fixture(scope="module")
def rated(spark, tables):
    return staged(E.rating_history(tables.matches, tables.player_match_stats))


def test_fold_equals_plain_rules(spark, tables, rated):
    rows = E.rating_input(tables.matches, tables.player_match_stats).collect()
    board = {(r.team, r.roster_key): r for r in E.rating_board(rated).collect()}
    history = {r.match_id: r for r in rated.collect()}
    assert len(history) == len(rows)
    for league in {r.league_id for r in rows}:
        want, log = play_all([r for r in rows if r.league_id == league])
        for key, (rating, n) in want.items():
            assert board[key].rating == pytest.approx(rating, abs=1e-6) and board[key].matches == n
        for match_id, values in log.items():
            h = history[match_id]
            assert (h.before_a, h.before_b, h.after_a, h.after_b) == pytest.approx(values, abs=1e-6)


def test_updates_keep_the_sum(rated):
    gap = F.abs(F.col("before_a") + F.col("before_b") - F.col("after_a") - F.col("after_b"))
    assert rated.filter(gap > 1e-9).count() == 0


def test_small_batches_give_the_same_ratings(spark, tables, rated):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        again = E.rating_history(tables.matches, tables.player_match_stats)
        assert again.exceptAll(rated).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rating_before_a_day(spark, tables, rated):
    probes = H.side_probes(tables.form_history).withColumn("as_of_date", F.date_add("as_of_date", 40))
    got = E.ratings_asof(rated, probes).collect()
    rows = E.rating_input(tables.matches, tables.player_match_stats).filter("league_id = 5").collect()
    checked = 0
    for r in got:
        if not r.team.startswith("L5-") or checked > 60:
            continue
        checked += 1
        board, _ = play_all([x for x in rows if x.match_date < r.as_of_date])
        mine = board.get((r.team, r.roster_key))
        if mine is not None:
            assert (r.rating, r.matches) == (pytest.approx(mine[0], abs=1e-6), mine[1])
    assert checked > 20


def test_unrated_roster_inherits(spark, rated):
    board = E.rating_board(rated)
    best = board.orderBy("team", "roster_key").first()
    players = best.roster_key.split("|")
    key = "|".join(sorted([players[0], players[1], "newcomer", "stranger"]))
    asked = spark.createDataFrame([(best.team, key), ("nobody", "a|b|c|d")], "team string, roster_key string")
    got = {r.team: r for r in E.ratings_now(board, asked).collect()}
    total = weight = 0.0
    for r in board.filter(F.col("team") == best.team).collect():
        w = len(set(r.roster_key.split("|")) & set(key.split("|")))
        total, weight = total + r.rating * w, weight + w
    assert got[best.team].rating == pytest.approx(total / weight * 0.8 + 300, abs=1e-6)
    assert (got["nobody"].rating, got["nobody"].matches) == (1500.0, 0)
    late = spark.createDataFrame([(best.team, key, "2030-01-01")], "team string, roster_key string, d string")
    late = late.select("team", "roster_key", F.col("d").cast("date").alias("as_of_date"))
    assert E.ratings_asof(rated, late).first().rating == pytest.approx(got[best.team].rating, abs=1e-6)


def test_from_files_to_ratings(spark, tmp_path):
    from matchlake.sources import documents as docs
    from tests.test_documents import document, write

    path = write(tmp_path, {f"{i}.json": document(f"m-{i}", date=f"2026-01-0{i}") for i in (1, 2, 3)})
    good, _ = docs.split_readable(docs.read_documents(spark, path))
    t = docs.shred(docs.current_documents(good, ["source_file"]))
    got = E.rating_history(t["matches"], t["player_match_stats"]).orderBy("match_date").collect()
    assert [r.match_id for r in got] == ["m-1", "m-2", "m-3"]
    assert (got[0].before_a, got[0].before_b) == (1500.0, 1500.0)
    assert all(b.before_a == pytest.approx(a.after_a) for a, b in zip(got, got[1:]))
    assert E.rating_board(E.rating_history(t["matches"], t["player_match_stats"])).count() == 2
