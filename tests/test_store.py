import datetime as dt

from pyspark.sql import functions as F

from matchlake.sources.store import (
    KeyedTable,
    VersionedTable,
    keep_last,
    record_results,
    save_predictions,
    staged,
    upsert,
)


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    delta = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, seq int")
    once = upsert(base, delta, ["k"], ["seq"]).select("k", "v")
    twice = upsert(once, delta, ["k"], ["seq"]).select("k", "v")
    want = {(1, "a"), (2, "d"), (3, "e")}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in twice.collect()}


def test_keep_last_drops_copies_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    assert {tuple(r) for r in keep_last(df, ["k"], ["id"]).collect()} == {(0, 998), (1, 999)}
    plan = keep_last(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_versions_and_staging(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert not table.exists()
    table.write(spark.createDataFrame([(1, "a")], "k int, v string"))
    table.write(table.read().union(spark.createDataFrame([(2, "c")], "k int, v string")))
    assert {tuple(r) for r in table.read().collect()} == {(1, "a"), (2, "c")} and table.version() == 2
    df = staged(spark.range(5))
    assert df.count() == 5 and "Range" not in df._jdf.queryExecution().executedPlan().toString()


def test_keyed_table_rewrites_touched_buckets_only(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], "k bigint, x bigint", buckets=8)
    assert table.read().count() == 0 and table.newest() == {}
    table.upsert(spark.range(100).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("x")), ["x"], 1)
    assert len(table.newest()) == 8
    change = spark.createDataFrame([(7, 1), (7, 5), (7, 3)], "k bigint, x bigint")
    touched = table.upsert(change, ["x"], 2)
    assert len(touched) == 1 and sum(v == 2 for v in table.newest().values()) == 1
    folders = {p.parent.name for p in (tmp_path / "t" / "data").glob("bucket=*/v=2")}
    assert folders == {f"bucket={touched[0]}"}
    want = {(k, 5 if k == 7 else 0) for k in range(100)}
    assert {tuple(r) for r in table.read().collect()} == want
    assert table.upsert(change, ["x"], 2) == touched  # run again
    assert {tuple(r) for r in table.read().collect()} == want
    assert {tuple(r) for r in table.read(before=2).collect()} == {(k, 0) for k in range(100)}
    assert table.upsert(change.limit(0), ["x"], 3) == [] and table.read().count() == 100
    # a batch without its line in the manifest is not seen
    spark.createDataFrame([(7, 9)], "k bigint, x bigint").write.parquet(
        str(tmp_path / "t" / "data" / f"bucket={touched[0]}" / "v=9"))
    assert {tuple(r) for r in table.read().collect()} == want
    # all rows of a bucket gone
    table.apply(change, 4, lambda old, new: old.filter("false"))
    assert table.read().filter("k = 7").count() == 0 and 4 in table.newest().values()


def test_prediction_log(spark, tables):
    from registry.models import _log

    log = _log(tables)
    n = log.count()
    assert save_predictions(log, log).count() == n
    row = log.filter("actual_winner is null").first()
    results = spark.createDataFrame(
        [(row.match_date, row.team_a, row.team_b, row.team_b, "1-3", dt.datetime(2026, 1, 1)),
         (dt.date(1990, 1, 1), "x", "y", "x", "3-0", dt.datetime(2026, 1, 1))],
        "match_date date, team_a string, team_b string, winner string, score string, result_timestamp timestamp")
    done, unmatched = record_results(log, results)
    key = (F.col("match_date") == row.match_date) & (F.col("team_a") == row.team_a) & (F.col("team_b") == row.team_b)
    assert done.filter(key).first().actual_score == "1-3" and done.count() == n
    assert [r.team_a for r in unmatched.collect()] == ["x"]
