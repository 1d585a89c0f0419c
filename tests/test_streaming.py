import datetime as dt
import json
import random
import time

from pyspark.sql import functions as F

from matchlake.operators import ratings as E
from matchlake.plans.catalog import rollups
from matchlake.schemas import DOCUMENT
from matchlake.streaming.ingest import MatchStore, load_batch, refresh_batch, start_ingest
from matchlake.streaming.states import STATES
from matchlake.streaming.ratings import stream_ratings
from tests.test_documents import document


def rows(df):
    names = sorted(c for c in df.columns if c not in ("batch", "source_time", "source_file"))
    kinds = dict(df.dtypes)
    return sorted(map(repr, df.select(*[F.round(c, 9).alias(c) if kinds[c] == "double" else F.col(c) for c in names]).collect()))


def ingest(spark, tmp_path):
    q = start_ingest(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "cp"))
    q.awaitTermination(300)
    assert q.exception() is None
    return MatchStore(spark, str(tmp_path / "store"))


def test_a_batch_of_rejected_or_no_documents_has_its_tally(spark, tmp_path):
    from matchlake.sources.documents import read_documents

    (tmp_path / "short.json").write_text(json.dumps(document("9", names="abc")))
    store = MatchStore(spark, str(tmp_path / "store"))
    every = read_documents(spark, str(tmp_path))
    load_batch(store, every, 1)
    load_batch(store, every, 1)  # a repeated batch counts once
    load_batch(store, every.limit(0), 2)
    assert [(r.outcome, r.documents, r.batch) for r in store.log("tally").collect()] == [("failed", 1, 1)]
    assert store.fact("matches").count() == 0 and store.log("rejected").count() == 1


def test_ingest_and_refresh_of_touched_keys(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in (1, 2, 3):
        (source / f"{i}.json").write_text(json.dumps(document(str(i), date=f"2026-01-0{i}")))
    (source / "short.json").write_text(json.dumps(document("9", names="abc")))
    (source / "broken.json").write_text('{"match_info": ')
    store = ingest(spark, tmp_path)
    assert store.fact("matches").count() == 3
    assert {r.reason for r in store.log("rejected").collect()} == {"not readable", "incomplete player stats: 3 vs 3"}
    assert {r.outcome: r.documents for r in store.log("tally").collect()} == {"imported": 3, "failed": 2}
    time.sleep(1.1)
    # a corrected copy with fewer maps, and a new match
    fixed = document("2", date="2026-01-02")
    fixed["map_results"] = fixed["map_results"][:3]
    fixed["match_info"]["team_a_score"] = 3
    (source / "2b.json").write_text(json.dumps(fixed))
    (source / "4.json").write_text(json.dumps(document("4", date="2026-01-04")))
    store = ingest(spark, tmp_path)
    assert store.fact("matches").count() == 4
    assert store.fact("map_results").filter("match_id = '2'").count() == 3
    whole = rollups(store.facts())
    for name in STATES:
        assert rows(store.rollup(name)) == rows(whole[name]), name
    time.sleep(1.1)
    # a correction that takes the only match of a team away: its rows go too
    wrong = document("5", date="2026-01-05")
    wrong["match_info"]["team_b"] = "Wrong"
    (source / "5.json").write_text(json.dumps(wrong))
    store = ingest(spark, tmp_path)
    assert store.rollup("team_stats").filter("team = 'Wrong'").count() == 1
    time.sleep(1.1)
    (source / "5b.json").write_text(json.dumps(document("5", date="2026-01-05")))
    store = ingest(spark, tmp_path)
    whole = rollups(store.facts())
    assert store.rollup("team_stats").filter("team = 'Wrong'").count() == 0
    for name in STATES:
        assert rows(store.rollup(name)) == rows(whole[name]), name
    store.compact(str(tmp_path / "compact"))
    small = MatchStore(spark, str(tmp_path / "compact"))
    assert rows(small.fact("map_results")) == rows(store.fact("map_results"))
    for name in STATES:
        assert rows(small.rollup(name)) == rows(whole[name]), name


def test_states_after_corrections_of_every_kind(spark, tmp_path):
    """Random copies over few matches: states equal the tables worked out anew after every batch."""
    rng = random.Random(7)
    store = MatchStore(spark, str(tmp_path / "store"), buckets=4, keep=1)
    schema = f"{DOCUMENT}, source_time timestamp, source_file string"

    def copy(number, batch):
        d = document(str(number), date=f"2026-01-{rng.randint(1, 9):02d}")
        d["match_info"]["team_b"] = rng.choice(["Bravo", "Wrong", "Other"])
        d["match_info"]["team_a_score"] = rng.randint(0, 3)
        d["map_results"] = d["map_results"][: rng.randint(1, 5)]
        if rng.random() < 0.3:
            d["map_results"][0]["mode"] = None
        return d | {"source_time": dt.datetime(2026, 2, batch), "source_file": f"{number}-{batch}"}

    batches = [range(1, 7), [2, 3], [], [1, 2, 3, 4, 5, 6], [8]]
    for batch, numbers in enumerate(batches, 1):
        text = [json.dumps(copy(n, batch), default=str) for n in numbers]
        lines = spark.createDataFrame([(t,) for t in text], "t string")
        documents = lines.select(F.from_json("t", schema).alias("d")).select("d.*")
        load_batch(store, documents, batch)
        refresh_batch(store, batch)
        if batch in (1, 3):
            continue
        whole = rollups(store.facts())
        for name in STATES:
            assert rows(store.rollup(name)) == rows(whole[name]), (name, batch)
    # a batch that runs again after later ones were lost gives the same states
    before = {name: rows(store.rollup(name)) for name in STATES}
    refresh_batch(store, 5)
    assert before == {name: rows(store.rollup(name)) for name in STATES}
    assert store.replaced(5) is None  # a batch of new matches reads no old facts
    assert set(r.batch for r in store.replaced(2)["map_results"].select("batch").distinct().collect()) == {1}


def test_streamed_ratings_equal_batch(spark, tables, tmp_path):
    league = tables.matches.filter("league_id = 2")
    batch = E.rating_history(league, tables.player_match_stats)
    data = E.rating_input(league, tables.player_match_stats).orderBy("match_date", "match_id").toPandas()
    cut = int(len(data) * 0.6)
    late = data.iloc[[0]].copy()
    late["match_id"] = -1
    source = tmp_path / "rows"
    schema = E.rating_input(league, tables.player_match_stats).schema

    def run():
        stream = spark.readStream.schema(schema).parquet(str(source))
        q = (
            stream_ratings(stream).writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out"))
            .trigger(availableNow=True).start()
        )
        q.awaitTermination(300)
        assert q.exception() is None

    for part in (data.iloc[:cut], data.iloc[cut:]):
        frame = part if part is not None else data
        spark.createDataFrame(frame, schema).coalesce(1).write.mode("append").parquet(str(source))
        run()
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(str(source))
    run()
    out = spark.read.parquet(str(tmp_path / "out"))
    got = out.filter("status = 'rated'").drop("status")
    names = batch.columns
    left = sorted(map(repr, got.select(*[F.round(c, 6).alias(c) if c.split("_")[0] in ("before", "after", "expected") else F.col(c) for c in names]).collect()))
    right = sorted(map(repr, batch.select(*[F.round(c, 6).alias(c) if c.split("_")[0] in ("before", "after", "expected") else F.col(c) for c in names]).collect()))
    assert left == right
    assert [r.match_id for r in out.filter("status = 'late'").collect()] == [-1]
    assert isinstance(data["match_date"].iloc[0], dt.date)


def test_streamed_ratings_keep_text_ids(spark, tables, tmp_path):
    league = tables.matches.filter("league_id = 3").withColumn("match_id", F.concat(F.lit("m-"), "match_id"))
    players = tables.player_match_stats.withColumn("match_id", F.concat(F.lit("m-"), "match_id"))
    E.rating_input(league, players).coalesce(1).write.parquet(str(tmp_path / "rows"))
    schema = E.rating_input(league, players).schema
    for _ in range(2):  # the second run finds nothing new and starts from the stored state
        q = (
            stream_ratings(spark.readStream.schema(schema).parquet(str(tmp_path / "rows"))).writeStream
            .format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp"))
            .option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        )
        q.awaitTermination(300)
        assert q.exception() is None
    got = spark.read.parquet(str(tmp_path / "out"))
    want = E.rating_history(league, players)
    assert got.schema["match_id"].dataType.simpleString() == "string" and got.filter("status = 'late'").count() == 0
    columns = ["match_id", "key_a", F.round("after_a", 6), F.round("after_b", 6)]
    assert sorted(map(repr, got.select(*columns).collect())) == sorted(map(repr, want.select(*columns).collect()))
    assert got.count() > 0


def test_a_first_delta_holds_only_the_entries_that_a_list_can_take(spark, tables):
    from matchlake.streaming import states

    new = {n: getattr(tables, n) for n in ("matches", "map_results", "player_match_stats", "player_map_stats")}
    new = {n: df.withColumn("match_id", F.col("match_id").cast("string")) for n, df in new.items()}
    spec = states.STATES["player_stats"]
    change = states.delta(spec, new, None, keep=3).cache()
    per_key = change.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("all"))
    assert per_key.agg(F.max("n")).first()[0] == 5  # four entries, and one row for the events below them
    assert per_key.agg(F.sum("all")).first()[0] == tables.player_match_stats.count()
    empty = spark.createDataFrame([], spec.schema)
    got = states.finished(spec, states.combine(spec, 3)(empty, change))
    whole = states.finished(spec, states.combine(spec, 3)(empty, states.delta(spec, new, None, keep=10**6)))
    assert got.exceptAll(whole).count() == 0 and got.count() == whole.count()


def test_older_copies_tell_copies_of_one_file_apart(spark):
    from matchlake.sources.documents import older_copies

    rows = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("a", 2, 2), ("b", 1, 3)], "id string, seq int, _row long")
    documents = rows.select(F.struct(F.col("id").alias("match_id")).alias("match_info"), "seq", "_row")
    left_out = {r[0] for r in older_copies(documents, ["seq"], "_row").collect()}
    assert 0 in left_out and len(left_out) == 2 and 3 not in left_out


def test_a_batch_is_added_up_without_joins_by_match(spark, tmp_path):
    """Rows of the log carry what their statistics need of their document; the facts do not show it."""
    from matchlake.sources.documents import CONTEXT, read_documents, shred

    for i in (1, 2):
        (tmp_path / f"{i}.json").write_text(json.dumps(document(str(i), date=f"2026-01-0{i}")))
    store = MatchStore(spark, str(tmp_path / "store"))
    load_batch(store, read_documents(spark, str(tmp_path), "[12].json"), 1)
    new = {name: store.log(name) for name in CONTEXT}
    plain = shred(read_documents(spark, str(tmp_path), "[12].json"))
    for name, state in STATES.items():
        got, want = state.rows(new), state.rows(plain)
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString(), name
        columns = [c for c in want.columns if c not in ("source_time", "source_file")]
        assert rows(got.select(*columns)) == rows(want.select(*columns)), name
    for name, df in store.facts().items():
        assert not {"match_date", "series_winner", "maps_played"} & set(df.columns) - {"match_date"} and (
            "match_date" not in df.columns or name == "matches"
        )
