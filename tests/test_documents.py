import json

from pyspark.sql import functions as F

from matchlake.sources import documents as docs
from matchlake.operators import quality as Q
from matchlake.operators.perspective import alias_table


def player(name, kills=20, deaths=10):
    return {"player": name, "kills": kills, "deaths": deaths, "kd": 2.0, "plus_minus": "+10", "damage": 2000, "rating": 1.1}


def document(match_id="1", date="2026-30-01", names="abcd", per_map=True, scores=((250, 200), (3, 6), (5, 2), (220, 250))):
    modes = ["Hardpoint", "Hardpoint", "Search & Destroy", "Overload"]
    order = [scores[0], scores[3], scores[1], scores[2]]
    maps = [
        {"mode": m, "map_name": f"M{i}", "team_a_score": a, "team_b_score": b}
        for i, (m, (a, b)) in enumerate(zip(modes, order))
    ]
    rows = [
        {"map_number": n, "player_name": f"{t}{x}", "team": t, "kills": 5 * n, "deaths": 4, "kd": 1.0, "damage": 900, "rating": 1.0}
        for n in range(1, 6) for t in ("team_a", "team_b") for x in names
    ]
    return {
        "match_info": {"match_id": match_id, "team_a": "OpTic Texas", "team_b": "New Team 1", "tournament": "T", "date": date,
                       "url": "u", "team_a_score": 2, "team_b_score": 2},
        "map_results": maps,
        "player_stats": {"team_a": [player("team_a" + x) for x in names], "team_b": [player("team_b" + x) for x in names],
                         "per_map": rows if per_map else []},
    }


def write(folder, files):
    for name, content in files.items():
        text = content if isinstance(content, str) else json.dumps(content, indent=2)
        (folder / name).write_text(text)
    return str(folder)


def test_read_shred_and_reject(spark, tmp_path):
    path = write(tmp_path, {
        "a.json": document("1"), "b.json": document("2", date="2026-02-03", names="abc"),
        "broken.json": '{"match_info": ', "none.json": {"other": 1}, "notes.txt": "x",
    })
    every = docs.read_documents(spark, path)
    tally = {r.outcome: r.documents for r in docs.import_tally(every).collect()}
    assert tally == {"imported": 2, "failed": 2}
    good, bad = docs.split_readable(every)
    assert {r.reason for r in bad.collect()} == {"not readable", "parts missing"}
    ok, rejected = docs.complete_documents(good)
    assert [r.match_info.match_id for r in ok.collect()] == ["1"]
    assert rejected.first().reason == "incomplete player stats: 3 vs 3"

    t = docs.shred(ok)
    match = t["matches"].first()
    assert str(match.match_date) == "2026-01-30" and match.winner == "New Team 1"  # level series
    assert t["map_results"].count() == 4 and t["player_match_stats"].count() == 8
    # five recorded maps but only four results: the fifth has no row
    assert t["player_map_stats"].filter("map_number = 5").count() == 0
    by_position = {(r.map_number, r.mode) for r in t["player_map_stats"].collect()}
    assert (2, "Hardpoint") in by_position
    by_sequence = {(r.map_number, r.mode) for r in docs.shred(ok, align="sequence")["player_map_stats"].collect()}
    assert (2, "Search & Destroy") in by_sequence and (4, "Hardpoint") in by_sequence
    assert {r.side for r in t["player_map_stats"].collect()} == {"team_a", "team_b"}
    assert {r.team for r in t["player_map_stats"].collect()} == {"OpTic Texas", "New Team 1"}


def test_newest_copy_and_findings(spark, tmp_path):
    newer = document("7", scores=((250, 200), (6, 6), (5, 2), (250, 220)))
    path = write(tmp_path, {"x.json": document("7"), "y.json": newer})
    good, _ = docs.split_readable(docs.read_documents(spark, path))
    newest = docs.current_documents(good, ["source_file"])
    t = docs.shred(newest)
    assert t["matches"].count() == 1 and t["map_results"].count() == 4
    report = Q.dq_report(t["matches"], t["map_results"], t["player_map_stats"], good)
    rules = {r.rule for r in report.collect()}
    assert {"level_map", "duplicate_id", "date", "position", "series_score"} <= rules
    scored = docs.with_series_score(newest).first().match_info
    assert (scored.team_a_score, scored.team_b_score) == (3, 0)


def test_report_of_documents_agrees_with_that_of_the_tables(spark, tmp_path):
    odd = document("8", scores=((250, 200), (6, 6), (5, 2), (250, 220)))
    odd["player_stats"]["per_map"][0]["team"] = None
    odd["match_info"]["date"] = "no date"
    files = {"x.json": document("7"), "y.json": document("7"), "z.json": odd,
             "none.json": {"match_info": {"match_id": None}, "map_results": None, "player_stats": None}}
    every = docs.read_documents(spark, write(tmp_path, files))
    got = {(r.rule, r.key, r.detail): r.n for r in Q.document_report(every).collect()}
    assert got.pop(("duplicate_id", "7", "2 copies")) == 2
    assert not any(rule == "duplicate_id" for rule, *_ in got)
    assert {rule for rule, key, _ in got if key == "8"} >= {"level_map", "side", "date", "series_score"}
    good, _ = docs.split_readable(every)
    for match in ("7", "8"):
        t = docs.shred(docs.current_documents(good.filter(F.col("match_info.match_id") == match), ["source_file"]))
        level = {(r.rule, r.key, r.detail) for r in Q.level_maps(t["map_results"]).collect()}
        assert level == {k for k in got if k[0] == "level_map" and k[1] == match}
    assert all(n == (2 if key == "7" else 1) for (_, key, _), n in got.items())
    assert Q.document_report(every.limit(0)).count() == 0


def test_judged_documents_are_the_two_splits(spark, tmp_path):
    files = {"a.json": document("1"), "b.json": document("2", names="abc"), "c.json": {"match_info": {"match_id": "3"}}}
    path = write(tmp_path, files)
    (tmp_path / "broken.json").write_text('{"match_info": ')
    every = docs.read_documents(spark, str(tmp_path))
    judged = {(r.source_file, r.reason) for r in docs.judged_documents(every).collect()}
    good, bad = docs.split_readable(every)
    ok, short = docs.complete_documents(good)
    want = {(r.source_file, r.reason) for d in (bad, short) for r in d.select("source_file", "reason").collect()}
    assert judged == want | {(r.source_file, None) for r in ok.collect()} and len(judged) == 4, path


def test_names_round_trip_and_seeds(spark, tables, tmp_path):
    some = tables.matches.filter("league_id = 3")
    ids = some.select("match_id")
    parts = [d.join(ids, "match_id", "left_semi") for d in
             (tables.map_results, tables.player_match_stats, tables.player_map_stats)]
    nested = docs.assemble(some, *parts)
    out = str(tmp_path / "out")
    docs.write_documents(nested, docs.document_names(some, alias_table(spark)), out)
    back, bad = docs.split_readable(docs.read_documents(spark, out, multi_line=False))
    assert bad.count() == 0 and back.count() == some.count()
    assert docs.shred(back)["player_map_stats"].count() == parts[2].count()
    seeds = tmp_path / "seeds.txt"
    seeds.write_text("# list\n\n  https://example.org/match/1/x \nhttps://example.org/match/2/y\n")
    assert [r.url for r in docs.read_seeds(spark, str(seeds)).collect()] == [
        "https://example.org/match/1/x", "https://example.org/match/2/y"]
    one = docs.training_table(spark, write(tmp_path, {"z.json": document("9")}), str(tmp_path / "train"))
    assert one.filter(F.col("match_info.match_id") == "9").count() == 1


def test_short_names(spark):
    from matchlake.operators.perspective import logo_table, with_short_name

    df = spark.createDataFrame([("OpTic Texas",), ("New Team-1!",)], "team string")
    names = {r.team: r.short_name for r in with_short_name(df, alias_table(spark)).collect()}
    assert names == {"OpTic Texas": "OpTic", "New Team-1!": "NewTeam1"}
    assert logo_table(spark).count() == 12
