"""Match tables of large inputs: written once in buckets, read without a shuffle."""

import pytest
from pyspark.sql import functions as F

from matchlake.sources import fixtures
from matchlake.sources.fixtures import FixtureTables
from tests.conftest import SF


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_maps_of_large_inputs_lie_in_buckets(spark, tables, monkeypatch):
    assert "Exchange" in _plan(tables.map_results.groupBy("match_id").count()) and tables.matches.columns
    monkeypatch.setattr(fixtures, "BUCKETS_FROM", 1)
    monkeypatch.setattr(fixtures, "BUCKET_LINES", 500)
    large = FixtureTables(spark, SF)
    assert large.map_results.exceptAll(tables.map_results).count() == 0
    assert tables.map_results.exceptAll(large.map_results).count() == 0
    assert large.matches.exceptAll(tables.matches).count() == 0
    totals = large.player_match_stats.groupBy("match_id").agg(F.collect_list("player_name").alias("p"))
    # orders are shuffled or broadcast, maps and players are not; tasks follow the lines, not their bytes
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    per_match = large.map_results.groupBy("match_id").count()
    assert "Exchange" not in _plan(per_match)
    assert per_match.rdd.getNumPartitions() == -(-lines // 500)
    assert totals.count() == tables.matches.count()


def test_copies_of_documents_are_made_in_one_pass(spark):
    from registry.facts import REGISTRY

    assert _plan(REGISTRY["documents_keep_last"][0](spark, SF)).count("from_json") == 1


def test_nested_matches_hold_the_tables(spark, tables):
    from matchlake.functions.scalar import rounded
    from matchlake.sources import documents as docs

    flat = docs.shred(docs.assemble(tables.matches, tables.map_results, tables.player_match_stats, tables.player_map_stats))
    nested = docs.shred(docs.nested_documents(tables.nested))
    for name, there in flat.items():
        rates = {c: rounded(c, 6) for c in ("kd", "rating") if c in there.columns}
        a, b = there.withColumns(rates), nested[name].withColumns(rates)
        assert a.count() > 0 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, name


@pytest.mark.parametrize("name", [
    "document_matches", "document_maps", "document_players", "document_player_maps", "document_scores",
    "match_page_headers", "match_page_maps", "match_page_players", "match_page_totals",
])
def test_lines_are_read_once_and_texts_parsed_once(spark, name):
    from registry.facts import REGISTRY

    plan = _plan(REGISTRY[name][0](spark, SF))
    assert plan.count("ReadSchema: struct<l_orderkey") == 1
    assert plan.count("from_json(") == (0 if name in ("match_page_headers", "match_page_maps") else 1)


@pytest.mark.parametrize("large", [False, True])
def test_kept_tables_are_written_once(spark, tables, monkeypatch, large):
    if large:
        monkeypatch.setattr(fixtures, "BUCKETS_FROM", 1)
        monkeypatch.setattr(fixtures, "BUCKET_LINES", 500)
    from matchlake.functions.scalar import rounded

    kept = FixtureTables(spark, SF).kept()
    for name in ("matches", "map_results", "player_match_stats"):
        a, b = getattr(kept, name), getattr(tables, name)
        assert a.columns == b.columns and "Join" not in _plan(a) and "lineitem" not in "".join(a.inputFiles()), name
        rates = {c: rounded(c, 6) for c in ("kd", "rating") if c in b.columns}
        a, b = a.withColumns(rates), b.withColumns(rates)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, name
        assert not large or "Exchange" not in _plan(getattr(kept, name).groupBy("match_id").count()), name
    assert kept.form_history.count() == 2 * tables.matches.count()


@pytest.mark.parametrize("name", ["match_page_table_players", "match_page_table_totals"])
def test_table_pages_are_made_inside_the_rows_of_matches(spark, name):
    from registry.facts import REGISTRY

    assert _plan(REGISTRY[name][0](spark, SF)).count("ReadSchema: struct<l_orderkey") == 1


def test_shred_takes_missing_and_empty_lists(spark):
    from matchlake.schemas import DOCUMENT
    from matchlake.sources import documents as docs

    texts = [
        '{"match_info": {"match_id": "1"}, "map_results": [], "player_stats": {"team_a": [], "team_b": [], "per_map": []}}',
        '{"match_info": {"match_id": "2"}}',
        '{"match_info": {"match_id": "3"}, "map_results": [{"mode": "M"}, null], "player_stats": {"team_a": [{"player": "x"}],'
        ' "team_b": [], "per_map": [{"map_number": 1}, {"map_number": 5}, null]}}',
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "j string").select(F.from_json("j", DOCUMENT).alias("d")).select("d.*")
    t = docs.shred(rows)
    assert {k: sorted(r.match_id for r in v.collect()) for k, v in t.items()} == {
        "matches": ["1", "2", "3"], "map_results": ["3", "3"], "player_match_stats": ["3"], "player_map_stats": ["3"]}
