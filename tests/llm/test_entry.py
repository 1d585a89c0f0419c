import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.conftest import SF
from tools.check_queries import compare, database


def test_one_query_per_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op1_decontaminate", "op5_warc", "op8_line_dedup", "op11_source_divergence", "op13_conversation_trie"])
def test_against_sql(spark, name):
    ok, note = compare(spark, database(SF), SF, name)
    assert ok, note


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.columns
    before = docs.count()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(os.path.join(tmp_path, str(i)))
        docs = spark.read.parquet(os.path.join(tmp_path, str(i)))
        assert docs.columns == first and 0.5 * before < docs.count() <= before
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.run(spark, SF).count() == len(pieces)


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
