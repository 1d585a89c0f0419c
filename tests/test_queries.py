"""Registered queries against their reference SQL; MATCHLAKE_ALL=1 runs all of them."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.conftest import SF
from tools.check_queries import compare, database

SOME = ["team_record", "team_grouping_sets", "pair_record", "trailing_ten", "weighted_record", "mode_stats",
        "weighted_record_asof", "recent_context", "win_probability", "series_walk", "training_features", "h2h_leaky"]


@pytest.mark.parametrize("name", sorted(oracle_sql()) if os.environ.get("MATCHLAKE_ALL") else SOME)
def test_against_sql(spark, name):
    ok, note = compare(spark, database(SF), SF, name)
    assert ok, note


def test_contract(spark):
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).count() == 240
