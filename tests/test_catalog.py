"""Every registered query against its SQL oracle; hot-key splitting changes nothing."""

import pytest
from compare import connect, oracle_rows, spark_rows
from conftest import SF_DIR

import __spark_entry__ as entry
from tidemark.catalog import load

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(load()) <= set(entry.queries()) & set(ORACLES)


@pytest.mark.parametrize("key", list(load()))
def test_query_matches_oracle(spark, con, key):
    got = spark_rows(entry.queries()[key](spark, SF_DIR))
    want = oracle_rows(con, ORACLES[key])
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("key", [
    "carry_forward", "pit_join", "val_sequence", "val_update_chain", "val_subscriptions", "pct_floor",
    "incident_decisions", "incident_episodes", "plan_transitions",
])
def test_split_hot_keys_match_oracle(spark, con, key):
    from tidemark.plans.lake import Lake

    lake = _HOT.setdefault("lake", Lake(spark, SF_DIR, hot_rows=5))
    q = load()[key]
    assert spark_rows(q.project(q.build(lake))) == oracle_rows(con, ORACLES[key])


_HOT = {}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
