"""Driver contract: entry runs; every registered query matches its DuckDB oracle at sf0.001."""

import os
import sys
from collections import Counter

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as se  # noqa: E402
from chunkgraph.plans.registry import all_oracles, all_queries  # noqa: E402
from chunkgraph.sources.tables import TABLES  # noqa: E402
from tests.conftest import SF_SMALL  # noqa: E402


def test_entry_runs(spark):
    df = se.entry(spark)
    assert df.columns == ["target_id", "cand_id", "cand_name", "dep", "rn", "pos"]
    assert df.count() == 610


def test_every_oracle_has_a_query():
    assert set(se.oracle_sql()) <= set(se.queries())
    assert set(all_queries()) == set(all_oracles())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(r[i] for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(se.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = se.queries()[name](spark, SF_SMALL)
    cur = duck.execute(se.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _bag(df.columns, [tuple(r) for r in df.collect()]) == _bag(ocols, cur.fetchall())
