from collections import Counter

import duckdb
import pytest

from chunkgraph.llm import queries
from tests.conftest import SF_SMALL


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(r[i] for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    cur = con.execute(queries.ORACLES[name])
    cols = [d[0] for d in cur.description]
    df = queries.QUERIES[name](spark, SF_SMALL)
    assert sorted(df.columns) == sorted(cols)
    assert _bag(df.columns, [tuple(r) for r in df.collect()]) == _bag(cols, cur.fetchall())


def test_names():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES if n != "pipeline"] == list(range(1, 14))
