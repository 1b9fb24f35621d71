"""The registered queries have matching checking SQL and a few agree end to end on the small data."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
TABLES = "part lineitem orders events documents pages conversations".split()


def test_names():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert len(queries) > 130 and set(oracles) <= set(queries)
    assert len(oracles) >= len(queries) - 10


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no driver data")
@pytest.mark.parametrize("name", ["balanced_order", "merge_signals", "action_state", "evidence_summary", "search_topk"])
def test_agrees(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    want = sorted(str(r) for r in cur.fetchall())
    got = sorted(str(tuple(r)) for r in entry.queries()[name](spark, SMALL).select(*cols).collect())
    assert got == want
