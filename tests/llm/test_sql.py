"""The queries that SQL can express, against it, over the smallest tables."""

import duckdb
import pytest

from quadlake.llm.queries import QUERIES, oracles

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(oracles()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    found, rel = QUERIES[name](spark, DIR), con.sql(oracles()[name])
    assert sorted(rel.columns) == sorted(found.columns)
    got = [tuple(r) for r in found.select(*rel.columns).collect()]
    assert sorted(got, key=repr) == sorted(rel.fetchall(), key=repr)
