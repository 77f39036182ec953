"""Every query of the graph engine over the smallest tables, against its SQL."""

import duckdb
import pytest

from quadlake.plans.queries import oracles, queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(row):
    return tuple(round(x, 6) if isinstance(x, float) else x for x in row)


#: The same over quads is compared in test_semantics.py.
@pytest.mark.parametrize("name", [x for x in queries() if not x.startswith("quad_")])
def test_query(spark, duck, name):
    found = queries()[name](spark, DIR)
    columns = sorted(found.columns)
    rel = duck.sql(oracles()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = [plain([r[i] for i in at]) for r in rel.fetchall()]
    assert sorted(map(repr, map(plain, found.select(*columns).collect()))) == sorted(map(repr, want))


def test_a_filter_reaches_the_scan(spark):
    plan = queries()["scalar_range"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_totalprice,100000.0)" in plan and "o_comment" not in plan and "Exchange" not in plan


def test_lineitem_key_is_unique(duck):
    """At the sizes where it is: the smallest tables repeat some rows' keys."""
    assert duck.sql("SELECT count(*) = count(DISTINCT (l_orderkey, l_linenumber, l_partkey, l_suppkey)) FROM read_parquet('/root/testdata/sf0.01/lineitem.parquet')").fetchall() == [(True,)]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
