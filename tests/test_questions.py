"""Every question against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from fabriq.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def rows(names, got):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple("NULL" if r[k] is None else str(r[k]) for k in order) for r in got)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, con, data, name):
    df = QUERIES[name](spark, data)
    got = [tuple(r) for r in df.collect()]
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", ["lpm_routes", "filter_line_reachability", "test_filters", "edges_layer3", "table_diff"])
def test_plans_have_no_python_and_no_product(spark, data, name):
    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
