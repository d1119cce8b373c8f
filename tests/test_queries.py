import os

import duckdb
import pytest

import __spark_entry__ as driver
from loomshift import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    result = duck.execute(queries.SQL[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    assert found == sorted(repr(tuple(r[order.index(c)] for c in columns)) for r in result.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_greedy_assignment_is_one_to_one(spark):
    rows = queries.QUERIES["greedy_assignment"](spark, SF).collect()
    assert rows and all(r["score"] >= 0.5 for r in rows)
    for part in ("target", "source"):
        assert len({(r["n_regionkey"], r[part]) for r in rows}) == len(rows)


def test_registry():
    assert set(driver.oracle_sql()) <= set(driver.queries()) and set(queries.QUERIES) <= set(driver.queries())
