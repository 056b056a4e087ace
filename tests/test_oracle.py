"""Every query of the engine against its SQL, over the smallest tables."""

import decimal
import glob
import os

import duckdb
import pytest

from lodestore import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
#: Queries that SQL can't express.
BY_LOOPS = {"sel_04", "trn_10", "trn_10_selector", "trn_10_memory", "trn_12", "atl_02_converged", "atl_04_seeds"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and x != x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        return f"{float(x) + 0.0:.8g}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    if isinstance(x, dict):
        return "{" + ",".join(map(plain, x.values())) + "}"
    return str(x).removesuffix("+00:00")


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows(df.columns, got) == rows(want.columns, want.fetchall())
    else:  # trained or iterated: test_learning and test_routing compare these with loops
        assert name in BY_LOOPS and got and len(df.columns) == len(set(df.columns))
