"""Every query with SQL against DuckDB, on the smallest driver tables."""

import os

import duckdb
import pytest

from cladeflow.plans import catalogue

SF = os.environ.get("CLADEFLOW_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, values):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(clean(r[i]) for i in at) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    have = rows(got.columns, [tuple(r) for r in got.collect()])
    assert have == rows(columns, want.fetchall())
    assert have
