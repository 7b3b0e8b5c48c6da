"""Every query of the star schema gives the rows of its SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__  # noqa: F401  all modules of queries
from tessera.plans.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(rows):
    return sorted(repr(tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    found = QUERIES[name](spark, DIR)
    columns = sorted(found.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert plain(map(tuple, found.select(columns).collect())) == plain(expected)
