"""Every query with SQL gives what the SQL gives on the smallest tables."""

import math

import duckdb
import pytest

from graphloom.plans.catalogue import ORACLES, QUERIES


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    tidy = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return sorted(([tidy(r[k]) for k in order] for r in data), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, df.collect())
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows(columns, found.fetchall())
