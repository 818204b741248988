"""Every registered query of the engine against its SQL, on the smallest tables."""

import decimal
import math

import duckdb
import pytest

import skeinql.entries  # noqa: F401
from skeinql.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = df.select(*(f"`{n}`" for n in names)).collect()
    want = duck.sql(f"SELECT {', '.join(names)} FROM ({SQL[name]})").fetchall()
    assert sorted([tuple(map(plain, r)) for r in got], key=str) == sorted([tuple(map(plain, r)) for r in want], key=str)
