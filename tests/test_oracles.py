"""Every registered query with SQL gives the SQL's rows at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from graphloom.queries import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(df):
    out = []
    for row in df[sorted(df.columns)].astype(object).itertuples(index=False):
        out.append(tuple(None if x is None or x is pd.NaT or isinstance(x, float) and x != x else f"{x:.9g}" if isinstance(x, float) else str(int(x)) if isinstance(x, int) and not isinstance(x, bool) else str(x) for x in row))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, db, name):
    got, want = queries()[name](spark, FOLDER).toPandas(), db.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    fix = lambda df: df.apply(lambda c: c.map(lambda x: float(x) if isinstance(x, int) and not isinstance(x, bool) else x))
    assert plain(fix(got)) == plain(fix(want))
