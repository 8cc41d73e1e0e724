"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from strataloom.catalog import QUERIES, SQL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(round(v, 5) if isinstance(v, float) else v)) for v in row)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, folder, duck):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=_key)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(dict(zip(names, r))[c] for c in columns) for r in cursor.fetchall()), key=_key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        for a, b in zip(g, w):
            assert a == b or (isinstance(a, float) and math.isclose(a, b, abs_tol=2e-6)), (g, w)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, folder):
    assert QUERIES[name](spark, folder).count() > 0
