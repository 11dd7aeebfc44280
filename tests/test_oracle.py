"""Every registered query with SQL gives the rows that DuckDB gives; the others run and keep their schema."""

import math
import os

import duckdb
import pytest

from stallwright.plans import all_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = all_queries()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = ordered(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in ORACLE:
        assert len(set(cols)) == len(df.columns)
        return
    got = duck.execute(ORACLE[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == ordered(tuple(plain(r[k]) for k in at) for r in got.fetchall())
