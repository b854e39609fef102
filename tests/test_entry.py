import math

import duckdb
import pytest

import __spark_entry__ as entry
from strandlake import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


@pytest.mark.parametrize("name", list(core.QUERIES))
def test_core_query(spark, sf, duck, name):
    df = core.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in core.ORACLES:
        res = duck.execute(core.ORACLES[name])
        names = [d[0] for d in res.description]
        assert sorted(names) == columns
        want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in res.fetchall())
        assert got == want


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5
    assert set(core.ORACLES) <= set(entry.oracle_sql()) and set(core.QUERIES) <= set(entry.queries())
