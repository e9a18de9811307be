"""Every registered query against its SQL, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from lodestone.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con):
    df = QUERIES[name](spark, sf)
    order = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in order) for r in df.collect()]
    assert got, f"{name} has no rows"
    if name in ORACLE_SQL:
        cur = con.execute(ORACLE_SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == order
        at = [names.index(c) for c in order]
        want = [tuple(plain(r[i]) for i in at) for r in cur.fetchall()]
        assert len(got) == len(want)
        assert sorted(got, key=repr) == sorted(want, key=repr)
