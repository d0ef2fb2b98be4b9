"""Every engine query against its SQL in DuckDB, over whole tables."""

import math
from collections import Counter

import duckdb
import pytest

from parlance.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v


@pytest.fixture(scope="module")
def db(sf):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, db, name):
    got = QUERIES[name](spark, sf)
    want = db.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    order = [names.index(c) for c in got.columns]
    expected = Counter(tuple(plain(r[i]) for i in order) for r in want.fetchall())
    found = Counter(tuple(plain(v) for v in r) for r in got.collect())
    assert found == expected, (list((found - expected).items())[:2], list((expected - found).items())[:2])
    assert found


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES)
