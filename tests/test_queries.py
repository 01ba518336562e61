"""Every query of the engine against the same rows by SQL, at the smallest scale."""

import math
import os

import duckdb
import pytest

from weftline.queries import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    ran = db.execute(SQL[name])
    names = [d[0] for d in ran.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in ran.fetchall()), key=str)
    assert sorted(names) == cols
    assert got == want


def test_names_are_those_of_the_functions():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 100
