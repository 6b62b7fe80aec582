"""Every query of the catalog against its SQL in DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pytest

from sievelight.plans import catalog

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return c


def normal(rows):
    def one(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return ""
        return repr(round(float(x), 5)) if isinstance(x, float) else str(x)

    return sorted(tuple(one(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR)
    cols = sorted(got.columns)
    want = duck.sql(catalog.ORACLE[name])
    assert cols == sorted(want.columns)
    assert normal(tuple(r[c] for c in cols) for r in got.collect()) == normal(want.select(*(f'"{c}"' for c in cols)).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0


def test_rs_promise(spark):
    assert catalog.rs_roundtrip(spark, DIR).where("not as_promised").count() == 0
