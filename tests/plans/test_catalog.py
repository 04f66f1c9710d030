"""Every registered query with SQL against DuckDB on the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from hourloom.plans import catalog

AT = os.environ.get("HOURLOOM_TEST_DATA", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{AT}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, AT)
    said = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in said.description]
    assert sorted(got.columns) == sorted(columns)
    want = rows(columns, said.fetchall())
    own = rows(got.columns, [tuple(r) for r in got.collect()])
    assert len(own) == len(want) and len(own) > 0
    bad = [(a, b) for a, b in zip(own, want, strict=True) if not all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-8, abs_tol=2e-6)) for x, y in zip(a, b, strict=True))]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, AT).count() > 0
