"""Every query with an SQL twin gives the twin's rows."""

import glob
import os

import duckdb
import pytest

from tickloom.plans import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(rows):
    return sorted(tuple("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_twin(spark, sf_dir, duck, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalog.ORACLES[name])
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.collect()) == plain([tuple(r[i] for i in order) for r in want.fetchall()])


def test_entry(spark, sf_dir):
    assert catalog.flagship(spark, sf_dir).count() > 0
