"""Queries with an SQL twin over events some of whose prices are 0: logarithms are -inf there, not null."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tickloom.functions.scalars import log_of
from tickloom.operators import features
from tickloom.plans import catalog

from .test_catalog import plain


@pytest.fixture(scope="module")
def zeros(sf_dir, tmp_path_factory):
    """A folder whose events are those of sf_dir in one working week, dense enough for finished frames; every 20th price is 0."""
    at = str(tmp_path_factory.mktemp("zeros"))
    changed = "TIMESTAMP '2024-01-08' + to_seconds(event_id * 86 % 432000) AS ts, CASE WHEN event_id % 20 = 0 THEN 0 ELSE value END AS value"
    duckdb.sql(f"COPY (SELECT * REPLACE ({changed}) FROM '{sf_dir}/events.parquet') TO '{at}/events.parquet' (FORMAT parquet)")
    return at


def test_logarithms(spark):
    x = F.col("x")
    got = spark.createDataFrame([(0.0,), (-0.0,), (-1.0,), (1.0,), (math.inf,), (math.nan,), (None,)], "x double").select(log_of(x).alias("y"))
    assert [str(r["y"]) for r in got.collect()] == ["-inf", "-inf", "nan", "0.0", "inf", "nan", "None"]


def test_garman_klass_at_zero(spark):
    rows = [(2.0, 4.0, 0.0, 3.0), (0.0, 4.0, 0.0, 3.0), (0.0, 0.0, 0.0, 0.0), (2.0, 2.0, 2.0, 2.0), (2.0, None, 1.0, 2.0)]
    got = spark.createDataFrame(rows, "open double, high double, low double, close double").select(features.garman_klass().alias("v"))
    assert [str(r["v"]) for r in got.collect()] == ["inf", "nan", "nan", "0.0", "None"]


@pytest.mark.parametrize("name", ["realized_vol", "feature_partitions", "finalize", "many_features", "stats_by_type"])
def test_query_equals_its_twin(spark, zeros, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{zeros}/events.parquet'")
    got, want = catalog.QUERIES[name](spark, zeros), con.sql(catalog.ORACLES[name])
    order = [want.columns.index(c) for c in got.columns]
    rows = plain(got.collect())
    assert rows == plain([tuple(r[i] for i in order) for r in want.fetchall()])
    assert any(x in ("inf", "nan") for r in rows for x in r)
