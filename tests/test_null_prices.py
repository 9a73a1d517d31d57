"""Queries with an SQL twin over events some of whose prices are unknown: a bar opens and closes at its first and last known price."""

import duckdb
import pytest

from tickloom.operators import bars
from tickloom.plans import catalog

from .test_catalog import plain


@pytest.fixture(scope="module")
def nulls(sf_dir, tmp_path_factory):
    """A folder whose events are those of sf_dir in one working week, dense enough for finished frames; every 20th price is null."""
    at = str(tmp_path_factory.mktemp("nulls"))
    changed = "TIMESTAMP '2024-01-08' + to_seconds(event_id * 86 % 432000) AS ts, CASE WHEN event_id % 20 = 0 THEN NULL ELSE value END AS value"
    duckdb.sql(f"COPY (SELECT * REPLACE ({changed}) FROM '{sf_dir}/events.parquet') TO '{at}/events.parquet' (FORMAT parquet)")
    return at


def test_first_and_last_known_price(spark):
    rows = [("a", 1, None, None), ("a", 2, 5.0, 0.5), ("a", 3, 7.0, 0.7), ("a", 4, None, None), ("b", 1, None, None)]
    quotes = spark.createDataFrame(rows, "symbol string, row_id long, mid double, spread double").selectExpr("*", "timestamp_ntz'2024-01-08 10:00:00' AS trade_ts")
    got = {r["symbol"]: tuple(r[x] for x in ("open", "high", "low", "close", "spread_close", "tick_count")) for r in bars.mid_bars(quotes).collect()}
    assert got == {"a": (5.0, 7.0, 5.0, 7.0, 0.7, 4), "b": (None, None, None, None, None, 1)}


@pytest.mark.parametrize("name", ["feature_partitions", "finalize", "many_features", "stats_by_type"])
def test_query_equals_its_twin(spark, nulls, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{nulls}/events.parquet'")
    got, want = catalog.QUERIES[name](spark, nulls), con.sql(catalog.ORACLES[name])
    order = [want.columns.index(c) for c in got.columns]
    assert plain(got.collect()) == plain([tuple(r[i] for i in order) for r in want.fetchall()])
