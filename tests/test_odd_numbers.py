"""Queries with an SQL twin over events whose numbers, from which volumes are made, are unknown or negative."""

import duckdb
import pytest

from tickloom.plans import catalog

from .test_catalog import plain

QUERIES = ("feature_partitions", "many_features", "stats_by_type")


@pytest.fixture(scope="module")
def odd(sf_dir, tmp_path_factory):
    """Folders whose events are those of sf_dir in one working week, dense enough for finished frames."""
    where = {}
    for name, changed in (
        ("negative", "event_id - 503 AS event_id, TIMESTAMP '2024-01-08' + to_seconds(event_id * 86 % 432000) AS ts"),
        ("unknown", "CASE WHEN event_id % 5 > 0 THEN event_id END AS event_id, TIMESTAMP '2024-01-08' + to_seconds(event_id * 86 % 432000) AS ts"),
        ("ties", "CASE WHEN event_id % 5 > 0 THEN event_id END AS event_id, TIMESTAMP '2024-01-08' + to_seconds(event_id // 4 * 344 % 432000) AS ts"),
    ):
        where[name] = str(tmp_path_factory.mktemp(name))
        duckdb.sql(f"COPY (SELECT * REPLACE ({changed}) FROM '{sf_dir}/events.parquet') TO '{where[name]}/events.parquet' (FORMAT parquet)")
    return where


def equals_its_twin(spark, at, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{at}/events.parquet'")
    got, want = catalog.QUERIES[name](spark, at), con.sql(catalog.ORACLES[name])
    order = [want.columns.index(c) for c in got.columns]
    rows = plain(got.collect())
    assert rows and rows == plain([tuple(r[i] for i in order) for r in want.fetchall()])


@pytest.mark.parametrize("name", QUERIES)
def test_negative_volumes(spark, odd, name):
    equals_its_twin(spark, odd["negative"], name)


@pytest.mark.parametrize("name", QUERIES)
def test_unknown_volumes(spark, odd, name):
    equals_its_twin(spark, odd["unknown"], name)


@pytest.mark.parametrize("name", QUERIES)
def test_unknown_numbers_come_last_of_equal_times(spark, odd, name):
    equals_its_twin(spark, odd["ties"], name)
