"""Streams that are stopped, started again and get late files; sketches, levels, tables dealt alike; what is left behind."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tickloom import session
from tickloom.functions import blocks
from tickloom.operators import dataset, features, report, rollup
from tickloom.plans import adapters, catalog
from tickloom.sources import tables
from tickloom.streaming import jobs

T0 = dt.datetime(2024, 1, 5, 9)
TICK = "trade_ts timestamp, symbol string, sequence_no long, price double, trade_volume long"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def deliver(spark, path, rows):
    spark.createDataFrame([(at(s), k, i, 1.0 + i, 1) for i, (s, k) in enumerate(rows)], TICK).coalesce(1).write.mode("append").parquet(path)


def arriving(spark, path):
    return jobs.live(spark).readStream.schema(TICK).parquet(path)


def test_bursts_end_after_a_pause(spark):
    rows = [(0, "a"), (599, "a"), (1199, "a"), (1800, "a"), (10, "b"), (20, None)]
    frame = spark.createDataFrame([(at(s), k, i, 1.0 + i, 1) for i, (s, k) in enumerate(rows)], TICK)
    got = sorted((str(r["symbol"]), r["begins"], r["ends"], r["n"], r["low"], r["high"]) for r in jobs.bursts(frame).collect())
    assert got == [("None", at(20), at(20), 1, 6.0, 6.0), ("a", at(0), at(1199), 3, 1.0, 3.0), ("a", at(1800), at(1800), 1, 4.0, 4.0), ("b", at(10), at(10), 1, 5.0, 5.0)]
    assert jobs.bursts(frame.limit(0)).count() == 0


def test_late_rows_are_set_aside_and_nothing_is_doubled(spark, tmp_path):
    route = lambda: jobs.set_late_aside(arriving(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", "10 minutes").awaitTermination()
    deliver(spark, f"{tmp_path}/in", [(0, "a"), (5000, "a")])
    route()
    deliver(spark, f"{tmp_path}/in", [(4399, "late"), (4400, "in time"), (6000, "a"), (5400, "a")])
    route()
    route()  # nothing new
    deliver(spark, f"{tmp_path}/in", [(5399, "late"), (0, "late")])
    route()
    got = {name: sorted((r["symbol"], r["trade_ts"]) for r in spark.read.parquet(f"{tmp_path}/out/{name}").collect()) for name in ("in_time", "late")}
    assert got["late"] == [("late", at(0)), ("late", at(4399)), ("late", at(5399))]
    assert [x[1] for x in got["in_time"]] == [at(0), at(5000), at(5400), at(6000), at(4400)]
    # a batch that runs again writes its folder again
    assert sorted(x for x in os.listdir(f"{tmp_path}/out/late") if x[0] != ".") == ["batch=0", "batch=1", "batch=2"]


def test_quotes_come_once(spark, tmp_path):
    kind = "timestamp timestamp, symbol string, bid double, ask double"
    put = lambda rows: spark.createDataFrame([(at(s), "S", b, b + 1) for s, b in rows], kind).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        live = jobs.live(spark).readStream.schema(kind).parquet(f"{tmp_path}/in")
        jobs.weekly_quote_sink(jobs.quotes_once(live), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()

    put([(0, 1.0), (0, 1.0), (9000, 2.0)])
    run()
    put([(9000, 2.0), (9000, 3.0), (0, 1.0), (9001, 2.0)])
    run()
    got = spark.read.option("header", True).option("sep", "\t").csv(f"{tmp_path}/out")
    assert sorted((r["timestamp"][11:19], r["bid"]) for r in got.collect()) == [("09:00:00", "1.0"), ("11:30:00", "2.0"), ("11:30:00", "3.0"), ("11:30:01", "2.0")]


def test_levels_tell_nulls_from_totals(spark):
    rows = spark.createDataFrame([("d", None, "x", 1, 2.0), ("d", "s", "x", 2, 3.0)], "session_date_jst string, session_type string, symbol string, trade_volume long, price double")
    got = {(r["level"], r["session_type"], r["symbol"]): (r["n"], r["volume"]) for r in rollup.totals(rows).collect()}
    assert got == {(0, None, "x"): (1, 1), (0, "s", "x"): (1, 2), (1, None, None): (1, 1), (1, "s", None): (1, 2), (3, None, None): (2, 3), (6, None, "x"): (2, 3), (7, None, None): (2, 3)}


def test_sketches_of_days_merge(spark):
    rows = spark.range(60_000).select((F.col("id") % 20).alias("day"), (F.col("id") * 7919 % 20_011).alias("who"), (F.col("id") % 1000).alias("value"))
    days = rollup.daily_sketches(rows, "who", "value", ("day",)).withColumn("week", F.floor(F.col("day") / 10))
    for r in rollup.merged_sketches(days, "week", (0.1, 0.5, 0.9)).collect():
        exact = rows.filter(F.floor(F.col("day") / 10) == r["week"]).agg(F.count_distinct("who")).first()[0]
        assert abs(r["about_who"] - exact) <= 3 * 1.04 / 64 * exact and r["n"] == 30_000
        assert abs(r["q10"] - 100) < 35 and abs(r["q50"] - 500) < 35 and abs(r["q90"] - 900) < 35


def test_tables_dealt_alike_join_without_an_exchange(spark, sf_dir):
    keys = ["bar_start_jst", "session_date_jst", "session_type"]
    bars, external = adapters.trade_bars(spark, sf_dir, "300 seconds"), adapters.external_bars(spark, sf_dir, "300 seconds")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = features.join_externals(bars, external, catalog.SYMBOLS)
        met = features.join_externals(tables.bucketed(bars, keys, 4), tables.bucketed(external, keys, 4), catalog.SYMBOLS)
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert "Exchange" in plain._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, met.collect())) == sorted(map(str, plain.select(*met.columns).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_prepared_set_reads_its_frame_once(spark):
    rows = spark.range(50).select(F.col("id").alias("bar_start_jst"), F.lit(1).alias("session_date_jst"), F.lit("DAY").alias("session_type"), (F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") > 3, F.col("id") / 50).cast("float").alias("y"))
    got = dataset.prepared(rows, ["x"], "y", 0.8)
    stats = {r["feature"]: (r["mean"], r["std"]) for r in dataset.feature_stats(rows, ["x"]).collect()}
    want = dataset.binarised(dataset.scaled(rows, stats), "y", dataset.nearest_quantile(rows, "y", 0.8))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(*got.columns).collect()), key=str)


def test_running_sums_of_one_first_order_value(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS_A_BLOCK", 10)
    rows = spark.range(200).select(F.lit(T0).alias("exit_time"), F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, -2.0).otherwise(1.5).alias("pnl"))
    order = ("exit_time", "k")
    got = {r["k"]: r["equity"] for r in report.equity_curve(rows, order).collect()}
    total, high, fall, want = 0.0, None, 0.0, {}
    for k in range(200):
        total += -2.0 if k % 3 == 0 else 1.5
        want[k] = total
        high = total if high is None else max(high, total)
        fall = max(fall, high - total)
    assert got == pytest.approx(want)
    assert report.max_drawdown(rows, order).first()[0] == pytest.approx(fall)
    assert blocks.ordered_blocks(rows, list(order), 10).select("_block").distinct().count() >= 15  # one first value, many blocks


def test_values_are_carried_through_blocks(spark):
    rows = spark.range(300).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 50 == 7, F.col("id")).alias("x"))
    got = {r["t"]: r["y"] for r in blocks.carried(blocks.ordered_blocks(rows, ["k", "t"], 9), ["k"], ["t"], F.col("x"), "y").collect()}
    want = {t: max((u for u in range(t + 1) if u % 3 == t % 3 and u % 50 == 7), default=None) for t in range(300)}
    assert got == want


def test_shared_folders_go(spark):
    kept = session.settled(spark.range(3))
    path = session._made[-1]
    assert kept.count() == 3 and session.forget(spark) >= 1 and not session._made
    assert not os.path.exists(path.removeprefix("file:"))
