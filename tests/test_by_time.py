"""Joins and windows by time, ticks in segments, files that are cut or come late."""

import datetime as dt
import glob
import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions import joins
from tickloom.operators import asof, bars, features, ticks
from tickloom.plans import adapters, catalog
from tickloom.sources import sinks, vendor

from .test_io import put

T0 = dt.datetime(2024, 1, 5, 9)
NAMES = "trade_date,execution_date,time,trade_price,trade_volume,contract_month,price_type"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def plan_of(df):
    return df._jdf.queryExecution().toString()


# vendor files


def test_folder_with_every_kind_of_header(spark, tmp_path):
    put(f"{tmp_path}/in/a.csv", f"﻿{NAMES}\n20240105,20240104,170000123,7,250,202403,N\n")
    put(f"{tmp_path}/in/deep/er/b.csv.gz", "trade_date,make_date,time,trade_volume,trade_price,contract_month,price_type,NO\n20240105,20240105,84500000,7,250,202403,N,9\n")
    put(f"{tmp_path}/in/deep/c.tsv", "Price_Type\tTRADE_DATE\ttime\ttrade_price\ttrade_volume\tcontract_month\nN\t20240105\t90000000\t5\t1\t202403\nN\tNULL\t90000000\t5\t1\t202403\n")
    put(f"{tmp_path}/in/d.csv", f'"{NAMES.replace(",", chr(34) + "," + chr(34))}",note\n20240105,20240105,91500000,"6",2,202403,N,"a, b"\n')
    got = vendor.read_ticks(spark, [f"{tmp_path}/in", f"{tmp_path}/in/deep"], "nk").orderBy("trade_ts").collect()
    assert [(r["price"], r["trade_volume"], r["sequence_no"], r["execution_date"]) for r in got] == [(7.0, 250, 1, "20240104"), (250.0, 7, 9, "20240105"), (5.0, 1, 1, "20240105"), (6.0, 2, 1, "20240105")]
    assert vendor.read_ticks(spark, [f"{tmp_path}/in"], "nk", pattern="*.csv.gz").count() == 1
    with pytest.raises(ValueError, match="trade_volume.*e.csv"):
        vendor.fields(spark, [f"{tmp_path}/in", put(f"{tmp_path}/other/e.csv", NAMES.replace("trade_volume", "volume") + "\n")])
    assert vendor.fields(spark, [put(f"{tmp_path}/empty/f.csv", NAMES + "\n")]).count() == 0


def test_lines_of_cut_files_keep_their_numbers(spark, tmp_path):
    sizes = {"x": 900, "y": 1, "z": 2500}
    for name, n in sizes.items():
        rows = [f"20240105,20240105,{84500000 + i},{i + 1},,202403,{name}" if i % 7 else f"NULL,,{84500000 + i},{i + 1},null,202403,{name}" for i in range(n)]
        put(f"{tmp_path}/in/{name}.csv", "\n".join([NAMES, *rows]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert vendor.layouts(vendor.lines(spark, [f"{tmp_path}/in"])).count() > 20
        got = vendor.fields(spark, [f"{tmp_path}/in"]).select("price_type", F.col("no").cast("int"), F.col("trade_price").cast("int").alias("price")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r[0], r[1]) for r in got) == sorted((k, i + 1) for k, n in sizes.items() for i in range(n))
    assert all(r["no"] == r["price"] for r in got)  # prices rise from line to line


# ticks


def plain_directions(rows):
    """(date, seq) -> (diff, direction)"""
    out, last = {}, {}
    for date, when, seq, price, _ in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        before, sign = last.get(date, (None, 0))
        diff = None if before is None else price - before
        sign = 1 if diff and diff > 0 else -1 if diff and diff < 0 else sign
        last[date] = price, sign
        out[date, seq] = diff, sign
    return out


@pytest.mark.parametrize("segment", [1, 7, 900, 10**8])
def test_tick_rule_in_segments(spark, segment):
    draw = random.Random(segment)
    rows = [(draw.choice(["20240105", "20240105", "20240106", None]), at(draw.randint(0, 60)), i, float(draw.choice([100, 100, 100, 101, 102])), 1 + i % 3) for i in range(400)]
    frame = spark.createDataFrame(rows, "trade_date string, trade_ts timestamp_ntz, sequence_no long, price double, trade_volume long")
    got = ticks.with_direction(frame, segment).collect()
    want = plain_directions(rows)
    assert len(got) == 400 and {(r["trade_date"], r["sequence_no"]): (r["price_diff"], r["direction"]) for r in got} == want
    assert all((r["buy_vol"], r["sell_vol"]) == (r["trade_volume"] * (r["direction"] == 1), r["trade_volume"] * (r["direction"] == -1)) for r in got)


def test_no_window_of_the_tick_rule_sees_a_whole_date_of_ticks(spark, sf_dir):
    plan = ticks.with_direction(ticks.regular(adapters.vendor_ticks(spark, sf_dir)))._jdf.queryExecution().optimizedPlan().toString()
    whole = [x for x in plan.split("\n") if "Window" in x and ", [trade_date#" in x and "_segment#" not in x.rpartition(", [trade_date#")[2].partition("]")[0]]
    assert whole and all(", [_segment#" in x for x in whole)  # in the order of segments: of their ends alone


def test_near_contract_without_a_broadcast(spark, sf_dir, monkeypatch):
    rows = adapters.vendor_ticks(spark, sf_dir)
    want = sorted(map(tuple, ticks.near_contract(rows).collect()))
    monkeypatch.setattr(ticks, "bounded", lambda df: joins.bounded(df, 3))
    many = ticks.near_contract(rows)
    assert "ResolvedHint" not in many._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, many.collect())) == want


def test_hot_dates_are_many_files_each_in_order(spark, tmp_path):
    rows = spark.range(40_000).select(F.lit(dt.date(2024, 1, 5)).alias("session_date_jst"), F.lit(T0).cast("timestamp_ntz").alias("trade_ts"), ((F.col("id") * 7919) % 40_000).alias("sequence_no"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))
    rows = rows.repartition(8).unionByName(rows.limit(5).withColumn("session_date_jst", F.lit(dt.date(2024, 1, 6))))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes",)}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        sinks.by_date(rows, f"{tmp_path}/ticks")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = glob.glob(f"{tmp_path}/ticks/year=2024/session_date_jst=2024-01-05/*.parquet")
    assert len(files) > 3 and len(glob.glob(f"{tmp_path}/ticks/year=2024/session_date_jst=2024-01-06/*.parquet")) == 1
    read = [[r[0] for r in spark.read.parquet(f).select("sequence_no").collect()] for f in files]
    assert all(x == sorted(x) for x in read) and sorted(sum(read, [])) == list(range(40_000))


# as-of and interval joins


@pytest.mark.parametrize("within", [None, "10 seconds"])
def test_as_of_equals_a_plain_search(spark, within):
    draw = random.Random(8)
    keys = ["hot"] * 8 + ["a", None]
    left = [(i, draw.choice(keys), draw.choice([None, *map(at, range(0, 400, 3))])) for i in range(150)] + [(7, "hot", at(9))] * 3
    right = [(i, draw.choice(keys), draw.choice([None, *map(at, range(0, 400, 7))]), None if i % 9 == 0 else float(i)) for i in range(120)]
    one = spark.createDataFrame(left, "id long, k string, t timestamp_ntz")
    two = spark.createDataFrame(right, "rid long, k string, t timestamp_ntz, x double")
    got = asof.as_of(one, two, ["k"], "t", tie="rid", within=within, prefix="r_", rows_a_block=7)
    want = []
    for i, k, t in left:
        fits = [r for r in right if k is not None and t is not None and r[1] == k and r[2] is not None and r[2] <= t]
        best = max(fits, key=lambda r: (r[2], r[0]), default=None)
        if best and within and best[2] < t - dt.timedelta(seconds=10):
            best = None
        want.append((i, k, t, *((best[2], best[0], best[3]) if best else (None, None, None))))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert got.columns == ["id", "k", "t", "r_t_matched", "r_rid", "r_x"]
    assert not any(x in plan_of(got) for x in ("BroadcastNestedLoopJoin", "CartesianProduct"))


def test_as_of_of_nothing(spark):
    one = spark.createDataFrame([(1, "a", T0)], "id long, k string, t timestamp_ntz")
    assert asof.as_of(one.limit(0), one, ["k"], "t").count() == 0
    assert [tuple(r) for r in asof.as_of(one, one.limit(0), ["k"], "t", prefix="r_").collect()] == [(1, "a", T0, None, None)]


@pytest.mark.parametrize("rows_a_part", [5, 100_000])
def test_points_inside_intervals(spark, rows_a_part):
    draw = random.Random(rows_a_part)
    points = [(i, draw.choice(["a", "a", "b", None]), at(draw.choice([1, 1, 1, draw.randint(0, 300)])) if i % 20 else None) for i in range(200)]
    spans = [(i, draw.choice(["a", "b", None]), at(a), at(a + draw.choice([-5, 0, 1, 30, 200]))) for i, a in enumerate(draw.choices(range(300), k=60))]
    got = asof.inside(spark.createDataFrame(points, "p long, k string, t timestamp_ntz"), spark.createDataFrame(spans, "s long, k string, a timestamp_ntz, b timestamp_ntz"), ["k"], "t", "a", "b", 20, rows_a_part)
    want = sorted((p, s) for p, k, t in points for s, q, a, b in spans if k is not None and k == q and t is not None and a <= t < b)
    assert sorted((r["p"], r["s"]) for r in got.collect()) == want
    assert not any(x in plan_of(got) for x in ("BroadcastNestedLoopJoin", "CartesianProduct"))


# windows by the clock


def test_frames_of_time_leave_out_what_row_frames_reach(spark):
    when = [0, 30, 60, 3600, 3630]  # an hour without a trade
    rows = [(at(s), T0.date(), "DAY", 1.0, 1.0, 1.0, 1.0, 10.0, 2, 4.0) for s in when]
    made = spark.createDataFrame(rows, "bar_start_jst timestamp_ntz, session_date_jst date, session_type string, open double, high double, low double, close double, volume double, tick_count int, signed_volume double")
    got = features.clock_features(made).orderBy("bar_start_jst").collect()
    assert [r["volume_sum_5m_clock"] for r in got] == [10.0, 20.0, 30.0, 10.0, 20.0]
    assert [r["bars_30m_clock"] for r in got] == [1, 2, 3, 1, 2]
    from tickloom.functions.scope import last_rows, session

    by_rows = made.withColumn("x", F.sum("volume").over(last_rows(session(), 10))).orderBy("bar_start_jst").collect()
    assert [r["x"] for r in by_rows] == [10.0, 20.0, 30.0, 40.0, 50.0]


# late files


def some_ticks(spark, rows):
    return spark.createDataFrame([(T0.date(), "s", "202403", at(s), i, p, v) for i, (s, p, v) in enumerate(rows)], "session_date_jst date, symbol string, contract_code string, trade_ts timestamp_ntz, sequence_no long, price double, trade_volume long")


def test_segments_of_many_files_are_the_bars_of_all_ticks(spark):
    draw = random.Random(3)
    rows = [(s, float(draw.choice([100, 100, 101])), draw.randint(1, 5)) for s in sorted(draw.choices(range(600), k=300))]
    whole = some_ticks(spark, rows)
    ruled = ticks.with_direction(whole.withColumn("trade_date", F.lit("20240105")))
    want = bars.trade_bars(ruled)
    cuts = [0, 40, 41, 150, 290, 300]  # in the middle of bars too
    parts = [bars.trade_segments(whole.filter(F.col("sequence_no").between(a, b - 1))) for a, b in zip(cuts, cuts[1:], strict=False)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    got = bars.bars_of_segments(every)
    key = lambda r: str(r["bar_start_jst"])
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    mixed = bars.trade_segments(whole.filter("sequence_no % 2 = 0")).unionByName(bars.trade_segments(whole.filter("sequence_no % 2 = 1")))
    with pytest.raises(Exception, match="alternate"):
        bars.bars_of_segments(mixed).collect()


def test_a_late_file_reads_its_own_dates_alone(spark, sf_dir, tmp_path):
    quotes = adapters.quotes(spark, sf_dir)
    days = sorted(r[0] for r in quotes.select(F.to_date("trade_ts")).distinct().collect())
    path = f"{tmp_path}/segments"
    one = quotes.filter(F.to_date("trade_ts") <= F.lit(days[-2]))
    sinks.merged(spark, bars.quote_segments(one), path, "one").count()
    late = sinks.merged(spark, bars.quote_segments(quotes.filter(F.to_date("trade_ts") == F.lit(days[-1]))), path, "two")
    assert late.agg(F.min("session_date_jst")).first()[0] >= days[-1]
    assert "dynamicpruning" in plan_of(late).lower() or late.select("session_date_jst").distinct().count() <= 3


def test_registered_queries_of_files(spark, sf_dir):
    assert {"vendor_mixed", "row_numbers", "late_bars", "late_externals", "asof_quotes", "signal_trades", "clock_windows"} <= set(catalog.ORACLES)
