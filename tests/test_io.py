"""Readers, writers and streams."""

import datetime as dt
import gzip
import os

import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars
from tickloom.plans import adapters
from tickloom.sources import sinks, vendor
from tickloom.streaming import jobs

HEAD = "trade_date,make_date,time,trade_price,trade_volume,contract_month,price_type"


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    data = text.encode()
    with open(path, "wb") as f:
        f.write(gzip.compress(data) if str(path).endswith(".gz") else data)
    return str(path)


def test_vendor_files_of_all_kinds(spark, tmp_path):
    comma = put(f"{tmp_path}/a.csv.gz", f"{HEAD.upper()}\n20240105,20240104,170000123,100,2,202403,N\n20240105,20240105,84500000,101,3,202403,N\n20240105,20240105,bad,101,3,202403,N\n20240105,NULL,84500000,101,3,202403,N\n")
    tab = put(f"{tmp_path}/b.tsv", "trade_date\ttime\ttrade_price\ttrade_volume\tcontract_month\tprice_type\tno\tsco_category\n20240106\t90000000\t7\t1\t202403\tN\t5\t1\n")
    assert {sep: len(files) for sep, files in vendor.separators(spark, [comma, tab]).items()} == {",": 1, "\t": 1}
    got = vendor.read_ticks(spark, [comma, tab], "nk").orderBy("trade_ts").collect()
    assert [(str(r["trade_ts"]), r["sequence_no"], r["direction"], r["session_type"], r["session_date_jst"].day) for r in got] == [
        ("2024-01-04 17:00:00.123000", 1, 0, "NIGHT", 5),
        ("2024-01-05 08:45:00", 2, 1, "DAY", 5),
        ("2024-01-06 09:00:00", 5, 0, "DAY", 6),
    ]
    with pytest.raises(ValueError, match="trade_price.*short.csv"):
        vendor.read_ticks(spark, [comma, put(f"{tmp_path}/short.csv", "trade_date\n20240105\n")], "nk")


def test_legacy_files(spark, tmp_path):
    path = put(f"{tmp_path}/x_20240105.tsv", "trade_date\tmake_date\ttime\ttrade_price\ttrade_volume\tcontract_month\tprice_type\tno\n20240105\t20240105\t84500000\t101\t3\t202403\tN\t1\nbroken\n")
    assert vendor.read_legacy_ticks(spark, [path]).count() == 1
    assert spark.range(1).select(vendor.from_path(F.lit(path), "period")).first()[0] == "20240105"


def test_quote_files(spark, tmp_path):
    with_head = put(f"{tmp_path}/SP500/2026/SP500-20260302.tsv", "timestamp\tbid\task\n2026-03-02 10:00:00.500\t1\t3\n2026-03-02 10:00:01.000\tbad\t3\n")
    put(f"{tmp_path}/SP500/2026/SP500-20260706.tsv.gz", "2026-07-06 10:00:00.000\t2\t4\n")
    got = vendor.read_quotes(spark, f"{tmp_path}/SP500/2026").orderBy("trade_ts").collect()
    assert [(str(r["trade_ts"]), r["symbol"], r["mid"], r["spread"]) for r in got] == [("2026-03-02 17:00:00.500000", "SP500", 2.0, 2.0), ("2026-07-06 16:00:00", "SP500", 3.0, 2.0)]
    assert vendor.read_quotes(spark, with_head, "X").first()["symbol"] == "X"
    with pytest.raises(ValueError, match="three"):
        vendor.read_quotes(spark, put(f"{tmp_path}/Y/2026/y.tsv", "a\tb\n"))


def test_writes_replace_only_their_dates(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "session_date_jst date, trade_ts timestamp_ntz, sequence_no long, symbol string")
    day = lambda d, n: (dt.date(2024, 1, d), dt.datetime(2024, 1, d, 9), n, "a")
    out = f"{tmp_path}/ticks"
    sinks.by_date(frame([day(1, 1), day(2, 2), day(2, 3)]), out)
    sinks.by_date(frame([day(2, 9)]), out)
    assert sorted(r[0] for r in spark.read.parquet(out).select("sequence_no").collect()) == [1, 9]
    sinks.by_date(frame([day(3, 4)]), f"{tmp_path}/ext", lead=("symbol",))
    assert os.path.isdir(f"{tmp_path}/ext/symbol=a/year=2024/session_date_jst=2024-01-03")
    sinks.by_month(frame([day(3, 4)]), f"{tmp_path}/months")
    assert os.path.isdir(f"{tmp_path}/months/period=202401")


def test_records_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-05", "DAY", 1.005, 0.123456), ("2024-01-06", "DAY", -2.0, None)], "date string, session string, edge double, prob_threshold double")
    sinks.write_records(rows, f"{tmp_path}/r")
    put(f"{tmp_path}/r/broken.json", "not json\n")
    got = sinks.read_records(spark, f"{tmp_path}/r").orderBy("date").collect()
    assert [(r["edge"], r["prob_threshold"]) for r in got] == [(pytest.approx(1.0, abs=0.011), 0.1235), (-2.0, 0.0)]
    assert sinks.read_records(spark, f"{tmp_path}/r", 0.0).count() == 1


def streamed(spark, df, path):
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_stream_bars_equal_batch_bars(spark, sf_dir, tmp_path):
    ticks = adapters.vendor_ticks(spark, sf_dir).select(F.col("trade_ts").cast("timestamp").alias("trade_ts"), F.col("contract_month").cast("string").alias("symbol"), "sequence_no", "price", "trade_volume")
    live = jobs.streaming_bars(streamed(spark, ticks, f"{tmp_path}/in"), "1 hour")
    query = live.writeStream.format("memory").queryName("live_bars").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = jobs.streaming_bars(ticks, "1 hour")
    closed = ticks.agg(F.max("trade_ts")).first()[0] - dt.timedelta(minutes=1)
    want = batch.filter(F.col("bar_end") <= F.lit(closed)).collect()
    assert want and sorted(map(str, spark.table("live_bars").collect())) == sorted(map(str, want))


def test_weekly_sink(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 3, 9), "S", 1.0, 2.0), (dt.datetime(2024, 1, 9, 9), "S", 3.0, 4.0)]
    quotes = spark.createDataFrame(rows, "timestamp timestamp, symbol string, bid double, ask double")
    jobs.weekly_quote_sink(streamed(spark, quotes, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert sorted(x for x in os.listdir(f"{tmp_path}/out/symbol=S") if x[0] != ".") == ["week_start=20240101", "week_start=20240108"]


def test_bars_keep_volume(spark, sf_dir):
    got = adapters.trade_bars(spark, sf_dir, "300 seconds").select("open", "high", "low", "close", "volume", "buy_volume", "sell_volume")
    assert got.filter("open > high or close > high or open < low or close < low or buy_volume + sell_volume > volume").count() == 0
    from tickloom.operators import ticks

    n = ticks.normalised(adapters.vendor_ticks(spark, sf_dir), "nk").agg(F.sum("trade_volume")).first()[0]
    assert got.agg(F.sum("volume")).first()[0] == n
    assert bars.size_bars(ticks.normalised(adapters.vendor_ticks(spark, sf_dir), "nk")).agg(F.sum("volume")).first()[0] == n
