"""Structured Streaming: bars and bursts of a tick stream, late rows set aside, quotes once, the weekly quote sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import clock
from ..operators.bars import _ohlc


def streaming_bars(ticks: DataFrame, width: str = "30 seconds", late: str = "1 minute", keys: tuple[str, ...] = ("symbol",), time_col: str = "trade_ts") -> DataFrame:
    """OHLCV bars of a stream in append mode: a bar comes out once the watermark has passed its end; later ticks are dropped.

    Event time must be a zoned timestamp; without a stream the same bars come out of a batch.
    """
    order = F.struct(time_col, "sequence_no")
    bars = ticks.withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("w"), *keys).agg(*_ohlc(F.col("price"), order), F.sum("trade_volume").alias("volume"), F.count("*").alias("tick_count"))
    return bars.select(F.col("w.start").alias("bar_start"), F.col("w.end").alias("bar_end"), *keys, "open", "high", "low", "close", "volume", "tick_count")


def weekly_quote_sink(quotes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Quotes appended as gzipped, tab-separated files under <symbol>/<Monday>; the checkpoint makes restarts safe."""
    out = quotes.select("symbol", F.date_format(clock.week_start(F.col("timestamp")), "yyyyMMdd").alias("week_start"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS").alias("timestamp"), "bid", "ask")
    writer = out.writeStream.partitionBy("symbol", "week_start").format("csv").option("sep", "\t").option("header", True).option("compression", "gzip")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bursts(ticks: DataFrame, gap: str = "10 minutes", late: str = "1 minute", keys: tuple[str, ...] = ("symbol",), time_col: str = "trade_ts") -> DataFrame:
    """Runs of trades of a key without a pause of `gap`: begins, ends (the last trade), n, volume, low, high.

    The same from a batch and, in append mode, from a stream, where a burst comes out once the watermark has passed its
    last trade and the gap. Rows with a null key are a key of their own; rows without a time are in none.
    """
    windows = ticks.withWatermark(time_col, late).groupBy(F.session_window(time_col, gap).alias("w"), *keys)
    found = windows.agg(F.max(time_col).alias("ends"), F.count("*").alias("n"), F.sum("trade_volume").alias("volume"), F.min("price").alias("low"), F.max("price").alias("high"))
    return found.select(F.col("w.start").alias("begins"), "ends", *keys, "n", "volume", "low", "high")


def set_late_aside(rows: DataFrame, path: str, checkpoint: str, late: str = "1 minute", time_col: str = "trade_ts") -> StreamingQuery:
    """Rows of a stream to {path}/in_time, and those that come too late, by the latest time of the batches before and
    `late`, to {path}/late, so that a later file's old rows are kept instead of dropped.

    Each batch writes a folder of its own, with the latest time up to it in {path}/marks, and a batch that runs again
    writes the same folders again: after a restart nothing is lost or doubled. A stream that reads in_time with a watermark
    of `late` drops nothing.
    """

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{path}/marks").filter(F.col("batch") < n).agg(F.max("latest")).first()[0] if n else None
        bound = F.lit(before) - F.expr(f"INTERVAL {late}")
        old = F.coalesce(F.col(time_col) < bound, F.lit(False)) if before is not None else F.lit(False)
        for name, part in (("in_time", batch.filter(~old)), ("late", batch.filter(old))):
            part.write.mode("overwrite").parquet(f"{path}/{name}/batch={n}")
        latest = batch.agg(F.greatest(F.max(time_col), F.lit(before).cast("timestamp")).alias("latest"))
        latest.write.mode("overwrite").parquet(f"{path}/marks/batch={n}")

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def quotes_once(quotes: DataFrame, late: str = "1 hour", time_col: str = "timestamp") -> DataFrame:
    """Quotes of a stream, each once though files overlap: equal ones are dropped within the watermark.

    A quote's key is kept until the watermark passes it, so the state stays small; a copy that comes later still is older
    than the watermark and dropped as late.
    """
    return quotes.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["symbol", time_col, "bid", "ask"])


def live(spark: SparkSession, partitions: int = 16) -> SparkSession:
    """A session for streams with state: their state has as many parts, for as long as their checkpoint is used."""
    other = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
        other.conf.set(key, spark.conf.get(key))
    other.conf.set("spark.sql.shuffle.partitions", str(min(partitions, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return other
