"""The driver's tables in the shapes of this engine: events as ticks and quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars, ticks

#: Event types stand for the external symbols.
SYMBOL_OF = {"click": "usdjpy", "view": "sp500", "purchase": "nasdaq", "signup": "xau", "error": "xti"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vendor_ticks(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    day = F.date_format("ts", "yyyyMMdd")
    return load(spark, sf_dir, "events").select(
        day.alias("trade_date"),
        day.alias("execution_date"),
        F.col("ts").alias("trade_ts"),
        (F.lit(202403) + 3 * (F.col("user_id") % 2)).cast("int").alias("contract_month"),
        F.col("event_id").alias("sequence_no"),
        F.when(F.col("event_type") == "error", "X").otherwise("N").alias("price_type"),
        F.lit(0).cast("tinyint").alias("sco_category"),
        F.col("value").alias("price"),
        (F.col("event_id") % 10 + 1).alias("trade_volume"),
        *more,
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bid, ask = F.col("value") * 0.999, F.col("value") * 1.001
    return load(spark, sf_dir, "events").select(
        F.col("ts").alias("trade_ts"),
        F.col("event_type").alias("symbol"),
        bid.alias("bid"),
        ask.alias("ask"),
        ((bid + ask) / 2).alias("mid"),
        (ask - bid).alias("spread"),
        F.col("event_id").alias("row_id"),
    )


def many_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ticks of three symbols in one table."""
    return vendor_ticks(spark, sf_dir, F.concat(F.lit("s"), F.col("user_id") % 3).alias("symbol"))


def trade_bars(spark: SparkSession, sf_dir: str, width: str) -> DataFrame:
    return bars.trade_bars(ticks.normalised(vendor_ticks(spark, sf_dir), "nk225"), width)


def external_bars(spark: SparkSession, sf_dir: str, width: str) -> DataFrame:
    return bars.mid_bars(quotes(spark, sf_dir), width)
