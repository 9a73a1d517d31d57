"""Ticks to bars. One shuffle each: first and last prices are ordered aggregates, so no sort is needed before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.scope import placed, series

#: Order-book columns that trade data can't fill.
BOOK = ("bid_close", "ask_close", "spread_close", "bid_qty_close", "ask_qty_close", "order_imbalance")


def _where_known(x: Column, order: Column) -> Column:
    """The order of those rows alone that have a value: min_by and max_by pass over rows without an order."""
    return F.when(x.isNotNull(), order)


def _ohlc(x: Column, order: Column, prefix: str = "") -> list[Column]:
    """First, highest, lowest and last known value; null where none is known."""
    known = _where_known(x, order)
    return [
        F.min_by(x, known).alias(f"{prefix}open"),
        F.max(x).alias(f"{prefix}high"),
        F.min(x).alias(f"{prefix}low"),
        F.max_by(x, known).alias(f"{prefix}close"),
    ]


def _ended(width: str) -> Column:
    return F.col("bar_start_jst") + F.expr(f"INTERVAL {width}")


def trade_bars(ticks: DataFrame, width: str = "30 seconds") -> DataFrame:
    """OHLCV bars of normalised ticks, of those intervals alone that have trades; volumes of which nothing is known are null."""
    order = placed("trade_ts", "sequence_no")
    total = lambda c: F.sum(c).cast("double")
    bars = ticks.groupBy("session_date_jst", "symbol", "contract_code", clock.bar_start(F.col("trade_ts"), width).alias("bar_start_jst")).agg(
        *_ohlc(F.col("price"), order),
        total("trade_volume").alias("volume"),
        F.count("*").cast("int").alias("tick_count"),
        total("buy_vol").alias("buy_volume"),
        total("sell_vol").alias("sell_volume"),
        F.sum(F.col("price") * F.col("trade_volume")).alias("_turnover"),
    )
    return _trade_columns(bars, width)


def _trade_columns(bars: DataFrame, width: str) -> DataFrame:
    """Summed bars in the columns of trade bars."""
    none = F.lit(None).cast("double")
    return bars.select(
        "bar_start_jst",
        _ended(width).alias("bar_end_jst"),
        "session_date_jst",
        clock.session_type(F.col("bar_start_jst")).alias("session_type"),
        "symbol",
        "contract_code",
        *("open", "high", "low", "close", "volume", "tick_count"),
        *[none.alias(c) for c in BOOK],
        "buy_volume",
        "sell_volume",
        (F.col("buy_volume") - F.col("sell_volume")).alias("signed_volume"),
        F.when(F.col("volume") > 0, F.col("_turnover") / F.col("volume")).otherwise(F.col("close")).alias("vwap_30s"),
        F.lit(True).alias("is_complete"),
    )


def mid_bars(quotes: DataFrame, width: str = "30 seconds") -> DataFrame:
    """Bars of the middle between bid and ask, by symbol. Equal times are ordered by `row_id`."""
    order = placed("trade_ts", "row_id")
    bars = quotes.groupBy("symbol", clock.bar_start(F.col("trade_ts"), width).alias("bar_start_jst")).agg(
        *_ohlc(F.col("mid"), order),
        F.max_by("spread", _where_known(F.col("spread"), order)).alias("spread_close"),
        F.count("*").cast("int").alias("tick_count"),
    )
    return _mid_columns(bars, width)


def _mid_columns(bars: DataFrame, width: str) -> DataFrame:
    """Summed bars in the columns of external bars."""
    return bars.select(
        "bar_start_jst",
        _ended(width).alias("bar_end_jst"),
        clock.session_date(F.col("bar_start_jst")).alias("session_date_jst"),
        clock.session_type(F.col("bar_start_jst")).alias("session_type"),
        "symbol",
        *("open", "high", "low", "close"),
        *[F.col(c).alias(f"mid_{c}") for c in ("open", "high", "low", "close")],
        "spread_close",
        "tick_count",
        F.lit(0.0).alias("volume"),
        F.lit(True).alias("is_complete"),
    )


def size_bars(ticks: DataFrame, width: str = "300 seconds") -> DataFrame:
    """Bars of each symbol with trade sizes and the share by which buyers outweigh sellers."""
    order = placed("trade_ts", "sequence_no")
    bars = ticks.groupBy(*series(ticks), clock.bar_start(F.col("trade_ts"), width).alias("trade_ts")).agg(
        *_ohlc(F.col("price"), order),
        F.avg("trade_volume").alias("avg_trade_size"),
        F.max("trade_volume").alias("max_trade_size"),
        F.sum("buy_vol").alias("buy_volume"),
        F.sum("sell_vol").alias("sell_volume"),
        F.sum("trade_volume").alias("volume"),
        F.count("*").cast("int").alias("tick_count"),
    )
    share = (F.col("buy_volume") - F.col("sell_volume")) / F.col("volume")
    return bars.withColumn("size_imb_1bar", F.when(F.col("volume") > 0, share).otherwise(0.0))


# Bars that can be merged: what a file brings to a bar is one row, a segment, that is kept beside the bars


def trade_segments(ticks: DataFrame, width: str = "30 seconds") -> DataFrame:
    """A row for each bar of one file's ticks (one contract a date; buy_vol and the like aren't needed): first and last
    tick, extremes, sums, and the volume by the sign of the move inside the segment: up, down, and lead, that of the ticks
    before its first move, whose sign only the segments before it can tell.
    """
    order = F.struct("trade_ts", "sequence_no")
    bar = ["session_date_jst", "symbol", "contract_code", "bar_start_jst"]
    placed = ticks.withColumn("bar_start_jst", clock.bar_start(F.col("trade_ts"), width))
    inside = Window.partitionBy(*bar).orderBy("trade_ts", "sequence_no")
    moved = placed.withColumn("_sign", F.signum(F.col("price") - F.lag("price").over(inside)).cast("int"))
    sign = F.when(F.col("_sign") != 0, F.col("_sign"))
    ruled = moved.withColumn("_way", F.last(sign, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    volume = lambda way: F.coalesce(F.sum(F.when(way, F.col("trade_volume"))), F.lit(0)).cast("double")
    at = F.struct("trade_ts", "sequence_no", "price")
    return ruled.groupBy(*bar).agg(
        F.min(at).alias("first"),
        F.max(at).alias("last"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.coalesce(F.sum("trade_volume"), F.lit(0)).cast("double").alias("volume"),
        F.count("*").alias("tick_count"),
        volume(F.col("_way") == 1).alias("up"),
        volume(F.col("_way") == -1).alias("down"),
        volume(F.col("_way").isNull()).alias("lead"),
        F.max_by(sign, F.when(sign.isNotNull(), order)).alias("way"),
        F.sum(F.col("price") * F.col("trade_volume")).alias("turnover"),
    )


def bars_of_segments(segments: DataFrame, width: str = "30 seconds") -> DataFrame:
    """The bars that all ticks of the segments together would give.

    Segments of a date follow each other in time; the last price and the last sign are carried from one to the next, so
    that ticks before a segment's first move get their side. Files may share a bar, if their ticks don't alternate in it;
    if they do, this raises, as the ticks themselves are needed then. Windows see a date's segments, never its ticks.
    """
    by_date = Window.partitionBy("session_date_jst", "symbol").orderBy("first.trade_ts", "first.sequence_no")
    before = F.lag("last").over(by_date)
    key = lambda x: F.struct(x["trade_ts"], x["sequence_no"])
    mixed = key(before) >= F.struct("first.trade_ts", "first.sequence_no")
    move = F.when(mixed, F.raise_error(F.lit("files have ticks that alternate in a bar"))).otherwise(F.signum(F.col("first.price") - before["price"]).cast("int"))
    met = segments.withColumn("_move", move).withColumn("_move", F.when(F.col("_move") != 0, F.col("_move")))
    carried = F.last(F.coalesce("way", "_move"), ignorenulls=True).over(by_date.rowsBetween(Window.unboundedPreceding, -1))
    sided = met.withColumn("_side", F.coalesce(F.col("_move"), carried))
    part = lambda own, side: F.sum(F.col(own) + F.when(F.col("_side") == side, F.col("lead")).otherwise(0.0))
    order = F.struct("first.trade_ts", "first.sequence_no")
    summed = sided.groupBy("session_date_jst", "symbol", "contract_code", "bar_start_jst").agg(
        F.min_by("first.price", order).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("last.price", order).alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("tick_count").cast("int").alias("tick_count"),
        part("up", 1).alias("buy_volume"),
        part("down", -1).alias("sell_volume"),
        F.sum("turnover").alias("_turnover"),
    )
    return _trade_columns(summed, width)


def quote_segments(quotes: DataFrame, width: str = "30 seconds") -> DataFrame:
    """A row for each symbol and bar of one file's quotes, with the session's date to file it under."""
    first, last = F.struct("trade_ts", "row_id", "mid"), F.struct("trade_ts", "row_id", "mid", "spread")
    made = quotes.groupBy("symbol", clock.bar_start(F.col("trade_ts"), width).alias("bar_start_jst")).agg(F.min(first).alias("first"), F.max(last).alias("last"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.count("*").alias("tick_count"))
    return made.withColumn("session_date_jst", clock.session_date(F.col("bar_start_jst")))


def mid_bars_of_segments(segments: DataFrame, width: str = "30 seconds") -> DataFrame:
    """The bars that all quotes of the segments together would give; their quotes may alternate."""
    summed = segments.groupBy("symbol", "bar_start_jst").agg(
        F.min("first")["mid"].alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max("last")["mid"].alias("close"),
        F.max("last")["spread"].alias("spread_close"),
        F.sum("tick_count").cast("int").alias("tick_count"),
    )
    return _mid_columns(summed, width)
