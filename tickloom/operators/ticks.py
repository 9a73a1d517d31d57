"""Operators on trade ticks, of one symbol or, where they have a column `symbol`, of many at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.joins import bounded
from ..functions.scope import placed, series

#: The columns of normalised ticks, in order.
TICK_COLUMNS = (
    "session_date_jst session_type trade_date execution_date trade_ts contract_month contract_code sequence_no "
    "price_type sco_category price trade_volume buy_vol sell_vol direction symbol"
).split()


def near_contract(ticks: DataFrame) -> DataFrame:
    """Ticks of each trade date's nearest contract month, by symbol, of all price types.

    The nearest months, a row for each trade date of a symbol, come from an aggregate that combines before its shuffle; they are
    broadcast if they are few, so that ticks stay where they are, and else joined by date.
    """
    of = series(ticks)
    nearest = bounded(ticks.groupBy(*[F.col(c).alias(f"_{c}") for c in (*of, "trade_date")]).agg(F.min("contract_month").alias("_near")))
    same = (F.col("trade_date") == F.col("_trade_date")) & (F.col("contract_month") == F.col("_near"))
    for c in of:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return ticks.join(nearest, same).drop("_trade_date", "_near", *[f"_{c}" for c in of])


def regular(ticks: DataFrame) -> DataFrame:
    """Regular trades alone. The nearest contract is chosen before, over all price types."""
    return ticks.filter(F.col("price_type") == "N")


#: Seconds of a trade date whose ticks one task orders.
SEGMENT = 900


def with_direction(ticks: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Adds price_diff, direction (-1, 0, 1) and the volumes of buyers and sellers.

    A trade date is worked on in segments of so many seconds, so that a date with most of the ticks is many tasks. What a
    segment hands on is its last price and its last sign, a row each: segments without a move take the sign before them,
    and the first tick of a segment is held against the last price before it. Windows see one segment's ticks, or one
    date's segments.
    """
    of = series(ticks)
    keys = [*of, "trade_date", "_segment"]
    order = placed("trade_ts", "sequence_no")
    sign = lambda x: F.when(x > 0, 1).when(x < 0, -1)
    inside = Window.partitionBy(*keys).orderBy("trade_ts", F.col("sequence_no").asc_nulls_last())
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    cut = ticks.withColumn("_segment", F.floor(F.unix_seconds(F.col("trade_ts").cast("timestamp")) / segment))
    moved = cut.withColumn("_diff", F.col("price") - F.lag("price").over(inside))
    ends = moved.groupBy(*keys).agg(F.min_by("price", order).alias("_open"), F.max_by("price", order).alias("_close"), F.max_by(sign(F.col("_diff")), F.when(sign(F.col("_diff")).isNotNull(), order)).alias("_sign"))
    by_date = Window.partitionBy(*of, "trade_date").orderBy("_segment")
    met = ends.withColumn("_prior", F.lag("_close").over(by_date)).withColumn("_first", sign(F.col("_open") - F.col("_prior")))
    told = F.last(F.coalesce("_sign", "_first"), ignorenulls=True).over(by_date.rowsBetween(Window.unboundedPreceding, -1))
    handed = met.select(*keys, "_prior", told.alias("_before"))
    # null dates have a partition of their own in windows, and a null date's segments meet again here
    theirs = [f"_of_{k}" for k in keys]
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(t)) for k, t in zip(keys, theirs, strict=True)])
    joined = moved.join(handed.toDF(*theirs, "_prior", "_before"), same, "left")
    whole = joined.withColumn("price_diff", F.when(F.row_number().over(inside) == 1, F.col("price") - F.col("_prior")).otherwise(F.col("_diff")))
    ruled = whole.withColumn("direction", F.coalesce(F.last(sign(F.col("price_diff")), ignorenulls=True).over(so_far), "_before", F.lit(0)).cast("tinyint"))
    side = lambda d: F.when(F.col("direction") == d, F.col("trade_volume")).otherwise(F.lit(0).cast("long"))
    return ruled.withColumns({"buy_vol": side(1), "sell_vol": side(-1)}).drop("_segment", "_diff", "_prior", "_before", *theirs)


def normalised(ticks: DataFrame, symbol: str | None = None) -> DataFrame:
    """Nearest-contract regular trades with direction, session and symbol, in the columns of TICK_COLUMNS.

    Ticks of many symbols have a column `symbol` and are worked on at once; those of one symbol get its name.
    """
    if symbol is None and not series(ticks):
        raise ValueError("ticks need a column symbol, or the name of their symbol")
    ruled = with_direction(regular(near_contract(ticks)))
    return ruled.withColumns(
        {
            "session_date_jst": clock.vendor_date(F.col("trade_date")),
            "session_type": clock.session_type(F.col("trade_ts")),
            "contract_code": F.col("contract_month").cast("string"),
            "symbol": F.col("symbol") if symbol is None else F.lit(symbol),
        }
    ).select(*TICK_COLUMNS)
