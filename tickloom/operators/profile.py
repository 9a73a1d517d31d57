"""Volume profiles and points of control."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bin_floor
from ..functions.scope import series

#: Look-backs in trading dates, by output column.
LOOKBACKS = {"prev_poc_1d": 1, "prev_poc_1w": 5, "prev_poc_4w": 20}


def volume_profile(bars: DataFrame, bin_size: int = 10, time_col: str = "trade_ts") -> DataFrame:
    """Volume by date and price bin, of each symbol where there are many."""
    return bars.groupBy(*series(bars), F.to_date(time_col).alias("date"), bin_floor(F.col("close"), bin_size).alias("price_bin")).agg(F.sum("volume").alias("volume"))


def rolling_poc(profile: DataFrame, lookbacks: dict[str, int] = LOOKBACKS) -> DataFrame:
    """The bin of most volume over the dates before each date; null until there are enough dates; ties go to the lowest bin.

    Each day's bins are copied to the dates that look back on them and joined there by a dense date number, so the
    range condition is an equi-join; dates alone, a row each, pass through the window that numbers them, symbol by symbol.
    """
    of = series(profile)
    numbers = Window.partitionBy(*of).orderBy("date")
    dates = profile.select(*of, "date").distinct().withColumn("i", F.row_number().over(numbers))
    numbered = profile.join(dates, [*of, "date"]).select(*of, "i", "price_bin", "volume")
    out = dates
    for name, n in lookbacks.items():
        copies = numbered.select(*of, F.explode(F.sequence(F.col("i") + 1, F.col("i") + n)).alias("i"), "price_bin", "volume")
        sums = copies.groupBy(*of, "i", "price_bin").agg(F.sum("volume").alias("v"))
        poc = sums.groupBy(*of, "i").agg(F.max_by("price_bin", F.struct(F.col("v"), -F.col("price_bin"))).alias(name))
        out = out.join(poc, [*of, "i"], "left").withColumn(name, F.when(F.col("i") > n, F.col(name)))
    return out.drop("i")


def with_poc(bars: DataFrame, bin_size: int = 10, time_col: str = "trade_ts") -> DataFrame:
    """Bars with the points of control of the dates before theirs."""
    poc = rolling_poc(volume_profile(bars, bin_size, time_col))
    return bars.withColumn("date", F.to_date(time_col)).join(poc, [*series(bars), "date"], "left").drop("date")
