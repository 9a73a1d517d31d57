"""What signals would have earned: each one on its own, by the first bar that reaches its stop or target."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scope import day, series


@dataclass(frozen=True)
class Bet:
    threshold: float = 0.82  # least score of a signal
    stop: float = 500.0  # points against the entry
    target: float = 1250.0  # points in its favour
    hold: int = 720  # bars held at most
    multiplier: float = 100
    cost: float = 80


#: Bars of a block, whose extremes tell whether a signal can end in it.
BLOCK = 32


def signal_outcomes(scored: DataFrame, bet: Bet = Bet(), block: int = BLOCK) -> DataFrame:
    """A row for each signal of scored bars (bar_start_jst, session_*, raw_*, prob, momentum): when, how and at what it ends.

    A signal enters at the next bar's open, long for a positive momentum and short for a negative one; the day's last bar
    and momentum 0 or null give none. It ends where a bar's range reaches the stop (SL, also if it reaches the target as
    well) or the target (TP), else at the close of the last bar held, or of the day (TIME). Signals don't wait for each
    other, so there is no state. With a column symbol, each symbol is a series of its own.

    A signal first asks the blocks of bars that it may be held over for their lowest low and highest high; then it looks at
    the bars of the first whole block that must end it, of the blocks at either end that may, and at its last bar. So of
    720 bars it meets some 24 blocks and a block or two of bars.
    """
    date = [*series(scored), "session_date_jst"]
    bar = ["bar_start_jst", *date, "session_type"]
    keys = [*date, "_i"]
    over = day(*series(scored))
    numbered = scored.withColumns({"_i": F.row_number().over(over), "_n": F.count("*").over(Window.partitionBy(*date))})
    ahead = lambda x: F.lead(x).over(over)
    looked = numbered.withColumns({"entry_price": ahead("raw_open"), "entry_time": ahead("bar_start_jst")})
    wanted = (F.col("prob").cast("double") >= bet.threshold) & (F.col("momentum") != 0) & F.col("entry_time").isNotNull()
    signals = looked.filter(wanted).select(
        *(*bar, "entry_time", "entry_price"),
        F.when(F.col("momentum") > 0, 1).otherwise(-1).alias("_side"),
        (F.col("_i") + 1).alias("_first"),
        F.least(F.col("_i") + bet.hold, F.col("_n")).cast("int").alias("_last"),
    )
    bars = numbered.select(*keys, F.col("bar_start_jst").alias("exit_time"), F.col("raw_high").alias("_high"), F.col("raw_low").alias("_low"), F.col("raw_close").alias("_close"))
    stop, goal = F.col("entry_price") - F.col("_side") * bet.stop, F.col("entry_price") + F.col("_side") * bet.target
    long = F.col("_side") > 0
    stopped = F.when(long, F.col("_low") <= stop).otherwise(F.col("_high") >= stop)
    reached = F.when(long, F.col("_high") >= goal).otherwise(F.col("_low") <= goal)
    # blocks that may end it
    number = lambda i: F.floor((F.col(i) - 1) / block).cast("int")
    extremes = bars.groupBy(*date, number("_i").alias("_block")).agg(F.max("_high").alias("_high"), F.min("_low").alias("_low"))
    asked = signals.withColumn("_block", F.explode(F.sequence(number("_first"), number("_last")))).join(extremes, [*date, "_block"]).filter(stopped | reached)
    whole = (F.col("_block") * block >= F.col("_first") - 1) & (F.col("_block") * block + block <= F.col("_last"))
    told = asked.groupBy(*date, "_first").agg(F.min(F.when(whole, F.col("_block"))).alias("_must"), F.collect_list(F.when(~whole, F.col("_block"))).alias("_may"))
    # their bars, and the last one
    own = F.filter(F.concat(F.coalesce("_may", F.array().cast("array<int>")), F.array("_must")), lambda b: b.isNotNull())
    inside = F.transform(own, lambda b: F.sequence(F.greatest(F.col("_first"), b * block + 1), F.least(F.col("_last"), b * block + block)))
    held = signals.join(told, [*date, "_first"], "left").withColumn("_i", F.explode(F.array_distinct(F.concat(F.flatten(inside), F.array("_last"))))).drop("_must", "_may")
    reason = F.when(stopped, "SL").when(reached, "TP")
    met = held.join(bars, keys).withColumns({"_reason": reason, "_price": F.when(stopped, stop).when(reached, goal).otherwise(F.col("_close"))})
    end = F.struct(F.coalesce("_reason", F.lit("TIME")).alias("reason"), F.col("exit_time"), F.col("_price").alias("exit_price"))
    # the first bar that ends it; of none, the last one
    place = F.when(F.col("_reason").isNotNull(), F.col("_i") - (1 << 30)).otherwise(-F.col("_i"))
    ended = met.groupBy(*bar, "entry_time", "entry_price", "_side").agg(F.min_by(end, place).alias("end"))
    return ended.select(
        *bar,
        "entry_time",
        "end.exit_time",
        F.when(F.col("_side") > 0, "LONG").otherwise("SHORT").alias("direction"),
        "entry_price",
        "end.exit_price",
        ((F.col("end.exit_price") - F.col("entry_price")) * F.col("_side") * bet.multiplier - bet.cost).alias("pnl"),
        "end.reason",
    )
