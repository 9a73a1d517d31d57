"""What trades earned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks

#: Exit reasons in the order of reports.
REASONS = ("TP", "SESSION", "SL", "TIME", "WEAK")


def totals(trades: DataFrame) -> DataFrame:
    """One row: how many trades, won and lost, gross and net, win rate in percent, profit factor (infinite without a loss)."""
    won, pnl = F.col("pnl") > 0, F.col("pnl")
    sums = trades.agg(
        F.count("*").alias("n_trades"),
        F.count_if(won).alias("n_wins"),
        F.count_if(~won).alias("n_losses"),
        F.coalesce(F.sum(F.when(won, pnl)), F.lit(0.0)).alias("gross_profit"),
        F.coalesce(F.abs(F.sum(F.when(~won, pnl))), F.lit(0.0)).alias("gross_loss"),
        F.coalesce(F.sum(pnl), F.lit(0.0)).alias("net"),
    )
    return sums.withColumns(
        {
            "win_rate": F.when(F.col("n_trades") > 0, F.col("n_wins") / F.col("n_trades") * 100).otherwise(0.0),
            "profit_factor": F.when(F.col("gross_loss") > 0, F.col("gross_profit") / F.col("gross_loss")).otherwise(F.lit(float("inf"))),
        }
    )


def equity_curve(trades: DataFrame, order: tuple[str, ...] = ("exit_time",), keys: tuple[str, ...] = ()) -> DataFrame:
    """Trades with `equity`, the profit so far, within `keys` if given; without, the sum runs in blocks of the order."""
    if not keys:
        return blocks.running_sum(trades, "pnl", order, "equity")
    over = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return trades.withColumn("equity", F.sum("pnl").over(over))


def max_drawdown(trades: DataFrame, order: tuple[str, ...] = ("exit_time",), keys: tuple[str, ...] = ()) -> DataFrame:
    """The deepest fall of the equity below its highest so far; the first trade's equity is the first high.

    Without keys, each block of the order tells its sum, its highest and lowest equity and its deepest fall; from these a
    fall across blocks is known.
    """
    if keys:
        over = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        curve = equity_curve(trades, order, keys).withColumn("high", F.max("equity").over(over))
        return curve.groupBy(*keys).agg(F.max(F.col("high") - F.col("equity")).alias("max_drawdown"))
    placed = blocks.ordered_blocks(trades.select("pnl", *order), list(order))
    inside = placed.withColumn("equity", F.sum("pnl").over(blocks.within(*order))).withColumn("high", F.max("equity").over(blocks.within(*order)))
    totals = inside.groupBy("_block").agg(F.sum("pnl").alias("total"), F.max("equity").alias("high"), F.min("equity").alias("low"), F.max(F.col("high") - F.col("equity")).alias("fall"))
    offset = totals.withColumn("before", F.coalesce(F.sum("total").over(blocks.before()), F.lit(0.0)))
    across = offset.withColumn("earlier", F.max(F.col("before") + F.col("high")).over(blocks.before()))
    return across.agg(F.max(F.greatest("fall", F.coalesce(F.col("earlier") - F.col("before") - F.col("low"), F.col("fall")))).alias("max_drawdown"))


def by_reason(trades: DataFrame) -> DataFrame:
    """A row per exit reason that occurs, with its place in reports."""
    place = F.array_position(F.array(*[F.lit(r) for r in REASONS]), F.col("reason")).cast("int")
    return trades.groupBy("reason").agg(F.count("*").alias("n"), (F.count_if(F.col("pnl") > 0) / F.count("*") * 100).alias("win_rate"), F.sum("pnl").alias("net")).withColumn("place", place)


def excursions(trades: DataFrame) -> DataFrame:
    """One row: the mean favourable excursion in ticks, and how many trades had one of a tick or more."""
    return trades.agg(F.avg("mfe_ticks").alias("mean_mfe"), F.count_if(F.col("mfe_ticks") >= 1).alias("n_with_mfe"))
