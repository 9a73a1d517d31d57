"""Ordered work over a whole table in blocks, so that no task sees the whole order.

A table is cut at quantiles of the leading order column, or, by any columns, into the ranges that Spark's own sampling
finds. Work inside blocks is a window by block; only block totals pass through a window without a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import settled

ROWS_A_BLOCK = 100_000
#: Blocks at most; beyond, blocks grow with the table and their sorts spill.
MOST_BLOCKS = 1024


def cuts_of(df: DataFrame, name: str) -> list:
    """Sorted quantiles that cut df into blocks of about ROWS_A_BLOCK rows: one pass, at most MOST_BLOCKS values."""
    n = df.count()
    blocks = min(MOST_BLOCKS, n // ROWS_A_BLOCK + 1)
    if blocks < 2:
        return []
    found = df.agg(F.percentile_approx(name, [i / blocks for i in range(1, blocks)], 10 * blocks)).first()[0]
    return sorted(set(found or []))


def block_of(x: Column, cuts: list) -> Column:
    """How many cuts lie below x, by halving; null is in the first block."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(x > F.lit(cuts[mid]), among(mid + 1, high)).otherwise(among(low, mid))

    return among(0, len(cuts))


def within(*order: str) -> WindowSpec:
    """The rows of a block up to the current one."""
    return Window.partitionBy("_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def before() -> WindowSpec:
    """Block totals of the blocks before."""
    return Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def running_sum(df: DataFrame, value: str, order: tuple[str, ...], name: str) -> DataFrame:
    """df with the sum of value over all rows up to each row's place in the order. Blocks are cut by the whole order, so rows
    that share its first column, however many, are many blocks."""
    placed = ordered_blocks(df, list(order))
    totals = placed.groupBy("_block").agg(F.sum(value).alias("_total"))
    offsets = totals.select("_block", F.coalesce(F.sum("_total").over(before()), F.lit(0)).alias("_before"))
    inner = placed.withColumn("_inner", F.sum(value).over(within(*order)))
    return inner.join(offsets, "_block").withColumn(name, F.col("_before") + F.col("_inner")).drop("_block", "_before", "_inner")


def values_at_ranks(df: DataFrame, name: str, ranks) -> list:
    """The values of a column at ranks(n), whole numbers from 0 among its n values that aren't null; [] of none.

    Values are counted first, equal ones once; block totals tell which block holds a rank, and only that block is ordered.
    """
    counted = df.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(F.count("*").alias("n")).persist()
    try:
        placed = counted.withColumn("_block", block_of(F.col("v"), cuts_of(counted, "v")))
        totals = sorted((r[0], r[1]) for r in placed.groupBy("_block").agg(F.sum("n")).collect())
        out = []
        for rank in ranks(sum(n for _, n in totals)) if totals else []:
            for block, n in totals:
                if rank < n:
                    break
                rank -= n
            upto = F.sum("n").over(within("v"))
            hit = placed.filter(F.col("_block") == block).withColumn("upto", upto).filter((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank))
            out.append(hit.first()["v"])
        return out
    finally:
        counted.unpersist()


def ordered_blocks(df: DataFrame, order: list[str], rows_a_block: int | None = None) -> DataFrame:
    """df with _block, a range of the order: all rows of a block come before those of the next.

    Blocks are as many as shuffles have partitions, or more, so that each has about rows_a_block (ROWS_A_BLOCK) rows at most; a row that
    is repeated in all of `order` stays in one. The rows are written once, so that every later reading sees one cut.
    """
    n = df.count()
    spread = min(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(max(1, spread, -(-n // (rows_a_block or ROWS_A_BLOCK))), *order)
    return settled(dealt.withColumn("_block", F.spark_partition_id()))


def carried(placed: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds to the rows of ordered_blocks (cut by `by` and `order`) the last value that isn't null among the rows of the same
    `by` up to and with each row; null where there is none.

    Within a block it is a window; what a block hands on is one row, and rows of the next blocks take it if it is of their
    own `by`. So a key with any share of the rows is worked on by as many tasks as it has blocks.
    """
    own = F.struct(*[F.col(c) for c in by])
    told = F.when(value.isNotNull(), F.struct(own.alias("by"), value.alias("value")))
    inner = Window.partitionBy("_block").orderBy(*by, *order).rowsBetween(Window.unboundedPreceding, 0)
    rank = F.struct(*[F.col(c) for c in (*by, *order)])
    ends = placed.groupBy("_block").agg(F.max_by(told, F.when(value.isNotNull(), rank)).alias("_end"))
    handed = ends.select("_block", F.last("_end", ignorenulls=True).over(before()).alias("_handed"))
    met = placed.withColumn("_within", F.last(told, ignorenulls=True).over(inner)).join(handed, "_block", "left")
    of = lambda c: F.when(F.col(c)["by"].eqNullSafe(own), F.col(c)["value"])
    return met.withColumn(name, F.coalesce(of("_within"), of("_handed"))).drop("_within", "_handed")
