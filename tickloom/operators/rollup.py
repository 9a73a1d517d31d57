"""Totals by levels, and sketches that are kept by day and merged by week."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The sets of columns by which totals are taken, from the finest to the grand total.
LEVELS = (("session_date_jst", "session_type", "symbol"), ("session_date_jst", "session_type"), ("session_date_jst",), ("symbol",), ())
KEYS = ("session_date_jst", "session_type", "symbol")


def totals(rows: DataFrame, levels: tuple[tuple[str, ...], ...] = LEVELS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """level (a bit for each key that is summed over, the first key's being the highest), keys, and totals of normalised
    ticks: one pass, each row copied once for each level and combined before its shuffle.

    A null in a key and a key that is summed over look alike; level tells them apart.
    """
    made = rows.groupingSets([[F.col(c) for c in level] for level in levels], *keys)
    return made.agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum("trade_volume").alias("volume"), F.min("price").alias("low"), F.max("price").alias("high"))


#: log2 of an HLL sketch's registers; its error is about 1.04 / 2 ** (HLL / 2). The k of a KLL sketch; its error in ranks
#: is about 1.65 %.
HLL, KLL = 12, 200


def daily_sketches(rows: DataFrame, who: str, value: str, by: tuple[str, ...] = ("session_date_jst",)) -> DataFrame:
    """A row for each day: n, and sketches of the distinct `who` and of the distribution of `value`, of bounded size."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(who, HLL).alias("who"), F.kll_sketch_agg_double(F.col(value).cast("double"), KLL).alias("value"))


def merged_sketches(days: DataFrame, week: str, quantiles: tuple[float, ...] = (0.5,)) -> DataFrame:
    """Sketches of days merged by a column such as the week: n, about_who and the quantiles; no row is read again."""
    whole = days.groupBy(week).agg(F.sum("n").alias("n"), F.hll_union_agg("who").alias("who"), F.kll_merge_agg_double("value").alias("value"))
    return whole.select(week, "n", F.hll_sketch_estimate("who").alias("about_who"), *[F.kll_sketch_get_quantile_double("value", F.lit(q)).alias(f"q{round(100 * q)}") for q in quantiles])
