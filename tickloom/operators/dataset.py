"""Training sets: statistics, scaling, labels, sequences and walk-forward splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.blocks import values_at_ranks
from ..functions.scope import day, series
from ..session import settled

NOT_FEATURES = ("raw_open_abs", "raw_high_abs", "raw_low_abs", "raw_close_abs")


def feature_columns(df: DataFrame, label: str) -> list[str]:
    """Numeric columns without the label and the absolute prices; reads the schema alone."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name != label and f.name not in NOT_FEATURES]


def feature_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """A row per feature: mean and sample deviation, 1 where that is null or 0.

    The wide frame is turned to (feature, value) rows, so that a few hundred features stay one small aggregate.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]))
    stats = df.select(pairs.alias("p")).select("p.*").groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return stats.withColumn("std", F.when(F.col("std") > 0, F.col("std")).otherwise(1.0))


def nearest_quantile(df: DataFrame, name: str, q: float) -> float | None:
    """The value at rank round((n - 1) q) from 0, halves to even; None of no values. Python's round() does the same."""
    found = values_at_ranks(df, name, lambda n: [round((n - 1) * q)])
    return found[0] if found else None


def scaled(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """Features less their mean by their deviation."""
    return df.withColumns({f: (F.col(f) - F.lit(m)) / F.lit(s) for f, (m, s) in stats.items()})


def binarised(df: DataFrame, label: str, threshold: float | None) -> DataFrame:
    """1 where the label reaches the threshold, else 0; null stays null, and all is null without a threshold."""
    return df.withColumn(label, (F.col(label) >= F.lit(threshold).cast("double")).cast("float"))


def prepared(df: DataFrame, features: list[str], label: str, q: float, keys: tuple[str, ...] = ("bar_start_jst", "session_date_jst", "session_type")) -> DataFrame:
    """keys, scaled features and the binarised label. The frame is computed once, its needed columns alone; means,
    deviations and the label's quantile are taken from what was written."""
    kept = settled(df.select(*keys, *features, label))
    stats = {r["feature"]: (r["mean"], r["std"]) for r in feature_stats(kept, features).collect()}  # a row a feature
    return binarised(scaled(kept, stats), label, nearest_quantile(kept, label, q))


def sequences(df: DataFrame, features: list[str], label: str, length: int = 60, session: str = "ALL") -> DataFrame:
    """The last `length` rows of the day as an array of feature arrays, at every row where they are whole.

    A window may begin in another session; its last row is of the asked one. Rows with a null in a feature or the label
    spoil every window that holds them.
    """
    spoilt = reduce(lambda a, b: a | b, [F.col(x).isNull() for x in (*features, label)]).cast("int")
    frame = day(*series(df)).rowsBetween(1 - length, 0)
    rows = df.withColumns(
        {
            "sequence": F.collect_list(F.array(*[F.col(f).cast("double") for f in features])).over(frame),
            "_spoilt": F.sum(spoilt).over(frame),
        }
    ).filter((F.size("sequence") == length) & (F.col("_spoilt") == 0))
    return (rows if session == "ALL" else rows.filter(F.col("session_type") == session)).drop("_spoilt")


def walk_forward(dates: DataFrame, train: int, valid: int, test: int, step: int = 1, date_col: str = "session_date_jst") -> DataFrame:
    """(window, part, date): sliding splits of the sorted dates; a window is named by its first test date.

    Each date finds its windows by arithmetic on its number and explodes into them: no range join. Only the distinct
    dates pass through the one unpartitioned window.
    """
    ordered = dates.select(F.col(date_col).alias("date")).distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    n = F.count("*").over(Window.partitionBy())
    length = train + valid + test
    numbered = ordered.withColumn("n", n)
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - (length - 1)) / step)).cast("long")
    last = F.least(F.floor(F.col("i") / step), F.floor((F.col("n") - length) / step)).cast("long")
    members = numbered.filter(first <= last).select("date", "i", F.explode(F.sequence(first, last)).alias("k"))
    place = F.col("i") - F.col("k") * step
    parts = members.withColumn("part", F.when(place < train, "train").when(place < train + valid, "valid").otherwise("test"))
    named = ordered.select(F.col("date").alias("window"), F.col("i").alias("_first"))
    return parts.join(named, F.col("k") * step + (train + valid) == F.col("_first")).select("window", "part", "date")


def long_enough(df: DataFrame, rows: int, key: str = "session_date_jst") -> DataFrame:
    """Rows of those dates, of a symbol, that have more than so many."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*series(df), key))).filter(F.col("_n") > rows).drop("_n")
