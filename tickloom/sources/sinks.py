"""Partitioned writers. A write replaces the partitions that it has rows of and no others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import bounded
from ..session import settled


def _write(df: DataFrame, path: str, partitions: list[str], order: list[str]) -> None:
    """Rows are dealt by their partition, and a partition of more bytes than spark.sql.adaptive.advisoryPartitionSizeInBytes
    is split among tasks, small ones being put together: a hot date is many files, each in order."""
    dealt = df.hint("rebalance", *partitions).sortWithinPartitions(*partitions, *order)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*partitions).parquet(path)


def by_date(df: DataFrame, path: str, order: tuple[str, ...] = ("trade_ts", "sequence_no"), lead: tuple[str, ...] = ()) -> None:
    """A folder for each year and trade date, in the given order; `lead` columns, such as symbol, come above the year."""
    _write(df.withColumn("year", F.year("session_date_jst")), path, [*lead, "year", "session_date_jst"], list(order))


def read_dates(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What by_date has written of frames like this one; none of a frame without rows, which leaves no file to tell its
    columns."""
    return spark.read.schema(like.withColumn("year", F.lit(0)).schema).parquet(path)


def by_month(df: DataFrame, path: str, time_col: str = "trade_ts") -> None:
    _write(df.withColumn("period", F.date_format(time_col, "yyyyMM")), path, ["period"], [time_col])


def by_arrival(segments: DataFrame, path: str, arrival: str) -> None:
    """Segments of one file, kept under its name: a file that is delivered again replaces its own segments and no others."""
    _write(segments.withColumn("arrival", F.lit(arrival)), path, ["session_date_jst", "arrival"], ["bar_start_jst"])


def merged(spark: SparkSession, segments: DataFrame, path: str, arrival: str) -> DataFrame:
    """Files the segments under `path` and returns all segments of the dates that they touch, those of earlier files
    included. What was written before is read by its dates alone, and no tick is read again."""
    kept = settled(segments)
    by_arrival(kept, path, arrival)
    dates = bounded(kept.select("session_date_jst").distinct())
    return spark.read.schema(kept.schema).parquet(path).join(dates, "session_date_jst", "left_semi")


def write_records(df: DataFrame, path: str) -> None:
    """Model records as JSON lines; the edge has 2 and the threshold 4 decimals, halves to even."""
    df.withColumns({"edge": F.bround("edge", 2), "prob_threshold": F.bround("prob_threshold", 4)}).write.mode("append").json(path)


RECORD = "date string, session string, edge double, prob_threshold double, threshold_source string, high_conf_percentile double, direction_source string, train_start string, train_end string, valid_start string, valid_end string, test_start string, test_end string"


def read_records(spark: SparkSession, path: str, least_edge: float | None = None) -> DataFrame:
    """Model records; edge and threshold default to 0, lines that aren't records go. Above least_edge alone if given."""
    rows = spark.read.schema(RECORD).option("mode", "DROPMALFORMED").json(path)
    rows = rows.withColumns({"edge": F.coalesce("edge", F.lit(0.0)), "prob_threshold": F.coalesce("prob_threshold", F.lit(0.0))})
    return rows if least_edge is None else rows.filter(F.col("edge") > least_edge)
