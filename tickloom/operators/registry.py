"""Which model scores which window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def runnable(windows: DataFrame, records: DataFrame, default_threshold: float, least_edge: float | None = None) -> DataFrame:
    """Test windows (window) with the models that were trained for them, a row per session: window, session, edge, threshold.

    A model's own threshold is used only where models are chosen by their edge, which must exceed least_edge; else the
    default holds for all. Windows without a model go.
    """
    chosen = records if least_edge is None else records.filter(F.col("edge") > least_edge)
    own = F.lit(default_threshold) if least_edge is None else F.coalesce(F.when(F.col("prob_threshold") > 0, F.col("prob_threshold")), F.lit(default_threshold))
    models = chosen.select(F.to_date("date").alias("window"), "session", "edge", own.alias("threshold"))
    return windows.select("window").distinct().join(models, "window")


def in_dates(df: DataFrame, first: str | None = None, last: str | None = None, key: str = "session_date_jst") -> DataFrame:
    """Rows of the dates between two, both included; on a partitioned table only those partitions are read."""
    if first:
        df = df.filter(F.col(key) >= F.lit(first).cast("date"))
    if last:
        df = df.filter(F.col(key) <= F.lit(last).cast("date"))
    return df
