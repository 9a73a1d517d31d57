"""What joins share: broadcasts behind a count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import settled

#: Narrow rows that are broadcast at most.
MOST_ROWS = 200_000


def bounded(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """df for the small side of a join, computed once: to be broadcast if it has at most so many rows, else without a hint,
    so that both sides are dealt by their keys. Rows are counted as they are written."""
    seen = Observation()
    rows = settled(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return F.broadcast(rows) if seen.get["n"] <= most else rows
