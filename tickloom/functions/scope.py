"""The partitions over which rows are ordered. Each is made once: a feature frame asks for them some hundred times.

Rows of many symbols may stand in one frame. Its series, the columns that tell them apart, lead every partition: symbols
don't meet in a window, and (symbol, date) is the unit of work, not the date.
"""

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SESSION_KEYS = ("session_date_jst", "session_type")
BAR = "bar_start_jst"


def series(df: DataFrame) -> tuple[str, ...]:
    """The columns that tell the symbols of a frame apart: symbol, or none where the frame is one symbol's."""
    return ("symbol",) if "symbol" in df.columns else ()


def placed(time: str, number: str) -> Column:
    """The place of a tick or quote, for min_by and max_by: its time, among equal times its number, unknown numbers last."""
    return F.struct(time, F.col(number).isNull().alias("_unknown"), number)


@lru_cache
def session(*series: str) -> WindowSpec:
    """Bars of one date and session type; evening and late bars of one date share it."""
    return Window.partitionBy(*series, *SESSION_KEYS).orderBy(BAR)


@lru_cache
def day(*series: str) -> WindowSpec:
    """All bars of one date, night and day together."""
    return Window.partitionBy(*series, "session_date_jst").orderBy(BAR)


@lru_cache
def last_rows(spec: WindowSpec, n: int) -> WindowSpec:
    """The frame of the last n rows, the current one among them."""
    return spec.rowsBetween(1 - n, 0)


@lru_cache
def so_far(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, 0)


@lru_cache
def ahead(spec: WindowSpec, n: int) -> WindowSpec:
    """The frame of the n rows after the current one."""
    return spec.rowsBetween(1, n)


@lru_cache
def session_seconds(*series: str) -> WindowSpec:
    """Bars of one session, ordered by the seconds of their start, so that frames can be spans of time."""
    return Window.partitionBy(*series, *SESSION_KEYS).orderBy(F.unix_seconds(F.col(BAR).cast("timestamp")))


@lru_cache
def last_seconds(spec: WindowSpec, n: int) -> WindowSpec:
    """The frame of the last n seconds, the current row's own among them: rows that are further back in time than that
    aren't in it, however few rows there are between."""
    return spec.rangeBetween(1 - n, 0)
