"""Column formulas without a window of their own. All are safe under ANSI rules: nothing divides by zero."""

from __future__ import annotations

import math

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from .scope import last_rows, so_far

#: Denominators this small count as none.
TINY = 1e-9


def ratio(above: Column, below: Column, default: float = 0.0) -> Column:
    """above / below; the default where below is tiny or null."""
    return F.when(F.abs(below) > TINY, above / below).otherwise(F.lit(default))


def log_of(x: Column) -> Column:
    """The logarithm as IEEE doubles have it: -inf of 0, NaN of less. F.ln alone gives null for both."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(-math.inf)).when(x < 0, F.lit(math.nan))


def quotient(above: Column, below: Column) -> Column:
    """above / below as IEEE doubles have it: inf, -inf or NaN where below is 0, which ANSI rules refuse to divide by."""
    return F.when(below != 0, above / below).when(below == 0, above * F.lit(math.inf))


def log1p_or_null(x: Column) -> Column:
    return F.when(x > -1, F.log1p(x))


def floored(x: Column) -> Column:
    """x, or 0 if it is less; null stays null, which greatest() would lose."""
    return F.when(x < 0, 0.0).otherwise(x)


def log_change(x: Column, over: WindowSpec, lag: int = 1) -> Column:
    return F.ln(x) - F.ln(F.lag(x, lag).over(over))


def change_share(x: Column, over: WindowSpec, lag: int) -> Column:
    """(x - x before) / x before; 0 where there is none before."""
    before = F.lag(x, lag).over(over)
    return ratio(x - before, before)


def slope(x: Column, over: WindowSpec, lag: int) -> Column:
    return (x - F.lag(x, lag).over(over)) / F.lit(float(lag))


def rolling(how, x: Column, over: WindowSpec, rows: int, least: int) -> Column:
    """An aggregate of the last rows; null while fewer than `least` of them hold a value."""
    frame = last_rows(over, rows)
    return F.when(F.count(x).over(frame) >= least, how(x).over(frame))


def zscore(name: str, over: WindowSpec, rows: int) -> dict[str, Column]:
    """Mean, deviation and z-score of a column over the last rows, by their column names."""
    x, least = F.col(name), max(5, rows // 4)
    mean, deviation = rolling(F.avg, x, over, rows, least), rolling(F.stddev_samp, x, over, rows, least)
    return {f"__{name}_mean_{rows}": mean, f"__{name}_std_{rows}": deviation, f"{name}_z_{rows}": ratio(x - mean, deviation)}


def filled_forward(x: Column, over: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(so_far(over))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def bin_floor(x: Column, width: int) -> Column:
    return (F.floor(x / F.lit(float(width))) * width).cast("int")


def padded(x: Column, width: int) -> Column:
    """Zeros on the left up to the width; longer text stays as it is."""
    text = x.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)
