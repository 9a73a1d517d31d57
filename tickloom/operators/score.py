"""Scores of models, and what they are worth."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import running_sum, values_at_ranks
from ..functions.scalars import sigmoid
from ..functions.scope import series, session


def percentile_threshold(df: DataFrame, score: str = "prob", percentile: float = 80.0, least: int = 5) -> float:
    """The linear percentile of the scores, 0.5 where there are fewer than `least`.

    It lies between the values of two ranks, which counts of distinct scores in blocks find.
    """

    def ranks(n: int) -> list[int]:
        nonlocal size
        size = n
        at = (n - 1) * percentile / 100
        return [math.floor(at), math.ceil(at)] if n >= least else []

    size = 0
    found = values_at_ranks(df, score, ranks)
    if not found:
        return 0.5
    share = (size - 1) * percentile / 100 % 1
    return found[0] + (found[1] - found[0]) * share


def roc_auc(df: DataFrame, score: str = "prob", label: str = "label") -> DataFrame:
    """One row: the area under the ROC curve by rank sums, ties at their middle rank; null of one class alone.

    Rows are first counted by score; the ordered sum over scores runs in blocks.
    """
    by = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("double")).alias("pos"), F.sum(1 - F.col(label).cast("double")).alias("neg"))
    below = running_sum(by, "neg", ("s",), "upto").withColumn("below", F.col("upto") - F.col("neg"))
    wins = below.select("pos", "neg", (F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("wins"))
    area = F.sum("wins") / (F.sum("pos") * F.sum("neg"))
    return wins.agg(F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), area).alias("auc"))


def precision_lift(df: DataFrame, score: str = "prob", label: str = "label", percentile: float = 80.0) -> DataFrame:
    """One row: threshold, and by how many points labels above it outdo all labels; 0.5 and 0 of fewer than 2 rows."""
    threshold = F.lit(percentile_threshold(df, score, percentile))
    chosen = df.select(score, F.col(label).cast("double").alias("y"), threshold.alias("threshold"))
    lift = (F.avg(F.when(F.col(score) >= F.col("threshold"), F.col("y"))) - F.avg("y")) * 100
    return chosen.agg(F.count("*").alias("n"), F.max("threshold").alias("threshold"), lift.alias("lift")).select(
        F.when(F.col("n") > 1, F.col("threshold")).otherwise(0.5).alias("threshold"), F.when(F.col("n") > 1, F.coalesce("lift", F.lit(0.0))).otherwise(0.0).alias("edge")
    )


def linear_scores(df: DataFrame, weights: dict[str, float], bias: float = 0.0, name: str = "prob") -> DataFrame:
    """A logistic score of the columns, inside the JVM."""
    total = F.lit(bias)
    for column, w in weights.items():
        total = total + F.col(column) * F.lit(w)
    return df.withColumn(name, sigmoid(total).cast("float"))


Scorer = Callable[[np.ndarray], np.ndarray]


def scored_sequences(df: DataFrame, scorer: Scorer, keys: list[str], sequence: str = "sequence", name: str = "prob") -> DataFrame:
    """Any model on sequences: the scorer gets (rows, steps, features) and returns a logit a row, in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = np.stack([np.stack(s) for s in frame[sequence]])
                yield frame[keys].assign(**{name: (1 / (1 + np.exp(-np.asarray(scorer(x), float)))).astype("float32")})

    kinds = dict(df.dtypes)
    return df.select(*keys, sequence).mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{name} float"]))


def score_by_session(df: DataFrame, models: dict[str, dict[str, float]], name: str = "prob") -> DataFrame:
    """Rows scored by the linear model of their own session type; null where there is none."""
    out = F.lit(None).cast("float")
    for kind, weights in models.items():
        total = F.lit(weights.get("bias", 0.0))
        for column, w in weights.items():
            if column != "bias":
                total = total + F.col(column) * F.lit(w)
        out = F.when(F.col("session_type") == kind, sigmoid(total).cast("float")).otherwise(out)
    return df.withColumn(name, out)


def with_signals(bars: DataFrame, lookback: int = 20, rise_bars: int = 5) -> DataFrame:
    """Scored bars with momentum (null at the session's start) and the rise of the score (0 there)."""
    over = session(*series(bars))
    momentum = F.col("raw_close") - F.lag("raw_close", lookback).over(over)
    rise = F.coalesce(F.col("prob") - F.lag("prob", rise_bars).over(over), F.lit(0.0))
    return bars.withColumns({"momentum": momentum, "prob_rise": rise.cast("double")})
