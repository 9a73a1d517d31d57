"""What the operators share: tables, checkpoints and the held-out rule."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions inside are deleted when each action ends, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared checkpoint folder, so that lineage ends there.

    The folder is the one in spark.checkpoint.dir; only a session on one machine (a local test) gets a folder here where
    that is unset. A cluster without one raises: executors would write to their own disks.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    with passing_shuffles(df.sparkSession):
        return df.select("*").checkpoint()  # a plan made here: its shuffle files go when it is written


#: A key is hot if it has more than one in HOT_SHARE of the rows, and more than HOT_LEAST: there are fewer than HOT_SHARE.
HOT_SHARE, HOT_LEAST = 1000, 200


def hot_limit(n: int) -> int:
    """Rows of n that make a key hot."""
    return max(HOT_LEAST, n // HOT_SHARE)


def hot_keys(df: DataFrame, key: str) -> list:
    """The keys, fewer than HOT_SHARE, that hold so many rows of df that a task with one of them would be slow."""
    with passing_shuffles(df.sparkSession):
        counts = df.groupBy(key).count().filter((F.col("count") > hot_limit(df.count())) & F.col(key).isNotNull())
        return [r[0] for r in counts.select(key).collect()]


def joined(left: DataFrame, right: DataFrame, key: str, hot: list | None = None, how: str = "inner") -> DataFrame:
    """The inner or left join of left with right, a row for each key, where keys may be hot on the left.

    Rows of hot keys stay where they are: the few rows on the right, one for each such key, come to them by broadcast.
    `left` is read twice or three times, so it should be a checkpoint.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    few = F.col(key).isin(hot)
    return left.filter(~few).join(right.filter(~few), key, how).unionByName(left.filter(few).join(F.broadcast(right.filter(few)), key, how))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the rule that holds documents out of training (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone: extra columns, whatever their names, can't clash with those that an operator makes."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: Bytes of text that a Python worker takes up at once.
BYTES_AT_ONCE = 1 << 19


def slices(batches: Iterator[pa.RecordBatch], column: int | str, most: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose texts have about so many bytes, so that a worker's memory doesn't follow the batch.

    A longer text is a part of its own.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
