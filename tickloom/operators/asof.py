"""Joins by time: the last row before each row, and rows inside intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import ROWS_A_BLOCK, carried, ordered_blocks
from ..functions.joins import bounded


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, tie: str | None = None, within: str | None = None, prefix: str = "", rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """left with the columns of the last row of right of the same `by` whose time `at` isn't after the row's own.

    Both sides have the columns of `by` and `at`; the others of right get the prefix, its time as {prefix}{at}_matched.
    Of rows of right with equal times the one with the greatest `tie` counts. With `within`, an interval such as
    "5 minutes", a match that is older is none. Rows of left without a match, with a null key or a null time stay, with
    nulls; rows of right with those never match. Equal rows of left all stay.

    The two are put together in order and the last row of right is carried along: no join of ranges. A key with any share
    of the rows is cut into blocks of the order, which hand one row on (blocks.carried).
    """
    kind = lambda n: F.lit(n).alias("_kind")
    keys = [F.col(c) for c in by]
    others = [c for c in right.columns if c not in (*by, at)]
    known = right.filter(" and ".join(f"`{c}` is not null" for c in (*by, at)))
    told = F.struct(F.col(at).alias("_at"), *[F.col(c) for c in others])
    ours = left.select(*keys, F.col(at).alias("_time"), kind(1), F.lit(None).alias("_tie") if tie is None else F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"))
    theirs = known.select(*keys, F.col(at).alias("_time"), kind(0), (F.lit(None) if tie is None else F.col(tie)).alias("_tie"), told.alias("_told"))
    order = ["_time", "_kind", *(["_tie"] if tie else [])]
    both = ours.unionByName(theirs, allowMissingColumns=True)
    both = both if tie else both.drop("_tie")
    placed = ordered_blocks(both, [*by, *order], rows_a_block)
    swept = carried(placed, by, order, F.when(F.col("_kind") == 0, F.col("_told")), "_match").filter("_kind = 1")
    fits = F.col("_time").isNotNull()
    for c in by:
        fits = fits & F.col(c).isNotNull()
    if within:
        fits = fits & (F.col("_match._at") >= F.col("_time") - F.expr(f"INTERVAL {within}"))
    match = lambda c: F.when(fits, F.col(f"_match.{c}"))
    return swept.select("_row.*", match("_at").alias(f"{prefix}{at}_matched"), *[match(c).alias(f"{prefix}{c}") for c in others])


#: Points of one bucket that one task joins.
ROWS_A_PART = 100_000


def inside(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, width: int, rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """The pairs of a point and a span of the same `by` with start <= at < end; all columns of both, `by` once.

    Time is cut into buckets of `width` seconds: a span is copied to those that it touches (choose width near the usual
    length), a point lies in one, and the two meet by equality. A bucket with more than rows_a_part points is dealt to
    several parts, to each of which its spans are copied, so a hot minute is many tasks. Nulls match nothing; a span that
    doesn't end after it starts holds nothing; repeated rows make pairs of their own.
    """
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    step = width * 1_000_000
    bucket = lambda micros: F.floor(micros / F.lit(step)).cast("long")
    placed = points.withColumn("_bucket", bucket(seconds(at)))
    keys = [*by, "_bucket"]
    crowded = placed.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows_a_part).select(*keys, F.ceil(F.col("_n") / rows_a_part).cast("int").alias("_parts"))
    crowded = bounded(crowded)  # fewer than one in rows_a_part rows
    parts = F.coalesce("_parts", F.lit(1))
    dealt = placed.join(crowded, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*[F.col(c) for c in points.columns if not points.schema[c].dataType.simpleString().startswith("map")]), parts).cast("int")).drop("_parts")
    whole = spans.filter(F.col(start) < F.col(end))
    touched = whole.withColumn("_bucket", F.explode(F.sequence(bucket(seconds(start)), bucket(seconds(end) - 1))))
    copied = touched.join(crowded, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    met = dealt.join(copied, [*keys, "_part"])
    return met.filter((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_bucket", "_part")


def unmatched(name: str) -> Column:
    """Whether a row of as_of found nothing: its matched time is null."""
    return F.col(name).isNull()
