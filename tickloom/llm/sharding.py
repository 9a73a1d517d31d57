"""Sharding by jump consistent hashing: keys find their shard without a ring table.

A key walks up the buckets: from bucket b it draws a number u in (0, 1] that only the key and b decide, and jumps to
floor((b + 1) / u). The last bucket below the shard count is its shard. The walk doesn't know the count, so one more
shard takes exactly the keys whose walk lands on it, a 1/(n + 1) share, and no key moves between the old shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import only, table

#: Rows that one task numbers at once.
ROWS_PER_BLOCK = 4096


#: Jumps that nearly every key's walk ends within, among any number of shards that there may be: it takes about their logarithm.
FEW = 32


def jump_shards(key: Column, shards: int) -> Column:
    """Struct of `shard`, the key's shard among so many, and `grown`, that among one more. Null keys walk like any other."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    def step(at: Column, _: Column) -> Column:
        draw = F.shiftrightunsigned(F.xxhash64(key, at["to"]), 33) + F.lit(1)
        jump = F.floor((at["to"] + 1).cast("double") * F.lit(float(1 << 31)) / draw.cast("double")).cast("long")
        return F.when(at["to"] > shards, at).otherwise(F.struct(F.when(at["to"] < shards, at["to"]).otherwise(at["shard"]).alias("shard"), at["to"].alias("grown"), jump.alias("to")))

    start = F.struct(F.lit(-1).cast("long").alias("shard"), F.lit(-1).cast("long").alias("grown"), F.lit(0).cast("long").alias("to"))
    walk = lambda steps, start: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    # each jump climbs by a bucket at least, so as many steps as buckets reach the end; only a rare walk takes the rest
    rest = lambda at: F.when(at["to"] > shards, at).otherwise(walk(max(1, shards + 1 - FEW), at))
    end = F.element_at(F.transform(F.array(walk(min(FEW, shards + 1), start)), rest), 1)
    return F.element_at(F.transform(F.array(end), lambda at: F.struct(at["shard"].cast("int").alias("shard"), at["grown"].cast("int").alias("grown_shard"))), 1)


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a key among so many shards, as an int."""
    return jump_shards(key, shards)["shard"]


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """A row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes (null: none) plus 16; text_crc32 is of the same bytes. The law is `key`: the id and
    the count decide the shard; grown_shard is the shard among one more. slot numbers a shard's rows from 0 without
    gaps, in the order of (block of the hashed row, id, crc, size); repeated rows get a slot each, a null id is a key
    like any other, and an empty table gives an empty table. Other columns are left out, so they can't clash.

    The numbering needs no task to see a whole shard: rows are counted by (shard, block), whose number follows the
    input, a running sum over these counts gives each block's first slot, and rows are numbered within their block.
    Rows that are the same in all columns are counted before they are shuffled and take a run of slots, so that an id
    which a third of all rows repeat makes no large block. Texts aren't shuffled.
    """
    rows = only(docs, id_col, text_col)
    body = F.coalesce(F.col(text_col), F.lit(""))
    blocks = max(1, -(-rows.count() // (shards * rows_per_block)))
    same = [id_col, "size", "text_crc32"]
    counted = rows.select(F.col(id_col), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32")).groupBy(*same).agg(F.count("*").alias("_n"))
    placed = counted.select(
        *same,
        "_n",
        F.pmod(F.xxhash64(F.lit("block"), *same), F.lit(blocks)).alias("_block"),
        # as a generator's output, the walk is not copied into filters on either side of the join
        F.inline(F.array(jump_shards(F.col(id_col), shards))),
    )
    counts = placed.groupBy("shard", "_block").agg(F.sum("_n").alias("_rows"))
    before = W.partitionBy("shard").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("shard", "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    within = W.partitionBy("shard", "_block").orderBy(*same).rowsBetween(W.unboundedPreceding, -1)
    numbered = placed.withColumn("_row", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    start = F.col("_first") + F.col("_row")
    return numbered.join(first, ["shard", "_block"]).select(
        *same,
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.sequence(start, start + F.col("_n") - 1)).alias("slot"),
        "grown_shard",
    )


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), shards=40)
