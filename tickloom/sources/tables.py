"""Tables whose files are dealt by key, so that joins and groups by that key need no exchange."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame

from ..session import shared_folder


def bucketed(df: DataFrame, keys: list[str], buckets: int, path: str | None = None, name: str | None = None) -> DataFrame:
    """df as a table of so many buckets by the keys, sorted in each. Tables of equal keys and buckets join file by file.

    Rows are dealt like the buckets before they are written, so a bucket is one file; choose as many buckets as give files
    that one task can sort. A key with very many rows makes a large bucket: keys should be fine, such as a bar's start.
    """
    spark = df.sparkSession
    name = name or f"tickloom_{uuid4().hex}"
    dealt = df.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path or shared_folder(spark)).mode("overwrite").format("parquet").saveAsTable(name)
    return spark.table(name)
