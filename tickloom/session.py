"""Session settings that the library expects."""

import atexit
import tempfile
from contextlib import suppress
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(app: str = "tickloom", master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; further settings are given with _ for the dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in more.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


#: Folders that this process has asked for and not yet deleted.
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path under spark.checkpoint.dir, which driver and executors share; a local one only in local mode.

    What is written there goes when the process ends, or before by `forget`.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    _made.append(f"{root or tempfile.mkdtemp(prefix='shared-')}/{uuid4().hex}")
    return _made[-1]


def forget(spark: SparkSession) -> int:
    """Deletes what shared folders hold: call it when no DataFrame that reads them is needed any more. Tells how many went."""
    jvm, conf, gone = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


@atexit.register
def _at_end() -> None:
    with suppress(Exception):  # the JVM may be gone already
        spark = SparkSession.getActiveSession() if _made else None
        if spark is not None and not spark.sparkContext._jsc.sc().isStopped():
            forget(spark)


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and written as Parquet to a shared folder, so that lineage ends there and columns can be pruned."""
    at = shared_folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
