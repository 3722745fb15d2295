"""Helpers that the corpus operators share: scratch space, staged tables, checked broadcasts."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table with short rows may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 200_000


_local: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``; where it is unset, a local one, which only a local session can use."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="millrace-"))
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, and survives the loss of an executor."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that later ones have taken the place of."""
    for df in tables:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df``, a staged table, holds at most ``rows`` rows: Parquet's footers tell."""
    return df.count() <= rows


def hinted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its row count is small enough, else as it is for a shuffled join."""
    return F.broadcast(df) if bounded(df, rows) else df


def width(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(column: str | object, divisor: int = 5):
    """crc32 of an id's decimal text modulo ``divisor``: the split into training and held-out rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor if isinstance(column, str) else F.crc32(column.cast("string").cast("binary")) % divisor


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now: they go once the driver has collected what named them."""
    for _ in range(2):  # what the first collection frees may have held more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def text_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hand texts to Python in batches of at most ``rows`` rows: whole texts are long, and a batch is held several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)
