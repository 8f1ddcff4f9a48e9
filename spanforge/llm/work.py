"""Tables between the steps of an operator, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new folder's path under spark.checkpoint.dir; where that is unset (tests, one machine), under a folder of our own."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="spanforge-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        top = f"file://{_OWN[0]}"
    return f"{top.rstrip('/')}/spanforge-{uuid.uuid4().hex}"


def table(df: DataFrame) -> DataFrame:
    """df, written and read again: later steps don't depend on its executors and don't compute it twice."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows that Spark hands to a Python worker at once, unless the session says otherwise; by default 64 MB, held by both sides of each task.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 3 << 20


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) over batches of bounded bytes."""
    conf = df.sparkSession.conf
    if conf.get(BATCH, None) is None:
        conf.set(BATCH, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


#: A key is hot from this share of all rows on; so at most as many keys as its inverse are hot.
HOT_SHARE = 1 / 2000
HOT_LEAST = 1000


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], count: str, rows: int, how: str = "inner") -> DataFrame:
    """left joined to right on keys that are unique in right and never null.

    `count` of right says how many of left's `rows` rows have the key. Hot keys,
    at most 1 / HOT_SHARE, are broadcast; the rest is joined by shuffle, in
    which every key is rare.
    """
    from pyspark.sql import functions as F

    hot = right.where(F.col(count) >= max(HOT_LEAST, int(rows * HOT_SHARE)))
    cold = right.where(F.col(count) < max(HOT_LEAST, int(rows * HOT_SHARE)))
    small = F.broadcast(hot)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return left.join(small, keys).unionByName(rest.join(cold, keys, how))
