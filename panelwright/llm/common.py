"""What the corpus operators share: tables, the shared scratch folder, small hashing helpers."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark only (the path may be any store Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see: ``spark.checkpoint.dir``.

    A local session may have none, then a folder of our own is set; on a cluster that is an error, since an executor's own disk is
    not seen by the others."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table in the shared folder."""
    _made.paths.append(f"{shared_dir(spark)}/panelwright-{name}-{uuid.uuid4().hex}")
    return _made.paths[-1]


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage, and
    survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class _Made(threading.local):
    """Intermediate tables of this thread, in the order they were made: queries that run side by side don't see each other's."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_made = _Made()


def mark() -> int:
    """The place in the list of intermediate tables from which ``discard`` goes on."""
    return len(_made.paths)


def discard(spark: SparkSession, since: int, keep: tuple[str, ...] = ()) -> None:
    """Delete the intermediate tables made since ``mark``, but those to ``keep``.  To be called only once nothing reads them any more:
    when the result is itself a stored table."""
    old = [p for p in _made.paths[since:] if p not in keep]
    _made.paths[since:] = [p for p in _made.paths[since:] if p in keep]
    sc = spark.sparkContext
    for path in old:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def finished(df: DataFrame, name: str, since: int) -> DataFrame:
    """``df`` as a stored table; the intermediate tables made since ``mark`` are deleted behind it."""
    out = stored(df, name)
    discard(df.sparkSession, since, (_made.paths[-1],))
    return out


def release(spark: SparkSession) -> None:
    """Let go of shuffle files of steps that are over: Spark removes them when the driver collects garbage, which in a long
    chain of jobs may be late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bits of the map that sorts out most rows before a join; its size is fixed.
MAP_BITS = 1 << 26


def perhaps_among(keys: DataFrame, key: str) -> Callable[[str], Column]:
    """A test whether a column's value may be among ``keys``: a bit map of hashed keys, of one size whatever there is, is built by Spark
    and broadcast.  A join that follows must be exact; a full map would only cost time."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS))
    maps = keys.select(bit(key).alias("b")).groupBy((F.col("b") / 32768).cast("long").alias("k")).agg(F.bitmap_construct_agg(F.col("b") % 32768).alias("m")).collect()
    found = np.zeros(MAP_BITS // 8, np.uint8)
    for r in maps:
        found[r.k * 4096 : (r.k + 1) * 4096] = np.frombuffer(bytes(r.m), np.uint8)
    sent = keys.sparkSession.sparkContext.broadcast(found)

    @F.pandas_udf(T.BooleanType())
    def set_(b: pd.Series) -> pd.Series:
        x = b.to_numpy(np.int64)
        return pd.Series((sent.value[x >> 3] >> (x & 7)) & 1 == 1)

    return lambda c: set_(bit(c))


def text_or_empty(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
