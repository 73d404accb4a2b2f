"""Streams of events: ingest without repeats, rolling sentiment, incremental scores, smoothed series."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def read_events(spark: SparkSession, path: str, schema, files_a_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else r).parquet(path)


def ingest(stream: DataFrame, key: str = "event_id", time: str = "observed_at", late: str = "1 hour") -> DataFrame:
    """Each id once, as long as its repeats come within the bound of lateness."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def rolling_sentiment(stream: DataFrame, entity: str = "ticker", time: str = "observed_at", value: str = "value", length: str = "7 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    """entity, start, end, n, mean over sliding windows."""
    d = stream.withWatermark(time, late).groupBy(F.window(time, length, step), entity).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"))
    return d.select(entity, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean_value")


def counts(stream: DataFrame, by: str = "event_type", time: str = "observed_at", length: str = "1 day", late: str = "1 day") -> DataFrame:
    d = stream.withWatermark(time, late).groupBy(F.window(time, length), by).agg(F.count(F.lit(1)).alias("n"))
    return d.select(by, F.col("window.start").alias("start"), "n")


def score_sink(stream: DataFrame, scorer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Scores of each batch under its number: a batch that is run again overwrites its own folder only."""

    def write(batch: DataFrame, number: int) -> None:
        scorer(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def smoother(share: float, idle_ms: int):
    """Work on one bucket of entities, its new rows and its state: each entity's level so far and that level's time, and the rows that the watermark has not
    passed yet, since earlier ones may still come."""

    def smooth(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, at, levels, who, times, values = state.get if state.exists else ([],) * 6
        known, held = dict(zip(names, zip(at, levels))), list(zip(who, times, values))
        for frame in frames:
            frame = frame[frame["_value"].notna() & frame["_at"].notna()]
            held += zip(frame["_entity"].tolist(), frame["_at"].astype("int64").tolist(), frame["_value"].tolist())
        mark = state.getCurrentWatermarkMs()
        ready, rest = sorted((r for r in held if r[1] < mark * 1000), key=lambda r: r[1:]), [r for r in held if r[1] >= mark * 1000]
        out = []
        for name, t, x in ready:
            level = share * x + (1 - share) * known[name][1] if name in known else x
            known[name] = (t, level)
            out.append((name, t, level))
        waits = {r[0] for r in rest}
        known = {n: k for n, k in known.items() if n in waits or k[0] // 1000 + idle_ms > mark}
        due = [r[1] // 1000 + 1 for r in rest] + [k[0] // 1000 + idle_ms for n, k in known.items() if n not in waits]
        if due:
            state.update((list(known), [k[0] for k in known.values()], [k[1] for k in known.values()], *([r[i] for r in rest] for i in range(3))))
            state.setTimeoutTimestamp(max(min(due), mark + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["entity", "at", "ema"])

    return smooth


def ema_state(stream: DataFrame, halflife: float = 5.0, entity: str = "ticker", time: str = "observed_at", value: str = "value", late: str = "30 days", idle_days: float = 365.0, buckets: int = 1024) -> DataFrame:
    """entity, observed_at, ema: smoothing carried from batch to batch.

    A row waits in the state until the watermark has passed its time, so rows that come late, but within the bound, are smoothed in their order; later ones
    are left out.  A timeout wakes a bucket of entities when something in it is due: state is read and
    written by buckets, since a call for every entity costs more than its rows.  The state of an entity that has nothing for ``idle_days`` of event time is dropped, and
    it begins anew.  Rows after the last watermark are given once it moves on (a source may send heartbeats).  Missing values are left out."""
    spark = stream.sparkSession
    spark.conf.set(STORE, ROCKS)
    kind = stream.schema[entity].dataType.simpleString()
    own = [F.col(entity).cast("string").alias("_entity"), F.unix_micros(F.col(time).cast("timestamp")).alias("_at"), F.col(value).cast("double").alias("_value")]
    d = stream.withWatermark(time, late).select(F.pmod(F.xxhash64(entity), F.lit(buckets)).alias("_bucket"), time, *own).groupBy("_bucket")
    work = smoother(1 - 2 ** (-1 / halflife), int(idle_days * 86_400_000))
    held = "names array<string>, at array<long>, levels array<double>, who array<string>, times array<long>, waiting array<double>"
    d = d.applyInPandasWithState(work, "entity string, at long, ema double", held, "append", "EventTimeTimeout")
    return d.select(F.col("entity").cast(kind).alias(entity), F.timestamp_micros("at").alias(time), "ema")


def run_to_files(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run what is there to the end.  Each batch is written under its number, so one that is run again after a failure replaces its own
    rows; nothing passes through the driver."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def read_results(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """What ``run_to_files`` has written; with ``keys`` (mode "update") the row of each key's latest batch."""
    d = spark.read.parquet(path)
    if not keys:
        return d.drop("batch")
    rest = [c for c in d.columns if c not in (*keys, "batch")]
    return d.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_x")).select(*keys, "_x.*")
