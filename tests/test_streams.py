"""Streams give what a batch over the same rows gives."""

import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from panelwright.catalog import QUERIES
from panelwright.streaming import streams


def events(spark, n=60):
    t = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, i % 3, t + timedelta(hours=i), float(i % 5)) for i in range(n)], "event_id long, ticker long, observed_at timestamp, value double")


def staged(spark, df):
    path = tempfile.mkdtemp(prefix="spark-")
    df.write.mode("overwrite").parquet(path)
    return streams.read_events(spark, path, df.schema)


def run(spark, stream, mode="append", keys=None):
    out = tempfile.mkdtemp(prefix="spark-") + "/out"
    streams.run_to_files(stream, out, tempfile.mkdtemp(prefix="spark-"), mode)
    return streams.read_results(spark, out, keys)


def test_ingest_drops_repeats(spark):
    d = events(spark)
    got = run(spark, streams.ingest(staged(spark, d.unionByName(d))))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, d.collect()))


def test_counts_match_batch(spark):
    d = events(spark).withColumn("event_type", F.lit("x"))
    got = run(spark, streams.counts(staged(spark, d)), "update", ["event_type", "start"])
    want = d.groupBy("event_type", F.window("observed_at", "1 day").start.alias("start")).count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def smoothed(rows):
    a, level, want = 1 - 2 ** (-1 / 5), {}, {}
    for r in sorted(rows, key=lambda r: (r.observed_at, r.value)):
        level[r.ticker] = r.value if r.ticker not in level else a * r.value + (1 - a) * level[r.ticker]
        want[(r.ticker, r.observed_at)] = round(level[r.ticker], 9)
    return want


def test_state_over_files_batches_late_rows_and_restarts(spark):
    """Three runs of one checkpoint, a file a batch: rows out of order inside the bound are smoothed in their order, a row after the bound is left out, a null value
    too; a heartbeat lets the last rows go."""
    source, out, checkpoint = (tempfile.mkdtemp(prefix="spark-") + x for x in ("/in", "/out", "/check"))
    d = events(spark, 48).persist()
    hour = lambda a, b: d.where((F.col("event_id") >= a) & (F.col("event_id") < b))
    none = hour(20, 21).withColumn("value", F.lit(None).cast("double")).withColumn("event_id", F.lit(900).cast("long"))
    too_late = hour(3, 4).withColumns({"event_id": F.lit(901).cast("long"), "value": F.lit(99.0)})
    beat = hour(0, 1).withColumns({"observed_at": F.lit("2030-01-01").cast("timestamp"), "ticker": F.lit(-1).cast("long")})
    late_in_time = hour(10, 12)
    for parts in ([hour(0, 10), hour(12, 20)], [late_in_time, hour(20, 30).unionByName(none), hour(30, 44)], [too_late, hour(44, 48)], [beat]):
        for p in parts:
            p.coalesce(1).write.mode("append").parquet(source)
            streams.run_to_files(streams.ema_state(streams.read_events(spark, source, d.schema, 1), late="12 hours"), out, checkpoint)
    got = [r for r in streams.read_results(spark, out).collect() if r.ticker >= 0]
    assert {(r.ticker, r.observed_at): round(r.ema, 9) for r in got} == smoothed(d.collect()) and len(got) == 48


def test_idle_state_begins_anew(spark):
    source, out, checkpoint = (tempfile.mkdtemp(prefix="spark-") + x for x in ("/in", "/out", "/check"))
    t = datetime(2024, 1, 1)
    rows = [(1, 1, t, 10.0), (2, 2, t + timedelta(days=40), 0.0), (3, 2, t + timedelta(days=41), 0.0), (4, 1, t + timedelta(days=60), 2.0), (5, 2, t + timedelta(days=90), 0.0)]
    for r in rows:
        d = spark.createDataFrame([r], "event_id long, ticker long, observed_at timestamp, value double")
        d.coalesce(1).write.mode("append").parquet(source)
        streams.run_to_files(streams.ema_state(streams.read_events(spark, source, d.schema, 1), late="1 hour", idle_days=10), out, checkpoint)
    assert {(r.ticker, r.observed_at): r.ema for r in streams.read_results(spark, out).collect() if r.ticker == 1} == {(1, t): 10.0, (1, t + timedelta(days=60)): 2.0}


def test_windows_over_runs_equal_batch(spark):
    source, out, checkpoint = (tempfile.mkdtemp(prefix="spark-") + x for x in ("/in", "/out", "/check"))
    d = events(spark, 60).persist()
    for k in range(3):
        d.where(F.floor(F.col("event_id") / 20) == k).repartition(2).write.mode("append").parquet(source)
        streams.run_to_files(streams.rolling_sentiment(streams.read_events(spark, source, d.schema, 1), length="2 days"), out, checkpoint, "update")
    got = streams.read_results(spark, out, ["ticker", "start"]).select("ticker", "start", "n", "mean_value")
    want = d.groupBy("ticker", F.window("observed_at", "2 days", "1 day").start.alias("start")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_batch_run_again_replaces_its_rows(spark):
    out = tempfile.mkdtemp(prefix="spark-") + "/out"
    for _ in range(2):  # two checkpoints: the same batch number twice
        streams.run_to_files(staged(spark, events(spark)), out, tempfile.mkdtemp(prefix="spark-"))
    assert streams.read_results(spark, out).count() == 60


def test_score_sink_is_idempotent_by_batch(spark):
    d, out = events(spark), tempfile.mkdtemp(prefix="spark-")
    q = streams.score_sink(staged(spark, d), lambda b: b.withColumn("score", F.col("value") * 2), out, tempfile.mkdtemp(prefix="spark-")).start()
    q.awaitTermination()
    assert spark.read.parquet(out).count() == d.count()


@pytest.mark.parametrize("name", ["event_stream_ingest", "event_stream_sentiment", "event_stream_counts", "event_stream_ema"])
def test_no_event_is_late_however_many_files_hold_it(spark, name):
    """The table's files overlap in time, so each part of the stream comes in several files."""
    path, t = tempfile.mkdtemp(prefix="spark-"), datetime(2024, 1, 1)
    rows = [(i, t + timedelta(hours=7 * i), i % 3, "ab"[i % 2], float(i % 5), "") for i in range(240)]
    d = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    for k in range(4):
        d.where(F.col("event_id") % 4 == 3 - k).coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")
    assert spark.read.parquet(f"{path}/events.parquet").rdd.getNumPartitions() > 1
    got = QUERIES[name](spark, path).collect()
    if name in ("event_stream_ingest", "event_stream_ema"):
        assert len(got) == 240 and (name == "event_stream_ema" or {r.event_id for r in got} == set(range(240)))
    else:
        assert sum(r.n for r in got) == (240 if name == "event_stream_counts" else 7 * 240)
