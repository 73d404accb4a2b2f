"""Reading and writing the stores: features, labels, prices, facts, events, residuals, texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.pit import latest, replace_groups, upsert, wide_to_long
from ..functions.scalars import close_utc


def between(date: str, start=None, end=None) -> Column:
    out = F.lit(True)
    if start is not None:
        out = out & (F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        out = out & (F.col(date) <= F.lit(end).cast("date"))
    return out


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, date: str | None = None, start=None, end=None, where: dict[str, list] | None = None) -> DataFrame:
    """A Parquet table, pruned to columns, a date range and lists of values (all reach the scan)."""
    d = spark.read.parquet(path)
    if date:
        d = d.where(between(date, start, end))
    for c, values in (where or {}).items():
        d = d.where(F.col(c).isin(values))
    return d.select(*columns) if columns else d


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def query_labels(labels: DataFrame, tickers: list | None = None, start=None, end=None, horizons: list[int] | None = None, as_of=None) -> DataFrame:
    d = labels.where(between("as_of_date", start, end))
    if tickers:
        d = d.where(F.col("ticker").isin(tickers))
    if horizons:
        d = d.where(F.col("horizon").isin(horizons))
    return d.where(F.col("label_matured_at") <= close_utc(F.lit(as_of).cast("date"))) if as_of else d


def query_bars(bars: DataFrame, tickers: list | None = None, start=None, end=None, as_of: Column | None = None) -> DataFrame:
    d = bars.where(between("date", start, end))
    if tickers:
        d = d.where(F.col("ticker").isin(tickers))
    return d.where(F.col("observed_at") <= as_of) if as_of is not None else d


def query_texts(texts: DataFrame, ticker=None, source: str | None = None, start=None, end=None, scored_only: bool = False) -> DataFrame:
    d = texts.where(between("event_date", start, end))
    if ticker is not None:
        d = d.where(F.col("ticker") == ticker)
    if source:
        d = d.where(F.col("source") == source)
    return d.where("scored") if scored_only else d


def load_panel(features: DataFrame, labels: DataFrame, regime: DataFrame | None, horizons: list[int], entity: str = "ticker") -> DataFrame:
    """Features with all horizons' labels side by side and the date's regime; keys are unique or it fails when run."""
    from ..operators.labels import complete_rows, pivot_labels

    d = features.join(pivot_labels(labels, horizons, entity).withColumnRenamed("as_of_date", "date"), ["date", entity])
    d = complete_rows(d, horizons)
    d = d.join(F.broadcast(regime), "date", "left") if regime is not None else d  # a row a date
    n = F.count(F.lit(1)).over(Window.partitionBy("date", entity))
    return d.withColumn("_once", F.when(n > 1, F.raise_error(F.lit("duplicate keys in the panel"))).otherwise(F.lit(True))).where("_once").drop("_once")


def write_features(features: DataFrame, path: str, date: str = "date") -> None:
    features.withColumn("month", F.date_format(date, "yyyy-MM")).repartition("month").write.mode("overwrite").partitionBy("month").parquet(path)


def write_labels(labels: DataFrame, path: str) -> None:
    labels.repartition("horizon", F.pmod(F.xxhash64("ticker"), F.lit(16))).write.mode("overwrite").partitionBy("horizon").parquet(path)


def write_metadata(spark: SparkSession, values: dict[str, str], path: str) -> None:
    spark.createDataFrame(list(values.items()), "key string, value string").coalesce(1).write.mode("overwrite").parquet(path)


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_metrics(frames: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet, and as CSV with one header where its columns are plain."""
    for name, d in frames.items():
        d.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
        if all(t in ("string", "int", "bigint", "double", "date", "boolean") for _, t in d.dtypes):
            d.write.mode("overwrite").csv(f"{path}/{name}.csv", header=True)


def write_ranking(ranked: DataFrame, path: str, nested: bool) -> None:
    if nested:
        ranked.groupBy("as_of_date", "horizon").agg(F.sort_array(F.collect_list(F.struct("rank", "ticker", "score", "category"))).alias("ranking")).write.mode("overwrite").json(path)
    else:
        ranked.select("as_of_date", "horizon", "rank", "ticker", "score", "percentile", "category").write.mode("overwrite").csv(path, header=True)


def upsert_prices(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per (ticker, date), the last write wins; rows without a time of observation are refused."""
    ok = F.when(F.col("observed_at").isNull(), F.raise_error(F.lit("observed_at is missing"))).otherwise(F.col("observed_at"))
    return upsert(old, new.withColumn("observed_at", ok), ["ticker", "date"])


def upsert_with_close(old: DataFrame, new: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """As ``upsert``; a missing time of observation is the close of the date."""
    return upsert(old, new.withColumn("observed_at", F.coalesce("observed_at", close_utc(date))), keys)


def ingest_statements(wide: DataFrame, ids: list[str], fields: list[str], old: DataFrame | None = None) -> DataFrame:
    new = wide_to_long(wide, ids, fields)
    return new if old is None else upsert(old, new, [*ids, "field"])


def upsert_events(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["event_id"])


def replace_residuals(old: DataFrame, new: DataFrame) -> DataFrame:
    """Residuals with loss = |actual - prediction|; all of an (expert_id, sub_model_id) are replaced."""
    return replace_groups(old, new.withColumn("loss", F.abs(F.col("actual") - F.col("prediction"))).select(old.columns), ["expert_id", "sub_model_id"])


def adjusted_bars(raw: DataFrame) -> DataFrame:
    """The bar of the highest volume per (ticker, date), with its adjusted close where there is one."""
    d = latest(raw, ["ticker", "date"], [F.col("volume").desc_nulls_last(), F.col("close").desc()])
    return d.withColumn("close", F.coalesce("adj_close", "close")).drop("adj_close")


def modeling_table(features: DataFrame, labels: DataFrame, regime: DataFrame, horizon: int) -> DataFrame:
    own = labels.where(F.col("horizon") == horizon).select(F.col("as_of_date").alias("date"), "ticker", "excess_return")
    return features.join(own, ["date", "ticker"], "left").join(F.broadcast(regime), "date", "left")


def enrich(rows: DataFrame, context: DataFrame, on: list[str]) -> DataFrame:
    """Left join of context columns; those that both have come from the context."""
    twice = [c for c in context.columns if c in rows.columns and c not in on]
    return rows.drop(*twice).join(context, on, "left")


__all__ = [n for n in dir() if not n.startswith("_") and n != "annotations"]
