"""Audits: what must hold of point-in-time tables, panels, prices, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import median, safe_corr
from ..functions.scalars import close_utc
from . import order


def validate_pit(df: DataFrame, entity: str = "ticker", date: str = "date", observed: str = "observed_at") -> DataFrame:
    """Per entity: rows, rows never observed, observed before their date, observed before the row before."""
    w = Window.partitionBy(entity).orderBy(date)
    o = F.col(observed).cast("timestamp")
    one = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    d = df.withColumn("_back", o < F.lag(o).over(w))
    return d.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), one(F.col(observed).isNull()).alias("n_missing"), one(o < F.col(date).cast("timestamp")).alias("n_early"), one(F.col("_back")).alias("n_backwards"))


def usage_violations(records: DataFrame, usage: DataFrame, key: str = "record_id") -> DataFrame:
    """usage: record_id, used_at.  Records used before they were known, or without a time of observation."""
    d = records.join(usage, key)
    kind = F.when(F.col("observed_at").isNull(), "no_observation_time").when(F.col("observed_at") > F.col("used_at"), "used_before_observed").when(F.col("observed_at").cast("date") < F.col("event_date"), "observed_before_event")
    return d.withColumn("violation", kind).where("violation IS NOT NULL")


def violation_summary(violations: DataFrame, by: list[str] = ["violation"]) -> DataFrame:
    return violations.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def filing_lag(df: DataFrame, days: int = 1) -> DataFrame:
    """Statements known sooner than ``days`` after they were filed."""
    return df.where(F.col("observed_at").cast("date") < F.date_add("filing_date", days))


def early_prices(df: DataFrame, date: str = "date") -> DataFrame:
    return df.where(F.col("observed_at") < close_utc(date))


def premature_labels(labels: DataFrame, as_of) -> DataFrame:
    d = labels.where(F.col("label_matured_at") > as_of)
    return d.groupBy("horizon").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("as_of_date", "ticker")).alias("example"))


def future_features(panel: DataFrame, observed: str, date: str) -> DataFrame:
    return panel.where(F.col(observed) > close_utc(date))


def drifting_attribute(df: DataFrame, entity: str, attribute: str) -> DataFrame:
    return df.groupBy(entity).agg(F.count_distinct(attribute).alias("n_values")).where("n_values > 1")


def validate_panel(df: DataFrame, keys: list[str], required: list[str], ranges: dict[str, tuple[float, float]], by: list[str] | None = None) -> DataFrame:
    """check, n_bad: missing columns, duplicate keys, NULL shares, values out of range; one pass over the rows and one over
    the keys."""
    spark = df.sparkSession
    lacking = [c for c in required if c not in df.columns]
    have = [c for c in required if c in df.columns]
    one = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    aggs = [F.struct(F.lit(f"null:{c}").alias("check"), one(F.col(c).isNull()).alias("n_bad")) for c in have]
    aggs += [F.struct(F.lit(f"range:{c}").alias("check"), one(~F.col(c).between(lo, hi)).alias("n_bad")) for c, (lo, hi) in ranges.items() if c in df.columns]
    out = df.agg(F.array(*aggs).alias("x")).select(F.inline("x"))
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.lit("duplicate_keys").alias("check"), one(F.col("_n") > 1).alias("n_bad"))
    out = out.unionByName(dup)
    return out.unionByName(spark.createDataFrame([(f"missing:{c}", 1) for c in lacking], "check string, n_bad long")) if lacking else out


def quality_report(df: DataFrame, features: list[str], target: str, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Per feature: share missing, mean, deviation, outer quantiles, rows outside them, correlation with the target, rows
    out of the allowed range."""
    out = []
    for f in features:
        lo, hi = (ranges or {}).get(f, (float("-inf"), float("inf")))
        out.append(F.struct(F.lit(f).alias("feature"), F.avg(F.col(f).isNull().cast("double")).alias("missing_share"), F.avg(f).alias("mean"), F.stddev_samp(f).alias("std"), safe_corr(f, target).alias("target_corr"), F.sum(F.coalesce(~F.col(f).between(lo, hi), F.lit(False)).cast("long")).alias("n_out_of_range")))
    long = df.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("_v")) for f in features])))
    outer = order.quantiles(long, "_v", {"p001": 0.001, "p999": 0.999}, ["feature"])
    return df.agg(F.array(*out).alias("x")).select(F.inline("x")).join(outer, "feature", "left").select("feature", "missing_share", "mean", "std", "p001", "p999", "target_corr", "n_out_of_range")


def coverage_report(df: DataFrame, features: list[str], categories: dict[str, str] | None = None) -> DataFrame:
    """Per feature: share present, its category, and whether it is nearly complete (95 %) or sparse (50 %)."""
    out = [F.struct(F.lit(f).alias("feature"), F.lit((categories or {}).get(f, "other")).alias("category"), F.avg(F.col(f).isNotNull().cast("double")).alias("coverage")) for f in features]
    d = df.agg(F.array(*out).alias("x")).select(F.inline("x"))
    return d.withColumns({"complete": F.col("coverage") >= 0.95, "sparse": F.col("coverage") < 0.5})


def row_coverage(df: DataFrame, features: list[str]) -> DataFrame:
    share = sum((F.col(f).isNotNull().cast("int") for f in features), F.lit(0)) / F.lit(float(len(features)))
    return df.select(share.alias("c")).agg(F.avg("c").alias("mean"), F.min("c").alias("min"), F.max("c").alias("max"))


def score_coverage(df: DataFrame, scores: list[str], by: list[str]) -> DataFrame:
    every = F.lit(True)
    for s in scores:
        every = every & F.col(s).isNotNull()
    return df.groupBy(*by).agg(*[F.avg(F.col(s).isNotNull().cast("double")).alias(f"has_{s}") for s in scores], F.avg(every.cast("double")).alias("has_all"))


def store_stats(df: DataFrame, entity: str, date: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(entity).alias("n_entities"), F.min(date).alias("first"), F.max(date).alias("last"))


def archive_summary(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fold_id").alias("n_folds"), F.count_distinct("as_of_date").alias("n_dates"), F.count_distinct("ticker").alias("n_tickers"), F.avg("loss").alias("mean_loss"), median("loss").alias("median_loss"))


def price_consistency(df: DataFrame, close: str, adjusted: str, entity: str, date: str, most: float = 25.0) -> DataFrame:
    """Rows whose close / adjusted close is out of bounds, or moves by more than a tenth from one row to the next."""
    r = F.try_divide(F.col(close), F.col(adjusted))
    w = Window.partitionBy(entity).orderBy(date)
    d = df.withColumn("ratio", r)
    return d.withColumn("jump", F.abs(F.try_divide(F.col("ratio"), F.lag("ratio").over(w)) - 1)).where((F.col("ratio") > most) | (F.col("ratio") < 1 / most) | (F.col("jump") > 0.1))


def missing_entities(wanted: DataFrame, have: DataFrame, entity: str = "ticker") -> DataFrame:
    return wanted.select(entity).distinct().join(have.select(entity).distinct(), entity, "left_anti")


def identical_patterns(df: DataFrame, x: str, entity: str, date: str) -> DataFrame:
    """Groups of entities whose values change on exactly the same dates (by an order-free hash of those dates)."""
    w = Window.partitionBy(entity).orderBy(date)
    d = df.withColumn("_d", F.col(x) - F.lag(x).over(w)).where(F.abs("_d") > 1e-12)
    p = d.groupBy(entity).agg(F.sum(F.xxhash64(date).cast("decimal(38,0)")).alias("_p"), F.count(F.lit(1)).alias("n_changes"))
    return p.groupBy("_p", "n_changes").agg(F.count(F.lit(1)).alias("n_entities"), F.min(entity).alias("first_entity")).where("n_entities > 1").drop("_p")


def forecast_checks(df: DataFrame, forecast: str, close: str, score: str, tolerance: float = 1e-9) -> DataFrame:
    """Rows whose score is not forecast / close - 1, or whose forecast equals the last close."""
    own = F.try_divide(F.col(forecast), F.col(close)) - 1
    kind = F.when(F.col(forecast).isNull(), "no_forecast").when(F.abs(own - F.col(score)) > tolerance, "score_differs").when(F.col(forecast) == F.col(close), "naive_forecast")
    return df.withColumn("issue", kind).where("issue IS NOT NULL")
