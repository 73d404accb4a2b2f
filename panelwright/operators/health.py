"""Health of a model by date: realised efficacy, drift, disagreement, the exposure gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import average_precision, auroc, bucket_by_edges, confusion, ks_of_counts, spearman
from ..functions.scalars import exposure_gate, sigmoid
from .evaluate import rank_ic
from .series import ewma, expanding_mean, expanding_z, matured, reference_drift
from .stats import pairwise_mean_correlation
from .uncertainty import date_index


def daily_ic(rows: DataFrame, by: list[str] = ["horizon"], date: str = "as_of_date") -> DataFrame:
    """by, date, daily_ic (0 where there is none)."""
    return rank_ic(rows, [*by, date]).select(*by, date, F.coalesce("rank_ic", F.lit(0.0)).alias("daily_ic"))


def realized(daily: DataFrame, lag: int, by: list[str] = ["horizon"], date: str = "as_of_date", halflife: float = 30.0, least: int = 20) -> DataFrame:
    """What was known of the daily ICs ``lag`` sessions later, smoothed: H_realized."""
    w = Window.partitionBy(*by).orderBy(date)
    d = daily.withColumn("matured_ic", matured("daily_ic", lag, w))
    return ewma(d, "matured_ic", by, date, halflife, least, "H_realized")


def feature_drift(rows: DataFrame, features: list[str], by: list[str] = ["horizon"], date: str = "as_of_date", n: int = 252, least: int = 60) -> DataFrame:
    means = rows.groupBy(*by, date).agg(*[F.avg(f).alias(f) for f in features])
    return means.select(*by, date, reference_drift(features, Window.partitionBy(*by).orderBy(date), n, least).alias("feature_drift"))


def score_drift(rows: DataFrame, by: list[str] = ["horizon"], date: str = "as_of_date", dates: int = 60, value: str = "score") -> DataFrame:
    """KS distance of a date's scores from those of the ``dates`` dates before, all names of them.

    Scores are first counted by date and value, and the counts copied forward to the dates that look back at them."""
    idx = date_index(rows, by, date)
    d = rows.where(F.col(value).isNotNull()).groupBy(*by, date, value).agg(F.count(F.lit(1)).alias("_c")).join(F.broadcast(idx), [*by, date])
    own = d.select(*by, F.col("_i").alias("_t"), value, F.col("_c").alias("_a"), F.lit(0).cast("long").alias("_b"))
    ref = d.select(*by, F.explode(F.sequence(F.col("_i") + 1, F.col("_i") + dates)).alias("_t"), value, F.lit(0).cast("long").alias("_a"), F.col("_c").alias("_b"))
    k = ks_of_counts(own.unionByName(ref), value, [*by, "_t"])
    return k.join(idx.withColumnRenamed("_i", "_t"), [*by, "_t"]).select(*by, date, "ks")


def correlation_level(returns: DataFrame, value: str, entity: str = "ticker", date: str = "date", dates: int = 21, least: int = 2) -> DataFrame:
    """Mean correlation of pairs, each over the dates that both have."""
    return pairwise_mean_correlation(returns, value, entity, date, dates, least)


def drift_composite(df: DataFrame, drift: str = "feature_drift", ks: str = "ks", corr: str = "mean_corr") -> DataFrame:
    part = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return df.withColumn("H_drift", 0.4 * part(drift) + 0.3 * part(ks) + 0.3 * part(corr))


def model_disagreement(scores: DataFrame, others: DataFrame, keys: list[str] = ["horizon", "as_of_date"]) -> DataFrame:
    """1 - mean rank correlation with the other models' scores (column model), per cross-section."""
    d = scores.select(*keys, "ticker", F.col("score").alias("_a")).join(others.select(*keys, "ticker", "model", F.col("score").alias("_b")), [*keys, "ticker"])
    return spearman(d, "_a", "_b", [*keys, "model"], "rho").groupBy(*keys).agg((1 - F.avg("rho")).alias("H_disagree"))


def dispersion_disagreement(rows: DataFrame, by: list[str] = ["horizon"], date: str = "as_of_date") -> DataFrame:
    """Without other models: the scores' deviation against its own past mean, less one."""
    d = rows.groupBy(*by, date).agg(F.stddev_samp("score").alias("_s"))
    return d.withColumn("H_disagree", F.try_divide(F.col("_s"), expanding_mean("_s", Window.partitionBy(*by).orderBy(date))) - 1).drop("_s")


def combine(df: DataFrame, by: list[str] = ["horizon"], date: str = "as_of_date", least: int = 60, weights: tuple[float, float, float] = (1.0, 0.5, 0.5)) -> DataFrame:
    """H_combined = sigmoid of the realised efficacy's z less drift's and disagreement's; G_exposure from it."""
    w = Window.partitionBy(*by).orderBy(date)
    z = {f"z_{c}": F.coalesce(expanding_z(f"H_{c}", w, least), F.lit(0.0)) if f"H_{c}" in df.columns else F.lit(0.0) for c in ("realized", "drift", "disagree")}
    d = df.withColumns(z)
    d = d.withColumn("H_combined", sigmoid(weights[0] * F.col("z_realized") - weights[1] * F.col("z_drift") - weights[2] * F.col("z_disagree")))
    return d.withColumn("G_exposure", exposure_gate("H_combined"))


def health_diagnostics(health: DataFrame, by: list[str], outcome: str = "daily_ic", gate: str = "G_exposure") -> DataFrame:
    d = health.withColumn("_good", (F.col(outcome) > 0).cast("int"))
    return auroc(d, "_good", gate, by).join(spearman(d, gate, outcome, by, "rho"), by)


def regime_trust(health: DataFrame, predictors: list[str], by: list[str], outcome: str = "daily_ic", threshold: float = 0.2) -> DataFrame:
    """For each predictor: AUROC, average precision and, at the threshold, precision, recall, abstention."""
    long = health.unpivot([*by, outcome], predictors, "predictor", "value").where("value IS NOT NULL")
    d = long.withColumns({"_good": (F.col(outcome) > 0).cast("int"), "_on": (F.col("value") >= threshold).cast("int")})
    k = [*by, "predictor"]
    return auroc(d, "_good", "value", k).join(average_precision(d, "_good", "value", k), k).join(confusion(d, "_good", "_on", k).drop("tp", "fp", "fn", "tn"), k)


def gate_buckets(series: DataFrame, gate: str, ret: str, by: list[str], buckets: int = 4) -> DataFrame:
    d = bucket_by_edges(series, gate, by, buckets).where("bucket IS NOT NULL")
    return d.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(gate).alias("mean_gate"), F.avg(ret).alias("mean_return"), F.avg((F.col(ret) > 0).cast("double")).alias("hit_rate"))


def early_warning(rows: DataFrame, daily: DataFrame, by: list[str] = ["horizon"], date: str = "as_of_date", value: str = "g_pred") -> DataFrame:
    """Daily median, p10, p90 and spread of an uncertainty, and how they go with the day's IC."""
    q = lambda p: F.percentile(value, F.lit(p))
    d = rows.groupBy(*by, date).agg(q(0.5).alias("g_median"), q(0.9).alias("g_p90"), q(0.1).alias("g_p10")).withColumn("g_spread", F.col("g_p90") - F.col("g_p10")).join(daily, [*by, date])
    long = d.withColumn("_bad", (F.col("daily_ic") < 0).cast("int")).unpivot([*by, "daily_ic", "_bad"], ["g_median", "g_p90", "g_p10", "g_spread"], "measure", "value")
    k = [*by, "measure"]
    return spearman(long, "value", "daily_ic", k, "rho").join(auroc(long, "_bad", "value", k).select(*k, "auroc"), k)


__all__ = [n for n in dir() if not n.startswith("_") and n != "annotations"]
