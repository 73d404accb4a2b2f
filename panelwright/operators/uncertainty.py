"""Uncertainty of scores: aleatoric tiers, the epistemic part, conformal intervals, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import bucket_by_edges, pct_rank
from ..functions.scalars import regime_code
from . import order
from .evaluate import rank_ic
from .stats import partial_rank_correlation, shape

KEYS = ["as_of_date", "horizon"]


def error_features(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Inputs of the error model: |score|, the score's percentile rank, the regime's code."""
    d = rows.withColumns({"abs_score": F.abs("score"), "score_pct": pct_rank("score", *keys)})
    return d.withColumn("regime_code", regime_code("market_regime")) if "market_regime" in rows.columns else d


def usable_features(df: DataFrame, features: list[str], least: float = 0.5) -> list[str]:
    row = df.agg(*[F.avg(F.col(f).isNotNull().cast("double")).alias(f) for f in features]).first()
    return [f for f in features if (row[f] or 0) > least]


def tier0(rows: DataFrame, constant: float = 1.0, label: str = "excess_return", keys: list[str] = KEYS) -> DataFrame:
    """constant / interquartile range of the date's returns."""
    iqr = F.percentile(label, F.lit(0.75)) - F.percentile(label, F.lit(0.25))
    return rows.groupBy(*keys).agg(iqr.alias("_iqr")).select(*keys, F.when(F.col("_iqr") > 1e-12, constant / F.col("_iqr")).alias("a_value"))


def loss_floor(rows: DataFrame, loss: str = "rank_loss", p: float = 0.1, keys: list[str] = KEYS) -> DataFrame:
    return rows.groupBy(*keys).agg(F.percentile(loss, F.lit(p)).alias("a_value"))


def prospective_floor(rows: DataFrame, loss: str = "rank_loss", p: float = 0.1, dates: int = 60, least: int = 20, by: list[str] = ["horizon"], date: str = "as_of_date") -> DataFrame:
    """The quantile over the rows of the ``dates`` dates before (not today), with ``least`` such dates."""
    at = lambda n: (n - 1) * F.lit(float(p))
    d = order.sliding(rows, loss, {"_lo": lambda n: F.floor(at(n)), "_hi": lambda n: F.ceil(at(n))}, dates, by, date)
    share = at(F.col("n_values")) - F.floor(at(F.col("n_values")))
    value = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * share)
    return d.select(*by, date, F.when(F.col("n_dates") >= least, value).alias("a_value"), "n_dates")


def date_index(rows: DataFrame, by: list[str], date: str) -> DataFrame:
    return order.date_index(rows, by, date)


def conditional_range(train: DataFrame, rows: DataFrame, features: list[str], label: str, cells: int = 4, least: int = 30) -> DataFrame:
    """Interquartile range of the label in the row's cell of feature quantiles, fitted on ``train``; cells of fewer than
    ``least`` rows fall back to the first feature's cell, then to all."""
    cuts = None
    for f in features:
        q = order.quantiles(train, f, {f"_{i}": i / cells for i in range(1, cells)}).select(F.array(*[f"_{i}" for i in range(1, cells)]).alias(f"_c_{f}"))
        cuts = q if cuts is None else cuts.crossJoin(F.broadcast(q))  # one row
    cell = lambda f: F.size(F.filter(F.col(f"_c_{f}"), lambda e: e < F.col(f)))
    mark = lambda df: df.crossJoin(F.broadcast(cuts)).withColumns({f"_b_{f}": F.coalesce(cell(f), F.lit(-1)) for f in features}).drop(*[f"_c_{f}" for f in features])
    t, every = mark(train), [f"_b_{f}" for f in features]
    def spread(keys: list[str], name: str, count: str) -> DataFrame:
        q = order.quantiles(t, label, {"_hi": 0.75, "_lo": 0.25}, keys).select(*keys, (F.col("_hi") - F.col("_lo")).alias(name))
        return q.join(t.groupBy(*keys).agg(F.count(F.lit(1)).alias(count)), keys) if keys else q

    fine, coarse, whole = spread(every, "_v2", "_n2"), spread(every[:1], "_v1", "_n1"), spread([], "_v0", "")
    d = mark(rows).join(fine, every, "left").join(F.broadcast(coarse), every[0], "left").crossJoin(F.broadcast(whole))  # ``cells`` rows, and one
    a = F.when(F.col("_n2") >= least, F.col("_v2")).when(F.col("_n1") >= least, F.col("_v1")).otherwise(F.col("_v0"))
    return d.withColumn("a_value", a).drop(*every, "_v2", "_n2", "_v1", "_n1", "_v0")


def pick_tier(tiers: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """tiers: keys, a_tier, a_value.  The highest tier with a value."""
    return tiers.where("a_value IS NOT NULL").groupBy(*keys).agg(F.max_by("a_value", "a_tier").alias("a_value"), F.max("a_tier").alias("a_tier"))


def alignment(rows: DataFrame, a: str, loss: str, by: list[str], least: float = 0.1) -> DataFrame:
    """Does an aleatoric estimate go with losses: correlation, quintile medians' span, verdict."""
    rho = order.spearman(rows, a, loss, by, "rho")
    d = order.bucket_by_edges(rows, a, by, 5)
    low, high = (order.quantiles(d.where(F.col("bucket") == b), loss, {name: 0.5}, by) for b, name in ((0, "low"), (4, "high")))
    return rho.join(low, by, "left").join(high, by, "left").withColumn("aligned", (F.col("rho") >= least) & (F.col("high") > F.col("low")))


def epistemic(g: DataFrame, a: DataFrame, keys: list[str] = KEYS, final_from: str = "2024-01-01") -> DataFrame:
    """ehat = max(0, g - a) with its percentile rank and period; ``a`` is per date or per stock (has ticker)."""
    on = keys + (["ticker"] if "ticker" in a.columns else [])
    d = g.join(a, on).withColumn("ehat_raw", F.greatest(F.col("g_pred") - F.col("a_value"), F.lit(0.0)))
    return d.withColumns({"ehat_pctile": pct_rank("ehat_raw", *keys), "period": F.when(F.col("as_of_date") < F.lit(final_from).cast("date"), "DEV").otherwise("FINAL")})


def epistemic_scaled(g: DataFrame, a: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """With a brought to the scale of g by the ratio of their medians over all rows."""
    on = keys + (["ticker"] if "ticker" in a.columns else [])
    d = g.join(a, on)
    middle = order.quantiles(d, "g_pred", {"_g": 0.5}).crossJoin(order.quantiles(d, "a_value", {"_a": 0.5}))  # one row each
    ratio = middle.select(F.try_divide("_g", "_a").alias("_ratio"))
    return d.crossJoin(F.broadcast(ratio)).withColumn("ehat_raw", F.greatest(F.col("g_pred") - F.col("a_value") * F.col("_ratio"), F.lit(0.0))).drop("_ratio")


def epistemic_filled(g: DataFrame, a: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Dates without an a get the median of all."""
    m = order.quantiles(a, "a_value", {"_m": 0.5})
    d = g.join(a, keys, "left").crossJoin(F.broadcast(m)).withColumn("a_value", F.coalesce("a_value", "_m")).drop("_m")
    return d.withColumn("ehat_raw", F.greatest(F.col("g_pred") - F.col("a_value"), F.lit(0.0)))


def ehat_diagnostics(rows: DataFrame, by: list[str], loss: str = "rank_loss") -> DataFrame:
    return shape(rows, "ehat_raw", by).join(order.spearman(rows, "ehat_raw", loss, by, "rho_loss").drop("n"), by)


def ehat_checks(diagnostics: DataFrame, most_zero: float = 0.9, least_rho: float = 0.0) -> DataFrame:
    tests = {"not_degenerate": F.col("p90") > 0, "not_mostly_zero": F.col("zero_share") <= most_zero, "ranks_losses": F.col("rho_loss") > least_rho}
    d = diagnostics.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in tests.items()})
    return d.withColumn("all_passed", sum((F.col(n).cast("int") for n in tests), F.lit(0)) == len(tests))


def partial_diagnostic(rows: DataFrame, by: list[str], given: list[str]) -> DataFrame:
    return partial_rank_correlation(rows, "ehat_raw", "rank_loss", given, by)


def selective_ic(rows: DataFrame, by: list[str], buckets: int = 3) -> DataFrame:
    """Mean rank IC of the rows in each bucket of uncertainty of a date."""
    d = bucket_by_edges(rows, "ehat_raw", KEYS, buckets).where("bucket IS NOT NULL")
    ic = rank_ic(d, ["bucket", *KEYS])
    return ic.groupBy("bucket", *by).agg(F.avg("rank_ic").alias("mean_ic"), F.count("rank_ic").alias("n_dates"))


def failure_detection(rows: DataFrame, by: list[str], risk: str = "ehat_raw", p: float = 0.8) -> DataFrame:
    """AUROC for losses over a group's p-quantile."""
    cut = order.quantiles(rows, "rank_loss", {"_cut": p}, by)
    d = rows.join(cut, by).withColumn("_bad", (F.col("rank_loss") > F.col("_cut")).cast("int"))
    return order.auroc(d, "_bad", risk, by)


def predictor_comparison(rows: DataFrame, predictors: list[str], by: list[str], loss: str = "rank_loss") -> DataFrame:
    """Rank correlation with the losses of several uncertainty predictors, one row each."""
    long = rows.unpivot([*by, loss], predictors, "predictor", "value")
    return order.spearman(long, "value", loss, [*by, "predictor"], "rho")


def importance_shares(importances: DataFrame, categories: DataFrame) -> DataFrame:
    g = importances.join(F.broadcast(categories), "feature", "left").groupBy(F.coalesce("category", F.lit("other")).alias("category")).agg(F.sum("importance").alias("importance"))
    return g.withColumn("share", F.try_divide("importance", F.sum("importance").over(Window.partitionBy(F.lit(1)))))


def stability(rows: DataFrame, conditions: dict[str, Column], by: list[str]) -> DataFrame:
    """rho(ehat, loss) inside each condition."""
    flags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))
    return order.spearman(rows.withColumn("condition", F.explode(flags)), "ehat_raw", "rank_loss", ["condition", *by], "rho")


def monthly_regime_table(daily: DataFrame, values: list[str], date: str = "as_of_date") -> DataFrame:
    return daily.groupBy(F.trunc(date, "month").alias("month")).agg(*[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("n"))


# Conformal intervals ---------------------------------------------------------------------------


def nonconformity(kind: str, loss: str = "rank_loss", vol: str = "vol_6m", ehat: str = "ehat_raw", floor: float = 1e-3) -> Column:
    if kind == "raw":
        return F.col(loss)
    return F.col(loss) / F.greatest(F.coalesce(F.col(vol if kind == "vol" else ehat), F.lit(0.0)), F.lit(floor))


def rolling_quantile(rows: DataFrame, value: str, alpha: float, dates: int = 60, least: int = 30, by: list[str] = ["horizon"], date: str = "as_of_date") -> DataFrame:
    """by, date, threshold: the ceil((n + 1)(1 - alpha))-th smallest of all values of the ``dates`` dates before.

    Windows are put together from dyadic stretches of dates (``order.sliding``): no list of a window is built, and no row copied to it."""
    rank = lambda n: F.least(F.ceil((n + 1) * (1 - alpha)), n) - 1
    g = order.sliding(rows, value, {"threshold": rank}, dates, by, date)
    return g.where(F.col("n_dates") >= least).select(*by, date, "threshold", "n_values", "n_dates")


def conformal(rows: DataFrame, kind: str = "raw", alpha: float = 0.1, dates: int = 60, least: int = 30, by: list[str] = ["horizon"], date: str = "as_of_date", **columns) -> DataFrame:
    """Rows with their interval's half width and whether the loss was covered."""
    d = rows.withColumn("_s", nonconformity(kind, **columns))
    scale = F.when(F.lit(kind == "raw"), F.lit(1.0)).otherwise(F.greatest(F.coalesce(F.col(columns.get("vol", "vol_6m") if kind == "vol" else columns.get("ehat", "ehat_raw")), F.lit(0.0)), F.lit(1e-3)))
    q = rolling_quantile(d, "_s", alpha, dates, least, by, date)
    d = d.join(q, [*by, date])
    return d.withColumn("width", F.col("threshold") * scale).withColumn("covered", F.col("_s") <= F.col("threshold")).drop("_s")


def coverage(intervals: DataFrame, by: list[str], target: float = 0.9) -> DataFrame:
    g = intervals.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("covered").cast("double")).alias("coverage"), F.avg("width").alias("mean_width"))
    return g.withColumn("gap", F.col("coverage") - target)


def conditional_coverage(intervals: DataFrame, by: list[str], on: str = "ehat_raw", buckets: int = 3, target: float = 0.9) -> DataFrame:
    """Coverage by bucket; spread and mean absolute gap over the buckets of a group."""
    d = order.bucket_by_edges(intervals, on, by, buckets).where("bucket IS NOT NULL")
    c = coverage(d, [*by, "bucket"], target)
    w = Window.partitionBy(*by)
    return c.withColumns({"spread": F.max("coverage").over(w) - F.min("coverage").over(w), "calibration_error": F.sum(F.abs("gap") * F.col("n")).over(w) / F.sum("n").over(w)})


__all__ = [n for n in dir() if not n.startswith("_") and n != "annotations"]
