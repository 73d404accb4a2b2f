"""Deployment policies: sized, sorted and gated books; a grid of parameters in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import bucket_by_order, median, safe_corr
from ..functions.scalars import size_by_uncertainty, size_by_volatility, trusted
from .cross import cap_uncertain, residual_uncertainty, sizing_constant
from .portfolio import long_short, metrics

KEYS = ["as_of_date"]


def policy_inputs(losses: DataFrame, ehat: DataFrame, health: DataFrame, horizon: int) -> DataFrame:
    """Rows of one horizon, one per (as_of_date, ticker): group means of both sides, joined; health's gate (1 and 0 where
    there is none)."""
    k = ["as_of_date", "ticker"]
    a = losses.where(F.col("horizon") == horizon).groupBy(*k).agg(*[F.avg(c).alias(c) for c in ("score", "excess_return", "rank_loss", "vol_6m", "rank_score") if c in losses.columns])
    b = ehat.where(F.col("horizon") == horizon).groupBy(*k).agg(F.avg("g_pred").alias("g_pred"), F.avg("ehat_raw").alias("ehat_raw"))
    h = health.select("as_of_date", F.col("G_exposure").alias("_g"), F.col("H_realized").alias("_h")).dropDuplicates(["as_of_date"])
    d = a.join(b, k).join(F.broadcast(h), "as_of_date", "left")  # a row a date
    return d.withColumns({"G_exposure": F.coalesce("_g", F.lit(1.0)), "H_realized": F.coalesce("_h", F.lit(0.0))}).drop("_g", "_h")


def conflict_by_date(rows: DataFrame) -> DataFrame:
    """Per date: correlation of uncertainty and |score|."""
    return rows.groupBy("as_of_date").agg(safe_corr("ehat_raw", F.abs("score")).alias("rho"), F.count(F.lit(1)).alias("n"))


def conflict_deciles(rows: DataFrame, buckets: int = 10) -> DataFrame:
    """By bucket of uncertainty within its date (ranked first): |score|, loss, return."""
    d = rows.withColumn("bucket", bucket_by_order("ehat_raw", "as_of_date", buckets=buckets, tie="ticker")).where("bucket IS NOT NULL")
    return d.groupBy("bucket").agg(F.avg(F.abs("score")).alias("mean_abs_score"), F.avg("rank_loss").alias("mean_loss"), F.avg("excess_return").alias("mean_return"), F.stddev_samp("excess_return").alias("std_return"), F.count(F.lit(1)).alias("n"))


def conflict_verdict(by_date: DataFrame, least: float = 0.05) -> DataFrame:
    return by_date.agg(median("rho").alias("median_rho"), F.count(F.lit(1)).alias("n_dates")).withColumn("conflict", F.col("median_rho") > least)


#: variant: (gated, what the book is sorted by)
VARIANTS = ("raw", "gate_raw", "gate_vol", "gate_ua_sort", "gate_resid", "gate_cap", "trail_ic")


def variant_scores(rows: DataFrame, vol_constant: Column | float = 0.05, ehat_constant: Column | float = 0.3, lam: Column | float = 0.5, cap_percentile: float = 0.9, cap_weight: float = 0.7, gate: float = 0.2) -> DataFrame:
    """Each row once for every policy: long_score and short_score that its book is sorted by, and whether the date is traded."""
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    s, on, always = F.col("score"), trusted("G_exposure", gate), F.lit(True)
    vol = size_by_volatility("score", "vol_6m", c(vol_constant))
    resid = F.greatest(residual_uncertainty("ehat_raw", "rank_score", *KEYS), F.lit(0.0))
    sized = size_by_uncertainty("score", resid, c(ehat_constant))
    capped = cap_uncertain("score", "ehat_raw", *KEYS, percentile=cap_percentile, weight=cap_weight)
    table = {"raw": (s, s, always), "gate_raw": (s, s, on), "gate_vol": (vol, vol, on), "gate_ua_sort": (s + c(lam) * F.col("g_pred"), s - c(lam) * F.col("g_pred"), on), "gate_resid": (sized, sized, on), "gate_cap": (capped, capped, on), "trail_ic": (s, s, F.col("H_realized") > 0)}
    d = rows.withColumns({f"_l_{v}": t[0] for v, t in table.items()} | {f"_s_{v}": t[1] for v, t in table.items()})
    each = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(f"_l_{v}").alias("long_score"), F.col(f"_s_{v}").alias("short_score"), t[2].alias("active")) for v, t in table.items()])
    return d.withColumn("_v", F.explode(each)).select(*rows.columns, "_v.*")


def policy_series(scored: DataFrame, k: int, by: list[str] = ["variant"], bps: float = 10.0, date: str = "as_of_date") -> DataFrame:
    """Per variant and date: the book's net return; flat dates (gate closed) return 0 and cost nothing, and the next active
    date pays for a whole new book; a date with too few names is flat too, but the book before it counts on."""
    active = scored.where("active")
    book = long_short(active, k, by, date, "long_score", "short_score")
    w = Window.partitionBy(*by).orderBy(date)
    dates = scored.groupBy(*by, date).agg(F.max(F.col("active").cast("int")).alias("_open"))
    names = book.groupBy(*by, date).agg(F.collect_set(F.when(F.col("side") == "long", F.col("ticker"))).alias("_l"), F.collect_set(F.when(F.col("side") == "short", F.col("ticker"))).alias("_s"), F.avg(F.when(F.col("side") == "long", F.col("excess_return"))).alias("long_return"), F.avg(F.when(F.col("side") == "short", F.col("excess_return"))).alias("short_return"))
    d = dates.join(names, [*by, date], "left")
    has = F.col("_l").isNotNull()
    run = F.sum((F.col("_open") == 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_run", run)
    since = Window.partitionBy(*by, "_run").orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    # books are 2k names: bounded arrays
    d = d.withColumns({"_pl": F.last("_l", ignorenulls=True).over(since), "_ps": F.last("_s", ignorenulls=True).over(since)})
    none = F.slice(F.coalesce("_l", "_pl", "_ps"), 1, 0)  # an empty book, whatever the names' type
    kept = F.size(F.array_intersect("_l", F.coalesce("_pl", none))) + F.size(F.array_intersect("_s", F.coalesce("_ps", none)))
    d = d.withColumn("turnover", F.when(has, 1 - kept / (2.0 * k)).otherwise(0.0)).withColumn("flat", ~has)
    d = d.withColumn("cost", 2 * bps / 10000 * F.col("turnover")).withColumn("ls_return", F.when(has, F.col("long_return") - F.col("short_return")).otherwise(0.0))
    return d.withColumn("ls_return_net", F.col("ls_return") - F.col("cost")).select(*by, date, "flat", "turnover", "cost", "ls_return", "ls_return_net")


def calibrate(rows: DataFrame, grid: DataFrame, k: int, until: str = "2024-01-01", bps: float = 10.0, least: int = 10) -> DataFrame:
    """grid: columns lam, cap_percentile, cap_weight (a small table).  All points in one job on the dates before ``until``:
    each parameter's Sharpe and the best point."""
    dev = rows.where(F.col("as_of_date") < F.lit(until).cast("date")).crossJoin(F.broadcast(grid))
    point = ["lam", "cap_percentile", "cap_weight"]
    # a share of ranks over the percentile is a value over its interpolated quantile, the rule that ``cap_uncertain`` applies
    known = F.col("ehat_raw").isNotNull()
    rank = F.when(known, F.percent_rank().over(Window.partitionBy("as_of_date", *point, known).orderBy("ehat_raw")))
    d = dev.withColumn("_p", rank).withColumn("_capped", F.col("score") * F.when(F.col("_p") > F.col("cap_percentile"), F.col("cap_weight")).otherwise(1.0))
    d = d.withColumns({"long_score": F.col("_capped") + F.col("lam") * F.col("g_pred"), "short_score": F.col("_capped") - F.col("lam") * F.col("g_pred"), "active": trusted("G_exposure")})
    m = metrics(policy_series(d, k, point, bps), point, least=least).select(*point, "sharpe", "n")
    best = F.row_number().over(Window.orderBy(F.col("sharpe").desc_nulls_last(), *point)) == 1
    return m.withColumn("best", best)


def trailing_constant(rows: DataFrame, uncertainty: str = "ehat_raw", until: str = "2024-01-01") -> DataFrame:
    return sizing_constant(rows, uncertainty, where=f"as_of_date < '{until}'")


__all__ = [n for n in dir() if not n.startswith("_") and n != "annotations"]
