"""Long/short books: variants and dates ride along as keys; turnover, costs, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import col
from ..functions.scalars import confidence_bucket, periods, rank_category
from .series import cumulative_return, drawdown


def long_short(rows: DataFrame, k: int, by: list[str], date: str = "as_of_date", long_by: str = "score", short_by: str | None = None, label: str = "excess_return", tie: str = "ticker") -> DataFrame:
    """by, date, side, tie, label: the k best and k worst of each date with 2k names or more.  ``short_by``: the score that the
    short side is sorted by."""
    s = short_by or long_by
    known = rows.where(F.col(long_by).isNotNull() & F.col(s).isNotNull() & F.col(label).isNotNull())
    w = Window.partitionBy(*by, date)
    d = known.withColumns({"_l": F.row_number().over(w.orderBy(F.col(long_by).desc(), tie)), "_s": F.row_number().over(w.orderBy(F.col(s).asc(), tie)), "_n": F.count(F.lit(1)).over(w)}).where(F.col("_n") >= 2 * k)
    d = d.withColumn("side", F.explode(F.array_compact(F.array(F.when(F.col("_l") <= k, "long"), F.when(F.col("_s") <= k, "short")))))
    return d.select(*by, date, "side", tie, label)


def book_series(book: DataFrame, k: int, by: list[str], date: str = "as_of_date", label: str = "excess_return", tie: str = "ticker", bps: float = 10.0) -> DataFrame:
    """Per date: returns of both sides, turnover against the book before (share of names replaced, mean of both
    sides; 1 at the start), cost 2 * bps * turnover, net return."""
    w = Window.partitionBy(*by).orderBy(date)
    dates = book.select(*by, date).distinct().withColumn("_next", F.lead(date).over(w))
    was = book.join(dates, [*by, date]).where("_next IS NOT NULL").select(*by, F.col("_next").alias(date), "side", tie, F.lit(1).alias("_was"))
    d = book.join(was, [*by, date, "side", tie], "left")
    g = d.groupBy(*by, date).agg(F.avg(F.when(F.col("side") == "long", F.col(label))).alias("long_return"), F.avg(F.when(F.col("side") == "short", F.col(label))).alias("short_return"), F.count("_was").alias("_kept"))
    g = g.withColumn("turnover", F.when(F.lag(date).over(w).isNull(), 1.0).otherwise(1 - F.col("_kept") / (2.0 * k))).drop("_kept")
    g = g.withColumn("ls_return", F.col("long_return") - F.col("short_return")).withColumn("cost", 2 * bps / 10000 * F.col("turnover"))
    return g.withColumn("ls_return_net", F.col("ls_return") - F.col("cost"))


def symmetric_turnover(now: Column, was: Column, k: int) -> Column:
    """Names in one of two books (arrays) but not both, over 4k."""
    return F.size(F.array_except(F.array_union(now, was), F.array_intersect(now, was))) / (4.0 * k)


def weight_turnover(weights: DataFrame, by: list[str], date: str, entity: str, weight: str) -> DataFrame:
    """by, date, turnover = half the sum of |change of weight| against the date before; missing names weigh 0."""
    w = Window.partitionBy(*by).orderBy(date)
    dates = weights.select(*by, date).distinct().withColumns({"_next": F.lead(date).over(w), "_prev": F.lag(date).over(w)})
    was = weights.join(dates, [*by, date]).where("_next IS NOT NULL").select(*by, F.col("_next").alias(date), entity, F.col(weight).alias("_was"))
    both = weights.select(*by, date, entity, F.col(weight).alias("_is")).join(was, [*by, date, entity], "full")
    g = both.groupBy(*by, date).agg((F.sum(F.abs(F.coalesce("_is", F.lit(0.0)) - F.coalesce("_was", F.lit(0.0)))) / 2).alias("turnover"))
    return g.join(dates.where("_prev IS NOT NULL").select(*by, date), [*by, date], "left_semi")


def metrics(series: DataFrame, by: list[str], ret: str = "ls_return_net", date: str = "as_of_date", per_year: float = 12.0, least: int = 2) -> DataFrame:
    """n, mean, deviation, Sharpe, Sortino, hit rate, total and yearly return, worst fall, Calmar, win/loss, best, worst."""
    w = Window.partitionBy(*by).orderBy(date)
    d = series.where(F.col(ret).isNotNull()).withColumn("_c", cumulative_return(ret, w)).withColumn("_d", drawdown("_c", w))
    r = F.col(ret)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), 2))).alias("_down"), F.avg((r > 0).cast("double")).alias("hit_rate"), F.max_by("_c", date).alias("total_return"), F.min("_d").alias("max_drawdown"), F.max(r).alias("best"), F.min(r).alias("worst"), F.avg(F.when(r > 0, r)).alias("_win"), F.avg(F.when(r < 0, r)).alias("_loss")]
    if "turnover" in series.columns:
        aggs.append(F.avg("turnover").alias("mean_turnover"))
    g = d.groupBy(*by).agg(*aggs).where(F.col("n") >= least)
    g = g.withColumns({"sharpe": F.when(F.col("std") > 1e-12, F.col("mean") / F.col("std") * per_year**0.5), "sortino": F.when(F.col("_down") > 1e-12, F.col("mean") / F.col("_down") * per_year**0.5), "cagr": F.when(F.col("total_return") > -1, F.pow(1 + F.col("total_return"), per_year / F.col("n")) - 1), "win_loss": F.try_divide("_win", F.abs("_loss"))})
    return g.withColumn("calmar", F.try_divide("cagr", F.abs("max_drawdown"))).drop("_down", "_win", "_loss")


def by_period(series: DataFrame, date: str = "as_of_date", final_from: str = "2024-01-01", crisis: tuple[str, str] | None = None) -> DataFrame:
    """Each row once for every period that it counts in."""
    return series.withColumn("period", F.explode(periods(date, final_from, crisis)))


def every_nth(rows: DataFrame, n: int, by: list[str], date: str = "as_of_date") -> DataFrame:
    dates = rows.select(*by, date).distinct().withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(date)) - 1)
    return rows.join(dates.where(F.col("_i") % n == 0).drop("_i"), [*by, date], "left_semi")


def first_of_month(series: DataFrame, by: list[str], date: str = "as_of_date") -> DataFrame:
    """The first row of each month: returns that do not overlap."""
    n = F.row_number().over(Window.partitionBy(*by, F.trunc(date, "month")).orderBy(date))
    return series.withColumn("_n", n).where("_n = 1").drop("_n")


def monthly_means(df: DataFrame, values: list[str], by: list[str], date: str) -> DataFrame:
    return df.groupBy(*by, F.trunc(date, "month").alias("month")).agg(*[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("n"))


def window_statistics(df: DataFrame, windows: DataFrame, value: str, date: str, ic: str | None = None, least: float = 0.2, by: list[str] | None = None) -> DataFrame:
    """windows: name, start, end (a few).  Mean, median, extremes, share under ``least``, and the verdicts' IC."""
    d = df.join(F.broadcast(windows), F.col(date).between(F.col("start"), F.col("end")))
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg((F.col(value) < least).cast("double")).alias("abstain_share")]
    return d.groupBy("name", *(by or [])).agg(*aggs, *([F.avg(ic).alias("mean_ic")] if ic else []))


def adopt_or_retain(table: DataFrame, incumbent: str, metric: str = "sharpe", gain: float = 0.05, model: str = "model") -> DataFrame:
    """One row: the best model, the incumbent's metric, and whether the best is enough better."""
    g = table.agg(F.max_by(model, F.struct(metric, model)).alias("best"), F.max(metric).alias("best_metric"), F.max(F.when(F.col(model) == incumbent, F.col(metric))).alias("incumbent_metric"))
    return g.withColumn("decision", F.when(F.col("best_metric") > F.col("incumbent_metric") + gain, F.concat(F.lit("adopt "), F.col("best"))).otherwise(f"retain {incumbent}"))


def rankings(rows: DataFrame, by: list[str], score: str = "score", tie: str = "ticker", confidence: str | None = None) -> DataFrame:
    w = Window.partitionBy(*by)
    d = rows.where(F.col(score).isNotNull()).withColumns({"rank": F.row_number().over(w.orderBy(F.col(score).desc(), tie)), "_n": F.count(F.lit(1)).over(w)})
    d = d.withColumn("percentile", 100.0 * (F.col("_n") - F.col("rank")) / F.greatest(F.col("_n") - 1, F.lit(1))).withColumn("category", rank_category("percentile"))
    return (d.withColumn("confidence_bucket", confidence_bucket(confidence)) if confidence else d).drop("_n")


def ranking_report(ranked: DataFrame, by: list[str], label: str = "excess_return", n: int = 5) -> DataFrame:
    """Per list: counts by category, spread of the outer fifths, and the names at both ends."""
    top = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ticker"))), lambda x: x.ticker), 1, n)
    g = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("category") == "top_buy").cast("long")).alias("n_top_buy"), F.sum((F.col("category") == "strong_avoid").cast("long")).alias("n_avoid"), (F.avg(F.when(F.col("percentile") >= 80, F.col(label))) - F.avg(F.when(F.col("percentile") <= 20, F.col(label)))).alias("quintile_spread"), top.alias("top_names"))
    return g


def select_signals(signals: DataFrame, direction: str | None = None, least_confidence: float | None = None, tickers: list | None = None) -> DataFrame:
    d = signals
    if direction:
        d = d.where(F.col("direction") == direction)
    if least_confidence is not None:
        d = d.where(F.col("confidence") >= least_confidence)
    return d.where(F.col("ticker").isin(tickers)) if tickers else d


def weight_years(df: DataFrame, weight: str, date: str, by: list[str]) -> DataFrame:
    """Weight by year, and the effective sample size."""
    g = df.groupBy(*by, F.year(date).alias("year")).agg(F.sum(weight).alias("weight"), F.sum(F.pow(F.col(weight), 2)).alias("_sq"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("effective_n", F.try_divide(F.col("weight") * F.col("weight"), F.col("_sq"))).drop("_sq")


def weighted_median_date(df: DataFrame, weight: str, date: str, by: list[str]) -> DataFrame:
    """The date on which half of the weight is reached (weights are first summed by date)."""
    d = df.groupBy(*by, date).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*by).orderBy(date)
    d = d.withColumns({"_cum": F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_w").over(Window.partitionBy(*by))})
    return d.where(F.col("_cum") >= F.col("_all") / 2).groupBy(*by).agg(F.min(date).alias("median_date"))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "col")]
