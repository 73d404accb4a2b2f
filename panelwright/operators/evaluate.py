"""Evaluation of scores: rank correlation, top-k, churn, folds, baselines, gates.

Rows are (as_of_date, ticker, horizon, fold_id, score, excess_return, ...); ``keys`` are the columns
that name a cross-section, so folds, horizons, models and variants are evaluated together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import auroc, bucket_by_edges, median, safe_corr, spearman, with_ranks, xs
from ..functions.scalars import factor_scores, random_score, slippage_bps
from .cross import deterministic_rank

KEYS = ["as_of_date", "horizon"]


def rank_ic(rows: DataFrame, keys: list[str] = KEYS, score: str = "score", label: str = "excess_return", least: int = 2) -> DataFrame:
    return spearman(rows, score, label, keys, "rank_ic", least)


def feature_ic(rows: DataFrame, features: list[str], label: str, keys: list[str], least: int = 10) -> DataFrame:
    """rank_ic of many features at once: features are unpivoted and named by ``feature``."""
    ids = [*keys, "ticker", label]
    long = rows.unpivot(ids, features, "feature", "value")
    return spearman(long, "value", label, ["feature", *keys], "rank_ic", least)


def ic_stability(ic: DataFrame, by: list[str], least: int = 12, threshold: float = 0.7) -> DataFrame:
    """Mean, population deviation, share of positive dates, sign consistency."""
    d = ic.where("rank_ic IS NOT NULL")
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n_dates"), F.avg("rank_ic").alias("mean_ic"), F.stddev_pop("rank_ic").alias("std_ic"), F.avg((F.col("rank_ic") > 0).cast("double")).alias("positive_share"))
    consistency = F.greatest(F.col("positive_share"), 1 - F.col("positive_share"))
    return g.where(F.col("n_dates") >= least).withColumns({"ic_ir": F.try_divide("mean_ic", "std_ic"), "sign_consistency": consistency, "stable": consistency >= threshold})


def top_k(rows: DataFrame, k: int, keys: list[str] = KEYS, score: str = "score", label: str = "excess_return", tie: str = "ticker") -> DataFrame:
    """Hit rate and mean return of the k best; NULL with fewer than k names."""
    d = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumn("_r", deterministic_rank(score, tie, *keys))
    own = F.col("_r") <= k
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_names"), F.avg(F.when(own, (F.col(label) > 0).cast("double"))).alias("hit_rate"), F.avg(F.when(own, F.col(label))).alias("top_return"))
    return g.withColumns({c: F.when(F.col("n_names") >= k, F.col(c)) for c in ("hit_rate", "top_return")})


def quantile_spread(rows: DataFrame, buckets: int = 5, keys: list[str] = KEYS, score: str = "score", label: str = "excess_return", least: int = 5) -> DataFrame:
    """Mean return of the top bucket less the bottom's (quantile edges, equal edges merged: NULL if the top is empty)."""
    d = bucket_by_edges(rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()), score, keys, buckets)
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_names"), F.avg(F.when(F.col("bucket") == buckets - 1, F.col(label))).alias("top_mean"), F.avg(F.when(F.col("bucket") == 0, F.col(label))).alias("bottom_mean"))
    return g.withColumn("spread", F.when(F.col("n_names") >= least, F.col("top_mean") - F.col("bottom_mean")))


def churn(rows: DataFrame, k: int, keys: list[str] = ["horizon"], date: str = "as_of_date", score: str = "score", tie: str = "ticker") -> DataFrame:
    """Per date with k names or more: share of the top k that was in the previous such date's top k."""
    d = rows.where(F.col(score).isNotNull()).withColumns({"_r": deterministic_rank(score, tie, *keys, date), "_n": F.count(score).over(xs(*keys, date))})
    book = d.where((F.col("_n") >= k) & (F.col("_r") <= k)).select(*keys, date, tie)
    dates = book.select(*keys, date).distinct().withColumn("_prev", F.lag(date).over(Window.partitionBy(*keys).orderBy(date)))
    now = book.join(dates, [*keys, date])
    was = book.withColumnRenamed(date, "_prev").withColumn("_in", F.lit(1))
    g = now.where("_prev IS NOT NULL").join(was, [*keys, "_prev", tie], "left").groupBy(*keys, date).agg(F.count("_in").alias("n_kept"))
    return g.withColumns({"retention": F.col("n_kept") / float(k), "churn": 1 - F.col("n_kept") / float(k)})


def per_date(rows: DataFrame, k: int = 10, keys: list[str] = ["fold_id", "horizon", "as_of_date"], least: int = 10) -> DataFrame:
    """All per-date metrics of all folds and horizons, in cross-sections of ``least`` names or more."""
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")
    d = rows.join(n, keys, "left_semi")
    out = rank_ic(d, keys).withColumnRenamed("n", "n_names")
    out = out.join(quantile_spread(d, 5, keys).select(*keys, "spread"), keys, "left")
    return out.join(top_k(d, k, keys).select(*keys, "hit_rate", "top_return"), keys, "left")


def summarize(daily: DataFrame, by: list[str], metrics: list[str], how: str = "median") -> DataFrame:
    """Middle and interquartile range of per-date metrics."""
    out = [F.count(F.lit(1)).alias("n_dates")]
    for m in metrics:
        out += [(median(m) if how == "median" else F.avg(m)).alias(m), (F.percentile(m, F.lit(0.75)) - F.percentile(m, F.lit(0.25))).alias(f"{m}_iqr")]
    return daily.groupBy(*by).agg(*out)


def fold_summary(rows: DataFrame, k: int = 10) -> DataFrame:
    daily = per_date(rows, k)
    s = summarize(daily, ["fold_id", "horizon"], ["rank_ic", "spread", "hit_rate", "top_return"])
    c = churn(rows, k, ["fold_id", "horizon"]).groupBy("fold_id", "horizon").agg(median("churn").alias("churn"))
    return s.join(c, ["fold_id", "horizon"], "left")


def signal_summary(ic: DataFrame, by: list[str]) -> DataFrame:
    g = ic.where("rank_ic IS NOT NULL").groupBy(*by).agg(F.avg("rank_ic").alias("mean_ic"), median("rank_ic").alias("median_ic"), F.stddev_samp("rank_ic").alias("std_ic"), F.avg((F.col("rank_ic") > 0).cast("double")).alias("positive_share"), F.count(F.lit(1)).alias("n_dates"))
    return g.withColumn("ic_stability", F.try_divide("mean_ic", "std_ic"))


def cost_survival(daily: DataFrame, by: list[str], fold: str = "fold_id") -> DataFrame:
    """Share of folds whose median top-k return is positive."""
    f = daily.groupBy(*by, fold).agg(median("top_return").alias("_m"))
    return f.groupBy(*by).agg(F.avg((F.col("_m") > 0).cast("double")).alias("positive_folds"), F.count(F.lit(1)).alias("n_folds"))


def regime_metrics(daily: DataFrame, regimes: DataFrame, axes: list[str], by: list[str], date: str = "as_of_date", thin: int = 20) -> DataFrame:
    """Metrics by regime axis and bucket; ``regimes``: a row a date."""
    d = daily.join(F.broadcast(regimes), date)
    d = d.withColumn("_x", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.coalesce(F.col(a).cast("string"), F.lit("unknown")).alias("bucket")) for a in axes])))
    g = d.groupBy(*by, "_x.axis", "_x.bucket").agg(F.count(F.lit(1)).alias("n_dates"), F.avg("rank_ic").alias("mean_ic"), median("rank_ic").alias("median_ic"))
    return g.withColumn("thin", F.col("n_dates") < thin)


def baselines(panel: DataFrame, label: str = "excess_return", keys: list[str] = KEYS) -> DataFrame:
    """Rows for every baseline score (a column ``baseline``): momentum factors and a fixed random score."""
    scores = factor_scores() | {"naive_random": random_score(*keys, "ticker")}
    d = panel.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(n).alias("baseline"), c.cast("double").alias("score")) for n, c in scores.items()])))
    return d.drop("score").select("*", "_s.*").drop("_s").where(F.col("score").isNotNull() & F.col(label).isNotNull())


def is_monotone(rows: DataFrame, score: str, factor: str, keys: list[str]) -> DataFrame:
    """Whether a baseline's score orders names as its factor does."""
    return spearman(rows, score, factor, keys, "rho").withColumn("monotone", F.col("rho") > 0.999)


def baseline_floor(daily: DataFrame) -> DataFrame:
    """The best baseline by median rank_ic at each horizon."""
    g = daily.groupBy("baseline", "horizon").agg(median("rank_ic").alias("median_ic"), F.avg((F.col("rank_ic") > 0).cast("double")).alias("positive_share"))
    return g.groupBy("horizon").agg(F.max_by("baseline", F.struct("median_ic", "baseline")).alias("best"), F.max("median_ic").alias("floor"))


def churn_diagnostics(c: DataFrame, by: list[str], high: float = 0.5) -> DataFrame:
    return c.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), median("churn").alias("median_churn"), F.percentile("churn", F.lit(0.9)).alias("p90_churn"), F.avg((F.col("churn") > high).cast("double")).alias("high_share"))


def cost_scenarios(spark) -> DataFrame:
    return spark.createDataFrame([("zero", 0.0, 0.0), ("low", 20.0, 5.0), ("base", 20.0, 10.0), ("high", 20.0, 20.0)], "scenario string, base_bps double, coefficient double")


def rebalance_cost(rows: DataFrame, scenarios: DataFrame, k: int = 10, aum: float = 1e6, keys: list[str] = ["horizon"], date: str = "as_of_date", missing_bps: float = 100.0) -> DataFrame:
    """Cost of moving an equal-weight top-k book from one date to the next: turnover, mean cost in bps of
    the traded names by scenario, and cost as a share of the book."""
    d = rows.where("score IS NOT NULL").withColumns({"_r": deterministic_rank("score", "ticker", *keys, date), "_n": F.count("score").over(xs(*keys, date))})
    book = d.where((F.col("_n") >= k) & (F.col("_r") <= k)).select(*keys, date, "ticker", "adv")
    dates = book.select(*keys, date).distinct().withColumn("_next", F.lead(date).over(Window.partitionBy(*keys).orderBy(date)))
    firsts = dates.groupBy(*keys).agg(F.min(date).alias("_first"))
    left = book.join(dates, [*keys, date]).where("_next IS NOT NULL").select(*keys, F.col("_next").alias(date), "ticker", F.col("adv").alias("_adv"), F.lit(1.0 / k).alias("_was"))
    both = book.withColumn("_is", F.lit(1.0 / k)).join(left, [*keys, date, "ticker"], "full").join(firsts, keys).where(F.col(date) > F.col("_first"))
    both = both.withColumns({"move": F.abs(F.coalesce("_is", F.lit(0.0)) - F.coalesce("_was", F.lit(0.0))), "adv": F.coalesce("adv", "_adv")}).where("move > 0")
    trade = F.col("move") * aum
    share = F.when(F.col("adv") < 1000, 1.0).otherwise(F.least(trade / F.col("adv"), F.lit(1.0)))
    bps = F.when(F.col("adv").isNull(), missing_bps).otherwise(F.col("base_bps") + slippage_bps(share, F.col("coefficient")))
    c = both.crossJoin(F.broadcast(scenarios)).withColumn("_bps", bps)
    return c.groupBy("scenario", *keys, date).agg((F.sum("move") / 2).alias("turnover"), F.avg("_bps").alias("mean_bps"), (F.sum(F.col("move") * F.col("_bps")) / 10000).alias("cost"))


def cost_overlay(summary: DataFrame, scenarios: DataFrame, gross: str = "top_return") -> DataFrame:
    """The documented fixed overlay on fold summaries: base cost plus the coefficient at one percent."""
    c = summary.crossJoin(F.broadcast(scenarios)).withColumn("cost_share", F.when(F.col("scenario") == "zero", 0.0).otherwise((F.col("base_bps") + F.col("coefficient") * 0.01) / 10000))
    return c.withColumn("net", F.col(gross) - F.col("cost_share")).withColumn("survives", F.col("net") > 0)


def scorecard(summary: DataFrame, churned: DataFrame, decay: DataFrame, by: list[str]) -> DataFrame:
    return summary.join(churned, by, "left").join(decay, by, "left")


def acceptance(model: DataFrame, floor: DataFrame, least_positive: float = 0.5, most_churn: float = 0.3, gain: float = 0.02) -> DataFrame:
    """Per horizon four criteria (gain over the floor, positive folds, churn, a defined spread) and the verdict."""
    d = model.join(floor, "horizon")
    tests = {"beats_floor": F.col("rank_ic") >= F.col("floor") + gain, "mostly_positive": F.col("positive_share") >= least_positive, "low_churn": F.col("churn") <= most_churn, "positive_spread": F.col("spread") > 0}
    d = d.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in tests.items()})
    passed = sum((F.col(n).cast("int") for n in tests), F.lit(0))
    return d.withColumn("n_passed", passed).withColumn("verdict", F.when(passed == len(tests), "accept").when(passed >= 3, "watch").otherwise("reject"))


def signal_gates(ic: DataFrame, by: list[str], least_ic: float = 0.02, least_positive: float = 0.55, least_ir: float = 0.1) -> DataFrame:
    s = signal_summary(ic, by)
    s = s.withColumns({"gate1": F.col("mean_ic") >= least_ic, "gate2": F.col("positive_share") >= least_positive, "gate3": F.coalesce(F.col("ic_stability") >= least_ir, F.lit(False))})
    return s.withColumn("passed", F.col("gate1") & F.col("gate2") & F.col("gate3"))


def fusion_gate(fused: DataFrame, single: DataFrame, by: list[str], gain: float = 0.0) -> DataFrame:
    """Whether the fused score's mean IC beats the best single one."""
    best = single.groupBy(*by).agg(F.max("mean_ic").alias("best_single"))
    return fused.join(best, by).withColumn("gate4", F.col("mean_ic") > F.col("best_single") + gain)


def score_correlation(a: DataFrame, b: DataFrame, on: list[str], keys: list[str], least: int = 10) -> DataFrame:
    """Rank correlation of two score tables, per cross-section."""
    d = a.select(*on, F.col("score").alias("score_a")).join(b.select(*on, F.col("score").alias("score_b")), on)
    return spearman(d, "score_a", "score_b", keys, "rho", least)


def shuffled_scores(rows: DataFrame, keys: list[str] = KEYS, seed: int = 1) -> DataFrame:
    """Scores dealt anew inside each cross-section, in an order fixed by the seed."""
    a = rows.withColumn("_i", F.row_number().over(xs(*keys).orderBy("ticker"))).drop("score")
    b = rows.select(*keys, "score", F.row_number().over(xs(*keys).orderBy(F.xxhash64("ticker", F.lit(seed)), "ticker")).alias("_i"))
    return a.join(b, [*keys, "_i"]).drop("_i")


def lagged_scores(rows: DataFrame, n: int, by: list[str] = ["ticker", "horizon"], date: str = "as_of_date") -> DataFrame:
    return rows.withColumn("score", F.lag("score", n).over(Window.partitionBy(*by).orderBy(date))).where("score IS NOT NULL")


def tripwires(rows: DataFrame, lags: tuple[int, ...] = (1, 7), keys: list[str] = KEYS) -> DataFrame:
    """Mean IC of the scores as they are, shuffled, and lagged: a leak shows as a shuffled IC off zero or one
    that falls to nothing with a lag."""
    every = rows.withColumn("control", F.lit("as_is")).unionByName(shuffled_scores(rows, keys).select(rows.columns).withColumn("control", F.lit("shuffled")))
    for n in lags:
        every = every.unionByName(lagged_scores(rows, n).select(rows.columns).withColumn("control", F.lit(f"lag_{n}")))
    ic = rank_ic(every, ["control", *keys])
    return ic.groupBy("control", "horizon").agg(F.avg("rank_ic").alias("mean_ic"), F.count("rank_ic").alias("n_dates"))


def is_clone(a: DataFrame, b: DataFrame, on: list[str], keys: list[str], most: float = 0.95) -> DataFrame:
    """Whether a model is a baseline in disguise: median and 90th percentile of per-date correlations."""
    c = score_correlation(a, b, on, keys)
    return c.groupBy(*[k for k in keys if k != "as_of_date"]).agg(median("rho").alias("median_rho"), F.percentile("rho", F.lit(0.9)).alias("p90_rho")).withColumn("clone", F.col("median_rho") > most)


def external_frame(rows: DataFrame) -> DataFrame:
    """Rows in the form an outside evaluator reads: (datetime at the close in UTC, instrument) -> score, label."""
    from ..functions.scalars import close_utc

    return rows.select(close_utc("as_of_date").alias("datetime"), F.col("ticker").cast("string").alias("instrument"), "horizon", "score", F.col("excess_return").alias("label"))


def ic_parity(ours: DataFrame, theirs: DataFrame, on: list[str], tolerance: float = 1e-6) -> DataFrame:
    d = ours.select(*on, F.col("rank_ic").alias("a")).join(theirs.select(*on, F.col("rank_ic").alias("b")), on, "full")
    return d.withColumn("same", F.coalesce(F.abs(F.col("a") - F.col("b")) <= tolerance, F.col("a").isNull() & F.col("b").isNull()))


def bucket_returns(rows: DataFrame, buckets: int, keys: list[str], score: str = "score", label: str = "excess_return") -> DataFrame:
    d = bucket_by_edges(rows, score, keys, buckets)
    return d.where("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("mean_return"), F.avg((F.signum(score) == F.signum(label)).cast("double")).alias("sign_agreement"))


def monotonicity(buckets: DataFrame, value: str, order: str, keys: list[str], slack: float = 0.005) -> DataFrame:
    """Correlation of bucket order and value, and whether no step falls by more than ``slack``."""
    w = Window.partitionBy(*keys).orderBy(order) if keys else Window.partitionBy(F.lit(1)).orderBy(order)
    d = buckets.withColumn("_step", F.col(value) - F.lag(value).over(w))
    d = with_ranks(d, order, value, keys) if keys else with_ranks(d.withColumn("_k", F.lit(1)), order, value, ["_k"])
    return d.groupBy(*(keys or [])).agg(safe_corr("_rx", "_ry").alias("rho"), F.coalesce(F.min("_step") >= -slack, F.lit(True)).alias("monotone"))


def failure_auroc(daily: DataFrame, risk: str, keys: list[str]) -> DataFrame:
    """How well a risk measure ranks the dates on which the IC is negative."""
    return auroc(daily.withColumn("_bad", (F.col("rank_ic") < 0).cast("int")), "_bad", risk, keys)


def align_scores(base: DataFrame, others: dict[str, DataFrame], on: list[str]) -> DataFrame:
    """The base rows with each other table's score (NULL where it has none) under its name; keys of the others are made unique by
    their mean."""
    out = base
    for name, d in others.items():
        out = out.join(d.groupBy(*on).agg(F.avg("score").alias(name)), on, "left")
    return out


def concat(frames: dict[str, DataFrame], name: str) -> DataFrame:
    """All rows of several frames (folds, horizons, models, tickers), the frame they come from in column ``name``; columns that a
    frame lacks are NULL.  What is evaluated by keys then runs once for all of them."""
    out = None
    for key, d in frames.items():
        d = d.withColumn(name, F.lit(key))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out
