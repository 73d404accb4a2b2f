"""Queries: labels, folds, evaluation, portfolios, uncertainty, health, policies, audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ranks as R
from ..functions import scalars as S
from ..operators import evaluate, events, health, labels, learn, pit, policy, portfolio, series, stats, uncertainty, universe, order
from .queries_models import GRID, GROW, PBOOK, PDAY, PROW, PSER, PVAR, fixed_gate
from .registry import Views, ar, corr, pr, query, r, rounded
from .sqlviews import sql

K = "as_of_date, horizon"
KEYS = ["as_of_date", "horizon"]
IC = f"SELECT as_of_date, horizon, {corr('x', 'y')} AS rank_ic, count(*) AS n FROM (SELECT *, {ar('score', K)} AS x, {ar('excess_return', K)} AS y FROM ev) GROUP BY 1, 2"
TOP = "SELECT *, row_number() OVER (PARTITION BY as_of_date, horizon ORDER BY score DESC, ticker) AS k, count(*) OVER (PARTITION BY as_of_date, horizon) AS n FROM ev"


@query("forward_labels", sql("SELECT as_of_date, ticker, horizon, round(p1 / p0 - b1.close / b0.close, 6) AS excess_return, exit_date FROM (SELECT date AS as_of_date, ticker, 20 AS horizon, close AS p0, lead(close, 20) OVER w AS p1, lead(date, 20) OVER w AS exit_date FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date) UNION ALL SELECT date, ticker, 60, close, lead(close, 60) OVER w, lead(date, 60) OVER w FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)) x JOIN bench b0 ON b0.date = as_of_date JOIN bench b1 ON b1.date = exit_date", "bars", "bench"))
def forward_labels(v: Views):
    return rounded(labels.forward_labels(v.bars, v.bench, [20, 60]).drop("label_matured_at"))


@query("label_maturity", sql("SELECT as_of_date, CAST(((as_of_date + INTERVAL 16 HOUR)::TIMESTAMP AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS TIMESTAMP) AS close_utc FROM (SELECT DISTINCT date AS as_of_date FROM bench)", "bench"))
def label_maturity(v):
    return v.bench.select(F.col("date").alias("as_of_date"), S.close_utc("date").cast("timestamp_ntz").alias("close_utc"))


@query("label_pivot", sql("SELECT as_of_date, ticker, max(excess_return) FILTER (horizon = 20) AS excess_return_20d, max(excess_return) FILTER (horizon = 60) AS excess_return_60d FROM ev GROUP BY 1, 2 HAVING count(*) = 2", "ev"))
def label_pivot(v):
    d = v.ev.select("as_of_date", "ticker", "horizon", "excess_return", S.close_utc("as_of_date").alias("label_matured_at"))
    return labels.complete_rows(labels.pivot_labels(d, [20, 60]), [20, 60]).select("as_of_date", "ticker", "excess_return_20d", "excess_return_60d")


CAL = "SELECT date AS session, CAST(row_number() OVER (ORDER BY date) - 1 AS BIGINT) AS session_idx FROM (SELECT DISTINCT date FROM bench)"


@query("session_arithmetic", sql("SELECT a.session, b.session AS plus_20, c.session AS minus_5 FROM cal a LEFT JOIN cal b ON b.session_idx = a.session_idx + 20 LEFT JOIN cal c ON c.session_idx = a.session_idx - 5", "bench", cal=CAL))
def session_arithmetic(v):
    c = labels.sessions(v.bench)
    d = labels.session_offset(c.select("session"), c, "session", 20, "plus_20")
    return labels.session_offset(d, c, "session", -5, "minus_5").select("session", "plus_20", "minus_5")


@query("rebalance_months", sql("SELECT CAST(date_trunc('month', date) AS DATE) AS period, max(date) AS rebalance FROM bench GROUP BY 1", "bench"))
def rebalance_months(v):
    return labels.rebalance_dates(labels.sessions(v.bench), "month")


@query("fold_assignment", sql("SELECT fold_id, part, CAST(count(*) AS BIGINT) AS n FROM (SELECT f.fold_id, CASE WHEN as_of_date >= train_start AND as_of_date < train_end THEN 'train' ELSE 'val' END AS part, as_of_date, horizon, train_end FROM ev JOIN f ON (as_of_date >= train_start AND as_of_date < train_end) OR (as_of_date >= val_start AND as_of_date < val_end)) WHERE CASE WHEN part = 'train' THEN as_of_date + (floor(horizon * 365 / 252.0)::INT + 1) <= train_end ELSE as_of_date - (floor(horizon * 365 / 252.0)::INT + 1) >= train_end END GROUP BY 1, 2", "ev", f="SELECT printf('fold_%02d', row_number() OVER (ORDER BY c)) AS fold_id, DATE '1992-01-01' AS train_start, CAST(c - 131 AS DATE) AS train_end, c AS val_start, CAST(coalesce(lead(c) OVER (ORDER BY c), c + INTERVAL 3 MONTH) AS DATE) AS val_end FROM (SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '1999-01-01', INTERVAL 3 MONTH)) AS DATE) AS c)"))
def fold_assignment(v):
    f = labels.make_folds(labels.period_starts(v.spark, "1996-01-01", "1999-01-01", 3), "1992-01-01", 3, 90)
    d = labels.assign_folds(v.ev.drop("fold_id"), f).where(~labels.purged("as_of_date", "horizon", "train_end", "part"))
    return d.groupBy("fold_id", "part").agg(F.count(F.lit(1)).alias("n"))


@query("rank_ic_by_date", sql(f"SELECT as_of_date, horizon, round(rank_ic, 6) AS rank_ic, n FROM ({IC})", "ev"))
def rank_ic_by_date(v):
    return rounded(evaluate.rank_ic(v.ev))


@query("signal_summary", sql(f"SELECT horizon, round(avg(rank_ic), 6) AS mean_ic, round(quantile_cont(rank_ic, 0.5), 6) AS median_ic, round(stddev_samp(rank_ic), 6) AS std_ic, round(avg((rank_ic > 0)::INT), 6) AS positive_share, count(*) AS n_dates, round(avg(rank_ic) / stddev_samp(rank_ic), 6) AS ic_stability FROM ({IC}) WHERE rank_ic IS NOT NULL GROUP BY 1", "ev"))
def signal_summary(v):
    return rounded(evaluate.signal_summary(evaluate.rank_ic(v.ev), ["horizon"]))


@query("top_k_metrics", sql(f"SELECT as_of_date, horizon, max(n) AS n_names, CASE WHEN max(n) >= 10 THEN round(avg((excess_return > 0)::INT) FILTER (k <= 10), 6) END AS hit_rate, CASE WHEN max(n) >= 10 THEN round(avg(excess_return) FILTER (k <= 10), 6) END AS top_return FROM ({TOP}) GROUP BY 1, 2", "ev"))
def top_k_metrics(v):
    return rounded(evaluate.top_k(v.ev, 10))


@query("quintile_spread", sql("SELECT as_of_date, horizon, CASE WHEN count(*) >= 5 THEN round(avg(excess_return) FILTER (b = 4) - avg(excess_return) FILTER (b = 0), 6) END AS spread FROM (SELECT *, CASE WHEN len(e) > 1 THEN len(list_filter(e[2:len(e)-1], lambda x: x < score)) END AS b FROM (SELECT *, list_sort(list_distinct(quantile_cont(score, [0, 0.2, 0.4, 0.6, 0.8, 1]) OVER (PARTITION BY as_of_date, horizon))) AS e FROM ev)) GROUP BY 1, 2", "ev"))
def quintile_spread(v):
    return rounded(evaluate.quantile_spread(v.ev).select("as_of_date", "horizon", "spread"))


BOOK = "SELECT as_of_date, horizon, ticker, adv FROM (SELECT *, row_number() OVER (PARTITION BY as_of_date, horizon ORDER BY score DESC, ticker) AS k, count(*) OVER (PARTITION BY as_of_date, horizon) AS n FROM ev) WHERE k <= 10 AND n >= 10"
BOOKD = "SELECT DISTINCT horizon, as_of_date FROM book"
BOOKP = "SELECT *, lag(as_of_date) OVER (PARTITION BY horizon ORDER BY as_of_date) AS prev FROM bd"


@query("top_k_churn", sql("SELECT b.horizon, b.as_of_date, count(p.ticker) AS n_kept, round(count(p.ticker) / 10.0, 6) AS retention, round(1 - count(p.ticker) / 10.0, 6) AS churn FROM book b JOIN bp USING (horizon, as_of_date) LEFT JOIN book p ON p.horizon = b.horizon AND p.as_of_date = bp.prev AND p.ticker = b.ticker WHERE bp.prev IS NOT NULL GROUP BY 1, 2", "ev", book=BOOK, bd=BOOKD, bp=BOOKP))
def top_k_churn(v):
    return rounded(evaluate.churn(v.ev, 10))


@query("fold_summary", sql(f"SELECT fold_id, horizon, count(*) AS n_dates, round(quantile_cont(rank_ic, 0.5), 6) AS rank_ic, round(quantile_cont(top_return, 0.5), 6) AS top_return FROM (SELECT fold_id, horizon, as_of_date, {corr('x', 'y')} AS rank_ic, avg(excess_return) FILTER (k <= 10) AS top_return FROM (SELECT *, {ar('score', K)} AS x, {ar('excess_return', K)} AS y FROM ({TOP}) WHERE n >= 10) GROUP BY 1, 2, 3) GROUP BY 1, 2", "ev"))
def fold_summary(v):
    return rounded(evaluate.fold_summary(v.ev).select("fold_id", "horizon", "n_dates", "rank_ic", "top_return"))


@query("ic_by_regime", sql(f"SELECT horizon, CASE WHEN m > 0 THEN 'bull' ELSE 'bear' END AS bucket, count(*) AS n_dates, round(avg(rank_ic), 6) AS mean_ic FROM ({IC}) i JOIN (SELECT month AS as_of_date, bclose / lag(bclose) OVER (ORDER BY month) - 1 AS m FROM mbench) USING (as_of_date) GROUP BY 1, 2", "ev", "mbench"))
def ic_by_regime(v):
    m = v.mbench.withColumn("m", series.simple_return("bclose", Window.orderBy("month"))).select(F.col("month").alias("as_of_date"), S.market_bucket("m").alias("market"))
    g = evaluate.regime_metrics(evaluate.rank_ic(v.ev), m, ["market"], ["horizon"])
    return rounded(g.select("horizon", "bucket", "n_dates", "mean_ic"))


@query("lag_tripwire", sql(f"SELECT horizon, round(avg(rank_ic), 6) AS mean_ic, count(rank_ic) AS n_dates FROM (SELECT as_of_date, horizon, {corr('x', 'y')} AS rank_ic FROM (SELECT *, {ar('s', K)} AS x, {ar('excess_return', K)} AS y FROM (SELECT *, lag(score) OVER (PARTITION BY ticker, horizon ORDER BY as_of_date) AS s FROM ev) WHERE s IS NOT NULL) GROUP BY 1, 2) GROUP BY 1", "ev"))
def lag_tripwire(v):
    return rounded(evaluate.tripwires(v.ev, (1,)).where("control = 'lag_1'").drop("control"))


@query("rebalance_cost", sql("SELECT horizon, as_of_date, round(sum(abs(move)) / 2, 6) AS turnover, round(sum(abs(move) * bps) / 10000, 8) AS cost FROM (SELECT horizon, as_of_date, ticker, move, 20 + least(500.0, 10 * sqrt(CASE WHEN adv < 1000 THEN 1.0 ELSE least(abs(move) * 1e6 / adv, 1.0) END)) AS bps FROM (SELECT coalesce(a.horizon, b.horizon) AS horizon, coalesce(a.as_of_date, b.nxt) AS as_of_date, coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.w, 0) - coalesce(b.w, 0) AS move, coalesce(a.adv, b.adv) AS adv FROM (SELECT *, 0.1 AS w FROM book) a FULL JOIN (SELECT book.*, 0.1 AS w, nxt FROM book JOIN bn USING (horizon, as_of_date) WHERE nxt IS NOT NULL) b ON a.horizon = b.horizon AND a.as_of_date = b.nxt AND a.ticker = b.ticker) JOIN (SELECT horizon, min(as_of_date) AS f FROM bd GROUP BY 1) USING (horizon) WHERE as_of_date > f AND abs(move) > 0) GROUP BY 1, 2", "ev", book=BOOK, bd=BOOKD, bn="SELECT *, lead(as_of_date) OVER (PARTITION BY horizon ORDER BY as_of_date) AS nxt FROM bd"))
def rebalance_cost(v):
    c = evaluate.rebalance_cost(v.ev, evaluate.cost_scenarios(v.spark).where("scenario = 'base'"), 10)
    return c.select("horizon", "as_of_date", F.round("turnover", 6).alias("turnover"), F.round("cost", 8).alias("cost"))


LS = "SELECT *, row_number() OVER (PARTITION BY as_of_date ORDER BY score DESC, ticker) AS l, row_number() OVER (PARTITION BY as_of_date ORDER BY score, ticker) AS s, count(*) OVER (PARTITION BY as_of_date) AS n FROM ev WHERE horizon = 20"
SER = "SELECT as_of_date, avg(excess_return) FILTER (l <= 10) - avg(excess_return) FILTER (s <= 10) AS ls_return FROM lsb WHERE n >= 20 GROUP BY 1"


@query("long_short_series", sql(f"SELECT as_of_date, round(ls_return, 6) AS ls_return FROM ({SER})", "ev", lsb=LS))
def long_short_series(v):
    b = portfolio.long_short(v.ev.where("horizon = 20"), 10, ["horizon"])
    return rounded(portfolio.book_series(b, 10, ["horizon"]).select("as_of_date", "ls_return"))


@query("portfolio_metrics", sql(f"SELECT count(*) AS n, round(avg(x), 6) AS mean, round(avg(x) / stddev_samp(x) * sqrt(12), 6) AS sharpe, round(avg((x > 0)::INT), 6) AS hit_rate, round(avg(x) / sqrt(avg(pow(least(x, 0), 2))) * sqrt(12), 6) AS sortino, round(exp(sum(ln(1 + x))) - 1, 5) AS total_return FROM (SELECT ls_return / 100 AS x FROM ({SER}))", "ev", lsb=LS))
def portfolio_metrics(v):
    b = portfolio.book_series(portfolio.long_short(v.ev.where("horizon = 20"), 10, ["horizon"]), 10, ["horizon"]).withColumn("x", F.col("ls_return") / 100)
    m = portfolio.metrics(b, ["horizon"], "x")
    return m.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "sharpe", "hit_rate", "sortino")], F.round("total_return", 5).alias("total_return"))


@query("drawdown_depth", sql(f"SELECT as_of_date, round(w / greatest(max(w) OVER (ORDER BY as_of_date), 1.0) - 1, 6) AS drawdown FROM (SELECT as_of_date, exp(sum(ln(1 + ls_return / 100)) OVER (ORDER BY as_of_date)) AS w FROM ({SER}))", "ev", lsb=LS))
def drawdown_depth(v):
    b = portfolio.book_series(portfolio.long_short(v.ev.where("horizon = 20"), 10, ["horizon"]), 10, ["horizon"]).withColumn("x", F.col("ls_return") / 100)
    w = Window.partitionBy("horizon").orderBy("as_of_date")
    d = b.withColumn("_c", series.cumulative_return("x", w)).withColumn("drawdown", series.drawdown("_c", w))
    return rounded(d.select("as_of_date", "drawdown"))


@query("universe_changes", sql("SELECT b.month AS month, count(*) FILTER (b.ticker IS NOT NULL) AS n, count(*) FILTER (new_) AS n_added FROM (SELECT a.month, a.ticker, NOT EXISTS (SELECT 1 FROM mbars p WHERE p.ticker = a.ticker AND p.month = (SELECT max(month) FROM md WHERE md.month < a.month)) AS new_ FROM mbars a WHERE a.month > (SELECT min(month) FROM md)) b GROUP BY 1", "mbars", md="SELECT DISTINCT month FROM mbars"))
def universe_changes(v):
    return universe.adjacent_changes(v.mbars, "month", "ticker").select("month", "n", "n_added")


@query("time_decay_weights", sql("SELECT horizon, year(as_of_date) AS year, round(sum(w), 6) AS weight, round(sum(w) * sum(w) / sum(w * w), 5) AS effective_n FROM (SELECT *, pow(2.0, -(DATE '1998-12-31' - as_of_date) / 365.25 / CASE WHEN horizon = 20 THEN 2.5 ELSE 3.5 END) AS w FROM ev) GROUP BY 1, 2", "ev"))
def time_decay_weights(v):
    d = v.ev.withColumn("w", S.decay_weight("as_of_date", F.lit("1998-12-31").cast("date"), S.half_life_years("horizon")))
    return portfolio.weight_years(d, "w", "as_of_date", ["horizon"]).select("horizon", "year", F.round("weight", 6).alias("weight"), F.round("effective_n", 5).alias("effective_n"))


# Statistics ------------------------------------------------------------------------------------


@query("feature_correlations", sql(" UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round({corr(a, b)}, 6) AS rho FROM mpanel WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in (("mom_1m", "mom_3m"), ("mom_1m", "vol_6m"), ("mom_3m", "vol_6m"))), "mpanel"))
def feature_correlations(v):
    return rounded(stats.correlation_pairs(v.mpanel, ["mom_1m", "mom_3m", "vol_6m"], "pearson").select("feature_a", "feature_b", "rho"))


@query("pooled_rank_ic", sql(f"SELECT count(*) AS n, round({corr('x', 'y')}, 6) AS rho FROM (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS x, rank() OVER (ORDER BY excess_return) + (count(*) OVER (PARTITION BY excess_return) - 1) / 2.0 AS y FROM ev WHERE horizon = 20)", "ev"))
def pooled_rank_ic(v):
    return rounded(stats.pooled_ic(v.ev.where("horizon = 20"), "score", "excess_return"))


@query("auroc_of_scores", sql("SELECT horizon, round((sum(rk) FILTER (y = 1) - p * (p + 1) / 2.0) / (p * q), 6) AS auroc FROM (SELECT horizon, y, rank() OVER (PARTITION BY horizon ORDER BY score) + (count(*) OVER (PARTITION BY horizon, score) - 1) / 2.0 AS rk, sum(y) OVER (PARTITION BY horizon) AS p, sum(1 - y) OVER (PARTITION BY horizon) AS q FROM (SELECT horizon, score, (excess_return > 0)::INT AS y FROM ev)) GROUP BY horizon, p, q", "ev"))
def auroc_of_scores(v):
    d = v.ev.withColumn("y", (F.col("excess_return") > 0).cast("int"))
    return rounded(order.auroc(d, "y", "score", ["horizon"]).select("horizon", "auroc"))


@query("average_precision", sql("SELECT horizon, round(sum(p * tp / (allp * total)), 6) AS auprc FROM (SELECT horizon, p, sum(p) OVER w AS tp, sum(n) OVER w AS allp, sum(p) OVER (PARTITION BY horizon) AS total FROM (SELECT horizon, score, sum((excess_return > 0)::INT) AS p, count(*) AS n FROM ev GROUP BY 1, 2) WINDOW w AS (PARTITION BY horizon ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) GROUP BY 1", "ev"))
def average_precision(v):
    d = v.ev.withColumn("y", (F.col("excess_return") > 0).cast("int"))
    return rounded(order.average_precision(d, "y", "score", ["horizon"]))


@query("shape_statistics", sql("SELECT horizon, count(*) AS n, round(avg(ehat_raw), 6) AS mean, round(skewness(ehat_raw), 6) AS skew, round(quantile_cont(ehat_raw, 0.1), 6) AS p10, round(quantile_cont(ehat_raw, 0.5), 6) AS p50, round(quantile_cont(ehat_raw, 0.9), 6) AS p90, round(avg((ehat_raw = 0)::INT), 6) AS zero_share, round(avg((ehat_raw > 0)::INT), 6) AS positive_share FROM ls GROUP BY 1", "ls"))
def shape_statistics(v):
    return rounded(stats.shape(v.ls, "ehat_raw", ["horizon"]))


@query("ols_residuals", sql("SELECT ticker, month, round(y - (avg(y) OVER m) - (covar_pop(y, x) OVER m) / (var_pop(x) OVER m) * (x - avg(x) OVER m), 6) AS residual FROM (SELECT ticker, month, mom_12m AS y, vol_6m AS x, count(*) OVER (PARTITION BY month) AS n FROM mpanel WHERE mom_12m IS NOT NULL AND vol_6m IS NOT NULL) WHERE n >= 5 WINDOW m AS (PARTITION BY month)", "mpanel"))
def ols_residuals(v):
    d = labels.least_names(v.mpanel.where("mom_12m IS NOT NULL AND vol_6m IS NOT NULL"), ["month"], 5)
    return rounded(stats.ols_residuals(d, "mom_12m", ["vol_6m"], ["month"]).select("ticker", "month", "residual"))


# Uncertainty -----------------------------------------------------------------------------------


@query("epistemic_part", sql(f"SELECT as_of_date, horizon, ticker, ehat_raw, round({pr('ehat_raw', K)}, 6) AS ehat_pctile FROM ls", "ls"))
def epistemic_part(v):
    a = v.ls.select("as_of_date", "horizon", "ticker", "a_value")
    d = uncertainty.epistemic(v.ls.drop("a_value", "ehat_raw"), a).withColumn("ehat_raw", F.round("ehat_raw", 8))
    d = d.withColumn("ehat_pctile", R.pct_rank("ehat_raw", *KEYS))
    return d.select("as_of_date", "horizon", "ticker", "ehat_raw", F.round("ehat_pctile", 6).alias("ehat_pctile"))


@query("loss_correlation", sql(f"SELECT horizon, round({corr('x', 'y')}, 6) AS rho, count(*) AS n FROM (SELECT *, {ar('ehat_raw', 'horizon')} AS x, {ar('rank_loss', 'horizon')} AS y FROM ls) GROUP BY 1", "ls"))
def loss_correlation(v):
    return rounded(order.spearman(v.ls, "ehat_raw", "rank_loss", ["horizon"]))


IDX = "SELECT horizon, as_of_date, row_number() OVER (PARTITION BY horizon ORDER BY as_of_date) AS i FROM (SELECT DISTINCT horizon, as_of_date FROM ls)"


@query("rolling_conformal", sql("SELECT d.horizon, d.as_of_date, v[CAST(least(ceil((len(v) + 1) * (1 - 0.1::DOUBLE)), len(v)) AS INT)] AS threshold, CAST(len(v) AS BIGINT) AS n_values, n_dates FROM (SELECT a.horizon, a.i, list(l.rank_loss ORDER BY l.rank_loss) AS v, count(DISTINCT b.i) AS n_dates FROM idx a JOIN idx b ON a.horizon = b.horizon AND b.i BETWEEN a.i - 12 AND a.i - 1 JOIN ls l ON l.horizon = b.horizon AND l.as_of_date = b.as_of_date GROUP BY 1, 2 HAVING count(DISTINCT b.i) >= 6) g JOIN idx d ON d.horizon = g.horizon AND d.i = g.i", "ls", idx=IDX))
def rolling_conformal(v):
    return uncertainty.rolling_quantile(v.ls, "rank_loss", 0.1, 12, 6).select("horizon", "as_of_date", "threshold", "n_values", "n_dates")


@query("prospective_floor", sql("SELECT d.horizon, d.as_of_date, CASE WHEN n_dates >= 6 THEN round(a, 6) END AS a_value, n_dates FROM (SELECT a.horizon, a.i, quantile_cont(l.rank_loss, 0.1) AS a, count(DISTINCT b.i) AS n_dates FROM idx a JOIN idx b ON a.horizon = b.horizon AND b.i BETWEEN a.i - 12 AND a.i - 1 JOIN ls l ON l.horizon = b.horizon AND l.as_of_date = b.as_of_date GROUP BY 1, 2) g JOIN idx d ON d.horizon = g.horizon AND d.i = g.i", "ls", idx=IDX))
def prospective_floor(v):
    return rounded(uncertainty.prospective_floor(v.ls, dates=12, least=6))


@query("conditional_coverage", sql("SELECT horizon, bucket, count(*) AS n, round(avg((rank_loss <= 0.6)::INT), 6) AS coverage FROM (SELECT *, CASE WHEN len(e) > 1 THEN CAST(len(list_filter(e[2:len(e)-1], lambda x: x < ehat_raw)) AS INTEGER) END AS bucket FROM (SELECT *, list_sort(list_distinct(quantile_cont(ehat_raw, [0::DOUBLE, 1/3::DOUBLE, 2/3::DOUBLE, 1::DOUBLE]) OVER (PARTITION BY horizon))) AS e FROM ls)) WHERE bucket IS NOT NULL GROUP BY 1, 2", "ls"))
def conditional_coverage(v):
    d = v.ls.withColumns({"covered": F.col("rank_loss") <= 0.6, "width": F.lit(0.6)})
    c = uncertainty.conditional_coverage(d, ["horizon"])
    return rounded(c.select("horizon", "bucket", "n", "coverage"))


# Health, policy ---------------------------------------------------------------------------------


@query("health_realized", sql(f"SELECT horizon, as_of_date, round(lag(coalesce(rank_ic, 0), 2) OVER (PARTITION BY horizon ORDER BY as_of_date), 6) AS matured_ic FROM ({IC})", "ev"))
def health_realized(v):
    d = health.realized(health.daily_ic(v.ev), 2, least=2)
    return rounded(d.select("horizon", "as_of_date", "matured_ic"))


@query("early_warning", sql(f"SELECT horizon, round({corr('x', 'y')}, 6) AS rho FROM (SELECT horizon, rank() OVER (PARTITION BY horizon ORDER BY m) + (count(*) OVER (PARTITION BY horizon, m) - 1) / 2.0 AS x, rank() OVER (PARTITION BY horizon ORDER BY ic) + (count(*) OVER (PARTITION BY horizon, ic) - 1) / 2.0 AS y FROM (SELECT as_of_date, horizon, quantile_cont(g_pred, 0.5) AS m FROM ls GROUP BY 1, 2) JOIN (SELECT as_of_date, horizon, round(coalesce(rank_ic, 0), 9) AS ic FROM ({IC})) USING (as_of_date, horizon)) GROUP BY 1", "ls"))
def early_warning(v):
    d = health.early_warning(v.ls, health.daily_ic(v.ev).withColumn("daily_ic", F.round("daily_ic", 9)))
    return rounded(d.where("measure = 'g_median'").select("horizon", "rho"))


@query("policy_conflict", sql("SELECT CAST(bucket AS INTEGER) AS bucket, round(avg(abs(score)), 6) AS mean_abs_score, round(avg(rank_loss), 6) AS mean_loss, count(*) AS n FROM (SELECT *, CASE WHEN n = 1 THEN 0 ELSE greatest(ceil((k - 1) * 5.0::DOUBLE / (n - 1)) - 1, 0) END AS bucket FROM (SELECT *, row_number() OVER (PARTITION BY as_of_date ORDER BY ehat_raw, ticker) AS k, count(*) OVER (PARTITION BY as_of_date) AS n FROM ls WHERE horizon = 20) WHERE n > 1) GROUP BY 1", "ls"))
def policy_conflict(v):
    d = labels.least_names(v.ls.where("horizon = 20"), ["as_of_date"], 2)
    return rounded(policy.conflict_deciles(d, 5).select("bucket", "mean_abs_score", "mean_loss", "n"))


@query("policy_variants", sql("SELECT variant, as_of_date, flat, round(turnover, 6) AS turnover, round(0.002 * turnover, 6) AS cost, round(ls_return, 6) AS ls_return, round(ls_return - 0.002 * turnover, 6) AS ls_return_net FROM ps", "ls", pin=fixed_gate("CASE WHEN month(as_of_date) % 3 = 0 THEN 0.1 ELSE 0.9 END"), pv=PVAR, pr=PROW, pb=PBOOK, pd=PDAY, ps=PSER))
def policy_variants(v):
    h = v.ev.select("as_of_date").distinct().withColumns({"G_exposure": F.when(F.month("as_of_date") % 3 == 0, 0.1).otherwise(0.9), "H_realized": F.lit(0.1)})
    d = policy.policy_inputs(v.ls, v.ls, h, 20)
    return rounded(policy.policy_series(policy.variant_scores(d), 10))


@query("policy_grid", sql("SELECT lam, cap_percentile, cap_weight, round(sharpe, 6) AS sharpe, n, row_number() OVER (ORDER BY sharpe DESC NULLS LAST, lam, cap_percentile) = 1 AS best FROM (SELECT lam, cap AS cap_percentile, 0.7::DOUBLE AS cap_weight, avg(x) / stddev_samp(x) * sqrt(12) AS sharpe, count(*) AS n FROM (SELECT variant, ls_return - 0.002 * turnover AS x FROM ps) JOIN grid USING (variant) GROUP BY 1, 2)", "ls", pin=fixed_gate("1.0"), grid=GRID, pr=GROW.replace("2000-01-01", "1998-01-01"), pb=PBOOK, pd=PDAY, ps=PSER))
def policy_grid(v):
    h = v.ev.select("as_of_date").distinct().withColumns({"G_exposure": F.lit(1.0), "H_realized": F.lit(0.1)})
    grid = v.spark.createDataFrame([(l_, p, w) for l_ in (0.0, 0.5) for p in (0.8, 0.9) for w in (0.7,)], "lam double, cap_percentile double, cap_weight double")
    return rounded(policy.calibrate(policy.policy_inputs(v.ls, v.ls, h, 20), grid, 10, "1998-01-01"))


@query("gated_raw_series", sql("SELECT as_of_date, round(CASE WHEN n >= 20 AND g THEN l - s ELSE 0 END, 6) AS ls_return, NOT (n >= 20 AND g) AS flat FROM (SELECT as_of_date, month(as_of_date) % 3 <> 0 AS g, max(n) AS n, avg(excess_return) FILTER (a <= 10) AS l, avg(excess_return) FILTER (b <= 10) AS s FROM (SELECT *, row_number() OVER (PARTITION BY as_of_date ORDER BY score DESC, ticker) AS a, row_number() OVER (PARTITION BY as_of_date ORDER BY score, ticker) AS b, count(*) OVER (PARTITION BY as_of_date) AS n FROM ls WHERE horizon = 20) GROUP BY 1)", "ls"))
def gated_raw_series(v):
    return policy_variants(v).where("variant = 'gate_raw'").select("as_of_date", "ls_return", "flat")


@query("stacking_weights", sql("SELECT horizon, CAST(n AS DOUBLE) AS n, round(my - w1 * m1 - w2 * m2, 6) AS w0, round(w1, 6) AS w1, round(w2, 6) AS w2 FROM (SELECT *, ((d + 1) * p - b * q) / ((a + 1) * (d + 1) - b * b) AS w1, ((a + 1) * q - b * p) / ((a + 1) * (d + 1) - b * b) AS w2 FROM (SELECT horizon, count(*) AS n, avg(score) AS m1, avg(mom_1m) AS m2, avg(excess_return) AS my, count(*) * var_pop(score) AS a, count(*) * covar_pop(score, mom_1m) AS b, count(*) * var_pop(mom_1m) AS d, count(*) * covar_pop(score, excess_return) AS p, count(*) * covar_pop(mom_1m, excess_return) AS q FROM ev GROUP BY 1))", "ev"))
def stacking_weights(v):
    return rounded(learn.stacking_weights(v.ev, "score", "mom_1m", "excess_return", by=["horizon"]))


@query("gbt_scores", None)
def gbt_scores(v):
    features = ["score", "adv", "mom_1m"]
    rows = v.ev.where("horizon = 20")
    train = rows.where("as_of_date < DATE '1997-01-01'")
    model = learn.fit_gbt(train, features, "excess_return", maxIter=5, maxDepth=2)
    return learn.score_gbt(model, rows.where("as_of_date >= DATE '1997-04-01'").withColumnRenamed("score", "base").withColumn("score", F.col("base")), features, "pred").select("as_of_date", "ticker", F.round("pred", 6).alias("pred"))


@query("monthly_means", sql("SELECT horizon, CAST(date_trunc('month', as_of_date) AS DATE) AS month, round(avg(rank_loss), 6) AS rank_loss, count(*) AS n FROM ls GROUP BY 1, 2", "ls"))
def monthly_means(v):
    return rounded(portfolio.monthly_means(v.ls, ["rank_loss"], ["horizon"], "as_of_date"))


@query("lexicon_sentiment", "SELECT doc_id, round(coalesce(CAST(p - n AS DOUBLE) / nullif(p + n, 0), 0), 6) AS score FROM (SELECT doc_id, len(regexp_extract_all(lower(text), '\\b(?:gain|growth|beat|strong|record|profit|improve|upgrade)[A-Za-z0-9_]*')) AS p, len(regexp_extract_all(lower(text), '\\b(?:loss|decline|miss|weak|risk|lawsuit|impair|downgrade)[A-Za-z0-9_]*')) AS n FROM documents WHERE length(trim(text)) > 0)")
def lexicon_sentiment(v):
    return rounded(learn.score_texts(v.table("documents")).where("score IS NOT NULL").select("doc_id", "score"))


def changed_tickers(v):
    dim = v.table("supplier").select(F.col("s_suppkey").cast("string").alias("stable_id"), F.col("s_name").alias("ticker"), F.lit("1990-01-01").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_active"))
    changes = dim.where("stable_id % 3 = 0").select("stable_id", F.concat(F.lit("NEW-"), "ticker").alias("new_ticker"), F.lit("1996-07-01").cast("date").alias("change_date"))
    return pit.apply_ticker_changes(dim, changes)


@query("ticker_changes", "SELECT as_of, CAST(s_suppkey AS VARCHAR) AS stable_id, CASE WHEN s_suppkey % 3 = 0 AND as_of >= DATE '1996-07-01' THEN 'NEW-' || s_name ELSE s_name END AS ticker FROM supplier, (VALUES (DATE '1996-06-30'), (DATE '1996-07-01')) t(as_of)")
def ticker_changes(v):
    return pit.identifier_at(changed_tickers(v), v.dates("1996-06-30", "1996-07-01"), "stable_id", "ticker")


@query("recency_block", sql("SELECT ticker, month AS date, last_filing, CAST(month - last_filing AS INTEGER) AS days_since_filing, coalesce(month - last_filing <= 63, FALSE) AS in_window, CAST(greatest(last_filing + CAST(round(spacing) AS INTEGER) - month, 0) AS INTEGER) AS days_to_next FROM (SELECT m.ticker, m.month, f.filing_date AS last_filing, f.spacing FROM mbars m ASOF LEFT JOIN fs f ON m.ticker = f.ticker AND m.month >= f.filing_date)", "mbars", "st0", fd="SELECT DISTINCT ticker, filing_date FROM st0", fg="SELECT *, CASE WHEN filing_date - lag(filing_date) OVER w BETWEEN 60 AND 120 THEN filing_date - lag(filing_date) OVER w END AS gap FROM fd WINDOW w AS (PARTITION BY ticker ORDER BY filing_date)", fs="SELECT ticker, filing_date, coalesce(CAST(list_sum(g[greatest(len(g) - 3, 1):]) AS DOUBLE) / nullif(least(len(g), 4), 0), 91.0) AS spacing FROM (SELECT ticker, filing_date, list(gap) FILTER (gap IS NOT NULL) OVER (PARTITION BY ticker ORDER BY filing_date ROWS UNBOUNDED PRECEDING) AS g FROM fg)"))
def recency_block(v):
    f = v.statements.where("field = 'revenue' AND observed_at = filing_date").select("ticker", "filing_date")
    return events.recency(v.mbars.select("ticker", F.col("month").alias("date")), f).select("ticker", "date", "last_filing", "days_since_filing", "in_window", "days_to_next")


# More of the inventory ---------------------------------------------------------------------------


@query("eligible_and_least_names", sql("SELECT as_of_date, count(*) AS n FROM ev WHERE as_of_date IN (SELECT as_of_date FROM ev GROUP BY 1 HAVING count(DISTINCT horizon) = 2) AND (as_of_date, horizon) IN (SELECT as_of_date, horizon FROM ev GROUP BY 1, 2 HAVING count(*) >= 50) GROUP BY 1", "ev"))
def eligible_and_least_names(v):
    d = labels.least_names(labels.eligible_dates(v.ev, 2), KEYS, 50)
    return d.groupBy("as_of_date").agg(F.count(F.lit(1)).alias("n"))


@query("future_sessions", sql("SELECT session, CAST(len(a) AS INTEGER) AS n, a[len(a)] AS last_session FROM (SELECT session, list(session) OVER (ORDER BY session_idx ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS a FROM cal) WHERE len(a) > 0", "bench", cal=CAL))
def future_sessions(v):
    d = labels.future_sessions(labels.sessions(v.bench), 20).where(F.size("next_sessions") > 0)
    return d.select("session", F.size("next_sessions").alias("n"), F.element_at("next_sessions", -1).alias("last_session"))


@query("snap_to_session", sql("SELECT d, (SELECT max(session) FROM cal WHERE session <= d) AS on_or_before, (SELECT min(session) FROM cal WHERE session >= d) AS on_or_after FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)", "bench", cal=CAL))
def snap_to_session(v):
    c = labels.sessions(v.bench)
    d = v.table("orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return labels.snap(labels.snap(d, c, "d", "on_or_before"), c, "d", "on_or_after", True).select("d", "on_or_before", "on_or_after")


@query("baseline_scores", sql("SELECT as_of_date, horizon, ticker, 'momentum_composite' AS baseline, round((mom_1m + score) / 2, 6) AS score FROM ev WHERE mom_1m IS NOT NULL UNION ALL SELECT as_of_date, horizon, ticker, 'mom_12m', round(score, 6) FROM ev UNION ALL SELECT as_of_date, horizon, ticker, 'short_term_strength', round(mom_1m, 6) FROM ev WHERE mom_1m IS NOT NULL", "ev"))
def baseline_scores(v):
    d = v.ev.withColumns({"mom_12m": F.col("score"), "mom_3m": F.lit(None).cast("double"), "mom_6m": F.lit(None).cast("double")})
    return rounded(evaluate.baselines(d).where("baseline <> 'naive_random'").select("as_of_date", "horizon", "ticker", "baseline", "score"))


@query("cost_survival", sql(f"SELECT horizon, round(avg((m > 0)::INT), 6) AS positive_folds, count(*) AS n_folds FROM (SELECT horizon, fold_id, quantile_cont(t, 0.5) AS m FROM (SELECT fold_id, horizon, as_of_date, avg(excess_return) FILTER (k <= 10) AS t FROM ({TOP}) WHERE n >= 10 GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1", "ev"))
def cost_survival(v):
    return rounded(evaluate.cost_survival(evaluate.per_date(v.ev), ["horizon"]))


@query("signal_gates", sql(f"SELECT horizon, avg(rank_ic) >= 0.02 AS gate1, avg((rank_ic > 0)::INT) >= 0.55 AS gate2, avg(rank_ic) / stddev_samp(rank_ic) >= 0.1 AS gate3 FROM ({IC}) WHERE rank_ic IS NOT NULL GROUP BY 1", "ev"))
def signal_gates(v):
    return evaluate.signal_gates(evaluate.rank_ic(v.ev), ["horizon"]).select("horizon", "gate1", "gate2", "gate3")


@query("churn_diagnostics", sql("SELECT horizon, count(*) AS n, round(quantile_cont(churn, 0.5), 6) AS median_churn, round(quantile_cont(churn, 0.9), 6) AS p90_churn, round(avg((churn > 0.5)::INT), 6) AS high_share FROM (SELECT b.horizon, b.as_of_date, 1 - count(p.ticker) / 10.0::DOUBLE AS churn FROM book b JOIN bp USING (horizon, as_of_date) LEFT JOIN book p ON p.horizon = b.horizon AND p.as_of_date = bp.prev AND p.ticker = b.ticker WHERE bp.prev IS NOT NULL GROUP BY 1, 2) GROUP BY 1", "ev", book=BOOK, bd=BOOKD, bp=BOOKP))
def churn_diagnostics(v):
    return rounded(evaluate.churn_diagnostics(evaluate.churn(v.ev, 10), ["horizon"]))


@query("ic_stability_of_features", sql(f"SELECT feature, count(*) AS n_dates, round(avg(ic), 6) AS mean_ic, round(stddev_pop(ic), 6) AS std_ic FROM (SELECT feature, as_of_date, {corr('x', 'y')} AS ic, count(*) AS n FROM (SELECT feature, as_of_date, {ar('value', 'feature, as_of_date')} AS x, {ar('excess_return', 'feature, as_of_date')} AS y FROM (SELECT as_of_date, excess_return, 'adv' AS feature, adv AS value FROM ev WHERE horizon = 20 UNION ALL SELECT as_of_date, excess_return, 'mom_1m', mom_1m FROM ev WHERE horizon = 20) WHERE value IS NOT NULL) GROUP BY 1, 2) WHERE n >= 10 AND ic IS NOT NULL GROUP BY 1 HAVING count(*) >= 12", "ev"))
def ic_stability_of_features(v):
    d = evaluate.feature_ic(v.ev.where("horizon = 20"), ["adv", "mom_1m"], "excess_return", ["as_of_date"])
    return rounded(evaluate.ic_stability(d, ["feature"]).select("feature", "n_dates", "mean_ic", "std_ic"))


@query("neutralized_ic", sql(f"SELECT month, round({corr('x', 'y')}, 6) AS ic_sector FROM (SELECT month, {ar('e', 'month')} AS x, {ar('mom_1m', 'month')} AS y FROM (SELECT *, round(mom_12m - avg(mom_12m) OVER (PARTITION BY month, sector), 9) AS e, count(*) OVER (PARTITION BY month) AS n FROM mpanel WHERE mom_12m IS NOT NULL AND sector IS NOT NULL) WHERE n >= 5) GROUP BY 1", "mpanel"))
def neutralized_ic(v):
    from ..operators import cross

    d = labels.least_names(v.mpanel.where("mom_12m IS NOT NULL AND sector IS NOT NULL"), ["month"], 5)
    d = cross.neutralize(d, "mom_12m", ["month"], sector="sector").withColumn("neutral", F.round("neutral", 9))
    return rounded(R.spearman(d, "neutral", "mom_1m", ["month"], "ic_sector").select("month", "ic_sector"))


@query("confusion_by_horizon", sql("SELECT horizon, CAST(count(*) FILTER (y AND p) AS BIGINT) AS tp, CAST(count(*) FILTER (NOT y AND p) AS BIGINT) AS fp, round(count(*) FILTER (y AND p) / CAST(count(*) FILTER (p) AS DOUBLE), 6) AS precision, round(count(*) FILTER (y AND p) / CAST(count(*) FILTER (y) AS DOUBLE), 6) AS recall FROM (SELECT horizon, excess_return > 0 AS y, score > 0 AS p FROM ev) GROUP BY 1", "ev"))
def confusion_by_horizon(v):
    d = v.ev.withColumns({"y": (F.col("excess_return") > 0).cast("int"), "p": (F.col("score") > 0).cast("int")})
    return rounded(R.confusion(d, "y", "p", ["horizon"]).select("horizon", "tp", "fp", "precision", "recall"))


@query("ks_of_periods", sql("SELECT horizon, round(max(abs(ca / na - cb / nb)), 6) AS ks FROM (SELECT horizon, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY horizon) AS na, sum(b) OVER (PARTITION BY horizon) AS nb FROM (SELECT horizon, score, CAST(sum((as_of_date >= DATE '1998-01-01')::INT) AS DOUBLE) AS a, CAST(sum((as_of_date < DATE '1998-01-01')::INT) AS DOUBLE) AS b FROM ev GROUP BY 1, 2) WINDOW w AS (PARTITION BY horizon ORDER BY score ROWS UNBOUNDED PRECEDING)) GROUP BY 1", "ev"))
def ks_of_periods(v):
    d = v.ev.withColumn("late", F.col("as_of_date") >= F.lit("1998-01-01").cast("date"))
    return rounded(R.ks_statistic(d, "score", "late", ["horizon"]).select("horizon", "ks"))


@query("selective_ic", sql(f"SELECT horizon, count(*) AS n FROM (SELECT DISTINCT horizon, as_of_date FROM ls) GROUP BY 1", "ls"))
def selective_ic(v):
    d = uncertainty.selective_ic(v.ls, ["horizon"])
    n = v.ls.select("horizon", "as_of_date").distinct().groupBy("horizon").agg(F.count(F.lit(1)).alias("n"))
    return n.join(d.select("horizon").distinct(), "horizon")


SELB = "SELECT *, CASE WHEN len(e) > 1 THEN CAST(len(list_filter(e[2:len(e)-1], lambda x: x < ehat_raw)) AS INTEGER) END AS bucket FROM (SELECT *, list_sort(list_distinct(quantile_cont(ehat_raw, [0::DOUBLE, 1/3::DOUBLE, 2/3::DOUBLE, 1::DOUBLE]) OVER (PARTITION BY as_of_date, horizon))) AS e FROM ls)"


@query("selective_ic_buckets", sql(f"SELECT bucket, horizon, count(rank_ic) AS n_dates, round(avg(rank_ic), 6) AS mean_ic FROM (SELECT bucket, as_of_date, horizon, {corr('x', 'y')} AS rank_ic FROM (SELECT *, {ar('score', f'bucket, {K}')} AS x, {ar('excess_return', f'bucket, {K}')} AS y FROM selb WHERE bucket IS NOT NULL) GROUP BY 1, 2, 3) GROUP BY 1, 2", "ls", selb=SELB))
def selective_ic_buckets(v):
    return rounded(uncertainty.selective_ic(v.ls, ["horizon"]).select("bucket", "horizon", "n_dates", "mean_ic"))


@query("failure_auroc", sql("SELECT horizon, round((sum(rk) FILTER (y = 1) - p * (p + 1) / 2.0) / (p * q), 6) AS auroc FROM (SELECT horizon, y, rank() OVER (PARTITION BY horizon ORDER BY ehat_raw) + (count(*) OVER (PARTITION BY horizon, ehat_raw) - 1) / 2.0 AS rk, sum(y) OVER (PARTITION BY horizon) AS p, sum(1 - y) OVER (PARTITION BY horizon) AS q FROM (SELECT horizon, ehat_raw, (rank_loss > quantile_cont(rank_loss, 0.8) OVER (PARTITION BY horizon))::INT AS y FROM ls)) GROUP BY horizon, p, q", "ls"))
def failure_auroc(v):
    return rounded(uncertainty.failure_detection(v.ls, ["horizon"]).select("horizon", "auroc"))


@query("archive_summary", sql("SELECT horizon, count(*) AS n, count(DISTINCT fold_id) AS n_folds, count(DISTINCT as_of_date) AS n_dates, count(DISTINCT ticker) AS n_tickers, round(avg(rank_loss), 6) AS mean_loss, round(quantile_cont(rank_loss, 0.5), 6) AS median_loss FROM ls GROUP BY 1", "ls"))
def archive_summary(v):
    from ..operators import audits

    return rounded(audits.archive_summary(v.ls.withColumn("loss", F.col("rank_loss")), ["horizon"]))


@query("identifier_intervals", "SELECT as_of, CAST(s_suppkey AS VARCHAR) AS stable_id, CASE WHEN s_suppkey % 3 = 0 AND as_of >= DATE '1996-07-01' THEN 'NEW-' || s_name ELSE s_name END AS ticker FROM supplier, (SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '1996-12-01', INTERVAL 1 MONTH)) AS DATE) AS as_of)")
def identifier_intervals(v):
    """Each security's identifier at twelve month starts, around the day on which a third of them change."""
    return pit.identifier_at(changed_tickers(v), v.dates(*[f"1996-{m:02d}-01" for m in range(1, 13)]), "stable_id", "ticker").select("as_of", "stable_id", "ticker")


@query("failure_auroc_by_date", sql("SELECT horizon, round((sum(rk) FILTER (y = 1) - p * (p + 1) / 2.0) / (p * q), 6) AS auroc FROM (SELECT horizon, y, rank() OVER (PARTITION BY horizon ORDER BY x) + (count(*) OVER (PARTITION BY horizon, x) - 1) / 2.0 AS rk, sum(y) OVER (PARTITION BY horizon) AS p, sum(1 - y) OVER (PARTITION BY horizon) AS q FROM (SELECT horizon, x, (round(rank_ic - avg(rank_ic) OVER (PARTITION BY horizon), 9) < 0)::INT AS y FROM (SELECT as_of_date, horizon, round(avg(ehat_raw), 9) AS x FROM ls GROUP BY 1, 2) JOIN ic USING (as_of_date, horizon) WHERE rank_ic IS NOT NULL)) GROUP BY horizon, p, q", "ls", "ic"))
def failure_auroc_by_date(v):
    """How well a date's mean uncertainty tells that its IC will be below its horizon's mean."""
    risk = v.ls.groupBy(*KEYS).agg(F.round(F.avg("ehat_raw"), 9).alias("risk"))
    daily = evaluate.rank_ic(v.ev).where("rank_ic IS NOT NULL").join(risk, KEYS)
    daily = daily.withColumn("rank_ic", F.round(F.col("rank_ic") - F.avg("rank_ic").over(Window.partitionBy("horizon")), 9))  # a row a date
    return rounded(evaluate.failure_auroc(daily, "risk", ["horizon"]).select("horizon", "auroc"))


@query("survivors_missing", sql("SELECT ticker, max(month) AS last_seen FROM mbars WHERE ticker NOT IN (SELECT ticker FROM mbars WHERE month = (SELECT max(month) FROM mbars)) GROUP BY 1", "mbars"))
def survivors_missing(v):
    top = v.mbars.agg(F.max("month").alias("month"))
    return pit.survivors_missing(v.mbars, v.mbars.join(top, "month"), "ticker", "month")


@query("weight_turnover", sql("SELECT as_of_date, round(sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) / 2, 6) AS turnover FROM (SELECT coalesce(a.as_of_date, b.nxt) AS as_of_date, a.w AS aw, b.w AS bw FROM (SELECT as_of_date, ticker, 0.1::DOUBLE AS w FROM book WHERE horizon = 20) a FULL JOIN (SELECT nxt, ticker, 0.1::DOUBLE AS w FROM book JOIN bn USING (horizon, as_of_date) WHERE horizon = 20 AND nxt IS NOT NULL) b ON a.as_of_date = b.nxt AND a.ticker = b.ticker) x, LATERAL (SELECT aw AS w) a, LATERAL (SELECT bw AS w) b WHERE as_of_date > (SELECT min(as_of_date) FROM bd WHERE horizon = 20) GROUP BY 1", "ev", book=BOOK, bd=BOOKD, bn="SELECT *, lead(as_of_date) OVER (PARTITION BY horizon ORDER BY as_of_date) AS nxt FROM bd"))
def weight_turnover(v):
    from ..operators import cross

    d = v.ev.where("horizon = 20").withColumns({"_r": cross.deterministic_rank("score", "ticker", "as_of_date"), "_n": F.count("score").over(Window.partitionBy("as_of_date"))})
    d = d.where("_r <= 10 AND _n >= 10").withColumn("w", F.lit(0.1))
    return rounded(portfolio.weight_turnover(d, [], "as_of_date", "ticker", "w"))


@query("surprise_features", sql("SELECT event_id, round(avg(value) OVER (PARTITION BY ticker ORDER BY observed_at, event_id ROWS 3 PRECEDING), 6) AS surprise_mean4, round(stddev_samp(value) OVER (PARTITION BY ticker ORDER BY observed_at, event_id ROWS 7 PRECEDING), 6) AS surprise_std8 FROM pe", "pe"))
def surprise_features(v):
    d = v.events.withColumn("at", F.struct("observed_at", "event_id"))
    return rounded(events.surprise_features(d, date="at", value="value").select("event_id", "surprise_mean4", "surprise_std8"))


@query("variance_inflation", None)
def variance_inflation(v):
    return rounded(stats.vif(v.mpanel, ["mom_1m", "mom_3m", "mom_6m", "vol_6m"]))
