"""Queries: summaries of events, more series and cross-sections, statistics, gates, books."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ranks as R
from ..functions import scalars as S
from ..operators import audits, cross, evaluate, events, labels, portfolio, series, stats
from .registry import Views, ar, corr, pr, query, rounded
from .sqlviews import sql

K = "as_of_date, horizon"
KEYS = ["as_of_date", "horizon"]
EDGES = "list_sort(list_distinct(quantile_cont({x}, [{q}]) OVER (PARTITION BY {k})))"


def bucketed(source: str, x: str, keys: str, buckets: int) -> str:
    """Rows with the quantile bucket of x by keys, in SQL."""
    q = ", ".join(f"{i}::DOUBLE / {buckets}" for i in range(buckets + 1))
    return f"SELECT *, CASE WHEN len(e) > 1 THEN CAST(len(list_filter(e[2:len(e)-1], lambda z: z < {x})) AS INTEGER) END AS bucket FROM (SELECT *, {EDGES.format(x=x, q=q, k=keys)} AS e FROM {source})"


def rank_corr(source: str, x: str, y: str, keys: str, name: str = "rho") -> str:
    """Rank correlation by keys over rows where both are known, in SQL."""
    return f"SELECT {keys}, {corr('_x', '_y')} AS {name}, count(*) AS n FROM (SELECT *, {ar(x, keys)} AS _x, {ar(y, keys)} AS _y FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY {keys}"


# Summaries ---------------------------------------------------------------------------------------


@query("first_and_last_shipments", "SELECT s AS ticker, d AS date, arg_min(k, k) AS first_order, arg_max(k, k) AS last_order FROM (SELECT l_suppkey AS s, CAST(l_shipdate AS DATE) AS d, l_orderkey * 10 + l_linenumber AS k FROM lineitem) GROUP BY 1, 2")
def first_and_last_shipments(v: Views):
    d = v.table("lineitem").select(F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("date"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    keys = ["ticker", "date"]
    first = labels.dedupe(d, keys, ["k"], "first").withColumnRenamed("k", "first_order")
    return first.join(labels.dedupe(d, keys, ["k"], "last").withColumnRenamed("k", "last_order"), keys)


@query("repeated_keys", "SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(v):
    return labels.duplicate_keys(v.table("lineitem"), ["l_orderkey", "l_suppkey"])


@query("event_summary", sql("SELECT ticker, event_type, n_events, days_since, round(mean_value, 6) AS mean_value, latest_value, v[n_events // 2 + 1] AS middle_value FROM (SELECT ticker, event_type, count(*) AS n_events, CAST(DATE '2024-02-01' - max(event_date) AS INTEGER) AS days_since, avg(value) AS mean_value, arg_max(value, (event_date, observed_at, event_id)) AS latest_value, list(value ORDER BY value) AS v FROM pe WHERE event_date <= DATE '2024-02-01' GROUP BY 1, 2)", "pe"))
def event_summary(v):
    seen = v.events.withColumn("as_of", F.lit("2024-02-01").cast("date")).where("event_date <= as_of")
    return rounded(events.event_summary(seen, ["ticker", "event_type", "as_of"], "as_of").drop("as_of"))


@query("event_date_lists", sql("SELECT ticker, CAST(count(DISTINCT event_date) AS INTEGER) AS n, min(event_date) AS first, max(event_date) AS last FROM pe WHERE event_type = (SELECT min(event_type) FROM pe) GROUP BY 1", "pe"))
def event_date_lists(v):
    kind = v.events.agg(F.min("event_type")).first()[0]
    return events.event_dates(v.events, kind).select("ticker", F.size("dates").alias("n"), F.col("dates")[0].alias("first"), F.element_at("dates", -1).alias("last"))


FEATURES = ["mom_1m", "mom_3m", "mom_6m", "mom_12m", "vol_6m"]


@query("feature_coverage", sql(" UNION ALL ".join(f"SELECT '{f}' AS feature, '{'risk' if f == 'vol_6m' else 'other'}' AS category, round(avg(({f} IS NOT NULL)::INT), 6) AS coverage, avg(({f} IS NOT NULL)::INT) >= 0.95 AS complete, avg(({f} IS NOT NULL)::INT) < 0.5 AS sparse FROM mpanel" for f in FEATURES), "mpanel"))
def feature_coverage(v):
    return rounded(audits.coverage_report(v.mpanel, FEATURES, {"vol_6m": "risk"}))


HAS = " + ".join(f"({f} IS NOT NULL)::INT" for f in FEATURES)


@query("row_coverage", sql(f"SELECT round(avg(c), 6) AS mean, round(min(c), 6) AS min, round(max(c), 6) AS max FROM (SELECT ({HAS}) / 5.0::DOUBLE AS c FROM mpanel)", "mpanel"))
def row_coverage(v):
    return rounded(audits.row_coverage(v.mpanel, FEATURES))


@query("score_coverage", sql("SELECT sector, round(avg((mom_12m IS NOT NULL)::INT), 6) AS has_mom_12m, round(avg((vol_6m IS NOT NULL)::INT), 6) AS has_vol_6m, round(avg((mom_12m IS NOT NULL AND vol_6m IS NOT NULL)::INT), 6) AS has_all FROM mpanel GROUP BY 1", "mpanel"))
def score_coverage(v):
    return rounded(audits.score_coverage(v.mpanel, ["mom_12m", "vol_6m"], ["sector"]))


BASE = "SELECT as_of_date, horizon, ticker, 'momentum_composite' AS baseline, (mom_1m + score) / 2 AS s, excess_return FROM ev WHERE mom_1m IS NOT NULL UNION ALL SELECT as_of_date, horizon, ticker, 'mom_12m', score, excess_return FROM ev UNION ALL SELECT as_of_date, horizon, ticker, 'short_term_strength', mom_1m, excess_return FROM ev WHERE mom_1m IS NOT NULL"


def baseline_rows(v):
    d = v.ev.withColumns({"mom_12m": F.col("score"), "mom_3m": F.lit(None).cast("double"), "mom_6m": F.lit(None).cast("double")})
    return evaluate.baselines(d).where("baseline <> 'naive_random'")


@query("baseline_floor", sql(f"SELECT horizon, arg_max(baseline, (m, baseline)) AS best, round(max(m), 6) AS floor FROM (SELECT baseline, horizon, quantile_cont(rank_ic, 0.5) AS m FROM ({rank_corr('bs', 's', 'excess_return', 'baseline, as_of_date, horizon', 'rank_ic')}) GROUP BY 1, 2) GROUP BY 1", "ev", bs=BASE))
def baseline_floor(v):
    return rounded(evaluate.baseline_floor(evaluate.rank_ic(baseline_rows(v), ["baseline", *KEYS])))


@query("baseline_monotone", sql(f"SELECT baseline, as_of_date, horizon, round(rho, 6) AS rho, rho > 0.999 AS monotone FROM ({rank_corr('(SELECT b.*, e.score FROM bs b JOIN ev e USING (as_of_date, horizon, ticker))', 's', 'score', 'baseline, as_of_date, horizon')})", "ev", bs=BASE))
def baseline_monotone(v):
    d = baseline_rows(v)
    return rounded(evaluate.is_monotone(d, "score", "mom_12m", ["baseline", *KEYS]).select("baseline", *KEYS, "rho", "monotone"))


@query("first_of_month", sql("SELECT date, round(ret, 6) AS ret FROM (SELECT *, row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY date) AS k FROM market) WHERE k = 1", "market"))
def first_of_month(v):
    return rounded(portfolio.first_of_month(v.market, [], "date").select("date", "ret"))


@query("weighted_median_date", sql("SELECT horizon, min(as_of_date) AS median_date FROM (SELECT horizon, as_of_date, sum(n) OVER (PARTITION BY horizon ORDER BY as_of_date) AS c, sum(n) OVER (PARTITION BY horizon) AS t FROM (SELECT horizon, as_of_date, count(*) AS n FROM ev GROUP BY 1, 2)) WHERE c >= t / 2.0 GROUP BY 1", "ev"))
def weighted_median_date(v):
    return portfolio.weighted_median_date(v.ev.withColumn("w", F.lit(1.0)), "w", "as_of_date", ["horizon"])


PERIODS = "(VALUES ('calm', DATE '1994-01-01', DATE '1995-12-31'), ('stress', DATE '1996-01-01', DATE '1996-12-31')) w(name, a, b)"


def named_windows(v):
    return v.spark.createDataFrame([("calm", "1994-01-01", "1995-12-31"), ("stress", "1996-01-01", "1996-12-31")], "name string, start string, end string").select("name", F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"))


@query("window_statistics", sql(f"SELECT name, horizon, count(*) AS n, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg((x < 0.2)::INT), 6) AS abstain_share, round(avg(rank_ic), 6) AS mean_ic FROM (SELECT *, round(abs(rank_ic), 9) AS x FROM ic) JOIN {PERIODS} ON as_of_date BETWEEN a AND b GROUP BY 1, 2", "ic"))
def window_statistics(v):
    d = evaluate.rank_ic(v.ev).withColumn("x", F.round(F.abs("rank_ic"), 9))
    return rounded(portfolio.window_statistics(d, named_windows(v), "x", "as_of_date", "rank_ic", by=["horizon"]))


# Series ------------------------------------------------------------------------------------------


@query("market_levels", sql("SELECT date, round(close - lag(close, 5) OVER w, 4) AS change_5, round(avg(ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 8) AS mean_ret, round(avg(ret) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 8) AS mean_before, CASE WHEN m50 > m200 THEN 1 ELSE -1 END AS side, round((m50 - m200) / m200, 6) AS gap FROM (SELECT *, avg(close) OVER (ORDER BY date ROWS 49 PRECEDING) AS m50, avg(close) OVER (ORDER BY date ROWS 199 PRECEDING) AS m200 FROM market) WINDOW w AS (ORDER BY date)", "market"))
def market_levels(v):
    w = Window.orderBy("date")  # a row a day
    d = v.market.withColumns({"m50": F.avg("close").over(w.rowsBetween(-49, 0)), "m200": F.avg("close").over(w.rowsBetween(-199, 0))})
    return d.select("date", F.round(series.level_change("close", 5, w), 4).alias("change_5"), F.round(series.expanding_mean("ret", w), 8).alias("mean_ret"), F.round(series.expanding_mean("ret", w, before=True), 8).alias("mean_before"), series.average_cross("m50", "m200").alias("side"), F.round(series.average_cross("m50", "m200", variant="online"), 6).alias("gap"))


@query("volume_by_volatility", sql("SELECT ticker, month, round(adv / nullif(vol_6m, 0), 4) AS x FROM mpanel", "mpanel"))
def volume_by_volatility(v):
    return v.mpanel.select("ticker", "month", F.round(series.vol_adjusted_volume("adv", "vol_6m"), 4).alias("x"))


@query("smoothed_returns", sql("SELECT a.ticker, a.month, round(sum(b.mom_1m * CASE WHEN b.i = 1 THEN 1 ELSE 1 - pow(2.0, -1 / 5.0) END * pow(2.0, (b.i - a.i) / 5.0)), 6) AS ema FROM x a JOIN x b ON a.ticker = b.ticker AND b.i <= a.i GROUP BY 1, 2", "mpanel", x="SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY month) AS i FROM mpanel WHERE mom_1m IS NOT NULL"))
def smoothed_returns(v):
    return rounded(series.ema(v.mpanel, "mom_1m", ["ticker"], "month", 5.0).select("ticker", "month", "ema"))


@query("drawdown_episodes", sql("SELECT ticker, CAST(episode AS BIGINT) AS episode, min(month) AS start, count(*) AS length, round(min(d), 6) AS depth, CASE WHEN count(nxt) = count(*) THEN max(nxt) END AS end FROM (SELECT *, sum((d >= 0)::INT) OVER (PARTITION BY ticker ORDER BY month ROWS UNBOUNDED PRECEDING) AS episode, lead(month) OVER (PARTITION BY ticker ORDER BY month) AS nxt FROM (SELECT ticker, month, CASE WHEN g >= t THEN 0 ELSE g / t - 1 END AS d FROM (SELECT ticker, month, g, greatest(max(g) OVER (PARTITION BY ticker ORDER BY month ROWS UNBOUNDED PRECEDING), 1.0) AS t FROM (SELECT ticker, month, exp(sum(ln(1 + mom_1m / 10)) OVER (PARTITION BY ticker ORDER BY month ROWS UNBOUNDED PRECEDING)) AS g FROM mpanel WHERE mom_1m IS NOT NULL)))) WHERE d < 0 GROUP BY 1, 2", "mpanel"))
def drawdown_episodes(v):
    d = v.mpanel.where("mom_1m IS NOT NULL").withColumn("r", F.col("mom_1m") / 10)
    g = series.drawdown_episodes(d, "r", "month", ["ticker"])
    return g.select("ticker", "episode", "start", "length", F.round("depth", 6).alias("depth"), "end")


@query("decay_thirds", sql("SELECT horizon, n, round(early, 6) AS early, round(late, 6) AS late, early > late AS decaying, sign(early) * sign(late) < 0 AS flipped FROM (SELECT horizon, max(n) AS n, quantile_cont(rank_ic, 0.5) FILTER (i <= n // 3) AS early, quantile_cont(rank_ic, 0.5) FILTER (i > n - n // 3) AS late FROM (SELECT horizon, rank_ic, row_number() OVER (PARTITION BY horizon ORDER BY as_of_date) AS i, count(*) OVER (PARTITION BY horizon) AS n FROM ic WHERE rank_ic IS NOT NULL) GROUP BY 1) WHERE n >= 9", "ic"))
def decay_thirds(v):
    return rounded(series.decay_thirds(evaluate.rank_ic(v.ev).drop("n"), "rank_ic", "as_of_date", ["horizon"]).drop("decay"))


@query("mostly_premarket", sql("SELECT event_id, avg((event_id % 3 <> 0)::INT) OVER (PARTITION BY ticker ORDER BY observed_at, event_id ROWS 7 PRECEDING) > 0.5 AS premarket FROM pe", "pe"))
def mostly_premarket(v):
    d = v.events.withColumns({"timing": F.when(F.col("event_id") % 3 != 0, "bmo").otherwise("amc"), "at": F.struct("observed_at", "event_id")})
    return d.select("event_id", events.mostly_premarket("timing", "ticker", "at").alias("premarket"))


@query("valuation_history", sql("SELECT ticker, period_end, CASE WHEN count(*) OVER w >= 8 THEN round((pe_ - avg(pe_) OVER w) / nullif(stddev_samp(pe_) OVER w, 0), 5) END AS pe_z FROM (SELECT ticker, period_end, equity / income * 1e5 AS pe_ FROM q0) WINDOW w AS (PARTITION BY ticker ORDER BY period_end ROWS UNBOUNDED PRECEDING)", "q0"))
def valuation_history(v):
    q = v.statements.where("observed_at = filing_date").groupBy("ticker", "period_end").pivot("field", ["income", "equity"]).agg(F.max("value"))
    d = events.valuation_history(q.withColumn("pe", F.col("equity") / F.col("income") * 1e5), "pe", "ticker", "period_end")
    return d.select("ticker", "period_end", F.round("pe_z", 5).alias("pe_z"))


DAYP = "SELECT ticker, DATE '2024-01-03' + CAST(7 * k AS INTEGER) AS date FROM (SELECT DISTINCT ticker FROM pe), generate_series(0, 3) g(k)"


def event_weeks(v):
    return v.events.select("ticker").distinct().select("ticker", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.date_add(F.lit("2024-01-03").cast("date"), k * 7))).alias("date"))


def event_texts(v):
    return v.events.select(F.col("event_id").alias("record_id"), "ticker", "event_date", F.col("value").alias("score"))


@query("filing_sentiment", sql("SELECT p.ticker, p.date, l.value AS latest, round(l.change, 9) AS change, (SELECT round(avg(value), 9) FROM pe WHERE pe.ticker = p.ticker AND pe.event_date BETWEEN p.date - 90 AND p.date - 1) AS mean_90d FROM p LEFT JOIN (SELECT ticker, event_date, value, value - p0 AS change FROM (SELECT *, lag(value) OVER (PARTITION BY ticker ORDER BY event_date, event_id) AS p0 FROM pe) QUALIFY row_number() OVER (PARTITION BY ticker, event_date ORDER BY value DESC, change DESC NULLS LAST) = 1) l ON l.ticker = p.ticker AND l.event_date = (SELECT max(event_date) FROM pe WHERE pe.ticker = p.ticker AND pe.event_date < p.date)", "pe", p=DAYP))
def filing_sentiment(v):
    return rounded(events.filing_sentiment(event_weeks(v), event_texts(v)), 9).select("ticker", "date", "latest", "change", "mean_90d")


NEWS = "(SELECT {f} FROM pe WHERE pe.ticker = p.ticker AND pe.event_date BETWEEN p.date - {n} AND p.date - 1)"


@query("news_sentiment", sql(f"SELECT ticker, date, {NEWS.format(f='round(avg(value), 9)', n=7)} AS news_7d, {NEWS.format(f='round(avg(value), 9)', n=30)} AS news_30d, {NEWS.format(f='count(value)', n=30)} AS news_count_30d, round({NEWS.format(f='avg(value)', n=7)} - {NEWS.format(f='avg(value)', n=30)}, 9) AS news_momentum FROM p", "pe", p=DAYP))
def news_sentiment(v):
    return rounded(events.news_sentiment(event_weeks(v), event_texts(v)), 9)


@query("implied_volatility_features", sql("SELECT ticker, month, round(mom_3m - mom_1m, 6) AS iv_term, round(mom_6m - mom_12m, 6) AS iv_skew, mom_1m > mom_3m AS iv_inverted, round(mom_1m - lag(mom_1m, 5) OVER w, 6) AS iv_change_5, round(mom_1m - lag(mom_1m, 20) OVER w, 6) AS iv_change_20 FROM mpanel WINDOW w AS (PARTITION BY ticker ORDER BY month)", "mpanel"))
def implied_volatility_features(v):
    d = series.iv_features(v.mpanel, "mom_1m", "mom_3m", "mom_6m", "mom_12m", "ticker", "month")
    return rounded(d.select("ticker", "month", "iv_term", "iv_skew", "iv_inverted", "iv_change_5", "iv_change_20"))


SPL = "SELECT ticker, date, CASE WHEN date < DATE '1995-07-01' THEN 4000.0 ELSE 1000.0 END * CASE WHEN ticker % 2 = 0 AND date < DATE '1997-01-01' THEN 2.0 ELSE 1.0 END AS close FROM bars"


@query("split_adjusted", sql("SELECT ticker, date, CAST(CASE WHEN has THEN 1000 ELSE close END AS DOUBLE) AS split_adjusted FROM (SELECT *, TRUE AS has FROM sp)", "bars", sp=SPL))
def split_adjusted(v):
    """Prices with a 4:1 split, and a 2:1 split of every other ticker: all come out at the last level."""
    late = F.when((F.col("ticker") % 2 == 0) & (F.col("date") < F.lit("1997-01-01").cast("date")), 2.0).otherwise(1.0)
    d = v.bars.select("ticker", "date", (F.when(F.col("date") < F.lit("1995-07-01").cast("date"), 4000.0).otherwise(1000.0) * late).alias("close"))
    return series.normalize_splits(d, "close", "ticker", "date").select("ticker", "date", F.round("split_adjusted", 6).alias("split_adjusted"))


@query("risk_on", sql("SELECT month, round(asia - america, 6) AS rel_asia, round((asia + europe) / 2 - (africa + america) / 2, 6) AS risk_on FROM (SELECT month, max(x) FILTER (sector = 'ASIA') AS asia, max(x) FILTER (sector = 'EUROPE') AS europe, max(x) FILTER (sector = 'AFRICA') AS africa, max(x) FILTER (sector = 'AMERICA') AS america FROM (SELECT month, sector, avg(mom_1m) AS x FROM mpanel WHERE sector IS NOT NULL GROUP BY 1, 2) GROUP BY 1)", "mpanel"))
def risk_on(v):
    r = v.mpanel.where("sector IS NOT NULL").groupBy("month", "sector").agg(F.avg("mom_1m").alias("x"))
    rel = series.sector_relative(r, "month", "sector", "x", ["ASIA"], "AMERICA")
    wide = r.groupBy("month").pivot("sector", ["ASIA", "EUROPE", "AFRICA", "AMERICA"]).agg(F.max("x"))
    return rounded(rel.join(series.risk_on(wide, ["ASIA", "EUROPE"], ["AFRICA", "AMERICA"]), "month").select("month", F.col("rel_ASIA").alias("rel_asia"), "risk_on"))


# Cross-sections ----------------------------------------------------------------------------------

M = "PARTITION BY month"


@query("relative_strengths", sql(f"SELECT ticker, month, CASE WHEN mom_3m IS NOT NULL AND count(mom_3m) OVER w >= 5 AND stddev_samp(mom_3m) OVER w > 1e-8 THEN round((mom_3m - avg(mom_3m) OVER w) / stddev_samp(mom_3m) OVER w, 6) END AS strength, CASE WHEN vol_6m IS NOT NULL AND count(vol_6m) OVER w >= 5 AND stddev_pop(vol_6m) OVER w > 1e-8 THEN round((vol_6m - avg(vol_6m) OVER w) / stddev_pop(vol_6m) OVER w, 6) END AS vol_z FROM mpanel WINDOW w AS ({M})", "mpanel"))
def relative_strengths(v):
    return rounded(v.mpanel.select("ticker", "month", cross.relative_strength("mom_3m", "month").alias("strength"), events.universe_z("vol_6m", "month", ddof=0).alias("vol_z")))


@query("sentiment_against_momentum", sql(f"SELECT ticker, month, CASE WHEN n >= 3 THEN round({pr('vol_6m', 'month')} - {pr('mom_12m', 'month')}, 6) END AS gap FROM (SELECT *, count(*) OVER ({M}) AS n FROM mpanel WHERE vol_6m IS NOT NULL AND mom_12m IS NOT NULL)", "mpanel"))
def sentiment_against_momentum(v):
    d = v.mpanel.select("ticker", "month", "vol_6m", "mom_12m", cross.sentiment_against_momentum("vol_6m", "mom_12m", "month").alias("gap"))
    return rounded(d.where("vol_6m IS NOT NULL AND mom_12m IS NOT NULL").select("ticker", "month", "gap"))


@query("ridge_neutral", sql(f"SELECT ticker, month, round(t - z * (sum(z * t) OVER ({M})) / (count(*) OVER ({M}) + 1), 6) AS neutral FROM (SELECT *, mom_12m - avg(mom_12m) OVER ({M}) AS t, (vol_6m - avg(vol_6m) OVER ({M})) / stddev_pop(vol_6m) OVER ({M}) AS z FROM (SELECT *, count(*) OVER ({M}) AS n FROM mpanel WHERE mom_12m IS NOT NULL AND vol_6m IS NOT NULL) WHERE n >= 5)", "mpanel"))
def ridge_neutral(v):
    d = labels.least_names(v.mpanel.where("mom_12m IS NOT NULL AND vol_6m IS NOT NULL"), ["month"], 5)
    return rounded(cross.neutralize_ridge(d, "mom_12m", ["vol_6m"], ["month"]).select("ticker", "month", "neutral"))


@query("sector_dummies", sql("SELECT ticker, CAST(coalesce(sector = 'ASIA', FALSE) AS INTEGER) AS sector_ASIA, CAST(coalesce(sector = 'EUROPE', FALSE) AS INTEGER) AS sector_EUROPE FROM sectors", "sectors"))
def sector_dummies(v):
    return cross.sector_dummies(v.sectors, "sector", ["ASIA", "EUROPE"]).drop("sector")


@query("rank_disagreement", sql(f"SELECT ticker, month, round(sqrt((a - m) ** 2 + (b - m) ** 2), 6) AS x FROM (SELECT ticker, month, a, b, (a + b) / 2 AS m FROM (SELECT ticker, month, CASE WHEN mom_1m IS NULL THEN 0.5 ELSE rank() OVER (PARTITION BY month ORDER BY mom_1m) / CAST(count(mom_1m) OVER ({M}) AS DOUBLE) END AS a, CASE WHEN mom_12m IS NULL THEN 0.5 ELSE rank() OVER (PARTITION BY month ORDER BY mom_12m) / CAST(count(mom_12m) OVER ({M}) AS DOUBLE) END AS b FROM (SELECT ticker, month, mom_1m, mom_12m FROM mpanel)))", "mpanel"))
def rank_disagreement(v):
    d = cross.disagreement([R.pct_rank("mom_1m", "month"), R.pct_rank("mom_12m", "month")])
    return rounded(v.mpanel.select("ticker", "month", d.alias("x")))


@query("sized_scores", sql("SELECT as_of_date, horizon, ticker, round(CASE WHEN ehat_raw IS NULL THEN score ELSE score * least(1.0, c / sqrt(greatest(ehat_raw, 0) + 1e-4)) END, 4) AS sized FROM ls, (SELECT 0.7 * quantile_cont(sqrt(greatest(ehat_raw, 0) + 1e-4), 0.5) AS c FROM ls WHERE as_of_date < DATE '1998-01-01')", "ls"))
def sized_scores(v):
    c = cross.sizing_constant(v.ls, "ehat_raw", where="as_of_date < '1998-01-01'")
    d = v.ls.crossJoin(F.broadcast(c))  # one row
    return rounded(d.select(*KEYS, "ticker", S.size_by_uncertainty("score", "ehat_raw", F.col("constant")).alias("sized")), 4)


@query("blended_scores", sql(f"SELECT ticker, month, round(w * {pr('vol_6m', 'month')} + (1 - w) * {pr('m', 'month')}, 6) AS blended FROM (SELECT *, coalesce(mom_12m, -1e300) AS m, 1 - 0.5 / (1 + exp(-(month(month) * 8 - 67) / 10.0)) AS w FROM mpanel WHERE vol_6m IS NOT NULL)", "mpanel"))
def blended_scores(v):
    w = S.calm_weight(F.month("month") * 8)
    return rounded(v.mpanel.where("vol_6m IS NOT NULL").select("ticker", "month", cross.blend_by_regime("vol_6m", "mom_12m", w, "month").alias("blended")))


@query("availability_masks", sql(f"SELECT ticker, month, mom_1m IS NOT NULL AS has_mom_1m, vol_6m IS NOT NULL AS has_vol_6m, round(({HAS}) / 5.0, 6) AS coverage, row_number() OVER (PARTITION BY ticker ORDER BY month) <= 12 AS is_new FROM mpanel", "mpanel"))
def availability_masks(v):
    d = cross.availability(v.mpanel, FEATURES).withColumn("is_new", cross.new_entity_flag("ticker", "month", 12))
    return rounded(d.select("ticker", "month", "has_mom_1m", "has_vol_6m", "coverage", "is_new"))


@query("grades_and_percentiles", sql(f"SELECT as_of_date, horizon, ticker, CASE WHEN n < 5 THEN 2 ELSE CAST(least(floor({pr('excess_return', K)} * 5), 4) AS INTEGER) END AS grade, round(100.0 * (n - k) / greatest(n - 1, 1), 6) AS percentile FROM (SELECT *, count(*) OVER (PARTITION BY {K}) AS n, row_number() OVER (PARTITION BY {K} ORDER BY score DESC, ticker) AS k FROM ev)", "ev"))
def grades_and_percentiles(v):
    d = v.ev.withColumns({"k": cross.deterministic_rank("score", "ticker", *KEYS), "n": F.count("score").over(R.xs(*KEYS))})
    return rounded(d.select(*KEYS, "ticker", cross.relevance_grade("excess_return", *KEYS).alias("grade"), cross.rank_percentile("k", "n").alias("percentile")))


TOPS = "SELECT as_of_date, horizon, list(ticker ORDER BY ticker) AS a FROM (SELECT *, row_number() OVER (PARTITION BY as_of_date, horizon ORDER BY score DESC, ticker) AS k FROM ev) WHERE k <= 10 GROUP BY 1, 2"


@query("symmetric_turnover", sql("SELECT as_of_date, horizon, round((len(a) + len(b) - 2 * len(list_intersect(a, b))) / 40.0, 6) AS turnover FROM (SELECT *, lag(a) OVER (PARTITION BY horizon ORDER BY as_of_date) AS b FROM tops) WHERE b IS NOT NULL", "ev", tops=TOPS))
def symmetric_turnover(v):
    d = cross.top_n(v.ev, "score", 10, KEYS, "ticker").groupBy(*KEYS).agg(F.collect_set("ticker").alias("a"))  # books of ten
    d = d.withColumn("b", F.lag("a").over(Window.partitionBy("horizon").orderBy("as_of_date"))).where("b IS NOT NULL")
    return rounded(d.select(*KEYS, portfolio.symmetric_turnover(F.col("a"), F.col("b"), 10).alias("turnover")))


@query("extreme_texts", "SELECT record_id, side FROM (SELECT doc_id AS record_id, 'best' AS side, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS k FROM documents UNION ALL SELECT doc_id, 'worst', row_number() OVER (ORDER BY n_chars, doc_id) FROM documents) WHERE k <= 10")
def extreme_texts(v):
    return events.extreme_texts(v.table("documents").select(F.col("doc_id").alias("record_id"), F.col("n_chars").alias("score")), 10).select("record_id", "side")


# Statistics --------------------------------------------------------------------------------------

NEUT = "SELECT *, a - avg(a) OVER (PARTITION BY month, sector) AS es, b - avg(b) OVER (PARTITION BY month, sector) AS bs FROM (SELECT ticker, month, sector, mom_12m AS a, vol_6m AS b, mom_1m AS y, count(*) OVER (PARTITION BY month) AS n FROM mpanel WHERE mom_12m IS NOT NULL AND vol_6m IS NOT NULL AND sector IS NOT NULL AND mom_1m IS NOT NULL)"
NEUT2 = "SELECT *, round(es - coalesce((sum(bs * es) OVER (PARTITION BY month)) / nullif(sum(bs * bs) OVER (PARTITION BY month), 0), 0) * bs, 9) AS eb, round(es, 9) AS e FROM ne WHERE n >= 5"


@query("neutral_ics", sql(f"SELECT month, round(x.rho, 5) AS ic_raw, round(z.rho, 5) AS ic_both FROM ({rank_corr('nf', 'a', 'y', 'month')}) x JOIN ({rank_corr('nf', 'eb', 'y', 'month')}) z USING (month)", "mpanel", ne=NEUT, nf=NEUT2))
def neutral_ics(v):
    d = labels.least_names(v.mpanel.where("mom_12m IS NOT NULL AND vol_6m IS NOT NULL AND sector IS NOT NULL AND mom_1m IS NOT NULL"), ["month"], 5)
    r = stats.neutral_ic(d.withColumnRenamed("vol_6m", "beta"), ["mom_12m"], "mom_1m", ["month"])
    return rounded(r.select("month", "ic_raw", "ic_both"), 5)


@query("rolling_pooled_correlation", sql(f"SELECT d.month, CASE WHEN n >= 20 THEN round(rho, 6) END AS rho, n FROM ({rank_corr('(SELECT d.i, p.mom_1m, p.vol_6m FROM idx d JOIN idx e ON e.i BETWEEN d.i - 11 AND d.i JOIN mpanel p ON p.month = e.month)', 'mom_1m', 'vol_6m', 'i')}) r JOIN idx d ON d.i = r.i", "mpanel", idx="SELECT month, row_number() OVER (ORDER BY month) AS i FROM (SELECT DISTINCT month FROM mpanel)"))
def rolling_pooled_correlation(v):
    return rounded(stats.rolling_pooled_correlation(v.mpanel, "mom_1m", "vol_6m", "month", 12))


@query("feature_blocks", sql(f"SELECT feature, block, CAST(size AS BIGINT) AS size FROM (VALUES ('mom_1m', 'mom_1m', 1), ('mom_1m_twice', 'mom_1m_twice', 1)) t(feature, block, size) WHERE FALSE UNION ALL SELECT f, CASE WHEN f = 'vol_6m' THEN 'vol_6m' ELSE 'adv' END, CASE WHEN f = 'vol_6m' THEN 1 ELSE 2 END FROM (VALUES ('adv'), ('adv_twice'), ('vol_6m')) t(f) WHERE (SELECT count(*) FROM mpanel) > 0", "mpanel"))
def feature_blocks(v):
    d = v.mpanel.withColumn("adv_twice", F.col("adv") * 2)
    names = ["adv", "adv_twice", "vol_6m"]
    pairs = stats.correlation_pairs(d, names, "pearson")
    return stats.feature_blocks(pairs, v.spark.createDataFrame([(n,) for n in names], "feature string")).select("feature", "block", "size")


@query("pair_report", sql(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, sector, round(rho, 6) AS rho, n, round(rho * sqrt(n - 2) / sqrt(1 - rho * rho), 4) AS t FROM ({rank_corr('(SELECT * FROM mpanel WHERE sector IS NOT NULL)', a, b, 'sector')})" for a, b in (("mom_1m", "mom_3m"), ("mom_3m", "vol_6m"))), "mpanel"))
def pair_report(v):
    d = stats.pair_report(v.mpanel.where("sector IS NOT NULL"), [("mom_1m", "mom_3m"), ("mom_3m", "vol_6m")], ["sector"])
    return d.select("a", "b", "sector", F.round("rho", 6).alias("rho"), "n", F.round("t", 4).alias("t"))


PAIRS = (("adv", "mom_1m"), ("adv", "vol_6m"), ("mom_1m", "vol_6m"))


@query("feature_rank_correlations", sql(" UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round({corr('x', 'y')}, 6) AS rho, count(*) AS n FROM (SELECT r{a} AS x, r{b} AS y FROM rk WHERE {a} IS NOT NULL AND {b} IS NOT NULL)" for a, b in PAIRS), "mpanel", rk="SELECT *, " + ", ".join(f"rank() OVER (ORDER BY {f} NULLS LAST) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0 AS r{f}" for f in ("adv", "mom_1m", "vol_6m")) + " FROM mpanel"))
def feature_rank_correlations(v):
    return rounded(stats.correlation_pairs(v.mpanel, ["adv", "mom_1m", "vol_6m"]))


@query("residual_spread", sql("SELECT month, round(quantile_cont(es - coalesce(k, 0) * bs, 0.75) - quantile_cont(es - coalesce(k, 0) * bs, 0.25), 6) AS residual_iqr, count(*) AS n FROM (SELECT *, (sum(bs * es) OVER (PARTITION BY month)) / nullif(sum(bs * bs) OVER (PARTITION BY month), 0) AS k FROM ne WHERE n >= 5) GROUP BY 1", "mpanel", ne=NEUT))
def residual_spread(v):
    d = labels.least_names(v.mpanel.where("mom_12m IS NOT NULL AND vol_6m IS NOT NULL AND sector IS NOT NULL AND mom_1m IS NOT NULL"), ["month"], 5)
    return rounded(stats.residual_iqr(d, "mom_12m", "sector", "vol_6m", ["month"]))


IMP = "SELECT feature, round(abs({c}), 9) AS importance FROM (SELECT 'mom_3m' AS feature, corr(mom_1m, mom_3m) AS c FROM p UNION ALL SELECT 'mom_6m', corr(mom_1m, mom_6m) FROM p UNION ALL SELECT 'mom_12m', corr(mom_1m, mom_12m) FROM p UNION ALL SELECT 'vol_6m', corr(mom_1m, vol_6m) FROM p UNION ALL SELECT 'adv', corr(mom_1m, adv) FROM p)"
IMPF = ["mom_3m", "mom_6m", "mom_12m", "vol_6m", "adv"]


def importance_sql(where: str) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, round(abs({corr('mom_1m', f)}), 9) AS importance FROM mpanel WHERE {where} AND mom_1m IS NOT NULL AND {f} IS NOT NULL" for f in IMPF)


def importance(v, where):
    c = F.array(*[F.struct(F.lit(f).alias("feature"), F.round(F.abs(R.safe_corr("mom_1m", f)), 9).alias("importance")) for f in IMPF])
    return v.mpanel.where(where).agg(c.alias("x")).select(F.inline("x"))


EARLY, LATE = "month < DATE '1998-07-01'", "month >= DATE '1998-07-01'"


@query("importance_drift", sql(f"SELECT round({corr('ra', 'rb')}, 6) AS rho, count(*) AS n, CAST(count(*) FILTER (ka <= 3 AND kb <= 3) AS BIGINT) AS top_overlap FROM (SELECT rank() OVER (ORDER BY a.importance) AS ra, rank() OVER (ORDER BY b.importance) AS rb, row_number() OVER (ORDER BY a.importance DESC, feature) AS ka, row_number() OVER (ORDER BY b.importance DESC, feature) AS kb FROM a JOIN b USING (feature))", "mpanel", a=importance_sql(EARLY), b=importance_sql(LATE)))
def importance_drift(v):
    return rounded(stats.importance_drift(importance(v, EARLY), importance(v, LATE)))


BKT = bucketed("ev", "score", K, 5)


@query("bucket_returns", sql("SELECT bucket, count(*) AS n, round(avg(excess_return), 6) AS mean_return, round(avg((sign(score) = sign(excess_return))::INT), 6) AS sign_agreement FROM bk WHERE bucket IS NOT NULL GROUP BY 1", "ev", bk=BKT))
def bucket_returns(v):
    return rounded(evaluate.bucket_returns(v.ev, 5, KEYS))


@query("bucket_monotonicity", sql(f"SELECT horizon, round({corr('bucket', 'k')}, 6) AS rho, coalesce(min(step) >= -0.005, TRUE) AS monotone FROM (SELECT horizon, bucket, m - lag(m) OVER (PARTITION BY horizon ORDER BY bucket) AS step, rank() OVER (PARTITION BY horizon ORDER BY m) AS k FROM (SELECT horizon, bucket, avg(excess_return) AS m FROM bk WHERE bucket IS NOT NULL GROUP BY 1, 2)) GROUP BY 1", "ev", bk=BKT))
def bucket_monotonicity(v):
    d = R.bucket_by_edges(v.ev, "score", KEYS, 5).where("bucket IS NOT NULL").groupBy("horizon", "bucket").agg(F.avg("excess_return").alias("m"))
    return rounded(evaluate.monotonicity(d, "m", "bucket", ["horizon"]))


# Gates and verdicts -------------------------------------------------------------------------------

TOPD = "SELECT fold_id, horizon, as_of_date, avg(excess_return) FILTER (k <= 10) AS top_return FROM (SELECT *, row_number() OVER (PARTITION BY as_of_date, horizon ORDER BY score DESC, ticker) AS k, count(*) OVER (PARTITION BY as_of_date, horizon) AS n FROM ev) WHERE n >= 10 GROUP BY 1, 2, 3"
SCEN = "(VALUES ('zero', 0.0, 0.0), ('low', 20.0, 5.0), ('base', 20.0, 10.0), ('high', 20.0, 20.0)) s(scenario, b, c)"


@query("cost_overlay", sql(f"SELECT fold_id, horizon, scenario, round(top_return - CASE WHEN scenario = 'zero' THEN 0 ELSE (b + c * 0.01) / 10000 END, 8) AS net, top_return - CASE WHEN scenario = 'zero' THEN 0 ELSE (b + c * 0.01) / 10000 END > 0 AS survives FROM (SELECT fold_id, horizon, quantile_cont(top_return, 0.5) AS top_return FROM td GROUP BY 1, 2), {SCEN}", "ev", td=TOPD))
def cost_overlay(v):
    d = evaluate.cost_overlay(evaluate.fold_summary(v.ev), evaluate.cost_scenarios(v.spark))
    return d.select("fold_id", "horizon", "scenario", F.round("net", 8).alias("net"), "survives")


@query("stability_scorecard", sql("SELECT horizon, round(m.mean_ic, 6) AS mean_ic, round(c.median_churn, 6) AS median_churn, d.early > d.late AS decaying FROM (SELECT horizon, avg(rank_ic) AS mean_ic FROM ic WHERE rank_ic IS NOT NULL GROUP BY 1) m LEFT JOIN (SELECT horizon, quantile_cont(churn, 0.5) AS median_churn FROM (SELECT b.horizon, b.as_of_date, 1 - count(p.ticker) / 10.0::DOUBLE AS churn FROM book b JOIN bp USING (horizon, as_of_date) LEFT JOIN book p ON p.horizon = b.horizon AND p.as_of_date = bp.prev AND p.ticker = b.ticker WHERE bp.prev IS NOT NULL GROUP BY 1, 2) GROUP BY 1) c USING (horizon) LEFT JOIN (SELECT horizon, quantile_cont(rank_ic, 0.5) FILTER (i <= n // 3) AS early, quantile_cont(rank_ic, 0.5) FILTER (i > n - n // 3) AS late FROM (SELECT horizon, rank_ic, row_number() OVER (PARTITION BY horizon ORDER BY as_of_date) AS i, count(*) OVER (PARTITION BY horizon) AS n FROM ic WHERE rank_ic IS NOT NULL) GROUP BY 1) d USING (horizon)", "ic", book="SELECT as_of_date, horizon, ticker FROM (SELECT *, row_number() OVER (PARTITION BY as_of_date, horizon ORDER BY score DESC, ticker) AS k, count(*) OVER (PARTITION BY as_of_date, horizon) AS n FROM ev) WHERE k <= 10 AND n >= 10", bp="SELECT horizon, as_of_date, lag(as_of_date) OVER (PARTITION BY horizon ORDER BY as_of_date) AS prev FROM (SELECT DISTINCT horizon, as_of_date FROM book)"))
def stability_scorecard(v):
    ic = evaluate.rank_ic(v.ev).drop("n")
    d = evaluate.scorecard(evaluate.signal_summary(ic, ["horizon"]), evaluate.churn_diagnostics(evaluate.churn(v.ev, 10), ["horizon"]), series.decay_thirds(ic, "rank_ic", "as_of_date", ["horizon"]).drop("n"), ["horizon"])
    return rounded(d.select("horizon", "mean_ic", "median_churn", "decaying"))


@query("acceptance_verdicts", sql(f"SELECT horizon, ric >= floor + 0.02 AS beats_floor, pos >= 0.5 AS mostly_positive, CASE WHEN (ric >= floor + 0.02)::INT + (pos >= 0.5)::INT + 2 = 4 THEN 'accept' WHEN (ric >= floor + 0.02)::INT + (pos >= 0.5)::INT + 2 >= 3 THEN 'watch' ELSE 'reject' END AS verdict FROM (SELECT horizon, quantile_cont(rank_ic, 0.5) AS ric, avg((rank_ic > 0)::INT) AS pos FROM ic WHERE rank_ic IS NOT NULL GROUP BY 1) JOIN (SELECT horizon, max(m) AS floor FROM (SELECT baseline, horizon, quantile_cont(rank_ic, 0.5) AS m FROM ({rank_corr('bs', 's', 'excess_return', 'baseline, as_of_date, horizon', 'rank_ic')}) GROUP BY 1, 2) GROUP BY 1) USING (horizon)", "ic", bs=BASE))
def acceptance_verdicts(v):
    floor = evaluate.baseline_floor(evaluate.rank_ic(baseline_rows(v), ["baseline", *KEYS]))
    m = evaluate.signal_summary(evaluate.rank_ic(v.ev), ["horizon"]).select("horizon", F.col("median_ic").alias("rank_ic"), "positive_share", F.lit(0.2).alias("churn"), F.lit(0.01).alias("spread"))
    return evaluate.acceptance(m, floor.drop("best")).select("horizon", "beats_floor", "mostly_positive", "verdict")


FUSED = f"SELECT *, ({pr('score', K)} + {pr('mom_1m', K)}) / 2 AS fused FROM ev WHERE mom_1m IS NOT NULL"


@query("fusion_gate", sql(f"SELECT f.horizon, round(f.m, 6) AS mean_ic, f.m > greatest(a.m, b.m) AS gate4 FROM (SELECT horizon, avg(round(rank_ic, 9)) AS m FROM ({rank_corr('(SELECT *, round(fused, 9) AS g FROM fu)', 'g', 'excess_return', K, 'rank_ic')}) GROUP BY 1) f JOIN (SELECT horizon, avg(rank_ic) AS m FROM ({rank_corr('fu', 'score', 'excess_return', K, 'rank_ic')}) GROUP BY 1) a USING (horizon) JOIN (SELECT horizon, avg(rank_ic) AS m FROM ({rank_corr('fu', 'mom_1m', 'excess_return', K, 'rank_ic')}) GROUP BY 1) b USING (horizon)", "ev", fu=FUSED))
def fusion_gate(v):
    d = v.ev.where("mom_1m IS NOT NULL")
    fused = d.withColumn("fused", F.round(cross.fuse_ranks(["score", "mom_1m"], *KEYS, least=1), 9))
    f = evaluate.signal_summary(evaluate.rank_ic(fused, score="fused"), ["horizon"])
    single = evaluate.signal_summary(evaluate.rank_ic(d).withColumn("signal", F.lit("score")).unionByName(evaluate.rank_ic(d, score="mom_1m").withColumn("signal", F.lit("mom_1m"))), ["signal", "horizon"])
    return evaluate.fusion_gate(f, single, ["horizon"]).select("horizon", F.round("mean_ic", 6).alias("mean_ic"), "gate4")


@query("concatenated_models", sql("SELECT model, horizon, count(*) AS n, count(vol_6m) AS n_vol, round(avg(score), 6) AS mean_score FROM (SELECT 'momentum' AS model, horizon, score, NULL AS vol_6m FROM ev UNION ALL SELECT 'reversal', horizon, -score, vol_6m FROM ev) GROUP BY 1, 2", "ev"))
def concatenated_models(v):
    d = evaluate.concat({"momentum": v.ev.drop("vol_6m"), "reversal": v.ev.withColumn("score", -F.col("score"))}, "model")
    return rounded(d.groupBy("model", "horizon").agg(F.count(F.lit(1)).alias("n"), F.count("vol_6m").alias("n_vol"), F.avg("score").alias("mean_score")))


@query("signal_orthogonality", sql(f"SELECT as_of_date, horizon, CASE WHEN n >= 10 THEN round(rho, 6) END AS rho, n FROM ({rank_corr('ev', 'score', 'mom_1m', K)})", "ev"))
def signal_orthogonality(v):
    on = [*KEYS, "ticker"]
    b = v.ev.select(*on, F.col("mom_1m").alias("score"))
    return rounded(evaluate.score_correlation(v.ev.select(*on, "score"), b, on, KEYS))


@query("baseline_clone", sql(f"SELECT horizon, round(quantile_cont(rho, 0.5), 6) AS median_rho, quantile_cont(rho, 0.5) > 0.95 AS clone FROM (SELECT horizon, CASE WHEN n >= 10 THEN rho END AS rho FROM ({rank_corr('ev', 'score', 'mom_1m', K)})) GROUP BY 1", "ev"))
def baseline_clone(v):
    on = [*KEYS, "ticker"]
    b = v.ev.select(*on, F.col("mom_1m").alias("score"))
    return evaluate.is_clone(v.ev.select(*on, "score"), b, on, KEYS).select("horizon", F.round("median_rho", 6).alias("median_rho"), "clone")


@query("shuffled_control", sql("SELECT as_of_date, horizon, count(*) AS n, round(sum(score), 6) AS total FROM ev GROUP BY 1, 2", "ev"))
def shuffled_control(v):
    """Scores dealt anew inside a cross-section: the same scores, other owners."""
    d = evaluate.shuffled_scores(v.ev)
    return rounded(d.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total")))


@query("external_frame", sql("SELECT CAST(((as_of_date + INTERVAL 16 HOUR)::TIMESTAMP AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS TIMESTAMP) AS datetime, CAST(ticker AS VARCHAR) AS instrument, horizon, round(score, 6) AS score, round(excess_return, 6) AS label FROM ev", "ev"))
def external_frame(v):
    d = evaluate.external_frame(v.ev)
    return rounded(d.withColumn("datetime", F.col("datetime").cast("timestamp_ntz")))


@query("ic_parity", sql("SELECT as_of_date, horizon, TRUE AS same FROM ic", "ic"))
def ic_parity(v):
    """Our rank IC and that of the frame given to an outside evaluator, side by side."""
    ours = evaluate.rank_ic(v.ev)
    theirs = evaluate.rank_ic(evaluate.external_frame(v.ev), ["datetime", "horizon"], label="label").withColumn("as_of_date", F.from_utc_timestamp("datetime", S.NEW_YORK).cast("date"))
    return evaluate.ic_parity(ours, theirs, KEYS).select(*KEYS, "same")


@query("aligned_scores", sql("SELECT e.as_of_date, e.horizon, e.ticker, round(e.score, 6) AS score, round(p.vol_6m, 6) AS vol, round(p.adv, 4) AS adv_score FROM ev e LEFT JOIN (SELECT * FROM mpanel WHERE ticker % 3 <> 0) p ON p.ticker = e.ticker AND p.month = e.as_of_date", "ev", "mpanel"))
def aligned_scores(v):
    p = v.mpanel.where("ticker % 3 <> 0")
    on = ["as_of_date", "ticker"]
    others = {n: p.select(F.col("month").alias("as_of_date"), "ticker", F.col(c).alias("score")) for n, c in (("vol", "vol_6m"), ("adv_score", "adv"))}
    d = evaluate.align_scores(v.ev.select(*KEYS, "ticker", "score"), others, on)
    return d.select(*KEYS, "ticker", F.round("score", 6).alias("score"), F.round("vol", 6).alias("vol"), F.round("adv_score", 4).alias("adv_score"))


# Books --------------------------------------------------------------------------------------------

LSB = "SELECT *, row_number() OVER (PARTITION BY as_of_date ORDER BY score DESC, ticker) AS l, row_number() OVER (PARTITION BY as_of_date ORDER BY score, ticker) AS s, count(*) OVER (PARTITION BY as_of_date) AS n FROM ev WHERE horizon = 20"
SER = "SELECT as_of_date, (avg(excess_return) FILTER (l <= 10) - avg(excess_return) FILTER (s <= 10)) / 100 AS x FROM lsb WHERE n >= 20 GROUP BY 1"


def book_returns(v):
    b = portfolio.book_series(portfolio.long_short(v.ev.where("horizon = 20"), 10, ["horizon"]), 10, ["horizon"])
    return b.withColumn("x", F.col("ls_return") / 100)


@query("period_metrics", sql("SELECT period, count(*) AS n, round(avg(x) / stddev_samp(x) * sqrt(12), 6) AS sharpe, round(max(x), 6) AS best, round(min(x), 6) AS worst, round(pow(exp(sum(ln(1 + x))), 12.0 / count(*)) - 1, 6) AS cagr, round(avg(x) FILTER (x > 0) / abs(avg(x) FILTER (x < 0)), 5) AS win_loss FROM (SELECT x, unnest(CASE WHEN as_of_date < DATE '1997-01-01' THEN ['ALL', 'DEV'] ELSE ['ALL', 'FINAL'] END) AS period FROM ser) GROUP BY 1 HAVING count(*) >= 2", "ev", lsb=LSB, ser=SER))
def period_metrics(v):
    m = portfolio.metrics(portfolio.by_period(book_returns(v), final_from="1997-01-01"), ["period"], "x")
    return m.select("period", "n", *[F.round(c, 6).alias(c) for c in ("sharpe", "best", "worst", "cagr")], F.round("win_loss", 5).alias("win_loss"))


@query("every_third_book", sql("SELECT as_of_date, round(x, 8) AS x FROM (SELECT *, row_number() OVER (ORDER BY as_of_date) - 1 AS i FROM ser) WHERE i % 3 = 0", "ev", lsb=LSB, ser=SER))
def every_third_book(v):
    return rounded(portfolio.every_nth(book_returns(v), 3, ["horizon"]).select("as_of_date", "x"), 8)


@query("model_decision", sql("SELECT arg_max(horizon, (s, horizon)) AS best, round(max(s), 6) AS best_metric, round(max(s) FILTER (horizon = '20'), 6) AS incumbent_metric FROM (SELECT CAST(horizon AS VARCHAR) AS horizon, avg(x) / stddev_samp(x) * sqrt(12) AS s FROM (SELECT as_of_date, horizon, avg(excess_return) FILTER (l <= 10) - avg(excess_return) FILTER (s <= 10) AS x FROM (SELECT *, row_number() OVER (PARTITION BY as_of_date, horizon ORDER BY score DESC, ticker) AS l, row_number() OVER (PARTITION BY as_of_date, horizon ORDER BY score, ticker) AS s, count(*) OVER (PARTITION BY as_of_date, horizon) AS n FROM ev) WHERE n >= 20 GROUP BY 1, 2) GROUP BY 1)", "ev"))
def model_decision(v):
    b = portfolio.book_series(portfolio.long_short(v.ev, 10, ["horizon"]), 10, ["horizon"])
    m = portfolio.metrics(b, ["horizon"], "ls_return").withColumn("model", F.col("horizon").cast("string"))
    return rounded(portfolio.adopt_or_retain(m, "20").select("best", "best_metric", "incumbent_metric"))


RK = "SELECT *, 100.0::DOUBLE * (n - rank) / greatest(n - 1, 1) AS percentile FROM (SELECT *, row_number() OVER (PARTITION BY as_of_date, horizon ORDER BY score DESC, ticker) AS rank, count(*) OVER (PARTITION BY as_of_date, horizon) AS n FROM ev)"


@query("ranking_report", sql("SELECT as_of_date, horizon, count(*) AS n, CAST(count(*) FILTER (percentile >= 90) AS BIGINT) AS n_top_buy, CAST(count(*) FILTER (percentile <= 10) AS BIGINT) AS n_avoid, round(avg(excess_return) FILTER (percentile >= 80) - avg(excess_return) FILTER (percentile <= 20), 6) AS quintile_spread, min(ticker) FILTER (rank = 1) AS first FROM rk GROUP BY 1, 2", "ev", rk=RK))
def ranking_report(v):
    d = portfolio.ranking_report(portfolio.rankings(v.ev, KEYS), KEYS)
    return rounded(d.select(*KEYS, "n", "n_top_buy", "n_avoid", "quintile_spread", F.col("top_names")[0].alias("first")))


@query("selected_signals", sql("SELECT as_of_date, horizon, ticker FROM ev WHERE score > 0.02 AND vol_6m >= 0.1", "ev"))
def selected_signals(v):
    d = v.ev.withColumns({"direction": S.signal_direction("score"), "confidence": F.col("vol_6m")})
    return portfolio.select_signals(d, "bullish", 0.1).select(*KEYS, "ticker")
