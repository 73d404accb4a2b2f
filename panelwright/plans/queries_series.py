"""Queries: scans, series, cross-sections, point-in-time reads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ranks as R
from ..functions import scalars as S
from ..operators import audits, cross, events, labels, learn, pit, series, universe
from .registry import Views, ar, corr, pr, query, r, rounded
from .sqlviews import sql

K = "as_of_date, horizon"


@query("rank_ic_monthly", sql(f"SELECT as_of_date, {r(corr('x', 'y'))} AS rank_ic, count(*) AS n FROM (SELECT as_of_date, {ar('score', K)} AS x, {ar('excess_return', K)} AS y FROM ev WHERE horizon = 20) GROUP BY 1 HAVING count(*) >= 5", "ev"))
def rank_ic_monthly(v: Views):
    from ..operators.evaluate import rank_ic

    d = labels.least_names(v.ev.where("horizon = 20"), ["as_of_date"], 5)
    return rounded(rank_ic(d, ["as_of_date"]))


W = "WINDOW w AS (PARTITION BY ticker ORDER BY date)"


@query("bar_scan_range", sql("SELECT ticker, date, close, volume FROM bars WHERE date BETWEEN DATE '1993-01-01' AND DATE '1997-12-31'", "bars"))
def bar_scan_range(v):
    from ..sources.stores import query_bars

    return query_bars(v.bars, None, "1993-01-01", "1997-12-31")


@query("momentum_daily", sql("SELECT ticker, date, " + ", ".join(r(f"close / lag(close, {n}) OVER w - 1") + f" AS mom_{n}" for n in (21, 63, 126, 252)) + f" FROM bars {W}", "bars"))
def momentum_daily(v):
    w = R.ts("ticker", "date")
    return rounded(v.bars.select("ticker", "date", *[series.momentum("close", n, w).alias(f"mom_{n}") for n in (21, 63, 126, 252)]))


VOL = {
    "lr": f"SELECT *, ln(close / lag(close) OVER w) AS lr, close / lag(close) OVER w - 1 AS sr FROM bars {W}",
}


@query(
    "realized_vol",
    sql(
        "SELECT ticker, date, "
        + ", ".join(f"CASE WHEN count(lr) OVER w{n} = {n} THEN {r(f'stddev_pop(lr) OVER w{n} * sqrt(252)')} END AS vol_{n}" for n in (20, 60))
        + ", CASE WHEN count(sr) OVER w20 >= 16 THEN round(stddev_samp(sr) OVER w20 * sqrt(252), 6) END AS online_20 FROM lr WINDOW w20 AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING), w60 AS (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING)",
        "bars",
        **VOL,
    ),
)
def realized_vol(v):
    w = R.ts("ticker", "date")
    d = v.bars.withColumns({"lr": series.log_return("close", w), "sr": series.simple_return("close", w)})
    return rounded(d.select("ticker", "date", series.realized_vol("lr", 20, w).alias("vol_20"), series.realized_vol("lr", 60, w).alias("vol_60"), series.realized_vol("sr", 20, w, "online").alias("online_20")))


@query(
    "vol_of_vol",
    sql(
        "SELECT ticker, date, round(sqrt((a*a + b*b + c*c) / 3 - ((a + b + c) / 3) * ((a + b + c) / 3)), 4) AS vov FROM (SELECT ticker, date, v AS a, lag(v, 20) OVER w AS b, lag(v, 40) OVER w AS c FROM (SELECT ticker, date, CASE WHEN count(lr) OVER w20 = 20 THEN stddev_pop(lr) OVER w20 * sqrt(252) END AS v FROM lr WINDOW w20 AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)) WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL",
        "bars",
        **VOL,
    ),
)
def vol_of_vol(v):
    w = R.ts("ticker", "date")
    d = v.bars.withColumn("lr", series.log_return("close", w)).withColumn("v", series.realized_vol("lr", 20, w))
    return d.select("ticker", "date", F.round(series.vol_of_vol("v", w), 4).alias("vov")).where("vov IS NOT NULL")


@query(
    "window_drawdown",
    sql(
        "SELECT ticker, date, round(list_min(list_transform(generate_series(1, 61), lambda i: a[i] / list_max(a[1:i]) - 1)), 6) AS dd FROM (SELECT ticker, date, list(close) OVER (PARTITION BY ticker ORDER BY date ROWS 60 PRECEDING) AS a FROM bars) WHERE len(a) = 61",
        "bars",
    ),
)
def window_drawdown(v):
    d = series.window_drawdown(v.bars, "close", 60, ["ticker"], "date", name="dd")
    return rounded(d.select("ticker", "date", "dd").where("dd IS NOT NULL"))


@query("distance_and_money_volume", sql("SELECT ticker, date, round(close / max(close) OVER (PARTITION BY ticker ORDER BY date ROWS 251 PRECEDING) - 1, 6) AS from_high, CASE WHEN count(*) OVER b = 20 THEN round(avg(close * volume) OVER b, 4) END AS adv_store, CASE WHEN count(*) OVER a = 20 THEN round(avg(close * volume) OVER a, 4) END AS adv_online FROM bars WINDOW b AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)", "bars"))
def distance_and_money_volume(v):
    w = R.ts("ticker", "date")
    return v.bars.select("ticker", "date", F.round(series.from_high("close", 252, w), 6).alias("from_high"), F.round(series.money_volume("close", "volume", 20, w), 4).alias("adv_store"), F.round(series.money_volume("close", "volume", 20, w, "online"), 4).alias("adv_online"))


@query("beta_252", sql("SELECT ticker, date, CASE WHEN count(x) OVER w = 252 THEN round((covar_samp(x, y) OVER w) / (var_samp(y) OVER w), 6) END AS beta FROM (SELECT b.ticker, b.date, b.close / lag(b.close) OVER p - 1 AS x, m.ret AS y FROM bars b JOIN market m USING (date) WINDOW p AS (PARTITION BY b.ticker ORDER BY b.date)) WHERE x IS NOT NULL AND y IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 251 PRECEDING)", "bars", "market"))
def beta_252(v):
    w = R.ts("ticker", "date")
    m = v.market.select("date", F.col("ret").alias("mret"))
    d = v.bars.join(F.broadcast(m), "date").withColumn("ret", series.simple_return("close", w)).where("ret IS NOT NULL AND mret IS NOT NULL")
    return rounded(series.beta(d, "ret", "mret", 252, ["ticker"], "date").select("ticker", "date", "beta"))


@query(
    "market_regime_block",
    sql(
        "SELECT date, round(close / lag(close, 5) OVER w - 1, 6) AS ret_5, round(close / lag(close, 21) OVER w - 1, 6) AS ret_21, CASE WHEN count(ret) OVER w20 = 20 THEN round(stddev_pop(ret) OVER w20 * sqrt(252), 6) END AS vol_20, CASE WHEN count(*) OVER w50 = 50 THEN round(avg(close) OVER w50, 6) END AS ma_50, CASE WHEN count(*) OVER w200 = 200 THEN round(avg(close) OVER w200, 6) END AS ma_200 FROM market WINDOW w AS (ORDER BY date), w20 AS (ORDER BY date ROWS 19 PRECEDING), w50 AS (ORDER BY date ROWS 49 PRECEDING), w200 AS (ORDER BY date ROWS 199 PRECEDING)",
        "market",
    ),
)
def market_regime_block(v):
    w = Window.orderBy("date")
    return rounded(v.market.select("date", series.momentum("close", 5, w).alias("ret_5"), series.momentum("close", 21, w).alias("ret_21"), series.realized_vol("ret", 20, w).alias("vol_20"), series.moving_average("close", 50, w).alias("ma_50"), series.moving_average("close", 200, w).alias("ma_200")))


@query("rolling_percentile_252", sql("SELECT date, round(100.0 * len(list_filter(a, lambda x: x <= close)) / 252, 6) AS pct FROM (SELECT date, close, list(close) OVER (ORDER BY date ROWS 251 PRECEDING) AS a FROM market) WHERE len(a) = 252", "market"))
def rolling_percentile_252(v):
    return rounded(v.market.select("date", series.rolling_percentile("close", 252, Window.orderBy("date")).alias("pct")).where("pct IS NOT NULL"))


@query("ewma_monthly", sql("SELECT ticker, month, round(num / den, 6) AS ewma FROM (SELECT a.ticker, a.month, sum(b.mom_1m * pow(2.0, (b.i - a.i) / 6.0)) AS num, sum(pow(2.0, (b.i - a.i) / 6.0)) AS den FROM x a JOIN x b ON a.ticker = b.ticker AND b.i <= a.i WHERE b.mom_1m IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3)", "mpanel", x="SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY month) AS i FROM mpanel"))
def ewma_monthly(v):
    return rounded(series.ewma(v.mpanel, "mom_1m", ["ticker"], "month", 6, 3).where("ewma IS NOT NULL").select("ticker", "month", "ewma"))


@query("expanding_z", sql("SELECT date, round(greatest(least((ret - avg(ret) OVER w) / (stddev_samp(ret) OVER w), 3.0), -3.0), 6) AS z FROM market WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING) QUALIFY count(ret) OVER w >= 60 AND ret IS NOT NULL", "market"))
def expanding_z(v):
    return rounded(v.market.withColumn("z", series.expanding_z("ret", Window.orderBy("date"))).where("z IS NOT NULL AND ret IS NOT NULL").select("date", "z"))


@query("rolling_sharpe_12", sql("SELECT ticker, month, round(avg(mom_1m) OVER w / (stddev_samp(mom_1m) OVER w) * sqrt(12), 6) AS sharpe FROM mpanel WINDOW w AS (PARTITION BY ticker ORDER BY month ROWS 11 PRECEDING) QUALIFY count(mom_1m) OVER w = 12 AND stddev_samp(mom_1m) OVER w > 1e-12", "mpanel"))
def rolling_sharpe_12(v):
    d = v.mpanel.withColumn("sharpe", series.rolling_sharpe("mom_1m", R.ts("ticker", "month")))
    return rounded(d.where("sharpe IS NOT NULL").select("ticker", "month", "sharpe"))


@query("reference_drift", sql("SELECT date, round(abs(ret - avg(ret) OVER w) / stddev_pop(ret) OVER w, 6) AS drift FROM market WINDOW w AS (ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) QUALIFY count(ret) OVER w >= 60 AND ret IS NOT NULL", "market"))
def reference_drift(v):
    d = v.market.withColumn("drift", series.reference_drift(["ret"], Window.orderBy("date")))
    return rounded(d.where("drift IS NOT NULL").select("date", "drift"))


@query("change_rate", sql("SELECT ticker, count(*) AS n, CAST(sum((abs(d) > 1e-12)::INT) AS BIGINT) AS n_changed, round(avg((abs(d) > 1e-12)::INT), 6) AS change_rate, CAST(sum((d < 0)::INT) AS BIGINT) AS n_resets FROM (SELECT ticker, volume - lag(volume) OVER w AS d FROM bars " + W + ") WHERE d IS NOT NULL GROUP BY 1", "bars"))
def change_rate(v):
    return rounded(series.change_rate("volume", "ticker", "date", v.bars))


@query("split_detector", sql("SELECT ticker, date, close, prev_close, CASE " + " ".join(f"WHEN abs(prev_close / close / {x!r} - 1) <= 0.05 THEN {x!r}::DOUBLE" for n in series.SPLIT_RATIOS for x in (float(n), 1.0 / n)) + " END AS split_ratio FROM (SELECT *, lag(close) OVER w AS prev_close FROM bars " + W + ") WHERE split_ratio IS NOT NULL", "bars"))
def split_detector(v):
    return series.detect_splits(v.bars.select("ticker", "date", "close"), "close", "ticker", "date")


@query("price_discontinuities", sql("SELECT ticker, date, round(ret, 6) AS ret FROM (SELECT ticker, date, close / lag(close) OVER w - 1 AS ret FROM bars " + W + ") WHERE abs(ret) >= 0.2", "bars"))
def price_discontinuities(v):
    return rounded(series.discontinuities(v.bars, "close", "ticker", "date").select("ticker", "date", "ret"))


# Cross-sections ---------------------------------------------------------------------------

M = "month"


@query("cross_section_z", sql("SELECT ticker, month, round(CASE WHEN stddev_samp(mom_3m) OVER w > 0 THEN (mom_3m - avg(mom_3m) OVER w) / stddev_samp(mom_3m) OVER w ELSE 0 END, 6) AS z FROM mpanel WHERE mom_3m IS NOT NULL WINDOW w AS (PARTITION BY month)", "mpanel"))
def cross_section_z(v):
    return rounded(v.mpanel.where("mom_3m IS NOT NULL").select("ticker", "month", R.zscore("mom_3m", "month").alias("z")))


@query("percentile_ranks", sql(f"SELECT ticker, month, {r(pr('mom_3m', M))} AS p FROM mpanel WHERE mom_3m IS NOT NULL", "mpanel"))
def percentile_ranks(v):
    return rounded(v.mpanel.where("mom_3m IS NOT NULL").select("ticker", "month", R.pct_rank("mom_3m", "month").alias("p")))


@query("winsorized", sql("SELECT ticker, month, round(greatest(least(mom_1m, quantile_cont(mom_1m, 0.99) OVER w), quantile_cont(mom_1m, 0.01) OVER w), 6) AS x FROM mpanel WHERE mom_1m IS NOT NULL WINDOW w AS (PARTITION BY month)", "mpanel"))
def winsorized(v):
    return rounded(v.mpanel.where("mom_1m IS NOT NULL").select("ticker", "month", R.winsorize("mom_1m", "month").alias("x")))


@query("sector_relative", sql("SELECT ticker, month, round(mom_1m - quantile_cont(mom_1m, 0.5) OVER w, 6) AS neutral, CASE WHEN count(adv) OVER w >= 2 THEN round(adv / quantile_cont(adv, 0.5) OVER w - 1, 6) END AS relative FROM mpanel WHERE mom_1m IS NOT NULL WINDOW w AS (PARTITION BY month, sector)", "mpanel"))
def sector_relative(v):
    d = v.mpanel.where("mom_1m IS NOT NULL")
    return rounded(d.select("ticker", "month", cross.sector_neutral("mom_1m", "sector", "month").alias("neutral"), cross.sector_relative("adv", "sector", "month").alias("relative")))


@query(
    "factor_neutral",
    sql(
        "SELECT ticker, month, round(y - coalesce(sum(b * y) OVER m / nullif(sum(b * b) OVER m, 0), 0) * b, 6) AS neutral FROM (SELECT ticker, month, mom_12m - avg(mom_12m) OVER s AS y, vol_6m - avg(vol_6m) OVER s AS b, count(*) OVER (PARTITION BY month) AS n FROM mpanel WHERE mom_12m IS NOT NULL AND vol_6m IS NOT NULL AND sector IS NOT NULL WINDOW s AS (PARTITION BY month, sector)) WHERE n >= 5 WINDOW m AS (PARTITION BY month)",
        "mpanel",
    ),
)
def factor_neutral(v):
    d = v.mpanel.where("mom_12m IS NOT NULL AND vol_6m IS NOT NULL AND sector IS NOT NULL")
    d = labels.least_names(cross.neutralize(d, "mom_12m", ["month"], "sector", "vol_6m"), ["month"], 5)
    return rounded(d.select("ticker", "month", "neutral"))


@query("quantile_buckets", sql("SELECT as_of_date, horizon, ticker, CAST(len(list_filter(e[2:len(e)-1], lambda x: x < score)) AS INTEGER) AS bucket FROM (SELECT *, list_sort(list_distinct(quantile_cont(score, [0, 0.2, 0.4, 0.6, 0.8, 1]) OVER (PARTITION BY as_of_date, horizon))) AS e FROM ev)", "ev"))
def quantile_buckets(v):
    return R.bucket_by_edges(v.ev, "score", ["as_of_date", "horizon"], 5).select("as_of_date", "horizon", "ticker", F.col("bucket").cast("int").alias("bucket"))


@query("rank_losses", sql(f"SELECT as_of_date, horizon, ticker, round(abs(rank_actual - rank_score), 6) AS rank_loss, round(abs(excess_return - score), 6) AS mae_loss FROM ls0", "ls0"))
def rank_losses(v):
    return rounded(cross.rank_losses(v.ev, "score", "excess_return", ["as_of_date", "horizon"]).select("as_of_date", "horizon", "ticker", "rank_loss", "mae_loss"))


@query("rank_fusion", sql(f"SELECT ticker, month, round(({pr('mom_1m', M)} + {pr('mom_3m', M)} + {pr('vol_6m', M)}) / 3, 6) AS fused FROM (SELECT *, count(*) OVER (PARTITION BY month) AS n FROM mpanel WHERE vol_6m IS NOT NULL AND mom_3m IS NOT NULL AND mom_1m IS NOT NULL) WHERE n >= 3", "mpanel"))
def rank_fusion(v):
    d = labels.least_names(v.mpanel.where("vol_6m IS NOT NULL AND mom_3m IS NOT NULL AND mom_1m IS NOT NULL"), ["month"], 3)
    return rounded(d.select("ticker", "month", cross.fuse_ranks(["mom_1m", "mom_3m", "vol_6m"], "month").alias("fused")))


@query("vol_sizing", sql("SELECT as_of_date, horizon, ticker, round(CASE WHEN vol_6m IS NULL THEN score ELSE score * least(1.0, 0.05 / greatest(vol_6m, 0.01)) END, 6) AS sized FROM ev", "ev"))
def vol_sizing(v):
    return rounded(v.ev.select("as_of_date", "horizon", "ticker", S.size_by_volatility("score", "vol_6m", F.lit(0.05)).alias("sized")))


@query("uncertainty_capped", sql("SELECT as_of_date, horizon, ticker, round(score * CASE WHEN ehat_raw > quantile_cont(ehat_raw, 0.9) OVER (PARTITION BY as_of_date, horizon) THEN 0.7 ELSE 1 END, 6) AS capped FROM ls", "ls"))
def uncertainty_capped(v):
    return rounded(v.ls.select("as_of_date", "horizon", "ticker", cross.cap_uncertain("score", "ehat_raw", "as_of_date", "horizon").alias("capped")))


@query("residual_uncertainty", sql("SELECT as_of_date, horizon, ticker, round(CASE WHEN count(*) OVER w < 3 THEN 0 ELSE ehat_raw - avg(ehat_raw) OVER w - CASE WHEN var_pop(x) OVER w > 1e-15 THEN (covar_pop(ehat_raw, x) OVER w) / (var_pop(x) OVER w) ELSE 0 END * (x - avg(x) OVER w) END, 9) AS resid FROM (SELECT *, abs(rank_score - 0.5) * 2 AS x FROM ls) WINDOW w AS (PARTITION BY as_of_date, horizon)", "ls"))
def residual_uncertainty(v):
    return rounded(v.ls.select("as_of_date", "horizon", "ticker", cross.residual_uncertainty("ehat_raw", "rank_score", "as_of_date", "horizon").alias("resid")), 9)


@query("top_by_size", sql("SELECT month, ticker, position FROM (SELECT month, ticker, CAST(row_number() OVER (PARTITION BY month ORDER BY adv DESC, ticker) AS INTEGER) AS position FROM mpanel) WHERE position <= 10", "mpanel"))
def top_by_size(v):
    return cross.top_n(v.mpanel, "adv", 10, ["month"], "ticker").select("month", "ticker", "position")


@query("missing_profile", sql("SELECT ticker, month, round(((mom_1m IS NOT NULL)::INT + (mom_3m IS NOT NULL)::INT + (mom_6m IS NOT NULL)::INT + (mom_12m IS NOT NULL)::INT) / 4.0, 6) AS coverage_momentum, CAST((mom_1m IS NULL)::INT + (mom_3m IS NULL)::INT + (mom_6m IS NULL)::INT + (mom_12m IS NULL)::INT + (vol_6m IS NULL)::INT AS INTEGER) AS n_missing FROM mpanel", "mpanel"))
def missing_profile(v):
    d = cross.missing_profile(v.mpanel, {"momentum": ["mom_1m", "mom_3m", "mom_6m", "mom_12m"], "risk": ["vol_6m"]}, date="month")
    return rounded(d.select("ticker", "month", "coverage_momentum", "n_missing"))


# Point in time -----------------------------------------------------------------------------

ASOF = "(VALUES (DATE '1995-06-30'), (DATE '1996-06-30'), (DATE '1997-03-31')) t(as_of)"


@query(
    "bitemporal_read",
    sql(
        f"SELECT as_of, ticker, field, period_end, observed_at, value FROM (SELECT *, row_number() OVER (PARTITION BY as_of, ticker, field ORDER BY period_end DESC) AS k FROM (SELECT *, row_number() OVER (PARTITION BY as_of, ticker, field, period_end ORDER BY observed_at DESC, value DESC) AS j FROM statements JOIN {ASOF} ON observed_at <= as_of) WHERE j = 1) WHERE k = 1",
        "statements",
    ),
)
def bitemporal_read(v):
    d = pit.read_bitemporal(v.statements, v.dates("1995-06-30", "1996-06-30", "1997-03-31"))
    return d.select("as_of", "ticker", "field", "period_end", "observed_at", "value")


@query("asof_last_price", sql(f"SELECT as_of, ticker, arg_max(close, date) AS close, max(date) AS date FROM bars JOIN {ASOF} ON date <= as_of GROUP BY 1, 2", "bars"))
def asof_last_price(v):
    return pit.last_value(v.bars, v.dates("1995-06-30", "1996-06-30", "1997-03-31"), "ticker", "date", "close").select("as_of", "ticker", "close", "date")


@query("asof_average_volume", sql(f"SELECT as_of, ticker, round(avg(volume), 6) AS avg_volume, count(*) AS n_rows FROM (SELECT *, row_number() OVER (PARTITION BY as_of, ticker ORDER BY date DESC) AS k FROM bars JOIN {ASOF} ON date <= as_of) WHERE k <= 20 GROUP BY 1, 2", "bars"))
def asof_average_volume(v):
    return rounded(pit.average_of_last(v.bars, v.dates("1995-06-30", "1996-06-30", "1997-03-31"), "ticker", "date", "volume", 20))


@query("asof_join_filings", sql("SELECT m.ticker, m.month, s.value AS revenue, s.filing_date FROM mbars m ASOF LEFT JOIN (SELECT * FROM st0 WHERE field = 'revenue') s ON m.ticker = s.ticker AND m.month >= s.filing_date", "mbars", "st0"))
def asof_join_filings(v):
    s = v.statements.where("field = 'revenue' AND observed_at = filing_date").select("ticker", F.col("filing_date").alias("f"), F.col("value").alias("revenue"), "filing_date")
    return pit.asof_join(v.mbars.select("ticker", "month"), s, ["ticker"], "month", "f", ["revenue", "filing_date"])


@query("peer_z_at_filing", sql("SELECT ticker, filing_date, round(CASE WHEN n >= 5 AND sd > 1e-8 THEN (value - m) / sd END, 6) AS value_z FROM (SELECT a.ticker, a.filing_date, a.value, count(*) AS n, avg(x.ov) AS m, stddev_samp(x.ov) AS sd FROM f a JOIN (SELECT a.ticker AS t, a.filing_date AS d, b.ticker AS o, arg_max(b.value, b.filing_date) AS ov FROM f a JOIN f b ON a.sector = b.sector AND b.filing_date <= a.filing_date AND a.filing_date - b.filing_date <= 90 AND (b.ticker <> a.ticker OR b.filing_date = a.filing_date) GROUP BY 1, 2, 3) x ON x.t = a.ticker AND x.d = a.filing_date GROUP BY 1, 2, 3)", "st0", "sectors", f="SELECT ticker, filing_date, value, sector FROM st0 JOIN sectors USING (ticker) WHERE field = 'revenue'"))
def peer_z_at_filing(v):
    s = v.statements.where("field = 'revenue' AND observed_at = filing_date").join(v.sectors, "ticker").select("ticker", "sector", "filing_date", "value")
    return rounded(events.peer_z(s, "value", "ticker", "sector", "filing_date").select("ticker", "filing_date", "value_z"))


@query("ttm_fundamentals", sql("SELECT ticker, period_end, CASE WHEN count(*) OVER a = 4 THEN round(sum(revenue) OVER a, 2) END AS revenue_ttm, CASE WHEN count(*) OVER a = 4 AND count(*) OVER b = 4 THEN round(sum(revenue) OVER a / sum(revenue) OVER b - 1, 6) END AS revenue_growth, CASE WHEN count(*) OVER a = 4 THEN round(sum(income) OVER a / avg(equity) OVER a, 6) END AS roe FROM q0 WINDOW a AS (PARTITION BY ticker ORDER BY period_end ROWS 3 PRECEDING), b AS (PARTITION BY ticker ORDER BY period_end ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING)", "q0"))
def ttm_fundamentals(v):
    q = v.statements.where("observed_at = filing_date").groupBy("ticker", "period_end").pivot("field", ["revenue", "income", "equity"]).agg(F.max("value"))
    d = events.ttm(q)
    return d.select("ticker", "period_end", F.round("revenue_ttm", 2).alias("revenue_ttm"), F.round("revenue_growth", 6).alias("revenue_growth"), F.round("roe", 6).alias("roe"))


@query("event_recency", sql("SELECT ticker, event_date, max(value) AS value, count(*) AS n FROM pe GROUP BY 1, 2", "pe"))
def event_recency(v):
    return v.events.groupBy("ticker", "event_date").agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("n"))


@query("event_high_water", sql("SELECT ticker, max(event_date) AS last_date, CAST(max(event_date) + 1 AS DATE) AS next_start FROM pe GROUP BY 1", "pe"))
def event_high_water(v):
    return pit.high_water(v.events, "ticker", "event_date")


@query("latest_events", sql("SELECT event_id, ticker FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY event_date DESC, observed_at DESC, event_id) AS k FROM pe) WHERE k <= 3", "pe"))
def latest_events(v):
    return events.last_events(v.events, 3).select("event_id", "ticker")


@query("payload_numbers", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def payload_numbers(v):
    return v.events.select("event_id", S.payload_number("payload", "k").alias("k"))


@query("news_window_means", sql("SELECT p.event_id, round(avg(q.value), 6) AS mean_7d, count(q.value) AS n_7d FROM pe p LEFT JOIN pe q ON p.ticker = q.ticker AND q.event_date BETWEEN p.event_date - 7 AND p.event_date - 1 GROUP BY 1", "pe"))
def news_window_means(v):
    panel = v.events.select("event_id", "ticker", F.col("event_date").alias("date"))
    return rounded(events.window_mean(panel, v.events.select("ticker", "event_date", F.col("value").alias("score")), "ticker", "date", "score", 7, "mean_7d", "n_7d").select("event_id", "mean_7d", "n_7d"))


@query("score_distribution", sql("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max, CAST(sum((value > 0.05)::INT) AS BIGINT) AS n_pos, CAST(sum((value < -0.05)::INT) AS BIGINT) AS n_neg, CAST(sum((abs(value) <= 0.05)::INT) AS BIGINT) AS n_neutral FROM pe WHERE value IS NOT NULL GROUP BY 1", "pe"))
def score_distribution(v):
    d = events.score_distribution(v.events, "event_type", "value")
    return d.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std")], "min", "max", "n_pos", "n_neg", "n_neutral")


@query("lookback_windows", sql("SELECT as_of, ticker, CAST(len(a) AS BIGINT) AS n, round(list_sum(a) / len(a), 6) AS mean FROM (SELECT as_of, ticker, list(close ORDER BY date) AS a FROM (SELECT *, row_number() OVER (PARTITION BY as_of, ticker ORDER BY date DESC) AS k FROM bars JOIN " + ASOF + " ON date <= as_of) WHERE k <= 60 GROUP BY 1, 2) WHERE len(a) = 60", "bars"))
def lookback_windows(v):
    d = learn.lookback_windows(v.bars, v.dates("1995-06-30", "1996-06-30", "1997-03-31"), 60)
    return rounded(learn.forecast(d, name="mean").select("as_of", "ticker", F.size("values").cast("long").alias("n"), "mean"))


@query("pit_validation", sql("SELECT ticker, count(*) AS n, CAST(sum((observed_at IS NULL)::INT) AS BIGINT) AS n_missing, CAST(sum((observed_at < event_date)::INT) AS BIGINT) AS n_early FROM pe GROUP BY 1", "pe"))
def pit_validation(v):
    return audits.validate_pit(v.events, "ticker", "event_date").select("ticker", "n", "n_missing", "n_early")


@query("universe_cascade", sql("SELECT month, count(*) AS n_start, CAST(sum((reason = 'adv')::INT) AS BIGINT) AS n_adv, CAST(sum((reason = 'price')::INT) AS BIGINT) AS n_price, CAST(sum((reason = 'market_cap')::INT) AS BIGINT) AS n_market_cap, CAST(sum((reason = '')::INT) AS BIGINT) AS n_passed FROM (SELECT month, CASE WHEN adv < 5000 THEN 'adv' WHEN close < 1400 THEN 'price' WHEN volume < 60 THEN 'market_cap' ELSE '' END AS reason FROM mpanel) GROUP BY 1", "mpanel"))
def universe_cascade(v):
    d = v.mpanel.withColumn("exclusion_reason", universe.liquidity_cascade(cap="volume", least_adv=5000, least_price=1400, least_cap=60))
    return universe.stage_counts(d, ["month"], ["adv", "price", "market_cap"])


@query("panel_validation", sql("SELECT 'null:' || c AS check, CAST(n AS BIGINT) AS n_bad FROM (SELECT count(*) FILTER (mom_1m IS NULL) AS mom_1m, count(*) FILTER (mom_12m IS NULL) AS mom_12m FROM mpanel) UNPIVOT (n FOR c IN (mom_1m, mom_12m)) UNION ALL SELECT 'range:close', count(*) FROM mpanel WHERE close NOT BETWEEN 1000 AND 2000 UNION ALL SELECT 'duplicate_keys', 0", "mpanel"))
def panel_validation(v):
    return audits.validate_panel(v.mpanel, ["ticker", "month"], ["mom_1m", "mom_12m"], {"close": (1000, 2000)})


@query("quality_report", sql(" UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg(({f} IS NULL)::INT), 6) AS missing_share, round(avg({f}), 6) AS mean, round(stddev_samp({f}), 6) AS std, round(quantile_cont({f}, 0.001), 6) AS p001, round(quantile_cont({f}, 0.999), 6) AS p999 FROM mpanel" for f in ("mom_1m", "mom_12m", "vol_6m")), "mpanel"))
def quality_report(v):
    return rounded(audits.quality_report(v.mpanel, ["mom_1m", "mom_12m", "vol_6m"], "adv").select("feature", "missing_share", "mean", "std", "p001", "p999"))


@query("texts_clean", r"SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;|&#160;', ' ', 'g'), '&amp;', '&', 'g'), '\s+', ' ', 'g'))) AS n FROM pages")
def texts_clean(v):
    return v.table("pages").select("page_id", F.length(S.strip_html("html")).cast("long").alias("n"))


@query("sample_distributions", "SELECT vec_id, round(quantile_cont(x, 0.05), 6) AS p5, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.95), 6) AS p95, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1")
def sample_distributions(v):
    d = v.table("embeddings").withColumn("a", F.col("embedding").cast("array<double>"))
    return rounded(d.select("vec_id", S.sample_distribution("a").alias("d")).select("vec_id", "d.p5", "d.p50", "d.p95", "d.mean", "d.std"))
