"""Queries: aleatoric tiers, checks of uncertainty, health, policies on real health, models by folds, a stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ranks as R
from ..operators import evaluate, events, health, labels, learn, policy, stats, uncertainty
from ..streaming import streams
from .queries_panels import bucketed, rank_corr
from .registry import Views, ar, corr, pr, query, rounded
from .sqlviews import sql

K = "as_of_date, horizon"
KEYS = ["as_of_date", "horizon"]

# Aleatoric tiers ----------------------------------------------------------------------------------


@query("error_features", sql(f"SELECT as_of_date, horizon, ticker, round(abs(score), 6) AS abs_score, round({pr('score', K)}, 6) AS score_pct, CASE WHEN sector = 'ASIA' THEN 1 WHEN sector = 'AFRICA' THEN -1 ELSE 0 END AS regime_code FROM ev", "ev"))
def error_features(v: Views):
    named = v.ev.withColumn("market_regime", F.when(F.col("sector") == "ASIA", "bull").when(F.col("sector") == "AFRICA", "bear").otherwise("neutral"))
    return rounded(uncertainty.error_features(named).select(*KEYS, "ticker", "abs_score", "score_pct", "regime_code"))


IQR = "quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)"


@query("tier_zero", sql(f"SELECT as_of_date, horizon, CASE WHEN i > 1e-12 THEN round(1 / i, 6) END AS a_value FROM (SELECT as_of_date, horizon, {IQR.format(x='excess_return')} AS i FROM ev GROUP BY 1, 2)", "ev"))
def tier_zero(v):
    return rounded(uncertainty.tier0(v.ev))


@query("loss_floor", sql("SELECT as_of_date, horizon, round(quantile_cont(rank_loss, 0.1), 6) AS a_value FROM ls GROUP BY 1, 2", "ls"))
def loss_floor(v):
    return rounded(uncertainty.loss_floor(v.ls))


CUT = "DATE '1998-01-01'"
CELLS = f"SELECT *, (vol_6m > c[1])::INT + (vol_6m > c[2])::INT + (vol_6m > c[3])::INT AS b FROM ev, (SELECT quantile_cont(vol_6m, [0.25, 0.5, 0.75]) AS c FROM ev WHERE as_of_date < {CUT}) WHERE vol_6m IS NOT NULL"


@query("conditional_range", sql(f"SELECT as_of_date, horizon, ticker, round(CASE WHEN n >= 30 THEN v ELSE w END, 6) AS a_value FROM ce JOIN (SELECT b, count(*) AS n, {IQR.format(x='excess_return')} AS v FROM ce WHERE as_of_date < {CUT} GROUP BY 1) USING (b), (SELECT {IQR.format(x='excess_return')} AS w FROM ce WHERE as_of_date < {CUT}) WHERE as_of_date >= {CUT}", "ev", ce=CELLS))
def conditional_range(v):
    d = v.kept_ev.where("vol_6m IS NOT NULL")
    cut = F.lit("1998-01-01").cast("date")
    return rounded(uncertainty.conditional_range(d.where(F.col("as_of_date") < cut), d.where(F.col("as_of_date") >= cut), ["vol_6m"], "excess_return").select(*KEYS, "ticker", "a_value"))


@query("aleatoric_alignment", sql(f"SELECT horizon, round(rho, 6) AS rho, round(low, 6) AS low, round(high, 6) AS high, rho >= 0.1 AND high > low AS aligned FROM ({rank_corr('ls', 'vol_6m', 'rank_loss', 'horizon')}) JOIN (SELECT horizon, quantile_cont(rank_loss, 0.5) FILTER (bucket = 0) AS low, quantile_cont(rank_loss, 0.5) FILTER (bucket = 4) AS high FROM bk GROUP BY 1) USING (horizon)", "ls", bk=bucketed("ls", "vol_6m", "horizon", 5)))
def aleatoric_alignment(v):
    return rounded(uncertainty.alignment(v.kept_ls, "vol_6m", "rank_loss", ["horizon"]).select("horizon", "rho", "low", "high", "aligned"))


@query("picked_tier", sql(f"SELECT as_of_date, horizon, round(arg_max(a, t), 6) AS a_value, CAST(max(t) AS INTEGER) AS a_tier FROM (SELECT as_of_date, horizon, 0 AS t, 1 / ({IQR.format(x='excess_return')}) AS a FROM ev GROUP BY 1, 2 UNION ALL SELECT as_of_date, horizon, 1, quantile_cont(rank_loss, 0.1) FROM ls WHERE month(as_of_date) % 2 = 0 GROUP BY 1, 2) WHERE a IS NOT NULL GROUP BY 1, 2", "ev", "ls"))
def picked_tier(v):
    t0 = uncertainty.tier0(v.ev).withColumn("a_tier", F.lit(0))
    t1 = uncertainty.loss_floor(v.ls.where("month(as_of_date) % 2 = 0")).withColumn("a_tier", F.lit(1))
    return rounded(uncertainty.pick_tier(t0.unionByName(t1)))


# The epistemic part ---------------------------------------------------------------------------------

AV = "SELECT as_of_date, horizon, quantile_cont(rank_loss, 0.1) AS a FROM ls GROUP BY 1, 2"


@query("epistemic_scaled", sql("SELECT as_of_date, horizon, ticker, round(greatest(g_pred - a * r, 0), 6) AS ehat_raw FROM ls JOIN av USING (as_of_date, horizon), (SELECT quantile_cont(g_pred, 0.5) / quantile_cont(a, 0.5) AS r FROM ls JOIN av USING (as_of_date, horizon))", "ls", av=AV))
def epistemic_scaled(v):
    d = uncertainty.epistemic_scaled(v.kept_ls.drop("a_value", "ehat_raw"), uncertainty.loss_floor(v.kept_ls))
    return rounded(d.select(*KEYS, "ticker", "ehat_raw"))


@query("epistemic_filled", sql("SELECT as_of_date, horizon, ticker, round(greatest(g_pred - coalesce(a, m), 0), 5) AS ehat_raw FROM ls LEFT JOIN (SELECT * FROM av WHERE month(as_of_date) % 2 = 0) USING (as_of_date, horizon), (SELECT quantile_cont(a, 0.5) AS m FROM av WHERE month(as_of_date) % 2 = 0)", "ls", av=AV))
def epistemic_filled(v):
    a = uncertainty.loss_floor(v.ls.where("month(as_of_date) % 2 = 0"))
    return rounded(uncertainty.epistemic_filled(v.ls.drop("a_value", "ehat_raw"), a).select(*KEYS, "ticker", "ehat_raw"), 5)


@query("uncertainty_checks", sql(f"SELECT horizon, p90 > 0 AS not_degenerate, z <= 0.9 AS not_mostly_zero, rho > 0 AS ranks_losses, p90 > 0 AND z <= 0.9 AND rho > 0 AS all_passed, round(rho, 6) AS rho_loss FROM (SELECT horizon, quantile_cont(ehat_raw, 0.9) AS p90, avg((ehat_raw = 0)::INT) AS z FROM ls GROUP BY 1) JOIN ({rank_corr('ls', 'ehat_raw', 'rank_loss', 'horizon')}) USING (horizon)", "ls"))
def uncertainty_checks(v):
    d = uncertainty.ehat_checks(uncertainty.ehat_diagnostics(v.kept_ls, ["horizon"]))
    return rounded(d.select("horizon", "not_degenerate", "not_mostly_zero", "ranks_losses", "all_passed", "rho_loss"))


PART = "SELECT horizon, round(ehat_raw - avg(ehat_raw) OVER h - (covar_pop(ehat_raw, vol_6m) OVER h) / (var_pop(vol_6m) OVER h) * (vol_6m - avg(vol_6m) OVER h), 10) AS x, round(rank_loss - avg(rank_loss) OVER h - (covar_pop(rank_loss, vol_6m) OVER h) / (var_pop(vol_6m) OVER h) * (vol_6m - avg(vol_6m) OVER h), 10) AS y FROM ls WHERE vol_6m IS NOT NULL WINDOW h AS (PARTITION BY horizon)"


@query("partial_diagnostic", sql(f"SELECT horizon, round(rho, 3) AS partial_rho, n FROM ({rank_corr('pt', 'x', 'y', 'horizon')})", "ls", pt=PART))
def partial_diagnostic(v):
    return rounded(uncertainty.partial_diagnostic(v.ls, ["horizon"], ["vol_6m"]).select("horizon", "partial_rho", "n"), 3)


@query("predictor_comparison", sql(" UNION ALL ".join(f"SELECT '{p}' AS predictor, horizon, round(rho, 6) AS rho, n FROM ({rank_corr('ls', p, 'rank_loss', 'horizon')})" for p in ("ehat_raw", "g_pred", "vol_6m")), "ls"))
def predictor_comparison(v):
    return rounded(uncertainty.predictor_comparison(v.kept_ls, ["ehat_raw", "g_pred", "vol_6m"], ["horizon"]).select("predictor", "horizon", "rho", "n"))


@query("importance_shares", sql("SELECT category, round(importance, 6) AS importance, round(importance / sum(importance) OVER (), 6) AS share FROM (SELECT CASE WHEN f = 'vol_6m' THEN 'risk' ELSE 'other' END AS category, sum(i) AS importance FROM (SELECT 'vol_6m' AS f, abs(covar_pop(vol_6m, excess_return)) AS i FROM ev UNION ALL SELECT 'score', abs(covar_pop(score, excess_return)) FROM ev UNION ALL SELECT 'mom_1m', abs(covar_pop(mom_1m, excess_return)) FROM ev) GROUP BY 1)", "ev"))
def importance_shares(v):
    each = F.array(*[F.struct(F.lit(f).alias("feature"), F.abs(F.covar_pop(f, "excess_return")).alias("importance")) for f in ("vol_6m", "score", "mom_1m")])
    kinds = v.spark.createDataFrame([("vol_6m", "risk")], "feature string, category string")
    return rounded(uncertainty.importance_shares(v.ev.agg(each.alias("x")).select(F.inline("x")), kinds))


@query("stability_by_condition", sql(f"SELECT 'early' AS condition, horizon, round(rho, 6) AS rho, n FROM ({rank_corr('(SELECT * FROM ls WHERE as_of_date < ' + CUT + ')', 'ehat_raw', 'rank_loss', 'horizon')}) UNION ALL SELECT 'liquid', horizon, round(rho, 6), n FROM ({rank_corr('(SELECT * FROM ls WHERE adv > 5000)', 'ehat_raw', 'rank_loss', 'horizon')})", "ls"))
def stability_by_condition(v):
    c = {"early": F.col("as_of_date") < F.lit("1998-01-01").cast("date"), "liquid": F.col("adv") > 5000}
    return rounded(uncertainty.stability(v.ls, c, ["horizon"]).select("condition", "horizon", "rho", "n"))


@query("monthly_uncertainty", sql("SELECT CAST(date_trunc('month', as_of_date) AS DATE) AS month, round(avg(g), 6) AS g, round(avg(e), 6) AS e, count(*) AS n FROM (SELECT as_of_date, horizon, avg(g_pred) AS g, avg(ehat_raw) AS e FROM ls GROUP BY 1, 2) GROUP BY 1", "ls"))
def monthly_uncertainty(v):
    daily = v.ls.groupBy(*KEYS).agg(F.avg("g_pred").alias("g"), F.avg("ehat_raw").alias("e"))
    return rounded(uncertainty.monthly_regime_table(daily, ["g", "e"]))


IDX = "SELECT horizon, as_of_date, row_number() OVER (PARTITION BY horizon ORDER BY as_of_date) AS i FROM (SELECT DISTINCT horizon, as_of_date FROM ls)"
CONF = "SELECT d.horizon, d.as_of_date, v[CAST(least(ceil((len(v) + 1) * (1 - 0.1::DOUBLE)), len(v)) AS INT)] AS threshold FROM (SELECT a.horizon, a.i, list(l.s ORDER BY l.s) AS v FROM idx a JOIN idx b ON a.horizon = b.horizon AND b.i BETWEEN a.i - 12 AND a.i - 1 JOIN sc l ON l.horizon = b.horizon AND l.as_of_date = b.as_of_date GROUP BY 1, 2 HAVING count(DISTINCT b.i) >= 6) g JOIN idx d ON d.horizon = g.horizon AND d.i = g.i"


@query("conformal_coverage", sql("SELECT horizon, count(*) AS n, round(avg((s <= threshold)::INT), 6) AS coverage, round(avg(threshold * greatest(ehat_raw, 1e-3)), 6) AS mean_width, round(avg((s <= threshold)::INT) - 0.9, 6) AS gap FROM sc JOIN cf USING (horizon, as_of_date) GROUP BY 1", "ls", idx=IDX, sc="SELECT *, rank_loss / greatest(coalesce(ehat_raw, 0), 1e-3) AS s FROM ls", cf=CONF))
def conformal_coverage(v):
    return rounded(uncertainty.coverage(uncertainty.conformal(v.kept_ls, "ehat", 0.1, 12, 6), ["horizon"]))


# Health -------------------------------------------------------------------------------------------

DAY = "SELECT horizon, as_of_date, coalesce(rank_ic, 0) AS daily_ic, row_number() OVER (PARTITION BY horizon ORDER BY as_of_date) AS i FROM ic"
REAL = "SELECT a.horizon, a.as_of_date, a.daily_ic, a.i, sum(b.m * pow(2.0, (b.i - a.i) / 30.0)) / sum(CASE WHEN b.m IS NOT NULL THEN pow(2.0, (b.i - a.i) / 30.0) END) AS raw, count(b.m) AS k FROM mt a JOIN mt b ON a.horizon = b.horizon AND b.i <= a.i GROUP BY 1, 2, 3, 4"
MAT = "SELECT *, lag(daily_ic, 2) OVER (PARTITION BY horizon ORDER BY as_of_date) AS m FROM dy"
HR = "SELECT horizon, as_of_date, daily_ic, CASE WHEN k >= 6 THEN raw END AS h FROM rl"
HC = "SELECT *, 1 / (1 + exp(-z)) AS c, greatest(least((1 / (1 + exp(-z)) - 0.3) / 0.4, 1.0), 0.0) AS g FROM (SELECT *, coalesce(CASE WHEN count(h) OVER w >= 12 THEN greatest(least((h - avg(h) OVER w) / nullif(stddev_samp(h) OVER w, 0), 3.0), -3.0) END, 0) AS z FROM hr WINDOW w AS (PARTITION BY horizon ORDER BY as_of_date ROWS UNBOUNDED PRECEDING))"
HEALTH = {"dy": DAY, "mt": MAT, "rl": REAL, "hr": HR, "hc": HC}


def real_health(v):
    return health.combine(health.realized(health.daily_ic(v.ev), 2, least=6), least=12)


@query("health_gate", sql("SELECT horizon, as_of_date, round(h, 6) AS H_realized, round(c, 6) AS H_combined, round(g, 6) AS G_exposure FROM hc", "ic", **HEALTH))
def health_gate(v):
    return rounded(real_health(v).select("horizon", "as_of_date", "H_realized", "H_combined", "G_exposure"))


@query("health_diagnostics", sql(f"SELECT horizon, round((sum(rk) FILTER (y = 1) - p * (p + 1) / 2.0) / (p * q), 6) AS auroc, round(max(rho), 6) AS rho FROM (SELECT horizon, y, rank() OVER (PARTITION BY horizon ORDER BY x) + (count(*) OVER (PARTITION BY horizon, x) - 1) / 2.0 AS rk, sum(y) OVER (PARTITION BY horizon) AS p, sum(1 - y) OVER (PARTITION BY horizon) AS q FROM (SELECT horizon, round(g, 9) AS x, (daily_ic > 0)::INT AS y FROM hc)) JOIN ({rank_corr('(SELECT *, round(g, 9) AS x FROM hc)', 'x', 'daily_ic', 'horizon')}) USING (horizon) GROUP BY horizon, p, q", "ic", **HEALTH))
def health_diagnostics(v):
    d = real_health(v).withColumn("G_exposure", F.round("G_exposure", 9))
    return rounded(health.health_diagnostics(d, ["horizon"]).select("horizon", "auroc", "rho"))


TRUST = "SELECT horizon, p AS predictor, x, (daily_ic > 0)::INT AS y FROM (SELECT horizon, daily_ic, 'G_exposure' AS p, round(g, 9) AS x FROM hc UNION ALL SELECT horizon, daily_ic, 'H_combined', round(c, 9) FROM hc)"


@query("regime_trust", sql("SELECT horizon, predictor, round(a.auroc, 6) AS auroc, round(ap, 6) AS auprc, round(precision, 6) AS precision, round(recall, 6) AS recall, round(abstention, 6) AS abstention FROM (SELECT horizon, predictor, (sum(rk) FILTER (y = 1) - p * (p + 1) / 2.0) / (p * q) AS auroc FROM (SELECT *, rank() OVER (PARTITION BY horizon, predictor ORDER BY x) + (count(*) OVER (PARTITION BY horizon, predictor, x) - 1) / 2.0 AS rk, sum(y) OVER (PARTITION BY horizon, predictor) AS p, sum(1 - y) OVER (PARTITION BY horizon, predictor) AS q FROM tr) GROUP BY horizon, predictor, p, q) a JOIN (SELECT horizon, predictor, sum(p * tp / (allp * total)) AS ap FROM (SELECT horizon, predictor, p, sum(p) OVER w AS tp, sum(n) OVER w AS allp, sum(p) OVER (PARTITION BY horizon, predictor) AS total FROM (SELECT horizon, predictor, x, sum(y) AS p, count(*) AS n FROM tr GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY horizon, predictor ORDER BY x DESC ROWS UNBOUNDED PRECEDING)) GROUP BY 1, 2) USING (horizon, predictor) JOIN (SELECT horizon, predictor, count(*) FILTER (y = 1 AND x >= 0.2) / CAST(nullif(count(*) FILTER (x >= 0.2), 0) AS DOUBLE) AS precision, count(*) FILTER (y = 1 AND x >= 0.2) / CAST(nullif(count(*) FILTER (y = 1), 0) AS DOUBLE) AS recall, count(*) FILTER (x < 0.2) / CAST(count(*) AS DOUBLE) AS abstention FROM tr GROUP BY 1, 2) USING (horizon, predictor)", "ic", **HEALTH, tr=TRUST))
def regime_trust(v):
    d = real_health(v)
    d = d.withColumns({c: F.round(c, 9) for c in ("G_exposure", "H_combined")})
    return rounded(health.regime_trust(d, ["G_exposure", "H_combined"], ["horizon"]).select("horizon", "predictor", "auroc", "auprc", "precision", "recall", "abstention"))


SDRIFT = "SELECT d.horizon, d.as_of_date, max(abs(ca / na - cb / nb)) AS ks, max(na) AS na, max(nb) AS nb FROM (SELECT horizon, i, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY horizon, i) AS na, sum(b) OVER (PARTITION BY horizon, i) AS nb FROM (SELECT horizon, i, score, CAST(sum(a) AS DOUBLE) AS a, CAST(sum(b) AS DOUBLE) AS b FROM (SELECT t.horizon, t.i, e.score, 1 AS a, 0 AS b FROM ei t JOIN ev e USING (horizon, as_of_date) UNION ALL SELECT t.horizon, t.i, e.score, 0, 1 FROM ei t JOIN ei s ON t.horizon = s.horizon AND s.i BETWEEN t.i - 6 AND t.i - 1 JOIN ev e ON e.horizon = s.horizon AND e.as_of_date = s.as_of_date) GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY horizon, i ORDER BY score ROWS UNBOUNDED PRECEDING)) g JOIN ei d USING (horizon, i) GROUP BY 1, 2"
EI = "SELECT horizon, as_of_date, row_number() OVER (PARTITION BY horizon ORDER BY as_of_date) AS i FROM (SELECT DISTINCT horizon, as_of_date FROM ev)"


@query("score_drift", sql("SELECT horizon, as_of_date, CASE WHEN na > 20 AND nb > 5 THEN round(ks, 6) END AS ks FROM sd", "ev", ei=EI, sd=SDRIFT))
def score_drift(v):
    return rounded(health.score_drift(v.kept_ev, dates=6))


FD = "SELECT horizon, as_of_date, CASE WHEN k >= 12 THEN abs(m - mu) / sd END AS fd FROM (SELECT horizon, as_of_date, m, count(m) OVER w AS k, avg(m) OVER w AS mu, stddev_pop(m) OVER w AS sd FROM (SELECT horizon, as_of_date, avg(vol_6m) AS m FROM ev GROUP BY 1, 2) WINDOW w AS (PARTITION BY horizon ORDER BY as_of_date ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))"


@query("drift_composite", sql("SELECT horizon, as_of_date, round(fd, 6) AS feature_drift, round(0.4 * coalesce(fd, 0) + 0.3 * coalesce(CASE WHEN na > 20 AND nb > 5 THEN ks END, 0), 6) AS H_drift FROM fdr JOIN sd USING (horizon, as_of_date)", "ev", ei=EI, sd=SDRIFT, fdr=FD))
def drift_composite(v):
    d = health.feature_drift(v.kept_ev, ["vol_6m"], n=24, least=12).join(health.score_drift(v.kept_ev, dates=6), ["horizon", "as_of_date"])
    d = health.drift_composite(d.withColumn("mean_corr", F.lit(None).cast("double")))
    return rounded(d.select("horizon", "as_of_date", "feature_drift", "H_drift"))


@query("pair_correlation_with_gaps", sql("SELECT d.month, round(avg(r), 6) AS mean_corr, count(*) AS n_pairs FROM (SELECT t.i AS t, a.ticker, b.ticker, corr(a.x, b.x) AS r FROM px a JOIN px b ON a.i = b.i AND a.ticker < b.ticker JOIN mx t ON a.i BETWEEN t.i - 11 AND t.i GROUP BY 1, 2, 3 HAVING count(*) >= 3) g JOIN mx d ON d.i = g.t GROUP BY 1", "mpanel", mx="SELECT month, row_number() OVER (ORDER BY month) AS i FROM (SELECT DISTINCT month FROM mpanel WHERE mom_3m > 0)", px="SELECT ticker, i, mom_1m AS x FROM mpanel JOIN mx USING (month) WHERE mom_1m IS NOT NULL AND mom_3m > 0"))
def pair_correlation_with_gaps(v):
    """Of names in the months in which they rose over three: each pair over the months that both have."""
    return rounded(health.correlation_level(v.mpanel.where("mom_3m > 0"), "mom_1m", "ticker", "month", 12, 3))


@query("pair_correlation_level", sql("SELECT d.month, round((q / 12 - n) / (n * (n - 1)), 6) AS mean_corr, n AS n_entities FROM (SELECT t, sum(z * z) AS q, max(k) AS n FROM (SELECT t, i, sum(zz) AS z, count(*) AS k FROM (SELECT t, i, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS zz, count(*) OVER w AS c FROM (SELECT b.i AS t, a.i, p.ticker, p.mom_1m AS x FROM mx a JOIN mx b ON b.i BETWEEN a.i AND a.i + 11 JOIN mpanel p ON p.month = a.month WHERE p.mom_1m IS NOT NULL) WINDOW w AS (PARTITION BY t, ticker)) WHERE c = 12 GROUP BY 1, 2) GROUP BY 1 HAVING max(k) > 1) g JOIN mx d ON d.i = g.t", "mpanel", mx="SELECT month, row_number() OVER (ORDER BY month) AS i FROM (SELECT DISTINCT month FROM mpanel)"))
def pair_correlation_level(v):
    return rounded(stats.mean_pair_correlation(v.mpanel, "mom_1m", "ticker", "month", 12).where("n_entities > 1"))


OTHER = "SELECT *, vol_6m AS s1, mom_1m AS s2 FROM ev"


@query("model_disagreement", sql(f"SELECT horizon, as_of_date, round(1 - avg(rho), 6) AS H_disagree FROM (SELECT * FROM ({rank_corr('ot', 'score', 's1', K)}) UNION ALL SELECT * FROM ({rank_corr('ot', 'score', 's2', K)})) GROUP BY 1, 2", "ev", ot=OTHER))
def model_disagreement(v):
    others = v.ev.unpivot(["horizon", "as_of_date", "ticker"], ["vol_6m", "mom_1m"], "model", "score").where("score IS NOT NULL")
    return rounded(health.model_disagreement(v.ev, others))


@query("dispersion_disagreement", sql("SELECT horizon, as_of_date, round(s / nullif(avg(s) OVER (PARTITION BY horizon ORDER BY as_of_date ROWS UNBOUNDED PRECEDING), 0) - 1, 6) AS H_disagree FROM (SELECT horizon, as_of_date, stddev_samp(score) AS s FROM ev GROUP BY 1, 2)", "ev"))
def dispersion_disagreement(v):
    return rounded(health.dispersion_disagreement(v.ev))


@query("gate_buckets", sql("SELECT horizon, bucket, count(*) AS n, round(avg(x), 6) AS mean_gate, round(avg(daily_ic), 6) AS mean_return, round(avg((daily_ic > 0)::INT), 6) AS hit_rate FROM bk WHERE bucket IS NOT NULL GROUP BY 1, 2", "ic", **HEALTH, hx="SELECT *, round(c, 9) AS x FROM hc", bk=bucketed("hx", "x", "horizon", 4)))
def gate_buckets(v):
    d = real_health(v).withColumn("H_combined", F.round("H_combined", 9))
    return rounded(health.gate_buckets(d, "H_combined", "daily_ic", ["horizon"]))


# Policies on real health ------------------------------------------------------------------------------

PIN = "SELECT l.*, coalesce(round(h.g, 9), 1.0) AS g, coalesce(round(h.h, 9), 0.0) AS hr FROM (SELECT * FROM ls WHERE horizon = 20) l LEFT JOIN (SELECT * FROM hc WHERE horizon = 20) h USING (as_of_date)"
RESID = "greatest(CASE WHEN count(*) OVER w < 3 THEN 0 ELSE ehat_raw - avg(ehat_raw) OVER w - CASE WHEN var_pop(x) OVER w > 1e-15 THEN (covar_pop(ehat_raw, x) OVER w) / (var_pop(x) OVER w) ELSE 0 END * (x - avg(x) OVER w) END, 0)"
PVAR = (
    f"SELECT *, {RESID} AS res, score * CASE WHEN ehat_raw > quantile_cont(ehat_raw, 0.9) OVER w THEN 0.7 ELSE 1 END AS cap, CASE WHEN vol_6m IS NULL THEN score ELSE score * least(1.0, 0.05 / greatest(vol_6m, 0.01)) END AS vol FROM (SELECT *, abs(rank_score - 0.5) * 2 AS x FROM pin) WINDOW w AS (PARTITION BY as_of_date)"
)
PROW = " UNION ALL ".join(
    f"SELECT as_of_date, ticker, excess_return, '{n}' AS variant, round({lo}, 9) AS lo, round({sh}, 9) AS sh, {on} AS active FROM pv"
    for n, lo, sh, on in (
        ("raw", "score", "score", "TRUE"), ("gate_raw", "score", "score", "g >= 0.2"), ("gate_vol", "vol", "vol", "g >= 0.2"), ("gate_ua_sort", "score + 0.5 * g_pred", "score - 0.5 * g_pred", "g >= 0.2"),
        ("gate_resid", "score * least(1.0, 0.3 / sqrt(res + 1e-4))", "score * least(1.0, 0.3 / sqrt(res + 1e-4))", "g >= 0.2"), ("gate_cap", "cap", "cap", "g >= 0.2"), ("trail_ic", "score", "score", "hr > 0"),
    )
)
PBOOK = "SELECT variant, as_of_date, list(ticker) FILTER (a <= 10) AS l, list(ticker) FILTER (b <= 10) AS s, avg(excess_return) FILTER (a <= 10) - avg(excess_return) FILTER (b <= 10) AS r FROM (SELECT *, row_number() OVER (PARTITION BY variant, as_of_date ORDER BY lo DESC, ticker) AS a, row_number() OVER (PARTITION BY variant, as_of_date ORDER BY sh, ticker) AS b, count(*) OVER (PARTITION BY variant, as_of_date) AS n FROM pr WHERE active) WHERE n >= 20 GROUP BY 1, 2"
PDAY = "SELECT d.variant, d.as_of_date, l, s, r, sum((d.o = 0)::INT) OVER (PARTITION BY d.variant ORDER BY d.as_of_date ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT variant, as_of_date, max(active::INT) AS o FROM pr GROUP BY 1, 2) d LEFT JOIN pb USING (variant, as_of_date)"
PSER = "SELECT variant, as_of_date, l IS NULL AS flat, CASE WHEN l IS NULL THEN 0.0 ELSE 1 - (coalesce(len(list_intersect(l, pl)), 0) + coalesce(len(list_intersect(s, ps)), 0)) / 20.0 END AS turnover, coalesce(r, 0) AS ls_return FROM (SELECT *, last_value(l IGNORE NULLS) OVER w AS pl, last_value(s IGNORE NULLS) OVER w AS ps FROM pd WINDOW w AS (PARTITION BY variant, run ORDER BY as_of_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
POLICY = HEALTH | {"pin": PIN, "pv": PVAR, "pr": PROW, "pb": PBOOK, "pd": PDAY}


def real_policy_inputs(v):
    h = real_health(v).where("horizon = 20").select("as_of_date", F.round("G_exposure", 9).alias("G_exposure"), F.round("H_realized", 9).alias("H_realized"))
    return policy.policy_inputs(v.ls, v.ls, h, 20)


@query("policy_on_health", sql("SELECT variant, as_of_date, flat, round(turnover, 6) AS turnover, round(ls_return, 6) AS ls_return, round(ls_return - 0.002 * turnover, 6) AS ls_return_net FROM ps", "ls", "ic", **POLICY, ps=PSER))
def policy_on_health(v):
    scored = policy.variant_scores(real_policy_inputs(v))
    scored = scored.withColumns({c: F.round(c, 9) for c in ("long_score", "short_score")})
    return rounded(policy.policy_series(scored, 10).select("variant", "as_of_date", "flat", "turnover", "ls_return", "ls_return_net"))


def fixed_gate(g: str) -> str:
    """Policy inputs with a given gate, in SQL."""
    return f"SELECT *, {g} AS g, 0.1 AS hr FROM ls WHERE horizon = 20"


GRID = "SELECT * FROM (VALUES ('a', 0.0::DOUBLE, 0.8::DOUBLE), ('b', 0.0, 0.9), ('c', 0.5, 0.8), ('d', 0.5, 0.9)) t(variant, lam, cap)"
GROW = "SELECT as_of_date, ticker, excess_return, variant, cs + lam * g_pred AS lo, cs - lam * g_pred AS sh, g >= 0.2 AS active FROM (SELECT *, score * CASE WHEN percent_rank() OVER (PARTITION BY as_of_date, variant ORDER BY ehat_raw) > cap THEN 0.7 ELSE 1 END AS cs FROM pin, grid WHERE as_of_date < DATE '2000-01-01')"
GSQL = HEALTH | {"pin": PIN, "grid": GRID, "pr": GROW, "pb": PBOOK, "pd": PDAY, "ps": PSER}


@query("policy_grid_on_health", sql("SELECT lam, cap_percentile, cap_weight, round(sharpe, 6) AS sharpe, n, row_number() OVER (ORDER BY sharpe DESC NULLS LAST, lam, cap_percentile) = 1 AS best FROM (SELECT lam, cap AS cap_percentile, 0.7::DOUBLE AS cap_weight, avg(x) / stddev_samp(x) * sqrt(12) AS sharpe, count(*) AS n FROM (SELECT variant, ls_return - 0.002 * turnover AS x FROM ps) JOIN grid USING (variant) GROUP BY 1, 2)", "ls", "ic", **GSQL))
def policy_grid_on_health(v):
    grid = v.spark.createDataFrame([(l_, p, w) for l_ in (0.0, 0.5) for p in (0.8, 0.9) for w in (0.7,)], "lam double, cap_percentile double, cap_weight double")
    return rounded(policy.calibrate(real_policy_inputs(v), grid, 10, "2000-01-01"))


@query("policy_conflict_by_date", sql(f"SELECT as_of_date, round({corr('ehat_raw', 's')}, 6) AS rho, count(*) AS n FROM (SELECT as_of_date, ehat_raw, abs(score) AS s FROM ls WHERE horizon = 20) GROUP BY 1", "ls"))
def policy_conflict_by_date(v):
    return rounded(policy.conflict_by_date(v.ls.where("horizon = 20")))


@query("policy_conflict_verdict", sql(f"SELECT round(quantile_cont(rho, 0.5), 6) AS median_rho, count(*) AS n_dates, quantile_cont(rho, 0.5) > 0.05 AS conflict FROM (SELECT as_of_date, {corr('ehat_raw', 's')} AS rho FROM (SELECT as_of_date, ehat_raw, abs(score) AS s FROM ls WHERE horizon = 20) GROUP BY 1)", "ls"))
def policy_conflict_verdict(v):
    return rounded(policy.conflict_verdict(policy.conflict_by_date(v.ls.where("horizon = 20"))))


@query("trailing_constant", sql("SELECT round(0.7 * quantile_cont(sqrt(greatest(ehat_raw, 0) + 1e-4), 0.5), 6) AS constant FROM ls WHERE as_of_date < DATE '1999-01-01'", "ls"))
def trailing_constant(v):
    return rounded(policy.trailing_constant(v.ls, until="1999-01-01"))


# Models ---------------------------------------------------------------------------------------------


@query("retrain_comparison", sql(f"SELECT as_of_date, horizon, round(a.rank_ic, 6) AS old_ic, round(b.rank_ic, 6) AS new_ic, round(b.rank_ic - a.rank_ic, 6) AS gain FROM ({rank_corr('ev', 'score', 'excess_return', K, 'rank_ic')}) a JOIN ({rank_corr('ev', 'mom_1m', 'excess_return', K, 'rank_ic')}) b USING (as_of_date, horizon)", "ev"))
def retrain_comparison(v):
    new = v.ev.drop("score").withColumn("score", F.col("mom_1m"))
    return rounded(learn.retrain_comparison(v.ev, new, KEYS))


STK = "SELECT *, {a} AS r1, {b} AS r2, as_of_date + 30 AS known FROM ev WHERE horizon = 20 AND mom_1m IS NOT NULL".format(a=pr("score", K), b=pr("mom_1m", K))
STF = "(VALUES ('s1', DATE '1997-07-01', DATE '1998-07-01'), ('s2', DATE '1998-07-01', DATE '1999-07-01')) f(fold, a, b)"


@query("stacked_scores", sql(f"SELECT fold AS fold_id, as_of_date, ticker, round(my + w1 * (r1 - m1) + w2 * (r2 - m2), 6) AS score FROM (SELECT *, ((d + 1) * p - c * q) / ((e + 1) * (d + 1) - c * c) AS w1, ((e + 1) * q - c * p) / ((e + 1) * (d + 1) - c * c) AS w2 FROM (SELECT fold, avg(r1) AS m1, avg(r2) AS m2, avg(excess_return) AS my, count(*) * var_pop(r1) AS e, count(*) * covar_pop(r1, r2) AS c, count(*) * var_pop(r2) AS d, count(*) * covar_pop(r1, excess_return) AS p, count(*) * covar_pop(r2, excess_return) AS q FROM sk JOIN {STF} ON known < a GROUP BY 1)) JOIN (SELECT * FROM sk JOIN {STF} ON as_of_date >= a AND as_of_date < b) USING (fold)", "ev", sk=STK))
def stacked_scores(v):
    d = v.ev.where("horizon = 20 AND mom_1m IS NOT NULL").withColumns({"base": F.col("score"), "label_matured_on": F.date_add("as_of_date", 30)}).drop("score")
    folds = [("s1", "1997-07-01", "1998-07-01"), ("s2", "1998-07-01", "1999-07-01")]
    return rounded(learn.stack(d, "base", "mom_1m", "excess_return", folds, KEYS).select("fold_id", "as_of_date", "ticker", "score"))


GF = ["score", "adv", "mom_1m"]


def stored_rows(v):
    """The rows that every fold's job reads: written once."""
    path = v.folder("rows")
    v.ev.where("horizon = 20").drop("fold_id").write.parquet(path)
    return v.spark.read.parquet(path)


def yearly(v):
    """The years after the first as folds."""
    first, last = v.ev.agg(F.year(F.min("as_of_date")), F.year(F.max("as_of_date"))).first()
    return [(f"y{y}", f"{y}-01-01", f"{y + 1}-01-01") for y in range(first + 1, last + 1)]


@query("walk_forward_gbt", None)
def walk_forward_gbt(v):
    """Weighted trees by fold: each fold's model is fitted on the rows before it, with an embargo, and scores the fold."""
    from ..functions.scalars import half_life_years

    years = v.spark.range(1).select(half_life_years(F.lit(20)).alias("y")).first().y
    d = learn.walk_forward(stored_rows(v), GF, "excess_return", yearly(v), ["as_of_date", "ticker"], embargo_days=60, half_life_days=365.25 * years)
    return d.select("fold_id", "as_of_date", "ticker", F.round("pred", 6).alias("pred"))


@query("error_model_by_fold", None)
def error_model_by_fold(v):
    """Expected losses of each year from a model of the years before."""
    path = v.folder("losses")
    uncertainty.error_features(v.ls.where("horizon = 20").drop("g_pred")).select("fold_id", "as_of_date", "ticker", "abs_score", "score_pct", "vol_6m", "rank_loss").write.parquet(path)
    d = v.spark.read.parquet(path)
    folds = sorted(r[0] for r in d.select("fold_id").distinct().collect())  # a name a year
    return learn.error_model(d, ["abs_score", "score_pct", "vol_6m"], folds).select("fold_id", "as_of_date", "ticker", F.round("g_pred", 6).alias("g_pred"))


def order_tone(v, line):
    """Stands in for scored texts: a supplier's orders by the day, from -1 (urgent) to 1 (low)."""
    lines = v.table("lineitem").where(F.col("l_linenumber") == line).select(F.col("l_orderkey").alias("record_id"), F.col("l_suppkey").alias("ticker"))
    orders = v.table("orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_orderdate").cast("date").alias("event_date"), ((F.substring("o_orderpriority", 1, 1).try_cast("double") - 3) / 2).alias("score"))
    return lines.join(orders, "record_id").where("score IS NOT NULL")


SENTIMENT = ["news_7d", "news_30d", "news_count_30d", "news_momentum", "latest", "change", "mean_90d"]


@query("sentiment_enriched_scores", None)
def sentiment_enriched_scores(v):
    """Trees by fold with what the ticker's news and filings said before the date; a ticker without any has NULLs, a bin of their own."""
    news, filings = order_tone(v, 1), order_tone(v, 2)
    rows = stored_rows(v).select("ticker", F.col("as_of_date").alias("date"), "as_of_date", F.col("score").alias("momentum"), "adv", "mom_1m", "excess_return")
    d = events.filing_sentiment(events.news_sentiment(rows, news), filings)
    scored = learn.walk_forward(d, ["momentum", "adv", "mom_1m", *SENTIMENT], "excess_return", yearly(v), ["as_of_date", "ticker"], embargo_days=60)
    return scored.select("fold_id", "as_of_date", "ticker", F.round("pred", 6).alias("score"))


@query("variance_inflation_of_three", sql("SELECT f AS feature, round(CASE f WHEN 'mom_1m' THEN (1 - c * c) / d WHEN 'mom_3m' THEN (1 - b * b) / d ELSE (1 - a * a) / d END, 5) AS vif FROM (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS d FROM (SELECT {ab} AS a, {ac} AS b, {bc} AS c FROM mpanel WHERE mom_1m IS NOT NULL AND mom_3m IS NOT NULL AND vol_6m IS NOT NULL)), (VALUES ('mom_1m'), ('mom_3m'), ('vol_6m')) t(f)".format(ab=corr("mom_1m", "mom_3m"), ac=corr("mom_1m", "vol_6m"), bc=corr("mom_3m", "vol_6m")), "mpanel"))
def variance_inflation_of_three(v):
    return rounded(stats.vif(v.mpanel, ["mom_1m", "mom_3m", "vol_6m"]), 5)


# A stream ---------------------------------------------------------------------------------------------


@query("event_stream_counts", sql("SELECT event_type, CAST(date_trunc('day', observed_at) AS TIMESTAMP) AS start, count(*) AS n FROM pe GROUP BY 1, 2", "pe"))
def event_stream_counts(v):
    """Counts by day of the events table read as a stream."""
    d = in_runs(v, streams.counts, keys=["event_type", "start"])
    return d.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


SLICES = 3


def in_runs(v, work, keys=None, twice=False, heartbeat=False):
    """The events come in ``SLICES`` parts in the order of time; after each the stream is started again from its checkpoint, reads what is new,
    and writes to files.  A part is one batch however many files it has: they overlap in time, so a batch a file would move the watermark past the
    rows of the next."""
    source, out, checkpoint = (v.folder(n) for n in ("source", "results", "checkpoint"))
    e = v.table("events").select("event_id", F.col("user_id").alias("ticker"), "event_type", F.col("ts").cast("timestamp").alias("observed_at"), "value")
    span = e.agg(F.min("observed_at").cast("double").alias("a"), F.max("observed_at").cast("double").alias("b"))
    part = F.least(F.floor((F.col("observed_at").cast("double") - F.col("a")) / (F.col("b") - F.col("a")) * SLICES), F.lit(SLICES - 1))
    dealt = e.crossJoin(F.broadcast(span)).withColumn("part", F.coalesce(part, F.lit(0))).drop("a", "b")  # one row
    for k in range(SLICES):
        own = dealt.where(F.col("part") == k).drop("part")
        (own.unionByName(own) if twice else own).write.mode("append").parquet(source)
        if heartbeat and k == SLICES - 1:
            end = e.agg((F.max("observed_at") + F.expr("INTERVAL 10 YEARS")).alias("observed_at")).where("observed_at IS NOT NULL")
            beat = end.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name != "observed_at" else F.col("observed_at") for f in e.schema])
            streams.run_to_files(work(streams.read_events(v.spark, source, e.schema)), out, checkpoint, "update" if keys else "append")
            beat.write.mode("append").parquet(source)
        streams.run_to_files(work(streams.read_events(v.spark, source, e.schema)), out, checkpoint, "update" if keys else "append")
    return streams.read_results(v.spark, out, keys)


@query("event_stream_sentiment", sql("SELECT ticker, CAST(d AS TIMESTAMP) AS start, count(*) AS n, round(avg(value), 9) AS mean_value FROM (SELECT ticker, value, unnest(generate_series(date_trunc('day', observed_at) - INTERVAL 6 DAY, date_trunc('day', observed_at), INTERVAL 1 DAY)) AS d FROM pe) GROUP BY 1, 2", "pe"))
def event_stream_sentiment(v):
    d = in_runs(v, streams.rolling_sentiment, keys=["ticker", "start"])
    return d.select("ticker", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("mean_value", 9).alias("mean_value"))


@query("event_stream_ingest", sql("SELECT event_id, ticker, value FROM pe", "pe"))
def event_stream_ingest(v):
    """The events come twice; each id is taken in once."""
    d = in_runs(v, streams.ingest, twice=True)
    return d.select("event_id", "ticker", "value")


@query("event_stream_scores", sql("SELECT event_id, round(value / 100, 6) AS score FROM pe", "pe"))
def event_stream_scores(v):
    path = v.folder("scores")
    q = streams.score_sink(streams.read_events(v.spark, f"{v.sf_dir}/events.parquet*", v.table("events").schema), lambda batch: batch.select("event_id", (F.col("value") / 100).alias("score")), path, v.folder("checkpoint")).start()
    q.awaitTermination()
    return rounded(v.spark.read.parquet(path).select("event_id", "score"))


@query("event_stream_ema", sql("SELECT a.ticker, a.observed_at, round(sum(b.value * CASE WHEN b.i = 1 THEN 1 ELSE 1 - pow(2.0, -1 / 5.0) END * pow(2.0, (b.i - a.i) / 5.0)), 6) AS ema FROM x a JOIN x b ON a.ticker = b.ticker AND b.i <= a.i GROUP BY a.ticker, a.observed_at, a.i", "pe", x="SELECT ticker, observed_at, value, row_number() OVER (PARTITION BY ticker ORDER BY observed_at, value) AS i FROM pe WHERE value IS NOT NULL"))
def event_stream_ema(v):
    d = in_runs(v, streams.ema_state, heartbeat=True)
    return d.where("ticker IS NOT NULL").select("ticker", F.col("observed_at").cast("timestamp_ntz").alias("observed_at"), F.round("ema", 6).alias("ema"))


@query("usable_features", sql(" UNION ALL ".join(f"SELECT '{f}' AS feature FROM mpanel HAVING avg(({f} IS NOT NULL)::INT) > 0.9" for f in ("mom_1m", "mom_3m", "mom_6m", "mom_12m")), "mpanel"))
def usable_features(v):
    names = uncertainty.usable_features(v.mpanel, ["mom_1m", "mom_3m", "mom_6m", "mom_12m"], 0.9)
    return v.spark.createDataFrame([(n,) for n in names], "feature string")
