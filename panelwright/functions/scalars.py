"""Row-level columns: times of observation, costs, regimes, weights, texts, sample arrays.

Fixed values, which results depend on: hours of the market, bounds and names of the classes, half-lives, cost constants, and the
coefficients of the error function's approximation (Abramowitz and Stegun 7.1.26).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ranks import col

NEW_YORK = "America/New_York"


# Times -----------------------------------------------------------------------------------


def at_ny(date, hour: int, minute: int = 0) -> Column:
    """A New York wall-clock time on a date, in UTC (summer time is followed)."""
    d = col(date)
    return F.to_utc_timestamp(F.make_timestamp(F.year(d), F.month(d), F.dayofmonth(d), F.lit(hour), F.lit(minute), F.lit(0)), NEW_YORK)


def close_utc(date) -> Column:
    """16:00 in New York."""
    return at_ny(date, 16)


def next_weekday(date) -> Column:
    d = col(date).cast("date")
    return F.date_add(d, F.when(F.dayofweek(d) == 6, 3).when(F.dayofweek(d) == 7, 2).otherwise(1))


def next_open_utc(date) -> Column:
    """09:30 in New York on the next weekday."""
    return at_ny(next_weekday(date), 9, 30)


def observed_from_report(date, timing) -> Column:
    """When a report was known: before the open 09:30, after the close 16:05, else next open."""
    t = F.lower(col(timing))
    return F.when(t == "bmo", at_ny(date, 9, 30)).when(t == "amc", at_ny(date, 16, 5)).otherwise(next_open_utc(date))


def observed_or_default(filing, period_end, lag_days: int = 45) -> Column:
    """The open after the filing; without a filing, the period's end and ``lag_days``."""
    return F.coalesce(next_open_utc(filing), close_utc(F.date_add(col(period_end), lag_days)))


def publication_time(feed, date) -> Column:
    """Default publication lags by feed: short interest 10 days later at the close, fund flows the
    next day at 09:30, holdings filings the same day at 16:00, others the next open."""
    d = col(date)
    return F.when(col(feed) == "short_interest", close_utc(F.date_add(d, 10))).when(col(feed) == "etf_flow", at_ny(F.date_add(d, 1), 9, 30)).when(col(feed) == "holdings", close_utc(d)).otherwise(next_open_utc(d))


def event_timing(accepted) -> Column:
    """bmo before 9 in New York, amc from 16, else during."""
    h = F.hour(F.from_utc_timestamp(col(accepted), NEW_YORK))
    return F.when(h.isNull(), "unknown").when(h < 9, "bmo").when(h >= 16, "amc").otherwise("during")


def calendar_days(trading_days) -> Column:
    return F.floor(col(trading_days) * 365 / F.lit(252.0)).cast("int") + 1


def trading_days(days) -> Column:
    return F.floor(col(days) * 252 / F.lit(365.0)).cast("int")


# Ratios, costs -------------------------------------------------------------------------------


def safe_divide(a, b) -> Column:
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def surprise_pct(actual, estimate) -> Column:
    return F.try_divide((col(actual) - col(estimate)).cast("double"), F.abs(col(estimate)).cast("double")) * 100


def participation(trade_value, adv, least_adv: float = 1000.0) -> Column:
    a = col(adv)
    return F.when(a.isNull() | (a < least_adv), 1.0).otherwise(F.least(F.try_divide(col(trade_value).cast("double"), a.cast("double")), F.lit(1.0)))


def slippage_bps(share, coefficient, floor: float = 0.0, cap: float = 500.0) -> Column:
    """Square-root impact between a floor and a cap."""
    s = col(share)
    return F.when(s <= 0, floor).otherwise(F.greatest(F.lit(floor), F.least(F.lit(cap), col(coefficient) * F.sqrt(s))))


def trade_cost_bps(trade_value, adv, coefficient, base_bps: float = 20.0, missing_bps: float = 100.0) -> Column:
    return F.when(col(adv).isNull(), missing_bps).otherwise(F.lit(base_bps) + slippage_bps(participation(trade_value, adv), coefficient))


def net_return(gross, cost_bps) -> Column:
    return col(gross) - col(cost_bps) / 10000.0


def survives(gross, cost_bps) -> Column:
    return net_return(gross, cost_bps) > 0


def expected_move_pct(straddle, price) -> Column:
    return safe_divide(straddle, price) * 100


def flow_pct(flow, assets) -> Column:
    return safe_divide(flow, assets) * 100


def new_position(before, now) -> Column:
    return (F.coalesce(col(before), F.lit(0)) == 0) & (F.coalesce(col(now), F.lit(0)) > 0)


def closed_position(before, now) -> Column:
    return (F.coalesce(col(before), F.lit(0)) > 0) & (F.coalesce(col(now), F.lit(0)) == 0)


def adjustment_holds(raw, adjusted, factor, tolerance: float = 0.01) -> Column:
    """Whether raw / factor is the adjusted price, within a share of it."""
    return F.coalesce(F.abs(F.try_divide(F.try_divide(col(raw).cast("double"), col(factor).cast("double")), col(adjusted).cast("double")) - 1) <= tolerance, F.lit(False))


# Weights, gates, scores ------------------------------------------------------------------


def half_life_years(horizon) -> Column:
    """2.5, 3.5 and 4.5 years at horizons 20, 60 and 90; straight lines between, flat outside."""
    h = col(horizon).cast("double")
    return F.when(h <= 20, 2.5).when(h <= 60, 2.5 + (h - 20) / 40).when(h <= 90, 3.5 + (h - 60) / 30).otherwise(4.5)


def decay_weight(date, as_of, half_life) -> Column:
    return F.pow(F.lit(2.0), -F.datediff(col(as_of), col(date)) / F.lit(365.25) / col(half_life))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def clip(x, low: float, high: float) -> Column:
    """NULL stays NULL."""
    c = col(x)
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def exposure_gate(health, low: float = 0.3, high: float = 0.7) -> Column:
    return clip((col(health) - low) / (high - low), 0.0, 1.0)


def trusted(gate, least: float = 0.2) -> Column:
    return F.coalesce(col(gate) >= least, F.lit(False))


def normal_cdf(x) -> Column:
    """Phi by a rational approximation (error under 1.5e-7)."""
    c = col(x).cast("double")
    z = F.abs(c) / F.lit(2**0.5)
    t = 1 / (1 + 0.3275911 * z)
    erf = 1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-z * z)
    return 0.5 * (1 + F.signum(c) * erf)


def prob_outperform(mean, std) -> Column:
    return normal_cdf(safe_divide(mean, std))


def size_by_volatility(score, vol, constant, floor: float = 0.01) -> Column:
    """score * min(1, c / max(vol, floor)); unchanged without a volatility."""
    return F.when(col(vol).isNull(), col(score)).otherwise(col(score) * F.least(F.lit(1.0), col(constant) / F.greatest(col(vol), F.lit(floor))))


def size_by_uncertainty(score, uncertainty, constant, epsilon: float = 1e-4) -> Column:
    return F.when(col(uncertainty).isNull(), col(score)).otherwise(col(score) * F.least(F.lit(1.0), col(constant) / F.sqrt(F.greatest(col(uncertainty), F.lit(0.0)) + epsilon)))


def calm_weight(vix_percentile, alpha: float = 0.5) -> Column:
    """Weight of the model against momentum: 1 - alpha * sigmoid((pct - 67) / 10)."""
    return 1 - alpha * sigmoid((col(vix_percentile) - 67) / 10.0)


def factor_scores() -> dict[str, Column]:
    """Baseline scores from momentum columns."""
    moms = [F.col(c) for c in ("mom_1m", "mom_3m", "mom_6m", "mom_12m")]
    known = sum((m.isNotNull().cast("int") for m in moms), F.lit(0))
    total = sum((F.coalesce(m, F.lit(0.0)) for m in moms), F.lit(0.0))
    return {"mom_12m": F.col("mom_12m"), "momentum_composite": F.try_divide(total, known), "short_term_strength": F.col("mom_1m")}


def random_score(*keys) -> Column:
    """A number in [-1, 1) fixed by the keys."""
    return F.xxhash64(*[col(k).cast("string") for k in keys]) / F.lit(float(1 << 63))


def stable_id(cik, figi, ticker) -> Column:
    return F.coalesce(F.concat(F.lit("CIK:"), col(cik)), F.concat(F.lit("FIGI:"), col(figi)), F.concat(F.lit("TICKER:"), col(ticker)))


def model_vintage(as_of, first: int, last: int, prefix: str = "model-") -> Column:
    """The newest model whose training year is over: year - 1, within what there is."""
    return F.concat(F.lit(prefix), F.greatest(F.lit(first), F.least(F.lit(last), F.year(col(as_of)) - 1)).cast("string"))


# Classes ------------------------------------------------------------------------------------


def ladder(x, steps: list[tuple[float, object]], otherwise) -> Column:
    """The value of the first step whose bound x does not exceed... x < bound; NULL for NULL."""
    c, out = col(x), None
    for bound, value in steps:
        out = F.when(c < bound, F.lit(value)) if out is None else out.when(c < bound, F.lit(value))
    return F.when(c.isNotNull(), out.otherwise(F.lit(otherwise)))


def vix_bucket(percentile) -> Column:
    """low up to 33, mid, high from 67; unknown for NULL."""
    c = col(percentile)
    return F.when(c.isNull(), "unknown").when(c <= 33, "low").when(c < 67, "mid").otherwise("high")


def market_bucket(market_return) -> Column:
    c = col(market_return)
    return F.when(c.isNull(), "unknown").when(c > 0, "bull").otherwise("bear")


def vix_level_regime(level) -> Column:
    return ladder(level, [(15, "low"), (25, "normal"), (35, "elevated")], "high")


def vix_percentile_regime(percentile) -> Column:
    return ladder(percentile, [(25, 0), (75, 1), (90, 2)], 3)


def market_regime_trend(price, ma50, ma200, ret21) -> Column:
    """bull above both averages with a gain, bear below both with a loss, else neutral."""
    p, a, b, r = (col(c) for c in (price, ma50, ma200, ret21))
    return F.when((p > b) & (a > b) & (r > 0), "bull").when((p < b) & (a < b) & (r < 0), "bear").otherwise("neutral")


def market_regime_return(ret, vol) -> Column:
    r, v = col(ret), col(vol)
    return F.when((r > 0.02) & (v < 0.20), 1).when((r < -0.02) | (v > 0.30), -1).otherwise(0)


def regime_code(name) -> Column:
    return F.when(col(name) == "bull", 1).when(col(name) == "bear", -1).otherwise(0)


def rank_category(percentile) -> Column:
    """From a percentile of 0-100."""
    c = col(percentile)
    return F.when(c >= 90, "top_buy").when(c >= 70, "buy").when(c <= 10, "strong_avoid").when(c <= 30, "avoid").otherwise("neutral")


def confidence_bucket(x) -> Column:
    c = col(x)
    return F.when(c >= 0.7, "high").when(c >= 0.4, "medium").otherwise("low")


def signal_direction(x, edge: float = 0.02) -> Column:
    c = col(x)
    return F.when(c > edge, "bullish").when(c < -edge, "bearish").otherwise("neutral")


def gate_verdict(active, ic) -> Column:
    a, c = col(active), col(ic)
    return F.when(a & (c > 0), "correct_active").when(a, "false_active").when(c > 0, "false_abstain").otherwise("correct_abstain")


def periods(date, final_from: str = "2024-01-01", crisis: tuple[str, str] | None = None) -> Column:
    """The periods a date counts in: ALL, and DEV or FINAL, and CRISIS."""
    d = col(date).cast("date")
    names = [F.lit("ALL"), F.when(d < F.lit(final_from).cast("date"), "DEV").otherwise("FINAL")]
    if crisis:
        names.append(F.when(d.between(F.lit(crisis[0]).cast("date"), F.lit(crisis[1]).cast("date")), "CRISIS"))
    return F.array_compact(F.array(*names))


# Arrays of samples ------------------------------------------------------------------------


def array_quantile(a, p: float) -> Column:
    """Linear interpolation between order statistics of an array column."""
    s = F.array_sort(col(a))
    at = (F.size(s) - 1) * F.lit(p)
    lo = F.floor(at).cast("int")
    low, high = F.get(s, lo), F.get(s, F.least(lo + 1, F.size(s) - 1))
    return low + (high - low) * (at - lo)


def array_mean(a) -> Column:
    return F.try_divide(F.aggregate(col(a), F.lit(0.0), lambda t, x: t + x), F.size(col(a)))


def array_std(a, ddof: int = 1) -> Column:
    m = array_mean(a)
    squares = F.aggregate(F.transform(col(a), lambda x: (x - m) * (x - m)), F.lit(0.0), lambda t, x: t + x)
    return F.sqrt(F.try_divide(squares, F.size(col(a)) - ddof))


def trimmed_mean(a, share: float = 0.1) -> Column:
    s = F.array_sort(col(a))
    cut = F.floor(F.size(s) * share).cast("int")
    return array_mean(F.slice(s, cut + 1, F.size(s) - 2 * cut))


def sample_distribution(a) -> Column:
    """struct of p5, p25, p50, p75, p95, mean, std of an array of samples."""
    parts = [array_quantile(a, p).alias(n) for n, p in (("p5", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95))]
    return F.struct(*parts, array_mean(a).alias("mean"), array_std(a, 0).alias("std"))


def distribution_fields(d: str) -> dict[str, Column]:
    """Derived from a distribution struct: range, upside ratio, value at risk, return over risk."""
    g = lambda n: F.col(f"{d}.{n}")
    return {"iqr": g("p75") - g("p25"), "upside_ratio": F.try_divide(g("p95") - g("p50"), g("p50") - g("p5")), "var95": -g("p5"), "risk_adjusted": F.try_divide(g("mean"), g("std"))}


def sample_step(a, which: str = "last") -> Column:
    """One number of a path: its last, first or summed step, or the median, mean or trimmed mean of all."""
    return {"last": F.element_at(col(a), -1), "first": F.get(col(a), F.lit(0)), "sum": F.aggregate(col(a), F.lit(0.0), lambda t, x: t + x), "median": array_quantile(a, 0.5), "mean": array_mean(a), "trimmed": trimmed_mean(a)}[which]


# Texts, payloads --------------------------------------------------------------------------


def strip_html(x) -> Column:
    """Tags and scripts removed, references for blanks and ampersands decoded, blanks squeezed."""
    c = F.regexp_replace(col(x), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"&nbsp;|&#160;", " "), r"&amp;", "&")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def item_section(x, item: str, most: int | None = None) -> Column:
    """The text from ``Item n.`` to the next item; without such the whole text, or its first ``most`` characters if that is asked for."""
    found = F.regexp_extract(col(x), rf"(?is)item\s+{item}\.?\s*(.*?)(?=item\s+\d+[a-z]?\.|\Z)", 1)
    rest = col(x) if most is None else F.substring(col(x), 1, most)
    return F.when(F.length(F.trim(found)) > 0, F.trim(found)).otherwise(rest)


def valid_text(x, least: int = 10) -> Column:
    """Whether a text has ``least`` characters or more between its outer blanks."""
    return F.coalesce(F.length(F.trim(col(x))) >= least, F.lit(False))


def truncated(x, most: int = 400) -> Column:
    return F.substring(col(x), 1, most)


def payload(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def payload_number(x, name: str) -> Column:
    return F.get_json_object(col(x), f"$.{name}").try_cast("double")


def content_hash(*columns: str) -> Column:
    """An aggregate that any order of the rows leaves alike."""
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))
