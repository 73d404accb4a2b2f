"""Events, filings, texts: what a panel row knew of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import col, median, zscore
from ..functions.scalars import close_utc, payload, surprise_pct
from .pit import asof_join, latest, latest_within


def visible_events(panel: DataFrame, events: DataFrame, entity: str = "ticker", date: str = "date", lookback: int = 90) -> DataFrame:
    """Panel rows with each event of the last ``lookback`` days known at the row's close."""
    e = events.select(F.col(entity).alias("_e"), "event_type", "event_date", "observed_at", *[c for c in events.columns if c not in (entity, "event_type", "event_date", "observed_at", date)])
    met = (F.col("_e") == F.col(entity)) & (F.col("observed_at") <= close_utc(date)) & (F.col("event_date") > F.date_sub(F.col(date), lookback)) & (F.col("event_date") <= F.col(date))
    return panel.join(e, met).drop("_e")


def event_scan(events: DataFrame, entities: list | None = None, kinds: list[str] | None = None, as_of: str | None = None, lookback: int | None = None, limit: int | None = None) -> DataFrame:
    d = events
    if entities:
        d = d.where(F.col("ticker").isin(entities))
    if kinds:
        d = d.where(F.col("event_type").isin(kinds))
    if as_of:
        d = d.where(F.col("observed_at") <= close_utc(F.lit(as_of).cast("date")))
        if lookback:
            d = d.where(F.col("event_date") >= F.date_sub(F.lit(as_of).cast("date"), lookback))
    d = d.orderBy(F.col("event_date").desc(), F.col("observed_at").desc(), "event_id")
    return d.limit(limit) if limit else d


def event_summary(seen: DataFrame, keys: list[str], as_of: str, value: str = "value") -> DataFrame:
    """Count, days since the latest, mean, upper-middle and latest value of visible events."""
    vals = F.sort_array(F.collect_list(value))
    g = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"), F.max("event_date").alias("_last"), F.avg(value).alias("mean_value"), vals.alias("_v"), F.max_by(value, F.struct("event_date", "observed_at", "event_id")).alias("latest_value"))
    return g.withColumns({"days_since": F.datediff(F.col(as_of), F.col("_last")), "middle_value": F.get("_v", F.expr("cast(size(_v) div 2 as int)"))}).drop("_last", "_v")


def event_dates(events: DataFrame, kind: str) -> DataFrame:
    return events.where(F.col("event_type") == kind).groupBy("ticker").agg(F.sort_array(F.collect_set("event_date")).alias("dates"))


def expected_next(filings: DataFrame, entity: str = "ticker", date: str = "filing_date", default: int = 91) -> DataFrame:
    """Mean of the last 4 spacings of 60 to 120 days; the next date expected."""
    w = Window.partitionBy(entity).orderBy(date)
    gap = F.datediff(F.col(date), F.lag(date).over(w))
    d = filings.withColumn("_gap", F.when(gap.between(60, 120), gap)).withColumn("_k", F.count("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.sum(F.coalesce(F.col("_gap"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_sum", first).withColumn("_gaps", F.collect_list("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last4 = F.slice("_gaps", F.greatest(F.size("_gaps") - 3, F.lit(1)), 4)
    mean = F.when(F.size("_gaps") > 0, F.aggregate(last4, F.lit(0.0), lambda t, x: t + x) / F.size(last4)).otherwise(float(default))
    return d.withColumn("spacing", mean).withColumn("expected_next", F.date_add(F.col(date), F.round("spacing").cast("int"))).drop("_gap", "_k", "_sum", "_gaps")


def recency(panel: DataFrame, filings: DataFrame, entity: str = "ticker", date: str = "date", window: int = 63) -> DataFrame:
    """days_since_filing, in_window (at most ``window`` days), days_to_next, of the last filing on or before the row."""
    f = expected_next(filings, entity).select(entity, F.col("filing_date").alias("last_filing"), "expected_next")
    d = asof_join(panel, f.withColumn("_on", F.col("last_filing")), [entity], date, "_on", ["last_filing", "expected_next"])
    since = F.datediff(F.col(date), F.col("last_filing"))
    return d.withColumns({"days_since_filing": since, "in_window": F.coalesce(since <= window, F.lit(False)), "days_to_next": F.greatest(F.datediff("expected_next", date), F.lit(0))})


def surprise_features(reports: DataFrame, entity: str = "ticker", date: str = "event_date", value: str = "surprise") -> DataFrame:
    """Per report: last, mean of 4, deviation of at most 8, streak of one sign ending here."""
    w = Window.partitionBy(entity).orderBy(date)
    sign = F.signum(F.col(value))
    d = reports.withColumn("_s", sign).withColumn("_new", F.coalesce((F.lag("_s").over(w) != F.col("_s")).cast("int"), F.lit(1)))
    d = d.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.row_number().over(Window.partitionBy(entity, "_run").orderBy(date)) * F.col("_s")
    return d.withColumns({"surprise_last": F.col(value), "surprise_mean4": F.avg(value).over(w.rowsBetween(-3, 0)), "surprise_std8": F.stddev_samp(value).over(w.rowsBetween(-7, 0)), "streak": F.when(F.col("_s") == 0, 0).otherwise(streak).cast("int")}).drop("_s", "_new", "_run")


def mostly_premarket(timing: str, entity: str, date: str) -> Column:
    return F.avg((F.col(timing) == "bmo").cast("double")).over(Window.partitionBy(entity).orderBy(date).rowsBetween(-7, 0)) > 0.5


def ttm(quarters: DataFrame, entity: str = "ticker", period: str = "period_end", fields: tuple[str, str, str] = ("revenue", "income", "equity")) -> DataFrame:
    """Sums of the last 4 quarters, growth against the 4 before, income over mean equity of at most 4."""
    revenue, income, equity = fields
    w = Window.partitionBy(entity).orderBy(period)
    four, before = w.rowsBetween(-3, 0), w.rowsBetween(-7, -4)
    full = lambda c, f: F.when(F.count(c).over(f) == 4, F.sum(c).over(f))
    d = quarters.withColumns({"revenue_ttm": full(revenue, four), "income_ttm": full(income, four), "_r": full(revenue, before), "_e": F.avg(equity).over(four)})
    return d.withColumns({"revenue_growth": F.try_divide("revenue_ttm", "_r") - 1, "roe": F.try_divide("income_ttm", "_e"), "margin": F.try_divide("income_ttm", "revenue_ttm")}).drop("_r", "_e")


def valuation_history(df: DataFrame, pe: str, entity: str, date: str, least: int = 8) -> DataFrame:
    w = Window.partitionBy(entity).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    z = F.try_divide(F.col(pe) - F.avg(pe).over(w), F.stddev_samp(pe).over(w))
    return df.withColumn("pe_z", F.when(F.count(pe).over(w) >= least, z))


def peer_z(df: DataFrame, value: str, entity: str, sector: str, date: str, days: int = 90, least: int = 5) -> DataFrame:
    """z of a filing's metric against its sector's latest ones within ``days`` before, its own included."""
    g = latest_within(df, entity, sector, date, value, days).select(sector, date, F.col("n").alias("_n"), F.col("mean").alias("_m"), F.col("std").alias("_s"))
    d = df.join(g, [sector, date], "left")  # a row a sector and day
    return d.withColumn(f"{value}_z", F.when((F.col("_n") >= least) & (F.col("_s") > 1e-8), (F.col(value) - F.col("_m")) / F.col("_s"))).drop("_n", "_m", "_s")


def universe_z(value: str, *keys, ddof: int = 1, least: int = 5, floor: float = 1e-8) -> Column:
    return zscore(value, *keys, ddof=ddof, least=least, floor=floor, degenerate=None)


def filing_sentiment(panel: DataFrame, texts: DataFrame, entity: str = "ticker", date: str = "date", score: str = "score") -> DataFrame:
    """Before the row's date (strictly): latest score, change from the one before, mean of the last 90 days."""
    w = Window.partitionBy(entity).orderBy("event_date", "record_id")
    t = texts.withColumns({"latest": F.col(score), "change": F.col(score) - F.lag(score).over(w), "_on": F.col("event_date")})
    d = asof_join(panel, t, [entity], date, "_on", ["latest", "change"], strict=True)
    return window_mean(d, texts, entity, date, score, 90, "mean_90d")


def window_mean(panel: DataFrame, texts: DataFrame, entity: str, date: str, score: str, days: int, name: str, count: str | None = None) -> DataFrame:
    """Mean (and count) of scores in the ``days`` before each row: union and a range frame, no pairs."""
    a = panel.select(F.struct("*").alias("_l"), F.col(entity).alias("_e"), F.datediff(F.col(date), F.lit("1970-01-01").cast("date")).alias("_d"), F.lit(None).cast("double").alias("_x"))
    b = texts.select(F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.col(entity).alias("_e"), F.datediff(F.col("event_date"), F.lit("1970-01-01").cast("date")).alias("_d"), F.col(score).cast("double").alias("_x"))
    w = Window.partitionBy("_e").orderBy("_d").rangeBetween(-days, -1)
    d = a.unionByName(b).withColumns({"_m": F.avg("_x").over(w), "_c": F.count("_x").over(w)}).where("_l IS NOT NULL")
    return d.select("_l.*", F.col("_m").alias(name), *([F.col("_c").alias(count)] if count else []))


def news_sentiment(panel: DataFrame, texts: DataFrame, entity: str = "ticker", date: str = "date", score: str = "score") -> DataFrame:
    d = window_mean(panel, texts, entity, date, score, 7, "news_7d")
    d = window_mean(d, texts, entity, date, score, 30, "news_30d", "news_count_30d")
    return d.withColumn("news_momentum", F.col("news_7d") - F.col("news_30d"))


def score_distribution(texts: DataFrame, by: str = "source", score: str = "score", edge: float = 0.05) -> DataFrame:
    s = F.col(score)
    one = lambda c: F.sum(c.cast("long"))
    return texts.where(s.isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("mean"), median(s).alias("median"), F.stddev_samp(s).alias("std"), F.min(s).alias("min"), F.max(s).alias("max"), one(s > edge).alias("n_pos"), one(s < -edge).alias("n_neg"), one(F.abs(s) <= edge).alias("n_neutral"))


def extreme_texts(texts: DataFrame, n: int, score: str = "score", tie: str = "record_id") -> DataFrame:
    best = texts.where(F.col(score).isNotNull()).orderBy(F.col(score).desc(), tie).limit(n).withColumn("side", F.lit("best"))
    worst = texts.where(F.col(score).isNotNull()).orderBy(F.col(score).asc(), tie).limit(n).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


FEEDS = {
    # feed: (date column, payload columns, observed_at from)
    "earnings": ("report_date", ["eps_actual", "eps_estimate"], None),
    "filing": ("filing_date", ["form"], None),
    "sentiment": ("published", ["score"], None),
    "estimate": ("date", ["consensus", "n_analysts"], None),
    "analyst": ("date", ["action", "target"], None),
    "options": ("date", ["iv", "skew"], None),
    "positioning": ("date", ["shares", "flow"], None),
}


def feed_events(rows: DataFrame, feed: str, observed: Column | None = None) -> DataFrame:
    """A vendor feed's rows as events: id, ticker, type, date, observed_at, JSON payload."""
    date, columns, _ = FEEDS[feed]
    d = rows.withColumn("event_date", F.col(date).cast("date"))
    seen = observed if observed is not None else close_utc("event_date")
    d = d.select("ticker", F.lit(feed).alias("event_type"), "event_date", seen.alias("observed_at"), payload(*[c for c in columns if c in rows.columns]).alias("payload"))
    return d.withColumn("event_id", F.concat_ws("_", F.col("ticker").cast("string"), "event_type", F.col("event_date").cast("string")))


def earnings_surprise(rows: DataFrame) -> DataFrame:
    return rows.withColumn("surprise", surprise_pct("eps_actual", "eps_estimate"))


def last_events(events: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy(F.col("event_date").desc(), F.col("observed_at").desc(), "event_id")
    return events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "latest", "col")]
