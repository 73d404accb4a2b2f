"""Forward labels, calendars, folds: what is predicted, when it is known, and who may train on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranks import col, ts
from ..functions.scalars import calendar_days, close_utc
from .pit import asof_join

# Calendar ------------------------------------------------------------------------------------


def sessions(df: DataFrame, date: str = "date") -> DataFrame:
    """session, session_idx (dense from 0), of the distinct dates: a calendar of a few thousand rows."""
    return df.select(F.col(date).alias("session")).distinct().withColumn("session_idx", (F.row_number().over(Window.orderBy("session")) - 1).cast("long"))


def session_offset(df: DataFrame, calendar: DataFrame, date: str, n: int, name: str) -> DataFrame:
    """The session n after (before, if negative) a date that is a session."""
    a = calendar.select(F.col("session").alias(date), (F.col("session_idx") + n).alias("_to"))
    b = calendar.select(F.col("session_idx").alias("_to"), F.col("session").alias(name))
    return df.join(F.broadcast(a), date, "left").join(F.broadcast(b), "_to", "left").drop("_to")


def sessions_between(df: DataFrame, calendar: DataFrame, start: str, end: str, name: str = "n_sessions") -> DataFrame:
    """How many sessions lie in (start, end], both being sessions."""
    a = calendar.select(F.col("session").alias(start), F.col("session_idx").alias("_a"))
    b = calendar.select(F.col("session").alias(end), F.col("session_idx").alias("_b"))
    return df.join(F.broadcast(a), start, "left").join(F.broadcast(b), end, "left").withColumn(name, F.col("_b") - F.col("_a")).drop("_a", "_b")


def snap(df: DataFrame, calendar: DataFrame, date: str, name: str, forward: bool = False) -> DataFrame:
    """The session on or before (after, if forward) any date."""
    met = df.select(date).distinct().join(F.broadcast(calendar), F.col("session") >= F.col(date) if forward else F.col("session") <= F.col(date))
    found = met.groupBy(date).agg((F.min if forward else F.max)("session").alias(name))
    return df.join(found, date, "left")


def future_sessions(calendar: DataFrame, n: int) -> DataFrame:
    """session, next_sessions: the n sessions that follow, in order (fewer at the end)."""
    w = Window.orderBy("session_idx").rowsBetween(1, n)
    return calendar.select("session", F.collect_list("session").over(w).alias("next_sessions"))


def rebalance_dates(calendar: DataFrame, every: str = "month") -> DataFrame:
    """The last session of each week, month or quarter; every session for "day"."""
    if every == "day":
        return calendar.select(F.col("session").alias("rebalance"))
    return calendar.groupBy(F.trunc("session", every).alias("period")).agg(F.max("session").alias("rebalance"))


def sampling_grid(calendar: DataFrame, entities: DataFrame, weekday: int | None = 6) -> DataFrame:
    """Sessions (of one weekday: 1 Sunday ... 7 Saturday, or all) times the entities."""
    days = calendar.select("session") if weekday is None else calendar.where(F.dayofweek("session") == weekday).select("session")
    return entities.crossJoin(F.broadcast(days))


def period_starts(spark: SparkSession, start: str, end: str, months: int) -> DataFrame:
    """``start``, then the first day of every month (or quarter) after it up to ``end``."""
    first = F.add_months(F.trunc(F.lit(start).cast("date"), "month" if months == 1 else "quarter"), months)
    seq = F.concat(F.array(F.lit(start).cast("date")), F.when(first <= F.lit(end).cast("date"), F.sequence(first, F.lit(end).cast("date"), F.make_ym_interval(F.lit(0), F.lit(months)))).otherwise(F.array().cast("array<date>")))
    return spark.range(1).select(F.explode(seq).alias("candidate"))


# Labels --------------------------------------------------------------------------------------


def forward_labels(bars: DataFrame, benchmark: DataFrame, horizons: list[int], entity: str = "ticker", date: str = "date", close: str = "close", all_horizons: bool = False) -> DataFrame:
    """as_of_date, entity, horizon, excess_return, exit_date, label_matured_at: the return over the next h rows less the
    benchmark's between the same dates (joined by date).  ``all_horizons``: only rows that have them all."""
    w = ts(entity, date)
    exits = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lead(date, h).over(w).alias("exit_date"), F.lead(close, h).over(w).alias("exit_close")) for h in horizons])
    d = bars.select(F.col(date).alias("as_of_date"), entity, F.col(close).alias("_p0"), exits.alias("_e"))
    if all_horizons:
        d = d.where(F.forall("_e", lambda x: x.exit_date.isNotNull()))
    d = d.select("as_of_date", entity, "_p0", F.inline("_e")).where("exit_date IS NOT NULL")
    b = F.broadcast(benchmark.select(F.col(date).alias("_d"), F.col(close).alias("_b")))  # a row a day
    d = d.join(b.withColumnsRenamed({"_d": "as_of_date", "_b": "_b0"}), "as_of_date").join(b.withColumnsRenamed({"_d": "exit_date", "_b": "_b1"}), "exit_date")
    excess = F.try_divide("exit_close", "_p0") - F.try_divide("_b1", "_b0")
    return d.select("as_of_date", entity, "horizon", excess.alias("excess_return"), "exit_date", close_utc("exit_date").alias("label_matured_at"))


def total_return_labels(bars: DataFrame, benchmark: DataFrame, dividends: DataFrame, calendar: DataFrame, horizons: list[int], entity: str = "ticker") -> DataFrame:
    """Price and total return over h sessions of the calendar, dividends with T < date <= exit added as yield
    (sums of the running total, no range join); rows need all four prices."""
    days = F.broadcast(calendar)
    h = F.explode(F.array(*[F.lit(x) for x in horizons]))
    d = bars.select(F.col("date").alias("as_of_date"), entity, F.col("close").alias("entry_price"), h.alias("horizon"))
    d = d.join(days.select(F.col("session").alias("as_of_date"), "session_idx"), "as_of_date").withColumn("_to", F.col("session_idx") + F.col("horizon"))
    d = d.join(days.select(F.col("session_idx").alias("_to"), F.col("session").alias("exit_date")), "_to").drop("_to", "session_idx")
    d = d.join(bars.select(F.col("date").alias("exit_date"), entity, F.col("close").alias("exit_price")), ["exit_date", entity])
    b = benchmark.select("date", "close")
    d = d.join(F.broadcast(b.withColumnsRenamed({"date": "as_of_date", "close": "_b0"})), "as_of_date").join(F.broadcast(b.withColumnsRenamed({"date": "exit_date", "close": "_b1"})), "exit_date")
    paid = dividends.withColumn("_cum", F.sum("dividend").over(Window.partitionBy(entity).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    for at, name in (("as_of_date", "_c0"), ("exit_date", "_c1")):
        d = asof_join(d, paid.withColumnRenamed("date", "paid_on"), [entity], at, "paid_on", ["_cum"]).withColumnRenamed("_cum", name)
    cash = F.coalesce(F.col("_c1"), F.lit(0.0)) - F.coalesce(F.col("_c0"), F.lit(0.0))
    d = d.withColumn("dividend_yield", cash / F.col("entry_price")).withColumn("stock_return", F.col("exit_price") / F.col("entry_price") - 1 + F.col("dividend_yield"))
    d = d.withColumn("benchmark_return", F.col("_b1") / F.col("_b0") - 1)
    return d.select("as_of_date", entity, "horizon", "entry_price", "exit_price", "dividend_yield", "stock_return", "benchmark_return", (F.col("stock_return") - F.col("benchmark_return")).alias("excess_return"), "exit_date", close_utc("exit_date").alias("label_matured_at"))


def pivot_labels(labels: DataFrame, horizons: list[int], entity: str = "ticker") -> DataFrame:
    g = labels.groupBy("as_of_date", entity).pivot("horizon", horizons).agg(F.max_by("excess_return", "label_matured_at").alias("excess_return"), F.max("label_matured_at").alias("label_matured_at"))
    return g.withColumnsRenamed({f"{h}_{c}": f"{c}_{h}d" for h in horizons for c in ("excess_return", "label_matured_at")})


def mature_labels(labels: DataFrame, as_of: Column) -> DataFrame:
    return labels.where(F.col("label_matured_at") <= as_of)


def mature_at_close(matured, cutoff) -> Column:
    return col(matured) <= close_utc(cutoff)


def eligible_dates(labels: DataFrame, n_horizons: int) -> DataFrame:
    """Rows of dates on which all horizons have labels."""
    full = labels.groupBy("as_of_date").agg(F.count_distinct("horizon").alias("_n")).where(F.col("_n") == n_horizons)
    return labels.join(full, "as_of_date", "left_semi")


def least_names(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("_n") >= n).drop("_n")


def complete_rows(df: DataFrame, horizons: list[int]) -> DataFrame:
    return df.na.drop(subset=[f"excess_return_{h}d" for h in horizons])


def optional_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """All of df's columns, and those wanted (name: type) that it lacks as NULL."""
    return df.withColumns({n: F.lit(None).cast(t) for n, t in wanted.items() if n not in df.columns})


def label_composition(labels: DataFrame) -> DataFrame:
    return labels.groupBy("horizon").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("dividend_yield") > 0).cast("double")).alias("dividend_share"), F.avg("dividend_yield").alias("mean_yield"), F.avg(F.col("dividend_yield").isNull().cast("double")).alias("fallback_rate"))


# Folds ---------------------------------------------------------------------------------------


def make_folds(starts: DataFrame, first_train: str, months: int, embargo_sessions: int = 90) -> DataFrame:
    """Expanding folds from validation starts (column candidate): train up to an embargo before, in calendar days."""
    w = Window.orderBy("candidate")
    d = starts.withColumn("val_start", F.col("candidate")).withColumn("val_end", F.coalesce(F.lead("candidate").over(w), F.add_months("candidate", months)))
    d = d.withColumn("train_end", F.date_sub("val_start", int(embargo_sessions * 365 / 252) + 1)).withColumn("train_start", F.lit(first_train).cast("date"))
    d = d.where("train_end > train_start").withColumn("fold_id", F.format_string("fold_%02d", F.row_number().over(w)))
    return d.select("fold_id", "train_start", "train_end", "val_start", "val_end")


def observed_folds(calendar: DataFrame, every: str = "quarter") -> DataFrame:
    """Folds from the periods of the observed dates, without an embargo: val from a period's first session to the next
    period's first session (inclusive)."""
    p = calendar.groupBy(F.trunc("session", every).alias("period")).agg(F.min("session").alias("val_start"))
    w = Window.orderBy("period")
    p = p.withColumn("val_end", F.lead("val_start").over(w)).withColumn("train_start", F.min("val_start").over(Window.partitionBy(F.lit(1)))).withColumn("train_end", F.date_sub("val_start", 1))
    p = p.where("val_end IS NOT NULL AND train_end > train_start")
    return p.select(F.format_string("fold_%02d", F.row_number().over(w)).alias("fold_id"), "train_start", "train_end", "val_start", "val_end")


def assign_folds(rows: DataFrame, folds: DataFrame, date: str = "as_of_date") -> DataFrame:
    """Every row once for each fold it is in, with part "train" or "val" (half-open ranges)."""
    f, d = F.broadcast(folds), F.col(date)  # folds: a few hundred rows
    train = (d >= F.col("train_start")) & (d < F.col("train_end"))
    val = (d >= F.col("val_start")) & (d < F.col("val_end"))
    return rows.join(f, train | val).withColumn("part", F.when(train, "train").otherwise("val"))


def purged(date, horizon, train_end, part) -> Column:
    """Labels that reach over the border: of training rows beyond its end, of validation rows back before it."""
    n = calendar_days(horizon)
    return F.when(col(part) == "train", F.date_add(col(date), n) > col(train_end)).otherwise(F.date_sub(col(date), n) < col(train_end))


def fold_rows(labels: DataFrame, folds: DataFrame) -> DataFrame:
    """Labels by fold and part, purged; training labels only if known at the close of the day before train_end."""
    d = assign_folds(labels, folds).where(~purged("as_of_date", "horizon", "train_end", "part"))
    return d.where((F.col("part") == "val") | mature_at_close("label_matured_at", F.date_sub("train_end", 1)))


def without(rows: DataFrame, purge: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(purge.select(*keys).distinct(), keys, "left_anti")


def dedupe(df: DataFrame, keys: list[str], order: list, keep: str = "first") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[c.asc() if keep == "first" else c.desc() for c in map(col, order)])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
