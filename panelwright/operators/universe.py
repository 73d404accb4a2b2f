"""Universe filters and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import col


def exclusion_reason(tests: list[tuple[str, Column]]) -> Column:
    """The first test that fails (a NULL fails); NULL if all pass."""
    out = None
    for name, ok in tests:
        failed = ~F.coalesce(ok, F.lit(False))
        out = F.when(failed, F.lit(name)) if out is None else out.when(failed, F.lit(name))
    return out


def liquidity_cascade(adv="adv", price="close", cap="market_cap", tag: Column | None = None, least_adv=1e6, least_price=5.0, least_cap=1e9) -> Column:
    tests = [("adv", col(adv) >= least_adv), ("price", col(price) >= least_price), ("market_cap", col(cap) >= least_cap)]
    return exclusion_reason(tests + ([("tag", tag)] if tag is not None else []))


def ranked_cascade(df: DataFrame, keys: list[str], n: int, entity: str = "ticker", adv="adv", price="close", cap="market_cap", least_adv=1e6, least_price=5.0, least_cap=1e9) -> DataFrame:
    """Price, volume, size, then the n largest; the rest have the reason ``rank``."""
    d = df.withColumn("exclusion_reason", exclusion_reason([("price", F.col(price) >= least_price), ("adv", F.col(adv) >= least_adv), ("market_cap", F.col(cap) >= least_cap)]))
    passed = F.col("exclusion_reason").isNull()
    r = F.row_number().over(Window.partitionBy(*keys, passed).orderBy(F.coalesce(F.col(cap), F.lit(0.0)).desc(), entity))
    return d.withColumn("cap_rank", F.when(passed, r)).withColumn("exclusion_reason", F.when(F.col("cap_rank") > n, "rank").otherwise(F.col("exclusion_reason")))


def stage_counts(df: DataFrame, keys: list[str], stages: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_start"), *[F.sum(F.coalesce((F.col("exclusion_reason") == s).cast("long"), F.lit(0))).alias(f"n_{s}") for s in stages], F.sum(F.col("exclusion_reason").isNull().cast("long")).alias("n_passed"))


def common_stock(kind="type", market="market", locale="locale") -> Column:
    return (F.upper(col(kind)) == "CS") & (F.lower(col(market)) == "stocks") & (F.lower(col(locale)) == "us")


def active_as_of(delisted, as_of) -> Column:
    return col(delisted).isNull() | (col(delisted) > col(as_of))


def delisted_between(delisted, since, until) -> Column:
    return (col(delisted) >= col(since)) & (col(delisted) < col(until))


def in_categories(df: DataFrame, categories: DataFrame, names: list[str], entity: str = "ticker") -> DataFrame:
    """Rows of entities in any of the categories, once each."""
    return df.join(category_members(categories, names, entity), entity, "left_semi")


def category_members(categories: DataFrame, names: list[str], entity: str = "ticker") -> DataFrame:
    return categories.where(F.col("category").isin(names)).select(entity).distinct().orderBy(entity)


def adjacent_changes(df: DataFrame, date: str, entity: str) -> DataFrame:
    """date, n, n_added, n_removed, turnover against the previous date of the table."""
    dates = df.select(date).distinct()
    step = dates.withColumn("_next", F.lead(date).over(Window.orderBy(date))).withColumn("_first", F.lag(date).over(Window.orderBy(date)).isNull())
    a = df.select(date, entity).distinct()
    was = a.join(step, date).where("_next IS NOT NULL").select(F.col("_next").alias(date), entity, F.lit(1).alias("_was"))
    both = a.withColumn("_is", F.lit(1)).join(was, [date, entity], "full")
    one = lambda c: F.sum(c.cast("long"))
    g = both.groupBy(date).agg(F.count("_is").alias("n"), F.count("_was").alias("n_before"), one(F.col("_was").isNull()).alias("n_added"), one(F.col("_is").isNull()).alias("n_removed"))
    return g.where("n_before > 0").withColumn("turnover", (F.col("n_added") + F.col("n_removed")) / (F.col("n") + F.col("n_before"))).select(date, "n", "n_added", "n_removed", "turnover")


def universe_turnover(df: DataFrame, date: str, entity: str) -> DataFrame:
    """Mean over dates of (adds + removals) / (2 * average size)."""
    return adjacent_changes(df, date, entity).agg(F.avg("turnover").alias("mean_turnover"), F.count(F.lit(1)).alias("n_changes"))
