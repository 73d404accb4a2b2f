"""Panel views of the test tables: daily bars of suppliers, monthly bars, labelled evaluation rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranks import pct_rank, ts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(price):
    """Money in whole cents, so that sums do not depend on the order of rows."""
    return F.round(F.col(price) * 100).cast("long")


def mean_price(price: str = "l_extendedprice", quantity: str = "l_quantity"):
    return F.sum(cents(price)).cast("double") / (F.sum(quantity) * 100)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, close, volume: the mean price of a supplier's shipments of a day."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("date"), "l_extendedprice", "l_quantity")
    return d.groupBy("ticker", "date").agg(mean_price().alias("close"), F.sum("l_quantity").alias("volume"))


def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, close: the same over all suppliers."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"), "l_extendedprice", "l_quantity")
    return d.groupBy("date").agg(mean_price().alias("close"))


def mbars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, month, date (last day with a bar), close, volume."""
    b = bars(spark, sf_dir)
    return b.groupBy("ticker", F.trunc("date", "MM").alias("month")).agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"))


def mbench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench(spark, sf_dir).groupBy(F.trunc("date", "MM").alias("month")).agg(F.max_by("close", "date").alias("bclose"))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, sector: the supplier's region."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("ticker"), F.col("r_name").alias("sector"))


def mpanel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly panel: momentum over 1, 3, 6 and 12 bars, volatility of 6 monthly returns, money volume."""
    w = ts("ticker", "month")
    d = mbars(spark, sf_dir)
    d = d.withColumns({f"mom_{k}m": F.col("close") / F.lag("close", k).over(w) - 1 for k in (1, 3, 6, 12)})
    last6 = w.rowsBetween(-5, 0)
    d = d.withColumn("vol_6m", F.when(F.count("mom_1m").over(last6) == 6, F.round(F.stddev_samp("mom_1m").over(last6), 8)))
    d = d.withColumn("adv", F.col("close") * F.col("volume") / 21.0)
    return d.join(sectors(spark, sf_dir), "ticker", "left")


HORIZONS = {20: 1, 60: 3}


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """as_of_date, ticker, sector, horizon, fold_id, score, excess_return, adv, vol_6m, mom_1m: scores are 12-bar
    momentum; returns are over 1 or 3 months ahead, less the benchmark's."""
    w = ts("ticker", "month")
    d = mpanel(spark, sf_dir).join(F.broadcast(mbench(spark, sf_dir)), "month")  # a row a month
    d = d.withColumns({f"_x{h}": F.lead("close", k).over(w) / F.col("close") - F.lead("bclose", k).over(w) / F.col("bclose") for h, k in HORIZONS.items()})
    ahead = [F.struct(F.lit(h).alias("horizon"), F.col(f"_x{h}").alias("excess_return")) for h in HORIZONS]
    d = d.select(F.col("month").alias("as_of_date"), "ticker", "sector", F.concat(F.lit("f"), F.year("month").cast("string")).alias("fold_id"), F.col("mom_12m").alias("score"), "adv", "vol_6m", "mom_1m", F.explode(F.array(*ahead)).alias("_h"))
    return d.select("as_of_date", "ticker", "sector", "_h.horizon", "fold_id", "score", "_h.excess_return", "adv", "vol_6m", "mom_1m").where("score IS NOT NULL AND excess_return IS NOT NULL")


def loss_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows with rank_score, rank_actual, rank_loss, and expected losses: g_pred (mean
    of the ticker's last 6 losses before), a_value (the date's 10th percentile), ehat_raw."""
    keys = ["as_of_date", "horizon"]
    d = eval_rows(spark, sf_dir).withColumns({"rank_score": pct_rank("score", *keys), "rank_actual": pct_rank("excess_return", *keys)})
    d = d.withColumn("rank_loss", F.round(F.abs(F.col("rank_actual") - F.col("rank_score")), 8))
    w = Window.partitionBy("ticker", "horizon").orderBy("as_of_date").rowsBetween(-6, -1)
    d = d.withColumn("g_pred", F.round(F.avg("rank_loss").over(w), 8))
    d = d.withColumn("a_value", F.round(F.percentile("rank_loss", F.lit(0.1)).over(Window.partitionBy(*keys)), 8))
    return d.withColumn("ehat_raw", F.round(F.greatest(F.col("g_pred") - F.col("a_value"), F.lit(0.0)), 8)).where("g_pred IS NOT NULL")


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily benchmark with returns: date, close, ret."""
    w = Window.orderBy("date")  # a row a day: a few thousand at any size
    return bench(spark, sf_dir).withColumn("ret", F.col("close") / F.lag("close", 1).over(w) - 1)


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, period_end, filing_date, observed_at, field, value: a supplier's quarterly sums, filed 45
    days after the quarter, and a revision of revenue 30 days later."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("date"), "l_extendedprice", "l_quantity", "l_discount")
    q = d.groupBy("ticker", F.last_day(F.add_months(F.trunc("date", "quarter"), 2)).alias("period_end")).agg((F.sum(cents("l_extendedprice")).cast("double") / 100).alias("revenue"), (F.sum(cents("l_extendedprice") * (100 - F.round(F.col("l_discount") * 100).cast("long"))).cast("double") / 10000).alias("income"), F.sum("l_quantity").alias("equity"))
    base = q.select("ticker", "period_end", F.date_add("period_end", 45).alias("filing_date"), F.date_add("period_end", 45).alias("observed_at"), F.explode(F.create_map(F.lit("revenue"), F.col("revenue"), F.lit("income"), F.col("income"), F.lit("equity"), F.col("equity"))).alias("field", "value"))
    revised = base.where("field = 'revenue'").select("ticker", "period_end", "filing_date", F.date_add("observed_at", 30).alias("observed_at"), "field", (F.col("value") * 1.5).alias("value"))
    return base.unionByName(revised)


def pit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ticker, event_type, event_date, observed_at, payload, value."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("ticker"), "event_type", F.col("ts").cast("date").alias("event_date"), F.col("ts").cast("timestamp").alias("observed_at"), F.col("props").alias("payload"), "value")
