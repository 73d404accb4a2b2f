"""Cross-sectional window columns and rank statistics: average ranks, correlation, buckets.

Missing values are NULL throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def xs(*keys):
    """A cross-section."""
    return Window.partitionBy(*keys)


def ts(entity, date):
    """A series of one entity."""
    return Window.partitionBy(*([entity] if isinstance(entity, str) else entity)).orderBy(date)


def present(x) -> Column:
    return F.count(col(x))


def avg_rank(x, *keys) -> Column:
    """Rank from 1 in ascending order, ties at their average; NULL for NULL."""
    c = col(x)
    first = F.rank().over(xs(*keys).orderBy(c.asc_nulls_last()))
    ties = F.count(F.lit(1)).over(xs(*keys, c))
    return F.when(c.isNotNull(), first + (ties - 1) / F.lit(2.0))


def pct_rank(x, *keys) -> Column:
    """Average rank over the number of values: (0, 1]."""
    return F.try_divide(avg_rank(x, *keys), present(x).over(xs(*keys)))


def safe_corr(x, y) -> Column:
    """Pearson correlation as an aggregate; NULL where a side is constant."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 1e-15, F.try_divide(F.covar_pop(a, b), spread))


def with_ranks(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Rows where both are known, with their average ranks _rx and _ry by key."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.withColumns({"_rx": avg_rank(x, *keys), "_ry": avg_rank(y, *keys)})


def spearman(df: DataFrame, x: str, y: str, keys: list[str], name: str = "rho", least: int = 2) -> DataFrame:
    """keys, name, n: rank correlation by key over rows where both are known; NULL under ``least``."""
    found = with_ranks(df, x, y, keys).groupBy(*keys).agg(safe_corr("_rx", "_ry").alias(name), F.count(F.lit(1)).alias("n"))
    return found.withColumn(name, F.when(F.col("n") >= least, F.col(name)))


def zscore(x, *keys, ddof: int = 1, least: int = 1, floor: float = 0.0, degenerate: float | None = 0.0) -> Column:
    """(x - mean) / std by key; ``degenerate`` where the spread is not over ``floor`` or fewer than
    ``least`` values are known; NULL for NULL."""
    c, w = col(x), xs(*keys)
    s = (F.stddev_samp(c) if ddof else F.stddev_pop(c)).over(w)
    ok = (F.count(c).over(w) >= least) & (s > max(floor, 0.0))
    return F.when(c.isNull(), None).when(ok, F.try_divide(c - F.avg(c).over(w), s)).otherwise(F.lit(degenerate))


def winsorize(x, *keys, lower: float = 0.01, upper: float = 0.99) -> Column:
    c, w = col(x), xs(*keys)
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.percentile(c, F.lit(upper)).over(w)), F.percentile(c, F.lit(lower)).over(w)))


def median(x) -> Column:
    return F.percentile(col(x), F.lit(0.5))


def bucket_by_edges(df: DataFrame, x: str, keys: list[str], buckets: int, name: str = "bucket") -> DataFrame:
    """Quantile buckets from 0: right-closed between interpolated edges; equal edges are merged,
    so fewer buckets (and NULL where all values are equal) may result."""
    cuts = F.percentile(F.col(x), F.array(*[F.lit(i / buckets) for i in range(buckets + 1)]))
    edges = df.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.array_distinct(cuts).alias("_edges"))
    joined = df.join(edges, keys, "left")
    inner = F.slice(F.col("_edges"), 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    n = F.size(F.filter(inner, lambda e: e < F.col(x)))
    return joined.withColumn(name, F.when(F.col(x).isNotNull() & (F.size("_edges") > 1), n)).drop("_edges")


def bucket_by_order(x, *keys, buckets: int, tie: str) -> Column:
    """Quantile buckets of the row number (ties by ``tie``): as even as can be."""
    c, w = col(x), xs(*keys)
    r = F.row_number().over(w.orderBy(c.asc_nulls_last(), F.col(tie))) - 1
    n = F.count(c).over(w)
    # edges of the numbers 1..n: right-closed, interpolated
    return F.when(c.isNotNull(), F.greatest(F.ceil(F.try_divide(r * F.lit(float(buckets)), n - 1)) - 1, F.lit(0)).cast("int"))


def auroc(df: DataFrame, label: str, score: str, keys: list[str], name: str = "auroc") -> DataFrame:
    """Mann-Whitney with average ranks; NULL with one class only."""
    d = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).withColumn("_r", avg_rank(score, *keys))
    pos = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    neg = F.sum(F.when(F.col(label) == 1, 0).otherwise(1))
    ranks = F.sum(F.when(F.col(label) == 1, F.col("_r")))
    return d.groupBy(*keys).agg(F.try_divide(ranks - pos * (pos + 1) / 2.0, (pos * neg).cast("double")).alias(name), pos.alias("n_pos"), neg.alias("n_neg"))


def average_precision(df: DataFrame, label: str, score: str, keys: list[str], name: str = "auprc") -> DataFrame:
    """Sum over distinct scores, from the highest, of recall gained times precision."""
    d = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    steps = d.groupBy(*keys, score).agg(F.sum((F.col(label) == 1).cast("long")).alias("_p"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumns({"_tp": F.sum("_p").over(w), "_all": F.sum("_n").over(w), "_total": F.sum("_p").over(Window.partitionBy(*keys))})
    return steps.groupBy(*keys).agg(F.sum(F.try_divide(F.col("_p") * F.col("_tp"), (F.col("_all") * F.col("_total")).cast("double"))).alias(name))


def confusion(df: DataFrame, label: str, predicted: str, keys: list[str]) -> DataFrame:
    """Counts, precision, recall and the share that is not predicted (abstention)."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    count = lambda c: F.sum(c.cast("long"))
    d = df.groupBy(*keys).agg(count(y & p).alias("tp"), count(~y & p).alias("fp"), count(y & ~p).alias("fn"), count(~y & ~p).alias("tn"), F.count(F.lit(1)).alias("n"))
    return d.withColumns({"precision": F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), "recall": F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), "abstention": F.try_divide((F.col("fn") + F.col("tn")).cast("double"), F.col("n"))})


def ks_statistic(df: DataFrame, value: str, is_first: str, keys: list[str], least: tuple[int, int] = (20, 5), name: str = "ks") -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance by key; NULL unless both sides have more than ``least`` values."""
    d = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(F.col(is_first).cast("long")).alias("_a"), F.sum((~F.col(is_first)).cast("long")).alias("_b"))
    return ks_of_counts(d, value, keys, least, name)


def ks_of_counts(df: DataFrame, value: str, keys: list[str], least: tuple[int, int] = (20, 5), name: str = "ks") -> DataFrame:
    """The same of rows that hold how often a value is in the first (_a) and second (_b) sample."""
    d = df.groupBy(*keys, value).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    t = Window.partitionBy(*keys)
    d = d.withColumns({"_na": F.sum("_a").over(t), "_nb": F.sum("_b").over(t)})
    gap = F.abs(F.try_divide(F.sum("_a").over(w).cast("double"), F.col("_na")) - F.try_divide(F.sum("_b").over(w).cast("double"), F.col("_nb")))
    d = d.withColumn("_gap", gap).groupBy(*keys).agg(F.max("_gap").alias("_g"), F.max("_na").alias("n_first"), F.max("_nb").alias("n_second"))
    return d.select(*keys, F.when((F.col("n_first") > least[0]) & (F.col("n_second") > least[1]), F.col("_g")).alias(name), "n_first", "n_second")
