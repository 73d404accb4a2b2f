"""Cross-sectional transforms: keys name the cross-section, normally date or (date, horizon)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import avg_rank, col, pct_rank, xs, zscore
from . import order


def relative_strength(x, *keys) -> Column:
    """z-score of at least 5 values with a deviation over 1e-8, else NULL."""
    return zscore(x, *keys, least=5, floor=1e-8, degenerate=None)


def sector_neutral(x, sector: str, *keys) -> Column:
    """Value less the sector's median."""
    c = col(x)
    return c - F.percentile(c, F.lit(0.5)).over(xs(*keys, sector))


def sector_relative(x, sector: str, *keys, kind: str = "ratio", least: int = 2) -> Column:
    """Against the sector's median: ratio - 1 or difference; NULL with fewer than ``least`` names."""
    c, w = col(x), xs(*keys, sector)
    m = F.percentile(c, F.lit(0.5)).over(w)
    value = F.try_divide(c, m) - 1 if kind == "ratio" else c - m
    return F.when(F.count(c).over(w) >= least, value)


def sentiment_against_momentum(sentiment: str, momentum: str, *keys, least: int = 3) -> Column:
    both = F.col(sentiment).isNotNull() & F.col(momentum).isNotNull()
    s, m = F.when(both, F.col(sentiment)), F.when(both, F.col(momentum))
    n = F.count(F.when(both, 1)).over(xs(*keys))
    return F.when(both & (n >= least), pct_rank(s, *keys) - pct_rank(m, *keys))


def neutralize(df: DataFrame, y: str, keys: list[str], sector: str | None = None, beta: str | None = None, least: int = 5, name: str = "neutral") -> DataFrame:
    """Residual of y on sector dummies and/or beta with an intercept, per cross-section.

    Sectors are taken out by their means, of y and of beta; then the slope of what is left is one
    division.  Cross-sections of fewer than ``least`` complete rows keep y."""
    known = F.col(y).isNotNull()
    for c in (sector, beta):
        if c:
            known = known & F.col(c).isNotNull()
    w, group = xs(*keys), xs(*keys, sector) if sector else xs(*keys)
    yy = F.when(known, F.col(y))
    d = df.withColumns({"_n": F.count(yy).over(w), "_y": yy - F.avg(yy).over(group)})
    if beta:
        bb = F.when(known, F.col(beta))
        d = d.withColumn("_b", bb - F.avg(bb).over(group))
        slope = F.try_divide(F.sum(F.col("_b") * F.col("_y")).over(w), F.sum(F.col("_b") * F.col("_b")).over(w))
        d = d.withColumn("_y", F.col("_y") - F.coalesce(slope, F.lit(0.0)) * F.col("_b")).drop("_b")
    return d.withColumn(name, F.when(F.col("_n") < least, F.col(y)).when(known, F.col("_y"))).drop("_n", "_y")


def neutralize_ridge(df: DataFrame, y: str, factors: list[str], keys: list[str], penalty: float = 1.0, name: str = "neutral") -> DataFrame:
    """Ridge residual on standardised factors; a cross-section of one date is solved in one task."""
    import numpy as np

    def solve(pdf):
        x = pdf[factors].to_numpy(float)
        ok = np.isfinite(x).all(1) & pdf[y].notna().to_numpy()
        out = np.full(len(pdf), np.nan)
        if ok.sum() >= 5:
            z = x[ok] - x[ok].mean(0)
            s = z.std(0)
            z = z / np.where(s > 0, s, 1)
            t = pdf[y].to_numpy(float)[ok]
            t = t - t.mean()
            out[ok] = t - z @ np.linalg.solve(z.T @ z + penalty * np.eye(z.shape[1]), z.T @ t)
        else:
            out = pdf[y].to_numpy(float)
        return pdf.assign(**{name: out})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.groupBy(*keys).applyInPandas(solve, f"{fields}, `{name}` double")


def sector_dummies(df: DataFrame, sector: str, values: list[str]) -> DataFrame:
    return df.withColumns({f"sector_{v}": F.coalesce((F.col(sector) == v).cast("int"), F.lit(0)) for v in values})


def rank_losses(df: DataFrame, score: str, actual: str, keys: list[str]) -> DataFrame:
    """rank_score, rank_actual (percentile ranks), rank_loss and mae_loss."""
    d = df.withColumns({"rank_score": pct_rank(score, *keys), "rank_actual": pct_rank(actual, *keys)})
    return d.withColumns({"rank_loss": F.abs(F.col("rank_actual") - F.col("rank_score")), "mae_loss": F.abs(F.col(actual) - F.col(score))})


def fuse_ranks(scores: list[str], *keys, least: int = 3, default: float = 0.5) -> Column:
    """Mean of the percentile ranks that there are; a score with fewer than ``least`` values in the
    cross-section counts for nothing; ``default`` without any."""
    parts = [F.when(F.count(s).over(xs(*keys)) >= least, pct_rank(s, *keys)) for s in scores]
    known = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    return F.coalesce(F.try_divide(sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)), known), F.lit(default))


def disagreement(ranks: list[Column]) -> Column:
    """Sample deviation of a row's ranks, missing ones at one half."""
    parts = [F.coalesce(r, F.lit(0.5)) for r in ranks]
    m = sum(parts[1:], parts[0]) / len(parts)
    return F.sqrt(sum(((p - m) * (p - m) for p in parts), F.lit(0.0)) / max(len(parts) - 1, 1))


def sizing_constant(df: DataFrame, uncertainty: str, share: float = 0.7, epsilon: float = 1e-4, where: str = "true") -> DataFrame:
    """One row: constant = share * median sqrt(u + epsilon) of the rows that ``where`` names."""
    d = df.where(where).select(F.when(F.col(uncertainty).isNotNull(), F.sqrt(F.greatest(F.col(uncertainty), F.lit(0.0)) + epsilon)).alias("_u"))
    return order.quantiles(d, "_u", {"_m": 0.5}).select((share * F.col("_m")).alias("constant"))


def blend_by_regime(score: str, momentum: str, weight, *keys) -> Column:
    """weight * rank(score) + (1 - weight) * rank(momentum); a missing momentum ranks last."""
    m = F.coalesce(F.col(momentum), F.lit(float("-inf")))
    return col(weight) * pct_rank(score, *keys) + (1 - col(weight)) * pct_rank(m, *keys)


def residual_uncertainty(ehat: str, rank_score: str, *keys) -> Column:
    """Residual of the uncertainty on the score's extremity |rank - 1/2| * 2, per cross-section; 0
    with fewer than 3 names or no spread."""
    w = xs(*keys)
    x, y = F.abs(F.col(rank_score) - 0.5) * 2, F.col(ehat)
    n, mx, my = F.count(y).over(w), F.avg(x).over(w), F.avg(y).over(w)
    var = F.var_pop(x).over(w)
    slope = F.when(var > 1e-15, F.covar_pop(y, x).over(w) / var).otherwise(0.0)
    return F.when(n < 3, 0.0).otherwise(y - my - slope * (x - mx))


def cap_uncertain(score: str, ehat: str, *keys, percentile: float = 0.9, weight: float = 0.7) -> Column:
    limit = F.percentile(F.col(ehat), F.lit(percentile)).over(xs(*keys))
    return F.col(score) * F.when(F.col(ehat) > limit, weight).otherwise(1.0)


def deterministic_rank(score: str, tie: str, *keys) -> Column:
    """1 for the highest score, ties to the smaller id; NULL scores have none."""
    return F.when(F.col(score).isNotNull(), F.row_number().over(xs(*keys).orderBy(F.col(score).desc_nulls_last(), F.col(tie))))


def rank_percentile(rank, count) -> Column:
    return 100.0 * (col(count) - col(rank)) / F.greatest(col(count) - 1, F.lit(1))


def top_n(df: DataFrame, by: str, n: int, keys: list[str], tie: str) -> DataFrame:
    """The n rows with the largest ``by`` of each key; NULL counts as 0."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.coalesce(F.col(by), F.lit(0.0)).desc(), F.col(tie)))
    return df.withColumn("position", r).where(F.col("position") <= n)


def availability(df: DataFrame, features: list[str]) -> DataFrame:
    """has_<feature> masks and the share of features that a row has."""
    d = df.withColumns({f"has_{f}": F.col(f).isNotNull() for f in features})
    return d.withColumn("coverage", sum((F.col(f).isNotNull().cast("int") for f in features), F.lit(0)) / F.lit(float(len(features))))


def new_entity_flag(entity: str, date: str, least: int = 252) -> Column:
    return F.row_number().over(Window.partitionBy(entity).orderBy(date)) <= least


def missing_profile(df: DataFrame, categories: dict[str, list[str]], staleness: dict[str, str] | None = None, date: str = "date") -> DataFrame:
    """Per row: coverage of each category, names of what is missing, days since the staleness columns."""
    d = df.withColumns({f"coverage_{k}": sum((F.col(f).isNotNull().cast("int") for f in v), F.lit(0)) / F.lit(float(len(v))) for k, v in categories.items()})
    every = [f for v in categories.values() for f in v]
    d = d.withColumn("missing", F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in every])))
    d = d.withColumns({"n_missing": F.size("missing"), "complete": F.size("missing") == 0})
    return d.withColumns({f"days_since_{k}": F.datediff(date, c) for k, c in (staleness or {}).items()})


def relevance_grade(x, *keys, least: int = 5) -> Column:
    """0-4 by percentile rank; 2 in cross-sections of fewer than ``least``."""
    n = F.count(col(x)).over(xs(*keys))
    return F.when(col(x).isNull(), None).when(n < least, 2).otherwise(F.least(F.floor(pct_rank(x, *keys) * 5), F.lit(4)).cast("int"))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "avg_rank")]
