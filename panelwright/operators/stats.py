"""Statistics over panels: correlations of features, collinearity, residuals, shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import avg_rank, safe_corr, spearman
from . import order
from .cross import neutralize


def pooled_ic(df: DataFrame, x: str, y: str, least: int = 30) -> DataFrame:
    """One rank correlation over all rows.  The ranks of all rows are made from counts by distinct value, so no
    task holds them all unless all values differ."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    for c, name in ((x, "_rx"), (y, "_ry")):
        d = d.join(global_ranks(d, c, name), c)
    return d.agg(F.count(F.lit(1)).alias("n"), safe_corr("_rx", "_ry").alias("rho")).withColumn("rho", F.when(F.col("n") >= least, F.col("rho")))


def global_ranks(df: DataFrame, x: str, name: str) -> DataFrame:
    """x, name: average rank over the whole table, a row for each value."""
    d = order.offsets(order.counted(df, x, []), [])
    kind = df.schema[x].dataType
    return d.select(F.col("_x").cast(kind).alias(x), (F.col("_before_c") + (F.col("_c") + 1) / 2.0).alias(name))


def correlation_pairs(df: DataFrame, features: list[str], method: str = "spearman", keys: list[str] | None = None) -> DataFrame:
    """feature_a < feature_b, rho, n: all pairs of a list of features in one aggregation (pairwise complete rows)."""
    d, names = df, {f: f for f in features}
    if method == "spearman":
        keys = keys or []
        if keys:
            d = df.withColumns({f"_r_{f}": avg_rank(f, *keys) for f in features})
        else:
            for f in features:
                d = d.join(global_ranks(d.where(F.col(f).isNotNull()), f, f"_r_{f}"), f, "left")
        names = {f: f"_r_{f}" for f in features}
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    out = []
    for a, b in pairs:
        both = F.col(names[a]).isNotNull() & F.col(names[b]).isNotNull()
        out.append(F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), safe_corr(names[a], names[b]).alias("rho"), F.sum(both.cast("long")).alias("n")))
    return d.agg(F.array(*out).alias("p")).select(F.inline("p"))


def feature_blocks(pairs: DataFrame, features: DataFrame, least: float = 0.7) -> DataFrame:
    """feature, block (its smallest name), size, mean |rho| and the representative of connected groups with |rho| >= ``least``.

    ``features``: one column feature.  A feature list is short; labels spread until they rest."""
    both = pairs.select("feature_a", "feature_b", F.abs("rho").alias("r")).unionByName(pairs.select(F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), F.abs("rho").alias("r"))).where(F.col("r") >= least)
    both = both.persist()
    now = features.select("feature", F.col("feature").alias("block"))
    while True:
        near = both.join(now.withColumnsRenamed({"feature": "feature_b"}), "feature_b").groupBy(F.col("feature_a").alias("feature")).agg(F.min("block").alias("_m"))
        new = now.join(near, "feature", "left").select("feature", F.least("block", F.coalesce("_m", "block")).alias("block"), (F.coalesce("_m", "block") < F.col("block")).alias("_moved")).persist()
        moved = new.where("_moved").count()
        now = new.select("feature", "block")
        if not moved:
            break
    inside = both.join(now.withColumnsRenamed({"feature": "feature_a"}), "feature_a").join(now.withColumnsRenamed({"feature": "feature_b", "block": "_other"}), "feature_b").where("block = _other")
    per = inside.groupBy("block", F.col("feature_a").alias("feature")).agg(F.avg("r").alias("_r"))
    rep = per.groupBy("block").agg(F.max_by("feature", F.struct("_r", "feature")).alias("representative"), F.avg("_r").alias("mean_rho"))
    size = now.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
    return now.join(size, "block").join(rep, "block", "left").select("feature", "block", "size", "mean_rho", F.coalesce("representative", "block").alias("representative"))


def vif(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, vif = 1 / (1 - R2) on the others: one pass for the correlation matrix, whose inverse has them on its
    diagonal (features x features, on the driver); NULL where the matrix is singular."""
    import numpy as np

    full = df.na.drop(subset=features)
    row = full.agg(*[safe_corr(a, b).alias(f"c{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if i < j]).first() if len(features) > 1 else None
    m = np.eye(len(features))
    for i in range(len(features)):
        for j in range(i + 1, len(features)):
            m[i, j] = m[j, i] = np.nan if row[f"c{i}_{j}"] is None else row[f"c{i}_{j}"]
    try:
        d = np.diag(np.linalg.inv(m)) if np.isfinite(m).all() else np.full(len(features), np.nan)
    except np.linalg.LinAlgError:
        d = np.full(len(features), np.nan)
    return df.sparkSession.createDataFrame([(f, float(v) if np.isfinite(v) else None) for f, v in zip(features, d)], "feature string, vif double")


def neutral_ic(df: DataFrame, features: list[str], label: str, keys: list[str], sector: str = "sector", beta: str = "beta", entity: str = "ticker") -> DataFrame:
    """feature, keys, and the IC raw and after taking out sectors, betas, both."""
    long = df.unpivot([*keys, entity, sector, beta, label], features, "feature", "value")
    k = ["feature", *keys]
    d = neutralize(long, "value", k, sector=sector, name="no_sector")
    d = neutralize(d, "value", k, beta=beta, name="no_beta")
    d = neutralize(d, "value", k, sector=sector, beta=beta, name="no_both")
    out = None
    for c, n in (("value", "ic_raw"), ("no_sector", "ic_sector"), ("no_beta", "ic_beta"), ("no_both", "ic_both")):
        ic = spearman(d, c, label, k, n).drop("n")
        out = ic if out is None else out.join(ic, k, "left")
    return out.withColumns({f"delta_{n}": F.col(f"ic_{n}") - F.col("ic_raw") for n in ("sector", "beta", "both")})


def rolling_pooled_correlation(df: DataFrame, x: str, y: str, date: str, dates: int = 64, least: int = 20) -> DataFrame:
    """date, rho, n: rank correlation over the rows of the last ``dates`` dates (each row is copied to the dates that see it)."""
    idx = df.select(date).distinct().withColumn("_i", F.row_number().over(Window.orderBy(date)))
    last = idx.agg(F.max("_i").alias("_top"))
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).join(F.broadcast(idx), date).crossJoin(F.broadcast(last))
    d = d.withColumn("_t", F.explode(F.sequence(F.col("_i"), F.least(F.col("_i") + dates - 1, F.col("_top"))))).drop(date, "_i", "_top")
    return spearman(d, x, y, ["_t"], "rho", least).join(F.broadcast(idx.withColumnRenamed("_i", "_t")), "_t").select(date, "rho", "n")


def pair_report(df: DataFrame, pairs: list[tuple[str, str]], by: list[str]) -> DataFrame:
    """Per pair and group: rank correlation, n, and the t statistic of the correlation; all pairs from one scan."""
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("_x"), F.col(b).cast("double").alias("_y")) for a, b in pairs])
    r = order.spearman(df.select(*by, F.inline(each)), "_x", "_y", ["a", "b", *by], "rho")
    return r.withColumn("t", F.try_divide(F.col("rho") * F.sqrt(F.col("n") - 2), F.sqrt(1 - F.col("rho") * F.col("rho"))))


def ols_residuals(df: DataFrame, y: str, x: list[str], keys: list[str], name: str = "residual") -> DataFrame:
    """Residuals of y on x with an intercept by key, by taking out one regressor after the other (Gram-Schmidt over windows):
    exact for any number of regressors, no solver; collinear ones are skipped."""
    ok = F.col(y).isNotNull()
    for c in x:
        ok = ok & F.col(c).isNotNull()
    w = Window.partitionBy(*keys)
    d = df.withColumns({f"_g{i}": F.when(ok, F.col(c)) for i, c in enumerate(x)} | {"_y": F.when(ok, F.col(y))})
    d = d.withColumns({c: F.col(c) - F.avg(c).over(w) for c in [f"_g{i}" for i in range(len(x))] + ["_y"]})
    for i in range(len(x)):
        norm = F.sum(F.col(f"_g{i}") * F.col(f"_g{i}")).over(w)
        later = [f"_g{j}" for j in range(i + 1, len(x))] + ["_y"]
        coefficient = {c: F.when(norm > 1e-18, F.sum(F.col(f"_g{i}") * F.col(c)).over(w) / norm).otherwise(0.0) for c in later}
        d = d.withColumns({c: F.col(c) - coefficient[c] * F.col(f"_g{i}") for c in later})
    return d.withColumn(name, F.col("_y")).drop("_y", *[f"_g{i}" for i in range(len(x))])


def partial_rank_correlation(df: DataFrame, x: str, y: str, given: list[str], keys: list[str]) -> DataFrame:
    d = ols_residuals(df, x, given, keys, "_x")
    d = ols_residuals(d, y, given, keys, "_yy")
    return order.spearman(d, "_x", "_yy", keys, "partial_rho")


def residual_iqr(df: DataFrame, y: str, sector: str, factor: str, keys: list[str]) -> DataFrame:
    d = neutralize(df, y, keys, sector=sector, beta=factor, name="_e")
    return d.groupBy(*keys).agg((F.percentile("_e", F.lit(0.75)) - F.percentile("_e", F.lit(0.25))).alias("residual_iqr"), F.count("_e").alias("n"))


def shape(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """n, mean, sample skewness, quantiles, shares of zeros and positives."""
    n = F.count(x).cast("double")
    g = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.when(F.stddev_pop(x) > 1e-15, F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))).alias("skew"), F.avg((F.col(x) == 0).cast("double")).alias("zero_share"), F.avg((F.col(x) > 0).cast("double")).alias("positive_share"))
    return order.joined(g, order.quantiles(df, x, {"p10": 0.1, "p50": 0.5, "p90": 0.9}, by), by, "left") if by else g.crossJoin(order.quantiles(df, x, {"p10": 0.1, "p50": 0.5, "p90": 0.9}))


def importance_drift(early: DataFrame, late: DataFrame, top: int = 3) -> DataFrame:
    """Both: feature, importance.  Rank correlation and the overlap of the top features."""
    d = early.select("feature", F.col("importance").alias("a")).join(late.select("feature", F.col("importance").alias("b")), "feature").withColumn("_k", F.lit(1))
    rho = spearman(d, "a", "b", ["_k"], "rho")
    r = d.withColumns({"_ra": F.row_number().over(Window.partitionBy("_k").orderBy(F.desc("a"), "feature")), "_rb": F.row_number().over(Window.partitionBy("_k").orderBy(F.desc("b"), "feature"))})
    both = r.groupBy("_k").agg(F.sum(((F.col("_ra") <= top) & (F.col("_rb") <= top)).cast("long")).alias("top_overlap"))
    return rho.join(both, "_k").drop("_k")


def mean_pair_correlation(df: DataFrame, x: str, entity: str, date: str, dates: int = 21) -> DataFrame:
    """date, mean correlation of all pairs of entities over the last ``dates`` dates that each entity has in full.

    With z-scores per entity the mean over pairs is (|sum of z|^2 / T - N) / (N (N - 1)): no pairs are made."""
    idx = df.select(date).distinct().withColumn("_i", F.row_number().over(Window.orderBy(date)))
    d = df.where(F.col(x).isNotNull()).join(F.broadcast(idx), date).select(entity, "_i", x)
    d = d.withColumn("_t", F.explode(F.sequence(F.col("_i"), F.col("_i") + dates - 1)))
    w = Window.partitionBy("_t", entity)
    d = d.withColumns({"_n": F.count(x).over(w), "_m": F.avg(x).over(w), "_s": F.stddev_pop(x).over(w)}).where((F.col("_n") == dates) & (F.col("_s") > 1e-15))
    z = d.withColumn("_z", (F.col(x) - F.col("_m")) / F.col("_s")).groupBy("_t", "_i").agg(F.sum("_z").alias("_z"), F.count(F.lit(1)).alias("_k"))
    g = z.groupBy("_t").agg((F.sum(F.col("_z") * F.col("_z")) / dates).alias("_q"), F.max("_k").alias("n_entities"))
    g = g.withColumn("mean_corr", F.try_divide(F.col("_q") - F.col("n_entities"), F.col("n_entities") * (F.col("n_entities") - 1)))
    return g.join(F.broadcast(idx.withColumnRenamed("_i", "_t")), "_t").select(date, "mean_corr", "n_entities")


#: Windows of so many dates at most are correlated by sums over masks of dates: 3^12 sums a window, whatever the number of entities.
MASK_DATES = 12


def pairwise_mean_correlation(df: DataFrame, x: str, entity: str, date: str, dates: int = 21, least: int = 2, block: int = 256, chunk: int = 64) -> DataFrame:
    """date, mean_corr, n_pairs: mean correlation of all pairs of entities over the last ``dates`` dates, each pair over the dates that both have
    (``least`` of them, and some spread on both sides).  Pairs are never rows.

    Windows of up to ``MASK_DATES`` dates cost in proportion to the entities (``_correlation_by_masks``), longer ones to their pairs (``_correlation_by_blocks``)."""
    idx = df.select(date).distinct().withColumn("_i", F.row_number().over(Window.orderBy(date)))  # a row a date
    d = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).groupBy(entity, date).agg(F.avg(F.col(x).cast("double")).alias("_x")).join(F.broadcast(idx), date)
    sums = _correlation_by_masks(d, idx, entity, dates, least) if dates <= MASK_DATES else _correlation_by_blocks(d, entity, dates, least, block, chunk)
    g = sums.groupBy("_i").agg((F.sum("s") / F.sum("n")).alias("mean_corr"), F.sum("n").alias("n_pairs")).where("n_pairs > 0")
    return g.join(idx, "_i").select(date, "mean_corr", "n_pairs")


def _correlation_by_masks(d: DataFrame, idx: DataFrame, entity: str, dates: int, least: int, low: int = 2) -> DataFrame:
    """d: entity, _i, _x.  _i, s, n: sums of correlations and numbers of pairs, in parts.

    An entity's mask are the dates of the window that it has; a pair is correlated over the dates C that both masks have.  Over a fixed C each entity is a vector
    of norm one, and correlations are inner products; so the sum over all pairs whose masks meet in C comes from the sums S(A) of the vectors by mask A (those
    that have C).  With T(D) = the sum of S over the masks that have D, pairs meeting exactly in C sum to the alternating sum of |T(D)|^2 over the D that have C.  A
    task has one window and the sets C that begin alike on its first ``low`` dates; its sums' size does not grow with the entities."""
    import numpy as np
    import pandas as pd

    low = min(low, dates)
    e = d.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_s"))  # as many as there are dates
    top = idx.agg(F.max("_i").alias("_top"))
    e = e.crossJoin(F.broadcast(top)).withColumn("_t", F.explode(F.sequence(F.col("_s")[0]["_i"], F.least(F.element_at("_s", -1)["_i"] + dates - 1, F.col("_top")))))
    e = e.select("_t", F.filter("_s", lambda r: r["_i"].between(F.col("_t") - dates + 1, F.col("_t"))).alias("_s")).where(F.size("_s") >= least)
    bit = lambda r: F.call_function("shiftleft", F.lit(1), (r["_i"] - F.col("_t") + dates - 1).cast("int"))
    e = e.select("_t", F.aggregate("_s", F.lit(0), lambda n, r: n.bitwiseOR(bit(r))).alias("mask"), F.transform("_s", lambda r: r["_x"]).alias("x"))
    starts = F.filter(F.sequence(F.lit(0), F.lit((1 << low) - 1)), lambda g: g.bitwiseAND(F.col("mask")) == g)
    e = e.select("_t", F.explode(starts).alias("g"), "mask", "x")
    sets = [c for c in range(1 << dates) if bin(c).count("1") >= max(least, 2)]

    def sums(pdf):
        t, g = int(pdf["_t"].iloc[0]), int(pdf["g"].iloc[0])
        masks = pdf["mask"].to_numpy().astype(np.int64)
        has = (masks[:, None] >> np.arange(dates)) & 1 == 1
        v = np.zeros(has.shape)
        v[has] = np.concatenate(pdf["x"].to_numpy())
        order = np.argsort(masks, kind="stable")
        masks, v = masks[order], v[order]
        distinct, first = np.unique(masks, return_index=True)
        ends = np.append(first[1:], len(masks))
        s, n = 0.0, 0
        for c in sets:
            if c & ((1 << low) - 1) != g:
                continue
            hit = distinct & c == c
            if not hit.any():
                continue
            on = [k for k in range(dates) if c >> k & 1]
            off = [k for k in range(dates) if not c >> k & 1]
            size = (ends - first)[hit]
            at = np.repeat(first[hit] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
            z = v[at][:, on]
            z -= z.mean(1, keepdims=True)
            norm = (z * z).sum(1)
            fine = norm > 1e-15
            z = np.where(fine[:, None], z / np.sqrt(np.where(fine, norm, 1.0))[:, None], 0.0)
            starts = np.append(0, np.cumsum(size)[:-1])
            rest = sum((distinct[hit] >> k & 1) << j for j, k in enumerate(off)) if off else np.zeros(int(hit.sum()), np.int64)
            total = np.zeros((1 << len(off), len(on) + 1))
            np.add.at(total, rest, np.column_stack([np.add.reduceat(z, starts, axis=0), np.add.reduceat(fine.astype(float), starts)]))
            own = total[0, -1]  # with itself an entity meets in its whole mask
            sign = np.ones(1)
            for j in range(len(off)):
                total = total.reshape(-1, 2, 1 << j, len(on) + 1)
                total[:, 0] += total[:, 1]
                sign = np.concatenate([sign, -sign])
            total = total.reshape(1 << len(off), len(on) + 1)
            s += (float(sign @ (total[:, :-1] ** 2).sum(1)) - own) / 2
            n += round((float(sign @ total[:, -1] ** 2) - own) / 2)
        return pd.DataFrame({"_i": [t], "s": [s], "n": [n]})

    e = e.repartition(256, "_t", "g")  # few rows, but much work on each: not to be coalesced
    return e.groupBy("_t", "g").applyInPandas(sums, "_i long, s double, n long")


def _correlation_by_blocks(d: DataFrame, entity: str, dates: int, least: int, block: int, chunk: int) -> DataFrame:
    """d: entity, _i, _x.  _i, s, n: sums of correlations and numbers of pairs, in parts.

    Entities are dealt to blocks and dates to chunks; a task has the rows of two blocks over a chunk and gets all windows' sums, squares, products and counts
    by products of masked matrices.  A row goes to as many tasks as there are blocks."""
    import numpy as np
    import pandas as pd

    blocks = max(1, -(-d.select(entity).distinct().count() // block))
    d = d.withColumns({"_b": F.pmod(F.xxhash64(entity), F.lit(blocks)).cast("int"), "_first": F.floor((F.col("_i") - 1) / chunk), "_last": F.floor((F.col("_i") + dates - 2) / chunk)})
    d = d.withColumn("_c", F.explode(F.sequence("_first", "_last"))).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    d = d.select(F.col("_c").cast("int").alias("c"), F.least("_b", "_o").alias("p"), F.greatest("_b", "_o").alias("q"), (F.col("_b") > F.col("_o")).alias("second"), F.xxhash64(entity).alias("e"), F.col("_i").alias("i"), F.col("_x").alias("x"))

    def both(pdf):
        c, p, q = int(pdf["c"].iloc[0]), int(pdf["p"].iloc[0]), int(pdf["q"].iloc[0])
        first = c * chunk + 2 - dates  # the first date that the chunk's windows see

        def filled(part):
            names, at = np.unique(part["e"].to_numpy(), return_inverse=True)
            v = np.full((len(names), chunk + dates - 1), np.nan)
            v[at, part["i"].to_numpy() - first] = part["x"].to_numpy()
            mean = np.nan_to_num(np.nanmean(v, 1, keepdims=True)) if len(names) else 0.0
            return np.nan_to_num(v - mean), (~np.isnan(v)).astype(float)

        a, ma = filled(pdf[~pdf["second"]] if p != q else pdf)
        b, mb = (a, ma) if p == q else filled(pdf[pdf["second"]])
        out = []
        for k in range(chunk):
            s = slice(k, k + dates)
            n = ma[:, s] @ mb[:, s].T
            sa, sb = a[:, s] @ mb[:, s].T, ma[:, s] @ b[:, s].T
            va = (a[:, s] ** 2) @ mb[:, s].T - sa**2 / np.maximum(n, 1)
            vb = ma[:, s] @ (b[:, s] ** 2).T - sb**2 / np.maximum(n, 1)
            fine = (n >= least) & (va > 1e-15) & (vb > 1e-15)
            if p == q:
                fine &= np.triu(np.ones_like(fine), 1)
            if fine.any():
                cov = a[:, s] @ b[:, s].T - sa * sb / np.maximum(n, 1)
                out.append((c * chunk + 1 + k, float((cov[fine] / np.sqrt(va[fine] * vb[fine])).sum()), int(fine.sum())))
        return pd.DataFrame(out, columns=["_i", "s", "n"])

    return d.groupBy("c", "p", "q").applyInPandas(both, "_i long, s double, n long")


__all__ = [n for n in dir() if not n.startswith("_") and n != "annotations"]
