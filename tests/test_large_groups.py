"""Order statistics of large groups, sums and falls by blocks, and reads by intervals, against plain windows and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.catalog import QUERIES
from panelwright.functions import ranks as R
from panelwright.operators import order, pit, policy, series, stats


def table(spark, n=600, seed=1):
    draw = random.Random(seed)
    odd = [None, float("inf"), float("-inf"), 0.0, -0.0, 1e-310, 1e300]
    value = lambda: draw.choice(odd) if draw.random() < 0.1 else round(draw.gauss(0, 1), draw.choice([1, 6]))
    rows = [(draw.choice([None, "a", "a", "a", "b"]), value(), value(), draw.choice([None, 0, 1])) for _ in range(n)]
    return spark.createDataFrame(rows, "k string, x double, y double, l int")


@pytest.mark.parametrize("most", [1 << 20, 3])
def test_ranks_equal_the_windows_however_small_the_cells(spark, monkeypatch, most):
    monkeypatch.setattr(order.offsets, "__defaults__", (("_c",), most, 42))
    d = table(spark)
    got = order.with_rank(d, "x", ["k"], "r").select("k", "x", "r").collect()
    want = d.select("k", "x", R.avg_rank("x", "k").alias("r")).collect()
    key = lambda r: (str(r[0]), str(r[1] and r[1] + 0.0), r[2] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)
    for a, b in ((order.auroc, R.auroc), (order.average_precision, R.average_precision)):
        x, y = ({r[0]: r[1] for r in f(d, "l", "x", ["k"]).collect()} for f in (a, b))
        assert x.keys() == y.keys() and all(x[k] == pytest.approx(y[k], rel=1e-12) for k in x)


def test_rank_correlation_equals_the_windows(spark):
    d = table(spark).where("abs(x) < 1e9 AND abs(y) < 1e9")
    a, b = ({r.k: (r.rho, r.n) for r in f(d, "x", "y", ["k"]).collect()} for f in (order.spearman, R.spearman))
    assert a.keys() == b.keys() and all(a[k][1] == b[k][1] and a[k][0] == pytest.approx(b[k][0], abs=1e-9) for k in a)


def test_ordered_bits_keep_the_order_of_doubles(spark):
    xs = [float("-inf"), -1e300, -1.5, -1e-320, 0.0, 5e-324, 1.0, math.nextafter(1.0, 2.0), 1e300, float("inf"), float("nan")]
    got = [r.b for r in spark.createDataFrame([(x,) for x in xs], "x double").select(order.ordered_bits(F.col("x")).alias("b")).collect()]
    assert got == sorted(set(got)) and len(got) == len(xs)
    zeros = spark.createDataFrame([(0.0,), (-0.0,)], "x double").select(order.ordered_bits(F.col("x")).alias("b")).distinct().count()
    assert zeros == 1


def test_quantiles_are_exact(spark):
    d = table(spark).where("abs(x) < 1e9")
    ps = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.731, "e": 1.0}
    groups = {}
    for r in d.collect():
        groups.setdefault(r.k, []).append(r.x)
    for r in order.quantiles(d, "x", ps, ["k"]).collect():
        xs = sorted(groups[r.k])
        for n, p in ps.items():
            at = (len(xs) - 1) * p
            lo, hi = xs[math.floor(at)], xs[math.ceil(at)]
            assert r[n] == (lo if lo == hi else lo + (hi - lo) * (at - math.floor(at)))
    empty = order.quantiles(d.where("false"), "x", ps).collect()
    assert [tuple(r) for r in empty] == [(None,) * 5]
    same = d.withColumn("x", F.lit(2.5))
    assert tuple(order.quantiles(same, "x", ps).first()) == (2.5,) * 5


def test_buckets_of_large_groups_equal_the_small_ones(spark):
    d = table(spark).where("abs(x) < 1e9 AND k IS NOT NULL")
    a, b = (sorted((r.k, r.x, r.bucket) for r in f(d, "x", ["k"], 4).collect()) for f in (order.bucket_by_edges, R.bucket_by_edges))
    assert a == b


# Blocks ---------------------------------------------------------------------------------------


def brute_beta(a, m, n, least):
    out = []
    for i in range(len(a)):
        pairs = [(x, y) for x, y in zip(a[max(0, i - n + 1) : i + 1], m[max(0, i - n + 1) : i + 1]) if x is not None and y is not None]
        if len(pairs) < max(least, 2):
            out.append(None)
            continue
        x, y = np.array(pairs).T
        if not np.isfinite(x).all() or not np.isfinite(y).all():
            out.append(math.nan)
        else:
            out.append(((x - x.mean()) * (y - y.mean())).sum() / ((y - y.mean()) ** 2).sum())
    return out


@pytest.mark.parametrize("odd", [float("nan"), float("inf"), None])
def test_beta_recovers_after_an_odd_return(spark, odd):
    draw = random.Random(5)
    a, m = [draw.gauss(0, 1) for _ in range(40)], [draw.gauss(0, 1) for _ in range(40)]
    a[5] = odd
    d = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(zip(a, m))], "e int, d int, a double, m double")
    got = [r.beta for r in series.beta(d, "a", "m", 10, ["e"], "d", least=8).orderBy("d").collect()]
    for x, y in zip(got, brute_beta(a, m, 10, 8)):
        assert (x is None) == (y is None) and (x is None or (math.isnan(x) and math.isnan(y)) or x == pytest.approx(y, abs=1e-9))
    assert got[20] is not None and not math.isnan(got[20])


@pytest.mark.parametrize("n", [1, 2, 7, 60])
def test_falls_of_windows_without_lists(spark, n):
    draw = random.Random(n)
    xs = [None if draw.random() < 0.03 else round(math.exp(draw.gauss(0, 0.3)), 3) for _ in range(90)]
    d = spark.createDataFrame([(k, i, x) for k in (1, 2) for i, x in enumerate(xs[: 90 // k])], "e int, d int, x double")
    for r in series.window_drawdown(d, "x", n, ["e"], "d", "online", "dd").collect():
        own = xs[max(0, r.d - n + 1) : r.d + 1]
        if len(own) < n or None in own:
            assert r.dd is None
        else:
            assert r.dd == pytest.approx(min(own[j] / max(own[: j + 1]) - 1 for j in range(n)), abs=1e-12)


def test_an_odd_value_of_a_group_is_in_its_own_days_only(spark):
    rows = [("a", "g", 1, 1.0), ("b", "g", 2, 3.0), ("c", "g", 3, float("nan")), ("c", "g", 5, 2.0), ("d", "g", 7, float("inf")), ("d", "g", 8, 6.0)]
    d = spark.createDataFrame(rows, "e string, g string, n int, x double").withColumn("d", F.date_add(F.lit("2024-01-01").cast("date"), F.col("n")))
    got = {r.d.toordinal() - 738886: (r.n, r.mean, r["std"]) for r in pit.latest_within(d, "e", "g", "d", "x", 30).collect()}
    assert got[1][:2] == (1, 1.0) and got[2] == (2, 2.0, pytest.approx(math.sqrt(2)))
    assert math.isnan(got[3][1]) and math.isnan(got[3][2])
    assert got[5] == (3, pytest.approx(2.0), pytest.approx(1.0)) and got[7][1] == float("inf") and got[8][:2] == (4, pytest.approx(3.0))


# Reads ----------------------------------------------------------------------------------------


def test_reads_at_many_dates_equal_one_read_a_date(spark):
    draw = random.Random(8)
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    facts = spark.createDataFrame([(draw.randint(1, 4), draw.choice("uv"), draw.randint(0, 60), draw.randint(0, 200), float(i)) for i in range(300)], "ticker int, field string, p int, o int, value double")
    facts = facts.select("ticker", "field", day(F.col("p")).alias("period_end"), day(F.col("o")).alias("observed_at"), "value").persist()
    as_of = spark.range(0, 230, 3).select(day(F.col("id").cast("int")).alias("as_of"))
    for last in (True, False):
        keys = ["ticker", "field"] + ([] if last else ["period_end"])
        got = pit.read_bitemporal(facts, as_of, last_period_only=last)
        seen = facts.join(as_of, F.col("observed_at") <= F.col("as_of"))
        want = pit.latest(seen, ["as_of", *keys], [F.col(c).desc() for c in ("period_end", "observed_at", "value")])
        cols = ["as_of", *facts.columns]
        assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    one = facts.groupBy("ticker", F.col("observed_at").alias("date")).agg(F.max("value").alias("value"))
    seen = one.join(as_of, F.col("date") <= F.col("as_of"))
    n = F.row_number().over(Window.partitionBy("as_of", "ticker").orderBy(F.col("date").desc()))
    want = seen.withColumn("n", n).where("n <= 5").groupBy("as_of", "ticker").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("c"))
    got = pit.last_rows(one, as_of, "ticker", "date", 5).groupBy("as_of", "ticker").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("c"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    mean = pit.average_of_last(one, as_of, "ticker", "date", "value", 5)
    assert sorted((r.as_of, r.ticker, round(r.avg_value * r.n_rows, 6), r.n_rows) for r in mean.collect()) == sorted((r[0], r[1], round(r[2], 6), r[3]) for r in want.collect())


def test_dates_are_not_shuffled_with_the_rows(spark):
    facts = spark.createDataFrame([(1, "u", 1.0)], "ticker int, field string, value double").withColumns({c: F.lit("2024-01-01").cast("date") for c in ("period_end", "observed_at")})
    as_of = spark.range(50).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("as_of"))
    plan = pit.read_bitemporal(facts, as_of)._jdf.queryExecution().executedPlan().toString()
    assert "first(_points" not in plan and "_points" not in "".join(line for line in plan.splitlines() if "hashpartitioning" in line)


# Policies -------------------------------------------------------------------------------------


def test_policies_take_names_of_any_type(spark):
    draw = random.Random(3)
    rows = [(t, f"N{i:02d}", i, draw.gauss(0, 1), draw.gauss(0, 0.1), t != 2) for t in range(5) for i in range(12)]
    d = spark.createDataFrame(rows, "t int, s string, i long, score double, excess_return double, active boolean")
    d = d.withColumn("as_of_date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("t"))).withColumns({"variant": F.lit("raw"), "long_score": F.col("score"), "short_score": F.col("score")})
    a, b = ([tuple(r) for r in policy.policy_series(d.withColumn("ticker", F.col(c)), 3).orderBy("as_of_date").collect()] for c in ("s", "i"))
    assert a == b and [r[2] for r in a] == [False, False, True, False, False] and a[3][3] == 1.0


# Sliding dates --------------------------------------------------------------------------------


def test_stretches_make_up_the_window(spark):
    for levels in (0, 1, 3, 5):
        w = spark.range(1, 80).select(F.col("id").cast("int").alias("t")).crossJoin(spark.range(1, 70, 7).select(F.col("id").cast("int").alias("n")))
        w = w.select("t", "n", order.nodes_of_window(F.greatest(F.col("t") - F.col("n"), F.lit(1)), F.col("t"), levels).alias("x"))
        for r in w.collect():
            seen = sorted(i for x in r.x for i in range(x.node << x.level, (x.node + 1) << x.level))
            assert seen == list(range(max(r.t - r.n, 1), r.t))


@pytest.mark.parametrize("dates", [1, 2, 7, 60])
def test_sliding_order_statistics_equal_sorted_windows(spark, dates):
    draw = random.Random(dates)
    value = lambda: draw.choice([None, 0.5, 0.5 + 2**-40, -1.0, float("inf")]) if draw.random() < 0.3 else draw.gauss(0, 1)
    rows = [(k, t, value()) for k in ("a", "b") for t in range(90) for _ in range(draw.randint(1, 4))]
    d = spark.createDataFrame(rows, "k string, t int, x double")
    got = order.sliding(d, "x", {"low": lambda n: n * 0, "mid": lambda n: F.floor(n / 2)}, dates, ["k"], "t")
    got = {(r.k, r.t): (r.low, r.mid, r.n_values, r.n_dates) for r in got.collect()}
    want = {}
    for k in ("a", "b"):
        for t in range(90):
            seen = [(u, x) for q, u, x in rows if q == k and t - dates <= u < t and x is not None]
            if seen:
                xs = sorted(x for _, x in seen)
                want[k, t] = (xs[0], xs[len(xs) // 2], len(xs), len({u for u, _ in seen}))
    assert got == want


def test_pairs_are_correlated_over_the_dates_both_have(spark):
    draw = random.Random(6)
    x = {(e, t): draw.gauss(0, 1) + (t % 3) for e in range(11) for t in range(40) if draw.random() < 0.6}
    d = spark.createDataFrame([(f"n{e}", t, v) for (e, t), v in x.items()] + [("gone", 3, None)], "e string, t int, x double")
    days = sorted({t for _, t in x})
    for block, chunk in ((256, 64), (3, 4)):
        got = {r.t: (r.mean_corr, r.n_pairs) for r in stats.pairwise_mean_correlation(d, "x", "e", "t", 7, 4, block, chunk).collect()}
        for k, t in enumerate(days):
            seen, found = days[max(0, k - 6) : k + 1], []
            for a in range(11):
                for b in range(a):
                    p = [(x[a, u], x[b, u]) for u in seen if (a, u) in x and (b, u) in x]
                    if len(p) >= 4:
                        found.append(np.corrcoef(np.array(p).T)[0, 1])
            assert (t in got) == bool(found) and (not found or (got[t][1] == len(found) and got[t][0] == pytest.approx(np.mean(found), abs=1e-9)))


def test_pair_correlations_of_many_names_without_pairs(spark, monkeypatch):
    """Both ways of windows agree, and the way by masks deals a row to a window a bounded number of times, however many names there are."""
    draw = random.Random(7)
    x = [(e, t, float(e % 5 == 0) if e % 7 == 0 else draw.gauss(0, 1)) for e in range(700) for t in range(9) if draw.random() < 0.7]
    d = spark.createDataFrame([*x, (1, 20, None)], "e long, t int, x double")
    plain = stats._correlation_by_blocks
    monkeypatch.setattr(stats, "_correlation_by_blocks", lambda *a: pytest.fail("pairs of blocks"))
    masks = {r.t: r for r in stats.pairwise_mean_correlation(d, "x", "e", "t", 5, 3).collect()}
    monkeypatch.setattr(stats, "_correlation_by_blocks", plain)
    monkeypatch.setattr(stats, "MASK_DATES", 0)
    blocks = {r.t: r for r in stats.pairwise_mean_correlation(d, "x", "e", "t", 5, 3).collect()}
    assert set(masks) == set(blocks) and 20 in masks
    assert all(masks[t].n_pairs == r.n_pairs and masks[t].mean_corr == pytest.approx(r.mean_corr, abs=1e-9) for t, r in blocks.items())


@pytest.mark.parametrize("name", ["uncertainty_checks", "aleatoric_alignment", "predictor_comparison", "conditional_range", "epistemic_scaled", "conformal_coverage", "score_drift", "drift_composite"])
def test_rows_that_several_steps_read_are_made_once(spark, name):
    """What the result reads are tables in the shared folder; each step began anew from lineitem."""
    assert not [f for f in QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles() if "lineitem" in f]
