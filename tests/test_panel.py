"""Semantics the SQL comparison can't see: ties, NULLs, empty groups, borders, order of rows."""

import math
from datetime import date, datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.functions import ranks as R
from panelwright.functions import scalars as S
from panelwright.operators import boosting, audits, cross, evaluate, events, labels, learn, pit, policy, portfolio, series, stats, uncertainty, universe


def rows(df, *cols, order=None):
    return [tuple(r) for r in df.select(*cols).orderBy(*(order or cols)).collect()]


def test_average_ranks_with_ties_and_nulls(spark):
    d = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, None)], "i int, x double").withColumn("r", R.avg_rank("x", F.lit(1))).withColumn("p", R.pct_rank("x", F.lit(1)))
    assert rows(d, "i", "r", "p") == [(1, 2.5, 2.5 / 3), (2, 2.5, 2.5 / 3), (3, 1.0, 1 / 3), (4, None, None)]


def test_spearman_is_null_for_constants_and_few(spark):
    d = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("b", 1.0, 3.0), ("b", 2.0, 1.0), ("c", 1.0, None)], "g string, x double, y double")
    assert rows(R.spearman(d, "x", "y", ["g"]), "g", "rho") == [("a", None), ("b", -1.0)]


def test_buckets_merge_equal_edges(spark):
    d = spark.createDataFrame([(i, x) for i, x in enumerate([1.0, 1.0, 1.0, 1.0, 2.0])] + [(9, None)], "i int, x double").withColumn("g", F.lit(1))
    assert rows(R.bucket_by_edges(d, "x", ["g"], 5), "i", "bucket")[-2:] == [(4, 1), (9, None)]
    same = spark.createDataFrame([(1, 3.0), (2, 3.0)], "i int, x double").withColumn("g", F.lit(1))
    assert rows(R.bucket_by_edges(same, "x", ["g"], 5), "bucket") == [(None,), (None,)]


def test_auroc_and_average_precision(spark):
    d = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "y int, s double").withColumn("g", F.lit(1))
    assert R.auroc(d, "y", "s", ["g"]).first().auroc == pytest.approx((1 + 1 + 0.5 + 1) / 4)
    assert R.average_precision(d, "y", "s", ["g"]).first().auprc == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_close_follows_summer_time(spark):
    d = spark.createDataFrame([(date(2024, 1, 10),), (date(2024, 7, 10),)], "d date")
    got = [r[0].hour for r in d.orderBy("d").select(S.close_utc("d").cast("timestamp_ntz")).collect()]
    assert got == [21, 20]


def test_next_open_skips_the_weekend(spark):
    d = spark.createDataFrame([(date(2024, 3, 1),), (date(2024, 3, 2),), (date(2024, 3, 4),)], "d date")
    assert [r[0] for r in d.orderBy("d").select(S.next_weekday("d")).collect()] == [date(2024, 3, 4), date(2024, 3, 4), date(2024, 3, 5)]


def test_costs(spark):
    d = spark.range(1).select(S.trade_cost_bps(F.lit(1e5), F.lit(1e7), F.lit(10.0)).alias("a"), S.trade_cost_bps(F.lit(1e5), F.lit(None).cast("double"), F.lit(10.0)).alias("b"), S.participation(F.lit(5.0), F.lit(10.0)).alias("c"))
    r = d.first()
    assert r.a == pytest.approx(21.0) and r.b == 100.0 and r.c == 1.0


def test_normal_cdf(spark):
    r = spark.range(1).select(S.normal_cdf(F.lit(0.0)).alias("z"), S.normal_cdf(F.lit(1.96)).alias("u"), S.prob_outperform(F.lit(1.0), F.lit(0.0)).alias("n")).first()
    assert abs(r.z - 0.5) < 1e-6 and abs(r.u - 0.9750021) < 1e-6 and r.n is None


def test_window_drawdown_starts_anew(spark):
    d = spark.createDataFrame([(1, i, x) for i, x in enumerate([10.0, 5.0, 6.0, 3.0])], "e int, d int, x double")
    got = rows(series.window_drawdown(d, "x", 2, ["e"], "d", "online", "dd"), "d", "dd")
    assert got == [(0, None), (1, -0.5), (2, 0.0), (3, -0.5)]


def test_ewma_matches_its_definition(spark):
    xs = [1.0, None, 3.0, 2.0]
    d = spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "e int, d int, x double")
    got = [r[1] for r in rows(series.ewma(d, "x", ["e"], "d", 2.0), "d", "ewma")]
    for i, g in enumerate(got):
        w = [(2 ** ((j - i) / 2), x) for j, x in enumerate(xs[: i + 1]) if x is not None]
        assert g == pytest.approx(sum(a * b for a, b in w) / sum(a for a, _ in w))


def test_recursive_ema(spark):
    d = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate([1, 2, 4])], "e int, d int, x double")
    a = 1 - 2 ** (-1 / 5)
    level, want = 1.0, [1.0]
    for x in (2.0, 4.0):
        level = a * x + (1 - a) * level
        want.append(level)
    assert [r[1] for r in rows(series.ema(d, "x", ["e"], "d"), "d", "ema")] == pytest.approx(want)


def test_split_is_found_and_normalised(spark):
    d = spark.createDataFrame([(1, i, 1000.0 if i < 5 else 100.0) for i in range(10)], "e int, d int, close double")
    assert rows(series.detect_splits(d, "close", "e", "d"), "d", "split_ratio") == [(5, 10.0)]
    assert {round(r[0], 6) for r in rows(series.normalize_splits(d, "close", "e", "d"), "split_adjusted")} == {100.0}


def test_asof_join_borders_and_strictness(spark):
    left = spark.createDataFrame([(1, date(2024, 1, 10)), (1, date(2024, 1, 9)), (2, date(2024, 1, 10))], "k int, d date")
    right = spark.createDataFrame([(1, date(2024, 1, 10), 7.0), (1, date(2024, 1, 1), 5.0)], "k int, f date, v double")
    assert rows(pit.asof_join(left, right, ["k"], "d", "f", ["v"]), "k", "d", "v") == [(1, date(2024, 1, 9), 5.0), (1, date(2024, 1, 10), 7.0), (2, date(2024, 1, 10), None)]
    assert rows(pit.asof_join(left, right, ["k"], "d", "f", ["v"], strict=True), "k", "d", "v")[1] == (1, date(2024, 1, 10), 5.0)


def test_many_as_ofs_are_the_union_of_single_ones(spark):
    facts = spark.createDataFrame([("a", "r", date(2024, 3, 31), date(2024, 5, 1), 1.0), ("a", "r", date(2024, 3, 31), date(2024, 6, 1), 2.0), ("a", "r", date(2024, 6, 30), date(2024, 8, 1), 3.0)], "ticker string, field string, period_end date, observed_at date, value double")
    days = [date(2024, 4, 1), date(2024, 5, 1), date(2024, 7, 1), date(2024, 9, 1)]
    many = rows(pit.read_bitemporal(facts, spark.createDataFrame([(d,) for d in days], "as_of date")), "as_of", "value")
    single = [r for d in days for r in rows(pit.read_bitemporal(facts, spark.createDataFrame([(d,)], "as_of date")), "as_of", "value")]
    assert many == sorted(single) == [(days[1], 1.0), (days[2], 2.0), (days[3], 3.0)]


def test_upsert_takes_the_last_write(spark):
    old = spark.createDataFrame([("a", 1, 1.0, 5), ("b", 1, 2.0, 5)], "k string, d int, v double, observed_at int")
    new = spark.createDataFrame([("a", 1, 9.0, 6), ("a", 1, 8.0, 7)], "k string, d int, v double, observed_at int")
    assert rows(pit.upsert(old, new, ["k", "d"]), "k", "v") == [("a", 8.0), ("b", 2.0)]


def test_ticker_change_closes_the_day_before(spark):
    dim = spark.createDataFrame([("x", "OLD", date(2020, 1, 1), None, True)], "stable_id string, ticker string, valid_from date, valid_to date, is_active boolean")
    ch = spark.createDataFrame([("x", "NEW", date(2022, 6, 9))], "stable_id string, new_ticker string, change_date date")
    assert rows(pit.apply_ticker_changes(dim, ch), "ticker", "valid_to", "is_active") == [("NEW", None, True), ("OLD", date(2022, 6, 8), False)]


def test_no_training_label_matures_after_its_cutoff(spark):
    import datetime as dt

    folds = labels.make_folds(labels.period_starts(spark, "2024-01-01", "2024-12-01", 3), "2020-01-01", 3, 20)
    days = [date(2023, 1, 1) + dt.timedelta(days=7 * i) for i in range(100)]
    lab = spark.createDataFrame([(d, "a", 20, datetime(d.year, d.month, d.day) + dt.timedelta(days=29)) for d in days], "as_of_date date, ticker string, horizon int, label_matured_at timestamp")
    got = labels.fold_rows(lab, folds)
    assert got.where("part = 'train' AND label_matured_at > timestamp(train_end)").count() == 0 and got.where("part = 'val'").count() > 0
    assert got.where("part = 'train'").count() > 0


def test_top_k_needs_k_names_and_breaks_ties_by_id(spark):
    d = spark.createDataFrame([("d", "a", 1.0, 0.1), ("d", "b", 1.0, -0.1), ("e", "a", 1.0, 0.1)], "as_of_date string, ticker string, score double, excess_return double")
    got = rows(evaluate.top_k(d, 1, ["as_of_date"]), "as_of_date", "hit_rate", "top_return")
    assert got == [("d", 1.0, 0.1), ("e", 1.0, 0.1)]
    assert rows(evaluate.top_k(d, 2, ["as_of_date"]), "as_of_date", "top_return")[1] == ("e", None)


def test_churn_uses_the_previous_valid_date(spark):
    d = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "a", 1.0), (3, "a", 2.0), (3, "c", 1.0)], "as_of_date int, ticker string, score double").withColumn("horizon", F.lit(20))
    assert rows(evaluate.churn(d, 2), "as_of_date", "churn") == [(3, 0.5)]


def test_shuffled_control_keeps_the_scores(spark):
    d = spark.createDataFrame([(1, 20, f"t{i}", float(i), 0.0) for i in range(20)], "as_of_date int, horizon int, ticker string, score double, excess_return double")
    got = evaluate.shuffled_scores(d)
    assert sorted(r.score for r in got.collect()) == [float(i) for i in range(20)] and got.where("ticker = concat('t', cast(score as int))").count() < 20


def test_policy_flat_days_restart_the_cost(spark):
    d = [(day, t, s, 0.01 * s, day != 2) for day in (1, 2, 3, 4) for t, s in ((1, 3.0), (2, 2.0), (3, 1.0), (4, 0.0))]
    df = spark.createDataFrame(d, "as_of_date int, ticker long, long_score double, excess_return double, active boolean").withColumn("short_score", F.col("long_score")).withColumn("variant", F.lit("v"))
    got = rows(policy.policy_series(df, 1), "as_of_date", "flat", "turnover")
    assert got == [(1, False, 1.0), (2, True, 0.0), (3, False, 1.0), (4, False, 0.0)]


def test_metrics_by_hand(spark):
    r = [0.1, -0.05, 0.02]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(r)], "as_of_date int, ls_return_net double").withColumn("v", F.lit(1))
    m = portfolio.metrics(d, ["v"]).first()
    mean = sum(r) / 3
    std = math.sqrt(sum((x - mean) ** 2 for x in r) / 2)
    assert m.sharpe == pytest.approx(mean / std * math.sqrt(12)) and m.total_return == pytest.approx(1.1 * 0.95 * 1.02 - 1) and m.max_drawdown == pytest.approx(-0.05)


def test_growth_is_undefined_after_more_than_everything_is_lost(spark):
    """As exp(sum(ln(1 + r))): -1 from a return of -100 % on, NaN from a lower one on."""
    d = spark.createDataFrame([(e, i, r) for e, rs in {"a": (0.1, -1.0, 0.5), "b": (0.1, -1.5, 0.5), "c": (-1.0, -2.0, 0.1), "d": (0.5, None, -0.9999999999)}.items() for i, r in enumerate(rs)], "e string, d long, x double")
    w = Window.partitionBy("e").orderBy("d")
    got = d.withColumn("c", series.cumulative_return("x", w)).withColumn("f", series.drawdown("c", w)).orderBy("e", "d").collect()
    nan = math.nan
    assert [r.c for r in got] == pytest.approx([0.1, -1, -1, 0.1, nan, nan, -1, nan, nan, 0.5, 0.5, 1.5e-10 - 1], nan_ok=True)
    assert [r.f for r in got] == pytest.approx([0, -1, -1, 0, nan, nan, -1, nan, nan, 0, 0, 1e-10 - 1], nan_ok=True)


def test_total_return_is_undefined_after_more_than_everything_is_lost(spark):
    d = spark.createDataFrame([(e, i, r) for e, rs in {"a": (0.1, -1.0, 0.5), "b": (0.1, -1.5, 0.5), "c": (-1.0, -2.0, 0.1)}.items() for i, r in enumerate(rs)], "e string, d long, x double")
    m = {r.e: r.total_return for r in portfolio.metrics(d, ["e"], "x", "d").collect()}
    assert m["a"] == -1 and math.isnan(m["b"]) and math.isnan(m["c"])


def test_rolling_quantile_looks_only_back(spark):
    d = spark.createDataFrame([(20, day, float(day * 10 + k)) for day in range(5) for k in range(3)], "horizon int, as_of_date int, v double")
    got = rows(uncertainty.rolling_quantile(d, "v", 0.5, 2, 2), "as_of_date", "threshold", "n_values")
    assert got == [(2, 10.0, 6), (3, 20.0, 6), (4, 30.0, 6)]


def test_selective_ic_gives_each_bucket_its_rank_ic(spark):
    from panelwright import catalog

    day = lambda d, sign: [(d, 20, f"t{i}", float(i), float(i if i < 3 else sign * i), i // 3 / 10.0) for i in range(6)]
    ls = spark.createDataFrame(day(date(2020, 1, 1), -1) + day(date(2020, 2, 1), 1) + [(date(2020, 3, 1), 20, "t0", 1.0, 1.0, 0.5)], "as_of_date date, horizon int, ticker string, score double, excess_return double, ehat_raw double")
    assert rows(uncertainty.selective_ic(ls, ["horizon"], 2), "bucket", "horizon", "mean_ic", "n_dates") == [(0, 20, 1.0, 2), (1, 20, 0.0, 2)]
    assert {"selective_ic", "selective_ic_buckets"} <= set(catalog.QUERIES) & set(catalog.ORACLE_SQL)
    got = catalog.QUERIES["selective_ic_buckets"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["bucket", "horizon", "n_dates", "mean_ic"] and {r.bucket for r in got.collect()} == {0, 1, 2}


def test_scorers_get_whole_texts_in_windows(spark):
    text = "good " * 30 + "bad " * 70
    d = spark.createDataFrame([(1, text), (2, "good"), (3, " "), (4, None), (5, "bad" * 200)], "i int, text string")
    scorer = lambda b: b.str.count("good") - b.str.count("bad") if (b.str.len() <= 100).all() else None
    got = {r.i: r.score for r in learn.score_texts(d, scorer, most=100).collect()}
    parts = learn.text_windows(text, 100)
    assert "".join(parts) == text and max(map(len, parts)) <= 100 and len(parts) > 4
    assert math.isclose(got[1], sum((p.count("good") - p.count("bad")) * len(p) for p in parts) / len(text))
    assert got[2] == 1 and got[3] is None and got[4] is None and got[5] < 0


def test_neutralised_values_have_no_sector_mean_and_no_slope(spark):
    import random

    g = random.Random(1)
    d = spark.createDataFrame([(1, i, "s" if i % 2 else "t", g.random(), g.random()) for i in range(40)], "d int, i int, sector string, beta double, y double")
    n = cross.neutralize(d, "y", ["d"], "sector", "beta")
    assert all(abs(r[0]) < 1e-9 for r in n.groupBy("sector").agg(F.avg("neutral")).select("avg(neutral)").collect())
    few = cross.neutralize(d.limit(3), "y", ["d"], "sector", "beta")
    assert few.where("neutral <> y").count() == 0


def test_ridge_neutralise(spark):
    d = spark.createDataFrame([(1, float(i), 2.0 * i) for i in range(10)], "d int, x double, y double")
    out = cross.neutralize_ridge(d, "y", ["x"], ["d"], penalty=0.0)
    assert all(abs(r.neutral) < 1e-9 for r in out.collect())


def test_feature_blocks(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", -0.8), ("c", "d", 0.1)], "feature_a string, feature_b string, rho double")
    f = spark.createDataFrame([(x,) for x in "abcd"], "feature string")
    assert rows(stats.feature_blocks(pairs, f), "feature", "block", "representative") == [("a", "a", "a"), ("b", "a", "a"), ("c", "a", "a"), ("d", "d", "d")]


def test_universe_reasons(spark):
    d = spark.createDataFrame([(2e6, 10.0, 2e9), (1.0, 10.0, 2e9), (2e6, None, 2e9)], "adv double, close double, market_cap double")
    assert sorted(str(r[0]) for r in d.select(universe.liquidity_cascade()).collect()) == ["None", "adv", "price"]


def test_surprise_streak(spark):
    d = spark.createDataFrame([("a", i, x) for i, x in enumerate([1.0, 2.0, -1.0, -2.0, -3.0])], "ticker string, event_date int, surprise double")
    assert [r[1] for r in rows(events.surprise_features(d), "event_date", "streak")] == [1, 2, -1, -2, -3]


def test_validate_panel_reports(spark):
    d = spark.createDataFrame([(1, 1, 5.0), (1, 1, None)], "d int, t int, x double")
    got = dict(rows(audits.validate_panel(d, ["d", "t"], ["x", "y"], {"x": (0, 1)}), "check", "n_bad"))
    assert got == {"null:x": 1, "range:x": 1, "duplicate_keys": 1, "missing:y": 1}


def test_error_model_uses_earlier_folds_only(spark):
    d = spark.createDataFrame([(f, float(i % 7), float(i % 3)) for f in ("f1", "f2") for i in range(40)], "fold_id string, x double, rank_loss double")
    out = learn.error_model(d, ["x"], ["f1", "f2"], settings=boosting.Settings(trees=2))
    assert {r.fold_id for r in out.select("fold_id").distinct().collect()} == {"f2"} and out.where("g_pred < 0").count() == 0


def test_order_of_rows_does_not_matter(spark):
    d = spark.createDataFrame([(1, 20, f"t{i}", float(i % 5), float((i * 7) % 11)) for i in range(50)], "as_of_date int, horizon int, ticker string, score double, excess_return double")
    a = evaluate.rank_ic(d).first().rank_ic
    b = evaluate.rank_ic(d.orderBy(F.desc("excess_return")).repartition(7)).first().rank_ic
    assert a == pytest.approx(b, abs=1e-12)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "as_of_date date, horizon int, ticker string, score double, excess_return double")
    assert evaluate.rank_ic(d).count() == 0 and evaluate.churn(d, 3).count() == 0 and portfolio.long_short(d, 3, ["horizon"]).count() == 0


def test_exponential_means_of_long_series(spark):
    n, h = 8000, 5.0
    d = spark.range(n).select(F.lit("a").alias("g"), F.col("id").cast("int").alias("i"), F.when(F.col("id") % 7 == 3, None).when(F.col("id").between(4000, 7000), None).otherwise((F.col("id") % 11).cast("double")).alias("x"))
    got = rows(series.ewma(d, "x", ["g"], "i", h), "i", "ewma")
    fade, s, w = 2 ** (-1 / h), 0.0, 0.0
    for i, value in got:
        s, w = s * fade, w * fade
        if not (i % 7 == 3 or 4000 <= i <= 7000):
            s, w = s + i % 11, w + 1
        if w > 1e-200:
            want = s / w
        assert value == pytest.approx(want, rel=1e-9)
    a, level = 1 - fade, None
    known = rows(series.ema(d, "x", ["g"], "i", h), "i", "ema")
    assert len(known) == sum(not (i % 7 == 3 or 4000 <= i <= 7000) for i in range(n))
    for i, value in known:
        level = float(i % 11) if level is None else a * (i % 11) + (1 - a) * level
        assert value == pytest.approx(level, rel=1e-9, abs=1e-12)


def test_reads_at_dates_deal_rows_once(spark):
    day = lambda k: date(2024, 1, k)
    d = spark.createDataFrame([("a", day(1), 1.0), ("a", day(3), 3.0), ("a", day(9), 9.0), ("b", day(4), 4.0), (None, day(1), 0.5)], "ticker string, date date, x double")
    at = spark.createDataFrame([(day(2),), (day(5),), (day(8),), (day(5),)], "as_of date")
    got = {(r.as_of.day, r.ticker): r.x for r in pit.last_value(d, at, "ticker", "date", "x").collect()}
    assert got == {(2, "a"): 1.0, (5, "a"): 3.0, (8, "a"): 3.0, (5, "b"): 4.0, (8, "b"): 4.0, (2, None): 0.5, (5, None): 0.5, (8, None): 0.5}
    assert pit.last_value(d, at.limit(0), "ticker", "date", "x").count() == 0
    two = {(r.as_of.day, r.ticker): (r.avg_x, r.n_rows) for r in pit.average_of_last(d, at, "ticker", "date", "x", 2).collect()}
    assert two[(5, "a")] == (2.0, 2) and two[(2, "a")] == (1.0, 1) and two[(8, "b")] == (4.0, 1)


def test_statistics_of_the_latest_values(spark):
    day = lambda k: date(2024, 1, k)
    rows_ = [("a", day(1), 1.0), ("b", day(2), 5.0), ("a", day(4), 3.0), ("c", day(20), 7.0), ("b", day(20), None)]
    d = spark.createDataFrame([(e, "g", t, x) for e, t, x in rows_], "e string, g string, d date, x double")
    got = {r.d.day: (r.n, r.mean) for r in pit.latest_within(d, "e", "g", "d", "x", 10).collect()}
    assert got[1] == (1, pytest.approx(1.0)) and got[2] == (2, pytest.approx(3.0)) and got[4] == (2, pytest.approx(4.0)) and got[20] == (1, pytest.approx(7.0))
