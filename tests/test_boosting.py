"""Boosted trees of all folds in one job a level, against a plain implementation fold by fold."""

import math
import random
from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from panelwright.operators import boosting

UNIT = 1 << 20


def plain(x, y, w, edges, s):
    """A function of one row, grown with loops on one fold's rows."""
    b = lambda row: [0 if v is None or math.isnan(v) else 1 + sum(v > e for e in edges[j]) for j, v in enumerate(row)]
    rows = [b(r) for r in x]
    h = [round(v * UNIT) for v in w]
    base = sum(round(-t * v * UNIT) for t, v in zip(y, w)) / -sum(h)
    margin = [base] * len(rows)
    trees = []
    share = lambda g, k: (g / UNIT) * (g / UNIT) / (k / UNIT + s.penalty)
    leaf = lambda g, k: -s.rate * (g / UNIT) / (k / UNIT + s.penalty)
    for _ in range(s.trees):
        g = [round((m - t) * v * UNIT) for m, t, v in zip(margin, y, w)]

        def grow(own, depth):
            all_g, all_h = sum(g[i] for i in own), sum(h[i] for i in own)
            best = None
            for f in range(len(edges)):
                for at in sorted({rows[i][f] for i in own} - {0}):
                    for null_left in (0, 1):
                        left = [i for i in own if (null_left if rows[i][f] == 0 else rows[i][f] <= at)]
                        if min(len(left), len(own) - len(left)) >= s.least_rows and depth < s.depth:
                            lg, lh = sum(g[i] for i in left), sum(h[i] for i in left)
                            gain = share(lg, lh) + share(all_g - lg, all_h - lh) - share(all_g, all_h)
                            if best is None or gain > best[0]:
                                best = (gain, f, at, null_left, left)
            if best is None or best[0] <= 1e-12:
                return leaf(all_g, all_h)
            _, f, at, null_left, left = best
            return f, at, null_left, grow(left, depth + 1), grow([i for i in own if i not in set(left)], depth + 1)

        trees.append(grow(list(range(len(rows))), 0))
        margin = [m + walk(trees[-1], r) for m, r in zip(margin, rows)]
    return lambda row: base + sum(walk(t, b(row)) for t in trees)


def walk(tree, row):
    while isinstance(tree, tuple):
        f, at, null_left, a, c = tree
        tree = a if (null_left if row[f] == 0 else row[f] <= at) else c
    return tree


def panel(spark, n=240, seed=4):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = (None if draw.random() < 0.15 else round(draw.gauss(0, 1), 2) for _ in range(2))
        y = None if draw.random() < 0.05 else (0.3 if a is None else a) * (1 if (b or 0) > 0 else -1) + draw.gauss(0, 0.1)
        rows.append((i, date(2024, 1, 1) + timedelta(days=i), a, b, draw.choice([1.0, float("nan")]), y, "clash"))
    return rows, spark.createDataFrame(rows, "i long, as_of_date date, a double, b double, c double, label double, fold string")


def test_all_folds_equal_plain_trees(spark):
    rows, d = panel(spark)
    s = boosting.Settings(trees=3, depth=2, bins=6, least_rows=4, rate=0.3)
    spans = [("f1", date(2024, 4, 1), date(2024, 6, 1)), ("f2", date(2024, 6, 1), date(2024, 8, 1)), ("f3", date(2024, 8, 1), date(2025, 1, 1))]
    got = boosting.walk_forward(d.repartition(5), ["a", "b", "c"], "label", spans, ["i"], embargo_days=5, half_life_days=90, settings=s)
    got = {(r.i, r.fold_id): r.pred for r in got.collect()}
    first = [r for r in rows if r[1] < spans[0][1] - timedelta(days=5) and r[5] is not None]
    edges = []
    for j in (2, 3, 4):
        xs = [r[j] for r in first if r[j] is not None and not math.isnan(r[j])]
        edges.append(np.unique([np.quantile(xs, k / s.bins) for k in range(1, s.bins)]))
    want = {}
    for name, a, b in spans:
        train = [r for r in rows if r[1] < a - timedelta(days=5) and r[5] is not None]
        f = plain([r[2:5] for r in train], [r[5] for r in train], [0.5 ** ((a - r[1]).days / 90) for r in train], edges, s)
        want |= {(r[0], name): f(r[2:5]) for r in rows if a <= r[1] < b}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_scores_do_not_depend_on_how_rows_are_dealt(spark):
    _, d = panel(spark, 120, 9)
    spans = [("f1", date(2024, 3, 1), date(2024, 6, 1))]
    runs = [sorted(map(tuple, boosting.walk_forward(x, ["a", "b"], "label", spans, ["i"], settings=boosting.Settings(trees=2)).collect())) for x in (d, d.repartition(7).orderBy(F.rand(3)))]
    assert runs[0] == runs[1] and len({r[2] for r in runs[0]}) > 3


def test_folds_without_rows_and_missing_features(spark):
    rows, d = panel(spark, 30, 2)
    spans = [("none", date(2023, 1, 1), date(2023, 2, 1)), ("early", date(2024, 1, 1), date(2024, 1, 10)), ("late", date(2024, 1, 20), date(2024, 2, 10))]
    got = boosting.walk_forward(d.withColumn("z", F.lit(None).cast("double")), ["a", "z"], "label", spans, ["i"], settings=boosting.Settings(trees=1, depth=1)).collect()
    assert {r.fold_id for r in got} == {"early", "late"} and all(r.pred == 0 for r in got if r.fold_id == "early") and len(got) == 9 + 11
    assert boosting.walk_forward(d.where("false"), ["a"], "label", spans, ["i"], settings=boosting.Settings(trees=1)).count() == 0
