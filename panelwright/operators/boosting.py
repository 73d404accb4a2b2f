"""Boosted regression trees of many folds at once.

A row belongs to the training sets of some folds, with a weight in each, and is scored by others; it is stored once, with its
features in bins (NULL is a bin of its own).  Every level of every fold's next tree is one job: tasks add up gradients by (fold, node, feature, bin),
Spark adds those up and finds each node's best split, and only splits come to the driver: folds x nodes rows.  Gradients and weights are
whole numbers of 2^-20, so sums, and with them trees and scores, don't depend on how rows are dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import scratch
from . import order

UNIT = 1 << 20


class Settings(NamedTuple):
    trees: int = 20
    depth: int = 3
    rate: float = 0.1
    bins: int = 32
    penalty: float = 1.0
    least_rows: int = 5


class Trees(NamedTuple):
    """One tree a fold, as arrays (folds, nodes): the feature (-1: a leaf), the last bin that goes left, whether NULL does, the leaf's value."""

    feature: np.ndarray
    last: np.ndarray
    null_left: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, folds: int, depth: int) -> Trees:
        shape = (folds, (2 << depth) - 1)
        return cls(np.full(shape, -1), np.zeros(shape, int), np.zeros(shape, bool), np.zeros(shape))

    def nodes(self, bins: np.ndarray, row: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """The leaf that each (row, fold) ends in."""
        node = np.zeros(len(row), np.int64)
        for _ in range(self.feature.shape[1].bit_length() - 1):
            f = self.feature[fold, node]
            b = bins[row, np.maximum(f, 0)]
            left = np.where(b == 0, self.null_left[fold, node], b <= self.last[fold, node])
            node = np.where(f < 0, node, 2 * node + 2 - left)
        return node


class Forest(NamedTuple):
    edges: list[np.ndarray]
    base: np.ndarray
    trees: list[Trees]

    def margins(self, bins: np.ndarray, row: np.ndarray, fold: np.ndarray) -> np.ndarray:
        out = self.base[fold].copy()
        for t in self.trees:
            out += t.value[fold, t.nodes(bins, row, fold)]
        return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """(rows, features) of doubles to bins from 1, 0 for NaN."""
    out = np.zeros(x.shape, np.uint8)
    for j, e in enumerate(edges):
        known = ~np.isnan(x[:, j])
        out[known, j] = 1 + e.searchsorted(x[known, j], "left")
    return out


def matrix(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    return np.stack([batch.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features], 1) if batch.num_rows else np.empty((0, len(features)))


def members(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of each entry."""
    size = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(lists)), size), lists.flatten().to_numpy(zero_copy_only=False)


def bin_edges(rows: DataFrame, features: list[str], bins: int, folds: int) -> list[np.ndarray]:
    """Quantiles of the rows that all folds train on (so no fold knows later ones; of all training rows, if there are none)."""
    d = rows.where(F.size("folds_in") == folds)
    d = d if d.limit(1).count() else rows.where(F.size("folds_in") > 0)
    long = d.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("_x")) for f in features])))
    long = long.where(~F.isnan("_x"))
    found = {r.feature: r for r in order.quantiles(long, "_x", {f"q{i}": i / bins for i in range(1, bins)}, ["feature"]).collect()}  # a row a feature
    return [np.unique([found[f][f"q{i}"] for i in range(1, bins)]) if f in found else np.empty(0) for f in features]


def histograms(rows: DataFrame, forest: Forest, tree: Trees, level: int, n_features: int, bins: int) -> DataFrame:
    """fold, node, feature, bin, g, h, n of the nodes of one level."""
    sent = rows.sparkSession.sparkContext.broadcast((forest, tree))
    first, width = (1 << level) - 1, 1 << level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, tree = sent.value
        shape = (len(forest.base), width, n_features, bins + 1)
        sums = np.zeros((3, int(np.prod(shape))))
        for batch in batches:
            b = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, n_features)
            row, fold = members(batch.column("folds_in"))
            w = members(batch.column("weights"))[1]
            error = forest.margins(b, row, fold) - batch.column("y").to_numpy()[row]
            node = tree.nodes(b, row, fold) - first
            here = node >= 0
            row, fold, node = row[here], fold[here], node[here]
            parts = (np.rint(error[here] * w[here] * UNIT), np.rint(w[here] * UNIT), np.ones(len(row)))
            for j in range(n_features):
                at = ((fold * width + node) * n_features + j) * (bins + 1) + b[row, j]
                for k, part in enumerate(parts):
                    sums[k] += np.bincount(at, part, sums.shape[1])
        at = np.flatnonzero(sums[2])
        place = np.unravel_index(at, shape)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (place[0], place[1] + first, place[2], place[3])] + [pa.array(s[at].astype(np.int64)) for s in sums], ["fold", "node", "feature", "bin", "g", "h", "n"])

    d = rows.select("bins", "y", "folds_in", "weights").mapInArrow(run, "fold int, node int, feature int, bin int, g long, h long, n long")
    return d.groupBy("fold", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"])


def best_splits(hist: DataFrame, s: Settings) -> DataFrame:
    """fold, node, its sums, and the split with the largest gain (ties: the first feature, bin, NULL to the right)."""
    w = Window.partitionBy("fold", "node", "feature")
    upto = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    known = lambda c: F.when(F.col("bin") > 0, F.col(c)).otherwise(0)
    d = hist.withColumns({f"all_{c}": F.sum(c).over(w) for c in "ghn"} | {f"null_{c}": F.sum(F.when(F.col("bin") == 0, F.col(c)).otherwise(0)).over(w) for c in "ghn"} | {f"run_{c}": F.sum(known(c)).over(upto) for c in "ghn"})
    d = d.withColumn("null_left", F.explode(F.array(F.lit(0), F.lit(1))))
    d = d.withColumns({f"left_{c}": F.col(f"run_{c}") + F.col("null_left") * F.col(f"null_{c}") for c in "ghn"})
    share = lambda g, h: (g / F.lit(float(UNIT))) * (g / F.lit(float(UNIT))) / (h / F.lit(float(UNIT)) + s.penalty)
    right = {c: F.col(f"all_{c}") - F.col(f"left_{c}") for c in "ghn"}
    gain = share(F.col("left_g"), F.col("left_h")) + share(right["g"], right["h"]) - share(F.col("all_g"), F.col("all_h"))
    fits = (F.col("bin") > 0) & (F.col("left_n") >= s.least_rows) & (right["n"] >= s.least_rows)
    d = d.withColumn("gain", F.when(fits, gain))
    top = F.max(F.struct(F.coalesce("gain", F.lit(float("-inf"))).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), (-F.col("null_left")).alias("m"), "left_g", "left_h")).alias("top")
    return d.groupBy("fold", "node").agg(F.max("all_g").alias("g"), F.max("all_h").alias("h"), top).select("fold", "node", "g", "h", "top.*")


def fit_trees(rows: DataFrame, features: list[str], folds: int, settings: Settings = Settings()) -> tuple[DataFrame, Forest]:
    """rows: the features, y, folds_in (numbers of the folds that train on the row), weights (one each).  Returns the rows with their bins, stored, and
    the trees of all folds.  Rows without a y are not trained on; a fold without rows scores 0."""
    s = settings
    rows = rows.withColumn("y", F.col("y").cast("double"))
    rows = rows.withColumns({"folds_in": F.when(F.col("y").isNotNull(), F.col("folds_in")).otherwise(F.array().cast("array<int>")), "y": F.coalesce("y", F.lit(0.0))})
    rows = rows.withColumn("weights", F.slice("weights", 1, F.size("folds_in")))
    edges = bin_edges(rows, features, s.bins, folds)
    schema = T.StructType([*rows.schema.fields, T.StructField("bins", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("bins", pa.array([r.tobytes() for r in binned(matrix(batch, features), edges)], pa.binary()))

    held = scratch.stored(rows.mapInArrow(cut, schema), "binned")
    forest = Forest(edges, np.zeros(folds), [])
    for r in best_splits(histograms(held, forest, Trees.empty(folds, s.depth), 0, len(features), s.bins), s).collect():
        forest.base[r.fold] = -r.g / r.h if r.h else 0.0
    for _ in range(s.trees):
        tree = Trees.empty(folds, s.depth)
        for level in range(s.depth):
            found = best_splits(histograms(held, forest, tree, level, len(features), s.bins), s).collect()  # a row a node
            leaf = lambda g, h: -s.rate * (g / UNIT) / (h / UNIT + s.penalty)
            for r in found:
                if not level:
                    tree.value[r.fold, 0] = leaf(r.g, r.h)
                if r.gain > 1e-12:
                    tree.feature[r.fold, r.node], tree.last[r.fold, r.node], tree.null_left[r.fold, r.node] = -r.f, -r.b, bool(-r.m)
                    tree.value[r.fold, 2 * r.node + 1] = leaf(r.left_g, r.left_h)
                    tree.value[r.fold, 2 * r.node + 2] = leaf(r.g - r.left_g, r.h - r.left_h)
        forest.trees.append(tree)
    return held, forest


def score_folds(held: DataFrame, forest: Forest, keep: list[str], fold: str = "fold", name: str = "pred") -> DataFrame:
    """keep, fold, name: every row once for each fold in its folds_out."""
    sent = held.sparkSession.sparkContext.broadcast(forest)
    schema = T.StructType([*held.select(*keep).schema.fields, T.StructField(fold, T.IntegerType()), T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, own = members(batch.column("folds_out"))
            b = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 1), np.uint8)
            kept = batch.select(keep).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(own.astype(np.int32)), pa.array(sent.value.margins(b, row, own))], [*keep, fold, name])

    return held.select(*keep, "bins", "folds_out").mapInArrow(run, schema)


def walk_forward(rows: DataFrame, features: list[str], label: str, spans: list[tuple], keep: list[str], date: str = "as_of_date", embargo_days: int = 0, half_life_days: float | None = None, settings: Settings = Settings()) -> DataFrame:
    """keep, fold_id, pred.  spans (fold_id, first day, day after the last): each fold is fitted on the rows more than ``embargo_days`` before its first day,
    weighted by age, and scores its own.  All folds are fitted together."""
    day = lambda x: F.lit(str(x)).cast("date")
    trains = [F.col(date) < F.date_sub(day(a), embargo_days) for _, a, _ in spans]
    age = [F.pow(F.lit(0.5), F.datediff(day(a), F.col(date)) / F.lit(float(half_life_days))) if half_life_days else F.lit(1.0) for _, a, _ in spans]
    d = rows.withColumns({
        "folds_in": F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in enumerate(trains)])), "weights": F.array_compact(F.array(*[F.when(t, w) for t, w in zip(trains, age)])),
        "folds_out": F.array_compact(F.array(*[F.when((F.col(date) >= day(a)) & (F.col(date) < day(b)), F.lit(k)) for k, (_, a, b) in enumerate(spans)])), "y": F.col(label),
    })
    held, forest = fit_trees(d.select(*dict.fromkeys([*keep, *features]), "y", "folds_in", "weights", "folds_out"), features, len(spans), settings)
    names = F.array(*[F.lit(n) for n, _, _ in spans])
    return score_folds(held, forest, keep).withColumn("fold_id", F.get(names, F.col("fold"))).select(*keep, "fold_id", "pred")


__all__ = ["Forest", "Settings", "Trees", "fit_trees", "score_folds", "walk_forward"]
