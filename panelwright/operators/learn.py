"""Models on tables: fit on a fold's training rows, score its validation rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import pct_rank
from . import boosting
from .pit import last_rows


def fit_gbt(train: DataFrame, features: list[str], label: str, weight: str | None = None, **settings):
    """A gradient-boosted tree regressor with missing features at their median."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    filled = [f"{f}__filled" for f in features]
    stages = [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_features", handleInvalid="keep"), GBTRegressor(featuresCol="_features", labelCol=label, predictionCol="_pred", seed=7, **({"weightCol": weight} if weight else {}), **({"maxIter": 20, "maxDepth": 3} | settings))]
    return Pipeline(stages=stages).fit(train.select(*features, label, *([weight] if weight else [])).where(F.col(label).isNotNull()))


def score_gbt(model, rows: DataFrame, features: list[str], name: str = "score") -> DataFrame:
    d = model.transform(rows).withColumn(name, F.col("_pred"))
    return d.drop("_pred", "_features", *[f"{f}__filled" for f in features])


def importances(model, features: list[str], spark) -> DataFrame:
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, model.stages[-1].featureImportances.toArray())], "feature string, importance double")


walk_forward = boosting.walk_forward


def error_model(rows: DataFrame, features: list[str], fold_ids: list[str], loss: str = "rank_loss", settings: boosting.Settings = boosting.Settings()) -> DataFrame:
    """g_pred of each fold from a model of the losses of the folds before (none for the first); never negative.  All folds are fitted together."""
    place = F.array_position(F.array(*[F.lit(f) for f in fold_ids]), F.col("fold_id")).cast("int") - 1  # -1: another fold
    last = F.lit(len(fold_ids) - 1)
    later = F.when((place >= 0) & (place < last), F.sequence(place + 1, F.greatest(last, place + 1))).otherwise(F.array().cast("array<int>"))
    keep = rows.columns
    d = rows.withColumns({"folds_in": later, "folds_out": F.when(place > 0, F.array(place)).otherwise(F.array().cast("array<int>")), "y": F.col(loss)})
    d = d.withColumn("weights", F.transform("folds_in", lambda k: F.lit(1.0)))
    held, forest = boosting.fit_trees(d, features, len(fold_ids), settings)
    return boosting.score_folds(held, forest, keep, "_fold", "g_pred").drop("_fold").withColumn("g_pred", F.greatest("g_pred", F.lit(0.0)))


def stacking_weights(train: DataFrame, x1: str, x2: str, y: str, penalty: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """Ridge weights of two regressors (centred; the intercept is not penalised), in closed form from sums."""
    m = {c: F.avg(c) for c in (x1, x2, y)}
    n = F.count(F.lit(1)).cast("double")
    s = lambda a, b: n * F.covar_pop(a, b)
    g = train.na.drop(subset=[x1, x2, y]).groupBy(*(by or [])).agg(n.alias("n"), *[m[c].alias(f"_m{i}") for i, c in enumerate((x1, x2, y))], s(x1, x1).alias("_a"), s(x1, x2).alias("_b"), s(x2, x2).alias("_d"), s(x1, y).alias("_p"), s(x2, y).alias("_q"))
    a, d = F.col("_a") + penalty, F.col("_d") + penalty
    det = a * d - F.col("_b") * F.col("_b")
    g = g.withColumns({"w1": F.try_divide(d * F.col("_p") - F.col("_b") * F.col("_q"), det), "w2": F.try_divide(a * F.col("_q") - F.col("_b") * F.col("_p"), det)})
    return g.withColumn("w0", F.col("_m2") - F.col("w1") * F.col("_m0") - F.col("w2") * F.col("_m1")).select(*(by or []), "n", "w0", "w1", "w2")


def stack(rows: DataFrame, first: str, second: str, label: str, folds: list[tuple[str, str, str]], keys: list[str], penalty: float = 1.0) -> DataFrame:
    """Scores of each fold (name, val_start, val_end) by ridge weights of both ranks over all earlier, matured dates
    (column label_matured_on): all folds in one job."""
    spark = rows.sparkSession
    d = rows.withColumns({"_r1": pct_rank(first, *keys), "_r2": pct_rank(second, *keys)})
    f = F.broadcast(spark.createDataFrame(folds, "fold_id string, val_start string, val_end string").select("fold_id", F.col("val_start").cast("date").alias("val_start"), F.col("val_end").cast("date").alias("val_end")))
    train = d.drop("fold_id").join(f, F.col("label_matured_on") < F.col("val_start"))
    w = stacking_weights(train, "_r1", "_r2", label, penalty, ["fold_id"])
    val = d.drop("fold_id").join(f, (F.col("as_of_date") >= F.col("val_start")) & (F.col("as_of_date") < F.col("val_end")))
    return val.join(F.broadcast(w), "fold_id").withColumn("score", F.col("w0") + F.col("w1") * F.col("_r1") + F.col("w2") * F.col("_r2")).drop("_r1", "_r2", "w0", "w1", "w2", "n", "val_start", "val_end")


#: A small default lexicon; any scorer of a series of texts may take its place.
POSITIVE = ["gain", "growth", "beat", "strong", "record", "profit", "improve", "upgrade"]
NEGATIVE = ["loss", "decline", "miss", "weak", "risk", "lawsuit", "impair", "downgrade"]


def lexicon_score(text) -> object:
    """(positive - negative) / (positive + negative) words; 0 without any."""
    count = lambda words: F.regexp_count(F.lower(F.col(text)), F.lit(rf"\b(?:{'|'.join(words)})\w*"))
    p, n = count(POSITIVE), count(NEGATIVE)
    return F.coalesce(F.try_divide((p - n).cast("double"), p + n), F.lit(0.0))


def text_windows(text: str | None, most: int) -> list[str]:
    """A text in windows of at most ``most`` characters, cut after white space where a window has any; blank ones are left out."""
    out, at = [], 0
    while text and at < len(text):
        to = at + most
        if to < len(text):
            found = re.search(r"\s\S*$", text[at:to])
            to = at + found.start() + 1 if found else to
        if text[at:to].strip():
            out.append(text[at:to])
        at = to
    return out


def score_texts(texts: DataFrame, scorer: Callable[[pd.Series], pd.Series] | None = None, text: str = "text", most: int = 400) -> DataFrame:
    """Sentiment of valid texts.  ``scorer`` gets batches of windows of ``most`` characters, as the scoring models take them; a text's
    score is the mean of its windows' by their characters (windows without a score are left out)."""
    if scorer is None:
        return texts.withColumn("score", F.when(F.length(F.trim(text)) > 0, lexicon_score(text)))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            parts = pd.Series([text_windows(t, most) for t in b], dtype=object).explode().dropna()
            if not len(parts):
                yield pd.Series([None] * len(b), dtype=float)
                continue
            scores = pd.Series(np.asarray(scorer(parts.reset_index(drop=True)), dtype=float), index=parts.index)
            size = parts.str.len().where(scores.notna())
            total = (scores * size).groupby(level=0).sum(min_count=1) / size.groupby(level=0).sum(min_count=1)
            yield total.reindex(range(len(b))).astype(float)

    return texts.withColumn("score", F.when(F.length(F.trim(text)) > 0, run(F.col(text))))


def unscored(texts: DataFrame, scores: DataFrame | None = None, key: str = "record_id") -> DataFrame:
    return texts.where(~F.col("scored")) if scores is None else texts.join(scores.select(key), key, "left_anti")


def forecast(sequences: DataFrame, model: Callable[[pd.Series], pd.Series] | None = None, values: str = "values", name: str = "score") -> DataFrame:
    """A score per sequence (an array of returns or prices); by default its mean."""
    if model is None:
        a = F.col(values)
        return sequences.withColumn(name, F.try_divide(F.aggregate(a, F.lit(0.0), lambda t, x: t + x), F.size(a)))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield model(b).astype(float)

    return sequences.withColumn(name, run(F.col(values)))


def lookback_windows(bars: DataFrame, as_of: DataFrame, n: int, strict: bool = True, value: str = "close", entity: str = "ticker", date: str = "date") -> DataFrame:
    """as_of, entity, values: the last n values up to each as_of in date order; ``strict``: only full windows."""
    d = last_rows(bars.select(entity, date, value), as_of, entity, date, n)
    g = d.groupBy("as_of", entity).agg(F.transform(F.array_sort(F.collect_list(F.struct(date, value))), lambda x: x[value]).alias("values"))
    return g.where(F.size("values") == n) if strict else g


def excess_windows(bars: DataFrame, benchmark: DataFrame, as_of: DataFrame, n: int, strict: bool = True, entity: str = "ticker") -> DataFrame:
    """The last n daily returns less the benchmark's, both over the same dates."""
    w = Window.partitionBy(entity).orderBy("date")
    b = F.broadcast(benchmark.select("date", F.col("close").alias("_b")))
    d = bars.join(b, "date").withColumn("excess", F.try_divide("close", F.lag("close").over(w)) - F.try_divide("_b", F.lag("_b").over(w))).where("excess IS NOT NULL")
    return lookback_windows(d, as_of, n, strict, "excess", entity)


def window_coverage(windows: DataFrame, n: int) -> DataFrame:
    full = F.sum((F.size("values") == n).cast("long"))
    return windows.groupBy("as_of").agg(F.count(F.lit(1)).alias("n_total"), full.alias("n_valid"), F.try_divide(full.cast("double"), F.count(F.lit(1))).alias("valid_share"))


def retrain_comparison(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Per-date rank ICs of two models side by side."""
    from .evaluate import rank_ic

    a, b = (rank_ic(d, keys).select(*keys, F.col("rank_ic").alias(n)) for d, n in ((old, "old_ic"), (new, "new_ic")))
    return a.join(b, keys).withColumn("gain", F.col("new_ic") - F.col("old_ic"))
