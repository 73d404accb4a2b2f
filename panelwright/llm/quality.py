"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-
regularised-leader (FTRL-proximal) updates, scored as sparse dot products.

A document's features are hashed n-grams of its words and of its words' shapes (letter case,
digits, punctuation), each with its count divided by the number of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Hash space of the features.
SLOTS = 1 << 18
#: Labelled rows trained on, about: a bounded sample by the hash of the id.
TRAIN_ROWS = 8192
EPOCHS, ALPHA, BETA, L1, L2 = 4, 5.0, 0.1, 1e-4, 1e-2
THRESHOLD = 0.3
MIX = np.uint64(0x9E3779B97F4A7C15)
SHAPES = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
RUN = re.compile(rb"(.)\1+", re.S)


class WordHashes(dict):
    """word -> (hash, hash of its shape); emptied when it gets large."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > 300_000:
            self.clear()
        shape = RUN.sub(rb"\1+", word.translate(SHAPES))
        self[word] = out = (xxhash.xxh64_intdigest(word), xxhash.xxh64_intdigest(shape, 1))
        return out


def features(text: str | None, memo: WordHashes) -> tuple[np.ndarray, int]:
    """(slots with repeats, number of words)."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    if not words:
        return np.empty(0, np.int64), 0
    both = np.array([memo[w] for w in words], np.uint64)
    word, shape = both[:, 0], both[:, 1]
    again = word[1:] == word[:-1]
    parts = [word, shape, word[:-1] * MIX + word[1:], np.where(again, np.uint64(1), shape[:-1] * MIX + shape[1:])]
    if len(words) > 2:
        parts.append((shape[:-2] * MIX + shape[1:-1]) * MIX + shape[2:])
    slots = np.concatenate([(p * MIX + np.uint64(k)) >> np.uint64(64 - 18) for k, p in enumerate(parts)])
    return slots.astype(np.int64), len(words)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights, the last of them the intercept.  rows: (distinct slots, values, label)."""
    z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            slots, x, y = rows[r]
            zi, ni = z[slots], n[slots]
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            z[slots] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[slots] += g * g
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def counted(text: str | None, memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    slots, n = features(text, memo)
    found, counts = np.unique(slots, return_counts=True)
    return np.append(found, SLOTS), np.append(counts / max(n, 1), 1.0)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """The weights, from about ``train_rows`` labelled rows whose crc32(id) mod 5 is not 0.

    Null ids and labels are left out; an id that repeats in the labels counts once, with its
    largest label; without any labelled row all weights are 0."""
    marked = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).dropna().where(F.crc32(F.col("i").cast("string")) % 5 != 0)
    n = marked.count()
    spread = F.pmod(F.xxhash64(F.col("i")), F.lit(1 << 30)).cast("double") / float(1 << 30)
    drawn = marked.where(spread < min(1.0, train_rows / max(n, 1))).groupBy("i").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(drawn), "i").select("i", "t", "y")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            found = [counted(t.as_py(), memo) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(2).cast(pa.int32()), pa.array([f[0].astype("<i4").tobytes() for f in found], pa.binary()), pa.array([f[1].astype("<f4").tobytes() for f in found], pa.binary())],
                ["i", "y", "slots", "x"],
            )

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(np.frombuffer(s, "<i4"), np.frombuffer(x, "<f4").astype(float), y) for f in frames for s, x, y in zip(f["slots"], f["x"], f["y"])]
        yield pd.DataFrame({"weights": [train_ftrl(held).astype("<f4").tobytes()]})

    bags = rows.mapInArrow(sparse, "i long, y int, slots binary, x binary")
    got = bags.repartition(1).sortWithinPartitions("i", "y", "slots").mapInPandas(train, "weights binary").collect()
    return np.frombuffer(bytes(got[0].weights), "<f4").astype(float) if got else np.zeros(SLOTS + 1)


def scorer(weights: np.ndarray):
    """text -> score, for use inside a task."""
    memo, intercept, w = WordHashes(), weights[-1], weights[:-1]

    def score(text: str | None) -> float:
        slots, n = features(text, memo)
        return 1 / (1 + float(np.exp(-np.clip(intercept + (w[slots].sum() / n if n else 0.0), -35, 35))))

    return score


def score_quality(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score.  The model has a fixed size and is broadcast.  Null and empty texts score
    the intercept; very long texts are scored whole; null ids and repeated rows stay, one result row each; other columns are
    ignored; an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([score(t.as_py()) for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def accepted_only(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(sent.value)
        for batch in batches:
            yield batch.filter(pa.array([score(t.as_py()) >= threshold for t in batch.column(text_col)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
