"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine, found with a block-max inverted index.

Terms are words and their first four to eight letters, so that forms of a word that the examples don't have still count.
Examples are a bounded sample of labelled documents; near copies (equal least hash of their three-word shingles) are one example with
their mean label.  The vocabulary is chosen on them: terms whose share differs between the labels at least twofold, and more than chance
allows among so many (log-likelihood ratio, Bonferroni), of terms that begin each other the best one.  All other words are one
pooled term, so a vector's direction tells how large a part of the text the chosen ones are; each for itself they would decide the cosine of long
texts by the rare words that any two of them happen to share.  Document frequencies are counted over the whole corpus.

The index has for each word its examples in order, in blocks, with each block's largest weight.  A text's bound for a block is the
sum over its words of their weights times those maxima; blocks are scored from the highest bound on, until the k-th best score is
above the next bound.  So the k nearest are exact.  They vote by distance; the votes are calibrated on the examples
themselves, each left out of its own vote.  The examples that voted are returned as evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import finished, mark, stored, table

#: Labelled rows that are examples, words of the vocabulary, postings of the index, at most (about).
TRAIN_ROWS, VOCABULARY, POSTINGS = 16_384, 4096, 2_000_000
#: Examples that a term occurs in at least; chance of one wrong term in the vocabulary.
LEAST_EXAMPLES, CHANCE = 3, 0.05
#: And it is at least so many times as common in the examples of one label as in the other's.
LIFT = 2.0
#: Neighbours that vote; weight of the examples' mean against their votes; smallest distance; examples of a block.
NEIGHBOURS, PRIOR, LEAST_DISTANCE, BLOCK = 16, 0.5, 0.02, 128
#: Added to the logarithm of a term's rarity: the weight of a word that every document has.
COMMON = 0.1
THRESHOLD = 0.5
WORD = re.compile(r"[^\W_]+")
#: Lengths of the beginnings of longer words that are terms too, written with a star behind.
STEMS = range(4, 9)


def words_in(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def terms_of(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)]


class Numbers(dict):
    """word -> the numbers of its terms in the vocabulary; emptied when it gets large."""

    def __init__(self, number: dict[str, int]) -> None:
        super().__init__()
        self.number = number

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        self[word] = out = tuple(self.number[t] for t in terms_of(word) if t in self.number)
        return out


def numbered(words: Counter, numbers: Numbers) -> dict[int, int]:
    """The counts of a text's terms by number; the pooled one comes last."""
    counts: dict[int, int] = {}
    other = 0
    for word, n in words.items():
        own = numbers[word]
        for i in own:
            counts[i] = counts.get(i, 0) + n
        other += 0 if own else n
    return counts | ({len(numbers.number): other} if other else {})


def copy_key(words: list[str]) -> int:
    """Near copies mostly share it: the least hash of the text's shingles of three words."""
    n = max(1, len(words) - 2)
    return min(xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(n)) - (1 << 63)


class Index(NamedTuple):
    """Postings of examples 0..n-1, sorted by word and example; words w has those of starts[w] to starts[w + 1]."""

    ids: np.ndarray
    labels: np.ndarray
    starts: np.ndarray
    examples: np.ndarray
    weights: np.ndarray
    #: The blocks that a word has, where they begin in its postings, and their largest weights.
    block_starts: np.ndarray
    blocks: np.ndarray
    begins: np.ndarray
    maxima: np.ndarray
    #: The smallest id of each block.
    least_ids: np.ndarray


def unit_weights(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = tf * idf
    return w / math.sqrt((w * w).sum())


def build_index(ids: list[int], labels: list[float], vectors: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> Index:
    """vectors: (words ascending, term frequencies) of each example, none empty.  Examples with like words get neighbouring
    numbers, so that blocks differ and bounds are sharp."""
    weighted = [(t, unit_weights(f, idf[t])) for t, f in vectors]
    key = [tuple(t[np.argsort(-w, kind="stable")].tolist()) for t, w in weighted]
    order = sorted(range(len(ids)), key=lambda i: (key[i], i))
    sizes = np.array([len(weighted[i][0]) for i in order], np.int64)
    example = np.repeat(np.arange(len(order)), sizes)
    word = np.concatenate([weighted[i][0] for i in order]) if order else np.empty(0, np.int64)
    weight = np.concatenate([weighted[i][1] for i in order]) if order else np.empty(0)
    by = np.lexsort((example, word))
    word, example, weight = word[by], example[by], weight[by]
    starts = np.searchsorted(word, np.arange(len(idf) + 1))
    fresh = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (example[1:] // BLOCK != example[:-1] // BLOCK)]) if len(word) else np.empty(0, np.int64)
    maxima = np.maximum.reduceat(weight, fresh) if len(word) else np.empty(0)
    own = np.array([ids[i] for i in order], np.int64)
    least = np.minimum.reduceat(own, np.arange(0, len(own), BLOCK)) if len(own) else own
    return Index(own, np.array([labels[i] for i in order], float), starts, example, weight, np.searchsorted(word[fresh], np.arange(len(idf) + 1)), example[fresh] // BLOCK, np.append(fresh, len(word)), maxima, least)


def nearest(index: Index, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """(examples, cosines) of the k nearest that share a word, nearest first, ties to the smaller id; exact.  ``without``: an example left out."""
    n_blocks = -(-len(index.ids) // BLOCK)
    bounds = np.zeros(n_blocks)
    for t, w in zip(terms, weights):
        own = slice(index.block_starts[t], index.block_starts[t + 1])
        bounds[index.blocks[own]] += w * index.maxima[own]
    found, scores = np.empty(0, np.int64), np.empty(0)
    for b in np.argsort(-bounds, kind="stable"):
        if bounds[b] <= 0 or (len(found) >= k and bounds[b] < scores[k - 1] - 1e-9):
            break
        if len(found) >= k and round(bounds[b], 12) <= scores[k - 1] and index.least_ids[b] > index.ids[found[k - 1]]:
            continue  # at best a tie with a larger id
        own = np.zeros(BLOCK)
        for t, w in zip(terms, weights):
            at = index.block_starts[t] + np.searchsorted(index.blocks[index.block_starts[t] : index.block_starts[t + 1]], b)
            if at < index.block_starts[t + 1] and index.blocks[at] == b:
                part = slice(index.begins[at], index.begins[at + 1])
                own[index.examples[part] - b * BLOCK] += w * index.weights[part]
        hit = np.flatnonzero(own)
        hit = hit[hit + b * BLOCK != without]
        found, scores = np.concatenate([found, hit + b * BLOCK]), np.concatenate([scores, np.round(own[hit], 12)])
        best = np.lexsort((index.ids[found], -scores))[:k]
        found, scores = found[best], scores[best]
    return found, scores


def votes(labels: np.ndarray, cosines: np.ndarray, mean: float) -> float:
    """The neighbours' mean label, each weighed by 1 / (distance + LEAST_DISTANCE), drawn to ``mean`` where they are few or far."""
    w = 1 / (1 - cosines + LEAST_DISTANCE)
    return float(((w * labels).sum() + PRIOR * mean) / (w.sum() + PRIOR))


def calibration(vote: np.ndarray, label: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a vote + b))), fitted to softened labels by Newton steps."""
    n1 = label.sum()
    n0 = len(label) - n1
    if len(label) < 20 or n1 < 2 or n0 < 2:
        return 8.0, -4.0  # the plain vote's side
    y = label * ((n1 + 1) / (n1 + 2)) + (1 - label) / (n0 + 2)
    x, w = np.stack([vote, np.ones(len(vote))]), np.array([8.0, -4.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2), x @ (p - y) + 1e-3 * (w - [8.0, -4.0]))
    return float(w[0]), float(w[1])


class Model(NamedTuple):
    words: dict[str, int]
    idf: np.ndarray
    index: Index
    #: Mean label of all examples, of those without a word of the vocabulary, and the calibration.
    mean: float
    mean_without: float
    curve: tuple[float, float]


def judged(model: Model, terms: np.ndarray, tf: np.ndarray, k: int = NEIGHBOURS) -> tuple[float, np.ndarray, np.ndarray]:
    """(score, examples, cosines) of a text's vector."""
    if not len(terms) or terms[0] == len(model.words) or not len(model.index.ids):
        return model.mean_without, terms[:0], np.empty(0)
    found, cosines = nearest(model.index, terms, unit_weights(tf, model.idf[terms]), k)
    if not len(found):
        return model.mean_without, found, cosines
    a, b = model.curve
    return 1 / (1 + math.exp(-min(max(a * votes(model.index.labels[found], cosines, model.mean) + b, -30), 30))), found, cosines


def deviance(n1, n0, all1: float, all0: float):
    """Log-likelihood ratio of a word in n1 of all1 and n0 of all0 examples, as a column."""
    term = lambda n, e: F.when(n > 0, n * F.log(n / e)).otherwise(0.0)
    share = (n1 + n0) / (all1 + all0)
    return 2 * (term(n1, all1 * share) + term(n0, all0 * share) + term(all1 - n1, all1 * (1 - share)) + term(all0 - n0, all0 * (1 - share)))


def critical(p: float) -> float:
    """The value that a chi-square of one degree exceeds with probability ``p``."""
    low, high = 0.0, 1400.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erfc(math.sqrt(mid / 2)) > p else (low, mid)
    return high


def labelled_examples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train_rows: int) -> DataFrame:
    """i, y, words, tf of about ``train_rows`` labelled documents with words, near copies as one (smallest id, mean label), and those without words
    (null words) with theirs."""
    marked = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).dropna().where(F.crc32(F.col("i").cast("string")) % 5 != 0)
    n = marked.count()
    spread = F.pmod(F.xxhash64(F.col("i")), F.lit(1 << 30)).cast("double") / float(1 << 30)
    drawn = marked.where(spread < min(1.0, train_rows / max(n, 1))).groupBy("i").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(drawn), "i").select(F.col("i").cast("long").alias("i"), "y", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ = [words_in(t.as_py()) for t in batch.column(2)]
            counts = [Counter(w) for w in all_]
            keys = [copy_key(w) if w else None for w in all_]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))], ["i", "y", "key", "words", "tf"])

    d = rows.mapInArrow(run, "i long, y int, key long, words array<string>, tf array<int>")
    first = F.min_by(F.struct("words", "tf"), F.struct("i", "words")).alias("v")
    return d.groupBy("key").agg(F.min("i").alias("i"), F.avg("y").alias("y"), first).select("i", "y", "v.words", "v.tf")


def terms_column(word):
    """``terms_of`` as a column."""
    return F.array_compact(F.array(word, *[F.when(F.length(word) > k, F.concat(F.substring(word, 1, k), F.lit("*"))) for k in STEMS]))


def choose_words(examples: DataFrame, vocabulary: int = VOCABULARY, chance: float = CHANCE) -> list[str]:
    """The terms that tell the labels apart, at most ``vocabulary``, in the order of their evidence."""
    known = examples.where(F.size("words") > 0)
    all1, all0 = known.agg(F.coalesce(F.sum("y"), F.lit(0.0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0.0))).first()
    if not all1 or not all0:
        return []
    terms = F.array_distinct(F.flatten(F.transform("words", lambda w: terms_column(w))))
    counts = known.select("y", F.explode(terms).alias("word")).groupBy("word").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0")).where(F.col("n1") + F.col("n0") >= LEAST_EXAMPLES)
    counts = stored(counts.withColumn("g", deviance(F.col("n1"), F.col("n0"), all1, all0)), "word-counts")
    least = critical(chance / max(counts.count(), 1))
    share1, share0 = F.col("n1") / all1, F.col("n0") / all0
    apart = (share1 >= LIFT * share0) | (share0 >= LIFT * share1)
    best: list[str] = []
    for r in counts.where((F.col("g") > least) & apart).orderBy(F.col("g").desc(), F.length("word").desc(), "word").limit(vocabulary).collect():
        stem = r.word.rstrip("*")
        if not any(stem != b and (stem.startswith(b) or b.startswith(stem)) for b in (x.rstrip("*") for x in best)):
            best.append(r.word)
    return best


def vectors_of(docs: DataFrame, words: list[str], id_col: str, text_col: str) -> DataFrame:
    """doc_id, terms (ascending), tf: every document's terms of the vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(sent.value)
        for batch in batches:
            terms, tf = [], []
            for t in batch.column(1):
                counts = numbered(Counter(words_in(t.as_py())), numbers)
                terms.append(sorted(counts))
                tf.append([counts[i] for i in terms[-1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))], ["doc_id", "terms", "tf"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, terms array<int>, tf array<int>")


def fit_toxicity(vectors: DataFrame, examples: DataFrame, words: list[str], postings: int = POSTINGS, k: int = NEIGHBOURS) -> Model:
    """The index over the examples, with document frequencies over all ``vectors``; the examples are a bounded sample."""
    spark = vectors.sparkSession
    df = np.zeros(len(words) + 1)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a word of the vocabulary
        df[r["t"]] = r["count"]
    idf = np.log((1 + vectors.count()) / (1 + df)) + COMMON
    sent = spark.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = Numbers(sent.value)
        for batch in batches:
            own = [sorted(numbered(Counter(dict(zip(ws, map(int, cs)))), numbers).items()) if ws is not None else [] for ws, cs in zip(batch["words"], batch["tf"])]
            yield pd.DataFrame({"i": batch["i"], "y": batch["y"], "terms": [[p[0] for p in x] for x in own], "tf": [[p[1] for p in x] for x in own]})

    placed = stored(examples.mapInPandas(run, "i long, y double, terms array<int>, tf array<int>"), "examples")
    n, mean, size = placed.agg(F.count(F.lit(1)), F.avg("y"), F.sum(F.size("terms"))).first()
    pooled = F.coalesce(F.get("terms", F.lit(0)), F.lit(len(words))) == len(words)
    bare = placed.where(pooled).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("y")).first()
    share = F.pmod(F.xxhash64("i", F.lit(7)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    held = placed.where((F.size("terms") > 0) & (share < min(1.0, postings / max(size or 0, 1)))).orderBy("i", "terms", "tf").collect()
    index = build_index([r.i for r in held], [r.y for r in held], [(np.array(r.terms, np.int64), np.array(r.tf, float)) for r in held], idf)
    model = Model({w: i for i, w in enumerate(words)}, idf, index, float(mean or 0.0), (bare.y + 0.1) / (bare.n + 1), (8.0, -4.0))
    if not len(index.ids):
        return model
    sent_model = spark.sparkContext.broadcast(model)

    def left_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = sent_model.value.index
        by = np.argsort(x.examples, kind="stable")
        word = np.repeat(np.arange(len(x.starts) - 1), np.diff(x.starts))[by]
        ends = np.searchsorted(x.examples[by], np.arange(len(x.ids) + 1))
        for batch in batches:
            out = []
            for e in batch["id"]:
                own = slice(ends[e], ends[e + 1])
                found, cosines = nearest(x, word[own], x.weights[by][own], k, without=e)
                out.append(votes(x.labels[found], cosines, sent_model.value.mean) if len(found) else np.nan)
            yield pd.DataFrame({"id": batch["id"], "vote": out})

    marked = np.unique(index.examples[: index.starts[-2]])  # examples with a word of the vocabulary
    if not len(marked):
        return model
    got = spark.createDataFrame([(int(e),) for e in marked], "id long").repartition(8).mapInPandas(left_out, "id long, vote double").toPandas()  # a row an example
    got = got[got["vote"].notna()].sort_values("id")
    return model._replace(curve=calibration(got["vote"].to_numpy(), index.labels[got["id"].to_numpy()]))


def score_vectors(vectors: DataFrame, model: Model, k: int = NEIGHBOURS) -> DataFrame:
    """doc_id, score, n_neighbours, evidence: the neighbours' ids, nearest first.  The model has a bounded size and is broadcast."""
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, near, evidence = [], [], []
            for terms, tf in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                s, found, _ = judged(sent.value, np.array(terms, np.int64), np.array(tf, float), k)
                score.append(s)
                near.append(len(found))
                evidence.append(",".join(map(str, sent.value.index.ids[found].tolist())) if len(found) else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(near, pa.int32()), pa.array(evidence, pa.string())], ["doc_id", "score", "n_neighbours", "evidence"])

    return vectors.mapInArrow(run, "doc_id long, score double, n_neighbours int, evidence string")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, score, n_neighbours, evidence of every document.

    Labels are learned from rows whose crc32(id) mod 5 is not 0, about ``train_rows`` of them; null ids and labels are left out; an id that repeats in
    the labels counts once, with its largest label.  A score depends on the text alone.  Null and empty texts, and texts without a
    word of the vocabulary, get the mean label of such examples; very long texts are read whole; null ids and repeated rows stay, a result
    row each; other columns are ignored; an empty table gives no rows; without labels all scores are 0.1."""
    since = mark()
    examples = stored(labelled_examples(docs, labels, id_col, text_col, label_col, train_rows), "labelled")
    words = choose_words(examples)
    vectors = stored(vectors_of(docs, words, id_col, text_col), "term-vectors")
    return finished(score_vectors(vectors, fit_toxicity(vectors, examples, words)), "toxicity", since)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_neighbours", "evidence")
