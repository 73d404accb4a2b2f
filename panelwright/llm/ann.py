"""Nearest neighbours by inner product: score-aware (anisotropic) quantisation, four-bit table
scans, exact reranking.

A vector is cut into pairs of dimensions, each coded in four bits.  The codebooks are trained on
a bounded sample so that the part of the residual along the vector costs ETA times as much as
the part across it: it is that part which changes large inner products.  Every row is coded;
queries and rows are dealt to blocks and every pair of blocks is scanned in one task: a query's
tables (two codes, one byte, a step) give approximate scores, the best are scored exactly in
double precision, and only the best k of a block go on.  A row travels once for every
BLOCK_QUERIES queries, with its own numbers and its code; blocks are as large as a task's memory
easily holds (about 30 MB at 64 dimensions), so that is seldom.  As blocks are dealt by a hash, the
share of a block that is scored exactly gives the same recall at every size of the table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

K, QUERY_STEP = 20, 20
#: Vectors that the codebooks are trained on, at most; weight of the parallel error.
TRAIN_VECTORS, ETA, TRAIN_STEPS = 8192, 4.0, 8
#: Rows and queries of a block, about, and candidates that a block reranks for a query.
BLOCK_ROWS, BLOCK_QUERIES, RERANK = 32_768, 8192, 1024
SUB = 2


def valid(vector):
    """No null, no null or non-finite component, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def padded(x: np.ndarray) -> np.ndarray:
    """With zeros up to a multiple of two sub-vectors, so that two codes fill a byte."""
    more = -x.shape[1] % (2 * SUB)
    return np.pad(x, ((0, 0), (0, more))) if more else x


def assign(x: np.ndarray, books: np.ndarray, sweeps: int = 2) -> np.ndarray:
    """Codes under the anisotropic loss |r|^2 + (ETA - 1) (r.u)^2, u the vector's direction, by
    coordinate descent over the sub-vectors."""
    n, m = len(x), books.shape[0]
    sub = x.reshape(n, m, SUB)
    u = sub / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
    apart = np.empty((n, m, 16))
    along = np.empty((n, m, 16))
    for j in range(m):
        r = sub[:, j, None, :] - books[j][None]
        apart[:, j], along[:, j] = (r * r).sum(2), (r * u[:, j, None, :]).sum(2)
    codes = apart.argmin(2)
    rows = np.arange(n)
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(sweeps):
        for j in range(m):
            rest = total - along[rows, j, codes[:, j]]
            codes[:, j] = (apart[:, j] + (ETA - 1) * (rest[:, None] + along[:, j]) ** 2).argmin(1)
            total = rest + along[rows, j, codes[:, j]]
    return codes


def train_books(x: np.ndarray, steps: int = TRAIN_STEPS) -> np.ndarray:
    """Codebooks (sub-vectors, 16, SUB): assignment and weighted least squares in turn."""
    x = padded(x.astype(float))
    n, m = len(x), x.shape[1] // SUB
    sub = x.reshape(n, m, SUB)
    draw = np.random.default_rng(3)
    books = np.stack([sub[draw.choice(n, 16, replace=n < 16), j] for j in range(m)])
    u = sub / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
    for step in range(steps):
        codes = assign(x, books, sweeps=1 if step else 0)
        rows = np.arange(n)
        along = np.stack([((sub[:, j] - books[j][codes[:, j]]) * u[:, j]).sum(1) for j in range(m)], 1)
        total = along.sum(1)
        for j in range(m):
            rest = total - along[:, j]
            for c in range(16):
                own = rows[codes[:, j] == c]
                if len(own):
                    # minimise sum |x - b|^2 + (ETA - 1) (rest + (x - b).u)^2 over b
                    uu, xx = u[own, j], sub[own, j]
                    a = len(own) * np.eye(SUB) + (ETA - 1) * uu.T @ uu
                    b = xx.sum(0) + (ETA - 1) * (uu * (rest[own] + (xx * uu).sum(1))[:, None]).sum(0)
                    books[j, c] = np.linalg.solve(a, b)
            fresh = ((sub[:, j] - books[j][codes[:, j]]) * u[:, j]).sum(1)
            total = rest + fresh
            along[:, j] = fresh
    return books


def pack(codes: np.ndarray) -> np.ndarray:
    return (codes[:, 0::2] * 16 + codes[:, 1::2]).astype(np.uint8)


def byte_tables(query: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(bytes, 256): what a byte of two codes adds to the score."""
    own = np.einsum("mcd,md->mc", books, query.reshape(-1, SUB))
    return (own[0::2, :, None] + own[1::2, None, :]).reshape(-1, 256).astype(np.float32)


def exact_scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added in the order of the components, so that equal
    vectors have equal scores wherever they stand."""
    return np.cumsum(rows * query[None], axis=1)[:, -1]


def scan_block(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, codes: np.ndarray, books: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of a block for each query: (query ids, row ids, scores).

    Equal vectors are scanned once; of them only the k + 1 smallest ids can be among a query's
    nearest, and are brought back for the final order."""
    order = np.argsort(cid, kind="stable")
    cid, c, codes = cid[order], c[order], codes[order]
    inverse, _ = pd.factorize(np.array([v.tobytes() for v in c], object))
    first = np.unique(inverse, return_index=True)[1]
    by_vector = np.argsort(inverse, kind="stable")
    again = np.zeros(len(cid), bool)  # rows that repeat an id and its vector
    again[1:] = (np.diff(cid[by_vector]) == 0) & (np.diff(inverse[by_vector]) == 0)
    by_vector = by_vector[~again]
    starts = np.searchsorted(inverse[by_vector], np.arange(len(first) + 1))
    few, packed = c[first], np.ascontiguousarray(codes[first].T)
    out_q, out_c, out_s = [], [], []
    take = min(rerank, len(few))
    for i, query in zip(qid, q):
        tables = byte_tables(padded(query[None])[0], books)
        approx = tables[0][packed[0]]
        for j in range(1, len(packed)):
            approx += tables[j][packed[j]]
        top = np.argpartition(-approx, take - 1)[:take] if take < len(few) else np.arange(len(few))
        exact = exact_scores(query, few[top])
        ids, scores = [], []
        best = np.argsort(-exact, kind="stable")
        n = 0
        for at in best:
            if n >= k and exact[at] < scores[-1][0]:
                break
            own = cid[by_vector[starts[top[at]] : min(starts[top[at]] + k + 1, starts[top[at] + 1])]]
            own = own[own != i] if (own == i).any() else own
            if len(own):
                ids.append(own)
                scores.append(np.full(len(own), exact[at]))
                n += len(own)
        if ids:
            ids, scores = np.concatenate(ids), np.concatenate(scores)
            best = np.lexsort((ids, -scores))[:k]
            out_q.append(np.full(len(best), i))
            out_c.append(ids[best])
            out_s.append(scores[best])
    if not out_q:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = RERANK, train_vectors: int = TRAIN_VECTORS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows but itself.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids.  A query is compared with
    vectors of its own length; lengths are few, and each is searched with codebooks of its own.  Rows that repeat an id and
    vector count once; an id with several vectors stands for its best one.  Ties go to the smaller id.  Empty tables give no rows;
    other columns are ignored.
    """
    spark = vectors.sparkSession

    def cleaned(df: DataFrame) -> DataFrame:
        kind = "array<float>" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v")).where(F.col("id").isNotNull() & valid(F.col("v")))

    rows, asked = cleaned(vectors), cleaned(queries)
    sizes = {r["d"]: r["n"] for r in rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    found = None
    for r in asked.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect():
        if r["d"] in sizes:
            own = F.size("v") == r["d"]
            part = scanned(rows.where(own), asked.where(own), sizes[r["d"]], r["n"], k, rerank, train_vectors)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.select("query_id", F.row_number().over(w).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def scanned(rows: DataFrame, asked: DataFrame, n: int, n_asked: int, k: int, rerank: int, train_vectors: int) -> DataFrame:
    """query_id, vec_id, score: the best k of every block for each query; rows and asked (id, v) of one length."""
    spark = rows.sparkSession
    spread = F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    sample = rows.where(spread < train_vectors / n).limit(2 * train_vectors).toPandas()["v"] if n > train_vectors else rows.toPandas()["v"]
    if not len(sample):
        sample = rows.limit(train_vectors).toPandas()["v"]
    sent = spark.sparkContext.broadcast(train_books(np.stack(sample.to_numpy())))

    @F.pandas_udf("binary")
    def coded(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(float)
        return pd.Series([r.tobytes() for r in pack(assign(padded(x), sent.value))])

    blocks = max(1, -(-n // BLOCK_ROWS))
    # small tables are cut into more blocks of queries, as many as there are places to run them
    asked_blocks = max(1, -(-n_asked // BLOCK_QUERIES), min(-(-spark.sparkContext.defaultParallelism // blocks), -(-n_asked // 64)))
    block = F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")
    asked_block = F.pmod(F.xxhash64("id", "v"), F.lit(asked_blocks)).cast("int")
    left = rows.select("id", "v", coded("v").alias("code"), block.alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(asked_blocks - 1))).alias("qb"))
    right = asked.select("id", "v", asked_block.alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("rb"))

    def pair(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        codes = np.frombuffer(b"".join(c["code"]), np.uint8).reshape(len(c), -1)
        found = scan_block(q["id"].to_numpy(), np.stack(q["v"].to_numpy()).astype(float), c["id"].to_numpy(), np.stack(c["v"].to_numpy()).astype(float), codes, sent.value, k, rerank)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    return left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(pair, "query_id long, vec_id long, score double")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % QUERY_STEP == 0))


OP7_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
