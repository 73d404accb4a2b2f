"""Compressed vectors: product codes of whole numbers, assigned by slice-and-intersect bitmasks.

A vector's components become whole numbers and are cut into parts; each part is coded by the nearest entry of its codebook.
To find it exactly without a look at every entry, each coordinate of a codebook is sorted once and its places carry prefix masks:
the entries among the first i, a bit each.  A row's distance to some entry is its radius; in every coordinate the entries
within the radius are a slice of the sorted ones, whose mask is the exclusive or of two prefix masks.  The slices' masks
ANDed leave the entries in a box about the row, among them all that are as near as the first guess: only they are measured.

Codebooks (parts x entries x width numbers, whatever the table's size) are broadcast; a round's assignments come back as sums
and counts of each entry, added up in the tasks first.  All sums are whole numbers, so no result depends on an order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import finished, mark, stored, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Numbers that a step of the assignment holds at once, about; labels whose sums are broadcast, at most.
STEP_NUMBERS, FEW_LABELS = 1 << 21, 100_000
Books = dict[int, np.ndarray]


def width_of(length: int, parts: int) -> int:
    return max(1, -(-length // parts))


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as 32-bit whole numbers."""
    x = np.floor(values.astype(np.float64) * scale)
    if x.size and np.abs(x).max() >= 1 << 31:
        raise ValueError("a component is too large for 32-bit whole numbers")
    return x.astype(np.int64)


def ordered_bytes(v: np.ndarray) -> bytes:
    """Bytes that compare as the numbers do."""
    return (v + (1 << 31)).astype(">u4").tobytes()


def from_bytes(column: pa.Array, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(-1, length).astype(np.int64) - (1 << 31)


def padded(v: np.ndarray, parts: int) -> np.ndarray:
    return np.pad(v, ((0, 0), (0, parts * width_of(v.shape[1], parts) - v.shape[1])))


class Slices:
    """One part's codebook (entries, width) with each coordinate sorted and its prefix masks (64 entries a word)."""

    def __init__(self, book: np.ndarray) -> None:
        self.book = book
        k, width = book.shape
        order = book.argsort(0, kind="stable")
        self.sorted = np.take_along_axis(book, order, 0)
        self.masks = np.zeros((width, k + 1, -(-k // 64)), np.uint64)
        for i in range(k):
            self.masks[:, i + 1] = self.masks[:, i]
            self.masks[np.arange(width), i + 1, order[i] // 64] |= np.uint64(1) << (order[i] % 64).astype(np.uint64)
        #: The guess: the entry nearest in the coordinate that spreads most.
        self.widest = int((self.sorted[-1] - self.sorted[0]).argmax())
        self.order = order[:, self.widest]
        self.between = (self.sorted[1:, self.widest] + self.sorted[:-1, self.widest]) // 2

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """(rows, words): the entries in the box of the radius about each row."""
        found = None
        for j in range(x.shape[1]):
            low = self.sorted[:, j].searchsorted(x[:, j] - radius, "left")
            high = self.sorted[:, j].searchsorted(x[:, j] + radius, "right")
            own = self.masks[j, high] ^ self.masks[j, low]
            found = own if found is None else found & own
        return found

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row, ties to the lower entry."""
        code = self.order[self.between.searchsorted(x[:, self.widest], "left")]
        best = ((x - self.book[code]) ** 2).sum(1)
        radius = np.sqrt(best.astype(np.float64)).astype(np.int64) + 1
        inside = self.candidates(x, radius)
        for e in range(len(self.book)):
            at = np.flatnonzero((inside[:, e // 64] >> np.uint64(e % 64)) & np.uint64(1))
            d = ((x[at] - self.book[e]) ** 2).sum(1)
            better = (d < best[at]) | ((d == best[at]) & (e < code[at]))
            code[at[better]], best[at[better]] = e, d[better]
        return code, best


def coded(v: np.ndarray, slices: list[Slices]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), both (rows, parts), in steps of bounded size."""
    parts, width = len(slices), v.shape[1] // len(slices)
    codes, errors = np.empty((len(v), parts), np.int64), np.empty((len(v), parts), np.int64)
    step = max(1, STEP_NUMBERS // v.shape[1])
    for at in range(0, len(v), step):
        for p in range(parts):
            codes[at : at + step, p], errors[at : at + step, p] = slices[p].nearest(v[at : at + step, p * width : (p + 1) * width])
    return codes, errors


def kept_rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None, scale: int) -> DataFrame:
    """vec_id, label, length, v (ordered bytes) of the vectors without null or non-finite components."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), (F.col(label_col) if label_col else F.lit(0)).alias("label"), x.alias("x")).where(fine)
    schema = T.StructType([*d.schema.fields[:2], T.StructField("length", T.IntegerType()), T.StructField("v", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = np.diff(lists.offsets.to_numpy())
            v = whole_numbers(lists.flatten().to_numpy(zero_copy_only=False), scale)
            cut = np.concatenate([[0], np.cumsum(ends)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ends, pa.int32()), pa.array([ordered_bytes(v[a:b]) for a, b in zip(cut[:-1], cut[1:])], pa.binary())], ["vec_id", "label", "length", "v"])

    return d.mapInArrow(run, schema)


def first_books(rows: DataFrame, parts: int, entries: int) -> Books:
    """length -> codebooks (parts, entries, width): the parts of the smallest ids (null last; of equal ids the smaller vector)."""
    books = {}
    for r in rows.select("length").distinct().collect():
        least = rows.where(F.col("length") == r.length).orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
        v = padded(from_bytes(pa.array([bytes(x.v) for x in least], pa.binary()), r.length) if r.length else np.zeros((len(least), 0), np.int64), parts)
        books[r.length] = np.ascontiguousarray(v.reshape(len(v), parts, -1).transpose(1, 0, 2))
    return books


def by_length(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """The rows of each length of a batch, with their padded numbers."""
    for batch in batches:
        lengths = batch.column("length").to_numpy()
        for length in np.unique(lengths):
            own = batch.filter(pa.array(lengths == length))
            v = from_bytes(own.column("v"), length) if length else np.zeros((own.num_rows, 0), np.int64)
            yield own, int(length), padded(v, parts)


def check_exact(v: np.ndarray, book: np.ndarray) -> None:
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * most * most * v.shape[1] >= 1 << 63:
        raise ValueError("components are too large for exact 64-bit distances")


def improved(rows: DataFrame, books: Books) -> Books:
    """One round: every entry becomes the floored mean of the parts assigned to it; entries without any stay."""
    parts = len(next(iter(books.values())))
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = {length: [Slices(b) for b in book] for length, book in sent.value.items()}
        sums = {length: np.zeros(book.shape, np.int64) for length, book in sent.value.items()}
        counts = {length: np.zeros(book.shape[:2], np.int64) for length, book in sent.value.items()}
        for _, length, v in by_length(batches, parts):
            check_exact(v, sent.value[length])
            codes, _ = coded(v, slices[length])
            cut = v.reshape(len(v), parts, -1)
            for p in range(parts):
                np.add.at(sums[length][p], codes[:, p], cut[:, p])
                counts[length][p] += np.bincount(codes[:, p], minlength=len(slices[length][p].book))
        for length, total in sums.items():
            p, e, j = (x.ravel() for x in np.indices(total.shape))
            n = np.repeat(counts[length].ravel(), total.shape[2])
            used = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[used], k) for x, k in ((np.full(len(p), length), pa.int32()), (p, pa.int32()), (e, pa.int32()), (j, pa.int32()), (total.ravel(), pa.int64()), (n, pa.int64()))], ["length", "p", "e", "j", "total", "n"])

    found = rows.select("length", "v").mapInArrow(run, "length int, p int, e int, j int, total long, n long")
    found = found.groupBy("length", "p", "e", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    fresh = {length: book.copy() for length, book in books.items()}
    for r in found.collect():  # a number of a codebook each
        fresh[r.length][r.p, r.e, r.j] = int(r.total) // r.n
    return fresh


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def train_codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books:
    books = first_books(rows, parts, entries)
    for _ in range(rounds if books else 0):
        books = improved(rows, books)
    return books


def encode(rows: DataFrame, books: Books) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error, codebooks_sha256."""
    sent = rows.sparkSession.sparkContext.broadcast(books)
    schema = T.StructType([*rows.schema.fields[:2], *T.StructType.fromDDL("code string, error long, codebooks_sha256 string").fields])
    pairs = np.array([f"{i:02x}" for i in range(256)], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = {length: [Slices(b) for b in book] for length, book in sent.value.items()}
        digests = {length: digest(book) for length, book in sent.value.items()}
        for own, length, v in by_length(batches, next((len(x) for x in slices.values()), 1)):
            check_exact(v, sent.value[length])
            codes, errors = coded(v, slices[length])
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(pairs[codes].sum(1), pa.string()), pa.array(errors.sum(1), pa.int64()), pa.array([digests[length]] * len(v), pa.string())], ["vec_id", "label", "code", "error", "codebooks_sha256"])

    return rows.mapInArrow(run, schema)


def with_label_error(coded_rows: DataFrame) -> DataFrame:
    """Adds label_error, the sum over the rows of equal label (nulls together).  Few labels are broadcast, by their counted number;
    many are joined in salted parts."""
    sums = stored(coded_rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")), "label-errors").withColumnRenamed("label", "_l")
    if sums.count() <= FEW_LABELS:
        return coded_rows.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("_l"))).drop("_l")
    salted = coded_rows.withColumn("_s", F.pmod(F.xxhash64("vec_id", "code"), F.lit(32)).cast("int"))
    sums = sums.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(31))))
    return salted.join(sums, F.col("label").eqNullSafe(F.col("_l")) & (F.col("_s") == F.col("_t"))).drop("_l", "_s", "_t")


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: a row for each vector without null or non-finite components.

    The first entries are the vectors of the smallest ids (null ids last, repeated ids in the order of their vectors); with fewer rows
    there are fewer entries.  Vectors of each length have codebooks of their own; a length that ``parts`` doesn't divide is filled up
    with zeros at the end.  Null ids and labels and repeated rows stay; a label is compared with nulls as one value; an empty table gives no rows;
    other columns are ignored.  Components whose distances don't fit in 64 bits are an error.  ``entries`` is 256 at most."""
    since = mark()
    rows = stored(kept_rows(vectors, id_col, vector_col, label_col, scale), "whole-vectors")
    out = stored(encode(rows, train_codes(rows, parts, entries, rounds)), "coded")
    return finished(with_label_error(out).select("vec_id", "code", "error", "label_error", "codebooks_sha256"), "codes", since)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _round(k: int) -> str:
    return f"""
d{k} AS MATERIALIZED (SELECT vec_id, p, e, CAST(sum((x.c - b.c) * (x.c - b.c)) AS BIGINT) AS d FROM x JOIN b{k} b USING (p, j) GROUP BY vec_id, p, e),
a{k} AS MATERIALIZED (SELECT vec_id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM d{k} GROUP BY vec_id, p),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, b.j, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN (SELECT p, e, j, CAST(floor(CAST(sum(c) AS DOUBLE) / count(*)) AS BIGINT) AS c FROM x JOIN a{k} USING (vec_id, p) GROUP BY p, e, j) m USING (p, e, j)),"""


OP11_SQL = f"""
WITH kept AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0),
long AS (SELECT vec_id, len(v) // 8 AS w, unnest(range(len(v))) AS i, CAST(floor(4096 * unnest(v)) AS BIGINT) AS c FROM kept),
x AS MATERIALIZED (SELECT vec_id, i // w AS p, i % w AS j, c FROM long),
least AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 16),
b0 AS MATERIALIZED (SELECT p, e, j, c FROM x JOIN least USING (vec_id)),{"".join(_round(k) for k in range(ROUNDS + 1))}
books AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM b{ROUNDS}),
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), books
"""
