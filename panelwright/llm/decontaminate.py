"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The test strings are windows of 13 consecutive words of the benchmark's items (an item of
fewer words is one window).  Windows of one length are searched together: a table over the
last two words of the search window says how far it may move on, a bucket under the hash of
those two words lists the strings that may end there, and a direct comparison confirms them.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table

WINDOW = 13
#: A document is contaminated if at least one word in SHARE is hit.
SHARE = 20
#: Bytes of benchmark text that the pattern tables of one part may hold; a larger benchmark is cut
#: into parts of this size by Spark and searched one part after the other, so what is broadcast is bounded.
#: A byte of text takes some 100 bytes of tables, so a part takes some 0.4 GB in each Python worker.
PART_BYTES = 4_000_000
#: A-Z become a-z, other ASCII bytes but digits and letters become blanks; UTF-8 stays.
WORD_BYTES = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))
OUT_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class WuManber:
    """Patterns of one length m over words.  Blocks have two words (one, where m is 1)."""

    def __init__(self, m: int) -> None:
        self.m, self.vocabulary, self.shift, self.buckets = m, set(), {}, defaultdict(list)
        self.items: dict[tuple[bytes, ...], set[int]] = {}

    def add(self, pattern: tuple[bytes, ...], item: int) -> None:
        if pattern in self.items:
            self.items[pattern].add(item)
            return
        self.items[pattern] = {item}
        m = self.m
        self.vocabulary.update(pattern)
        if m == 1:
            self.buckets[pattern[0]].append(pattern)
            return
        for end in range(1, m):
            block, move = (pattern[end - 1], pattern[end]), m - 1 - end
            if self.shift.get(block, m) > move:
                self.shift[block] = move
        self.buckets[pattern[m - 2 :]].append(pattern)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(end index, pattern) of every occurrence."""
        m, vocabulary, shift, buckets = self.m, self.vocabulary, self.shift, self.buckets
        at, n = m - 1, len(words)
        if m == 1:
            for at, word in enumerate(words):
                for pattern in buckets.get(word, ()):
                    yield at, pattern
            return
        while at < n:
            word = words[at]
            if word not in vocabulary:
                at += m
                continue
            block = (words[at - 1], word)
            move = shift.get(block, m - 1)
            if move:
                at += move
                continue
            start = at - m + 1
            first = words[start]
            for pattern in buckets[block]:
                if pattern[0] == first and words[start : at + 1] == list(pattern):
                    yield at, pattern
            at += 1


def pattern_tables(items: list[tuple[int, str | None]], window: int = WINDOW) -> list[WuManber]:
    by_length: dict[int, WuManber] = {}
    for item, text in items:
        words = words_of(text)
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            if m not in by_length:
                by_length[m] = WuManber(m)
            by_length[m].add(tuple(words[i : i + m]), item)
    return list(by_length.values())


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges [start, end) as disjoint ones, in order."""
    merged: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def search(tables: list[WuManber], words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
    """Hit ranges [start, end) of words, merged, and the items with an occurring window."""
    ranges, items = [], set()
    for t in tables:
        for end, pattern in t.find(words):
            ranges.append((end - t.m + 1, end + 1))
            items |= t.items[pattern]
    return merge(ranges), items


def verdict(n_words: int, hit: int) -> bool:
    return hit > 0 and SHARE * hit >= n_words


class Parts:
    """The pattern tables of a benchmark, part by part: those of one part are in memory at a time."""

    def __init__(self, groups: list[list[int]], rows: DataFrame, window: int) -> None:
        self.groups, self.rows, self.window = groups, rows, window

    def __len__(self) -> int:
        return len(self.groups)

    def __iter__(self) -> Iterator[list[WuManber]]:
        for group in self.groups:
            found = self.rows.where(F.col("part").isin(group)) if group else self.rows
            yield pattern_tables([(r.i, r.t) for r in found.select("i", "t").collect()], self.window)


def pieces(text: str, window: int, most_bytes: int) -> Iterator[str]:
    """A text, or pieces of it of about ``most_bytes`` that have each of its windows in whole."""
    size = len(text.encode("utf-8", "surrogatepass"))
    words = words_of(text) if size > most_bytes else []
    if len(words) <= window:
        yield text
        return
    step = max(1, len(words) * most_bytes // size - window)
    for at in range(0, len(words) - window + 1, step):
        yield b" ".join(words[at : at + step + window - 1]).decode("utf-8", "surrogatepass")


def benchmark_tables(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, most_bytes: int = PART_BYTES) -> Parts:
    """The pattern tables of a benchmark, in parts of about ``most_bytes`` of text."""
    rows = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("t IS NOT NULL")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    if size <= most_bytes:
        return Parts([[]], rows, window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            of, part_ids, texts, sizes = [], [], [], []
            for k, text in enumerate(batch.column(1)):
                for piece in pieces(text.as_py(), window, most_bytes):
                    n = len(piece.encode("utf-8", "surrogatepass"))
                    if held and held + n > most_bytes:
                        part, held = part + 1, 0
                    held += n
                    of.append(k), part_ids.append(part), texts.append(piece), sizes.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(part_ids, pa.int64()), batch.column(0).take(pa.array(of, pa.int64())), pa.array(texts, batch.column(1).type), pa.array(sizes, pa.int64())], ["part", "i", "t", "n"])

    schema = T.StructType([T.StructField("part", T.LongType()), rows.schema["i"], rows.schema["t"], T.StructField("n", T.LongType())])
    rows = stored(rows.repartition(-(-size // most_bytes), F.xxhash64("t")).mapInArrow(cut, schema), "benchmark")
    groups, held = [], most_bytes + 1
    for r in rows.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        if held + r.n > most_bytes:
            groups.append([])
            held = 0
        groups[-1].append(r.part)
        held += r.n
    return Parts(groups, rows, window)


def searched(docs: DataFrame, id_col: str, text_col: str, tables: list[WuManber]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sent.value
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                ranges, items = search(found, words)
                rows.append(result(i, len(words), ranges, [str(x) for x in items]))
            yield result_batch(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, OUT_SCHEMA)


def result(doc_id: int | None, n_words: int, ranges: list[tuple[int, int]], items: list[str]) -> tuple:
    hit = sum(b - a for a, b in ranges)
    return doc_id, n_words, hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), verdict(n_words, hit)


def result_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.string(), pa.bool_()]
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)


def searched_in_parts(keyed: DataFrame, parts: Parts) -> DataFrame:
    """keyed: key, doc_id, text.  key and the columns of OUT_SCHEMA: each part's hit ranges and items are written, put together
    by row, and only then counted."""
    found = None
    for k, tables in enumerate(parts):
        sent = keyed.sparkSession.sparkContext.broadcast(tables)

        def run(batches: Iterator[pa.RecordBatch], every: bool = k == 0, sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in batches:
                rows = []
                for key, i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    words = words_of(text.as_py())
                    ranges, items = search(own, words)
                    if every or ranges:  # the first part has a row of each document; a null item is told from the text "None"
                        rows.append((key, i, len(words), [a for a, _ in ranges], [b for _, b in ranges], ["" if x is None else f"={x}" for x in items]))
                kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], ["key", "doc_id", "n_words", "starts", "ends", "items"])

        hits = stored(keyed.mapInArrow(run, "key long, doc_id long, n_words long, starts array<long>, ends array<long>, items array<string>"), "hits")
        sent.destroy()
        found = hits if found is None else found.unionByName(hits)
    whole = found.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))).alias("ranges"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [result(r["doc_id"], r["n_words"], merge([(x["starts"], x["ends"]) for x in r["ranges"]]), [x[1:] if x else "None" for x in r["items"]]) for r in batch.to_pylist()]
            out = result_batch(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), *out.columns], ["key", *out.schema.names])

    return whole.mapInArrow(count, f"key long, {OUT_SCHEMA}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, most_bytes: int = PART_BYTES) -> DataFrame:
    """Per document: words, words inside an occurrence of a window, items, their digest, and
    whether one word in SHARE is hit.  A null or empty text has no words and is clean; null ids
    and repeated rows stay, one result row each; items with equal windows all count; a null item
    id counts as the item "None"; other columns are ignored; very long texts are searched whole; an empty table gives no rows and an
    empty benchmark hits nothing.  A
    benchmark of more than ``most_bytes`` is searched in parts, with the same results."""
    parts = benchmark_tables(benchmark, window=window, most_bytes=most_bytes)
    if len(parts) == 1:
        return searched(docs, id_col, text_col, next(iter(parts)))
    keyed = stored(docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "documents")
    return searched_in_parts(keyed, parts).drop("key")


def contaminated_only(docs: DataFrame, parts: Parts, keep: bool, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are (or are not) contaminated."""
    if len(parts) > 1:
        rows = stored(docs.select(F.monotonically_increasing_id().alias("key"), F.col(text_col).cast("string").alias("text"), F.struct(*docs.columns).alias("_row")), "documents")
        hit = searched_in_parts(rows.select("key", F.lit(None).cast("long").alias("doc_id"), "text"), parts).where("contaminated").select("key")
        return rows.join(hit, "key", "left_semi" if keep else "left_anti").select("_row.*")
    sent = docs.sparkSession.sparkContext.broadcast(next(iter(parts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sent.value
        for batch in batches:
            mask = []
            for text in batch.column(text_col):
                words = words_of(text.as_py())
                hit = sum(b - a for a, b in search(found, words)[0])
                mask.append(verdict(len(words), hit) == keep)
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bwin AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM bw WHERE len(w) > 0)
), lens AS (SELECT DISTINCT m FROM bwin),
dwin AS (
  SELECT rid, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT rid, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM dw, lens WHERE len(w) >= m)
), hits AS (SELECT d.rid, d.i, d.m, b.item_id FROM dwin d JOIN bwin b ON d.g = b.g AND d.m = b.m),
hw AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + m - 1)) AS p FROM (SELECT DISTINCT rid, i, m FROM hits)) GROUP BY rid),
hi AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY rid)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""
