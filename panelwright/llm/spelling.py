"""Spelling variants: words one inserted, deleted or replaced letter apart, by pivotal bigrams.

A word's bigrams are put in one order, rarest in the vocabulary first.  Its prefix is its first three (with every place of the
third): of two words one edit apart, whose edit spoils two bigrams at most, each keeps one of them.  Its pivots are two bigrams
of the prefix that don't overlap, chosen by dynamic programming for the least sum of frequencies; an edit spoils one of them
at most.  If the prefix of r ends no later in that order than the prefix of s, a pivot that r keeps is in the prefix
of s, for a bigram of s outside it comes after all of it.  So pivots are looked up in the other words' prefixes only, at the
places that one edit can move them to and in words of a length that it can reach; the pairs found are verified by their edit
distance.

Places and lengths are part of the key; a key with many prefixes is dealt to parts by its counted size, so no task holds it whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import finished, mark, stored, table

#: Code points and occurrences that a word has at least; one run in STEP loses a letter; a form is RATIO times as frequent.
LEAST_LETTERS, LEAST_COUNT, STEP, RATIO = 6, 5, 199, 5
#: A bigram's letters; bigrams that one edit spoils at most, and so the pivots and the prefix.
GRAM, EDITS = 2, 1
N_PIVOTS, N_PREFIX = EDITS + 1, GRAM * EDITS + 1
#: Prefixes of one key that a part holds, about.
PART_ROWS = 2048
#: Where a pivot can stand in a word one edit away: differences in length and place.
SHIFTS = [(0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1)]


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", step: int = STEP, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT) -> DataFrame:
    """word, n: runs of letters, A-Z lower-cased, with their occurrences over all texts.

    A run whose crc32 of ``<id>:<run>`` is divisible by ``step`` loses the letter at that number modulo its length.  Null texts have no runs;
    a null id counts as an empty one; repeated rows count as often as they stand there."""
    low = F.translate(F.col(text_col).cast("string"), ascii_uppercase, ascii_lowercase)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(F.regexp_extract_all(low, F.lit(rf"([a-zÀ-ÿ]{{{letters},}})"), F.lit(1))).alias("w"))
    runs = runs.withColumn("h", F.crc32(F.encode(F.concat("i", F.lit(":"), "w"), "UTF-8")))
    at = (F.col("h") % F.length("w")).cast("int")
    cut = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))
    d = runs.select(F.when(F.col("h") % step == 0, cut).otherwise(F.col("w")).alias("word"))
    return d.where(F.length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def grams_of(words: DataFrame) -> DataFrame:
    """gram, f: in how many places of the vocabulary a bigram stands.  Letters are 90, so there are 8100 rows at most."""
    at = F.sequence(F.lit(1), F.length("word") - GRAM + 1)
    return words.select(F.explode(F.transform(at, lambda i: F.substring("word", i, F.lit(GRAM)))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("f"))


def pivots_of(prefix: list[tuple[int, int, int]], k: int = N_PIVOTS) -> list[tuple[int, int, int]]:
    """Of (place, rank, frequency) the ``k`` that don't overlap with the least sum of frequencies (then the earliest places)."""
    prefix = sorted(prefix)
    best: list[list[tuple[int, list]]] = [[(0, [])] * (len(prefix) + 1)]  # best[j][i]: j of the first i
    for j in range(1, k + 1):
        row: list[tuple[int, list]] = [(1 << 62, [])]
        for i, one in enumerate(prefix):
            free = i
            while free and prefix[free - 1][0] > one[0] - GRAM:
                free -= 1
            before = best[j - 1][free]
            row.append(min(row[i], (before[0] + one[2], [*before[1], one])))
        best.append(row)
    return best[k][-1][1]


def signature(word: str, order: dict[str, tuple[int, int]]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """(prefix, pivots, rank of the prefix's last bigram); entries (place, rank, frequency)."""
    grams = sorted((order[word[p : p + GRAM]], p) for p in range(len(word) - GRAM + 1))
    last = grams[N_PREFIX - 1][0][0]
    prefix = [(p, rank, f) for (rank, f), p in grams if rank <= last]
    return prefix, pivots_of(prefix), last


def letters_mask(word: str) -> int:
    """A bit for each letter that occurs: one edit changes two bits at most, if letters stay, else one."""
    m = 0
    for c in word:
        m |= 1 << (ord(c) & 63)
    return m - (1 << 64) if m >> 63 else m


SIGNED = "word string, n long, mask long, size int, last int, prefix array<struct<gram:int,at:int>>, pivots array<struct<gram:int,at:int>>"


def signed(words: DataFrame, order: dict[str, tuple[int, int]]) -> DataFrame:
    """words (word, n) with their prefixes and pivots; ``order``: bigram -> (rank, frequency), 8100 at most."""
    sent = words.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.list_(pa.struct([("gram", pa.int32()), ("at", pa.int32())]))
        for batch in batches:
            found = batch.column(0).to_pylist()
            all_ = [signature(w, sent.value) for w in found]
            entries = lambda k: pa.array([[{"gram": g, "at": p} for p, g, _ in a[k]] for a in all_], place)
            cols = [batch.column(0), batch.column(1), pa.array([letters_mask(w) for w in found], pa.int64()), pa.array([len(w) for w in found], pa.int32()), pa.array([a[2] for a in all_], pa.int32()), entries(0), entries(1)]
            yield pa.RecordBatch.from_arrays(cols, ["word", "n", "mask", "size", "last", "prefix", "pivots"])

    return words.mapInArrow(run, SIGNED)


def near_pairs(words: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """a, na, b, nb: every two words one edit apart, once, with their counts.  words (word, n) of at least four letters, distinct."""
    ranked = sorted((r.f, r.gram) for r in grams_of(words).collect())  # 8100 rows at most
    s = signed(words, {g: (i, f) for i, (f, g) in enumerate(ranked)})
    s = stored(s, "signed")
    there = s.select("word", "n", "mask", "last", "size", F.inline("prefix")).withColumnRenamed("at", "place")
    sizes = there.groupBy("gram", "place", "size").agg(F.count(F.lit(1)).alias("rows")).withColumn("parts", F.ceil(F.col("rows") / part_rows).cast("int"))
    crowded = sizes.where("parts > 1").select("gram", "place", "size", "parts")
    dealt = F.coalesce(F.pmod(F.xxhash64("word"), "parts"), F.lit(0)).cast("int")
    key = ["gram", "place", "size"]
    there = there.join(crowded, key, "left").select(*key, dealt.alias("part"), F.col("word").alias("b"), F.col("n").alias("nb"), F.col("mask").alias("mb"), F.col("last").alias("lb"))
    shifts = F.array(*[F.struct(F.lit(d).alias("longer"), F.lit(m).alias("moved")) for d, m in SHIFTS])
    asked = s.select("word", "n", "mask", "last", "size", F.inline("pivots")).withColumn("x", F.explode(shifts))
    asked = asked.select("gram", (F.col("at") + F.col("x.moved")).alias("place"), (F.col("size") + F.col("x.longer")).alias("size"), F.col("word").alias("a"), F.col("n").alias("na"), F.col("mask").alias("ma"), F.col("last").alias("la"), F.abs("x.longer").alias("differ"))
    asked = asked.where("place >= 0").join(crowded, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    near = (F.col("la") <= F.col("lb")) & (F.bit_count(F.col("ma").bitwiseXOR(F.col("mb"))) <= 2 - F.col("differ")) & (F.col("a") != F.col("b")) & (F.levenshtein("a", "b", EDITS) == EDITS)
    d = asked.alias("p").join(there.alias("q"), [F.col(f"p.{k}") == F.col(f"q.{k}") for k in [*key, "part"]] + [near]).select("a", "na", "b", "nb")
    first = F.col("a") < F.col("b")
    turned = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return d.select(turned("a", "b").alias("a"), turned("na", "nb").alias("na"), turned("b", "a").alias("b"), turned("nb", "na").alias("nb")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form), a word once: adds root, the end of the chain of forms.  Each round doubles the steps taken."""
    r = stored(forms.select("word", "form", F.col("form").alias("root")), "roots")
    while True:
        on = r.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        r = stored(r.join(on, "root", "left").select("word", "form", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("moved")), "roots")
        if not r.where("moved").limit(1).count():
            return r.drop("moved")
        r = r.drop("moved")


def better(n: Column, of: Column, ratio: int) -> Column:
    """Whether n >= ratio * of, whatever their size."""
    return n.cast("decimal(20,0)") >= of.cast("decimal(20,0)") * ratio


def group_variants(words: DataFrame, ratio: int = RATIO, part_rows: int = PART_ROWS) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table of distinct words (word, n) of at least four letters a-z and U+00C0-U+00FF.

    A word's form is its near word with the largest n (ties: the smallest by code points), if that is ``ratio`` times its own; the root is
    where the forms lead to.  No word is left out; an empty table gives no rows."""
    pairs = near_pairs(words, part_rows)
    seen = lambda x, nx, y, ny: F.struct(F.col(x).alias("word"), F.col(nx).alias("n"), F.col(y).alias("near"), F.col(ny).alias("near_n"))
    both = pairs.select(F.inline(F.array(seen("a", "na", "b", "nb"), seen("b", "nb", "a", "na"))))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.max("n").alias("n"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))).alias("best"))
    formed = better(-F.col("best.m"), F.col("n"), ratio)
    best = stored(best.select("word", "n_near", F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.m")).alias("form_n")), "near")
    led = roots(best.where("form IS NOT NULL")).select("word", "root")
    d = words.join(best, "word", "left").join(led, "word", "left")
    return d.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", step: int = STEP) -> DataFrame:
    """``group_variants`` of the words of all whole texts.

    Null and empty texts have no words; very long texts are read whole; other columns are ignored, whatever their names; an
    empty table gives no rows."""
    since = mark()
    words = stored(words_of(docs, id_col, text_col, step), "words")
    return finished(group_variants(words), "spelling", since)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


#: The crc32 of a key is the exclusive or of what each of its bytes adds, which depends on the byte and on how many follow it (t).
OP13_SQL = f"""
WITH RECURSIVE
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{ascii_uppercase}', '{ascii_lowercase}'), '[a-z\\x{{C0}}-\\x{{FF}}]{{6,}}')) AS w FROM documents),
keys AS (SELECT doc_id, w, count(*) AS c, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM runs GROUP BY doc_id, w),
s(b, v, k) AS (SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256) UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM s WHERE k < 8),
t0 AS MATERIALIZED (SELECT b, v FROM s WHERE k = 8),
t(k, b, v) AS (SELECT CAST(0 AS BIGINT), b, v FROM t0 UNION ALL SELECT t.k + 1, t.b, xor(t.v >> 8, z.v) FROM t JOIN t0 z ON z.b = t.v % 256 WHERE t.k < (SELECT max(length(x) // 2) FROM keys)),
places AS (SELECT doc_id, w, c, x, unnest(range(1, length(x) // 2 + 1)) AS i FROM keys),
bytes AS (SELECT doc_id, w, c, length(x) // 2 - i AS after, xor(CAST('0x' || substr(x, 2 * i - 1, 2) AS BIGINT), CASE WHEN i <= 4 THEN 255 ELSE 0 END) AS b FROM places),
crc AS (SELECT doc_id, w, c, xor(bit_xor(t.v), 4294967295) AS h FROM bytes JOIN t ON t.k = bytes.after AND t.b = bytes.b GROUP BY doc_id, w, c),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM crc),
words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, n, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, other)) AS other FROM near GROUP BY word, n),
forms AS MATERIALIZED (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * words.n THEN other END AS form, CASE WHEN m >= 5 * words.n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
chain(word, here, k) AS (SELECT word, word, 0 FROM forms UNION ALL SELECT c.word, f.form, c.k + 1 FROM chain c JOIN forms f ON f.word = c.here WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, k) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""
