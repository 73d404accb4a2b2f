"""MinHash near-duplicates by a chosen-path set similarity join.

Documents with equal shingle sets are one class; classes are joined.  In each of TREES
independent trees a class walks down from the root: at a node it follows BRANCHES coordinates
of its MinHash signature, chosen by the node, into the children named by its minwise tokens
there.  Classes that meet in a small node are compared exhaustively: first by their sketches,
and those which are near by their full sets.  With two branches a pair at the threshold survives
every level of a tree with probability 0.97 or more, so four trees miss about one in a million.

The join has two rounds.  The first looks at one coordinate only and finds most links cheaply.  The
second walks all trees; pairs that the first round has connected need no further look, so whole
nodes drop out.  What sizes and sketches cannot tell apart is held together by its full sets, in
groups of a bounded number of texts that follow the pairs in question.

A large node is first cut by set sizes (linked sets are nearly of one size).  One of mostly alike
classes would never become small by branching: there a pivot is drawn, and the ball around it is
settled in blocks like a family's; what lies outside goes on branching, and ball and rest overlap by
more than a linked pair can differ in its likeness to the pivot.  No group is larger than SMALL, no
group of texts larger than BLOCK, and nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import finished, mark, perhaps_among, release, stored, table
from .components import components

SHINGLE, NUMERATOR = 3, 85
COORDINATES, TREES, BRANCHES = 192, 4, 2
SMALL = 2048
#: Texts of a group that is confirmed by full sets, at most.
BLOCK = 256
MOST_LEVELS = 8
#: Sketches may fall short of the threshold by this much (4.5 standard errors).
MARGIN = 0.12
#: A node is dense if at least half of it is near to its pivot; the ball and the rest overlap.
DENSE_SHARE, BALL_FROM, REST_BELOW = 0.5, 0.4, 0.65
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_draw = np.random.default_rng(11)
FACTORS = (_draw.integers(0, 1 << 31, COORDINATES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
OFFSETS = _draw.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def shingle_set(text: str | None, width: int, memo: WordHashes) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles; with fewer words, of the whole sequence."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([memo[w] for w in words], np.uint64)
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, np.uint64) + np.uint64(min(len(h), width))
    for k in range(min(width, len(h))):
        out = (out ^ h[k : k + n]) * MIX
        out ^= out >> np.uint64(29)
    return np.unique(out * MIX2)


def class_id(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63)


def signature(hashes: np.ndarray) -> np.ndarray:
    """COORDINATES minwise values of a set."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        low = np.minimum(low, (x[at : at + 2048, None] * FACTORS + OFFSETS).min(0))
    return low


def sketch_of(values: np.ndarray) -> bytes:
    """A byte of each minwise value, by its hash: the value's own high bits are nearly always 0 in a large set."""
    x = (values ^ (values >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return ((x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(24)).astype(np.uint8).tobytes()


def first_nodes(values: np.ndarray) -> np.ndarray:
    """The nodes below the roots: each tree has its own BRANCHES coordinates there."""
    k = TREES * BRANCHES
    return ((values[:k].astype(np.uint64) + MIX * np.arange(1, k + 1, dtype=np.uint64)) * MIX2 ^ (values[:k].astype(np.uint64) * MIX >> np.uint64(31))).astype(np.int64)


def documents_sets(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, cid (hash of the set, null if empty), sketch (a byte of the hash
    of each minwise value), nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            n, cid, sketch, nodes = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), width, memo)
                n.append(len(s))
                if len(s):
                    values = signature(s)
                    cid.append(class_id(s))
                    sketch.append(sketch_of(values))
                    nodes.append(first_nodes(values).tolist())
                else:
                    cid.append(None), sketch.append(None), nodes.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(sketch, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "cid", "sketch", "nodes"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, cid long, sketch binary, nodes array<long>")


def sized(rows: DataFrame) -> DataFrame:
    """rows (node, cid, ...): adds the node's size, without nodes of one class."""
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return rows.join(sizes, "node")


def sketch_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, COORDINATES)


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Frames of whole groups, from rows sorted by their first column."""
    kept = None
    for batch in batches:
        frame = batch.to_pandas()
        if kept is not None and len(kept):
            frame = pd.concat([kept, frame], ignore_index=True)
        if not len(frame):
            continue
        key = frame.iloc[:, 0].to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield frame.iloc[:cut].reset_index(drop=True)
        kept = frame.iloc[cut:].reset_index(drop=True)
    if kept is not None and len(kept):
        yield kept


def roots(n: int, pairs: Iterator[tuple[int, int]]) -> tuple[list[int], list[tuple[int, int]]]:
    """Union-find: (root of each, the pairs that joined two sets)."""
    up, made = list(range(n)), []

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            made.append((a, b))
    return [top(i) for i in range(n)], made


def near_pairs(least: float, numerator: int, hubs: bool = False):
    """Rows (lid, side, cid, comp, n, sketch) of lists, sorted by lid: of each list the classes with a partner of another component
    that sizes and sketches cannot tell apart, in groups for ``confirmed`` (``hubs``: in whole connected parts).  Sides 1 and 2: only pairs across."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in runs_of(batches):
            key, cid, comp, side, n = (frame[c].to_numpy() for c in ("lid", "cid", "comp", "side", "n"))
            sketches = sketch_matrix(frame["sketch"])

            def may(i, j):
                return (comp[i] != comp[j]) & ((side[i] != side[j]) | (side[i] == 0)) & (100 * np.minimum(n[i], n[j]) >= numerator * np.maximum(n[i], n[j]))

            bounds = np.flatnonzero(np.diff(key, prepend=key[0] - 1, append=key[-1] + 1))
            sizes = np.diff(bounds)
            short = np.repeat(sizes <= 8, sizes)
            found_a, found_b = [], []
            for step in range(1, 8):  # short lists together, by the distance of their rows
                at = np.flatnonzero((key[step:] == key[:-step]) & short[step:])
                at = at[may(at, at + step)]
                for k in range(0, len(at), 8192):
                    own = at[k : k + 8192]
                    near = own[(sketches[own] == sketches[own + step]).mean(1) >= least]
                    found_a.append(near)
                    found_b.append(near + step)
            for lo, hi in zip(bounds[:-1][sizes > 8], bounds[1:][sizes > 8]):
                order = lo + np.argsort(n[lo:hi], kind="stable")
                reach = np.searchsorted(n[order], n[order] * 100 // numerator, side="right")
                for k in range(len(order) - 1):
                    i, others = order[k], order[k + 1 : reach[k]]
                    others = others[may(i, others)]
                    if len(others):
                        near = others[(sketches[others] == sketches[i]).mean(1) >= least]
                        found_a.append(np.full(len(near), i))
                        found_b.append(near)
            a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (found_a, found_b))
            if not len(a):
                continue
            used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            part, _ = roots(len(used), zip(place[: len(a)].tolist(), place[len(a) :].tolist()))
            if hubs:  # whole connected parts, named by their smallest
                gid, out = pd.Series(cid[used]).groupby(np.array(part)).transform("min").to_numpy(), cid[used]
                sides = np.zeros(len(out), np.int32)
            else:
                gid, sides, out = text_groups(cid[used], np.array(part), place[: len(a)], place[len(a) :])
            yield pa.RecordBatch.from_arrays([pa.array(gid, pa.int64()), pa.array(sides, pa.int32()), pa.array(out, pa.int64())], ["gid", "side", "cid"])

    return run


def text_groups(cid: np.ndarray, part: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Groups (gid, side, cid) of BLOCK classes at most that hold both ends of every pair (a, b).

    A connected part that fits is one group.  A larger one is put in breadth-first order and cut into halves of a block;
    of each two halves, the classes that have a pair across are a group."""
    gid: list[int] = []
    sides: list[int] = []
    out: list[int] = []

    def put(left: np.ndarray, right: np.ndarray | None = None) -> None:
        every = np.sort(cid[left]) if right is None else np.concatenate([np.sort(cid[left]), [0], np.sort(cid[right])])
        g = class_id(every.astype(np.int64))
        for side, own in ((0, left),) if right is None else ((1, left), (2, right)):
            gid.extend([g] * len(own))
            sides.extend([side] * len(own))
            out.extend(cid[own].tolist())

    order = np.argsort(part, kind="stable")
    bounds = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
    large = np.zeros(len(cid), bool)
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi - lo <= BLOCK:
            put(order[lo:hi])
        else:
            large[order[lo:hi]] = True
    if large.any():
        keep = large[a]
        x, y = np.concatenate([a[keep], b[keep]]), np.concatenate([b[keep], a[keep]])
        by = np.argsort(x, kind="stable")
        x, y = x[by], y[by]
        starts = np.searchsorted(x, np.arange(len(cid) + 1))
        rank, n = np.full(len(cid), -1), 0
        for root in np.flatnonzero(large):
            if rank[root] >= 0:
                continue
            rank[root], front = n, [root]
            n += 1
            while front:
                near = np.unique(np.concatenate([y[starts[f] : starts[f + 1]] for f in front]))
                front = near[rank[near] < 0].tolist()
                rank[front] = np.arange(n, n + len(front))
                n += len(front)
        half = rank // (BLOCK // 2)
        i, j = a[keep], b[keep]
        swap = half[i] > half[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        block = half[i] * (1 << 32) + half[j]
        by = np.argsort(block, kind="stable")
        i, j, block = i[by], j[by], block[by]
        bounds = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
        for lo, hi in zip(bounds[:-1], bounds[1:]):  # of two halves, only what a pair in question names
            if half[i[lo]] == half[j[lo]]:
                put(np.unique(np.concatenate([i[lo:hi], j[lo:hi]])))
            else:
                put(np.unique(i[lo:hi]), np.unique(j[lo:hi]))
    return gid, sides, out


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: products of 0/1 matrices over the shingles both sides have.  ``right`` may be ``left`` itself;
    then the diagonal is not to be used."""
    ls, rs = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    lc, rc = np.concatenate(left), np.concatenate(right)
    if left is right:  # of a set with itself nothing is asked, so shingles that only one has don't matter
        found, counts = np.unique(lc, return_counts=True)
        common = found[counts > 1]
    else:
        common = np.intersect1d(np.unique(lc), np.unique(rc), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(common):
        return out.astype(np.int64)
    lrow, rrow = np.repeat(np.arange(len(left)), ls), np.repeat(np.arange(len(right)), rs)
    lcol, rcol = np.searchsorted(common, lc), np.searchsorted(common, rc)
    lok, rok = common[np.minimum(lcol, len(common) - 1)] == lc, common[np.minimum(rcol, len(common) - 1)] == rc
    lrow, lcol, rrow, rcol = lrow[lok], lcol[lok], rrow[rok], rcol[rok]
    step = 4096
    lo, ro = np.argsort(lcol, kind="stable"), np.argsort(rcol, kind="stable")
    lrow, lcol, rrow, rcol = lrow[lo], lcol[lo], rrow[ro], rcol[ro]
    for at in range(0, len(common), step):
        a0, a1 = np.searchsorted(lcol, [at, at + step])
        b0, b1 = np.searchsorted(rcol, [at, at + step])
        x, y = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        x[lrow[a0:a1], lcol[a0:a1] - at] = 1
        y[rrow[b0:b1], rcol[b0:b1] - at] = 1
        out += x @ y.T
    return np.rint(out).astype(np.int64)


def linked(left: list[np.ndarray], right: list[np.ndarray], numerator: int) -> np.ndarray:
    common = intersections(left, right)
    union = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None] - common
    return 100 * common >= numerator * union


def confirmed(width: int, numerator: int):
    """Groups (gid, side, cid, text): edges between classes that are linked by their full sets, a spanning forest of each group.
    With side 0 all pairs are compared, else those of sides 1 and 2.  A text that is not of its class (its doc_id repeats with
    other texts) is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for frame in runs_of(batches):
            a, b = [], []
            bounds = np.flatnonzero(np.diff(frame["gid"].to_numpy(), prepend=frame["gid"].iloc[0] - 1, append=frame["gid"].iloc[-1] + 1))
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                g = frame.iloc[lo:hi]
                sets = [shingle_set(t, width, memo) for t in g["text"]]
                right = np.array([class_id(s) == c for s, c in zip(sets, g["cid"])], bool)
                cid, side, sets = g["cid"].to_numpy()[right], g["side"].to_numpy()[right], [s for s, r in zip(sets, right) if r]
                one, two = (np.arange(len(cid)),) * 2 if not side.any() else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
                if not len(one) or not len(two):
                    continue
                left = [sets[k] for k in one]
                i, j = np.nonzero(linked(left, left if not side.any() else [sets[k] for k in two], numerator))
                i, j = one[i], two[j]
                apart_ = cid[i] != cid[j]
                _, made = roots(len(cid), zip(i[apart_].tolist(), j[apart_].tolist()))
                a += [int(cid[x]) for x, _ in made]
                b += [int(cid[y]) for _, y in made]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def spread_by(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key)


def near_groups(lists: DataFrame, sketches: DataFrame, least: float, numerator: int, hubs: bool = False) -> DataFrame:
    """Groups (gid, side, cid) of what is near by sketch in lists (lid, side, cid, comp)."""
    rows = spread_by(lists.join(sketches, "cid").select("lid", "side", "cid", "comp", "n", "sketch"), "lid")
    return stored(rows.mapInArrow(near_pairs(least, numerator, hubs), "gid long, side int, cid long").distinct(), "groups")


def confirm(groups: DataFrame, classes: DataFrame, source: DataFrame, width: int, numerator: int) -> DataFrame:
    """Edges (a, b) of groups (gid, side, cid), by full sets; only the texts that are needed are read out."""
    wanted = groups.select("cid").distinct().join(classes.select("cid", "doc_id"), "cid")
    texts = stored(source.where("doc_id IS NOT NULL").where(perhaps_among(wanted, "doc_id")("doc_id")).join(wanted, "doc_id").select("cid", "text"), "texts", compression="zstd")
    release(source.sparkSession)
    return stored(spread_by(groups.join(texts, "cid").select("gid", "side", "cid", "text"), "gid").mapInArrow(confirmed(width, numerator), "a long, b long"), "links")


@F.pandas_udf(T.DoubleType())
def likeness(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series((sketch_matrix(x) == sketch_matrix(y)).mean(1) if len(x) else [], dtype=float)


@F.pandas_udf(T.ArrayType(T.LongType()))
def children(node: pd.Series, sketch: pd.Series) -> pd.Series:
    """The nodes below: the node's key chooses BRANCHES other coordinates."""
    key, values = node.to_numpy(np.int64).astype(np.uint64), sketch_matrix(sketch)
    first = TREES * BRANCHES
    free, out = COORDINATES - first, []
    start = (key * MIX2 >> np.uint64(33)) % np.uint64(free)
    for b in range(BRANCHES):
        at = (first + (start + np.uint64(b) * np.uint64(37)) % np.uint64(free)).astype(np.int64)
        token = values[np.arange(len(key)), at].astype(np.uint64)
        out.append((((key ^ (token + np.uint64(1 + 256 * b)) * MIX) * MIX2) ^ (key >> np.uint64(23))).astype(np.int64))
    return pd.Series(list(np.stack(out, 1))) if len(key) else pd.Series([], dtype=object)


def chunked(rows: DataFrame, most: int) -> DataFrame:
    """rows (node, cid, size) as (lid, cid): nodes of over ``most`` in chunks of about that size that all hold the node's smallest."""
    rows = stored(rows, "sized")
    n = F.ceil(F.col("size") / (0.8 * most)).cast("long")
    part = F.when(F.col("size") <= most, F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("cid"), n))
    own = rows.select("node", part.alias("part"), "cid")
    large = rows.where(F.col("size") > most)
    pivots = large.groupBy("node").agg(F.min("cid").alias("cid"), F.max(n).alias("n")).select("node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("part"), "cid")
    return own.unionByName(pivots).distinct().select(F.xxhash64("node", "part").alias("lid"), "cid")


def apart(rows: DataFrame) -> DataFrame:
    """rows (node, cid, comp, ...): adds the node's size, without nodes of one component."""
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo < _hi").select("node", "size")
    return rows.join(sizes, "node")


def small_lists(rows: DataFrame) -> DataFrame:
    """Distinct lists of classes that meet in a small node."""
    met = rows.where(F.col("size") <= SMALL).groupBy("node").agg(F.sort_array(F.collect_set(F.struct("cid", "comp"))).alias("members"))
    return met.select("members")


def blocks_of(members: DataFrame, group: str, main: str, most: int) -> DataFrame:
    """members (group, main, cid, comp): lists (lid, side, cid, comp) of ``most`` or so that hold every class of another component
    than ``main`` against every class of the group."""
    half = 0.4 * most
    n = members.groupBy(group).agg(F.count(F.lit(1)).alias("size"), F.ceil(F.count(F.lit(1)) / half).cast("long").alias("chunks"), F.ceil(F.sum((F.col("comp") != F.col(main)).cast("long")) / half).cast("long").alias("parts")).where("parts > 0")
    d = members.join(n, group)
    small = d.where(F.col("size") <= most).select(F.xxhash64(group).alias("lid"), F.lit(0).alias("side"), "cid", "comp")
    d = d.where(F.col("size") > most)
    chunk, part, zero = F.pmod(F.xxhash64("cid"), F.col("chunks")), F.pmod(F.xxhash64("cid", F.lit(1)), F.col("parts")), F.lit(0).cast("long")
    mine = d.where(F.col("comp") != F.col(main)).withColumn("part", part).withColumn("chunk", F.explode(F.sequence(zero, F.col("chunks") - 1))).withColumn("side", F.lit(1))
    theirs = d.withColumn("chunk", chunk).withColumn("part", F.explode(F.sequence(zero, F.col("parts") - 1))).withColumn("side", F.lit(2))
    return mine.unionByName(theirs).select(F.xxhash64(group, "part", "chunk").alias("lid"), "side", "cid", "comp").unionByName(small)


def near_duplicates(docs: DataFrame, width: int = SHINGLE, numerator: int = NUMERATOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Two documents are linked if 100 * common >= numerator * union of their sets of distinct
    ``width``-word shingles (of fewer words: the whole sequence); component_id is the smallest
    doc_id that links reach.  Null and empty texts have an empty set, are linked with nothing
    and are their own component.  Rows that repeat a doc_id are one document as to links and
    each get a row; a null id never names a component (its component is that of equal texts, or
    null).  Very long texts are taken whole.  Other columns are ignored; an empty table gives no rows.
    """
    least, since = numerator / 100 - MARGIN, mark()
    sets = stored(documents_sets(docs, width, id_col, text_col), "sets")
    named = sets.where("cid IS NOT NULL AND doc_id IS NOT NULL")
    first = named.groupBy("cid").agg(F.min("doc_id").alias("doc_id"))
    classes = stored(named.join(first, ["cid", "doc_id"]).select("cid", "doc_id", F.col("n_shingles").alias("n"), "sketch", "nodes"), "classes")
    sketches = classes.select("cid", "n", "sketch")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    one = chunked(sized(classes.select("cid", F.col("nodes")[0].alias("node")).distinct()), SMALL)
    found = near_groups(one.select("lid", F.lit(0).alias("side"), "cid", F.col("cid").alias("comp")), sketches, least, numerator, hubs=True)
    found = chunked(sized(found.select(F.col("gid").alias("node"), "cid").distinct()), BLOCK)
    edges = confirm(found.select(F.col("lid").alias("gid"), F.lit(0).alias("side"), "cid"), classes, source, width, numerator)
    release(docs.sparkSession)
    known = components(edges).select(F.col("node").alias("cid"), "component")

    comp = F.coalesce("component", "cid").alias("comp")
    rows = classes.join(known, "cid", "left").select("cid", "n", comp, F.explode("nodes").alias("node")).distinct()
    rows = stored(apart(rows), "nodes")
    lists, balls = [small_lists(rows)], []
    # linked sets differ by less than one step of this ladder of sizes
    step = F.floor(F.log("n") / F.lit(float(np.log(100 / numerator)))).cast("long")
    rows = rows.where(F.col("size") > SMALL).select("cid", "comp", F.explode(F.array(F.xxhash64("node", step), F.xxhash64("node", step + 1))).alias("node")).distinct()
    rows = stored(apart(rows), "nodes")
    lists.append(small_lists(rows))
    rows = rows.where(F.col("size") > SMALL).join(sketches.drop("n"), "cid")
    for level in range(MOST_LEVELS):
        rows = stored(rows.select("node", "cid", "comp", "sketch"), "large")
        if rows.isEmpty():
            break
        pivots = rows.groupBy("node").agg(F.min(F.struct(F.xxhash64("cid").alias("h"), F.col("cid").alias("pivot"), F.col("comp").alias("pivot_comp"), F.col("sketch").alias("psketch"))).alias("p")).select("node", "p.pivot", "p.pivot_comp", "p.psketch")
        near = rows.join(pivots, "node").withColumn("like", likeness("sketch", "psketch")).drop("psketch")
        last = level == MOST_LEVELS - 1
        dense = near.groupBy("node").agg((F.avg((F.col("like") >= least).cast("int")) >= (0.0 if last else DENSE_SHARE)).alias("dense"))
        near = stored(near.join(dense, "node"), "pivots")
        balls.append(near.where(F.col("dense") & (F.lit(last) | (F.col("like") >= BALL_FROM))).select("pivot", "pivot_comp", "cid", "comp"))
        if last:
            break
        below = near.where(~F.col("dense") | (F.col("like") < REST_BELOW)).select("cid", "comp", "sketch", F.explode(children("node", "sketch")).alias("node")).distinct()
        below = stored(apart(below), "nodes")
        lists.append(small_lists(below))
        rows = below.where(F.col("size") > SMALL)

    met = lists[0]
    for more in lists[1:]:
        met = met.unionByName(more)
    met = met.distinct().select(F.xxhash64("members").alias("lid"), F.lit(0).alias("side"), F.explode("members").alias("m")).select("lid", "side", "m.cid", "m.comp")
    if balls:
        ball = balls[0]
        for more in balls[1:]:
            ball = ball.unionByName(more)
        met = met.unionByName(blocks_of(stored(ball.distinct(), "ball"), "pivot", "pivot_comp", SMALL))
    release(docs.sparkSession)
    edges = edges.unionByName(confirm(near_groups(met, sketches, least, numerator), classes, source, width, numerator))

    ids = classes.select("cid", "doc_id").distinct()
    shared = named.select("cid", "doc_id").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("a")).where("n > 1")
    same_id = named.select(F.col("cid").alias("b"), "doc_id").join(shared, "doc_id").select("a", "b").where("a <> b").distinct()
    found = components(edges.unionByName(same_id)).select(F.col("node").alias("cid"), "component")
    found = stored(found, "components")
    least_id = found.join(ids, "cid").groupBy("component").agg(F.min("doc_id").alias("least"))
    of_class = ids.join(found, "cid", "left").join(least_id, "component", "left").select("cid", F.coalesce("least", "doc_id").alias("least"))
    of_class = of_class.groupBy("cid").agg(F.min("least").alias("component_id"))
    out = sets.select("doc_id", "n_shingles", "cid").join(of_class, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return finished(out, "near-duplicates", since)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id),
classes AS (SELECT k, min(doc_id) AS rep FROM sets GROUP BY k),
cs AS (SELECT s.doc_id, g, n FROM s JOIN classes ON s.doc_id = classes.rep JOIN n ON n.doc_id = s.doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM cs a JOIN cs b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rep AS node, rep AS root FROM classes UNION SELECT sym.b, reach.root FROM reach JOIN sym ON sym.a = reach.node),
comp AS (SELECT node, min(root) AS c FROM reach GROUP BY node)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(comp.c, w.doc_id) AS component_id, w.doc_id = coalesce(comp.c, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN sets ON sets.doc_id = w.doc_id LEFT JOIN classes ON classes.k = sets.k LEFT JOIN comp ON comp.node = classes.rep
"""
