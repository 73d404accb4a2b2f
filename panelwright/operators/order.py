"""Order statistics of groups of any size: ranks, rank correlation, AUROC, average precision, quantiles.

``functions.ranks`` ranks in one window a key, which fits cross-sections.  Here a key may hold the whole table: rows are counted by
value, values are dealt to cells by the first 22 of their ordered bits, and what comes before a value is what comes before its cell and
what comes before it there.  A cell with too many values for one window is dealt anew by the next bits.  No window has more than 2^22
rows, however many a key has and however its values lie; ties are one row.  Results are those of the windows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import safe_corr
from ..sources import scratch

#: Values of a cell that one window orders, at most.
MOST_ROWS = 1 << 20


def ordered_bits(x: Column) -> Column:
    """A long in the order of doubles (both zeros alike, NaN last); NULL for NULL.

    Spark may evaluate the call for rows that a condition around it leaves out, so it never gets a NULL."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.coalesce(x.cast("double"), F.lit(0.0)) + F.lit(0.0)).cast("long")
    return F.when(x.isNull(), F.lit(None).cast("long")).when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def joined(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys meet; the right side's keys are left out."""
    r = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    test = F.lit(True)
    for c in on:
        test = test & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(r, test, how).drop(*[f"_r_{c}" for c in on])


def counted(df: DataFrame, x: str, keys: Sequence[str], **measures: Column) -> DataFrame:
    """keys, _o, _x, _c and the sums of the measures, a row for each value of a key; without nulls.  A table in the shared
    folder: it is read more than once."""
    d = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), *[c.alias(n) for n, c in measures.items()])
    d = d.groupBy(*keys, ordered_bits(F.col("_x")).alias("_o"))
    return scratch.stored(d.agg(F.min("_x").alias("_x"), F.count(F.lit(1)).alias("_c"), *[F.sum(n).alias(n) for n in measures]), "values")


def offsets(values: DataFrame, keys: Sequence[str], measures: Sequence[str] = ("_c",), most: int = MOST_ROWS, shift: int = 42) -> DataFrame:
    """values (keys, _o, measures), each value of a key once: adds for each measure its sum over the key's smaller values
    (_before<m>) and over all (_all<m>).

    ``shift``: the bits of _o that this level leaves to the next."""

    def run(d: DataFrame, node: str, inside: Sequence[str]) -> DataFrame:
        w = Window.partitionBy(*([F.col(c) for c in inside] or [F.lit(0)]))
        upto = w.orderBy(node).rowsBetween(Window.unboundedPreceding, -1)
        return d.withColumns({f"_before{m}": F.coalesce(F.sum(m).over(upto), F.lit(0)) for m in measures} | {f"_all{m}": F.sum(m).over(w) for m in measures})

    if not shift:
        return run(values, "_o", keys)  # 2^21 rows at most
    cell = f"_p{shift}"
    d = values.withColumn(cell, F.shiftright("_o", shift))
    cells = d.groupBy(*keys, cell).agg(*[F.sum(m).alias(m) for m in measures], F.count(F.lit(1)).alias("_rows"))
    crowded = cells.where(F.col("_rows") > most).limit(1).count()
    above = run(cells.drop("_rows"), cell, keys)  # 2^22 rows at most
    above = above.select(*keys, cell, *[F.col(f"_before{m}").alias(f"_top{m}") for m in measures], *[F.col(f"_all{m}").alias(f"_every{m}") for m in measures])
    inside = [*keys, cell]
    d = offsets(d, inside, measures, most, shift - 21) if crowded else run(d, "_o", inside)
    d = joined(d, above, inside)
    sums = {f"_before{m}": F.col(f"_before{m}") + F.col(f"_top{m}") for m in measures} | {f"_all{m}": F.col(f"_every{m}") for m in measures}
    return d.withColumns(sums).select(*values.columns, *sums)


def value_ranks(df: DataFrame, x: str, keys: Sequence[str], name: str) -> DataFrame:
    """keys, _o, name: each value's average rank from 1 inside its key."""
    d = offsets(counted(df, x, keys), keys)
    return d.select(*keys, "_o", (F.col("_before_c") + (F.col("_c") + 1) / 2.0).alias(name))


def with_rank(df: DataFrame, x: str, keys: Sequence[str], name: str) -> DataFrame:
    """Rows with the average rank of x inside their key; NULL for NULL."""
    ranks = value_ranks(df, x, keys, name)
    return joined(df.withColumn("_o", F.when(F.col(x).isNotNull(), ordered_bits(F.col(x)))), ranks, [*keys, "_o"], "left").drop("_o")


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str], name: str = "rho", least: int = 2) -> DataFrame:
    """keys, name, n: rank correlation by key over rows where both are known; NULL under ``least``."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, ordered_bits(F.col(x)).alias("_o"), ordered_bits(F.col(y)).alias("_q"), F.col(x).alias("_a"), F.col(y).alias("_b"))
    d = scratch.stored(d, "pairs")
    a, b = value_ranks(d, "_a", keys, "_ra"), value_ranks(d, "_b", keys, "_rb").withColumnRenamed("_o", "_q")
    d = joined(joined(d, a, [*keys, "_o"]), b, [*keys, "_q"])
    found = d.groupBy(*keys).agg(safe_corr("_ra", "_rb").alias(name), F.count(F.lit(1)).alias("n"))
    return found.withColumn(name, F.when(F.col("n") >= least, F.col(name)))


def auroc(df: DataFrame, label: str, score: str, keys: Sequence[str], name: str = "auroc") -> DataFrame:
    """Mann-Whitney with average ranks, from counts by value; NULL with one class only."""
    d = df.where(F.col(label).isNotNull())
    v = offsets(counted(d, score, keys, _pos=(F.col(label) == 1).cast("long")), keys)
    rank = F.col("_before_c") + (F.col("_c") + 1) / 2.0
    pos, all_ = F.sum("_pos"), F.sum("_c")
    g = v.groupBy(*keys).agg(F.sum(F.col("_pos") * rank).alias("_r"), pos.alias("n_pos"), (all_ - pos).alias("n_neg"))
    area = F.try_divide(F.col("_r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0, (F.col("n_pos") * F.col("n_neg")).cast("double"))
    return g.select(*keys, area.alias(name), "n_pos", "n_neg")


def average_precision(df: DataFrame, label: str, score: str, keys: Sequence[str], name: str = "auprc") -> DataFrame:
    """Sum over distinct scores, from the highest, of recall gained times precision."""
    d = df.where(F.col(label).isNotNull())
    v = offsets(counted(d, score, keys, _pos=(F.col(label) == 1).cast("long")), keys, ("_c", "_pos"))
    hits, seen = F.col("_all_pos") - F.col("_before_pos"), F.col("_all_c") - F.col("_before_c")
    return v.groupBy(*keys).agg(F.sum(F.try_divide(F.col("_pos") * hits, (seen * F.col("_all_pos")).cast("double"))).alias(name))


def quantiles(df: DataFrame, x: str, probabilities: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """keys and a column for each named probability: the interpolated quantile of the known values; one row without keys (NULLs
    if there is no value).  Exact: the two values beside each place are found by their offsets."""
    v = offsets(counted(df, x, keys), keys)
    places, found = {}, {}
    for name, p in probabilities.items():
        at = (F.col("_all_c") - 1) * F.lit(float(p))
        for side, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            found[f"_{side}_{name}"] = F.when((F.col("_before_c") <= place) & (place < F.col("_before_c") + F.col("_c")), F.col("_x"))
        places[name] = at - F.floor(at)
    hit = F.coalesce(*found.values()).isNotNull()
    g = v.where(hit).groupBy(*keys).agg(*[F.max(c).alias(n) for n, c in found.items()], *[F.max(c).alias(f"_at_{n}") for n, c in places.items()])
    between = lambda n: F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_at_{n}")
    exact = lambda n: F.when(F.col(f"_lo_{n}") == F.col(f"_hi_{n}"), F.col(f"_lo_{n}")).otherwise(between(n))
    return g.select(*keys, *[exact(n).alias(n) for n in probabilities])


def date_index(rows: DataFrame, by: Sequence[str], date: str) -> DataFrame:
    """by, date, _i: the dates of a group numbered from 1; a row a date."""
    return rows.select(*by, date).distinct().withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(date)))


def nodes_of_window(first: Column, end: Column, levels: int) -> Column:
    """The dyadic stretches (level, node) that make up the dates from ``first`` up to before ``end``: two a level, and those of the top."""
    found = []
    for k in range(levels + 1):
        a, e = F.ceil(first / float(1 << k)).cast("int"), F.floor(end / float(1 << k)).cast("int")
        level = F.lit(k).alias("level")
        if k < levels:
            found.append(F.array_compact(F.array(F.when((a < e) & (a % 2 == 1), F.struct(level, a.alias("node"))), F.when((a < e) & (e % 2 == 1), F.struct(level, (e - 1).alias("node"))))))
        else:
            found.append(F.when(a < e, F.transform(F.sequence(a, F.greatest(e - 1, a)), lambda n: F.struct(F.lit(levels).alias("level"), n.alias("node")))).otherwise(F.array().cast("array<struct<level:int,node:int>>")))
    return F.flatten(F.array(*found))


def sliding(rows: DataFrame, value: str, places: dict[str, Callable[[Column], Column]], dates: int, by: Sequence[str], date: str) -> DataFrame:
    """by, date, the named values, n_values, n_dates: order statistics of all values of the ``dates`` dates before each date.

    ``places``: from the number of values n to a place counted from 0.  A value is counted in the dyadic stretches of dates that hold its own
    (log2 of ``dates`` of them), and a window is put together from two stretches a level.  The place is found by counts of cells of the values'
    ordered bits: of the first 16 bits, then inside the cells that windows named, of the first 32, then among the values there.  No row is copied
    to the windows that see it."""
    levels = max(0, dates.bit_length() - 2)
    x = F.col(value).cast("double")
    counts = rows.groupBy(*by, date, F.when(x.isNotNull(), ordered_bits(x)).alias("_o")).agg(F.min(x).alias("_x"), F.count(F.lit(1)).alias("_c"))
    counts = scratch.stored(counts, "by-date")
    index = scratch.stored(date_index(counts, by, date), "dates")
    own = joined(counts.where(F.col("_o").isNotNull()), index, [*by, date])
    up = F.explode(F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("level"), F.floor(F.col("_i") / F.pow(F.lit(2.0), k)).cast("int").alias("node"))))
    in_nodes = lambda x: x.withColumn("_n", up).select("*", "_n.level", "_n.node").drop("_n", "_i")
    windows = index.select(*by, date, F.col("_i").alias("_t")).withColumn("_w", F.explode(nodes_of_window(F.greatest(F.col("_t") - dates, F.lit(1)), F.col("_t"), levels)))
    windows = scratch.stored(windows.select(*by, "_t", "_w.level", "_w.node"), "windows")
    totals = in_nodes(own.groupBy(*by, "_i").agg(F.sum("_c").alias("_c"))).groupBy(*by, "level", "node").agg(F.sum("_c").alias("n_values"), F.count(F.lit(1)).alias("n_dates"))
    sizes = scratch.stored(joined(windows, totals, [*by, "level", "node"]).groupBy(*by, "_t").agg(F.sum("n_values").alias("n_values"), F.sum("n_dates").alias("n_dates")), "sizes")
    each = F.array(*[F.struct(F.lit(n).alias("name"), f(F.col("n_values")).cast("long").alias("place")) for n, f in places.items()])
    sought = sizes.select(*by, "_t", F.inline(each))
    here: list[str] = []  # the cell that the last pass found
    for shift in (48, 32, 0):
        cells = own.withColumn("_cell", F.shiftright("_o", shift) if shift else F.col("_o"))
        if here:
            cells = cells.withColumn("_in", F.shiftright("_o", above))
            cells = joined(cells, sought.select(*by, "_in").distinct(), [*by, "_in"])
        held = in_nodes(cells.select(*by, *here, "_i", "_cell", "_c", "_x")).groupBy(*by, *here, "level", "node", "_cell").agg(F.sum("_c").alias("_c"), F.min("_x").alias("_x"))
        ask = joined(windows, sought.select(*by, "_t", *here).distinct(), [*by, "_t"]) if here else windows
        counts = joined(ask, held, [*by, *here, "level", "node"]).groupBy(*by, "_t", *here, "_cell").agg(F.sum("_c").alias("_c"), F.min("_x").alias("_x"))
        w = Window.partitionBy(*by, "_t", *here).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
        found = joined(sought.drop("_x"), counts, [*by, "_t", *here]).where((F.col("_before") <= F.col("place")) & (F.col("place") < F.col("_before") + F.col("_c")))
        sought = scratch.stored(found.select(*by, "_t", "name", (F.col("place") - F.col("_before")).alias("place"), F.col("_cell").alias("_in"), "_x"), "sought")
        here, above = ["_in"], shift
    wide = sought.groupBy(*by, "_t").agg(*[F.max(F.when(F.col("name") == n, F.col("_x"))).alias(n) for n in places])
    d = joined(joined(wide, sizes, [*by, "_t"]), index.select(*by, date, F.col("_i").alias("_t")), [*by, "_t"])
    return d.select(*by, date, *places, "n_values", "n_dates")


def bucket_by_edges(df: DataFrame, x: str, keys: Sequence[str], buckets: int, name: str = "bucket") -> DataFrame:
    """``functions.ranks.bucket_by_edges`` for large groups: quantile buckets from 0, right-closed, equal edges merged."""
    names = [f"_e{i}" for i in range(buckets + 1)]
    edges = quantiles(df, x, {n: i / buckets for i, n in enumerate(names)}, keys).select(*keys, F.array_distinct(F.array(*names)).alias("_edges"))
    d = joined(df, edges, keys, "left") if keys else df.join(edges, how="left")
    inner = F.slice(F.col("_edges"), 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    n = F.size(F.filter(inner, lambda e: e < F.col(x)))
    return d.withColumn(name, F.when(F.col(x).isNotNull() & (F.size("_edges") > 1), n)).drop("_edges")


__all__ = ["bucket_by_edges", "counted", "auroc", "average_precision", "joined", "offsets", "ordered_bits", "date_index", "quantiles", "sliding", "spearman", "value_ranks", "with_rank"]
