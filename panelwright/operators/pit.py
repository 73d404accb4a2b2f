"""Point-in-time reads: what was known at a date; effective-dated identifiers; upserts.

Every read takes a table of dates, so that many are answered in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in ``order`` (make it total)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def points_of(as_of: DataFrame) -> DataFrame:
    """One row: the dates of ``as_of`` (one column of that name) in order, an array ``_points``.  They are dates that somebody asks
    for, or those of a calendar: a few thousand at most, whatever the facts' size.  It is only ever joined where rows
    stay where they are; what is shuffled carries places in it."""
    return F.broadcast(as_of.agg(F.sort_array(F.collect_set("as_of")).alias("_points")))


def first_point(x: Column) -> Column:
    """The place in ``_points`` of the first date not before x (their number, if there is none), by bisection."""
    n = F.size("_points")
    whole = F.struct(F.lit(0).alias("lo"), n.alias("hi"))

    def half(s: Column, _: Column) -> Column:
        mid = F.floor((s.lo + s.hi) / 2).cast("int")
        before = (s.lo < s.hi) & (F.get("_points", mid) < x)
        return F.struct(F.when(before, mid + 1).otherwise(s.lo).alias("lo"), F.when(before | (s.lo >= s.hi), s.hi).otherwise(mid).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))
    return F.aggregate(steps, whole, half, lambda s: s.lo)


def dealt(df: DataFrame, as_of: DataFrame, when: str) -> DataFrame:
    """Each row once, with the place ``_t`` of the first date that sees it; rows that none sees are left out."""
    d = df.crossJoin(points_of(as_of)).withColumn("_t", first_point(F.col(when)))
    return d.where(F.col(when).isNotNull() & (F.col("_t") < F.size("_points"))).drop("_points")


def spread(df: DataFrame, as_of: DataFrame) -> DataFrame:
    """Rows that hold from the date at ``_t`` up to that before ``_until`` (NULL: for good), once for each of them (as_of)."""
    d = df.crossJoin(points_of(as_of))
    last = F.coalesce(F.col("_until"), F.size("_points")) - 1
    d = d.where(F.col("_t") <= last).withColumn("as_of", F.explode(F.slice("_points", F.col("_t") + 1, last - F.col("_t") + 1)))
    return d.drop("_points", "_t", "_until")


def read_bitemporal(facts: DataFrame, as_of: DataFrame, entity: str = "ticker", last_period_only: bool = True) -> DataFrame:
    """For each as_of, entity and field: the last revision known of each period, and of those the latest
    period (or all).

    Facts are dealt to the first date that sees them and reduced there to one row a group.  A sweep over a group's dates keeps the best row so
    far; it holds until the next date on which something was learned, and only then is it written out for the dates of that interval."""
    order = ["period_end", "observed_at", "value"]
    keys = [entity, "field"] + ([] if last_period_only else ["period_end"])
    rank = F.struct(*[F.col(f"_row.{c}") for c in order])
    d = dealt(facts, as_of, "observed_at").select(*keys, "_t", F.struct(*facts.columns).alias("_row"))
    d = d.groupBy(*keys, "_t").agg(F.max_by("_row", rank).alias("_row"))
    w = Window.partitionBy(*keys).orderBy("_t")
    best = F.max(F.struct(rank.alias("_order"), F.col("_row").alias("_best"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumns({"_so_far": best, "_until": F.lead("_t").over(w)})
    return spread(d.select("_t", "_until", "_so_far._best.*"), as_of).select("as_of", *facts.columns)


def last_value(df: DataFrame, as_of: DataFrame, entity: str, date: str, value: str) -> DataFrame:
    """as_of, entity, value of the last date not after as_of.

    One pass: rows are dealt to the first as_of that sees them and reduced there; each holds until the next."""
    d = dealt(df.select(entity, date, value), as_of, date)
    d = d.groupBy(entity, "_t").agg(F.max_by(value, date).alias(value), F.max(date).alias(date))
    d = d.withColumn("_until", F.lead("_t").over(Window.partitionBy(entity).orderBy("_t")))
    return spread(d, as_of).select("as_of", entity, value, date)


def last_rows(df: DataFrame, as_of: DataFrame, entity: str, date: str, n: int) -> DataFrame:
    """The last n rows of each entity up to each as_of: a row is among them from the first date that sees it until the one that sees the n-th after it."""
    w = Window.partitionBy(entity).orderBy(F.col(date).asc(), "_t")
    return spread(dealt(df, as_of, date).withColumn("_until", F.lead("_t", n).over(w)), as_of)


def average_of_last(df: DataFrame, as_of: DataFrame, entity: str, date: str, value: str, n: int) -> DataFrame:
    """Mean of the last n rows up to each as_of: taken at each row, of which the last that a date sees holds until the next such."""
    d = dealt(df.select(entity, date, value), as_of, date)
    w = Window.partitionBy(entity).orderBy(date)
    frame = w.rowsBetween(-(n - 1), 0)
    d = d.withColumns({f"avg_{value}": F.avg(value).over(frame), "n_rows": F.count(F.lit(1)).over(frame), "_until": F.lead("_t").over(w)})
    d = d.where(F.col("_until").isNull() | (F.col("_until") > F.col("_t")))
    return spread(d, as_of).select("as_of", entity, f"avg_{value}", "n_rows")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str], strict: bool = False, within_days: int | None = None) -> DataFrame:
    """Each left row with the values of the last right row at or before it (``strict``: before it).

    Union and carry: both sides are put in one order per key and the last seen right row is
    carried on; one shuffle, no pairs.  Equal right times: the largest values win."""
    tag = 0 if not strict else 2
    r = right.select(*by, F.col(right_on).alias("_t"), F.lit(1).alias("_side"), F.struct(F.col(right_on).alias("_rt"), *values).alias("_r"), F.lit(None).cast(left.select(F.struct("*").alias("s")).schema["s"].dataType).alias("_l"))
    l_ = left.select(*by, F.col(left_on).alias("_t"), F.lit(2 - tag).alias("_side"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.struct("*").alias("_l"))
    w = Window.partitionBy(*by).orderBy("_t", "_side", F.col("_r").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    d = l_.unionByName(r).withColumn("_last", F.last("_r", ignorenulls=True).over(w)).where(F.col("_l").isNotNull())
    if within_days is not None:
        d = d.withColumn("_last", F.when(F.datediff(F.col("_t"), F.col("_last._rt")) <= within_days, F.col("_last")))
    return d.select("_l.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def latest_within(df: DataFrame, entity: str, group: str, date: str, value: str, days: int = 90) -> DataFrame:
    """group, date, n, mean, std over the group's entities of their latest value within ``days`` before or on each date that has a row.

    A value counts from its date until the entity's next one or until ``days`` have passed: it is added on the one day and taken
    away on the other, and running sums over the days of a group give all statistics; no pairs are made.  Of several rows of an
    entity and day the largest value counts.  NaN and infinities are counted apart: they are in the statistics of the days that see them, no others."""
    one = df.where(F.col(value).isNotNull()).groupBy(entity, group, date).agg(F.max(value).cast("double").alias("_v"))
    gone = F.least(F.lead(date).over(Window.partitionBy(group, entity).orderBy(date)), F.date_add(date, days + 1))
    # values less their group's mean: sums of squares of small numbers
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    finite = ~F.isnan("_v") & (F.abs("_v") < inf)
    centre = one.groupBy(group).agg(F.coalesce(F.avg(F.when(finite, F.col("_v"))), F.lit(0.0)).alias("_c"))
    d = one.withColumn("_gone", gone).join(centre, group).withColumn("_x", F.when(finite, F.col("_v") - F.col("_c")).otherwise(0.0))
    parts = {"_k": F.lit(1), "_nan": F.isnan("_v").cast("int"), "_up": (F.col("_v") == inf).cast("int"), "_down": (F.col("_v") == -inf).cast("int"), "_s": F.col("_x"), "_q": F.col("_x") * F.col("_x")}
    move = lambda day, sign: F.struct(F.col(day).alias("_d"), *[(c * sign).alias(n) for n, c in parts.items()])
    moves = d.select(group, F.inline(F.array(move(date, 1), move("_gone", -1))))
    byday = moves.groupBy(group, "_d").agg(*[F.sum(n).alias(n) for n in parts])
    w = Window.partitionBy(group).orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)  # a row a day
    run = byday.select(group, F.col("_d").alias(date), *[F.sum(n).over(w).alias(n) for n in parts]).withColumnRenamed("_k", "n")
    var = F.greatest(F.col("_q") - F.col("_s") * F.col("_s") / F.col("n"), F.lit(0.0)) / (F.col("n") - 1)
    run = run.where("n > 0").join(centre, group)
    odd = F.col("_nan") + F.col("_up") + F.col("_down") > 0
    mean = F.when((F.col("_nan") > 0) | ((F.col("_up") > 0) & (F.col("_down") > 0)), nan).when(F.col("_up") > 0, inf).when(F.col("_down") > 0, -inf).otherwise(F.col("_s") / F.col("n") + F.col("_c"))
    return run.select(group, date, "n", mean.alias("mean"), F.when(F.col("n") > 1, F.when(odd, nan).otherwise(F.sqrt(var))).alias("std"))


def within_interval(dim: DataFrame, as_of: DataFrame) -> DataFrame:
    """Each row once for every as_of with valid_from <= as_of <= valid_to (open if NULL)."""
    seen = F.filter("_points", lambda x: (x >= F.col("valid_from")) & (F.col("valid_to").isNull() | (x <= F.col("valid_to"))))
    return dim.crossJoin(points_of(as_of)).withColumn("as_of", F.explode(seen)).drop("_points")


def identifier_at(dim: DataFrame, as_of: DataFrame, key: str = "ticker", value: str = "stable_id") -> DataFrame:
    """Effective-dated lookup: valid_from <= as_of <= valid_to (open if NULL), the latest valid_from wins."""
    return latest(within_interval(dim, as_of), ["as_of", key], [F.col("valid_from").desc(), F.col(value)]).select("as_of", key, value)


def active_at(dim: DataFrame, as_of: DataFrame) -> DataFrame:
    return within_interval(dim.where("is_active"), as_of).select("as_of", "ticker").distinct()


def terminal_price(events: DataFrame) -> DataFrame:
    """stable_id, terminal_price of the latest delisting."""
    return events.where("event_type = 'delisting'").groupBy("stable_id").agg(F.max_by("terminal_price", "event_date").alias("terminal_price"))


def identifier_history(dim: DataFrame, stable_ids: list[str] | None = None) -> DataFrame:
    """The identifiers in the order of time, of some or all securities."""
    d = dim.where(F.col("stable_id").isin(stable_ids)) if stable_ids else dim
    return d.orderBy("stable_id", "valid_from")


def first_after(periods: DataFrame, filings: DataFrame, entity: str = "ticker", days: int = 60) -> DataFrame:
    """For each period end the earliest 8-K filed within ``days``, else the earliest 10-Q or 10-K."""
    d = periods.join(filings, entity).where((F.col("filing_date") >= F.col("period_end")) & (F.datediff("filing_date", "period_end") <= days))
    d = d.withColumn("_p", F.when(F.col("form") == "8-K", 0).when(F.col("form").isin("10-Q", "10-K"), 1)).where("_p IS NOT NULL")
    return latest(d, [entity, "period_end"], ["_p", "filing_date", "form"]).drop("_p")


def survivors_missing(history: DataFrame, current: DataFrame, entity: str = "ticker", date: str = "date") -> DataFrame:
    """Entities of the past that are gone today, with the last date they were seen."""
    return history.join(current.select(entity).distinct(), entity, "left_anti").groupBy(entity).agg(F.max(date).alias("last_seen"))


def replay_universe(bars: DataFrame, rebalances: DataFrame, cap: str, entity: str = "ticker", date: str = "date", n: int = 100, least_rows: int = 20) -> DataFrame:
    """At each rebalance date (column as_of): the n largest by the last known ``cap``, with the mean money volume of the last
    20 rows."""
    from .cross import top_n

    price = last_value(bars, rebalances, entity, date, cap)
    adv = average_of_last(bars, rebalances, entity, date, "money", 20).where(F.col("n_rows") >= least_rows)
    return top_n(price.join(adv, ["as_of", entity]), cap, n, ["as_of"], entity)


# Upserts -----------------------------------------------------------------------------------


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str = "observed_at") -> DataFrame:
    """Rows of both by key, the new ones win; of several new rows the one with the latest ``order``."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [F.col("_new").desc(), F.col(order).desc_nulls_last()]).drop("_new")


def replace_groups(old: DataFrame, new: DataFrame, group: list[str]) -> DataFrame:
    """All rows of a group that the new table has are replaced."""
    return old.join(new.select(*group).distinct(), group, "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def apply_scores(texts: DataFrame, scores: DataFrame, key: str = "record_id") -> DataFrame:
    """Bulk update of sentiment scores: scored rows keep theirs unless a new one comes."""
    s = scores.select(key, F.col("score").alias("_s"))
    d = texts.join(s, key, "left")
    return d.withColumns({"scored": F.col("scored") | F.col("_s").isNotNull(), "sentiment_score": F.coalesce("_s", "sentiment_score")}).drop("_s")


def wide_to_long(df: DataFrame, ids: list[str], fields: list[str]) -> DataFrame:
    return df.unpivot(ids, fields, "field", "value").where("value IS NOT NULL")


def high_water(df: DataFrame, entity: str, date: str) -> DataFrame:
    """The last date of each entity and the day to go on from."""
    return df.groupBy(entity).agg(F.max(date).alias("last_date")).withColumn("next_start", F.date_add("last_date", 1))


def apply_ticker_changes(dim: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: stable_id, new_ticker, change_date.  Old rows end the day before, new ones are open."""
    rows = dim.select("stable_id", "ticker", "valid_from", "valid_to", "is_active").unionByName(changes.select("stable_id", F.col("new_ticker").alias("ticker"), F.col("change_date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_active")))
    nxt = F.lead("valid_from").over(Window.partitionBy("stable_id").orderBy("valid_from"))
    closed = F.least(F.coalesce("valid_to", F.lit("9999-12-31").cast("date")), F.date_sub(nxt, 1))
    return rows.withColumn("_next", nxt).withColumns({"valid_to": F.when(F.col("_next").isNull(), F.col("valid_to")).otherwise(closed), "is_active": F.col("is_active") & F.col("_next").isNull()}).drop("_next")


def close_delisted(dim: DataFrame, delistings: DataFrame) -> DataFrame:
    """delistings: stable_id, delisting_date."""
    d = dim.join(delistings, "stable_id", "left")
    gone = F.col("delisting_date").isNotNull() & (F.col("valid_from") <= F.col("delisting_date"))
    return d.withColumns({"valid_to": F.when(gone, F.coalesce("valid_to", "delisting_date")).otherwise(F.col("valid_to")), "is_active": F.col("is_active") & ~gone}).drop("delisting_date")


def flatten_facts(df: DataFrame, facts: str = "facts", entity: str = "ticker") -> DataFrame:
    """Nested filings (map taxonomy -> map concept -> map unit -> array of struct end, val, filed, form) to
    rows: of a concept's units USD, else the first in name order."""
    d = df.select(entity, F.explode(facts).alias("taxonomy", "concepts")).select(entity, "taxonomy", F.explode("concepts").alias("concept", "units"))
    names = F.array_sort(F.map_keys("units"))
    unit = F.when(F.map_contains_key("units", "USD"), "USD").otherwise(F.get(F.filter(names, lambda n: F.size(F.element_at(F.col("units"), n)) > 0), F.lit(0)))
    d = d.withColumn("unit", unit).where("unit IS NOT NULL")
    d = d.select(entity, "taxonomy", "concept", "unit", F.explode(F.element_at("units", F.col("unit"))).alias("x"))
    return d.select(entity, "taxonomy", "concept", "unit", F.col("x.end").alias("period_end"), F.col("x.val").alias("value"), F.col("x.filed").alias("observed_at"), F.col("x.form").alias("form"))


def flatten_filings(df: DataFrame, arrays: list[str], entity: str = "ticker", forms: list[str] | None = None) -> DataFrame:
    """Parallel arrays of a filing index to rows; the acceptance time is when it was known."""
    d = df.select(entity, F.explode(F.arrays_zip(*arrays)).alias("x")).select(entity, *[F.col(f"x.{a}").alias(a) for a in arrays])
    d = d.withColumn("observed_at", F.col("accepted").cast("timestamp")) if "accepted" in arrays else d
    return d.where(F.col("form").isin(forms)) if forms else d
