"""Mixing sources to target weights: hierarchical budgets over a domain-language-source tree.

All in DataFrame functions.  Weights go down the tree as token budgets.  A child that cannot
fill its part is capped at what it has; what it lacks is dealt among its siblings by weight,
and only what the whole family lacks reaches the parent's siblings (a parent is capped at the
sum of its children first).  A leaf then takes a prefix of its tokens from epochs, each a
seeded order of its documents.

No task holds a leaf: a leaf's order is cut into buckets of hash ranges whose number follows
the leaf's size, only bucket totals are added up along the leaf, and documents are compared
with the leaf's cut, so texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

SEED = 17
#: Documents of a leaf that one bucket of its order holds, about.
BUCKET_DOCS = 512
#: The budget is this share of all tokens.
SHARE = 0.6
MAX_EPOCHS = 3
#: Parts that a leaf's documents are dealt to in a join with the leaves.
SALTS = 32
#: (domain, weight) of the query below; languages and sources weigh as LANG_WEIGHTS says and 1.
DOMAIN_WEIGHTS = {"web": 5, "forum": 3, "books": 2}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 2}
LEAF = ["domain", "lang", "source"]


def case(column: Column, values: dict, default) -> Column:
    out = F.when(F.lit(False), F.lit(default))
    for k, v in values.items():
        out = out.when(column == k, F.lit(v))
    return out.otherwise(F.lit(default))


def source_domain(source: Column) -> Column:
    """The first source is the web crawl, sources 1-9 are forums, all others books."""
    return F.when(source == "src0", "web").when(source.rlike("^src[1-9]$"), "forum").otherwise("books")


def count_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def order_key(epoch: Column, doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def deal(children: DataFrame, family: list[str], budget: str, weight: str, room: str, name: list[str]) -> DataFrame:
    """Adds ``given``: the family's budget dealt by weight, no child over its room.

    Children in the order of room / weight: one is full if, when it and all before it are full,
    the rest of the budget still gives it its room at the common level."""
    w = Window.partitionBy(*family).orderBy(F.col("_ratio"), *name) if family else Window.orderBy(F.col("_ratio"), *name)
    all_ = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(1))
    before, to_here = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    d = children.withColumn("_ratio", F.col(room).cast("double") / F.col(weight).cast("double"))
    d = d.withColumn("_used", F.coalesce(F.sum(room).over(before), F.lit(0))).withColumn("_left", F.sum(weight).over(all_) - F.coalesce(F.sum(weight).over(before), F.lit(0)))
    d = d.withColumn("_full", F.col(room) * F.col("_left") <= (F.col(budget) - F.col("_used")) * F.col(weight))
    d = d.withColumn("_spent", F.coalesce(F.sum(F.when(F.col("_full"), F.col(room))).over(all_), F.lit(0))).withColumn("_open", F.coalesce(F.sum(F.when(~F.col("_full"), F.col(weight))).over(all_), F.lit(0)))
    given = F.when(F.col("_full"), F.col(room)).otherwise(F.expr(f"(({budget} - _spent) * {weight}) div greatest(_open, 1)"))
    return d.withColumn("given", given.cast("long")).drop("_ratio", "_used", "_left", "_full", "_spent", "_open")


def leaf_budgets(leaves: DataFrame, share: float, max_epochs: int) -> DataFrame:
    """leaves: domain, lang, source, tokens, docs, w_domain, w_lang, w_source (whole weights of 1
    or more).  Adds ``budget`` in tokens."""
    percent = round(share * 1000)
    leaves = leaves.withColumn("room", F.col("tokens") * max_epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("room").alias("room"), F.max("w_lang").alias("w_lang"), F.max("w_domain").alias("w_domain"), F.sum("tokens").alias("tokens"))
    domains = langs.groupBy("domain").agg(F.sum("room").alias("room"), F.max("w_domain").alias("w_domain"), F.sum("tokens").alias("tokens"))
    total = Window.partitionBy(F.lit(1))
    domains = domains.withColumn("t", F.sum("tokens").over(total)).withColumn("r", F.sum("room").over(total)).withColumn("b", F.expr(f"least(t * {percent} div 1000, r)"))
    domains = deal(domains, [], "b", "w_domain", "room", ["domain"]).select("domain", F.col("given").alias("b"))
    langs = langs.alias("g").join(domains.alias("d"), F.expr("g.domain <=> d.domain")).select("g.*", "d.b")
    langs = deal(langs, ["domain"], "b", "w_lang", "room", ["lang"]).select("domain", "lang", F.col("given").alias("b"))
    k = leaves.alias("l").join(langs.alias("g"), F.expr("l.domain <=> g.domain AND l.lang <=> g.lang")).select("l.*", "g.b")
    return deal(k, ["domain", "lang"], "b", "w_source", "room", ["source"]).withColumnRenamed("given", "budget").drop("b", "room")


def join_leaves(rows: DataFrame, leaves: DataFrame, leaf: tuple[str, str, str] = ("_domain", "_lang", "_source")) -> DataFrame:
    """rows (domain, lang, source, doc_id, ...) with their leaf's row.  A leaf may hold a third of all rows: where the leaves are too
    many to be sent to all tasks, the rows of each are dealt to SALTS parts by their id."""
    salted = leaves.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = " AND ".join(f"{a} <=> {b}" for a, b in zip(LEAF, leaf))
    return rows.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, F.expr(f"{same} AND _part = _salt")).drop("_part", "_salt")


def mix(docs: DataFrame, domain: Column | None = None, w_domain: Column | None = None, w_lang: Column | None = None, w_source: Column | None = None, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(keys, cuts).  keys: one row per input row with doc_id, domain, lang, source, n_tokens; cuts:
    per leaf its budget, the number of whole epochs, and the cut (key, doc_id) in the last one.

    A document is taken in an epoch if it starts before the leaf's budget is used up; it is then
    taken whole.  Null domains, languages and sources are leaves of their own; null ids stand for one
    document; rows that repeat an id are taken together; null and empty texts have no tokens and
    are taken with what stands at their place in the order; very long texts are counted whole; other columns are ignored, whatever
    their names; an empty table gives empty results.
    """
    lang, source = F.col("lang"), F.col("source")
    keys = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), count_tokens(F.col(text_col)).alias("n_tokens"))
    keys = stored(keys.withColumn("domain", domain if domain is not None else source_domain(source)), "mix-keys")
    leaves = keys.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    leaves = leaves.withColumns({
        "w_domain": w_domain if w_domain is not None else case(F.col("domain"), DOMAIN_WEIGHTS, 1),
        "w_lang": w_lang if w_lang is not None else case(lang, LANG_WEIGHTS, 1),
        "w_source": w_source if w_source is not None else F.lit(1),
    })
    leaves = leaf_budgets(leaves, share, max_epochs)
    cut_in = leaves.select(*(F.col(c).alias(f"_{c}") for c in LEAF), "budget", "tokens", F.expr("if(tokens > 0, budget div tokens, 0)").alias("epochs"), F.expr("if(tokens > 0, budget % tokens, 0)").alias("rest"), F.greatest(F.lit(1), F.expr(f"docs div {BUCKET_DOCS}")).alias("n_buckets"))
    cut_in = stored(cut_in, "leaves")  # a row a leaf, of a size that the planner then knows
    o = join_leaves(keys, cut_in.where("rest > 0")).withColumn("key", order_key(F.col("epochs"), F.col("doc_id"), seed))
    o = o.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * F.col("n_buckets")).cast("long"))
    o = o.groupBy("_domain", "_lang", "_source", "rest", "bucket", "key", "doc_id").agg(F.sum("n_tokens").alias("n"))
    g = ["_domain", "_lang", "_source"]
    totals = o.groupBy(*g, "bucket").agg(F.sum("n").alias("bn"))
    along = Window.partitionBy(*g).orderBy("bucket")
    totals = totals.withColumn("before", F.sum("bn").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bn"))
    b = totals.select(*(F.col(c).alias(f"b{c}") for c in g), F.col("bucket").alias("b_bucket"), "before", "bn")
    last = o.join(b, F.expr("_domain <=> b_domain AND _lang <=> b_lang AND _source <=> b_source AND bucket = b_bucket")).where("before < rest AND rest <= before + bn")
    inner = Window.partitionBy(*g, "bucket").orderBy("key", F.col("doc_id").asc_nulls_first())
    at = F.col("before") + F.sum("n").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    taken = last.withColumn("at", at).where("at < rest").groupBy(*g).agg(F.max(F.struct("key", F.coalesce("doc_id", F.lit(-(1 << 62))).alias("id"))).alias("cut"))
    t = taken.select(*(F.col(c).alias(f"t{c}") for c in g), "cut")
    cuts = cut_in.join(t, F.expr("_domain <=> t_domain AND _lang <=> t_lang AND _source <=> t_source"), "left").select(*g, "budget", "tokens", "epochs", "cut")
    return keys, stored(cuts, "cuts")


def times_taken(cuts_epochs: str = "epochs", seed: int = SEED) -> Column:
    """How often a document of a leaf is taken: the whole epochs, and once more before the cut."""
    key = order_key(F.col(cuts_epochs), F.col("doc_id"), seed)
    me = F.struct(key.alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("id"))
    return F.col(cuts_epochs) + F.when(F.col("cut").isNotNull() & (me <= F.col("cut")), 1).otherwise(0)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its leaf, its tokens, the leaf's budget, and how often it is taken."""
    keys, cuts = mix(table(spark, sf_dir, "documents"))
    out = join_leaves(keys, cuts)
    return out.select("doc_id", "domain", "lang", "source", "n_tokens", F.col("budget").alias("leaf_budget"), times_taken().cast("long").alias("times"))


OP4_SQL = r"""
WITH k AS (
  SELECT doc_id, lang, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
         CASE WHEN source = 'src0' THEN 'web' WHEN regexp_matches(source, '^src[1-9]$') THEN 'forum' ELSE 'books' END AS domain
  FROM documents
), leaf AS (
  SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(3 * sum(n_tokens) AS BIGINT) AS room,
         CASE domain WHEN 'web' THEN 5 WHEN 'forum' THEN 3 ELSE 2 END AS wd, CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END AS wl, 1 AS ws
  FROM k GROUP BY ALL
), dom AS (SELECT domain, max(wd) AS w, CAST(sum(room) AS BIGINT) AS room, CAST(sum(tokens) AS BIGINT) AS tokens FROM leaf GROUP BY domain),
d0 AS (SELECT *, least(CAST(sum(tokens) OVER () AS BIGINT) * 600 // 1000, CAST(sum(room) OVER () AS BIGINT)) AS b FROM dom),
d1 AS (SELECT *, coalesce(sum(room) OVER o, 0) AS used, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS lft FROM d0
       WINDOW o AS (ORDER BY CAST(room AS DOUBLE) / CAST(w AS DOUBLE), domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d2 AS (SELECT *, room * lft <= (b - used) * w AS full_ FROM d1),
d3 AS (SELECT domain, CAST(CASE WHEN full_ THEN room ELSE CAST((b - coalesce(sum(room) FILTER (full_) OVER (), 0)) * w AS BIGINT) // CAST(greatest(sum(w) FILTER (NOT full_) OVER (), 1) AS BIGINT) END AS BIGINT) AS b FROM d2),
l0 AS (SELECT domain, lang, max(wl) AS w, CAST(sum(room) AS BIGINT) AS room FROM leaf GROUP BY domain, lang),
l1 AS (SELECT l0.*, d3.b, coalesce(sum(room) OVER o, 0) AS used, sum(w) OVER (PARTITION BY domain) - coalesce(sum(w) OVER o, 0) AS lft FROM l0 JOIN d3 USING (domain)
       WINDOW o AS (PARTITION BY domain ORDER BY CAST(room AS DOUBLE) / CAST(w AS DOUBLE), lang NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l2 AS (SELECT *, room * lft <= (b - used) * w AS full_ FROM l1),
l3 AS (SELECT domain, lang, CAST(CASE WHEN full_ THEN room ELSE CAST((b - coalesce(sum(room) FILTER (full_) OVER p, 0)) * w AS BIGINT) // CAST(greatest(sum(w) FILTER (NOT full_) OVER p, 1) AS BIGINT) END AS BIGINT) AS b FROM l2 WINDOW p AS (PARTITION BY domain)),
s1 AS (SELECT leaf.domain, leaf.lang, leaf.source, tokens, room, ws AS w, l3.b, coalesce(sum(room) OVER o, 0) AS used, sum(ws) OVER (PARTITION BY leaf.domain, leaf.lang) - coalesce(sum(ws) OVER o, 0) AS lft
       FROM leaf JOIN l3 ON leaf.domain = l3.domain AND leaf.lang IS NOT DISTINCT FROM l3.lang
       WINDOW o AS (PARTITION BY leaf.domain, leaf.lang ORDER BY CAST(room AS DOUBLE) / CAST(ws AS DOUBLE), leaf.source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s2 AS (SELECT *, room * lft <= (b - used) * w AS full_ FROM s1),
s3 AS (SELECT domain, lang, source, tokens, CAST(CASE WHEN full_ THEN room ELSE CAST((b - coalesce(sum(room) FILTER (full_) OVER p, 0)) * w AS BIGINT) // CAST(greatest(sum(w) FILTER (NOT full_) OVER p, 1) AS BIGINT) END AS BIGINT) AS budget FROM s2 WINDOW p AS (PARTITION BY domain, lang)),
e AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM s3),
o AS (SELECT k.*, e.budget, e.epochs, e.rest, md5('17:' || CAST(e.epochs AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
      FROM k JOIN e ON k.domain = e.domain AND k.lang IS NOT DISTINCT FROM e.lang AND k.source IS NOT DISTINCT FROM e.source),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
             - sum(n_tokens) OVER (PARTITION BY domain, lang, source, key, doc_id) AS before_ FROM o)
SELECT doc_id, domain, lang, source, n_tokens, budget AS leaf_budget, CAST(epochs + CASE WHEN before_ < rest THEN 1 ELSE 0 END AS BIGINT) AS times FROM c
"""
