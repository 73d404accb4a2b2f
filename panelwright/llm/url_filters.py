"""URL filters: a sort-merge range join of urls with nested host/path rules.

A host is turned round (``blog.example.org`` -> ``org,example,blog,``), so that a rule's host
is a prefix of the keys it covers: an interval.  Urls and rules are cut into the same key
ranges, a partition each, and sorted; one sweep over a range keeps a stack of the hosts whose rules are
open at the current key, which are nested.  A host's own rules are sorted by path, each with the
longest other one that it lies in, so those that cover a url are found by one binary search and
a walk outwards.  Every rule is copied into the ranges that its interval meets, so no range needs
another one's state, and a key that fills many ranges is dealt among them.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (layer, host, path, verdict): layer 0 wins over layer 1, then the longest rule wins.
CONTRACT_RULES = [
    (0, "org", "/", "allow"),
    (0, "example.org", "/es/", "block"),
    (0, "example.org", "/en/1", "block"),
    (0, "com", "/fr/", "allow"),
    (0, "com", "/de/", "block"),
]
#: Hosts this library itself blocks where no given rule fits.
HOUSE_RULES = [(1, f"{w}-example.{t}", "/", "block") for w in ("adult", "casino", "spam") for t in ("com", "net", "org")]
RULE_SCHEMA = "layer int, host string, path string, verdict string"
#: Keys drawn to place the range bounds; the sample's size does not grow with the input.
SAMPLE_KEYS = 20_000
HIGHEST = "\U0010ffff"


def split_url(url):
    """(host, path) columns: host after the first ``://`` up to ``/ ? #`` or the end, A-Z
    lower-cased; path from there up to ``? #`` or the end; both empty for null or no ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def host_key(host):
    """The reversed host: each label followed by a comma."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), ","), F.lit(","))


def key_bounds(keys: DataFrame, ranges: int) -> list[str]:
    """At most ``ranges - 1`` bounds, quantiles of a sample of fixed size, drawn by hash (repeats stay: they
    mark a key that fills several ranges).  The rows are counted first, so no task sends more than its share."""
    n, most = keys.count(), float(1 << 30)
    drawn = keys.where(F.pmod(F.xxhash64("salt", F.lit(7)), F.lit(1 << 30)) < most * min(1.0, 1.2 * SAMPLE_KEYS / max(n, 1))).select("key").limit(2 * SAMPLE_KEYS)
    found = sorted(r[0] for r in drawn.collect())
    return [found[len(found) * i // ranges] for i in range(1, ranges)] if found else []


class HostRules:
    """The rules of one host: (layer, path, host, verdict)."""

    def __init__(self, key: str) -> None:
        self.key, self.rules, self.paths = key, [], None

    def sort(self) -> None:
        best: dict[str, tuple] = {}
        for rule in self.rules:  # in (layer, host, path, verdict) order: the first of a path wins
            best.setdefault(rule[1], rule)
        self.paths = sorted(best)
        self.best, self.around = [best[p] for p in self.paths], []
        open_: list[int] = []
        for i, p in enumerate(self.paths):
            while open_ and not p.startswith(self.paths[open_[-1]]):
                open_.pop()
            self.around.append(open_[-1] if open_ else -1)
            open_.append(i)

    def covering(self, path: str) -> Iterator[tuple]:
        """The rules whose path the url's starts with, from the longest."""
        if self.paths is None:
            self.sort()
        i = bisect_right(self.paths, path) - 1
        while i >= 0:
            if path.startswith(self.paths[i]):
                yield self.best[i]
            i = self.around[i]


def sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (part, key, mark, id, host, path, layer, verdict) sorted by part, key, mark; rules
    (mark 0) stand before the urls (mark 1) that they cover."""
    part, stack = None, []
    for rows in frames:
        out = []
        for p, key, mark, i, host, path, layer, verdict in rows.itertuples(index=False, name=None):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if mark == 0:
                if not stack or stack[-1].key != key:
                    stack.append(HostRules(key))
                stack[-1].rules.append((layer, path, host, verdict))
                continue
            best = None
            for level in stack:
                for rule in level.covering(path):
                    rank = (-rule[0], len(rule[2]) + len(rule[1]))
                    if best is None or rank > best[0]:
                        best = (rank, rule)
            out.append((i, host, path, best and best[1][2] + best[1][1], best and best[1][3], best and best[1][0]))
        yield pd.DataFrame(out, columns=["id", "host", "path", "rule", "verdict", "layer"]).astype({"id": "Int64", "layer": "Int64"})


def judge_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """The rule and verdict of every url.

    ``rules``: layer, host, path, verdict.  A rule covers its host and all subdomains if the
    path starts with the rule's; the lowest layer wins, then the longest host + path (ties: the
    first in (layer, host, path, verdict) order).  Returns id, host, path, rule, verdict, layer;
    without a fitting rule, rule and layer are null and the verdict is ``default``.  Null urls
    and urls without ``://`` have an empty host and path and take the default; repeated rows and
    null ids stay, one result row each; very long urls are taken whole; other columns are ignored; rules
    with a null part never fit; empty tables give empty results.
    """
    spark = urls.sparkSession
    left = urls.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("u"))
    host, path = split_url(F.col("u"))
    left = left.select("id", host.alias("host"), path.alias("path"), F.xxhash64("id", "u").alias("salt")).withColumn("key", host_key(F.col("host")))
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = key_bounds(left, ranges)

    @F.pandas_udf("int")
    def part_of(key: pd.Series, salt: pd.Series) -> pd.Series:
        out = []
        for k, s in zip(key, salt):
            lo, hi = bisect_left(bounds, k), bisect_right(bounds, k)
            out.append(lo + s % (hi - lo + 1))
        return pd.Series(out, dtype="int32")

    @F.pandas_udf("array<int>")
    def parts_of(key: pd.Series) -> pd.Series:
        return pd.Series([list(range(bisect_left(bounds, k), bisect_right(bounds, k + HIGHEST) + 1)) for k in key])

    right = rules.select(F.col("layer").cast("int").alias("layer"), "host", "path", "verdict").dropna()
    right = right.withColumn("key", host_key(F.col("host"))).withColumn("part", F.explode(parts_of("key")))
    rows = right.select("part", "key", F.lit(0).alias("mark"), F.lit(None).cast("long").alias("id"), "host", "path", "layer", "verdict").unionByName(
        left.withColumn("part", part_of("key", "salt")).select("part", "key", F.lit(1).alias("mark"), "id", "host", "path", F.lit(None).cast("int").alias("layer"), F.lit(None).cast("string").alias("verdict"))
    )
    swept = rows.repartitionById(ranges, "part").sortWithinPartitions("part", "key", "mark", "layer", "host", "path", "verdict").mapInPandas(sweep, "id long, host string, path string, rule string, verdict string, layer int")
    return swept.select("id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"), "layer")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(CONTRACT_RULES + HOUSE_RULES, RULE_SCHEMA)
    found = judge_urls(table(spark, sf_dir, "pages"), rules)
    return found.select(F.col("id").alias("page_id"), "host", "path", F.when(F.col("layer") == 0, F.col("rule")).alias("rule"), "verdict")


OP5_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), judged AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches('.' || host, '\.(adult|casino|spam)-example\.(com|net|org)$') AND starts_with(path, '/') THEN 'block'
    ELSE 'allow' END AS verdict
FROM judged
"""
