"""Registering queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels
from ..sources import scratch, views
from .sqlparts import ar, corr, pr, r

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Views:
    """The panel views of one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return views.table(self.spark, self.sf_dir, name)

    bars = cached_property(lambda self: views.bars(self.spark, self.sf_dir))
    bench = cached_property(lambda self: views.bench(self.spark, self.sf_dir))
    mbars = cached_property(lambda self: views.mbars(self.spark, self.sf_dir))
    mbench = cached_property(lambda self: views.mbench(self.spark, self.sf_dir))
    sectors = cached_property(lambda self: views.sectors(self.spark, self.sf_dir))
    mpanel = cached_property(lambda self: views.mpanel(self.spark, self.sf_dir))
    ev = cached_property(lambda self: views.eval_rows(self.spark, self.sf_dir))
    ls = cached_property(lambda self: views.loss_rows(self.spark, self.sf_dir))
    # As tables in the shared folder, for queries whose steps read them more than once: a step starts anew from the given tables otherwise.
    kept_ev = cached_property(lambda self: scratch.stored(self.ev, "eval-rows"))
    kept_ls = cached_property(lambda self: scratch.stored(self.ls, "loss-rows"))
    market = cached_property(lambda self: views.market(self.spark, self.sf_dir))
    statements = cached_property(lambda self: views.statements(self.spark, self.sf_dir))
    events = cached_property(lambda self: views.pit_events(self.spark, self.sf_dir))

    labels = cached_property(lambda self: labels.forward_labels(self.bars, self.bench, [20, 60]))
    calendar = cached_property(lambda self: labels.sessions(self.bench))

    def folder(self, name: str) -> str:
        return scratch.folder(self.spark, name)

    def dates(self, *days: str) -> DataFrame:
        return self.spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("date").alias("as_of"))


def query(name: str, oracle: str | None = None):
    def put(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` decimals (sums depend on the order of rows in their last digits)."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


__all__ = ["ORACLE_SQL", "QUERIES", "Views", "ar", "corr", "pr", "query", "r", "rounded"]
