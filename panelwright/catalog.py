"""All registered queries of the panel library, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import queries_evaluation, queries_models, queries_panels, queries_series, queries_stores  # noqa: F401  (they register)
from .plans.registry import ORACLE_SQL, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["rank_ic_monthly"](spark, sf_dir)
