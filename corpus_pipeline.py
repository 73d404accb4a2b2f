"""The corpus pipeline: quality, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import stored, table
from panelwright.llm.decontaminate import benchmark_tables, contaminated_only
from panelwright.llm.mixing import join_leaves, mix, source_domain, times_taken
from panelwright.llm.near_dups import near_duplicates
from panelwright.llm.quality import accepted_only, fit_quality
from panelwright.llm.token_files import token_output

#: Near-duplicates share this many percent of their distinct shingles of so many words.
SHINGLE, PERCENT = 5, 80
#: The mix takes this share of the tokens that came so far, each document once at most.
MIX_SHARE, MIX_EPOCHS = 0.8, 1

#: Its rows can't be told by SQL (a trained model, a tokenizer); tests hold them against plain Python.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, all columns as they are.  Null and empty texts are judged by the intercept, very long ones whole; null ids and
    repeated rows stay if their text does; an empty table stays empty."""
    return accepted_only(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near-duplicates (null ids last).  Rows are told apart by a key
    of their own, so rows that share an id, or have none, are judged by their texts like all others."""
    rows = stored(docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text", F.struct(*docs.columns).alias("_row")), "keyed", compression="zstd")
    groups = near_duplicates(rows, SHINGLE, PERCENT, id_col="key").select(F.col("doc_id").alias("key"), "component_id")
    own = rows.select("key", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("hash"), "key").alias("_o"))
    groups = stored(groups.join(own, "key").select("key", "component_id", "_o"), "groups")
    first = groups.groupBy("component_id").agg(F.min("_o").alias("_first"))
    dropped = groups.select("key").join(first.select(F.col("_first.key").alias("key")), "key", "left_anti")
    return rows.join(dropped, "key", "left_anti").select("_row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark.  Null and empty texts are clean, very long ones are searched whole; each row is judged by its
    text, whatever its id; with an empty benchmark all stay."""
    return contaminated_only(docs, benchmark_tables(table(spark, sf_dir, "benchmark")), keep=False)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the sources' budgets take.  Null languages and sources are leaves of their own; rows that repeat an id are taken together; texts
    without a token go with what stands at their place; an empty table stays empty."""
    _, cuts = mix(docs, share=MIX_SHARE, max_epochs=MIX_EPOCHS)
    rows = docs.select("doc_id", "lang", "source", source_domain(F.col("source")).alias("domain"), F.struct(*docs.columns).alias("_row"))
    return join_leaves(rows, cuts).where(times_taken() > 0).select("_row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files of what is left, read back: doc_id, start, n_tokens, ids_crc32.  Null and empty texts are the end id alone."""
    return token_output(docs)


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("mixing to target weights", mixing), ("token-ID output", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
