"""The corpus pipeline: toxicity, near duplicates, decontamination, mixing, sharding.

Each stage takes what its predecessor kept (read again from Parquet) and
returns the columns of `documents`; the last adds shard and slot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import free_name, scratch, table
from ledgerloom.llm.decontaminate import decontaminate
from ledgerloom.llm.mixing import mix
from ledgerloom.llm.near_text import keep_one, near_duplicates
from ledgerloom.llm.sharding import shuffle_to_shards
from ledgerloom.llm.toxicity import fit_sample, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold of their language."""
    model = fit_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity(docs, model).where(~F.col("toxic")).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest doc_id."""
    return keep_one(near_duplicates(docs)).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where(F.size("spans") == 0).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources come to their target weights."""
    return mix(docs).select("row", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies").cast("int")))).alias("_")).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in random order in shards of equal row counts; adds the struct `place` (shard, slot), or `place_` and so on where that name is taken."""
    return shuffle_to_shards(docs, scratch(spark, "shards")).select("row.*", F.struct("shard", "slot").alias(free_name(docs, "place")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The classifier and the random order are beyond SQL.  Tests hold near_dedup, decontamination, mixing and sharding
#: against brute-force versions, and toxicity against planted labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(path := scratch(spark, f"stage-{name}"))
        docs = spark.read.parquet(path)
    return docs
