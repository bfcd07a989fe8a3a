"""The corpus pipeline: from documents to shards, one training-data operator a stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  Its result is
written as Parquet and read again as the next one's docs.  All stages but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from opsloom.llm import common, decontam, jaccard, langid, mixing, sharding


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles with a similarity of 0.8 the smallest doc_id stays."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontam.drop_contaminated(docs, common.benchmark(spark, sf_dir))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gets an equal share; copies are in a global random order."""
    return mixing.replicate(docs).drop("copy", "shuffle_key")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with the shard of the committed manifest that holds them."""
    out = sharding.shard_once(docs, common.new_path(spark, "shards"), target_bytes=128 << 20)
    return out.select("*", F.col("shard.id").alias("shard_id")).drop("shard")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("shards", shards),
]
#: The near-duplicate and language stages have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    stages = common.Stages(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stages.write(f"{k}-{name}", stage(spark, docs, sf_dir))
        if k:
            stages.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
