"""The pipeline over documents: filter, deduplicate, decontaminate, mix, shard.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame; all but the last give
the columns of documents.  What a stage returns is written and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossaflow.llm import decontamination, mixing, quality, sharding, simhash
from glossaflow.llm.common import cut, prepare, table

SHARDS = 24


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their language and source go."""
    prepare(spark)
    return quality.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays, that with the smallest number.

    Links are those of two bits over three-word shingles; most near copies below a similarity of about
    0.95 stay (README).
    """
    prepare(spark)
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontamination.drop_contaminated(docs, table(prepare(spark), sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says."""
    prepare(spark)
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with the shard and the slot that a uniform shuffle gives them."""
    prepare(spark)
    return sharding.shuffle_into(docs, SHARDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix_sources),
    ("sharding", shard),
]

#: Fingerprints and robust estimates are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
