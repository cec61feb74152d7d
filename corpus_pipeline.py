"""From raw documents to sharded training data: quality rules, near-duplicates, benchmark leaks, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet to the folder that
the cluster shares and read again as the next stage's docs. All but the last return the columns of documents.

What holds for all stages: null texts and texts without words are documents of no words; null ids, sources and languages
are values of their own; repeated rows are rows of their own until near-duplicates; an empty table gives an empty result
with the same columns; texts are handled whole; further columns pass unchanged through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import decontaminate, mixing, near_dup, quality, sharding
from lodestar.llm.common import forget, saved


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep. Null and empty texts go: they have too few words."""
    return quality.rejected_removed(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id: five-word shingles, similarity 0.8 or more.

    Texts without words and rows without an id are in no group and stay; rows with one id stay or go together.
    """
    return near_dup.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, re-parameterised ones included. Null and empty texts hold none."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it, in the order of the curriculum."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document of the mix, along the Hilbert curve of source, language and size."""
    return sharding.assign_shards(docs)


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("benchmark leaks", benchmark_leaks), ("source mix", source_mix), ("shards", shards)]

#: Rolling hashes, similarity links and the Hilbert curve are not SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents after all stages but the last, as a table in the shared folder; the tables before it are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            forget(before)
        before = docs
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of the mix. A result reads tables of its own run alone, which stay until the shared folder is cleared."""
    return STAGES[-1][1](spark, mixed(spark, sf_dir), sf_dir)


def write(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Write the mix itself to path: documents with their shard and slot, a folder for each shard, in files by slot."""
    docs = mixed(spark, sf_dir)
    sharding.write_shards(sharding.assign_shards(docs, keep=docs.columns), path)
    forget(docs)
