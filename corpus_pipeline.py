"""From raw documents to balanced training shards, in five stages.

Each stage works on all that its predecessor kept, and is written as Parquet and
read again, in the shared folder of ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from newsgraph.llm import decontam, mixing, sharding, simhash, toxicity
from newsgraph.llm.common import read, ready
from newsgraph.session import ensure_checkpoint_dir, remove


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold."""
    ready(spark)
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: 4-word shingles, at most 4 differing bits."""
    ready(spark)
    return simhash.representatives(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out of the texts; clean documents stay as they are."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen to the target weights; one used in two epochs is there twice."""
    ready(spark)
    return mixing.mix(docs).select(*docs.columns)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    ready(spark)
    return sharding.shard(docs, carry=["doc_id"])


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("decontamination", cut_benchmark),
          ("mixing", mix_sources), ("sharding", cut_shards)]

# SimHash and the trained classifier are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; of the folders between them only the last is kept."""
    docs = read(spark, sf_dir, "documents")
    folder, last = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        path = f"{folder}/{name}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
