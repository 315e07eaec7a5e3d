"""Readers for the parquet tables the engine is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


# tables whose rows carry long text and get per-row CPU work (parsing, regexes)
TEXT_TABLES = ("documents", "pages", "conversations")
TEXT_PARTITIONS = "newsgraph.textPartitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; callers select columns so the scan's ReadSchema is pruned.

    Scans are split by ``spark.sql.files.maxPartitionBytes``.  A session whose
    text tables are single row groups can declare ``newsgraph.textPartitions``:
    text tables are then dealt over that many tasks, whatever their size.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    declared = spark.conf.get(TEXT_PARTITIONS, None) if name in TEXT_TABLES else None
    return df.repartition(int(declared)) if declared else df


class Tables:
    """Lazy accessor: ``Tables(spark, dir).orders`` -> DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return table(self.spark, self.sf_dir, name)
        raise AttributeError(name)
