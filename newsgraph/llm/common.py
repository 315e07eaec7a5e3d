"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgraph.session import configure, cut_lineage

# Bytes of text that cross to a Python worker at a time; long texts travel in smaller batches.
ARROW_BYTES = 16 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on (also ships the package to the workers)."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's shared folder."""
    return cut_lineage(df)


def schema_of(df: DataFrame, *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in more)])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer form of it that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ordered_index(df: DataFrame, keys: list[Column], weight: str) -> tuple[DataFrame, int, int]:
    """Global row index and exclusive prefix sum of ``weight`` in the order of ``keys``.

    The rows are range-partitioned and sorted by ``keys`` (equal keys are dealt
    over partitions by a running number, so a hot key does not fill one task)
    and checkpointed, which fixes the partitions.  Only one (rows, weight) pair
    for each partition goes to the driver; every partition then numbers its own
    rows from the totals before it.  Adds ``row_index`` and ``prefix``; returns
    the frame, the number of rows and the total weight.
    """
    tie, part = "_tie", "_part"
    laid = checkpoint(
        df.withColumn(tie, F.monotonically_increasing_id())
        .repartitionByRange(*keys, F.col(tie)).sortWithinPartitions(*keys, tie)
        .drop(tie).withColumn(part, F.spark_partition_id()))
    totals = sorted(tuple(r) for r in laid.groupBy(part).agg(F.count(F.lit(1)), F.sum(weight)).collect())
    before, rows, total = {}, 0, 0
    for p, n, w in totals:
        before[p] = (rows, total)
        rows, total = rows + n, total + w

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            w = t.column(weight).to_numpy().astype(np.int64)
            if at is None:
                at = before[t.column(part)[0].as_py()]
            upto = np.cumsum(w)
            t = t.drop_columns([part]).append_column("row_index", pa.array(np.arange(b.num_rows) + at[0], pa.int64()))
            t = t.append_column("prefix", pa.array(upto - w + at[1], pa.int64()))
            at = (at[0] + b.num_rows, at[1] + int(upto[-1]))
            yield from t.combine_chunks().to_batches()

    out = laid.mapInArrow(number, schema_of(laid.drop(part), ("row_index", T.LongType()), ("prefix", T.LongType())))
    return out, rows, total


def _plain(df: DataFrame) -> bool:
    """Whether the frame is a table as it was read."""
    return df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in df.columns


def row_ids(df: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """Adds ``name``, an id of each row that stays the same whenever the frame is read.

    Rows of a Parquet table are known by file and position; any other frame is
    checkpointed with a running number.  ``columns``: those that are kept (default: all).
    """
    if columns is not None:
        return row_ids(df if _plain(df) else df.select(*columns), name).select(*columns, name)
    if _plain(df):
        return df.withColumn(name, F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")))
    return checkpoint(df.withColumn(name, F.struct(F.lit(0).cast("long").alias("f"), F.monotonically_increasing_id().alias("i"))))
