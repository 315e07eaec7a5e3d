"""Keyed state of a stream: hash buckets on shared storage, versioned by batch.

A batch reads and rewrites only the buckets that its keys fall into, so what it
moves follows the batch, not the state.  Layout under one folder::

    data/v=<batch>/bucket=<b>/*.parquet   a bucket as that batch left it
    manifest/v=<batch>/*.parquet          (bucket, version, mark, buckets) after that batch

Batch N starts from manifest N - 1 and writes version N, so a batch that is
replayed after a failure gives the same state.  What neither of the last two
manifests names is removed.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgraph.session import remove, shuffles_dropped

# One row of each manifest that names no bucket holds the mark of an empty state.
_NONE = -1


def _children(spark: SparkSession, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


class BucketState:
    """Rows of ``schema`` keyed by ``keys``, in ``n_buckets`` buckets (fixed for the life of the state)."""

    def __init__(self, spark: SparkSession, path: str, keys: Iterable[str], schema: str, n_buckets: int = 64):
        self.spark, self.path, self.keys, self.schema, self.n = spark, path.rstrip("/"), list(keys), schema, n_buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets that the rows' keys fall into: at most ``n_buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def dealt(self, rows: DataFrame, n: int) -> DataFrame:
        """The rows with their ``bucket``, dealt out by it to ``n`` tasks."""
        return rows.withColumn("bucket", self.bucket()).repartition(n, "bucket")

    def manifest(self, version: int) -> tuple[dict[int, int], int | None]:
        """Version of each bucket after batch ``version``, and the mark; nothing before the first batch."""
        if version < 0:
            return {}, None
        rows = self.spark.read.parquet(f"{self.path}/manifest/v={version}").collect()
        if any(r["buckets"] != self.n for r in rows):
            raise ValueError(f"the state has {rows[0]['buckets']} buckets, not {self.n}")
        return {r["bucket"]: r["version"] for r in rows if r["bucket"] != _NONE}, rows[0]["mark"]

    def read(self, version: int, touched: Iterable[int] | None = None) -> DataFrame:
        """The rows after batch ``version``: of all buckets, or of those named."""
        held, _ = self.manifest(version)
        some = sorted(held) if touched is None else sorted(set(held) & set(touched))
        if not some:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/data/v={held[b]}/bucket={b}" for b in some]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def write(self, batch_id: int, rows: DataFrame, touched: Iterable[int], mark: int | None = None) -> None:
        """State after batch ``batch_id``: ``rows`` are all that the touched buckets hold from now on.

        Rows that have a column ``bucket`` are dealt out by it already.
        """
        touched, data = set(touched), f"{self.path}/data/v={batch_id}"
        held, _ = self.manifest(batch_id - 1)
        remove(self.spark, data)  # a batch that failed halfway
        if touched:
            bucketed = rows if "bucket" in rows.columns else self.dealt(rows, len(touched))
            with shuffles_dropped(self.spark):
                bucketed.write.partitionBy("bucket").mode("overwrite").parquet(data)
        there = {int(c.split("=")[1]) for c in _children(self.spark, data) if c.startswith("bucket=")}
        now = {b: v for b, v in held.items() if b not in touched} | {b: batch_id for b in there}
        entries = [(b, v, mark, self.n) for b, v in sorted(now.items())] or [(_NONE, batch_id, mark, self.n)]
        self.spark.createDataFrame(entries, "bucket int, version long, mark long, buckets int").coalesce(1) \
            .write.mode("overwrite").parquet(f"{self.path}/manifest/v={batch_id}")
        self._sweep(batch_id, held, now)

    def _sweep(self, batch_id: int, held: dict[int, int], now: dict[int, int]) -> None:
        """Removes what only the manifest before the last two named, and that manifest."""
        if batch_id < 2 or f"v={batch_id - 2}" not in _children(self.spark, f"{self.path}/manifest"):
            return
        old, _ = self.manifest(batch_id - 2)
        live = set(held.items()) | set(now.items())
        for b, v in set(old.items()) - live:
            remove(self.spark, f"{self.path}/data/v={v}/bucket={b}")
        for v in {v for _, v in old.items()} - {v for _, v in live}:
            remove(self.spark, f"{self.path}/data/v={v}")
        remove(self.spark, f"{self.path}/manifest/v={batch_id - 2}")


def upsert(state: BucketState, rows: DataFrame, batch_id: int, merge, in_bucket: bool = False) -> DataFrame:
    """Merges a batch's rows (in the state's schema) into the buckets that they touch.

    ``merge`` re-aggregates previous and new rows by key; it must be associative.
    ``in_bucket``: it also takes the name of a column to group by besides the key;
    the rows are then dealt out once, by bucket, and merged and written where they are.
    Returns what the touched buckets hold afterwards.
    """
    touched = state.touched(rows)
    both = state.read(batch_id - 1, touched).unionByName(rows)
    merged = merge(state.dealt(both, len(touched)), "bucket") if in_bucket and touched else merge(both)
    state.write(batch_id, merged, touched)
    return state.read(batch_id, touched)
