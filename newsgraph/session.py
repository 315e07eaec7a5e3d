"""Session construction and cluster-safe helpers."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # last duplicate key wins, as Python's json module does
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app: str = "newsgraph") -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    b = b.config("spark.driver.memory", os.environ.get("NEWSGRAPH_DRIVER_MEM", "16g"))
    # delete a checkpoint's files once nothing references it (long-running streams)
    b = b.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    for k, v in SESSION_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    if master and master.startswith("local["):  # one machine: a table is often one row group
        spark.conf.set("newsgraph.textPartitions", str(spark.sparkContext.defaultParallelism))
    configure(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``newsgraph`` importable in Python workers (pandas UDFs, applyInPandas).

    The package is zipped once per SparkContext and added with ``addPyFile``,
    the standard way to distribute code to every executor.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="newsgraph-code-"), "newsgraph.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings the operators rely on to an existing session."""
    for k, v in SESSION_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; a single-machine session without one gets a temporary folder."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="newsgraph-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this session's own on whatever storage it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint dir (survives executor loss).

    The frame is persisted while the checkpoint is written: without it Spark
    computes the plan twice (once for the job, once more to write the files).
    """
    from pyspark import StorageLevel
    ensure_checkpoint_dir(df.sparkSession)
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is run in here leaves no shuffle files: they go when its action ends, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def stored(df: DataFrame) -> DataFrame:
    """The frame written once as a table into the shared checkpoint dir and read back.

    For long tables: columns with dictionaries take a fraction of the rows that
    ``cut_lineage`` writes, a reader takes only the columns that it needs, and the
    shuffles that made the frame are dropped when it is written.
    The order of the rows and their partitions are not kept.
    """
    import uuid
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/newsgraph-stored-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Bits of a table of keys: 16 MB at most.
KEY_BITS = 1 << 27


def sharing_bits(rows: DataFrame, key: Column, ids: DataFrame, id_key: Column) -> DataFrame:
    """The rows whose 64-bit ``key`` is an ``id_key`` of ``ids``, and a few others that share a bit with one.

    Every task gets a bit table of the ids (``KEY_BITS``, whatever their number),
    so that rows without an id are left out before anything moves.
    """
    from pyspark.sql import functions as F
    bits = ids.select(F.pmod(id_key, F.lit(KEY_BITS)).alias("_h")).groupBy(F.bitmap_bucket_number("_h").alias("_part")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_h")).alias("_bits"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(bitmap_bit_position(_h) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(_h) % 8 as int))"))
    return rows.withColumn("_h", F.pmod(key, F.lit(KEY_BITS))).join(F.broadcast(bits), F.bitmap_bucket_number("_h") == F.col("_part")) \
        .where(bit != 0).select(*rows.columns)


# Rows of keys or of one number a key that go to every task.
FEW_ROWS = 1_000_000


def broadcast_few(df: DataFrame) -> DataFrame:
    """The frame, to be broadcast in a join if it has at most ``FEW_ROWS`` (narrow) rows: the other side then stays where it is."""
    from pyspark.sql import functions as F
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df


def cut_lineage_by(df: DataFrame, *cols: str) -> DataFrame:
    """Checkpoint dealt out by ``cols``, for joins and groups on them that do not shuffle it again.

    The frame that a checkpoint gives knows its partitioning only if the plan was
    not adaptive, since an adaptive plan has none before it has run.
    """
    spark, name = df.sparkSession, "spark.sql.adaptive.enabled"
    ensure_checkpoint_dir(spark)
    parts, was = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return df.repartition(parts, *cols).checkpoint(eager=True)
    finally:
        spark.conf.set(name, was)
