"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgraph.llm.common import checkpoint


# A graph of at most so many edges is worked out in one task, without shuffles; counted in every round.
ONE_TASK = 200_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))")).first())


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges``: columns ``u``, ``v`` of one orderable type, any direction,
    repeats allowed.  Returns ``node``, ``root`` (roots map to themselves).
    Alternates the large-star and small-star steps until the edges are stars;
    each step is a map-side combined minimum and a join (a hot centre is one row
    on the minimum side, so AQE can split its other side).  Every round is
    checkpointed; only a row count and a checksum reach the driver.  At most
    ``one_task`` edges are one partition from then on.
    """
    edges = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    while (now := _state(edges)) != last:
        last = now
        edges = edges.coalesce(1) if now[0] <= one_task else edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = checkpoint(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                           .unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
