"""Knowledge graph kept as two tables (nodes, edges) and traversed with joins.

Snapshots hold only associative aggregates (max, min, sum, count), so an
incremental upsert is "union the previous snapshot with the new rows and
re-aggregate" and gives the same table as a full rebuild.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgraph.config import MAX_GRAPH_DEPTH
from newsgraph.session import cut_lineage, cut_lineage_by, stored
from newsgraph.streaming.state import BucketState, upsert

NODE_ATTRS = ("industry", "role", "country", "severity")
# Edges of one node that stay together in the trace.
HUB_EDGES = 100_000


def node_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def _node_rows(entities: DataFrame, ts_col: str) -> DataFrame:
    """Entity mentions in snapshot shape (one row = one mention)."""
    ts = F.col(ts_col)
    return entities.select(
        node_key(F.col("name")).alias("key"), "type", F.col("name").alias("name"),
        F.col("confidence").alias("confidence"), F.lit(1).cast("bigint").alias("mentions"),
        ts.alias("first_seen"), ts.alias("last_seen"),
        *[F.when(F.col(a).isNotNull(), F.struct(ts.alias("ts"), F.col(a).alias("v"))).alias(a)
          for a in NODE_ATTRS])


def _merge_nodes(rows: DataFrame, *more: str) -> DataFrame:
    return rows.groupBy(*more, "key", "type").agg(
        F.min("name").alias("name"), F.max("confidence").alias("confidence"),
        F.sum("mentions").alias("mentions"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"), *[F.max(a).alias(a) for a in NODE_ATTRS])


def upsert_nodes(entities: DataFrame, previous: DataFrame | None = None,
                 ts_col: str = "ts") -> DataFrame:
    """Nodes keyed (lower(name), type): best confidence, mention count, first/last
    seen, and each attribute's latest value (kept as (ts, value) so merges stay
    associative).  ``entities`` needs name, type, confidence, attributes, ``ts_col``.
    """
    rows = _node_rows(entities, ts_col)
    if previous is not None:
        rows = rows.unionByName(previous)
    return _merge_nodes(rows)


NODE_STATE = ("key string, type string, name string, confidence double, mentions long, first_seen timestamp, last_seen timestamp, "
              + ", ".join(f"{a} struct<ts:timestamp,v:string>" for a in NODE_ATTRS))
EDGE_STATE = "src string, action string, dst string, n long, sentiment_sum double, confidence double, first_article string, last_article string"


def node_state(spark: SparkSession, path: str, n_buckets: int = 64) -> BucketState:
    return BucketState(spark, path, ["key", "type"], NODE_STATE, n_buckets)


def edge_state(spark: SparkSession, path: str, n_buckets: int = 64) -> BucketState:
    return BucketState(spark, path, ["src", "action", "dst"], EDGE_STATE, n_buckets)


def upsert_nodes_incremental(state: BucketState, entities: DataFrame, batch_id: int, ts_col: str = "ts") -> DataFrame:
    """Merges the nodes of a batch into a stored snapshot, rewriting only the buckets that they touch.

    The batch is aggregated first, so a hot node is one row when it meets the
    snapshot.  Returns the touched part of the snapshot.
    """
    return upsert(state, stored(upsert_nodes(entities, ts_col=ts_col)), batch_id, _merge_nodes, in_bucket=True)


def upsert_edges_incremental(state: BucketState, relationships: DataFrame, batch_id: int) -> DataFrame:
    """Merges the edges of a batch into a stored snapshot, as ``upsert_nodes_incremental`` does for nodes."""
    return upsert(state, stored(upsert_edges(relationships)), batch_id, _merge_edges, in_bucket=True)


def node_view(nodes: DataFrame) -> DataFrame:
    """Nodes with plain attribute values."""
    return nodes.select("key", "type", "name", "confidence", "mentions", "first_seen", "last_seen",
                        *[F.col(f"{a}.v").alias(a) for a in NODE_ATTRS])


def upsert_edges(relationships: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Edges keyed (subject, ACTION, object): count, sentiment sum, best confidence,
    first/last article id.  The mean is sum/count at read time."""
    rows = relationships.select(
        node_key(F.col("subject.name")).alias("src"), F.upper("action").alias("action"),
        node_key(F.col("object.name")).alias("dst"), F.lit(1).cast("bigint").alias("n"),
        F.col("sentiment").alias("sentiment_sum"), F.col("confidence").alias("confidence"),
        F.col("article_id").alias("first_article"), F.col("article_id").alias("last_article"))
    if previous is not None:
        rows = rows.unionByName(previous)
    return _merge_edges(rows)


def _merge_edges(rows: DataFrame, *more: str) -> DataFrame:
    return rows.groupBy(*more, "src", "action", "dst").agg(
        F.sum("n").alias("n"), F.sum("sentiment_sum").alias("sentiment_sum"),
        F.max("confidence").alias("confidence"), F.min("first_article").alias("first_article"),
        F.max("last_article").alias("last_article"))


def edge_articles(relationships: DataFrame) -> DataFrame:
    """The articles of every edge as rows (src, action, dst, article_id): no list that grows with the edge."""
    return relationships.select(
        node_key(F.col("subject.name")).alias("src"), F.upper("action").alias("action"),
        node_key(F.col("object.name")).alias("dst"), "article_id").distinct()


def edge_view(edges: DataFrame) -> DataFrame:
    return edges.withColumn("sentiment_avg", F.col("sentiment_sum") / F.col("n"))


def _adjacency(edges: DataFrame, direction: str, hub_edges: int) -> tuple[DataFrame, DataFrame]:
    """Edges dealt out once by (src, salt), and (node, salts) of the hubs.

    A node of more than ``hub_edges`` edges is dealt over several salts, so that
    its edges are several keys.  The checkpoint keeps the partitioning, so the
    rounds shuffle their frontier only.
    """
    e = edges.select("src", "dst")
    if direction == "both":
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    e = cut_lineage(e.distinct())
    hubs = cut_lineage(e.groupBy("src").count().where(F.col("count") > hub_edges)
                       .select(F.col("src").alias("hub"), F.ceil(F.col("count") / hub_edges).cast("int").alias("salts")))
    salted = e.join(hubs, e.src == hubs.hub, "left").select(
        "src", F.coalesce(F.expr("pmod(xxhash64(dst), salts)"), F.lit(0)).cast("int").alias("salt"), "dst")
    return cut_lineage_by(salted, "src", "salt"), hubs


def trace_bits(seeds: DataFrame, edges: DataFrame, max_depth: int = MAX_GRAPH_DEPTH, direction: str = "forward",
               hub_edges: int = HUB_EDGES) -> tuple[DataFrame, DataFrame]:
    """``impact_trace`` in packed form: (seed, block, bit) and (node, block, bits, depth).

    Seeds are numbered, and 64 of them are one block: a bit of ``bits`` says that
    the seed with this (block, bit) reaches the node first at ``depth``.
    """
    ids = cut_lineage(seeds.select("seed").distinct())
    # the numbers of a checkpoint's rows are the same whenever it is read
    ids = ids.withColumn("_i", F.monotonically_increasing_id()).select(
        "seed", F.expr("_i div 64").alias("block"), (F.col("_i") % 64).cast("int").alias("bit"))
    e, hubs = _adjacency(edges, direction, hub_edges)
    flat = hubs.isEmpty()
    start = seeds.select("seed", "node").distinct().join(ids, "seed")
    frontier = cut_lineage(start.groupBy("node", "block").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")))
    reached = frontier.withColumn("depth", F.lit(0))
    for d in range(1, max_depth + 1):
        out = frontier.withColumn("salt", F.lit(0)) if flat else frontier.join(hubs, frontier.node == hubs.hub, "left").select(
            "node", "block", "bits", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
        step = out.join(e, (out.node == e.src) & (out.salt == e.salt)).groupBy(F.col("dst").alias("node"), "block") \
                  .agg(F.bit_or("bits").alias("bits"))
        seen = reached.groupBy("node", "block").agg(F.bit_or("bits").alias("seen"))
        new = step.join(seen, ["node", "block"], "left") \
                  .select("node", "block", F.expr("bits & ~coalesce(seen, 0L)").alias("bits")).where("bits <> 0")
        frontier = cut_lineage(new)
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier.withColumn("depth", F.lit(d)))
    return ids, reached


def set_bits(bits: str) -> Column:
    """The numbers of the bits that are set."""
    return F.expr(f"filter(sequence(0, 63), b -> (shiftright({bits}, b) & 1L) = 1L)")


def impact_trace(seeds: DataFrame, edges: DataFrame, max_depth: int = MAX_GRAPH_DEPTH,
                 direction: str = "forward", hub_edges: int = HUB_EDGES) -> DataFrame:
    """Nodes reachable from each seed within ``max_depth`` hops, with minimum depth.

    seeds(seed, node) -> (seed, node, depth); depth 0 is the seed itself.
    Breadth-first over bit sets: a frontier row is (node, 64 seeds), so what many
    seeds reach is one row for each block of them.  Each round joins the frontier
    with the edges, combines the bits by node on the map side, and keeps the bits
    that are new there, so every pair gets its first (= minimum) depth and no
    path is enumerated twice.  ``direction``: 'forward' follows subject -> object,
    'both' ignores direction.
    """
    ids, reached = trace_bits(seeds, edges, max_depth, direction, hub_edges)
    pairs = reached.select("node", "block", F.explode(set_bits("bits")).alias("bit"), "depth")
    return pairs.join(ids, ["block", "bit"]).select("seed", "node", "depth")


def node_stats(edges: DataFrame) -> DataFrame:
    """Per node: out/in edge counts, weights (mentions) and sentiment received/sent."""
    out = edges.groupBy(F.col("src").alias("key")).agg(
        F.count("*").alias("out_edges"), F.sum("n").alias("out_weight"),
        F.sum("sentiment_sum").alias("out_sentiment"))
    inn = edges.groupBy(F.col("dst").alias("key")).agg(
        F.count("*").alias("in_edges"), F.sum("n").alias("in_weight"),
        F.sum("sentiment_sum").alias("in_sentiment"))
    j = out.join(inn, "key", "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select("key", *[zero(c).alias(c) for c in
                             ("out_edges", "in_edges", "out_weight", "in_weight")],
                    F.coalesce("out_sentiment", F.lit(0.0)).alias("out_sentiment"),
                    F.coalesce("in_sentiment", F.lit(0.0)).alias("in_sentiment"))
