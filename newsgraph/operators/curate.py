"""Curation: user interests, graph matching, vector matching and ranked feeds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from newsgraph.config import FEED_TTL_HOURS, MAX_GRAPH_DEPTH
from newsgraph.operators.graph import impact_trace, node_key, set_bits, trace_bits
from newsgraph.operators.vectors import MAX_CELLS, NO_CELL, assign, best_in_groups, centroids, own_type, unit_rows, vector_column
from newsgraph.session import broadcast_few, cut_lineage, stored

# Fixed values (ours): relevance weights and feed length
GRAPH_WEIGHT, VECTOR_WEIGHT = 0.7, 0.3
FEED_SIZE = 20
REASON_PREFIX = "Follows "
# (follow, node) pairs that one task makes at a time
CELL_PAIRS = 1_000_000
TYPE_WEIGHTS = {"purchase": 3.0, "signup": 2.0, "error": 0.5}


def interests(interactions: DataFrame, type_weights: dict[str, float] | None = None) -> DataFrame:
    """(user_id, name, weight) from interaction rows (user_id, name, event_type, value).

    Every interaction counts, by its value times the weight of its type (1 if none is named).
    """
    w = F.lit(1.0)
    for kind, x in (TYPE_WEIGHTS if type_weights is None else type_weights).items():
        w = F.when(F.col("event_type") == kind, x).otherwise(w)
    return interactions.groupBy("user_id", "name").agg(F.sum(F.col("value") * w).alias("weight"))


def _blocks(pairs: int, follows: int, reached: int) -> tuple[int, int]:
    """Into how many parts users and nodes are cut: cells of about ``CELL_PAIRS`` pairs, the fewest copied rows."""
    cells = max(1, -(-pairs // CELL_PAIRS))
    nodes = min(cells, max(1, round(math.sqrt(cells * reached / max(1, follows)))))
    return -(-cells // nodes), nodes


def _match(follows: pa.Table, reach: pa.Table) -> pa.Table:
    """Pairs of the users and nodes of one cell: (user_id, node, graph_depth, match_reasons, *node attributes)."""
    user, node = (t.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for t, c in ((follows, "user_id"), (reach, "node")))
    why = pc.binary_join_element_wise(REASON_PREFIX, follows.column("name"), "").combine_chunks().dictionary_encode()
    words = sorted(range(len(why.dictionary)), key=lambda k: why.dictionary[k].as_py().encode())
    rank = np.empty(len(words), np.int64)
    rank[words] = np.arange(len(words))
    by_seed = np.argsort(reach.column("seed").to_numpy(), kind="stable")
    seeds = reach.column("seed").to_numpy()[by_seed]
    mine = follows.column("seed").to_numpy()
    lo, hi = np.searchsorted(seeds, mine), np.searchsorted(seeds, mine, side="right")
    n = hi - lo
    f = np.repeat(np.arange(len(mine)), n)
    r = by_seed[np.arange(len(f)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
    u, at = user.indices.to_numpy().astype(np.int64)[f], node.indices.to_numpy().astype(np.int64)[r]
    depth, w = reach.column("depth").to_numpy()[r], rank[why.indices.to_numpy()[f]]
    pair = u * max(1, len(node.dictionary)) + at
    order = np.lexsort((w, pair))
    pair, w, r = pair[order], w[order], r[order]
    new = np.concatenate(([True], pair[1:] != pair[:-1]))[:len(pair)]
    start = np.flatnonzero(new)
    once = new | np.concatenate(([True], w[1:] != w[:-1]))[:len(pair)]
    offsets = np.concatenate((np.cumsum(once)[start] - 1, [once.sum()])).astype(np.int32)
    reasons = why.dictionary.take(pa.array(np.array(words, np.int64)[w[once]]))
    first = pa.array(r[start])
    return pa.table({"user_id": user.dictionary.take(pa.array(u[order][start])), "node": node.dictionary.take(pa.array(at[order][start])),
                     "graph_depth": pa.array(np.minimum.reduceat(depth[order], start) if len(start) else depth[:0], pa.int32()),
                     "match_reasons": pa.ListArray.from_arrays(pa.array(offsets), reasons),
                     **{c: reach.column(c).take(first) for c in reach.column_names if c not in ("ub", "nb", "seed", "node", "depth")}})


def matched_nodes(user_interests: DataFrame, edges: DataFrame, max_depth: int = MAX_GRAPH_DEPTH, about: DataFrame | None = None) -> DataFrame:
    """Graph matches in factored form: (user_id, node, graph_depth, match_reasons).

    A user's articles are those that name one of the nodes; users and articles
    meet only where a feed expands them.  The trace runs once per followed entity.
    The pairs are the result and many times either side: they are made in cells
    of some users by some nodes, so follows and reached nodes are shuffled and
    no pair is.  ``about``: (node, ...), one row a node, joined to the nodes
    before they meet the users; its columns come with the pairs.
    """
    ui = cut_lineage(user_interests.select("user_id", "name", node_key(F.col("name")).alias("_s")).where("_s is not null"))
    ids = cut_lineage(ui.select(F.col("_s").alias("seed"), F.col("_s").alias("node")).distinct())
    numbered = ids.select(F.col("seed").alias("_s"), F.monotonically_increasing_id().alias("seed"))  # a checkpoint keeps its order
    reach = impact_trace(ids, edges, max_depth).withColumnRenamed("seed", "_s").join(numbered, "_s").drop("_s")
    reach = cut_lineage(reach if about is None else reach.join(about, "node", "left"))
    ui = ui.join(numbered.withColumnRenamed("seed", "_n"), "_s").select("user_id", "name", F.col("_n").cast("long").alias("seed"))
    of = reach.groupBy(F.col("seed").alias("_r")).agg(F.count(F.lit(1)).alias("r"))
    per = ui.groupBy(F.col("seed").alias("_f")).agg(F.count(F.lit(1)).alias("f")).join(of, F.col("_f") == F.col("_r"))
    size = per.agg(F.sum(F.col("f") * F.col("r")), F.sum("f"), F.sum("r")).first()
    users, nodes = _blocks(*(int(x or 0) for x in size))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = ui.select("*", part("user_id", users).alias("ub"), every(nodes).alias("nb"))
    right = reach.select("*", every(users).alias("ub")).withColumn("nb", part("node", nodes))
    more = "".join(f", {c} {t}" for c, t in reach.dtypes if c not in ("node", "depth", "seed"))
    return left.groupBy("ub", "nb").cogroup(right.groupBy("ub", "nb")).applyInArrow(
        _match, f"user_id {dict(ui.dtypes)['user_id']}, node string, graph_depth int, match_reasons array<string>{more}")


def _cosine_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    """Row-wise cosine of two vector columns for one Arrow batch (numpy, float64)."""
    out = np.full(len(a), np.nan)
    ok = a.notna().to_numpy() & b.notna().to_numpy()
    if ok.any():
        am = np.stack(a[ok].to_numpy()).astype(np.float64)
        bm = np.stack(b[ok].to_numpy()).astype(np.float64)
        den = np.linalg.norm(am, axis=1) * np.linalg.norm(bm, axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            out[ok] = np.einsum("ij,ij->i", am, bm) / den
    return pd.Series(out)


_cosine_udf = F.pandas_udf(_cosine_batch, DoubleType())


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two numeric arrays in DOUBLE.

    Spark has no built-in vector similarity; element-wise lambdas (zip_with +
    aggregate) run interpreted per element, so this is an Arrow-batched pandas
    UDF doing one numpy product per batch.  NULL when either vector is NULL.
    """
    return _cosine_udf(a, b)


def relevance(depth: Column, cos: Column) -> Column:
    """Score in [0, 1]: 0.7/(1+depth) + 0.3*max(0, cosine), rounded to 6 places."""
    return F.round(F.lit(GRAPH_WEIGHT) / (1 + depth)
                   + F.lit(VECTOR_WEIGHT) * F.greatest(F.lit(0.0), F.coalesce(cos, F.lit(0.0))), 6)


def user_feed(matches: DataFrame, user_vectors: DataFrame | None = None,
              article_vectors: DataFrame | None = None, n: int = FEED_SIZE,
              as_of: Column | None = None) -> DataFrame:
    """Top-``n`` articles per user by relevance (ties: article_id).

    Cosine is computed only for graph-matched (user, article) pairs, so no
    all-pairs product is formed.
    """
    m = matches
    if user_vectors is not None and article_vectors is not None:
        # articles first: only ids travel to them, and the ranking reuses the partitioning by user
        m = m.join(article_vectors.select("article_id", F.col("vec").alias("avec")), "article_id", "left") \
             .join(user_vectors.select("user_id", F.col("vec").alias("uvec")), "user_id", "left")
        cos = cosine(F.col("uvec"), F.col("avec"))
    else:
        cos = F.lit(None).cast("double")
    m = m.withColumn("relevance_score", relevance(F.col("graph_depth"), cos))
    w = Window.partitionBy("user_id").orderBy(F.desc("relevance_score"), F.asc("article_id"))
    ranked = m.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    ts = as_of if as_of is not None else F.current_timestamp()
    return ranked.select(F.col("user_id").cast("string").alias("user_id"), "article_id",
                         "relevance_score", "match_reasons", "graph_depth", ts.alias("timestamp"), "rank")


def _depth0_reads(served: DataFrame, article_entities: DataFrame, user_vectors: DataFrame, article_vectors: DataFrame, n: int) -> tuple:
    """What the depth-0 feed of each user has to score.

    Returns (user_id, node, cell, n_articles, bound, first), (node, iid, cell,
    angle), the articles' cells with vectors, and the users' vectors.
    """
    seeds = cut_lineage(served.select(F.col("seed").alias("node")).distinct())
    followed = stored(article_entities.join(broadcast_few(seeds), "node", "left_semi"))
    size = followed.agg((F.count(F.lit(1)) / F.greatest(F.lit(1), F.countDistinct("node"))).alias("a")).first()["a"] or 0
    # vectors of articles that are in no list stay where they are
    arts = article_vectors.select(F.col("article_id").alias("iid"), "vec").join(
        followed.select(F.col("article_id").alias("iid")).distinct(), "iid", "left_semi")
    cents = centroids(arts, max(1, min(MAX_CELLS, math.isqrt(int(size)))))
    placed = cut_lineage(assign(arts, cents)) if len(cents) else arts.limit(0).selectExpr("iid", "0 as cell", "0D as angle", "cast(vec as array<double>) vec")
    lists = cut_lineage(followed.join(placed.select(F.col("iid").alias("article_id"), "cell", "angle"), "article_id", "left")
                        .select("node", F.col("article_id").alias("iid"), F.coalesce("cell", F.lit(NO_CELL)).alias("cell"), F.coalesce("angle", F.lit(0.0)).alias("angle")))
    cells = lists.groupBy("node", "cell").agg(F.count(F.lit(1)).alias("n_articles"), F.max("angle").alias("radius"))

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, u = unit_rows(b.column(1))
            at, u = (at, u) if len(cents) else (at[:0], u[:0])
            to = np.arccos(np.clip(u @ cents.T, -1.0, 1.0)) if len(at) else u
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), vector_column(to, at, b.num_rows)], ["user_id", "uvec", "to"])

    own = own_type(user_vectors.select(F.col("user_id").alias("iid"), "vec"))
    kinds = dict(own.dtypes)
    users = cut_lineage(own.mapInArrow(angles, f"user_id {kinds['iid']}, uvec {kinds['vec']}, to array<double>"))
    pairs = served.select("user_id", F.col("seed").alias("node")).distinct().join(users.select("user_id", "to"), "user_id", "left").join(cells, "node")
    # no article of the cell has a larger cosine (triangle inequality on angles)
    cos = F.when(F.col("to").isNull() | (F.col("cell") == NO_CELL), 0.0).otherwise(
        F.cos(F.greatest(F.lit(0.0), F.get("to", F.col("cell")) - F.col("radius") - 1e-7)) + 1e-5)
    asked = pairs.select("user_id", "node", "cell", "n_articles", (F.lit(GRAPH_WEIGHT) + VECTOR_WEIGHT * F.greatest(F.lit(0.0), cos)).alias("bound"))
    # an article may be in several lists, so the first reads hold more than n
    best = Window.partitionBy("user_id").orderBy(F.desc("bound"), "node", "cell").rowsBetween(Window.unboundedPreceding, -1)
    asked = stored(asked.withColumn("first", F.coalesce(F.sum("n_articles").over(best), F.lit(0)) < 3 * n))
    return asked, lists, placed, users


def nearest_articles(served: DataFrame, article_entities: DataFrame, user_vectors: DataFrame, article_vectors: DataFrame,
                     n: int) -> tuple[DataFrame, DataFrame]:
    """The ``n`` best depth-0 articles of every user: (user_id, article_id, relevance_score), and what was read.

    ``served``: (user_id, seed); ``article_entities``: (article_id, node).  The
    articles of an entity are a list cut into cells of near vectors, each with an
    upper bound of the score that a user can find in it.  A user first reads the
    cells of the highest bounds that hold 3 n articles; the n-th score found is a
    threshold, and only cells whose bound reaches it are read besides.  A cell is
    scored for its users as one matrix product, entity by entity.  The second
    frame has (user_id, node, cell, n_articles, bound, first, read).
    """
    asked, lists, placed, users = _depth0_reads(served, article_entities, user_vectors, article_vectors, n)
    wide = lists.join(placed.select("iid", "vec"), "iid", "left").select("node", "iid", "cell", "vec")

    def score(cos: np.ndarray) -> np.ndarray:
        return np.round(GRAPH_WEIGHT + VECTOR_WEIGHT * np.maximum(0.0, np.nan_to_num(cos, nan=0.0)), 6)

    def scored(reads: DataFrame) -> DataFrame:
        some = reads.groupBy("user_id", "node", "tau").agg(F.collect_list("cell").alias("cells")) \
            .join(users, "user_id", "left").select("node", F.col("user_id").alias("qid"), F.col("uvec").alias("vec"), "cells", "tau")
        # what is below a user's threshold is not moved
        return best_in_groups(some, wide, n, "node", score)

    def top(found: DataFrame) -> DataFrame:
        one = found.repartition("qid").groupBy("qid", "iid").agg(F.max("score").alias("relevance_score"))
        w = Window.partitionBy("qid").orderBy(F.desc("relevance_score"), F.asc("iid"))
        return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)

    got = cut_lineage(top(scored(asked.where("first").withColumn("tau", F.lit(None).cast("double")))))
    tau = got.where(F.col("rank") == n).select(F.col("qid").alias("user_id"), F.col("relevance_score").alias("tau"))
    reads = asked.join(broadcast_few(tau), "user_id", "left").withColumn("read", F.col("first") | F.col("tau").isNull() | (F.col("bound") >= F.col("tau")))
    more = scored(reads.where("read and not first"))
    best = top(got.select("qid", "iid", F.col("relevance_score").alias("score")).unionByName(more))
    return best.select(F.col("qid").alias("user_id"), F.col("iid").alias("article_id"), "relevance_score"), reads


def graph_feed(user_interests: DataFrame, article_entities: DataFrame, edges: DataFrame,
               user_vectors: DataFrame, article_vectors: DataFrame, n: int = FEED_SIZE,
               max_depth: int = MAX_GRAPH_DEPTH, as_of: Column | None = None) -> DataFrame:
    """Top-``n`` articles per user by relevance over all articles that an interest reaches.

    (user, node, depth) and (article, node) stay apart.  A pair of depth 0 scores
    at least 0.7 and any deeper one at most 0.65, so a user who follows an entity
    with ``n`` articles needs no deeper pair: that feed comes from
    ``nearest_articles``.  Only the others' nodes are expanded at every depth.
    Reasons are found for the ranked rows alone, with followed entities and
    reached nodes as bit sets of seeds.
    """
    ui = cut_lineage(user_interests.select("user_id", "name", node_key(F.col("name")).alias("seed")))
    ids, reached = trace_bits(ui.select("seed").distinct().withColumn("node", F.col("seed")), edges, max_depth)
    reached = cut_lineage(reached)
    ae = stored(article_entities.select("article_id", node_key(F.col("name")).alias("node")).distinct())
    served = ui.join(ae.groupBy("node").count().where(F.col("count") >= n), ui["seed"] == F.col("node"))
    served = cut_lineage(served.select("user_id").distinct())
    ts = as_of if as_of is not None else F.current_timestamp()
    best, _ = nearest_articles(ui.join(served, "user_id", "left_semi"), ae, user_vectors, article_vectors, n)
    w = Window.partitionBy("user_id").orderBy(F.desc("relevance_score"), F.asc("article_id"))
    top = best.select(F.col("user_id").cast("string").alias("user_id"), "article_id", "relevance_score", F.lit(0).alias("graph_depth"),
                      ts.alias("timestamp"), F.row_number().over(w).alias("rank"))
    others = cut_lineage(ui.join(served, "user_id", "left_anti"))
    if not others.isEmpty():
        # only nodes that articles name, before the seeds are told apart
        named = reached.join(ae.select("node").distinct(), "node", "left_semi")
        reach = named.select("node", "block", F.explode(set_bits("bits")).alias("bit"), "depth").join(ids, ["block", "bit"])
        nodes = others.join(reach, "seed").groupBy("user_id", "node").agg(F.min("depth").alias("depth"))
        pairs = nodes.join(ae, "node").groupBy("user_id", "article_id").agg(F.min("depth").alias("graph_depth"))
        top = top.unionByName(user_feed(pairs.withColumn("match_reasons", F.lit(None)), user_vectors, article_vectors, n, as_of).drop("match_reasons"))
    top = cut_lineage(top)
    user = F.col("user_id").cast("string").alias("user_id")
    own = ui.join(ids, "seed").groupBy(user, "block").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("own"))
    by_node = reached.groupBy("node", "block").agg(F.bit_or("bits").alias("bits"))
    why = top.select("user_id", "article_id").join(ae, "article_id").join(by_node, "node") \
        .groupBy("user_id", "article_id", "block").agg(F.bit_or("bits").alias("bits")) \
        .join(own, ["user_id", "block"]).select("user_id", "article_id", "block", F.expr("bits & own").alias("bits")).where("bits <> 0") \
        .select("user_id", "article_id", "block", F.explode(set_bits("bits")).alias("bit")).join(ids, ["block", "bit"]) \
        .join(ui.select(user, "name", "seed"), ["user_id", "seed"]).groupBy("user_id", "article_id") \
        .agg(F.array_sort(F.collect_set(F.concat(F.lit(REASON_PREFIX), F.col("name")))).alias("match_reasons"))
    return top.join(why, ["user_id", "article_id"])


def fresh(df: DataFrame, ts_col: str, as_of: Column, hours: int = FEED_TTL_HOURS) -> DataFrame:
    """Rows younger than ``hours`` at ``as_of`` (feed cache TTL)."""
    return df.filter(F.col(ts_col) > as_of - F.expr(f"INTERVAL {int(hours)} HOURS"))
