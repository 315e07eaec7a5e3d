"""Exact top-k inner products by a three-phase uniform threshold."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsgraph.llm.common import checkpoint

K = 5
N_LISTS = 4
# Query vectors that travel to every task at a time.
QUERY_BLOCK = 2048
_ROWS = 1024
_EXACT = 1 << 53


def quantised(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds ``q``, floor(256 * component) as longs; vectors null or with null or non-finite components go."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x.cast("double")))
    return vectors.where(F.col(vector).isNotNull() & finite).withColumn(
        "q", F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long")))


class Lists:
    """Queries of one block, their components dealt to ``m`` score lists."""

    def __init__(self, ids: list[int], vectors: list[list[int]], m: int):
        self.dim = max(map(len, vectors), default=0)
        self.ids, self.q = np.array(ids, np.int64), _matrix(vectors, self.dim)
        cut = [self.dim * i // m for i in range(m + 1)]
        self.parts = [slice(a, b) for a, b in zip(cut, cut[1:])]
        self.top = int(np.abs(self.q).max(initial=0))

    def scores(self, x: np.ndarray) -> list[np.ndarray]:
        """Local score of every query (rows) and vector in each list; doubles where they are exact."""
        kind = np.float64 if self.top * int(np.abs(x).max(initial=0)) * max(1, self.dim) < _EXACT else np.int64
        q, x = self.q.astype(kind), x.astype(kind)
        return [q[:, p] @ x[:, p].T for p in self.parts]


def _matrix(rows: list[list[int]], dim: int) -> np.ndarray:
    """Rows cut or zero-padded to ``dim`` components."""
    out = np.zeros((len(rows), dim), np.int64)
    for i, r in enumerate(rows):
        r = r[:dim]
        out[i, :len(r)] = r
    return out


def _chunks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        for s in range(0, b.num_rows, _ROWS):
            part = b.slice(s, _ROWS)
            yield part.column(0).to_numpy(), _matrix(part.column(1).to_pylist(), dim)


def _gather(lists: Lists, keep: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phase 1: this task's ``keep`` best vectors of each query in each list, with their whole scores."""
    best = [None] * len(lists.parts)
    for cid, x in _chunks(batches, lists.dim):
        local = lists.scores(x)
        whole = reduce(np.add, local)
        for j, s in enumerate(local):
            c, w = np.broadcast_to(cid, s.shape), whole
            if best[j] is not None:
                s, w, c = (np.concatenate(p, axis=1) for p in zip(best[j], (s, w, c), strict=True))
            if s.shape[1] > keep:
                at = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
                s, w, c = (np.take_along_axis(p, at, axis=1) for p in (s, w, c))
            best[j] = (s, w, np.ascontiguousarray(c))
    for j, found in enumerate(best):
        if found is not None:
            s, w, c = found
            n = s.shape[1]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(lists.ids, n)), pa.array(np.full(s.size, j, np.int32)), pa.array(c.ravel()),
                pa.array(s.ravel().astype(np.int64)), pa.array(w.ravel().astype(np.int64))], ["qid", "list", "cid", "local", "score"])


def _collect(lists: Lists, cutoff: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phase 2: vectors with an entry of at least cutoff / m in some list, unless their upper bound is below the cutoff.

    Phase 3: the lists that these miss are resolved exactly where the vectors
    are, and whole scores of at least the cutoff go on.
    """
    m = len(lists.parts)
    for cid, x in _chunks(batches, lists.dim):
        local, upper, some = lists.scores(x), 0, False
        for s in local:
            entry = s * m >= cutoff[:, None]
            upper = upper + np.where(entry, s, cutoff[:, None] / m)
            some = some | entry
        qi, xi = np.nonzero(some & (upper >= cutoff[:, None] - 1e-6 * np.abs(cutoff[:, None])))
        score = sum(s[qi, xi] for s in local)
        keep = score >= cutoff[qi]
        if keep.any():
            yield pa.RecordBatch.from_arrays([
                pa.array(lists.ids[qi[keep]]), pa.array(cid[xi[keep]]), pa.array(score[keep].astype(np.int64))], ["qid", "cid", "score"])


def _block(items: DataFrame, queries: list, k: int, n_lists: int) -> DataFrame:
    """The k + 1 best rows of every query vector of a block: ``qid``, ``vec_id``, ``score``."""
    lists = Lists([r["cid"] for r in queries], [r["q"] for r in queries], n_lists)
    keep, sc = k + 1, items.sparkSession.sparkContext
    shared = sc.broadcast(lists)
    vectors = items.select("cid", "q")

    def gather(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gather(shared.value, keep, it)

    local = vectors.mapInArrow(gather, "qid long, list int, cid long, local long, score long")
    per_list = Window.partitionBy("qid", "list").orderBy(F.desc("local"), "cid")
    seen = local.withColumn("rn", F.row_number().over(per_list)).where(F.col("rn") <= keep)
    seen = seen.select("qid", "cid", "score").distinct().join(items.select("cid", F.size("ids").alias("n")), "cid")
    # at most n_lists * (k + 1) vectors of each query of the block
    found = seen.groupBy("qid").agg(F.collect_list(F.struct("score", "n")).alias("s")).collect()
    cut = {}
    for r in found:
        scores = sorted((x["score"] for x in r["s"] for _ in range(x["n"])), reverse=True)
        cut[r["qid"]] = scores[keep - 1] if len(scores) >= keep else -np.inf
    cutoff = sc.broadcast(np.array([cut.get(i, -np.inf) for i in lists.ids.tolist()], np.float64))

    def collect(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _collect(shared.value, cutoff.value, it)

    scored = vectors.mapInArrow(collect, "qid long, cid long, score long")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("first").asc_nulls_last(), "cid")
    # the classes that can hold the k + 1 best rows, before they are expanded
    ranked = scored.join(items.select("cid", "ids", F.element_at("ids", 1).alias("first")), "cid")
    ranked = ranked.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= keep)
    rows = ranked.select("qid", "score", F.explode("ids").alias("vec_id"))
    by = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return checkpoint(rows.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= keep))


def search(vectors: DataFrame, k: int = K, every: int = 50, n_lists: int = N_LISTS, query_block: int = QUERY_BLOCK,
           vector: str = "embedding") -> DataFrame:
    """The ``k`` highest integer inner products of every query: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are
    all other rows, repeated rows included.  Ties go to the smaller vec_id (null
    last).  Components are floor(256 * x); vectors null or with null or
    non-finite components take no part; of vectors of unequal length the shorter
    counts as padded with zeros.  Scores are exact while they fit a long.

    Equal vectors form one class that keeps its k + 1 smallest vec_ids, which is
    all that a top k can show of them, so a hot vector is one candidate.  The
    components are dealt to ``n_lists`` score lists.  Phase 1 gathers the k + 1
    best of each list; the k + 1-th whole score among them is a safe cutoff t.
    Phase 2 broadcasts t: a vector that scores t has at least t / n_lists in some
    list, so only such entries are collected, less those whose upper bound is
    below t.  Phase 3 resolves the lists that the remaining ones miss, in the
    task that holds the vector, so only scores of t or more travel.  Queries
    go in blocks of about ``query_block`` vectors, so what is broadcast is
    bounded; each block passes over the classes twice.
    """
    rows = quantised(vectors, vector).select("vec_id", "q")
    per = Window.partitionBy("q").orderBy(F.col("vec_id").asc_nulls_last())
    items = rows.withColumn("rn", F.row_number().over(per)).where(F.col("rn") <= k + 1)
    items = items.groupBy("q").agg(F.sort_array(F.collect_list(F.struct(F.col("vec_id").isNull().alias("n"), "vec_id"))).alias("m"))
    items = checkpoint(items.select(F.monotonically_increasing_id().alias("cid"), "q", F.col("m.vec_id").alias("ids")))
    asked = checkpoint(rows.where(F.col("vec_id") % every == 0).join(items.select("cid", "q"), "q").select("vec_id", "cid"))
    wanted = asked.select("cid").distinct()
    blocks = max(1, -(-wanted.count() // query_block))
    spread = wanted.join(items.select("cid", "q"), "cid")
    spread = checkpoint(spread) if blocks > 1 else spread
    found = []
    for b in range(blocks):
        part = spread.where(F.pmod(F.xxhash64("cid"), F.lit(blocks)) == b).collect()
        if part:
            found.append(_block(items, part, k, n_lists))
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = reduce(DataFrame.unionByName, found)
    # a query's own row is among the best of its class's rows or not in its top k
    lists = best.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rn", "vec_id", "score"))).alias("best"))
    own = asked.withColumnRenamed("vec_id", "query_id").join(lists, asked["cid"] == lists["qid"])
    self_score = items.select("cid", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x * x).alias("self"))
    own = own.join(self_score, "cid")
    at = F.array_position(F.transform("best", lambda r: F.coalesce((r["vec_id"] == F.col("query_id")) & (r["score"] == F.col("self")), F.lit(False))), True)
    rest = own.withColumn("at", at).withColumn("best", F.filter("best", lambda r, i: i + 1 != F.col("at")))
    return rest.select("query_id", F.posexplode(F.slice("best", 1, k)).alias("i", "r")).select(
        F.col("query_id").cast("long").alias("query_id"), (F.col("i") + 1).cast("int").alias("rank"),
        F.col("r.vec_id").cast("long").alias("vec_id"), F.col("r.score").cast("long").alias("score"))
