"""Graph snapshots, trace (vs brute-force BFS), TTL dedup, vector top-k (vs numpy)."""
import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from newsgraph.operators import graph as G
from newsgraph.operators.vectors import vector_topk
from newsgraph.sources.ingest import ttl_keep


def bfs(edges, seed, depth):
    seen, frontier = {seed: 0}, [seed]
    for d in range(1, depth + 1):
        nxt = []
        for u in frontier:
            for a, b in edges:
                if a == u and b not in seen:
                    seen[b] = d
                    nxt.append(b)
        frontier = nxt
    return seen


def test_trace_matches_bfs(spark):
    rnd = random.Random(7)
    edges = sorted({(f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}") for _ in range(60)})
    e = spark.createDataFrame(edges, "src string, dst string")
    seeds = spark.createDataFrame([(f"n{i}", f"n{i}") for i in range(0, 30, 7)], "seed string, node string")
    got = {(r.seed, r.node): r.depth for r in G.impact_trace(seeds, e, 3).collect()}
    exp = {(f"n{i}", n): d for i in range(0, 30, 7) for n, d in bfs(edges, f"n{i}", 3).items()}
    assert got == exp


def test_trace_with_hubs_and_blocks_of_seeds(spark):
    """More than 64 seeds, several start nodes of one seed, hubs dealt over salts, both directions."""
    rnd = random.Random(8)
    edges = sorted({(f"n{rnd.randrange(90)}", f"n{rnd.randrange(90)}") for _ in range(150)} | {("n0", f"n{i}") for i in range(1, 60)})
    e = spark.createDataFrame(edges, "src string, dst string")
    starts = [(f"s{i}", f"n{i}") for i in range(90)] + [("s3", "n0"), ("s3", "n7"), ("s4", "elsewhere")]
    seeds = spark.createDataFrame(starts, "seed string, node string")
    both = edges + [(b, a) for a, b in edges]
    for direction, es in (("forward", edges), ("both", both)):
        exp = {}
        for s, n in starts:
            for m, d in bfs(es, n, 3).items():
                exp[s, m] = min(d, exp.get((s, m), 9))
        got = G.impact_trace(seeds, e, 3, direction, hub_edges=10).collect()
        assert {(r.seed, r.node): r.depth for r in got} == exp and len(got) == len(exp)


def test_trace_shuffles_its_edges_once(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{i * 7 % 50}") for i in range(50)], "src string, dst string")
    adjacency, hubs = G._adjacency(e, "forward", 10)
    front = spark.createDataFrame([("n1", 0, 1)], "node string, salt int, bits long").hint("merge")
    plan = front.join(adjacency, (front.node == adjacency.src) & (front.salt == adjacency.salt))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and hubs.isEmpty()


def test_incremental_upsert_equals_rebuild(spark):
    rel = spark.createDataFrame(
        [("a1", "X", "buys", "Y", 0.5, 0.8), ("a2", "x", "BUYS", "y", -0.5, 0.9), ("a3", "Y", "sells", "Z", 0.1, 0.7)],
        "article_id string, s string, action string, o string, sentiment double, confidence double"
    ).select("article_id", F.struct(F.col("s").alias("name")).alias("subject"), "action",
             F.struct(F.col("o").alias("name")).alias("object"), "sentiment", "confidence")
    full = G.upsert_edges(rel)
    step = G.upsert_edges(rel.filter("article_id = 'a3'"), G.upsert_edges(rel.filter("article_id <> 'a3'")))
    assert sorted(full.collect()) == sorted(step.collect())
    e = {(r.src, r.dst): r for r in full.collect()}
    assert e[("x", "y")].n == 2 and e[("x", "y")].first_article == "a1"


def test_ttl_keep_fold(spark):
    base = dt.datetime(2024, 1, 1)
    days = [0, 5, 7, 10, 12, 30]
    rows = [("A", base + dt.timedelta(days=d), i) for i, d in enumerate(days)] + \
           [("B", base, 0), ("B", base, 1), ("C", base + dt.timedelta(days=7, seconds=1), 0),
            ("C", base, 1)]
    df = spark.createDataFrame(rows, "article_id string, fetch_timestamp timestamp, n int")
    kept = ttl_keep(df, tie=["n"]).collect()
    got = sorted((r.article_id, (r.fetch_timestamp - base).days, r.n) for r in kept)
    assert got == [("A", 0, 0), ("A", 10, 3), ("A", 30, 5), ("B", 0, 0), ("C", 0, 1), ("C", 7, 0)]


def test_ttl_keep_long_chain(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [("A", base + dt.timedelta(days=d), d) for d in range(0, 120, 3)]
    kept = ttl_keep(spark.createDataFrame(rows, "article_id string, fetch_timestamp timestamp, n int"),
                    tie=["n"]).collect()
    exp, last = [], None
    for _, ts, n in rows:
        if last is None or ts - last > dt.timedelta(days=7):
            exp.append(n)
            last = ts
    assert sorted(r.n for r in kept) == exp


def test_vector_topk_matches_numpy(spark):
    rng = np.random.default_rng(3)
    q = rng.normal(size=(7, 5))
    it = rng.normal(size=(40, 5))
    it[5] = it[6]                                    # a tie, broken by item id
    qdf = spark.createDataFrame([(i, q[i].tolist()) for i in range(7)], "qid long, vec array<double>")
    idf = spark.createDataFrame([(f"i{j:02d}", it[j].tolist()) for j in range(40)], "iid string, vec array<double>")
    got = sorted((r.qid, r.rank, r.iid) for r in vector_topk(qdf, idf, 4).collect())
    qn = q / np.linalg.norm(q, axis=1, keepdims=True)
    inn = it / np.linalg.norm(it, axis=1, keepdims=True)
    s = np.round(qn @ inn.T, 6)
    exp = []
    for i in range(7):
        order = sorted(range(40), key=lambda j: (-s[i, j], f"i{j:02d}"))[:4]
        exp += [(i, r + 1, f"i{j:02d}") for r, j in enumerate(order)]
    assert got == sorted(exp)


def test_ttl_keep_random_vs_fold(spark):
    rnd = random.Random(11)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(6):
        for _ in range(rnd.randrange(1, 40)):
            rows.append((f"id{i}", base + dt.timedelta(minutes=rnd.randrange(0, 60 * 24 * 60))))
    rows = [(a, ts, n) for n, (a, ts) in enumerate(rows)]
    exp = set()
    for i in range(6):
        last = None
        for ts in sorted({ts for a, ts, _ in rows if a == f"id{i}"}):
            if last is None or ts - last > dt.timedelta(days=7):
                exp.add((f"id{i}", ts))
                last = ts
    df = spark.createDataFrame(rows, "article_id string, fetch_timestamp timestamp, n int")
    for hours in (1, 24, 240):
        got = {(r.article_id, r.fetch_timestamp) for r in ttl_keep(df, tie=["n"], bucket_hours=hours).collect()}
        assert got == exp, hours
