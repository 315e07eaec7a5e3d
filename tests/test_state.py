"""Bucketed state: replay, what a batch moves, removal of old versions; the tables kept in it."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsgraph.operators import factcheck as fc
from newsgraph.operators import graph as G
from newsgraph.streaming import state as S


def merge(rows):
    return rows.groupBy("k").agg(F.sum("n").alias("n"))


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, n long")


def content(state, version):
    return {r.k: r.n for r in state.read(version).collect()}


def test_batches_and_replays(spark, tmp_path):
    state = S.BucketState(spark, str(tmp_path), ["k"], "k string, n long", 8)
    batches = [[(f"k{i}", 1) for i in range(50)], [("k3", 5), ("new", 2), (None, 7)], [("k3", 1)], [], [("k4", 1)]]
    want, at = {}, []
    for n, rows in enumerate(batches):
        for k, v in rows:
            want[k] = want.get(k, 0) + v
        at.append(dict(want))
        for _ in range(2):  # each batch once more, as after a failure
            S.upsert(state, frame(spark, rows), n, merge)
            assert content(state, n) == at[n]
    assert content(state, 3) == at[3]  # the state before the last batch is still there


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    state = S.BucketState(spark, str(tmp_path), ["k"], "k string, n long", 16)
    S.upsert(state, frame(spark, [(f"k{i}", 1) for i in range(4000)]), 0, merge)
    files = lambda v: list((tmp_path / "data" / f"v={v}").rglob("*.parquet"))
    touched = S.upsert(state, frame(spark, [("k7", 1)]), 1, merge)
    assert len(files(0)) == 16 and len(files(1)) == 1
    assert 100 < touched.count() < 500 and len(touched.inputFiles()) == 1
    assert sum(f.stat().st_size for f in files(1)) < 0.2 * sum(f.stat().st_size for f in files(0))
    assert sum(content(state, 1).values()) == 4001


def test_versions_beyond_the_last_two_are_removed(spark, tmp_path):
    state = S.BucketState(spark, str(tmp_path), ["k"], "k string, n long", 2)
    keys = {}
    for i in range(100):
        b = frame(spark, [(f"k{i}", 1)]).select(state.bucket()).first()[0]
        keys.setdefault(b, f"k{i}")
        if len(keys) == 2:
            break
    for n in range(6):
        S.upsert(state, frame(spark, [(keys[0], 1)] + ([(keys[1], 1)] if n == 0 else [])), n, merge)
    names = lambda d: sorted(p.name for p in (tmp_path / d).iterdir())
    assert names("manifest") == ["v=4", "v=5"]
    assert names("data") == ["v=0", "v=4", "v=5"]  # the bucket that no later batch touched is where batch 0 left it
    assert [p.name for p in (tmp_path / "data" / "v=0").iterdir() if p.name.startswith("bucket")] == ["bucket=1"]
    assert content(state, 5) == {keys[0]: 6, keys[1]: 1}


def test_emptied_buckets_marks_and_other_sizes(spark, tmp_path):
    state = S.BucketState(spark, str(tmp_path), ["k"], "k string, n long", 4)
    rows = frame(spark, [("a", 1), ("b", 2)])
    state.write(0, rows, state.touched(rows), 17)
    state.write(1, rows.limit(0), state.touched(rows), 18)
    assert content(state, 1) == {} and state.manifest(1)[1] == 18 and state.manifest(0)[1] == 17
    with pytest.raises(ValueError, match="4 buckets"):
        S.BucketState(spark, str(tmp_path), ["k"], "k string, n long", 8).read(1)


def test_dedup_moves_what_the_batch_touches(spark, tmp_path):
    from newsgraph.config import Config
    from newsgraph.streaming.stream import dedup_against_seen
    base = dt.datetime(2024, 1, 1)
    batch = lambda *r: spark.createDataFrame([(a, base + dt.timedelta(days=d)) for a, d in r], "article_id string, fetch_timestamp timestamp")
    run = lambda n, *r: sorted(x.article_id for x in dedup_against_seen(spark, batch(*r), str(tmp_path), n, Config()).collect())
    assert len(run(0, *[(f"a{i}", 0) for i in range(500)])) == 500
    assert run(1, ("a1", 1), ("b", 1)) == ["b"]
    assert len(list((tmp_path / "data" / "v=1").rglob("*.parquet"))) == 2
    # 60 days on, copies of the first day are forgotten, in buckets not touched since too
    assert run(2, ("c", 60)) == ["c"]
    assert run(3, ("a2", 3), ("b", 3), ("c", 61)) == ["a2", "b"]
    assert run(3, ("a2", 3), ("b", 3), ("c", 61)) == ["a2", "b"]


def kb(spark, names):
    return spark.createDataFrame([(f"id-{n}", n, ["x"], "p", "d", 1) for n in names],
                                 "kb_id string, name string, aliases array<string>, permalink string, short_description string, popularity int")


def test_verdicts_are_looked_up_once(spark, tmp_path):
    store = fc.verdict_state(spark, str(tmp_path), 4)
    ents = lambda *n: spark.createDataFrame([(x, "company") for x in n] + [("Thing", "product")], "name string, type string")

    def batch(n, version, companies, *names):
        v, new = fc.stored_verdicts(store, n, version, ents(*names), kb(spark, companies), None)
        return {r.name: (r.validated, r.v_confidence) for r in v.collect()}, sorted(r.name for r in new.collect())

    yes, no, skip = (True, 0.95), (False, None), (True, None)
    assert batch(0, "1", ["Acme"], "Acme", "Beta") == ({"Acme": yes, "Beta": no, "Thing": skip}, ["Acme", "Beta", "Thing"])
    # what is known is not searched again, even if the table has changed under the same version
    second = ({"Acme": yes, "Beta": no, "Corp": yes, "Thing": skip}, ["Corp"])
    assert batch(1, "1", ["Beta", "Corp"], "Acme", "Beta", "Corp") == second
    assert batch(1, "1", ["Beta", "Corp"], "Acme", "Beta", "Corp") == second  # a replay
    # another version of the KB: every verdict anew, those of the old one go when their bucket is rewritten
    assert batch(2, "2", ["Beta"], "Acme", "Beta") == ({"Acme": no, "Beta": yes, "Thing": skip}, ["Acme", "Beta", "Thing"])
    assert batch(3, "2", [], "Acme", "Beta") == ({"Acme": no, "Beta": yes, "Thing": skip}, [])


def test_incremental_snapshots_equal_a_rebuild(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    ents = spark.createDataFrame([(i % 4, f"N{i % 7}", "company", i / 40, f"ind{i}" if i % 3 else None, None, None, None, base + dt.timedelta(days=i * 5 % 11))
                                  for i in range(40)], "b int, name string, type string, confidence double, industry string, role string, country string, "
                                                       "severity string, ts timestamp")
    rel = spark.createDataFrame([(i % 4, f"a{i}", f"N{i % 5}", "buys", f"N{i % 3}", i / 100, i / 50) for i in range(40)],
                                "b int, article_id string, s string, action string, o string, sentiment double, confidence double") \
        .select("b", "article_id", F.struct(F.col("s").alias("name")).alias("subject"), "action", F.struct(F.col("o").alias("name")).alias("object"), "sentiment", "confidence")
    nodes, edges = G.node_state(spark, str(tmp_path / "n"), 4), G.edge_state(spark, str(tmp_path / "e"), 4)
    for n in (0, 1, 1, 2, 3, 3):
        G.upsert_nodes_incremental(nodes, ents.where(F.col("b") == n), n)
        G.upsert_edges_incremental(edges, rel.where(F.col("b") == n), n)
    rounded = lambda df: sorted(map(str, df.withColumns({c: F.round(c, 9) for c, t in df.dtypes if t == "double"}).collect()))
    assert rounded(nodes.read(3)) == rounded(G.upsert_nodes(ents))
    assert rounded(edges.read(3)) == rounded(G.upsert_edges(rel))


def test_a_snapshot_is_dealt_out_once_a_batch(spark, tmp_path, monkeypatch):
    from test_moves import moved

    from newsgraph.operators import graph as G
    written, keep = [], S.BucketState.write
    monkeypatch.setattr(S.BucketState, "write", lambda self, n, rows, *more: written.append(moved(rows)) or keep(self, n, rows, *more))
    state = G.edge_state(spark, str(tmp_path / "edges"), 4)
    rel = spark.range(600).selectExpr("cast(id as string) article_id", "struct(concat('S', id % 40) as name) subject", "'sells' action",
                                      "struct(concat('O', id % 23) as name) object", "0.5D sentiment", "0.8D confidence")
    for n in range(3):
        G.upsert_edges_incremental(state, rel.where(f"cast(article_id as int) % 3 = {n}"), n)
    want, got = ([tuple(r) for r in df.orderBy("src", "dst").collect()] for df in (G.upsert_edges(rel), state.read(2)))
    assert got == want and len(got) > 500
    assert [len(x) for x in written] == [1, 1, 1], written
