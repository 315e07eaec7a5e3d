import random

import brute
import pytest
from newsgraph.llm import simhash
from newsgraph.llm.queries import QUERIES
from pyspark.sql import functions as F
from shared import same, table

COLS = ["doc_id", "fingerprint", "component_id"]


def test_query(spark):
    docs = table(spark, "documents", "doc_id", "text")
    df = QUERIES["op10_simhash"](spark, "/root/testdata/sf0.001")
    same(df, COLS, brute.simhash(docs))
    first = docs[7][1]
    assert simhash.fingerprint(first) == brute.fingerprint(first).to_bytes(8)


def test_odd_rows(spark, frame, odd):
    same(simhash.near_duplicates(frame(odd)), COLS, brute.simhash(odd))


def test_empty(spark, frame):
    assert simhash.near_duplicates(frame([])).collect() == []
    assert simhash.representatives(frame([])).collect() == []


def clouds(seed):
    """Fingerprints around a few centres, chains of small steps, and noise."""
    rng = random.Random(seed)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    out = {0, (1 << 64) - 1}
    for _ in range(4):
        c = rng.getrandbits(64)
        out |= {flip(c, rng.randint(0, 5)) for _ in range(60)}
    x = rng.getrandbits(64)
    for _ in range(40):
        out.add(x := flip(x, rng.randint(3, 5)))
    return sorted(out | {rng.getrandbits(64) for _ in range(60)})


@pytest.mark.parametrize("bound", [3, 20_000])
def test_links_are_exact(spark, bound):
    """In-task comparison, and the midpoint join for buckets over the bound."""
    f = clouds(1)
    want = brute.classes(len(f), lambda i, j: (f[i] ^ f[j]).bit_count() <= 4)
    signed = [x - (1 << 64) if x >> 63 else x for x in f]
    fps = spark.createDataFrame([(x,) for x in signed], "fp long")
    root = {r["node"]: r["root"] for r in simhash.components(simhash.links(fps, bucket_rows=bound)).collect()}
    groups = {}
    for x, c in zip(signed, want):
        groups.setdefault(c, []).append(x)
    for g in groups.values():
        assert {root.get(x, x) for x in g} == {min(g)}


@pytest.mark.parametrize("one_task", [0, 200_000])
def test_components(spark, one_task):
    """Paths, stars and random links, over many tasks and in one."""
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7), (500, 490)]
    near = {frozenset(e) for e in edges}
    want = brute.classes(501, lambda i, j: frozenset((i, j)) in near)
    df = spark.createDataFrame([e if i % 2 else e[::-1] for i, e in enumerate(edges)], "u long, v long").repartition(7)
    got = {r["node"]: r["root"] for r in simhash.components(df, one_task).collect()}
    first = {}
    for i, c in enumerate(want):
        first.setdefault(c, i)
    assert got == {x: first[want[x]] for e in edges if e[0] != e[1] for x in e}


@pytest.mark.parametrize("seed", [2, 3])
def test_large_bucket_forest(seed):
    import numpy as np
    f = clouds(seed)
    linker = simhash.Linker(simhash.block_masks(), f[:16], 4)
    a, b = linker.large(np.array(f, np.uint64))
    at = {x: i for i, x in enumerate(f)}
    edges = {(at[int(x)], at[int(y)]) for x, y in zip(a, b)}
    assert all((int(x) ^ int(y)).bit_count() <= 4 for x, y in zip(a, b))
    want = brute.classes(len(f), lambda i, j: (f[i] ^ f[j]).bit_count() <= 4)
    assert brute.classes(len(f), lambda i, j: (i, j) in edges or (j, i) in edges) == want


def test_representatives(spark, frame, odd):
    kept = simhash.representatives(frame(odd))
    assert kept.columns == frame(odd).columns
    c = brute.simhash(odd)
    assert kept.count() == len({(x[1], x[2]) if x[2] is None else x[2] for x in c})
    assert kept.where(F.col("text").isNull()).count() <= 1


def test_carried_columns_and_equal_rows(spark):
    docs = spark.createDataFrame([(2, "a b c", 9, 1), (1, "a b c", 8, 2), (1, "a b c", 8, 3), (None, "x y z", 7, 4)], "doc_id long, text string, _text int, n int")
    got = simhash.near_duplicates(docs, carry=["doc_id", "_text"])
    assert got.columns == ["doc_id", "_text", "fingerprint", "component_id", "component_fingerprint"]
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "x y z"), (1, "a b c")]
