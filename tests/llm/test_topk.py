import math
import random

import pytest
from newsgraph.llm import topk
from newsgraph.llm.queries import QUERIES
from shared import same

COLS = ["query_id", "rank", "vec_id", "score"]
SCHEMA = "vec_id long, embedding array<float>, label int, q string, cid int, score double"


def brute(rows, k=5, every=50):
    v = [(i, [math.floor(256 * x) for x in e]) for i, e in rows
         if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for n, (i, q) in enumerate(v):
        if i is None or i % every:
            continue
        s = sorted(((-sum(a * b for a, b in zip(q, x)), j is None, j or 0, j) for m, (j, x) in enumerate(v) if m != n), key=lambda r: r[:3])
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(s[:k])]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 1, "x", 2, 0.5) for i, e in rows], SCHEMA).repartition(4)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()]
    same(QUERIES["op2_topk"](spark, "/root/testdata/sf0.01"), COLS, brute(rows))


@pytest.mark.parametrize("lists,block", [(1, 2048), (4, 5)])
def test_odd_rows(spark, lists, block):
    rng = random.Random(1)
    vec = lambda n=6: [rng.choice([-0.5, -0.25, 0.0, 0.25, 0.7]) for _ in range(n)]
    hot = vec()
    rows = [(i, vec()) for i in range(-20, 160)] + [(200 + i, hot) for i in range(60)] + [(None, hot), (None, vec()), (50, hot), (50, hot)]
    rows += [(300, None), (350, [None] * 6), (400, [float("nan")] * 6), (450, [float("inf")] + vec(5)), (500, []), (550, vec(3)), (600, vec(9)), (650, [1e4] * 6)]
    same(topk.search(frame(spark, rows), n_lists=lists, query_block=block), COLS, brute(rows))


def test_few_and_none(spark):
    rows = [(0, [0.5, 0.1]), (1, [0.5, 0.2]), (50, [0.5, 0.3])]
    same(topk.search(frame(spark, rows)), COLS, brute(rows))
    assert topk.search(frame(spark, [])).collect() == []
    assert topk.search(frame(spark, [(1, [0.5])])).collect() == []
