import math
import random

import numpy as np
import pytest
from newsgraph.llm import hardneg
from newsgraph.llm.queries import QUERIES
from pyspark.sql import functions as F
from shared import same

COLS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "vec_id long, embedding array<float>, label int, q string, row int, slot double, id string"


def brute(rows, every, label=lambda i, x: x, n_pos=5, n_neg=10):
    v = [(i, label(i, y), [math.floor(256 * x) for x in e]) for i, e, y in rows
         if y is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for n, (i, y, q) in enumerate(v):
        if i is None or i % every:
            continue
        s = sorted(((-sum(a * b for a, b in zip(q, x)), j is None, j or 0, z, j) for m, (j, z, x) in enumerate(v) if m != n), key=lambda r: r[:3])
        for p in [r for r in s if r[3] == y][:n_pos]:
            hits = [r for r in s if r[3] != y and 30 * -p[0] <= 100 * -r[0] <= 90 * -p[0]][:n_neg]
            out += [(i, p[4], k + 1, r[4], -p[0], -r[0]) for k, r in enumerate(hits)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, e, y, "x", 2, 0.5, "z") for i, e, y in rows], SCHEMA).repartition(4)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want = brute(rows, 100, lambda i, y: (y + 1) % 10 if i % 7 == 0 else y)
    assert want
    same(QUERIES["op13_hardneg"](spark, "/root/testdata/sf0.01"), COLS, want)


@pytest.mark.parametrize("block", [2048, 3])
def test_odd_rows(spark, block):
    rng = random.Random(1)
    vec = lambda n=6: [rng.choice([-0.5, -0.25, 0.0, 0.25, 0.7]) for _ in range(n)]
    hot = vec()
    rows = [(i, vec(), rng.randrange(3)) for i in range(-20, 140)] + [(200 + i, hot, i % 2) for i in range(60)]
    rows += [(None, hot, 1), (None, vec(), 2), (50, hot, 0), (50, hot, 0), (300, None, 1), (301, vec(), None), (310, [None] * 6, 1),
             (320, [float("nan")] * 6, 1), (330, [float("inf")] + vec(5), 2), (340, [], 1), (350, vec(3), 0), (360, vec(9), 2), (370, [1e4] * 6, 1)]
    same(hardneg.mine(frame(spark, rows), anchor=F.col("vec_id") % 10 == 0, anchor_block=block), COLS, brute(rows, 10))


def test_few_and_none(spark):
    assert hardneg.mine(frame(spark, []), anchor=F.lit(True)).collect() == []
    assert hardneg.mine(frame(spark, [(1, [0.5], 1)]), anchor=F.lit(True)).collect() == []
    # no other row of the label; a positive of score 0 admits scores of 0 only; negative scores admit none
    rows = [(0, [0.5, 0.0], 1), (1, [0.0, 0.5], 1), (2, [0.0, 0.3], 2), (3, [0.5, 0.0], 2), (4, [-0.5, 0.0], 3), (5, [-0.4, 0.0], 3)]
    same(hardneg.mine(frame(spark, rows), anchor=F.lit(True)), COLS, brute(rows, 1))


def test_string_labels(spark):
    df = spark.createDataFrame([(1, [1.0], "a"), (2, [1.0], "a"), (3, [0.5], "b"), (4, [0.5], None)], "vec_id long, embedding array<double>, label string")
    same(hardneg.mine(df, anchor=F.col("vec_id") == 1), COLS, [(1, 2, 1, 3, 65536, 32768)])


def test_combiner():
    """Rows in any order and any batches give each group's first rows, ties by id."""
    rng = np.random.default_rng(3)
    n = 4000
    group, score, ids = rng.integers(0, 7, n), rng.integers(0, 6, n), rng.permutation(n)
    best = hardneg.Best(7, 9)
    for at in range(0, n, 170):
        s = slice(at, at + 170)
        may = best.beats(group[s], score[s], ids[s])
        best.add(group[s][may], score[s][may], ids[s][may], ids[s][may])
    want = [r for g in range(7) for r in sorted((int(g), -int(s), int(i)) for h, s, i in zip(group, score, ids) if h == g)[:9]]
    assert [(int(g), -int(s), int(i)) for g, s, i in zip(*best.rows[:3])] == want
