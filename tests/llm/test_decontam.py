import random

import brute
import numpy as np
from newsgraph.llm import decontam
from newsgraph.llm.queries import QUERIES
from shared import same, table

COLS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_query(spark):
    df = QUERIES["op5_decontamination"](spark, "/root/testdata/sf0.01")
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("item_id", "text").collect()]
    want = brute.contamination(docs, items)
    assert any(w[-1] for w in want)
    same(df, COLS, want)


def bench(odd):
    long = dict((d, t) for d, t in odd if d is not None)
    return [(1, long[12]), (2, long[13].upper() + ", tail"), (3, "w1 w2"), (4, ""), (5, None), (None, long[14]), (7, long[12]), (8, "ONE"),
            (9, " ".join(long[99].split()[500:530]))]


def test_odd_rows_and_blocks(spark, frame, odd):
    items = bench(odd)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, n_words string")
    want = brute.contamination(odd, items)
    same(decontam.contamination(frame(odd), b), COLS, want)
    same(decontam.contamination(frame(odd), b, block_words=20, shard_symbols=50), COLS, want)


def test_empty(spark, frame, odd):
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(frame([]), b).collect() == []
    same(decontam.contamination(frame(odd), b), COLS, brute.contamination(odd, []))


def test_cut(spark, frame, odd):
    items = bench(odd)
    b = spark.createDataFrame(items, "item_id long, text string")
    src = frame(odd)
    out = decontam.decontaminate(src, b)
    assert out.columns == src.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    was = brute.contamination(odd, items)
    for row, (d, t) in zip(was, odd):
        if not row[-1]:
            assert (d, t) in got
    assert len(got) >= sum(r[2] < r[1] or r[1] == 0 for r in was)
    words = {d: len(brute.WORD.findall(brute.lower(t))) for d, t in got if d == 99}
    n, hit = next((r[1], r[2]) for r in was if r[0] == 99)
    assert words[99] == n - hit and hit >= 30


def test_index_against_scan():
    rng = random.Random(3)
    for n in (1, 2, 40, 3000):
        s = np.array([rng.randint(1, 5) for _ in range(n)] * 2)
        index = decontam.FMIndex(s, 6)
        for m in (1, 2, 5):
            p = np.array([[rng.randint(1, 5) for _ in range(m)] for _ in range(20)])
            low, high = index.search(p)
            for q, a, b in zip(p, low, high):
                want = [i for i in range(len(s) - m + 1) if (s[i:i + m] == q).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_carried_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "n", 5)], "doc_id long, text string, n_words string, _carry int")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    got = decontam.contamination(docs, items, carry=["doc_id", "n_words", "_carry", "text"])
    assert got.columns[:4] == ["doc_id", "_carry", "text", "n_words"] and len(set(got.columns)) == len(got.columns)
    assert [(r["n_words"], r["n_hit"], r["_carry"]) for r in got.collect()] == [(2, 2, 5)]
