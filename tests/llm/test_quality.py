import math
import random

import numpy as np
from newsgraph.llm import quality
from newsgraph.llm.queries import QUERIES
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, rank string, log_weight string, _text int"


def brute(spark, docs, labels, share):
    """Keys of all documents from plain counts, and the ids drawn."""
    grams = quality.Grams(quality.BUCKETS)
    good = {d for d, q in labels if q == 1 and d is not None}
    raw, target = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for d, t in docs:
        for g in grams.of(t):
            raw[g] += 1
            target[g] += d in good
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    noise = {r[0]: r[1] for r in spark.createDataFrame([(d,) for d in {x[0] for x in docs}], "d long").select(
        "d", F.pmod(F.xxhash64(F.lit(quality.SEED), "d"), F.lit(1 << 52))).collect()}
    keys = [(ratio[grams.of(t)].sum() - math.log(-math.log((noise[d] + 0.5) / (1 << 52))), d) for d, t in docs]
    keys.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
    return keys[:round(share * len(docs))]


def test_odd_rows(spark, odd):
    rng = random.Random(1)
    docs = odd + [(1000 + i, " ".join(rng.choice(["###", "$$$", "zz"]) for _ in range(40))) for i in range(20)]
    labels = [(d, int(d < 1000)) for d, _ in docs if d is not None] + [(None, 1), (77, None)]
    df = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in docs], SCHEMA).repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.resample(df, lab, 0.6).orderBy("rank").collect()
    want = brute(spark, docs, labels, 0.6)
    assert [r["doc_id"] for r in got] == [d for _, d in want] and [r["rank"] for r in got] == list(range(1, len(want) + 1))
    assert np.allclose([r["gumbel_key"] for r in got], [k for k, _ in want])
    assert quality.resample(df, lab, 1.0).count() == len(docs)
    none = spark.createDataFrame([], SCHEMA)
    assert quality.resample(none, lab).collect() == []
    assert quality.resample(df, lab.limit(0)).count() == len(docs)


def test_grams():
    g = quality.Grams(quality.BUCKETS)
    assert len(g.of("One two, three")) == 7 and len(g.of(None)) == len(g.of(" ")) == 0
    assert (g.of("ONE two") == g.of("one TWO")).all()


def test_query_prefers_quality(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op8_quality"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    good, known = labels.agg(F.count_if(F.col("quality") == 1), F.count("quality")).first()
    assert got.count() == round(good / known * n)
    kept = {r["quality"]: (r["kept"], r["n"]) for r in labels.join(got.select("doc_id", "rank"), "doc_id", "left").groupBy("quality").agg(
        F.count("rank").alias("kept"), F.count(F.lit(1)).alias("n")).collect()}
    assert kept[1][0] / kept[1][1] > 0.9 and kept[0][0] / kept[0][1] < 0.5


def test_carried_columns(spark, odd):
    df = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in odd], SCHEMA)
    lab = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    got = quality.resample(df, lab, 1.0, carry=["doc_id", "_text", "rank", "text"])
    assert got.columns == ["doc_id", "_text", "text", "n_grams", "log_weight", "gumbel_key", "rank"]
    assert got.count() == len(odd) and {r["_text"] for r in got.collect()} == {1}
