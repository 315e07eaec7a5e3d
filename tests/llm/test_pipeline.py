import brute
import corpus_pipeline
import pytest
from newsgraph.llm import mixing, toxicity
from pyspark.sql import functions as F
from shared import same

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on what its predecessor kept; the last one is the pipeline's result."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, after = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        after[name] = (docs, out)
        if k < 4:
            assert out.columns == columns
        docs = out
    rows = lambda df: [tuple(r) for r in df.select("doc_id", "text").collect()]

    was, kept = map(rows, after["toxicity"])
    score = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).score
    assert sorted(kept) == sorted((d, t) for d, t in was if score(t) < 0.3) and len(kept) < len(was)

    was, kept = map(rows, after["simhash"])
    best = {}
    for (d, t), (_, _, c) in zip(was, brute.simhash(was)):
        best.setdefault(c, []).append((d, t))
    assert sorted(kept) == sorted(min(x) for x in best.values()) and len(kept) < len(was)

    was, kept = map(rows, after["decontamination"])
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    marks = {r[0]: r for r in brute.contamination(was, items)}
    words = {d: len(brute.WORD.findall(brute.lower(t))) for d, t in kept}
    assert all(words.get(d, 0) == m[1] - m[2] for d, m in marks.items())
    assert {(d, t) for d, t in was if not marks[d][-1]} <= set(kept) and any(m[-1] for m in marks.values())

    was, out = after["mixing"]
    budget = sum(len((t or "").split()) for _, t in rows(was)) * mixing.SHARE[0] // mixing.SHARE[1]
    longest = max(len(t.split()) for _, t in rows(was))
    leaves = was.select("lang", "source").distinct().count()
    assert budget - longest * leaves <= sum(len(t.split()) for _, t in rows(out)) <= budget

    was, out = after["sharding"]
    same(out, ["doc_id", "size", "text_crc32", "shard", "slot"], brute.shards(rows(was)))


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and got.select("shard").distinct().count() <= 24


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_empty_and_odd(spark, frame, odd, stage):
    name, f = stage
    assert f(spark, frame([]), SF).collect() == []
    src = frame(odd)
    out = f(spark, src, SF)
    if name != "sharding":
        assert out.columns == src.columns
    if name in ("toxicity", "decontamination"):  # nothing planted here: all clean rows stay
        assert out.count() == src.count()
    assert out.where(F.col("doc_id") == 99).count() >= (name != "mixing")
