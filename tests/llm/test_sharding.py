import brute
from newsgraph.llm import sharding
from newsgraph.llm.queries import QUERIES
from shared import same, table

COLS = ["doc_id", "size", "text_crc32", "shard", "slot"]


def test_query(spark):
    same(QUERIES["op1_sharding"](spark, "/root/testdata/sf0.001"), COLS, brute.shards(table(spark, "documents", "doc_id", "text")))


def test_odd_rows(spark, frame, odd):
    df = sharding.shard(frame(odd), 7)
    assert {"lang", "source", "text", "n_words"} <= set(df.columns)
    same(df, COLS, brute.shards(odd, 7))


def test_balance_and_hot_id(spark, frame):
    docs = [(5, "same text")] * 300 + [(i, "x" * (i % 50)) for i in range(600)]
    got = sharding.shard(frame(docs), 24).collect()
    by = {}
    for r in got:
        by[r["shard"]] = by.get(r["shard"], 0) + r["size"]
    assert len(by) == 24 and max(by.values()) - min(by.values()) <= 2 * 58
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}


def test_empty(spark, frame):
    assert sharding.shard(frame([])).collect() == []


def test_input_columns_of_internal_names_stay(spark):
    docs = spark.createDataFrame([(i, "t" * i, f"p{i}", i, 7, "x") for i in range(20)],
                                 "doc_id long, text string, prefix string, row_index int, _carry int, Shard string")
    got = sharding.shard(docs, 3)
    assert got.columns == ["doc_id", "text", "prefix", "row_index", "_carry", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert all(r["prefix"] == f"p{r['doc_id']}" and r["row_index"] == r["doc_id"] for r in got.collect())
