"""Cases that an earlier version got wrong."""
import datetime as dt

import pytest
from pyspark.sql import functions as F


def test_article_ids_and_urls(spark):
    from newsgraph.sources.ingest import article_id, page_quarantine, pages_to_articles
    urls = ["https://a.com:443/x", "https://a.com/x", "http://a.com:80/", "ftp://a/1", "not a url", None]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit("<p>t</p>"))
    ids = [r[0] for r in rows.orderBy("page_id").select(article_id(F.col("url"))).collect()]
    assert ids[0] == ids[1] and len(ids[0]) == 64 and ids[3:] == [None] * 3
    assert pages_to_articles(rows).count() == 3
    assert {r["page_id"] for r in page_quarantine(rows).collect()} == {3, 4, 5}


def test_character_references(spark):
    from newsgraph.sources.ingest import unescape
    text = "&copy;&middot;&eacute; &amp;lt; &#233;&#xE9;&#x1F600; &nope; &#0; a & b&nbsp;c"
    assert spark.range(1).select(unescape(F.lit(text))).first()[0] == "©·é &lt; éé😀 &nope; &#0; a & b c"


def test_dates(spark):
    from newsgraph.functions import variant as V
    from newsgraph.sources.articles import _ts
    text = ['"2024-01-05"', '"2024-01-05T10:00:00Z"', '"1700000000"', '"2024"', '"2024-1-5"', '"T10:00:00"', '"x"']
    df = spark.createDataFrame([(t,) for t in text], "t string").select(V.parse_single(F.col("t")).alias("v"))
    got = [r[0] for r in df.select(F.unix_seconds(_ts(F.col("v")))).collect()]
    assert got == [1704412800, 1704448800, 1700000000, 2024, None, None, None]  # text of digits is epoch seconds


def test_vectors_without_direction(spark):
    from newsgraph.operators.vectors import vector_topk
    items = [(i, [1.0, float(i)]) for i in range(5)] + [(7, [0.0, 0.0]), (8, [0.0, 0.0]), (9, None)]
    q = spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, None)], "qid long, vec array<double>")
    got = vector_topk(q, spark.createDataFrame(items, "iid long, vec array<double>"), 3).collect()
    assert {r["qid"] for r in got} == {1} and sorted(r["rank"] for r in got) == [1, 2, 3]
    assert {r["iid"] for r in got} == {1, 2, 3}


def test_subject_before_a_mention_at_the_verb(spark):
    from newsgraph.operators.relations import lexicon_relations
    text = "Alpha is Beta."
    docs = spark.createDataFrame([(1, text)], "article_id long, content string")
    m = [(1, 0, 5, "Alpha", "company", 0.9), (1, 6, 8, "is", "company", 0.9), (1, 9, 13, "Beta", "company", 0.9)]
    mentions = spark.createDataFrame(m, "article_id long, start int, end int, name string, type string, confidence double")
    lex = spark.createDataFrame([("is", "IS", 0.0)], "verb string, action string, sentiment double")
    r = lexicon_relations(docs, mentions, lex).collect()
    assert [(x["subject"]["name"], x["object"]["name"]) for x in r] == [("Alpha", "Beta")]


def test_late_copies_and_missing_state(spark, tmp_path):
    from newsgraph.config import Config
    from newsgraph.streaming.stream import dedup_against_seen
    at = lambda d: dt.datetime(2024, 3, 1) + dt.timedelta(days=d)
    batch = lambda *ds: spark.createDataFrame([("a", at(d)) for d in ds], "article_id string, fetch_timestamp timestamp")
    run = lambda n, *ds: sorted((r["fetch_timestamp"] - at(0)).days for r in dedup_against_seen(spark, batch(*ds), str(tmp_path), n, Config()).collect())
    assert run(0, 0) == [0]
    assert run(1, -3, 5, -10, 20) == [-10, 20]
    assert run(2, 14, 28) == [28]
    assert run(2, 14, 28) == [28]  # a replay
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        dedup_against_seen(spark, batch(1), str(tmp_path / "other"), 3, Config())


def test_ranked_keys_search_like_the_kb(spark):
    from newsgraph.operators import factcheck as fc
    kb = spark.createDataFrame([(f"k{i}", f"Acme {i % 3} Corp", ["AC"], i) for i in range(12)],
                               "kb_id string, name string, aliases array<string>, popularity int") \
        .withColumn("permalink", F.lit("p")).withColumn("short_description", F.lit(None).cast("string"))
    names = spark.createDataFrame([("acme",), ("ac",), ("Acme 1 Corp",), ("none",)], "name string")
    stored = spark.createDataFrame(fc.top_keys(kb, "kb_id", "name").collect(), fc.top_keys(kb, "kb_id", "name").schema)
    for limit in (5, 2):
        exp = fc.company_verdicts(names, kb, limit).collect()
        assert sorted(map(str, exp)) == sorted(map(str, fc.company_verdicts(names, stored, limit).collect())) and len(exp) == 4


def test_interests_weigh_every_event_type(spark):
    from newsgraph.operators.curate import interests
    e = spark.createDataFrame([(1, "A", "view", 2.0), (1, "A", "purchase", 1.0), (1, "B", "new kind", 4.0), (2, "A", None, 1.5)],
                              "user_id long, name string, event_type string, value double")
    assert sorted(map(tuple, interests(e).collect())) == [(1, "A", 5.0), (1, "B", 4.0), (2, "A", 1.5)]
