"""What the plans move: wide columns stay where they are, rows that need no key stay out of a join."""

import pathlib
import re

from pyspark.sql import functions as F

from newsgraph.operators import factcheck as fc
from newsgraph.operators.responses import ResponseStore, attach
from newsgraph.plans import fixtures as fx
from newsgraph.plans.process import process_batch
from newsgraph.session import stored
from newsgraph.sources.tables import Tables

RESPONSES = "article_id string, stage string, content string, tokens_used long, error string"


def moved(df):
    """The columns of every shuffle of a plan."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [re.findall(r"(\w+)#", cols) for cols in re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", text)]


def test_responses_are_made_at_their_articles(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    arts = fx.order_articles(t).select("article_id")
    for stage in ("entity", "mapping"):
        one = fx.responses_fixture(t).where(F.col("stage") == stage).join(arts.hint("merge"), "article_id", "left_semi").select("article_id", "content")
        got = moved(one)
        assert got and not [c for c in got if {"content", "elem", "items", "els"} & set(c)], got


def test_attached_status_moves_no_content(spark):
    reqs = spark.createDataFrame([("a", "entity"), ("b", "entity"), ("c", "entity"), ("d", "entity")], "article_id string, stage string")
    resp = spark.createDataFrame([("a", "entity", "[]", 1, None), ("b", "entity", "x", 2, "failed"), ("c", "entity", None, 3, None)], RESPONSES)
    a = attach(reqs, resp.hint("merge"))
    got = {r.article_id: (r.status, r.has_content) for r in a.select("article_id", "status", "has_content").collect()}
    assert got == {"a": ("ok", True), "b": ("error", True), "c": ("missing", False), "d": ("missing", False)}
    assert not [c for c in moved(a.select("article_id", "status")) if "content" in c]


def test_a_type_without_a_source_needs_no_key(spark):
    ents = spark.sql("""select * from values ('a', 0, 'N', 'company'), ('a', 1, 'P', 'product'), ('a', 2, cast(null as string), 'product'),
                        ('b', 0, 'Q', cast(null as string)), ('b', 1, 'L', 'location') as (article_id, pos, name, type)""") \
        .selectExpr("*", "0.9D confidence", "cast(map() as map<string,string>) metadata")
    ents = stored(ents)
    checked = fc.validate_entities(ents, None, None)
    got = {(r.article_id, r.pos): (r.validated, r.reason, dict(r.metadata)) for r in checked.collect()}
    assert got == {("a", 0): (False, "no_api_key", {}), ("a", 1): (True, None, {"skipped": "true"}), ("a", 2): (False, "unknown", {}),
                   ("b", 0): (False, "unknown", {}), ("b", 1): (False, "api_error", {})}
    by_join = fc.apply_verdicts(ents, fc.verdicts(ents, None, None))
    assert {(r.article_id, r.pos): (r.validated, r.reason, dict(r.metadata)) for r in by_join.collect()} == got
    assert checked._jdf.queryExecution().optimizedPlan().toString().startswith("Union")  # the skipped ones beside the join


def test_a_batch_moves_its_own_responses_only(spark, tmp_path):
    store = ResponseStore(spark, str(tmp_path / "r"), 4)
    store.append(spark.range(5000).selectExpr("cast(id as string) article_id", "'entity' stage", "'x' content", "1L tokens_used", "cast(null as string) error"))
    arts = spark.range(0, 5000, 10).selectExpr("cast(id as string) article_id").unionByName(spark.sql("select cast(null as string) article_id"))
    got = [r.article_id for r in store.of(arts).collect()]
    assert {str(i) for i in range(0, 5000, 10)} <= set(got) and len(got) < 520 and len(set(got)) == len(got)
    assert store.of(arts.limit(0)).count() == 0


def test_a_stored_frame_leaves_no_shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {p for d in folders for p in pathlib.Path(d).rglob("shuffle_*")}
    before = files()
    stored(spark.range(20_000).selectExpr("id % 97 k", "id v").repartition("k").groupBy("k").agg(F.max("v").alias("v")))
    assert not files() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"  # as it was


def test_a_batch_of_a_store_moves_no_content_to_parse_it(spark, tmp_path):
    t = Tables(spark, "/root/testdata/sf0.001")
    arts, resp = fx.order_articles(t).drop("file_no").where("cast(article_id as long) % 3 = 0"), stored(fx.responses_fixture(t))
    store = ResponseStore(spark, str(tmp_path / "r"), 4)
    store.append(resp)
    args = fx.company_kb(t), fx.wiki_kb(t)
    as_of = F.lit("2024-06-01 00:00:00").cast("timestamp")
    got, want = (process_batch(arts, r, *args, as_of=as_of) for r in (store, resp))
    for a, b in ((got.events, want.events), (got.quarantine, want.quarantine)):
        key = lambda r: r.asDict(recursive=True).__repr__()
        assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))
    assert got.events.count() == arts.count() and got.quarantine.count() > 10
    wide = [got.entities, got.relationships.select("article_id", "pos", "action")]
    assert not [c for df in wide for c in moved(df) if "content" in c]
