"""Properties of the batch plan on the smallest driver tables."""
from pyspark.sql import functions as F

from newsgraph.operators.assemble import flatten_events
from newsgraph.plans import fixtures as fx
from newsgraph.plans import queries as Q
from newsgraph.plans.process import process_batch
from newsgraph.sources.tables import Tables

SF = "/root/testdata/sf0.001"


def test_batch_properties(spark):
    t = Tables(spark, SF)
    res = Q.order_batch(t)
    ev = res.events
    n_orders = t.orders.count()
    # every article exactly once
    assert ev.count() == n_orders == ev.select("article_id").distinct().count()
    # valid + flagged = extracted over the threshold, per article
    per = res.checked.groupBy("article_id").agg(F.count("*").alias("n"))
    chk = ev.join(per, "article_id").select(
        (F.size("entities") + F.size("hallucination_flags") - F.col("n")).alias("d"))
    assert chk.filter("d <> 0").count() == 0
    # passed <=> no flags; severities in range
    assert ev.filter(F.col("fact_check_passed") != (F.size("hallucination_flags") == 0)).count() == 0
    assert ev.filter(~F.col("impact_summary.severity").between(1, 10)).count() == 0


def test_repartitioning_does_not_change_output(spark):
    t = Tables(spark, SF)
    as_of = F.lit(Q.AS_OF).cast("timestamp")
    arts = fx.order_articles(t).drop("file_no")
    resp = fx.responses_fixture(t)
    a = process_batch(arts, resp, fx.company_kb(t), fx.wiki_kb(t), as_of=as_of).events
    b = process_batch(arts.repartition(7), resp.repartition(3, "stage"), fx.company_kb(t).repartition(5),
                      fx.wiki_kb(t), as_of=as_of).events
    assert sorted(flatten_events(a).collect()) == sorted(flatten_events(b).collect())


def test_trace_depth_bounded(spark):
    t = Tables(spark, SF)
    tr = Q.impact_trace(spark, SF)
    assert tr.filter("depth > 3 or depth < 0").count() == 0
    assert tr.filter("depth = 0 and seed <> node").count() == 0


def test_quarantine_tells_missing_from_quiet(spark):
    t = Tables(spark, SF)
    q = Q.order_batch(t).quarantine
    missing = {r.article_id for r in q.filter("stage = 'entity' and reason = 'missing'").collect()}
    exp = {str(r.o_orderkey) for r in t.orders.filter("o_orderkey % 20 = 19").collect()}
    assert missing == exp
