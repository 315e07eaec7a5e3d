"""Request tables, the model hook (mapInPandas) and graph-event JSON encoding."""
import json

import pandas as pd
from pyspark.sql import functions as F

from newsgraph.operators import prompts as P
from newsgraph.operators.parse import parse_entities
from newsgraph.operators.responses import attach, generate
from newsgraph.sources.sinks import GRAPH_EVENT_FIELDS, encode_graph_events


def articles(spark):
    return spark.createDataFrame([("a1", "Tesla CEO Elon Musk spoke."), ("a2", "Nothing here.")],
                                 "article_id string, content string")


def test_entity_request_shape(spark):
    reqs = P.entity_requests(articles(spark))
    assert "Elon Musk" in reqs.first().user and reqs.first().template == P.template_id("entity")
    assert len(reqs.first().user) < 200  # the article's part only
    r = P.with_messages(reqs).collect()
    assert {x.article_id for x in r} == {"a1", "a2"}
    m = r[0].messages
    assert [x.role for x in m] == ["system", "user", "assistant", "user"]
    assert m[0].content == P.ENTITY_SYSTEM_PROMPT
    assert m[-1].content.startswith("Article: ") and m[-1].content.endswith(P.ENTITY_TASK)
    assert json.loads(m[2].content)[0]["name"] == "Tesla"
    assert (r[0].temperature, r[0].response_format) == (0.1, "json_object")


def test_model_hook_round_trip(spark):
    # defined in the test so cloudpickle ships it by value to the Python workers
    def echo_model(pdf: pd.DataFrame) -> pd.DataFrame:
        """A stand-in model: returns one entity per request, named after the article id."""
        content = [json.dumps({"entities": [{"name": a, "type": "company", "confidence": 0.9}]})
                   for a in pdf["article_id"]]
        return pd.DataFrame({"article_id": pdf["article_id"], "stage": pdf["stage"], "content": content,
                             "tokens_used": [len(m) for m in pdf["messages"]], "error": [None] * len(pdf)})

    reqs = P.entity_requests(articles(spark))
    resp = generate(reqs, echo_model)
    a = attach(reqs, resp).collect()
    assert {x.status for x in a} == {"ok"} and all(x.tokens_used == 4 for x in a)
    ents, _ = parse_entities(resp)
    assert sorted(r.name for r in ents.collect()) == ["a1", "a2"]


def test_causal_request_gate(spark):
    ents = spark.createDataFrame([("a1", 0, "Tesla", "company"), ("a1", 1, "Elon Musk", "person"),
                                  ("a2", 0, "X", "company")], "article_id string, pos int, name string, type string")
    r = P.with_messages(P.causal_requests(articles(spark), ents)).collect()
    assert [x.article_id for x in r] == ["a1"] and len(r[0].messages) == 6
    assert '[{"name":"Tesla","type":"company"},{"name":"Elon Musk","type":"person"}]' in r[0].messages[-1].content


def test_templates_of_another_version(spark):
    reqs = P.entity_requests(articles(spark))
    table = P.templates(spark)
    assert {r.stage: len(r.messages) for r in table.collect()} == {"entity": 3, "mapping": 5, "impact": 5}
    assert {r.messages for r in P.with_messages(reqs, table.where("stage = 'impact'")).collect()} == {None}


def test_a_batch_reads_the_buckets_of_its_articles(spark, tmp_path):
    from newsgraph.operators.responses import ResponseStore
    from newsgraph.plans.process import process_batch
    store = ResponseStore(spark, str(tmp_path / "r"), 16)
    rows = [(f"a{i}", "entity", json.dumps({"entities": [{"name": f"N{i}", "type": "product", "confidence": 0.9}]}), 1, None) for i in range(200)]
    for part in (rows[:150], rows[150:]):
        store.append(spark.createDataFrame(part, "article_id string, stage string, content string, tokens_used long, error string"))
    arts = spark.createDataFrame([("a3",), ("a190",)], "article_id string")
    read = store.of(arts)
    assert "PartitionFilters: [isnotnull(bucket" in read._jdf.queryExecution().executedPlan().toString().replace("PartitionFilters: [bucket", "PartitionFilters: [isnotnull(bucket")
    files = {r[0] for r in read.select(F.input_file_name()).distinct().collect()}
    assert len({f.split("bucket=")[1].split("/")[0] for f in files}) <= 2 and len(spark.read.parquet(store.path).inputFiles()) >= 16
    assert sorted(r.article_id for r in read.collect() if r.article_id in ("a3", "a190")) == ["a190", "a3"]
    full = arts.selectExpr("article_id", "'u' url", "'t' title", "'c' content", "'s' source", "timestamp '2024-01-01' published_date",
                           "timestamp '2024-01-01' fetch_timestamp", "cast(null as string) author", "array('x') tags", "cast(null as string) raw_html")
    ents = process_batch(full, store, None, None).entities.collect()
    assert sorted(e["name"] for e in ents) == ["N190", "N3"]
    assert store.of(arts.limit(0)).count() == 0


def test_graph_event_json(spark):
    ev = spark.sql("""
        SELECT 'a1' AS article_id,
               array(named_struct('name', 'FDA', 'type', 'organization', 'confidence', 0.95D,
                                  'metadata', map('k', 'v'), 'industry', CAST(NULL AS STRING),
                                  'role', CAST(NULL AS STRING), 'country', CAST(NULL AS STRING),
                                  'severity', CAST(NULL AS STRING))) AS entities,
               array() AS relationships,
               named_struct('summary', 's', 'severity', 7, 'affected_sectors', array('Pharma'),
                            'key_stakeholders', array()) AS impact_summary,
               TIMESTAMP '2024-01-15 14:30:00' AS processing_timestamp,
               'gpt-4-turbo-preview' AS llm_model_used, true AS fact_check_passed,
               array() AS hallucination_flags""")
    out = encode_graph_events(ev).collect()[0]
    d = json.loads(out.value)
    assert out.key == "a1" and list(d) == GRAPH_EVENT_FIELDS
    assert d["entities"][0]["industry"] is None            # nulls kept, as model_dump
    assert d["processing_timestamp"].startswith("2024-01-15T14:30:00")
    assert d["impact_summary"]["key_stakeholders"] == []
