"""Root shapes and element rules (2.14 B) of the response parsers."""
import json

import pytest
from pyspark.sql import functions as F

from newsgraph.operators import parse

E = {"name": "Tesla", "type": "company", "confidence": 0.9, "metadata": {"industry": "EV"}}
REL = {"subject": {"name": "A", "type": "company", "confidence": 0.9}, "action": "acquires",
       "object": {"name": "B", "type": "company", "confidence": 0.8, "industry": "X"},
       "sentiment": 0.5, "confidence": 0.8, "reasoning": "r"}


def resp(spark, stage, contents):
    data = [(str(i), stage, c, 10, None) for i, c in enumerate(contents)]
    return spark.createDataFrame(data, "article_id string, stage string, content string, tokens_used bigint, error string")


def n_entities(spark, content):
    ents, _ = parse.parse_entities(resp(spark, "entity", [content]))
    return ents.count()


@pytest.mark.parametrize("content,expected", [
    (json.dumps([E, E]), 2),                         # bare array
    (json.dumps({"entities": [E]}), 1),              # wrapped
    (json.dumps(E), 0),                              # lone object: keys are iterated, all fail
    (json.dumps({"entities": None}), 0),
    (json.dumps({"entities": 5}), 0),
    (json.dumps({"entities": {"a": 1}}), 0),
    (json.dumps({"entities": "abc"}), 0),
    ('"text"', 0), ("null", 0), ("not json", 0),
    (json.dumps([E]) + " trailing", 0),             # trailing junk is bad JSON (as Python)
])
def test_entity_root_shapes(spark, content, expected):
    assert n_entities(spark, content) == expected


@pytest.mark.parametrize("content,expected", [
    (json.dumps([REL]), 1), (json.dumps({"relationships": [REL, REL]}), 2),
    (json.dumps(REL), 1),                            # lone object is wrapped
    (json.dumps({"relationships": None}), 0), (json.dumps({"relationships": "x"}), 0),
    ("not json", 0), ("3", 0),
])
def test_relationship_root_shapes(spark, content, expected):
    rels, _ = parse.parse_relationships(resp(spark, "mapping", [content]))
    assert rels.count() == expected


def one_entity(spark, **over):
    e = dict(E)
    for k, v in over.items():
        if v is KeyError:
            e.pop(k, None)
        else:
            e[k] = v
    ents, q = parse.parse_entities(resp(spark, "entity", [json.dumps([e])]))
    got = ents.collect()
    return got[0] if got else None, [r.reason for r in q.collect()]


def test_entity_element_rules(spark):
    assert one_entity(spark, confidence="0.9")[0].confidence == 0.9      # numeric text accepted
    assert one_entity(spark, confidence=True)[0].confidence == 1.0
    assert one_entity(spark, confidence=1.7)[1] == ["confidence"]
    assert one_entity(spark, confidence="x")[1] == ["confidence"]
    assert one_entity(spark, name=5)[1] == ["name"]                       # no int -> str coercion
    assert one_entity(spark, metadata=None)[1] == ["metadata"]
    assert one_entity(spark, metadata="m")[1] == ["metadata"]
    e, _ = one_entity(spark, metadata=KeyError)                            # absent -> {}
    assert e.metadata == {} and e.industry is None
    assert one_entity(spark, metadata={"severity": "huge"})[1] == ["severity_value"]
    assert one_entity(spark, metadata={"industry": 5})[1] == ["industry"]
    e, _ = one_entity(spark, industry="top-level ignored", metadata={"role": "CEO", "n": {"a": 1}})
    assert e.industry is None and e.role == "CEO" and e.metadata["n"] == '{"a":1}'


def test_relationship_rules(spark):
    def parse_one(**over):
        r = json.loads(json.dumps(REL))
        r.update(over)
        rels, q = parse.parse_relationships(resp(spark, "mapping", [json.dumps([r])]))
        got = rels.collect()
        return got[0] if got else None, [x.reason for x in q.collect()]
    r, _ = parse_one()
    assert r.action == "ACQUIRES" and r.object.industry == "X" and r.subject.metadata == {}
    assert parse_one(sentiment=-1.5)[1] == ["sentiment"]
    assert parse_one(action=7)[1] == ["action"]
    assert parse_one(subject={"name": "A", "type": "company"})[1] == ["subject.confidence"]
    assert parse_one(subject={"name": "A", "type": "c", "confidence": 1, "metadata": None})[1] \
        == ["subject.metadata"]
    assert parse_one(reasoning=None)[1] == ["reasoning"]
    r, _ = parse_one(action="straße")
    assert r.action == "STRASSE"                      # upper() as Python


def test_duplicate_keys_last_wins(spark):
    ents, _ = parse.parse_entities(resp(spark, "entity", [
        '[{"name": "a", "name": "b", "type": "t", "confidence": 0.8}]']))
    assert [r.name for r in ents.collect()] == ["b"]


IMP = {"summary": "s", "severity": 7, "affected_sectors": ["X"]}


@pytest.mark.parametrize("content,status,summary,severity", [
    (json.dumps(IMP), "ok", "s", 7),
    (json.dumps({**IMP, "severity": "7"}), "ok", "s", 7),
    (json.dumps({**IMP, "severity": 7.5}), "severity", parse.FALLBACK_ERROR, 1),
    (json.dumps({**IMP, "severity": 11}), "severity_range", parse.FALLBACK_ERROR, 1),
    (json.dumps({**IMP, "summary": "x" * 501}), "summary_length", parse.FALLBACK_ERROR, 1),
    (json.dumps({**IMP, "key_stakeholders": None}), "key_stakeholders", parse.FALLBACK_ERROR, 1),
    (json.dumps({"summary": "s", "severity": 2}), "affected_sectors", parse.FALLBACK_ERROR, 1),
    (json.dumps([IMP]), "not_object", parse.FALLBACK_ERROR, 1),
    ("{bad", "bad_json", parse.FALLBACK_BAD_JSON, 1),
])
def test_impact(spark, content, status, summary, severity):
    r = parse.parse_impacts(resp(spark, "impact", [content])).collect()[0]
    assert (r.status, r.summary, r.severity) == (status, summary, severity)
    if status == "ok":
        assert r.key_stakeholders == [] and r.affected_sectors == ["X"]
    else:
        assert r.affected_sectors == ["Unknown"]


def test_impact_missing_response(spark):
    arts = spark.createDataFrame([("9",)], "article_id string")
    r = parse.parse_impacts(resp(spark, "impact", [json.dumps(IMP)]), arts).collect()[0]
    assert r.status == "missing" and r.summary == parse.FALLBACK_ERROR


def test_golden_few_shot_entities(spark):
    from newsgraph.operators.prompts import ENTITY_EXAMPLES
    ents, q = parse.parse_entities(resp(spark, "entity", [json.dumps(ENTITY_EXAMPLES[0]["entities"])]))
    got = {r.name: r for r in ents.collect()}
    assert len(got) == 6 and q.count() == 0
    assert got["Tesla"].industry == "Electric Vehicles" and got["Elon Musk"].role == "CEO of Tesla"
    assert got["Gigafactory Investment"].severity == "high"


def test_rejected_rows_come_from_one_read(spark):
    """The quarantine reads the responses once: the plan of both halves has one scan and one parse."""
    got = resp(spark, "mapping", [json.dumps([REL, 5]), "not json", json.dumps({"relationships": 3}), json.dumps([])])
    _, q = parse.parse_relationships(got)
    assert {(r.article_id, r.pos, r.raw, r.reason) for r in q.collect()} == {
        ("0", 1, "5", "not_object"), ("1", None, "not json", "bad_json"),
        ("2", None, '{"relationships": 3}', "relationships_not_list")}
    for stage, read in (("entity", parse.parse_entities), ("mapping", parse.parse_relationships)):
        for half in read(resp(spark, stage, [json.dumps([E, REL])])):
            plan = half._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
            assert plan.count("parse_json") + plan.count("parseJson") == 1
