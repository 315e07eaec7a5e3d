"""Fact-check verdicts, routing, metadata merge and flags."""
from pyspark.sql import functions as F

from newsgraph.operators import factcheck as fc

CAND = "name string, type string, rank int, wikidata_id string, label string, description string"


def wiki(spark, rows):
    return {r.name: r for r in fc.wiki_verdict(spark.createDataFrame(rows, CAND)).collect()}


def test_wiki_first_hit_in_rank_order(spark):
    v = wiki(spark, [
        # fuzzy at rank 1 beats exact at rank 2
        ("Paris", "location", 1, "Q1", "par", "x", ), ("Paris", "location", 2, "Q2", "Paris", "capital"),
        # type word in description
        ("Bob", "person", 1, "Q3", "Robert", "a person from x"),
        # exact at rank 5 still visible, exact only at rank 6 is not
        ("Lyon", "location", 1, "Q4", "zzz", "city"), ("Lyon", "location", 5, "Q5", "lyon", "d5"),
        ("Nice", "location", 1, "Q6", "zzz", "city"), ("Nice", "location", 6, "Q7", "Nice", "d"),
        # empty label is contained in any name: fuzzy
        ("Oslo", "location", 1, "Q8", "", "city"),
        # no candidate
        ("Nowhere", "location", None, None, None, None),
    ])
    assert (v["Paris"].validated, v["Paris"].v_confidence, v["Paris"].v_metadata) == \
        (True, 0.80, {"fuzzy_match": "true"})
    assert v["Bob"].v_confidence == 0.80
    assert v["Lyon"].v_confidence == 0.92 and v["Lyon"].v_metadata == {"wikidata_id": "Q5", "description": "d5"}
    assert (v["Nice"].validated, v["Nice"].reason) == (False, "not_found")
    assert v["Oslo"].v_confidence == 0.80
    assert (v["Nowhere"].validated, v["Nowhere"].reason) == (False, "not_found")


def test_company_exact_wins_anywhere_in_top5(spark):
    rows = [("Tesla", 1, "k1", "Tesla Energy", "p1", "d1"), ("Tesla", 4, "k4", "TESLA", "p4", None),
            ("Acme", 1, "k9", "Acme Holdings", "p9", "d9"),
            ("Ghost", None, None, None, None, None)]
    c = spark.createDataFrame(rows, "name string, rank int, kb_id string, cand_name string, "
                                    "permalink string, short_description string")
    v = {r.name: r for r in fc.company_verdict(c).collect()}
    assert v["Tesla"].v_confidence == 0.95
    assert v["Tesla"].v_metadata == {"crunchbase_uuid": "k4", "permalink": "p4", "short_description": ""}
    assert (v["Acme"].v_confidence, v["Acme"].v_metadata) == (0.75, {"partial_match": "true"})
    assert (v["Ghost"].validated, v["Ghost"].reason) == (False, "not_found")


ENT = "article_id string, pos int, name string, type string, confidence double, " \
      "metadata map<string,string>, industry string, role string, country string, severity string"


def sample(spark):
    # the reference's fact-check sample, plus a skipped type and a repeated entity
    return spark.createDataFrame([
        ("a", 0, "Tesla", "company", 0.9, {}, None, None, None, None),
        ("a", 1, "FakeCompanyCorp", "company", 0.85, {}, None, None, None, None),
        ("a", 2, "Elon Musk", "person", 0.95, {"role": "CEO"}, None, "CEO", None, None),
        ("a", 3, "Austin", "location", 0.90, {}, None, None, None, None),
        ("a", 4, "Model Y", "product", 0.72, {"k": "v"}, None, None, None, None),
        ("a", 5, "FakeCompanyCorp", "company", 0.80, {}, None, None, None, None),
    ], ENT)


def kbs(spark):
    company = spark.createDataFrame(
        [("c1", "Tesla, Inc.", [], "tesla", "EV maker", 10, "en"), ("c2", "Tesla", ["TSLA"], "tesla-2", None, 5, "en")],
        "kb_id string, name string, aliases array<string>, permalink string, short_description string, "
        "popularity bigint, language string")
    wiki_kb = spark.createDataFrame(
        [("Q1", "Elon Musk", [], "businessman", 9, "en"), ("Q2", "Austin", [], "city in Texas", 8, "en"),
         ("Q3", "Austin", [], "Stadt", 99, "de")],
        "wikidata_id string, label string, aliases array<string>, description string, popularity bigint, language string")
    return company, wiki_kb


def test_validate_sample(spark):
    company, wiki_kb = kbs(spark)
    c = {(r.pos): r for r in fc.validate_entities(sample(spark), company, wiki_kb).collect()}
    assert c[0].validated and c[0].confidence == 0.9 and c[0].metadata["crunchbase_uuid"] == "c2"
    assert (c[1].validated, c[1].reason) == (False, "not_found")
    assert c[2].validated and c[2].confidence == 0.92 and c[2].metadata == \
        {"role": "CEO", "wikidata_id": "Q1", "description": "businessman"}
    assert c[3].metadata["wikidata_id"] == "Q2"        # the 'de' row never matches
    assert c[4].validated and c[4].confidence == 0.72 and c[4].metadata == {"k": "v", "skipped": "true"}
    f = fc.flags(fc.validate_entities(sample(spark), company, wiki_kb)).collect()[0]
    assert f.hallucination_flags == ["FakeCompanyCorp (company): not_found"] * 2
    assert f.fact_check_passed is False


def test_no_kb_and_errors(spark):
    company, wiki_kb = kbs(spark)
    v = {r.name: r for r in fc.verdicts(sample(spark), None, wiki_kb).collect()}
    assert v["Tesla"].reason == "no_api_key" and not v["Tesla"].validated
    errs = spark.createDataFrame([("Tesla", "company", "network"), ("Austin", "location", "http_status"),
                                  ("FakeCompanyCorp", "company", "http_status")], "name string, type string, kind string")
    v = {r.name: r for r in fc.verdicts(sample(spark), company, wiki_kb, errs).collect()}
    assert (v["Tesla"].validated, v["Tesla"].reason) == (False, "api_error")
    assert v["Austin"].reason == "api_error" and v["FakeCompanyCorp"].reason == "not_found"


def test_confidence_never_raised(spark):
    company, wiki_kb = kbs(spark)
    c = fc.validate_entities(sample(spark), company, wiki_kb).join(
        sample(spark).select("pos", F.col("confidence").alias("orig")), "pos")
    assert c.filter(F.col("confidence") > F.col("orig")).count() == 0
