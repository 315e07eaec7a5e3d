"""Texts and mentions meet once: rows of one id are one document, whatever batches they come in."""

import pyarrow as pa

from newsgraph.operators.relations import _relations, lexicon_relations
from newsgraph.operators.tagging import Phrases, tag_mentions

VERBS = Phrases([("buys", "BUYS", 0.5)])
NAMES = ["id", "pos", "s", "st", "sc", "o", "ot", "oc", "action", "sentiment", "reasoning"]


def _rows(docs):
    rows = []
    for i, text in docs:
        rows.append((i, text, None, None, None, None, None))
        rows += [(i, None, text.index(n), text.index(n) + len(n), n, "company", 0.75) for n in ("Acme Inc.", "Beta") if n in text]
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["id", "text", "s", "e", "n", "t", "c"])


def test_documents_over_batches():
    b = _rows([(k, "Acme Inc. buys Beta. Nothing else") for k in range(5)] + [(9, "Beta buys")])
    whole = [r for x in _relations(VERBS, NAMES, [b]) for r in x.to_pylist()]
    assert [(r["id"], r["pos"], r["s"], r["o"], r["reasoning"]) for r in whole] == [(k, 0, "Acme Inc.", "Beta", "Acme Inc. buys Beta.") for k in range(5)]
    for size in (1, 2, 4):
        parts = [b.slice(k, size) for k in range(0, b.num_rows, size)]
        assert [r for x in _relations(VERBS, NAMES, parts) for r in x.to_pylist()] == whole


def test_one_shuffle_and_repeated_ids(spark):
    d = spark.createDataFrame([(1, "Acme buys Beta."), (1, "Acme buys Beta."), (2, None), (3, "Beta buys Acme"), (None, "Acme buys Beta")], "doc_id long, text string")
    gaz = spark.createDataFrame([("acme", "ORG"), ("beta", "GPE")], "phrase string, label string")
    lex = spark.createDataFrame([("buys", "buys", 0.5)], "verb string, action string, sentiment double")
    r = lexicon_relations(d, tag_mentions(d, gaz, "doc_id", "text"), lex, "doc_id", "text")
    got = sorted((x["doc_id"] or 0, x["pos"], x["subject"]["name"], x["action"], x["object"]["name"], x["reasoning"]) for x in r.collect())
    assert got == [(0, 0, "Acme", "BUYS", "Beta", "Acme buys Beta"), (1, 0, "Acme", "BUYS", "Beta", "Acme buys Beta."),
                   (1, 1, "Acme", "BUYS", "Beta", "Acme buys Beta."), (3, 0, "Beta", "BUYS", "Acme", "Beta buys Acme")]
    plan = r._jdf.queryExecution().optimizedPlan().toString()
    # the mentions are tagged once, and neither windows nor a second shuffle follow
    assert plan.count("MapInArrow") == 2 and "Window" not in plan
