"""Tagging, lexicon relations and impact roll-up against brute force in Python."""
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from newsgraph.operators.impact import rollup_impact
from newsgraph.operators.relations import lexicon_relations, sentence_spans
from newsgraph.operators.tagging import Phrases, normalised, tag_mentions

TEXTS = [
    (1, "Apache License covers Zürich. apache  license, Zürich!"),
    (2, "Ünïcode 😀 Zürich and the general public license is here."),
    (3, ""),
    (4, "General Public License"),
]


def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def test_longest_match_and_offsets(spark):
    gaz = spark.createDataFrame([("apache license", "PRODUCT"), ("license", "ORG"), ("zürich", "GPE"),
                                 ("general public license", "PRODUCT"), ("public license", "EVENT"),
                                 ("here", "NORP")], "phrase string, label string")
    m = tag_mentions(docs(spark), gaz, "doc_id", "text").collect()
    got = sorted((r.doc_id, r.start, r.end, r.name, r.type) for r in m)
    assert got == [
        (1, 0, 14, "Apache License", "product"), (1, 22, 28, "Zürich", "location"),
        (1, 30, 45, "apache  license", "product"), (1, 47, 53, "Zürich", "location"),
        (2, 10, 16, "Zürich", "location"), (2, 25, 47, "general public license", "product"),
        (4, 0, 22, "General Public License", "product")]
    text2 = TEXTS[1][1]
    assert text2[10:16] == "Zürich"


def test_lexicon_relations(spark):
    d = spark.createDataFrame([(1, "Acme is Bolt. Acme with Corp and Bolt. Corp by")],
                              "doc_id long, text string")
    m = spark.createDataFrame([(1, 0, 4, "Acme", "company", 0.75), (1, 8, 12, "Bolt", "company", 0.75),
                               (1, 14, 18, "Acme", "company", 0.75), (1, 24, 28, "Corp", "company", 0.75),
                               (1, 33, 37, "Bolt", "company", 0.75), (1, 39, 43, "Corp", "company", 0.75)],
                              "doc_id long, start int, end int, name string, type string, confidence double")
    lex = spark.createDataFrame([("is", "IS", 0.0), ("with", "WORKS_WITH", 0.3), ("by", "BY", -0.2)],
                                "verb string, action string, sentiment double")
    r = lexicon_relations(d, m, lex, "doc_id", "text").orderBy("pos").collect()
    assert [(x.subject.name, x.action, x.object.name, x.reasoning) for x in r] == [
        ("Acme", "IS", "Bolt", "Acme is Bolt."), ("Acme", "WORKS_WITH", "Corp", "Acme with Corp and Bolt.")]


def test_rollup(spark):
    arts = spark.createDataFrame([("a",), ("b",)], "article_id string")
    ents = spark.createDataFrame([("a", "X", "Tech"), ("a", "Y", None), ("a", "Z", "Auto"), ("b", "Q", None)],
                                 "article_id string, name string, industry string")
    rels = spark.createDataFrame([("a", "X", "Y", -0.9), ("a", "X", "Z", 0.2), ("a", "Z", "Y", 0.1)],
                                 "article_id string, s string, o string, sentiment double") \
        .select("article_id", F.struct(F.col("s").alias("name")).alias("subject"),
                F.struct(F.col("o").alias("name")).alias("object"), "sentiment")
    r = {x.article_id: x for x in rollup_impact(arts, ents, rels).collect()}
    assert r["a"].severity == 1 + 4 + 2 and r["a"].affected_sectors == ["Auto", "Tech"]
    assert r["a"].key_stakeholders == ["Y", "Z"] and r["a"].summary.startswith("3 causal links")
    assert r["b"].severity == 1 and r["b"].key_stakeholders == []


def test_chained_overlaps_and_money(spark):
    gaz = spark.createDataFrame([("aa bb", "ORG"), ("bb cc dd", "ORG"), ("dd ee ff gg", "ORG"), ("million", "ORG"),
                                 ("million pounds", "GPE")], "phrase string, label string")
    d = spark.createDataFrame([(1, "aa bb cc dd ee ff gg"), (2, "$5 million"), (3, "$5 million pounds"), (4, None), (5, "")],
                              "doc_id long, text string")
    m = tag_mentions(d, gaz, "doc_id", "text", money=True).collect()
    got = sorted((r.doc_id, r.start, r.end, r.label) for r in m)
    # "aa bb" overlaps only a span that is itself beaten; of two overlapping spans the longer one stays
    assert got == [(1, 0, 5, "ORG"), (1, 9, 20, "ORG"), (2, 0, 10, "MONEY"), (3, 3, 17, "GPE")]


NAMES = [("AT&T", "ORG"), ("3M", "ORG"), ("Coca-Cola Co", "ORG"), ("S&P 500", "PRODUCT"), ("Acme Corp", "ORG"), ("acme", "PERSON"),
         (".NET", "PRODUCT"), ("C++", "PRODUCT"), ("İzmir", "GPE"), ("ΣΑΣ", "ORG"), ("e\u0301clair", "EVENT"), ("", "ORG"), ("  ", "ORG"), (None, "ORG")]


def brute_mentions(text, names):
    """Every place of every phrase, tried one by one; then the longest first."""
    word = lambda c: c.isalnum() or unicodedata.category(c)[0] == "M"
    found = []
    for phrase, label in names:
        if not phrase or not phrase.strip():
            continue
        want = normalised(phrase).strip(" ")
        for s in range(len(text)):
            for e in range(s + 1, min(len(text), s + 3 * len(phrase) + 3) + 1):
                if text[s] not in " \t" and text[e - 1] not in " \t" and normalised(text[s:e]) == want:
                    if not (s and word(text[s]) and word(text[s - 1])) and not (e < len(text) and word(text[e - 1]) and word(text[e])):
                        found.append((s, e, label))
    kept = []
    for s, e, label in sorted(set(found), key=lambda r: (r[0] - r[1], r[0])):
        if all(e <= a or s >= b or (a, b) == (s, e) for a, b, _ in kept):
            kept.append((s, e, label))
    return sorted(kept)


def texts_with_names():
    rng = random.Random(2)
    parts = ["AT&T", "at&t", "AT&Tx", "3M", "13M", "3m's", "Coca-Cola", "Co", "COCA-COLA\t Co", "S&P", "500", "S&P  500", "5000", "Acme", "acme  corp", "ACME CORP.",
             ".net", "x.NET", "C++", "C+++", "İzmir", "i\u0307zmir", "ΣΑΣ", "σας", "éclair", "e\u0301clair", "e\u0301clairs", "(", ",", "😀", "and"]
    return [(i, "".join(rng.choice(parts) + rng.choice([" ", " ", "  ", "\t", "", "-"]) for _ in range(rng.randint(0, 14)))) for i in range(150)] + [
        (900, None), (901, ""), (902, "AT&T " * 3000)]


@pytest.mark.parametrize("phrase_bytes", [1 << 20, 300])
def test_names_with_digits_and_marks(spark, phrase_bytes):
    """One automaton, and a gazetteer matched in several passes."""
    rows = texts_with_names()
    gaz = spark.createDataFrame(NAMES + [("AT&T", "NORP")], "phrase string, label string")
    m = tag_mentions(spark.createDataFrame(rows, "doc_id long, text string"), gaz, "doc_id", "text", phrase_bytes=phrase_bytes).collect()
    got = sorted((r.doc_id, r.start, r.end, r.label) for r in m)
    exp = sorted((i, s, e, label) for i, t in rows[:-1] for s, e, label in brute_mentions(t or "", NAMES)) + [(902, 5 * k, 5 * k + 4, "ORG") for k in range(3000)]
    assert got == sorted(exp) and len({r[3] for r in got}) == 5
    text = dict(rows)
    assert all(r.name == text[r.doc_id][r.start:r.end] and r.phrase == normalised(r.name) for r in m)


def test_no_phrases(spark):
    gaz = spark.createDataFrame([("x", "NORP")], "phrase string, label string")
    d = spark.createDataFrame([(1, "x costs $5")], "doc_id long, text string")
    assert tag_mentions(d, gaz, "doc_id", "text").collect() == []
    assert [r.name for r in tag_mentions(d, gaz, "doc_id", "text", money=True).collect()] == ["$5"]
    assert list(Phrases([]).find("abc")) == []


@pytest.mark.parametrize("text,sentences", [
    ("Acme Inc. acquired Beta. It paid.", ["Acme Inc. acquired Beta.", "It paid."]),
    ("It is worth $4.2 billion in Beta. Ok", ["It is worth $4.2 billion in Beta.", "Ok"]),
    ("They bought Acme Inc. Beta fell.", ["They bought Acme Inc.", "Beta fell."]),
    ("Dr. J. Smith of the U.S. army met Mr. Doe vs. me!? Yes... no", ["Dr. J. Smith of the U.S. army met Mr. Doe vs. me!?", "Yes...", "no"]),
    ("She is at Yahoo! now. He left Yahoo! Then", ["She is at Yahoo! now.", "He left Yahoo!", "Then"]),
    ("One. two. Three", ["One.", "two.", "Three"]), ("", []), ("...", ["..."]), ("e.g. this etc. and that etc.", ["e.g. this etc. and that etc."])])
def test_sentence_rules(text, sentences):
    mentions = [(m.start(), m.end()) for m in re.finditer(r"Acme Inc\.|Yahoo!|\$4\.2 billion", text)]
    spans = sentence_spans(text, mentions)
    assert [text[a:b].strip(" ") for a, b in spans] == sentences
    assert [a for a, _ in spans[1:]] == [b for _, b in spans[:-1]]


def test_relations_across_abbreviations(spark):
    d = spark.createDataFrame([(1, "Acme Inc. acquired Beta. AT&T paid $4.2 billion for Beta."), (2, None)], "doc_id long, text string")
    gaz = spark.createDataFrame([("acme inc.", "ORG"), ("beta", "ORG"), ("at&t", "ORG")], "phrase string, label string")
    lex = spark.createDataFrame([("acquired", "ACQUIRES", 0.5), ("Paid", "PAYS", -0.1), ("for", "FOR", None)], "verb string, action string, sentiment double")
    r = lexicon_relations(d, tag_mentions(d, gaz, "doc_id", "text", money=True), lex, "doc_id", "text").orderBy("pos").collect()
    assert [(x.subject.name, x.action, x.object.name, x.sentiment) for x in r] == [
        ("Acme Inc.", "ACQUIRES", "Beta", 0.5), ("AT&T", "PAYS", "$4.2 billion", -0.1), ("$4.2 billion", "FOR", "Beta", None)]


def graph_match(ui, article_entities, edges, depth):
    """Every matched (user, article) with its smallest depth and all reasons, pair by pair."""
    from newsgraph.operators.graph import impact_trace, node_key
    ui = ui.select("user_id", "name", node_key(F.col("name")).alias("seed"))
    reach = impact_trace(ui.select("seed").distinct().withColumn("node", F.col("seed")), edges, depth)
    ae = article_entities.select("article_id", node_key(F.col("name")).alias("node")).distinct()
    m = ui.join(reach, "seed").join(ae, "node")
    return m.groupBy("user_id", "article_id").agg(F.min("depth").alias("graph_depth"), F.array_sort(
        F.collect_set(F.concat(F.lit("Follows "), F.col("name")))).alias("match_reasons"))


def feed_inputs(spark):
    rng = random.Random(4)
    ui = spark.createDataFrame([(u, f"N{(u * 3 + j) % 7}") for u in range(6) for j in range(2)] + [(7, "N1"), (8, "none")], "user_id long, name string")
    ae = spark.createDataFrame([(f"a{i}", f"n{(i * i + j) % 9}") for i in range(60) for j in range(2)], "article_id string, name string")
    edges = spark.createDataFrame([(f"n{i}", f"n{(i + 1) % 9}") for i in range(9)], "src string, dst string")
    uv = spark.createDataFrame([(u, [1.0, float(u), 0.5]) for u in range(5)] + [(7, [0.0, 0.0, 0.0])], "user_id long, vec array<double>")
    av = spark.createDataFrame([(f"a{i}", [rng.gauss(0, 1), 1.0, float(i % 4)]) for i in range(55)] + [("a57", None), ("a58", [0.0] * 3)],
                               "article_id string, vec array<double>")
    return ui, ae, edges, uv, av


def test_graph_feed_equals_feed_of_all_pairs(spark):
    from newsgraph.operators.curate import graph_feed, user_feed
    ui, ae, edges, uv, av = feed_inputs(spark)
    at = F.lit("2024-06-01").cast("timestamp")
    for n in (3, 8, 40):  # all users served by depth 0, some, none
        got = graph_feed(ui, ae, edges, uv, av, n, 3, at)
        exp = user_feed(graph_match(ui, ae, edges, 3), uv, av, n, at)
        assert sorted(got.select(exp.columns).collect()) == sorted(exp.collect())
        assert exp.count() > 0


def test_feed_reads_part_of_the_lists(spark):
    """Lists of near vectors: cells whose bound stays below a user's n-th score are not read."""
    from newsgraph.operators.curate import nearest_articles
    rng = random.Random(6)
    centre = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    av = spark.createDataFrame([(f"a{i:04d}", [x + rng.gauss(0, 0.05) for x in centre[i % 12]]) for i in range(1200)], "article_id string, vec array<double>")
    uv = spark.createDataFrame([(u, [x + rng.gauss(0, 0.05) for x in centre[u]]) for u in range(12)], "user_id long, vec array<double>")
    served = spark.createDataFrame([(u, "n0") for u in range(12)], "user_id long, seed string")
    ae = spark.createDataFrame([(f"a{i:04d}", "n0") for i in range(1200)], "article_id string, node string")
    best, reads = nearest_articles(served, ae, uv, av, 10)
    assert best.count() == 120
    read, whole = reads.where("read").agg(F.sum("n_articles")).first()[0], reads.agg(F.sum("n_articles")).first()[0]
    assert whole == 12 * 1200 and read < 0.3 * whole
    assert all(int(r.article_id[1:]) % 12 == r.user_id for r in best.collect())


def test_mentions_leave_a_task_in_small_batches(monkeypatch):
    """A batch of texts is scanned some texts at a time, and gives the same mentions."""
    import pyarrow as pa

    from newsgraph.operators import tagging
    phrases = Phrases([("zürich", "GPE", "location"), ("license", "ORG", "company")])
    fields = pa.schema([pa.field("doc_id", pa.null()), ("start", pa.int32()), ("end", pa.int32()),
                        *[(n, pa.string()) for n in ("name", "phrase", "label", "type")]])
    texts = pa.record_batch({"doc_id": list(range(1000)), "text": ["License in Zürich for $3 million" if i % 3 else None for i in range(1000)]})

    def scan():
        return list(tagging._scan(phrases, True, True, fields, iter([texts])))

    small = scan()
    assert len(small) == 4 and max(b.num_rows for b in small) <= 3 * 256
    monkeypatch.setattr(tagging, "SCAN_ROWS", 10_000)
    assert pa.Table.from_batches(small).to_pylist() == pa.Table.from_batches(scan()).to_pylist()
