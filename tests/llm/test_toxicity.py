import random

import pytest
from newsgraph.llm import toxicity
from newsgraph.llm.queries import QUERIES
from pyspark.sql import functions as F


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_rare_and_many_terms():
    common = [(f"mild{i:04d}x", 0, 300) for i in range(1500)]
    got = {t for t, _ in toxicity.choose([*common, ("rareword", 0, 19), ("chance", 19, 19), ("once", 0, 3)], 12_000, 4000)}
    assert got == {t for t, *_ in common} | {"rareword"}


def test_automaton_against_distances():
    rng = random.Random(2)
    word = lambda lo, hi: "".join(rng.choice("abc") for _ in range(rng.randint(lo, hi)))
    terms = sorted({(word(3, 8), rng.random() < 0.5) for _ in range(12)})
    lex = toxicity.Lexicon(terms)
    for _ in range(3000):
        w = word(1, 11)
        best = 9
        for t, whole in terms:
            most = int(len(t) >= toxicity.FUZZY_FROM)
            for p in [w] if whole else [w[:k] for k in range(len(w) + 1)]:
                d = distance(p, t)
                if d <= most:
                    best = min(best, d)
        assert lex.edits(w) == best, (w, terms)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op4_toxicity"](spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    hits = sum(r["toxic"] == 1 and r["predicted"] == 1 for r in rows)
    said, true = sum(r["predicted"] for r in rows), sum(r["toxic"] for r in rows)
    assert hits / true >= 0.9 and hits / said >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(400):
        words = ["".join(rng.choice("aeioumnrst") for _ in range(rng.randint(4, 9))) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randint(0, 29)] = rng.choice(["blockhead", "vermin"])
        elif i % 4 == 1:
            words[10:13] = ["he", "said", '"blockhead"']
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    d = spark.createDataFrame([(i, t, "x", "y", 0.1, "h") for i, t in docs], "doc_id long, text string, toxic string, predicted string, score double, held_out string")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quotation_misspelling_and_odd_rows(spark, corpus):
    docs, labels = corpus
    probes = [(None, None), (None, ""), (1000, ""), (1001, "  \n"), (1002, "you are a blockhead all of you"), (1003, "you are a blokhead all"),
              (1004, 'and he said "blockhead" to them'), (1005, "plain words only here"), (1006, "w " * 200_000 + "vermin"), (1002, "you are a blockhead all of you")]
    d, lab = frames(spark, docs + probes, [*labels, (5, 1, None), (None, 1, 1), (8, 1, 0)])
    rows = toxicity.toxicity(d, lab).collect()
    assert len(rows) == len(docs) + len(probes)
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    assert [r["predicted"] for r in got[1002]] == [1, 1]
    assert got[1004][0]["predicted"] == 0 and got[1004][0]["score"] < got[1002][0]["score"]
    model = toxicity.train(d, lab)
    assert model.lexicon.edits("blokhead") == 1 and model.lexicon.features("a blokhead")[2] > 0
    assert all(got[i][0]["predicted"] == 0 for i in (1000, 1001, 1005))
    assert all(r["held_out"] is False for r in got[None])
    kept = toxicity.without_toxic(d, lab)
    assert kept.columns == d.columns and kept.where("doc_id = 1002").count() == 0 and kept.where(F.col("text").isNull()).count() == 1


def test_held_out_labels_are_not_read(spark, corpus):
    docs, labels = corpus
    d, lab = frames(spark, docs, labels)
    flipped = lab.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    a, b = toxicity.train(d, lab), toxicity.train(d, flipped)
    assert a.lexicon.terms == b.lexicon.terms and (abs(a.weights - b.weights) < 1e-9).all()


def test_empty_and_one_sided(spark, corpus):
    docs, labels = corpus
    d, lab = frames(spark, docs, labels)
    none, no_labels = frames(spark, [], [])
    assert toxicity.toxicity(none, lab).collect() == []
    assert {r["predicted"] for r in toxicity.toxicity(d, no_labels).collect()} == {0}
    assert {r["predicted"] for r in toxicity.toxicity(d, lab.withColumn("toxic", F.lit(1))).collect()} == {1}


def test_a_common_word_of_rare_toxic_rows(spark):
    """60 toxic and 6,000 clean rows; a term in 40 of the toxic and 60 of the clean ones is 67 times as frequent there."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioumnrst") for _ in range(6))
    docs, labels, told = [], [], 0
    for i in range(8000):
        text, toxic = [word() for _ in range(12)], int(i % 100 == 0)
        if toxic and told % 3 != 2 or not toxic and i % 99 == 0:
            text[3] = "blockhead"
        told += toxic
        docs.append((i, " ".join(text)))
        labels.append((i, 1, toxic))
    d, lab = frames(spark, docs, labels)
    model = toxicity.train(d, lab)
    assert ("blockhead", True) in model.lexicon.terms or ("blockhead", False) in model.lexicon.terms
    assert model.score("one two blockhead four") > 5 * model.score("one two three four")


def test_repeated_ids_train_with_one_point(spark, corpus):
    """Many rows of one labelled id do not outweigh the others, and none is cut."""
    docs, labels = corpus
    copies = [(1, f"{docs[1][1]} extra{i}") for i in range(2000)]
    once, often = toxicity.train(*frames(spark, docs, labels)), toxicity.train(*frames(spark, docs + copies, labels))
    assert abs(once.score("you are a blockhead all of you") - often.score("you are a blockhead all of you")) < 0.1
    few = toxicity.train(*frames(spark, docs + copies, labels), train_rows=50)
    assert 0 <= few.score("x") <= 1


def test_score_worked_out_apart(spark, corpus):
    """Features and score of texts from the lexicon and weights alone, in plain Python."""
    docs, labels = corpus
    model = toxicity.train(*frames(spark, docs, labels))
    for text in [docs[0][1], docs[1][1], docs[2][1], "", None]:
        x = model.lexicon.features(text)
        z = sum(w * v for w, v in zip(model.weights, [*x, 1.0], strict=True))
        assert abs(model.score(text) - 1 / (1 + 2.718281828459045 ** -z)) < 1e-9
        assert len(x) == len(toxicity.FEATURES) and (text or not any(x[:2]))
