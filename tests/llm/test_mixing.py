import hashlib
import random
from collections import Counter, defaultdict
from fractions import Fraction

from newsgraph.llm import mixing
from newsgraph.llm.queries import QUERIES
from oracle_check import compare, duck
from pyspark.sql import functions as F
from shared import same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, epoch string, n_tokens string, _key string"
LEVELS = {"language": "lang", "origin": "source"}
WEIGHTS = {"language": {"en": 3, "de": 2}, "origin": {"a": 5}}


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def rounds(budget, caps, weights):
    """Share among capped children, in rounds of proportional dealing."""
    got, open_ = dict.fromkeys(caps, Fraction(0)), set(caps)
    left = Fraction(budget)
    while open_ and left > 0:
        w = sum(weights[c] for c in open_)
        full = {c for c in open_ if got[c] + left * weights[c] / w >= caps[c]}
        if not full:
            for c in open_:
                got[c] += left * weights[c] / w
            break
        c = min(full, key=lambda c: Fraction(caps[c] - got[c], weights[c]))
        step = (caps[c] - got[c]) / weights[c]
        for x in open_:
            got[x] += step * weights[x]
        left -= step * w
        open_ -= {x for x in open_ if got[x] >= caps[x]}
    return got


def brute(docs, budgets, seed=17):
    out = []
    leaves = defaultdict(list)
    for d, t, g, s in docs:
        leaves[g or "", s or ""].append((d, t, len((t or "").split())))
    for leaf, rows in leaves.items():
        total, budget = sum(r[2] for r in rows), budgets[leaf]
        whole = budget // total if total else 0
        rest = budget - whole * total
        ident = lambda d, t: md5(("" if d is None else str(d)) + ":" + md5(t or ""))
        keyed = sorted((md5(f"{seed}:{whole}:{ident(d, t)}"), d, n) for d, t, n in rows)
        for d, _, n in rows:
            out += [(d, *leaf, n, e + 1) for e in range(whole)]
        if rest > 0 or not whole:
            for k, d, n in keyed:
                if sum(x[2] for x in keyed if x[0] <= k) <= rest:
                    out.append((d, *leaf, n, whole + 1))
    return out


def sample(n=260):
    rng = random.Random(4)
    docs = []
    for i in range(n):
        source = rng.choice("aaaaaabcd")
        docs.append((i, "w " * rng.randint(0, 40), rng.choice(["en", "en", "en", "de", "fr", None]), source))
    return docs + [(None, None, None, None), (7, "", "en", "z"), (7, "", "en", "z"), (1, "x " * 5000, "xx", "long"), (3, "same", "de", "b"), (3, "same", "de", "b")]


def frame(spark, docs):
    return spark.createDataFrame([(d, t, g, s, 1, "e", "n", "k") for d, t, g, s in docs], SCHEMA).repartition(4)


def test_query(spark):
    con = duck("/root/testdata/sf0.001")
    from newsgraph.llm.oracle import SQL
    assert compare(spark, "/root/testdata/sf0.001", "op3_mixing", QUERIES["op3_mixing"], SQL["op3_mixing"], con, verbose=False)


def test_budgets_and_prefixes(spark):
    docs = sample()
    for share, epochs in (((4, 5), 2), ((1, 7), 1), ((5, 2), 3), ((9, 1), 2)):
        tokens = Counter()
        for _, t, g, s in docs:
            tokens[g or "", s or ""] += len((t or "").split())
        leaves = spark.createDataFrame([(*k, v) for k, v in tokens.items()], "language string, origin string, tokens long")
        got = {(r["language"], r["origin"]): r["budget"] for r in mixing.budgets(leaves, list(LEVELS), WEIGHTS, share, epochs).collect()}
        total = sum(tokens.values())
        want = min(total * share[0] // share[1], total * epochs)
        assert sum(got.values()) == want
        caps = {k: v * epochs for k, v in tokens.items()}
        langs = Counter()
        for (g, _), c in caps.items():
            langs[g] += c
        top = rounds(want, langs, {g: WEIGHTS["language"].get(g, 1) for g in langs})
        for g in langs:
            own = {k: c for k, c in caps.items() if k[0] == g}
            assert abs(sum(got[k] for k in own) - top[g]) <= 1
            below = rounds(sum(got[k] for k in own), own, {k: WEIGHTS["origin"].get(k[1], 1) for k in own})
            assert all(abs(got[k] - below[k]) <= 1 and got[k] <= own[k] for k in own)
        df = mixing.mix(frame(spark, docs), LEVELS, WEIGHTS, share, epochs)
        assert {"text", "_key", "epoch"} <= set(df.columns) and dict(df.dtypes)["epoch"] == "int"
        same(df, ["doc_id", "language", "origin", "n_tokens", "epoch"], brute(docs, got))


def test_shuffled_plan_and_empty(spark, monkeypatch):
    docs = sample(80)
    cols = ["doc_id", "language", "origin", "n_tokens", "epoch"]
    want = [tuple(r) for r in mixing.mix(frame(spark, docs), LEVELS, WEIGHTS).select(*cols).collect()]
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 0)
    same(mixing.mix(frame(spark, docs), LEVELS, WEIGHTS), cols, want)
    assert mixing.mix(frame(spark, []), LEVELS, WEIGHTS).collect() == []


def test_native(spark):
    plan = mixing.mix(spark.range(3).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("en").alias("lang"), F.lit("s1").alias("source")))
    text = plan._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text
