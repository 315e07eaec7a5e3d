import random
from collections import Counter, defaultdict

import duckdb
import pytest
from newsgraph.llm import divergence
from newsgraph.llm.queries import QUERIES
from shared import SCHEMA, same

COLS = ["lang", "source", "part", "item", "value", "rank"]


def letters(text):
    out, run = [], ""
    for c in text or "":
        if "A" <= c <= "Z":
            c = chr(ord(c) + 32)
        if "a" <= c <= "z" or ord(c) > 127:
            run += c
        elif run:
            out.append(run)
            run = ""
    return out + [run] * bool(run)


def brute(rows, min_docs=3, top=200):
    """The audit in Python integers; ``rows``: (lang, source, text)."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source, found = lang or "", source or "", letters(text)
        groups[lang].add(source)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        share = lambda c, n: {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}
        own = {s: share(counts[lang, s], sum(counts[lang, s][t] for t in kept)) for s in sources}
        whole = sum((counts[lang, s] for s in sources), Counter())
        q = share(whole, sum(whole[t] for t in kept))
        for s in sources:
            pair = [(sum((own[s][t] - own[o][t]) ** 2 // own[o][t] for t in kept), o) for o in sources if o != s]
            term = [((own[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and own[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (v, i) in enumerate(found) if part == "pair" or k < top]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, s, None, 1, "x", "y", 0.5, 3, "z") for i, (g, s, t) in enumerate(rows)], SCHEMA).repartition(4)


def odd_rows():
    rng = random.Random(4)
    words = ["Straße", "straße", "über", "a", "ab", "abc", "zé", "日本", "日本語", "x1y", "it's", "ABC", "Zebra", "𝒳", "nu\x00ll", "ÀB"] + [f"w{chr(97 + i)}{chr(97 + i * 7 % 26)}" for i in range(26)]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None, "S1"]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for _ in range(80)]
    rows += [("fr", "only", "one two three")] + [("it", s, None) for s in ("p", "q")] + [("pt", "", ""), ("pt", None, "12 34 !!")]
    rows += [("en", "long", " ".join(rng.choice(words) for _ in range(30_000))), ("en", "long", "x" * 5000), ("en", "s1", "x" * 5000), ("en", "s2", "x" * 5000)]
    return rows + [rows[0]] * 3


def test_query(spark):
    path = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT lang, source, text FROM '{path}/documents.parquet'").fetchall()
    same(QUERIES["op12_divergence"](spark, path), COLS, brute(rows))


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "shard_terms": 7, "cells": 1}, {"shard_terms": 5}])
def test_odd_rows(spark, options):
    """Texts through broadcast transducers, and counted terms sent to the transducers."""
    rows = odd_rows()
    same(divergence.audit(frame(spark, rows), **options), COLS, brute(rows))


def test_blocks(spark, monkeypatch):
    rng = random.Random(9)
    rows = [("en", f"s{i % 3}", " ".join("".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(400))) for i in range(30)]
    want = brute(rows, top=4)
    assert len({r[3] for r in want if r[2] == "term"}) > 4
    monkeypatch.setattr(divergence, "max", lambda *a, **k: 50 if a[0] == 1024 else max(*a, **k), raising=False)
    same(divergence.audit(frame(spark, rows), top=4, cells=1), COLS, want)


def test_empty(spark):
    assert divergence.audit(frame(spark, [])).collect() == []
    same(divergence.audit(frame(spark, [(None, None, None), ("", "b", "")])), COLS, [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)])


@pytest.mark.parametrize("seed", range(4))
def test_transducer(seed):
    rng = random.Random(seed)
    terms = sorted({bytes(rng.choice(b"ab\xc3\xff") for _ in range(rng.randint(1, 7))) for _ in range(600)})
    t = divergence.Transducer.unpack(divergence.Transducer.build(terms).pack())
    asked = [bytes(rng.choice(b"ab\xc3\xff") for _ in range(rng.randint(1, 9))) for _ in range(3000)] + terms
    assert t.ordinals(asked).tolist() == [terms.index(x) if x in terms else -1 for x in asked]
    # minimal: as many states as there are different sets of endings
    ends = {frozenset(x[len(p):] for x in terms if x.startswith(p)) for x in terms for p in (x[:i] for i in range(len(x) + 1))}
    assert len(t.final) == len(ends)
    assert divergence.Transducer.build([]).ordinals([b"a"]).tolist() == [-1]
