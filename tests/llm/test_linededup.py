import hashlib
import random

import pytest
from newsgraph.llm import linededup
from newsgraph.llm.oracle import SQL
from newsgraph.llm.queries import QUERIES
from oracle_check import compare, duck
from shared import same

SCHEMA = "doc_id long, text string, n_lines string, _gone int, source string"


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "x", 1, "s") for d, t in docs], SCHEMA).repartition(1)


def brute(docs):
    """Documents in doc_id order (nulls last), each without the chunks met before."""
    seen, out = set(), []
    for d, t in sorted(docs, key=lambda r: (r[0] is None, r[0] or 0)):
        if t is None:
            out.append((d, None, 0, 0))
            continue
        lines = t.split("\n")
        h = [0, 0] + [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        chunks, now = [], []
        for i, x in enumerate(lines):
            now.append(x)
            if (h[i + 2] + 257 * h[i + 1] + 66049 * h[i]) % 4 == 0 or i == len(lines) - 1:
                chunks.append(now)
                now = []
        left, gone = [], 0
        for c in chunks:
            if len(c) > 1 and tuple(c) in seen:
                gone += len(c)
            else:
                left.append("\n".join(c))
                seen.add(tuple(c))
        out.append((d, "\n".join(left), len(lines), gone))
    return out


def sample():
    rng = random.Random(8)
    lines = [f"line {i} é" for i in range(60)] + [""]
    block = [rng.choice(lines) for _ in range(25)]
    docs = [(None, None), (1, None), (2, ""), (3, "\n\n\n"), (4, "a"), (5, "a\nb"), (6, "a\nb")]
    docs += [(10 + i, "\n".join([f"own {i}"] * (i % 3) + block + [rng.choice(lines) for _ in range(10)])) for i in range(20)]
    docs += [(50 + i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 30)))) for i in range(20)]
    return docs + [(90, "\n".join(f"l{i % 400}" for i in range(20_000))), (91, "\n".join(block + block))]


def test_odd_rows(spark, tmp_path):
    docs = sample()
    want = brute(docs)
    assert sum(r[3] for r in want) > 300
    df = linededup.dedup_lines(frame(spark, docs))
    assert df.columns == ["doc_id", "text", "_gone", "source", "n_lines", "n_lines_removed", "n_chunks_removed"]
    same(df, ["doc_id", "text", "n_lines", "n_lines_removed"], want)
    frame(spark, docs).repartition(3).write.parquet(f"{tmp_path}/t")  # rows known by file and position
    same(linededup.dedup_lines(spark.read.parquet(f"{tmp_path}/t")), ["doc_id", "text", "n_lines", "n_lines_removed"], want)


def test_repeated_rows_and_empty(spark):
    df = linededup.dedup_lines(frame(spark, [(1, "a\nb\nc")] * 4 + [(None, "x\ny")] * 2))
    got = [r["n_lines_removed"] for r in df.collect()]
    chunks = brute([(1, "a\nb\nc")] * 4 + [(None, "x\ny")] * 2)
    assert sorted(got) == sorted(r[3] for r in chunks)
    assert linededup.dedup_lines(frame(spark, [])).collect() == []


@pytest.mark.parametrize("sf", ["0.01"])
def test_query(spark, sf):
    d = f"/root/testdata/sf{sf}"
    assert compare(spark, d, "op6_line_dedup", QUERIES["op6_line_dedup"], SQL["op6_line_dedup"], duck(d), verbose=False)


def test_native(spark):
    plan = QUERIES["op6_line_dedup"](spark, "/root/testdata/sf0.001")
    text = plan._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text
