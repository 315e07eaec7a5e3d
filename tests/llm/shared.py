import random

SF = "/root/testdata/sf0.001"
# extra columns whose names the operators use themselves
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, size string, shard string, score double, mask int, n_words string"


def key(row):
    return tuple((x is not None, str(x)) for x in row)


def same(df, cols, want):
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    assert got == sorted(want, key=key)


def odd_texts():
    """Nulls, empties, blanks, very long, ties and repeated rows."""
    rng = random.Random(5)
    words = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(25)]
    docs = [(None, None), (None, None), (None, "a b"), (1, ""), (2, " \t\n "), (3, None), (4, "ONE"), (4, "one"), (4, "one")]
    docs += [(10 + i, t) for i, t in enumerate(base)]
    docs += [(50 + i, base[i % 3]) for i in range(12)]
    docs += [(80 + i, base[3] + f" extra{i}") for i in range(10)]
    docs += [(99, " ".join(rng.choice(words) for _ in range(30_000))), (-7, base[1].upper())]
    return docs


def table(spark, name, *cols):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*cols).collect()]
