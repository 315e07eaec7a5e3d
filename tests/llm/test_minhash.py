import random

import numpy as np
import pytest
from newsgraph.llm import minhash
from newsgraph.llm.queries import QUERIES
from shared import key, same, table

COLS = ["doc_id", "n_shingles", "component_id", "kept"]


def brute(docs, percent=80):
    """All pairs of sets of word pairs; components by spreading the smallest row."""
    sets = []
    for _, t in docs:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for blank in "\t\n\x0b\x0c\r":
            lowered = lowered.replace(blank, " ")
        w = [x for x in lowered.split(" ") if x]
        sets.append(set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set())
    label = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and label[i] != label[j] and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    out = []
    for i, (d, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if label[j] == label[i] and docs[j][0] is not None]
        c = min(ids, default=None)
        out.append((d, len(sets[i]), c, c == d))
    return out


def test_query(spark):
    same(QUERIES["op11_minhash"](spark, "/root/testdata/sf0.001"), COLS, brute(table(spark, "documents", "doc_id", "text")))


def test_odd_rows(spark, frame, odd):
    got = minhash.near_duplicates(frame(odd), carry=["doc_id", "text", "fp", "score"])
    assert got.columns == ["doc_id", "text", "fp", "score", "n_shingles", "component_id", "kept"]
    same(got, COLS, brute(odd))


def test_empty(spark, frame):
    assert minhash.near_duplicates(frame([])).collect() == []
    same(minhash.near_duplicates(frame([(2, None), (1, ""), (1, " ")])), COLS, [(2, 0, 2, True), (1, 0, 1, True), (1, 0, 1, True)])


def test_clashing_names(spark):
    docs = spark.createDataFrame([(i, "a b c d e f", i, "x", "y", 1, 2) for i in (3, 1, 2)],
                                 "doc_id long, text string, n_shingles long, component_id string, _text string, rid int, _carry int").repartition(3)
    got = minhash.near_duplicates(docs, carry=["doc_id", "n_shingles", "_text", "rid", "_carry"])
    assert got.columns == ["doc_id", "_text", "rid", "_carry", "n_shingles", "component_id", "kept"]
    same(got, COLS, [(1, 5, 1, True), (2, 5, 1, False), (3, 5, 1, False)])


def clouds(seed, n=40, size=60):
    """Documents around one text: many share buckets, few are linked, and to others than the smallest."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(size)]
    docs = []
    for i in range(n):
        w = list(base)
        for at in rng.sample(range(size), rng.randint(2, 9)):
            w[at] = f"x{i}.{at}" if rng.random() < 0.5 else f"y{at}.{rng.randrange(4)}"
        docs.append((i, " ".join(w)))
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_that_miss_the_centre(spark, frame, seed):
    docs = clouds(seed)
    want = brute(docs)
    assert 1 < len({r[2] for r in want}) < len(docs)
    same(minhash.near_duplicates(frame(docs)), COLS, want)


def test_blocks_of_asking_classes(spark, frame, monkeypatch):
    """Asking classes in several blocks, asked ones in several tasks of a block."""
    monkeypatch.setattr(minhash, "ASKING", 3)
    monkeypatch.setattr(minhash, "ASKED", 10)
    docs = clouds(7, n=60, size=40)
    same(minhash.near_duplicates(frame(docs)), COLS, brute(docs))


@pytest.mark.parametrize("n", [1, 3, 40, 700, 5000])
def test_signature(n):
    """Each bin's smallest hash; an empty bin borrows from the first full one in its own order."""
    rng = random.Random(n)
    hashes = sorted({rng.getrandbits(64) for _ in range(n)})
    least = {}
    for h in hashes:
        least.setdefault(h >> 56, h)
    order = minhash._probes(256)
    want = [least[b] if b in least else least[min(least, key=lambda j: order[b][j])] for b in range(256)]
    assert minhash.signature(np.array(hashes, np.uint64)).tolist() == want


@pytest.mark.parametrize("n", [5, 30, 400])
def test_candidates_at_the_bound(n):
    """Sets of similarity 0.8 share a band and stay within the sketch's bound, whatever their size."""
    rng = np.random.default_rng(n)
    for _ in range(300):
        h = rng.integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False)
        cut = n // 10
        a, b = (minhash.bands_and_sketch(minhash.signature(np.sort(x))) for x in (h[:n - (n // 5 - cut)], np.concatenate((h[:n - n // 5], h[n - (n // 5 - cut):]))))
        assert (a[0] == b[0]).any()
        assert int(np.bitwise_count((a[1] ^ b[1]).view(np.uint64)).sum()) <= minhash.MAX_SKETCH_BITS


def test_other_bounds(frame):
    with pytest.raises(ValueError):
        minhash.near_duplicates(frame([(1, "a")]), percent=50)


def test_brute_is_sorted_like_the_frames(odd):
    assert sorted(brute(odd), key=key)[0][0] is None
