"""Toxicity from a learned lexicon, misspellings and the context of each hit."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgraph.llm.common import checkpoint, fresh, schema_of

THRESHOLD = 0.3
# Bound on the labelled documents that the lexicon and the weights are fitted on.
TRAIN_ROWS = 40_000
# A term must be in that many toxic documents, however many there are.
MIN_DOCS = 4
MIN_LOG_RATIO = 3.0
STEMS = range(3, 9)
WINDOW = 10
FUZZY_FROM = 5

_TOKEN = re.compile(r"[^\W_]+")
_QUOTE = re.compile(r"[\"“”„«»‹›]")
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|‹[^›\n]*›")
# Words that announce somebody else's words.
REPORTING = frozenset("said says quote quoted quoting wrote called reported dit disait sagte schrieb zitiert dijo escribió citó".split())
FEATURES = ("any_direct", "direct", "fuzzy", "quoted", "dense", "rate")


class Lexicon:
    """Terms in a trie, read together with Levenshtein automata.

    A state is the set of (trie node, edits) that the characters read so far can
    reach; states are built when first met and kept, so the product of trie and
    automata acts as one deterministic automaton.  ``terms``: (term, whole); a
    term that is not whole also matches the words that it begins.  Terms of
    ``FUZZY_FROM`` letters or more allow one edit.
    """

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[bool, int]]] = [[]]
        for term, whole in terms:
            at = 0
            for c in term:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.ends.append([])
                at = self.child[at][c]
            self.ends[at].append((whole, int(len(term) >= FUZZY_FROM)))
        self.reset()

    def __getstate__(self):
        return self.terms

    def __setstate__(self, terms):
        self.__init__(terms)

    def reset(self) -> None:
        self.seen: dict[str, int] = {}
        self.number: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.step: list[dict[str, int]] = []
        self.at_end: list[int] = []
        self._state({(0, 0)}, 9)

    def _state(self, states: set[tuple[int, int]], begun: int) -> int:
        """``begun``: least edits of a stem that the word has passed (9: none)."""
        todo = list(states)
        while todo:  # a missing letter
            node, e = todo.pop()
            if e == 0:
                for n in self.child[node].values():
                    if (n, 1) not in states and (n, 0) not in states:
                        states.add((n, 1))
        for node, e in states:
            for whole, most in self.ends[node]:
                if not whole and e <= most:
                    begun = min(begun, e)
        key = (frozenset(states), begun)
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.step.append({})
            end = min([begun, *(e for node, e in states for _, most in self.ends[node] if e <= most)])
            self.at_end.append(end)
        return self.number[key]

    def _next(self, state: int, c: str) -> int:
        states, begun = self.sets[state]
        after = set()
        for node, e in states:
            child = self.child[node]
            if c in child:
                after.add((child[c], e))
            if e == 0:
                after.add((node, 1))  # one letter too many
                after.update((n, 1) for n in child.values())  # a wrong letter
        after = {(n, e) for n, e in after if not (e and (n, 0) in after)}
        self.step[state][c] = out = self._state(after, begun) if after or begun < 9 else -1
        return out

    def edits(self, word: str) -> int:
        """Fewest edits from the word to a term; 9 if there is none."""
        got = self.seen.get(word)
        if got is not None:
            return got
        if len(self.sets) > 50_000 or len(self.seen) > 200_000:
            self.reset()
        s = 0
        for c in word:
            n = self.step[s].get(c)
            s = self._next(s, c) if n is None else n
            if s < 0 or self.sets[s][1] == 0:
                break
        got = self.seen[word] = 9 if s < 0 else self.at_end[s]
        return got

    def features(self, text: str | None) -> tuple[float, ...]:
        """Hits of the whole text by kind, weighed by the context window of each."""
        low = (text or "").lower()
        words = _TOKEN.findall(low)
        hit = {w: e for w in set(words) if (e := self.edits(w)) < 9}
        if not hit:
            return (0.0,) * len(FEATURES)
        at = [i for i, w in enumerate(words) if w in hit]
        want, spans = set(at), {}
        for i, m in enumerate(_TOKEN.finditer(low)):
            if i in want:
                spans[i] = m.start()
        marks = [m.start() for m in _QUOTE.finditer(low)]
        lines = [i for i, c in enumerate(low) if c == "\n"] if marks else []
        direct = fuzzy = quoted = dense = 0.0
        for i in at:
            e, pos = hit[words[i]], spans[i]
            inside = False
            if marks:  # an odd number of quotation marks stands before it in its line, and one follows
                k = bisect_left(lines, pos)
                start, end = lines[k - 1] if k else -1, lines[k] if k < len(lines) else len(low)
                before, after = bisect_left(marks, pos) - bisect_left(marks, start), bisect_left(marks, end) - bisect_left(marks, pos)
                inside = before % 2 == 1 and after > 0
            told = not REPORTING.isdisjoint(words[max(0, i - WINDOW):i])
            if inside or told and marks:
                quoted += 1
            elif e:
                fuzzy += 1
            else:
                direct += 1
            dense = max(dense, bisect_left(at, i + WINDOW + 1) - bisect_left(at, i - WINDOW) - 1)
        return (float(direct > 0), math.log1p(direct), math.log1p(fuzzy), math.log1p(quoted), math.log1p(dense),
                math.log1p(100 * (direct + fuzzy) / len(words)))


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label that hold a word, or a word with a stem, outside quotations; partial counts of this task."""
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])

    def out():
        names = list(counts)
        rows = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(
            pa.array([counts[n][k] for n in names], pa.int64()) for k in (0, 1))], ["term", "clean", "toxic"])
        counts.clear()
        return rows

    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = {" "}
            for w in set(_TOKEN.findall(_QUOTED.sub(" ", (text or "").lower()))):
                found.add(w)
                found.update(w[:k] + "*" for k in STEMS if k < len(w))
            for t in found:
                counts[t][toxic] += 1
            if len(counts) > 100_000:
                yield out()
    if counts:
        yield out()


def choose(rows: list[tuple[str, int, int]], n_clean: int, n_toxic: int) -> list[tuple[str, bool]]:
    """Terms of the lexicon from (term, clean, toxic): strongest first, the most specific of equals, none inside another."""
    scored = []
    for term, clean, toxic in rows:
        ratio = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
        if toxic >= MIN_DOCS and ratio >= MIN_LOG_RATIO:
            scored.append((-toxic * ratio, "*" in term, -len(term), term))
    out: list[tuple[str, bool]] = []
    stems: set[str] = set()
    begun: set[str] = set()
    for *_, term in sorted(scored):
        word, whole = term.rstrip("*"), not term.endswith("*")
        if any(word[:k] in stems for k in range(1, len(word) + 1)) or not whole and word in begun:
            continue
        out.append((word, whole))
        begun.update(word[:k] for k in range(1, len(word) + 1))
        if not whole:
            stems.add(word)
    return out


def fit(x: np.ndarray, y: np.ndarray, times: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (last: intercept) of a ridge logistic regression on points that count ``times`` each, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    pull = np.full(len(w), ridge)
    pull[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (times * (p - y)) + pull * w
        step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + np.diag(pull), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id's text is 2 modulo 4 (a null id is no such row)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.weights[:-1], self.lexicon.features(text)) + self.weights[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``train_rows`` labelled rows that are not held out, the first in hash order.

    The labels chosen are bounded, so they are broadcast and only their texts
    shuffle.  A document with several labels is toxic if one says so; null labels are
    passed over.  A term enters the lexicon if ``MIN_DOCS`` toxic rows have it and
    its log ratio is ``MIN_LOG_RATIO`` or more, whatever the clean rows; only such
    terms come to the driver, at most a ``MIN_DOCS``-th of the terms of the toxic
    training rows.  Of a doc_id that occurs several times one text trains, the
    first in byte order.  Without toxic or without clean rows the lexicon is
    empty and the score is the share of toxic rows.
    """
    known = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = checkpoint(rows.select("text", "toxic"))
    counts = rows.mapInArrow(_mine, "term string, clean long, toxic long").groupBy("term").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # the blank term counts the documents
    counts = checkpoint(counts.where((F.col("toxic") >= MIN_DOCS) | (F.col("term") == " ")))
    sizes = counts.where("term = ' '").first()
    n_clean, n_toxic = (sizes["clean"], sizes["toxic"]) if sizes else (0, 0)
    # the rule of ``choose``, which looks at the terms again
    ratio = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    strong = counts.where((F.col("term") != " ") & (ratio >= MIN_LOG_RATIO - 1e-9))
    lexicon = Lexicon(choose([tuple(r) for r in strong.collect()], n_clean, n_toxic) if n_clean and n_toxic else [])
    base = np.zeros(len(FEATURES) + 1)
    if not lexicon.terms:
        share = n_toxic / (n_clean + n_toxic) if n_clean + n_toxic else 0.0
        base[-1] = max(-30.0, min(30.0, math.log(max(share, 1e-9) / max(1 - share, 1e-9))))
        return Model(lexicon, base)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [shared.value.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1).cast(pa.int32())], ["x", "toxic"])

    # at most a row for each label that was chosen
    points = rows.mapInArrow(featurise, "x array<double>, toxic int").groupBy("x", "toxic").count().orderBy("x", "toxic").collect()
    x, y, times = (np.array([r[k] for r in points], np.float64) for k in ("x", "toxic", "count"))
    return Model(lexicon, fit(x, y, times))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The documents with the score of each whole text in column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            s = [shared.value.score(x) for x in t.column("text").to_pylist()]
            yield from t.append_column(name, pa.array(s, pa.float64())).combine_chunks().to_batches()

    return docs.mapInArrow(run, schema_of(docs, (name, T.DoubleType())))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document.

    Null and empty texts score as texts without a hit; repeated rows score
    alike; an empty table gives no rows.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels)).drop("text")
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, all columns kept."""
    name = fresh(docs, "tox_score")
    return score(docs, train(docs, labels), name).where(F.col(name) < threshold).drop(name)
