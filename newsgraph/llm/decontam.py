"""Benchmark decontamination with an FM-index for each training shard."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgraph.llm.common import fresh, schema_of

WINDOW = 10
# Benchmark words that one pass searches for (they travel to every task); more take further passes.
BLOCK_WORDS = 1_000_000
# Symbols of one index; a longer document has an index of its own.
SHARD_SYMBOLS = 1 << 20
SAMPLE = 16

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
# Non-word bytes become blanks and A-Z lower case; bytes from 0x80 on belong to non-ASCII letters.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_PLAIN).split() if text else []


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling (``s`` ends with a unique smallest symbol)."""
    rank, n, step = s.astype(np.int64), len(s), 1
    while True:
        after = np.zeros(n, np.int64)
        after[:n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (int(after.max()) + 1) + after
        order = np.argsort(key, kind="stable")
        head = np.concatenate(([0], (key[order][1:] != key[order][:-1]).astype(np.int64)))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(head)
        step *= 2
        if rank[order[-1]] == n - 1 or step >= 2 * n:
            return order


class WaveletMatrix:
    """Ranks of symbols in prefixes, by one cumulative bit count for each level."""

    def __init__(self, s: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (s >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(len(s) - self.ones[-1][-1]))
            s = np.concatenate((s[bit == 0], s[bit == 1]))

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        low = np.zeros_like(upto)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            upto = np.where(one, zeros + ones[upto], upto - ones[upto])
            low = np.where(one, zeros + ones[low], low - ones[low])
        return upto - low


class FMIndex:
    """Backward search and location in one sequence of symbols from 1."""

    def __init__(self, s: np.ndarray, symbols: int):
        s = np.concatenate((s, [0]))
        sa = suffix_array(s)
        self.bwt = s[sa - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=symbols))))
        self.tree = WaveletMatrix(self.bwt, symbols)
        self.sampled = sa % SAMPLE == 0
        self.slot = np.cumsum(self.sampled) - 1
        self.sample = sa[self.sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the patterns (rows of one length)."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), len(self.bwt), np.int64)
        live = np.arange(len(patterns))
        for c in patterns.T[::-1]:
            c = c[live]
            low[live] = self.first[c] + self.tree.rank(c, low[live])
            high[live] = self.first[c] + self.tree.rank(c, high[live])
            live = live[high[live] > low[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back to a sampled suffix."""
        found, steps, at, live = np.empty(len(rows), np.int64), 0, rows.copy(), np.arange(len(rows))
        while len(live):
            hit = self.sampled[at]
            found[live[hit]] = self.sample[self.slot[at[hit]]] + steps
            live, at = live[~hit], at[~hit]
            c = self.bwt[at]
            at = self.first[c] + self.tree.rank(c, at)
            steps += 1
        return found


class Phrases:
    """The windows of a block of benchmark items as rows of symbols."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.symbol: dict[bytes, int] = {}
        owner: dict[tuple, set] = defaultdict(set)
        for item, text in items:
            w = [self.symbol.setdefault(x, len(self.symbol) + 2) for x in words_of(text)]
            for i in range(max(1, len(w) - window + 1) if w else 0):
                owner[tuple(w[i:i + window])].add(item)
        self.symbols = len(self.symbol) + 2  # 0 ends the text, 1 stands between runs
        by = defaultdict(list)
        for p in owner:
            by[len(p)].append(p)
        self.patterns = [(n, np.array(sorted(by[n]), np.int64)) for n in sorted(by)]
        self.items = [[sorted(x for x in owner[tuple(p)] if x is not None) for p in rows.tolist()] for _, rows in self.patterns]
        self.shortest = min(by, default=0)


class _Shard:
    """Documents of one index; only runs of benchmark words long enough for a window go in."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.parts, self.at, self.size = phrases, [], [], 0

    def add(self, doc: int, words: list[bytes]) -> None:
        get, p = self.phrases.symbol.get, self.phrases
        if not p.shortest or len(words) < p.shortest:
            return
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        known = np.concatenate(([0], ids != 0, [0])).astype(np.int8)
        edge = np.diff(known)
        for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            if e - s >= p.shortest:
                self.at.append((self.size, doc, s))
                self.parts += [ids[s:e], [1]]
                self.size += e - s + 1

    def hits(self) -> dict[int, tuple[list[tuple[int, int]], set]]:
        """For each document with an occurrence: its merged word spans and items."""
        if not self.parts:
            return {}
        index = FMIndex(np.concatenate(self.parts), self.phrases.symbols)
        base, doc, word = (np.array(x) for x in zip(*self.at, strict=True))
        spans, items = defaultdict(list), defaultdict(set)
        for (n, patterns), owners in zip(self.phrases.patterns, self.phrases.items, strict=True):
            low, high = index.search(patterns)
            count = high - low
            which = np.repeat(np.arange(len(patterns)), count)
            rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
            at = index.locate(rows)
            run = np.searchsorted(base, at, side="right") - 1
            start = word[run] + at - base[run]
            for d, s in zip(doc[run].tolist(), start.tolist(), strict=True):
                spans[d].append((s, s + n))
            for d, k in {*zip(doc[run].tolist(), which.tolist(), strict=True)}:
                items[d].update(owners[k])
        return {d: (merge(x), items[d]) for d, x in spans.items()}


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.translate(_PLAIN))]
    out, last = [], 0
    for s, e in spans:
        out.append(raw[last:at[s][0]])
        last = at[e - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def _search(phrases: Phrases, shard_symbols: int, text: str, spans: str, items: str, words: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = pa.Table.from_batches([batch])
        texts, old, had = (t.column(c).to_pylist() for c in (text, spans, items))
        n, found, shard = [], {}, _Shard(phrases)
        for d, x in enumerate(texts):
            w = words_of(x)
            n.append(len(w))
            shard.add(d, w)
            if shard.size >= shard_symbols:
                found.update(shard.hits())
                shard = _Shard(phrases)
        found.update(shard.hits())
        for d, (s, i) in found.items():
            old[d] = [{"start": a, "end": b} for a, b in merge([(x["start"], x["end"]) for x in old[d]] + s)]
            had[d] = sorted({*had[d], *i})
        for name, new in ((spans, old), (items, had), (words, n)):
            k = t.column_names.index(name)
            t = t.set_column(k, t.schema.field(k), pa.chunked_array([pa.array(new, t.schema.field(k).type)]))
        yield from t.combine_chunks().to_batches()


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS,
               shard_symbols: int = SHARD_SYMBOLS, names: tuple[str, str, str] = ("n_words", "hit_spans", "hit_items")) -> DataFrame:
    """Word spans of every document that benchmark windows cover.

    Words are runs of digits, a-z (after lower-casing A-Z) and non-ASCII
    characters.  A window is ``window`` consecutive words of an item; a shorter
    item with words is one window.  Each task builds an FM-index (wavelet-tree
    ranks, every 16th suffix position sampled) over a shard of its documents,
    searches all windows backward, locates their occurrences and merges them.
    Runs of words that no item has, or that are too short for any window, cannot
    hold an occurrence and stay out of the index.

    The benchmark is searched in blocks of about ``block_words`` words, one map
    over the documents for each, so what a task holds is bounded; documents do
    not shuffle.  Adds the columns ``names``: number of words, merged spans
    ``[start, end)`` in words, sorted item ids as strings.  A null text has no
    words; items with null id mark words but are not listed; an empty benchmark
    marks nothing.
    """
    words, spans, items = names
    bench = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    size = bench.agg(F.coalesce(F.sum(F.length("text") / 4), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // block_words))
    out = docs.withColumn(words, F.lit(0).cast("long"))
    out = out.withColumn(spans, F.array().cast("array<struct<start:int,end:int>>")).withColumn(items, F.array().cast("array<string>"))
    for b in range(blocks):
        block = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        phrases = Phrases([(r["item"], r["text"]) for r in block.collect()], window)
        shared = docs.sparkSession.sparkContext.broadcast(phrases)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            yield from _search(shared.value, shard_symbols, "text", spans, items, words, batches)

        out = out.mapInArrow(run, out.schema)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None, **options) -> DataFrame:
    """``carry`` (default: doc_id), ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated`` and ``hit_spans`` of every document; input columns of these names are replaced."""
    made = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans")
    carry = [c for c in (carry or ["doc_id"]) if c.lower() not in made]
    slim = docs.select(F.struct(*[F.col(c) for c in carry]).alias("_carry") if carry else F.lit(None).cast("int").alias("_carry"), "text")
    found = find_spans(slim, benchmark, **options)
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        *[F.col("_carry").getField(c).alias(c) for c in carry], "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"), "hit_spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents with the covered spans cut out of their texts; all other columns and clean texts stay.

    ``n_chars``, where present, follows the text.  A document is dropped only if
    it was contaminated and no word is left.
    """
    names = tuple(fresh(docs, n) for n in ("n_words", "hit_spans", "hit_items"))
    found = find_spans(docs, benchmark, names=names, **options)
    spans, whole = names[1], docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            marked = t.column(spans).to_pylist()
            if any(marked):
                texts = t.column("text").to_pylist()
                new = [cut(x, [(s["start"], s["end"]) for s in m]) if m else x for x, m in zip(texts, marked, strict=True)]
                keep = [not m or bool(words_of(x)) for x, m in zip(new, marked, strict=True)]
                k = t.column_names.index("text")
                t = t.set_column(k, t.schema.field(k), pa.chunked_array([pa.array(new, t.schema.field(k).type)]))
                if "n_chars" in t.column_names:
                    k = t.column_names.index("n_chars")
                    n = [len(x) if m else c for x, m, c in zip(new, marked, t.column("n_chars").to_pylist(), strict=True)]
                    t = t.set_column(k, t.schema.field(k), pa.chunked_array([pa.array(n, t.schema.field(k).type)]))
                t = t.filter(pa.array(keep))
            yield from t.select(whole.names).combine_chunks().to_batches()

    return found.mapInArrow(run, whole)
