"""How far the sources of a language differ in their words, over a minimal transducer vocabulary."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsgraph.llm.common import checkpoint, ordered_index

# After lower-casing A-Z: runs of letters a-z and of bytes beyond ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
MIN_DOCS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
# Terms of one transducer.
SHARD_TERMS = 1 << 16
# Transducers that travel to every task; beyond it counted terms travel to the transducers.
BROADCAST_BYTES = 64 << 20
# Cells (sources x terms) of one comparison.
CELLS = 1 << 20
# Counts that a task holds before it hands them on.
_HELD = 1 << 21


def terms_of(text: str) -> list[bytes]:
    return TERM.findall(text.encode().lower())


class Transducer:
    """Minimal acyclic transducer: term -> ordinal, the rank of the term among all of its terms.

    ``arc`` holds state * 256 + byte in ascending order, ``to`` the next state,
    ``out`` what the arc adds to the ordinal: the number of terms that leave its
    state earlier.
    """

    def __init__(self, arc: np.ndarray, to: np.ndarray, out: np.ndarray, final: np.ndarray, root: int):
        self.arc, self.to, self.out, self.final, self.root = arc, to, out, final, root

    @classmethod
    def build(cls, terms: list[bytes]) -> Transducer:
        """From distinct sorted terms, one state after the other: a state that no later term can
        change is looked up among the equal ones made so far."""
        known: dict[tuple, int] = {}
        size: list[int] = []  # terms that end below a state

        def settle(node: list) -> int:
            final, labels, targets = node
            key = (final, bytes(labels), tuple(targets))
            if key not in known:
                known[key] = len(size)
                size.append(final + sum(size[t] for t in targets))
            return known[key]

        def close(path: list, depth: int) -> None:
            while len(path) > depth + 1:
                node = path.pop()
                path[-1][2].append(settle(node))

        path, last = [[False, bytearray(), []]], b""
        for term in terms:
            same = next((i for i, (a, b) in enumerate(zip(last, term)) if a != b), min(len(last), len(term)))
            close(path, same)
            for byte in term[same:]:
                path[-1][1].append(byte)
                path.append([False, bytearray(), []])
            path[-1][0], last = True, term
        close(path, 0)
        root = settle(path[0])
        arc, to, out = [], [], []
        for state, (final, labels, targets) in enumerate(known):
            arc += [state * 256 + b for b in labels]
            to += targets
            out += list(accumulate((size[t] for t in targets), initial=int(final)))[:-1]
        return cls(np.array(arc, np.int64), np.array(to, np.int32), np.array(out, np.int32),
                   np.array([k[0] for k in known], bool), root)

    def pack(self) -> bytes:
        head = np.array([len(self.arc), len(self.final), self.root], np.int64)
        return b"".join(x.tobytes() for x in (head, self.arc, self.to, self.out, self.final))

    @classmethod
    def unpack(cls, blob: bytes) -> Transducer:
        arcs, states, root = np.frombuffer(blob, np.int64, 3).tolist()
        at = 24 + 8 * arcs
        return cls(np.frombuffer(blob, np.int64, arcs, 24), np.frombuffer(blob, np.int32, arcs, at),
                   np.frombuffer(blob, np.int32, arcs, at + 4 * arcs), np.frombuffer(blob, bool, states, at + 8 * arcs), root)

    def ordinals(self, terms: list[bytes]) -> np.ndarray:
        """Ordinal of every term (-1: none of its terms), all walked at once, a byte a step."""
        found = np.full(len(terms), -1, np.int64)
        if not len(self.arc):
            return found
        text = np.frombuffer(b"".join(terms), np.uint8)
        length = np.fromiter(map(len, terms), np.int64, len(terms))
        at = np.cumsum(length) - length
        who, state, total = np.arange(len(terms)), np.full(len(terms), self.root, np.int64), np.zeros(len(terms), np.int64)
        step = 0
        while len(who):
            want = state * 256 + text[at[who] + step]
            i = np.minimum(np.searchsorted(self.arc, want), len(self.arc) - 1)
            on = self.arc[i] == want
            who, i = who[on], i[on]
            state, total, step = self.to[i].astype(np.int64), total[on] + self.out[i], step + 1
            end = length[who] == step
            done = end & self.final[state]
            found[who[done]] = total[done]
            who, state, total = who[~end], state[~end], total[~end]
        return found


class Vocabulary:
    """Transducers of each language by their first terms."""

    def __init__(self, shards: list[tuple[str, bytes, int, bytes]]):
        self.of = defaultdict(lambda: ([], []))
        for lang, first, base, blob in sorted(shards):
            self.of[lang][0].append(first)
            self.of[lang][1].append((base, blob and Transducer.unpack(blob)))
        self.of = dict(self.of)

    def shards(self, lang: str, terms: list[bytes]) -> Iterator[tuple[int, int, list[bytes]]]:
        """(shard, base, terms) of sorted terms; those before a language's first term are none of its terms."""
        firsts, parts = self.of.get(lang, ([], []))
        cut = [bisect_left(terms, f) for f in firsts] + [len(terms)]
        for i, part in enumerate(parts):
            if cut[i] < cut[i + 1]:
                yield i, part, terms[cut[i]:cut[i + 1]]

    def ordinals(self, lang: str, terms: list[bytes]) -> dict[bytes, int]:
        out = {}
        for _, (base, shard), some in self.shards(lang, terms):
            found = shard.ordinals(some)
            out.update((t, base + o) for t, o in zip(some, found.tolist(), strict=True) if o >= 0)
        return out


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of a task's documents with each (lang, term)."""
    held: dict[str, Counter] = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for lang, c in held.items():
            for s in range(0, len(c), 1 << 18):
                some = list(c.items())[s:s + (1 << 18)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(some), pa.string()), pa.array([t for t, _ in some], pa.binary()).cast(pa.string()),
                    pa.array([n for _, n in some], pa.int64())], ["lang", "term", "docs"])
        held.clear()

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            held[lang].update(set(terms_of(text)))
        if sum(map(len, held.values())) > _HELD:
            yield from out()
    yield from out()


def _group_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Counts of the terms of each (lang, source) of a batch."""
    for b in batches:
        held: dict[tuple, Counter] = defaultdict(Counter)
        for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            held[lang, source].update(terms_of(text))
        yield held


class Packed:
    """Occurrences as rows of a (lang, source, block): the ordinals of a block of ``width`` terms and their counts, as bytes."""

    NAMES = ["lang", "source", "block", "total", "ordinals", "counts"]
    SCHEMA = "lang string, source string, block long, total long, ordinals binary, counts binary"

    def __init__(self, width: int):
        self.width, self.rows = width, [[] for _ in self.NAMES]

    def add(self, lang: str, source: str, ordinals: np.ndarray, counts: np.ndarray) -> None:
        """Ordinals may come in any order and repeat."""
        if not len(ordinals):
            return
        ordinals, at = np.unique(ordinals, return_inverse=True)
        counts = np.bincount(at, weights=counts).astype(np.int64) if counts.sum() < 1 << 53 else _summed(at, counts)
        blocks = ordinals // self.width
        first = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1])))
        for s, e in zip(first.tolist(), [*first[1:].tolist(), len(ordinals)], strict=True):
            row = (lang, source, int(blocks[s]), int(counts[s:e].sum()), ordinals[s:e].tobytes(), counts[s:e].tobytes())
            for column, x in zip(self.rows, row, strict=True):
                column.append(x)

    def out(self) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(self.rows[0]), 256):
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x[s:s + 256], k) for x, k in zip(self.rows, kinds, strict=True)], self.NAMES)
        self.rows = [[] for _ in self.NAMES]


def _summed(at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros(int(at.max()) + 1, np.int64)
    np.add.at(out, at, counts)
    return out


def _recount(vocabulary: Vocabulary, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts through the transducers: occurrences of each kept term in each (lang, source) of a task."""
    total: dict[tuple, list] = defaultdict(list)
    packed, entries = Packed(width), 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), parts in total.items():
            packed.add(lang, source, *(np.concatenate(x) for x in zip(*parts, strict=True)))
        total.clear()
        yield from packed.out()

    for held in _group_counts(batches):
        by_lang = defaultdict(set)
        for (lang, _), c in held.items():
            by_lang[lang].update(c)
        known = {lang: vocabulary.ordinals(lang, sorted(some)) for lang, some in by_lang.items()}
        for (lang, source), c in held.items():
            ordinal = known[lang]
            found = np.fromiter((ordinal.get(t, -1) for t in c), np.int64, len(c))
            n = np.fromiter(c.values(), np.int64, len(c))
            total[lang, source].append((found[found >= 0], n[found >= 0]))
            entries += len(c)
        if entries > _HELD:
            yield from out()
            entries = 0
    yield from out()


def _merged(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows in order of (lang, source, block): one row for each."""
    at, sums, base = None, None, 0
    packed = Packed(width)
    for b in batches:
        for lang, source, block, _, ordinals, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (lang, source, block) != at:
                if at is not None:
                    some = np.flatnonzero(sums)
                    packed.add(at[0], at[1], some + base, sums[some])
                at, sums, base = (lang, source, block), np.zeros(width, np.int64), block * width
            sums[np.frombuffer(ordinals, np.int64) - base] += np.frombuffer(counts, np.int64)
        yield from packed.out()
    if at is not None:
        some = np.flatnonzero(sums)
        packed.add(at[0], at[1], some + base, sums[some])
        yield from packed.out()


def _routed(splits: Vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted terms of a batch with the shard whose range they fall into."""
    for held in _group_counts(batches):
        for (lang, source), c in held.items():
            for i, _, some in splits.shards(lang, sorted(c)):
                n = len(some)
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * n, pa.string()), pa.array([i] * n, pa.int64()), pa.array([source] * n, pa.string()),
                    pa.array(some, pa.binary()), pa.array([c[t] for t in some], pa.int64())], ["lang", "shard", "source", "term", "n"])


def _walked(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (lang, shard), each shard's transducer before its terms: ordinals of the terms."""
    base, shard, packed = 0, None, Packed(width)
    for b in batches:
        blob, at = b.column(4), 0
        heads = np.flatnonzero(blob.is_valid().to_numpy(zero_copy_only=False)).tolist()
        for end in [*heads, b.num_rows]:
            if end > at and shard is not None:
                part = b.slice(at, end - at)
                found, n = shard.ordinals(part.column(5).to_pylist()), part.column(3).to_numpy()
                lang, source = part.column(0).to_pylist(), np.array(part.column(2).to_pylist(), object)
                for name in dict.fromkeys(source.tolist()):
                    mine = (source == name) & (found >= 0)
                    packed.add(lang[0], name, base + found[mine], n[mine])
                yield from packed.out()
            if end < b.num_rows:
                base, shard, at = b.column(3)[end].as_py(), Transducer.unpack(blob[end].as_py()), end + 1


def vocabulary(rows: DataFrame, min_docs: int = MIN_DOCS, shard_terms: int = SHARD_TERMS) -> tuple[DataFrame, DataFrame]:
    """Kept terms with their ordinals, and the transducers: (``lang``, ``term``, ``ordinal``), (``lang``, ``shard``, ``first``, ``base``, ``blob``)."""
    counts = rows.mapInArrow(_document_counts, "lang string, term string, docs long").groupBy("lang", "term").agg(F.sum("docs").alias("docs"))
    ordered, _, _ = ordered_index(counts.where(F.col("docs") >= min_docs).select("lang", "term", F.lit(1).cast("long").alias("one")),
                                  [F.col("lang"), F.col("term")], "one")
    start = ordered.groupBy("lang").agg(F.min("row_index").alias("start"))
    kept = checkpoint(ordered.join(start, "lang").select("lang", "term", (F.col("row_index") - F.col("start")).alias("ordinal")))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("ordinal")
        terms = [t.encode() for t in table.column("term").to_pylist()]
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "shard": pa.array([key[1].as_py()], pa.int64()), "first": pa.array([terms[0]], pa.binary()),
                         "base": pa.array([table.column("ordinal")[0].as_py()], pa.int64()), "blob": pa.array([Transducer.build(terms).pack()], pa.binary())})

    sharded = kept.withColumn("shard", F.expr(f"ordinal div {shard_terms}"))
    shards = checkpoint(sharded.groupBy("lang", "shard").applyInArrow(build, "lang string, shard long, first binary, base long, blob binary"))
    return kept, shards


def occurrences(rows: DataFrame, shards: DataFrame, width: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """How often each kept term occurs in each source, as ``Packed`` rows of ``width`` terms.

    Transducers of at most ``broadcast_bytes`` in all go to every task and the
    texts stream through them.  Beyond it only the first terms of the shards do;
    each task's counted terms go to the shard that they fall into and stream
    through its transducer there.  Either way a task sends one row for each of
    its sources and blocks of terms, and these are summed in a stream.
    """
    sc = rows.sparkSession.sparkContext
    if (shards.agg(F.sum(F.length("blob"))).first()[0] or 0) <= broadcast_bytes:
        shared = sc.broadcast([tuple(r) for r in shards.select("lang", "first", "base", "blob").collect()])

        def recount(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _recount(Vocabulary([(a, bytes(b), c, bytes(d)) for a, b, c, d in shared.value]), width, it)

        found = rows.mapInArrow(recount, Packed.SCHEMA)
    else:
        splits = sc.broadcast([tuple(r) for r in shards.select("lang", "first", "base").collect()])

        def route(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _routed(Vocabulary([(a, bytes(b), c, b"") for a, b, c in splits.value]), it)

        def walk(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _walked(width, it)

        counted = rows.mapInArrow(route, "lang string, shard long, source string, term binary, n long") \
            .groupBy("lang", "shard", "source", "term").agg(F.sum("n").alias("n"))
        heads = shards.select("lang", "shard", F.lit(None).cast("string").alias("source"), F.col("base").alias("n"), "blob", F.lit(None).cast("binary").alias("term"))
        both = heads.unionByName(counted.withColumn("blob", F.lit(None).cast("binary")))
        found = both.repartition("lang", "shard").sortWithinPartitions("lang", "shard", F.col("blob").isNull()) \
            .select("lang", "shard", "source", "n", "blob", "term").mapInArrow(walk, Packed.SCHEMA)

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _merged(width, it)

    key = ["lang", "source", "block"]
    return checkpoint(found.repartition(*key).sortWithinPartitions(*key).mapInArrow(merge, Packed.SCHEMA))


def _share(n: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / total), exactly, for totals up to 9e15."""
    rest, out = n + 1, np.zeros_like(n)
    for _ in range(3):  # SCALE is 1000 ** 3
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def _compared(width: int, top: int, key: tuple, counts: pa.Table, sources: pa.Table) -> pa.Table:
    """Sums of one block of a language's terms for each pair of sources, and each source's first terms."""
    lang, block = key[0].as_py(), key[1].as_py()
    sources = sources.sort_by("source")
    names, n_all = sources.column("source").to_pylist(), sources.column("total").to_numpy()
    vocab = sources.column("terms")[0].as_py()
    at, base = {s: i for i, s in enumerate(names)}, block * width
    n = np.zeros((len(names), min(width, vocab - base)), np.int64)
    for s, ordinals, found in zip(*(counts.column(c).to_pylist() for c in ("source", "ordinals", "counts")), strict=True):
        n[at[s], np.frombuffer(ordinals, np.int64) - base] = np.frombuffer(found, np.int64)
    out = {"source": [], "item": [], "ordinal": [], "value": []}
    if vocab:
        p = _share(n, (n_all + vocab)[:, None])
        q = _share(n.sum(axis=0), int(n_all.sum()) + vocab)
    for a, name in enumerate(names):
        pair = ((p[a] - p) ** 2 // p).sum(axis=1) if vocab else np.zeros(len(names), np.int64)
        others = [i for i in range(len(names)) if i != a]
        out["source"] += [name] * len(others)
        out["item"] += [names[i] for i in others]
        out["ordinal"] += [None] * len(others)
        out["value"] += pair[others].tolist()
        if vocab:
            over = np.flatnonzero((n[a] > 0) & (p[a] > q))
            f = (p[a][over] - q[over]) ** 2 // q[over]
            first = np.lexsort((over, -f))[:top]
            out["source"] += [name] * len(first)
            out["item"] += [None] * len(first)
            out["ordinal"] += (over[first] + base).tolist()
            out["value"] += f[first].tolist()
    return pa.table({"lang": pa.array([lang] * len(out["source"]), pa.string()), "source": pa.array(out["source"], pa.string()),
                     "item": pa.array(out["item"], pa.string()), "ordinal": pa.array(out["ordinal"], pa.int64()), "value": pa.array(out["value"], pa.int64())})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, shard_terms: int = SHARD_TERMS, broadcast_bytes: int = BROADCAST_BYTES,
          cells: int = CELLS, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Divergence of the sources of each language: ``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``.

    Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased; a
    language keeps those in at least ``min_docs`` of its documents.  Null text,
    lang and source count as empty; repeated rows count each.  With V kept terms
    and N occurrences of them, a source (or a whole language) gives a term with
    n occurrences p = 1 + floor(10^9 * (n + 1) / (N + V)); p differs from q by
    floor((p - q)^2 / q).  Part ``pair`` ranks every other source of the language
    by the sum over all kept terms (0 without kept terms), part ``term`` the
    source's first ``top`` terms with p above the language's q.  Ranks go by
    value descending, then by the item's UTF-8 bytes.  An empty table gives none.

    First pass: documents of each term.  The kept terms, sorted, become minimal
    acyclic transducers of ``shard_terms`` terms each, whose outputs are the
    terms' lexicographic ordinals.  Second pass: texts stream through them and
    are counted anew by ordinal (see ``occurrences``).  Blocks of ordinals are
    compared in tasks of about ``cells`` (source, term) counts, and ties fall by
    ordinal.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    kept, shards = vocabulary(rows, min_docs, shard_terms)
    groups = checkpoint(rows.select("lang", "source").groupBy("lang", "source").agg(F.lit(0).cast("long").alias("total")))
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    width = max(1024, cells // most)
    counts = occurrences(rows, shards, width, broadcast_bytes)
    totals = groups.unionByName(counts.select("lang", "source", "total")).groupBy("lang", "source").agg(F.sum("total").alias("total"))
    totals = checkpoint(totals.join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms")), "lang", "left").fillna(0, ["terms"]))
    blocks = totals.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"greatest(terms - 1, 0) div {width}"))))

    def compared(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return _compared(width, top, key, left, right)

    found = checkpoint(counts.groupBy("lang", "block").cogroup(blocks.groupBy("lang", "block")).applyInArrow(compared, "lang string, source string, item string, ordinal long, value long"))
    pairs = found.where("item is not null").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    per = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(per).alias("rank"))
    per = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    terms = found.where("ordinal is not null").withColumn("rank", F.row_number().over(per)).where(F.col("rank") <= top)
    terms = terms.join(kept, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(terms)
