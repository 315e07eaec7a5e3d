"""Near-duplicate passages through compact windows of token min-hashes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsgraph.llm.common import row_ids
from newsgraph.llm.decontam import words_of
from newsgraph.session import sharing_bits, stored

SHINGLE = 5
SIMILARITY = 0.8
MIN_WORDS = 50
N_HASHES = 4
SEED = 11

_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of a 64-bit generator; every bit depends on all others."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hash of each word, worked out when it is first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


class Shingles:
    """Hashes of the word shingles of a text; word hashes are kept up to a bound."""

    def __init__(self, width: int = SHINGLE):
        self.width, self.known = width, _Words()

    def of(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        if len(words) < self.width:
            return np.empty(0, np.uint64)
        if len(self.known) > 300_000:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        n = len(words) - self.width + 1
        out = np.zeros(n, np.uint64)
        for k in range(self.width):
            out = _mix(out + _STEP) ^ h[k:k + n]
        return _mix(out)


def _window_minima(key: np.ndarray, t: int) -> np.ndarray:
    """Minimum of every run of ``t`` columns, by doubling."""
    size, out = 1, key
    while size * 2 <= t:
        out = np.minimum(out[:, :-size], out[:, size:])
        size *= 2
    rest = t - size
    return np.minimum(out[:, :out.shape[1] - rest], out[:, rest:]) if rest else out


def compact_windows(s: np.ndarray, t: int, seeds: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """For each hash: signatures and (left, centre, right) of the windows of ``t`` shingles or more.

    All runs [i, j] with left <= i <= centre <= j <= right have the signature as
    their min-hash.  The centres are the minima of the runs of length t; each
    one's nearest smaller value on either side is such a minimum too, so the
    Cartesian tree is built over them alone.
    """
    n = len(s)
    if n < t:
        return []
    value = _mix(s[None, :] ^ seeds[:, None])
    place = np.uint64((1 << max(1, int(n).bit_length())) - 1)
    least = _window_minima((value & ~place) | np.arange(n, dtype=np.uint64), t) & place
    out = []
    for j in range(len(seeds)):
        row = least[j].astype(np.int64)
        centre = row[np.concatenate(([True], row[1:] != row[:-1]))]
        v = (value[j] & ~place | np.arange(n, dtype=np.uint64))[centre].tolist()
        left, right, stack, at = [0] * len(v), [n - 1] * len(v), [], centre.tolist()
        for k, x in enumerate(v):
            while stack and v[stack[-1]] > x:
                right[stack.pop()] = at[k] - 1
            left[k] = at[stack[-1]] + 1 if stack else 0
            stack.append(k)
        out.append((value[j][centre], np.array(left), centre, np.array(right)))
    return out


# Shared positions that are compared at a time.
_MATCHES = 1 << 20


def _segments(a: np.ndarray, b: np.ndarray, shared: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Maximal equal runs of a and b: rows (start in a, start in b, length), sorted by the starts."""
    at = b[order]
    lo, hi = np.searchsorted(at, a[shared]), np.searchsorted(at, a[shared], side="right")
    upto = np.cumsum(hi - lo)
    first, last = [], []
    begin = 0
    while begin < len(shared):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + _MATCHES, side="right")))
        n = hi[begin:end] - lo[begin:end]
        x = np.repeat(shared[begin:end], n)
        y = order[np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[begin:end], n)]
        new = (x == 0) | (y == 0) | (a[x - 1] != b[y - 1])
        over = (x == len(a) - 1) | (y == len(b) - 1) | (a[np.minimum(x + 1, len(a) - 1)] != b[np.minimum(y + 1, len(b) - 1)])
        first.append(np.stack((y[new] - x[new], x[new])))
        last.append(np.stack((y[over] - x[over], x[over])))
        begin = end
    first, last = (np.concatenate(z, axis=1) for z in (first, last))
    # a line's starts and ends alternate
    first, last = first[:, np.lexsort(first[::-1])], last[:, np.lexsort(last[::-1])]
    out = np.stack((first[1], first[1] + first[0], last[1] - first[1] + 1), axis=1)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


# Runs before a run that it may follow with an overlap.
LOOK_BACK = 256


class _Ends:
    """Best run among those that end before a place in both texts, by prefix maxima over their ends in b."""

    def __init__(self, x: np.ndarray, y: np.ndarray, n: np.ndarray, cost: float):
        self.low, self.cost, self.at = int(y.min()), cost, 0
        self.x, self.y, self.n = x.tolist(), (y - self.low + 1).tolist(), n.tolist()
        self.order = np.argsort(x + n, kind="stable").tolist()
        self.size = max(map(int.__add__, self.y, self.n)) + 1
        self.tree = [(-math.inf, -1)] * self.size

    def before(self, k: int, best: np.ndarray) -> tuple[float, int]:
        """(gain, run) for run ``k``, to be asked in the order of the starts in a."""
        x, y, n, tree = self.x, self.y, self.n, self.tree
        while x[j := self.order[self.at]] + n[j] <= x[k]:
            i, now = y[j] + n[j], (best[j] + self.cost * (x[j] + y[j] + 2 * n[j]), j)
            while i < self.size:
                if tree[i] < now:
                    tree[i] = now
                i += i & -i
            self.at += 1
        i, top = y[k], (-math.inf, -1)
        while i:
            top = max(top, tree[i])
            i -= i & -i
        return top[0] - self.cost * (x[k] + y[k]), top[1]


def _links(x: np.ndarray, y: np.ndarray, n: np.ndarray, cost: float, look_back: int) -> tuple[np.ndarray, np.ndarray]:
    """Each run's best one before it (-1: none), and the shingles by which they overlap.

    Of the last ``look_back`` runs any may be followed, with or without an
    overlap; of the earlier ones those that end before the run.
    """
    xe, ye = x + n, y + n
    best, back, lost = n.astype(np.float64), np.full(len(n), -1), np.zeros(len(n), np.int64)
    reach = best + cost * (xe + ye)  # of two runs, the better one to follow after both have ended
    ends = _Ends(x, y, n, cost) if len(n) > look_back + 1 else None
    for k in range(1, len(n)):
        s = slice(max(0, k - look_back), k)
        over = np.maximum(np.maximum(xe[s] - x[k], ye[s] - y[k]), 0)
        gain = np.where((x[s] < x[k]) & (y[s] < y[k]) & (over < n[k]), reach[s] - (2 * cost + 1) * over, -np.inf)
        j = int(gain.argmax())
        top = float(gain[j]) - cost * (x[k] + y[k])
        far = ends.before(k, best) if ends else (-math.inf, -1)
        if far[0] > top:
            back[k], best[k] = far[1], best[k] + max(0.0, far[0])
        elif top > -np.inf:
            back[k], lost[k] = s.start + j, over[j]
            best[k] += max(0.0, top)
        reach[k] = best[k] + cost * (xe[k] + ye[k])
    return back, lost


def _chain(seg: np.ndarray, t: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """Longest similar span that ends with each segment: (start, end, start, end, similarity).

    A span with m aligned shingles and g others on both sides is similar if
    m >= g * similarity / (1 - similarity), so a segment's best chain is a sum
    over links; a segment follows one that starts before it in both texts, and
    loses the shingles by which they overlap.
    """
    x, y, n = seg.T
    xe, ye = x + n, y + n
    cost = similarity / max(1e-9, 1 - similarity)
    back, lost = _links(x, y, n, cost, LOOK_BACK)
    x, y, xe, ye, n, back, lost = (z.tolist() for z in (x, y, xe, ye, n, back, lost))
    out = []
    for k in range(len(n)):
        m, i, found = 0, k, None
        while i >= 0:
            m += n[i]
            long, wide = xe[k] - x[i], ye[k] - y[i]
            score = m / (long + wide - m)
            if min(long, wide) >= t and score >= similarity - 1e-12:
                found = (x[i], xe[k], y[i], ye[k], score)
            m -= lost[i]
            i = back[i]
        if found:
            out.append(found)
    return out


def passages(a: np.ndarray, b: np.ndarray, t: int, width: int, similarity: float,
             order: np.ndarray | None = None) -> list[tuple[int, int, int, int, float]]:
    """Spans of ``t`` shingles or more of a that are similar to a span of b: (start, end, start, end, similarity).

    Equal runs are chained by position, so the offset may drift, and texts in
    another order are chains of their own.  Reported is every maximal span from
    the start of one run to the end of another whose aligned shingles are
    ``similarity`` or more of all shingles of both sides (the Jaccard
    similarity; a repeated shingle counts each time).  An equal run of ``t``
    shingles always qualifies.  ``order``: the stable order of b, if known.
    """
    # m aligned of t shingles or more on either side
    least = 2 * t * similarity / (1 + similarity) - 1e-9
    if min(len(a), len(b)) < t:
        return []
    if len(a) == len(b) and np.array_equal(a, b):
        return [(0, len(a), 0, len(b), 1.0)]
    order = np.argsort(b, kind="stable") if order is None else order
    at = np.minimum(np.searchsorted(b, a, sorter=order), len(b) - 1)
    shared = np.flatnonzero(b[order[at]] == a)
    if len(shared) < least:
        return []
    seg = _segments(a, b, shared, order)
    found = set(_chain(seg, t, similarity))
    if len(seg) > 2:  # also by each segment's best successor
        back = np.stack((-seg[:, 0] - seg[:, 2], -seg[:, 1] - seg[:, 2], seg[:, 2]), axis=1)
        found |= {(-e, -s, -w, -u, score) for s, e, u, w, score in _chain(back[np.lexsort((back[:, 1], back[:, 0]))], t, similarity)}
    # those that reach further than the others on either side
    out = set()
    for side in (0, 2):
        far = -1
        for r in sorted(found, key=lambda r: (r[side], -r[side + 1], r)):
            if r[side + 1] > far:
                far = r[side + 1]
                out.add(r)
    return sorted(out)


# Documents whose windows are held at a time.
_DOCS = 400
# Hashes, or keys of the second round, that have to bring two documents together near one place.
AGREE = 2
# Pairs, or documents, whose ids are broadcast whole; of more documents a bit table is.
_SMALL = 500_000


def _emit(t: int, width: int, seeds: np.ndarray, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compact windows of (doc_id, text, f, i) batches: signature, document, centre and hash."""
    make = Shingles(width)
    for b in (whole.slice(s, _DOCS) for whole in batches for s in range(0, whole.num_rows, _DOCS)):
        cols: list[list[np.ndarray]] = [[] for _ in range(4)]
        for k, text in enumerate(b.column(1).to_pylist()):
            for j, (sig, _, centre, _) in enumerate(compact_windows(make.of(text), t, seeds)):
                for column, x in zip(cols, (_mix(sig + np.uint64(j)), np.full(len(sig), k), np.full(len(sig), j, np.int32), centre), strict=True):
                    column.append(x)
        if cols[0]:
            key, row, j, centre = (np.concatenate(c) for c in cols)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(b.column(c).take(at) for c in (0, 2, 3)), pa.array(centre, pa.int32()), pa.array(j)], names)


def _further_keys(s: np.ndarray, t: int, seeds: np.ndarray, windows: list[tuple[int, int]], centres: list[int]) -> Iterator[tuple[int, int, int]]:
    """(way, key, place) of a document's uncovered windows.

    Way 0: each run of ``t`` shingles around one of the ``centres``, by a hash of
    its shingles.  Way 1: each window (centre, hash) by its signature and the
    smallest shingle of the third of a window on either side that it reaches
    over.  Such a key stays where words are inserted or deleted elsewhere.
    """
    raw, n, side = s.tobytes(), len(s) - t, max(1, t // 3)
    for start in sorted({x for p in centres for x in range(max(0, p - t + 1), min(n, p) + 1)}):
        yield 0, xxhash.xxh64_intdigest(raw[8 * start:8 * (start + t)]), start
    for j in {j for _, j in windows}:
        value = _mix(s ^ seeds[j])
        near = _window_minima(value[None, :], side)[0]
        p = np.array([c for c, k in windows if k == j])
        for tag, at in ((1, p + 1), (2, p - side)):
            at_hand = (at >= 0) & (at < len(near))
            least = near[np.clip(at, 0, len(near) - 1)]
            reach = at_hand & (least > value[p])
            for key, place in zip(_mix(_mix(value[p] + np.uint64(tag)) ^ least)[reach].tolist(), p[reach].tolist(), strict=True):
                yield 1, key, place


def _merged(spans: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Spans that share a word are one, with the best similarity."""
    out: list[list] = []
    for s, e, score in sorted(spans):
        if out and s < out[-1][1]:
            out[-1][1:] = max(out[-1][1], e), max(out[-1][2], score)
        else:
            out.append([s, e, score])
    return [tuple(x) for x in out]


def _stars(names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key (column 0) and document: each row with the first document of its key (f, i, place)."""
    head = None
    for b in batches:
        if not b.num_rows:
            continue
        key, f, i, p = (b.column(k).to_numpy() for k in (0, 2, 3, 4))
        new = np.concatenate(([head is None or head[0] != key[0]], key[1:] != key[:-1]))
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        of, oi, op = (np.where(first >= 0, x[first], 0 if head is None else head[n]) for n, x in ((1, f), (2, i), (3, p)))
        pick = pa.array(np.flatnonzero((of != f) | (oi != i)))
        if len(pick):
            yield pa.RecordBatch.from_arrays([*(c.take(pick) for c in b.columns), *(pa.array(x).take(pick) for x in (of, oi, op.astype(np.int32)))], names)
        k = first[-1]
        head = (key[k], f[k], i[k], p[k]) if k >= 0 else head


def _agreeing(marks: list[int], places: list[int], near: int, need: int) -> bool:
    """Whether ``need`` different marks lie within ``near`` of each other."""
    last: dict[int, int] = {}
    for p, m in sorted(zip(places, marks, strict=True)):
        last[m] = p
        if sum(q >= p - near for q in last.values()) >= need:
            return True
    return False


def duplicate_passages(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, width: int = SHINGLE,
                       n_hashes: int = N_HASHES, seed: int = SEED, agree: int = AGREE) -> DataFrame:
    """Passages of ``min_words`` words or more that another document repeats, exactly or nearly.

    Tokens are shingles of ``width`` words (digits, a-z after lower-casing A-Z,
    non-ASCII).  For each of ``n_hashes`` hash functions the Cartesian tree of a
    text's hashes groups all its long enough subsequences into compact windows
    that share a min-hash.  Windows of one hash and signature are a star around
    the first document (by doc_id, nulls first, and row).  Two documents are
    candidates if ``agree`` hashes bring them together within a window's length;
    candidates are verified on their whole shingle sequences by ``passages``.

    Windows that no passage covers then go two further ways, once each.  Exact
    passages: of one hash, every run of the shortest length around the centre is
    hashed, and equal runs of two documents are passages as they are; each such
    passage has its runs around a centre in both documents, so none is missed
    unless the earlier one's is wholly inside a passage with another document.
    Near ones: the windows are starred anew by signature and the smallest
    shingle on one side, which documents with another passage around the
    signature do not share, and candidates not met before are verified.
    An exact passage is also found where it goes on beyond what an earlier document
    has.  A near passage is reported as far as the document that it was found with
    has it: an end that only two later documents nearly share may be missing.

    Returns a row for each merged passage: ``doc_id``, ``start_word``,
    ``end_word`` (exclusive), ``duplicate`` (an earlier document has it; false:
    the first), ``partner_id`` (smallest doc_id it was found with) and
    ``similarity`` (the best).  Ids may have any type that can be ordered.
    Null, empty and short texts have no passages; passages within one document
    are not compared.
    """
    t = min_words - width + 1
    seeds = _mix(np.arange(1, n_hashes + 1, dtype=np.uint64) * _STEP + np.uint64(seed))
    rows = row_ids(docs, "_r", ["doc_id", "text"]).select("doc_id", "text", F.col("_r.f").alias("f"), F.col("_r.i").alias("i"))
    kind = dict(rows.dtypes)["doc_id"]
    window, window_ddl = ["key", "doc_id", "f", "i", "p", "j"], f"key long, doc_id {kind}, f long, i long, p int, j int"
    span = ["f", "i", "duplicate", "s", "e", "of", "oi", "similarity"]
    span_ddl = "f long, i long, duplicate boolean, s int, e int, of long, oi long, similarity double"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _emit(t, width, seeds, window, batches)

    def stars(frame: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _stars([*window, "of", "oi", "op"], batches)

        return frame.select(*window).repartition("key").sortWithinPartitions("key", "doc_id", "f", "i", "p").mapInArrow(
            run, f"{window_ddl}, of long, oi long, op int")

    def candidates(links: DataFrame, mark: str) -> DataFrame:
        """(f, i, of, oi) whose links agree near one place, with the places."""
        pairs = links.groupBy("f", "i", "of", "oi").agg(F.collect_list(F.col(mark).cast("long")).alias("marks"), F.collect_list("p").alias("places"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = [_agreeing(m, p, t, agree) for m, p in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
                yield b.select([0, 1, 2, 3]).filter(pa.array(keep, pa.bool_()))

        return pairs.where(F.size("marks") >= agree).mapInArrow(run, "f long, i long, of long, oi long")

    def texts(keys: DataFrame) -> DataFrame:
        """Rows of the documents named by (f, i); where these are many, of a few others too."""
        there, key = keys.distinct(), F.xxhash64("f", "i")
        return rows.join(F.broadcast(there), ["f", "i"], "left_semi") if there.count() <= _SMALL else sharing_bits(rows, key, there, key)

    def verified(pairs: DataFrame) -> DataFrame:
        """Passages of each pair on either side: those of the later document are duplicates.

        Texts move, which pack better than the hashes of their shingles: a later
        document's once to its first one, a first one's once.
        """
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            make, last, whole, other, order = Shingles(width), None, None, None, None
            for b in batches:
                out: list[tuple] = []
                for r, (of, oi, y, x) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5), b.column(2), strict=True)):
                    if (of, oi) != last:
                        last, whole = (of, oi), y.as_py()
                        other = make.of(whole)
                        order = np.argsort(other, kind="stable")
                    text = x.as_py()
                    found = passages(other if text == whole else make.of(text), other, t, width, similarity, order)
                    out += [(r, True, s, e + width - 1, score) for s, e, score in _merged([(x[0], x[1], x[4]) for x in found])]
                    out += [(r, False, s, e + width - 1, score) for s, e, score in _merged([(x[2], x[3], x[4]) for x in found])]
                at, later = np.array([x[0] for x in out], np.int64), np.array([x[1] for x in out], bool)
                f, i, of, oi = (b.column(k).to_numpy()[at] for k in (0, 1, 3, 4))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.where(later, f, of)), pa.array(np.where(later, i, oi)), pa.array(later), *(pa.array([x[k] for x in out], pa.int32()) for k in (2, 3)),
                    pa.array(np.where(later, of, f)), pa.array(np.where(later, oi, i)), pa.array([x[4] for x in out], pa.float64())], span)

        text = ["f", "i", "text"]
        if pairs.count() <= _SMALL:
            mine = rows.select(*text).join(F.broadcast(pairs), ["f", "i"])
        else:
            mine = texts(pairs.select("f", "i")).select(*text).join(pairs, ["f", "i"])
        first = texts(pairs.select(F.col("of").alias("f"), F.col("oi").alias("i"))).select(*text).toDF("of", "oi", "other")
        both = mine.join(first, ["of", "oi"]).select(*text, "of", "oi", "other")
        return stored(both.mapInArrow(run, span_ddl))

    def uncovered(places: DataFrame, spans: DataFrame) -> DataFrame:
        """Rows whose place lies in no passage that an earlier document has."""
        found = spans.where("duplicate").groupBy("f", "i").agg(F.array_distinct(F.collect_list(F.struct("s", "e"))).alias("spans"))
        # of the first hash all runs around the centre have to be inside: an end may go on in two later documents
        reach = F.when(F.col("j") == 0, t - 1).otherwise(0)
        inside = F.exists("spans", lambda x: (x["s"] <= F.greatest(F.lit(0), F.col("p") - reach)) & (F.col("p") + reach < x["e"] - (width - 1)))
        return places.join(found, ["f", "i"], "left").where(F.coalesce(~inside, F.lit(True))).drop("spans")

    def further(left: DataFrame) -> DataFrame:
        """``_further_keys`` of the uncovered windows; runs also around the centres of the stars' first documents."""
        left, at = stored(left), F.struct("p", "j")
        one = F.when(F.col("j") == 0, F.col("p"))
        own = left.select("f", "i", at.alias("w"), one.alias("c"))
        heads = left.where("j = 0").select(F.col("of").alias("f"), F.col("oi").alias("i"), F.lit(None).cast("struct<p:int,j:int>").alias("w"), F.col("op").alias("c"))
        asked = stored(own.unionByName(heads).groupBy("f", "i").agg(F.collect_set("w").alias("windows"), F.collect_set("c").alias("centres")))
        h = texts(asked.select("f", "i")).join(asked, ["f", "i"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            make = Shingles(width)
            for b in batches:
                for r, (x, w, c) in enumerate(zip(b.column(3), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)):
                    found = list(_further_keys(make.of(x.as_py()), t, seeds, [(y["p"], y["j"]) for y in w], c))
                    at = pa.array([r] * len(found), pa.int64())
                    way, key, place = zip(*found, strict=True) if found else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(key, np.uint64).view(np.int64)), *(b.column(k).take(at) for k in range(3)),
                                                      pa.array(place, pa.int32()), pa.array(way, pa.int32())], window)

        return stored(h.select("doc_id", "f", "i", "text", "windows", "centres").mapInArrow(run, window_ddl))

    def exact(runs: DataFrame) -> DataFrame:
        """Equal runs, those that follow each other with one partner as one passage."""
        end = t + width - 1
        line = stars(runs).groupBy("f", "i", "of", "oi", (F.col("p") - F.col("op")).alias("o"), "p").agg(F.lit(1).alias("n")) \
            .withColumn("g", F.col("p") - F.row_number().over(Window.partitionBy("f", "i", "of", "oi", "o").orderBy("p")))
        found = stored(line.groupBy("f", "i", "of", "oi", "o", "g").agg(F.min("p").alias("s"), (F.max("p") + end).alias("e")))
        mine = found.select("f", "i", F.lit(True).alias("duplicate"), "s", "e", "of", "oi", F.lit(1.0).alias("similarity"))
        return mine.unionByName(found.select(F.col("of").alias("f"), F.col("oi").alias("i"), F.lit(False).alias("duplicate"), (F.col("s") - F.col("o")).alias("s"),
                                             (F.col("e") - F.col("o")).alias("e"), F.col("f").alias("of"), F.col("i").alias("oi"), F.lit(1.0).alias("similarity")))

    links = stored(stars(rows.mapInArrow(emit, window_ddl)).drop("key", "doc_id"))
    met = stored(candidates(links, "j"))
    spans = verified(met)
    keyed = further(uncovered(links, spans))
    spans = spans.unionByName(exact(keyed.where("j = 0")))
    again = candidates(stars(uncovered(keyed.where("j = 1"), spans)), "key")
    spans = spans.unionByName(verified(stored(again.join(met, ["f", "i", "of", "oi"], "left_anti"))))
    ids = rows.select("f", "i", "doc_id")
    found = spans.join(ids, ["f", "i"]).join(ids.toDF("of", "oi", "partner_id"), ["of", "oi"])
    # the passage of a hot first document is named by all its copies: they combine before the window
    spans = found.groupBy("f", "i", "doc_id", "duplicate", "s", "e").agg(F.min("partner_id").alias("partner_id"), F.max("similarity").alias("similarity"))
    before = Window.partitionBy("f", "i", "duplicate").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    marked = spans.withColumn("_new", (F.col("s") > F.coalesce(F.max("e").over(before), F.lit(-1))).cast("int"))
    group = Window.partitionBy("f", "i", "duplicate").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)
    merged = marked.withColumn("_g", F.sum("_new").over(group)).groupBy("f", "i", "doc_id", "duplicate", "_g").agg(
        F.min("s").alias("start_word"), F.max("e").alias("end_word"), F.min("partner_id").alias("partner_id"),
        F.max("similarity").alias("similarity"))
    # a head of a later round is named as such, but an earlier document may have its passage
    merged = stored(merged)
    later = merged.where("duplicate").select("f", "i", F.col("start_word").alias("_s"), F.col("end_word").alias("_e"))
    first = merged.where("not duplicate").join(later, ["f", "i"], "left")
    inside = F.coalesce((F.col("_s") <= F.col("start_word")) & (F.col("_e") >= F.col("end_word")), F.lit(False))
    names = ["doc_id", "start_word", "end_word", "duplicate", "partner_id", "similarity"]
    first = first.groupBy("f", "i", *names).agg(F.max(inside).alias("_inside")).where("not _inside")
    return merged.where("duplicate").select(*names).unionByName(first.select(*names))
