"""SimHash near-duplicates through pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgraph.llm.common import checkpoint, fresh, row_ids, schema_of
from newsgraph.llm.components import components

SHINGLE = 4
MAX_BITS = 4
N_PIVOTS = 16
# Two fingerprints at most 4 bits apart agree on at least 3 of 7 blocks.
BLOCKS = 7
# Distinct fingerprints of one bucket that a task compares; larger buckets take the exact midpoint join.
BUCKET_ROWS = 20_000
_CHUNK = 1 << 15


def fingerprint(text: str | None, width: int = SHINGLE) -> bytes:
    """Fingerprint of a text as 8 bytes, most significant first (no words: zero)."""
    words = text.encode().lower().split() if text else []
    if not words:
        return bytes(8)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) >= width:
        ends, starts = ends[width - 1:], starts[:len(starts) - width + 1]
    else:
        starts, ends = starts[:1], ends[-1:]
    n, count = len(starts), np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = b"".join([xxhash.xxh64_digest(flat[s:e], 42) for s, e in
                         zip(starts[at:at + _CHUNK].tolist(), ends[at:at + _CHUNK].tolist(), strict=True)])
        count += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(count * 2 > n).tobytes()


def fingerprints(docs: DataFrame, carry: list[str], width: int = SHINGLE) -> DataFrame:
    """``carry`` and ``fp`` (the fingerprint's bits as a signed long) of every document."""
    mark = fresh(docs, "_text")
    slim = docs.select(*carry, F.col("text").alias(mark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            fp = np.frombuffer(b"".join([fingerprint(x, width) for x in t.column(mark).to_pylist()]), ">i8")
            t = t.drop_columns([mark]).append_column("fp", pa.array(fp.astype(np.int64)))
            yield from t.to_batches()

    return slim.mapInArrow(run, schema_of(slim.drop(mark), ("fp", T.LongType())))


def block_masks(max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> list[int]:
    """Masks over every choice of blocks that a linked pair agrees on at least once."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(block, blocks - max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Linker:
    """Links of one bucket: pivot tables discard pairs, the survivors are verified.

    A pair is linked in the first of the buckets that it shares, so that no link
    is emitted by several.
    """

    def __init__(self, masks: list[int], pivots: list[int], max_bits: int):
        self.masks, self.max_bits = np.array(masks, np.uint64), max_bits
        self.pivots = np.array(pivots, np.uint64)

    def table(self, f: np.ndarray) -> np.ndarray:
        return np.bitwise_count(f[:, None] ^ self.pivots[None, :]).astype(np.int8)

    def own(self, a: np.ndarray, b: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Whether mask i is the first on which a and b agree."""
        return (((a ^ b)[:, None] & self.masks[None, :]) == 0).argmax(axis=1) == i

    def close(self, f: np.ndarray, t: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Positions of the pairs (f[x], f[y]) that are linked."""
        near = np.flatnonzero(np.abs(t[x] - t[y]).max(axis=1, initial=0) <= self.max_bits)
        return near[np.bitwise_count(f[x[near]] ^ f[y[near]]) <= self.max_bits]

    def small(self, f: np.ndarray, group: np.ndarray, mask: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """All links of many small buckets at once, by distance d between sorted rows."""
        t, left, right = self.table(f), [], []
        for d in range(1, longest):
            x = np.flatnonzero(group[d:] == group[:-d])
            if not len(x):
                break
            x = x[self.close(f, t, x, x + d)]
            x = x[self.own(f[x], f[x + d], mask[x])] if len(x) else x
            left.append(f[x])
            right.append(f[x + d])
        none = np.empty(0, np.uint64)
        return np.concatenate([none, *left]), np.concatenate([none, *right])

    def large(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of one large bucket.

        Fingerprints not yet within reach of a leader become leaders, themselves
        pivots: each is compared with the whole bucket.  Members of two balls can
        be linked only if their leaders are at most 3 * max_bits apart; such balls
        in different trees are compared through the pivot tables.
        """
        t, m, r = self.table(f), len(f), self.max_bits
        label, ball = np.arange(m), np.full(m, -1)
        left, right, leaders = [], [], []

        def join(x: int, ys: np.ndarray) -> None:
            _, first = np.unique(label[ys], return_index=True)
            for y in ys[first]:
                if label[y] != label[x]:
                    left.append(f[x])
                    right.append(f[y])
                    label[label == label[y]] = label[x]

        for x in range(m):
            if ball[x] < 0:
                near = np.flatnonzero(np.bitwise_count(f ^ f[x]) <= r)
                ball[near[ball[near] < 0]] = x
                leaders.append(x)
                if len(near) > 1:
                    join(x, near)
        order = np.argsort(ball, kind="stable")
        heads, first, sizes = np.unique(ball[order], return_index=True, return_counts=True)
        wide = {int(h): order[s:s + n] for h, s, n in zip(heads, first, sizes, strict=True) if n > 1}
        hub = np.array(list(wide), np.int64)
        for k, a in enumerate(hub):
            rest = hub[k + 1:]
            for b in rest[np.bitwise_count(f[rest] ^ f[a]) <= 3 * r]:
                if label[a] == label[b]:
                    continue
                for x in wide[int(a)]:
                    y = wide[int(b)]
                    y = y[self.close(f, t, np.full(len(y), x), y)]
                    if len(y):
                        join(x, y[:1])
                        break
        return np.array(left, np.uint64), np.array(right, np.uint64)


def _link_buckets(linker: Linker, bucket_rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (mask, key): links as (fp, fp, null); buckets over the bound as (fp, null, mask)."""
    def out(a, b=None, i=None):
        n, a = len(a), a.astype(np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array(a), pa.nulls(n, pa.int64()) if b is None else pa.array(b.astype(np.uint64).view(np.int64)),
            pa.nulls(n, pa.int32()) if i is None else pa.array(np.full(n, i, np.int32))], ["u", "v", "mask"])

    def settle(mask, key, f):
        new = np.concatenate(([True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])))
        group = np.cumsum(new) - 1
        size = np.bincount(group)[group]
        some = (size > 1) & (size <= 32)
        if some.any():
            a, b = linker.small(f[some], group[some], mask[some], int(size[some].max()))
            if len(a):
                yield out(a, b)
        starts = np.flatnonzero(new)
        for s in starts[size[starts] > 32]:
            e = s + size[s]
            a, b = linker.large(f[s:e])
            if len(a):
                yield out(a, b)

    held, over = None, None  # rows of the last bucket so far; the bucket that is over the bound
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        mask, key, f = now
        if over is not None:
            n = len(mask) if (same := (mask == over[0]) & (key == over[1])).all() else int(np.argmin(same))
            if n:
                yield out(f[:n], i=over[0])
            mask, key, f = mask[n:], key[n:], f[n:]
            if not len(mask):
                held = None
                continue
            over = None
        cut = int(np.argmax((mask == mask[-1]) & (key == key[-1])))
        if cut:
            yield from settle(mask[:cut], key[:cut], f[:cut])
        held = [mask[cut:], key[cut:], f[cut:]]
        if len(held[0]) > bucket_rows:
            over, held = (held[0][0], held[1][0]), None
            yield out(f[cut:], i=over[0])
    if held is not None:
        yield from settle(*held)


def links(fps: DataFrame, max_bits: int = MAX_BITS, n_pivots: int = N_PIVOTS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges ``u``, ``v`` whose components are those of all pairs within ``max_bits``.

    ``fps``: distinct fingerprints in column ``fp``.  Each goes to one bucket for
    each choice of blocks; linked pairs share a bucket.  The reference
    fingerprints are the first of the data in hash order.  A bucket of more than
    ``bucket_rows`` fingerprints is resolved by a join on midpoints instead: two
    fingerprints are within ``max_bits`` exactly if a word lies within half of
    that from both, so each emits its neighbours in the free bits and all that
    emit one word are linked to the smallest of them.
    """
    if max_bits % 2:
        raise ValueError("max_bits must be even: an odd bound has no midpoint")
    masks = block_masks(max_bits)
    pivots = [r[0] % (1 << 64) for r in fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(n_pivots).collect()]
    linker = Linker(masks, pivots, max_bits)
    keyed = fps.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for i, m in enumerate(masks)])).alias("b"), "fp").select("b.mask", "b.key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _link_buckets(linker, bucket_rows, batches)

    found = checkpoint(keyed.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
                       .mapInArrow(run, "u long, v long, mask int"))
    flips = F.expr("CASE mask " + " ".join(
        f"WHEN {i} THEN array({','.join(f'{_signed(1 << b)}L' if b < 63 else 'shiftleft(1L, 63)' for b in range(64) if not m >> b & 1)})"
        for i, m in enumerate(masks)) + " END")
    half = max_bits // 2
    dense = found.where("v is null").select("mask", F.col("u").alias("fp")).distinct().withColumn("word", F.col("fp"))
    steps = [dense]
    for _ in range(half):
        steps.append(steps[-1].select("mask", "fp", "word", F.explode(flips).alias("bit"))
                     .select("mask", "fp", F.expr("word ^ bit").alias("word")))
    near = steps[0]
    for s in steps[1:]:
        near = near.unionByName(s)
    low = near.groupBy("mask", "word").agg(F.min("fp").alias("low"))
    wide = near.join(low, ["mask", "word"]).where("fp <> low").select(F.col("fp").alias("u"), F.col("low").alias("v")).distinct()
    return found.where("v is not null").select("u", "v").unionByName(wide)


def _hex(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, max_bits: int = MAX_BITS, carry: list[str] | None = None,
                    bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Fingerprint and component of every document.

    Words are runs of non-blank characters after lower-casing A-Z; a shingle is
    ``width`` words (a shorter text is one shingle, a text without words or a
    null text has fingerprint zero and is linked like any other).  Documents
    within ``max_bits`` bits are linked; ``component_id`` is the smallest doc_id
    reachable (null only if all are null).  Returns ``carry`` (default: doc_id),
    ``fingerprint``, ``component_id`` and ``component_fingerprint`` (of the
    component's smallest fingerprint), a row for each row given; an empty table
    gives none.  Texts are read once and do not shuffle; equal
    fingerprints collapse to one node before any comparison.
    """
    carry = [c for c in (carry or ["doc_id"]) if c not in ("fp", "fingerprint", "component_id", "component_fingerprint")]
    rows = checkpoint(fingerprints(docs, carry, width))
    nodes = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    root = components(links(nodes.select("fp"), max_bits, bucket_rows=bucket_rows))
    placed = nodes.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # written before the join, which then is free to split a hot root
    names = checkpoint(placed.groupBy("root").agg(F.min("first_doc").alias("component_id")))
    named = placed.join(names, "root").select("fp", "component_id", "root")
    return rows.join(named, "fp").select(*carry, _hex("fp").alias("fingerprint"), "component_id",
                                         _hex("root").alias("component_fingerprint"))


def representatives(docs: DataFrame, width: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each group: that of the smallest doc_id (null first), then text hash.

    All columns are kept; of rows equal in doc_id and text the first stays.  Rows
    are chosen by their numbers, so the texts travel once.
    """
    rid = fresh(docs, "_rid")
    rows = row_ids(docs, rid)
    mark = rows.select("doc_id", "text", F.xxhash64("text").alias("_h"), F.col(rid).alias("_r"))
    found = near_duplicates(mark, width, max_bits, carry=["doc_id", "_h", "_r"])
    best = found.groupBy("component_fingerprint").agg(F.min(F.struct("doc_id", "_h", "_r"))["_r"].alias(rid))
    return rows.join(best.select(rid), rid, "left_semi").drop(rid)
