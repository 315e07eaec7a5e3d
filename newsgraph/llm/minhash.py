"""MinHash near-duplicates: one-permutation hashing, densified, with star-shaped candidate edges."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgraph.llm.common import checkpoint, fresh, row_ids, schema_of
from newsgraph.llm.components import components

SHINGLE = 2
# Links: 100 * intersection >= PERCENT * union.
PERCENT = 80
# One hash function deals the shingles over this many bins (a power of two).
BINS = 256
# Bins of one band; two sets of similarity 0.8 share 17 of the 51 bands on average.
BAND = 5
# Pairs that differ in more of the 256 sketch bits are no candidates: at similarity 0.8 they
# differ in 26 bits with a deviation of 6.
MAX_SKETCH_BITS = 68
# Classes that a task holds while the others of their buckets stream by, and of these for one task.
ASKING, ASKED = 512, 8192
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_CHUNK = 1 << 15


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) >= width:
        ends, starts = ends[width - 1:], starts[:len(starts) - width + 1]
    else:
        starts, ends = starts[:1], ends[-1:]
    found = []
    for at in range(0, len(starts), _CHUNK):
        pairs = zip(starts[at:at + _CHUNK].tolist(), ends[at:at + _CHUNK].tolist(), strict=True)
        found.append(np.fromiter((xxhash.xxh64_intdigest(flat[s:e]) for s, e in pairs), np.uint64))
    return np.unique(np.concatenate(found))


@cache
def _probes(bins: int) -> np.ndarray:
    """Row i: the place of every bin in the order in which bin i, if empty, looks for one to borrow from."""
    rng, out = np.random.RandomState(11), np.empty((bins, bins), np.uint16)
    for i in range(bins):
        out[i, rng.permutation(bins)] = np.arange(bins)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX2
    return x ^ (x >> np.uint64(32))


def signature(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One-permutation signature of a non-empty set of sorted hashes, with optimal densification.

    The top bits of a hash choose its bin, the smallest hash of a bin is its value.
    An empty bin takes the value of the first non-empty bin in a random order of
    its own, independently of every other bin.
    """
    bin_of = (hashes >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    first = np.concatenate(([True], bin_of[1:] != bin_of[:-1]))
    full, values = bin_of[first], hashes[first]
    out = values[_probes(bins)[:, full].argmin(axis=1)]
    out[full] = values
    return out


def bands_and_sketch(values: np.ndarray, band: int = BAND) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key of each band of a signature, and one bit of each bin."""
    n = len(values) // band
    keys = np.arange(n, dtype=np.uint64)
    for column in values[:n * band].reshape(n, band).T:
        keys = _mixed(keys ^ column)
    bits = (_mixed(values ^ _mixed(np.arange(1, len(values) + 1, dtype=np.uint64))) & np.uint64(1)).astype(np.uint8)
    return keys.view(np.int64), np.packbits(bits).view(np.int64)


def _signed_rows(docs: DataFrame, width: int) -> DataFrame:
    """The other columns, set size, digest of the set, band keys and sketch of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            sizes, digests, keys, sketches = [], [], [], []
            for x in t.column("_text").to_pylist():
                h = shingle_hashes(x, width)
                sizes.append(len(h))
                digests.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                k, s = bands_and_sketch(signature(h)) if len(h) else (None, None)
                keys.append(k)
                sketches.append(s)
            t = t.drop_columns(["_text"])
            for values, kind in ((sizes, pa.int64()), (digests, pa.binary()), (keys, pa.list_(pa.int64())), (sketches, pa.list_(pa.int64()))):
                t = t.append_column(f"c{t.num_columns}", pa.array(values, kind))
            yield from t.rename_columns([*t.column_names[:-4], "_n", "_digest", "_keys", "_sketch"]).combine_chunks().to_batches()

    longs = T.ArrayType(T.LongType())
    return docs.mapInArrow(run, schema_of(docs.drop("_text"), ("_n", T.LongType()), ("_digest", T.BinaryType()), ("_keys", longs), ("_sketch", longs)))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """``cid`` and the whole set, as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([shingle_hashes(x, width).tobytes() for x in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), found], ["cid", "hashes"])

    return docs.select("cid", "_text").mapInArrow(run, "cid long, hashes binary")


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, last, v = [], None, None
            for x, y in zip(b.column(2), b.column(3), strict=True):
                u = np.frombuffer(x.as_buffer(), np.uint64)
                if last is None or y != last:
                    last, v = y, np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(v, u), len(v) - 1)
                common = int(np.count_nonzero(v[at] == u))
                keep.append(100 * common >= percent * (len(u) + len(v) - common))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "u long, v long")


def _alike(percent: int) -> Column:
    """Whether sizes and sketches of a pair leave a similarity of ``percent`` possible."""
    bits = sum((F.bit_count(F.col("us")[i].bitwiseXOR(F.col("vs")[i])) for i in range(1, BINS // 64)), F.bit_count(F.col("us")[0].bitwiseXOR(F.col("vs")[0])))
    return (F.least("un", "vn") * 100 >= F.greatest("un", "vn") * percent) & (bits <= MAX_SKETCH_BITS)


def _held_against(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (g, blk, salt, kind, cid, root, hashes) in order: the asking classes (kind 0) of a block, then those asked.

    Every asked set meets all the asking ones at once, through an index of their
    hashes; a link goes out for each asking class and component met first.
    """
    at, held, index = None, [], None
    for b in batches:
        cols = [c.to_pylist() for c in b.columns[:6]]
        found = []
        for i, (g, blk, salt, kind, cid, root) in enumerate(zip(*cols, strict=True)):
            if (g, blk, salt) != at:
                at, held, index = (g, blk, salt), [], None
            h = np.frombuffer(b.column(6)[i].as_buffer(), np.uint64)
            if kind == 0:
                held.append((cid, root, h))
                continue
            if index is None:
                sizes = np.array([len(x[2]) for x in held])
                owner, flat = np.repeat(np.arange(len(held)), sizes), np.concatenate([x[2] for x in held])
                order = np.argsort(flat, kind="stable")
                index = (flat[order], owner[order], sizes, np.array([x[1] for x in held]), [set() for _ in held])
            flat, owner, sizes, roots, met = index
            low, high = np.searchsorted(flat, h, "left"), np.searchsorted(flat, h, "right")
            n = high - low
            common = np.bincount(owner[np.repeat(high - np.cumsum(n), n) + np.arange(n.sum())], minlength=len(held)) if n.any() else np.zeros(len(held), int)
            for x in np.flatnonzero((100 * common >= percent * (sizes + len(h) - common)) & (roots != root)):
                if root not in met[x]:
                    met[x].add(root)
                    found.append((held[x][0], cid))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])


def _missed_by_stars(members: DataFrame, root: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links between members of a bucket that stars left in different components: ``u``, ``v``.

    In such an open bucket the members outside its largest component ask; all
    its members are asked.  The asking ones are held in blocks (those of near
    buckets together, known by their smallest centre), and the asked sets stream
    by a block once however many buckets they share with it.  No pair is a row
    before it is a link.
    """
    rooted = root.toDF("cid", "root")
    placed = members.join(rooted, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    most = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(
        F.max_by("root", F.struct("n", "root")).alias("largest"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    asking = checkpoint(placed.join(most, "key").where("root <> largest").select("key", "cid", "head", "root"))
    if asking.isEmpty():
        return None
    rank = F.row_number().over(Window.partitionBy("g").orderBy("cid"))
    block = checkpoint(asking.groupBy("cid").agg(F.min("head").alias("g"), F.min("root").alias("root"))
                       .withColumn("blk", F.floor((rank - 1) / ASKING).cast("int")))
    keys = asking.select("key", "cid").join(block.select("cid", "g", "blk"), "cid").select("key", "g", "blk").distinct()
    asked = checkpoint(keys.join(members.select("key", "cid"), "key").select("g", "blk", "cid").distinct())
    salts = asked.groupBy("g", "blk").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("salts"))
    left = block.join(salts, ["g", "blk"]).select("g", "blk", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                                                  F.lit(0).alias("kind"), "cid", "root")
    right = asked.join(salts, ["g", "blk"]).join(rooted, "cid", "left").select(
        "g", "blk", F.expr("cast(pmod(xxhash64(cid), salts) as int)").alias("salt"), F.lit(1).alias("kind"), "cid", F.coalesce("root", "cid").alias("root"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _held_against(percent, batches)

    rows = left.unionByName(right).join(sets, "cid").select("g", "blk", "salt", "kind", "cid", "root", "hashes")
    return checkpoint(rows.repartition("g", "blk", "salt").sortWithinPartitions("g", "blk", "salt", "kind", "cid").mapInArrow(run, "u long, v long"))


def class_links(texts: DataFrame, classes: DataFrame, percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """Component of every class that is linked: ``node``, ``root``.

    ``texts``: ``rid``, ``_text``.  ``classes``: ``cid``, ``rid`` (row of one of
    its documents), ``n``, ``keys``, ``sketch``.  A bucket holds the classes with
    one band key.  Its smallest class is the centre of a star: the others meet
    it, and only pairs that their sizes and sketches leave possible move their
    sets to be compared in full, so a group of near copies costs an edge a
    member.  A bucket whose members are one component then is done.  In the
    others, members may be alike that are both unlike the centre, and
    ``_missed_by_stars`` compares them in full.
    """
    keyed = classes.select(F.explode("keys").alias("key"), "cid")
    # the smallest members are summed up on the map side, so a hot key is a row for each task
    several = keyed.groupBy("key").agg(F.min("cid").alias("head"), F.max("cid").alias("last")).where("head <> last")
    members = checkpoint(keyed.join(several.select("key", "head"), "key"))
    slim = classes.select("cid", "n", "sketch")
    wanted = classes.select("cid", "rid").join(members.select("cid").distinct(), "cid")
    sets = checkpoint(_sets(texts.join(wanted, "rid"), width))
    pairs = members.where("cid <> head").select(F.col("cid").alias("u"), F.col("head").alias("v")).distinct()
    near = pairs.join(slim.toDF("u", "un", "us"), "u").join(slim.toDF("v", "vn", "vs"), "v").where(_alike(percent)).select("u", "v")
    whole = near.join(sets.toDF("u", "uh"), "u").join(sets.toDF("v", "vh"), "v").select("u", "v", "uh", "vh")
    found = checkpoint(_verified(whole, percent))
    root = checkpoint(components(found))
    more = _missed_by_stars(members, root, sets, percent)
    return root if more is None else components(found.unionByName(more))


def near_duplicates(docs: DataFrame, carry: list[str] | None = None, width: int = SHINGLE, percent: int = PERCENT,
                    id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Set size, component and representative of every document.

    Words are runs of non-blank characters after lower-casing A-Z; a document's
    set holds its distinct ``width``-word shingles (a shorter text is one
    shingle).  Documents are linked if 100 * intersection >= ``percent`` * union,
    which is worked out on the whole sets.  A text without words and a null text
    are linked with nothing: such a row is a component of its own.  Returns
    ``carry`` (default: the id), ``n_shingles``, ``component_id`` (smallest id
    reachable, null only if all of them are null) and ``kept`` (the row's id is
    its component's, repeated rows included), a row for each row given; an empty
    table gives none.  Input columns of these names are replaced.

    Equal sets are one class, known by a 128-bit digest.  The classes' signatures
    (one-permutation hashing, optimal densification) are cut into bands, and
    classes that share a band are candidates, see ``class_links``.
    """
    if percent < PERCENT:
        raise ValueError(f"the bands are laid out for a similarity of {PERCENT} % or more")
    made = ("n_shingles", "component_id", "kept")
    carry = [c for c in (carry or [id_col]) if c.lower() not in made]
    rid = fresh(docs, "_rid")
    numbered = row_ids(docs, rid).select(F.struct(*[F.col(c) for c in carry]).alias("_carry"), F.col(id_col).alias("_id"),
                                         F.col(rid).alias("rid"), F.col(text).alias("_text"))
    rows = checkpoint(_signed_rows(numbered, width))
    grouped = rows.where("_n > 0").groupBy("_digest").agg(
        F.min("_id").alias("first_id"), F.min("rid").alias("rid"), F.first("_n").alias("n"), F.first("_keys").alias("keys"), F.first("_sketch").alias("sketch"))
    classes = checkpoint(grouped.withColumn("cid", F.monotonically_increasing_id()))
    root = class_links(numbered.select("rid", "_text"), classes, percent, width)
    placed = classes.select("cid", "_digest", "first_id").join(root.withColumnRenamed("node", "cid"), "cid", "left") \
        .withColumn("root", F.coalesce("root", "cid"))
    names = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = placed.join(names, "root").select("_digest", "component_id")
    out = rows.select("_carry", "_id", "_n", "_digest").join(named, "_digest", "left")
    component = F.when(F.col("_n") > 0, F.col("component_id")).otherwise(F.col("_id"))
    return out.select("_carry.*", F.col("_n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("_id")).alias("kept"))
