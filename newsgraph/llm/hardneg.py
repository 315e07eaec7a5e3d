"""Hard-negative mining: overlapping score windows answered from disjoint slots."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgraph.llm.common import checkpoint
from newsgraph.llm.topk import quantised

N_POSITIVES = 5
N_NEGATIVES = 10
# A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
# Anchors that travel to every task at a time.
ANCHOR_BLOCK = 2048
_ROWS = 1024
_EXACT = 1 << 53
_LAST = np.iinfo(np.int64).max


class Best:
    """Combiner: the ``k`` first rows of every group by (score descending, id ascending, null ids last)."""

    def __init__(self, groups: int, k: int):
        self.k, self.rows = k, [np.empty(0, np.int64)] * 4
        # a full group's last row: what a new one has to beat
        self.bar, self.bar_id = np.full(groups, np.iinfo(np.int64).min), np.full(groups, _LAST)

    def beats(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether rows may still be among the first of their group."""
        bar = self.bar[group]
        return (score > bar) | ((score == bar) & (ids <= self.bar_id[group]))

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        group, score, ids, row = (np.concatenate(x) for x in zip(self.rows, (group, score, ids, row), strict=True))
        order = np.lexsort((row, ids, -score, group))
        group = group[order]
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        place = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        keep = order[place < self.k]
        self.rows = [group[place < self.k], score[order][place < self.k], ids[keep], row[keep]]
        last = place == self.k - 1
        self.bar[group[last]], self.bar_id[group[last]] = score[order][last], ids[order][last]


class Anchors:
    """One block of anchors: their vectors, labels, row numbers and, later, slot limits."""

    def __init__(self, rows: list):
        self.row = np.array([r["row"] for r in rows], np.int64)
        self.label = np.array([r["label"] for r in rows])
        self.dim = max((len(r["q"]) for r in rows), default=0)
        self.q = _matrix([r["q"] for r in rows], self.dim)
        self.top = int(np.abs(self.q).max(initial=0))

    def scores(self, x: np.ndarray, of: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Inner product of the anchors ``of`` (rows) and every vector; doubles where they are exact."""
        exact = self.top * int(np.abs(x).max(initial=0)) * max(1, self.dim) < _EXACT
        kind = np.float64 if exact else np.int64
        return (self.q[of].astype(kind) @ x.astype(kind).T).astype(np.int64)


def _matrix(rows: list[list[int]], dim: int) -> np.ndarray:
    """Rows cut or zero-padded to ``dim`` components."""
    out = np.zeros((len(rows), dim), np.int64)
    for i, r in enumerate(rows):
        r = r[:dim]
        out[i, :len(r)] = r
    return out


def _chunks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple]:
    for b in batches:
        for s in range(0, b.num_rows, _ROWS):
            part = b.slice(s, _ROWS)
            ids = part.column(1).fill_null(_LAST).to_numpy()
            yield part.column(0).to_numpy(), ids, np.array(part.column(2).to_pylist()), _matrix(part.column(3).to_pylist(), dim)


def _rows_out(group: np.ndarray, rest: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    if len(group):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (group, *rest)], names)


def _positives(anchors: Anchors, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's ``k`` best rows of each anchor's label, itself left out."""
    best = Best(len(anchors.row), k)
    for row, ids, label, x in _chunks(batches, anchors.dim):
        for value in np.unique(label):
            mine, there = np.flatnonzero(anchors.label == value), np.flatnonzero(label == value)
            if not len(mine):
                continue
            s = anchors.scores(x[there], mine)
            ok = anchors.row[mine][:, None] != row[there][None, :]
            a, b = np.nonzero(ok & best.beats(mine[:, None], s, ids[there][None, :]))
            if len(a):
                best.add(mine[a], s[a, b], ids[there[b]], row[there[b]])
    group, score, _, row = best.rows
    yield from _rows_out(anchors.row[group], [row, score], ["anchor", "row", "score"])


def _negatives(anchors: Anchors, limits: np.ndarray, floor: np.ndarray, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's ``k`` best rows of other labels in each slot of each anchor.

    ``limits``: upper limits of an anchor's slots, descending; slot j holds the
    scores in (limits[j + 1], limits[j]], the last one those down to ``floor``.
    """
    slots = limits.shape[1]
    best = Best(limits.size, k)
    for row, ids, label, x in _chunks(batches, anchors.dim):
        s = anchors.scores(x)
        a, b = np.nonzero((s <= limits[:, :1]) & (s >= floor[:, None]) & (anchors.label[:, None] != label[None, :]))
        score = s[a, b]
        # limits descend: as many as are not below the score come before its slot's end
        group = a * slots + (limits[a] >= score[:, None]).sum(axis=1) - 1
        may = best.beats(group, score, ids[b])
        if may.any():
            best.add(group[may], score[may], ids[b[may]], row[b[may]])
    group, score, _, row = best.rows
    yield from _rows_out(anchors.row[group // slots], [(group % slots).astype(np.int32), row, score], ["anchor", "slot", "row", "score"])


def _block(items: DataFrame, rows: list, k_pos: int, k_neg: int, low: int, high: int) -> DataFrame:
    """Answers of one block of anchors."""
    sc = items.sparkSession.sparkContext
    anchors = Anchors(rows)
    shared, vectors, ids = sc.broadcast(anchors), items.select("row", "id", "label", "q"), items.select("row", "id")

    def positives(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _positives(shared.value, k_pos, it)

    by = Window.partitionBy("anchor").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    near = vectors.mapInArrow(positives, "anchor long, row long, score long").join(ids, "row")
    chosen = checkpoint(near.withColumn("p", F.row_number().over(by)).where(F.col("p") <= k_pos)
                        .select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "p"))
    # at most k_pos scores of each anchor of the block
    at = {int(r): i for i, r in enumerate(anchors.row)}
    none = -(1 << 62)
    limits, floor = np.full((len(rows), k_pos), none), np.full(len(rows), _LAST)
    upper = {}
    for r in chosen.select("anchor", "positive_score").collect():
        if r[1] >= 0:  # the window of a negative score is empty
            i = at[r[0]]
            upper.setdefault(i, set()).add(r[1] * high // 100)
            floor[i] = min(floor[i], -(-r[1] * low // 100))
    for i, found in upper.items():
        limits[i, :len(found)] = sorted(found, reverse=True)
    asked = sc.broadcast((limits, floor))

    def negatives(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _negatives(shared.value, *asked.value, k_neg, it)

    by_slot = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    held = vectors.mapInArrow(negatives, "anchor long, slot int, row long, score long").join(ids, "row")
    held = held.withColumn("rn", F.row_number().over(by_slot)).where(F.col("rn") <= k_neg)
    # at most k_pos slots of k_neg rows each, highest slot first
    slots = held.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "rn", F.col("id").alias("negative_id"), "score"))).alias("slots"))
    high_of, low_of = (F.col("positive_score") * high), (F.col("positive_score") * low)
    # a window's rows are the first ones of the slots from its own limit down
    suffix = F.slice(F.filter("slots", lambda r: r["score"] * 100 <= F.col("high_of")), 1, k_neg)
    answers = chosen.withColumn("high_of", high_of).withColumn("low_of", low_of).join(slots, "anchor") \
        .withColumn("hits", F.filter(suffix, lambda r: r["score"] * 100 >= F.col("low_of")))
    return checkpoint(answers.select("anchor", "positive_id", "positive_score", F.posexplode("hits").alias("i", "r"))
                      .select("anchor", "positive_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("r.negative_id").alias("negative_id"),
                              "positive_score", F.col("r.score").alias("negative_score")))


def mine(vectors: DataFrame, anchor: Column, label: Column | str = "label", n_positives: int = N_POSITIVES, n_negatives: int = N_NEGATIVES,
         low: int = LOW, high: int = HIGH, anchor_block: int = ANCHOR_BLOCK, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Hard negatives of every anchor and positive.

    ``anchor`` says which rows are anchors.  Scores are integer inner products of
    floor(256 * component); higher scores come first, ties by the smaller id
    (null last).  An anchor's positives are its first ``n_positives`` other rows
    of the same label; a positive's negatives are the first ``n_negatives`` rows
    of other labels with low * positive <= 100 * score <= high * positive (a
    negative positive score leaves none).  Rows with a null label, a null
    vector, or a null or non-finite component take no part; of vectors of unequal
    length the shorter counts as padded with zeros; repeated rows are rows of
    their own, as candidates and as anchors.  Returns ``anchor_id``,
    ``positive_id``, ``rank``, ``negative_id``, ``positive_score``,
    ``negative_score``; an empty table gives none.

    The windows of an anchor overlap, so they are not searched one by one.  Their
    upper limits split the scores into disjoint slots; each task keeps the first
    rows of every slot, a window over (anchor, slot) those of all tasks, and the
    answer of a limit is the head of the concatenated slots from there down.
    Anchors go in blocks of about ``anchor_block``, so that what is broadcast is
    bounded; each block passes over the vectors twice (once for its positives).
    """
    kept = quantised(vectors.withColumn("_label", F.col(label) if isinstance(label, str) else label).where("_label is not null"), vector)
    # labels become numbers: any type that can be compared may be a label
    items = checkpoint(kept.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                                   F.xxhash64("_label").alias("label") if dict(kept.dtypes)["_label"] == "string" else F.col("_label").cast("long").alias("label"),
                                   "q", F.coalesce(anchor, F.lit(False)).alias("asked")))
    asked = items.where("asked").select("row", "label", "q")
    blocks = max(1, -(-asked.count() // anchor_block))
    found = []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).collect()
        if rows:
            found.append(_block(items, rows, n_positives, n_negatives, low, high))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not found:
        return vectors.sparkSession.createDataFrame([], schema)
    names = items.where("asked").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return reduce(DataFrame.unionByName, found).join(names, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
