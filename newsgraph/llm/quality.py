"""Importance resampling towards a target text distribution."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgraph.llm.common import checkpoint, ordered_index, schema_of

BUCKETS = 10_000
# Bound on the target documents, the first in hash order, that the target model is fitted on.
TARGET_ROWS = 40_000
SEED = 29

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")


class Grams:
    """Hashed 1- and 2-grams of a text; word hashes are kept up to a bound."""

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def of(self, text: str | None) -> np.ndarray:
        words = _TOKEN.findall((text or "").lower())
        if not words:
            return np.empty(0, np.int64)
        if len(self.known) > 500_000:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = zlib.crc32(w.encode())
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(20)
        return (np.concatenate((h, pair)) % np.uint64(self.buckets)).astype(np.int64)


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, target_rows: int = TARGET_ROWS) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw), add-one smoothed.

    Raw counts cover all documents; the target model takes the labelled
    documents of quality 1, at most ``target_rows`` labels.  Without any the
    ratios are 0.
    """
    target = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    target = target.orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows).withColumn("_target", F.lit(1))
    rows = docs.select("doc_id", "text").join(F.broadcast(target), "doc_id", "left").select("text", F.col("_target").isNotNull().alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, n = Grams(buckets), np.zeros((2, buckets), np.int64)
        for b in batches:
            for text, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = np.bincount(grams.of(text), minlength=buckets)
                n[0] += c
                if t:
                    n[1] += c
        some = np.flatnonzero(n[0])
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[0][some]), pa.array(n[1][some])], ["bucket", "raw", "target"])

    # a row for each bucket at most
    got = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    n = np.ones((2, buckets))
    for bucket, raw, t in got:
        n[:, bucket] += (raw, t)
    if n[1].sum() == buckets:
        return np.zeros(buckets)
    p = np.log(n / n.sum(axis=1, keepdims=True))
    return p[1] - p[0]


def weigh(docs: DataFrame, ratios: np.ndarray, carry: list[str]) -> DataFrame:
    """``carry`` (as struct ``_carry``), ``_id``, ``n_grams`` and ``log_weight`` (the summed log ratio) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("int")
    slim = docs.select(carried.alias("_carry"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, r = Grams(len(shared.value)), shared.value
        for b in batches:
            t = pa.Table.from_batches([b])
            found = [(len(g), float(r[g].sum())) for g in map(grams.of, t.column("_text").to_pylist())]
            n, w = zip(*found, strict=True) if found else ((), ())
            t = t.drop_columns(["_text"]).append_column("n_grams", pa.array(n, pa.int64())).append_column("log_weight", pa.array(w, pa.float64()))
            yield from t.combine_chunks().to_batches()

    return slim.mapInArrow(run, schema_of(slim.drop("_text"), ("n_grams", T.LongType()), ("log_weight", T.DoubleType())))


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, carry: list[str] | None = None,
             seed: int = SEED, buckets: int = BUCKETS, target_rows: int = TARGET_ROWS) -> DataFrame:
    """A sample without replacement, drawn by importance: the Gumbel top k of all documents.

    The weight of a document is the ratio of its likelihoods under hashed n-gram
    models of target and raw text.  Adding Gumbel noise (a hash of seed and
    doc_id) to the log weight and taking the ``k`` largest draws k documents in
    proportion to their weights.  k is ``share`` of the documents, by default
    the share of quality 1 among the labels (without labels all).  Ties go to the smaller
    doc_id.  Null and empty texts weigh 0.  Returns ``carry`` (default doc_id),
    ``n_grams``, ``log_weight``, ``gumbel_key`` and ``rank`` (from 1) of the
    documents drawn; input columns of these names are replaced.
    """
    if share is None:
        good, known = labels.agg(F.count_if(F.col("quality") == 1), F.count("quality")).first()
        share = good / known if known else 1.0
    added = ("n_grams", "log_weight", "gumbel_key", "rank")
    carry = [c for c in (carry or ["doc_id"]) if c.lower() not in added]
    # narrow rows, written once: the sort reads them twice and would score the texts twice
    rows = checkpoint(weigh(docs, log_ratios(docs, labels, buckets, target_rows), carry))
    u = (F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = rows.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u))).withColumn("_one", F.lit(1).cast("long"))
    drawn, n, _ = ordered_index(rows, [F.col("gumbel_key").desc(), F.col("_id").asc_nulls_last()], "_one")
    return drawn.where(F.col("row_index") < round(share * n)).select(
        *[F.col("_carry").getField(c).alias(c) for c in carry], "n_grams", "log_weight", "gumbel_key", (F.col("row_index") + 1).alias("rank"))
