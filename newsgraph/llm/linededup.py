"""Removal of repeated multi-line chunks with content-defined boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgraph.llm.common import checkpoint, fresh, row_ids

# A chunk ends where the rolling hash of three lines is 0 modulo 4: four lines on average.
DIVISOR = 4
ROLL = (1, 257, 66049)
MIN_LINES = 2


def _chunks(docs: DataFrame, keep: list[str], divisor: int) -> DataFrame:
    """``keep`` and ``_chunks``, the chunks in order as structs (n, text); null for a null text."""
    lines = F.split("text", "\n", -1)
    number = lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")
    out = docs.select(*keep, lines.alias("_lines"), F.transform(lines, number).alias("_hash"))
    before = lambda i, k: F.coalesce(F.get("_hash", i - k), F.lit(0).cast("long"))
    roll = F.transform("_hash", lambda h, i: h * ROLL[0] + before(i, 1) * ROLL[1] + before(i, 2) * ROLL[2])
    out = out.select(*keep, "_lines", roll.alias("_roll"))
    last = F.size("_roll") - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (F.get("_roll", i) % divisor == 0))
    out = out.select(*keep, "_lines", F.when(F.col("_roll").isNotNull(), ends).alias("_ends"))
    spans = F.transform("_ends", lambda e, i: F.struct(
        F.coalesce(F.get("_ends", i - 1), F.lit(-1)).alias("s"), (e - F.coalesce(F.get("_ends", i - 1), F.lit(-1))).alias("n")))
    return out.select(*keep, F.transform(spans, lambda x: F.struct(
        x["n"].cast("long").alias("n"), F.array_join(F.slice("_lines", x["s"] + 2, x["n"]), "\n").alias("text"))).alias("_chunks"))


def _repeatable(chunked: DataFrame, keep: list[str], min_lines: int, *value: Column) -> DataFrame:
    # the outer form: the optimizer would push a filter on the array of the inner one below all that computes it
    rows = chunked.select(*keep, F.posexplode_outer("_chunks").alias("_at", "_c")).where(F.col("_c.n") >= min_lines)
    return rows.select(*keep, "_at", F.md5("_c.text").alias("_digest"), F.col("_c.n").alias("_n"), *value)


def dedup_lines(docs: DataFrame, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """The documents without the multi-line chunks that stand earlier in the corpus.

    Lines end at a line feed.  Rolling hashes over the hashes of three lines
    choose the chunk boundaries, so an insertion moves only the boundaries next
    to it.  Of all chunks of ``min_lines`` lines or more with the same bytes the
    first stays, in the order of doc_id (nulls last), row and position; equal
    digests only propose, the texts are compared.  All columns and rows are
    kept (a text may become empty; null stays null); adds ``n_lines``,
    ``n_lines_removed`` and ``n_chunks_removed``, in place of columns of these names.

    Only DataFrame operations.  Digests are counted and matched without texts;
    the texts meet the marks of their row, then those of repeated chunks the
    first copy, then each row its removals.
    """
    docs = docs.drop("n_lines", "n_lines_removed", "n_chunks_removed")
    rid = fresh(docs, "_rid")
    others = F.struct(*[c for c in docs.columns if c != "text"])
    rows = row_ids(docs, rid).select(others.alias("_row"), "doc_id", "text", F.col(rid).alias("_rid"))
    key = ["_rid", "doc_id"]
    chunked = _chunks(rows, key, divisor)
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "_rid", "_at")
    counts = _repeatable(chunked, key, min_lines).groupBy("_digest").agg(F.count(F.lit(1)).alias("_copies"), F.min(order).alias("_first"))
    repeated = checkpoint(counts.where("_copies > 1").select("_digest", F.col("_first._rid").alias("_frid"), F.col("_first._at").alias("_fat")))
    members = _repeatable(chunked, key, min_lines).drop("doc_id").join(repeated, "_digest")
    marks = members.groupBy("_rid").agg(F.collect_list(F.struct(
        "_at", "_digest", "_n", ((F.col("_rid") == F.col("_frid")) & (F.col("_at") == F.col("_fat"))).alias("first"))).alias("_marks"))
    # only now the texts, and only of repeated chunks; naming the array twice keeps it from being worked out for each mark
    wide = _chunks(rows.select("_rid", "text").join(marks, "_rid"), ["_rid", "_marks"], divisor)
    texts = wide.select("_rid", F.explode_outer(F.when(F.size("_chunks") > 0, F.transform("_marks", lambda m: F.struct(
        m["_at"].alias("at"), m["_digest"].alias("digest"), m["_n"].alias("n"), m["first"].alias("first"),
        F.get("_chunks", m["_at"])["text"].alias("text"))))).alias("m")).select("_rid", "m.*")
    first = texts.where("first").select("digest", F.col("text").alias("_ftext"))
    later = texts.where("not first").join(first, "digest").where(F.col("text") == F.col("_ftext"))
    gone = later.groupBy("_rid").agg(F.collect_list("at").alias("_gone"), F.sum("n").alias("_n_gone"))
    whole = rows.select("_row", "text", "_rid").join(gone, "_rid", "left")
    whole = _chunks(whole, ["_row", "text", "_gone", "_n_gone"], divisor).withColumn(
        "_n_lines", F.size(F.split("text", "\n", -1)).cast("long"))
    every = F.sequence(F.lit(0), F.size("_chunks") - 1)
    kept = whole.withColumn("_left", F.when(F.col("_gone").isNotNull(), F.array_except(every, "_gone")))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.when(F.size("_chunks") > 0, F.array_join(
        F.transform("_left", lambda i: F.get("_chunks", i)["text"]), "\n")))
    return kept.select(
        *[text.alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns],
        F.when(F.col("text").isNotNull(), F.col("_n_lines")).otherwise(F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("_n_gone", F.lit(0)).cast("long").alias("n_lines_removed"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_chunks_removed"))
