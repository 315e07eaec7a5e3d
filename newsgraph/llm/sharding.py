"""Contiguous shards of equal byte size from global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgraph.llm.common import ordered_index

N_SHARDS = 24
ROW_OVERHEAD = 8


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus the per-row overhead."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(ROW_OVERHEAD)).cast("long")


def shard(docs: DataFrame, n_shards: int = N_SHARDS, carry: list[str] | None = None) -> DataFrame:
    """Cut the documents, in doc_id order, into ``n_shards`` runs of near-equal bytes.

    Law ``bytes``: with S the total size, the row whose middle byte lies at
    position m of the concatenation goes to shard ``floor(m * n_shards / S)``,
    so no shard is further from S / n_shards than one row.  Prefix sums come
    from per-partition totals (``ordered_index``).  Rows are ordered by doc_id
    (nulls first), text checksum and size; rows that tie in all three are equal
    in every column returned.  Carries the columns ``carry`` (default: all, so
    the texts travel once) and adds ``size``, ``text_crc32`` (null for a null
    text), ``law``, ``shard``, ``slot`` (gapless from 0 in each shard) and
    ``grown_shard`` (null: this law moves rows when a shard is added).  Columns
    of the input with these names are replaced, all others kept.  Fewer rows than shards leave
    shards empty; an empty table gives no rows.
    """
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    keep = [c for c in (docs.columns if carry is None else carry) if c.lower() not in added]
    carried = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None).cast("int")
    sized = docs.select(carried.alias("_carry"), F.col("doc_id").alias("_doc_id"), text_size().alias("size"), F.crc32("text").alias("text_crc32"))
    order = [F.col("_doc_id").asc_nulls_first(), F.col("text_crc32").asc_nulls_first(), F.col("size").asc()]
    rows, _, total = ordered_index(sized, order, "size")
    middle = (F.col("prefix") * 2 + F.col("size")) * n_shards
    cut = rows.withColumn("shard", F.expr("NULL").cast("int") if not total
                          else F.least(F.floor(middle / F.lit(2 * total)), F.lit(n_shards - 1)).cast("int"))
    first = cut.groupBy("shard").agg(F.min("row_index").alias("at")).collect()  # n_shards rows
    start = F.create_map(*[F.lit(x) for r in first for x in (r["shard"], r["at"])]) if first else None
    slot = F.col("row_index") - (start[F.col("shard")] if first else F.lit(0))
    return cut.select(*[F.col("_carry").getField(c).alias(c) for c in keep], "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                      slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
