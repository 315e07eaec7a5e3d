"""Registered queries of the training-data operators: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgraph.llm import decontam, divergence, hardneg, linededup, minhash, mixing, quality, sharding, simhash, substring, topk, toxicity, warc
from newsgraph.llm.common import read


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), carry=["doc_id"])


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read(spark, sf_dir, "embeddings"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select(
        "doc_id", "domain", "language", "origin", "n_tokens", "epoch")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("hit_spans")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = linededup.dedup_lines(read(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_lines", "n_lines_removed", "n_chunks_removed",
                        F.length("text").cast("long").alias("clean_chars"), F.md5("text").alias("clean_md5"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.duplicate_passages(read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = warc.resolve(warc.capture_records(read(spark, sf_dir, "pages")))
    fields = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return done.withColumn("headers", F.array_join(fields, ";"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op13_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(read(spark, sf_dir, "embeddings"), anchor=F.col("vec_id") % 100 == 0, label=label)


QUERIES = {f.__name__: f for f in (op1_sharding, op2_topk, op3_mixing, op4_toxicity, op5_decontamination, op6_line_dedup, op7_substring_dedup,
                                  op8_quality, op9_warc, op10_simhash, op11_minhash, op12_divergence, op13_hardneg)}
