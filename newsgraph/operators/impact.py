"""Offline impact summary: roll an article's relationships and entities up into
an ImpactSummary (severity 1..10, sectors, stakeholders, two sentences)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Severity bands for reporting (fixed values of the reference prompt).
SEVERITY_BANDS = [(1, 3, "minor"), (4, 6, "significant"), (7, 8, "major"), (9, 10, "crisis")]
# Letters of names that the summary spells out (it must stay within 500 in all).
SUMMARY_NAMES = 400


def rollup_impact(articles: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row per article of ``articles`` (article_id).

    severity = clamp(1 + floor(5 * max |sentiment|) + min(4, #distinct objects), 1, 10),
    1 without relationships; sectors = sorted distinct entity industries;
    stakeholders = all distinct object names, the most exposed first (strongest
    |sentiment|, then most links, then name).  The summary spells out whole names
    as long as they fit and counts the others.
    """
    by_object = relationships.groupBy("article_id", F.col("object.name").alias("name")).agg(
        F.count("*").alias("n"), F.max(F.abs("sentiment")).alias("mx"))
    r = by_object.groupBy("article_id").agg(
        F.sum("n").alias("n_rel"), F.max("mx").alias("max_abs"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("name").isNotNull(), F.struct(
            (-F.col("mx")).alias("a"), (-F.col("n")).alias("b"), "name")))), lambda x: x["name"]).alias("objects"))
    e = entities.groupBy("article_id").agg(
        F.count("*").alias("n_ent"),
        F.array_sort(F.collect_set(F.col("industry"))).alias("sectors"))
    j = articles.select("article_id").join(e, "article_id", "left").join(r, "article_id", "left")
    n_rel = F.coalesce(F.col("n_rel"), F.lit(0))
    n_obj = F.coalesce(F.size("objects"), F.lit(0))
    raw = 1 + F.floor(5 * F.coalesce(F.col("max_abs"), F.lit(0.0))) + F.least(F.lit(4), n_obj)
    severity = F.when(n_rel == 0, F.lit(1)).otherwise(F.least(F.lit(10), F.greatest(F.lit(1), raw)))
    stake = F.coalesce("objects", F.array().cast("array<string>"))
    fit = F.aggregate(stake, F.struct(F.lit(0).alias("len"), F.lit(0).alias("k")), lambda a, x: F.when(
        a["len"] + F.length(x) + 2 <= SUMMARY_NAMES, F.struct((a["len"] + F.length(x) + 2).alias("len"), (a["k"] + 1).alias("k")))
        .otherwise(F.struct(F.lit(SUMMARY_NAMES).alias("len"), a["k"].alias("k"))))
    shown = F.greatest(F.lit(1), fit["k"])
    more = F.size(stake) - shown
    first = F.concat(n_rel.cast("string"), F.lit(" causal links connect "),
                     F.coalesce(F.col("n_ent"), F.lit(0)).cast("string"), F.lit(" entities."))
    second = F.when(n_rel > 0, F.concat(
        F.lit(" Most exposed: "), F.array_join(F.slice(stake, F.lit(1), shown), ", "),
        F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(F.lit("")), F.lit(".")))\
              .otherwise(F.lit(" No party is exposed."))
    return j.select(
        "article_id", F.concat(first, second).alias("summary"),
        severity.cast("int").alias("severity"),
        F.coalesce("sectors", F.array().cast("array<string>")).alias("affected_sectors"),
        stake.alias("key_stakeholders"), n_rel.alias("n_relationships"))


def severity_band(severity) -> F.Column:
    c = F.col(severity) if isinstance(severity, str) else severity
    out = F.lit(None).cast("string")
    for lo, hi, name in reversed(SEVERITY_BANDS):
        out = F.when(c.between(lo, hi), F.lit(name)).otherwise(out)
    return out
