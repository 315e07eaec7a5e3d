"""Pipeline metrics as tables (the reference logs these per message)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgraph.operators.impact import severity_band


def _counts(df: DataFrame, **named) -> DataFrame:
    """One pass over ``df`` computing several counts, returned as (metric, value) rows."""
    wide = df.agg(*[v.cast("bigint").alias(k) for k, v in named.items()])
    return wide.unpivot([], list(named), "metric", "value")


def stage_counts(entities: DataFrame, relationships: DataFrame, checked: DataFrame,
                 threshold: float = 0.7) -> DataFrame:
    """Long table (metric, value): extraction, relationship and fact-check counts.

    One aggregate per input (each a partial, map-side count); rows are unioned.
    """
    hi = lambda: F.count_if(F.col("confidence") >= threshold)
    return _counts(entities, entities_total=F.count("*"), entities_high_confidence=hi()) \
        .unionByName(_counts(relationships, relationships_total=F.count("*"),
                             relationships_high_confidence=hi())) \
        .unionByName(_counts(checked, factcheck_total=F.count("*"),
                             factcheck_validated=F.count_if(F.col("validated")),
                             factcheck_hallucinations=F.count_if(~F.col("validated"))))


def token_usage(attached: DataFrame) -> DataFrame:
    """Tokens per (model, stage) with rollup totals (model total, grand total)."""
    return attached.rollup("model", "stage").agg(
        F.sum(F.coalesce("tokens_used", F.lit(0))).alias("tokens"),
        (F.count_if("has_content") if "has_content" in attached.columns else F.count("content")).alias("responses"))


def article_metrics(events: DataFrame, start_col: str | None = None,
                    end_col: str | None = None) -> DataFrame:
    """Per-article completion record (entity/relationship counts, severity, band)."""
    cols = [F.col("article_id"), F.size("entities").alias("entity_count"),
            F.size("relationships").alias("relationship_count"),
            F.col("impact_summary.severity").alias("severity"),
            severity_band(F.col("impact_summary.severity")).alias("severity_band"),
            F.col("fact_check_passed"), F.size("hallucination_flags").alias("n_flags")]
    if start_col and end_col:
        cols.append(((F.unix_micros(end_col) - F.unix_micros(start_col)) / 1e6)
                    .alias("processing_seconds"))
    return events.select(*cols)


def hallucination_rate(checked: DataFrame, by: tuple[str, ...] = ("type", "source")) -> DataFrame:
    """Share of flagged entities for every combination of ``by`` (CUBE)."""
    return checked.cube(*by).agg(
        F.count("*").alias("n"), F.count_if(~F.col("validated")).alias("flagged"),
        F.avg((~F.col("validated")).cast("double")).alias("rate"))


def windowed(df: DataFrame, ts_col: str, keys: list[str], every: str = "15 minutes",
             aggs: list | None = None) -> DataFrame:
    """Tumbling-window metrics per key (batch or streaming input)."""
    aggs = aggs or [F.count("*").alias("n")]
    return df.groupBy(F.window(F.col(ts_col), every), *keys).agg(*aggs)
