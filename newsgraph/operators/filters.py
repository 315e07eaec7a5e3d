"""Gates between stages (confidence threshold, minimum entity count)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgraph.config import CONFIDENCE_THRESHOLD


def by_confidence(df: DataFrame, threshold: float = CONFIDENCE_THRESHOLD,
                  col: str = "confidence") -> DataFrame:
    """Keep rows with ``confidence >= threshold`` (inclusive, as the reference)."""
    return df.filter(F.col(col) >= F.lit(float(threshold)))


def articles_with_min_entities(entities: DataFrame, n: int = 2) -> DataFrame:
    """article_id of articles holding at least ``n`` entities (partial count map-side)."""
    return entities.groupBy("article_id").agg(F.count("*").alias("n_entities")) \
                   .filter(F.col("n_entities") >= n).select("article_id")


def min_entities(relationships: DataFrame, entities: DataFrame, n: int = 2) -> DataFrame:
    """Relationships only for articles with ``n``+ entities (fewer ⇒ no mapping at all)."""
    return relationships.join(articles_with_min_entities(entities, n), "article_id", "left_semi")
