"""All queries over the reference's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.plans import case_queries, corpus_queries, linking_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return corpus_queries.QUERIES | linking_queries.QUERIES | case_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return corpus_queries.SQL | linking_queries.SQL | case_queries.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with split, challenge family, quality and their text with mentions masked."""
    from docloom.plans import fixtures as X

    splits = corpus_queries.split_hash(spark, sf_dir)
    families = X.features(spark, sf_dir).select("doc_id", "lang", "primary_challenge")
    scores = corpus_queries.quality_scores(spark, sf_dir)
    masked = corpus_queries.mask_spans(spark, sf_dir)
    return families.join(splits, "doc_id").join(scores, "doc_id").join(masked, "doc_id").orderBy(F.col("quality_score").desc(), "doc_id")
