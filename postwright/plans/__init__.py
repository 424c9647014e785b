"""Whole queries: operators put together over the driver's tables, each beside the SQL that gives the same rows."""

from pyspark.sql import DataFrame, SparkSession

from postwright.plans import decision_queries, model_queries, retrieval_queries, study_queries, text_queries  # noqa: F401
from postwright.plans.registry import QUERIES

__all__ = ["QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over the documents for the benchmark's items, ten passages each."""
    return QUERIES["bm25_top10"](spark, sf_dir)
