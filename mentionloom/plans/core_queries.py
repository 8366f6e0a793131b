"""All queries of the core library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mentionloom.operators import timestamps
from mentionloom.plans import annotated_queries, file_queries, mention_queries, method_queries, metric_queries, phrase_queries, resolution_queries, text_queries  # noqa: F401
from mentionloom.plans.registry import QUERIES, SQL, query
from mentionloom.sources.tables import read

__all__ = ["QUERIES", "SQL"]


@query("p6_found")
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return timestamps.normalize_timestamps(read(spark, sf, "articles"), read(spark, sf, "sources"))
