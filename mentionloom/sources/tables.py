"""Readers of the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "articles", "sources", "mentions", "codings", "rules", "experiments", "documents", "level_ratings", "pack_specs",
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings",
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one table; columns are pruned by the plan that uses it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
