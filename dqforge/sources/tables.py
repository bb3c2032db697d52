"""Readers for the parquet tables the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale-factor folder; scans are lazy and column-pruned."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
