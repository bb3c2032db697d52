"""Tables kept for a while in the shared folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a reader of it:
    lineage ends there, and a lost executor costs only a new read."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
