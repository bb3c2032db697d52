"""Outputs (S11-S14): CSV exports, append-only history tables, preview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import qcol
from ..functions import constants as K


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Results / enhanced rows / comparisons as CSV with a header.
    Written by all tasks in parallel (one part file each).  Nested columns
    (e.g. the ``details`` map of rule results) are written as JSON text."""
    from pyspark.sql import types as T
    cols = [F.to_json(qcol(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else qcol(f.name)
            for f in df.schema.fields]
    # quotes inside fields are doubled (RFC 4180, as pandas writes them)
    df.select(*cols).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def append_history(flat: DataFrame, path: str) -> None:
    """Append flattened snapshots (fixed schema: the per-type counts are
    a map column, so rows with different type sets still share one schema)."""
    flat.write.mode("append").parquet(path)


def append_field_history(fields: DataFrame, path: str) -> None:
    """Append per-column summaries, partitioned by dataset name."""
    fields.write.mode("append").partitionBy("dataset_name").parquet(path)


def preview(df: DataFrame, order_by: list[str] | str, n: int = K.PREVIEW_ROWS) -> DataFrame:
    """The first ``n`` rows in an explicit order (a top-k: the feature)."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*[qcol(k) for k in keys]).limit(n)
