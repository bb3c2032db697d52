"""Documents dealt into buckets of ascending doc_id.

Bucket bounds are ids that occur (approximate quantiles of all ids, so buckets
hold about equally many documents); only the bounds -- at most ``most`` of them
-- reach the driver.  Null ids come first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounds(rows: DataFrame, bucket_rows: int, most: int = 50_000) -> tuple[list[int], int, int | None]:
    """(lower bounds of buckets 1, 2, ..., number of null ids, least id) of ``rows.doc_id``."""
    total, nulls, least = rows.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull()), F.min("doc_id")).first()
    n = int(min(most, max(1, -(-total // bucket_rows))))
    low = []
    if n > 1 and least is not None:
        low = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 4 * n)).first()[0] or []
    return sorted({x for x in low if nulls or x > least}), nulls, least


def _deal(batches, shared, copies: bool):
    low = shared.value
    for batch in batches:
        ids = batch.column("doc_id")
        none = ids.is_null().to_numpy(zero_copy_only=False)
        v = ids.fill_null(0).to_numpy(zero_copy_only=False)
        bucket = np.where(none, 0, np.searchsorted(low, v, side="right"))
        names = ["doc_id", "text", "bucket", "copy"]
        yield pa.RecordBatch.from_arrays(
            [ids, batch.column("text"), pa.array(bucket), pa.array(np.zeros(len(v), bool))], names=names)
        at = np.flatnonzero(~none & (bucket > 0) & np.isin(v, low)) if copies else []
        if len(at):
            p = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [p.column("doc_id"), p.column("text"), pa.array(bucket[at] - 1), pa.array(np.ones(len(at), bool))],
                names=names)


def deal(rows: DataFrame, low: list[int], copies: bool = False) -> DataFrame:
    """``rows`` (doc_id, text) with their bucket; with ``copies`` the rows at a bucket's lower bound
    also go to the bucket before, marked ``copy``."""
    shared = rows.sparkSession.sparkContext.broadcast(np.array(low, np.int64))
    return rows.mapInArrow(lambda it: _deal(it, shared, copies), "doc_id long, text string, bucket long, copy boolean")
