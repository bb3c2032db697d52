"""The first rows of each group, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .names import qcol

#: rows that one task may merge, or those of two buckets where ``n`` is larger
TASK_ROWS = 100_000


def merge_levels(buckets: int, n: int) -> list[int]:
    """Numbers of buckets after each merge, down to one: a merge takes as many buckets together as keep
    a task within ``TASK_ROWS`` rows (``n`` from each), and at least two."""
    fan, out = max(2, TASK_ROWS // max(n, 1)), []
    while buckets > 1:
        buckets = -(-buckets // fan)
        out.append(buckets)
    return out


def first_rows(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str) -> DataFrame:
    """The first ``n`` rows of each group in ``order`` (all rows are one group where ``by`` is
    empty), with their place ``rank``.  Rows are cut to ``n`` inside every (group, bucket) -- buckets by
    a hash of the row -- and the buckets are merged level by level, each cut to ``n`` again, so no task
    reads more than ``max(2 * n, TASK_ROWS)`` rows of a group after the first cut, whatever ``n``, the
    number of buckets and the size of a group are."""
    buckets = shuffle_partitions(df.sparkSession)
    keys = [qcol(b) for b in by]
    hashable = [qcol(f.name) for f in df.schema.fields if "map" not in f.dataType.simpleString()]
    cut = df.withColumn("_bucket", F.pmod(F.xxhash64(*hashable), F.lit(buckets)))
    for left in [buckets, *merge_levels(buckets, n)]:
        cut = cut.withColumn("_bucket", F.pmod("_bucket", F.lit(left)))
        first = Window.partitionBy(*keys, "_bucket").orderBy(*order)
        cut = cut.withColumn(rank, F.row_number().over(first)).filter(qcol(rank) <= n)
    return cut.drop("_bucket")
