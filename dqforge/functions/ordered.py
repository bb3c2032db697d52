"""Means that add their terms in a fixed order.

Averages of per-column scores are rounded to 1 dp right after; adding the
same doubles in another order can move the mean across a rounding tie
(e.g. 18.549999999999997 vs 18.55).  The original sums columns left to
right, so we do too: collect ``(order, value)`` -- one entry per column or
snapshot, never per data row -- sort, and fold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered_mean(value: Column, order: Column) -> Column:
    """Aggregate expression: mean of non-null ``value`` added in ``order``."""
    arr = F.array_sort(F.collect_list(F.when(value.isNotNull(),
                                             F.struct(order.alias("o"), value.alias("v")))))
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x["v"])
    return F.when(F.size(arr) > 0, total / F.size(arr))
