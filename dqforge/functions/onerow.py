"""One-row frames side by side, without a join.

Global aggregates (dataset metrics, scores, distributions) each produce
exactly one row.  ``beside(first, *others)`` adds the columns of every other
frame to ``first`` as one struct-valued scalar subquery per frame: Spark runs
each subquery once (merging subqueries over the same plan) and fails the
query if such a frame ever holds more than one row, so the one-row bound is
checked at run time rather than assumed.  As with a join of one-row frames,
the result is empty when any of the other frames is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .names import qcol


def beside(first: DataFrame, *others: DataFrame) -> DataFrame:
    holders, fields = [], []
    for i, o in enumerate(others):
        name = f"_dq_one{i}"
        sub = o.select(F.struct(*[qcol(c) for c in o.columns]).alias("_s")).scalar()
        holders.append(sub.alias(name))
        fields += [F.col(name)[c].alias(c) for c in o.columns]
    out = first.select(*[qcol(c) for c in first.columns], *holders)
    for i in range(len(others)):
        out = out.filter(F.col(f"_dq_one{i}").isNotNull())
    return out.select(*[qcol(c) for c in first.columns], *fields)
