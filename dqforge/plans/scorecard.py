"""Rule scorecard: results table plus health band (S10 + H1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bands import health_status
from ..operators.rules import Rule, evaluate


def scorecard(df: DataFrame, rules: list[Rule], with_details: bool = False) -> DataFrame:
    res = evaluate(df, rules)
    cols = ["seq", "column", "rule", "total", "passed", "failed", "success_rate",
            health_status(F.col("success_rate")).alias("health")]
    if with_details:
        cols.append("details")
    return res.select(*cols)
