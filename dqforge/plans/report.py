"""The report's data as DataFrames (the HTML page itself is not built).

Everything the original report page renders -- health distribution (2 dp),
overall health, rules grouped by label, the bar chart, dataset scores and the
ordered field summary with score bands -- comes back as small DataFrames
derived from the rule results and one profile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bands import score_color
from ..operators import profile as PR
from ..operators import scores as S


def report_tables(df: DataFrame, results: DataFrame,
                  critical_columns: list[str] | None = None,
                  prof: DataFrame | None = None) -> dict[str, DataFrame]:
    prof = prof if prof is not None else PR.profile(df)
    fields = S.field_order(S.with_critical(prof, critical_columns)).select(
        "ordinal", "column", "data_type", "is_critical",
        S.r1(F.col("completeness")).alias("completeness"),
        S.r1(F.col("uniqueness")).alias("uniqueness"),
        S.r1(F.col("consistency_type_share")).alias("consistency"),
        score_color(F.col("completeness")).alias("completeness_color"),
        score_color(F.col("uniqueness")).alias("uniqueness_color"),
        "total_count", "null_count", "distinct_count", "mean", "median", "std", "min", "max",
        "date_min", "date_max", "date_median", "date_range_days", "mode", "mode_count",
        "sample_values")
    return {
        "health_distribution": S.rule_health_distribution(results, digits=2),
        "overall_health": S.overall_health(results),
        "rule_groups": S.rule_groups(results),
        "bar_chart": S.bar_chart_data(results),
        "dataset_scores": S.report_quality(prof, PR.dataset_metrics(df)),
        "type_distribution": S.type_distribution(prof, label="data_type_b"),
        "fields": fields,
    }
