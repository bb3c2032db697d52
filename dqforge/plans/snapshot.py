"""Comprehensive quality snapshot (H15), its flat form (H16) and the field
summary (H17).

All pieces are one-row aggregates of the small profile/results tables; the
nested row is assembled from single-row frames as scalar subqueries
(``functions.onerow.beside``, no join), and the
per-column/per-rule arrays are ``collect_list`` of tables bounded by the
number of columns or rules, never by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.onerow import beside
from ..operators import scores as S
from ..operators.profile import dataset_metrics, profile as build_profile

R2 = lambda c: F.bround(c, 2)  # noqa: E731 - presentation rounding (2 dp)


def column_details(prof: DataFrame) -> DataFrame:
    """Per-column entries of the snapshot (scores rounded as presented)."""
    is_num = F.col("kind").isin("numeric", "boolean")
    return prof.select(
        "ordinal", F.col("column").alias("name"), "data_type", "total_count", "null_count",
        "distinct_count", S.r1(F.col("completeness")).alias("completeness"),
        S.r1(F.col("uniqueness")).alias("uniqueness"),
        S.r1(F.col("consistency_standard")).alias("consistency"), "is_critical",
        F.when(is_num, R2(F.col("mean"))).alias("mean"),
        F.when(is_num, R2(F.col("median"))).alias("median"),
        F.when(is_num, R2(F.col("std"))).alias("std"),
        F.when(is_num, F.col("min")).alias("min"), F.when(is_num, F.col("max")).alias("max"))


def comprehensive_snapshot(df: DataFrame, results: DataFrame | None, title: str = "Data Quality Report",
                           dataset_name: str = "Unknown Dataset",
                           critical_columns: list[str] | None = None,
                           prof: DataFrame | None = None) -> DataFrame:
    """One nested row describing the dataset, its columns and its rules."""
    spark = df.sparkSession
    if results is None:
        results = spark.createDataFrame([], "seq int, column string, rule string, total long, "
                                            "passed long, failed long, success_rate double")
    prof = S.with_critical(prof if prof is not None else build_profile(df), critical_columns)
    details = column_details(prof)
    entry = F.struct(*[F.col(c) for c in details.columns if c != "ordinal"])

    metrics = dataset_metrics(df)
    health = S.overall_health(results)
    quality = S.overall_quality(prof)
    dist = S.rule_health_distribution(results, digits=1)
    cols = details.agg(
        F.array_sort(F.collect_list(F.when(F.col("is_critical"),
                                           F.struct("ordinal", entry.alias("e")))))
        .alias("_crit"),
        F.array_sort(F.collect_list(F.when(~F.col("is_critical"),
                                           F.struct("ordinal", entry.alias("e")))))
        .alias("_other"))
    types = prof.groupBy("data_type").agg(F.count(F.lit(1)).alias("n")).agg(
        F.map_from_entries(F.collect_list(F.struct("data_type", "n"))).alias("column_type_distribution"))
    detailed = results.agg(F.array_sort(F.collect_list(F.struct(
        "seq", "column", "rule", "success_rate", "total", "passed", "failed"))).alias("detailed_results"))

    one = beside(metrics, health, quality, dist, cols, types, detailed)  # one row each
    crit = F.transform(F.col("_crit"), lambda s: s["e"])
    other = F.transform(F.col("_other"), lambda s: s["e"])
    return one.select(
        F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
                 F.lit(title).alias("title"), F.lit(dataset_name).alias("dataset_name")).alias("metadata"),
        F.struct(F.col("total_rows").alias("total_records"), "total_columns", "total_cells",
                 "null_cells", S.r1(F.col("cell_completeness")).alias("data_completeness_rate"),
                 "total_rules_executed", "overall_health_score", "overall_health_status")
        .alias("key_metrics"),
        F.struct("completeness", "uniqueness", "consistency", "combined_score")
        .alias("overall_data_quality"),
        F.struct(F.size(crit).alias("count"), crit.alias("columns")).alias("critical_data_elements"),
        F.struct(F.size(other).alias("count"), other.alias("columns")).alias("other_fields"),
        "column_type_distribution",
        F.struct("total_rules", F.col("excellent_rules"), "good_rules", "fair_rules", "poor_rules",
                 F.struct(F.col("excellent_percentage").alias("excellent"),
                          F.col("good_percentage").alias("good"),
                          F.col("fair_percentage").alias("fair"),
                          F.col("poor_percentage").alias("poor")).alias("health_percentages"))
        .alias("rule_execution_summary"),
        "detailed_results",
    )


def flatten_snapshot(snap: DataFrame) -> DataFrame:
    """One wide row with a fixed schema; type counts stay a map, and the
    critical / other averages are 0 when the group is empty."""
    km, q = F.col("key_metrics"), F.col("overall_data_quality")
    res = F.col("rule_execution_summary")

    def avg_of(arr: str, field: str):
        a = F.col(arr)["columns"]
        n = F.size(a)
        total = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x[field])
        return F.when(n > 0, S.r1(total / n)).otherwise(F.lit(0.0))

    return snap.select(
        F.col("metadata.timestamp").alias("timestamp"), F.col("metadata.title").alias("title"),
        F.col("metadata.dataset_name").alias("dataset_name"),
        km["total_records"].alias("total_records"), km["total_columns"].alias("total_columns"),
        km["total_cells"].alias("total_cells"), km["null_cells"].alias("null_cells"),
        km["data_completeness_rate"].alias("data_completeness_rate"),
        km["total_rules_executed"].alias("total_rules_executed"),
        km["overall_health_score"].alias("overall_health_score"),
        km["overall_health_status"].alias("overall_health_status"),
        q["completeness"].alias("overall_completeness"), q["uniqueness"].alias("overall_uniqueness"),
        q["consistency"].alias("overall_consistency"),
        q["combined_score"].alias("combined_quality_score"),
        F.col("critical_data_elements.count").alias("critical_elements_count"),
        F.col("other_fields.count").alias("other_fields_count"),
        res["excellent_rules"].alias("excellent_rules_count"),
        res["good_rules"].alias("good_rules_count"), res["fair_rules"].alias("fair_rules_count"),
        res["poor_rules"].alias("poor_rules_count"),
        res["health_percentages"]["excellent"].alias("excellent_rules_percentage"),
        res["health_percentages"]["good"].alias("good_rules_percentage"),
        res["health_percentages"]["fair"].alias("fair_rules_percentage"),
        res["health_percentages"]["poor"].alias("poor_rules_percentage"),
        F.transform_keys("column_type_distribution",
                         lambda k, v: F.concat(F.lit("columns_"),
                                               F.regexp_replace(F.regexp_replace(F.lower(k), "/", "_"),
                                                                " ", "_"),
                                               F.lit("_count"))).alias("type_counts"),
        avg_of("critical_data_elements", "completeness").alias("critical_avg_completeness"),
        avg_of("critical_data_elements", "uniqueness").alias("critical_avg_uniqueness"),
        avg_of("critical_data_elements", "consistency").alias("critical_avg_consistency"),
        avg_of("other_fields", "completeness").alias("other_avg_completeness"),
        avg_of("other_fields", "uniqueness").alias("other_avg_uniqueness"),
        avg_of("other_fields", "consistency").alias("other_avg_consistency"),
    )


def field_summary(df: DataFrame, title: str = "Data Quality Report",
                  dataset_name: str = "Unknown Dataset", prof: DataFrame | None = None) -> DataFrame:
    """17 fields per column; consistency is the extended score (K2) and
    the critical flag ignores any user list (H11)."""
    prof = prof if prof is not None else build_profile(df)
    is_num = F.col("kind").isin("numeric", "boolean")
    nonempty = is_num & (F.col("non_null_count") > 0)
    return prof.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.lit(title).alias("title"), F.lit(dataset_name).alias("dataset_name"),
        F.col("column").alias("column_name"), "data_type", "total_count", "null_count",
        "distinct_count", S.r1(F.col("completeness")).alias("completeness"),
        S.r1(F.col("uniqueness")).alias("uniqueness"),
        S.r1(F.col("consistency_extended")).alias("consistency"),
        S.auto_critical(F.col("total_count"), F.col("null_count")).alias("is_critical"),
        F.when(nonempty, R2(F.col("mean"))).alias("mean"),
        F.when(nonempty, R2(F.col("median"))).alias("median"),
        F.when(nonempty, R2(F.col("std"))).alias("std"),
        F.when(nonempty, F.col("min")).alias("min"), F.when(nonempty, F.col("max")).alias("max"),
        "ordinal")

