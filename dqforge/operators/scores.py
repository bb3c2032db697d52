"""Scores, health, criticality and report tables.

Inputs are the small derived tables -- the rule results (one row per rule)
and the profile (one row per column) -- so everything here is a projection
or an aggregate over at most a few thousand rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.onerow import beside
from ..functions.names import qcol
from ..functions import constants as K
from ..functions.bands import health_status, rule_description, rule_title
from ..functions.ordered import ordered_mean


def r1(c: Column) -> Column:
    """Presentation rounding to 1 dp (half-even, as numpy)."""
    return F.bround(c, 1)


# --------------------------------------------------------------------------
# Criticality
# --------------------------------------------------------------------------
def auto_critical(total: Column, nulls: Column) -> Column:
    """Completeness >= 80, density >= 0.7 and nulls < half the rows."""
    completeness = F.coalesce(F.try_divide(total - nulls, total) * 100, F.lit(0.0))
    density = F.coalesce(F.try_divide(total - nulls, total), F.lit(0.0))
    return ((completeness >= K.CRITICAL_MIN_COMPLETENESS) & (density >= K.CRITICAL_MIN_DENSITY)
            & (nulls < total * K.CRITICAL_MAX_NULL_SHARE))


def with_critical(profile: DataFrame, user_columns: list[str] | None = None) -> DataFrame:
    """The user's list wins when non-empty, else the automatic rule."""
    if user_columns:
        flag = F.col("column").isin(list(user_columns))
    else:
        flag = auto_critical(F.col("total_count"), F.col("null_count"))
    return profile.withColumn("is_critical", flag)


def critical_suggestions(profile: DataFrame) -> DataFrame:
    """H12 + H13: confidence score, reasons and label for every column;
    ``suggested`` columns ordered by score desc, then column order."""
    total, nulls = F.col("total_count"), F.col("null_count")
    comp = F.col("completeness")
    crit = (comp >= K.CRITICAL_MIN_COMPLETENESS) & (nulls < total * K.CRITICAL_MAX_NULL_SHARE)
    score = F.when(crit, 3
                   + F.when(comp >= K.CONFIDENCE_HIGH, 2).when(comp >= K.CONFIDENCE_MEDIUM, 1)
                   .otherwise(0)
                   + F.when(comp >= K.CONFIDENCE_NEAR_PERFECT, 1).otherwise(0)).otherwise(0)
    reasons = F.when(crit, F.array_compact(F.array(
        F.lit(K.REASON_THRESHOLD),
        F.when(comp >= K.CONFIDENCE_HIGH, F.lit(K.REASON_EXCELLENT))
        .when(comp >= K.CONFIDENCE_MEDIUM, F.lit(K.REASON_HIGH)),
        F.when(comp >= K.CONFIDENCE_NEAR_PERFECT, F.lit(K.REASON_NEAR_PERFECT))))) \
        .otherwise(F.array_compact(F.array(
            F.when(comp < K.CRITICAL_MIN_COMPLETENESS,
                   F.format_string(K.REASON_LOW, comp)),
            F.when(nulls >= total * K.CRITICAL_MAX_NULL_SHARE, F.lit(K.REASON_NULLS)))))
    confidence = (F.when(comp >= K.CONFIDENCE_HIGH, F.lit("High"))
                  .when(comp >= K.CONFIDENCE_MEDIUM, F.lit("Medium")).otherwise(F.lit("Low")))
    return profile.select(
        "ordinal", "column", comp.alias("completeness"), "null_count", "total_count",
        crit.alias("suggested"), score.cast("int").alias("score"),
        F.concat_ws("; ", reasons).alias("reasons"),
        F.when(crit, confidence).alias("confidence"),
        F.when(crit, F.lit("Recommended")).otherwise(F.lit("Manual")).alias("status"))


def suggestion_order(suggestions: DataFrame) -> DataFrame:
    """Suggested columns by score desc, ties in column order (stable)."""
    return suggestions.filter("suggested").orderBy(F.desc("score"), "ordinal")


def profile_section(profile: DataFrame, section: str = "all",
                    columns: list[str] | None = None) -> DataFrame:
    """The profile rows of one section (``critical`` / ``other`` / ``all``),
    optionally restricted to some columns.  Needs ``is_critical``."""
    out = profile
    if section == "critical":
        out = out.filter(F.col("is_critical"))
    elif section == "other":
        out = out.filter(~F.col("is_critical"))
    if columns:
        out = out.filter(F.col("column").isin(list(columns)))
    return out


def sort_table(df: DataFrame, column: str, numeric: bool = True, ascending: bool = True,
               ties: list[str] | None = None) -> DataFrame:
    """Sort a report table by one column, as numbers (text that is not a
    number sorts as 0) or as text; ``ties`` orders equal values."""
    key = F.coalesce(qcol(column).cast("string").try_cast("double"), F.lit(0.0)) if numeric \
        else qcol(column).cast("string")
    return df.orderBy(key.asc() if ascending else key.desc(), *[qcol(t) for t in ties or []])


def field_order(profile: DataFrame) -> DataFrame:
    """Critical first, then by rounded completeness desc, stable."""
    return profile.orderBy(F.desc("is_critical"), F.desc(r1(F.col("completeness"))), "ordinal")


# --------------------------------------------------------------------------
# Dataset-level quality (H5, H6, H7, H8)
# --------------------------------------------------------------------------
def overall_quality(profile: DataFrame, consistency: str = "consistency_standard") -> DataFrame:
    """H5 (``consistency_standard``) / H7 (``consistency_whitespace``): means over
    columns of the per-column scores rounded to 1 dp; combined = mean of the
    three means; all four rounded to 1 dp.  0 with no columns."""
    c, u, k = r1(F.col("completeness")), r1(F.col("uniqueness")), r1(qcol(consistency))
    o = F.col("ordinal")
    agg = profile.agg(ordered_mean(c, o).alias("_c"), ordered_mean(u, o).alias("_u"),
                      ordered_mean(k, o).alias("_k"))
    z = lambda x: F.coalesce(qcol(x), F.lit(0.0))
    return agg.select(r1(z("_c")).alias("completeness"), r1(z("_u")).alias("uniqueness"),
                      r1(z("_k")).alias("consistency"),
                      r1((z("_c") + z("_u") + z("_k")) / 3).alias("combined_score"))


def report_quality(profile: DataFrame, metrics: DataFrame) -> DataFrame:
    """H6: cell completeness, uniqueness over columns holding a value, K3 and
    their mean (unrounded)."""
    u = profile.agg(
        ordered_mean(F.when(F.col("distinct_count") > 0, F.col("uniqueness")), F.col("ordinal"))
        .alias("_u"),
        ordered_mean(F.col("consistency_type_share"), F.col("ordinal")).alias("_k"))
    j = beside(metrics.select("cell_completeness"), u)  # one row each
    uu = F.coalesce(F.col("_u"), F.lit(0.0))
    kk = F.coalesce(F.col("_k"), F.lit(100.0))
    return j.select(F.col("cell_completeness").alias("completeness"), uu.alias("uniqueness"),
                    kk.alias("consistency"),
                    ((F.col("cell_completeness") + uu + kk) / 3).alias("overall_score"))


def snapshot_score(completeness: Column, uniqueness: Column) -> Column:
    """H8: (completeness + uniqueness) / 2, rounded to 1 dp."""
    return r1((completeness + uniqueness) / 2)


# --------------------------------------------------------------------------
# Type distribution
# --------------------------------------------------------------------------
def type_distribution(profile: DataFrame, label: str = "data_type") -> DataFrame:
    """G17 + G18: columns per type label and their share of all columns."""
    n = profile.groupBy(qcol(label).alias("data_type")).agg(F.count(F.lit(1)).alias("count"))
    tot = profile.agg(F.count(F.lit(1)).alias("_n"))
    return beside(n, tot).select(
        "data_type", "count", r1(F.col("count") / F.col("_n") * 100).alias("percentage"))


# --------------------------------------------------------------------------
# Rule-level summaries
# --------------------------------------------------------------------------
def rule_health_distribution(results: DataFrame, digits: int = 1) -> DataFrame:
    """H3: number and share of rules per health band (one row)."""
    rate = F.col("success_rate")
    bands = {"excellent": rate >= 90, "good": (rate >= 75) & (rate < 90),
             "fair": (rate >= 50) & (rate < 75), "poor": rate < 50}
    agg = results.agg(F.count(F.lit(1)).alias("total_rules"),
                      *[F.count_if(c).alias(f"{k}_rules") for k, c in bands.items()])
    pct = [F.coalesce(F.bround(F.try_divide(qcol(f"{k}_rules"), F.col("total_rules")) * 100,
                               digits), F.lit(0.0)).alias(f"{k}_percentage") for k in bands]
    return agg.select("total_rules", *[f"{k}_rules" for k in bands], *pct)


def overall_health(results: DataFrame) -> DataFrame:
    """H4: mean success rate (0 with no rules), rounded to 1 dp, and its band."""
    agg = results.agg(F.coalesce(_rule_mean(results), F.lit(0.0)).alias("_h"),
                      F.count(F.lit(1)).alias("total_rules_executed"))
    return agg.select("total_rules_executed", r1(F.col("_h")).alias("overall_health_score"),
                      health_status(F.col("_h")).alias("overall_health_status"))


def _rule_mean(results: DataFrame) -> Column:
    """Mean success rate, added in rule order when the results carry it."""
    if "seq" in results.columns:
        return ordered_mean(F.col("success_rate"), F.col("seq"))
    return F.avg("success_rate")


def validation_summary(results: DataFrame) -> DataFrame:
    """H9: rules run, rules with rate >= 90 and the average rate (100.0 with
    no rules, as the tracking entry reports it)."""
    return results.agg(
        F.count(F.lit(1)).alias("total_validations"),
        F.count_if(F.col("success_rate") >= K.PASSED_RULE_RATE).alias("passed_validations"),
        F.coalesce(_rule_mean(results), F.lit(100.0)).alias("avg_success_rate"))


def rule_groups(results: DataFrame) -> DataFrame:
    """Results grouped by rule label with a title and description."""
    return results.groupBy("rule").agg(
        F.count(F.lit(1)).alias("rules"), F.avg("success_rate").alias("avg_success_rate"),
        F.sum("failed").alias("failed")).select(
        "rule", rule_title(F.col("rule")).alias("title"),
        rule_description(F.col("rule")).alias("description"), "rules", "avg_success_rate",
        "failed")


def bar_chart_data(results: DataFrame) -> DataFrame:
    """One bar per rule result: column, success rate, band and colour."""
    rate = F.col("success_rate")
    color = None
    for lower, c in K.BAR_COLORS:
        color = F.when(rate >= lower, F.lit(c)) if color is None else color.when(rate >= lower,
                                                                                 F.lit(c))
    color = color.otherwise(F.lit(K.BAR_COLOR_FLOOR))
    return results.select("seq", "column", rate.alias("success_rate"),
                          health_status(rate).alias("band"), color.alias("color"))


def app_quality(profile: DataFrame) -> DataFrame:
    """H7 + H8 + G17 (label C) in one row: the app's overall data quality of a
    frame, with its type distribution as a map."""
    q = overall_quality(profile, consistency="consistency_whitespace")
    types = profile.groupBy("data_type_c").agg(F.count(F.lit(1)).alias("n")).agg(
        F.map_from_entries(F.collect_list(F.struct("data_type_c", "n"))).alias("type_distribution"))
    return beside(q, types).withColumn(               # one row each
        "snapshot_score", snapshot_score(F.col("completeness"), F.col("uniqueness")))
