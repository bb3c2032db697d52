"""Registered queries for the remaining small operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ...sources.tables import table
from ...functions.bands import score_color
from ...functions import constants as K
from ...operators import history as HI
from ...operators import rowflags as RF
from ...operators import scores as S
from ...operators.rules import evaluate
from .q_history import VAL_SQL, YEARS_SQL, history
from .q_rowflags import ORDERS_NULLS_SQL, orders_nulls
from .q_rules import FLAGSHIP_RULES, FLAGSHIP_SQL, lineitem_nulls
from .q_scores import PERCOL_SQL, bands_profile, places

QUERIES: dict = {}
ORACLE: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ----------------------------------------------------------------- P5 -----
@register("row_flags_invalid_checks_orders", f"""
WITH {ORDERS_NULLS_SQL}
SELECT o_orderkey, TRUE AS o_orderstatus_range_pass, TRUE AS o_orderpriority_pattern_pass,
       COALESCE(o_totalprice BETWEEN 1000 AND 200000, FALSE) OR o_totalprice IS NULL AS o_totalprice_range_pass,
       2 + CAST(COALESCE(o_totalprice BETWEEN 1000 AND 200000, FALSE) OR o_totalprice IS NULL AS INTEGER)
         AS passed_validations
FROM o""")
def row_flags_invalid_checks_orders(spark, sf):
    # a range a text column cannot be compared with, and a pattern that does
    # not compile, mark their flags as passed for every row
    cfg = {"ranges": {"o_orderstatus": (1, 5), "o_totalprice": (1000, 200000)},
           "patterns": {"o_orderpriority": "([unclosed"}}
    enh = RF.enhanced_dataset(orders_nulls(spark, sf), cfg)
    return enh.select("o_orderkey", "o_orderstatus_range_pass", "o_orderpriority_pattern_pass",
                      "o_totalprice_range_pass", "passed_validations")


# ------------------------------------------------------------ P8, H2 ------
CRIT = ("completeness >= 80 AND (CAST(total_count - null_count AS DOUBLE) / total_count) >= 0.7 "
        "AND null_count < total_count * 0.5")


@register("profile_section_critical_orders", "WITH " + PERCOL_SQL + f"""
SELECT "column", round_even(completeness, 1) AS completeness FROM pc
WHERE {CRIT} AND "column" IN ('o_orderkey', 'o_custkey', 'o_orderpriority')""")
def profile_section_critical_orders(spark, sf):
    p = S.with_critical(bands_profile(spark, sf))
    sec = S.profile_section(p, "critical", ["o_orderkey", "o_custkey", "o_orderpriority"])
    return sec.select("column", S.r1(F.col("completeness")).alias("completeness"))


@register("profile_section_other_orders", "WITH " + PERCOL_SQL + f"""
SELECT "column", round_even(completeness, 1) AS completeness FROM pc WHERE NOT ({CRIT})""")
def profile_section_other_orders(spark, sf):
    p = S.with_critical(bands_profile(spark, sf))
    return S.profile_section(p, "other").select("column",
                                                S.r1(F.col("completeness")).alias("completeness"))


@register("score_colors_orders", "WITH " + PERCOL_SQL + """
SELECT "column",
       CASE WHEN completeness >= 90 THEN 'score-excellent' WHEN completeness >= 70 THEN 'score-good'
            WHEN completeness >= 50 THEN 'score-warning' ELSE 'score-poor' END AS completeness_color,
       CASE WHEN uniqueness >= 90 THEN 'score-excellent' WHEN uniqueness >= 70 THEN 'score-good'
            WHEN uniqueness >= 50 THEN 'score-warning' ELSE 'score-poor' END AS uniqueness_color,
       CASE WHEN k1 >= 90 THEN 'score-excellent' WHEN k1 >= 70 THEN 'score-good'
            WHEN k1 >= 50 THEN 'score-warning' ELSE 'score-poor' END AS consistency_color
FROM pc""")
def score_colors_orders(spark, sf):
    p = bands_profile(spark, sf)
    return p.select("column", score_color(F.col("completeness")).alias("completeness_color"),
                    score_color(F.col("uniqueness")).alias("uniqueness_color"),
                    score_color(F.col("consistency_standard")).alias("consistency_color"))


# ----------------------------------------------------------------- W5 -----
@register("snapshot_retention_orders", f"""
SELECT snapshot, CAST(COUNT(*) AS BIGINT) AS row_count FROM (SELECT strftime(o_orderdate, '%Y-%m') AS snapshot FROM orders)
GROUP BY snapshot ORDER BY snapshot DESC LIMIT {K.SNAPSHOTS_KEEP}""")
def snapshot_retention_orders(spark, sf):
    # One snapshot for each month (about 80), the last ten stay
    months = (table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("snapshot"))
              .agg(F.count(F.lit(1)).alias("row_count")))
    return HI.keep_last(months, K.SNAPSHOTS_KEEP, order="snapshot")


# ----------------------------------------------------------------- W9 -----
RES_SQL = "WITH res AS (" + FLAGSHIP_SQL.strip() + ")\n"


@register("sort_results_lineitem", RES_SQL + """
SELECT seq, CAST(row_number() OVER (ORDER BY success_rate DESC, seq) AS INTEGER) AS by_rate,
       CAST(row_number() OVER (ORDER BY "column", seq) AS INTEGER) AS by_column FROM res""")
def sort_results_lineitem(spark, sf):
    # the place of a row in the sorted table; one row per rule, so numbering in one task is fine
    res = evaluate(lineitem_nulls(spark, sf), FLAGSHIP_RULES).select("seq", "column", "success_rate")
    by_rate = places(S.sort_table(res, "success_rate", numeric=True, ascending=False, ties=["seq"]), "by_rate")
    by_column = places(S.sort_table(res, "column", numeric=False, ties=["seq"]), "by_column")
    return by_rate.join(by_column, "seq")


# ------------------------------------------- G1/G4 approximate (opt-in) ---
@register("profile_approx_lineitem")
def profile_approx_lineitem(spark, sf):
    # HyperLogLog distincts and approximate quartiles: two scans, no value
    # shuffle; values are approximate, so this entry is checked on rows only
    from ...operators.profile_approx import profile_approx
    from ...sources.tables import table
    return profile_approx(table(spark, sf, "lineitem")).select(
        "column", "total_count", "null_count", "distinct_count", "completeness", "uniqueness",
        "consistency_standard")


# -------------------------------------- P3: several unique flags at once ---
@register("row_flags_multi_unique_orders", f"""
WITH {ORDERS_NULLS_SQL},
dc AS (SELECT o_custkey FROM o WHERE o_custkey IS NOT NULL GROUP BY o_custkey HAVING COUNT(*) > 1),
dd AS (SELECT o_orderdate FROM o WHERE o_orderdate IS NOT NULL GROUP BY o_orderdate HAVING COUNT(*) > 1),
dp AS (SELECT o_totalprice FROM o WHERE o_totalprice IS NOT NULL GROUP BY o_totalprice HAVING COUNT(*) > 1)
SELECT o.o_orderkey,
       dc.o_custkey IS NULL OR o.o_custkey IS NULL AS o_custkey_unique_pass,
       dd.o_orderdate IS NULL OR o.o_orderdate IS NULL AS o_orderdate_unique_pass,
       dp.o_totalprice IS NULL OR o.o_totalprice IS NULL AS o_totalprice_unique_pass,
       CAST(dc.o_custkey IS NULL OR o.o_custkey IS NULL AS INTEGER)
         + CAST(dd.o_orderdate IS NULL OR o.o_orderdate IS NULL AS INTEGER)
         + CAST(dp.o_totalprice IS NULL OR o.o_totalprice IS NULL AS INTEGER) AS passed_validations
FROM o LEFT JOIN dc ON o.o_custkey = dc.o_custkey LEFT JOIN dd ON o.o_orderdate = dd.o_orderdate
       LEFT JOIN dp ON o.o_totalprice = dp.o_totalprice""")
def row_flags_multi_unique_orders(spark, sf):
    # three unique checks: their duplicated values come from one aggregation
    enh = RF.enhanced_dataset(orders_nulls(spark, sf),
                              {"unique": ["o_custkey", "o_orderdate", "o_totalprice"]})
    return enh.select("o_orderkey", "o_custkey_unique_pass", "o_orderdate_unique_pass",
                      "o_totalprice_unique_pass", "passed_validations")
