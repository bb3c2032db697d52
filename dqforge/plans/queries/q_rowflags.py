"""Registered row-flag queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import rowflags as RF
from ...operators.duplicates import mark_duplicates
from ...sources.tables import table
from .q_rules import FLAGSHIP_RULES, FLAGSHIP_SQL, lineitem_nulls
from ...operators.rules import evaluate

QUERIES: dict = {}
ORACLE: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def orders_nulls(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey",
        F.when(k % 19 == 0, None).otherwise(F.col("o_custkey")).alias("o_custkey"),
        "o_orderstatus",
        F.when(k % 13 == 0, None).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        F.when(k % 17 == 0, None).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))


ORDERS_NULLS_SQL = """
o AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
         o_orderstatus,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
         o_orderdate,
         CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders)"""

ORDERS_CONFIG = {
    "not_null": ["o_totalprice"],
    "unique": ["o_custkey"],
    "ranges": {"o_totalprice": (50000, 300000)},
    "allowed_values": {"o_orderstatus": ["F", "O"]},
    "patterns": {"o_orderpriority": "[1-3]-"},
}

FLAGS_SQL = f"""
WITH {ORDERS_NULLS_SQL},
d AS (SELECT o_custkey FROM o WHERE o_custkey IS NOT NULL GROUP BY o_custkey HAVING COUNT(*) > 1),
f AS (
  SELECT o.*,
    o.o_totalprice IS NOT NULL AS o_totalprice_not_null_pass,
    (d.o_custkey IS NULL) OR o.o_custkey IS NULL AS o_custkey_unique_pass,
    COALESCE(o.o_totalprice BETWEEN 50000 AND 300000, FALSE) OR o.o_totalprice IS NULL AS o_totalprice_range_pass,
    COALESCE(o.o_orderstatus IN ('F', 'O'), FALSE) OR o.o_orderstatus IS NULL AS o_orderstatus_allowed_values_pass,
    COALESCE(regexp_matches(o.o_orderpriority, '^(?:[1-3]-)'), FALSE) OR o.o_orderpriority IS NULL AS o_orderpriority_pattern_pass
  FROM o LEFT JOIN d ON o.o_custkey = d.o_custkey),
g AS (
  SELECT *,
    CAST(o_totalprice_not_null_pass AS INTEGER) + CAST(o_custkey_unique_pass AS INTEGER)
      + CAST(o_totalprice_range_pass AS INTEGER) + CAST(o_orderstatus_allowed_values_pass AS INTEGER)
      + CAST(o_orderpriority_pattern_pass AS INTEGER) AS passed_validations
  FROM f)
"""

ROW_FLAGS_SQL = FLAGS_SQL + """
SELECT *, 5 AS total_validations,
       ROUND(CAST(passed_validations AS DOUBLE) / 5 * 100, 1) AS validation_success_rate,
       passed_validations = 5 AS all_validations_pass
FROM g"""


@register("row_flags_orders", ROW_FLAGS_SQL)
def row_flags_orders(spark, sf):
    return RF.enhanced_dataset(orders_nulls(spark, sf), ORDERS_CONFIG)


@register("row_filter_orders", FLAGS_SQL + """
SELECT *, 5 AS total_validations,
       ROUND(CAST(passed_validations AS DOUBLE) / 5 * 100, 1) AS validation_success_rate,
       passed_validations = 5 AS all_validations_pass
FROM g
WHERE COALESCE(contains(lower(o_orderpriority), '1-urgent'), FALSE)
  AND o_totalprice_range_pass = FALSE""")
def row_filter_orders(spark, sf):
    enh = RF.enhanced_dataset(orders_nulls(spark, sf), ORDERS_CONFIG)
    return RF.filter_rows(enh, needle="1-URGENT", column="o_orderpriority",
                          rule_flag="o_totalprice_range_pass", status=False)


@register("row_filter_any_column", FLAGS_SQL + """,
w AS (SELECT *, 5 AS total_validations,
             ROUND(CAST(passed_validations AS DOUBLE) / 5 * 100, 1) AS validation_success_rate,
             passed_validations = 5 AS all_validations_pass FROM g)
SELECT * FROM w WHERE contains(lower(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
  o_orderpriority, o_totalprice_not_null_pass, o_custkey_unique_pass, o_totalprice_range_pass,
  o_orderstatus_allowed_values_pass, o_orderpriority_pattern_pass, passed_validations, total_validations,
  validation_success_rate, all_validations_pass)), 'urg')""")
def row_filter_any_column(spark, sf):
    # P9 over every column of the enhanced rows
    return RF.filter_rows(RF.enhanced_dataset(orders_nulls(spark, sf), ORDERS_CONFIG), needle="URG")


@register("duplicates_lineitem_orderkey", """
WITH d AS (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING COUNT(*) > 1)
SELECT l.l_orderkey, l.l_linenumber, d.l_orderkey IS NOT NULL AS is_duplicate
FROM lineitem l LEFT JOIN d ON l.l_orderkey = d.l_orderkey""")
def duplicates_lineitem_orderkey(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return mark_duplicates(li, ["l_orderkey"])


@register("duplicates_customer_nullsafe", """
WITH c AS (
  SELECT c_custkey,
         CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey,
         c_mktsegment FROM customer),
d AS (SELECT c_nationkey, c_mktsegment FROM c GROUP BY c_nationkey, c_mktsegment HAVING COUNT(*) > 1)
SELECT c.c_custkey, c.c_nationkey, c.c_mktsegment, d.c_mktsegment IS NOT NULL AS is_duplicate
FROM c LEFT JOIN d ON c.c_nationkey IS NOT DISTINCT FROM d.c_nationkey
                  AND c.c_mktsegment IS NOT DISTINCT FROM d.c_mktsegment""")
def duplicates_customer_nullsafe(spark, sf):
    c = table(spark, sf, "customer")
    c = c.select("c_custkey",
                 F.when(F.col("c_custkey") % 9 == 0, None).otherwise(F.col("c_nationkey"))
                 .alias("c_nationkey"), "c_mktsegment")
    return mark_duplicates(c, ["c_nationkey", "c_mktsegment"])


@register("rules_for_column_lineitem", "WITH res AS (" + FLAGSHIP_SQL.strip() + """)
SELECT rule, CAST(SUM(failed) AS BIGINT) AS failed FROM res
WHERE list_contains(string_split("column", ', '), 'l_quantity') GROUP BY rule""")
def rules_for_column_lineitem(spark, sf):
    # P10 over the flagship's results table (derived from lineitem), with the
    # failures of each rule found
    res = evaluate(lineitem_nulls(spark, sf), FLAGSHIP_RULES)
    found = RF.rules_for_column(res, "l_quantity")
    return found.join(res.groupBy("rule").agg(F.sum("failed").alias("failed")), "rule")
