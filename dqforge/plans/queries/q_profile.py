"""Registered profiling queries (G1-G13, K1-K4, S2) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import constants as K
from ...operators import profile as PR
from ...sources.tables import table
from .q_rowflags import ORDERS_NULLS_SQL, orders_nulls

QUERIES: dict = {}
ORACLE: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
              "o_orderpriority"]


def _union(template: str, cols) -> str:
    return "\n  UNION ALL\n".join(template.format(c=c, i=i, email=K.EMAIL_PATTERN) for i, c in enumerate(cols))


# ---------------------------------------------------------- G1, G3, G4 ----
COUNTS_SQL = f"""
WITH {ORDERS_NULLS_SQL}
""" + _union("""  SELECT {i} AS ordinal, '{c}' AS "column", CAST(COUNT(*) AS BIGINT) AS total_count,
         CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS null_count,
         CAST(COUNT(DISTINCT {c}) AS BIGINT) AS distinct_count,
         COALESCE(CAST(COUNT({c}) AS DOUBLE) / NULLIF(COUNT(*), 0) * 100, 0.0) AS completeness,
         COALESCE(CAST(COUNT(DISTINCT {c}) AS DOUBLE) / NULLIF(COUNT(*), 0) * 100, 0.0) AS uniqueness
  FROM o""", ORDER_COLS)


@register("profile_counts_orders", COUNTS_SQL)
def profile_counts_orders(spark, sf):
    p = PR.profile(orders_nulls(spark, sf))
    return p.select("ordinal", "column", "total_count", "null_count", "distinct_count",
                    "completeness", "uniqueness")


# ------------------------------------------------------------- G12 --------
@register("column_info_orders", f"""
WITH {ORDERS_NULLS_SQL}
""" + _union("""  SELECT '{c}' AS "column", CAST(COUNT({c}) AS BIGINT) AS non_null_count,
         CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS null_count,
         CAST(COUNT(DISTINCT {c}) AS BIGINT) AS unique_values FROM o""", ORDER_COLS))
def column_info_orders(spark, sf):
    return PR.column_info_table(orders_nulls(spark, sf)).drop("data_type")


# ------------------------------------------------------- G5, G11 ----------
NUM_COLS = ["o_orderkey", "o_custkey", "o_totalprice"]


@register("profile_numeric_stats_orders", f"""
WITH {ORDERS_NULLS_SQL}
""" + _union("""  SELECT '{c}' AS "column",
         round_even(avg({c}), 2) AS mean, round_even(median({c}), 2) AS median,
         round_even(stddev_samp({c}), 2) AS std,
         CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
         round_even(quantile_cont({c}, 0.25), 2) AS q1, round_even(quantile_cont({c}, 0.75), 2) AS q3
  FROM o""", NUM_COLS))
def profile_numeric_stats_orders(spark, sf):
    p = PR.profile(orders_nulls(spark, sf))
    r = lambda c: F.bround(F.col(c), 2).alias(c)  # noqa: E731 - presentation rounding (2 dp)
    return p.filter(F.col("kind") == "numeric").select(
        "column", r("mean"), r("median"), r("std"), "min", "max", r("q1"), r("q3"))


@register("profile_numeric_stats_lineitem", """
""" + "WITH x AS (SELECT 1)\n" + _union("""  SELECT '{c}' AS "column",
         round_even(avg({c}), 2) AS mean, round_even(median({c}), 2) AS median,
         round_even(stddev_samp({c}), 2) AS std,
         CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
         round_even(quantile_cont({c}, 0.25), 2) AS q1, round_even(quantile_cont({c}, 0.75), 2) AS q3
  FROM lineitem""", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                     "l_extendedprice", "l_discount", "l_tax"]))
def profile_numeric_stats_lineitem(spark, sf):
    p = PR.profile(table(spark, sf, "lineitem"))
    r = lambda c: F.bround(F.col(c), 2).alias(c)
    return p.filter(F.col("kind") == "numeric").select(
        "column", r("mean"), r("median"), r("std"), "min", "max", r("q1"), r("q3"))


# ------------------------------------------------------- G6, G8 -----------
MODE_NUM_SQL = """  SELECT '{c}' AS "column", CAST(v AS DOUBLE) AS mode_value, CAST(n AS BIGINT) AS mode_count
  FROM (SELECT {c} AS v, COUNT(*) AS n FROM o WHERE {c} IS NOT NULL GROUP BY {c}
        ORDER BY n DESC, v ASC LIMIT 1)"""
MODE_TXT_SQL = """  SELECT '{c}' AS "column", CASE WHEN n > 1 THEN v ELSE 'N/A' END AS mode,
         CAST(n AS BIGINT) AS mode_count
  FROM (SELECT {c} AS v, COUNT(*) AS n FROM o WHERE {c} IS NOT NULL GROUP BY {c}
        ORDER BY n DESC, v ASC LIMIT 1)"""


@register("profile_mode_numeric_orders", f"WITH {ORDERS_NULLS_SQL}\n"
          + _union("(" + MODE_NUM_SQL + ")", NUM_COLS))
def profile_mode_numeric_orders(spark, sf):
    p = PR.profile(orders_nulls(spark, sf))
    return p.filter(F.col("kind") == "numeric").select(
        "column", F.col("mode").cast("double").alias("mode_value"), "mode_count")


@register("profile_mode_text_orders", f"WITH {ORDERS_NULLS_SQL}\n"
          + _union("(" + MODE_TXT_SQL + ")", ["o_orderstatus", "o_orderpriority"]))
def profile_mode_text_orders(spark, sf):
    p = PR.profile(orders_nulls(spark, sf))
    return p.filter(F.col("kind") == "text").select("column", "mode", "mode_count")


@register("profile_mode_text_customer", """
WITH c AS (SELECT c_name, c_mktsegment FROM customer)
""" + _union("(" + MODE_TXT_SQL.replace("FROM o", "FROM c") + ")", ["c_name", "c_mktsegment"]))
def profile_mode_text_customer(spark, sf):
    # c_name is unique: its mode is reported as N/A
    p = PR.profile(table(spark, sf, "customer").select("c_name", "c_mktsegment"))
    return p.select("column", "mode", "mode_count")


# ------------------------------------------------------------ G7 ----------
@register("profile_dates_orders", f"""
WITH {ORDERS_NULLS_SQL},
m AS (SELECT o_orderdate AS v, COUNT(*) AS n FROM o WHERE o_orderdate IS NOT NULL
      GROUP BY o_orderdate ORDER BY n DESC, v ASC LIMIT 1)
SELECT 'o_orderdate' AS "column", min(o_orderdate) AS date_min, max(o_orderdate) AS date_max,
       quantile_cont(o_orderdate, 0.5) AS date_median,
       date_sub('day', min(o_orderdate), max(o_orderdate)) AS date_range_days,
       (SELECT strftime(v, '%Y-%m-%d %H:%M:%S') FROM m) AS mode,
       (SELECT CAST(n AS BIGINT) FROM m) AS mode_count
FROM o""")
def profile_dates_orders(spark, sf):
    p = PR.profile(orders_nulls(spark, sf))
    return p.filter(F.col("kind") == "datetime").select(
        "column", "date_min", "date_max", "date_median", "date_range_days", "mode", "mode_count")


# ------------------------------------------------------------ G9 ----------
@register("profile_samples_orders", f"""
WITH {ORDERS_NULLS_SQL}
""" + _union("""  SELECT '{c}' AS "column",
         (SELECT string_agg(v, '|' ORDER BY v) FROM
            (SELECT DISTINCT {c} AS v FROM o WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)) AS samples""",
             ["o_orderstatus", "o_orderpriority"]) + """
  UNION ALL """ + _union("""  SELECT '{c}' AS "column",
         (SELECT string_agg(CAST(v AS VARCHAR), '|' ORDER BY v) FROM
            (SELECT DISTINCT {c} AS v FROM o WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)) AS samples""",
             ["o_orderkey", "o_custkey"]))
def profile_samples_orders(spark, sf):
    p = PR.profile(orders_nulls(spark, sf),
                   columns=["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])
    return p.select("column", F.concat_ws("|", "sample_values").alias("samples"))


# ----------------------------------------------------------- G10 ----------
@register("top_values_orders", """
SELECT o_orderpriority AS value FROM orders WHERE o_orderpriority IS NOT NULL
GROUP BY o_orderpriority ORDER BY value LIMIT 20""")
def top_values_orders(spark, sf):
    return PR.top_values(table(spark, sf, "orders"), "o_orderpriority")


@register("top_values_customer_name", """
SELECT c_name AS value FROM customer WHERE c_name IS NOT NULL
GROUP BY c_name ORDER BY value LIMIT 20""")
def top_values_customer_name(spark, sf):
    return PR.top_values(table(spark, sf, "customer"), "c_name")


# ------------------------------------------------------------ G2 ----------
@register("value_frequencies_lineitem", """
""" + "WITH x AS (SELECT 1)\n" + _union("""  SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, CAST(COUNT(*) AS BIGINT) AS count
  FROM lineitem GROUP BY {c}""", ["l_returnflag", "l_linestatus", "l_quantity",
                                  "l_linenumber", "l_discount"]))
def value_frequencies_lineitem(spark, sf):
    li = table(spark, sf, "lineitem")
    return PR.value_frequencies(li, ["l_returnflag", "l_linestatus", "l_quantity",
                                     "l_linenumber", "l_discount"])


# ----------------------------------------------------------- G13 ----------
@register("dataset_metrics_orders", f"""
WITH {ORDERS_NULLS_SQL},
n AS (SELECT COUNT(*) AS r,
             COUNT(*) * 6 - COUNT(o_orderkey) - COUNT(o_custkey) - COUNT(o_orderstatus)
               - COUNT(o_totalprice) - COUNT(o_orderdate) - COUNT(o_orderpriority) AS nc FROM o)
SELECT CAST(r AS BIGINT) AS total_rows, 6 AS total_columns, CAST(r * 6 AS BIGINT) AS total_cells,
       CAST(nc AS BIGINT) AS null_cells,
       COALESCE(CAST(r * 6 - nc AS DOUBLE) / NULLIF(r * 6, 0) * 100, 0.0) AS cell_completeness,
       4 AS dtype_count
FROM n""")
def dataset_metrics_orders(spark, sf):
    return PR.dataset_metrics(orders_nulls(spark, sf))


# ------------------------------------------------------- K1, K2, K4 -------
def customer_text(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    email = F.when(k % 10 == 0, F.concat(F.col("c_name"), F.lit("@bad"))) \
        .otherwise(F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.com")))
    padded = F.when(k % 6 == 0, F.concat(F.lit(" "), F.col("c_name"))) \
        .when(k % 7 == 0, F.concat(F.col("c_name"), F.lit("  "))).otherwise(F.col("c_name"))
    word = F.when(k % 4 == 0, F.lower("c_mktsegment")).when(k % 4 == 1, F.initcap("c_mktsegment")) \
        .when(k % 4 == 2, F.concat(F.lit("x"), F.upper("c_mktsegment"))) \
        .otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", email.alias("c_email"), padded.alias("c_padded"),
                    word.alias("c_word"), "c_mktsegment",
                    F.when(k % 8 == 0, None).otherwise(F.col("c_acctbal")).alias("c_acctbal"))


CUSTOMER_TEXT_SQL = """
c AS (
  SELECT c_custkey,
         CASE WHEN c_custkey % 10 = 0 THEN c_name || '@bad'
              ELSE lower(replace(c_name, '#', '.')) || '@example.com' END AS c_email,
         CASE WHEN c_custkey % 6 = 0 THEN ' ' || c_name
              WHEN c_custkey % 7 = 0 THEN c_name || '  ' ELSE c_name END AS c_padded,
         CASE WHEN c_custkey % 4 = 0 THEN lower(c_mktsegment)
              WHEN c_custkey % 4 = 1 THEN upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2))
              WHEN c_custkey % 4 = 2 THEN 'x' || upper(c_mktsegment)
              ELSE c_mktsegment END AS c_word,
         c_mktsegment,
         CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal
  FROM customer)"""

# text consistency from per-column counts (whole column, as the profile)
TEXT_K_SQL = """  SELECT '{c}' AS "column",
    CAST(COUNT({c}) AS BIGINT) AS n,
    COUNT(*) FILTER (WHERE contains({c}, '@') AND NOT regexp_matches({c}, '{email}')) AS bad_email,
    bool_or(contains({c}, '@')) OR contains(lower('{c}'), 'email') AS email_check,
    COUNT(*) FILTER (WHERE regexp_matches({c}, '^\\s') OR regexp_matches({c}, '\\s$')) AS ws,
    avg(length({c})) AS len_mean,
    COUNT(*) FILTER (WHERE regexp_matches({c}, '^[A-Za-z]+$') AND upper({c}) = {c} AND lower({c}) <> {c}) AS up,
    COUNT(*) FILTER (WHERE regexp_matches({c}, '^[A-Za-z]+$') AND lower({c}) = {c} AND upper({c}) <> {c}) AS low,
    COUNT(*) FILTER (WHERE regexp_matches({c}, '^[A-Za-z]+$') AND NOT (upper({c}) = {c} AND lower({c}) <> {c})
                     AND NOT (lower({c}) = {c} AND upper({c}) <> {c})
                     AND upper(substr({c}, 1, 1)) || lower(substr({c}, 2)) = {c}) AS title,
    COUNT(*) FILTER (WHERE regexp_matches({c}, '^[A-Za-z]+$') AND NOT (upper({c}) = {c} AND lower({c}) <> {c})
                     AND NOT (lower({c}) = {c} AND upper({c}) <> {c})
                     AND NOT (upper(substr({c}, 1, 1)) || lower(substr({c}, 2)) = {c})) AS mixed
  FROM c"""

K_SQL = f"""
WITH {CUSTOMER_TEXT_SQL},
t AS (
""" + _union(TEXT_K_SQL, ["c_email", "c_padded", "c_word", "c_mktsegment"]) + """
),
l AS (
""" + _union("""  SELECT '{c}' AS "column", COUNT(*) FILTER (
      WHERE abs(length({c}) - (SELECT avg(length({c})) FROM c)) > (SELECT avg(length({c})) FROM c) * 0.5) AS len_dev
  FROM c""", ["c_email", "c_padded", "c_word", "c_mktsegment"]) + """
),
s AS (
  SELECT t.*, l.len_dev,
         CASE WHEN email_check THEN bad_email ELSE 0 END AS email_issues,
         CASE WHEN n > 5 AND len_mean > 5 THEN CAST(len_dev AS DOUBLE) * 0.5 ELSE 0.0 END AS len_issues,
         up + low + title + mixed AS alpha_total,
         (CAST(up > 0 AS INTEGER) + CAST(low > 0 AS INTEGER) + CAST(title > 0 AS INTEGER)
            + CAST(mixed > 0 AS INTEGER)) AS used
  FROM t JOIN l USING ("column")),
q AS (SELECT quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.75) AS q3,
             COUNT(c_acctbal) AS n FROM c),
num AS (
  SELECT 'c_acctbal' AS "column",
         CASE WHEN q.n = 0 THEN 0.0 WHEN q.n > 2 THEN greatest(70.0, 100 - CAST((SELECT COUNT(*) FROM c
              WHERE c_acctbal < q.q1 - 1.5 * (q.q3 - q.q1) OR c_acctbal > q.q3 + 1.5 * (q.q3 - q.q1)) AS DOUBLE)
              / q.n * 100 * 2) ELSE 100.0 END AS consistency_standard
  FROM q)
SELECT "column",
       CASE WHEN n = 0 THEN 0.0 ELSE greatest(0.0, 100 - email_issues / n * 100) END AS consistency_standard,
       CASE WHEN n = 0 THEN 0.0 ELSE greatest(0.0, 100 - (email_issues + len_issues
            + CASE WHEN alpha_total > 5 AND used > 2 THEN CAST(alpha_total AS DOUBLE) * 0.1 ELSE 0.0 END) / n * 100) END
         AS consistency_extended,
       CASE WHEN n = 0 THEN 0.0 ELSE greatest(0.0, 100 - ws / n * 100) END AS consistency_whitespace
FROM s
UNION ALL
SELECT "column", consistency_standard, consistency_standard, 100.0 FROM num"""


@register("profile_consistency_customer", K_SQL)
def profile_consistency_customer(spark, sf):
    p = PR.profile(customer_text(spark, sf),
                   columns=["c_email", "c_padded", "c_word", "c_mktsegment", "c_acctbal"])
    return p.select("column", "consistency_standard", "consistency_extended",
                    "consistency_whitespace")


@register("profile_exact_integers_orders", """
WITH o AS (SELECT 9007199254740993 + 2 * (o_custkey % 1000) AS big FROM orders)
SELECT 'big' AS "column", CAST(min(big) AS VARCHAR) AS min_value, CAST(max(big) AS VARCHAR) AS max_value,
       (SELECT CAST(big AS VARCHAR) FROM o GROUP BY big ORDER BY COUNT(*) DESC, big LIMIT 1) AS mode
FROM o""")
def profile_exact_integers_orders(spark, sf):
    # Integers that a double cannot hold
    o = table(spark, sf, "orders").select((F.lit(9007199254740993) + 2 * (F.col("o_custkey") % 1000)).alias("big"))
    return PR.profile(o, only=["column", "min_value", "max_value", "mode"])
