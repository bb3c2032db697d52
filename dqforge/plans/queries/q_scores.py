"""Registered score / health / criticality queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ...operators import profile as PR
from ...operators import scores as S
from ...operators.rules import evaluate
from ...plans import snapshot as SN
from ...sources.tables import table
from . import sql_twins as TW
from .sql_twin_fields import field_summary_sql
from .q_rules import FLAGSHIP_RULES, FLAGSHIP_SQL, lineitem_nulls

QUERIES: dict = {}
ORACLE: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ----------------------------------------------------------- set-up -------
def orders_bands(spark, sf):
    """orders with NULL shares 0 / 1 / 5 / 10 / 15 / 25 % across its columns."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey",
        F.when(k % 20 == 0, None).otherwise(F.col("o_custkey")).alias("o_custkey"),
        F.when(k % 100 == 7, None).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when((k % 20 >= 1) & (k % 20 <= 3), None).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.when(k % 10 == 5, None).otherwise(F.col("o_orderdate")).alias("o_orderdate"),
        F.when(k % 4 == 0, None).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))


BANDS_SQL = """
o AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
         CASE WHEN o_orderkey % 100 = 7 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderkey % 20 BETWEEN 1 AND 3 THEN NULL ELSE o_totalprice END AS o_totalprice,
         CASE WHEN o_orderkey % 10 = 5 THEN NULL ELSE o_orderdate END AS o_orderdate,
         CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders)"""

COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
NUMS = ["o_orderkey", "o_custkey", "o_totalprice"]
TEXTS = ["o_orderstatus", "o_orderpriority"]


def _union(t, cols):
    return "\n  UNION ALL\n".join(t.format(c=c, i=COLS.index(c) if c in COLS else i)
                                  for i, c in enumerate(cols))


# per-column completeness / uniqueness / K1 / K4 of the band table, in SQL
PERCOL_SQL = (BANDS_SQL + """,
base AS (
""" + _union("""  SELECT {i} AS ordinal, '{c}' AS "column", COUNT(*) AS total_count,
         COUNT(*) - COUNT({c}) AS null_count, COUNT(DISTINCT {c}) AS distinct_count,
         COALESCE(CAST(COUNT({c}) AS DOUBLE) / NULLIF(COUNT(*), 0) * 100, 0.0) AS completeness,
         COALESCE(CAST(COUNT(DISTINCT {c}) AS DOUBLE) / NULLIF(COUNT(*), 0) * 100, 0.0) AS uniqueness
  FROM o""", COLS) + """),
k1 AS (
""" + _union("""  SELECT '{c}' AS "column",
         CASE WHEN n = 0 THEN 0.0 WHEN n > 2 THEN greatest(70.0, 100 - CAST(outl AS DOUBLE) / n * 100 * 2)
              ELSE 100.0 END AS k1, 100.0 AS k4
  FROM (SELECT COUNT({c}) AS n,
               COUNT(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outl
        FROM o, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM o))""", NUMS)
    + """
  UNION ALL
""" + _union("""  SELECT '{c}' AS "column", CASE WHEN COUNT({c}) = 0 THEN 0.0 ELSE 100.0 END,
         CASE WHEN COUNT({c}) = 0 THEN 0.0 ELSE greatest(0.0, 100 - CAST(COUNT(*) FILTER (
           WHERE regexp_matches({c}, '^\\s') OR regexp_matches({c}, '\\s$')) AS DOUBLE) / COUNT({c}) * 100) END
  FROM o""", TEXTS) + """
  UNION ALL
  SELECT 'o_orderdate', CASE WHEN COUNT(o_orderdate) = 0 THEN 0.0 ELSE 95.0 END,
         CASE WHEN COUNT(o_orderdate) = 0 THEN 0.0 ELSE 100.0 END FROM o),
pc AS (SELECT * FROM base JOIN k1 USING ("column"))""")


def bands_profile(spark, sf):
    return PR.profile(orders_bands(spark, sf))


# ------------------------------------------------------- H12, H13 ---------
@register("critical_suggestions_orders", "WITH " + PERCOL_SQL + """
SELECT ordinal, "column", completeness,
       completeness >= 80 AND null_count < total_count * 0.5 AS suggested,
       CASE WHEN completeness >= 80 AND null_count < total_count * 0.5
            THEN 3 + CASE WHEN completeness >= 95 THEN 2 WHEN completeness >= 90 THEN 1 ELSE 0 END
                   + CASE WHEN completeness >= 99 THEN 1 ELSE 0 END ELSE 0 END AS score,
       CASE WHEN completeness >= 80 AND null_count < total_count * 0.5
            THEN concat_ws('; ', 'Meets quality threshold',
                   CASE WHEN completeness >= 95 THEN 'Excellent completeness'
                        WHEN completeness >= 90 THEN 'High completeness' END,
                   CASE WHEN completeness >= 99 THEN 'Near-perfect completeness' END)
            ELSE concat_ws('; ', CASE WHEN completeness < 80 THEN printf('Low completeness (%.1f%%)', completeness) END,
                   CASE WHEN null_count >= total_count * 0.5 THEN 'Too many null values' END) END AS reasons,
       CASE WHEN completeness >= 80 AND null_count < total_count * 0.5 THEN
            CASE WHEN completeness >= 95 THEN 'High' WHEN completeness >= 90 THEN 'Medium' ELSE 'Low' END
       END AS confidence,
       CASE WHEN completeness >= 80 AND null_count < total_count * 0.5 THEN 'Recommended' ELSE 'Manual' END AS status
FROM pc""")
def critical_suggestions_orders(spark, sf):
    return S.critical_suggestions(bands_profile(spark, sf)).drop("null_count", "total_count")


# ------------------------------------------------------------ H10 ---------
@register("critical_flags_orders", "WITH " + PERCOL_SQL + """
SELECT "column", completeness >= 80 AND (CAST(total_count - null_count AS DOUBLE) / total_count) >= 0.7
                 AND null_count < total_count * 0.5 AS is_critical_auto,
       "column" IN ('o_orderkey', 'o_orderpriority') AS is_critical_user
FROM pc""")
def critical_flags_orders(spark, sf):
    p = bands_profile(spark, sf)
    auto = S.with_critical(p).select("column", F.col("is_critical").alias("is_critical_auto"))
    user = S.with_critical(p, ["o_orderkey", "o_orderpriority"]).select(
        "column", F.col("is_critical").alias("is_critical_user"))
    return auto.join(user, "column")


# ------------------------------------------------------------ H5 ----------
@register("overall_quality_orders", "WITH " + PERCOL_SQL + """,
m AS (SELECT avg(round_even(completeness, 1)) AS c, avg(round_even(uniqueness, 1)) AS u,
             avg(round_even(k1, 1)) AS k FROM pc)
SELECT round_even(c, 1) AS completeness, round_even(u, 1) AS uniqueness,
       round_even(k, 1) AS consistency, round_even((c + u + k) / 3, 1) AS combined_score FROM m""")
def overall_quality_orders(spark, sf):
    return S.overall_quality(bands_profile(spark, sf))


# ------------------------------------------------------- H7, H8 -----------
@register("overall_quality_app_orders", "WITH " + PERCOL_SQL + """,
m AS (SELECT avg(round_even(completeness, 1)) AS c, avg(round_even(uniqueness, 1)) AS u,
             avg(round_even(k4, 1)) AS k FROM pc)
SELECT round_even(c, 1) AS completeness, round_even(u, 1) AS uniqueness,
       round_even(k, 1) AS consistency, round_even((c + u + k) / 3, 1) AS combined_score,
       round_even((round_even(c, 1) + round_even(u, 1)) / 2, 1) AS snapshot_score FROM m""")
def overall_quality_app_orders(spark, sf):
    q = S.overall_quality(bands_profile(spark, sf), consistency="consistency_whitespace")
    return q.withColumn("snapshot_score", S.snapshot_score(F.col("completeness"),
                                                           F.col("uniqueness")))


# ------------------------------------------------------------ H6 ----------
@register("report_quality_orders", "WITH " + PERCOL_SQL + """,
cells AS (SELECT SUM(total_count) AS cells, SUM(null_count) AS nulls FROM pc)
SELECT round_even(COALESCE(CAST(cells - nulls AS DOUBLE) / NULLIF(cells, 0) * 100, 0.0), 9) AS completeness,
       round_even((SELECT avg(uniqueness) FROM pc WHERE distinct_count > 0), 9) AS uniqueness,
       CAST(100.0 AS DOUBLE) AS consistency,
       round_even((COALESCE(CAST(cells - nulls AS DOUBLE) / NULLIF(cells, 0) * 100, 0.0)
        + (SELECT avg(uniqueness) FROM pc WHERE distinct_count > 0) + 100.0) / 3, 9) AS overall_score
FROM cells""")
def report_quality_orders(spark, sf):
    df = orders_bands(spark, sf)
    r = S.report_quality(PR.profile(df), PR.dataset_metrics(df))
    return r.select(F.bround("completeness", 9).alias("completeness"),
                    F.bround("uniqueness", 9).alias("uniqueness"), "consistency",
                    F.bround("overall_score", 9).alias("overall_score"))


# ------------------------------------------------------------ W7 ----------
def places(ordered, name, key="seq"):
    """Key and place of every row of a small sorted table, as it stands."""
    whole = ordered.coalesce(1).withColumn("_p", F.monotonically_increasing_id())
    return whole.select(key, F.row_number().over(Window.orderBy("_p")).alias(name))


@register("field_order_orders", "WITH " + PERCOL_SQL + """
SELECT "column", CAST(row_number() OVER (
    ORDER BY (completeness >= 80 AND (CAST(total_count - null_count AS DOUBLE) / total_count) >= 0.7
              AND null_count < total_count * 0.5) DESC, round_even(completeness, 1) DESC, ordinal)
    AS INTEGER) AS position
FROM pc""")
def field_order_orders(spark, sf):
    return places(S.field_order(S.with_critical(bands_profile(spark, sf))), "position", key="column")


# ------------------------------------------------- G14-G18 (rows) ---------
@register("type_labels_lineitem", TW.TYPE_LABELS_LINEITEM)
def type_labels_lineitem(spark, sf):
    return PR.profile(table(spark, sf, "lineitem"), only=["column", "spark_type", "data_type", "data_type_b", "data_type_c"])


@register("type_distribution_orders",
          TW.type_distribution(BANDS_SQL.strip(), "o", TEXTS, describe="orders"))
def type_distribution_orders(spark, sf):
    return S.type_distribution(bands_profile(spark, sf))


@register("type_distribution_app_lineitem", TW.TYPE_DISTRIBUTION_APP_LINEITEM)
def type_distribution_app_lineitem(spark, sf):
    return S.type_distribution(PR.profile(table(spark, sf, "lineitem")), label="data_type_c")


@register("numeric_and_text_columns_lineitem", TW.NUMERIC_AND_TEXT_LINEITEM)
def numeric_and_text_columns_lineitem(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = [(c, "numeric") for c in PR.numeric_columns(li)] + [(c, "text") for c in PR.text_columns(li)]
    # P1/P2 are schema selections; join to the profile so the answer is data-derived
    sel = spark.createDataFrame(rows, "column string, selection string")
    return sel.join(PR.profile(li, only=["column", "non_null_count"]), "column")


# ------------------------------------------------ rule summaries ----------
RES_SQL = "WITH res AS (" + FLAGSHIP_SQL.strip() + ")\n"


@register("rule_health_lineitem", RES_SQL + """
SELECT CAST(COUNT(*) AS BIGINT) AS total_rules,
       CAST(COUNT(*) FILTER (WHERE success_rate >= 90) AS BIGINT) AS excellent_rules,
       CAST(COUNT(*) FILTER (WHERE success_rate >= 75 AND success_rate < 90) AS BIGINT) AS good_rules,
       CAST(COUNT(*) FILTER (WHERE success_rate >= 50 AND success_rate < 75) AS BIGINT) AS fair_rules,
       CAST(COUNT(*) FILTER (WHERE success_rate < 50) AS BIGINT) AS poor_rules,
       round_even(CAST(COUNT(*) FILTER (WHERE success_rate >= 90) AS DOUBLE) / COUNT(*) * 100, 1) AS excellent_percentage,
       round_even(CAST(COUNT(*) FILTER (WHERE success_rate >= 75 AND success_rate < 90) AS DOUBLE) / COUNT(*) * 100, 1) AS good_percentage,
       round_even(CAST(COUNT(*) FILTER (WHERE success_rate >= 50 AND success_rate < 75) AS DOUBLE) / COUNT(*) * 100, 1) AS fair_percentage,
       round_even(CAST(COUNT(*) FILTER (WHERE success_rate < 50) AS DOUBLE) / COUNT(*) * 100, 1) AS poor_percentage
FROM res""")
def rule_health_lineitem(spark, sf):
    return S.rule_health_distribution(evaluate(lineitem_nulls(spark, sf), FLAGSHIP_RULES))


@register("overall_health_lineitem", RES_SQL + """
SELECT CAST(COUNT(*) AS BIGINT) AS total_rules_executed,
       round_even(avg(success_rate), 1) AS overall_health_score,
       CASE WHEN avg(success_rate) >= 90 THEN 'Excellent' WHEN avg(success_rate) >= 75 THEN 'Good'
            WHEN avg(success_rate) >= 50 THEN 'Fair' ELSE 'Poor' END AS overall_health_status
FROM res""")
def overall_health_lineitem(spark, sf):
    return S.overall_health(evaluate(lineitem_nulls(spark, sf), FLAGSHIP_RULES))


@register("validation_summary_lineitem", RES_SQL + """
SELECT CAST(COUNT(*) AS BIGINT) AS total_validations,
       CAST(COUNT(*) FILTER (WHERE success_rate >= 90) AS BIGINT) AS passed_validations,
       round_even(avg(success_rate), 9) AS avg_success_rate
FROM res""")
def validation_summary_lineitem(spark, sf):
    v = S.validation_summary(evaluate(lineitem_nulls(spark, sf), FLAGSHIP_RULES))
    return v.withColumn("avg_success_rate", F.bround("avg_success_rate", 9))


@register("bar_chart_lineitem", RES_SQL + """
SELECT seq, "column", success_rate, health AS band,
       CASE WHEN success_rate >= 90 THEN '#28a745' WHEN success_rate >= 75 THEN '#17a2b8'
            WHEN success_rate >= 50 THEN '#ffc107' ELSE '#dc3545' END AS color
FROM res""")
def bar_chart_lineitem(spark, sf):
    return S.bar_chart_data(evaluate(lineitem_nulls(spark, sf), FLAGSHIP_RULES))


@register("rule_groups_lineitem", RES_SQL + """
SELECT rule,
       CASE WHEN rule = 'not null' THEN 'Not Null' WHEN rule = 'unique' THEN 'Unique'
            ELSE NULL END AS t,
       CAST(COUNT(*) AS BIGINT) AS rules, round_even(avg(success_rate), 9) AS avg_success_rate,
       CAST(SUM(failed) AS BIGINT) AS failed
FROM res GROUP BY rule""")
def rule_groups_lineitem(spark, sf):
    g = S.rule_groups(evaluate(lineitem_nulls(spark, sf), FLAGSHIP_RULES))
    return g.select("rule", F.when(F.col("rule") == "not null", F.col("title"))
                    .when(F.col("rule") == "unique", F.col("title")).alias("t"),
                    "rules", F.bround("avg_success_rate", 9).alias("avg_success_rate"), "failed")


@register("rule_descriptions_lineitem", TW.rule_descriptions(RES_SQL))
def rule_descriptions_lineitem(spark, sf):
    g = S.rule_groups(evaluate(lineitem_nulls(spark, sf), FLAGSHIP_RULES))
    return g.select("rule", "description", "rules",
                    F.bround("avg_success_rate", 9).alias("avg_success_rate"), "failed")


# ---------------------------------------------------- H15, H16, H17 -------
def _orders_snapshot(spark, sf, critical=None):
    df = orders_bands(spark, sf)
    from ...operators.rules import rules_from_config
    from .q_rowflags import ORDERS_CONFIG
    res = evaluate(df, rules_from_config(ORDERS_CONFIG, df.columns))
    return SN.comprehensive_snapshot(df, res, title="orders", dataset_name="orders",
                                     critical_columns=critical)


@register("snapshot_orders")
def snapshot_orders(spark, sf):
    return _orders_snapshot(spark, sf).drop("metadata")


@register("snapshot_flat_orders")
def snapshot_flat_orders(spark, sf):
    return SN.flatten_snapshot(_orders_snapshot(spark, sf)).drop("timestamp")


@register("critical_averages_orders", "WITH " + PERCOL_SQL + """,
c AS (SELECT *, completeness >= 80 AND (CAST(total_count - null_count AS DOUBLE) / total_count) >= 0.7
                AND null_count < total_count * 0.5 AS crit FROM pc)
SELECT COALESCE(round_even(avg(round_even(completeness, 1)) FILTER (WHERE crit), 1), 0.0) AS critical_avg_completeness,
       COALESCE(round_even(avg(round_even(uniqueness, 1)) FILTER (WHERE crit), 1), 0.0) AS critical_avg_uniqueness,
       COALESCE(round_even(avg(round_even(k1, 1)) FILTER (WHERE crit), 1), 0.0) AS critical_avg_consistency,
       COALESCE(round_even(avg(round_even(completeness, 1)) FILTER (WHERE NOT crit), 1), 0.0) AS other_avg_completeness,
       COALESCE(round_even(avg(round_even(uniqueness, 1)) FILTER (WHERE NOT crit), 1), 0.0) AS other_avg_uniqueness,
       COALESCE(round_even(avg(round_even(k1, 1)) FILTER (WHERE NOT crit), 1), 0.0) AS other_avg_consistency,
       CAST(COUNT(*) FILTER (WHERE crit) AS INTEGER) AS critical_elements_count,
       CAST(COUNT(*) FILTER (WHERE NOT crit) AS INTEGER) AS other_fields_count
FROM c""")
def critical_averages_orders(spark, sf):
    flat = SN.flatten_snapshot(_orders_snapshot(spark, sf))
    return flat.select("critical_avg_completeness", "critical_avg_uniqueness",
                       "critical_avg_consistency", "other_avg_completeness",
                       "other_avg_uniqueness", "other_avg_consistency",
                       "critical_elements_count", "other_fields_count")


@register("field_summary_orders", field_summary_sql(
    PERCOL_SQL, NUMS, TEXTS, ["o_orderdate"],
    {"o_orderkey": "Integer", "o_custkey": "Integer", "o_orderstatus": "Text/String",
     "o_totalprice": "Decimal", "o_orderdate": "Date/Time", "o_orderpriority": "Text/String"}))
def field_summary_orders(spark, sf):
    return SN.field_summary(orders_bands(spark, sf), title="orders",
                            dataset_name="orders").drop("timestamp")


@register("suggestion_order_orders", "WITH " + PERCOL_SQL + """,
s AS (SELECT "column", ordinal, 3 + CASE WHEN completeness >= 95 THEN 2 WHEN completeness >= 90 THEN 1 ELSE 0 END
                                  + CASE WHEN completeness >= 99 THEN 1 ELSE 0 END AS score
      FROM pc WHERE completeness >= 80 AND null_count < total_count * 0.5)
SELECT "column", CAST(row_number() OVER (ORDER BY score DESC, ordinal) AS INTEGER) AS position FROM s""")
def suggestion_order_orders(spark, sf):
    # The order in which columns are suggested
    return places(S.suggestion_order(S.critical_suggestions(bands_profile(spark, sf))), "position", key="column")


@register("snapshot_columns_orders", "WITH " + PERCOL_SQL + """
SELECT "column" AS column_name, completeness >= 80 AND (CAST(total_count - null_count AS DOUBLE) / total_count) >= 0.7
                 AND null_count < total_count * 0.5 AS critical,
       round_even(completeness, 1) AS completeness, round_even(uniqueness, 1) AS uniqueness, round_even(k1, 1) AS consistency
FROM pc""")
def snapshot_columns_orders(spark, sf):
    # The two column lists of the nested snapshot
    snap = _orders_snapshot(spark, sf)
    parts = [snap.select(F.inline(F.col(f"{g}.columns"))).withColumn("critical", F.lit(c))
             for g, c in (("critical_data_elements", True), ("other_fields", False))]
    name = "column" if "column" in parts[0].columns else parts[0].columns[0]
    return parts[0].unionByName(parts[1]).select(F.col(name).alias("column_name"), "critical", "completeness", "uniqueness", "consistency")


@register("snapshot_type_counts_orders", """
SELECT 'columns_' || replace(replace(lower(t), '/', '_'), ' ', '_') || '_count' AS name, CAST(COUNT(*) AS BIGINT) AS n
FROM (SELECT CASE WHEN column_type IN ('BIGINT', 'INTEGER') THEN 'Integer' WHEN column_type = 'DOUBLE' THEN 'Decimal'
                  WHEN column_type LIKE 'TIMESTAMP%' OR column_type = 'DATE' THEN 'Date/Time' ELSE 'Text/String' END AS t
      FROM (DESCRIBE SELECT * FROM orders)) GROUP BY 1""")
def snapshot_type_counts_orders(spark, sf):
    # The type counts of the flat snapshot
    return SN.flatten_snapshot(_orders_snapshot(spark, sf)).select(F.explode("type_counts").alias("name", "n"))
