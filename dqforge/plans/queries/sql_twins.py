"""DuckDB twins of the schema-derived queries (labels, fingerprints, pivots).

DuckDB describes a query's columns with its own type names; these map them
to the Spark names and to the three type labels.
"""

from __future__ import annotations

SPARK_TYPE = ("CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' "
              "WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' "
              "WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'BOOLEAN' THEN 'boolean' END")
LABEL = ("CASE WHEN column_type IN ('BIGINT', 'INTEGER') THEN 'Integer' "
         "WHEN column_type = 'DOUBLE' THEN 'Decimal' WHEN column_type = 'VARCHAR' THEN 'Text/String' "
         "WHEN column_type = 'TIMESTAMP' THEN 'Date/Time' WHEN column_type = 'BOOLEAN' THEN 'Boolean' END")


def _boolish(src: str, cols: list[str]) -> str:
    """Text columns whose non-null values are all true/false/1/0 (label A)."""
    return "\n  UNION ALL\n".join(
        f"""  SELECT '{c}' AS c, COUNT({c}) > 0 AND COALESCE(bool_and(lower({c}) IN ('true', 'false', '1', '0')), FALSE) AS b
  FROM {src}""" for c in cols)


TYPE_LABELS_LINEITEM = f"""
WITH d AS (SELECT column_name, column_type FROM (DESCRIBE SELECT * FROM lineitem)),
b AS (
{_boolish("lineitem", ["l_returnflag", "l_linestatus"])})
SELECT d.column_name AS "column", {SPARK_TYPE} AS spark_type,
       CASE WHEN COALESCE(b.b, FALSE) THEN 'Boolean' ELSE {LABEL} END AS data_type,
       {LABEL} AS data_type_b, {LABEL} AS data_type_c
FROM d LEFT JOIN b ON d.column_name = b.c"""

NUMERIC_AND_TEXT_LINEITEM = f"""
WITH d AS (SELECT column_name, column_type FROM (DESCRIBE SELECT * FROM lineitem))
SELECT column_name AS "column",
       CASE WHEN column_type = 'VARCHAR' THEN 'text' ELSE 'numeric' END AS selection,
       CAST((SELECT COUNT(*) FROM lineitem) AS BIGINT) AS non_null_count
FROM d WHERE column_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'VARCHAR')"""


def type_distribution(cte: str, src: str, text_cols: list[str], describe: str) -> str:
    """``describe`` is a plain table with the same column types as ``src``."""
    return f"""
WITH {cte},
d AS (SELECT column_name, column_type FROM (DESCRIBE SELECT * FROM {describe})),
b AS (
{_boolish(src, text_cols)}),
l AS (SELECT CASE WHEN COALESCE(b.b, FALSE) THEN 'Boolean' ELSE {LABEL} END AS data_type
      FROM d LEFT JOIN b ON d.column_name = b.c)
SELECT data_type, CAST(COUNT(*) AS BIGINT) AS count,
       round_even(CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM l) * 100, 1) AS percentage
FROM l GROUP BY data_type"""


TYPE_DISTRIBUTION_APP_LINEITEM = f"""
WITH d AS (SELECT column_name, column_type FROM (DESCRIBE SELECT * FROM lineitem)),
l AS (SELECT {LABEL} AS data_type FROM d)
SELECT data_type, CAST(COUNT(*) AS BIGINT) AS count,
       round_even(CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM l) * 100, 1) AS percentage
FROM l GROUP BY data_type"""


def rule_descriptions(res_sql: str) -> str:
    """H18 over the flagship results: title, description, counts."""
    d = """CASE
      WHEN lower(rule) LIKE '%range%' AND lower(rule) LIKE '%date%' THEN 'Validates that dates fall within acceptable time periods.'
      WHEN lower(rule) LIKE '%range%' THEN 'Ensures numeric values fall within specified minimum and maximum bounds.'
      WHEN rule = 'not null' OR lower(rule) LIKE '%not null%' THEN 'Checks for missing or empty values in the column. Ensures data completeness.'
      WHEN rule = 'unique' OR lower(rule) LIKE '%unique%' THEN 'Verifies that all values in the column are distinct. Identifies duplicate entries.'
      WHEN lower(rule) LIKE '%matches regex%' THEN 'Validates data format using pattern matching. Ensures values follow specific formats (emails, phone numbers, etc.).'
      WHEN lower(rule) LIKE '%in allowed set%' THEN 'Confirms values are from a predefined list of acceptable options. Enforces data consistency.'
      ELSE 'Validates data quality according to specified business rules.' END"""
    return res_sql + f"""
SELECT rule, {d} AS description, CAST(COUNT(*) AS BIGINT) AS rules,
       round_even(avg(success_rate), 9) AS avg_success_rate, CAST(SUM(failed) AS BIGINT) AS failed
FROM res GROUP BY rule"""


# ---- snapshots of orders by year (see q_history) -------------------------
YEAR_SCHEMA = f"""
d AS (SELECT column_name, column_type FROM (DESCRIBE SELECT CAST(year(o_orderdate) AS INTEGER) AS yr,
        o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders)),
y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS seq FROM orders),
s AS (SELECT y.seq, 'orders_' || CAST(y.seq AS VARCHAR) AS snapshot, d.column_name,
             {SPARK_TYPE} AS t, {LABEL} AS data_type
      FROM y, d WHERE NOT (d.column_name = 'o_orderpriority' AND y.seq >= 1999))"""

SCHEMA_FINGERPRINT_ORDERS = f"""
WITH {YEAR_SCHEMA}
SELECT seq, string_agg(column_name || ':' || t, '|' ORDER BY column_name || ':' || t) AS schema_fingerprint
FROM s GROUP BY seq"""

SNAPSHOT_TYPES_ORDERS = f"""
WITH {YEAR_SCHEMA},
n AS (SELECT seq, COUNT(*) AS n FROM s GROUP BY seq)
SELECT s.seq, snapshot, data_type, CAST(COUNT(*) AS BIGINT) AS count,
       round_even(CAST(COUNT(*) AS DOUBLE) / max(n.n) * 100, 1) AS percentage
FROM s JOIN n ON s.seq = n.seq GROUP BY s.seq, snapshot, data_type"""

TYPE_PIVOT_ORDERS = f"""
WITH {YEAR_SCHEMA}
SELECT seq, snapshot,
       CAST(COUNT(*) FILTER (WHERE data_type = 'Integer') AS BIGINT) AS "Integer",
       CAST(COUNT(*) FILTER (WHERE data_type = 'Decimal') AS BIGINT) AS "Decimal",
       CAST(COUNT(*) FILTER (WHERE data_type = 'Text/String') AS BIGINT) AS "Text/String"
FROM s GROUP BY seq, snapshot"""


def field_diff_orders(years_sql: str) -> str:
    """J1 between the 1996 and 2000 snapshots (``years_sql`` defines ``s``)."""
    cols = ["yr", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    stats = "\n  UNION ALL\n".join(
        f"""  SELECT yr, '{c}' AS field,
         round_even(CAST(COUNT(*) - COUNT({c}) AS DOUBLE) / COUNT(*) * 100, 2) AS np,
         COUNT(DISTINCT {c}) AS u FROM s WHERE yr IN (1996, 2000)
         {"AND yr < 1999" if c == "o_orderpriority" else ""} GROUP BY yr""" for c in cols)
    return f"""
WITH {years_sql},
{YEAR_SCHEMA.strip().replace("s AS (", "sch AS (", 1)},
st AS (
{stats}),
t AS (SELECT st.*, sch.t FROM st JOIN sch ON st.yr = sch.seq AND st.field = sch.column_name),
a AS (SELECT * FROM t WHERE yr = 1996), b AS (SELECT * FROM t WHERE yr = 2000)
SELECT COALESCE(a.field, b.field) AS field, COALESCE(a.t, 'N/A') AS version_a_type,
       COALESCE(b.t, 'N/A') AS version_b_type,
       COALESCE(b.np, 0.0) - COALESCE(a.np, 0.0) AS null_pct_change,
       CAST(COALESCE(b.u, 0) - COALESCE(a.u, 0) AS BIGINT) AS unique_count_change
FROM a FULL OUTER JOIN b ON a.field = b.field"""
