"""Registered rule queries (R1-R17, S10, H1) and their SQL twins.

Set-up shared by both sides: NULLs are injected into whole tables by key
arithmetic (the test tables have none), every row is processed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import rules as R
from ...plans.scorecard import scorecard
from ...sources.tables import table

QUERIES: dict = {}
ORACLE: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- set-up ---
def lineitem_nulls(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_orderkey") % 7 == 0, None).otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(F.col("l_orderkey") % 11 == 0, None).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus", "l_shipdate", "l_discount", "l_extendedprice", "l_tax")


LI_NULLS_SQL = """
li AS (
  SELECT l_orderkey, l_linenumber, l_partkey,
         CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
         CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
         l_linestatus, l_shipdate, l_discount, l_extendedprice, l_tax
  FROM lineitem)"""


def _result_sql(body: str, ctes: str = LI_NULLS_SQL) -> str:
    """Wrap ``r(seq, col, rule, total, failed)`` rows into the scorecard shape."""
    return f"""
WITH {ctes},
r AS ({body})
SELECT seq, col AS "column", rule,
       CAST(total AS BIGINT) AS total,
       CAST(total - failed AS BIGINT) AS passed,
       CAST(failed AS BIGINT) AS failed,
       COALESCE(CAST(total - failed AS DOUBLE) / NULLIF(total, 0) * 100, 0.0) AS success_rate,
       CASE WHEN COALESCE(CAST(total - failed AS DOUBLE) / NULLIF(total, 0) * 100, 0.0) >= 90 THEN 'Excellent'
            WHEN COALESCE(CAST(total - failed AS DOUBLE) / NULLIF(total, 0) * 100, 0.0) >= 75 THEN 'Good'
            WHEN COALESCE(CAST(total - failed AS DOUBLE) / NULLIF(total, 0) * 100, 0.0) >= 50 THEN 'Fair'
            ELSE 'Poor' END AS health
FROM r"""


def _dup_sql(seq, label, rule, keys, src="li", null_key_passes=True):
    keys_sql = ", ".join(keys)
    where = f"WHERE {keys[0]} IS NOT NULL" if null_key_passes else ""
    return (f"SELECT {seq} AS seq, '{label}' AS col, '{rule}' AS rule, "
            f"(SELECT COUNT(*) FROM {src}) AS total, "
            f"COALESCE((SELECT SUM(n) FROM (SELECT COUNT(*) AS n FROM {src} {where} "
            f"GROUP BY {keys_sql} HAVING COUNT(*) > 1) d), 0) AS failed")


# ------------------------------------------------------------ flagship ----
FLAGSHIP_RULES = [
    R.expect_column_values_to_not_be_null("l_quantity"),
    R.expect_column_values_to_be_unique("l_orderkey"),
    R.expect_column_values_to_be_in_set("l_returnflag", ["A", "N"]),
    R.expect_column_values_to_match_regex("l_linestatus", r"[OF]$"),
    R.expect_column_values_to_be_in_range("l_quantity", 5, 45),
    R.expect_column_values_to_be_in_date_range("l_shipdate", "1996-01-01", "1998-12-31"),
    R.expect_columns_values_to_not_be_null(["l_quantity", "l_returnflag"]),
    R.expect_columns_values_to_be_unique(["l_orderkey", "l_linenumber"]),
    R.expect_columns_values_to_be_in_sets(["l_returnflag", "l_linestatus"], [["A", "N", "R"], ["O"]]),
    R.expect_columns_values_to_match_patterns(["l_returnflag", "l_linestatus"],
                                              {"l_returnflag": "[AR]", "l_linestatus": "F"}),
    R.expect_columns_values_to_be_in_ranges(["l_quantity", "l_discount"],
                                            {"l_quantity": (1, 30), "l_discount": (0.0, 0.05)}),
]

FLAGSHIP_SQL = _result_sql("""
  SELECT 0 AS seq, 'l_quantity' AS col, 'not null' AS rule, COUNT(*) AS total,
         COUNT(*) FILTER (WHERE l_quantity IS NULL) AS failed FROM li
  UNION ALL """ + _dup_sql(1, "l_orderkey", "unique", ["l_orderkey"]) + """
  UNION ALL
  SELECT 2, 'l_returnflag', 'in allowed set', COUNT(*),
         COUNT(*) FILTER (WHERE NOT COALESCE(l_returnflag IN ('A', 'N'), FALSE)) FROM li
  UNION ALL
  SELECT 3, 'l_linestatus', 'matches regex', COUNT(*),
         COUNT(*) FILTER (WHERE NOT COALESCE(regexp_matches(l_linestatus, '^(?:[OF]$)'), FALSE)) FROM li
  UNION ALL
  SELECT 4, 'l_quantity', 'in range 5-45', COUNT(*),
         COUNT(*) FILTER (WHERE NOT COALESCE(l_quantity BETWEEN 5 AND 45, FALSE)) FROM li
  UNION ALL
  SELECT 5, 'l_shipdate', 'in date range', COUNT(l_shipdate),
         COUNT(*) FILTER (WHERE l_shipdate < TIMESTAMP '1996-01-01' OR l_shipdate > TIMESTAMP '1998-12-31') FROM li
  UNION ALL
  SELECT 6, 'l_quantity, l_returnflag', 'all not null', COUNT(*),
         COUNT(*) FILTER (WHERE l_quantity IS NULL OR l_returnflag IS NULL) FROM li
  UNION ALL """ + _dup_sql(7, "l_orderkey, l_linenumber", "unique combination",
                          ["l_orderkey", "l_linenumber"], null_key_passes=False) + """
  UNION ALL
  SELECT 8, 'l_returnflag, l_linestatus', 'all in allowed sets', COUNT(*),
         COUNT(*) FILTER (WHERE NOT COALESCE(l_returnflag IN ('A', 'N', 'R'), FALSE)
                             OR NOT COALESCE(l_linestatus IN ('O'), FALSE)) FROM li
  UNION ALL
  SELECT 9, 'l_returnflag, l_linestatus', 'all match patterns', COUNT(*),
         COUNT(*) FILTER (WHERE NOT COALESCE(regexp_matches(l_returnflag, '^(?:[AR])'), FALSE)
                             OR NOT COALESCE(regexp_matches(l_linestatus, '^(?:F)'), FALSE)) FROM li
  UNION ALL
  SELECT 10, 'l_quantity, l_discount', 'all in ranges', COUNT(*),
         COUNT(*) FILTER (WHERE NOT COALESCE(l_quantity BETWEEN 1 AND 30, FALSE)
                             OR NOT COALESCE(l_discount BETWEEN 0.0 AND 0.05, FALSE)) FROM li
""")


@register("rule_scorecard_lineitem", FLAGSHIP_SQL)
def rule_scorecard_lineitem(spark, sf):
    return scorecard(lineitem_nulls(spark, sf), FLAGSHIP_RULES)


# ------------------------------------------------ R2 / R8 null policy ----
@register("uniqueness_customer", """
WITH c AS (
  SELECT c_custkey,
         CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
         CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey,
         c_mktsegment FROM customer),
r AS (""" + _dup_sql(0, "c_acctbal", "unique", ["c_acctbal"], src="c") + """
  UNION ALL """ + _dup_sql(1, "c_nationkey", "unique", ["c_nationkey"], src="c") + """
  UNION ALL """ + _dup_sql(2, "c_nationkey, c_mktsegment", "unique combination",
                          ["c_nationkey", "c_mktsegment"], src="c", null_key_passes=False) + """
  UNION ALL """ + _dup_sql(3, "c_custkey", "unique", ["c_custkey"], src="c") + """)
SELECT seq, col AS "column", rule, CAST(total AS BIGINT) AS total, CAST(total - failed AS BIGINT) AS passed,
       CAST(failed AS BIGINT) AS failed,
       COALESCE(CAST(total - failed AS DOUBLE) / NULLIF(total, 0) * 100, 0.0) AS success_rate
FROM r""")
def uniqueness_customer(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    c = c.select("c_custkey",
                 F.when(k % 10 == 0, None).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
                 F.when(k % 9 == 0, None).otherwise(F.col("c_nationkey")).alias("c_nationkey"),
                 "c_mktsegment")
    rules = [R.expect_column_values_to_be_unique("c_acctbal"),
             R.expect_column_values_to_be_unique("c_nationkey"),
             R.expect_columns_values_to_be_unique(["c_nationkey", "c_mktsegment"]),
             R.expect_column_values_to_be_unique("c_custkey")]
    return R.evaluate(c, rules).drop("details")


# ------------------------------------------------- R6: junk date text ----
@register("date_range_text_orders", """
WITH o AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'bad'
                       WHEN o_orderkey % 7 = 0 THEN NULL
                       ELSE CAST(o_orderdate AS VARCHAR) END AS d FROM orders),
r AS (SELECT 0 AS seq, 'd' AS col, 'in date range' AS rule, COUNT(TRY_CAST(d AS TIMESTAMP)) AS total,
             COUNT(*) FILTER (WHERE TRY_CAST(d AS TIMESTAMP) < TIMESTAMP '1996-01-01'
                                 OR TRY_CAST(d AS TIMESTAMP) > TIMESTAMP '1998-12-31 23:59:59') AS failed FROM o)
SELECT seq, col AS "column", rule, CAST(total AS BIGINT) AS total, CAST(total - failed AS BIGINT) AS passed,
       CAST(failed AS BIGINT) AS failed,
       COALESCE(CAST(total - failed AS DOUBLE) / NULLIF(total, 0) * 100, 0.0) AS success_rate
FROM r""")
def date_range_text_orders(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    d = F.when(k % 5 == 0, "bad").when(k % 7 == 0, None).otherwise(F.col("o_orderdate").cast("string"))
    rules = [R.expect_column_values_to_be_in_date_range("d", "1996-01-01", "1998-12-31 23:59:59")]
    return R.evaluate(o.select(d.alias("d")), rules).drop("details")


# ------------------------------------- R6a: aware vs naive timestamps ----
@register("date_range_timezones_events", """
WITH r AS (
  SELECT 0 AS seq, 'ts' AS col, COUNT(ts) AS total,
         COUNT(*) FILTER (WHERE ts < TIMESTAMP '2024-01-01 06:00:00' OR ts > TIMESTAMP '2024-01-02 12:00:00') AS failed
  FROM events
  UNION ALL
  SELECT 1, 'ts_utc', COUNT(ts),
         COUNT(*) FILTER (WHERE ts < TIMESTAMP '2024-01-01 06:00:00' OR ts > TIMESTAMP '2024-01-02 12:00:00')
  FROM events
  UNION ALL
  SELECT 2, 'ts', COUNT(ts),
         COUNT(*) FILTER (WHERE ts < TIMESTAMP '2024-01-01 06:00:00' OR ts > TIMESTAMP '2024-01-02 12:00:00')
  FROM events)
SELECT seq, col AS "column", 'in date range' AS rule, CAST(total AS BIGINT) AS total,
       CAST(total - failed AS BIGINT) AS passed, CAST(failed AS BIGINT) AS failed
FROM r""")
def date_range_timezones_events(spark, sf):
    ev = table(spark, sf, "events")
    # the same instants as an aware (UTC) timestamp, built without the session zone
    micros = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col("ts"))
    df = ev.select("ts", F.timestamp_micros(micros).alias("ts_utc"))
    rules = [
        # naive data, naive bounds
        R.expect_column_values_to_be_in_date_range("ts", "2024-01-01 06:00:00", "2024-01-02 12:00:00"),
        # aware data, naive bounds -> bounds read as UTC
        R.expect_column_values_to_be_in_date_range("ts_utc", "2024-01-01 06:00:00", "2024-01-02 12:00:00"),
        # naive data, aware bounds -> zone dropped, wall time kept
        R.expect_column_values_to_be_in_date_range("ts", "2024-01-01T06:00:00+05:00",
                                                   "2024-01-02T12:00:00+05:00"),
    ]
    return R.evaluate(df, rules).select("seq", "column", "rule", "total", "passed", "failed")


# ------------------------------------------------- R3: a large set -------
@register("allowed_set_large_lineitem", """
WITH r AS (
  SELECT 0 AS seq, 'l_partkey' AS col, 'in allowed set' AS rule, COUNT(*) AS total,
         COUNT(*) FILTER (WHERE NOT COALESCE(l_partkey % 3 <> 0 AND l_partkey < 30000, FALSE)) AS failed
  FROM lineitem)
SELECT seq, col AS "column", rule, CAST(total AS BIGINT) AS total, CAST(total - failed AS BIGINT) AS passed,
       CAST(failed AS BIGINT) AS failed,
       COALESCE(CAST(total - failed AS DOUBLE) / NULLIF(total, 0) * 100, 0.0) AS success_rate
FROM r""")
def allowed_set_large_lineitem(spark, sf):
    # 20,000 allowed keys
    allowed = [k for k in range(30000) if k % 3 != 0]
    li = table(spark, sf, "lineitem").select("l_partkey")
    return R.evaluate(li, [R.expect_column_values_to_be_in_set("l_partkey", allowed)]).drop("details")


# ---------------------------------------------- R12: pattern presets -----
def _preset_sql(src: str, col_expr: str, col_label: str) -> str:
    from ...functions.constants import PATTERN_PRESETS
    parts = []
    for i, (name, pat) in enumerate(PATTERN_PRESETS.items()):
        esc = pat.replace("'", "''")
        parts.append(f"""  SELECT {i} AS seq, '{col_label}' AS col, '{name}' AS preset, COUNT(*) AS total,
         COUNT(*) FILTER (WHERE NOT COALESCE(regexp_matches({col_expr}, '^(?:{esc})'), FALSE)) AS failed
  FROM {src}""")
    return "WITH r AS (\n" + "\n  UNION ALL\n".join(parts) + """)
SELECT seq, col AS "column", preset, CAST(total AS BIGINT) AS total, CAST(total - failed AS BIGINT) AS passed,
       CAST(failed AS BIGINT) AS failed FROM r"""


def _preset_query(df, column):
    from ...functions.constants import PATTERN_PRESETS
    names = list(PATTERN_PRESETS)
    rules = [R.expect_column_values_to_match_regex(column, PATTERN_PRESETS[n]) for n in names]
    res = R.evaluate(df, rules)
    preset = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("seq") + 1)
    return res.select("seq", "column", preset.alias("preset"), "total", "passed", "failed")


@register("pattern_presets_pages", _preset_sql("pages", "url", "url"))
def pattern_presets_pages(spark, sf):
    return _preset_query(table(spark, sf, "pages").select("url"), "url")


@register("pattern_presets_orders_dates", _preset_sql(
    "(SELECT strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)", "d", "d"))
def pattern_presets_orders_dates(spark, sf):
    o = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return _preset_query(o, "d")


@register("pattern_presets_customer", _preset_sql(
    "(SELECT CASE WHEN c_custkey % 10 = 0 THEN c_name || '@bad' "
    "ELSE lower(replace(c_name, '#', '.')) || '@example.com' END AS e FROM customer)", "e", "e"))
def pattern_presets_customer(spark, sf):
    c = table(spark, sf, "customer")
    e = F.when(F.col("c_custkey") % 10 == 0, F.concat("c_name", F.lit("@bad"))) \
        .otherwise(F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.com")))
    return _preset_query(c.select(e.alias("e")), "e")


# -------------------------------------------- R13: match-rate preview -----
@register("pattern_preview_pages", """
SELECT 'url' AS "column", CAST(COUNT(url) FILTER (WHERE regexp_matches(url, '^(?:https://)')) AS BIGINT) AS matching,
       CAST(COUNT(url) AS BIGINT) AS total_non_null,
       COALESCE(CAST(COUNT(url) FILTER (WHERE regexp_matches(url, '^(?:https://)')) AS DOUBLE)
                / NULLIF(COUNT(url), 0) * 100, 0.0) AS match_rate
FROM (SELECT CASE WHEN page_id % 4 = 0 THEN NULL ELSE url END AS url FROM pages)""")
def pattern_preview_pages(spark, sf):
    from ...operators.rules import pattern_preview
    p = table(spark, sf, "pages")
    p = p.select(F.when(F.col("page_id") % 4 == 0, None).otherwise(F.col("url")).alias("url"), "page_id")
    return pattern_preview(p, "url", "https://")[0]


@register("pattern_preview_samples_pages", """
SELECT url AS value, COALESCE(regexp_matches(url, '^(?:https://)'), FALSE) AS matches
FROM pages WHERE url IS NOT NULL ORDER BY page_id LIMIT 5""")
def pattern_preview_samples_pages(spark, sf):
    from ...operators.rules import pattern_preview
    p = table(spark, sf, "pages").select("url", "page_id")
    return pattern_preview(p, "url", "https://", order_by="page_id")[1]


# --------------------------------------------- R14 / R15: rule batches ----
RULES_JSON = """{
  "expect_column_values_to_not_be_null": [{"column": "l_quantity"}],
  "expect_column_values_to_be_in_range": [{"column": "l_quantity", "min_val": 5, "max_val": 45}],
  "expect_something_unknown": [{"column": "l_quantity"}],
  "expect_columns_values_to_be_unique": [{"columns": ["l_orderkey", "l_linenumber"]}]
}"""


@register("rules_from_json_lineitem", _result_sql("""
  SELECT 0 AS seq, 'l_quantity' AS col, 'not null' AS rule, COUNT(*) AS total,
         COUNT(*) FILTER (WHERE l_quantity IS NULL) AS failed FROM li
  UNION ALL
  SELECT 1, 'l_quantity', 'in range 5-45', COUNT(*),
         COUNT(*) FILTER (WHERE NOT COALESCE(l_quantity BETWEEN 5 AND 45, FALSE)) FROM li
  UNION ALL """ + _dup_sql(2, "l_orderkey, l_linenumber", "unique combination",
                          ["l_orderkey", "l_linenumber"], null_key_passes=False)))
def rules_from_json_lineitem(spark, sf):
    return scorecard(lineitem_nulls(spark, sf), R.rules_from_json(RULES_JSON))


@register("rules_from_config_orders", """
WITH o AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
         o_orderstatus,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
         CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders),
r AS (
  SELECT 0 AS seq, 'o_totalprice' AS col, 'not null' AS rule, COUNT(*) AS total,
         COUNT(*) FILTER (WHERE o_totalprice IS NULL) AS failed FROM o
  UNION ALL """ + _dup_sql(1, "o_custkey", "unique", ["o_custkey"], src="o") + """
  UNION ALL
  SELECT 2, 'o_totalprice', 'in range 50000-300000', COUNT(*),
         COUNT(*) FILTER (WHERE NOT COALESCE(o_totalprice BETWEEN 50000 AND 300000, FALSE)) FROM o
  UNION ALL
  SELECT 3, 'o_orderstatus', 'in allowed set', COUNT(*),
         COUNT(*) FILTER (WHERE NOT COALESCE(o_orderstatus IN ('F', 'O'), FALSE)) FROM o
  UNION ALL
  SELECT 4, 'o_orderpriority', 'matches regex', COUNT(*),
         COUNT(*) FILTER (WHERE NOT COALESCE(regexp_matches(o_orderpriority, '^(?:[1-3]-)'), FALSE)) FROM o)
SELECT seq, col AS "column", rule, CAST(total AS BIGINT) AS total, CAST(total - failed AS BIGINT) AS passed,
       CAST(failed AS BIGINT) AS failed,
       COALESCE(CAST(total - failed AS DOUBLE) / NULLIF(total, 0) * 100, 0.0) AS success_rate
FROM r""")
def rules_from_config_orders(spark, sf):
    from .q_rowflags import ORDERS_CONFIG, orders_nulls
    o = orders_nulls(spark, sf)
    return R.evaluate(o, R.rules_from_config(ORDERS_CONFIG, o.columns)).drop("details")


# ------------------------------------------------ R17: advertised extras ---
@register("extra_checks_lineitem", _result_sql("""
  SELECT 0 AS seq, 'q_text' AS col, 'is numeric' AS rule, COUNT(*) AS total,
         COUNT(*) FILTER (WHERE NOT COALESCE(regexp_matches(q_text, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$'), FALSE)) AS failed FROM t
  UNION ALL
  SELECT 1, 'l_returnflag', 'is numeric', COUNT(*),
         COUNT(*) FILTER (WHERE NOT COALESCE(regexp_matches(l_returnflag, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$'), FALSE)) FROM t
  UNION ALL
  SELECT 2, 'flag_text', 'is boolean', COUNT(*),
         COUNT(*) FILTER (WHERE NOT COALESCE(lower(flag_text) IN ('true', 'false'), FALSE)) FROM t
  UNION ALL
  SELECT 3, 'ship_text', 'is datetime', COUNT(*),
         COUNT(*) FILTER (WHERE TRY_CAST(ship_text AS TIMESTAMP) IS NULL) FROM t
  UNION ALL
  SELECT 4, 'l_returnflag', 'length 1-1', COUNT(*),
         COUNT(*) FILTER (WHERE NOT COALESCE(length(l_returnflag) BETWEEN 1 AND 1, FALSE)) FROM t
  UNION ALL
  SELECT 5, 'l_returnflag', 'contains', COUNT(*),
         COUNT(*) FILTER (WHERE NOT COALESCE(contains(l_returnflag, 'A'), FALSE)) FROM t
""", ctes=LI_NULLS_SQL + """,
t AS (SELECT CAST(l_quantity AS VARCHAR) AS q_text, l_returnflag,
             CASE WHEN l_linestatus = 'O' THEN 'True' WHEN l_orderkey % 3 = 0 THEN 'false' ELSE 'maybe' END AS flag_text,
             CASE WHEN l_orderkey % 5 = 0 THEN 'soon' ELSE CAST(l_shipdate AS VARCHAR) END AS ship_text
      FROM li)"""))
def extra_checks_lineitem(spark, sf):
    li = lineitem_nulls(spark, sf)
    t = li.select(
        F.col("l_quantity").cast("string").alias("q_text"), "l_returnflag",
        F.when(F.col("l_linestatus") == "O", "True").when(F.col("l_orderkey") % 3 == 0, "false")
        .otherwise("maybe").alias("flag_text"),
        F.when(F.col("l_orderkey") % 5 == 0, "soon").otherwise(F.col("l_shipdate").cast("string"))
        .alias("ship_text"))
    rules = [R.expect_column_values_to_be_numeric("q_text"),
             R.expect_column_values_to_be_numeric("l_returnflag"),
             R.expect_column_values_to_be_boolean("flag_text"),
             R.expect_column_values_to_be_datetime("ship_text"),
             R.expect_column_value_lengths_to_be_between("l_returnflag", 1, 1),
             R.expect_column_values_to_contain("l_returnflag", "A")]
    return scorecard(t, rules)
