"""Registered snapshot / history / version queries.

Set-up: ``orders`` split by order year into snapshots (``seq`` = year); the
years from 1999 on lack ``o_orderpriority``; NULL shares change by year.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import history as HI
from ...operators.rules import evaluate, expect_column_values_to_be_in_set, \
    expect_column_values_to_be_unique, expect_column_values_to_not_be_null
from ...sources.tables import table
from . import sql_twins as TW

QUERIES: dict = {}
ORACLE: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


ABSENT = {"o_orderpriority": [1999, 2000, 2001, 2002, 2003, 2004, 2005]}


def orders_years(spark, sf):
    o = table(spark, sf, "orders")
    yr = F.year("o_orderdate")
    k = F.col("o_orderkey")
    return o.select(
        yr.alias("yr"), "o_orderkey",
        F.when(k % (yr - 1990) == 0, None).otherwise(F.col("o_custkey")).alias("o_custkey"),
        "o_orderstatus",
        F.when(k % 7 < (yr - 1995) % 4, None).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderpriority")


def snapshots(spark, sf):
    df = orders_years(spark, sf)
    recs, schema = HI.snapshot_records_from_column(df, F.col("yr"), prefix="orders_",
                                                   absent=ABSENT)
    return df, recs, schema


YEARS_SQL = """
s AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, o_orderkey,
         CASE WHEN o_orderkey % (year(o_orderdate) - 1990) = 0 THEN NULL ELSE o_custkey END AS o_custkey,
         o_orderstatus,
         CASE WHEN o_orderkey % 7 < (year(o_orderdate) - 1995) % 4 THEN NULL ELSE o_totalprice END AS o_totalprice,
         o_orderpriority
  FROM orders),
pc AS (
""" + "\n  UNION ALL\n".join(
    f"""  SELECT yr AS seq, '{c}' AS col, COUNT(*) AS total, COUNT({c}) AS nn, COUNT(DISTINCT {c}) AS d
  FROM s {"WHERE yr < 1999" if c == "o_orderpriority" else ""} GROUP BY yr"""
    for c in ["yr", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]) + """),
snap AS (
  SELECT seq, 'orders_' || CAST(seq AS VARCHAR) AS snapshot, CAST(max(total) AS BIGINT) AS row_count,
         CAST(COUNT(*) AS BIGINT) AS column_count,
         round_even(avg(round_even(CAST(nn AS DOUBLE) / total * 100, 1)), 1) AS completeness,
         round_even(avg(round_even(CAST(d AS DOUBLE) / total * 100, 1)), 1) AS uniqueness,
         CAST(SUM(total - nn) AS BIGINT) AS null_cells
  FROM pc GROUP BY seq)"""


@register("snapshot_table_orders", "WITH " + YEARS_SQL + """
SELECT seq, snapshot, row_count, column_count, completeness, uniqueness,
       round_even((completeness + uniqueness) / 2, 1) AS overall_score, null_cells,
       round_even(CAST(row_count * column_count - null_cells AS DOUBLE) / (row_count * column_count) * 100, 9)
         AS cell_completeness
FROM snap""")
def snapshot_table_orders(spark, sf):
    _, recs, schema = snapshots(spark, sf)
    t = HI.snapshot_table(recs, schema)
    return t.withColumn("cell_completeness", F.bround("cell_completeness", 9))


@register("snapshot_trend_orders", "WITH " + YEARS_SQL + """
SELECT count(*) AS snapshots, round_even(avg(round_even((completeness + uniqueness) / 2, 1)), 9) AS avg_score,
       CASE WHEN max_by(round_even((completeness + uniqueness) / 2, 1), seq)
                 > min_by(round_even((completeness + uniqueness) / 2, 1), seq) THEN 'up' ELSE 'down' END AS score_trend,
       max_by(row_count, seq) AS last_rows, max_by(row_count, seq) - min_by(row_count, seq) AS row_change,
       max_by(column_count, seq) AS last_columns,
       max_by(column_count, seq) - min_by(column_count, seq) AS column_change
FROM snap""")
def snapshot_trend_orders(spark, sf):
    _, recs, schema = snapshots(spark, sf)
    fl = HI.first_last(HI.snapshot_table(recs, schema))
    return fl.withColumn("avg_score", F.bround("avg_score", 9))


@register("snapshot_pair_diff_orders", "WITH " + YEARS_SQL + """
SELECT a.snapshot AS snapshot_a, b.snapshot AS snapshot_b,
       round_even((b.completeness + b.uniqueness) / 2, 1) - round_even((a.completeness + a.uniqueness) / 2, 1) AS score_change,
       b.completeness - a.completeness AS completeness_change,
       b.uniqueness - a.uniqueness AS uniqueness_change, b.row_count - a.row_count AS row_change
FROM snap a, snap b WHERE a.snapshot = 'orders_1996' AND b.snapshot = 'orders_2000'""")
def snapshot_pair_diff_orders(spark, sf):
    _, recs, schema = snapshots(spark, sf)
    return HI.pair_diff(HI.snapshot_table(recs, schema), "orders_1996", "orders_2000")


@register("schema_diff_orders", """
WITH a AS (SELECT column_name AS c FROM (DESCRIBE SELECT year(o_orderdate) AS yr, o_orderkey, o_custkey,
                                          o_orderstatus, o_totalprice, o_orderpriority FROM orders)),
b AS (SELECT c FROM a WHERE c <> 'o_orderpriority')
SELECT COALESCE(a.c, b.c) AS "column",
       CASE WHEN a.c IS NULL THEN 'added' WHEN b.c IS NULL THEN 'removed' ELSE 'common' END AS status
FROM a FULL OUTER JOIN b ON a.c = b.c""")
def schema_diff_orders(spark, sf):
    _, _, schema = snapshots(spark, sf)
    return HI.schema_diff(schema, 1996, 2000)


@register("type_pivot_orders", TW.TYPE_PIVOT_ORDERS)
def type_pivot_orders(spark, sf):
    _, _, schema = snapshots(spark, sf)
    return HI.type_pivot(schema, ["Integer", "Decimal", "Text/String"])


@register("snapshot_types_orders", TW.SNAPSHOT_TYPES_ORDERS)
def snapshot_types_orders(spark, sf):
    _, _, schema = snapshots(spark, sf)
    return HI.snapshot_type_distribution(schema)


@register("schema_fingerprint_orders", TW.SCHEMA_FINGERPRINT_ORDERS)
def schema_fingerprint_orders(spark, sf):
    _, _, schema = snapshots(spark, sf)
    return HI.schema_fingerprint(schema)


# ------------------------------------------------------- tracking ---------
RULES = [expect_column_values_to_not_be_null("o_custkey"),
         expect_column_values_to_be_unique("o_custkey"),
         expect_column_values_to_be_in_set("o_orderstatus", ["F", "O"]),
         expect_column_values_to_not_be_null("o_totalprice")]


def history(spark, sf, with_fields=True):
    df, recs, schema = snapshots(spark, sf)
    res = (evaluate(df, RULES, by=["yr"]).withColumnRenamed("seq", "rule_seq")
           .withColumnRenamed("yr", "seq"))
    snaps = HI.snapshot_table(recs, schema)
    fps = HI.schema_fingerprint(schema)
    # entry time: the end of the snapshot's year (deterministic, data-derived)
    ts = schema.select("seq").distinct().select(
        "seq", F.concat(F.col("seq").cast("string"), F.lit("-12-31 00:00:00")).alias("timestamp"))
    fj = HI.field_statistics_json(HI.field_statistics(recs, schema)) if with_fields else None
    return HI.tracking_entries(res, snaps, fps, "orders", timestamps=ts, field_json=fj)


VAL_SQL = """,
res AS (
  SELECT yr AS seq, 'a' AS r, CAST(COUNT(o_custkey) AS DOUBLE) / COUNT(*) * 100 AS rate FROM s GROUP BY yr
  UNION ALL
  SELECT yr, 'b', CAST(SUM(n) - COALESCE(SUM(n) FILTER (WHERE n > 1 AND o_custkey IS NOT NULL), 0) AS DOUBLE)
              / SUM(n) * 100
  FROM (SELECT yr, o_custkey, COUNT(*) AS n FROM s GROUP BY yr, o_custkey) GROUP BY yr
  UNION ALL
  SELECT yr, 'c', CAST(COUNT(*) FILTER (WHERE o_orderstatus IN ('F', 'O')) AS DOUBLE) / COUNT(*) * 100
  FROM s GROUP BY yr
  UNION ALL
  SELECT yr, 'd', CAST(COUNT(o_totalprice) AS DOUBLE) / COUNT(*) * 100 FROM s GROUP BY yr),
v AS (SELECT seq, COUNT(*) AS total_validations, COUNT(*) FILTER (WHERE rate >= 90) AS passed_validations,
             avg(rate) AS score FROM res GROUP BY seq),
h AS (
  SELECT snap.seq, CAST(snap.seq AS VARCHAR) || '-12-31 00:00:00' AS timestamp, 'orders' AS dataset_name,
         'v' || CAST(snap.seq AS VARCHAR) AS dataset_version,
         round_even(COALESCE(v.score, 100.0), 1) AS overall_quality_score,
         CAST(v.total_validations AS BIGINT) AS total_validations,
         CAST(v.passed_validations AS BIGINT) AS passed_validations,
         snap.row_count, snap.column_count,
         round_even(CAST(row_count * column_count - null_cells AS DOUBLE) / (row_count * column_count) * 100, 1)
           AS data_completeness
  FROM snap JOIN v ON snap.seq = v.seq)"""


@register("tracking_entries_orders", "WITH " + YEARS_SQL + VAL_SQL + """
SELECT * FROM h""")
def tracking_entries_orders(spark, sf):
    return history(spark, sf, with_fields=False).drop(
        "schema_fingerprint", "snapshot_id", "has_detailed_stats", "field_statistics")


@register("history_summary_orders", "WITH " + YEARS_SQL + VAL_SQL + """
SELECT CAST(COUNT(*) AS BIGINT) AS total_runs, round_even(avg(overall_quality_score), 9) AS avg_quality,
       max(overall_quality_score) AS best_quality, min(overall_quality_score) AS worst_quality FROM h""")
def history_summary_orders(spark, sf):
    s = HI.history_summary(history(spark, sf, with_fields=False))
    return s.withColumn("avg_quality", F.bround("avg_quality", 9))


@register("history_recent_orders", "WITH " + YEARS_SQL + VAL_SQL + """
SELECT seq, dataset_version, overall_quality_score FROM h ORDER BY seq DESC LIMIT 3""")
def history_recent_orders(spark, sf):
    # The last n entries (n = 3 to make the cut visible on 7 years)
    h = history(spark, sf, with_fields=False)
    return HI.keep_last(h, 3).select("seq", "dataset_version", "overall_quality_score")


@register("history_retention_orders", "WITH " + YEARS_SQL + VAL_SQL + """
SELECT seq, dataset_version FROM h ORDER BY seq DESC LIMIT 4""")
def history_retention_orders(spark, sf):
    # Seven yearly entries, the last four stay
    h = history(spark, sf, with_fields=False)
    early, late = h.filter("seq < 1996"), h.filter("seq >= 1996")
    return HI.append_entry(early, late, keep=4).select("seq", "dataset_version")


@register("latest_per_version_orders", "WITH " + YEARS_SQL + VAL_SQL + """,
hv AS (SELECT *, CASE WHEN seq < 1998 THEN 'early' ELSE 'late' END AS grp FROM h)
SELECT grp, max_by(seq, seq) AS seq, max_by(overall_quality_score, seq) AS overall_quality_score
FROM hv GROUP BY grp""")
def latest_per_version_orders(spark, sf):
    h = history(spark, sf, with_fields=False).withColumn(
        "grp", F.when(F.col("seq") < 1998, "early").otherwise("late"))
    return HI.latest_per_version(h, version="grp").select("grp", "seq", "overall_quality_score")


@register("version_diff_orders", "WITH " + YEARS_SQL + VAL_SQL + """
SELECT 'v1996' AS version_a, 'v2000' AS version_b, TRUE AS available,
       b.overall_quality_score - a.overall_quality_score AS quality_diff,
       b.row_count - a.row_count AS row_diff, b.column_count - a.column_count AS column_diff,
       b.data_completeness - a.data_completeness AS completeness_diff, TRUE AS schema_changed
FROM h a, h b WHERE a.seq = 1996 AND b.seq = 2000""")
def version_diff_orders(spark, sf):
    return HI.version_diff(history(spark, sf, with_fields=False), "v1996", "v2000")


@register("version_diff_missing_orders", """
SELECT 'v1996' AS version_a, 'v1980' AS version_b, FALSE AS available,
       CAST(NULL AS DOUBLE) AS quality_diff, CAST(NULL AS BIGINT) AS row_diff,
       CAST(NULL AS BIGINT) AS column_diff, CAST(NULL AS DOUBLE) AS completeness_diff,
       CAST(NULL AS BOOLEAN) AS schema_changed
FROM (SELECT COUNT(*) FROM orders)""")
def version_diff_missing_orders(spark, sf):
    return HI.version_diff(history(spark, sf, with_fields=False), "v1996", "v1980")


TEXTS = ("o_orderstatus", "o_orderpriority")


@register("field_statistics_orders", "WITH " + YEARS_SQL.split(",\npc AS")[0] + """,
f AS (
""" + "\n  UNION ALL\n".join(
    f"""  SELECT yr AS seq, '{c}' AS "column", CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS null_count,
         CAST(COUNT(DISTINCT {c}) AS BIGINT) AS unique_count,
         round_even(CAST(COUNT(*) - COUNT({c}) AS DOUBLE) / COUNT(*) * 100, 2) AS null_percentage,
         {"round_even(avg(" + c + "), 2)" if c not in TEXTS else "CAST(NULL AS DOUBLE)"} AS mean,
         {"round_even(median(" + c + "), 2)" if c not in TEXTS else "CAST(NULL AS DOUBLE)"} AS median,
         {"round_even(stddev_samp(" + c + "), 2)" if c not in TEXTS else "CAST(NULL AS DOUBLE)"} AS std
  FROM s {"WHERE yr < 1999" if c == "o_orderpriority" else ""} GROUP BY yr"""
    for c in ["yr", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]) + """)
SELECT * FROM f""")
def field_statistics_orders(spark, sf):
    _, recs, schema = snapshots(spark, sf)
    fs = HI.field_statistics(recs, schema)
    return fs.drop("data_type")


@register("field_diff_orders", TW.field_diff_orders(YEARS_SQL.split(",\npc AS")[0].strip()))
def field_diff_orders(spark, sf):
    return HI.field_diff(history(spark, sf), "v1996", "v2000")


@register("snapshot_sample_orders", """
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 1000""")
def snapshot_sample_orders(spark, sf):
    # The stored sample is the first 1000 rows by key (a sample is the feature)
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return HI.snapshot_sample(o, "o_orderkey")
