"""Registered streaming queries: the rule compiler over a file stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ...operators import rules as R
from ...sources.csv import scratch_dir
from ...streaming import monitor as M
from .q_rules import FLAGSHIP_RULES, LI_NULLS_SQL, _result_sql

QUERIES: dict = {}
ORACLE: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def lineitem_stream(spark, sf):
    path = f"{sf.rstrip('/')}/lineitem.parquet"
    schema = spark.read.parquet(path).schema
    # a file stream watches a folder: a glob selects the table's file in it
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1) \
        .parquet(f"{sf.rstrip('/')}/lineitem.parque[t]")
    k = F.col("l_orderkey")
    return s.select(
        "l_orderkey", "l_linenumber",
        F.when(k % 7 == 0, None).otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(k % 11 == 0, None).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus", "l_shipdate", "l_discount")


PRED_RULES = [r for r in FLAGSHIP_RULES if not r.is_group]


@register("stream_running_scorecard_lineitem", """
WITH """ + LI_NULLS_SQL.strip() + """,
r AS (
  SELECT 0 AS seq, 'l_quantity' AS col, 'not null' AS rule, COUNT(*) AS total,
         COUNT(*) FILTER (WHERE l_quantity IS NULL) AS failed FROM li
  UNION ALL
  SELECT 1, 'l_returnflag', 'in allowed set', COUNT(*),
         COUNT(*) FILTER (WHERE NOT COALESCE(l_returnflag IN ('A', 'N'), FALSE)) FROM li
  UNION ALL
  SELECT 2, 'l_linestatus', 'matches regex', COUNT(*),
         COUNT(*) FILTER (WHERE NOT COALESCE(regexp_matches(l_linestatus, '^(?:[OF]$)'), FALSE)) FROM li
  UNION ALL
  SELECT 3, 'l_quantity', 'in range 5-45', COUNT(*),
         COUNT(*) FILTER (WHERE NOT COALESCE(l_quantity BETWEEN 5 AND 45, FALSE)) FROM li
  UNION ALL
  SELECT 4, 'l_shipdate', 'in date range', COUNT(l_shipdate),
         COUNT(*) FILTER (WHERE l_shipdate < TIMESTAMP '1996-01-01' OR l_shipdate > TIMESTAMP '1998-12-31') FROM li
  UNION ALL
  SELECT 5, 'l_quantity, l_returnflag', 'all not null', COUNT(*),
         COUNT(*) FILTER (WHERE l_quantity IS NULL OR l_returnflag IS NULL) FROM li
  UNION ALL
  SELECT 6, 'l_returnflag, l_linestatus', 'all in allowed sets', COUNT(*),
         COUNT(*) FILTER (WHERE NOT COALESCE(l_returnflag IN ('A', 'N', 'R'), FALSE)
                             OR NOT COALESCE(l_linestatus IN ('O'), FALSE)) FROM li
  UNION ALL
  SELECT 7, 'l_returnflag, l_linestatus', 'all match patterns', COUNT(*),
         COUNT(*) FILTER (WHERE NOT COALESCE(regexp_matches(l_returnflag, '^(?:[AR])'), FALSE)
                             OR NOT COALESCE(regexp_matches(l_linestatus, '^(?:F)'), FALSE)) FROM li
  UNION ALL
  SELECT 8, 'l_quantity, l_discount', 'all in ranges', COUNT(*),
         COUNT(*) FILTER (WHERE NOT COALESCE(l_quantity BETWEEN 1 AND 30, FALSE)
                             OR NOT COALESCE(l_discount BETWEEN 0.0 AND 0.05, FALSE)) FROM li)
SELECT seq, col AS "column", rule, CAST(total AS BIGINT) AS total, CAST(total - failed AS BIGINT) AS passed,
       CAST(failed AS BIGINT) AS failed,
       COALESCE(CAST(total - failed AS DOUBLE) / NULLIF(total, 0) * 100, 0.0) AS success_rate
FROM r""")
def stream_running_scorecard_lineitem(spark, sf):
    sc = M.running_scorecard(lineitem_stream(spark, sf), PRED_RULES)
    name = f"dq_running_{uuid.uuid4().hex[:8]}"
    return M.run_to_table(sc, name, scratch_dir(spark, "stream-ckpt"))


@register("stream_monitor_lineitem", _result_sql("""
  SELECT 0 AS seq, 'l_quantity' AS col, 'not null' AS rule, COUNT(*) AS total,
         COUNT(*) FILTER (WHERE l_quantity IS NULL) AS failed FROM li
  UNION ALL
  SELECT 1, 'l_orderkey, l_linenumber', 'unique combination', (SELECT COUNT(*) FROM li),
         COALESCE((SELECT SUM(n) FROM (SELECT COUNT(*) AS n FROM li GROUP BY l_orderkey, l_linenumber
                                       HAVING COUNT(*) > 1) d), 0)
""").replace("SELECT seq, col AS \"column\", rule,", "SELECT seq, col AS \"column\", rule, CAST(0 AS BIGINT) AS batch_id,"))
def stream_monitor_lineitem(spark, sf):
    rules = [R.expect_column_values_to_not_be_null("l_quantity"),
             R.expect_columns_values_to_be_unique(["l_orderkey", "l_linenumber"])]
    res_path, hist_path = scratch_dir(spark, "mon-res"), scratch_dir(spark, "mon-hist")
    q = M.monitor(lineitem_stream(spark, sf), rules, res_path, hist_path,
                  scratch_dir(spark, "mon-ckpt"), dataset_name="lineitem", available_now=True)
    q.awaitTermination()
    from ...functions.bands import health_status
    res = spark.read.parquet(res_path)
    return res.select("seq", "column", "rule", F.col("batch_id").cast("long").alias("batch_id"),
                      "total", "passed", "failed", "success_rate",
                      health_status(F.col("success_rate")).alias("health"))
