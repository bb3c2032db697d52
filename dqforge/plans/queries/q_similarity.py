"""Registered similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import similarity as SM
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


def part_pairs(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select(
        "p_partkey",
        F.when(k % 9 == 0, None).otherwise(F.col("p_brand")).alias("p_brand"),
        F.when(k % 13 == 0, None).otherwise(
            F.concat(F.lit("Brand#"), (F.col("p_size") % 12).cast("string"))).alias("p_brand2"),
        "p_type", "p_name")


PART_SQL = """
p AS (
  SELECT p_partkey,
         CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_brand END AS p_brand,
         CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE 'Brand#' || CAST(p_size % 12 AS VARCHAR) END AS p_brand2,
         p_type, p_name
  FROM part),
d AS (
  SELECT p_partkey AS row_index, COALESCE(p_brand, '') AS value1, COALESCE(p_brand2, '') AS value2,
         levenshtein(COALESCE(p_brand, ''), COALESCE(p_brand2, '')) AS distance
  FROM p),
r AS (
  SELECT *, CASE WHEN greatest(length(value1), length(value2)) = 0 THEN 1.0
                 ELSE CAST(greatest(length(value1), length(value2)) - distance AS DOUBLE)
                      / greatest(length(value1), length(value2)) END AS similarity_ratio
  FROM d)"""


@register("similarity_detail_part", f"""
WITH {PART_SQL}
SELECT row_index, value1, value2, CAST(distance AS INTEGER) AS distance, similarity_ratio,
       similarity_ratio >= 0.8 AS is_similar FROM r""")
def similarity_detail_part(spark, sf):
    return SM.comparisons(part_pairs(spark, sf), "p_brand", "p_brand2", 0.8, key="p_partkey")


def _summary_sql(ctes: str, label: str, t: float) -> str:
    return f"""
WITH {ctes},
a AS (SELECT avg(similarity_ratio) AS av FROM r)
SELECT '{label}' AS column_pair, CAST({t} AS DOUBLE) AS similarity_threshold,
       CAST(COUNT(*) AS BIGINT) AS total_comparisons,
       CAST(COUNT(*) FILTER (WHERE similarity_ratio >= {t}) AS BIGINT) AS similar_pairs,
       round_even(COALESCE(CAST(COUNT(*) FILTER (WHERE similarity_ratio >= {t}) AS DOUBLE) / NULLIF(COUNT(*), 0) * 100, 0.0), 9) AS similarity_percentage,
       CAST(COUNT(*) FILTER (WHERE similarity_ratio = 1.0) AS BIGINT) AS exact_matches,
       CAST(COUNT(*) FILTER (WHERE similarity_ratio >= {t} AND similarity_ratio < 1.0) AS BIGINT) AS within_threshold,
       CAST(COUNT(*) FILTER (WHERE similarity_ratio < {t}) AS BIGINT) AS outside_threshold,
       round_even(avg(similarity_ratio), 9) AS average_similarity,
       min(similarity_ratio) AS min_similarity, max(similarity_ratio) AS max_similarity,
       round_even(stddev_pop(similarity_ratio), 9) AS std_similarity,
       round_even(avg(distance), 9) AS average_distance,
       CAST(min(distance) AS INTEGER) AS min_distance, CAST(max(distance) AS INTEGER) AS max_distance,
       CAST(COUNT(*) FILTER (WHERE similarity_ratio >= 0.9) AS BIGINT) AS very_high,
       CAST(COUNT(*) FILTER (WHERE similarity_ratio >= 0.8 AND similarity_ratio < 0.9) AS BIGINT) AS high,
       CAST(COUNT(*) FILTER (WHERE similarity_ratio >= 0.6 AND similarity_ratio < 0.8) AS BIGINT) AS medium,
       CAST(COUNT(*) FILTER (WHERE similarity_ratio >= 0.4 AND similarity_ratio < 0.6) AS BIGINT) AS low,
       CAST(COUNT(*) FILTER (WHERE similarity_ratio < 0.4) AS BIGINT) AS very_low
FROM r"""


def _rounded(s):
    r9 = lambda c: F.bround(F.col(c), 9).alias(c)  # noqa: E731 - summation order differs
    return s.select(*[r9(c) if c in ("similarity_percentage", "average_similarity",
                                      "std_similarity", "average_distance") else F.col(c)
                      for c in s.columns])


@register("similarity_summary_part", _summary_sql(PART_SQL, "p_brand vs p_brand2", 0.8))
def similarity_summary_part(spark, sf):
    return _rounded(SM.summary(part_pairs(spark, sf), "p_brand", "p_brand2", 0.8))


ORDERS_PAIR_SQL = """
o AS (SELECT o_orderkey,
             CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
             o_orderpriority FROM orders),
d AS (SELECT o_orderkey AS row_index, COALESCE(o_orderstatus, '') AS value1,
             COALESCE(o_orderpriority, '') AS value2,
             levenshtein(COALESCE(o_orderstatus, ''), COALESCE(o_orderpriority, '')) AS distance FROM o),
r AS (
  SELECT *, CASE WHEN greatest(length(value1), length(value2)) = 0 THEN 1.0
                 ELSE CAST(greatest(length(value1), length(value2)) - distance AS DOUBLE)
                      / greatest(length(value1), length(value2)) END AS similarity_ratio
  FROM d)"""


def orders_pairs(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey",
                    F.when(F.col("o_orderkey") % 5 == 0, None).otherwise(F.col("o_orderstatus"))
                    .alias("o_orderstatus"), "o_orderpriority")


@register("similarity_summary_orders",
          _summary_sql(ORDERS_PAIR_SQL, "o_orderstatus vs o_orderpriority", 0.5))
def similarity_summary_orders(spark, sf):
    return _rounded(SM.summary(orders_pairs(spark, sf), "o_orderstatus", "o_orderpriority", 0.5))


@register("similarity_band_part", f"""
WITH {PART_SQL}
SELECT row_index, value1, value2, CAST(distance AS INTEGER) AS distance,
       round_even(similarity_ratio, 3) AS similarity_ratio, similarity_ratio >= 0.8 AS is_similar
FROM r WHERE similarity_ratio >= 0.3 AND similarity_ratio <= 0.9""")
def similarity_band_part(spark, sf):
    det = SM.comparisons(part_pairs(spark, sf), "p_brand", "p_brand2", 0.8, key="p_partkey", min_similarity=0.3)
    return SM.filter_band(det, 0.3, 0.9)


@register("similarity_rule_part", f"""
WITH {PART_SQL}
SELECT 0 AS seq, 'p_brand vs p_brand2' AS "column", 'levenshtein similarity (threshold: 0.8)' AS rule,
       CAST(COUNT(*) AS BIGINT) AS total,
       CAST(COUNT(*) FILTER (WHERE similarity_ratio >= 0.8) AS BIGINT) AS passed,
       CAST(COUNT(*) FILTER (WHERE similarity_ratio < 0.8) AS BIGINT) AS failed,
       round_even(CAST(COUNT(*) FILTER (WHERE similarity_ratio >= 0.8) AS DOUBLE) / COUNT(*) * 100, 9) AS success_rate
FROM r""")
def similarity_rule_part(spark, sf):
    res = SM.as_rule_result(SM.summary(part_pairs(spark, sf), "p_brand", "p_brand2", 0.8))
    return res.withColumn("success_rate", F.bround("success_rate", 9))


@register("similarity_table_part", f"""
WITH {PART_SQL}
SELECT 'p_brand vs p_brand2' AS Column_Pair, CAST(COUNT(*) AS BIGINT) AS Total_Comparisons,
       CAST(COUNT(*) FILTER (WHERE similarity_ratio >= 0.8) AS BIGINT) AS Similar_Pairs,
       round_even(CAST(COUNT(*) FILTER (WHERE similarity_ratio >= 0.8) AS DOUBLE) / COUNT(*) * 100, 1) AS Similarity_Percentage,
       round_even(avg(similarity_ratio), 3) AS Avg_Similarity,
       round_even(min(similarity_ratio), 3) AS Min_Similarity,
       round_even(max(similarity_ratio), 3) AS Max_Similarity,
       round_even(avg(distance), 1) AS Avg_Distance, CAST(0.8 AS DOUBLE) AS Threshold_Used
FROM r""")
def similarity_table_part(spark, sf):
    pp = part_pairs(spark, sf)
    summ = SM.summary(pp, "p_brand", "p_brand2", 0.8)
    res = SM.as_rule_result(summ)
    return SM.summary_table(res, summ)
