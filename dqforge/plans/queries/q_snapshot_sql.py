"""The numbers of the comprehensive snapshot (H15 -> H16), SQL-checked.

The Spark side builds the nested snapshot and flattens it; the SQL twin
recomputes every number from the table: the five form-config rules, the
dataset metrics, per-column scores (added in column order, as the snapshot
does) and the rule bands.
"""

from __future__ import annotations

from ...plans import snapshot as SN
from .q_scores import PERCOL_SQL, _orders_snapshot

QUERIES: dict = {}
ORACLE: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


RATES = """
rr AS (
  SELECT 0 AS seq, COUNT(*) AS n, COUNT(*) - COUNT(o_totalprice) AS failed FROM o
  UNION ALL
  SELECT 1, (SELECT COUNT(*) FROM o), COALESCE((SELECT SUM(c) FROM (SELECT COUNT(*) AS c FROM o
         WHERE o_custkey IS NOT NULL GROUP BY o_custkey HAVING COUNT(*) > 1)), 0)
  UNION ALL
  SELECT 2, COUNT(*), COUNT(*) FILTER (WHERE NOT COALESCE(o_totalprice BETWEEN 50000 AND 300000, FALSE)) FROM o
  UNION ALL
  SELECT 3, COUNT(*), COUNT(*) FILTER (WHERE NOT COALESCE(o_orderstatus IN ('F', 'O'), FALSE)) FROM o
  UNION ALL
  SELECT 4, COUNT(*), COUNT(*) FILTER (WHERE NOT COALESCE(regexp_matches(o_orderpriority, '^(?:[1-3]-)'), FALSE)) FROM o),
rate AS (SELECT seq, CAST(n - failed AS DOUBLE) / n * 100 AS r FROM rr),
h AS (SELECT list_reduce(list(r ORDER BY seq), lambda a, b: a + b) / COUNT(*) AS health,
             COUNT(*) AS rules,
             COUNT(*) FILTER (WHERE r >= 90) AS ex, COUNT(*) FILTER (WHERE r >= 75 AND r < 90) AS go,
             COUNT(*) FILTER (WHERE r >= 50 AND r < 75) AS fa, COUNT(*) FILTER (WHERE r < 50) AS po
      FROM rate),
q AS (SELECT list_reduce(list(round_even(completeness, 1) ORDER BY ordinal), lambda a, b: a + b) / COUNT(*) AS c,
             list_reduce(list(round_even(uniqueness, 1) ORDER BY ordinal), lambda a, b: a + b) / COUNT(*) AS u,
             list_reduce(list(round_even(k1, 1) ORDER BY ordinal), lambda a, b: a + b) / COUNT(*) AS k,
             COUNT(*) FILTER (WHERE completeness >= 80 AND (CAST(total_count - null_count AS DOUBLE) / total_count) >= 0.7
                              AND null_count < total_count * 0.5) AS crit,
             COUNT(*) AS ncols, MAX(total_count) AS nrows, SUM(null_count) AS nulls
      FROM pc)"""

SNAPSHOT_SQL = "WITH " + PERCOL_SQL + "," + RATES + """
SELECT 'orders' AS title, 'orders' AS dataset_name,
       CAST(nrows AS BIGINT) AS total_records, CAST(ncols AS INTEGER) AS total_columns,
       CAST(nrows * ncols AS BIGINT) AS total_cells, CAST(nulls AS BIGINT) AS null_cells,
       round_even(CAST(nrows * ncols - nulls AS DOUBLE) / (nrows * ncols) * 100, 1) AS data_completeness_rate,
       CAST(rules AS BIGINT) AS total_rules_executed, round_even(health, 1) AS overall_health_score,
       CASE WHEN health >= 90 THEN 'Excellent' WHEN health >= 75 THEN 'Good'
            WHEN health >= 50 THEN 'Fair' ELSE 'Poor' END AS overall_health_status,
       round_even(c, 1) AS overall_completeness, round_even(u, 1) AS overall_uniqueness,
       round_even(k, 1) AS overall_consistency, round_even((c + u + k) / 3, 1) AS combined_quality_score,
       CAST(crit AS INTEGER) AS critical_elements_count, CAST(ncols - crit AS INTEGER) AS other_fields_count,
       CAST(ex AS BIGINT) AS excellent_rules_count, CAST(go AS BIGINT) AS good_rules_count,
       CAST(fa AS BIGINT) AS fair_rules_count, CAST(po AS BIGINT) AS poor_rules_count,
       round_even(CAST(ex AS DOUBLE) / rules * 100, 1) AS excellent_rules_percentage,
       round_even(CAST(go AS DOUBLE) / rules * 100, 1) AS good_rules_percentage,
       round_even(CAST(fa AS DOUBLE) / rules * 100, 1) AS fair_rules_percentage,
       round_even(CAST(po AS DOUBLE) / rules * 100, 1) AS poor_rules_percentage
FROM h, q"""


@register("snapshot_numbers_orders", SNAPSHOT_SQL)
def snapshot_numbers_orders(spark, sf):
    flat = SN.flatten_snapshot(_orders_snapshot(spark, sf))
    return flat.drop("timestamp", "type_counts", "critical_avg_completeness",
                     "critical_avg_uniqueness", "critical_avg_consistency",
                     "other_avg_completeness", "other_avg_uniqueness", "other_avg_consistency")
