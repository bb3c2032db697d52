"""DuckDB twin of the field summary (H17) over the NULL-band orders table."""

from __future__ import annotations

from ...functions import constants as K


def _text_k2(src: str, c: str) -> str:
    alpha = f"regexp_matches({c}, '^[A-Za-z]+$')"
    up = f"(upper({c}) = {c} AND lower({c}) <> {c})"
    low = f"(lower({c}) = {c} AND upper({c}) <> {c})"
    title = f"(upper(substr({c}, 1, 1)) || lower(substr({c}, 2)) = {c})"
    return f"""  SELECT '{c}' AS "column", n,
         CASE WHEN bool_or_at OR contains(lower('{c}'), 'email') THEN bad_email ELSE 0 END AS email_issues,
         CASE WHEN n > 5 AND len_mean > 5 THEN CAST(len_dev AS DOUBLE) * 0.5 ELSE 0.0 END AS len_issues,
         CASE WHEN up + low + title + mixed > 5 AND (CAST(up > 0 AS INTEGER) + CAST(low > 0 AS INTEGER)
                   + CAST(title > 0 AS INTEGER) + CAST(mixed > 0 AS INTEGER)) > 2
              THEN CAST(up + low + title + mixed AS DOUBLE) * 0.1 ELSE 0.0 END AS case_issues
  FROM (SELECT COUNT({c}) AS n,
               COALESCE(bool_or(contains({c}, '@')), FALSE) AS bool_or_at,
               COUNT(*) FILTER (WHERE contains({c}, '@') AND NOT regexp_matches({c}, '{K.EMAIL_PATTERN}')) AS bad_email,
               avg(length({c})) AS len_mean,
               COUNT(*) FILTER (WHERE abs(length({c}) - (SELECT avg(length({c})) FROM {src}))
                                      > (SELECT avg(length({c})) FROM {src}) * 0.5) AS len_dev,
               COUNT(*) FILTER (WHERE {alpha} AND {up}) AS up,
               COUNT(*) FILTER (WHERE {alpha} AND NOT {up} AND {low}) AS low,
               COUNT(*) FILTER (WHERE {alpha} AND NOT {up} AND NOT {low} AND {title}) AS title,
               COUNT(*) FILTER (WHERE {alpha} AND NOT {up} AND NOT {low} AND NOT {title}) AS mixed
        FROM {src})"""


def field_summary_sql(percol_sql: str, nums: list[str], texts: list[str], dates: list[str],
                      labels: dict[str, str]) -> str:
    """``percol_sql`` defines ``o`` (the data) and ``pc`` (counts, k1 per column)."""
    k2 = "\n  UNION ALL\n".join(_text_k2("o", c) for c in texts)
    stats = "\n  UNION ALL\n".join(
        f"""  SELECT '{c}' AS "column", round_even(avg({c}), 2) AS mean, round_even(median({c}), 2) AS median,
         round_even(stddev_samp({c}), 2) AS std, CAST(min({c}) AS DOUBLE) AS min,
         CAST(max({c}) AS DOUBLE) AS max FROM o""" for c in nums)
    lab = " ".join(f"WHEN '{c}' THEN '{v}'" for c, v in labels.items())
    return "WITH " + percol_sql + f""",
k2t AS (
{k2}),
st AS (
{stats})
SELECT 'orders' AS title, 'orders' AS dataset_name, pc."column" AS column_name,
       CASE pc."column" {lab} END AS data_type,
       CAST(total_count AS BIGINT) AS total_count, CAST(null_count AS BIGINT) AS null_count,
       CAST(distinct_count AS BIGINT) AS distinct_count,
       round_even(completeness, 1) AS completeness, round_even(uniqueness, 1) AS uniqueness,
       round_even(CASE WHEN k2t.n IS NULL THEN pc.k1
                       WHEN k2t.n = 0 THEN 0.0
                       ELSE greatest(0.0, 100 - (email_issues + len_issues + case_issues) / k2t.n * 100) END, 1)
         AS consistency,
       completeness >= 80 AND (CAST(total_count - null_count AS DOUBLE) / total_count) >= 0.7
         AND null_count < total_count * 0.5 AS is_critical,
       st.mean, st.median, st.std, st.min, st.max, pc.ordinal
FROM pc LEFT JOIN k2t ON pc."column" = k2t."column" LEFT JOIN st ON pc."column" = st."column"
"""
