"""Registered profile query: text measures over all values of each column."""

from __future__ import annotations

from ...functions import constants as K
from ...operators import profile as PR
from .q_profile import CUSTOMER_TEXT_SQL, customer_text

QUERIES: dict = {}
ORACLE: dict = {}

TEXT = ["c_email", "c_padded", "c_word", "c_mktsegment"]


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _measures(c: str) -> str:
    alpha = f"regexp_matches({c}, '^[A-Za-z]+$')"
    up = f"(upper({c}) = {c} AND lower({c}) <> {c})"
    low = f"(lower({c}) = {c} AND upper({c}) <> {c})"
    title = f"(upper(substr({c}, 1, 1)) || lower(substr({c}, 2)) = {c})"
    return f"""  SELECT '{c}' AS "column", COUNT(*) AS n,
    COUNT(*) FILTER (WHERE contains({c}, '@') AND NOT regexp_matches({c}, '{K.EMAIL_PATTERN}')) AS bad_email,
    COALESCE(bool_or(contains({c}, '@')), FALSE) OR contains(lower('{c}'), 'email') AS email_check,
    COUNT(*) FILTER (WHERE regexp_matches({c}, '^\\s') OR regexp_matches({c}, '\\s$')) AS ws,
    avg(length({c})) AS len_mean,
    COUNT(*) FILTER (WHERE abs(length({c}) - (SELECT avg(length({c})) FROM s))
                           > (SELECT avg(length({c})) FROM s) * 0.5) AS len_dev,
    COUNT(*) FILTER (WHERE {alpha} AND {up}) AS up,
    COUNT(*) FILTER (WHERE {alpha} AND NOT {up} AND {low}) AS low,
    COUNT(*) FILTER (WHERE {alpha} AND NOT {up} AND NOT {low} AND {title}) AS title,
    COUNT(*) FILTER (WHERE {alpha} AND NOT {up} AND NOT {low} AND NOT {title}) AS mixed
  FROM s"""


KEYED_SQL = f"""
WITH {CUSTOMER_TEXT_SQL},
s AS (SELECT * FROM c),
t AS (
""" + "\n  UNION ALL\n".join(_measures(c) for c in TEXT) + """),
x AS (
  SELECT *, CASE WHEN email_check THEN bad_email ELSE 0 END AS email_issues,
         CASE WHEN n > 5 AND len_mean > 5 THEN CAST(len_dev AS DOUBLE) * 0.5 ELSE 0.0 END AS len_issues,
         up + low + title + mixed AS alpha_total,
         CAST(up > 0 AS INTEGER) + CAST(low > 0 AS INTEGER) + CAST(title > 0 AS INTEGER)
           + CAST(mixed > 0 AS INTEGER) AS used
  FROM t)
SELECT "column",
       greatest(0.0, 100 - email_issues / n * 100) AS consistency_standard,
       greatest(0.0, 100 - (email_issues + len_issues
            + CASE WHEN alpha_total > 5 AND used > 2 THEN CAST(alpha_total AS DOUBLE) * 0.1 ELSE 0.0 END)
            / n * 100) AS consistency_extended,
       greatest(0.0, 100 - ws / n * 100) AS consistency_whitespace
FROM x"""


@register("profile_consistency_keyed_customer", KEYED_SQL)
def profile_consistency_keyed_customer(spark, sf):
    df = customer_text(spark, sf)
    return PR.profile(df, columns=TEXT, only=["column", "consistency_standard", "consistency_extended", "consistency_whitespace"])
