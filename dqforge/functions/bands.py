"""Band and label expressions (H1, H2, H13, H18) as ``when`` chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def _bands(x: Column, bands, floor) -> Column:
    out = None
    for lower, label in bands:
        out = F.when(x >= lower, F.lit(label)) if out is None else out.when(x >= lower, F.lit(label))
    return out.otherwise(F.lit(floor))


def health_status(rate: Column) -> Column:
    """H1: >=90 Excellent, >=75 Good, >=50 Fair, else Poor."""
    return _bands(rate, K.HEALTH_BANDS, K.HEALTH_FLOOR)


def score_color(score: Column) -> Column:
    """H2: >=90 / >=70 / >=50 / else (a different cut than H1)."""
    return _bands(score, K.SCORE_COLOR_BANDS, K.SCORE_COLOR_FLOOR)


def rule_title(rule: Column) -> Column:
    """H18 label: underscores to spaces, words capitalised."""
    return F.initcap(F.regexp_replace(rule, "_", " "))


def rule_description(rule: Column) -> Column:
    """H18 description: any rule with 'range' first, then exact, then substring
    match either way, in the fixed order of the description table."""
    low = F.lower(rule)
    d = K.RULE_DESCRIPTIONS
    out = F.when(low.contains("range") & low.contains("date"), F.lit(d["in date range"])) \
        .when(low.contains("range"), F.lit(d["in range"]))
    for key, text in d.items():
        out = out.when(rule == F.lit(key), F.lit(text))
    for key, text in d.items():
        out = out.when(low.contains(key) | F.lit(key).contains(low), F.lit(text))
    return out.otherwise(F.lit(K.DEFAULT_RULE_DESCRIPTION))
