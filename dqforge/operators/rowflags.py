"""Row-level pass/fail flags (P3-P5) and filters over them.

Flags follow the row policy: a NULL value passes every check except not-null.
A range that cannot be compared with the column, or a pattern that does not
compile, marks the whole flag as passed (P5).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import qcol
from ..functions import predicates as P
from .duplicates import duplicated_values_per_column, mark_duplicates

SUMMARY_COLUMNS = ["total_validations", "passed_validations", "validation_success_rate",
                   "all_validations_pass"]


def enhanced_dataset(df: DataFrame, config: dict, normalize: bool = True) -> DataFrame:
    """P3 + P4: the input with ``{col}_{check}_pass`` flags and a per-row summary.

    ``config`` is ``{not_null: [...], unique: [...], ranges: {col: (lo, hi)},
    allowed_values: {col: [...]}, patterns: {col: pattern}}``; columns absent
    from the data and empty sets/patterns are skipped.
    """
    src = P.normalize_nan(df) if normalize else df
    cols = set(src.columns)
    flags: list[tuple[str, Column]] = []

    for c in config.get("not_null", []):
        if c in cols:
            flags.append((f"{c}_not_null_pass", qcol(c).isNotNull()))

    uniques = list(dict.fromkeys(c for c in config.get("unique", []) if c in cols))
    # several unique checks: all duplicated values come from one aggregation
    # over the input (not from the output of the previous check's joins)
    dup_tables = duplicated_values_per_column(src, uniques) if len(uniques) > 1 else {}
    for c in uniques:
        # NULL passes; duplicated non-null values fail (all instances)
        src = mark_duplicates(src, [c], flag=f"_dq_dup_{c}", dups=dup_tables.get(c))
        flags.append((f"{c}_unique_pass", ~qcol(f"_dq_dup_{c}") | qcol(c).isNull()))

    for c, (lo, hi) in config.get("ranges", {}).items():
        if c in cols:
            dt = P.column_type(src, c)
            if P.range_comparable(dt, lo, hi):
                pred = P.flagged(P.in_range(qcol(c), dt, lo, hi), qcol(c))
            else:
                pred = F.lit(True)
            flags.append((f"{c}_range_pass", pred))

    for c, vals in config.get("allowed_values", {}).items():
        if c in cols and vals:
            flags.append((f"{c}_allowed_values_pass",
                          P.flagged(P.in_set(qcol(c), vals, P.column_type(src, c)), qcol(c))))

    for c, pat in config.get("patterns", {}).items():
        if c in cols and pat:
            try:
                re.compile(pat)
                pred = P.flagged(P.regex_match(qcol(c), pat), qcol(c))
            except re.error:
                pred = F.lit(True)
            flags.append((f"{c}_pattern_pass", pred))

    base = [qcol(c) for c in df.columns]
    if not flags:
        return src.select(*base)
    flag_cols = [e.alias(n) for n, e in flags]
    out = src.select(*base, *flag_cols)
    # Summarise only the flags made here
    names = [n for n, _ in flags]
    passed = reduce(lambda a, b: a + b, [qcol(n).cast("int") for n in names])
    total = F.lit(len(names))
    return out.select(
        "*",
        total.alias("total_validations"),
        passed.alias("passed_validations"),
        F.bround(passed / total * 100, 1).alias("validation_success_rate"),
        (passed == total).alias("all_validations_pass"),
    )


def flag_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.endswith("_pass") and c != "all_validations_pass"]


def filter_rows(enhanced: DataFrame, needle: str | None = None, column: str | None = None,
                rule_flag: str | None = None, status: bool | None = None) -> DataFrame:
    """Rows whose text (one column, or any column) contains ``needle``
    case-insensitively, optionally restricted to a flag being true/false."""
    out = enhanced
    if needle:
        low = needle.lower()
        targets = [column] if column else [c for c in enhanced.columns]
        conds = [F.coalesce(F.lower(qcol(c).cast("string")).contains(low), F.lit(False))
                 for c in targets]
        out = out.filter(reduce(lambda a, b: a | b, conds))
    if rule_flag is not None and status is not None:
        out = out.filter(qcol(rule_flag) == F.lit(status))
    return out


def rules_for_column(results: DataFrame, column: str) -> DataFrame:
    """P10: distinct rule labels whose column list names ``column``."""
    return (results.filter(F.array_contains(F.split(F.col("column"), ", "), column))
            .select("rule").distinct())
