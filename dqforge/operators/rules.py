"""Validation rules (R1-R17) and the rule compiler.

* Predicate rules (not null, allowed set, regex, range, date range and their
  multi-column forms) become per-row 0/1 failure flags, summed in one plain
  aggregate: one row leaves each map task.
* Uniqueness rules (single column, combination) become grouping keys.  Each row
  is expanded into one record per such rule (``inline`` of a fixed-size array)
  and one ``groupBy(rule, keys)`` counts the keys; partial aggregation collapses
  a hot key to one row per map task.  A second, tiny ``groupBy(rule)`` turns key
  counts into duplicate counts.
* Wide keys (texts, nested values, more than 16 bytes of fixed-width columns) are
  counted by 128-bit digests first; only rows whose digest repeats are grouped by
  their whole keys, which settles collisions (``_wide_counts``).  This first count
  runs when the rules are compiled, the rest is lazy.

Both parts are column-pruned scans of their own: the predicates read their
columns, the uniqueness rules read only the keys.
"""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from ..functions.names import qcol
from ..functions import constants as K
from ..functions import predicates as P

log = logging.getLogger(__name__)

RESULT_SCHEMA = T.StructType([
    T.StructField("seq", T.IntegerType(), False),
    T.StructField("column", T.StringType(), False),
    T.StructField("rule", T.StringType(), False),
    T.StructField("details", T.MapType(T.StringType(), T.StringType()), True),
])

GROUP_KINDS = {"unique", "unique_combination"}


@dataclass(frozen=True)
class Rule:
    """One validation rule.  ``columns`` are the columns it reads."""

    kind: str
    columns: tuple
    params: dict = field(default_factory=dict, hash=False, compare=False)

    # ---- labels ---------------------------------------------------------
    @property
    def column_label(self) -> str:
        return ", ".join(self.columns)

    @property
    def label(self) -> str:
        k = self.kind
        if k == "in_range":
            return f"{K.RULE_IN_RANGE} {self.params['min_val']}-{self.params['max_val']}"
        if k == "length":
            return f"{K.RULE_LENGTH} {self.params['min_len']}-{self.params['max_len']}"
        return {
            "not_null": K.RULE_NOT_NULL, "unique": K.RULE_UNIQUE, "in_set": K.RULE_IN_SET,
            "regex": K.RULE_REGEX, "date_range": K.RULE_DATE_RANGE,
            "all_not_null": K.RULE_ALL_NOT_NULL, "unique_combination": K.RULE_UNIQUE_COMBINATION,
            "all_in_sets": K.RULE_ALL_IN_SETS, "all_match": K.RULE_ALL_MATCH,
            "all_in_ranges": K.RULE_ALL_IN_RANGES, "is_boolean": K.RULE_IS_BOOLEAN,
            "is_numeric": K.RULE_IS_NUMERIC, "is_datetime": K.RULE_IS_DATETIME,
            "contains": K.RULE_CONTAINS,
        }[k]

    @property
    def details(self) -> dict:
        p = self.params
        out: dict[str, str] = {}
        if "allowed_values" in p:
            out["allowed_values"] = json.dumps(p["allowed_values"], default=str)
        if "pattern" in p:
            out["pattern"] = p["pattern"]
        if self.kind == "in_range":
            out["range"] = str((p["min_val"], p["max_val"]))
        if self.kind == "date_range":
            out["range"] = str((p["min_date"], p["max_date"]))
        if len(self.columns) > 1 or self.kind.startswith("all_") or self.kind == "unique_combination":
            out["columns"] = json.dumps(list(self.columns))
        if "patterns" in p:
            out["patterns"] = json.dumps(p["patterns"])
        if "ranges" in p:
            out["ranges"] = json.dumps({k: list(v) for k, v in p["ranges"].items()}, default=str)
        if "substring" in p:
            out["substring"] = p["substring"]
        return out

    @property
    def is_group(self) -> bool:
        return self.kind in GROUP_KINDS


# --------------------------------------------------------------------------
# Rule constructors, named as in the rule JSON format
# --------------------------------------------------------------------------
def _cols(columns) -> tuple:
    if isinstance(columns, str):
        return (columns,)
    if isinstance(columns, (list, tuple)):
        return tuple(columns)
    raise ValueError("Columns must be a string, list, or tuple")


def expect_column_values_to_not_be_null(column):
    return Rule("not_null", (column,))


def expect_column_values_to_be_unique(column):
    return Rule("unique", (column,))


def expect_column_values_to_be_in_set(column, allowed_values):
    return Rule("in_set", (column,), {"allowed_values": list(allowed_values)})


def expect_column_values_to_match_regex(column, pattern):
    P.check_regex(pattern)
    return Rule("regex", (column,), {"pattern": pattern})


def expect_column_values_to_be_in_range(column, min_val, max_val):
    return Rule("in_range", (column,), {"min_val": min_val, "max_val": max_val})


def expect_column_values_to_be_in_date_range(column, min_date, max_date, date_format=None):
    return Rule("date_range", (column,),
                {"min_date": min_date, "max_date": max_date, "date_format": date_format})


def expect_columns_values_to_not_be_null(columns):
    return Rule("all_not_null", _cols(columns))


def expect_columns_values_to_be_unique(columns):
    return Rule("unique_combination", _cols(columns))


def expect_columns_values_to_be_in_sets(columns, allowed_values):
    cols = _cols(columns)
    if isinstance(allowed_values, list):
        if len(allowed_values) != len(cols):
            raise ValueError("Number of allowed value lists must match number of columns")
        allowed_values = dict(zip(cols, allowed_values))
    return Rule("all_in_sets", cols,
                {"allowed_values": {k: list(v) for k, v in allowed_values.items()}})


def expect_columns_values_to_match_patterns(columns, patterns_dict):
    for p in patterns_dict.values():
        P.check_regex(p)
    return Rule("all_match", _cols(columns), {"patterns": dict(patterns_dict)})


def expect_columns_values_to_be_in_ranges(columns, ranges_dict):
    return Rule("all_in_ranges", _cols(columns),
                {"ranges": {k: tuple(v) for k, v in ranges_dict.items()}})


# Advertised checks, built as plain predicates (null fails)
def expect_column_values_to_be_boolean(column):
    return Rule("is_boolean", (column,))


def expect_column_values_to_be_numeric(column):
    return Rule("is_numeric", (column,))


def expect_column_values_to_be_datetime(column):
    return Rule("is_datetime", (column,))


def expect_column_value_lengths_to_be_between(column, min_len, max_len):
    return Rule("length", (column,), {"min_len": min_len, "max_len": max_len})


def expect_column_values_to_contain(column, substring):
    return Rule("contains", (column,), {"substring": substring})


# allow-list for rule JSON: only these names can be called
REGISTRY = {f.__name__: f for f in (
    expect_column_values_to_not_be_null, expect_column_values_to_be_unique,
    expect_column_values_to_be_in_set, expect_column_values_to_match_regex,
    expect_column_values_to_be_in_range, expect_column_values_to_be_in_date_range,
    expect_columns_values_to_not_be_null, expect_columns_values_to_be_unique,
    expect_columns_values_to_be_in_sets, expect_columns_values_to_match_patterns,
    expect_columns_values_to_be_in_ranges, expect_column_values_to_be_boolean,
    expect_column_values_to_be_numeric, expect_column_values_to_be_datetime,
    expect_column_value_lengths_to_be_between, expect_column_values_to_contain,
)}


def rules_from_json(spec) -> list[Rule]:
    """``{expectation_name: [kwargs, ...]}`` (dict or JSON text) -> rules.

    Unknown names are logged and skipped, like the original loader.
    """
    if isinstance(spec, str):
        spec = json.loads(spec)
    out = []
    for name, configs in spec.items():
        ctor = REGISTRY.get(name)
        if ctor is None:
            log.warning("Warning: %s not implemented.", name)
            continue
        for cfg in configs:
            out.append(ctor(**cfg))
    return out


def rules_from_config(config: dict, columns) -> list[Rule]:
    """The form-style config, applied in the fixed order
    not-null, unique, ranges, allowed values, patterns.  Columns absent from
    the data and empty sets/patterns are skipped."""
    cols = set(columns)
    out = []
    for c in config.get("not_null", []):
        if c in cols:
            out.append(expect_column_values_to_not_be_null(c))
    for c in config.get("unique", []):
        if c in cols:
            out.append(expect_column_values_to_be_unique(c))
    for c, (lo, hi) in config.get("ranges", {}).items():
        if c in cols:
            out.append(expect_column_values_to_be_in_range(c, lo, hi))
    for c, vals in config.get("allowed_values", {}).items():
        if c in cols and vals:
            out.append(expect_column_values_to_be_in_set(c, vals))
    for c, pat in config.get("patterns", {}).items():
        if c in cols and pat:
            out.append(expect_column_values_to_match_regex(c, pat))
    return out


# --------------------------------------------------------------------------
# Compiler
# --------------------------------------------------------------------------
def _failed_and_total(df: DataFrame, rule: Rule) -> tuple[Column, Column | None]:
    """Per-row failure flag (boolean, never NULL) and, for date ranges, the
    per-row "counted" flag (``None`` = every row counts)."""
    k, cols, p = rule.kind, rule.columns, rule.params
    c = qcol(cols[0])
    dt = P.column_type(df, cols[0])
    if k == "not_null":
        return c.isNull(), None
    if k == "in_set":
        return ~P.scored(P.in_set(c, p["allowed_values"], dt)), None
    if k == "regex":
        return ~P.scored(P.regex_match(c, p["pattern"])), None
    if k == "in_range":
        return ~P.scored(P.in_range(c, dt, p["min_val"], p["max_val"])), None
    if k == "date_range":
        parsed = P.parse_datetime(c, dt, p.get("date_format"))
        lo, hi = P.date_bounds(T.TimestampNTZType() if not isinstance(dt, T.TimestampType) else dt,
                               p["min_date"], p["max_date"])
        out = F.coalesce((parsed < lo) | (parsed > hi), F.lit(False))
        return out, parsed.isNotNull()
    if k == "all_not_null":
        bad = F.lit(False)
        for name in cols:
            bad = bad | qcol(name).isNull()
        return bad, None
    if k == "all_in_sets":
        bad = F.lit(False)
        for name in cols:
            if name in p["allowed_values"]:
                bad = bad | ~P.scored(P.in_set(qcol(name), p["allowed_values"][name], P.column_type(df, name)))
        return bad, None
    if k == "all_match":
        bad = F.lit(False)
        for name in cols:
            if name in p["patterns"]:
                bad = bad | ~P.scored(P.regex_match(qcol(name), p["patterns"][name]))
        return bad, None
    if k == "all_in_ranges":
        bad = F.lit(False)
        for name in cols:
            if name in p["ranges"]:
                lo, hi = p["ranges"][name]
                bad = bad | ~P.scored(P.in_range(qcol(name), P.column_type(df, name), lo, hi))
        return bad, None
    if k == "is_boolean":
        return ~P.scored(P.looks_boolean(c, dt)), None
    if k == "is_numeric":
        return ~P.scored(P.looks_numeric(c, dt)), None
    if k == "is_datetime":
        return ~P.scored(P.looks_datetime(c, dt)), None
    if k == "length":
        n = F.length(c.cast("string"))
        return ~P.scored(n.between(p["min_len"], p["max_len"])), None
    if k == "contains":
        return ~P.scored(c.cast("string").contains(p["substring"])), None
    raise ValueError(f"unknown rule kind {k!r}")


def _meta(spark, rules: list[Rule]) -> DataFrame:
    rows = [(i, r.column_label, r.label, r.details) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def _check_columns(df: DataFrame, rules: list[Rule]) -> None:
    missing = sorted({c for r in rules for c in r.columns if c not in df.columns})
    if missing:
        raise KeyError(f"columns not in data: {missing}")


#: bytes of a digest; keys that are no wider are grouped as they are
_DIGEST_BYTES = 16
#: repeated digests are broadcast up to this many (about 40 bytes each)
REPEATED_LIMIT = 1_000_000


def _is_wide(df: DataFrame, columns: tuple) -> bool:
    sizes = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8, T.BooleanType: 1,
             T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8}
    return sum(sizes.get(type(P.column_type(df, c)), 1 << 20) for c in columns) > _DIGEST_BYTES


def _key_column(df: DataFrame, name: str) -> Column:
    """A key column as it is grouped: maps by their JSON text."""
    return F.to_json(qcol(name)) if isinstance(P.column_type(df, name), T.MapType) else qcol(name)


def _key_digest(df: DataFrame, columns: tuple) -> tuple[Column, Column]:
    """128 bits of a key, NULL told from every value and -0.0 the same as 0.0."""
    parts = []
    for c in columns:
        x = _key_column(df, c)
        x = x + F.lit(0.0).cast(P.column_type(df, c)) if isinstance(P.column_type(df, c), P.FLOAT_TYPES) else x
        parts += [x.isNull(), x]
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)


def _wide_counts(df: DataFrame, rules: list[tuple[int, Rule]], by: list[str]) -> DataFrame:
    """(by..., seq, total, failed) of uniqueness rules over wide keys."""
    from ..sources.csv import scratch_dir
    spark, byc = df.sparkSession, [qcol(b) for b in by]

    def records(with_keys: bool) -> DataFrame:
        """One record a row and rule, none for the NULLs of a single-column rule (they never fail)."""
        keys = list(dict.fromkeys(c for _, r in rules for c in r.columns)) if with_keys else []
        types = {c: T.StringType() if isinstance(P.column_type(df, c), T.MapType) else P.column_type(df, c) for c in keys}
        recs = []
        for i, r in rules:
            h1, h2 = _key_digest(df, r.columns)
            own = [(_key_column(df, c) if c in r.columns else F.lit(None).cast(types[c])).alias(f"_dqk{j}") for j, c in enumerate(keys)]
            counted = qcol(r.columns[0]).isNotNull() if r.kind == "unique" else F.lit(True)
            recs.append(F.struct(F.when(counted, F.lit(i)).alias("_dqr"), h1.alias("_dqh1"), h2.alias("_dqh2"), *own))
        if not with_keys:                       # every row counts once more, for the total of all rules
            zero = F.lit(0).cast("long")
            recs.append(F.struct(F.lit(-1).alias("_dqr"), zero.alias("_dqh1"), zero.alias("_dqh2")))
        return df.select(*byc, F.inline(F.array(*recs))).filter(F.col("_dqr").isNotNull())

    path = scratch_dir(spark, "repeated-digests")
    digest = [*by, "_dqr", "_dqh1", "_dqh2"]
    (records(False).groupBy(*map(qcol, digest)).agg(F.count(F.lit(1)).alias("_dqn")).filter("_dqn > 1 OR _dqr = -1").write.parquet(path))
    counted = spark.read.parquet(path)
    repeated = counted.filter("_dqr >= 0").drop("_dqn")
    n = repeated.count()
    totals = counted.filter("_dqr = -1").select(
        *byc, F.inline(F.array(*[F.struct(F.lit(i).alias("seq"), F.col("_dqn").alias("total"), F.lit(0).cast("long").alias("failed")) for i, _ in rules])))
    if n == 0:
        return totals
    whole = records(True)
    fields = [c for c in whole.columns if c.startswith("_dqk")]
    if n <= REPEATED_LIMIT:
        other = repeated.toDF(*[f"_dqj{i}" for i in range(len(digest))])
        on = [qcol(c).eqNullSafe(F.col(f"_dqj{i}")) for i, c in enumerate(digest)]
        whole = whole.join(F.broadcast(other), on, "left_semi")
    failed = (whole.groupBy(*byc, "_dqr", *fields).agg(F.count(F.lit(1)).alias("_dqn")).filter("_dqn > 1")
              .groupBy(*byc, F.col("_dqr").alias("seq")).agg(F.lit(0).cast("long").alias("total"), F.sum("_dqn").alias("failed")))
    return (totals.unionByName(failed).groupBy(*byc, "seq")
            .agg(F.sum("total").cast("long").alias("total"), F.sum("failed").cast("long").alias("failed")))


def rule_counts(df: DataFrame, rules: list[Rule], by: list[str] | None = None) -> DataFrame:
    """(by..., seq, total, failed) for every rule.  Rules whose
    input is empty produce no row here; ``evaluate`` fills them with zeros.

    ``by`` evaluates the rules separately per group (snapshot, version, day)
    in the same job: the group columns just join the grouping keys."""
    by = list(by or [])
    byc = [qcol(b) for b in by]
    pred = [(i, r) for i, r in enumerate(rules) if not r.is_group]
    wide = [(i, r) for i, r in enumerate(rules) if r.is_group and _is_wide(df, r.columns)]
    if wide:
        settled = _wide_counts(df, wide, by)
        others = [r for _, r in enumerate(rules) if not (r.is_group and _is_wide(df, r.columns))]
        if not others:
            return settled
        place = [i for i, r in enumerate(rules) if r in others]
        rest = rule_counts(df, others, by)
        seq = F.element_at(F.array(*map(F.lit, place)), F.col("seq") + 1)
        return rest.withColumn("seq", seq).unionByName(settled)
    grp = [(i, r) for i, r in enumerate(rules) if r.is_group]

    flag_exprs = {}
    for i, r in pred:
        bad, counted = _failed_and_total(df, r)
        flag_exprs[f"_dqf{i}"] = bad.cast("int")
        if counted is not None:
            # a date range counts only parseable values: failures among them
            flag_exprs[f"_dqt{i}"] = counted.cast("int")

    def long_rows(src: DataFrame, total_col: str, sums: dict) -> DataFrame:
        items = []
        for i, _ in pred:
            tot = sums.get(f"_dqt{i}", qcol(total_col))
            items.append(F.struct(F.lit(i).alias("seq"), tot.cast("long").alias("total"),
                                  sums[f"_dqf{i}"].cast("long").alias("failed")))
        return src.select(*byc, F.inline(F.array(*items)))

    if pred:
        # sums over the whole input: one row leaves each map task, whatever the flags are
        aggs = [F.count(F.lit(1)).alias("_dqn")]
        aggs += [F.sum(e).alias(n) for n, e in flag_exprs.items()]
        plain = long_rows(df.groupBy(*byc).agg(*aggs), "_dqn", {n: qcol(n) for n in flag_exprs})
    if not grp:
        return plain

    # distinct key columns over all uniqueness rules, one typed field each
    key_cols: list[str] = []
    for _, r in grp:
        for c in r.columns:
            if c not in key_cols:
                key_cols.append(c)
    key_field = {c: f"_dqk{j}" for j, c in enumerate(key_cols)}
    key_type = {c: P.column_type(df, c) for c in key_cols}
    # maps cannot be grouped on: their JSON text stands in for them
    key_expr = {c: F.to_json(qcol(c)) if isinstance(key_type[c], T.MapType) else qcol(c)
                for c in key_cols}
    key_type = {c: T.StringType() if isinstance(t, T.MapType) else t for c, t in key_type.items()}

    def record(rule_id: int, keys: tuple) -> Column:
        parts = [F.lit(rule_id).alias("_dqr")]
        for c in key_cols:
            v = key_expr[c] if c in keys else F.lit(None).cast(key_type[c])
            parts.append(v.alias(key_field[c]))
        return F.struct(*parts)

    exploded = df.select(*byc, F.inline(F.array(*[record(i, r.columns) for i, r in grp])))
    stage1 = exploded.groupBy(*byc, "_dqr", *key_field.values()).agg(F.count(F.lit(1)).alias("_dqn"))

    # A single-column rule never fails on NULL; N4: combinations do
    cond = None
    for i, r in grp:
        if r.kind == "unique":
            e = qcol(key_field[r.columns[0]]).isNotNull()
            cond = F.when(F.col("_dqr") == i, e) if cond is None else cond.when(
                F.col("_dqr") == i, e)
    counts_dup = F.lit(True) if cond is None else cond.otherwise(F.lit(True))
    dup = F.when((F.col("_dqn") > 1) & counts_dup, F.col("_dqn")).otherwise(F.lit(0))
    keyed = stage1.groupBy(*byc, "_dqr").agg(F.sum("_dqn").alias("total"), F.sum(dup).alias("failed"))
    keyed = keyed.select(*byc, F.col("_dqr").alias("seq"), F.col("total").cast("long").alias("total"),
                         F.col("failed").cast("long").alias("failed"))
    return plain.unionByName(keyed) if pred else keyed


def evaluate(df: DataFrame, rules: list[Rule], normalize: bool = True,
             by: list[str] | None = None) -> DataFrame:
    """The rule-result table.

    Columns: ``[by...,] seq, column, rule, total, passed, failed, success_rate,
    details``.  ``success_rate`` is ``100 * passed / total`` and 0.0 for an
    empty input.  With ``by``, one result set per group, from the same job.
    """
    by = list(by or [])
    rules = list(rules)
    if not rules:
        raise ValueError("no rules to evaluate")
    _check_columns(df, rules)
    used = sorted({c for r in rules for c in r.columns} | set(by))
    src = df.select(*[qcol(c) for c in used])
    if normalize:
        src = P.normalize_nan(src, [c for c in used if c not in by])
    return result_table(df.sparkSession, rules, rule_counts(src, rules, by), by)


def result_table(spark, rules: list[Rule], counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The rule-result table from (by..., seq, total, failed)."""
    by = list(by or [])
    meta = _meta(spark, rules)
    if by:
        # every group with rows yields every rule; meta is ~#rules rows
        out = counts.join(meta, "seq")
    else:
        out = meta.join(counts, "seq", "left")  # both sides ~#rules rows
    total = F.coalesce(F.col("total"), F.lit(0)).cast("long")
    failed = F.coalesce(F.col("failed"), F.lit(0)).cast("long")
    return out.select(
        *[qcol(b) for b in by], "seq", "column", "rule",
        total.alias("total"), (total - failed).alias("passed"), failed.alias("failed"),
        success_rate(total - failed, total).alias("success_rate"),
        "details",
    )


def success_rate(passed: Column, total: Column) -> Column:
    """``100 * passed / total``; 0.0 (not NULL, no error) when total is 0."""
    return F.coalesce(F.try_divide(passed, total) * F.lit(100), F.lit(0.0))


def pattern_preview(df: DataFrame, column: str, pattern: str, samples: int = 5,
                    order_by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Match rate over the non-null values, and the first ``samples``
    non-null values (by ``order_by``, else by value) with their match flag.

    Returns ``(rate_row, sample_rows)``; the sample is a top-k (the feature),
    cut to ``samples`` rows per task before the final merge."""
    c = qcol(column)
    m = P.regex_match(c, pattern)
    rate = df.agg(F.count_if(c.isNotNull() & F.coalesce(m, F.lit(False))).alias("matching"),
                  F.count(c).alias("total_non_null"))
    rate = rate.select(F.lit(column).alias("column"), "matching", "total_non_null",
                       success_rate(F.col("matching"), F.col("total_non_null")).alias("match_rate"))
    key = qcol(order_by) if order_by else c
    samp = (df.filter(c.isNotNull()).orderBy(key).limit(samples)
            .select(c.cast("string").alias("value"), F.coalesce(m, F.lit(False)).alias("matches")))
    return rate, samp
