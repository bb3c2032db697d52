"""Column profiling.

A profile is put together from parts, and only the parts that the wanted output
columns need are planned (``profile(only=[...])``); nothing runs before an action.

* counts, min/max, mean, deviation, text measures, text-as-boolean: one plain
  ``agg`` -- one row leaves each task, no value is shuffled;
* quartiles: counting passes that narrow a value range (``quartile_ranges``);
* outliers and length deviations: a second plain ``agg`` with the means and
  quartiles as one-row scalar subqueries;
* distinct counts: ``groupBy(column, value)``, long texts by a 128-bit digest;
* mode and samples: the frequency table (G2) of whole values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql import types as T

from ..functions.names import qcol
from ..functions import constants as K
from ..functions import predicates as P
from ..functions import ranks as RK
from ..functions.topk import first_rows

WS_PATTERN = r"(?U)(^\s|\s\z)"
ALPHA_PATTERN = r"^\p{L}+$"


@dataclass(frozen=True)
class ColumnInfo:
    ordinal: int
    name: str
    dtype: T.DataType

    @property
    def kind(self) -> str:
        dt = self.dtype
        if P.is_boolean(dt):
            return "boolean"
        if P.is_numeric(dt):
            return "numeric"
        if P.is_datetime(dt):
            return "datetime"
        if P.is_string(dt):
            return "text"
        return "other"

    @property
    def spark_type(self) -> str:
        return self.dtype.simpleString()


# --------------------------------------------------------------------------
# Type labels (G14-G16).  A and C differ only in their fallbacks; A also
# looks at text values (see ``profile``).
# --------------------------------------------------------------------------
def label_b(dt: T.DataType) -> str:
    """Dtype-only label; unknown types keep their own name title-cased."""
    if P.is_string(dt):
        return K.TYPE_TEXT
    if isinstance(dt, P.INTEGRAL_TYPES):
        return K.TYPE_INTEGER
    if isinstance(dt, P.FLOAT_TYPES + (T.DecimalType,)):
        return K.TYPE_DECIMAL
    if P.is_boolean(dt):
        return K.TYPE_BOOLEAN
    if P.is_datetime(dt):
        return K.TYPE_DATETIME
    name = dt.simpleString()
    return name.title() if name else K.TYPE_UNKNOWN


def label_c(dt: T.DataType) -> str:
    """As G15 with ``Other`` for everything unrecognised."""
    lab = label_b(dt)
    return lab if lab in (K.TYPE_TEXT, K.TYPE_INTEGER, K.TYPE_DECIMAL, K.TYPE_BOOLEAN,
                          K.TYPE_DATETIME) else K.TYPE_OTHER


def label_a_static(dt: T.DataType) -> str | None:
    """G14 for non-text columns (text needs its values)."""
    if P.is_datetime(dt):
        return K.TYPE_DATETIME
    if P.is_boolean(dt):
        return K.TYPE_BOOLEAN
    if isinstance(dt, P.INTEGRAL_TYPES):
        return K.TYPE_INTEGER
    if isinstance(dt, P.FLOAT_TYPES):
        return K.TYPE_DECIMAL
    if isinstance(dt, T.DecimalType):
        return K.TYPE_NUMERIC
    if P.is_string(dt):
        return None
    return dt.simpleString().title()


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns (booleans excluded, as ``select_dtypes('number')``)."""
    return [f.name for f in df.schema.fields if P.is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    """Text columns."""
    return [f.name for f in df.schema.fields if P.is_string(f.dataType)]


def columns_info(df: DataFrame, columns: list[str] | None = None) -> list[ColumnInfo]:
    names = columns or df.columns
    return [ColumnInfo(i, f.name, f.dataType) for i, f in enumerate(df.schema.fields)
            if f.name in names]


# --------------------------------------------------------------------------
# Frequency table
# --------------------------------------------------------------------------
def quoted(name: str) -> str:
    """A column's name in SQL text."""
    return "`" + name.replace("`", "``") + "`"


# Expressions over many columns are written as SQL text: Spark parses one in a single call, while
# building them call by call takes longer than small tables do to read.
def _text_sql(ci: ColumnInfo) -> str:
    c, dt = quoted(ci.name), ci.dtype
    if isinstance(dt, P.FLOAT_TYPES):
        # -0.0 and 0.0 are one value
        return f"CASE WHEN {c} = 0 THEN '0.0' ELSE CAST({c} AS STRING) END"
    if isinstance(dt, T.TimestampType):
        # absolute instants: keep microseconds, independent of the session zone
        return f"CAST(unix_micros({c}) AS STRING)"
    if isinstance(dt, T.BinaryType):
        return f"base64({c})"
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
        return f"to_json({c})"
    return f"CAST({c} AS STRING)"


def _as_text(ci: ColumnInfo) -> Column:
    return F.expr(_text_sql(ci))


_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def _typed(ci: ColumnInfo) -> tuple[str, str]:
    """A value as its field -- ``s`` text, ``d`` double or ``l`` long -- and SQL.  Grouping on
    typed fields avoids rendering every row as text before aggregation."""
    c, dt = quoted(ci.name), ci.dtype
    if isinstance(dt, P.INTEGRAL_TYPES):
        return "l", f"CAST({c} AS BIGINT)"
    if isinstance(dt, P.FLOAT_TYPES):
        return "d", f"CAST({c} AS DOUBLE)"             # grouping folds -0.0 into 0.0
    if P.is_boolean(dt):
        return "l", f"CAST(CAST({c} AS INT) AS BIGINT)"
    if isinstance(dt, T.TimestampType):
        return "l", f"unix_micros({c})"
    if isinstance(dt, (T.TimestampNTZType, T.DateType)):
        return "l", f"timestampdiff(MICROSECOND, {_EPOCH}, CAST({c} AS TIMESTAMP_NTZ))"
    return "s", _text_sql(ci)


def _render(infos: list[ColumnInfo]) -> tuple[str, str, str]:
    """After aggregation: the text form ``v`` (as ``cast(value as string)``
    renders it), ``vn`` (numbers, booleans as 0/1) and ``vt`` (datetimes as
    microseconds)."""
    def when(pred, then: str) -> str:
        got = [str(i.ordinal) for i in infos if pred(i)]
        return f" WHEN ci IN ({', '.join(got)}) THEN {then}" if got else ""

    def case(*branches: str, other: str) -> str:
        return f"CASE{''.join(branches)} ELSE {other} END" if any(branches) else other

    ts = f"timestampadd(MICROSECOND, l, {_EPOCH})"
    of = lambda *kinds: lambda i: isinstance(i.dtype, kinds)
    v = case(when(of(*P.INTEGRAL_TYPES), "CAST(l AS STRING)"), when(of(T.FloatType), "CAST(CAST(d AS FLOAT) AS STRING)"),
             when(of(T.DoubleType), "CAST(d AS STRING)"), when(of(T.BooleanType), "CASE l WHEN 1 THEN 'true' WHEN 0 THEN 'false' END"),
             when(of(T.TimestampType), "CAST(l AS STRING)"), when(of(T.TimestampNTZType), f"CAST({ts} AS STRING)"),
             when(of(T.DateType), f"CAST(CAST({ts} AS DATE) AS STRING)"), other="s")
    vn = case(when(lambda i: i.kind == "numeric" and isinstance(i.dtype, T.DecimalType), "CAST(s AS DOUBLE)"),
              when(lambda i: i.kind in ("numeric", "boolean"), "coalesce(d, CAST(l AS DOUBLE))"), other="CAST(NULL AS DOUBLE)")
    vt = case(when(lambda i: i.kind == "datetime", "l"), other="CAST(NULL AS BIGINT)")
    return v, vn, vt


def _digest(t: str) -> str:
    """128 bits stand for a long text; shorter ones are told apart from digests by length."""
    return f"CASE WHEN length({t}) > 40 THEN concat(hex(xxhash64({t})), hex(xxhash64(1, {t})), '{'#' * 16}') ELSE {t} END"


def _records(infos: list[ColumnInfo], digest: bool = False) -> Column:
    recs = []
    for i in infos:
        field, x = _typed(i)
        value = {"s": "CAST(NULL AS STRING)", "d": "CAST(NULL AS DOUBLE)", "l": "CAST(NULL AS BIGINT)"}
        value[field] = _digest(x) if digest and field == "s" else x
        recs.append(f"named_struct('ci', {i.ordinal}, 's', {value['s']}, 'd', {value['d']}, 'l', {value['l']})")
    return F.expr(f"inline(array({', '.join(recs)}))")


def frequency_table(df: DataFrame, infos: list[ColumnInfo]) -> DataFrame:
    """``(ci, v, cnt, vn, vt, d, l)``: occurrences of each value (NULL included) per
    column, with the value as text, as a number and as a datetime, and typed."""
    freq = df.select(_records(infos)).groupBy("ci", "s", "d", "l").agg(F.count(F.lit(1)).alias("cnt"))
    v, vn, vt = _render(infos)
    return freq.selectExpr("ci", f"{v} AS v", "cnt", f"{vn} AS vn", f"{vt} AS vt", "d", "l")


def value_frequencies(df: DataFrame, columns: list[str] | None = None,
                      normalize: bool = True) -> DataFrame:
    """G2 as a table: ``(column, value, count)``, NULL values included."""
    src = P.normalize_nan(df) if normalize else df
    infos = columns_info(src, columns)
    names = src.sparkSession.createDataFrame([(i.ordinal, i.name) for i in infos],
                                             "ci int, column string")
    freq = frequency_table(src.select(*[qcol(i.name) for i in infos]), infos)
    return (freq.join(names, "ci")
            .select("column", F.col("v").alias("value"), F.col("cnt").alias("count")))


# --------------------------------------------------------------------------
# Profile
# --------------------------------------------------------------------------
PROFILE_COLUMNS = [
    "ordinal", "column", "spark_type", "kind", "data_type", "data_type_b", "data_type_c",
    "total_count", "null_count", "non_null_count", "distinct_count",
    "completeness", "uniqueness",
    "mean", "median", "std", "min", "max", "min_value", "max_value", "q1", "q3", "outliers",
    "date_min", "date_max", "date_median", "date_range_days",
    "mode", "mode_count", "sample_values",
    "consistency_standard", "consistency_extended", "consistency_whitespace",
    "consistency_type_share",
]


def _meta_df(spark, infos: list[ColumnInfo]) -> DataFrame:
    rows = [(i.ordinal, i.name, i.spark_type, i.kind, label_a_static(i.dtype),
             label_b(i.dtype), label_c(i.dtype),
             isinstance(i.dtype, T.TimestampType)) for i in infos]
    schema = "ordinal int, column string, spark_type string, kind string, label_a string, " \
             "data_type_b string, data_type_c string, is_ltz boolean"
    return spark.createDataFrame(rows, schema)


#: output columns -> the parts they need
_NEEDS = {
    "distinct": {"distinct_count", "uniqueness"},
    "numbers": {"mean", "std", "min", "max", "min_value", "max_value", "date_min", "date_max", "date_range_days"},
    "quartiles": {"median", "q1", "q3", "outliers", "date_median", "consistency_standard", "consistency_extended"},
    "outliers": {"outliers", "consistency_standard", "consistency_extended"},
    "text": {"consistency_standard", "consistency_extended", "consistency_whitespace"},
    "lengths": {"consistency_extended"},
    "labels": {"data_type"},
    "mode": {"mode", "mode_count"},
    "samples": {"sample_values"},
}


def profile(df: DataFrame, columns: list[str] | None = None, normalize: bool = True,
            sample_values: int = K.SAMPLE_VALUES, only: list[str] | None = None) -> DataFrame:
    """One row per column with counts, statistics, labels and consistency scores.

    Scores are unrounded doubles (0-100); presentation rounding is left to the
    caller (``bround``).  Text measures use the whole column.  ``only`` names the
    output columns wanted: what no wanted column needs is not planned.  Lazy.
    """
    src = P.normalize_nan(df) if normalize else df
    infos = columns_info(src, columns)
    src = src.select(*[qcol(i.name) for i in infos])
    wanted = set(only or PROFILE_COLUMNS)
    parts = {p for p, cols in _NEEDS.items() if cols & wanted}
    if "samples" not in parts and "mode" in parts:
        parts.add("heavy")                       # modes by a heavy-hitter summary
    if parts & {"quartiles", "lengths", "heavy"}:
        plain, unsettled = _measured(src, infos, parts)
    else:
        plain, unsettled = _wide(src, infos, parts).selectExpr(f"inline({_plain_rows(infos, parts)})"), infos
    out = _meta_df(src.sparkSession, infos).join(plain, F.col("ordinal") == F.col("ci")).drop("ci")

    def add(table: DataFrame) -> None:
        nonlocal out
        out = out.join(table.withColumnRenamed("ci", "_ci"), F.col("ordinal") == F.col("_ci"), "left").drop("_ci")

    out = out.drop("_mode", "mode_count") if "heavy" not in parts else out
    if "samples" in parts:                       # the value table serves distinct counts and modes too
        freq = frequency_table(src, infos).filter(F.col("v").isNotNull())
        add(_of_values(freq))
        add(_samples(freq, sample_values))
    else:
        if "distinct" in parts:
            add(_distinct(src, infos))
        if "mode" in parts and unsettled:
            freq = frequency_table(src.select(*[qcol(i.name) for i in unsettled]), unsettled).filter(F.col("v").isNotNull())
            add(_of_values(freq).select("ci", F.col("_mode").alias("_mode2"), F.col("mode_count").alias("_count2")))
            if "_mode" in out.columns:
                out = (out.withColumn("_mode", F.coalesce("_mode", "_mode2")).withColumn("mode_count", F.coalesce("mode_count", "_count2"))
                       .drop("_mode2", "_count2"))
    have = set(out.columns)
    for name, kind in _OPTIONAL.items():
        if name not in have:
            out = out.withColumn(name, F.lit(None).cast(kind))
    out = _finish(out)
    return out.select(*only) if only else out


#: what ``_finish`` reads of parts that may not be planned
_OPTIONAL = {"q1": "double", "median": "double", "q3": "double", "outliers": "long", "_len_dev": "long", "distinct_count": "long",
             "_mode": "string", "mode_count": "long", "_samp": "array<string>"}


def _number(i: ColumnInfo) -> str:
    """A number, boolean or datetime as the double that is ranked (SQL)."""
    if i.kind == "boolean":
        return f"CAST(CAST({quoted(i.name)} AS INT) AS DOUBLE)"
    return f"CAST({_typed(i)[1] if i.kind == 'datetime' else quoted(i.name)} AS DOUBLE)"


def _case(c: str) -> str:
    """1 upper, 2 lower, 3 title, 4 mixed case; null for text that is not all letters (SQL)."""
    return (f"CASE WHEN rlike({c}, r'{ALPHA_PATTERN}') THEN CASE WHEN upper({c}) = {c} AND lower({c}) != {c} THEN 1 "
            f"WHEN lower({c}) = {c} AND upper({c}) != {c} THEN 2 WHEN initcap({c}) = {c} THEN 3 ELSE 4 END END")


def _wide(src: DataFrame, infos: list[ColumnInfo], parts: set) -> DataFrame:
    """One row with every plain number: one aggregate, one row leaves each task."""
    made, aggs = [], ["count(1) AS _rows"]
    for i in infos:
        c, o = quoted(i.name), i.ordinal
        aggs.append(f"count({c}) AS _{o}_nn")
        if "numbers" in parts and i.kind in ("numeric", "boolean"):
            x = _number(i)
            aggs += [f"avg({x}) AS _{o}_mean", f"stddev_samp({x}) AS _{o}_std", f"min({c}) AS _{o}_min", f"max({c}) AS _{o}_max"]
        if "numbers" in parts and i.kind == "datetime":
            x = _typed(i)[1]
            aggs += [f"min({x}) AS _{o}_tmin", f"max({x}) AS _{o}_tmax"]
        if i.kind == "text":
            if "labels" in parts:
                aggs.append(f"bool_and(lower({c}) IN ({', '.join(repr(v) for v in K.BOOLEAN_TEXT_VALUES)})) AS _{o}_bool")
            if "text" in parts:
                aggs += [f"bool_or(contains({c}, '@')) AS _{o}_at", f"count_if(contains({c}, '@') AND NOT rlike({c}, r'{K.EMAIL_PATTERN}')) AS _{o}_bad",
                         f"count_if(rlike({c}, r'{WS_PATTERN}')) AS _{o}_ws"]
            if "lengths" in parts:
                made.append(f"{_case(c)} AS _case_{o}")          # told once a row, counted four times
                aggs.append(f"avg(length({c})) AS _{o}_len")
                aggs += [f"count_if(_case_{o} = {k}) AS _{o}_{n}" for k, n in enumerate(("up", "low", "title", "mixed"), 1)]
    return src.selectExpr("*", *made).agg(*map(F.expr, aggs))


def _plain_rows(infos: list[ColumnInfo], parts: set) -> str:
    """The numbers of ``_wide`` as one struct a column, all of one shape (SQL)."""
    def row(i: ColumnInfo) -> str:
        o, num, text = i.ordinal, i.kind in ("numeric", "boolean") and "numbers" in parts, i.kind == "text"
        when = i.kind == "datetime" and "numbers" in parts

        def take(have: bool, name: str, kind: str, out: str, via: str = "") -> str:
            got = f"_{o}_{name}" if have else "NULL"
            return f"'{out}', CAST({f'CAST({got} AS {via})' if via and have else got} AS {kind})"
        flag = "INT" if i.kind == "boolean" else ""
        fields = [f"'ci', {o}", "'total_count', _rows", f"'null_count', _rows - _{o}_nn",
                  take(num, "mean", "DOUBLE", "mean"), take(num, "std", "DOUBLE", "std"),
                  take(num, "min", "DOUBLE", "min", flag), take(num, "max", "DOUBLE", "max", flag),
                  take(num, "min", "STRING", "min_value"), take(num, "max", "STRING", "max_value"),
                  take(when, "tmin", "BIGINT", "_tmin"), take(when, "tmax", "BIGINT", "_tmax"),
                  take(text and "text" in parts, "at", "BOOLEAN", "_any_at"), take(text and "text" in parts, "bad", "BIGINT", "_bad_email"),
                  take(text and "text" in parts, "ws", "BIGINT", "_ws"), take(text and "lengths" in parts, "len", "DOUBLE", "_len_mean"),
                  *[take(text and "lengths" in parts, k, "BIGINT", f"_{k}") for k in ("up", "low", "title", "mixed")],
                  take(text and "labels" in parts, "bool", "BOOLEAN", "_boolish")]
        return f"named_struct({', '.join(fields)})"
    return f"array({', '.join(map(row, infos))})"


PROBS = (0.25, 0.5, 0.75)
#: rows that a first grouping leaves for the last task, whatever the number of tasks
SLOTS = 64
#: heavy hitters: counters of a column's summary, candidates counted exactly
TRACKED, CANDIDATES = 1000, 8


def _ranked(infos: list[ColumnInfo]) -> list[ColumnInfo]:
    return [i for i in infos if i.kind in ("numeric", "boolean", "datetime")]


def _heavy(infos: list[ColumnInfo]) -> list[ColumnInfo]:
    """Columns whose values a summary can hold: all but nested ones and those compared by their JSON."""
    return [i for i in infos if i.kind != "other"]


def _value_key(i: ColumnInfo) -> str:
    """A column's value as one key: long, double, or text (long texts by their digest) (SQL)."""
    field, x = _typed(i)
    return {"l": x, "d": f"CASE WHEN {x} = 0 THEN 0D ELSE {x} END", "s": _digest(x)}[field]


def _sketches(src: DataFrame, ranked: list[ColumnInfo], heavy: list[ColumnInfo]) -> dict:
    """Bracket ends (``_<ordinal>_ends``) and heavy hitters (``_<ordinal>_top``) of columns, from one scan.
    Tasks are merged in ``SLOTS`` groups first, so the last task reads a bounded number of sketches."""
    first, last = ["count(1) AS _rows"], ["sum(_rows) AS _rows"]
    for i in ranked:
        first += [f"kll_sketch_agg_double({_number(i)}, {RK.SKETCH_K}) AS k{i.ordinal}", f"count({_number(i)}) AS n{i.ordinal}"]
        ends = RK.bracket_ends(f"kll_merge_agg_double(k{i.ordinal}, {RK.SKETCH_K})", PROBS)
        last.append(f"CASE WHEN sum(n{i.ordinal}) > 0 THEN {ends} END AS _{i.ordinal}_ends")
    for i in heavy:
        first.append(f"approx_top_k_accumulate({_value_key(i)}, {TRACKED}) AS h{i.ordinal}")
        last.append(f"CASE WHEN sum(_rows) > 0 THEN approx_top_k_estimate(approx_top_k_combine(h{i.ordinal}, {TRACKED}), {CANDIDATES}) END AS _{i.ordinal}_top")
    slots = src.withColumn("_slot", F.expr(f"pmod(spark_partition_id(), {SLOTS})")).groupBy("_slot").agg(*map(F.expr, first))
    return slots.agg(*map(F.expr, last)).first().asDict()


def _heavy_error() -> float:
    """Share of the rows by which a summary of ``TRACKED`` counters can miss a count."""
    size = 1
    while size * 0.75 < TRACKED:
        size *= 2
    return 3.5 / size


_MEASURED = "q1 double, median double, q3 double, outliers long, _len_dev long, _mode string, mode_count long"


def _measured(src: DataFrame, infos: list[ColumnInfo], parts: set) -> tuple[DataFrame, list[ColumnInfo]]:
    """The plain numbers with quartiles, outliers, length deviations and modes, one row a column, and
    the columns whose mode is not settled.  Three scans, run here: plain aggregates and sketches; the
    values inside the brackets; one plain aggregate with all of that as literals."""
    wide = _wide(src, infos, parts).selectExpr(f"inline({_plain_rows(infos, parts)})")
    plain = {r["ci"]: r for r in wide.collect()}                      # one row a column
    nonnull = {c: r["total_count"] - r["null_count"] for c, r in plain.items()}
    found: dict[int, dict] = {i.ordinal: dict.fromkeys(("q1", "median", "q3", "outliers", "_len_dev", "_mode", "mode_count")) for i in infos}

    # a column of few values is counted whole, without a sketch
    ranked = [i for i in _ranked(infos) if "quartiles" in parts]
    large = [i for i in ranked if nonnull[i.ordinal] > RK.FEW]
    heavy = [i for i in _heavy(infos) if "heavy" in parts and nonnull[i.ordinal]]
    one = _sketches(src, large, heavy) if large or heavy else {}
    quart = RK.quantiles(src, {i.ordinal: _number(i) for i in ranked}, {i.ordinal: nonnull[i.ordinal] for i in ranked},
                         {i.ordinal: one[f"_{i.ordinal}_ends"] for i in large}, list(PROBS))
    for c, q in quart.items():
        found[c].update(zip(("q1", "median", "q3"), q))

    aggs, take, tops = [], [], {}
    for i in infos:
        o, c, q = i.ordinal, quoted(i.name), found[i.ordinal]
        mean = plain[o]["_len_mean"]
        if mean is not None:
            aggs.append(f"count_if(abs(length({c}) - {mean!r}D) > {mean * K.LENGTH_DEVIATION_SHARE!r}D) AS _{o}_dev")
            take.append((o, "_len_dev", f"_{o}_dev"))
        if "outliers" in parts and i.kind in ("numeric", "boolean") and q["q1"] is not None:
            step, x = K.IQR_FACTOR * (q["q3"] - q["q1"]), _number(i)
            aggs.append(f"count_if({x} < {RK.literal(q['q1'] - step)} OR {x} > {RK.literal(q['q3'] + step)}) AS _{o}_out")
            take.append((o, "outliers", f"_{o}_out"))
        if i in heavy:
            tops[o] = [t for t in one[f"_{o}_top"] or [] if t["item"] is not None]
            for k, t in enumerate(tops[o]):
                is_it = F.expr(_value_key(i)) == F.lit(t["item"])
                aggs += [F.count_if(is_it).alias(f"_{o}_n{k}"), F.min(F.when(is_it, _as_text(i))).alias(f"_{o}_v{k}")]
    if aggs:
        exact = src.agg(*[F.expr(a) if isinstance(a, str) else a for a in aggs]).first()
        for o, name, col in take:
            found[o][name] = exact[col]
        for o in tops:
            tops[o] = [(exact[f"_{o}_n{k}"], t["item"], exact[f"_{o}_v{k}"]) for k, t in enumerate(tops[o])]

    unsettled = []
    for i in infos:
        o = i.ordinal
        if o not in tops:
            if nonnull[o]:
                unsettled.append(i)
            continue
        listed = one[f"_{o}_top"] or []
        # a value outside the candidates is counted by the summary below the last of them, or not at all
        others = max(2 * _heavy_error() * plain[o]["total_count"], listed[-1]["count"] if len(listed) >= CANDIDATES else 0)
        best = max((n for n, _, _ in tops[o]), default=0)
        if best > others:
            order = {"text": lambda t: t[2].encode()}.get(i.kind, lambda t: t[1])
            if isinstance(i.dtype, T.DecimalType):
                order = lambda t: (float(t[2]), t[2])
            found[o].update(_mode=min((t for t in tops[o] if t[0] == best), key=order)[2], mode_count=best)
        elif nonnull[o]:
            unsettled.append(i)
    schema = T.StructType(wide.schema.fields + T.StructType.fromDDL(_MEASURED).fields)
    data = [tuple(plain[i.ordinal]) + tuple(found[i.ordinal].values()) for i in infos]
    return src.sparkSession.createDataFrame(data, schema), unsettled


def _of_values(freq: DataFrame) -> DataFrame:
    """Distinct count and mode of each column, from its value table."""
    order = F.struct((-F.col("cnt")).alias("a"), "l", "d", "vn", "v")
    return freq.groupBy("ci").agg(F.count(F.lit(1)).alias("distinct_count"), F.min_by("v", order).alias("_mode"), F.max("cnt").alias("mode_count"))


def _distinct(src: DataFrame, infos: list[ColumnInfo]) -> DataFrame:
    filled = F.coalesce(F.col("s").isNotNull() | F.col("d").isNotNull() | F.col("l").isNotNull(), F.lit(False))
    return (src.select(_records(infos, digest=True)).groupBy("ci", "s", "d", "l").agg(F.lit(1).alias("_one"))
            .groupBy("ci").agg(F.count_if(filled).alias("distinct_count")))


def _samples(freq: DataFrame, k: int) -> DataFrame:
    """First distinct values in value order (numbers numerically)."""
    order = [F.col(c).asc_nulls_last() for c in ("l", "d", "vn")] + [F.col("v")]
    top = first_rows(freq, ["ci"], order, k, rank="_rk")
    return top.groupBy("ci").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rk", "v"))), lambda x: x["v"]).alias("_samp"))


def case_flags(text: Column) -> tuple[Column, Column, Column, Column]:
    alpha = text.rlike(ALPHA_PATTERN)
    is_up = alpha & (F.upper(text) == text) & (F.lower(text) != text)
    is_low = alpha & ~is_up & (F.lower(text) == text) & (F.upper(text) != text)
    is_title = alpha & ~is_up & ~is_low & (F.initcap(text) == text)
    is_mixed = alpha & ~is_up & ~is_low & ~is_title
    return is_up, is_low, is_title, is_mixed


def _ts_from_micros(micros: Column, is_ltz: Column) -> Column:
    """Datetime statistics are reported as wall-clock ``timestamp_ntz``."""
    epoch = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    return F.timestamp_add("MICROSECOND", micros, epoch)


def _finish(j: DataFrame) -> DataFrame:
    kind = F.col("kind")
    total = F.coalesce(F.col("total_count"), F.lit(0)).cast("long")
    nulls = F.coalesce(F.col("null_count"), F.lit(0)).cast("long")
    nonnull = total - nulls
    distinct = F.coalesce(F.col("distinct_count"), F.lit(0)).cast("long")
    completeness = F.coalesce(F.try_divide(nonnull, total) * 100, F.lit(0.0))
    uniqueness = F.coalesce(F.try_divide(distinct, total) * 100, F.lit(0.0))
    is_num = kind.isin("numeric", "boolean")
    std = F.when(is_num & (nonnull > 1), F.col("std"))
    ntext = nonnull

    # K1 pieces
    email_check = F.lower(F.col("column")).contains("email") | F.coalesce(F.col("_any_at"), F.lit(False))
    email_issues = F.when(email_check, F.col("_bad_email")).otherwise(F.lit(0))
    text_score = F.greatest(F.lit(0.0), 100 - email_issues / ntext * 100)
    out_pct = F.col("outliers") / nonnull * 100
    num_score = F.when(nonnull > 2, F.greatest(F.lit(float(K.NUMERIC_CONSISTENCY_FLOOR)),
                                               100 - out_pct * K.OUTLIER_PENALTY)) \
        .otherwise(F.lit(100.0))
    bool_score = F.when(nonnull > 2, F.lit(K.OTHER_TYPE_CONSISTENCY)).otherwise(F.lit(100.0))
    k1 = (F.when(nonnull == 0, F.lit(0.0))
          .when(kind == "text", text_score)
          .when(kind == "numeric", num_score)
          .when(kind == "boolean", bool_score)
          .otherwise(F.lit(K.OTHER_TYPE_CONSISTENCY)))

    # K2 = K1 + length and case penalties for text
    len_issues = F.when((ntext > K.LENGTH_MIN_SAMPLE) & (F.col("_len_mean") > K.LENGTH_MIN_MEAN),
                        F.col("_len_dev") * K.LENGTH_PENALTY).otherwise(F.lit(0.0))
    alpha_total = F.col("_up") + F.col("_low") + F.col("_title") + F.col("_mixed")
    used = sum((qcol(c) > 0).cast("int") for c in ("_up", "_low", "_title", "_mixed"))
    case_issues = F.when((alpha_total > K.CASE_MIN_ALPHA) & (used > K.CASE_MAX_PATTERNS),
                         alpha_total * K.CASE_PENALTY).otherwise(F.lit(0.0))
    text_score2 = F.greatest(F.lit(0.0),
                             100 - (email_issues + len_issues + case_issues) / ntext * 100)
    k2 = F.when((nonnull > 0) & (kind == "text"), text_score2).otherwise(k1)

    # K4: leading/trailing whitespace in text
    k4 = (F.when(nonnull == 0, F.lit(0.0))
          .when(kind == "text", F.greatest(F.lit(0.0), 100 - F.col("_ws") / ntext * 100))
          .otherwise(F.lit(100.0)))

    label_a = F.coalesce(F.col("label_a"),
                         F.when((nonnull > 0) & F.coalesce(F.col("_boolish"), F.lit(False)),
                                F.lit(K.TYPE_BOOLEAN)).otherwise(F.lit(K.TYPE_TEXT)))

    is_dt = kind == "datetime"
    dmin = _ts_from_micros(F.col("_tmin"), F.col("is_ltz"))
    dmax = _ts_from_micros(F.col("_tmax"), F.col("is_ltz"))
    dmed = _ts_from_micros(F.round(F.col("median")).cast("long"), F.col("is_ltz"))
    mode_text = F.when(kind == "text",
                       F.when(F.col("mode_count") > 1, F.col("_mode")).otherwise(F.lit("N/A")))
    ltz_mode = F.date_format(_ts_from_micros(F.col("_mode").cast("long"), F.col("is_ltz")),
                             "yyyy-MM-dd HH:mm:ss")
    mode_dt = F.when(is_dt, F.when(F.col("is_ltz"), ltz_mode).otherwise(F.col("_mode")))
    mode = F.coalesce(mode_text, mode_dt, F.when(nonnull > 0, F.col("_mode")), F.lit("N/A"))

    return j.select(
        "ordinal", "column", "spark_type", "kind",
        label_a.alias("data_type"), "data_type_b", "data_type_c",
        total.alias("total_count"), nulls.alias("null_count"), nonnull.alias("non_null_count"),
        distinct.alias("distinct_count"),
        completeness.alias("completeness"), uniqueness.alias("uniqueness"),
        F.when(is_num, F.col("mean")).alias("mean"),
        F.when(is_num, F.col("median")).alias("median"),
        std.alias("std"),
        F.when(is_num, F.col("min")).alias("min"),
        F.when(is_num, F.col("max")).alias("max"),
        F.when(is_num, F.col("min_value")).alias("min_value"),
        F.when(is_num, F.col("max_value")).alias("max_value"),
        F.when(is_num, F.col("q1")).alias("q1"),
        F.when(is_num, F.col("q3")).alias("q3"),
        F.when(is_num, F.coalesce(F.col("outliers"), F.lit(0))).cast("long").alias("outliers"),
        F.when(is_dt, dmin).alias("date_min"),
        F.when(is_dt, dmax).alias("date_max"),
        F.when(is_dt, dmed).alias("date_median"),
        F.when(is_dt, F.timestamp_diff("DAY", dmin, dmax)).alias("date_range_days"),
        mode.alias("mode"),
        F.coalesce(F.col("mode_count"), F.lit(0)).cast("long").alias("mode_count"),
        F.coalesce(F.col("_samp"), F.array().cast("array<string>")).alias("sample_values"),
        k1.alias("consistency_standard"), k2.alias("consistency_extended"),
        k4.alias("consistency_whitespace"), F.lit(100.0).alias("consistency_type_share"),
    )


def column_info_table(df: DataFrame) -> DataFrame:
    """Column, type, non-null, null and unique counts."""
    p = profile(df, only=["column", "spark_type", "non_null_count", "null_count", "distinct_count"])
    return p.select(F.col("column"), F.col("spark_type").alias("data_type"),
                    F.col("non_null_count"), F.col("null_count"),
                    F.col("distinct_count").alias("unique_values"))


def top_values(df: DataFrame, column: str, k: int = K.TOP_VALUES_FOR_SETS) -> DataFrame:
    """Up to ``k`` distinct non-null values (value order) offered for sets.

    A top-k is the feature here: ``orderBy().limit(k)`` keeps ``k`` rows per
    task before the final merge.
    """
    return (df.select(qcol(column).alias("value")).filter(F.col("value").isNotNull())
            .distinct().orderBy("value").limit(k))


def dataset_metrics(df: DataFrame, normalize: bool = True) -> DataFrame:
    """Rows, columns, cells, null cells, cell completeness, number of types.

    One aggregate over the data; the type count comes from the schema.
    """
    src = P.normalize_nan(df) if normalize else df
    ncols = len(src.columns)
    ntypes = len({f.dataType.simpleString() for f in src.schema.fields})
    nulls = [F.count_if(qcol(c).isNull()) for c in src.columns]
    null_cells = nulls[0] if nulls else F.lit(0)
    for e in nulls[1:]:
        null_cells = null_cells + e
    agg = src.agg(F.count(F.lit(1)).alias("total_rows"), null_cells.cast("long").alias("null_cells"))
    cells = F.col("total_rows") * ncols
    return agg.select(
        "total_rows", F.lit(ncols).alias("total_columns"), cells.cast("long").alias("total_cells"),
        "null_cells",
        F.coalesce(F.try_divide(cells - F.col("null_cells"), cells) * 100, F.lit(0.0))
        .alias("cell_completeness"),
        F.lit(ntypes).alias("dtype_count"))
