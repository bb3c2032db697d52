"""Column predicates shared by scored rules and row-level flags.

Every builder returns a boolean ``Column`` that is NULL when the input value is
NULL.  The two null policies are applied on top:

* ``scored``  – rule scorecards: a NULL value fails (``coalesce(p, false)``).
* ``flagged`` – row-level flags: a NULL value passes (``p or col is null``).
"""

from __future__ import annotations

import datetime as _dt
import math
import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import qcol

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, DATETIME_TYPES)


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def is_boolean(dt: T.DataType) -> bool:
    return isinstance(dt, T.BooleanType)


def column_type(df: DataFrame, name: str) -> T.DataType:
    try:
        return df.schema[name].dataType
    except KeyError as exc:  # pragma: no cover - message only
        raise KeyError(f"column {name!r} not in {df.columns}") from exc


# --------------------------------------------------------------------------
# NaN counts as missing everywhere.
# --------------------------------------------------------------------------
def normalize_nan(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Turn NaN into NULL on float/double columns (one projection, no shuffle)."""
    wanted = set(columns or df.columns)
    exprs = []
    changed = False
    for f in df.schema.fields:
        if f.name in wanted and isinstance(f.dataType, FLOAT_TYPES):
            exprs.append(F.when(F.isnan(qcol(f.name)), F.lit(None).cast(f.dataType))
                         .otherwise(qcol(f.name)).alias(f.name))
            changed = True
        else:
            exprs.append(qcol(f.name))
    return df.select(*exprs) if changed else df


# --------------------------------------------------------------------------
# Null policies
# --------------------------------------------------------------------------
def scored(pred: Column) -> Column:
    """Rule scorecards: NULL (unknown) fails."""
    return F.coalesce(pred, F.lit(False))


def flagged(pred: Column, *cols: Column) -> Column:
    """Row flags: a NULL input value passes."""
    nulls = [c.isNull() for c in cols]
    out = F.coalesce(pred, F.lit(False))
    for n in nulls:
        out = out | n
    return out


# --------------------------------------------------------------------------
# Allowed set
# --------------------------------------------------------------------------
def _is_null_value(v) -> bool:
    return v is None or (isinstance(v, float) and math.isnan(v))


def _as_type(v, dt: T.DataType):
    """``v`` as a value of ``dt`` that it equals, or None if no value of the type does
    (1.5 among integers, text among numbers).  ``True`` equals 1, as in Python."""
    if is_string(dt):
        return v if isinstance(v, str) else None
    if is_boolean(dt):
        return bool(v) if isinstance(v, (bool, int, float, Decimal)) and v in (0, 1) else None
    if is_numeric(dt):
        if not isinstance(v, (bool, int, float, Decimal)) or (isinstance(v, float) and math.isinf(v) and not isinstance(dt, FLOAT_TYPES)):
            return None
        if isinstance(dt, INTEGRAL_TYPES):
            bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}[type(dt)]
            return int(v) if v == int(v) and -(1 << bits) <= v < 1 << bits else None
        if isinstance(dt, FLOAT_TYPES):
            try:
                return float(v) if float(v) == v else None
            except OverflowError:
                return None
        exact = Decimal(repr(v)) if isinstance(v, float) else Decimal(int(v)) if isinstance(v, bool) else Decimal(v)
        small = abs(exact) < Decimal(10) ** (dt.precision - dt.scale)
        return exact if small and exact == round(exact, dt.scale) else None
    if is_datetime(dt):
        if not isinstance(v, (str, _dt.date)):
            return None
        try:
            return _to_python_datetime(v)
        except ValueError:
            return None
    return v


def in_set(col: Column, values, dt: T.DataType) -> Column:
    """Membership in a list of any length: every listed value is first taken as a value of the
    column's type without loss, and dropped where no value of the type equals it."""
    values = list(values)
    allow_null = any(_is_null_value(v) for v in values)
    typed = [_as_type(v, dt) for v in values if not _is_null_value(v)]
    typed = [v for v in typed if v is not None]
    if not typed:
        pred = F.lit(False)
    elif is_datetime(dt):
        kind = T.TimestampNTZType() if isinstance(dt, T.DateType) else dt
        pred = (col.cast("timestamp_ntz") if isinstance(dt, T.DateType) else col).isin(
            [date_bounds(kind, v, v)[0] for v in dict.fromkeys(typed)])
    else:
        try:
            typed = list(dict.fromkeys(typed))
        except TypeError:                       # unhashable values (arrays, structs)
            pass
        pred = (col.cast("double") if isinstance(dt, T.FloatType) else col).isin(typed)
    if allow_null:
        # a listed None/NaN matches missing values (pandas isin semantics)
        pred = col.isNull() | F.coalesce(pred, F.lit(False))
    return pred


# --------------------------------------------------------------------------
# Regular expressions
# --------------------------------------------------------------------------
_NAMED_GROUP = re.compile(r"\(\?P<([A-Za-z_][A-Za-z0-9_]*)>")
_NAMED_BACKREF = re.compile(r"\(\?P=([A-Za-z_][A-Za-z0-9_]*)\)")


def check_regex(pattern: str) -> None:
    """Raise ``re.error`` for a pattern Python itself would refuse."""
    re.compile(pattern)


def java_regex(pattern: str) -> str:
    """Python ``re.match`` semantics as a Java pattern usable in ``rlike``.

    ``re.match`` anchors at the start only; ``rlike`` is a find.  ``(?U)`` gives
    Unicode ``\\d \\w \\s`` as Python 3 str patterns have, ``(?d)`` makes ``$`` and
    ``.`` treat only ``\\n`` as a line end, as Python does.
    """
    p = _NAMED_GROUP.sub(r"(?<\1>", pattern)
    p = _NAMED_BACKREF.sub(r"\\k<\1>", p)
    p = re.sub(r"\\(.)", lambda m: r"\z" if m.group(1) == "Z" else m.group(0), p, flags=re.S)
    return "(?dU)^(?:" + p + ")"


def regex_match(col: Column, pattern: str) -> Column:
    """``re.match(pattern, str(value))`` for every value; NULL stays NULL."""
    return col.cast("string").rlike(java_regex(pattern))


# --------------------------------------------------------------------------
# Ranges (R5, R11)
# --------------------------------------------------------------------------
def _is_number(v) -> bool:
    return isinstance(v, (int, float, Decimal)) and not isinstance(v, bool)


def range_comparable(dt: T.DataType, lo, hi) -> bool:
    if is_numeric(dt):
        return _is_number(lo) and _is_number(hi)
    if is_string(dt):
        return isinstance(lo, str) and isinstance(hi, str)
    if is_datetime(dt):
        return all(isinstance(v, (str, _dt.date)) for v in (lo, hi))
    return False


def in_range(col: Column, dt: T.DataType, lo, hi) -> Column:
    """Inclusive ``lo <= value <= hi``; refuses incomparable types up front."""
    if not range_comparable(dt, lo, hi):
        raise TypeError(f"range ({lo!r}, {hi!r}) is not comparable with {dt.simpleString()}")
    if is_datetime(dt):
        lo_c, hi_c = date_bounds(dt, lo, hi)
        return col.between(lo_c, hi_c)
    return col.between(F.lit(lo), F.lit(hi))


# --------------------------------------------------------------------------
# Date ranges
# --------------------------------------------------------------------------
def parse_datetime(col: Column, dt: T.DataType, fmt: str | None = None) -> Column:
    """Parseable dates of a column as timestamps; junk and NULL become NULL.

    Text is read as wall-clock time (``timestamp_ntz``) so that the answer does
    not depend on the session time zone.
    """
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return col
    if isinstance(dt, T.DateType):
        return col.cast("timestamp_ntz")
    if is_string(dt):
        if fmt:
            return F.try_to_timestamp(col, F.lit(fmt)).cast("timestamp_ntz")
        return col.try_cast("timestamp_ntz")
    raise TypeError(f"cannot read dates from a {dt.simpleString()} column")


def _to_python_datetime(v) -> _dt.datetime:
    if isinstance(v, _dt.datetime):
        return v
    if isinstance(v, _dt.date):
        return _dt.datetime(v.year, v.month, v.day)
    s = str(v).strip().replace("Z", "+00:00")
    return _dt.datetime.fromisoformat(s)


def date_bounds(dt: T.DataType, lo, hi) -> tuple[Column, Column]:
    """Bounds as literals of the column's timestamp kind.

    * naive data (``timestamp_ntz``/date/text) and aware bounds: drop the zone,
      keep the wall time;
    * aware data (``timestamp``) and naive bounds: the bounds are UTC.
    """
    out = []
    for v in (lo, hi):
        d = _to_python_datetime(v)
        if isinstance(dt, T.TimestampType):
            if d.tzinfo is None:
                d = d.replace(tzinfo=_dt.timezone.utc)
            s = d.astimezone(_dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
            out.append(F.expr(f"TIMESTAMP '{s}+00:00'"))
        else:
            s = d.replace(tzinfo=None).strftime("%Y-%m-%d %H:%M:%S.%f")
            out.append(F.expr(f"TIMESTAMP_NTZ '{s}'"))
    return out[0], out[1]


# --------------------------------------------------------------------------
# Optional extras
# --------------------------------------------------------------------------
def looks_boolean(col: Column, dt: T.DataType) -> Column:
    if is_boolean(dt):
        return col.isNotNull()
    return F.lower(col.cast("string")).isin("true", "false")


def looks_numeric(col: Column, dt: T.DataType) -> Column:
    if is_numeric(dt):
        return col.isNotNull()
    return col.cast("string").rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")


def looks_datetime(col: Column, dt: T.DataType) -> Column:
    if is_datetime(dt):
        return col.isNotNull()
    return col.cast("string").try_cast("timestamp_ntz").isNotNull()
