"""Opt-in approximate profile for very large tables (never the default).

Exact distinct counts and exact quartiles need every distinct value of every
column shuffled (the frequency table of ``profile``).  Here the input is read
twice and no value is shuffled: every aggregate is map-side partial with a
one-row result per task.

1. one ``agg``: row and null counts, HyperLogLog++ distinct counts
   (``approx_count_distinct``, relative error ``rsd``), exact
   mean / sample std / min / max, ``percentile_approx`` quartiles and
   median, and the whole-column text measures;
2. a second ``agg`` with the first row's results as literals: IQR outliers
   and text length deviation.

Modes and value samples need value frequencies and are not computed
(``NULL``).  Output columns follow ``profile``; ``approximate`` is true.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions import predicates as P
from ..functions.names import qcol
from .profile import WS_PATTERN, _finish, _meta_df, case_flags, columns_info


def profile_approx(df: DataFrame, columns: list[str] | None = None, rsd: float = 0.05,
                   accuracy: int = 10000, normalize: bool = True) -> DataFrame:
    """``rsd`` is the HyperLogLog++ relative standard deviation (Spark's
    default 0.05; 0.01 costs about ten times more per column)."""
    src = P.normalize_nan(df) if normalize else df
    infos = columns_info(src, columns)
    spark = src.sparkSession
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i in infos:
        c, k, p = qcol(i.name), i.kind, f"_{i.ordinal}_"
        aggs += [F.count(c).alias(p + "nn"), F.approx_count_distinct(c, rsd).alias(p + "nd")]
        if k in ("numeric", "boolean"):
            x = c.cast("double")
            aggs += [F.avg(x).alias(p + "mean"), F.stddev_samp(x).alias(p + "std"),
                     F.min(x).alias(p + "min"), F.max(x).alias(p + "max"),
                     F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy).alias(p + "q")]
        elif k == "datetime":
            x = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"),
                                 c.cast("timestamp_ntz")) if not isinstance(i.dtype, T.TimestampType) \
                else F.unix_micros(c)
            aggs += [F.min(x).alias(p + "tmin"), F.max(x).alias(p + "tmax"),
                     F.percentile_approx(x, [0.5], accuracy).alias(p + "tq")]
        elif k == "text":
            up, low, title, mixed = case_flags(c)
            aggs += [F.bool_or(c.contains("@")).alias(p + "at"),
                     F.count_if(c.contains("@") & ~c.rlike(K.EMAIL_PATTERN)).alias(p + "bad"),
                     F.count_if(c.rlike(WS_PATTERN)).alias(p + "ws"),
                     F.avg(F.length(c)).alias(p + "len"),
                     F.count_if(up).alias(p + "up"), F.count_if(low).alias(p + "low"),
                     F.count_if(title).alias(p + "title"), F.count_if(mixed).alias(p + "mixed"),
                     F.bool_and(F.lower(c).isin(K.BOOLEAN_TEXT_VALUES)).alias(p + "bool")]
    first = src.agg(*aggs).first()          # one row of per-column numbers

    second = [F.lit(0).alias("_z")]
    for i in infos:
        c, p = qcol(i.name), f"_{i.ordinal}_"
        if i.kind == "numeric" and first[p + "q"]:
            q1, q3 = first[p + "q"][0], first[p + "q"][2]
            lo, hi = q1 - K.IQR_FACTOR * (q3 - q1), q3 + K.IQR_FACTOR * (q3 - q1)
            x = c.cast("double")
            second.append(F.count_if((x < lo) | (x > hi)).alias(p + "out"))
        if i.kind == "text" and first[p + "len"] is not None:
            m = first[p + "len"]
            second.append(F.count_if(F.abs(F.length(c) - m) > m * K.LENGTH_DEVIATION_SHARE)
                          .alias(p + "dev"))
    extra = src.agg(*second).first()        # one row: outliers, length deviations

    rows = []
    for i in infos:
        p = f"_{i.ordinal}_"
        g = lambda name, row=first: row[p + name] if (p + name) in row.asDict() else None
        q = g("q") or [None, None, None]
        low, high = g("min"), g("max")
        rows.append((i.ordinal, first["_rows"], first["_rows"] - g("nn"), g("nd"), g("mean"), g("std"), low, high,
                     None if low is None else str(low), None if high is None else str(high),
                     q[0], q[1] if g("tq") is None else float(g("tq")[0]), q[2], g("out", extra), g("tmin"), g("tmax"),
                     g("at"), g("bad"), g("ws"), g("len"), g("dev", extra), g("up"), g("low"), g("title"), g("mixed"), g("bool")))
    schema = ("ci int, total_count long, null_count long, distinct_count long, mean double, std double, min double, max double, "
              "min_value string, max_value string, q1 double, median double, q3 double, outliers long, _tmin long, _tmax long, "
              "_any_at boolean, _bad_email long, _ws long, _len_mean double, _len_dev long, _up long, _low long, _title long, "
              "_mixed long, _boolish boolean")
    numbers = spark.createDataFrame(rows, schema)
    for name, kind in (("_mode", "string"), ("mode_count", "long"), ("_samp", "array<string>")):
        numbers = numbers.withColumn(name, F.lit(None).cast(kind))
    whole = _finish(_meta_df(spark, infos).join(numbers, F.col("ordinal") == F.col("ci")).drop("ci"))
    # no value table: modes and samples are unknown here
    return (whole.withColumn("mode", F.lit(None).cast("string")).withColumn("mode_count", F.lit(None).cast("long"))
            .withColumn("sample_values", F.lit(None).cast("array<string>")).withColumn("approximate", F.lit(True)))
