"""Snapshots, tracking history and version comparison.

Snapshots are profiled together: every snapshot's rows become
``(seq, column, value)`` records and one ``groupBy`` over all of them yields
per-snapshot, per-column counts -- one shuffle however many snapshots there
are.  Snapshots may have different columns; each contributes records only
for the columns it has.

The history itself (tracking entries, snapshot tables) is small: one row per
run or snapshot.  Windows over it are partitioned by version / dataset.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql import types as T

from ..functions.onerow import beside
from ..functions.names import qcol
from ..functions.topk import first_rows
from ..functions import constants as K
from ..functions import predicates as P
from ..functions.ordered import ordered_mean
from .profile import ColumnInfo, _as_text, label_c

r1 = lambda c: F.bround(c, 1)  # noqa: E731 - presentation rounding
r2 = lambda c: F.bround(c, 2)


# --------------------------------------------------------------------------
# Snapshot records
# --------------------------------------------------------------------------
def _records(df: DataFrame, seq: Column, columns: list[tuple[str, T.DataType]],
             absent: dict[str, list[int]] | None = None) -> DataFrame:
    """``(seq, column, v)`` per row and column; ``absent[c]`` lists the
    snapshots (``seq`` values) that do not have column ``c``."""
    recs = [F.struct(F.lit(c).alias("column"), _as_text(ColumnInfo(0, c, dt)).alias("v"))
            for c, dt in columns]
    arr = F.array(*recs)
    if absent:
        def keep(s):
            out = F.lit(True)
            for c, seqs in absent.items():
                out = F.when(s["column"] == c, ~seq.isin(seqs)).otherwise(out)
            return out
        arr = F.filter(arr, keep)
    return df.select(seq.alias("seq"), F.inline(arr))


def snapshot_records_from_frames(frames: list[tuple[str, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """S5 input: one DataFrame per snapshot (schemas may differ), in order.
    Returns the record table and the snapshot schema table."""
    parts, schema_rows = [], []
    for i, (name, df) in enumerate(frames, start=1):
        df = P.normalize_nan(df)
        cols = [(f.name, f.dataType) for f in df.schema.fields]
        parts.append(_records(df, F.lit(i), cols))
        schema_rows += [(i, name, f.name, f.dataType.simpleString(), label_c(f.dataType), j)
                        for j, f in enumerate(df.schema.fields)]
    recs = reduce(DataFrame.unionByName, parts)
    spark = frames[0][1].sparkSession
    return recs, spark.createDataFrame(schema_rows, SCHEMA_TABLE)


SCHEMA_TABLE = "seq int, snapshot string, column string, dtype string, data_type string, ordinal int"


def snapshot_freq(records: DataFrame, materialize: str = "none") -> DataFrame:
    """``(seq, column, v, cnt)``: value counts per snapshot and column (one
    shuffle, map-side combined).  ``materialize="checkpoint"`` writes it once
    to the session's checkpoint folder so that every statistic derived from
    it reads the checkpoint instead of scanning the source again."""
    freq = records.groupBy("seq", "column", "v").agg(F.count(F.lit(1)).alias("cnt"))
    if materialize == "checkpoint":
        from ..session import ensure_checkpoint_dir
        ensure_checkpoint_dir(records.sparkSession)
        return freq.checkpoint(eager=True)
    if materialize == "persist":
        from pyspark import StorageLevel
        return freq.persist(StorageLevel.MEMORY_AND_DISK)
    return freq


def _as_freq(records_or_freq: DataFrame) -> DataFrame:
    """Accept either raw records or an already-built frequency table."""
    if "cnt" in records_or_freq.columns:
        return records_or_freq
    return snapshot_freq(records_or_freq)


def snapshot_records_from_column(df: DataFrame, seq: Column, prefix: str = "snapshot_",
                                 absent: dict[str, list[int]] | None = None,
                                 materialize: str = "checkpoint") -> tuple[DataFrame, DataFrame]:
    """Snapshots held in one table, told apart by the integer ``seq``
    expression.  ``absent[c]`` lists the snapshots without column ``c``;
    snapshot names are ``prefix + seq``.

    Returns ``(freq, schema)``: the snapshot frequency table (checkpointed by
    default, so the source is scanned once) and the snapshot schema table,
    whose snapshot list is read from that frequency table."""
    df = P.normalize_nan(df)
    cols = [(f.name, f.dataType) for f in df.schema.fields]
    freq = snapshot_freq(_records(df, seq, cols, absent), materialize)
    spark = df.sparkSession
    col_rows = [(f.name, f.dataType.simpleString(), label_c(f.dataType), j)
                for j, f in enumerate(df.schema.fields)]
    colmeta = spark.createDataFrame(col_rows, "column string, dtype string, data_type string, _o int")
    # every (snapshot, present column) pair has records in freq (absent columns
    # were dropped before counting); colmeta is one row per column
    present = freq.select(F.col("seq").cast("int").alias("seq"), "column").distinct()
    schema = present.join(colmeta, "column")
    w = Window.partitionBy("seq").orderBy("_o")
    schema = schema.select(
        "seq", F.concat(F.lit(prefix), F.col("seq").cast("string")).alias("snapshot"),
        "column", "dtype", "data_type", (F.row_number().over(w) - 1).cast("int").alias("ordinal"))
    return freq, schema


# --------------------------------------------------------------------------
# Per-snapshot metrics (U4, U5, H8, G17/G18 per snapshot)
# --------------------------------------------------------------------------
def snapshot_column_stats(records: DataFrame) -> DataFrame:
    """``(seq, column, total, nulls, distinct)`` from the records or their
    frequency table (partial aggregation throughout)."""
    freq = _as_freq(records)
    return freq.groupBy("seq", "column").agg(
        F.sum("cnt").alias("total"),
        F.sum(F.when(F.col("v").isNull(), F.col("cnt")).otherwise(F.lit(0))).alias("nulls"),
        F.count("v").alias("distinct"))


def snapshot_table(records: DataFrame, schema: DataFrame) -> DataFrame:
    """U4: one row per snapshot: name, rows, columns, completeness, uniqueness,
    score (H8), null cells and cell completeness; ordered by ``seq``."""
    cs = snapshot_column_stats(records)
    percol = cs.select(
        "seq", "column", "total", "nulls",
        r1(F.coalesce(F.try_divide(F.col("total") - F.col("nulls"), F.col("total")) * 100,
                      F.lit(0.0))).alias("c"),
        r1(F.coalesce(F.try_divide(F.col("distinct"), F.col("total")) * 100, F.lit(0.0))).alias("u"))
    # per-column scores are averaged in column order (see functions.ordered)
    percol = percol.join(schema.select("seq", "column", "ordinal"), ["seq", "column"],
                         "left")
    o = F.col("ordinal")
    per = percol.groupBy("seq").agg(
        F.max("total").alias("row_count"), ordered_mean(F.col("c"), o).alias("_c"),
        ordered_mean(F.col("u"), o).alias("_u"),
        F.sum("nulls").alias("null_cells"))
    names = schema.groupBy("seq", "snapshot").agg(F.count(F.lit(1)).alias("column_count"))
    j = names.join(per, "seq", "left")
    comp, uniq = r1(F.coalesce(F.col("_c"), F.lit(0.0))), r1(F.coalesce(F.col("_u"), F.lit(0.0)))
    rows = F.coalesce(F.col("row_count"), F.lit(0)).cast("long")
    cells = rows * F.col("column_count")
    return j.select(
        "seq", "snapshot", rows.alias("row_count"), F.col("column_count").cast("long").alias("column_count"),
        comp.alias("completeness"), uniq.alias("uniqueness"),
        r1((comp + uniq) / 2).alias("overall_score"),
        F.coalesce(F.col("null_cells"), F.lit(0)).cast("long").alias("null_cells"),
        F.coalesce(F.try_divide(cells - F.col("null_cells"), cells) * 100, F.lit(0.0))
        .alias("cell_completeness"))


def snapshot_type_distribution(schema: DataFrame) -> DataFrame:
    """G18 per snapshot: columns per type label and share of the snapshot's columns."""
    n = schema.groupBy("seq", "snapshot", "data_type").agg(F.count(F.lit(1)).alias("count"))
    tot = schema.groupBy("seq").agg(F.count(F.lit(1)).alias("_n"))
    return n.join(tot, "seq").select("seq", "snapshot", "data_type", "count",
                                     r1(F.col("count") / F.col("_n") * 100).alias("percentage"))


def type_pivot(schema: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Snapshot x type counts, missing -> 0.  Pass ``types`` to skip the
    extra job Spark runs to discover the pivot values."""
    n = schema.groupBy("seq", "snapshot", "data_type").agg(F.count(F.lit(1)).alias("count"))
    piv = n.groupBy("seq", "snapshot").pivot("data_type", types).sum("count")
    return piv.na.fill(0)


def schema_diff(schema: DataFrame, seq_a: int, seq_b: int) -> DataFrame:
    """Common / added / removed columns between two snapshots."""
    seq = F.col("seq")
    g = (schema.filter(seq.isin(seq_a, seq_b)).groupBy("column")
         .agg(F.max(seq == seq_a).alias("_a"), F.max(seq == seq_b).alias("_b")))
    return g.select("column",
                    F.when(~F.col("_a"), F.lit("added"))
                    .when(~F.col("_b"), F.lit("removed"))
                    .otherwise(F.lit("common")).alias("status"))


def first_last(snapshots: DataFrame) -> DataFrame:
    """First vs last snapshot (by ``seq``): direction of the score (equal
    counts as down), row and column change, average score."""
    agg = snapshots.agg(
        F.min_by("overall_score", "seq").alias("_s0"), F.max_by("overall_score", "seq").alias("_s1"),
        F.min_by("row_count", "seq").alias("_r0"), F.max_by("row_count", "seq").alias("_r1"),
        F.min_by("column_count", "seq").alias("_c0"), F.max_by("column_count", "seq").alias("_c1"),
        F.avg("overall_score").alias("avg_score"), F.count(F.lit(1)).alias("snapshots"))
    return agg.select(
        "snapshots", "avg_score",
        F.when(F.col("_s1") > F.col("_s0"), F.lit("up")).otherwise(F.lit("down")).alias("score_trend"),
        F.col("_r1").alias("last_rows"), (F.col("_r1") - F.col("_r0")).alias("row_change"),
        F.col("_c1").alias("last_columns"), (F.col("_c1") - F.col("_c0")).alias("column_change"))


def pair_diff(snapshots: DataFrame, name_a: str, name_b: str) -> DataFrame:
    """Score, completeness, uniqueness and row deltas between two snapshots."""
    fields = ["snapshot", "overall_score", "completeness", "uniqueness", "row_count"]

    def side(name, tag):
        return snapshots.filter(F.col("snapshot") == name).select(
            *[F.col(f).alias(f"{tag}_{f}") for f in fields])

    j = beside(side(name_a, "a"), side(name_b, "b"))  # one row each (names are unique)
    return j.select(
        F.col("a_snapshot").alias("snapshot_a"), F.col("b_snapshot").alias("snapshot_b"),
        (F.col("b_overall_score") - F.col("a_overall_score")).alias("score_change"),
        (F.col("b_completeness") - F.col("a_completeness")).alias("completeness_change"),
        (F.col("b_uniqueness") - F.col("a_uniqueness")).alias("uniqueness_change"),
        (F.col("b_row_count") - F.col("a_row_count")).alias("row_change"))


# --------------------------------------------------------------------------
# Tracking entries (U6, U7, U8) -- one per (dataset, version) run
# --------------------------------------------------------------------------
def schema_fingerprint(schema: DataFrame) -> DataFrame:
    """U8: ``name:type|...`` sorted by name, per snapshot."""
    return schema.groupBy("seq").agg(
        F.concat_ws("|", F.array_sort(F.collect_list(F.concat_ws(":", "column", "dtype"))))
        .alias("schema_fingerprint"))


def field_statistics(records: DataFrame, schema: DataFrame) -> DataFrame:
    """Per snapshot and column: type, nulls, uniques, null % (2 dp) and for
    numeric columns mean / median / std (2 dp); plus the JSON text form."""
    from ..functions.quantile import exact_quantiles
    freq = _as_freq(records)
    numeric = schema.filter(F.col("data_type").isin(K.TYPE_INTEGER, K.TYPE_DECIMAL)) \
        .select("seq", "column", F.lit(True).alias("_num"))
    f = freq.join(numeric, ["seq", "column"], "left") \
        .withColumn("vn", F.when(F.col("_num"), F.col("v").cast("double")))
    st = f.groupBy("seq", "column").agg(
        F.sum("cnt").alias("total"),
        F.sum(F.when(F.col("v").isNull(), F.col("cnt")).otherwise(F.lit(0))).alias("nulls"),
        F.count("v").alias("uniques"),
        (F.sum(F.col("vn") * F.col("cnt")) / F.sum(F.when(F.col("vn").isNotNull(), F.col("cnt"))))
        .alias("mean"),
        F.sum(F.when(F.col("vn").isNotNull(), F.col("cnt"))).alias("_n"))
    ss = f.join(st.select("seq", "column", "mean"), ["seq", "column"]).groupBy(
        "seq", "column").agg(F.sum(F.col("cnt") * (F.col("vn") - F.col("mean")) ** 2).alias("_ss"))
    med = exact_quantiles(f.select("seq", "column", "vn", "cnt"), ["seq", "column"], "vn", "cnt",
                          [0.5]).select("seq", "column", F.col("quantile").alias("median"))
    j = (schema.join(st, ["seq", "column"], "left").join(ss, ["seq", "column"], "left")
         .join(med, ["seq", "column"], "left"))
    std = F.when(F.col("_n") > 1, F.sqrt(F.col("_ss") / (F.col("_n") - 1)))
    out = j.select(
        "seq", "column", F.col("dtype").alias("data_type"),
        F.coalesce("nulls", F.lit(0)).cast("long").alias("null_count"),
        F.coalesce("uniques", F.lit(0)).cast("long").alias("unique_count"),
        r2(F.coalesce(F.try_divide(F.col("nulls"), F.col("total")) * 100, F.lit(0.0)))
        .alias("null_percentage"),
        r2(F.col("mean")).alias("mean"), r2(F.col("median")).alias("median"), r2(std).alias("std"))
    return out


def field_statistics_json(stats: DataFrame) -> DataFrame:
    """U7 as JSON text per snapshot (``{column: {...}}``), as stored in history."""
    entry = F.struct("data_type", "null_count", "unique_count", "null_percentage", "mean",
                     "median", "std")
    return stats.groupBy("seq").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", entry)))))
        .alias("field_statistics"))


def tracking_entries(results_by: DataFrame, snapshots: DataFrame, fingerprints: DataFrame,
                     dataset_name: str, timestamps: DataFrame | None = None,
                     field_json: DataFrame | None = None, rule_order: str = "rule_seq") -> DataFrame:
    """One tracking entry per snapshot/version (``seq``).

    ``results_by`` is ``evaluate(..., by=["seq"])``; the score is the average
    success rate (100.0 with no rules), ``passed_validations`` counts rules at
    or above 90."""
    v = results_by.groupBy("seq").agg(
        F.count(F.lit(1)).alias("total_validations"),
        F.count_if(F.col("success_rate") >= K.PASSED_RULE_RATE).alias("passed_validations"),
        (ordered_mean(F.col("success_rate"), qcol(rule_order)) if rule_order in results_by.columns
         else F.avg("success_rate")).alias("_score"))
    j = snapshots.join(v, "seq", "left").join(fingerprints, "seq", "left")
    if timestamps is not None:
        j = j.join(timestamps, "seq", "left")
    else:
        j = j.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))
    if field_json is not None:
        j = j.join(field_json, "seq", "left")
    else:
        j = j.withColumn("field_statistics", F.lit(None).cast("string"))
    version = F.concat(F.lit("v"), F.col("seq").cast("string"))
    return j.select(
        "seq", "timestamp", F.lit(dataset_name).alias("dataset_name"),
        version.alias("dataset_version"),
        r1(F.coalesce(F.col("_score"), F.lit(100.0))).alias("overall_quality_score"),
        F.coalesce("total_validations", F.lit(0)).cast("long").alias("total_validations"),
        F.coalesce("passed_validations", F.lit(0)).cast("long").alias("passed_validations"),
        "row_count", "column_count",
        r1(F.col("cell_completeness")).alias("data_completeness"),
        "schema_fingerprint",
        F.concat_ws("_", F.lit(dataset_name), version, F.col("timestamp")).alias("snapshot_id"),
        F.col("field_statistics").isNotNull().alias("has_detailed_stats"),
        "field_statistics")


# --------------------------------------------------------------------------
# Windows over the history (W3, W4, W5, W6, W8) and summaries
# --------------------------------------------------------------------------
def latest_per_version(history: DataFrame, version: str = "dataset_version",
                       order: list[str] | None = None) -> DataFrame:
    """The most recent entry of each version (timestamp, then seq)."""
    order = order or ["timestamp", "seq"]
    w = Window.partitionBy(version).orderBy(*[F.desc(c) for c in order])
    return history.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def keep_last(history: DataFrame, n: int, order: str = "seq",
              partition: list[str] | None = None) -> DataFrame:
    """The last ``n`` entries by ``order`` (per ``partition``)."""
    return first_rows(history, list(partition or []), [F.desc(order)], n, "_rn").drop("_rn")


def snapshot_sample(df: DataFrame, key: str | list[str], n: int = K.SNAPSHOT_SAMPLE_ROWS) -> DataFrame:
    """The first ``n`` rows by an explicit key (a sample is the feature)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(*keys).limit(n)


def history_summary(history: DataFrame) -> DataFrame:
    """Runs and average / best / worst quality score."""
    s = F.col("overall_quality_score")
    return history.agg(F.count(F.lit(1)).alias("total_runs"), F.avg(s).alias("avg_quality"),
                       F.max(s).alias("best_quality"), F.min(s).alias("worst_quality"))


def version_diff(history: DataFrame, version_a: str, version_b: str) -> DataFrame:
    """Latest entry of each version and the deltas; a row with
    ``available = false`` when either version is missing."""
    latest = latest_per_version(history.filter(F.col("dataset_version").isin(version_a, version_b)))
    # at most one row per version after W3: one global aggregation picks each
    # side's values (and yields exactly one row, also when a side is missing)
    ver = F.col("dataset_version")
    fields = ["overall_quality_score", "row_count", "column_count", "data_completeness",
              "schema_fingerprint"]
    sides = latest.agg(
        F.count_if(ver == version_a).alias("_na"), F.count_if(ver == version_b).alias("_nb"),
        *[F.max(F.when(ver == v, F.col(c))).alias(f"{tag}_{c}")
          for tag, v in (("a", version_a), ("b", version_b)) for c in fields])

    def diff(c, t):
        return (F.col(f"b_{c}") - F.col(f"a_{c}")).cast(t)

    return sides.select(
        F.lit(version_a).alias("version_a"), F.lit(version_b).alias("version_b"),
        ((F.col("_na") > 0) & (F.col("_nb") > 0)).alias("available"),
        diff("overall_quality_score", "double").alias("quality_diff"),
        diff("row_count", "bigint").alias("row_diff"),
        diff("column_count", "bigint").alias("column_diff"),
        diff("data_completeness", "double").alias("completeness_diff"),
        (F.col("a_schema_fingerprint") != F.col("b_schema_fingerprint")).alias("schema_changed"))


FIELD_STATS_SCHEMA = T.MapType(T.StringType(), T.StructType([
    T.StructField("data_type", T.StringType()), T.StructField("null_count", T.LongType()),
    T.StructField("unique_count", T.LongType()), T.StructField("null_percentage", T.DoubleType()),
    T.StructField("mean", T.DoubleType()), T.StructField("median", T.DoubleType()),
    T.StructField("std", T.DoubleType())]))


def field_diff(history: DataFrame, version_a: str, version_b: str) -> DataFrame:
    """Per field of either version: types (``N/A`` if absent), null %
    change and unique-count change (absent counts as 0)."""
    latest = latest_per_version(history.filter(F.col("dataset_version").isin(version_a, version_b)))

    def fields(v: str, tag: str) -> DataFrame:
        e = latest.filter(F.col("dataset_version") == v).select(
            F.explode(F.from_json("field_statistics", FIELD_STATS_SCHEMA)).alias("field", "s"))
        return e.select(F.lit(tag).alias("_t"), "field", "s")

    # one row per field of either version: one grouping instead of a join
    t = F.col("_t")
    j = fields(version_a, "a").unionByName(fields(version_b, "b")).groupBy("field").agg(
        *[F.max(F.when(t == tag, F.col(f"s.{k}"))).alias(f"{n}_{tag}") for tag in ("a", "b")
          for k, n in (("data_type", "type"), ("null_percentage", "null"),
                       ("unique_count", "unique"))])
    return j.select(
        "field", F.coalesce("type_a", F.lit("N/A")).alias("version_a_type"),
        F.coalesce("type_b", F.lit("N/A")).alias("version_b_type"),
        (F.coalesce("null_b", F.lit(0.0)) - F.coalesce("null_a", F.lit(0.0))).alias("null_pct_change"),
        (F.coalesce("unique_b", F.lit(0)) - F.coalesce("unique_a", F.lit(0))).alias("unique_count_change"))


def append_entry(history: DataFrame | None, entry: DataFrame, keep: int | None = None) -> DataFrame:
    """Append; with ``keep`` also W4: keep the last ``keep`` entries."""
    out = entry if history is None else history.unionByName(entry, allowMissingColumns=True)
    return out if keep is None else keep_last(out, keep)


def tracking_entry(df: DataFrame, results: DataFrame, dataset_name: str,
                   dataset_version: str = "v1.0", detailed: bool = True,
                   timestamp: str | None = None) -> DataFrame:
    """U6 for one run over ``df``: the entry the history table appends.

    ``results`` is the run's rule-result table (``rules.evaluate``).  With
    ``detailed`` the entry carries the field statistics (U7, JSON text) and
    the schema fingerprint (U8); otherwise both are empty."""
    recs, schema = snapshot_records_from_frames([(dataset_name, df)])   # one snapshot, seq 1
    # two consumers (table, field statistics): materialise the counts once
    recs = snapshot_freq(recs, materialize="checkpoint" if detailed else "none")
    snaps = snapshot_table(recs, schema)
    res = results.withColumnRenamed("seq", "rule_seq").withColumn("seq", F.lit(1))
    spark = df.sparkSession
    if detailed:
        fps = schema_fingerprint(schema)
        fj = field_statistics_json(field_statistics(recs, schema))
    else:
        fps = spark.createDataFrame([(1, "")], "seq int, schema_fingerprint string")
        fj = None
    ts = (F.lit(timestamp) if timestamp is not None
          else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))
    stamps = spark.range(1).select(F.lit(1).alias("seq"), ts.alias("timestamp"))
    entry = tracking_entries(res, snaps, fps, dataset_name, timestamps=stamps, field_json=fj)
    stamp = F.regexp_replace(F.regexp_replace(F.col("timestamp"), "[-:]", ""), " ", "_")
    return entry.withColumn("dataset_version", F.lit(dataset_version)).withColumn(
        "snapshot_id", F.concat_ws("_", F.lit(dataset_name), F.lit(dataset_version), stamp))
