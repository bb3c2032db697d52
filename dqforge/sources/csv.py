"""CSV inputs (S1-S6): read as text, normalise missing-value tokens, infer
types the way a pandas CSV read does.

* S2: the NA tokens of a pandas read become NULL (exact match, no trimming).
* S3: one aggregate tests every text column against the type patterns:
  bool (only without NULLs) -> integer (only without NULLs, else float) ->
  float -> text.  Dates stay text.  An all-NULL column is a float column.
  The one-row answer (a few booleans per column) decides the casts.
"""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T

from ..functions.names import qcol
from ..functions import constants as K
from ..functions import predicates as P
from .records import csv_records, line_ends_open

BOOL_TOKENS = ["True", "False", "TRUE", "FALSE", "true", "false"]
INT_RE = r"^[+-]?\d+$"
FLOAT_RE = (r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?"
            r"|[iI]nf|INF|[iI]nfinity)$")
SNAPSHOT_DELIMITER = "---SNAPSHOT---"
# a doubled quote inside quotes is one quote
_CSV_OPTIONS = {"escape": '"', "quote": '"'}


# --------------------------------------------------------------- S2 -------
def normalize_na(df: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    toks = tokens if tokens is not None else K.NA_TOKENS
    out = []
    for f in df.schema.fields:
        c = qcol(f.name)
        if P.is_string(f.dataType):
            out.append(F.when(c.isin(toks), F.lit(None).cast("string")).otherwise(c).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


# --------------------------------------------------------------- S3 -------
def _kind_tests(c: Column) -> list[Column]:
    ok = lambda e: F.bool_and(c.isNull() | e)
    return [F.count(c), F.count(F.lit(1)), ok(c.isin(BOOL_TOKENS)),
            ok(c.rlike(INT_RE) & c.try_cast("bigint").isNotNull()),   # wider integers are floats
            ok(c.rlike(FLOAT_RE))]


def _decide(nonnull: int, total: int, is_bool: bool, is_int: bool, is_float: bool) -> str:
    if nonnull == 0:
        return "double" if total > 0 else "string"
    has_null = nonnull < total
    if is_bool and not has_null:
        return "boolean"
    if is_int:
        return "double" if has_null else "bigint"
    if is_float:
        return "double"
    return "string"


def inferred_types(df: DataFrame) -> dict[str, str]:
    """Column -> Spark type name for every text column (one aggregate job)."""
    cols = [f.name for f in df.schema.fields if P.is_string(f.dataType)]
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        for j, e in enumerate(_kind_tests(qcol(c))):
            aggs.append(e.alias(f"_t{i}_{j}"))
    row = df.agg(*aggs).first()  # one row: five numbers/flags per column
    out = {}
    for i, c in enumerate(cols):
        v = [row[f"_t{i}_{j}"] for j in range(5)]
        out[c] = _decide(v[0] or 0, v[1] or 0, bool(v[2]), bool(v[3]), bool(v[4]))
    return out


def cast_expr(c: Column, to: str) -> Column:
    if to == "boolean":
        return F.lower(c) == "true"
    return c.cast(to)


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.select(*[cast_expr(qcol(f.name), types[f.name]).alias(f.name)
                       if f.name in types else qcol(f.name) for f in df.schema.fields])


def infer_types(df: DataFrame) -> DataFrame:
    return apply_types(df, inferred_types(df))


# --------------------------------------------------------------- S1 -------
def dedupe_names(names: list[str]) -> list[str]:
    """Repeated header names become ``a, a.1, a.2`` (as a pandas read names
    them), not Spark's ``a0, a4``."""
    seen: dict[str, int] = {}
    taken = set(names)
    out = []
    for n in names:
        if n not in seen:
            seen[n] = 0
            out.append(n)
            continue
        k = seen[n] + 1
        while f"{n}.{k}" in taken:
            k += 1
        seen[n] = k
        taken.add(f"{n}.{k}")
        out.append(f"{n}.{k}")
    return out


def read_csv_text_columns(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Header row, every field as text.  ``multiline`` allows quoted line breaks; files are
    still read in many splits (``records.csv_records``)."""
    if multiline:
        return _multiline_text_columns(spark, path)
    df = (spark.read.option("header", True).option("inferSchema", False)
          .option("escape", '"').csv(path))
    first = spark.read.text(path).limit(1).collect()   # one header line: metadata
    if first:
        names = _split_fields(first[0]["value"])
        if len(names) == len(df.columns) and len(set(names)) < len(names):
            df = df.toDF(*dedupe_names(names))
    return df


def _multiline_text_columns(spark: SparkSession, path: str) -> DataFrame:
    """The first record of every file is its header; the first file's names the columns."""
    recs = csv_records(spark, path).filter(F.trim("value") != "")
    heads = recs.groupBy("_file").agg(F.min("_pos").alias("_head"), F.min_by("value", "_pos").alias("_names")).collect()  # one row a file
    if not heads:
        return spark.createDataFrame([], T.StructType([]))
    data = recs.filter(~F.col("_pos").isin([h["_head"] for h in heads]))
    return _fields(data, min(heads, key=lambda h: h["_file"])["_names"], "value")


def read_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """S1 + S2 + S3: a CSV file or folder read like a pandas CSV read."""
    return infer_types(normalize_na(read_csv_text_columns(spark, path, multiline)))


# --------------------------------------------------------------- S4 -------
def _split_fields(header: str) -> list[str]:
    import csv
    import io
    return next(csv.reader(io.StringIO(header)))


def _fields(lines: DataFrame, header: str, value: str) -> DataFrame:
    """Records -> text columns named by the header; an empty field is NULL, as in a CSV read."""
    names = dedupe_names(_split_fields(header))
    ddl = ", ".join(f"`_c{i}` STRING" for i in range(len(names)))
    raw = lines.select(F.from_csv(qcol(value), ddl, _CSV_OPTIONS).alias("_r"))
    raw = raw.select(*[F.col("_r")[f"_c{i}"].alias(n) for i, n in enumerate(names)])
    return raw.select(*[F.when(qcol(n) == "", None).otherwise(qcol(n)).alias(n) for n in names])


def parse_csv_lines(lines: DataFrame, header: str, value: str = "value") -> DataFrame:
    """Data lines (one CSV record per row) + their header -> typed frame.
    Parsing is ``from_csv`` on the JVM; no Python per row."""
    return infer_types(normalize_na(_fields(lines, header, value)))


def _text_records(text: str) -> list[str]:
    """Records of a pasted text: lines, joined while a quoted field is open."""
    out, open_ = [], False
    for line in re.split(r"\r\n|\n|\r", text):
        if open_:
            out[-1] += "\n" + line
        else:
            out.append(line)
        open_ = line_ends_open(line, open_)
    return out


def read_csv_from_text(spark: SparkSession, text: str) -> DataFrame:
    """CSV pasted as text (driver-side input typed by a user)."""
    rows = [r for r in _text_records(text) if r.strip() != ""]
    if not rows:
        raise ValueError("no CSV content")
    lines = spark.createDataFrame([(ln,) for ln in rows[1:]], "value string")
    return parse_csv_lines(lines, rows[0])


# --------------------------------------------------------------- S5 -------
def read_snapshot_files(spark: SparkSession, paths: list[str]) -> list[tuple[str, DataFrame]]:
    """One frame per file, named by the file stem, in the given order.
    Each file is read on its own: files may differ in schema."""
    out = []
    for p in paths:
        stem = os.path.splitext(os.path.basename(p.rstrip("/")))[0]
        out.append((stem, read_csv(spark, p)))
    return out


# --------------------------------------------------------------- S6 -------
def _text_lines(spark: SparkSession, path: str, one_text: bool) -> tuple[DataFrame, list]:
    """The non-blank records with their place and chunk, and one row per non-blank chunk, in order."""
    delim = F.trim(F.col("value")) == SNAPSHOT_DELIMITER
    recs = csv_records(spark, path, delim, one_text).withColumnRenamed("_before", "_chunk")
    lines = recs.filter(~delim & (F.trim(F.col("value")) != ""))
    heads = lines.groupBy("_file", "_chunk").agg(F.min("_pos").alias("_hpos"), F.min_by("value", "_pos").alias("value")).collect()
    return lines, sorted(heads, key=lambda h: (h["_file"], h["_chunk"]))


def _numbered(lines: DataFrame, heads: list) -> DataFrame:
    order = lines.sparkSession.createDataFrame([(h["_file"], h["_chunk"], h["_hpos"], i) for i, h in enumerate(heads, 1)],
                                               "_file string, _chunk long, _hpos long, snapshot int")
    j = lines.join(F.broadcast(order), ["_file", "_chunk"])      # one row per snapshot
    return j.select("snapshot", F.concat(F.lit("Pasted_Snapshot_"), F.col("snapshot").cast("string"))
                    .alias("name"), (F.col("_pos") == F.col("_hpos")).alias("is_header"), "value")


def snapshot_text_chunks(spark: SparkSession, path: str, one_text: bool = False) -> DataFrame:
    """S6, distributed: lines of multi-snapshot text files with their chunk.

    Chunks are separated by lines equal to ``---SNAPSHOT---`` (after
    trimming); blank lines and blank chunks are dropped; chunks are numbered
    1.. in (file, position) order.  With ``one_text`` the files are, by name, the
    parts of one text and a chunk may run over several.  Returns ``(snapshot, name,
    is_header, value)`` where the first non-blank line of a chunk is its header."""
    return _numbered(*_text_lines(spark, path, one_text))


def snapshot_text_records(spark: SparkSession, path: str, one_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """S6 -> the snapshot record and schema tables of ``operators.history``.

    Headers (one per snapshot) come to the driver; the data lines are parsed,
    typed and exploded in one pass: the type of every (snapshot, column) is
    inferred by a grouped aggregate, then each value is rendered in the text
    form of its type so that counting distinct values matches a typed read.
    ``one_text`` is that of ``snapshot_text_chunks``."""
    from ..operators.history import SCHEMA_TABLE
    from ..operators.profile import label_c
    lines, heads = _text_lines(spark, path, one_text)
    chunks = _numbered(lines, heads)
    header_rows = []
    width = 0
    for seq, h in enumerate(heads, 1):
        names = _split_fields(h["value"])
        width = max(width, len(names))
        for i, n in enumerate(names):
            header_rows.append((seq, f"Pasted_Snapshot_{seq}", i, n))
    hdr = spark.createDataFrame(header_rows, "snapshot int, name string, idx int, column string")
    ddl = ", ".join(f"`_c{i}` STRING" for i in range(width))
    data = chunks.filter(~F.col("is_header")).select(
        "snapshot", F.from_csv(F.col("value"), ddl, _CSV_OPTIONS).alias("_r"))
    cells = data.select("snapshot", F.posexplode(F.array(*[F.col("_r")[f"_c{i}"] for i in range(width)]))
                        .alias("idx", "v"))
    cells = cells.join(F.broadcast(hdr), ["snapshot", "idx"])  # drop fields beyond the header
    cells = cells.withColumn("v", F.when(F.col("v").isin(K.NA_TOKENS) | (F.col("v") == ""), None)
                             .otherwise(F.col("v")))
    t = cells.groupBy("snapshot", "column").agg(*[e.alias(f"_k{j}") for j, e in
                                                  enumerate(_kind_tests(F.col("v")))])
    types = {(r["snapshot"], r["column"]): _decide(r["_k0"] or 0, r["_k1"] or 0, bool(r["_k2"]),
                                                   bool(r["_k3"]), bool(r["_k4"]))
             for r in t.collect()}  # one row per (snapshot, column)
    type_rows = [(s, c, ty) for (s, c), ty in types.items()]
    tdf = spark.createDataFrame(type_rows, "snapshot int, column string, ty string")
    cells = cells.join(F.broadcast(tdf), ["snapshot", "column"])
    ty = F.col("ty")
    v = F.col("v")
    canon = (F.when(ty == "double", v.cast("double").cast("string"))
             .when(ty == "bigint", v.cast("bigint").cast("string"))
             .when(ty == "boolean", (F.lower(v) == "true").cast("string"))
             .otherwise(v))
    records = cells.select(F.col("snapshot").alias("seq"), "column", canon.alias("v"))
    schema_rows = []
    for (s, n, i, c) in header_rows:
        dt = T._parse_datatype_string(types.get((s, c), "string"))
        schema_rows.append((s, n, c, dt.simpleString(), label_c(dt), i))
    return records, spark.createDataFrame(schema_rows, SCHEMA_TABLE)


def scratch_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder under the session's shared checkpoint directory."""
    from ..session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/dqforge-{what}-{uuid.uuid4().hex[:12]}"
