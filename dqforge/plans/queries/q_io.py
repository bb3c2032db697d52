"""Registered source / sink / SQL-demo queries.

File-based entries write their input from the test tables into a fresh
folder under the session's checkpoint directory (shared storage on a
cluster), then read it back through the operator under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.onerow import beside
from ...operators import history as HI
from ...operators import profile as PR
from ...plans import sqldemo as SQ
from ...sources import csv as CS
from ...sources import sinks as SK
from ...sources.tables import table

QUERIES: dict = {}
ORACLE: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def orders_csv_frame(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey",
        F.when(k % 19 == 0, None).otherwise(F.col("o_custkey")).alias("o_custkey"),
        "o_orderstatus", "o_totalprice",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        F.when(k % 17 == 0, "NA").when(k % 23 == 0, "null").otherwise(F.col("o_orderpriority"))
        .alias("o_orderpriority"),
        F.when(k % 2 == 0, "True").otherwise("False").alias("o_flag"))


ORDERS_CSV_SQL = """
o AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
         o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
         CASE WHEN o_orderkey % 17 = 0 OR o_orderkey % 23 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
         o_orderkey % 2 = 0 AS o_flag
  FROM orders)"""

TYPES = [("o_orderkey", "bigint"), ("o_custkey", "double"), ("o_orderstatus", "string"),
         ("o_totalprice", "double"), ("o_orderdate", "string"), ("o_orderpriority", "string"),
         ("o_flag", "boolean")]


def _counts_sql(ctes: str) -> str:
    return "WITH " + ctes + "\n" + "\n  UNION ALL\n".join(
        f"""  SELECT '{c}' AS "column", '{t}' AS spark_type, CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS null_count,
         CAST(COUNT(DISTINCT {c}) AS BIGINT) AS distinct_count FROM o""" for c, t in TYPES)


@register("csv_roundtrip_orders", _counts_sql(ORDERS_CSV_SQL))
def csv_roundtrip_orders(spark, sf):
    path = CS.scratch_dir(spark, "csv")
    SK.write_csv(orders_csv_frame(spark, sf), path)          # S11
    back = CS.read_csv(spark, path)                          # S1 + S2 + S3
    p = PR.profile(back)
    return p.select("column", "spark_type", "null_count", "distinct_count")


@register("csv_text_lines_orders", _counts_sql(ORDERS_CSV_SQL))
def csv_text_lines_orders(spark, sf):
    # CSV records held as text rows (as pasted text), parsed on the JVM
    src = orders_csv_frame(spark, sf)
    header = ",".join(src.columns)
    lines = src.select(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit(""))
                                          for c in src.columns]).alias("value"))
    back = CS.parse_csv_lines(lines, header)
    return PR.profile(back).select("column", "spark_type", "null_count", "distinct_count")


YEAR_SQL = """
y AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, o_orderkey,
         CASE WHEN o_orderkey % (year(o_orderdate) - 1990) = 0 THEN NULL ELSE o_custkey END AS o_custkey,
         o_orderstatus, o_orderpriority FROM orders),
pc AS (
""" + "\n  UNION ALL\n".join(
    f"""  SELECT yr, '{c}' AS col, COUNT(*) AS total, COUNT({c}) AS nn, COUNT(DISTINCT {c}) AS d FROM y GROUP BY yr"""
    for c in ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]) + """),
snap AS (
  SELECT yr, CAST(max(total) AS BIGINT) AS row_count, CAST(COUNT(*) AS BIGINT) AS column_count,
         round_even(avg(round_even(CAST(nn AS DOUBLE) / total * 100, 1)), 1) AS completeness,
         round_even(avg(round_even(CAST(d AS DOUBLE) / total * 100, 1)), 1) AS uniqueness
  FROM pc GROUP BY yr)"""


def orders_year_frame(spark, sf):
    o = table(spark, sf, "orders")
    yr = F.year("o_orderdate")
    k = F.col("o_orderkey")
    return o.select(yr.alias("yr"), "o_orderkey",
                    F.when(k % (yr - 1990) == 0, None).otherwise(F.col("o_custkey")).alias("o_custkey"),
                    "o_orderstatus", "o_orderpriority")


@register("snapshot_files_orders", "WITH " + YEAR_SQL + """
SELECT 'yr=' || CAST(yr AS VARCHAR) AS snapshot, row_count, column_count, completeness, uniqueness,
       round_even((completeness + uniqueness) / 2, 1) AS overall_score FROM snap""")
def snapshot_files_orders(spark, sf):
    # One CSV folder per year (written in parallel), each read on its own
    base = CS.scratch_dir(spark, "snapfiles")
    orders_year_frame(spark, sf).write.partitionBy("yr").option("header", True).csv(base)
    years = [r["yr"] for r in orders_year_frame(spark, sf).select("yr").distinct().collect()]
    frames = CS.read_snapshot_files(spark, [f"{base}/yr={y}" for y in sorted(years)])
    recs, schema = HI.snapshot_records_from_frames(frames)
    t = HI.snapshot_table(recs, schema)
    return t.select("snapshot", "row_count", "column_count", "completeness", "uniqueness",
                    "overall_score")


@register("snapshot_text_orders", "WITH " + YEAR_SQL + """
SELECT row_count, column_count, completeness, uniqueness,
       round_even((completeness + uniqueness) / 2, 1) AS overall_score FROM snap""")
def snapshot_text_orders(spark, sf):
    # Multi-snapshot text, one chunk per year separated by ---SNAPSHOT---
    src = orders_year_frame(spark, sf)
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    data = src.select("yr", F.lit(1).alias("kind"), F.col("o_orderkey").alias("k"),
                      F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit(""))
                                         for c in cols]).alias("value"))
    years = src.select("yr").distinct()
    head = years.select("yr", F.lit(0).alias("kind"), F.lit(-1).cast("bigint").alias("k"),
                        F.lit(",".join(cols)).alias("value"))
    tail = years.select("yr", F.lit(2).alias("kind"), F.lit(-1).cast("bigint").alias("k"),
                        F.lit(CS.SNAPSHOT_DELIMITER).alias("value"))
    path = CS.scratch_dir(spark, "snaptext")
    (data.unionByName(head).unionByName(tail)
     .repartitionByRange("yr", "kind", "k").sortWithinPartitions("yr", "kind", "k")
     .select("value").write.text(path))                       # one text in sorted parts
    recs, schema = CS.snapshot_text_records(spark, path, one_text=True)
    t = HI.snapshot_table(recs, schema)
    return t.select("row_count", "column_count", "completeness", "uniqueness", "overall_score")


@register("history_append_orders", """
SELECT CAST(2 AS BIGINT) AS runs, CAST(COUNT(*) AS BIGINT) AS total_records,
       'orders' AS dataset_name,
       CAST(2 * (SELECT COUNT(*) FROM (DESCRIBE SELECT * FROM orders)) AS BIGINT) AS field_rows
FROM orders""")
def history_append_orders(spark, sf):
    # S12 + S13: append two runs to the dataset and field histories, read back
    from ...plans import snapshot as SN
    from .q_scores import orders_bands
    df = orders_bands(spark, sf)
    prof = PR.profile(df)
    flat = SN.flatten_snapshot(SN.comprehensive_snapshot(df, None, dataset_name="orders", prof=prof))
    fields = SN.field_summary(df, dataset_name="orders", prof=prof)
    hist, fhist = CS.scratch_dir(spark, "hist"), CS.scratch_dir(spark, "fhist")
    for _ in range(2):
        SK.append_history(flat, hist)
        SK.append_field_history(fields, fhist)
    h = spark.read.parquet(hist).agg(F.count(F.lit(1)).alias("runs"),
                                     F.max("total_records").alias("total_records"))
    fh = spark.read.parquet(fhist).groupBy("dataset_name").agg(F.count(F.lit(1)).alias("field_rows"))
    return beside(h, fh)


@register("preview_orders", """
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 10""")
def preview_orders(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return SK.preview(o, "o_orderkey")


# ------------------------------------------------------------ SQL demo ----
EMP_SQL = """
employees AS (
  SELECT c.c_custkey AS id, c.c_name AS name, 18 + c.c_custkey % 47 AS age,
         CAST(floor(c.c_acctbal * 10) AS BIGINT) + 40000 AS salary, n.n_name AS department
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey)"""


def employees_view(spark, sf):
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation")
    emp = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        (18 + F.col("c_custkey") % 47).alias("age"),
        (F.floor(F.col("c_acctbal") * 10).cast("bigint") + 40000).alias("salary"),
        F.col("n_name").alias("department"))
    return SQ.register_table(emp, "employees")


@register("sql_small_query_customers", "WITH " + EMP_SQL + "\n" + SQ.QUERY_SMALL.replace(
    "AVG(age)", "round_even(AVG(age), 9)"))
def sql_small_query_customers(spark, sf):
    employees_view(spark, sf)
    df, _ = SQ.run_query(spark, SQ.QUERY_SMALL, timed=False)   # Q1 + Q2 over the view (S9)
    return df.withColumn("avg_age", F.bround("avg_age", 9))


@register("sql_large_query_customers", "WITH " + EMP_SQL + "\n" + SQ.QUERY_LARGE.replace(
    "AVG(salary)", "round_even(AVG(salary), 9)").replace("COUNT(*) as cnt", "CAST(COUNT(*) AS BIGINT) as cnt"))
def sql_large_query_customers(spark, sf):
    employees_view(spark, sf)
    df, _ = SQ.run_query(spark, SQ.QUERY_LARGE, timed=False)   # Q3
    return df.withColumn("avg_salary", F.bround("avg_salary", 9))


@register("dataframe_large_query_customers", "WITH " + EMP_SQL + "\n" + SQ.QUERY_LARGE.replace(
    "AVG(salary)", "round_even(AVG(salary), 9)").replace("COUNT(*) as cnt", "CAST(COUNT(*) AS BIGINT) as cnt"))
def dataframe_large_query_customers(spark, sf):
    df = SQ.avg_salary_by_department(employees_view(spark, sf))
    return df.withColumn("avg_salary", F.bround("avg_salary", 9))


@register("csv_quoted_records_orders", """
SELECT o_orderkey, 'say "' || o_orderstatus || '", then' || chr(10) || o_orderpriority AS note,
       CAST(CAST(o_orderkey AS VARCHAR) || '00000000000000000000001' AS DOUBLE) AS wide FROM orders""")
def csv_quoted_records_orders(spark, sf):
    # S1 + S3: doubled quotes, commas and line breaks in quoted fields; integers beyond 64 bits
    o = table(spark, sf, "orders")
    base = CS.scratch_dir(spark, "quoted")
    (o.select("o_orderkey", F.concat(F.lit('say "'), "o_orderstatus", F.lit('", then\n'), "o_orderpriority").alias("note"),
              F.concat(F.col("o_orderkey").cast("string"), F.lit("00000000000000000000001")).alias("wide"))
     .write.option("header", True).option("escape", '"').csv(base))
    return CS.read_csv(spark, base, multiline=True)


@register("snapshot_text_quoted_orders", """
SELECT YEAR(o_orderdate) - (SELECT min(YEAR(o_orderdate)) FROM orders) + 1 AS seq, 'note' AS "column",
       'say "' || o_orderstatus || '", then' || chr(10) || o_orderpriority AS v, COUNT(*) AS cnt
FROM orders GROUP BY ALL""")
def snapshot_text_quoted_orders(spark, sf):
    # A record whose quoted field holds a doubled quote, a comma and a line break
    o = table(spark, sf, "orders")
    yr = F.year("o_orderdate").alias("yr")
    note = F.concat(F.lit('"say ""'), "o_orderstatus", F.lit('"", then\n'), "o_orderpriority", F.lit('"'))
    years = o.select(yr).distinct()
    data = o.select(yr, F.lit(1).alias("kind"), F.col("o_orderkey").alias("k"), note.alias("value"))
    edge = lambda kind, text: years.select("yr", F.lit(kind).alias("kind"), F.lit(-1).cast("bigint").alias("k"), F.lit(text).alias("value"))
    path = CS.scratch_dir(spark, "snapquoted")
    (data.unionByName(edge(0, "note")).unionByName(edge(2, CS.SNAPSHOT_DELIMITER))
     .repartitionByRange("yr", "kind", "k").sortWithinPartitions("yr", "kind", "k").select("value").write.text(path))
    recs, _ = CS.snapshot_text_records(spark, path, one_text=True)
    return recs.groupBy("seq", "column", "v").agg(F.count(F.lit(1)).alias("cnt")).select(F.col("seq").cast("bigint").alias("seq"), "column", "v", "cnt")
