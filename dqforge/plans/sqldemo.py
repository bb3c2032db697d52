"""The SQL demo (S7-S9, Q1-Q3): register a table, run SQL, time it.

The original demo compares two embedded engines; here the engine is Spark
SQL itself, so only the workload is kept: the two default queries and free
SQL over a registered view.  Timing wraps a real action (a ``noop`` write
that materialises every row without collecting anything).
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the demo's default queries
QUERY_SMALL = "SELECT department, AVG(age) as avg_age FROM employees GROUP BY department"
QUERY_LARGE = ("SELECT department, AVG(salary) as avg_salary, COUNT(*) as cnt "
               "FROM employees GROUP BY department")

# fixed values: the demo's small inline table (id, name, age, department)
SMALL_NAMES = ["Alice", "Bob", "Charlie", "David", "Eva", "Frank", "Grace", "Hannah", "Ivan",
               "Julia"]
SMALL_AGES = [25, 32, 37, 29, 41, 35, 28, 39, 45, 31]
SMALL_DEPARTMENTS = ["HR", "IT", "Finance", "IT", "HR", "Finance", "IT", "HR", "Finance", "IT"]
SMALL_EMPLOYEES = [(i + 1, n, a, d) for i, (n, a, d) in
                   enumerate(zip(SMALL_NAMES, SMALL_AGES, SMALL_DEPARTMENTS))]
DEPARTMENTS = ["HR", "IT", "Finance", "Marketing"]


def small_employees(spark: SparkSession) -> DataFrame:
    """The inline 10-row table."""
    return spark.createDataFrame(SMALL_EMPLOYEES, "id bigint, name string, age bigint, department string")


def register_table(df: DataFrame, name: str = "employees") -> DataFrame:
    """Make a frame queryable by name."""
    df.createOrReplaceTempView(name)
    return df


def run_query(spark: SparkSession, sql: str, timed: bool = True) -> tuple[DataFrame, float | None]:
    """Q1: the query's frame and, if ``timed``, the milliseconds one full
    execution takes (noop sink: every row computed, nothing collected)."""
    df = spark.sql(sql)
    if not timed:
        return df, None
    t0 = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return df, (time.perf_counter() - t0) * 1000.0


def avg_age_by_department(df: DataFrame) -> DataFrame:
    """Q2 in the DataFrame API."""
    return df.groupBy("department").agg(F.avg("age").alias("avg_age"))


def avg_salary_by_department(df: DataFrame) -> DataFrame:
    """Q3 in the DataFrame API."""
    return df.groupBy("department").agg(F.avg("salary").alias("avg_salary"),
                                        F.count(F.lit(1)).alias("cnt"))
