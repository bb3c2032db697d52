"""The seeded synthetic employees table of the SQL demo, generated on the
executors (``spark.range`` + seeded ``rand``), never on the driver.

Only the distribution contract holds (id 0..n-1, age 18-64, salary
40,000-119,999, department uniform over four values); a numpy random stream
cannot be reproduced in Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.sqldemo import DEPARTMENTS


def synthetic_employees(spark: SparkSession, rows: int = 1_000_000, seed: int = 42,
                        partitions: int | None = None) -> DataFrame:
    base = spark.range(0, rows, numPartitions=partitions) if partitions else spark.range(rows)
    dep = F.element_at(F.array(*[F.lit(d) for d in DEPARTMENTS]),
                       (F.floor(F.rand(seed + 3) * len(DEPARTMENTS)) + 1).cast("int"))
    return base.select(
        F.col("id"),
        (F.floor(F.rand(seed) * (65 - 18)) + 18).cast("bigint").alias("age"),
        (F.floor(F.rand(seed + 1) * (120_000 - 40_000)) + 40_000).cast("bigint").alias("salary"),
        dep.alias("department"))
