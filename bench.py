"""Headline workloads of the data-quality engine, timed.

Runs on ``local[$BENCH_CPUS]`` against ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1).  Every query is fully executed through a ``noop``
sink (all rows computed, nothing collected); the reported time is the
median of ``$BENCH_RUNS`` (default 3) runs after one warm-up run.

Prints ONE JSON line:
{"metric": "dq_total_sec", "value": <sum of medians>, "unit": "sec",
 "queries": {name: median_sec, ...}, "sf": ..., ...}
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dqforge.operators import profile as PR  # noqa: E402
from dqforge.operators.profile_approx import profile_approx  # noqa: E402
from dqforge.operators import rowflags as RF  # noqa: E402
from dqforge.operators import rules as R  # noqa: E402
from dqforge.operators import similarity as SM  # noqa: E402
from dqforge.plans import sqldemo as SQ  # noqa: E402
from dqforge.plans.queries.q_rules import FLAGSHIP_RULES, lineitem_nulls  # noqa: E402
from dqforge.plans.scorecard import scorecard  # noqa: E402
from dqforge.session import get_spark  # noqa: E402
from dqforge.sources.csv import scratch_dir  # noqa: E402
from dqforge.sources.generate import synthetic_employees  # noqa: E402
from dqforge.sources.tables import table  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def _sf_value(path: str) -> float | str:
    base = os.path.basename(path.rstrip("/"))
    try:
        return float(base.replace("sf", ""))
    except ValueError:
        return base


def main() -> None:
    spark = get_spark(master=f"local[{CPUS}]", shuffle_partitions=int(CPUS) * 2)
    li = lambda: table(spark, SF_DIR, "lineitem")

    six = FLAGSHIP_RULES[:6]
    row_cfg = {"not_null": ["l_quantity"], "unique": ["l_orderkey"],
               "ranges": {"l_quantity": (5, 45)}, "allowed_values": {"l_returnflag": ["A", "N"]},
               "patterns": {"l_linestatus": "[OF]$"}}

    def demo_query(rows):
        # generation included: the whole table is generated and written inside the timing
        def q():
            path = scratch_dir(spark, f"bench-gen-{rows}")
            synthetic_employees(spark, rows).write.parquet(path)
            SQ.register_table(spark.read.parquet(path), "employees")
            return spark.sql(SQ.QUERY_LARGE)
        return q

    def demo_materialised(rows):
        # query only: the generated table is written once, outside the timing,
        # under the session's checkpoint folder
        path = scratch_dir(spark, f"bench-emp-{rows}")
        synthetic_employees(spark, rows).write.mode("overwrite").parquet(path)

        def q():
            SQ.register_table(spark.read.parquet(path), "employees")
            return spark.sql(SQ.QUERY_LARGE)
        return q

    workloads = {
        "scorecard_6_rules": lambda: scorecard(lineitem_nulls(spark, SF_DIR), six),
        "scorecard_11_rules": lambda: scorecard(lineitem_nulls(spark, SF_DIR), FLAGSHIP_RULES),
        "uniqueness_single_and_combined": lambda: R.evaluate(li(), [
            R.expect_column_values_to_be_unique("l_orderkey"),
            R.expect_columns_values_to_be_unique(["l_orderkey", "l_linenumber"])]),
        "profile_lineitem": lambda: PR.profile(li()),
        "profile_lineitem_approx": lambda: profile_approx(li()),
        "row_flags_lineitem": lambda: RF.enhanced_dataset(lineitem_nulls(spark, SF_DIR), row_cfg),
        "similarity_part": lambda: SM.summary(table(spark, SF_DIR, "part"), "p_brand", "p_type"),
        "similarity_orders": lambda: SM.summary(table(spark, SF_DIR, "orders"),
                                                "o_orderstatus", "o_orderpriority"),
        "demo_query_1m": demo_materialised(1_000_000),
        "demo_query_10m": demo_materialised(10_000_000),
        "demo_gen_and_query_1m": demo_query(1_000_000),
        "demo_gen_and_query_10m": demo_query(10_000_000),
    }
    # opt-in variants, run only when named on the command line
    optional = {"profile_lineitem_approx"}
    only = set(sys.argv[1:])
    results = {}
    for name, build in workloads.items():
        if (only and name not in only) or (not only and name in optional):
            continue
        times = []
        for i in range(RUNS + 1):
            t0 = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i > 0:
                times.append(dt)
        results[name] = round(statistics.median(times), 4)
    out = {"metric": "dq_total_sec", "value": round(sum(results.values()), 4), "unit": "sec",
           "queries": results, "sf": _sf_value(SF_DIR), "cpus": int(CPUS), "runs": RUNS,
           "driver_memory": spark.sparkContext.getConf().get("spark.driver.memory", ""),
           "spark": spark.version}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
