"""Session construction and cluster-facing settings.

Library code never builds its own session: every public function takes the
caller's ``SparkSession`` (or a DataFrame).  ``get_spark`` is for tests, the
bench and command-line use only.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session we create gets.  AQE re-plans joins and coalesces
# small shuffle partitions at runtime; skew-join splitting is the second line
# of defence behind the explicit hot-key split in ``operators.duplicates``.
_BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of frames that are no longer referenced are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              driver_memory: str = "16g", app_name: str = "dqforge",
              extra_conf: dict | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app_name)
    conf = dict(_BASE_CONF)
    conf["spark.driver.memory"] = driver_memory
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting names a shared, fault-tolerant folder and we use
    it as is.  Where it is unset, a local session gets a scratch folder (driver
    and tasks share one disk there); any other master raises, because its
    executors would write to disks of their own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="dqforge-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return configured


def cluster_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20
                 ) -> dict[str, str]:
    """Settings sized to the data for a cluster session (pass them to the
    session builder or ``spark-submit --conf``).

    * input splits of ``target_partition_bytes`` (256 MB): a task's slice of a
      scan fits comfortably in executor memory;
    * shuffle partitions so that the widest shuffle here (the value counts of
      a profile, about the size of the input columns) lands near the same
      size per task, and never fewer than three waves of the cluster's cores;
    * AQE coalesces small partitions toward 128 MB and splits skewed ones
      above 4x the median (and 512 MB).
    """
    parts = max(3 * total_cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
    }


def shuffle_partitions(spark: SparkSession) -> int:
    try:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    except Exception:  # pragma: no cover - conf always set in practice
        return 200
