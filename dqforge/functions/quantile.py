"""Exact quantiles (linear interpolation, as pandas/numpy) without a single task
holding a whole column.

``percentile`` keeps a value->count map of the entire group in one final task
and ``percentile_approx`` is not exact.  Here the work is spread out:

1. the input is already a frequency table ``(group, value, cnt)``;
2. ``repartitionByRange(group, value)`` cuts it into ordered slices; the
   slice ids are checkpointed once so that every later step sees the same
   slices (the shared ``spark.checkpoint.dir``; survives lost executors);
3. per-slice totals and their running offsets (at most ``#slices + #groups``
   rows: slices are contiguous in (group, value) order, so each boundary
   splits at most one group) tell which slices hold a wanted rank -- at most
   two per quantile and group;
4. only those slices get a running count (window over ``(group, slice)``,
   bounded by the slice size), giving their values global rank intervals
   ``[start, end)``;
5. a broadcast join against the wanted ranks picks the two neighbours of each
   quantile position and interpolates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, shuffle_partitions


def exact_quantiles(freq: DataFrame, group: list[str], value: str, cnt: str,
                    probs: list[float], slices: int | None = None) -> DataFrame:
    """``(group..., prob, quantile)`` for every group with at least one value.

    ``freq`` rows with a NULL ``value`` are ignored.
    """
    spark = freq.sparkSession
    slices = slices or shuffle_partitions(spark)
    src = freq.filter(F.col(value).isNotNull()).select(*group, F.col(value).alias("_qv"),
                                                        F.col(cnt).alias("_qc"))
    totals = src.groupBy(*group).agg(F.sum("_qc").alias("_qn"))
    probs_arr = F.array(*[F.lit(float(p)) for p in probs])
    targets = (totals.select(*group, "_qn", F.explode(probs_arr).alias("prob"))
               .withColumn("_h", (F.col("_qn") - 1) * F.col("prob"))
               .withColumn("_rlo", F.floor("_h").cast("long"))
               .withColumn("_rhi", F.least(F.col("_rlo") + 1, F.col("_qn") - 1))
               .withColumn("_frac", F.col("_h") - F.col("_rlo")))

    # Slice ids are written once: every consumer below reads the same ids.
    # (Two separate range exchanges would each sample their own bounds.)
    ranged = src.repartitionByRange(slices, *group, "_qv") \
        .withColumn("_qs", F.spark_partition_id())
    ensure_checkpoint_dir(spark)
    ranged = ranged.checkpoint(eager=True)

    # per-slice totals and offsets: at most #slices + #groups rows, no sorting
    per_slice = ranged.groupBy(*group, "_qs").agg(F.sum("_qc").alias("_qsn"))
    w_off = Window.partitionBy(*group).orderBy("_qs") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = (per_slice.withColumn("_qo", F.coalesce(F.sum("_qsn").over(w_off), F.lit(0)))
               .withColumn("_qe", F.col("_qo") + F.col("_qsn")))

    # only the slices holding a wanted rank (at most two per quantile and
    # group) are ordered; all other slices are never sorted or shuffled again
    inside = lambda r: (F.col(r) >= F.col("_qo")) & (F.col(r) < F.col("_qe"))
    need = (offsets.join(targets.select(*group, "_rlo", "_rhi"), group)
            .filter(inside("_rlo") | inside("_rhi"))
            .select(*group, "_qs", "_qo").distinct())
    local = ranged.join(need, [*group, "_qs"])
    w_local = Window.partitionBy(*group, "_qs").orderBy("_qv") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (local.withColumn("_ql", F.sum("_qc").over(w_local))
              .withColumn("_qend", F.col("_qo") + F.col("_ql"))
              .withColumn("_qstart", F.col("_qend") - F.col("_qc")))

    t = targets.alias("t")
    r = ranked.alias("r")
    hit_lo = (F.col("t._rlo") >= F.col("r._qstart")) & (F.col("t._rlo") < F.col("r._qend"))
    hit_hi = (F.col("t._rhi") >= F.col("r._qstart")) & (F.col("t._rhi") < F.col("r._qend"))
    cond = [F.col(f"t.{g}").eqNullSafe(F.col(f"r.{g}")) for g in group]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    picked = (r.join(t, on & (hit_lo | hit_hi))
              .groupBy(*[F.col(f"t.{g}").alias(g) for g in group], F.col("t.prob").alias("prob"))
              .agg(F.max(F.when(hit_lo, F.col("r._qv"))).alias("_lo"),
                   F.max(F.when(hit_hi, F.col("r._qv"))).alias("_hi"),
                   F.first("t._frac").alias("_frac")))
    # numpy's linear interpolation, written as numpy writes it
    diff = F.col("_hi") - F.col("_lo")
    q = F.when(F.col("_frac") >= 0.5, F.col("_hi") - diff * (1 - F.col("_frac"))) \
        .otherwise(F.col("_lo") + diff * F.col("_frac"))
    return picked.select(*group, "prob", q.alias("quantile"))
