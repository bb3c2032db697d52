"""Rule scorecards and tracking history over Structured Streaming sources.

* ``running_scorecard`` keeps running totals of the predicate rules (not
  null, sets, patterns, ranges, dates and their multi-column forms) in
  Spark's state store: one streaming aggregate, complete output mode.
  Uniqueness needs every key ever seen: ``monitor`` keeps key counts.
* ``monitor`` judges each micro-batch (``foreachBatch``) and appends the rule
  results and one tracking entry per batch to parquet tables.  Predicate rules
  are about the batch; uniqueness rules are about all batches so far, from a
  table of key counts that every batch adds to.  Each batch writes its own
  ``batch_id=<n>`` folders in overwrite mode, so a replayed batch replaces
  itself (idempotent).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.streaming import StreamingQuery

from ..functions.onerow import beside
from ..functions.names import qcol
from ..functions import constants as K
from ..functions import predicates as P
from ..operators import rules as R


def running_scorecard(stream: DataFrame, rules: list[R.Rule]) -> DataFrame:
    """Streaming ``seq, column, rule, total, passed, failed, success_rate``
    for the predicate rules (uniqueness rules are refused: use ``monitor``)."""
    if any(r.is_group for r in rules):
        raise ValueError("uniqueness rules need per-batch evaluation: use monitor()")
    used = sorted({c for r in rules for c in r.columns})
    src = P.normalize_nan(stream.select(*[qcol(c) for c in used]))
    flags = {}
    for i, r in enumerate(rules):
        bad, counted = R._failed_and_total(src, r)
        flags[f"_dqf{i}"] = bad.cast("int")
        if counted is not None:
            flags[f"_dqt{i}"] = counted.cast("int")
    agg = src.agg(F.count(F.lit(1)).alias("_dqn"), *[F.sum(e).alias(n) for n, e in flags.items()])
    items = []
    for i, r in enumerate(rules):
        tot = qcol(f"_dqt{i}") if f"_dqt{i}" in flags else F.col("_dqn")
        failed = F.coalesce(qcol(f"_dqf{i}"), F.lit(0)).cast("long")
        total = F.coalesce(tot, F.lit(0)).cast("long")
        items.append(F.struct(F.lit(i).alias("seq"), F.lit(r.column_label).alias("column"),
                              F.lit(r.label).alias("rule"), total.alias("total"),
                              (total - failed).alias("passed"), failed.alias("failed"),
                              R.success_rate(total - failed, total).alias("success_rate")))
    return agg.select(F.inline(F.array(*items)))


def run_to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Drain a bounded streaming source (``availableNow``) into an in-process
    memory table and return it as a batch DataFrame."""
    q = (df.writeStream.outputMode(mode).format("memory").queryName(name)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.table(name)


def monitor(stream: DataFrame, rules: list[R.Rule], results_path: str, history_path: str,
            checkpoint: str, dataset_name: str = "stream",
            available_now: bool = False) -> StreamingQuery:
    """Append rule results and one tracking entry per micro-batch."""

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        counts = _batch_counts(batch, rules, f"{results_path.rstrip('/')}_keys", batch_id)
        res = R.result_table(batch.sparkSession, rules, counts).drop("details").withColumn("batch_id", F.lit(batch_id))
        res.write.mode("overwrite").parquet(f"{results_path}/batch_id={batch_id}")
        saved = batch.sparkSession.read.parquet(f"{results_path}/batch_id={batch_id}")
        entry = tracking_entry(batch, saved, dataset_name, batch_id)
        entry.write.mode("overwrite").parquet(f"{history_path}/batch_id={batch_id}")

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def _batch_counts(batch: DataFrame, rules: list[R.Rule], keys_path: str, batch_id: int) -> DataFrame:
    """(seq, total, failed): predicates over the batch, uniqueness over all batches up to it."""
    used = sorted({c for r in rules for c in r.columns})
    src = P.normalize_nan(batch.select(*[qcol(c) for c in used]))
    plain = [(i, r) for i, r in enumerate(rules) if not r.is_group]
    out = None
    if plain:
        own = R.rule_counts(src, [r for _, r in plain])
        place = F.array(*[F.lit(i) for i, _ in plain])
        out = own.withColumn("seq", F.element_at(place, F.col("seq") + 1))
    for i, r in enumerate(rules):
        if not r.is_group:
            continue
        keys = [f"k{j}" for j in range(len(r.columns))]
        values = [F.to_json(qcol(c)) if isinstance(src.schema[c].dataType, T.MapType) else qcol(c) for c in r.columns]
        path = f"{keys_path}/rule_{i}"
        (src.groupBy(*[v.alias(k) for v, k in zip(values, keys)]).agg(F.count(F.lit(1)).alias("n"))
         .write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}"))
        seen = (batch.sparkSession.read.parquet(path).filter(F.col("batch_id") <= batch_id)
                .groupBy(*keys).agg(F.sum("n").alias("n")))
        twice = F.col("n") > 1
        if r.kind == "unique":                        # a single-column rule never fails on NULL
            twice = twice & F.col("k0").isNotNull()
        one = seen.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"),
                       F.coalesce(F.sum(F.when(twice, F.col("n"))), F.lit(0)).cast("long").alias("failed"))
        one = one.select(F.lit(i).alias("seq"), "total", "failed")
        out = one if out is None else out.unionByName(one)
    return out


def tracking_entry(batch: DataFrame, results: DataFrame, dataset_name: str,
                   batch_id: int) -> DataFrame:
    """U6 for one micro-batch: score (average rate, 100.0 with no rules),
    rules at or above 90, rows, columns, cell completeness."""
    ncols = len(batch.columns)
    nulls = [F.count_if(qcol(c).isNull()) for c in batch.columns]
    null_cells = nulls[0]
    for e in nulls[1:]:
        null_cells = null_cells + e
    size = batch.agg(F.count(F.lit(1)).alias("row_count"), null_cells.alias("_nulls"))
    v = results.agg(F.count(F.lit(1)).alias("total_validations"),
                    F.count_if(F.col("success_rate") >= K.PASSED_RULE_RATE).alias("passed_validations"),
                    F.avg("success_rate").alias("_score"))
    cells = F.col("row_count") * ncols
    return beside(size, v).select(  # one row each
        F.lit(batch_id).cast("long").alias("batch_id"), F.lit(dataset_name).alias("dataset_name"),
        F.bround(F.coalesce(F.col("_score"), F.lit(100.0)), 1).alias("overall_quality_score"),
        "total_validations", "passed_validations", "row_count",
        F.lit(ncols).alias("column_count"),
        F.bround(F.coalesce(F.try_divide(cells - F.col("_nulls"), cells) * 100, F.lit(0.0)), 1)
        .alias("data_completeness"))
