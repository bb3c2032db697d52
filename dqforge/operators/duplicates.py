"""Row-level duplicate marking (W1) without a hot-key task.

``count(*) over (partition by key)`` sends every row of a key to one task; a
key that holds a third of the table would then be one third of the job in a
single task.  Instead:

1. ``groupBy(keys).count()`` with map-side partial counts -> the duplicated
   keys ``D`` with their counts (one row per key, however hot), kept once.
2. The hottest keys -- each above ``1 / HOT_KEYS`` of the duplicated rows, so
   fewer than ``HOT_KEYS``, and no more than ``HOT_BYTES`` of them -- are
   broadcast and flag their rows where these are: the whole key is compared, and
   being hot they are known to be duplicated.
3. The other rows meet the rest of ``D`` in one join on (key, salt).  Both sides
   take the salt from the key's hash, so ``D`` holds each key once; a row that is
   flagged already takes a salt that no key has, from its contents and the
   partition it comes from, so it looks for nothing, spreads evenly, and a task
   that runs again deals it the same way.

A key outside the broadcast holds at most ``1 / HOT_KEYS`` of the rows (or the
bytes of the hot ones ran out, and AQE's skew join splits what is left).
Equality is NULL-safe (pandas ``duplicated`` treats missing values as equal).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import qcol
from ..session import shuffle_partitions

#: fewer keys than this are hot, and they take this many bytes at most
HOT_KEYS = 4096
HOT_BYTES = 32 << 20
_FLAGGED = 1 << 40


def _key(df: DataFrame, k: str):
    """A key column as compared: maps (not groupable) by their JSON text."""
    from pyspark.sql import types as T
    return F.to_json(qcol(k)) if isinstance(df.schema[k].dataType, T.MapType) else qcol(k)


def duplicated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys occurring more than once, with their count ``_dq_n``."""
    return (df.groupBy(*[_key(df, k).alias(k) for k in keys])
            .agg(F.count(F.lit(1)).alias("_dq_n"))
            .filter(F.col("_dq_n") > 1))


def duplicated_values_per_column(df: DataFrame, columns: list[str],
                                 materialize: bool = True) -> dict[str, DataFrame]:
    """Duplicated values of several columns from ONE aggregation: every row is
    expanded into one typed record per column and a single ``groupBy``
    (map-side combined) counts them all.  The result -- duplicated values
    only -- is checkpointed once, and each column's slice is returned as a
    ``(column, _dq_n)`` table ready for ``mark_duplicates(dups=...)``."""
    fields = {c: f"_dqv{i}" for i, c in enumerate(columns)}
    from pyspark.sql import types as T
    types = {c: (T.StringType() if isinstance(df.schema[c].dataType, T.MapType)
                 else df.schema[c].dataType) for c in columns}
    recs = [F.struct(F.lit(i).alias("_dqi"),
                     *[(_key(df, c) if c == own else F.lit(None).cast(types[c])).alias(fields[c])
                       for c in columns])
            for i, own in enumerate(columns)]
    counted = (df.select(F.inline(F.array(*recs)))
               .groupBy("_dqi", *fields.values()).agg(F.count(F.lit(1)).alias("_dq_n"))
               .filter(F.col("_dq_n") > 1))
    if materialize:
        from ..session import ensure_checkpoint_dir
        ensure_checkpoint_dir(df.sparkSession)
        counted = counted.checkpoint(eager=True)
    return {c: counted.filter(F.col("_dqi") == i).select(F.col(fields[c]).alias(c), "_dq_n")
            for i, c in enumerate(columns)}


def _hot_from(table: DataFrame, names: list[str]) -> int | None:
    """The least count of a hot key, null if there is none: fewer than ``HOT_KEYS`` counts and sizes
    come to the driver, of which the largest that fit in ``HOT_BYTES`` stay."""
    total = table.agg(F.sum("_dq_n")).first()[0] or 0
    size = F.length(F.to_json(F.struct(*names)))
    hot = (table.filter(F.col("_dq_n") * HOT_KEYS > total).groupBy("_dq_n").agg(F.sum(size).alias("bytes"))
           .orderBy(F.desc("_dq_n")).collect())
    least, used = None, 0
    for r in hot:
        used += r["bytes"]
        if used > HOT_BYTES:
            break
        least = r["_dq_n"]
    return least


def mark_duplicates(df: DataFrame, keys: list[str], flag: str = "is_duplicate",
                    buckets: int | None = None, dups: DataFrame | None = None) -> DataFrame:
    """Add boolean ``flag``: the row's key tuple occurs more than once.
    ``dups`` may supply the duplicated keys (with ``_dq_n``) already counted; ``buckets`` is the
    number of salts (the session's shuffle partitions if not given)."""
    keys = list(keys)
    spark = df.sparkSession
    buckets = buckets or shuffle_partitions(spark)
    if dups is None:
        from ..session import ensure_checkpoint_dir
        ensure_checkpoint_dir(spark)
        dups = duplicated_keys(df, keys).checkpoint(eager=True)
    names = [f"_dqk_{i}" for i in range(len(keys))]
    table = dups.select(*[qcol(k).alias(n) for k, n in zip(keys, names)], "_dq_n")
    same = lambda left, extra=(): reduce(lambda a, b: a & b, [
        _key(left, k).eqNullSafe(qcol(n)) for k, n in zip(keys, names)] + list(extra))
    own = lambda cols: F.pmod(F.xxhash64(*cols), F.lit(buckets))
    salt = own([_key(df, k) for k in keys])
    marked, flagged = df, F.lit(False)
    least = _hot_from(table, names)
    if least is not None:
        hot = table.filter(F.col("_dq_n") >= least).select(*names, F.lit(True).alias("_dq_hot"))
        marked = df.join(F.broadcast(hot), same(df), "left").drop(*names)
        flagged = F.coalesce(F.col("_dq_hot"), F.lit(False))
        contents = [qcol(f.name) for f in df.schema.fields if "map" not in f.dataType.simpleString()]
        salt = F.when(flagged, F.lit(_FLAGGED) + F.pmod(F.xxhash64(*contents, F.spark_partition_id()), F.lit(_FLAGGED))).otherwise(salt)
        table = table.filter(F.col("_dq_n") < least)
    marked = marked.withColumn("_dq_salt", salt)
    table = table.select(*names, own(names).alias("_dqk_salt"), F.lit(True).alias("_dq_dup"))
    joined = marked.join(table, same(marked, [F.col("_dq_salt") == F.col("_dqk_salt")]), "left")
    return joined.select(*[qcol(c) for c in df.columns], (flagged | F.coalesce(F.col("_dq_dup"), F.lit(False))).alias(flag))
