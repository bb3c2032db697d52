"""Edit-distance similarity between two columns.

NULL compares as the empty string, so two NULLs are an exact match (N13).
Distances come from the built-in ``levenshtein`` (code points, JVM side).

The summary first groups rows on the value pair -- map-side combined, so a
pair repeated across a third of the table costs one row per map task -- and
computes each distinct pair's distance once, weighting every measure by the
pair's count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import qcol
from ..functions import constants as K


def _text(c: str) -> Column:
    return F.coalesce(qcol(c).cast("string"), F.lit(""))


def ratio_expr(a: Column, b: Column, distance: Column | None = None) -> Column:
    """L2: ``(maxlen - d) / maxlen``, 1.0 when both are empty."""
    d = distance if distance is not None else F.levenshtein(a, b)
    m = F.greatest(F.length(a), F.length(b))
    return F.when(m == 0, F.lit(1.0)).otherwise((m - d) / m)


def rule_label(threshold: float) -> str:
    return f"{K.RULE_SIMILARITY} (threshold: {threshold})"


def comparisons(df: DataFrame, column1: str, column2: str, threshold: float = 0.8,
                key: str | None = None, min_similarity: float = 0.0) -> DataFrame:
    """L3: per-row detail: ``row_index, value1, value2, distance,
    similarity_ratio, is_similar``.  ``key`` names the row identifier; without
    one a generated id is used (Spark rows have no inherent position).

    Rows below ``min_similarity`` are left out, and their distance is not worked out: it
    ends as soon as the lengths or the distance so far leave the band (``band_distance``)."""
    v1, v2 = _text(column1), _text(column2)
    rid = qcol(key) if key else F.monotonically_increasing_id()
    base = df.select(rid.alias("row_index"), v1.alias("value1"), v2.alias("value2"))
    d = band_distance("value1", "value2", min_similarity) if min_similarity > 0 else F.levenshtein("value1", "value2")
    # a generated column is worked out once; a projected one would be again in every condition on it
    base = base.select("*", F.explode(F.array(d)).alias("distance"))
    if min_similarity > 0:
        base = base.filter("distance >= 0")
    out = base.select("row_index", "value1", "value2", "distance",
                      ratio_expr(F.col("value1"), F.col("value2"), F.col("distance")).alias("similarity_ratio")) \
        .withColumn("is_similar", F.col("similarity_ratio") >= threshold)
    return out.filter(F.col("similarity_ratio") >= min_similarity) if min_similarity > 0 else out


def band_distance(a: str, b: str, min_similarity: float) -> Column:
    """Edit distance of two columns, -1 where it is above what ``min_similarity`` allows (one more is
    let through, so that rounding decides nothing here): only a band of the table of that width is
    filled, and none where the lengths differ by more."""
    longer = f"greatest(length({a}), length({b}))"
    return F.expr(f"levenshtein({a}, {b}, CAST(floor((1 - {float(min_similarity)!r}D) * {longer}) AS INT) + 1)")


def filter_band(details: DataFrame, min_similarity: float = 0.0,
                max_similarity: float = 1.0) -> DataFrame:
    """Detail rows with ``min <= ratio <= max``; ratio shown at 3 dp."""
    r = F.col("similarity_ratio")
    return details.filter((r >= min_similarity) & (r <= max_similarity)) \
        .withColumn("similarity_ratio", F.bround(r, 3))


def pair_table(df: DataFrame, column1: str, column2: str) -> DataFrame:
    """Distinct value pairs with their count, distance and ratio."""
    pairs = df.select(_text(column1).alias("value1"), _text(column2).alias("value2")) \
        .groupBy("value1", "value2").agg(F.count(F.lit(1)).alias("n"))
    d = F.levenshtein("value1", "value2")
    return pairs.select("value1", "value2", "n", d.alias("distance"),
                        ratio_expr(F.col("value1"), F.col("value2"), d).alias("ratio"))


def summary(df: DataFrame, column1: str, column2: str, threshold: float = 0.8,
            dedupe_pairs: bool = True) -> DataFrame:
    """L4 + L5: one row of counts, statistics and distribution buckets.

    ``dedupe_pairs`` (default) computes each distinct value pair once after a
    map-side combined ``groupBy``: best when pairs repeat.  With ``False``
    every row gets its own distance and the aggregates stay map-side partial
    with no shuffle at all: best for mostly-unique pairs."""
    if dedupe_pairs:
        pt = pair_table(df, column1, column2)
    else:
        v1, v2 = _text(column1), _text(column2)
        d0 = F.levenshtein(v1, v2)
        pt = df.select(v1.alias("value1"), v2.alias("value2"), F.lit(1).cast("long").alias("n"),
                       d0.alias("distance"), ratio_expr(v1, v2, d0).alias("ratio"))
    n, r, d = F.col("n"), F.col("ratio"), F.col("distance")

    def w(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("long")

    first = pt.agg(
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_comparisons"),
        F.sum((r - 0.5) * n).alias("_s1"), F.sum((r - 0.5) * (r - 0.5) * n).alias("_s2"),
        # an aggregated label stays a join key (a literal one would leave a join without a key)
        F.max(F.lit(f"{column1} vs {column2}")).alias("_pair"),
        w(r >= threshold).alias("similar_pairs"),
        w(r == 1.0).alias("exact_matches"),
        w((r >= threshold) & (r < 1.0)).alias("within_threshold"),
        w(r < threshold).alias("outside_threshold"),
        (F.sum(r * n) / F.sum(n)).alias("average_similarity"),
        F.min(r).alias("min_similarity"), F.max(r).alias("max_similarity"),
        (F.sum(d * n) / F.sum(n)).alias("average_distance"),
        F.min(d).alias("min_distance"), F.max(d).alias("max_distance"),
        *[w(((r >= lo) if lo is not None else F.lit(True))
            & ((r < hi) if hi is not None else F.lit(True))).alias(name)
          for name, lo, hi in K.SIMILARITY_BUCKETS])
    tot = F.col("total_comparisons")
    zero = F.lit(0.0)
    # population variance from count-weighted moments around 1/2 (ratios lie in 0..1)
    var = F.col("_s2") / tot - (F.col("_s1") / tot) * (F.col("_s1") / tot)
    var = F.when(var > 1e-15, var).otherwise(zero)
    return first.select(
        F.coalesce("_pair", F.lit(f"{column1} vs {column2}")).alias("column_pair"),
        F.lit(float(threshold)).alias("similarity_threshold"),
        "total_comparisons", "similar_pairs",
        F.coalesce(F.try_divide(F.col("similar_pairs"), tot) * 100, zero).alias("similarity_percentage"),
        "exact_matches", "within_threshold", "outside_threshold",
        F.coalesce(F.col("average_similarity"), zero).alias("average_similarity"),
        F.coalesce(F.col("min_similarity"), zero).alias("min_similarity"),
        F.coalesce(F.col("max_similarity"), zero).alias("max_similarity"),
        F.coalesce(F.when(tot > 0, F.sqrt(var)), zero).alias("std_similarity"),
        F.coalesce(F.col("average_distance"), zero).alias("average_distance"),
        F.coalesce(F.col("min_distance"), F.lit(0)).alias("min_distance"),
        F.coalesce(F.col("max_distance"), F.lit(0)).alias("max_distance"),
        *[name for name, _, _ in K.SIMILARITY_BUCKETS])


def as_rule_result(summ: DataFrame, seq: int = 0, threshold: float | None = None) -> DataFrame:
    """The similarity summary recorded as a rule result (rate = similar %).
    Pass ``threshold`` to label it exactly as written (``1`` stays ``1``)."""
    label = F.lit(rule_label(threshold)) if threshold is not None else F.concat(
        F.lit(K.RULE_SIMILARITY + " (threshold: "),
        F.col("similarity_threshold").cast("string"), F.lit(")"))
    return summ.select(
        F.lit(seq).alias("seq"), F.col("column_pair").alias("column"),
        label.alias("rule"),
        F.col("total_comparisons").alias("total"), F.col("similar_pairs").alias("passed"),
        (F.col("total_comparisons") - F.col("similar_pairs")).alias("failed"),
        F.col("similarity_percentage").alias("success_rate"))


def summary_table(results: DataFrame, summaries: DataFrame) -> DataFrame:
    """One row per similarity result in ``results``; numbers stay numbers."""
    sim = results.filter(F.col("rule").contains(K.RULE_SIMILARITY)).select("column")
    return sim.join(summaries, sim["column"] == summaries["column_pair"]).select(
        F.col("column_pair").alias("Column_Pair"),
        F.col("total_comparisons").alias("Total_Comparisons"),
        F.col("similar_pairs").alias("Similar_Pairs"),
        F.bround("similarity_percentage", 1).alias("Similarity_Percentage"),
        F.bround("average_similarity", 3).alias("Avg_Similarity"),
        F.bround("min_similarity", 3).alias("Min_Similarity"),
        F.bround("max_similarity", 3).alias("Max_Similarity"),
        F.bround("average_distance", 1).alias("Avg_Distance"),
        F.col("similarity_threshold").alias("Threshold_Used"))
