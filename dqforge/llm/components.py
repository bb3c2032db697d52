"""Connected components of a link table, by alternating star contractions.

Each round is two grouped minima with joins; no component is ever gathered in
one place.  Rounds are cut by tables in the shared checkpoint folder, so a lost
executor never recomputes more than one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import kept


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    return (both.join(least, both["u"] == least["c"]).filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
    moved = down.join(least, down["u"] == least["c"])
    return (moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).filter("u != v").distinct())


def _state(e: DataFrame):
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).first())


def components(links: DataFrame) -> DataFrame:
    """``links(u, v)`` -> ``(u, v)``: every linked vertex ``u`` with the smallest vertex ``v`` of
    its component (that vertex itself is not listed).  Self-links and repeats are allowed."""
    e = kept(links.filter("u != v").distinct(), "links")
    state = _state(e)
    while state[0]:
        e = kept(_small_star(_large_star(e)), "links")
        now = _state(e)
        if now == state:
            break
        state = now
    return e
