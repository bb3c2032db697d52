"""Exact quantiles of many columns, each rank bracketed by count.

A mergeable sketch (KLL) of each column brackets every wanted rank between two values of
the data.  One counting pass then tells how many values lie below, inside and between the
brackets and counts the values inside one by one; nothing else is shuffled.  As brackets
are cut by count and not by value, no spread of the values makes them large: a quantile's
bracket holds about ``6 * rank_error()`` of the rows.

Where that is still more than one task should order (``LIMIT`` distinct values of a
column), the counted values -- a table of that small share -- are kept and cut into cells
of about equally many, again and again, until few are left around each rank.  The source
is never read again.

The counts prove a bracket: a rank that falls outside (which the sketch's bound all but
excludes) opens the brackets and counts again, so the result is exact in any case.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: size of a column's sketch (about 47 KB), see ``rank_error``
SKETCH_K = 2048
LIMIT = 100_000
#: columns with fewer values are counted whole
FEW = 10_000
#: cells that a large group of kept values is cut into
_CELLS = 64

#: closed value range; None is open
Range = tuple[float | None, float | None]


@dataclass(frozen=True)
class Wanted:
    """One rank (from 0) of a group, to be found under ``name``."""
    group: int
    rank: int
    name: tuple


def rank_error(k: int = SKETCH_K) -> float:
    """Share of the values by which a KLL sketch of size ``k`` misses a rank (99 % confidence)."""
    return 2.296 / k ** 0.9021


def bracket_ends(sketch: str, probs, k: int = SKETCH_K) -> str:
    """Values at both sides of each of ``probs``, low and high in turn, from a sketch that holds values (SQL)."""
    d = 2 * rank_error(k)
    ends = [min(max(p + s, 0.0), 1.0) for p in probs for s in (-d, d)]
    return f"kll_sketch_get_quantile_double({sketch}, array({', '.join(map(literal, ends))}))"


def literal(x: float) -> str:
    """A double in SQL text."""
    return f"{x!r}D" if math.isfinite(x) else f"double('{x}')"


def neighbours(n: int, p: float) -> tuple[int, int, float]:
    """Ranks on both sides of the quantile's place among ``n`` values, and its share of the way."""
    spot = p * (n - 1)
    low = int(spot)
    return low, min(low + 1, n - 1), spot - low


def interpolate(a: float, b: float, part: float) -> float:
    """numpy's linear interpolation, written as numpy writes it."""
    return b - (b - a) * (1 - part) if part >= 0.5 else a + (b - a) * part


def disjoint(ranges: list[Range]) -> list[Range]:
    """Ranges in ascending order, overlapping ones joined."""
    low = lambda r: float("-inf") if r[0] is None else r[0]
    out: list[Range] = []
    for lo, hi in sorted(ranges, key=low):
        if out and (out[-1][1] is None or lo is None or lo <= out[-1][1]):
            top = None if hi is None or out[-1][1] is None else max(hi, out[-1][1])
            out[-1] = (out[-1][0], top)
        else:
            out.append((lo, hi))
    return out


def zone(x: str, ranges: list[Range]) -> str:
    """Odd numbers are the ranges, even numbers what lies between them, in ascending order (SQL)."""
    out = ""
    for i, (lo, hi) in enumerate(ranges):
        if lo is not None:
            out += f" WHEN {x} < {literal(lo)} THEN {2 * i}"
        out += f" WHEN {'TRUE' if hi is None else f'{x} <= {literal(hi)}'} THEN {2 * i + 1}"
    return f"CASE{out} ELSE {2 * len(ranges)} END" if out else "0"


def quantiles(src: DataFrame, values: dict[int, str], counts: dict[int, int], ends: dict[int, list[float]],
              probs: list[float], k: int = SKETCH_K, limit: int = LIMIT, few: int = FEW) -> dict[int, list[float]]:
    """The quantiles ``probs`` of each column, given its non-null count and its ``bracket_ends``."""
    have = {c: n for c, n in counts.items() if n}
    wanted, ranges = [], {}
    for c, n in have.items():
        for q, p in enumerate(probs):
            a, b, _ = neighbours(n, p)
            wanted += [Wanted(c, a, (c, q, 0)), Wanted(c, b, (c, q, 1))]
        ranges[c] = [(None, None)] if n <= few else [(ends[c][2 * q], ends[c][2 * q + 1]) for q in range(len(probs))]
    share = min(1.0, 6 * len(probs) * rank_error(k))
    found = _search(src, values, wanted, ranges, limit, max((n if n <= few else int(n * share) for n in have.values()), default=0))
    out = {}
    for c, n in have.items():
        out[c] = [interpolate(found[c, q, 0], found[c, q, 1], neighbours(n, p)[2]) for q, p in enumerate(probs)]
    return out


def _counted(src: DataFrame, values: dict[int, str], ranges: dict[int, list[Range]]) -> DataFrame:
    """(g, z, x, cnt): the values in the ranges one by one, the others by zone (x is null)."""
    recs = []
    for c, found in ranges.items():
        x, z = values[c], zone(values[c], disjoint(found))
        recs.append(f"named_struct('g', {c}, 'z', CASE WHEN {x} IS NOT NULL THEN {z} END, 'x', {x})")
    return (src.selectExpr(f"inline(array({', '.join(recs)}))").filter("z is not null")
            .selectExpr("g", "z", "CASE WHEN z % 2 = 1 THEN x END AS x")
            .groupBy("g", "z", "x").agg(F.count(F.lit(1)).alias("cnt")))


def _search(src: DataFrame, values: dict[int, str], wanted: list[Wanted], ranges: dict[int, list[Range]],
            limit: int, expected: int) -> dict[tuple, float]:
    if not wanted:
        return {}
    table = _counted(src, values, ranges)
    if expected <= limit:
        found = _pick(table, wanted)
        if None not in found.values():
            return found
        return _search(src, values, wanted, _wider(ranges), limit, limit + 1)
    ensure_checkpoint_dir(src.sparkSession)
    table = table.checkpoint(eager=True)
    moved = _rebase(table, wanted)
    if moved is None:
        return _search(src, values, wanted, _wider(ranges), limit, expected)
    return _narrow(table.filter("x IS NOT NULL").selectExpr("g * 1000 + z AS g", "x", "cnt"), moved, limit)


def _wider(ranges: dict[int, list[Range]]) -> dict[int, list[Range]]:
    """Open ranges: what a bracket that its counts disprove becomes."""
    return {c: [(None, None)] for c in ranges}


def _pick(table: DataFrame, wanted: list[Wanted]) -> dict[tuple, float | None]:
    """The values at the wanted ranks, by a running count of each group's rows."""
    w = Window.partitionBy("g").orderBy("z", "x").rowsBetween(Window.unboundedPreceding, -1)
    t = table.withColumn("begin", F.coalesce(F.sum("cnt").over(w), F.lit(0)))
    by_group: dict[int, list[int]] = {}
    for x in wanted:
        by_group.setdefault(x.group, []).append(x.rank)
    hit = F.lit(False)
    for g, ranks in by_group.items():
        inside = F.lit(False)
        for r in sorted(set(ranks)):
            inside = inside | ((F.col("begin") <= r) & (F.col("begin") + F.col("cnt") > r))
        hit = hit | ((F.col("g") == g) & inside)
    rows = t.filter(hit).collect()                                # at most one row for each wanted rank
    out = {}
    for x in wanted:
        out[x.name] = next((r.x for r in rows if r.g == x.group and r.begin <= x.rank < r.begin + r.cnt), None)
    return out


def _rebase(table: DataFrame, wanted: list[Wanted]) -> list[Wanted] | None:
    """Ranks inside the zone that holds them, zones numbered ``1000 * group + zone``; None if a rank is in no range."""
    totals: dict[int, list[tuple[int, int]]] = {}
    for r in table.groupBy("g", "z").agg(F.sum("cnt").alias("n")).orderBy("g", "z").collect():
        totals.setdefault(r.g, []).append((r.z, r.n))
    out = []
    for x in wanted:
        begin = 0
        for z, n in totals.get(x.group, []):
            if begin <= x.rank < begin + n:
                if z % 2 == 0:
                    return None
                out.append(Wanted(1000 * x.group + z, x.rank - begin, x.name))
                break
            begin += n
    return out


def _cell(x: str, cuts: list[float], first: int = 0) -> str:
    """How many of the ascending ``cuts`` are at or below ``x``, by halving (SQL)."""
    if not cuts:
        return str(first)
    mid = len(cuts) // 2
    return f"CASE WHEN {x} < {literal(cuts[mid])} THEN {_cell(x, cuts[:mid], first)} ELSE {_cell(x, cuts[mid + 1:], first + mid + 1)} END"


def _narrow(rows: DataFrame, wanted: list[Wanted], limit: int) -> dict[tuple, float]:
    """Find ranks in a kept table (g, x, cnt) of distinct values.  Groups of more than ``limit`` values
    are cut into cells of about equally many values; the cells that hold a rank go on."""
    grid = [i / _CELLS for i in range(1, _CELLS)]
    sizes = {r.g: r for r in rows.groupBy("g").agg(F.count(F.lit(1)).alias("rows"), F.percentile_approx("x", grid, 50 * _CELLS).alias("cuts")).collect()}
    large = sorted({x.group for x in wanted if sizes[x.group].rows > limit})
    small = [x for x in wanted if x.group not in large]
    found = _pick(rows.filter(F.col("g").isin(sorted({x.group for x in small}))).withColumn("z", F.lit(1)), small) if small else {}
    if not large:
        return found
    cases = "".join(f" WHEN {g} THEN {_cell('x', sorted(set(sizes[g].cuts)))}" for g in large)
    cells = rows.filter(F.col("g").isin(large)).selectExpr("g", f"CASE g{cases} END AS z", "x", "cnt")
    begins: dict[tuple[int, int], tuple[int, int, int]] = {}
    before: dict[int, int] = {}
    for r in cells.groupBy("g", "z").agg(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("rows")).orderBy("g", "z").collect():
        begin = before.get(r.g, 0)
        begins[r.g, r.z], before[r.g] = (begin, begin + r.n, r.rows), begin + r.n
    moved: dict[tuple[int, int], list[Wanted]] = {}
    for x in (x for x in wanted if x.group in large):
        at = next((g, z) for (g, z), (lo, hi, _) in begins.items() if g == x.group and lo <= x.rank < hi)
        moved.setdefault(at, []).append(x)
    if any(begins[g, z][2] == sizes[g].rows for g, z in moved):
        # distinct values that one cell holds all of cannot be cut by doubles: order them at once
        return found | _pick(rows.withColumn("z", F.lit(1)), [x for x in wanted if x.group in large])
    code = "".join(f" WHEN g = {g} AND z = {z} THEN {i}" for i, (g, z) in enumerate(moved))
    rest = [Wanted(i, x.rank - begins[at][0], x.name) for i, at in enumerate(moved) for x in moved[at]]
    return found | _narrow(cells.selectExpr(f"CASE{code} END AS g", "x", "cnt").filter("g IS NOT NULL"), rest, limit)
