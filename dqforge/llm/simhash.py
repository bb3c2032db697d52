"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; its embedding is the
32 bit counts.  The Manhattan distance of two embeddings is a lower bound of
the Hamming distance.  Written as a thermometer code (0 -> 00, 1 -> 01,
2 -> 11) the Manhattan distance is the number of differing code bits.

Grid range-join: the 32 counts form ``BLOCKS`` = 8 blocks of four.  A pair
within Manhattan distance ``d`` leaves at least ``8 - d`` blocks unchanged, so
with one grid for each choice of ``8 - d`` blocks (70 grids for d = 4) it
shares a cell of at least one grid.  Inside a cell pairs are compared by
Manhattan distance, and those within it exactly by bits.

* Equal fingerprints are one vertex: a group of copies is collapsed by a
  map-side combined minimum before any join.
* A cell emits a spanning forest of its links, never its pairs; forests are
  reduced again per task before they are shuffled.
* A cell with more than ``cell_limit`` fingerprints is cut into chunks and
  every pair of chunks is a task of its own: bounded memory, no lost link.

Defined results: null, empty and blank texts have fingerprint zero and link
like any other; fewer words than the shingle length are one shingle; repeated
rows are kept; rows with a null doc_id take part, and a component of such rows
only has a null id; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .components import components
from .store import kept

BLOCKS = 8
_ODD = X.U(0x5555555555555555)


def shingle_hashes(part_text, k: int):
    """(xxh64 of every shingle, shingles of each row) of a text column."""
    data, off = X.utf8(part_text)
    w = X.Words(data, off, X.space_table())
    lower = data.copy()
    upper = (lower >= 65) & (lower <= 90)
    lower[upper] += 32
    # words with one space after each: shingles are slices of this buffer
    on = w.bytes != 0
    keep = on.copy()
    after = w.end[w.end < len(on)]
    keep[after] |= ~on[after]
    lower[~on] = 32
    clean = lower[keep].tobytes()
    place = np.cumsum(keep) - 1
    begin, end = place[w.start], place[w.end - 1] + 1
    n = w.n
    many = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    first = np.repeat(w.first[:-1], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    last = np.minimum(first + k, np.repeat(w.first[1:], many)) - 1
    digest = xxhash.xxh64_intdigest
    view = memoryview(clean)
    h = np.fromiter((digest(view[a:b], 42) for a, b in zip(begin[first].tolist(), end[last].tolist())),
                    dtype=X.U, count=len(first))
    return h, many


def majority_bits(h: np.ndarray, many: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """Per row: the bits set in over half of its hashes."""
    ones = np.zeros((len(many), 64), np.int64)
    row = np.repeat(np.arange(len(many)), many)
    for lo in range(0, len(h), step):
        part, own = h[lo:lo + step], row[lo:lo + step]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cut = np.flatnonzero(np.r_[True, np.diff(own) > 0])
        ones[own[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    on = (2 * ones > many[:, None]).astype(np.uint8)
    return np.packbits(on, axis=1, bitorder="little").view(X.U).ravel() if len(on) else np.zeros(0, X.U)


def _fingerprints(batches, k: int):
    for batch in batches:
        for part in X.pieces(batch, limit=1 << 20):
            fp = majority_bits(*shingle_hashes(part.column("text"), k))
            keep = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(X.shift_all(fp))],
                                             names=[*keep, "fp"])
        X.release()


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` is the fingerprint as a signed 64-bit integer."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(lambda it: _fingerprints(it, shingle), "doc_id long, fp long")


def embedding(fp: np.ndarray) -> np.ndarray:
    """Thermometer code of the 32 two-bit counts."""
    low, high = fp & _ODD, (fp >> X.U(1)) & _ODD
    return (low | high) | ((low & high) << X.U(1))


def _cells(batches, bits: int):
    grids = list(combinations(range(BLOCKS), BLOCKS - bits))
    for batch in batches:
        for lo in range(0, batch.num_rows, 1 << 14):
            part = batch.slice(lo, 1 << 14)
            fp = part.column(0).to_numpy(zero_copy_only=False).view(X.U)
            code = embedding(fp).view(np.uint8).reshape(-1, 8).astype(X.U)
            key = np.empty((len(fp), len(grids)), X.U)
            for g, own in enumerate(grids):
                k = np.full(len(fp), X.U(g))
                for b in own:
                    k = k * X.U(257) + code[:, b]
                key[:, g] = X.mix(k) if len(own) > 6 else k
            yield pa.RecordBatch.from_arrays(
                [pa.array(X.shift_all(key.ravel())), pa.array(X.shift_all(np.repeat(fp, len(grids))))],
                names=["cell", "fp"])


def _near(a, b, bits: int):
    """Manhattan bound first, then the exact distance."""
    near = np.bitwise_count(embedding(a) ^ embedding(b)) <= bits
    near[near] = np.bitwise_count((a ^ b)[near] if np.ndim(b) else a[near] ^ b) <= bits
    return near


def _forest(fp: np.ndarray, bits: int):
    """Spanning forest of the links inside one cell."""
    rest, out, queue = fp, [], []
    while len(rest) or queue:
        if not queue:
            queue, rest = [rest[0]], rest[1:]
        at = queue.pop()
        near = _near(rest, at, bits)
        if near.any():
            found = rest[near]
            out.append(np.c_[np.full(len(found), at), found])
            queue.extend(found)
            rest = rest[~near]
        if not len(rest):
            break
    return out


class _Roots:
    """Union-find over the links of a task: what it hands on is a forest."""

    def __init__(self):
        self.up = {}

    def root(self, x):
        while self.up.get(x, x) != x:
            self.up[x] = self.up.get(self.up[x], self.up[x])
            x = self.up[x]
        return x

    def add(self, pairs):
        for a, b in pairs:
            a, b = self.root(a), self.root(b)
            if a != b:
                self.up.setdefault(min(a, b), min(a, b))
                self.up[max(a, b)] = min(a, b)

    def rows(self):
        pairs = [(x, self.root(x)) for x in self.up]
        pairs = [(x, y) for x, y in pairs if x != y]
        self.up = {}
        kind = lambda i: pa.array(X.shift_all(np.array([p[i] for p in pairs], X.U)))
        return pa.RecordBatch.from_arrays([kind(0), kind(1)], names=["u", "v"])


def _links(batches, bits: int, small: int = 64, most: int = 200_000):
    """Batches sorted by cell -> links; a cell that spans batches is carried over."""
    roots, carry = _Roots(), None

    def work(keys, fp):
        edge = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        size = np.diff(np.r_[edge, len(fp)])
        run = np.repeat(np.arange(len(edge)), size)
        for a in edge[size > small]:
            for pairs in _forest(fp[a:a + size[run[a]]], bits):
                roots.add(pairs.tolist())
        use = np.flatnonzero((size[run] > 1) & (size[run] <= small))
        f, r = fp[use], run[use]
        for d in range(1, small):
            if len(f) <= d:
                break
            same = np.flatnonzero(r[d:] == r[:-d])
            if not len(same):
                break
            a, b = f[same], f[same + d]
            near = _near(a, b, bits)
            roots.add(zip(a[near].tolist(), b[near].tolist()))

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.c_[tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "t1", "t2"))]
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(X.U)
        if carry is not None:
            keys, fp = np.r_[carry[0], keys], np.r_[carry[1], fp]
        done = int(np.argmax((keys == keys[-1]).all(axis=1)))
        carry = (keys[done:], fp[done:])
        if done:
            work(keys[:done], fp[:done])
        if len(roots.up) > most:
            yield roots.rows()
    if carry is not None:
        work(*carry)
    if roots.up:
        yield roots.rows()


def near_links(vertices: DataFrame, bits: int = 4, cell_limit: int = 4096, task_cells: int = 1 << 20) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of ``vertices.fp`` within ``bits``."""
    if not 0 <= bits < BLOCKS:
        raise ValueError(f"bits must be from 0 to {BLOCKS - 1}")
    # a task counts about ``task_cells`` cells, nearly all of them distinct; a stored table of fingerprints is a few files
    tasks = max(1, -(-vertices.count() * comb(BLOCKS, bits) // task_cells))
    cells = vertices.select("fp").repartition(tasks, "fp").mapInArrow(lambda it: _cells(it, bits), "cell long, fp long")
    large = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell_limit)
    chunks = F.ceil(F.col("n") / cell_limit).cast("long")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    dealt = (cells.join(large.select(F.col("cell").alias("hot"), chunks.alias("chunks")),
                        F.col("cell") == F.col("hot"), "left")
             .withColumn("own", own)
             .withColumn("other", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long")))
                                            .otherwise(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))))
             .select("cell", "fp", F.coalesce(F.least("own", "other"), F.lit(0)).alias("t1"),
                     F.coalesce(F.greatest("own", "other"), F.lit(0)).alias("t2")))
    return (dealt.repartition("cell", "t1", "t2").sortWithinPartitions("cell", "t1", "t2")
            .mapInArrow(lambda it: _links(it, bits), "u long, v long"))


def _named(rows: DataFrame, bits: int, cell_limit: int) -> DataFrame:
    """Of (doc_id, fp) rows: (vertex, component_id, root), one for each fingerprint."""
    vertices = kept(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-vertices")
    member = components(near_links(vertices, bits, cell_limit))
    linked = (member.select(F.col("u").alias("fp"), F.col("v").alias("root"))
              .unionByName(member.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
              .join(vertices, "fp"))
    least = linked.groupBy("root").agg(F.min("rep").alias("component"))
    named = linked.join(least, "root").select(F.col("fp").alias("linked_fp"), "root", "component")
    # kept: a later join then has two plain shuffled sides, which AQE can split at a hot fingerprint
    return kept(vertices.join(named, F.col("fp") == F.col("linked_fp"), "left")
                .select(F.col("fp").alias("vertex"), F.coalesce("component", "rep").alias("component_id"),
                        F.coalesce("root", "fp").alias("root")), "simhash-named")


def near_duplicates(docs: DataFrame, shingle: int = 4, bits: int = 4, cell_limit: int = 4096,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of every row."""
    rows = kept(fingerprints(docs, shingle, id_col, text_col), "simhash")
    known = _named(rows, bits, cell_limit)
    return (rows.join(known, F.col("fp") == F.col("vertex"))
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def deduplicate(docs: DataFrame, shingle: int = 4, bits: int = 4, cell_limit: int = 4096, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (a null id only where
    the component has no other), of equal ids the first as stored.  All columns are kept."""
    whole = kept(docs.withColumn("__row", F.monotonically_increasing_id()), "simhash-docs")
    source = whole.select("__row", F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = kept(source.mapInArrow(lambda it: _fingerprints(it, shingle), "__row long, doc_id long, fp long"), "simhash")
    known = _named(rows, bits, cell_limit)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row"))
    stay = (rows.groupBy("fp").agg(best.alias("best")).join(known, F.col("fp") == F.col("vertex"))
            .groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.__row").alias("__stays")))
    return whole.join(kept(stay, "simhash-stay"), F.col("__row") == F.col("__stays"), "left_semi").drop("__row")
