"""Hard-negative mining: exact integer scores of anchors against all rows, tile by tile.

Anchors go out in slices of bounded size; for each slice the table is scanned twice.  A
scan multiplies int64 tiles of anchors and candidates by Strassen's recursion (zero
padded to even halves, integer additions, seven products instead of eight; tiles at the
cutoff are multiplied directly), and pushes the scores into bounded heaps:

1. positive heaps: for each anchor its best rows of the same label;
2. window heaps: for each anchor and positive the best rows of other labels whose score
   lies between ``low`` and ``high`` percent of the positive's.

Heaps of one kind merge: tile into tile inside a task, and those of the tasks by a rank
over what each of them kept.  What moves is at most a heap's size for each anchor and
task; the driver holds one slice of anchors and their positives.  A slice's result is
written to the shared folder, so a lost executor costs tasks of one slice.

Integers wrap modulo 2**64 inside the recursion, which additions and products undo
exactly as long as the scores fit; a tile whose scores (times 100) could leave 63 bits
raises ``OverflowError``.

Defined results: a row with a null id, null label, null vector, or any null or
non-finite component takes no part.  Vectors of unlike length are padded with zeros; an
empty vector is all zeros.  Rows that repeat count one by one, and an anchor's other rows
are those with another id: its own copies are never its positives or negatives, and each
copy of an anchor is an anchor.  Ties go by smaller id.  A positive score below zero has
an empty window.  An empty table has no result.  Other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import fresh_path, kept

CUTOFF = 32                    # tiles with a side of this size or less are multiplied directly
ANCHOR_TILE = 512
CANDIDATE_TILE = 2048
SLICE_ROWS = 4096              # anchors sent to all tasks at a time
SCALE = 256
_RESULT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def _strassen(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    if depth == 0:
        return a @ b.T
    m, n, k = len(a) // 2, len(b) // 2, a.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    # b holds the right factor by columns: b12 is the block that the upper right of the product meets
    b11, b21, b12, b22 = b[:n, :k], b[:n, k:], b[n:, :k], b[n:, k:]
    d = depth - 1
    m1 = _strassen(a11 + a22, b11 + b22, d)
    m2 = _strassen(a21 + a22, b11, d)
    m3 = _strassen(a11, b12 - b22, d)
    m4 = _strassen(a22, b21 - b11, d)
    m5 = _strassen(a11 + a12, b22, d)
    m6 = _strassen(a21 - a11, b11 + b12, d)
    m7 = _strassen(a12 - a22, b21 + b22, d)
    out = np.empty((2 * m, 2 * n), a.dtype)
    out[:m, :n] = m1 + m4 - m5 + m7
    out[:m, n:] = m3 + m5
    out[m:, :n] = m2 + m4
    out[m:, n:] = m1 - m2 + m3 + m6
    return out


def products(a: np.ndarray, b: np.ndarray, cutoff: int = CUTOFF) -> np.ndarray:
    """``a @ b.T`` of int64 tiles (rows are vectors) by Strassen's recursion."""
    m, n, k = len(a), len(b), a.shape[1]
    if not (m and n and k):
        return np.zeros((m, n), np.int64)
    depth = 0
    while min(m, n, k) >> depth > cutoff:
        depth += 1
    step = 1 << depth
    pad = lambda x: np.pad(x, ((0, -len(x) % step), (0, -x.shape[1] % step)))
    return _strassen(pad(a), pad(b), depth)[:m, :n]


class Heaps:
    """For each of ``keys`` the best ``size`` entries by (score descending, id ascending)."""

    def __init__(self, keys: int, size: int):
        self.keys, self.size = keys, size
        self.key, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(keys, np.iinfo(np.int64).min)       # scores below cannot enter any more

    def push(self, key: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(key):
            return
        key, score, ident = np.r_[self.key, key], np.r_[self.score, score], np.r_[self.id, ident]
        order = np.lexsort((ident, -score, key))
        key, score, ident = key[order], score[order], ident[order]
        first = np.r_[0, np.flatnonzero(np.diff(key)) + 1]
        place = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
        stay = place < self.size
        self.key, self.score, self.id = key[stay], score[stay], ident[stay]
        full = place == self.size - 1
        self.floor[key[full]] = score[full]

    def merge(self, other: Heaps) -> None:
        self.push(other.key, other.score, other.id)


def matrix(vectors: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their components as int64 after ``floor(scale * x)``)."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    n = len(vectors)
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(vectors)
    x = np.floor(scale * flat.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64))      # nulls are nan
    row = np.repeat(np.arange(n), size)
    ok = ~vectors.is_null().to_numpy(zero_copy_only=False)
    ok[row[~np.isfinite(x)]] = False
    good = ok[row]
    if good.any() and np.abs(x[good]).max() >= 2.0 ** 62:
        raise OverflowError("a component leaves 63 bits")
    out = np.zeros((n, int(size[ok].max(initial=0))), np.int64)
    at = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
    out[row[good], at[good]] = x[good].astype(np.int64)
    return np.flatnonzero(ok), out[ok]


def _wide(x: np.ndarray, k: int) -> np.ndarray:
    return x if x.shape[1] == k else np.pad(x, ((0, 0), (0, k - x.shape[1])))


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    k = max(anchors.shape[1], rows.shape[1])
    a, b = _wide(anchors, k), _wide(rows, k)
    if a.size and b.size and 100.0 * k * float(np.abs(a).max()) * float(np.abs(b).max()) >= 2.0 ** 63:
        raise OverflowError("scores leave 63 bits")
    return products(a, b)


def _tiles(batches, anchors):
    """(first anchor, scores, anchors' labels and ids, candidates' labels and ids) of every pair of tiles."""
    for batch in batches:
        for lo in range(0, batch.num_rows, CANDIDATE_TILE):
            part = batch.slice(lo, CANDIDATE_TILE)
            ok, x = matrix(part.column("vec"))
            part = part.take(pa.array(ok))
            ident, label = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
            for at in range(0, len(anchors["id"]), ANCHOR_TILE):
                cut = slice(at, at + ANCHOR_TILE)
                yield at, _scores(anchors["x"][cut], x), anchors["label"][cut], anchors["id"][cut], label, ident


def _positives(batches, shared, size):
    anchors = shared.value
    heaps = Heaps(len(anchors["id"]), size)
    for at, s, a_label, a_id, label, ident in _tiles(batches, anchors):
        floor = heaps.floor[at:at + len(a_id), None]
        i, j = np.nonzero((s >= floor) & (a_label[:, None] == label) & (a_id[:, None] != ident))
        heaps.push(i + at, s[i, j], ident[j])
    yield pa.RecordBatch.from_arrays([pa.array(heaps.key), pa.array(heaps.score), pa.array(heaps.id)], names=["key", "score", "id"])


def _negatives(batches, shared, size, low, high):
    anchors = shared.value
    ps = anchors["positive_score"]                                 # anchors x positives; the missing ones are -1
    n, slots = ps.shape
    bottom, top = -((-low * ps) // 100), (high * ps) // 100
    heaps = Heaps(n * slots, size)
    for at, s, a_label, a_id, label, ident in _tiles(batches, anchors):
        cut = slice(at, at + len(a_id))
        other = (a_label[:, None] != label) & (a_id[:, None] != ident)
        floor = heaps.floor.reshape(n, slots)[cut].copy()
        for p in range(slots):
            least = np.maximum(bottom[cut, p], floor[:, p])[:, None]
            i, j = np.nonzero((s >= least) & (s <= top[cut, p, None]) & other)
            heaps.push((i + at) * slots + p, s[i, j], ident[j])
    a, p = heaps.key // slots, heaps.key % slots
    cols = [heaps.key, anchors["id"][a], anchors["positive_id"][a, p], ps[a, p], heaps.score, heaps.id]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "anchor_id", "positive_id", "positive_score", "score", "id"])


def _ranked(heaps: DataFrame, size: int) -> DataFrame:
    """The heaps of all tasks merged: the best ``size`` entries of each key with their rank."""
    w = Window.partitionBy("key").orderBy(F.desc("score"), F.asc("id"))
    return heaps.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= size)


def _slices(anchors: DataFrame, rows: int):
    """Anchors as arrays, at most ``rows`` at a time; the driver holds one partition of a batch of them."""
    have: list = []
    for r in anchors.toLocalIterator():
        have.append(r)
        if len(have) == rows:
            yield have
            have = []
    if have:
        yield have


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row for each anchor, positive and hard negative: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.  ``is_anchor`` is a condition over ``rows``."""
    spark = rows.sparkSession
    vec = F.col(vector_col)
    table = (rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vec.alias("vec"),
                         F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
             .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()))
    candidates = table.select("id", "label", "vec")
    path = fresh_path(spark, "hard-negatives")
    spark.createDataFrame([], _RESULT).write.parquet(path)
    for part in _slices(kept(table.filter("anchor").select("id", "label", "vec"), "hard-negatives-anchors"), slice_rows):
        ok, x = matrix(pa.array([r.vec for r in part], pa.list_(pa.float64())))
        if not len(ok):
            continue
        anchors = {"x": x, "id": np.array([part[i].id for i in ok]), "label": np.array([part[i].label for i in ok])}
        shared = spark.sparkContext.broadcast(anchors)
        best = _ranked(candidates.mapInArrow(lambda it, s=shared: _positives(it, s, positives), "key long, score long, id long"), positives)
        ps, pid = np.full((len(ok), positives), -1, np.int64), np.zeros((len(ok), positives), np.int64)
        for r in best.collect():                                   # at most `positives` rows for each anchor of the slice
            ps[r.key, r.rank - 1], pid[r.key, r.rank - 1] = r.score, r.id
        shared.unpersist()
        asked = spark.sparkContext.broadcast({**anchors, "positive_score": ps, "positive_id": pid})
        found = candidates.mapInArrow(lambda it, s=asked: _negatives(it, s, negatives, low, high),
                                      "key long, anchor_id long, positive_id long, positive_score long, score long, id long")
        (_ranked(found, negatives).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                                          F.col("score").alias("negative_score")).write.mode("append").parquet(path))
        asked.unpersist()
    return spark.read.schema(_RESULT).parquet(path)
