"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of ``width`` consecutive words (an item
with fewer words, but not none, is one window).  A document word is *hit* when
it lies inside any occurrence of a window.

1. Every window is a set of word shingles.  A first pass counts, over all
   documents, how often each benchmark shingle occurs (counts are combined
   before the shuffle): that is the rarity order.
2. Containment asks for all shingles of the window, so its necessary prefix is
   its single rarest shingle.  Windows are indexed by that shingle.
3. A second pass looks every document shingle up in the index.  The length
   bound (the document has at least the window's words) and the positional
   bound (the window must begin and end inside the document when the shingle
   sits at its place) leave candidates, which are verified word by word.

The index is broadcast in slices of at most ``max_windows`` windows: a slice
has a proven size, and a larger benchmark takes more slices.  Documents never
meet each other, so no hot source or group of copies meets in one task.

Defined results: a null or empty text has no words (0 words, not
contaminated); a null or word-less item has no window; repeated item ids count
once for a document; repeated document rows each get their own row; an empty
benchmark gives clean documents.  Other columns of either table are ignored
by ``contamination`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .store import kept

_PIECE = 1 << 20              # bytes of text whose words are looked up at once
_WINDOWS = "item string, words array<binary>"
_BITS = 20


def _item_windows(batches, width: int):
    table = X.alnum_table()
    for batch in batches:
        for part in X.pieces(batch):
            w = X.Words(*X.utf8(part.column("text")), table)
            ids = part.column("item").to_pylist()
            rows = []
            for i, (lo, n) in enumerate(zip(w.first[:-1], w.n)):
                size = min(width, int(n))
                for k in range(int(n) - size + 1 if n else 0):
                    rows.append((ids[i], [w.text(j) for j in range(lo + k, lo + k + size)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()),
                 pa.array([r[1] for r in rows], pa.list_(pa.binary()))],
                names=["item", "words"])


def item_windows(benchmark: DataFrame, width: int, max_windows: int, item_col: str = "item_id",
                 text_col: str = "text") -> tuple[DataFrame, int]:
    """The distinct windows of all items, dealt by a hash into slices of about ``max_windows``."""
    rows = (benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
            .mapInArrow(lambda it: _item_windows(it, width), _WINDOWS)
            .groupBy("words").agg(F.collect_set("item").alias("items")))
    rows = kept(rows, "bench-windows")
    slices = max(1, -(-rows.count() // max_windows))
    return rows.withColumn("slice", F.pmod(F.xxhash64("words"), F.lit(slices))), slices


class _Slice:
    """One broadcast slice: windows, their shingles, and which shingle leads to which window."""

    def __init__(self, rows, shingle: int):
        self.text = [b" ".join(bytes(x) for x in r["words"]) for r in rows]
        self.items = [sorted(x for x in r["items"] if x is not None) for r in rows]
        self.size = np.array([len(r["words"]) for r in rows], np.int64)
        w = X.Words(*X.utf8(pa.array([b" ".join(self.text).decode()])), X.alnum_table())
        begin = np.r_[0, np.cumsum(self.size)]
        lengths = np.minimum(self.size, shingle)
        self.lengths = sorted(set(lengths.tolist()))
        hashes, owner, offset = [], [], []
        for k in self.lengths:
            h = X.windows(w.hash, k, X._BASE + 2 * k)
            for i in np.flatnonzero(lengths == k):
                span = np.arange(begin[i], begin[i] + self.size[i] - k + 1)
                hashes.append(h[span])
                owner.append(np.full(len(span), i))
                offset.append(np.arange(len(span)))
        self.shingle_hash = np.concatenate(hashes) if hashes else np.zeros(0, X.U)
        self.shingle_owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        self.shingle_offset = np.concatenate(offset) if offset else np.zeros(0, np.int64)
        self.shingle_length = lengths[self.shingle_owner] if len(self.shingle_owner) else np.zeros(0, np.int64)
        self.index(self.shingle_hash, self.shingle_owner, self.shingle_offset)

    def index(self, h, owner, offset):
        order = np.argsort(h, kind="stable")
        self.h, self.owner, self.offset = h[order], owner[order], offset[order]
        self.key, self.at = np.unique(self.h, return_index=True)
        self.at = np.r_[self.at, len(self.h)]
        self.filter = np.zeros(1 << _BITS, bool)
        self.filter[(self.key >> X.U(64 - _BITS)).astype(np.int64)] = True

    def keep_rarest(self, counts: dict):
        """Leave the necessary prefix only: each window's rarest shingle (then the smallest hash)."""
        c = np.array([counts.get(int(x), 0) for x in self.shingle_hash], np.int64)
        order = np.lexsort((self.shingle_hash, c, self.shingle_owner))
        lead = order[np.r_[True, np.diff(self.shingle_owner[order]) != 0]] if len(order) else order
        self.index(self.shingle_hash[lead], self.shingle_owner[lead], self.shingle_offset[lead])
        return self

    def find(self, w: X.Words):
        """(word position, index into ``key``) of every indexed shingle in the batch."""
        where, which = [], []
        for k in self.lengths:
            h = X.windows(w.hash, k, X._BASE + 2 * k)
            ok = self.filter[(h >> X.U(64 - _BITS)).astype(np.int64)]
            ok &= X.inside(w.first, w.n, k, len(w.hash))
            p = np.flatnonzero(ok)
            if not len(p) or not len(self.key):
                continue
            j = np.minimum(np.searchsorted(self.key, h[p]), len(self.key) - 1)
            same = self.key[j] == h[p]
            where.append(p[same])
            which.append(j[same])
        if not where:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(where), np.concatenate(which)


def _count_shingles(batches, shared):
    s, table = shared.value, X.alnum_table()
    total = np.zeros(len(s.key), np.int64)
    for batch in batches:
        for part in X.pieces(batch, limit=_PIECE):
            _, which = s.find(X.Words(*X.utf8(part.column("text")), table))
            total += np.bincount(which, minlength=len(s.key))
    X.release()
    hit = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(X.shift_all(s.key[hit])), pa.array(total[hit])], names=["h", "n"])


def _matches(s: _Slice, w: X.Words):
    """(window, first word) of every verified occurrence."""
    where, which = s.find(w)
    many = s.at[which + 1] - s.at[which]
    pos = np.repeat(where, many)
    entry = np.repeat(s.at[which], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    win, begin = s.owner[entry], pos - s.offset[entry]
    doc = w.doc[pos] if len(pos) else pos
    fits = (begin >= w.first[doc]) & (begin + s.size[win] <= w.first[doc + 1])
    for a, b in zip(win[fits].tolist(), begin[fits].tolist()):
        if b" ".join(w.text(i) for i in range(b, b + s.size[a])) == s.text[a]:
            yield a, b


def _hits(batches, shared, key_cols):
    """One row for each document row: words, covered word runs, items."""
    s, table = shared.value, X.alnum_table()
    for batch in batches:
        for part in X.pieces(batch, limit=_PIECE):
            w = X.Words(*X.utf8(part.column("text")), table)
            cover = np.zeros(len(w.hash) + 1, np.int64)
            items: dict[int, set] = {}
            for a, b in _matches(s, w):
                cover[b] += 1
                cover[b + s.size[a]] -= 1
                items.setdefault(int(w.doc[b]), set()).update(s.items[a])
            on = np.cumsum(cover[:-1]) > 0
            p = np.flatnonzero(on)
            d = w.doc[p]
            breaks = np.r_[True, (np.diff(p) > 1) | (np.diff(d) > 0)] if len(p) else np.zeros(0, bool)
            first = np.flatnonzero(breaks)
            last = np.r_[first[1:], len(p)][:len(first)] - 1
            begin, end, of = p[first] - w.first[d[first]], p[last] + 1 - w.first[d[last]], d[first]
            spans = [[] for _ in range(part.num_rows)]
            for i, x, y in zip(of.tolist(), begin.tolist(), end.tolist()):
                spans[i].append((x, y))
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in key_cols]
                + [pa.array(w.n.astype(np.int64)),
                   pa.array([[x for x, _ in v] for v in spans], pa.list_(pa.int64())),
                   pa.array([[y for _, y in v] for v in spans], pa.list_(pa.int64())),
                   pa.array([sorted(items.get(i, ())) for i in range(part.num_rows)], pa.list_(pa.string()))],
                names=[*key_cols, "n_words", "begins", "ends", "items"])


def _summary(batches):
    """Per row: hit words from the union of the covered runs, and the item digest."""
    for batch in batches:
        hit, n_items, sha = [], [], []
        for b, e, items in zip(*(batch.column(c).to_pylist() for c in ("begins", "ends", "items"))):
            total, reach = 0, -1
            for x, y in sorted(zip(b, e)):
                total += max(0, y - max(x, reach))
                reach = max(reach, y)
            names = sorted(set(items))
            hit.append(total)
            n_items.append(len(names))
            sha.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        keep = [c for c in batch.schema.names if c not in ("begins", "ends", "items")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in keep]
            + [pa.array(hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string()),
               pa.array([x > 0 for x in hit], pa.bool_())],
            names=[*keep, "n_hit", "n_items", "items_sha256", "contaminated"])


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, shingle: int = 4,
                  max_windows: int = 200_000, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    wins, slices = item_windows(benchmark, width, max_windows)
    texts = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keys = "doc_id long"
    if slices > 1:                      # rows of several passes meet again by a number fixed once
        texts = kept(texts.withColumn("row", F.monotonically_increasing_id()), "bench-docs")
        keys += ", row long"
    cols = [c.split()[0] for c in keys.split(",")]
    passes = []
    for k in range(slices):
        s = _Slice(wins.filter(F.col("slice") == k).drop("slice").collect(), shingle)
        first = spark.sparkContext.broadcast(s)
        counts = (texts.select("text").mapInArrow(lambda it, b=first: _count_shingles(it, b), "h long, n long")
                  .groupBy("h").agg(F.sum("n").alias("n")).collect())
        s = s.keep_rarest({r["h"] & (2 ** 64 - 1): r["n"] for r in counts})
        second = spark.sparkContext.broadcast(s)
        passes.append(texts.mapInArrow(
            lambda it, b=second: _hits(it, b, cols),
            f"{keys}, n_words long, begins array<long>, ends array<long>, items array<string>"))
    found = passes[0]
    if slices > 1:
        for other in passes[1:]:
            found = found.unionByName(other)
        found = found.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            *[F.flatten(F.collect_list(c)).alias(c) for c in ("begins", "ends", "items")])
    return (found.mapInArrow(_summary, ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name not in ("begins", "ends", "items"))
        + ", n_hit long, n_items long, items_sha256 string, contaminated boolean")
        .select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))


def _flag(batches, shared):
    s, table = shared.value, X.alnum_table()
    for batch in batches:
        for part in X.pieces(batch, "__text", _PIECE):
            w = X.Words(*X.utf8(part.column("__text")), table)
            bad = {int(w.doc[b]) for _, b in _matches(s, w)}
            yield part.filter(pa.array([i not in bad for i in range(part.num_rows)], pa.bool_()))
    X.release()


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, shingle: int = 4,
                  max_windows: int = 200_000, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold any window; all columns are kept."""
    spark = docs.sparkSession
    wins, slices = item_windows(benchmark, width, max_windows)
    # columns go through Arrow under plain names, whatever they are called
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = F.col(f"c{docs.columns.index(text_col)}")
    out = plain.withColumn("__text", text)
    schema = out.schema
    for k in range(slices):
        s = _Slice(wins.filter(F.col("slice") == k).drop("slice").collect(), shingle)
        first = spark.sparkContext.broadcast(s)
        counts = (plain.select(text.alias("text")).mapInArrow(lambda it, b=first: _count_shingles(it, b), "h long, n long")
                  .groupBy("h").agg(F.sum("n").alias("n")).collect())
        second = spark.sparkContext.broadcast(s.keep_rarest({r["h"] & (2 ** 64 - 1): r["n"] for r in counts}))
        out = out.mapInArrow(lambda it, b=second: _flag(it, b), schema)
    return out.drop("__text").toDF(*docs.columns)
