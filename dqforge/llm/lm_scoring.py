"""Language-model scores by deleted interpolation.

Model: ``p(w | v) = l2(b) c(v,w)/c(v) + l1(b) c(w)/N + l0(b) / (V+1)`` where
``b`` is the frequency bucket of the context ``v``.  The weights are learned
by expectation-maximisation on counts held out from the training rows: the
counts of one training fold are deleted from the estimates and predicted by
the rest; the final estimates use all training rows.

How it runs:

* Texts are packed into blocks of about ``block_tokens`` tokens (whole
  documents), kept once in the shared folder.  A token is a 64-bit hash.
* Each block sends its *distinct* words and word pairs with their training
  counts to the shard that owns the hash range -- the pre-aggregated counting
  shuffle, packed arrays instead of one row for each pair.  A very common pair
  is one entry of each block, so no key is hot.
* A shard adds the counts up and answers every block for exactly the entries
  it asked for.  Blocks then score their documents from the answers: no model
  is collected or broadcast, and what is counted grows with the corpus.
* Held-out counts go to the driver as a histogram of (bucket, ratio bins) whose
  size is fixed; EM runs on it there.

Defined results: a null or empty text is the single end token; a null doc_id
counts as a training row; repeated rows are scored (and counted) each; with no
training token every probability is the uniform one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .store import kept

END = X.U(0x656E64)                     # the end token's hash
BUCKETS = 64                            # context counts 0, 1, 2-3, 4-7, ..., one for each power of two
BINS = 128                              # half-octave bins of p / uniform

_BLOCK = "block long, fold boolean, tokens long, trained long, doc_id binary, no_id binary, held binary, n binary, words binary, codes binary"
_ASK = "shard long, size int, block long, fold boolean, keys binary, trained binary"
_ANSWER = "block long, size int, shard long, total binary, folded binary, distinct_words long"


def _pack(a: np.ndarray) -> bytes:
    """Bytes of like weight side by side, then zstd: sorted keys and small counts shrink."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(raw.T.tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=X.U(0)))


def _unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b, X.U), dtype=X.U)


def _blocks(batches, block_tokens: int):
    """Pack documents into blocks; the deleted fold has blocks of its own."""
    table, part = X.space_table(), TaskContext.get().partitionId()
    waiting = {True: [], False: []}
    size = {True: 0, False: 0}
    made = 0

    def flush(fold):
        nonlocal made
        ids, no_id, held, n, words = (np.concatenate(x) for x in zip(*waiting[fold]))
        uni, codes = np.unique(words, return_inverse=True)
        row = [(part << 32) + made, fold, int(n.sum()), int(n[~held].sum()), ids.tobytes(), no_id.tobytes(), held.tobytes(),
               n.astype(np.int32).tobytes(), uni.tobytes(), codes.astype(np.int32).tobytes()]
        made += 1
        waiting[fold], size[fold] = [], 0
        names = [c.split()[0] for c in _BLOCK.split(", ")]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64()] + [pa.binary()] * 6
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

    for batch in batches:
        for p in X.pieces(batch):
            w = X.Words(*X.utf8(p.column("text")), table)
            n = w.n + 1
            at = np.cumsum(n) - 1                      # the end token follows each text
            words = np.empty(int(n.sum()), X.U)
            words[at] = END
            rest = np.ones(len(words), bool)
            rest[at] = False
            words[rest] = w.hash
            no_id = p.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids = p.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            kind = p.column("kind").to_numpy(zero_copy_only=False)
            for fold in (True, False):
                pick = (kind == 1) == fold
                if pick.any():
                    waiting[fold].append((ids[pick], no_id[pick], kind[pick] == 2, n[pick], words[np.repeat(pick, n)]))
                    size[fold] += int(n[pick].sum())
                if size[fold] >= block_tokens:
                    yield flush(fold)
    for fold in (True, False):
        if waiting[fold]:
            yield flush(fold)


class _Block:
    """A block's tokens, with its distinct words and pairs in the order they are asked for."""

    def __init__(self, row):
        self.n = np.frombuffer(row["n"], np.int32).astype(np.int64)
        self.held = np.frombuffer(row["held"], bool)
        self.ids = row["doc_id"]
        self.words = np.frombuffer(row["words"], X.U)
        self.codes = np.frombuffer(row["codes"], np.int32).astype(np.int64)
        self.first = np.cumsum(self.n) - self.n
        end = int(np.searchsorted(self.words, END))
        self.context = np.empty_like(self.codes)
        self.context[1:] = self.codes[:-1]
        self.context[self.first] = end                 # a text begins after an end token
        pair, inverse = np.unique(self.context * len(self.words) + self.codes, return_inverse=True)
        key = X.mix(self.words[pair // len(self.words)] * X.U(0x9E3779B97F4A7C15)
                    + X.mix(self.words[pair % len(self.words)]))
        order = np.argsort(key)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.pairs, self.pair_of = key[order], rank[inverse]

    def keys(self, size):
        return self.words if size == 1 else self.pairs

    def trained(self, size):
        """Training counts of the block's own entries."""
        use = np.repeat(~self.held, self.n)
        of = self.codes if size == 1 else self.pair_of
        return np.bincount(of[use], minlength=len(self.keys(size))).astype(np.uint32)


def _shard_cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    own = ((keys >> X.U(32)) * X.U(shards)) >> X.U(32)
    return np.searchsorted(own, np.arange(shards + 1))


def _ask(batches, shards: int):
    for batch in batches:
        for row in batch.to_pylist():
            b = _Block(row)
            out = []
            for size in (1, 2):
                keys, count = b.keys(size), b.trained(size)
                cuts = _shard_cuts(keys, shards)
                for s in range(shards):
                    lo, hi = cuts[s], cuts[s + 1]
                    if hi > lo:
                        out.append((s, size, row["block"], row["fold"], _pack_sorted(keys[lo:hi]), _pack(count[lo:hi])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.bool_(),
                                                                  pa.binary(), pa.binary()))],
                names=["shard", "size", "block", "fold", "keys", "trained"])


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard and entry size: add up what the blocks sent and answer each of them."""
    keys = [_unpack_sorted(x) for x in pdf["keys"]]
    counts = [_unpack(x, np.uint32) for x in pdf["trained"]]
    known, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts), len(known)).astype(np.int64)
    fold = np.concatenate([c if f else np.zeros_like(c) for c, f in zip(counts, pdf["fold"])])
    folded = np.bincount(at, fold, len(known)).astype(np.int64)
    cuts = np.r_[0, np.cumsum([len(k) for k in keys])]
    size, shard = int(pdf["size"].iloc[0]), int(pdf["shard"].iloc[0])
    rows = [(block, size, shard, _pack(total[at[lo:hi]]), _pack(folded[at[lo:hi]]), 0)
            for block, lo, hi in zip(pdf["block"], cuts[:-1], cuts[1:])]
    if size == 1:
        rows.append((-1, size, shard, b"", b"", int((total > 0).sum())))
    return pd.DataFrame(rows, columns=["block", "size", "shard", "total", "folded", "distinct_words"])


def _counts(block: _Block, answers: pd.DataFrame, deleted: bool):
    """Per token: counts of its pair, its context and itself."""
    found = {}
    for size in (1, 2):
        own = answers[answers["size"] == size].sort_values("shard")
        total = np.concatenate([_unpack(x, np.int64) for x in own["total"]])
        if deleted:
            total = total - np.concatenate([_unpack(x, np.int64) for x in own["folded"]])
        found[size] = total
    return found[2][block.pair_of], found[1][block.context], found[1][block.codes]


def _estimates(pair, context, word, n: float):
    p2 = np.divide(pair, context, out=np.zeros(len(pair)), where=context > 0)
    p1 = word / n if n else np.zeros(len(word))
    bucket = np.where(context > 0, np.minimum(np.floor(np.log2(np.maximum(context, 1))) + 1, BUCKETS - 1), 0)
    return p2, p1, bucket.astype(np.int64)


def _bin(p, p0):
    return np.where(p > 0, np.clip(np.floor(2 * np.log2(np.maximum(p, 1e-300) / p0)) + 40, 1, BINS - 1), 0).astype(np.int64)


def _histogram(n_kept: float, p0: float):
    def job(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if blocks.empty:
            return pd.DataFrame({"cell": [], "n": [], "s2": [], "s1": []})
        p2, p1, bucket = _estimates(*_counts(b := _Block(blocks.iloc[0]), answers, True), n_kept)
        cell = (bucket * BINS + _bin(p2, p0)) * BINS + _bin(p1, p0)
        own, at = np.unique(cell, return_inverse=True)
        return pd.DataFrame({"cell": own, "n": np.bincount(at).astype(float) if len(b.codes) else [],
                             "s2": np.bincount(at, p2), "s1": np.bincount(at, p1)})
    return job


def expectation_maximisation(cells: pd.DataFrame, p0: float, rounds: int = 60) -> np.ndarray:
    """Weights (buckets x 3, for pair, word, uniform) from held-out counts.  One
    pseudo-count for each part keeps every weight positive; bucket 0 (context
    never seen) has no pair part."""
    out = np.full((BUCKETS, 3), 1 / 3)
    out[0] = (0.0, 0.5, 0.5)
    bucket = cells["cell"].to_numpy(np.int64) // (BINS * BINS)
    n = cells["n"].to_numpy(float)
    p = np.c_[cells["s2"] / n, cells["s1"] / n, np.full(len(n), p0)] if len(n) else np.zeros((0, 3))
    for b in range(BUCKETS):
        own = bucket == b
        for _ in range(rounds):
            mass = out[b] * p[own]
            share = mass / np.maximum(mass.sum(axis=1, keepdims=True), 1e-300)
            got = (share * n[own, None]).sum(axis=0) + (out[b] > 0)
            out[b] = got / got.sum()
    return out


def _score(weights: np.ndarray, n: int, vocabulary: int):
    p0 = 1.0 / (vocabulary + 1)

    def job(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if blocks.empty:
            return pd.DataFrame({c: [] for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")})
        b = _Block(blocks.iloc[0])
        pair, context, word = _counts(b, answers, False)
        p2, p1, bucket = _estimates(pair, context, word, n)
        w = weights[bucket]
        p = w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0 if n else np.full(len(p2), p0)
        base = np.log10((word + 1.0) / (n + vocabulary + 1.0))
        return pd.DataFrame({
            "doc_id": pd.arrays.IntegerArray(np.frombuffer(b.ids, np.int64), np.frombuffer(blocks.iloc[0]["no_id"], bool)),
            "held_out": b.held, "n_tokens": b.n,
            "n_known": np.add.reduceat((word > 0).astype(np.int64), b.first),
            "base_score": np.add.reduceat(base, b.first), "score": np.add.reduceat(np.log10(p), b.first)})
    return job


def scores(docs: DataFrame, folds: int = 7, held_fold: int = 2, deleted_fold: int = 3, block_tokens: int = 1_500_000,
           shard_entries: int = 3_000_000, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``."""
    rest = F.pmod(F.crc32(F.col(doc_col).cast("string").cast("binary")), F.lit(folds))
    kind = F.when(rest == held_fold, 2).when(rest == deleted_fold, 1).otherwise(0)
    source = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                         kind.cast("int").alias("kind"))
    blocks = kept(source.mapInArrow(lambda it: _blocks(it, block_tokens), _BLOCK), "lm-blocks")
    sums = blocks.agg(F.sum("tokens"), F.sum("trained"), F.sum(F.when(F.col("fold"), F.col("trained")))).first()
    tokens, n, n_fold = (int(x or 0) for x in sums)
    shards = max(4, -(-tokens // shard_entries))
    asked = blocks.mapInArrow(lambda it: _ask(it, shards), _ASK)
    answers = kept(asked.groupBy("shard", "size").applyInPandas(_answer, _ANSWER), "lm-counts")
    vocabulary = int(answers.filter(F.col("block") == -1).agg(F.sum("distinct_words")).first()[0] or 0)
    p0 = 1.0 / (vocabulary + 1)

    def joined(only_fold, job, schema):
        left = blocks.filter("fold") if only_fold else blocks
        right = answers.filter(F.col("block") >= 0)
        if only_fold:
            right = right.join(left.select("block"), "block", "left_semi")
        return left.groupBy("block").cogroup(right.groupBy("block")).applyInPandas(job, schema)

    cells = (joined(True, _histogram(float(n - n_fold), p0), "cell long, n double, s2 double, s1 double")
             .groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", "s2", "s1")]).orderBy("cell").toPandas())
    weights = expectation_maximisation(cells, p0)
    return (joined(False, _score(weights, n, vocabulary), "doc_id long, held_out boolean, n_tokens long, n_known long, "
                   "base_score double, score double")
            .withColumn("train_tokens", F.lit(n).cast("long"))
            .select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"))
