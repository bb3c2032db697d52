"""Quality classifier: random-indexing word vectors, a two-layer network, temperature scaling.

Random indexing: every word has a sparse index vector (a few +1 and -1, fixed
by its hash); a word's vector is the sum of the index vectors of the words
around it.  The sums are whole numbers, so they do not depend on how the data
were split.  A document is the mean of its words' vectors, beside the mean of
the index vectors of its punctuation runs and word shapes.  A two-layer network
in numpy gives a logit; its temperature is fitted on rows the network has not
seen, so scores are calibrated probabilities.

The vectors are corpus statistics: every word of every document has one, from
all of its contexts.  Blocks of documents send the sums around their distinct
words to hash shards, which answer each block with the totals of exactly its words;
no vocabulary is collected, broadcast or stored.  The texts themselves are not
shuffled: the answers go to the partition that holds the block.  A document's features (float32) are
written once; the network learns from some and scores all.  Only the network has a bound, a parameter:
at most ``max_rows`` labelled training rows (the smallest hashes of doc_id; 20,000).

Only texts enter a score.  Labels are read from rows whose ``crc32(doc_id) mod 4``
is not 2; labels that contradict each other evenly are left out.

Defined results: a null text is an empty one; empty texts get the score of a
document without words; a null doc_id is not held out; repeated rows are scored
each; without labels of both kinds the score is the smoothed share of label 1
(0.5 with no label); an empty table gives an empty result.
"""

from __future__ import annotations

import io
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import RDD, TaskContext
from pyspark.serializers import NoOpSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as X
from .lm_scoring import _pack, _pack_sorted, _shard_cuts, _unpack, _unpack_sorted
from .store import kept

DIM = 64
_REACH = 2                     # words on either side that are a word's context
_PLACES = 4                    # nonzero places of an index vector


def _table(keep) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for b in keep:
        t[b] = b + 32 if 65 <= b <= 90 else b
    return t


_WORD = _table([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_MARK = _table([b for b in range(33, 127) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)])


def _places(h: np.ndarray) -> list[np.ndarray]:
    """Nonzero places of hashed words' index vectors: -1, 1, -1, 1 (added where they meet)."""
    return [(X.mix(h + X.U((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> X.U(58)).astype(np.uint8) for i in range(_PLACES)]


def index_vectors(h: np.ndarray) -> np.ndarray:
    """Sparse ternary vectors of hashed words."""
    out = np.zeros((len(h), DIM), np.int32)
    for i, p in enumerate(_places(h)):
        np.add.at(out, (np.arange(len(h)), p), 1 if i % 2 else -1)
    return out


class Parts:
    """Words, punctuation runs and word shapes of a batch of texts."""

    def __init__(self, column):
        data, off = X.utf8(column)
        self.words = X.Words(data, off, _WORD)
        self.marks = X.Words(data, off, _MARK)
        w = self.words
        capital = np.r_[0, np.cumsum((data >= 65) & (data <= 90))]
        digit = np.r_[0, np.cumsum((data >= 48) & (data <= 57))]
        n = w.end - w.start
        up = capital[w.end] - capital[w.start]
        first = capital[w.start + 1] - capital[w.start] if len(w.start) else up
        # 1 has digits, 2 one capital first, 3 mostly capitals, 4 other capitals, 5 lower case; by length, too
        kind = np.where(digit[w.end] > digit[w.start], 1, np.where(up == 0, 5, np.where((n > 1) & (2 * up >= n), 3, np.where((up == 1) & (first == 1), 2, 4))))
        self.shape = (kind * 8 + np.minimum(n // 4, 7)).astype(np.uint8)          # below SHAPES


SHAPES = X.mix(np.arange(48, dtype=X.U))


def _index_sums(own: np.ndarray, code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the index vectors of ``own[code]`` over the runs ``first[i] .. first[i+1]-1``."""
    n = len(first) - 1
    row, total = np.repeat(np.arange(n) * DIM, np.diff(first)), np.zeros(n * DIM, np.int64)
    for i, p in enumerate(_places(own)):
        add = np.bincount(row + p[code], minlength=n * DIM)
        total += add if i % 2 else -add
    return total.reshape(n, DIM)


def _numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes, each place's number among them, in two bytes where these do)"""
    own, code = np.unique(hashes, return_inverse=True)
    return own, code.astype(np.uint16 if len(own) < 1 << 16 else np.int32)


class Texts:
    """Texts in numbers: distinct words, each place's number among them, and what needs no word vectors."""

    def __init__(self, column):
        p = Parts(column)
        self.own, self.code = _numbered(p.words.hash)
        self.first, n = p.words.first, p.words.n[:, None]
        self.total = np.zeros((len(n), DIM))
        marks, mark = np.unique(p.marks.hash, return_inverse=True)
        self.rest = np.concatenate([np.log1p(n) / 10, _index_sums(marks, mark, p.marks.first) / (n + 1),
                                    _index_sums(SHAPES, p.shape, p.words.first) / (n + 1)], axis=1).astype(np.float32)

    def add(self, vectors: np.ndarray, begin: int, most: int = 1 << 13) -> None:
        """Add the ``vectors`` of the block's words from number ``begin`` on; ``own`` are numbers by now."""
        lo, hi = np.searchsorted(self.own, [begin, begin + len(vectors)]).tolist()
        mine = vectors[self.own[lo:hi] - begin].astype(np.float64)
        places = np.flatnonzero((self.code >= lo) & (self.code < hi))
        code, first = self.code[places] - lo, np.searchsorted(places, self.first)
        for i, (x, y) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            for at in range(x, y, most):
                self.total[i] += mine[code[at:min(at + most, y)]].sum(axis=0)

    def features(self) -> np.ndarray:
        mean = self.total / np.maximum(np.diff(self.first), 1)[:, None]
        return np.concatenate([mean.astype(np.float32), self.rest], axis=1)


class Contexts:
    """The words of a block of texts, from (distinct words, each place's number among them, words of each row) of
    its pieces, which it takes from the list: ``own`` are the distinct ones in order.  Places are looked
    up and sorted for a range of words at a time; only the places' words are held for the whole block."""

    def __init__(self, pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.own = np.unique(np.concatenate([own for own, _, _ in pieces]))
        size = sum(len(code) + _REACH * len(n) for _, code, n in pieces)
        # texts one after another, each with places of no word, ``len(own)``, before it; and some at the end
        self.code, at, count = np.full(size + _REACH, len(self.own), np.int32), 0, np.zeros(len(self.own), np.int64)
        while pieces:
            own, code, n = pieces.pop()
            word = np.searchsorted(self.own, own).astype(np.int32)
            count[word] += np.bincount(code, minlength=len(own))
            self.code[at + np.arange(len(code)) + np.repeat(_REACH * np.arange(1, len(n) + 1), n)] = word[code]
            at += len(code) + _REACH * len(n)
        self.start = np.r_[0, np.cumsum(count)]
        self.place = _places(self.own)
        self.begin = self.end = 0
        self.order = np.zeros(0, np.int32)

    def _places_of(self, lo: int, hi: int, most: int = 1 << 18) -> np.ndarray:
        """The places of ``own[lo:hi]`` in the order of their words; those of further words, ``most`` or so, are kept for later calls."""
        if not self.begin <= lo <= hi <= self.end:
            self.begin, self.end = lo, max(hi, int(np.searchsorted(self.start, self.start[lo] + most, side="right")) - 1)
            at = np.flatnonzero((self.code >= self.begin) & (self.code < self.end)).astype(np.int32)
            self.order = at[np.argsort(self.code[at], kind="stable")]
        return self.order[self.start[lo] - self.start[self.begin]:self.start[hi] - self.start[self.begin]]

    def around(self, lo: int, hi: int, most: int = 1 << 16) -> np.ndarray:
        """Sums of the index vectors around ``own[lo:hi]``, added up over ``most`` places at a time."""
        places, total = self._places_of(lo, hi), np.zeros((hi - lo) * DIM, np.int64)
        for begin in range(0, len(places), most):
            at, near = places[begin:begin + most], []
            row = (self.code[at] - np.int32(lo)).astype(np.int64) * DIM
            for step in (*range(-_REACH, 0), *range(1, _REACH + 1)):
                other = self.code[at + np.int32(step)]
                word = other < len(self.own)
                near.append((row[word], other[word]))
            for sign, kind in ((-1, self.place[::2]), (1, self.place[1::2])):
                total += sign * np.bincount(np.concatenate([r + p[c] for r, c in near for p in kind]), minlength=len(total))
        return total.reshape(-1, DIM)


def _pack_sums(total: np.ndarray) -> bytes:
    """Rows whose largest numbers have as many bits are compressed together, small numbers several a byte:
    rare words' sums are mostly zeros and ones."""
    z = ((total << 1) ^ (total >> 63)).view(X.U)                        # small numbers of either sign have zero bytes
    bits = np.searchsorted(X.U(1) << np.arange(64, dtype=X.U), z.max(axis=1), side="right").astype(np.uint8)
    parts = [_pack(bits)]
    for k in np.unique(bits[bits > 0]).tolist():
        rows = z[bits == k].astype(_kind(k))
        parts.append(_pack(sum(rows[:, i::_share(k)] << i * (8 // _share(k)) for i in range(_share(k))).ravel()))
    return np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def _kind(bits: int) -> np.dtype:
    return np.dtype(f"u{next(k for k in (1, 2, 4, 8) if bits <= 8 * k)}")


def _share(bits: int) -> int:
    """Numbers of so many bits that share a byte."""
    return 4 if bits <= 2 else 2 if bits <= 4 else 1


def _unpack_sums(b: bytes) -> np.ndarray:
    n = int(np.frombuffer(b, "<u4", 1)[0])
    at = 4 * (n + 1) + np.r_[0, np.cumsum(np.frombuffer(b, "<u4", n, 4))]
    parts = [b[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
    bits = _unpack(parts[0], np.uint8)
    z = np.zeros((len(bits), DIM), X.U)
    for k, part in zip(np.unique(bits[bits > 0]).tolist(), parts[1:], strict=True):
        rows, m = _unpack(part, _kind(k)).reshape(-1, DIM // _share(k)), _share(k)
        full = np.empty((len(rows), DIM), rows.dtype)
        for i in range(m):
            full[:, i::m] = rows if m == 1 else rows >> i * (8 // m) & (1 << 8 // m) - 1
        z[bits == k] = full
    return (z >> X.U(1)).view(np.int64) ^ -(z & X.U(1)).view(np.int64)


def _blocks(batches, text: str, block_bytes: int):
    """(block, piece) for rows in the order of the partition: pieces of a quarter of a megabyte, blocks of
    ``block_bytes`` of text; (block, None) where a block ends.  No text is held but the batch at hand."""
    block, size, begun = TaskContext.get().partitionId() << 32, 0, False
    for batch in batches:
        for part in X.pieces(batch, text, 1 << 18):
            size, begun = size + part.column(text).nbytes, True
            yield block, part
            if size >= block_bytes:
                yield block, None
                block, size, begun = block + 1, 0, False
    batch = part = None                                                 # the last ones go before the last block is worked on
    if begun:
        yield block, None


class _Packing:
    """An Arrow stream, compressed as its batches come."""

    def __init__(self, schema: pa.Schema):
        self.sink = io.BytesIO()
        self.packed = zstandard.ZstdCompressor(level=1).stream_writer(self.sink, closefd=False)
        self.out = pa.ipc.new_stream(self.packed, schema)

    def done(self) -> memoryview:
        self.out.close()
        self.packed.close()
        return self.sink.getbuffer()


def _parts_of(rows: bytes):
    with zstandard.ZstdDecompressor().stream_reader(rows) as packed, pa.ipc.open_stream(packed) as stream:
        yield from stream


def _send_rows(batches, text: str, shards: int, block_bytes: int, most: int = 1 << 20):
    """Each block as a compressed Arrow stream, cut into as many rows as shards answer it, sent in batches of ``most`` bytes or so."""
    packing = None
    for _, part in _blocks(batches, text, block_bytes):
        if part is not None:
            packing = packing or _Packing(part.schema)
            packing.out.write_batch(part)
            continue
        data, packing = packing.done(), None
        each = -(-len(data) // shards)
        step = max(1, most // each)
        for s in range(0, shards, step):
            yield pa.RecordBatch.from_arrays([pa.array([bytes(data[i * each:(i + 1) * each]) for i in range(s, min(s + step, shards))], pa.binary())], names=["chunk"])
        del data
        X.release()


def _send_sums(batches, text: str, shards: int, block_bytes: int):
    """A message per block and shard, if only an empty one: distinct words and the sums around them."""
    pieces = []
    for block, part in _blocks(batches, text, block_bytes):
        if part is not None:
            words = X.Words(*X.utf8(part.column(text)), _WORD)
            pieces.append((*_numbered(words.hash), words.n))
            del words
            continue
        X.release()
        around = Contexts(pieces)
        cuts = _shard_cuts(around.own, shards)
        for s, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([block], pa.int64()), pa.array([_pack_sorted(around.own[lo:hi])], pa.binary()),
                                              pa.array([_pack_sums(around.around(lo, hi))], pa.binary())], names=["shard", "block", "words", "sums"])
        del around
        X.release()


def _add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard: the sums of its words over all blocks, told to each block for its own words."""
    sent = [_unpack_sorted(b) for b in pdf["words"]]
    own = np.unique(np.concatenate(sent))
    total = np.zeros((len(own), DIM), np.int64)
    at = [np.searchsorted(own, words).astype(np.int32) for words in sent]
    del sent
    for j, sums in zip(at, pdf["sums"]):
        total[j] += _unpack_sums(sums)                                  # a block names a word once
    told = [_pack_sums(total[j]) for j in at]
    del total, at
    X.release()
    return pd.DataFrame({"block": pdf["block"], "shard": pdf["shard"], "words": pdf["words"], "sums": told})


def _shards(plain: DataFrame, text: str, shard_bytes: int = 16 << 20) -> int:
    size = plain.agg(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))))).first()[0] or 0
    return max(8, -(-size // shard_bytes))


def context_sums(plain: DataFrame, text: str, block_bytes: int, shards: int | None = None) -> DataFrame:
    """(block, shard, words, sums): for each block its words of a shard, with their sums over all documents."""
    shards = shards or _shards(plain, text)
    return (plain.mapInArrow(lambda it: _send_sums(it, text, shards, block_bytes), "shard long, block long, words binary, sums binary")
            .groupBy("shard").applyInPandas(_add_up, "block long, shard long, words binary, sums binary"))


_CHANGED = "the documents were not the same when they were read again"
_UNEVEN = "same number of elements"             # what Spark says of it if there are more or fewer blocks


class Answer(NamedTuple):
    """What a shard tells a block: the checksum of the block's words of the shard, and their sums."""

    block: int
    shard: int
    check: int
    sums: bytes


_HEAD = ">qqq"


def _bytes(df: DataFrame) -> RDD:
    """The only column of ``df``, a binary one, as an RDD of its values as they are: no row is pickled."""
    sc = df.sparkSession.sparkContext
    return RDD(getattr(df._jdf, "as")(sc._jvm.org.apache.spark.sql.Encoders.BINARY()).javaRDD(), sc, NoOpSerializer())


def _gather(task: int, pairs, shards: int):
    rows, answers, size = [], [], struct.calcsize(_HEAD)
    for i, (chunk, answer) in enumerate(pairs):
        if i % shards == 0:
            rows.append(bytearray())
        rows[-1] += chunk
        answers.append(Answer(*struct.unpack_from(_HEAD, answer), answer[size:]))
    if rows:
        yield ([(task << 32) + i for i in range(len(rows))], rows), (answers,)


def _paired(plain: DataFrame, text: str, block_bytes: int, shards: int) -> RDD:
    """For each partition of ``plain`` that has rows: ((blocks, rows), (answers,)).  Both readings cut the same
    blocks in the same partitions, so the answers are sent there and the texts stay where they were
    read; what is held at once is a partition, compressed.  A block's rows are cut into as many chunks as
    it has answers, so chunks and answers can be zipped, and the JVM holds a few small ones at a time."""
    if plain.isEmpty():
        return plain.sparkSession.sparkContext.emptyRDD()
    chunks = _bytes(plain.mapInArrow(lambda it: _send_rows(it, text, shards, block_bytes), "chunk binary"))
    head = [F.unhex(F.lpad(F.hex(c), 16, "0")) for c in ("block", "shard", F.crc32("words"))]       # a block knows its words
    answers = _bytes(context_sums(plain, text, block_bytes, shards)
                     .select(F.shiftright("block", 32).cast("int").alias("part"), F.concat(*head, "sums").alias("answer"))
                     .repartitionById(chunks.getNumPartitions(), "part").select("answer"))

    return chunks.zip(answers).mapPartitionsWithIndex(lambda task, pairs: _gather(task, pairs, shards))


def _block_features(rows: bytes, answers: list[Answer], text: str, shards: int, most: int = 1 << 15):
    """(piece, features) of one block.  Texts become numbers first, so that all words of the block are
    known; their vectors are then made and used for ``most`` words or so at a time."""
    pieces = [Texts(part.column(text)) for part in _parts_of(rows)]
    words = np.unique(np.concatenate([np.zeros(0, X.U), *(t.own for t in pieces)]))
    cuts, at = _shard_cuts(words, shards), 0
    for t in pieces:
        t.own = np.searchsorted(words, t.own).astype(np.int32)
    answers = sorted(answers, key=lambda a: a.shard)
    if [a.shard for a in answers] != list(range(shards)):
        raise RuntimeError(_CHANGED)
    while at < shards:
        begin, end = int(cuts[at]), max(at + 1, int(np.searchsorted(cuts, cuts[at] + most, side="right")) - 1)
        vectors = np.zeros((int(cuts[end]) - begin, DIM), np.float32)
        for s in range(at, end):
            lo, hi = cuts[s], cuts[s + 1]
            if zlib.crc32(_pack_sorted(words[lo:hi])) != answers[s].check:
                raise RuntimeError(_CHANGED)
            total = _unpack_sums(answers[s].sums).astype(np.float64)
            answers[s] = None
            vectors[lo - begin:hi - begin] = total / np.maximum(np.sqrt((total ** 2).sum(axis=1, keepdims=True)), 1)
        for t in pieces:
            t.add(vectors, begin)
        at = end
    del vectors, total
    for part, t in zip(_parts_of(rows), pieces):
        yield part, t.features()


class Featured:
    """Rows with the features of their text: ``rows`` has the columns under plain names (c0, c1, ...) and
    ``features`` (float32); ``names`` are the columns' own names."""

    def __init__(self, rows: DataFrame, names: list[str]):
        self.rows, self.names = rows, names


def features(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, stored: bool = False,
             block_bytes: int = 32 << 20) -> Featured:
    """The rows of ``docs`` (columns ``keep``, by default all) with their features, written once.

    Blocks are cut twice, for the sums and for the features, so both readings must give the same rows
    in the same partitions: ``stored`` says that ``docs`` is a plain scan of files, which does; all
    else is written to a table first.  A block whose words differ fails with ``RuntimeError``."""
    names = docs.columns
    # columns go through Arrow under plain names, whatever they are called
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index(text_col)}"
    wanted = [i for i, c in enumerate(names) if keep is None or c in keep]
    own = [f"c{i}" for i in wanted]
    schema = T.StructType([*(T.StructField(f"c{i}", docs.schema.fields[i].dataType) for i in wanted), T.StructField("features", T.BinaryType())])
    plain = plain.select(*dict.fromkeys([*own, text]))
    if not stored:
        plain = kept(plain, "quality-documents")
    shards = _shards(plain, text)

    def job(pair):
        (blocks, rows), (answers,) = pair
        told = {block: [] for block in blocks}
        while answers:
            if (a := answers.pop()).block not in told:
                raise RuntimeError(_CHANGED)
            told[a.block].append(a)
        del a
        for i, block in enumerate(blocks):
            packed, rows[i] = rows[i], None
            for part, found in _block_features(packed, told.pop(block), text, shards):
                yield from zip(*(part.column(c).to_pylist(maps_as_pydicts="strict") for c in own), (r.tobytes() for r in found))
            X.release()

    rows = plain.sparkSession.createDataFrame(_paired(plain, text, block_bytes, shards).flatMap(job), schema, verifySchema=False)
    try:
        return Featured(kept(rows, "quality-features"), [names[i] for i in wanted])
    except Exception as e:
        if _UNEVEN in str(e):
            raise RuntimeError(_CHANGED) from e
        raise


class Network:
    """Two layers; the second gives one logit, divided by the temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, check: np.ndarray, hidden: int = 32, rounds: int = 300, decay: float = 1e-4):
        self.constant = (y.sum() + 1) / (len(y) + 2) if len(set(y.tolist())) < 2 else None
        if self.constant is not None:
            return
        fit = ~check if (~check).any() and len(set(y[~check].tolist())) == 2 else np.ones(len(y), bool)
        self.mean, self.scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
        z = self._scaled(x)
        rng = np.random.default_rng(7)
        p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        zf, yf = z[fit], y[fit]
        for t in range(1, rounds + 1):
            h = np.tanh(zf @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - yf) / len(yf)
            back = np.outer(d, p[2]) * (1 - h * h)
            grads = [zf.T @ back + decay * p[0], back.sum(axis=0), h.T @ d + decay * p[2], np.array([d.sum()])]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)
        self.layers, self.temperature = p, 1.0
        test = check if check.any() else fit
        logit = self.logits(x[test])
        loss = lambda s: np.logaddexp(0, np.where(y[test] == 1, -logit, logit) / s).mean()
        self.temperature = float(min(np.geomspace(0.25, 16, 61), key=loss))

    def _scaled(self, x):
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logits(self, x):
        w1, b1, w2, b2 = self.layers
        return (np.tanh(self._scaled(x) @ w1 + b1) @ w2 + b2) / self.temperature

    def probabilities(self, x):
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def fit(rows: Featured, labels: DataFrame, label_col: str = "quality", folds: int = 4, held_fold: int = 2,
        max_rows: int = 20_000, id_col: str = "doc_id") -> Network:
    """The network learned from at most ``max_rows`` labelled rows that are not held out."""
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    picked = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
              .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (remainder != held_fold))
              .groupBy("doc_id").agg(F.avg("label").alias("label")).filter("label != 0.5")
              .select("doc_id", (F.col("label") > 0.5).cast("int").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    found = (rows.rows.select(F.col(rows.rows.columns[rows.names.index(id_col)]).cast("long").alias("doc_id"), "features")
             .join(F.broadcast(picked), "doc_id")                       # at most max_rows ids and labels
             .groupBy("doc_id", "label").agg(F.min("features").alias("features")).toPandas().sort_values("doc_id"))
    x = np.frombuffer(b"".join(found["features"]), np.float32).reshape(len(found), -1 if len(found) else 1).astype(np.float64)
    check = (X.mix(found["doc_id"].to_numpy(np.int64).view(X.U)) % X.U(5) == 0) if len(found) else np.zeros(0, bool)
    return Network(x, found["label"].to_numpy(np.int64), check)


def score(rows: Featured, network: Network) -> DataFrame:
    """The rows with the probability of label 1 as ``__score``, the last column."""
    plain = rows.rows.columns[:-1]
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.rows.schema.fields[:-1])

    def job(batches, most=1 << 10):
        for batch in batches:
            for begin in range(0, batch.num_rows, most):
                part = batch.slice(begin, most)
                x = np.frombuffer(b"".join(part.column("features").to_pylist()), np.float32).reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in plain), pa.array(network.probabilities(x.astype(np.float64)))],
                                                 names=[*plain, "__score"])
        X.release()

    return rows.rows.mapInArrow(job, f"{kinds}__score double").toDF(*rows.names, "__score")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 4, held_fold: int = 2,
            stored: bool = False, **fitting) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    rows = features(source, keep=["doc_id"], stored=stored)
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    return score(rows, fit(rows, labels, folds=folds, held_fold=held_fold, **fitting)).select(
        "doc_id", F.coalesce(remainder == held_fold, F.lit(False)).alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= threshold).cast("int").alias("predicted"))
