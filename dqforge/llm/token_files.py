"""Token-id files compressed by Re-Pair grammars.

Texts are encoded with a ``tokenizers`` file, dealt into shards of ascending
doc_id, and each shard's id stream is compressed by itself: the frequent pairs
of neighbouring symbols are replaced by new nonterminals, again and again, until
no pair is frequent.  A shard stores its rules, the expansion length of every
rule and the remaining symbols; with the lengths, any stretch of ids is decoded
without expanding what stands before it.

The files are a Parquet folder (so they live wherever Spark can write), one row
for each shard:

    shard       place in ascending doc_id order
    n_ids       ids of the shard
    doc_id, no_id, ids   int64 / bool / int64 arrays: id, its absence and length of every document
    terminals   symbols below this number are ids; symbol ``terminals + k`` is rule ``k``
    left, right, length  rules as two symbols, and how many ids each expands to
    symbols     the compressed stream (16 bits a symbol, or 32 where needed)

All arrays are little-endian.  A shard holds about ``shard_docs`` documents.

The tokenizer sees each chunk between ASCII white space once per batch at most
(a bounded table keeps them): its normaliser and splitter drop white space, so a
text's ids are those of its chunks; ``Encoder`` checks that the file is of that
kind and otherwise encodes whole texts.

Defined results: a null text is an empty one (only the end id); null doc_ids come
first; equal doc_ids are ordered by text; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as X
from .ordering import bounds, deal
from .store import fresh_path

CACHE = 900_000                # chunks and words that a worker keeps between batches (about 130 MB)
SHARD_BYTES = 8 << 20          # a shard is closed beyond so many bytes of ids
_SLOTS = 18
_LATIN = re.compile("[a-zß-öø-ÿ]+")
_TAIL = b".,!?*%&$#;:"
_ALNUM = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
_ROW = ("shard long, n_ids long, doc_id binary, no_id binary, ids binary, terminals int, left binary, right binary, "
        "length binary, symbols binary")


def _chunk_wise(spec: dict) -> bool:
    """The file drops white space before merging, so chunks between it are independent."""
    norm, split = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    first = (split.get("pretokenizers") or [split])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    return (norm.get("type") == "Sequence" and {x["type"] for x in norm["normalizers"]} <= {"NFC", "Replace", "Lowercase"}
            and all(x["pattern"] == {"Regex": "\\s+"} and x["content"] == " " for x in norm["normalizers"] if x["type"] == "Replace")
            and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
            and pattern == "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
            and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in spec["added_tokens"]))


class Encoder:
    """Texts -> bytes of their ids (little-endian, 32 bits).

    Every distinct chunk of a batch is looked up once.  Words that are not known yet are given to
    the tokenizer together, as one text, and the ids are told apart by their offsets.  The table
    is cut back to what the current batch uses when it grows beyond ``CACHE``.

    Lower-case words of Latin letters pass the normaliser unchanged and the splitter whole; for
    them the same model runs without both."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit
        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[bytes, bytes] = {}            # chunks as they stand in texts, words and runs of marks
        with open(path, encoding="utf-8") as f:
            self.chunks = _chunk_wise(json.load(f))

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_words(self, words: list[bytes]) -> None:
        plain, rest = [], []
        for w in words:
            (plain if _LATIN.fullmatch(t := w.decode()) else rest).append((w, t))
        if not unicodedata.is_normalized("NFC", " ".join(t for _, t in rest)):
            for w, t in rest:                          # offsets would shift: one by one
                if not unicodedata.is_normalized("NFC", t):
                    self.known[w] = self._ids(t)
            rest = [x for x in rest if x[0] not in self.known]
        self._together(self.plain, plain)
        self._together(self.tokenizer, rest)

    def _together(self, tokenizer, pairs: list, group: int = 200) -> None:
        words, text = [w for w, _ in pairs], [t for _, t in pairs]
        lines = [" ".join(text[lo:lo + group]) for lo in range(0, len(text), group)]
        for k, out in enumerate(tokenizer.encode_batch(lines, add_special_tokens=False)):
            own = slice(k * group, (k + 1) * group)
            begin = np.cumsum([0] + [len(t) + 1 for t in text[own]])
            at = np.fromiter((o[0] for o in out.offsets), np.int64, len(out.ids))
            raw = np.array(out.ids, "<u4").tobytes()
            cut = (np.searchsorted(at, begin) * 4).tolist()
            for w, x, y in zip(words[own], cut, cut[1:]):
                self.known[w] = raw[x:y]

    def _learn(self, chunks: set) -> None:
        known, made, need = self.known, [], set()
        for c in chunks:
            # the normaliser lower-cases; control strings are matched before it
            low = c if b"<|" in c else c.lower()
            word, tail = low.rstrip(_TAIL), b""
            if word and len(word) < len(low) and word[-1] in _ALNUM:
                tail = low[len(word):]                 # a word and the marks behind it are separate pieces
            else:
                word = low
            made.append((c, word, tail))
            if word not in known:
                need.add(word)
            if tail and tail not in known:
                need.add(tail)
        self._learn_words(list(need))
        for c, word, tail in made:
            known[c] = known[word] + known[tail] if tail else known[word]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.chunks:
            return [self._ids(t.decode()) for t in texts]
        split = [t.split() for t in texts]
        used = set().union(*split)
        if len(self.known) > CACHE:
            self.known = {c: self.known[c] for c in used if c in self.known}
        self._learn({c for c in used if c not in self.known})
        return [b"".join(map(self.known.__getitem__, chunks)) for chunks in split]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices begin[0] .. begin[0]+size[0]-1, begin[1] .., one after another."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(total)


def _top_pairs(key: np.ndarray, least: int, most: int) -> np.ndarray:
    """The pairs that occur at least ``least`` times, the most frequent (then smallest) first."""
    ordered = np.sort(key)
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    n = np.diff(np.r_[first, len(ordered)])
    use = np.flatnonzero(n >= least)
    return ordered[first[use[np.argsort(-n[use], kind="stable")[:most]]]]


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key.view(X.U) * X.U(0x9E3779B97F4A7C15)) >> X.U(64 - _SLOTS)).astype(np.int64)


def compress(ids: np.ndarray, least: int = 8, a_round: int = 8192, most_rules: int = 1 << 17, gain: float = 0.01):
    """Re-Pair: (terminals, left, right, length, symbols).  Each round gives the most frequent
    pairs (at least ``least`` times) nonterminals and replaces their occurrences, the more frequent
    pair first where two overlap, until a round saves less than ``gain`` of the symbols."""
    terminals = int(ids.max()) + 1 if len(ids) else 1
    s = ids.astype(np.int64)
    left, right, length = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.ones(terminals, np.int64)
    made = 0
    while len(s) > 1 and made < most_rules:
        key = s[:-1] << 32 | s[1:]
        top = _top_pairs(key, least, min(a_round, most_rules - made))
        # a slot holds one pair; a rarer one that meets it there waits for the next round
        holds, rank_of = np.full(1 << _SLOTS, -1, np.int64), np.empty(1 << _SLOTS, np.int64)
        slots = _slot(top)
        holds[slots[::-1]], rank_of[slots[::-1]] = top[::-1], np.arange(len(top))[::-1]
        at = _slot(key)
        pos = np.flatnonzero(holds[at] == key)
        if not len(pos):
            break
        r = rank_of[at[pos]]
        # in a run of one overlapping pair (a a a a) only every other place can be replaced
        i = np.arange(len(pos))
        joined = np.r_[False, (pos[1:] == pos[:-1] + 1)]
        run = np.maximum.accumulate(np.where(joined & np.r_[False, r[1:] == r[:-1]], 0, i))
        use = (i - run) % 2 == 0
        r = np.where(use, r, len(top))
        before = np.where(joined, np.r_[len(top), r[:-1]], len(top))
        after = np.where(np.r_[joined[1:], False], np.r_[r[1:], len(top)], len(top))
        won = use & (r < before) & (r < after)
        pick, r = pos[won], r[won]
        if not len(pick):
            break
        rules = np.flatnonzero(np.bincount(r, minlength=len(top)))       # pairs that were used at all
        new = np.full(len(top), -1, np.int64)
        new[rules] = terminals + made + np.arange(len(rules))
        left.append(top[rules] >> 32)
        right.append(top[rules] & 0xFFFFFFFF)
        length = np.r_[length, length[left[-1]] + length[right[-1]]]
        made += len(rules)
        s[pick] = new[r]
        keep = np.ones(len(s), bool)
        keep[pick + 1] = False
        small = len(pick) < max(64, gain * len(s))
        s = s[keep]
        if small:
            break
    return terminals, np.concatenate(left), np.concatenate(right), length[terminals:], s


def expansions(terminals: int, left, right, length):
    """(flat ids, begin, size) of every symbol's expansion."""
    size = np.r_[np.ones(terminals, np.int64), length]
    begin = np.cumsum(size) - size
    flat = np.empty(int(size.sum()), np.int64)
    flat[:terminals] = np.arange(terminals)
    done = terminals
    while done < len(size):
        # rules whose parts are both known
        k = np.arange(done, len(size))
        ready = (left[k - terminals] < done) & (right[k - terminals] < done)
        stop = done + (int(np.argmin(ready)) if not ready.all() else len(ready))
        own = np.arange(done, stop)
        for part, shift in ((left[own - terminals], 0), (right[own - terminals], size[left[own - terminals]])):
            flat[_ragged(begin[own] + shift, size[part])] = flat[_ragged(begin[part], size[part])]
        done = stop
    return flat, begin, size


def decode(grammar, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` .. ``last - 1`` of a shard; only the symbols that hold them are expanded."""
    terminals, left, right, length, symbols = grammar
    size = np.r_[np.ones(terminals, np.int64), length][symbols]
    ends = np.cumsum(size)
    last = int(ends[-1]) if last is None and len(ends) else (last or 0)
    if last <= first:
        return np.zeros(0, np.uint32)
    lo, hi = np.searchsorted(ends, first, side="right"), np.searchsorted(ends, last, side="left") + 1
    flat, begin, sizes = expansions(terminals, left, right, length)
    out = flat[_ragged(begin[symbols[lo:hi]], sizes[symbols[lo:hi]])]
    skip = first - int(ends[lo] - size[lo])
    return out[skip:skip + last - first].astype(np.uint32)


def _shard_row(shard: int, ids: list, streams: list[bytes]):
    stream = np.frombuffer(b"".join(streams), "<u4")
    terminals, left, right, length, symbols = compress(stream)
    wide = terminals + len(left) > 1 << 16
    kind = "<u4" if wide else "<u2"
    none = np.array([i is None for i in ids], bool)
    return {"shard": shard, "n_ids": len(stream),
            "doc_id": np.array([i or 0 for i in ids], "<i8").tobytes(), "no_id": none.tobytes(),
            "ids": np.array([len(x) // 4 for x in streams], "<i8").tobytes(), "terminals": terminals,
            "left": left.astype(kind).tobytes(), "right": right.astype(kind).tobytes(),
            "length": length.astype("<u4").tobytes(), "symbols": symbols.astype(kind).tobytes()}


def _shards(batches, path: str, end_id: int):
    """Rows sorted by (bucket, doc_id, text) -> one compressed row for each bucket, or more where
    a bucket is large (long texts, many rows of one id)."""
    enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
    now, part, ids, streams, size = None, 0, [], [], 0

    def row():
        r = _shard_row((now << 24) + part, ids, streams)
        X.release()
        return pa.RecordBatch.from_pylist([r], schema=pa.schema([
            (c.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for c in _ROW.split(", ")]))

    for batch in batches:
        for piece in X.pieces(batch, "text", 2 << 20):
            ids_of = enc.encode(piece.column("text").cast(pa.binary()).to_pylist())
            for bucket, d, stream in zip(piece.column("bucket").to_pylist(), piece.column("doc_id").to_pylist(), ids_of):
                if bucket != now or size > SHARD_BYTES:
                    if streams:
                        yield row()
                    now, part, ids, streams, size = bucket, part + 1 if bucket == now else 0, [], [], 0
                ids.append(d)
                streams.append(stream + end)
                size += len(streams[-1])
    if streams:
        yield row()


def write(docs: DataFrame, tokenizer: str, out: str, end_id: int = 2, shard_docs: int = 1000,
          id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode ``docs`` with the tokenizer file and write the shards to the folder ``out``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    low, _, _ = bounds(rows, shard_docs)
    (deal(rows, low).drop("copy").repartition("bucket")
     .sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "text")
     .mapInArrow(lambda it: _shards(it, tokenizer, end_id), _ROW).write.parquet(out))
    return out


def grammar_of(row) -> tuple:
    kind = "<u4" if row["terminals"] + len(row["length"]) // 4 > 1 << 16 else "<u2"
    read = lambda c, k=kind: np.frombuffer(row[c], k).astype(np.int64)
    return row["terminals"], read("left"), read("right"), read("length", "<u4"), read("symbols")


def _documents(batches, before):
    for batch in batches:
        for row in batch.to_pylist():
            stream = decode(grammar_of(row)).astype("<u4")
            n = np.frombuffer(row["ids"], "<i8")
            at = np.cumsum(n) - n
            data = stream.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(row["doc_id"], "<i8"), mask=np.frombuffer(row["no_id"], bool)),
                 pa.array(at + before.value[row["shard"]]), pa.array(n.astype(np.int64)),
                 pa.array([data[4 * a:4 * (a + k)] for a, k in zip(at.tolist(), n.tolist())], pa.binary())],
                names=["doc_id", "start", "n_tokens", "ids"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files: doc_id, start (ids before it), n_tokens, ids (little-endian bytes)."""
    files = spark.read.schema(_ROW).parquet(path)
    sizes = files.select("shard", "n_ids").orderBy("shard").toPandas()     # one number for each shard
    total = pd.Series(sizes["n_ids"].cumsum() - sizes["n_ids"])
    before = spark.sparkContext.broadcast(dict(zip(sizes["shard"].tolist(), total.tolist())))
    return files.mapInArrow(lambda it: _documents(it, before), "doc_id long, start long, n_tokens long, ids binary")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[int] | None:
    """One document's ids by random access: only its shard is read, only its symbols are expanded."""
    holds = F.udf(lambda b: bool((np.frombuffer(b, "<i8") == doc_id).any()), "boolean")
    for row in spark.read.schema(_ROW).parquet(path).filter(holds("doc_id")).toLocalIterator():
        ids = np.frombuffer(row["doc_id"], "<i8")
        at = np.flatnonzero((ids == doc_id) & ~np.frombuffer(row["no_id"], bool))
        if len(at):
            n = np.frombuffer(row["ids"], "<i8")
            first = int(n[:at[0]].sum())
            return decode(grammar_of(row), first, first + int(n[at[0]])).tolist()
    return None


def file_digests(docs: DataFrame, tokenizer: str, end_id: int = 2, shard_docs: int = 1000) -> DataFrame:
    """Write the files to the shared folder, read them back: doc_id, start, n_tokens, ids_crc32."""
    path = write(docs, tokenizer, fresh_path(docs.sparkSession, "token-files"), end_id, shard_docs)
    return read(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
