"""SentencePiece models run by the tokenizers library.

The model's protobuf is parsed and its parts rebuilt: the normaliser
(precompiled character map, white-space rules), the metaspace marker with the
dummy prefix, the model itself (unigram: pieces with their scores; BPE: merges
in the order of the scores) and byte fallback.  Where no piece has the marker
behind another character, texts may be cut before every run of markers, which
lets the library reuse what it has seen; otherwise they are not cut.

Batches are encoded by the library's own threads, and these ids are returned.  Every
text is encoded by the sentencepiece library as well: ``parity`` tells whether both
agree, and only where they do not (pieces of equal score can tie) the ids of
sentencepiece stand in.  Decoding is a table look-up over all ids of a batch.

Defined results: a null or empty text has no ids and decodes to the empty text;
a marker character inside a text decodes to a space, as in sentencepiece
(``round_trip`` is then false); repeated rows are encoded each; an empty table
gives an empty result; ``encode`` keeps all other columns.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X

MARK = "▁"
# piece kinds of the model's protobuf (fixed values)
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def load(path: str):
    from sentencepiece import sentencepiece_model_pb2 as pb
    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model


def _merges(pieces) -> list[tuple[str, str]]:
    """All ways to make a piece of two others, the best-scored piece first."""
    score = {p.piece: p.score for p in pieces if p.type in (NORMAL, USER_DEFINED)}
    order = {p.piece: i for i, p in enumerate(pieces)}
    found = [(-score[p], order[p], i, p[:i], p[i:]) for p in score for i in range(1, len(p))
             if p[:i] in score and p[i:] in score]
    return [(a, b) for *_, a, b in sorted(found)]


def build(model):
    """The tokenizers-library twin of a sentencepiece model."""
    from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers
    t, n, pieces = model.trainer_spec, model.normalizer_spec, model.pieces
    unknown = next(i for i, p in enumerate(pieces) if p.type == UNKNOWN)
    if t.model_type == UNIGRAM:
        backend = models.Unigram([(p.piece, p.score) for p in pieces], unk_id=unknown, byte_fallback=t.byte_fallback)
    elif t.model_type == BPE:
        backend = models.BPE({p.piece: i for i, p in enumerate(pieces)}, _merges(pieces),
                             unk_token=pieces[unknown].piece, byte_fallback=t.byte_fallback, fuse_unk=True)
    else:
        raise ValueError("only unigram and BPE models are supported")
    steps = []
    if n.precompiled_charsmap:
        steps.append(normalizers.Precompiled(n.precompiled_charsmap))
    if n.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if n.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    if n.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK if n.escape_whitespaces else " "))
    out = Tokenizer(backend)
    out.normalizer = normalizers.Sequence(steps)
    if not any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in pieces):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    return out


class Decoder:
    """ids -> text by one gather: the bytes of every piece in one table."""

    def __init__(self, model):
        parts = []
        for p in model.pieces:
            if p.type == BYTE:
                parts.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == CONTROL:
                parts.append(b"")
            elif p.type == UNKNOWN:
                parts.append(model.trainer_spec.unk_surface.encode())
            else:
                parts.append(p.piece.replace(MARK, " ").encode())
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        self.size = np.array([len(p) for p in parts], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.prefix = model.normalizer_spec.add_dummy_prefix

    def texts(self, ids: np.ndarray, n: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ``n[0], n[1], ..`` ids."""
        size = self.size[ids]
        at = np.repeat(self.begin[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        data = self.flat[at].tobytes()
        ends = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(n)]]
        out = [data[a:b].decode(errors="replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        return [t[1:] if self.prefix and t.startswith(" ") else t for t in out]


class Codec:
    def __init__(self, path: str, threads: int):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        import sentencepiece
        model = load(path)
        self.fast = build(model)
        self.plain = sentencepiece.SentencePieceProcessor(model_file=path)
        self.decoder = Decoder(model)
        self.threads = threads

    def encode(self, texts: list[str]):
        """(ids, parity) of every text: the rebuilt tokenizer's ids, sentencepiece's where the check fails."""
        mine = [e.ids for e in self.fast.encode_batch_fast(texts, add_special_tokens=False)]
        theirs = self.plain.encode(texts, num_threads=self.threads)
        same = [a == b for a, b in zip(mine, theirs)]
        return [a if ok else b for a, b, ok in zip(mine, theirs, same)], same


_codecs: dict[str, Codec] = {}


def codec(path: str, threads: int) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path, threads)
    return _codecs[path]


def _encode(batches, path: str, threads: int):
    c = codec(path, threads)
    for batch in batches:
        for part in X.pieces(batch, "__text", 1 << 19):
            ids, same = c.encode([t or "" for t in part.column("__text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [part.column(k) for k in part.schema.names if k != "__text"]
                + [pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())],
                names=[*(k for k in part.schema.names if k != "__text"), "ids", "parity"])


def _free(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without its own columns of these names (they are replaced)."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def encode(docs: DataFrame, model: str, threads: int = 2, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array<int>) and ``parity``; columns of these names are replaced."""
    rest = _free(docs, "ids", "parity")
    text = docs.select(F.col(f"`{text_col}`")).schema.fields[0]
    source = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest.columns)], F.col(f"`{text.name}`").alias("__text"))
    kinds = "".join(f"c{i} {f.dataType.simpleString()}, " for i, f in enumerate(rest.schema))
    return (source.mapInArrow(lambda it: _encode(it, model, threads), f"{kinds}ids array<int>, parity boolean")
            .toDF(*rest.columns, "ids", "parity"))


def _decode(batches, path: str):
    d = Decoder(load(path))
    for batch in batches:
        lists = batch.column("ids")
        n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        texts = d.texts(lists.flatten().to_numpy(zero_copy_only=False), n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                         names=[*batch.schema.names, "decoded"])


def decode(tokens: DataFrame, model: str) -> DataFrame:
    """``tokens`` (a column ``ids``) with the text ``decoded``."""
    source = _free(tokens, "decoded")
    plain = source.toDF(*["ids" if c == "ids" else f"c{i}" for i, c in enumerate(source.columns)])
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in plain.schema)
    return plain.mapInArrow(lambda it: _decode(it, model), f"{kinds}decoded string").toDF(*source.columns, "decoded")


def _digests(batches, path: str, threads: int):
    c = codec(path, threads)
    for batch in batches:
        for part in X.pieces(batch, "text", 1 << 19):
            texts = [t or "" for t in part.column("text").to_pylist()]
            ids, same = c.encode(texts)
            n = np.array([len(x) for x in ids], np.int64)
            flat = np.fromiter((i for x in ids for i in x), np.int64, int(n.sum()))
            back = c.decoder.texts(flat, n)
            raw, at = flat.astype("<u4").tobytes(), np.r_[0, np.cumsum(n)] * 4
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n),
                 pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64()),
                 pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                 pa.array([a == b for a, b in zip(back, texts)], pa.bool_()), pa.array(same, pa.bool_())],
                names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip", "parity"])


def digests(docs: DataFrame, model: str, threads: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (ids as little-endian 32 bits), decoded_sha256, round_trip, parity of every row."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(lambda it: _digests(it, model, threads),
                             "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean, parity boolean")
