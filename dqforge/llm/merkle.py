"""Merkle manifest of a document table, its subtrees stored in van Emde Boas order.

Leaves are hashed on the JVM (only digests travel from there on) and ranked by
(lang, doc_id, leaf): one range sort of the digests, whose parts count their rows by
language, and offsets by part.  Eight consecutive nodes have one parent.

Storage: the leaves of a language are cut into aligned subtrees of ``8 ** HEIGHT``
leaves.  A subtree is one row: its nodes lie in one byte string in van Emde Boas order,
that is, the tree is split at half its height, the top tree comes first, then each
bottom tree, and every one of these is laid out the same way.  ``address`` computes where
a node lies from its depth and place alone; construction writes through it and sibling
retrieval reads through it, so neighbours on a path share cache lines and pages at every
size of these.  The roots of subtrees are the leaves of the next layer of subtrees, and
so on until a language has one: with 4,096 leaves a subtree, three layers hold 6.8e10
documents of one language.

Proofs: siblings go down the layers once for each subtree (not for each document); a
document's proof is its siblings inside its own subtree, then those of its subtree.  The
last run of the tree holds one subroot for each language and every proof includes all of
it, so these (32 bytes a language) are what the driver and each task must hold.

Defined results: a document is a row.  A null doc_id comes before all others and is never
tampered with; rows of one doc_id follow their leaf digests; equal rows are leaves side by
side and have proofs of their own.  Null lang is a language of its own, before all others,
and differs from an empty one.  Null and empty text differ (``-`` and ``0:``).  An empty
table has no rows and no root.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .store import kept

ARITY = 8
HEIGHT = 4
_W = 32                                        # bytes of a digest
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_LEAF = "lang string, doc_id long, leaf binary, tampered binary"
_TREE = "lang string, block long, n long, root binary, nodes binary"
_ABOVE = "lang string, block long, above array<struct<before:binary,after:binary>>"
_PROOF = ("doc_id long, lang string, leaf string, subroot string, root string, proof_sha256 string, "
          "folded_root string, verified boolean")


def sha(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def parent(children: bytes) -> bytes:
    """Digest of a run of digests, each taken as its hex text."""
    return sha(children.hex().encode())


def address(levels: int, depth: int, place):
    """Slot of the node(s) at ``depth`` (root 0) and ``place`` (from the left) of a complete tree of
    ``levels`` levels in van Emde Boas order."""
    if levels == 1:
        return place * 0
    top = levels // 2
    if depth < top:
        return address(top, depth, place)
    below = ARITY ** (depth - top)
    tree, inner = place // below, place % below
    return size_of(top) + tree * size_of(levels - top) + address(levels - top, depth - top, inner)


@functools.cache
def slots(levels: int, depth: int) -> np.ndarray:
    """``address`` of every place at ``depth``."""
    return address(levels, depth, np.arange(ARITY ** depth))


def size_of(levels: int) -> int:
    """Nodes of a complete tree."""
    return (ARITY ** levels - 1) // (ARITY - 1)


def height_of(n: int) -> int:
    """Levels of parents above ``n`` leaves."""
    h = 0
    while ARITY ** h < n:
        h += 1
    return h


def _count(n: int, up: int) -> int:
    """Nodes ``up`` levels above ``n`` leaves."""
    return -(-n // ARITY ** up)


def build_block(leaves: np.ndarray, height: int) -> np.ndarray:
    """Nodes (slots x 32 bytes) of one subtree over ``leaves`` (n x 32 bytes); slots without a node are zero."""
    nodes = np.zeros((size_of(height + 1), _W), np.uint8)
    level = leaves
    for depth in range(height, -1, -1):
        nodes[slots(height + 1, depth)[:len(level)]] = level
        if depth:
            level = np.frombuffer(b"".join(parent(level[i:i + ARITY].tobytes()) for i in range(0, len(level), ARITY)), np.uint8).reshape(-1, _W)
    return nodes


def siblings(nodes: np.ndarray, n: int, height: int, place: int) -> list[tuple[bytes, bytes]]:
    """For each level, from the leaves up: the digests left and right of the path within its run."""
    out = []
    for up in range(height):
        at = place // ARITY ** up
        lo = at - at % ARITY
        hi = min(lo + ARITY, _count(n, up))
        run = nodes[slots(height + 1, height - up)[lo:hi]]
        out.append((run[:at - lo].tobytes(), run[at - lo + 1:].tobytes()))
    return out


def fold(leaf: bytes, path) -> bytes:
    """The root that ``leaf`` and its siblings give."""
    for before, after in path:
        leaf = parent(before + leaf + after)
    return leaf


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(text: Column | None = None) -> Column:
    """Leaf of a document row, as 32 bytes; ``text`` stands in for its text."""
    cols = [text if f == "text" and text is not None else F.col(f) for f in FIELDS]
    return F.unhex(F.sha2(F.concat(*map(_field, cols)), 256))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame, tampered: Column | None = None, tampered_text: Column | None = None) -> DataFrame:
    """(lang, doc_id, leaf, tampered): ``tampered`` is the digest of rows that ``tampered`` marks, with their text replaced."""
    other = F.lit(None).cast("binary") if tampered is None else F.when(tampered, leaf_digest(tampered_text))
    return docs.select(*FIELDS).select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"),
                                       leaf_digest().alias("leaf"), other.alias("tampered"))


def _number(batches):
    """Place of each row among those of its language in this part; rows come sorted by language."""
    last, n = object(), 0
    for batch in batches:
        lang = batch.column("lang").to_pylist()
        out = np.empty(len(lang), np.int64)
        for i, x in enumerate(lang):
            if x != last:
                last, n = x, 0
            out[i] = n
            n += 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "i"])


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` of ``leaves`` with ``place``, their rank in the language from 0."""
    flat = kept(rows, "merkle-leaves")
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    n = shuffle_partitions(rows.sparkSession)
    sorted_ = (flat.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
               .sortWithinPartitions(*order).mapInArrow(_number, _LEAF + ", part int, i long"))
    numbered = kept(sorted_, "merkle-ranked")
    parts = numbered.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col("lang").alias("l"), F.col("part").alias("p"), F.coalesce(F.sum("rows").over(w), F.lit(0)).alias("offset"))
    return (numbered.join(offsets, F.col("lang").eqNullSafe(F.col("l")) & (F.col("part") == F.col("p")))
            .select("lang", "doc_id", "leaf", "tampered", (F.col("offset") + F.col("i")).alias("place")))


def _layer(rows: DataFrame, sizes: DataFrame, most: int, name: str, extra: str = "") -> DataFrame:
    """Subtrees over ``rows`` (lang, place, leaf, ...), kept as a table.  ``sizes`` (l, total) tells how many
    nodes the language has in this layer: where it has one subtree, that stops at its root.  ``most`` is a
    full subtree's height."""
    def block(key, table):
        total = key[2].as_py()
        order = np.argsort(table.column("slot").to_numpy())
        table = table.take(pa.array(order))
        digests = np.frombuffer(b"".join(table.column("leaf").to_pylist()), np.uint8).reshape(-1, _W)
        height = min(height_of(total), most)
        nodes = build_block(digests, height)
        cols = [[key[0].as_py()], [key[1].as_py()], [len(digests)], [nodes[0].tobytes()], [nodes.tobytes()]]
        types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        names = ["lang", "block", "n", "root", "nodes"]
        if extra:
            cols += [[table.column("doc_id").to_pylist()], [table.column("tampered").to_pylist()]]
            types += [pa.list_(pa.int64()), pa.list_(pa.binary())]
            names += ["doc_ids", "tampered"]
        return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    cut = rows.withColumn("block", F.expr(f"place div {ARITY ** most}")).withColumn("slot", F.col("place") % ARITY ** most)
    sized = cut.join(sizes, F.col("lang").eqNullSafe(F.col("l"))).drop("l")
    return kept(sized.groupBy("lang", "block", "total").applyInArrow(block, _TREE + extra), name)


def manifest(ranked_leaves: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """The layers of subtrees, lowest first; the lowest also holds its rows' doc_ids and tampered digests."""
    rows, layers, extra = ranked_leaves, [], ", doc_ids array<long>, tampered array<binary>"
    sizes = kept(rows.groupBy(F.col("lang").alias("l")).agg((F.max("place") + 1).alias("total")), "merkle-sizes")
    largest = sizes.agg(F.max("total")).first()[0] or 0
    while True:
        layers.append(_layer(rows, sizes, height, f"merkle-layer{len(layers)}", extra))
        if largest <= ARITY ** height:
            return layers
        above = F.expr(f"(total + {ARITY ** height - 1}) div {ARITY ** height}")
        sizes = sizes.filter(F.col("total") > ARITY ** height).select("l", above.alias("total"))
        rows = layers[-1].select("lang", F.col("block").alias("place"), F.col("root").alias("leaf"))
        largest, extra = _count(largest, height), ""


def subroots(layers: list[DataFrame]) -> list[tuple[str | None, bytes]]:
    """(lang, subroot) of every language, in their order in the root's run: one small row a language."""
    tops = []
    for k, layer in enumerate(layers):
        one = layer.groupBy("lang").agg(F.count(F.lit(1)).alias("blocks"), F.min("root").alias("root")).filter(F.col("blocks") == 1)
        tops.append(one.select(F.lit(k).alias("layer"), "lang", "root"))
    found: dict = {}
    for t in tops:
        for r in t.collect():
            found.setdefault(r.lang, bytes(r.root))       # a language that is done stands in no higher layer
    return sorted(found.items(), key=lambda x: (x[0] is not None, (x[0] or "").encode()))


def _path(row) -> list[tuple[bytes, bytes]]:
    return [(p["before"], p["after"]) for p in row]


def _send_down(batches, most: int):
    """Each subtree of a layer tells the subtrees below it what stands beside and above them."""
    for batch in batches:
        for r in range(batch.num_rows):
            lang, block, n, nodes, above = (batch.column(c)[r].as_py() for c in ("lang", "block", "n", "nodes", "above"))
            nodes = np.frombuffer(nodes, np.uint8).reshape(-1, _W)
            height = _levels(len(nodes)) - 1
            rest = _path(above or [])
            paths = [[{"before": a, "after": b} for a, b in siblings(nodes, n, height, i) + rest] for i in range(n)]
            kind = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(block * ARITY ** most + np.arange(n)), pa.array(paths, kind)],
                                             names=["lang", "block", "above"])


def _levels(nodes: int) -> int:
    levels = 1
    while size_of(levels) < nodes:
        levels += 1
    return levels


def _prove(batches, shared):
    tops, root = shared.value
    where = {lang: i for i, (lang, _) in enumerate(tops)}
    names = [c.split()[0] for c in _PROOF.split(", ")]
    for batch in batches:
        for r in range(batch.num_rows):
            lang, n, nodes, above, ids, tampered = (batch.column(c)[r].as_py() for c in ("lang", "n", "nodes", "above", "doc_ids", "tampered"))
            nodes = np.frombuffer(nodes, np.uint8).reshape(-1, _W)
            height = _levels(len(nodes)) - 1
            i = where[lang]
            top = [(b"".join(x for _, x in tops[:i]), b"".join(x for _, x in tops[i + 1:]))]
            rest = _path(above or []) + top
            tail = b"".join(a + b for a, b in rest).hex().encode()
            out: list[list] = [[] for _ in names]
            for place in range(n):
                own = siblings(nodes, n, height, place)
                leaf = nodes[slots(height + 1, height)[place]].tobytes()
                proof = hashlib.sha256(b"".join(a + b for a, b in own).hex().encode() + tail).hexdigest()
                folded = fold(tampered[place] or leaf, own + rest)
                for col, v in zip(out, (ids[place], lang, leaf.hex(), tops[i][1].hex(), root.hex(), proof, folded.hex(), folded == root)):
                    col.append(v)
            kinds = [pa.int64()] + [pa.string()] * 6 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)


def proofs(layers: list[DataFrame], height: int = HEIGHT) -> DataFrame:
    """One row a document: leaf, subroot, root, digest of its proof, and what its (tampered) leaf folds to."""
    spark = layers[0].sparkSession
    tops = subroots(layers)
    shared = spark.sparkContext.broadcast((tops, parent(b"".join(x for _, x in tops))))
    above = None
    for layer in reversed(layers[1:]):
        below = _with_above(layer.select("lang", "block", "n", "nodes"), above).mapInArrow(lambda it: _send_down(it, height), _ABOVE)
        above = kept(below, "merkle-above")
    return _with_above(layers[0], above).mapInArrow(lambda it: _prove(it, shared), _PROOF)


def _with_above(layer: DataFrame, above: DataFrame | None) -> DataFrame:
    if above is None:
        return layer.withColumn("above", F.lit(None).cast("array<struct<before:binary,after:binary>>"))
    a = above.select(F.col("lang").alias("l"), F.col("block").alias("b"), "above")
    return layer.join(a, F.col("lang").eqNullSafe(F.col("l")) & (F.col("block") == F.col("b")), "left").drop("l", "b")


def verified_rows(docs: DataFrame, tampered: Column | None = None, tampered_text: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """``proofs`` of ``docs``, whose rows marked by ``tampered`` are checked with ``tampered_text``."""
    return proofs(manifest(ranked(leaves(docs, tampered, tampered_text)), height), height)
