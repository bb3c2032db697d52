"""Document fingerprints as invertible Bloom lookup sketches.

A text is cut into paragraphs (line ends, sentence ends and table bars close
one; very long ones are cut on), and each paragraph is hashed to a digest; the
second, third ... occurrence of a digest in a text counts as another element.
A sketch has three groups of cells; an element is added to one cell of each:
its count, the XOR of the elements and the XOR of their checks.

Two versions are compared by subtracting their cells: common paragraphs
vanish.  A cell left with one element (count +1 or -1 and a fitting check)
yields that element, which is then taken out of its other cells; peeling goes
on until all cells are empty.  When it gets stuck, both sketches are built
again, four times larger and with other hashes, until it succeeds.  The
recovered digests give the likeness (shared / all elements, 0 to 1) exactly.

Neighbouring documents meet by range buckets of doc_id: each document is moved
once, and the first document of a bucket is also sent to the bucket before.

Defined results: a null text is an empty one; an empty text has the empty
sketch, and two empty texts have likeness 1; documents are ordered by (doc_id,
text), null ids first, repeated rows each being a document; the only document
of a table is its own next; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as X
from .ordering import bounds, deal

CELLS = 24                      # cells of the stored fingerprint (three groups)
GROWTH = 4
_STOP = r"\n.!?|;。！？"
#: up to 120 characters and the marks that close them
PARAGRAPH = rf"(?s)[^{_STOP}]{{1,120}}[{_STOP}]*|[{_STOP}]+"
_SALT = 0x9E3779B97F4A7C15


def digests(text):
    """Column of a text's paragraph digests (array<long>), blank paragraphs left out."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0))
    return F.transform(F.filter(F.transform(found, lambda p: F.trim(p)), lambda p: p != ""), lambda p: F.xxhash64(p))


def elements(lists: pa.Array):
    """(element, owner) of a list<long> column: digests told apart by occurrence."""
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    d = lists.flatten().to_numpy(zero_copy_only=False).view(X.U)
    own = np.repeat(np.arange(len(lists)), n)
    order = np.lexsort((d, own))
    same = np.zeros(len(d), bool)
    same[1:] = (d[order][1:] == d[order][:-1]) & (own[order][1:] == own[order][:-1])
    at = np.arange(len(d))
    start = np.maximum.accumulate(np.where(same, 0, at))
    times = np.empty(len(d), X.U)
    times[order] = (at - start).astype(X.U)
    return X.mix(d + times * X.U(_SALT)), own


def _places(x: np.ndarray, own: np.ndarray, cells: int, level: int):
    """Three cells of each element, in the table that holds all owners' cells."""
    third = cells // 3
    for g in range(3):
        h = X.mix(x + X.U((1 + g + 3 * level) * _SALT % (1 << 64)))
        yield own * cells + g * third + ((h >> X.U(32)) * X.U(third) >> X.U(32)).astype(np.int64)


def _check(x):
    return X.mix(x ^ X.U(0x5BD1E9955BD1E995)) >> X.U(32)


class Sketch:
    """Cells of many documents side by side."""

    def __init__(self, owners: int, cells: int, level: int):
        self.owners, self.cells, self.level = owners, cells, level
        self.count = np.zeros(owners * cells, np.int64)
        self.key = np.zeros(owners * cells, X.U)
        self.check = np.zeros(owners * cells, X.U)

    def add(self, x, own, sign=1):
        c = _check(x)
        for at in _places(x, own, self.cells, self.level):
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, x)
            np.bitwise_xor.at(self.check, at, c)
        return self

    def peel(self):
        """(elements, owners, signs) recovered, and which owners came out empty."""
        got = []
        while True:
            at = np.flatnonzero((np.abs(self.count) == 1) & (_check(self.key) == self.check))
            if not len(at):
                break
            own, x, sign = at // self.cells, self.key[at], self.count[at]
            order = np.lexsort((x, own))
            own, x, sign = own[order], x[order], sign[order]
            new = np.r_[True, (x[1:] != x[:-1]) | (own[1:] != own[:-1])]
            own, x, sign = own[new], x[new], sign[new]
            self.add(x, own, -sign)
            got.append((x, own, sign))
        left = (self.count != 0) | (self.key != 0)
        empty = ~left.reshape(self.owners, self.cells).any(axis=1)
        if not got:
            return np.zeros(0, X.U), np.zeros(0, np.int64), np.zeros(0, np.int64), empty
        return *(np.concatenate(c) for c in zip(*got)), empty

    def text(self) -> list[str]:
        """The fingerprint strings: all cells of an owner, little-endian, base 64."""
        raw = np.concatenate([
            self.count.astype("<i4").view(np.uint8).reshape(self.owners, -1),
            self.key.astype("<u8").view(np.uint8).reshape(self.owners, -1),
            self.check.astype("<u4").view(np.uint8).reshape(self.owners, -1)], axis=1)
        return [base64.b64encode(r.tobytes()).decode() for r in raw]


def differences(a, b, owners: int):
    """Peel ``a - b`` for every owner: (elements, owners, signs); sign +1 stands in ``a`` only.
    Owners whose sketch does not decode are tried again with larger ones."""
    (xa, oa), (xb, ob) = a, b
    out, cells, level = [], CELLS, 0
    todo = np.arange(owners)
    while len(todo):
        index = np.full(owners, -1)
        index[todo] = np.arange(len(todo))
        sa, sb = index[oa] >= 0, index[ob] >= 0
        s = Sketch(len(todo), cells, level).add(xa[sa], index[oa][sa]).add(xb[sb], index[ob][sb], -1)
        x, own, sign, empty = s.peel()
        use = empty[own]
        out.append((x[use], todo[own[use]], sign[use]))
        todo = todo[~empty]
        cells, level = cells * GROWTH, level + 1
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, X.U),) + (np.zeros(0, np.int64),) * 2


def likeness(a, b, owners: int):
    """(likeness, elements only in a, elements only in b) for every owner."""
    _, own, sign = differences(a, b, owners)
    gone = np.bincount(own[sign > 0], minlength=owners)
    new = np.bincount(own[sign < 0], minlength=owners)
    shared = np.bincount(a[1], minlength=owners) - gone
    whole = shared + gone + new
    return np.where(whole > 0, shared / np.maximum(whole, 1), 1.0), gone, new


def _compare(batches, limit: int = 1 << 16):
    for batch in batches:
        if not batch.num_rows:
            continue
        size = sum(batch.column(c).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                   for c in ("own", "edited", "next"))
        part = (np.cumsum(size) - size) // limit
        cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            p = batch.slice(int(lo), int(hi - lo))
            own, edited, after = (elements(p.column(c)) for c in ("own", "edited", "next"))
            n = p.num_rows
            near, gone, new = likeness(own, edited, n)
            near_next, _, _ = likeness(own, after, n)
            yield pa.RecordBatch.from_arrays(
                [p.column("doc_id"), p.column("n_chars"), p.column("edited_sha256"),
                 pa.array(Sketch(n, CELLS, 0).add(*own).text()), pa.array(Sketch(n, CELLS, 0).add(*edited).text()),
                 pa.array(near), pa.array(near_next), pa.array(gone.astype(np.int64)), pa.array(new.astype(np.int64))],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
                       "near_next", "paragraphs_removed", "paragraphs_added"])


def with_next(docs: DataFrame, bucket_rows: int = 2000, most_buckets: int = 50_000, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """(doc_id, text, next_text) of every row in ascending (doc_id, text), the last followed by the first."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    low, nulls, least = bounds(rows, bucket_rows, most_buckets)
    dealt = deal(rows, low, copies=True)
    # the first document of all follows the last one
    first = (rows.filter(F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(least))
             .groupBy("doc_id").agg(F.min("text").alias("text"))
             .select("doc_id", "text", F.lit(len(low)).cast("long").alias("bucket"), F.lit(True).alias("copy")))
    w = Window.partitionBy("bucket").orderBy("copy", F.col("doc_id").asc_nulls_first(), "text")
    return (dealt.unionByName(first).withColumn("next_text", F.lead("text").over(w)).filter(~F.col("copy"))
            .select("doc_id", "text", "next_text"))


def fingerprints(docs: DataFrame, bucket_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited version (see the query's contract), with likenesses."""
    pairs = with_next(docs, bucket_rows, id_col=id_col, text_col=text_col).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut))
    return (pairs.withColumn("edited", edited)
            .select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                    digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("edited"),
                    digests(F.col("next_text")).alias("next"))
            .mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                  "edited_fingerprint string, near_edited double, near_next double, "
                                  "paragraphs_removed long, paragraphs_added long"))
