"""Repeated passages through sparse suffix arrays.

A passage counts when at least ``length`` words (50) stand, word for word, in
more than one document.

1. *Sparse suffixes.*  Every run of ``length`` words holds ``length - seed + 1``
   seeds of ``seed`` words; the one with the smallest hash is its minimiser.
   Only suffixes at minimisers are retained (about one word in 18), and equal
   passages select equal places.
2. *Sort, compare neighbours.*  Suffixes are sorted by their seed; those whose
   neighbours in another document share the seed stay.
3. *Extend.*  Around each suffix that stays, the runs of ``length`` words that
   lead to it are compared at every offset to the left and right, again
   sorted against their neighbours.  Runs that occur in two documents, put
   together where they touch or overlap, are the maximal passages.

Equal texts are collapsed first: a document whose text another document has too
is one whole passage, and only one of the copies takes part in the steps above.

A seed shared by more than ``hot_limit`` suffixes (a second or two of a task's
time) does not meet in one task: such seeds are found by a map-side combined
count, and their runs are settled by combined minima and a salted join instead
of by sorting.

Words are runs of characters other than ASCII white space, A-Z lower-cased,
held as 64-bit hashes; a run is compared by 96 hash bits.

Defined results: null, empty and short texts (under ``length`` words) hold no
passage; a text that repeats only inside its own document is not reported;
rows equal in doc_id and text are one document; rows with equal or null doc_id
but other texts are different documents (null ids count as the smallest); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .store import kept

_NO_ID = -(1 << 63)
_POS_BITS = 28


def _select(w: X.Words, length: int, seed: int):
    """For every run of ``length`` words inside one text: (its start, its minimiser's place), and the seed hashes."""
    h = X.windows(w.hash, seed)
    ok = X.inside(w.first, w.n, seed, len(w.hash))
    place = np.arange(len(h), dtype=X.U)
    mask = X.U((1 << _POS_BITS) - 1)
    # the word count of a piece of text stays far below 2**28
    best = np.where(ok, (X.mix(h) & ~mask) | (place & mask), ~X.U(0))
    width, have = length - seed + 1, 1
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[:len(best) - step], best[step:]) if len(best) > step else best[:0]
        have += step
    starts = np.flatnonzero(X.inside(w.first, w.n, length, len(w.hash)))
    return starts, (best[starts] & mask).astype(np.int64), h


def _suffixes(batches, length: int, seed: int):
    table = X.space_table()
    for batch in batches:
        for part in X.pieces(batch):
            w = X.Words(*X.utf8(part.column("text")), table)
            _, place, h = _select(w, length, seed)
            place = np.unique(place)
            own = w.doc[place]
            rows = part.column("row").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(X.shift_all(h[place])), pa.array(rows[own]), pa.array((place - w.first[own]).astype(np.int32))],
                names=["seed", "row", "pos"])


def _extend(batches, length: int, seed: int):
    """Runs of ``length`` words that lead to a retained suffix (``cold``/``hot`` hold its places in the text)."""
    table = X.space_table()
    for batch in batches:
        for part in X.pieces(batch):
            w = X.Words(*X.utf8(part.column("text")), table)
            starts, place, _ = _select(w, length, seed)
            state = np.zeros(len(w.hash) + 1, np.int8)
            for name, code in (("cold", 1), ("hot", 2)):
                lists = part.column(name)
                own = np.repeat(np.arange(part.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                state[w.first[own] + lists.flatten().to_numpy(zero_copy_only=False)] = code
            use = state[place] > 0
            starts, place = starts[use], place[use]
            own = w.doc[starts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(X.shift_all(X.windows(w.hash, length)[starts])),
                 pa.array(X.shift_all(X.windows(w.hash, length, 0x9E3779B97F4A7C15)[starts]).astype(np.int32)),
                 pa.array(part.column("id").to_numpy(zero_copy_only=False)[own]),
                 pa.array(part.column("row").to_numpy(zero_copy_only=False)[own]),
                 pa.array((starts - w.first[own]).astype(np.int32)), pa.array(w.n[own].astype(np.int32)),
                 pa.array(state[place] == 2)],
                names=["run", "check", "id", "row", "pos", "n", "hot"])


def _neighbours(batches, keys: list[str], give: list[str], lead: str | None = None):
    """Batches sorted by ``keys`` then document: rows whose key also stands in another document.
    With ``lead`` the smallest such document's id is added.

    Only the rows of a key's first document are ever held back (until another document confirms
    the key), so a long run of one key takes no memory."""
    carry, confirmed = None, None

    def work(t, k, confirmed):
        first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)])
        last = np.r_[first[1:], len(k)] - 1
        row, size = t.column("row").to_numpy(), last - first + 1
        shared = row[first] != row[last]
        leads = t.column(lead).to_numpy()[first] if lead else None
        if confirmed is not None and (k[0] == confirmed[0]).all():
            shared[0] = True
            if lead:
                leads = leads.copy()
                leads[0] = confirmed[1]
        use = np.flatnonzero(np.repeat(shared, size))
        out = [t.column(c).combine_chunks().take(pa.array(use)) for c in give]
        names = list(give)
        if lead:
            out.append(pa.array(np.repeat(leads, size)[use]))
            names.append("lead")
        return pa.RecordBatch.from_arrays(out, names=names), (shared[-1], k[-1], leads[-1] if lead else None)

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if carry is not None:
            t = pa.concat_tables([carry, t])
            carry = None
        k = np.c_[tuple(t.column(c).to_numpy() for c in keys)]
        done = int(np.argmax((k == k[-1]).all(axis=1)))
        row = t.column("row").to_numpy()
        known = confirmed is not None and (k[-1] == confirmed[0]).all()
        if row[done] == row[-1] and not known:
            carry = t.slice(done).combine_chunks()
            t, k = t.slice(0, done), k[:done]
        if len(k):
            out, (shared, key, first_id) = work(t, k, confirmed)
            confirmed = (key, first_id) if shared else None
            yield out
    if carry is not None:
        yield work(carry, np.c_[tuple(carry.column(c).to_numpy() for c in keys)], confirmed)[0]


def _passages(batches, length: int):
    """Batches sorted by (row, pos): runs that touch or overlap become one passage."""
    carry = None

    def work(t):
        c = {x: t.column(x).to_numpy() for x in ("row", "pos", "id", "n", "lead")}
        new = np.r_[True, (np.diff(c["row"]) != 0) | (np.diff(c["pos"]) > length)]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(new)] - 1
        ids = c["id"][first]
        leads = np.minimum.reduceat(c["lead"], first)
        return pa.RecordBatch.from_arrays(
            [pa.array(c["row"][first]), pa.array(ids), pa.array(c["pos"][first].astype(np.int64)),
             pa.array(c["pos"][last].astype(np.int64) + length), pa.array(c["n"][first].astype(np.int64)), pa.array(leads)],
            names=["row", "doc_id", "begin_word", "end_word", "n_words", "first_doc_id"])

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if carry is not None:
            t = pa.concat_tables([carry, t])
        row = t.column("row").to_numpy()
        done = int(np.argmax(row == row[-1]))
        carry = t.slice(done).combine_chunks()
        if done:
            yield work(t.slice(0, done))
    if carry is not None:
        yield work(carry)


def repeated_passages(docs: DataFrame, length: int = 50, seed: int = 16, hot_limit: int = 1_000_000, salts: int = 16,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each maximal passage: doc_id, begin_word, end_word (exclusive), n_words (of the
    document), first_doc_id (the smallest doc_id that holds part of it, itself included)."""
    every = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    every = every.withColumn("row", F.xxhash64("text"))
    # equal texts are one text (that of the smallest id); their documents are whole passages
    copied = kept(every.groupBy("row").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least != most")
                  .select(F.col("row").alias("same"), "least"), "copied-texts")
    marked = every.join(copied, F.col("row") == F.col("same"), "left")
    texts = marked.filter("same is null or id = least").select("id", "row", "text")
    found = kept(_passages_of_texts(texts, length, seed, hot_limit, salts), "passages")
    single = found.join(copied, F.col("row") == F.col("same"), "left_anti").drop("row")
    lead = (found.join(copied, F.col("row") == F.col("same"), "left_semi")
            .groupBy(F.col("row").alias("of")).agg(F.min("first_doc_id").alias("lead")))
    copies = (marked.filter("same is not null")
              .select("id", "row", "least", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"))
              .filter(F.col("n_words") >= length).distinct().join(lead, F.col("row") == F.col("of"), "left"))
    known = lambda c: F.when(c != _NO_ID, c)
    return single.unionByName(copies.select(
        F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("begin_word"), F.col("n_words").alias("end_word"), "n_words",
        F.coalesce(F.least("least", "lead"), "least").alias("first_doc_id"))).withColumn(
            "doc_id", known(F.col("doc_id"))).withColumn("first_doc_id", known(F.col("first_doc_id")))


def _passages_of_texts(texts: DataFrame, length: int, seed: int, hot_limit: int, salts: int) -> DataFrame:
    """Passages shared by different texts (id, row, text): row, doc_id, begin_word, end_word, n_words, first_doc_id."""
    suffixes = kept(texts.select("row", "text").mapInArrow(lambda it: _suffixes(it, length, seed),
                                                          "seed long, row long, pos int"), "suffixes")
    hot = (suffixes.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("a"), F.max("row").alias("b"))
           .filter((F.col("n") > hot_limit)).select(F.col("seed").alias("hot_seed"), (F.col("a") != F.col("b")).alias("shared")))
    marked = suffixes.join(hot, F.col("seed") == F.col("hot_seed"), "left")
    cold = (marked.filter("hot_seed is null").select("seed", "row", "pos")
            .repartition("seed").sortWithinPartitions("seed", "row")
            .mapInArrow(lambda it: _neighbours(it, ["seed"], ["row", "pos"]), "row long, pos int")
            .withColumn("hot", F.lit(False)))
    stay = cold.unionByName(marked.filter("shared").select("row", "pos", F.lit(True).alias("hot")))
    places = stay.groupBy(F.col("row").alias("at")).agg(
        F.collect_set(F.when(~F.col("hot"), F.col("pos"))).alias("cold"),
        F.collect_set(F.when(F.col("hot"), F.col("pos"))).alias("hot"))
    runs = (texts.join(places, F.col("row") == F.col("at")).select("id", "row", "text", "cold", "hot")
            .mapInArrow(lambda it: _extend(it, length, seed),
                        "run long, check int, id long, row long, pos int, n int, hot boolean"))
    runs = kept(runs, "runs")
    fields = ["id", "row", "pos", "n"]
    sorted_runs = (runs.filter("not hot").drop("hot").repartition("run").sortWithinPartitions("run", "check", "id", "row")
                   .mapInArrow(lambda it: _neighbours(it, ["run", "check"], fields, "id"),
                               "id long, row long, pos int, n int, lead long"))
    hot_runs = runs.filter("hot")
    shared = (hot_runs.groupBy("run", "check").agg(F.min("row").alias("a"), F.max("row").alias("b"), F.min("id").alias("lead"))
              .filter("a != b")
              .select(F.col("run").alias("r"), F.col("check").alias("c"), "lead",
                      F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")))
    salt = F.pmod(F.xxhash64("row", "pos"), F.lit(salts)).cast("int")
    joined = (hot_runs.withColumn("s", salt)
              .join(shared, (F.col("run") == F.col("r")) & (F.col("check") == F.col("c")) & (F.col("s") == F.col("salt")))
              .select(*fields, "lead"))
    return (sorted_runs.unionByName(joined).repartition("row").sortWithinPartitions("row", "pos")
            .mapInArrow(lambda it: _passages(it, length),
                        "row long, doc_id long, begin_word long, end_word long, n_words long, first_doc_id long"))
