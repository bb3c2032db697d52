r"""Removal of lines that many documents share (DataFrame functions only).

1. Texts are split at ``\n``.  A line's key is the line stripped of ASCII white space
   at both ends, with A-Z lower-cased; keys of ``min_chars`` code points or more count.
2. Each document gives the 128-bit digests of its distinct keys once; one grouping by
   digest, combined inside the map tasks, counts the documents and keeps the largest
   doc_id.  Digests found in ``min_docs`` documents or more are the frequent table.
3. The lines are exploded again with their positions and meet the frequent table.  A
   digest with more than ``1 / (4 * buckets)`` of all frequent lines is hot; there are
   fewer than ``4 * buckets`` of these, so they are broadcast and settle their
   lines first.  The others join by digest, by whatever way their measured size suggests.
4. The positions that go come together for each document, and its text is put together
   from the other positions.

Texts travel once at most, and only where the positions to drop are too many to send to
the texts.  Nothing reaches the driver.

Defined results: a document is a row.  A null or empty text is one empty line.  Repeated
rows (or rows that share a doc_id) count one by one and, where they hold the largest
doc_id, all keep the line.  A null doc_id is smaller than all others: a key held by rows
without doc_id alone keeps its lines in all of them.  A document that repeats a line
keeps or loses every one of them.  An empty table gives an empty one.  Other columns,
whatever their names, are ignored by ``deduplicated_lines`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .store import kept

MIN_CHARS = 40
MIN_DOCS = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = " \t\n\x0b\x0c\r"


def key_of(line: Column) -> Column:
    """The key under which two lines are the same."""
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def digests_of(text: Column, min_chars: int) -> Column:
    """The digest of each line's key as hex, null where the key is too short."""
    return F.transform(F.transform(lines_of(text), key_of), lambda k: F.when(F.char_length(k) >= min_chars, F.md5(k)))


def frequent_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(digest, n_docs, keeper): the keys found in at least ``min_docs`` documents, with the
    largest doc_id that holds them."""
    own = F.array_distinct(F.array_compact(digests_of(F.col("text"), min_chars)))
    return (docs.select("doc_id", F.explode(own).alias("digest"))
            .groupBy(F.unhex("digest").alias("digest")).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
            .filter(F.col("n_docs") >= min_docs))


def _dropped(docs: DataFrame, frequent: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, print, gone): the positions that each document loses, for documents that lose any."""
    buckets = min(shuffle_partitions(docs.sparkSession), 1 << 14)
    total = frequent.agg(F.sum("n_docs")).first()[0] or 0
    is_hot = F.col("n_docs") * F.lit(4 * buckets) > F.lit(total)
    hot = frequent.filter(is_hot).select("digest", F.col("keeper").alias("hot_keeper"))
    rest = frequent.filter(~is_hot).select(F.col("digest").alias("seek"), "keeper")
    lines = (docs.select("doc_id", "print", F.posexplode(digests_of(F.col("text"), min_chars)).alias("at", "digest"))
             .filter(F.col("digest").isNotNull()).withColumn("digest", F.unhex("digest")))
    # a settled line looks for nothing: its key is longer than a digest and differs by document
    settled = F.concat(F.col("digest"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).cast("binary"))
    found = (lines.join(F.broadcast(hot), "digest", "left")
             .withColumn("seek", F.when(F.col("hot_keeper").isNull(), F.col("digest")).otherwise(settled))
             .join(rest, "seek", "left").withColumn("keeper", F.coalesce("hot_keeper", "keeper")))
    return (found.filter(F.col("keeper").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("keeper")))
            .groupBy("doc_id", "print").agg(F.collect_set("at").alias("gone")))


def _judged(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(row, n_lines, n_dropped, kept) of ``docs`` (doc_id, text, row); ``row`` is handed through."""
    known = docs.withColumn("print", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    frequent = kept(frequent_lines(docs.select("doc_id", "text"), min_chars, min_docs), "line-dedup-frequent")
    gone = _dropped(known.select("doc_id", "text", "print"), frequent, min_chars)
    a, b = known.select("doc_id", "print", "row", "text", lines_of(F.col("text")).alias("lines")).alias("a"), gone.alias("b")
    both = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.print") == F.col("b.print")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce(F.col("gone"), F.array().cast("array<int>")))
    out = both.select("row", "lines", "a.text", F.coalesce(F.size("gone"), F.lit(0)).alias("n_dropped"), F.when(F.col("gone").isNotNull(), stay).alias("stay"))
    whole = F.coalesce(F.col("text"), F.lit(""))
    return out.select("row", F.size("lines").cast("long").alias("n_lines"), F.greatest("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
                      F.when(F.col("stay").isNull(), whole).otherwise(
                          F.array_join(F.transform("stay", lambda i: F.col("lines")[i]), "\n")).alias("kept"))


def deduplicated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): every document with its remaining lines."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.struct("doc_id").alias("row"))
    return _judged(rows, min_chars, min_docs).select("row.doc_id", "n_lines", "n_dropped", F.col("kept").alias("text"))


def deduplicate(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with their remaining lines as ``text`` (a null text stays null), all columns kept."""
    others = [F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.struct(*others).alias("row"))
    out = _judged(rows, min_chars, min_docs)
    at = docs.columns.index("text")
    cols = [F.when(F.col(f"row.c{i}").isNotNull(), F.col("kept")) if i == at else F.col(f"row.c{i}") for i in range(len(docs.columns))]
    return out.select(*(c.alias(name) for c, name in zip(cols, docs.columns)))
