"""Registered queries of the training-data operators (``op<N>_<name>``) and their SQL twins."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import functions as F

from ..sources.tables import table
from . import chat_format as C10
from . import decontaminate as D4
from . import hard_negatives as H12
from . import iblt as B1
from . import line_dedup as L11
from . import lm_scoring as L2
from . import merkle as M13
from . import piece_codec as P6
from . import quality as Q7
from . import simhash as S3
from . import suffix_dedup as S9
from . import surrogates as E5
from . import token_files as T8

QUERIES: dict = {}
ORACLE: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("op1_document_fingerprints")
def op1_document_fingerprints(spark, sf):
    return B1.fingerprints(table(spark, sf, "documents"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, len(w) AS n, list_slice(w, i, i + least(10, len(w)) - 1) AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
bs AS (SELECT DISTINCT item_id, len(win) AS n, array_to_string(win, ' ') AS win FROM bw),
sizes AS (SELECT DISTINCT n FROM bs),
dw AS (SELECT doc_id, w, s.n AS n, unnest(range(1, greatest(len(w) - s.n + 2, 1))) AS i FROM d, sizes s WHERE len(w) >= s.n),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bs.item_id FROM dw JOIN bs
         ON bs.n = dw.n AND bs.win = array_to_string(list_slice(dw.w, dw.i, dw.i + dw.n - 1), ' ')),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


@register("op4_decontamination", OP4_SQL)
def op4_decontamination(spark, sf):
    return D4.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@register("op2_lm_scoring")
def op2_lm_scoring(spark, sf):
    return L2.scores(table(spark, sf, "documents"))


@register("op3_simhash")
def op3_simhash(spark, sf):
    return S3.near_duplicates(table(spark, sf, "documents"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (SELECT doc_id, len(w) AS n, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS run
         FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS i FROM d)),
shared AS (SELECT run, min(doc_id) AS lead FROM runs GROUP BY run HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT doc_id, n, i, lead, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM runs JOIN shared USING (run)),
part AS (SELECT *, sum(CASE WHEN before IS NULL OR i - before > 50 THEN 1 ELSE 0 END)
                   OVER (PARTITION BY doc_id ORDER BY i) AS p FROM hit)
SELECT doc_id, CAST(min(i) - 1 AS BIGINT) AS begin_word, CAST(max(i) + 49 AS BIGINT) AS end_word,
       CAST(min(n) AS BIGINT) AS n_words, min(lead) AS first_doc_id
FROM part GROUP BY doc_id, p"""


@register("op9_suffix_dedup", OP9_SQL)
def op9_suffix_dedup(spark, sf):
    return S9.repeated_passages(table(spark, sf, "documents"))


@register("op8_token_files")
def op8_token_files(spark, sf):
    return T8.file_digests(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register("op6_sentencepiece")
def op6_sentencepiece(spark, sf):
    return P6.digests(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@register("op7_quality")
def op7_quality(spark, sf):
    return Q7.quality(table(spark, sf, "documents"), table(spark, sf, "labels"), stored=True)


OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
k AS (SELECT conv_id, bool_or(regexp_matches(text, '<\|im_(start|end)\|>') OR regexp_matches(text, '<\\+[|~]')) AS hard FROM c GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(role) + CASE WHEN hard THEN length(regexp_replace(text, '<(\\*)([|~])', '<_\1\2', 'g'))
                                         ELSE length(text) END) AS BIGINT) AS formatted_chars,
       TRUE AS round_trip
FROM c JOIN k USING (conv_id) GROUP BY conv_id"""


@register("op10_chat_format", OP10_SQL)
def op10_chat_format(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    hard = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return C10.read_back(C10.format_conversations(rows.unionByName(extra)))


#: Key of the registered query's surrogates; a deployment passes its own secret.
PII_KEY = "surrogates-v1"


@register("op5_pii_surrogates")
def op5_pii_surrogates(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return (E5.replace(docs, PII_KEY)
            .select("doc_id", F.col("__mentions").cast("long").alias("n_mentions"), "text",
                    F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")))


OP11_SQL = r"""
WITH l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS pos
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, often.key IS NOT NULL AND k.doc_id <> keeper AS gone FROM k LEFT JOIN often USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id"""


@register("op11_line_dedup", OP11_SQL)
def op11_line_dedup(spark, sf):
    return (L11.deduplicated_lines(table(spark, sf, "documents"))
            .select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")))


#: crc32 of the decimal doc_id, unsigned, bit by bit
CRC_OF_ID = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda ch: [CAST(ord(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"""


def _op13_sql(levels: int = 12) -> str:
    """One pair of CTEs for each level of the tree: 8 ** 12 documents a language."""
    fields = "concat(" + ", ".join(
        f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf, low = (f"sha256({fields.replace('{text}', t)})" for t in ("text", lower))
    parts = [f"""d AS (SELECT doc_id, lang, {leaf} AS leaf, {low} AS low FROM documents),
n0 AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, leaf AS h,
              count(*) OVER (PARTITION BY lang) AS n, doc_id, leaf, low FROM d)"""]
    runs = "PARTITION BY lang, place // 8 ORDER BY place ROWS BETWEEN"
    for k in range(levels):
        parts.append(f"""s{k} AS (SELECT lang, place, h, n, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({runs} UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS a,
       CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({runs} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS b FROM n{k})""")
        parts.append(f"""n{k + 1} AS (SELECT lang, place // 8 AS place, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY place)) ELSE min(h) END AS h,
       CAST(ceil(max(n) / 8.0) AS BIGINT) AS n FROM s{k} GROUP BY lang, place // 8)""")
    parts.append(f"""top AS (SELECT lang, h, coalesce(string_agg(h, '') OVER (ORDER BY lang NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
       coalesce(string_agg(h, '') OVER (ORDER BY lang NULLS FIRST ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM n{levels}),
root AS (SELECT sha256(string_agg(h, '' ORDER BY lang NULLS FIRST)) AS root FROM top)""")
    parts.append(f"""p0 AS (SELECT doc_id, lang, leaf, place, '' AS proof, CASE WHEN {CRC_OF_ID} % 3 = 0 THEN low ELSE leaf END AS cur FROM n0)""")
    for k in range(levels):
        parts.append(f"""p{k + 1} AS (SELECT p.doc_id, p.lang, p.leaf, p.place // 8 AS place, p.proof || coalesce(s.a || s.b, '') AS proof,
       CASE WHEN s.a IS NULL THEN p.cur ELSE sha256(s.a || p.cur || s.b) END AS cur
  FROM p{k} p JOIN s{k} s ON s.lang IS NOT DISTINCT FROM p.lang AND s.place = p.place)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, top.h AS subroot, root, sha256(proof || a || b) AS proof_sha256, sha256(a || cur || b) AS folded_root,
       sha256(a || cur || b) = root AS verified
FROM p{levels} p JOIN top ON top.lang IS NOT DISTINCT FROM p.lang, root"""


@register("op13_merkle_manifest", _op13_sql())
def op13_merkle_manifest(spark, sf):
    docs = table(spark, sf, "documents")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return (M13.verified_rows(docs, third, M13.lower_ascii(F.col("text")))
            .select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"))


OP12_SQL = r"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
       AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""


@register("op12_hard_negatives", OP12_SQL)
def op12_hard_negatives(spark, sf):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return H12.mine(rows, F.col("vec_id") % 100 == 0)
