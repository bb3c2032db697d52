"""Corpus pipeline over ``documents``: stages built on the training-data operators.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which ``run`` writes as Parquet to the shared folder and
reads again as the next stage's documents.  All but the last stage return the
columns of ``documents`` as they came.

1. quality          documents scored under 0.7 go
2. near_duplicates  one document of each group of SimHash links stays (the smallest doc_id)
3. decontamination  documents that hold a benchmark window go
4. pii              mentions are replaced by surrogates
5. tokens           SentencePiece ids of every text, with the decoded text's digest

Null texts count as empty ones in every stage and stay null; repeated rows are
judged one by one, except that near-duplicates keep one of them; columns beyond
those of ``documents`` are carried along; an empty table passes as an empty one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

import public_tokenizers
from dqforge.llm import decontaminate, piece_codec, quality, simhash, surrogates
from dqforge.llm.store import kept

QUALITY_THRESHOLD = 0.7
PII_KEY = "surrogates-v1"


def quality_stage(spark, docs, sf_dir):
    rows = quality.features(docs, stored=True)      # run() hands each stage a table
    model = quality.fit(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(rows, model).filter(F.col("__score") >= QUALITY_THRESHOLD).drop("__score")


def near_duplicate_stage(spark, docs, sf_dir):
    return simhash.deduplicate(docs)


def decontamination_stage(spark, docs, sf_dir):
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark, docs, sf_dir):
    return surrogates.replace(docs, PII_KEY).drop("__mentions")


def token_stage(spark, docs, sf_dir):
    return piece_codec.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage),
          ("pii", pii_stage), ("tokens", token_stage)]

#: a trained classifier and a tokenizer's ids have no SQL form
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
