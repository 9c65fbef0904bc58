"""From raw documents to token ids: five stages, each a step of ``tidemark.llm`` over all its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns they were given. ``run`` writes each
stage's rows to the shared folder and reads them back for the next one, so that a lost executor costs one stage at most.

1. quality: documents that the quality classifier rejects go.
2. near_duplicates: one document of each class of near duplicates stays, that of the least id.
3. decontaminate: documents that hold a benchmark item, also with other numbers or names, go.
4. redact: personal data is replaced by its kind in angle brackets.
5. encode: token ids of each text.

Null and empty texts are kept by all stages (as one class of duplicates) and have no tokens; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, jaccard, pii, quality
from tidemark.session import cut


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encode = bpe.encoder(public_tokenizers.path("word_bpe_49k.json"))
    ids = docs.select("doc_id", "lang", "source", encode(F.coalesce("text", F.lit(""))).alias("ids"))
    return ids.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", no_benchmark),
    ("redact", redacted),
    ("encode", token_ids),
]

#: Training and recursion have no place in SQL; tests/llm/test_llm_proofs.py holds the rows of run() against plain Python, from the ids the classifier keeps.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
