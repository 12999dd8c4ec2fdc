"""From documents to token ids: quality, near-duplicates, personal data, mixture, pieces.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, but for the last, which returns ids.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panewise.llm import mixing, near_text, pieces, pii, quality
from panewise.llm._common import written

#: Spark's limit of the bytes of an Arrow batch, and what the last stage sets it to.
LIMIT, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their own rules or their host's rate reject go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays, that with the smallest doc_id."""
    return near_text.keep_one(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; n_chars follows."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is used at least once, those of small sources up to twice."""
    return mixing.mix_documents(docs)


def few_bytes(spark: SparkSession) -> None:
    """Rows go to Python in batches of about BATCH bytes, for the session from here on, unless it asks for less.

    As Spark comes (10,000 rows, 64 MB) a batch is a whole task's texts, which the JVM and the worker hold once each.
    """
    size, unit = re.fullmatch("([0-9]+)([kmgtp]?)b?", spark.conf.get(LIMIT, "64m").lower()).groups()
    if int(size) << 10 * " kmgtp".index(unit or " ") > BATCH:
        spark.conf.set(LIMIT, str(BATCH))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded_sha256): the ids of each document's use, and what they decode to."""
    few_bytes(spark)
    found = pieces.encoded(docs)
    return found.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("private_data", private_data),
    ("mixture", mixture),
    ("piece_ids", piece_ids),
]

#: The classes of the second stage and the model of the third are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each stage's result a written table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
