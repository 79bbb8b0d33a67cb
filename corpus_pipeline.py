"""A corpus pipeline of five stages over `documents`; every stage is written as Parquet and read again.

quality_classifier          rejected documents go
ngram_jaccard_join          of each group of near copies the document with the smallest id stays
benchmark_decontamination   documents that hold a benchmark item go
secret_scan                 secrets are replaced by a mark, n_chars follows
bpe_tokens                  digests of ids and of the decoded bytes

Stages with work in Python hand few texts over at once and save its rows before they return: executors and their Python
workers live through all stages, and what one stage has taken is there while the next one runs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldnotes.llm import bpe, decontaminate, jaccard, quality, secret_scan
from fieldnotes.llm.base import few_texts, row_key, saved, shared_folder
from fieldnotes.llm.queries import vocabulary

#: Ids or keys that may go to every task; more of them are joined by a shuffle.
FEW = 200_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with few_texts(spark):
        scored = quality.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
        return saved(scored.filter("keep").select(*docs.columns), "accepted")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows that links connect the one with the smallest id stays, of several such rows one; rows without an id
    come last. Rows that only share an id are not connected, and rows without words link with nothing."""
    linked = saved(jaccard.link(docs, key=row_key()).filter("label is not null").select("key", "doc_id", "label"), "linked")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"]
    stay = saved(linked.groupBy("label").agg(best.alias("key")).select("key"), "stay")
    copies = saved(linked.select("key").distinct().join(stay, "key", "left_anti"), "copies")
    keyed = docs.withColumn("key", row_key())
    kept = keyed.join(F.broadcast(copies) if copies.count() <= FEW else copies, "key", "left_anti")
    # rows with the same id and text; there are none in almost all tables, so look first
    repeated = saved(linked.groupBy("key").count().filter("count > 1").select("key").join(stay, "key", "left_semi"), "repeated")
    if not repeated.limit(1).count():
        return kept.select(*docs.columns)
    once = kept.join(repeated, "key", "left_semi").dropDuplicates(["key"])
    return kept.join(repeated, "key", "left_anti").unionByName(once).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold an item go, each for itself: rows that only share an id with one stay, rows without an id go too."""
    with few_texts(spark):
        found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=row_key())
        leaks = saved(found.select(F.col("doc_id").alias("key")).distinct(), "leaks")
    keyed = docs.withColumn("key", row_key())
    return keyed.join(F.broadcast(leaks) if leaks.count() <= FEW else leaks, "key", "left_anti").select(*docs.columns)


def secrets_replaced(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, "source")


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with few_texts(spark):
        encoded = bpe.encode(docs, *vocabulary())
        return saved(encoded.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256"), "tokens")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secrets_replaced),
    ("bpe_tokens", bpe_tokens),
]

#: Model fits and BPE merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
