"""The corpus pipeline: from raw documents to tokens in five stages.

Each stage takes the documents that its predecessor kept and returns those it keeps, with the
columns of documents; the last returns a row of tokens a document. Stages that need labels or the
benchmark read them from ``sf_dir``. Nulls, empty texts, ties and repeated rows are treated as each
stage's operator says; an empty table passes as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atelier.llm import bpe, decontaminate, near_duplicates, queries, secrets
from atelier.operators.scratch import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return queries.quality(spark, docs, sf_dir, keep=COLUMNS).filter("kept").select(*COLUMNS)


#: Ids up to which the removed documents are broadcast (16 MB); beyond, texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, percent: int = 80) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id. Of equal rows that
    share that id one stays; a duplicate stays as well if a kept document bears its id, as documents are told by their ids. Near-duplicates share ``percent`` % of their shingles at least."""
    found = cut(near_duplicates.classes(docs.select("doc_id", "text"), percent=percent).select("doc_id", "kept"), docs.count())
    ids = found.groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    gone = cut(ids.filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")), found.count())
    small = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    left = docs.join(small, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti").select(*COLUMNS)
    return left if ids.filter("n > 1").isEmpty() else left.dropDuplicates(["doc_id", "text"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean(docs.select(*COLUMNS), queries.read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    masked = secrets.redact(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


#: Words that a worker remembers in the last stage: fewer than by default, as the stages before leave executors less memory.
REMEMBERED_WORDS = 100_000


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``, the ids decoded again for the last."""
    return bpe.digests(docs, queries.RANKS, public_tokenizers.PATTERN, keep=["doc_id"], remembered=REMEMBERED_WORDS)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("byte-level BPE", tokens),
]

#: Compression of evidence into a verdict, and tokens, have no SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = queries.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return cut(STAGES[-1][1](spark, docs, sf_dir))
