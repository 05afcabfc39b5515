"""The pipeline's stages, each against its operator, and odd tables through all of them."""

import hashlib

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from atelier.llm import bpe, decontaminate, near_duplicates, queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, folder):
    docs = queries.read(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, folder).cache()
        assert docs.columns == COLUMNS, name
        assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        if name == "near-duplicates":
            assert docs.count() == near_duplicates.classes(before, percent=80).filter("kept").count()
        if name == "benchmark decontamination":
            found = decontaminate.report(before, queries.read(spark, folder, "benchmark"), ["doc_id"])
            assert docs.count() == found.filter("not contaminated").count() < before.count()
        if name == "secret scans":
            assert docs.count() == before.count() and docs.filter("n_chars <> length(text)").count() == 0
            assert docs.filter(F.col("text").rlike(r"[0-9a-f]{16}")).count() == 0
    tokens = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe._ranks(queries.RANKS), special_tokens={})
    for r in docs.collect():
        assert tokens[r["doc_id"]]["n_tokens"] == len(encoding.encode_ordinary(r["text"]))
        assert tokens[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_odd_rows(spark, folder):
    docs = queries.read(spark, folder, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", "src0", 0), (10**6, "", "en", "src0", 0), (10**6 + 1, "x" * 100_000, None, None, None)], docs.schema)
    for table in (docs.limit(20).unionByName(odd).withColumn("kept", F.lit("clash")), odd, docs.limit(0)):
        out = table
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, folder)
        assert out.columns[0] == "doc_id" and out.count() <= table.count()


def test_labels_of_quality(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")
    judged = queries.QUERIES["op1_quality_classifier"](spark, folder).join(queries.read(spark, folder, "labels"), "doc_id")
    right = judged.filter(F.col("kept") == (F.col("quality") == 1)).count()
    assert right >= 0.97 * judged.count()
