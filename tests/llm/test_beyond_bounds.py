"""Beyond each bound of what is broadcast the results are the same: each bound is set to 0."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from atelier.llm import quality_model, queries, url_filters

from ..compare import rows_of_spark


@pytest.mark.parametrize(
    ("name", "module", "bound"),
    [("op1_quality_classifier", quality_model, "BROADCAST_SITES"), ("op5_url_filters", url_filters, "BROADCAST_HOSTS")],
)
def test_queries(spark, folder, monkeypatch, name, module, bound):
    near = rows_of_spark(queries.QUERIES[name](spark, folder))
    monkeypatch.setattr(module, bound, 0)
    far = rows_of_spark(queries.QUERIES[name](spark, folder))
    assert far == near and len(far[1]) >= 50


def test_removed_duplicates(spark, folder, monkeypatch):
    """Null and repeated ids as well."""
    docs = queries.read(spark, folder, "documents")
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("bigint")))
    near = rows_of_spark(corpus_pipeline.near_dedup(spark, docs, folder))
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_IDS", 0)
    assert rows_of_spark(corpus_pipeline.near_dedup(spark, docs, folder)) == near and len(near[1]) < docs.count()
