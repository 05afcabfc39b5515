"""The index finds what a scan finds, reads what it needs, and follows changes."""

import re

import pytest
from pyspark.sql import functions as F

from atelier.operators import search, textindex
from atelier.sources import versions

TEXTS = ["Red wooden Sword", "wooden_sword.png red", "swordfish, redwood", None, "", "  ", "Épée rouge; épée bleue", "sword sword sword", "the red the red wooden", "RED—wooden", "中文 剑 red", "x1 2y 33"]
QUERIES = ["sword", "red", "red wooden", "wooden sword", "epee", "Épée rouge", "sword sword", "the red the", "中文 剑", "swor", "redw", "2", "png re", "none", "x1 2", "33"]


@pytest.fixture
def table(spark):
    return spark.createDataFrame([(i, t, TEXTS[-1 - i]) for i, t in enumerate(TEXTS)], "id int, name string, notes string").repartition(3)


def scan(table, text, prefix):
    where = (search.word if prefix else search.quoted)(["name", "notes"], text)
    return sorted(r["id"] for r in search.matching(table, where).collect())


def test_index_equals_scan(spark, table, tmp_path):
    index = textindex.opened(textindex.build(spark, f"{tmp_path}/words", table, "id", ["name", "notes"]))
    for text in QUERIES:
        for prefix in (False, True):
            assert sorted(r["id"] for r in index.holding(text, prefix).collect()) == scan(table, text, prefix), (text, prefix)
    assert index.holding(" -- ") is None and search.matching(table, index.condition("--")).count() == len(TEXTS)
    both = search.matching(table, index.condition("red") & ~index.condition("wood", prefix=True))
    assert sorted(r["id"] for r in both.collect()) == sorted(set(scan(table, "red", False)) - set(scan(table, "wood", True)))


def test_a_word_reads_its_letter_only(spark, table, tmp_path):
    index = textindex.opened(textindex.build(spark, f"{tmp_path}/words", table, "id", ["name", "notes"]))
    files = {re.search("initial=([^/]*)", f)[1] for f in index.base.inputFiles()}
    assert len(files) > 8
    plan = index.base.filter((F.col("initial") == "73") & F.col("token").startswith("swor"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*initial[^\]]*73", plan) and "StringStartsWith(token,swor)" in plan


def test_changes_and_compaction(spark, table, tmp_path):
    root = f"{tmp_path}/words"
    textindex.build(spark, root, table, "id", ["name", "notes"])
    now = table.withColumn("name", F.when(F.col("id") == 0, "blue axe").when(F.col("id") == 5, "red wooden sword").otherwise(F.col("name"))).filter("id <> 1").unionByName(table.filter("id = 2").withColumn("id", F.lit(99)))
    base = versions.snapshot(spark, root)
    textindex.refresh(spark, root, now.filter("id in (0, 5, 99)").withColumn("name", F.lit("first change")), table.filter("id = 1"), "id", ["name", "notes"])
    after = textindex.refresh(spark, root, now.filter("id in (0, 5, 99)"), table.filter("false"), "id", ["name", "notes"])
    assert after.places["postings"] == base.places["postings"]  # not written again
    whole = textindex.compact(spark, root)
    for at in (after, whole):
        index = textindex.opened(at)
        for text in ["red wooden", "sword", "axe", "first", "swordfish"]:
            assert sorted(r["id"] for r in index.holding(text).collect()) == scan(now, text, False), text
    assert textindex.opened(whole).stale.count() == 0
    old = textindex.opened(base)
    assert sorted(r["id"] for r in old.holding("sword").collect()) == scan(table, "sword", False)


def test_an_empty_table(spark, table, tmp_path):
    index = textindex.opened(textindex.build(spark, f"{tmp_path}/none", table.limit(0), "id", ["name"]))
    assert index.holding("red").count() == 0


def test_words_are_split_once(spark, tmp_path):
    """Finding the ranges of tokens goes through the rows as well; it reads them."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    table = spark.range(500).selectExpr("id", "concat('w', id, ' red') AS name").mapInArrow(run, "id long, name string")
    index = textindex.opened(textindex.build(spark, f"{tmp_path}/words", table, "id", ["name"]))
    assert index.base.count() == 1000 and seen.value == 500
