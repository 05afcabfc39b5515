"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, near_duplicates, neighbours, periodic, quality_model, quality_rules, secrets, sharding, token_counts, toxicity, url_filters, vector_codes

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str, keep: list[str] | None = None) -> DataFrame:
    """Documents are sites' pages here: their source is the host, source and language the path."""
    sample, good = toxicity.labelled(docs, read(spark, sf_dir, "labels"), most_each=1500, label="quality")
    model = quality_model.train(sample)
    host = F.col("source")
    return quality_model.judge(docs, model, host, F.concat_ws("/", host, F.col("lang")), min(max(0.5 if good is None else good, 0.01), 0.99), keep=keep)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality(spark, read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), sf_dir, keep=["doc_id"])
    return judged.select("doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", "posterior", "kept")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"), keep=["doc_id"])


def op3_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(read(spark, sf_dir, "documents"), [("source", "linear"), ("lang", "linear"), ("n_chars", "log")])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(read(spark, sf_dir, "pages"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, keep=["doc_id"])


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), ["doc_id"])


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.lengths(read(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, keep=[])
    return token_counts.suffix_sums(token_counts.histogram(counted))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))  # a null id is in no fold
    model = toxicity.train(*toxicity.labelled(docs, labels.filter(~held_out), most_each=1500))
    scored = toxicity.score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` where the end of the texts of one document in ten repeats with a period: words from ``a`` on become
    those of the first ``p`` from there. The document's id decides; a null id is not chosen."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = docs.select("doc_id", "text", F.floor(h / 10).alias("_g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))).alias("_w"))
    sized = split.select("*", F.size("_w").cast("bigint").alias("_n")).select("*", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).alias("_a"))
    n, a = F.col("_n"), F.col("_a")
    period = sized.select("*", (1 + F.floor((n - a) / (3 + F.col("_g") % 8))).alias("_p"))
    place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % F.col("_p"))
    repeated = F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get("_w", place(i).cast("int"))))
    return period.select("doc_id", F.when(n > 0, repeated).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.detect(planted(read(spark, sf_dir, "documents")), keep=["doc_id"])
    ordered = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("short")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = found.select("*", F.array_max(ordered).alias("best"))
    start, length, period = -F.col("best.before"), F.col("best.length"), -F.col("best.short")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neighbours.numbered(read(spark, sf_dir, "embeddings"))
    return neighbours.search(rows.filter("id % 50 = 0"), neighbours.index(rows), k=5, factor=1.0)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_quality_rules, op3_hilbert_sharding, op4_secret_scans, op5_url_filters,
        op6_byte_bpe, op7_decontaminate, op8_minhash, op9_token_counts, op10_toxicity,
        op11_periodic_runs, op12_neighbours, op13_vector_codes,
    )
}
