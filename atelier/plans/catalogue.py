"""The catalogue's tables, presented from the star-schema test tables, in Spark and as SQL.

Parts are assets, suppliers are packs, embeddings are palettes, customers are projects, line items
uses, events logs of jobs, pages files under folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, values

EXTENSIONS = ["png", "webp", "glb", "fbx", "svg", "psd", "wav", "gd"]
FOLDERS = ["PNG", "PSD", "1 Heroes", "tiles", "raw"]
T0 = 1_600_000_000


class Catalogue:
    """Lazily read tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def packs(self) -> DataFrame:
        s = self.table("supplier")
        state = F.when(F.col("s_acctbal") > 5000, "complete").when(F.col("s_acctbal") > 0, "partial").otherwise("none")
        return s.select(
            F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lower("s_name").alias("library_rel_path"), (F.col("s_nationkey") % 13).alias("license_id"), state.alias("provenance_state"),
            F.concat(F.lit("author"), F.col("s_nationkey")).alias("author"), F.when(F.col("s_suppkey") % 3 == 0, "by its author").otherwise("").alias("attribution_text"),
        )

    def assets(self) -> DataFrame:
        p, key = self.table("part"), F.col("p_partkey")
        ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("p_size") % 8 + 1).cast("int"))
        folder = F.element_at(F.array(*map(F.lit, FOLDERS)), (key % 5 + 1).cast("int"))
        rows = p.withColumn("ext", ext).withColumn("filename", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("."), F.col("ext")))
        return rows.select(
            key.alias("id"), (key % 10).alias("pack_id"), F.concat_ws("/", F.lower("p_type"), folder, "filename").alias("rel_path"), "filename", "ext", paths.kind(F.col("ext")).alias("kind"),
            F.round(F.col("p_retailprice") * 100).cast("long").alias("size"), (T0 + key * 3600).alias("first_seen_at"), (T0 + (key * 7919) % 100000).alias("mtime"),
            F.sha2(F.concat("p_name", F.col("p_size").cast("string")), 256).alias("sha256"), F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("width"), F.when(F.col("p_size") % 7 != 0, (key % 50 + 1).cast("int")).alias("height"),
            F.when(F.col("ext").isin("glb", "fbx"), (key * 31) % 5000).alias("tri_count"), F.when(key % 5 != 0, key % 2 == 0).alias("has_alpha"), F.when(key % 4 != 0, key % 3 == 0).alias("is_pixel_art"),
            F.when(key % 6 != 0, key % 4).alias("frame_count"), F.when(key % 17 == 0, F.lit(T0)).alias("missing_since"), F.col("p_name").alias("title"),
        )

    def asset_tags(self) -> DataFrame:
        p = self.table("part")
        first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
        tag = F.explode(F.array(
            F.struct(F.concat(F.lit("theme:"), first).alias("t"), F.when(F.col("p_partkey") % 3 == 0, "manual").otherwise("auto_path").alias("s")),
            F.struct(F.concat(F.lit("object:"), second, F.lit(":"), F.lower("p_type")).alias("t"), F.lit("auto_type").alias("s")),
            F.struct(F.when(F.col("p_partkey") % 29 == 0, "disable:true").alias("t"), F.lit("manual").alias("s")),
        ))
        return p.select(F.col("p_partkey").alias("asset_id"), tag.alias("x")).filter("x.t is not null").select("asset_id", F.col("x.t").alias("tag"), F.col("x.s").alias("source"))

    def pack_tags(self) -> DataFrame:
        s = self.table("supplier")
        tag = F.explode(F.array(F.concat(F.lit("license:l"), F.col("s_nationkey") % 5), F.concat(F.lit("theme:"), F.when(F.col("s_suppkey") % 2 == 0, "red").otherwise("old"))))
        return s.select(F.col("s_suppkey").alias("pack_id"), tag.alias("tag"))

    def swatches(self) -> DataFrame:
        """Four triples of each vector as colours of falling share."""
        e = self.table("embeddings")
        channel = lambda i: F.greatest(F.least(F.floor((F.element_at("embedding", i).cast("double") * 4 + 1) * 127.5), F.lit(255)), F.lit(0)).cast("int")
        rows = F.explode(F.array(*(F.struct(F.lit(k).alias("rank"), channel(3 * k + 1).alias("r"), channel(3 * k + 2).alias("g"), channel(3 * k + 3).alias("b"), F.lit([0.5, 0.3, 0.197, 0.003][k]).alias("ratio")) for k in range(4))))
        return e.select(F.col("vec_id").alias("asset_id"), rows.alias("s")).select("asset_id", "s.*")

    def hashes(self) -> DataFrame:
        """The signs of 24 numbers, spread over the bits of a hash; each vector is an image with a content, group and size."""
        bits = F.lit(0).cast("long")
        for i in range(24):
            one = 1 << i * 8 // 3
            bits = bits.bitwiseOR(F.when(F.element_at("embedding", i + 1) > 0, F.lit(one).cast("long")).otherwise(F.lit(0).cast("long")))
        return self.table("embeddings").select(F.col("vec_id").alias("id"), bits.alias("phash"), (F.col("vec_id") % 40).alias("sha256"), F.col("label").alias("group_id"), (F.col("vec_id") % 97 + 1).alias("size"))

    def files(self) -> DataFrame:
        """Host and path of each page as a path below folders."""
        return self.table("pages").select("page_id", "url", F.regexp_replace(F.regexp_extract("url", r"://([^?#]*)", 1), "/+$", "").alias("path"))

    def index(self) -> tuple[DataFrame, DataFrame]:
        """A stored index and a new listing of orders as files: some gone, new, changed, moved, ignored."""
        o, key = self.table("orders"), F.col("o_orderkey")
        sha = F.concat(F.lit("h"), F.col("o_custkey"), F.lit("-"), F.col("o_orderpriority"))
        folder = F.concat(F.lit("c"), F.col("o_custkey") % 20)
        old = o.filter(key % 10 != 0).select(
            key.alias("id"), F.concat_ws("/", folder, F.when(key % 23 == 0, F.lit(".Trash")), key.cast("string")).alias("path"), F.col("o_totalprice").cast("long").alias("size"), values.epoch("o_orderdate").alias("mtime"), sha.alias("sha256"),
            F.when(key % 19 == 0, F.lit(T0)).alias("missing_since"), F.when(key % 3 == 0, F.lit(T0) + key).alias("content_changed_at"),
        )
        changed, touched = key % 11 == 0, key % 13 == 0
        new = o.filter((key % 10 != 1) & (key % 23 != 0)).select(
            F.concat_ws("/", F.when(key % 7 == 0, F.lit("moved")).otherwise(folder), key.cast("string")).alias("path"), F.col("o_totalprice").cast("long").alias("size"),
            (values.epoch("o_orderdate") + F.when(changed | touched, 60).otherwise(0)).alias("mtime"), F.when(changed, F.concat(sha, F.lit("x"))).otherwise(sha).alias("sha256"),
        )
        return old, new

    def uses(self) -> DataFrame:
        li = self.table("lineitem")
        return li.select(
            (F.col("l_orderkey") % 50).alias("project_id"), F.col("l_partkey").alias("asset_id"), F.concat_ws("/", F.lit("res"), F.col("l_orderkey"), F.col("l_linenumber")).alias("res_path"), F.col("l_suppkey").alias("pack_id"),
            F.sha2(F.concat(F.lit(""), F.col("l_returnflag")), 256).alias("_x"), F.when(F.col("l_returnflag") == "R", values.epoch("l_shipdate")).alias("removed_at"), F.col("l_linestatus").alias("status"),
        ).drop("_x")

    def copies(self) -> DataFrame:
        """Documents as files with copies, their source as the folder."""
        d = self.table("documents")
        n = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
        return d.select(
            F.col("doc_id").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.col("n_chars").alias("size"), F.concat_ws("/", F.when(n % 3 == 0, F.lit("raw")), "source", F.col("doc_id").cast("string")).alias("path"),
            (F.col("doc_id") % 11 == 0).alias("used"), (n % 2 == 0).alias("complete"), (F.col("doc_id") % 4 == 0).alias("is_primary"), (F.col("doc_id") % 3).alias("variants"),
            (T0 + (F.col("doc_id") * 7919) % 5000).alias("first_seen_at"), F.when(F.col("doc_id") % 31 == 0, F.lit(T0)).alias("missing_since"),
        )


def _case(values: list[str], index: str) -> str:
    return "CASE " + index + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_KINDS = {"png": "image", "webp": "image", "glb": "model", "fbx": "model", "svg": "image", "psd": "image", "wav": "audio", "gd": "script"}
_PRECEDENCE = "CASE ext " + " ".join(f"WHEN '{e}' THEN {i + 1}" for i, e in enumerate(paths.PRECEDENCE)) + f" ELSE {len(paths.PRECEDENCE) + 1} END"
#: SQL of each table, by the names that the oracles use.
SQL = {
    "packs": """SELECT s_suppkey AS id, s_name AS name, s_nationkey % 13 AS license_id, CASE WHEN s_acctbal > 5000 THEN 'complete' WHEN s_acctbal > 0 THEN 'partial' ELSE 'none' END AS provenance_state,
        'author' || s_nationkey AS author, CASE WHEN s_suppkey % 3 = 0 THEN 'by its author' ELSE '' END AS attribution_text FROM supplier""",
    "assets": f"""SELECT *, filename0 AS filename, lower(p_type) || '/' || {_case(FOLDERS, "(id % 5)")} || '/' || filename0 AS rel_path, {_case(list(_KINDS.values()), "(p_size % 8)")} AS kind,
        lower(p_type) || '/' || CASE WHEN id % 5 > 1 THEN {_case(FOLDERS, "(id % 5)")} || '/' ELSE '' END || replace(p_name, ' ', '_') AS group_key, {_PRECEDENCE} AS precedence
        FROM (SELECT *, replace(p_name, ' ', '_') || '.' || ext AS filename0 FROM (SELECT *, p_partkey AS id, p_partkey % 10 AS pack_id, {_case(EXTENSIONS, "(p_size % 8)")} AS ext, round(p_retailprice * 100)::BIGINT AS size,
        {T0} + p_partkey * 3600 AS first_seen_at, {T0} + (p_partkey * 7919) % 100000 AS mtime, sha256(p_name || p_size) AS sha256, CASE WHEN p_size % 7 <> 0 THEN p_size END AS width,
        CASE WHEN p_size % 7 <> 0 THEN (p_partkey % 50 + 1)::INTEGER END AS height, CASE WHEN p_size % 8 IN (2, 3) THEN (p_partkey * 31) % 5000 END AS tri_count, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 2 = 0 END AS has_alpha,
        CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 3 = 0 END AS is_pixel_art, CASE WHEN p_partkey % 6 <> 0 THEN p_partkey % 4 END AS frame_count, CASE WHEN p_partkey % 17 = 0 THEN {T0} END AS missing_since FROM part))""",
    "asset_tags": """SELECT p_partkey AS asset_id, 'theme:' || split_part(p_name, ' ', 1) AS tag, CASE WHEN p_partkey % 3 = 0 THEN 'manual' ELSE 'auto_path' END AS source FROM part
        UNION ALL SELECT p_partkey, 'object:' || split_part(p_name, ' ', 2) || ':' || lower(p_type), 'auto_type' FROM part UNION ALL SELECT p_partkey, 'disable:true', 'manual' FROM part WHERE p_partkey % 29 = 0""",
    "pack_tags": """SELECT s_suppkey AS pack_id, 'license:l' || (s_nationkey % 5) AS tag FROM supplier UNION ALL SELECT s_suppkey, 'theme:' || CASE WHEN s_suppkey % 2 = 0 THEN 'red' ELSE 'old' END FROM supplier""",
    "swatches": "SELECT vec_id AS asset_id, k AS rank, " + ", ".join(f"greatest(least(floor((embedding[3 * k + {i + 1}]::DOUBLE * 4 + 1) * 127.5), 255), 0)::INTEGER AS {c}" for i, c in enumerate("rgb")) + ", [0.5, 0.3, 0.197, 0.003][k + 1]::DOUBLE AS ratio FROM embeddings, range(4) AS t(k)",
    "hashes": "SELECT vec_id AS id, list_transform(embedding[1:24], lambda x: x > 0) AS signs, vec_id % 40 AS sha256, label AS group_id, vec_id % 97 + 1 AS size FROM embeddings",
    "files": r"SELECT page_id, url, regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/+$', '') AS path FROM pages",
    "old": f"""SELECT o_orderkey AS id, 'c' || (o_custkey % 20) || '/' || CASE WHEN o_orderkey % 23 = 0 THEN '.Trash/' ELSE '' END || o_orderkey AS path, CAST(trunc(o_totalprice) AS BIGINT) AS size, epoch(o_orderdate)::BIGINT AS mtime,
        'h' || o_custkey || '-' || o_orderpriority AS sha256, CASE WHEN o_orderkey % 19 = 0 THEN {T0} END AS missing_since, CASE WHEN o_orderkey % 3 = 0 THEN {T0} + o_orderkey END AS content_changed_at FROM orders WHERE o_orderkey % 10 <> 0""",
    "new": """SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'moved' ELSE 'c' || (o_custkey % 20) END || '/' || o_orderkey AS path, CAST(trunc(o_totalprice) AS BIGINT) AS size,
        epoch(o_orderdate)::BIGINT + CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN 60 ELSE 0 END AS mtime, 'h' || o_custkey || '-' || o_orderpriority || CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE '' END AS sha256
        FROM orders WHERE o_orderkey % 10 <> 1 AND o_orderkey % 23 <> 0""",
    "uses": """SELECT l_orderkey % 50 AS project_id, l_partkey AS asset_id, 'res/' || l_orderkey || '/' || l_linenumber AS res_path, l_suppkey AS pack_id, CASE WHEN l_returnflag = 'R' THEN epoch(l_shipdate)::BIGINT END AS removed_at, l_linestatus AS status FROM lineitem""",
    "copies": f"""SELECT doc_id AS id, sha256(text) AS sha256, n_chars AS size, CASE WHEN n % 3 = 0 THEN 'raw/' ELSE '' END || source || '/' || doc_id AS path, n % 3 = 0 AS in_raw, doc_id % 11 = 0 AS used, n % 2 = 0 AS complete, doc_id % 4 = 0 AS is_primary,
        doc_id % 3 AS variants, {T0} + (doc_id * 7919) % 5000 AS first_seen_at, CASE WHEN doc_id % 31 = 0 THEN {T0} END AS missing_since FROM (SELECT *, regexp_extract(source, '([0-9]+)$', 1)::INTEGER AS n FROM documents)""",
}


def sql(query: str, *names: str) -> str:
    """The query with the named tables before it."""
    recursive = "RECURSIVE " if query.lstrip().upper().startswith("RECURSIVE") else ""
    body = query.lstrip()[len(recursive) :] if recursive else query
    extra = ""
    if body.lstrip().startswith("WITH "):
        extra, body = ", " + body.lstrip()[5:], ""
    return f"WITH {recursive}" + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + extra + (" " + body if body else "")
