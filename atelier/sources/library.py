"""Folders of assets as tables: listings, packs, sidecar files, snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators.scratch import cut
from . import tree

SIDECAR = "name string, source_url string, author string, license string, tags array<string>, notes string, updated_at long"


def listing(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """``path, size, mtime`` of all files below a folder, empty and hidden ones as well, without ignored ones and reserved folders at the top; ``sha256`` too if
    the content is asked for (else it is not read). A file that can't be read has no hash."""
    files = tree.walk(spark, root).filter("kind = 'file'").select("path", "size", "mtime")
    return tree.hashed(files, root) if content else files


def rehashed(spark: SparkSession, root: str, index: DataFrame) -> DataFrame:
    """A listing with hashes, reading only files whose size or time differs from the index: the others
    take the hash they have there. Changed files stay a table, shared out by size, and tasks open them. One that can't be
    read keeps the row that it has in the index, or is left out if it is new there."""
    known = index.select("path", F.col("size").alias("_s"), F.col("mtime").alias("_m"), F.col("sha256").alias("_h"))
    now = cut(listing(spark, root).join(known, "path", "left"))
    same = F.coalesce((F.col("size") == F.col("_s")) & (F.col("mtime") == F.col("_m")), F.lit(False))
    kept = now.filter(same).select("path", "size", "mtime", F.col("_h").alias("sha256"))
    read = tree.hashed(now.filter(~same), root)
    got = lambda c, old: F.when(F.col("sha256").isNull(), F.col(old)).otherwise(F.col(c)).alias(c)
    return kept.unionByName(read.select("path", got("size", "_s"), got("mtime", "_m"), got("sha256", "_h")).filter("sha256 is not null"))


def present_hashes(index: DataFrame, root: str) -> DataFrame:
    """``path, sha256`` of the files that the index has as present, all read anew whatever their size and time; null where one can't be."""
    return tree.hashed(index.filter("missing_since is null").select("path", "size"), root).select("path", "sha256")


def clutter(spark: SparkSession, root: str, known_hashes: DataFrame, sidecar: str = "pack.asset.json", derived: str | None = None) -> DataFrame:
    """``path, kind, size`` of all that may go below a folder: what ``junk`` finds, and folders with nothing in them. A folder that holds but ignored files is not
    empty; ``__MACOSX`` trees are one row each, with the bytes of all they hold. Derivatives lie in a folder of their own, ``derived``."""
    found = tree.walk(spark, root, ignored=True)
    if derived is not None:
        found = found.unionByName(tree.walk(spark, derived).filter("kind = 'file'").withColumn("path", F.concat(F.lit("_derived/"), "path")))
    found = cut(found)
    files, folders = found.filter("kind = 'file'"), found.filter("kind = 'folder'")
    mac = F.regexp_extract("path", r"(?i)^((?:.*?/)?__macosx)(?:/|$)", 1)
    marked = junk(files.select("path", "size"), known_hashes, sidecar)
    whole = found.filter((mac != "") & F.col("kind").isin("file", "folder")).groupBy(mac.alias("path")).agg(F.lit("macos").alias("kind"), F.sum("size").alias("size"))
    empty = folders.filter((F.col("entries") == 0) & (mac == "")).select("path", F.lit("empty_folder").alias("kind"), F.lit(0).cast("long").alias("size"))
    return marked.filter("kind <> 'macos'").unionByName(whole).unionByName(empty)


def packs(files: DataFrame, sidecar: str = "pack.asset.json") -> DataFrame:
    """``pack`` folders: those with a sidecar file, with an asset of their own, or mostly of format folders;
    a pack within a pack belongs to the outer one."""
    name, folder = paths.base_name(F.col("path")), paths.parent_dir(F.col("path"))
    own = files.groupBy(folder.alias("dir")).agg(F.max(name == sidecar).alias("marked"), F.max(paths.is_asset(name)).alias("assets"))
    dirs = files.select(F.explode(paths.ancestors(F.col("path"))).alias("dir")).filter("dir <> ''").distinct()
    sub = dirs.groupBy(paths.parent_dir(F.col("dir")).alias("dir")).agg((2 * F.count_if(paths.is_format_folder(paths.base_name(F.col("dir")))) > F.count(F.lit(1))).alias("formats"))
    all_ = dirs.join(own, "dir", "left").join(sub, "dir", "left").filter("coalesce(marked, false) or coalesce(assets, false) or coalesce(formats, false)").select("dir")
    above = all_.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("dir", "/"))), lambda n: F.array_join(F.slice(F.split("dir", "/"), 1, n), "/"))).alias("up"))
    return above.join(all_.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.min_by("up", F.length("up")).alias("pack")).select("pack").distinct()


def sidecars(spark: SparkSession, root: str, name: str = "pack.asset.json") -> DataFrame:
    """``pack`` and the fields of each sidecar file."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
    rows = found.select(paths.parent_dir(F.col("path")).alias("pack"), F.from_json(F.decode("content", "utf-8"), SIDECAR).alias("s"))
    return rows.select("pack", "s.*")


def imported(stored: DataFrame, files: DataFrame) -> DataFrame:
    """Packs after sidecars are read: a sidecar counts where the pack has no metadata, or where it is newer."""
    s = files.select(F.col("pack"), *(F.col(c).alias(f"_{c}") for c in ("source_url", "author", "license", "notes", "updated_at")))
    both = stored.join(s, "pack", "left")
    take = F.col("_updated_at").isNotNull() & (~F.col("has_metadata") | (F.col("_updated_at") > F.col("updated_at")))
    pick = [F.when(take, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("source_url", "author", "license", "notes", "updated_at")]
    return both.select("pack", *pick, take.alias("imported"))


def sidecar_text(packs_: DataFrame, pack_tags: DataFrame) -> DataFrame:
    """``pack, json`` to be written: metadata with the tags set by hand."""
    tags = pack_tags.filter("source = 'manual'").groupBy("pack").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    both = packs_.join(tags, "pack", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return both.select("pack", F.to_json(F.struct("name", "source_url", "author", "license", "tags", "notes", "updated_at")).alias("json"))


def publish(table: DataFrame, folder: str) -> str:
    """Write a new version of a table beside the old ones; readers of ``latest`` see it once it is complete,
    as Spark marks a finished write."""
    version = f"{folder.rstrip('/')}/v-{uuid.uuid4().hex}"
    table.write.mode("errorifexists").parquet(version)
    return version


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest complete version that ``publish`` wrote."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    marks = [s for s in fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/v-*/_SUCCESS")) or []]
    newest = max(marks, key=lambda s: (s.getModificationTime(), s.getPath().toString()))
    return spark.read.parquet(newest.getPath().getParent().toString())


def junk(files: DataFrame, known_hashes: DataFrame, sidecar: str = "pack.asset.json") -> DataFrame:
    """``path, kind, size`` of what may go: system leftovers, empty files, and derivatives (a folder named
    by a hash below ``_derived``) of contents that are no longer known."""
    name = paths.base_name(F.col("path"))
    digest = F.regexp_extract("path", r"(?:^|/)_derived/([0-9a-f]{64})/", 1)
    kind = (
        F.when(F.lower("path").rlike("(^|/)__macosx/"), "macos").when(F.lower(name).rlike(r"^(\.ds_store|thumbs\.db|desktop\.ini|\._.*)$"), "system")
        .when((F.col("size") == 0) & (name != sidecar), "empty").when((digest != "") & F.col("_known").isNull(), "orphan")
    )
    marked = files.withColumn("_h", digest).join(known_hashes.select(F.col("sha256").alias("_h"), F.lit(True).alias("_known")).distinct(), "_h", "left")
    return marked.withColumn("kind", kind).filter("kind is not null").select("path", "kind", "size")


def marked_folders(files: DataFrame, sidecar: str = "pack.asset.json") -> DataFrame:
    """``dir``: every folder above a sidecar file."""
    return files.filter(paths.base_name(F.col("path")) == sidecar).select(F.explode(paths.ancestors(F.col("path"))).alias("dir")).filter("dir <> ''").distinct()


def write_report(report: DataFrame, folder: str) -> None:
    """A report as JSON lines; a finished write replaces the one before."""
    report.write.mode("overwrite").json(folder)


def read_report(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(folder)


def empty_folders(folders: DataFrame, files: DataFrame) -> DataFrame:
    """``path, kind, size`` of folders (``dir``) with neither a file nor a folder in them; reserved ones at the top are left alone."""
    used = files.select(paths.parent_dir(F.col("path")).alias("dir")).union(folders.select(paths.parent_dir(F.col("dir")))).distinct()
    left = folders.filter((F.col("dir") != "") & ~paths.is_reserved(F.concat("dir", F.lit("/x")))).join(used, "dir", "left_anti")
    return left.select(F.col("dir").alias("path"), F.lit("empty_folder").alias("kind"), F.lit(0).cast("long").alias("size"))
