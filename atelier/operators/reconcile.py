"""The stored index against a new listing of files: new, changed, moved, missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths

#: A warning is due from this share of the index missing.
WARN_SHARE = 0.2


class EmptyListing(ValueError):
    """The listing has no files but the index does: an unmounted folder rather than an empty one."""


def compared(index: DataFrame, listing: DataFrame) -> DataFrame:
    """A full outer join by path with a ``status`` for each: unchanged, reappeared, metadata_only,
    content_changed, fresh or absent. Both have path, size, mtime, sha256; the index has id, missing_since and, if it
    was written by ``snapshot``, content_changed_at."""
    at = F.col("content_changed_at") if "content_changed_at" in index.columns else F.lit(None)
    old = index.select("path", "id", "missing_since", at.cast("long").alias("content_changed_at"), *(F.col(c).alias(f"old_{c}") for c in ("size", "mtime", "sha256")))
    both = old.join(listing.select("path", "size", "mtime", "sha256").withColumn("_listed", F.lit(True)), "path", "full")
    same = (F.col("size") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime"))
    status = (
        F.when(F.col("id").isNull(), "fresh").when(F.col("_listed").isNull(), "absent")
        .when(same & F.col("missing_since").isNotNull(), "reappeared").when(same, "unchanged")
        .when(F.col("sha256") != F.col("old_sha256"), "content_changed").otherwise("metadata_only")
    )
    return both.withColumn("status", status).drop("_listed")


def moves(status: DataFrame) -> DataFrame:
    """``id, old_path, path, content_changed_at``: absent files paired one to one with fresh files of the same content, each
    in order of path."""
    # contents that only left or only came are out before any ranking
    gone = status.filter("status = 'absent' and missing_since is null").select("id", "content_changed_at", F.col("path").alias("old_path"), F.col("old_sha256").alias("sha"))
    come = status.filter("status = 'fresh'").select("path", F.col("sha256").alias("sha"))
    rank = lambda path: F.row_number().over(Window.partitionBy("sha").orderBy(path))
    left = gone.join(come.select("sha"), "sha", "left_semi").withColumn("k", rank("old_path"))
    right = come.join(gone.select("sha"), "sha", "left_semi").withColumn("k", rank("path"))
    return left.join(right, ["sha", "k"]).select("id", "old_path", "path", "content_changed_at")


def resolved(index: DataFrame, listing: DataFrame, ignored: list[str] = paths.IGNORED) -> DataFrame:
    """As ``compared``, with moves found: rows of fresh files become ``moved`` (with the id they keep) or
    ``added``, and absent files become ``gone`` (moved away), ``purged`` (their path is ignored now),
    ``missing`` or, if it was known, ``still_missing``."""
    if listing.isEmpty() and not index.isEmpty():
        raise EmptyListing("no files are listed, but the index has some")
    status = compared(index, listing)
    pairs = moves(status)
    came = pairs.select("path", F.col("id").alias("moved_id"), F.col("content_changed_at").alias("moved_changed_at"))
    left = pairs.select(F.col("old_path").alias("path")).withColumn("_left", F.lit(True))
    both = status.join(came, "path", "left").join(left, "path", "left")
    absent = (
        F.when(F.col("_left"), "gone").when(F.col("missing_since").isNotNull(), "still_missing")
        .when(paths.is_ignored(F.col("path"), ignored), "purged").otherwise("missing")
    )
    final = F.when(F.col("status") == "fresh", F.when(F.col("moved_id").isNotNull(), "moved").otherwise("added")).when(F.col("status") == "absent", absent).otherwise(F.col("status"))
    return both.withColumn("status", final).withColumns({"id": F.coalesce("id", "moved_id"), "content_changed_at": F.coalesce("content_changed_at", "moved_changed_at")}).drop("moved_id", "moved_changed_at", "_left")


def counts(found: DataFrame) -> DataFrame:
    return found.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def snapshot(found: DataFrame, now: int) -> DataFrame:
    """The next index. Missing rows stay with the time they went missing; purged rows and the old places
    of moved ones go; ``content_changed_at`` is now if the content changed, else what it was. Added rows have no id yet."""
    kept = found.filter("status not in ('gone', 'purged')")
    lost = F.col("status").isin("missing", "still_missing")
    pick = lambda c: F.when(lost, F.col(f"old_{c}")).otherwise(F.col(c)).alias(c)
    return kept.select(
        "id", "path", pick("size"), pick("mtime"), pick("sha256"),
        F.when(F.col("status") == "missing", F.lit(now)).when(F.col("status") == "still_missing", F.col("missing_since")).alias("missing_since"),
        F.when(F.col("status") == "content_changed", F.lit(now)).otherwise(F.col("content_changed_at")).cast("long").alias("content_changed_at"),
    )


def too_many_missing(found: DataFrame) -> bool:
    row = found.agg(F.count_if(F.col("status") == "missing").alias("m"), F.count_if(~F.col("status").isin("added", "moved")).alias("n")).first()
    return bool(row["n"]) and row["m"] >= WARN_SHARE * row["n"]


def verify(index: DataFrame, hashes: DataFrame) -> DataFrame:
    """``checked, mismatched, absent`` of the present files against fresh hashes (path, sha256)."""
    both = index.filter("missing_since is null").join(hashes.select("path", F.col("sha256").alias("_now")), "path", "left")
    return both.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("_now") != F.col("sha256")).alias("mismatched"), F.count_if(F.col("_now").isNull()).alias("absent"))


def rebuilt(listing: DataFrame, packs: DataFrame) -> DataFrame:
    """Assets from a listing alone: ``id`` (a hash of the path), pack, relative path, name, extension, kind and group of
    each indexable file below a pack (``pack`` paths; the outermost that holds it)."""
    name = paths.base_name(F.col("path"))
    files = listing.filter(paths.is_asset(name) & ~paths.is_ignored(F.col("path")) & ~paths.is_reserved(F.col("path")))
    above = files.select("path", F.explode(paths.ancestors(F.col("path"))).alias("pack")).join(packs.select("pack").distinct(), "pack")
    owner = above.groupBy("path").agg(F.min_by("pack", F.length("pack")).alias("pack"))
    rows = files.join(owner, "path").withColumn("rel_path", F.expr("substr(path, length(pack) + 2)"))
    ext = paths.ext(F.col("path"))
    return rows.select(F.xxhash64("path").alias("id"), "pack", "rel_path", name.alias("filename"), ext.alias("ext"), paths.kind(ext).alias("kind"), "size", "mtime", paths.group_key(F.col("rel_path")).alias("group_key"))
