"""Plans of removal: files and folders to be trashed or linked, each with a decision and its reason.

Nothing is removed here. A target is checked by itself first: where it lies, what it is, who uses what is in it, and for links, whether the
copy to keep has the same content. Then the selection is checked as a whole: no content may lose its last copy. Of the targets
that would take the last copies of a content the first in order of root and path is refused; its files then stay, and what is left is judged anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .records import below
from .scratch import cut

ROOTS, ACTIONS, LIBRARY = ("library", "data"), ("trash", "link"), "library"
KEY = ["root", "path", "action"]


def _tidy(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.replace(c, F.lit("\\"), F.lit("/"))), "^/+|/+$", "")


def normalised(targets: DataFrame) -> DataFrame:
    """``root, path, action, keep_path`` of each target once: slashes made one way, the library and the trash where nothing is said."""
    blank = lambda c, other: F.when(F.coalesce(F.trim(c), F.lit("")) == "", other).otherwise(F.trim(c))
    rows = targets.select(blank(F.col("root"), LIBRARY).alias("root"), _tidy(F.coalesce("path", F.lit(""))).alias("path"), blank(F.col("action"), "trash").alias("action"), _tidy(F.coalesce("keep_path", F.lit(""))).alias("keep_path"))
    return rows.groupBy(*KEY).agg(F.min("keep_path").alias("keep_path"))


def last_copies(covered: DataFrame, copies: DataFrame) -> DataFrame:
    """``t`` of the targets that are refused lest a content lose its last copy. ``covered`` has t (targets in their order), sha256 and n, the copies that
    target takes; ``copies`` sha256 and n, all there are.

    Contents that keep a copy whatever happens bind nothing and go first. Of the rest, a target that is the first of all
    its contents is refused, whatever later ones do; its copies come back, and contents that have one now are done. Each round decides all such
    targets at once; there is always one. Targets left without such a content are free."""
    taken = covered.groupBy("sha256").agg(F.sum("n").alias("_taken"))
    left = taken.join(copies.select("sha256", F.col("n").alias("_all")), "sha256", "left").select("sha256", (F.coalesce("_all", F.lit(0)) - F.col("_taken")).alias("stay")).filter("stay < 1")
    live, refused = cut(covered.join(left, "sha256")), []
    while not live.isEmpty():
        first = live.groupBy("sha256").agg(F.min("t").alias("_first"))
        now = cut(live.join(first, "sha256").groupBy("t").agg(F.bool_and(F.col("t") == F.col("_first")).alias("_now")).filter("_now").select("t"))
        refused.append(now)
        back = live.join(now, "t", "left_semi").groupBy("sha256").agg(F.sum("n").alias("_back"))
        rest = live.join(now, "t", "left_anti").join(back, "sha256", "left").withColumn("stay", F.col("stay") + F.coalesce("_back", F.lit(0)))
        live = cut(rest.filter("stay < 1").drop("_back"))
    out = covered.select("t").limit(0)
    for rows in refused:
        out = out.unionByName(rows)
    return out


def plan(targets: DataFrame, entries: DataFrame, assets: DataFrame, uses: DataFrame, trash: str | None = None, sidecar: str = "pack.asset.json") -> DataFrame:
    """``root, path, action, keep_path, is_folder, bytes, files, assets, decision (do, refuse), reason, remaining``; the last is how many copies of the content
    remain after all, for targets of one content.

    ``targets`` has root, path, action and keep_path; ``entries`` root, path, kind (file, folder, link or other) and size of what is there; ``assets`` id, path,
    sha256 of the indexed files that are present; ``uses`` asset_id and project. ``trash`` is the trash's place in the library."""
    wanted = cut(normalised(targets))
    at = wanted.join(entries.select("root", "path", "kind", F.col("size").alias("_size")).dropDuplicates(["root", "path"]), ["root", "path"], "left")
    # what lies at or below each target
    inner = below(entries.filter("kind = 'file'").select(F.concat_ws("/", "root", "path").alias("path"), "size").dropDuplicates(["path"]), wanted.select(F.concat_ws("/", "root", "path").alias("target")))
    sizes = inner.join(entries.filter("kind = 'file'").select(F.concat_ws("/", "root", "path").alias("path"), "size").dropDuplicates(["path"]), "path")
    sizes = sizes.groupBy("target").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("files"))
    held = cut(below(assets, wanted.filter(F.col("root") == LIBRARY).select(F.col("path").alias("target"))).join(assets.select("path", "id", "sha256"), "path"))
    used = held.join(uses.select(F.col("asset_id").alias("id"), "project"), "id").groupBy("target").agg(F.array_join(F.array_sort(F.collect_set("project")), ", ").alias("_projects"))
    counts = held.groupBy("target").agg(F.count(F.lit(1)).alias("assets"))
    own = assets.select("path", F.col("sha256").alias("_own")).dropDuplicates(["path"])
    keep = own.select(F.col("path").alias("keep_path"), F.col("_own").alias("_keep"))
    library = F.col("root") == LIBRARY
    all_ = at.withColumn("target", F.concat_ws("/", "root", "path")).join(sizes, "target", "left").withColumn("target", F.when(library, F.col("path")))
    all_ = all_.join(used, "target", "left").join(counts, "target", "left").join(own, "path", "left").join(keep, "keep_path", "left")
    path, link = F.col("path"), F.col("action") == "link"
    within = F.lit(False) if trash is None else library & ((path == trash) | path.startswith(trash.rstrip("/") + "/"))
    reason = (
        F.when(~F.col("root").isin(*ROOTS), "unknown root").when(~F.col("action").isin(*ACTIONS), "unknown action").when(path == "", "empty path").when(link & ~library, "only library files can be linked")
        .when(path.rlike(r"(^|/)\.{1,2}(/|$)"), "the path leaves its root").when(F.col("kind").isNull(), "not there").when(within, "inside the trash").when(library & paths.is_reserved(path), "a reserved folder")
        .when(library & (paths.base_name(path) == sidecar), "it holds a pack's provenance").when(F.col("kind") == "link", "links are not removed").when(F.col("kind") == "other", "not a regular file")
        .when(~link & F.col("_projects").isNotNull(), F.concat(F.lit("in use by "), "_projects"))
        .when(link & (F.col("keep_path") == ""), "linking needs the copy to keep").when(link & (F.col("keep_path") == path), "a file is not linked to itself").when(link & (F.col("kind") == "folder"), "only files can be linked")
        .when(link & F.col("_own").isNull(), "not in the index").when(link & F.col("_keep").isNull(), "the copy to keep is not in the index").when(link & (F.col("_own") != F.col("_keep")), "contents differ")
    )
    checked = cut(all_.withColumn("reason", reason).select(*KEY, "keep_path", (F.col("kind") == "folder").alias("is_folder"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("assets", F.lit(0)).alias("assets"), "reason"))
    going = checked.filter(F.col("reason").isNull() & (F.col("action") == "trash") & library).select(F.col("path").alias("target"), F.struct("root", "path").alias("t"))
    covered = cut(held.join(going, "target").groupBy("t", "sha256").agg(F.count(F.lit(1)).alias("n")))
    copies = assets.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"))
    refused = cut(last_copies(covered, copies))
    gone = covered.join(refused, "t", "left_anti")
    after = copies.join(gone.groupBy("sha256").agg(F.sum("n").alias("_gone")), "sha256").select("sha256", F.greatest(F.col("n") - F.col("_gone"), F.lit(0)).alias("remaining"))
    one = gone.groupBy("t").agg(F.count(F.lit(1)).alias("_k"), F.first("sha256").alias("sha256")).filter("_k = 1").join(after, "sha256").select("t.root", "t.path", F.lit("trash").alias("action"), "remaining")
    lost = refused.select("t.root", "t.path", F.lit("trash").alias("action"), F.lit(True).alias("_lost"))
    out = checked.join(lost, KEY, "left").join(one, KEY, "left")
    why = F.when(F.col("_lost"), "the last copy of its content").otherwise(F.col("reason"))
    return out.select(*KEY, "keep_path", "is_folder", "bytes", "files", "assets", F.when(why.isNull(), "do").otherwise("refuse").alias("decision"), why.alias("reason"), "remaining")
