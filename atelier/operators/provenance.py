"""Licences, credits and the projects that use assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Spdx, name, commercial use, attribution, share alike.
LICENCES = [
    ("CC0-1.0", "Creative Commons Zero v1.0 Universal", True, False, False),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0", True, True, False),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0", True, True, True),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0", False, True, False),
    ("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0", False, True, True),
    ("OGA-BY-3.0", "OpenGameArt Attribution 3.0", True, True, False),
    ("MIT", "MIT License", True, True, False),
    ("Apache-2.0", "Apache License 2.0", True, True, False),
    ("GPL-3.0-only", "GNU General Public License v3.0 only", True, True, True),
    ("Unlicense", "The Unlicense", True, False, False),
    ("Proprietary", "Proprietary / all rights reserved", False, False, False),
]


def licences(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, *row) for i, row in enumerate(LICENCES)]
    return spark.createDataFrame(rows, "id int, spdx string, name string, commercial boolean, attribution boolean, share_alike boolean")


def in_order(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("commercial"), "attribution", "spdx")


def risks(packs: DataFrame, table: DataFrame) -> DataFrame:
    """Packs with the reason they need attention, '' where none does."""
    both = packs.join(table.select(F.col("id").alias("license_id"), "spdx", "commercial", "attribution"), "license_id", "left")
    reason = (
        F.when(F.coalesce("spdx", F.lit("")) == "", "no licence").when(~F.col("commercial"), "not cleared for commercial use")
        .when(F.col("attribution") & (F.trim(F.coalesce("attribution_text", F.lit(""))) == ""), "attribution required, none written").otherwise("")
    )
    return both.withColumn("reason", reason)


def summaries(packs: DataFrame, table: DataFrame, which: str = "all") -> DataFrame:
    """``needs``: provenance not complete; ``risk``: a reason for attention; ``all``."""
    found = risks(packs, table)
    keep = {"needs": F.col("provenance_state") != "complete", "risk": F.col("reason") != "", "all": F.lit(True)}[which]
    return found.filter(keep)


def credits(uses: DataFrame, packs: DataFrame, table: DataFrame) -> DataFrame:
    """Distinct lines of a project's active uses: licence (unknown last), author, pack."""
    lines = uses.filter("removed_at is null").join(packs.select(F.col("id").alias("pack_id"), F.col("name").alias("pack"), "author", "license_id"), "pack_id")
    named = lines.join(table.select(F.col("id").alias("license_id"), F.col("spdx").alias("licence")), "license_id", "left")
    return named.select("project_id", "licence", "author", "pack").distinct()


def credits_text(lines: DataFrame) -> DataFrame:
    """``project_id, text``: a list of lines under each licence, as Markdown."""
    each = lines.withColumn("line", F.concat(F.lit("- "), F.col("pack"), F.when(F.coalesce("author", F.lit("")) != "", F.concat(F.lit(" by "), F.col("author"))).otherwise("")))
    one = each.groupBy("project_id", "licence").agg(F.array_join(F.array_sort(F.collect_set("line")), "\n").alias("lines"))
    part = F.struct(F.coalesce("licence", F.lit("zzz")).alias("k"), F.concat(F.lit("## "), F.coalesce("licence", F.lit("Unknown licence")), F.lit("\n"), F.col("lines")).alias("t"))
    return one.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n\n").alias("text"))


def outdated(uses: DataFrame, assets: DataFrame) -> DataFrame:
    """Active uses with whether the asset's content has changed since, and whether its file is missing. Assets are never broadcast: computed hashes take
    many times the bytes of the columns that they are made of, which are what Spark goes by."""
    now = assets.select(F.col("id").alias("asset_id"), F.col("sha256").alias("_now"), "missing_since")
    known = F.coalesce("asset_sha256", F.lit("")) != ""
    return uses.filter("removed_at is null").join(now.hint("merge"), "asset_id").select("project_id", "asset_id", (known & (F.col("asset_sha256") != F.col("_now"))).alias("outdated"), F.col("missing_since").isNotNull().alias("missing"))


def recorded_use(uses: DataFrame, new: DataFrame, assets: DataFrame, now: int) -> DataFrame:
    """Uses after new ones (project_id, asset_id, res_path, asset_sha256) are recorded: a use whose content
    differs from the asset's is moved to the first asset of that content; a removed use comes back."""
    own = assets.select(F.col("id").alias("asset_id"), F.col("sha256").alias("_own"))
    first = assets.groupBy(F.col("sha256").alias("asset_sha256")).agg(F.min("id").alias("_first"))
    found = new.join(own, "asset_id", "left").join(first, "asset_sha256", "left")
    target = F.when(F.col("_own").eqNullSafe(F.col("asset_sha256")), F.col("asset_id")).otherwise(F.coalesce("_first", "asset_id"))
    fresh = found.select("project_id", target.alias("asset_id"), "res_path", F.col("asset_sha256").alias("_sha"))
    both = uses.join(fresh, ["project_id", "asset_id", "res_path"], "full")
    return both.select(
        "project_id", "asset_id", "res_path", F.coalesce("_sha", "asset_sha256").alias("asset_sha256"),
        F.coalesce("added_at", F.lit(now)).alias("added_at"), F.when(F.col("_sha").isNull(), F.col("removed_at")).alias("removed_at"),
    )


def manifest_states(manifest: DataFrame, uses: DataFrame) -> DataFrame:
    """``asset_id, state``: a project's own list of files against the recorded uses, worst first."""
    both = manifest.select("asset_id", F.col("on_disk"), F.lit(True).alias("_m")).join(uses.select("asset_id", "outdated", "missing", F.lit(True).alias("_s")), "asset_id", "full")
    state = (
        F.when(F.col("_m").isNotNull() & ~F.coalesce("on_disk", F.lit(True)), "file deleted").when(F.coalesce("missing", F.lit(False)), "missing on server")
        .when(F.coalesce("outdated", F.lit(False)), "outdated").when(F.col("_s").isNull(), "not recorded").when(F.col("_m").isNull(), "not in manifest").otherwise("")
    )
    return both.select("asset_id", state.alias("state"))


def removed(uses: DataFrame, gone: DataFrame, now: int) -> DataFrame:
    """Uses after some (project_id, asset_id) are taken out: they stay, with the time they went."""
    marks = gone.select("project_id", "asset_id").distinct().withColumn("_gone", F.lit(True))
    both = uses.join(marks, ["project_id", "asset_id"], "left")
    return both.withColumn("removed_at", F.coalesce("removed_at", F.when(F.col("_gone"), F.lit(now)))).drop("_gone")
