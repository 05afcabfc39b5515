"""Variants of one asset, and the variant that shows it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def regroup(assets: DataFrame) -> DataFrame:
    """``pack_id, group_key, primary_id, variants``: present variants come first, then formats in their
    order of precedence, then paths. A grouped minimum, so partial results combine before the shuffle."""
    rank = F.struct(F.col("missing_since").isNotNull(), paths.precedence(F.col("ext")), F.col("rel_path"), F.col("id"))
    return assets.groupBy("pack_id", paths.group_key(F.col("rel_path")).alias("group_key")).agg(F.min_by("id", rank).alias("primary_id"), F.count(F.lit(1)).alias("variants"))


def changes(groups: DataFrame, before: DataFrame) -> DataFrame:
    """``pack_id, group_key, change``: created, emptied, updated or unchanged since the last grouping."""
    old = before.select("pack_id", "group_key", F.col("primary_id").alias("_p"), F.col("variants").alias("_v"))
    both = groups.join(old, ["pack_id", "group_key"], "full")
    same = F.col("primary_id").eqNullSafe(F.col("_p")) & (F.col("variants") == F.col("_v"))
    return both.select("pack_id", "group_key", F.when(F.col("_v").isNull(), "created").when(F.col("variants").isNull(), "emptied").when(same, "unchanged").otherwise("updated").alias("change"))


def with_any_variant(groups: DataFrame, assets: DataFrame, found: DataFrame) -> DataFrame:
    """Groups of which any variant is among ``found`` (ids), each once."""
    keys = assets.join(found.select("id"), "id", "left_semi").select("pack_id", paths.group_key(F.col("rel_path")).alias("group_key")).distinct()
    return groups.join(keys, ["pack_id", "group_key"], "left_semi")


def primaries(groups: DataFrame, assets: DataFrame, packs: DataFrame) -> DataFrame:
    """Each group with its primary and pack; groups without drop out."""
    pick = assets.select(F.col("id").alias("primary_id"), "filename", "kind")
    return groups.join(pick, "primary_id").join(packs.select(F.col("id").alias("pack_id"), F.col("name").alias("pack")), "pack_id")


def variants(assets: DataFrame, group_key: str) -> DataFrame:
    return assets.filter(paths.group_key(F.col("rel_path")) == group_key).orderBy(paths.precedence(F.col("ext")), "rel_path")
