"""Hierarchical tags: ancestors, aliases, sources and automatic tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A stronger source replaces a weaker one.
STRENGTH = {"manual": 3, "auto_path": 2, "auto_type": 2, "inherited": 1}


def closure(tags: DataFrame) -> DataFrame:
    """``ancestor, descendant, depth`` of tags ``a:b:c`` and all above them, itself at depth 0. The name
    holds its ancestors (two parts at least), so no recursion is needed."""
    parts = F.split("tag", ":")
    above = lambda n: F.array_join(F.slice(F.split("tag", ":"), 1, n), ":")
    every = tags.filter(F.size(parts) >= 2).select(F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), above)).alias("tag")).distinct()
    pairs = every.select(F.col("tag").alias("descendant"), F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.struct(above(n).alias("a"), (F.size(parts) - n).alias("d")))).alias("x"))
    return pairs.select(F.col("x.a").alias("ancestor"), "descendant", F.col("x.d").cast("int").alias("depth"))


def resolve(tags: DataFrame, aliases: DataFrame) -> DataFrame:
    """``tag`` by its canonical name: aliases are replaced, other names stay."""
    known = aliases.select(F.col("alias").alias("_a"), F.col("tag").alias("_t"))
    return tags.join(known, tags["tag"] == F.col("_a"), "left").withColumn("tag", F.coalesce("_t", "tag")).drop("_a", "_t")


def strongest(marks: DataFrame) -> DataFrame:
    """One row for each asset and tag, of the strongest source (of equal ones the first by name)."""
    weight = F.when(F.lit(False), 0)
    for source, n in STRENGTH.items():
        weight = weight.when(F.col("source") == source, n)
    best = F.max_by("source", F.struct(weight, F.when(F.col("source") == "auto_path", 1).otherwise(0)))
    return marks.groupBy("asset_id", "tag").agg(best.alias("source"))


def view(asset_tags: DataFrame, assets: DataFrame, pack_tags: DataFrame) -> DataFrame:
    """``asset_id, tag, inherited``: its own tags, and those of its pack that it lacks."""
    own = asset_tags.select("asset_id", "tag").distinct()
    packs = assets.select(F.col("id").alias("asset_id"), "pack_id").join(pack_tags.select("pack_id", "tag"), "pack_id").select("asset_id", "tag").distinct()
    return own.withColumn("inherited", F.lit(False)).unionByName(packs.join(own, ["asset_id", "tag"], "left_anti").withColumn("inherited", F.lit(True)))


def retag(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """``asset_id, tag, source, change``: derived automatic tags replace the stored automatic ones; others
    stay; a manual tag is never weakened."""
    old = stored.select("asset_id", "tag", F.col("source").alias("_old"))
    new = derived.select("asset_id", "tag", F.col("source").alias("_new"))
    both = strongest_pair(old).join(strongest_pair(new, "_new"), ["asset_id", "tag"], "full")
    auto = F.col("_old").isin("auto_path", "auto_type")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull() & auto, "pruned").otherwise("kept")
    source = F.when(F.col("_old").isNull() | (auto & F.col("_new").isNotNull()), F.col("_new")).otherwise(F.col("_old"))
    return both.select("asset_id", "tag", source.alias("source"), change.alias("change"))


def strongest_pair(marks: DataFrame, source: str = "_old") -> DataFrame:
    return strongest(marks.withColumnRenamed(source, "source")).withColumnRenamed("source", source)


def search_text(asset_tags: DataFrame, assets: DataFrame, pack_tags: DataFrame, tag_closure: DataFrame, aliases: DataFrame) -> DataFrame:
    """``asset_id, tag_text``: all its tags with their ancestors and the aliases of those, sorted."""
    direct = view(asset_tags, assets, pack_tags).select("asset_id", "tag")
    above = direct.join(tag_closure.select(F.col("descendant").alias("tag"), "ancestor"), "tag").select("asset_id", F.col("ancestor").alias("tag")).distinct()
    names = above.select("asset_id", F.col("tag").alias("name")).union(above.join(aliases, "tag").select("asset_id", F.col("alias").alias("name")))
    return names.groupBy("asset_id").agg(F.array_join(F.array_sort(F.collect_set("name")), " ").alias("tag_text"))


def bulk_add(stored: DataFrame, found: DataFrame, tag: str) -> DataFrame:
    """The tag by hand on all found assets."""
    more = found.select(F.col("id").alias("asset_id"), F.lit(tag).alias("tag"), F.lit("manual").alias("source"))
    return strongest(stored.select("asset_id", "tag", "source").unionByName(more))
