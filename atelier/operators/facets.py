"""Counts beside a list: tags, folders, colours, completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, values

FACETS, MOST_FACETS, SUGGESTED = 40, 200, 6


def asset_tag_pairs(assets: DataFrame, asset_tags: DataFrame, pack_tags: DataFrame) -> DataFrame:
    """``asset_id, tag``: its own tags and its pack's, each once."""
    own = assets.join(asset_tags, assets["id"] == asset_tags["asset_id"]).select("asset_id", "tag")
    packs = assets.select(F.col("id").alias("asset_id"), "pack_id").join(pack_tags, "pack_id").select("asset_id", "tag")
    return own.union(packs).distinct()


def tag_facets(assets: DataFrame, asset_tags: DataFrame, pack_tags: DataFrame, limit: int = FACETS) -> DataFrame:
    n = limit if 0 < limit <= MOST_FACETS else FACETS
    counts = asset_tag_pairs(assets, asset_tags, pack_tags).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "tag").limit(n).withColumn("namespace", F.substring_index("tag", ":", 1))


def tree(files: DataFrame, path: str, most: int) -> DataFrame:
    """``dir, assets, direct``: files at or below each folder, and those that are in it; files deeper than
    ``most`` levels count as direct in the folder at the limit."""
    spread = files.select(F.explode(F.transform(paths.ancestors(F.col(path), most), lambda d: F.struct(d.alias("dir"), (d == F.element_at(paths.ancestors(F.col(path), most), -1)).alias("own")))).alias("x"))
    return spread.groupBy(F.col("x.dir").alias("dir")).agg(F.count(F.lit(1)).alias("assets"), F.count_if("x.own").alias("direct"))


def visible(folders: DataFrame, selected: str) -> DataFrame:
    """Rows of a tree that show when a folder is open: the open folders and their children."""
    parts = selected.split("/") if selected else []
    open_ = ["", *("/".join(parts[: i + 1]) for i in range(len(parts)))]
    return folders.filter((F.col("dir") == "") | paths.parent_dir(F.col("dir")).isin(open_))


#: Channels are bucketed by this; swatches of lower share are left out of the library's colours.
BUCKET, LEAST_SHARE = 24, 0.02


def colour_buckets(swatches: DataFrame) -> DataFrame:
    """``r, g, b, weight, assets``: mean colour by share of each bucket of like colours."""
    cell = [F.floor(F.col(c) / BUCKET).alias(f"_{c}") for c in "rgb"]
    mean = [F.round(F.sum(F.col(c) * F.col("ratio")) / F.sum("ratio")).cast("int").alias(c) for c in "rgb"]
    rows = swatches.filter(F.col("ratio") >= LEAST_SHARE).groupBy(*cell).agg(*mean, F.round(F.sum("ratio"), 6).alias("weight"), F.count_distinct("asset_id").alias("assets"))
    return rows.select("r", "g", "b", "weight", "assets", F.col("_r").cast("int").alias("br"), F.col("_g").cast("int").alias("bg"), F.col("_b").cast("int").alias("bb"))


def spread_hues(colours: DataFrame, most: int) -> DataFrame:
    """The heaviest colour of each hue family, then the second of each, up to ``most``. The input is a
    list of buckets, of which there are some thousand at most."""
    family = values.hue_family(F.col("r"), F.col("g"), F.col("b"))
    turn = F.row_number().over(Window.partitionBy("family").orderBy(F.desc("weight"), "r", "g", "b", "br", "bg", "bb"))
    return colours.withColumn("family", family).withColumn("rn", turn).orderBy("rn", F.desc("weight"), "family", "r", "g", "b", "br", "bg", "bb").limit(most)


def completions(named: list[tuple[str, DataFrame, Column]], prefix: str, most: int = SUGGESTED) -> DataFrame:
    """``grp, value, n``: of each named frame the ``most`` frequent values that begin with the prefix,
    in either case. A prefix with a colon or a blank completes nothing."""
    out = None
    for name, frame, value in named:
        rows = frame.select(value.alias("value")).filter(F.lower("value").startswith(prefix.lower()) if prefix.strip() and ":" not in prefix else F.lit(False))
        top = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(most).select(F.lit(name).alias("grp"), "value", "n")
        out = top if out is None else out.unionByName(top)
    return out


def last_token(query: str) -> str:
    """What a completion would complete: nothing after a blank or within open quotes."""
    if not query or query[-1].isspace() or query.count('"') % 2:
        return ""
    return query.split()[-1]


#: What a search can be completed with, the most useful first, and what is shown for it where that differs.
KEYWORDS = [
    ("type:", "type:"), ("style:pixel-art", "style:pixel-art"), ("has:alpha", "has:alpha"), ("has:animation", "has:animation"), ("has:source-file", "has:source-file"),
    ("dim:32x32", "32x32"), ("width:>=64", "width:>=64"), ("colors:<=16", "colors:<=16"), ("frames:>1", "frames:>1"), ("tris:<5000", "tris:<5000"), ("materials:>1", "materials:>1"),
    ("duration:<2000", "duration:<2000"), ("color:#8b3a3a", "color:#8b3a3a"), ("added:>2026-01", "added:>2026-01"), ("license:cc0", "license:cc0"),
]


def suggestions(assets: DataFrame, asset_tags: DataFrame, packs: DataFrame, query: str, most: int = SUGGESTED) -> DataFrame:
    """``grp, value, n, place`` for the last token of a query, at most ``most`` of each group: keywords in their order, tags
    by how many assets have them, packs by their present files, and names of present files, the shortest first (n is
    null for these and for keywords). A token with a colon names a field and gets keywords only; no token, nothing."""
    token = last_token(query).lower()
    words = [k for k, shown in KEYWORDS if token and (k.lower().startswith(token) or shown.lower().startswith(token))][:most]
    schema = "grp string, value string, n bigint, place int"
    out = assets.sparkSession.createDataFrame([("keyword", k, None, i) for i, k in enumerate(words)], schema)
    if not token or ":" in token:
        return out
    present, starts = assets.filter("missing_since is null"), lambda c: F.lower(c).startswith(token)
    tags = asset_tags.filter(starts(F.col("tag")) | starts(F.expr("substr(tag, instr(tag, ':') + 1)"))).groupBy(F.col("tag").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    held = present.groupBy("pack_id").agg(F.count(F.lit(1)).alias("n"))
    named = packs.filter(starts(F.col("name"))).select(F.col("id").alias("pack_id"), F.col("name").alias("value"))
    filled = named.join(held, "pack_id", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))
    files = present.filter(starts(F.col("filename"))).select(F.col("filename").alias("value")).distinct().withColumn("n", F.lit(None).cast("long"))
    for name, rows, order in (("tag", tags, [F.desc("n"), "value"]), ("pack", filled, [F.desc("n"), "value"]), ("filename", files, [F.length("value"), "value"])):
        top = rows.orderBy(*order).limit(most)
        out = out.unionByName(top.select(F.lit(name).alias("grp"), "value", "n", (F.row_number().over(Window.orderBy(*order)) - 1).alias("place")))
    return out
