"""Orders, pages and neighbours of lists of assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_PAGE, LARGEST_PAGE = 100, 500


def orders() -> dict[str, list[Column]]:
    """Nine orders; each ends in a unique key."""
    c, none = F.col, F.lit(0)
    return {
        "added": [c("first_seen_at").desc(), c("id").desc()],
        "modified": [c("mtime").desc(), c("id").desc()],
        "name": [c("filename").asc(), c("id").asc()],
        "name-desc": [c("filename").desc(), c("id").desc()],
        "size": [c("size").desc(), c("id").asc()],
        "kind": [c("kind").asc(), c("filename").asc(), c("id").asc()],
        "pixels": [(F.coalesce("width", none) * F.coalesce("height", none)).desc(), c("id").asc()],
        "tris": [c("tri_count").asc_nulls_last(), c("id").asc()],
        "tris-desc": [F.coalesce("tri_count", none).desc(), c("id").asc()],
    }


def page_size(limit: int | None) -> int:
    return DEFAULT_PAGE if not limit or limit <= 0 else min(limit, LARGEST_PAGE)


def page(assets: DataFrame, order: str = "added", number: int = 1, limit: int | None = None) -> DataFrame:
    n = page_size(limit)
    return assets.orderBy(*orders()[order]).offset((max(1, number) - 1) * n).limit(n)


def after(assets: DataFrame, filename: str, id_: int, limit: int | None = None) -> DataFrame:
    """The next page by name, and one row more, which tells whether there is another."""
    later = (F.col("filename") > filename) | ((F.col("filename") == filename) & (F.col("id") > id_))
    return assets.filter(later).orderBy("filename", "id").limit(page_size(limit) + 1)


def neighbours(assets: DataFrame, filename: str, id_: int) -> tuple[DataFrame, DataFrame]:
    """The rows just before and just after a place in the order by name."""
    name, key = F.col("filename"), F.col("id")
    before = (name < filename) | ((name == filename) & (key < id_))
    later = (name > filename) | ((name == filename) & (key > id_))
    return assets.filter(before).orderBy(name.desc(), key.desc()).limit(1), assets.filter(later).orderBy(name, key).limit(1)


def all_neighbours(assets: DataFrame, within: list[str]) -> DataFrame:
    """``id, prev, next`` of every row, by name within each value of ``within``."""
    line = Window.partitionBy(*within).orderBy("filename", "id")
    return assets.select("id", F.lag("id").over(line).alias("prev"), F.lead("id").over(line).alias("next"))


def page_numbers(current: int, pages: int) -> list[int | None]:
    """Up to nine numbers in full; else the first, the last and those around, None for gaps."""
    if pages <= 9:
        return list(range(1, pages + 1))
    shown = sorted({1, pages, *(p for p in (current - 1, current, current + 1) if 1 <= p <= pages)})
    out: list[int | None] = []
    for p in shown:
        if out and p - (out[-1] or 0) > 1:
            out.append(None)
        out.append(p)
    return out


def stats(assets: DataFrame) -> DataFrame:
    return assets.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(F.coalesce("has_alpha", F.lit(False))).alias("with_alpha"),
        F.count_if(F.col("missing_since").isNotNull()).alias("missing"), F.count_distinct("pack_id").alias("packs"),
    )


def kinds(assets: DataFrame) -> DataFrame:
    return assets.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def hidden(assets: DataFrame, asset_tags: DataFrame, tag: str = "disable:true") -> DataFrame:
    """``disabled``: how many present files carry the tag that hides them."""
    off = asset_tags.filter(F.col("tag") == tag).select(F.col("asset_id").alias("id"))
    return assets.filter("missing_since is null").join(off, "id", "left_semi").agg(F.count(F.lit(1)).alias("disabled"))


def groups_after(groups: DataFrame, filename: str, primary_id: int, limit: int | None = None) -> DataFrame:
    """The next page of groups by the name of what shows them (``groups`` as from ``groups.primaries``), and one row more."""
    later = (F.col("filename") > filename) | ((F.col("filename") == filename) & (F.col("primary_id") > primary_id))
    return groups.filter(later).orderBy("filename", "primary_id").limit(page_size(limit) + 1)
