"""Search conditions as functions from assets to the assets that meet them.

A condition is made by one of the functions below; ``&``, ``|`` and ``~`` combine them.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fulltext

#: Shares below which a swatch is no part of an asset's look, and tolerances unless given.
LEAST_RATIO, COLOUR_TOLERANCE, NEAR_TOLERANCE, NEAR_SWATCHES = 0.005, 12, 24, 6
_serial = itertools.count()


@dataclass
class Where:
    """Conditions that must all hold: column expressions, sets of ids that a row must be in or must not be in,
    and mixed expressions over flags that sets of ids give (``mixed`` with ``flags``)."""

    columns: list[Column] = field(default_factory=list)
    within: list[DataFrame] = field(default_factory=list)
    without: list[DataFrame] = field(default_factory=list)
    mixed: list[Column] = field(default_factory=list)
    flags: dict[str, DataFrame] = field(default_factory=dict)

    def _one(self) -> tuple[Column, dict[str, DataFrame]]:
        """All as one expression over the row and flags."""
        flags, parts = dict(self.flags), [*self.columns, *self.mixed]
        for sets, inside in ((self.within, True), (self.without, False)):
            for ids in sets:
                flags[name := f"_flag{next(_serial)}"] = ids
                held = F.coalesce(F.col(name), F.lit(False))
                parts.append(held if inside else ~held)
        out = F.lit(True)
        for part in parts:
            out = out & part
        return out, flags

    def __invert__(self) -> "Where":
        kinds = (self.columns, self.within, self.without, self.mixed)
        if sum(map(len, kinds)) == 1 and not self.mixed:
            return Where([~c for c in self.columns], self.without, self.within)
        column, flags = self._one()
        return Where(mixed=[~column], flags=flags) if flags else Where([~column])

    def __and__(self, other: "Where") -> "Where":
        return Where(self.columns + other.columns, self.within + other.within, self.without + other.without, self.mixed + other.mixed, self.flags | other.flags)

    def __or__(self, other: "Where") -> "Where":
        (a, x), (b, y) = self._one(), other._one()
        return Where(mixed=[a | b], flags=x | y) if x or y else Where([a | b])


def matching(assets: DataFrame, where: Where, key: str = "id") -> DataFrame:
    """The assets that meet the condition. Columns are filtered first (Spark pushes that into the scan), sets of
    ids are semi- and anti-joins, and only what mixes both under "or" or "not" joins flags on."""
    out = assets
    for column in where.columns:
        out = out.filter(column)
    for sets, how in ((where.within, "left_semi"), (where.without, "left_anti")):
        for ids in sets:
            marks = ids.select(F.col(ids.columns[0]).alias("_id"))
            out = out.join(marks, out[key] == marks["_id"], how)
    for flag, ids in where.flags.items():
        marks = ids.select(F.col(ids.columns[0]).alias("_id")).filter("_id is not null").distinct().withColumn(flag, F.lit(True))
        out = out.join(marks, out[key] == marks["_id"], "left").drop("_id")
    for column in where.mixed:
        out = out.filter(column)
    return out.select(*assets.columns)


def _in(ids: DataFrame) -> Where:
    return Where(within=[ids])


def always() -> Where:
    return Where([F.lit(True)])


def never() -> Where:
    return Where([F.lit(False)])


def word(columns: list[str], text: str) -> Where:
    """The last word may be the start of one."""
    return Where([fulltext.phrase([F.col(c) for c in columns], text, prefix=True)])


def quoted(columns: list[str], text: str) -> Where:
    return Where([fulltext.phrase([F.col(c) for c in columns], text)])


def compare(column: str, op: str, value: float) -> Where:
    """An unknown value meets no comparison, and no negated one either."""
    left = F.col(column)
    return Where([{"<": left < value, "<=": left <= value, ">": left > value, ">=": left >= value, "=": left == value}[op]])


def size(width: int, height: int) -> Where:
    return Where([(F.col("width") == width) & (F.col("height") == height)])


def kind(name: str) -> Where:
    return Where([F.col("kind") == name])


def has(column: str) -> Where:
    """A flag that may be unknown; unknown counts as no, also under negation."""
    return Where([F.coalesce(F.col(column), F.lit(False))])


def animated() -> Where:
    return Where([F.coalesce(F.col("frame_count"), F.lit(0)) > 1])


def provenance(packs: DataFrame, assets: DataFrame) -> Where:
    whole = packs.filter("provenance_state = 'complete'").select(F.col("id").alias("pack_id"))
    return _in(assets.join(whole, "pack_id", "left_semi").select("id"))


def in_folder(folder: str, path: str = "library_path") -> Where:
    """A folder that climbs or names nothing filters nothing."""
    clean = "/".join(p for p in folder.strip("/").split("/") if p)
    if not clean or any(p in {".", ".."} for p in clean.split("/")):
        return always()
    return Where([(F.col(path) == clean) | F.col(path).startswith(clean + "/")])


def tagged(tag: str, assets: DataFrame, asset_tags: DataFrame, pack_tags: DataFrame) -> Where:
    """The tag (of two parts at least) or one below it, on the asset or on its pack. A tag's name begins with those
    above it, so the condition is a filter that reaches the scan."""
    below = ((F.col("tag") == tag) | F.col("tag").startswith(f"{tag}:")) & F.lit(":" in tag)
    direct = asset_tags.filter(below).select("asset_id")
    packs = pack_tags.filter(below).select("pack_id").distinct()
    return _in(direct.union(assets.join(packs, "pack_id", "left_semi").select("id")))


def _box(r: int, g: int, b: int, tolerance: int) -> Column:
    near = lambda c, v: F.col(c).between(max(0, v - tolerance), min(255, v + tolerance))
    return near("r", r) & near("g", g) & near("b", b)


def colour(swatches: DataFrame, hexcode: str, tolerance: int = COLOUR_TOLERANCE) -> Where:
    """Some swatch of enough share lies in a box around the colour."""
    digits = hexcode.lstrip("#")
    digits = "".join(2 * c for c in digits) if len(digits) == 3 else digits
    r, g, b = (int(digits[i : i + 2], 16) for i in (0, 2, 4))
    return _in(swatches.filter((F.col("ratio") >= LEAST_RATIO) & _box(r, g, b, tolerance)).select("asset_id"))


def palette_near(swatches: DataFrame, asset_id: int, tolerance: int = NEAR_TOLERANCE) -> Where:
    """Assets that hold more than half of the reference's main colours. Each swatch counts for the
    first colour it is near to."""
    main = swatches.filter((F.col("asset_id") == asset_id) & (F.col("ratio") >= LEAST_RATIO)).orderBy("rank").limit(NEAR_SWATCHES).select("r", "g", "b").collect()
    if not main:
        return never()
    first = F.when(F.lit(False), 0)
    for i, row in enumerate(main):
        first = first.when(_box(*row, tolerance), i)
    near = swatches.filter(F.col("ratio") >= LEAST_RATIO).groupBy("asset_id").agg(F.count_distinct(first).alias("n"))
    return _in(near.filter(F.col("n") >= len(main) // 2 + 1).select("asset_id"))


def present() -> Where:
    return Where([F.col("missing_since").isNull()])


def enabled(asset_tags: DataFrame, tag: str = "disable:true") -> Where:
    """Without the tag itself; its pack's tags don't count."""
    return ~_in(asset_tags.filter(F.col("tag") == tag).select("asset_id"))


#: Extensions that can be edited again.
EDITABLE = ["psd", "aseprite", "ase", "kra", "xcf", "blend", "svg"]


def source_file(assets: DataFrame) -> Where:
    """Assets of whose variants one is an editable format. An extension to the search."""
    from ..functions import paths

    key = ["pack_id", paths.group_key(F.col("rel_path")).alias("group_key")]
    groups = assets.filter(F.col("ext").isin(EDITABLE)).select(*key).distinct()
    return _in(assets.select("id", *key).join(groups, ["pack_id", "group_key"], "left_semi").select("id"))


def fuzzy(column: str, text: str, distance: int = 2) -> Where:
    """Some word of the column is within an edit distance of the word. An extension to the search."""
    found = fulltext.words(text)
    if not found:
        return always()
    near = F.exists(F.split(F.trim(fulltext.normalised(F.col(column))), " "), lambda w: F.levenshtein(w, F.lit(found[-1])) <= distance)
    return Where([near])
