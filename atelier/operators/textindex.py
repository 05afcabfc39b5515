"""A positional inverted index of text columns, kept up from changes.

Postings are rows of a token, the row's id, the field and the place of the word in it, kept in order of token and dealt into folders by
the token's first letter: a word reads its letter's folder and the row groups whose range of tokens holds it, a prefix a range of tokens. A phrase
is a join of its words on id, field and place. Three tables change as one (``versions``): ``postings``, ``fresh`` (those of rows that changed since) and
``stale`` (ids whose postings no longer count); a change writes the last two only, ``compact`` makes one of all.

Words are those of ``functions.fulltext``, so the index finds what a scan finds. Null texts have no words; a query without words constrains nothing. A token of very many
rows is spread over files by id. Ids must be unique.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fulltext
from ..sources import versions
from .scratch import cut
from .search import Where, always

LAYOUT = {"postings": ["initial"], "fresh": ["initial"]}


def _initial(word: str) -> str:
    return word[0].encode().hex()


def postings(table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``id, field, place, token, initial``: a row for each word, numbered from 0 within its column."""
    words = lambda c: F.filter(F.split(F.trim(fulltext.normalised(F.col(f"`{c}`"))), " "), lambda w: w != "")
    out = None
    for field, column in enumerate(columns):
        rows = table.select(F.col(key).alias("id"), F.lit(field).alias("field"), F.posexplode(words(column)).alias("place", "token"))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("initial", F.lower(F.hex(F.encode(F.substring("token", 1, 1), "utf-8"))))


def _ordered(rows: DataFrame) -> DataFrame:
    """In order of token and id, so that files and row groups hold ranges; a token of many rows takes several. Spark goes through the rows twice, first to find the
    ranges, so they should be read, not made: words are split once, then written."""
    return rows.repartitionByRange("initial", "token", "id").sortWithinPartitions("initial", "token", "id", "field", "place")


@dataclass
class TextIndex:
    """One version of the index."""

    base: DataFrame
    fresh: DataFrame
    stale: DataFrame

    def holding(self, text: str, prefix: bool = False) -> DataFrame | None:
        """``id`` of the rows that hold the words of ``text`` side by side in one column, the last the start of a word if so asked; None if it has no words."""
        words = fulltext.words(text)
        found = None
        for k, word in enumerate(words):
            token = F.col("token").startswith(word) if prefix and k == len(words) - 1 else F.col("token") == word
            at = self._read(token & (F.col("initial") == _initial(word))).select("id", "field", (F.col("place") - k).alias("place"))
            found = at if found is None else found.join(at, ["id", "field", "place"], "left_semi")
        return None if found is None else found.select("id").distinct()

    def _read(self, which: Column) -> DataFrame:
        return self.base.filter(which).join(self.stale, "id", "left_anti").unionByName(self.fresh.filter(which))

    def condition(self, text: str, prefix: bool = False) -> Where:
        """For ``search.matching``, alone or with other conditions."""
        ids = self.holding(text, prefix)
        return always() if ids is None else Where(within=[ids])


def build(spark: SparkSession, root: str, table: DataFrame, key: str, columns: list[str]) -> versions.Snapshot:
    """A new index, or one that replaces what is there."""
    rows = _ordered(cut(postings(table, key, columns)))
    return versions.commit(versions.snapshot(spark, root), {"postings": rows, "fresh": rows.limit(0), "stale": rows.select("id").limit(0)}, layout=LAYOUT)


def opened(at: versions.Snapshot) -> TextIndex:
    return TextIndex(at.table("postings"), at.table("fresh"), at.table("stale"))


def refresh(spark: SparkSession, root: str, changed: DataFrame, gone: DataFrame, key: str, columns: list[str]) -> versions.Snapshot:
    """After rows were added or changed (``changed`` has them as they are now) or went (``gone``, by ``key``)."""
    touched = changed.select(F.col(key).alias("id")).union(gone.select(F.col(key))).distinct()

    def made(base: versions.Snapshot) -> dict[str, DataFrame]:
        now = opened(base)
        fresh = now.fresh.join(touched, "id", "left_anti").unionByName(cut(postings(changed, key, columns)))
        return {"fresh": _ordered(fresh), "stale": now.stale.union(touched).distinct()}

    return versions.update(spark, root, made, layout=LAYOUT)


def compact(spark: SparkSession, root: str) -> versions.Snapshot:
    """The same index with all postings in one table."""

    def made(base: versions.Snapshot) -> dict[str, DataFrame]:
        now = opened(base)
        return {"postings": _ordered(cut(now.base.join(now.stale, "id", "left_anti").unionByName(now.fresh))), "fresh": now.fresh.limit(0), "stale": now.stale.limit(0)}

    return versions.update(spark, root, made, layout=LAYOUT)
