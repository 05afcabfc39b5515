"""Small tables kept by key: packs, saved searches, the audit log, health, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def upserted(stored: DataFrame, new: DataFrame, key: str, at: str, now: int) -> DataFrame:
    """Rows of ``new`` replace those of the same key; others stay. ``at`` is the time of the last change: a row
    that brings nothing new keeps its own. The last of equal keys in ``new`` wins by its other columns' order."""
    values = [c for c in stored.columns if c not in (key, at)]
    fresh = new.groupBy(key).agg(F.max(F.struct(*values)).alias("_n"))
    both = stored.withColumn("_o", F.struct(*values)).select(key, at, "_o").join(fresh, key, "full")
    same = F.col("_n").isNull() | F.col("_n").eqNullSafe(F.col("_o"))
    pick = F.coalesce("_n", "_o")
    return both.select(key, *(pick[c].alias(c) for c in values), F.when(same, F.col(at)).otherwise(F.lit(now)).alias(at))


def logged(log: DataFrame, entries: DataFrame) -> DataFrame:
    """The log with new entries; nothing in it changes."""
    return log.unionByName(entries)


def health(assets: DataFrame, jobs: DataFrame) -> DataFrame:
    """``measure, value``: files, missing files, waiting and failed jobs, last sighting."""
    a = assets.agg(F.count(F.lit(1)).alias("assets"), F.count_if(F.col("missing_since").isNotNull()).alias("missing"), F.max("first_seen_at").alias("last_seen"))
    j = jobs.agg(F.count_if(F.col("state") == "queued").alias("queued"), F.count_if(F.col("state") == "failed").alias("failed"))
    one = lambda t: t.select(F.inline(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("long").alias("value")) for c in t.columns))))
    return one(a).unionByName(one(j))


def derive_states(assets: DataFrame) -> DataFrame:
    return assets.groupBy("derive_state").agg(F.count(F.lit(1)).alias("n"))


def junk_totals(junk: DataFrame) -> DataFrame:
    """``kind, items, bytes``, the largest first."""
    return junk.groupBy("kind").agg(F.count(F.lit(1)).alias("items"), F.sum("size").alias("bytes")).orderBy(F.desc("bytes"), "kind")


def below(files: DataFrame, targets: DataFrame, path: str = "path") -> DataFrame:
    """``target, path`` of the files at or below each target path: ancestors of files meet targets on equality."""
    up = F.array_append(paths.ancestors(F.col(path)), F.col(path))
    return files.select(F.col(path).alias("_path"), F.explode(F.array_distinct(up)).alias("target")).filter("target <> ''").join(targets.select("target").distinct(), "target").select("target", F.col("_path").alias("path"))


def reclaimable(exact_bytes: DataFrame, pack_bytes: DataFrame) -> DataFrame:
    """One row: bytes that removing copies may free. Packs and files tell of the same bytes, so the larger
    of the two counts, not their sum."""
    a = exact_bytes.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("v"))
    b = pack_bytes.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("v"))
    return a.unionByName(b).agg(F.max("v").alias("bytes"))


def removal_script(plan: DataFrame) -> DataFrame:
    """``line``s of a shell script for review, one a file, in order of path; quotes in paths are escaped."""
    quoted = F.concat(F.lit("'"), F.replace("path", F.lit("'"), F.lit("'\\''")), F.lit("'"))
    return plan.filter("decision = 'remove'").select("path", F.concat(F.lit("rm -- "), quoted).alias("line"))


def tag_completions(tags: DataFrame, aliases: DataFrame, prefix: str, most: int = 20) -> DataFrame:
    """Tags that, or an alias of which, begin with the prefix in either case: at most ``most``, 50 at the highest."""
    starts = lambda c: F.lower(c).startswith(prefix.lower())
    own = tags.filter(starts("tag")).select("tag")
    other = aliases.filter(starts("alias")).select("tag")
    return own.union(other).distinct().orderBy("tag").limit(min(most if most > 0 else 20, 50))


def latest_first(saved: DataFrame, at: str = "updated_at", name: str = "name") -> DataFrame:
    """Saved rows, the last updated first, then by name."""
    return saved.orderBy(F.desc(at), name)
