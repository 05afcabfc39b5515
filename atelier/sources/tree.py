"""Folder trees as a table, and files hashed where they are read.

``spark.read.format("asset_tree").option("root", uri)`` lists a tree in tasks. The planner lists folders from
the top, level by level, until there are enough subtrees to share out; each task then walks its own. Folders that
are not wanted are never entered: ignored names, reserved ones at the top, links, and, where the query
filters ``path`` by a prefix, everything beside it. Listings and contents are read by file system URI
(``file``, ``hdfs``, ``s3``, ``gs``), so nothing but the tree itself is shared between tasks.
"""

from __future__ import annotations

import hashlib
import os
import re
import stat
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition, StringStartsWith

from ..functions import paths

ENTRY = "path string, kind string, size bigint, mtime bigint, entries int, error string"
ARROW = pa.schema([("path", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("mtime", pa.int64()), ("entries", pa.int32()), ("error", pa.string())])
#: Subtrees that a plan looks for, and folders that it lists at most in doing so; bytes read at a time; bytes and files that a hashing task should have.
SUBTREES, PLANNED, CHUNK, TASK_BYTES, TASK_FILES = 256, 4096, 4 << 20, 1 << 30, 20_000
BATCH = 8192


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI, and the path in it."""
    if "://" not in root:
        return pafs.LocalFileSystem(), (unquote(urlparse(root).path) if root.startswith("file:") else root).rstrip("/")
    if root.startswith("file://"):
        return pafs.LocalFileSystem(), unquote(urlparse(root).path).rstrip("/")
    found, path = pafs.FileSystem.from_uri(root)
    return found, path.rstrip("/")


def entries(store: pafs.FileSystem, folder: str) -> list[tuple[str, bool, int, int]]:
    """Name, whether it is a folder, size and time of what a folder holds, in order of name; links and special files are passed over."""
    if isinstance(store, pafs.LocalFileSystem):
        out = []
        for name in sorted(os.listdir(folder)):
            if not os.path.lexists(place := f"{folder}/{name}"):
                continue  # gone since
            seen = os.lstat(place)
            if stat.S_ISDIR(seen.st_mode) or stat.S_ISREG(seen.st_mode):
                out.append((name, stat.S_ISDIR(seen.st_mode), seen.st_size, int(seen.st_mtime)))
        return out
    found = store.get_file_info(pafs.FileSelector(folder))
    return sorted((x.base_name, x.type == pafs.FileType.Directory, x.size or 0, x.mtime_ns // 10**9 if x.mtime_ns else 0) for x in found)


@dataclass
class Rules:
    """What of a tree is wanted. ``ignored``: whether ignored names are listed (as clutter) or pruned."""

    ignored: bool
    prefix: str = ""

    def entered(self, path: str) -> bool:
        """Whether a folder is looked into at all."""
        name = path.rpartition("/")[2]
        if "/" not in path and name.startswith("_") and not (self.ignored and name.lower() == "__macosx"):
            return False
        if not self.ignored and any(fnmatchcase(name.lower(), p.lower()) for p in paths.IGNORED):
            return False
        return self.met(path)

    def met(self, path: str) -> bool:
        """Whether the path, or something below it, can begin with the prefix."""
        return path.startswith(self.prefix) or self.prefix.startswith(path + "/")

    def listed(self, name: str) -> bool:
        return self.ignored or not any(fnmatchcase(name.lower(), p.lower()) for p in paths.IGNORED)


def look(store: pafs.FileSystem, top: str, folder: str, rules: Rules) -> tuple[list[tuple], list[str]]:
    """The rows of a folder (itself, unless it is the top, and its files), and the folders in it that are to be entered. A folder that
    cannot be read gives one row that says why."""
    try:
        held = entries(store, f"{top}/{folder}" if folder else top)
    except OSError as e:
        return [(folder, "error", 0, 0, None, str(e))], []
    inner = lambda name: f"{folder}/{name}" if folder else name
    rows = [(folder, "folder", 0, 0, len(held), None)] if folder else []
    rows += [(inner(name), "file", size, at, None, None) for name, is_folder, size, at in held if not is_folder and rules.listed(name) and rules.met(inner(name))]
    return rows, [path for name, is_folder, _, _ in held if is_folder and rules.entered(path := inner(name))]


class Share(InputPartition):
    """Subtrees that a task walks, and rows that the plan has already seen."""

    def __init__(self, subtrees: list[str], rows: list[tuple]):
        self.subtrees, self.rows = subtrees, rows


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["root"]
        self.rules = Rules(str(options.get("ignored", "false")).lower() == "true")
        self.subtrees = int(options.get("subtrees", SUBTREES))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for x in filters:
            if isinstance(x, StringStartsWith) and x.attribute == ("path",) and len(x.value) > len(self.rules.prefix):
                self.rules.prefix = x.value
            yield x  # Spark applies it all the same

    def partitions(self) -> list[Share]:
        store, top = opened(self.root)
        rows, level, looked = [], [""], 0
        while level and len(level) < self.subtrees and looked < PLANNED:
            below = []
            for k, folder in enumerate(level):
                if looked >= PLANNED:
                    below += level[k:]
                    break
                own, inner = look(store, top, folder, self.rules)
                looked += 1
                if folder == "" and own and own[0][1] == "error":
                    raise OSError(f"the tree {self.root} can't be read: {own[0][5]}")
                rows += own
                below += inner
            level = below
        n = max(1, min(self.subtrees, max(len(level), -(-len(rows) // BATCH))))
        return [Share(level[k::n], rows[k::n]) for k in range(n)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        store, top = opened(self.root)
        rows, waiting = list(partition.rows), list(reversed(partition.subtrees))
        while True:
            while len(rows) >= BATCH or rows and not waiting:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[:BATCH]), ARROW.types)], schema=ARROW)
                rows = rows[BATCH:]
            if not waiting:
                return
            own, inner = look(store, top, waiting.pop(), self.rules)
            rows += own
            waiting += reversed(inner)


class TreeSource(DataSource):
    """Options: ``root``; ``ignored`` (true lists ignored names as well); ``subtrees``, how many to share out."""

    @classmethod
    def name(cls) -> str:
        return "asset_tree"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def walk(spark: SparkSession, root: str, ignored: bool = False) -> DataFrame:
    """``path, kind (file, folder, error), size, mtime, entries, error`` of everything below a folder, empty and hidden files and empty folders
    as well. Ignored names are pruned unless asked for; reserved folders at the top and links always are."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    return spark.read.format("asset_tree").option("root", root).option("ignored", str(ignored).lower()).option("subtrees", str(max(SUBTREES, 4 * spark.sparkContext.defaultParallelism))).load()


def dealt(files: DataFrame) -> DataFrame:
    """The same files, shared out so that tasks have alike many and alike many bytes: each task deals what it has in turn, the largest first."""
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    n = max(files.sparkSession.sparkContext.defaultParallelism, -(-total["bytes"] // TASK_BYTES), -(-total["n"] // TASK_FILES))
    turn = files.sortWithinPartitions(F.desc("size"), "path").withColumn("_turn", F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int"))
    return turn.repartitionById(n, F.col("_turn")).drop("_turn")


def digest(store: pafs.FileSystem, place: str) -> str | None:
    """Of a file read in chunks; None if it can't be read."""
    sha = hashlib.sha256()
    try:
        with store.open_input_stream(place, buffer_size=0) as stream:
            while chunk := stream.read(CHUNK):
                sha.update(chunk)
    except OSError:
        return None
    return sha.hexdigest()


def written(contents: DataFrame, root: str) -> DataFrame:
    """Write a file for each row of ``path, content`` (binary) below a folder, in tasks; a task that runs again writes the same. Returns ``path, size``
    of what was written, which has to be computed for anything to be written."""

    def run(batches):
        store, top = opened(root)
        made = None
        for batch in batches:
            sizes = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if (folder := f"{top}/{path}".rpartition("/")[0]) != made:
                    store.create_dir(folder, recursive=True)
                    made = folder
                with store.open_output_stream(f"{top}/{path}") as out:
                    out.write(content.as_buffer() if content.is_valid else b"")
                sizes.append(len(content.as_buffer()) if content.is_valid else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["path", "size"])

    return contents.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "path string, size bigint")


def contents(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``path, content`` of the files whose name fits the pattern, but those hidden or below hidden folders (``.`` or ``_`` first), for many small files: a task opens some
    ``TASK_FILES`` of them, where Spark's own reader would deal out a few dozen, and folders are listed in tasks. A file that can't be read is an error."""
    files = walk(spark, root, ignored=True).filter((F.col("kind") == "file") & F.col("path").rlike(pattern) & ~F.col("path").rlike("(^|/)[._]")).select("path", "size")

    def run(batches):
        store, top = opened(root)
        for batch in batches:
            names, held, size = [], [], 0
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(f"{top}/{path}") as stream:
                    held.append(stream.read())
                names.append(f"{root.rstrip('/')}/{path}")
                size += len(held[-1])
                if size >= CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(held, pa.binary())], ["path", "content"])
                    names, held, size = [], [], 0
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(held, pa.binary())], ["path", "content"])

    return dealt(files).mapInArrow(run, "path string, content binary")


def hashed(files: DataFrame, root: str) -> DataFrame:
    """``files`` (path, size and others) with ``sha256``, each opened by the task that has its row and read in chunks, so neither paths nor
    contents pass through the driver and a file may be larger than memory. Null where a file can't be read or its path leaves the tree."""
    rows = files.drop("sha256")

    def run(batches):
        store, top = opened(root)
        for batch in batches:
            found = [None if p is None or re.search(r"(^|/)\.\.(/|$)", p) else digest(store, f"{top}/{p}") for p in batch.column(batch.schema.get_field_index("path")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "sha256"])

    return dealt(rows).mapInArrow(run, rows.schema.add("sha256", "string"))
