"""Sounds and archives as tables, read by Spark and decoded from bytes inside tasks."""

from __future__ import annotations

import io
import wave
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tree

SAMPLES = "clip string, i long, v double, rate int"
ENTRIES = "archive string, name string, size long, packed long, error string"


def gltf_texts(spark: SparkSession, root: str) -> DataFrame:
    """``id, text, error`` of glTF models: the JSON of ``.gltf`` files and of the first chunk of ``.glb`` containers, for ``features.models``. A container
    that is none, of another version than 2 or cut short has an error and no text."""
    found = tree.contents(spark, root, r"[.]gl(tf|b)$")
    c = F.col("content")
    word = lambda at: F.conv(F.concat(*(F.hex(F.substring(c, at + k, 1)) for k in (4, 3, 2, 1))), 16, 10).cast("long")  # noqa: E731  little-endian, from byte ``at``
    size = word(12)
    error = (
        F.when(F.length(c) < 20, "cut short").when(F.substring(c, 1, 4) != F.lit(b"glTF"), "no glTF container").when(word(4) != 2, "another version")
        .when(F.substring(c, 17, 4) != F.lit(b"JSON"), "no JSON chunk").when((F.length(c) < word(8)) | (F.length(c) < size + 20), "cut short")
    )
    error = F.when(F.lower("path").endswith(".glb"), error)
    text = F.when(F.lower("path").endswith(".glb"), F.decode(F.call_function("substring", c, F.lit(21), size.cast("int")), "utf-8")).otherwise(F.decode(c, "utf-8"))
    return found.select(F.col("path").alias("id"), F.when(error.isNull(), text).alias("text"), error.alias("error"))


def wav_samples(spark: SparkSession, root: str) -> DataFrame:
    """``clip, i, v, rate``: the mean of the channels of each PCM file, from -1 to 1. Files that are no
    such sound have no rows."""
    found = tree.contents(spark, root, r"[.]wav$")

    def run(parts):
        for part in parts:
            for path, content in zip(part.column("path").to_pylist(), part.column("content").to_pylist()):
                try:
                    with wave.open(io.BytesIO(content)) as sound:
                        wide, channels, rate, raw = sound.getsampwidth(), sound.getnchannels(), sound.getframerate(), sound.readframes(sound.getnframes())
                except (wave.Error, EOFError):
                    continue
                if wide == 3:
                    v = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
                    v = ((v[:, 0] << 8 | v[:, 1] << 16 | v[:, 2] << 24) >> 8) / 2.0**23
                else:
                    v = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[wide]).astype(float)
                    v = (v - 128) / 128 if wide == 1 else v / 2.0 ** (8 * wide - 1)
                v = v[: len(v) // channels * channels].reshape(-1, channels).mean(1)
                for k in range(0, len(v), 100_000):
                    some = v[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(some)), pa.array(np.arange(k, k + len(some))), pa.array(some), pa.array(np.full(len(some), rate, np.int32))], names=["clip", "i", "v", "rate"])

    return found.select("path", "content").mapInArrow(run, SAMPLES)


def zip_entries(spark: SparkSession, root: str, most: int = 100_000) -> DataFrame:
    """``archive, name, size, packed`` from the directories of zip files; ``error`` where one can't be read or
    has more than ``most`` entries."""
    found = tree.contents(spark, root, r"[.]zip$")

    def out(rows):
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["archive", "name", "size", "packed", "error"])

    def run(parts):
        for part in parts:
            rows = []
            for path, content in zip(part.column("path").to_pylist(), part.column("content").to_pylist()):
                try:
                    infos = zipfile.ZipFile(io.BytesIO(content)).infolist()
                    own = [(path, e.filename, e.file_size, e.compress_size, None) for e in infos if not e.is_dir()]
                    rows += own if len(own) <= most else [(path, None, None, None, "too many entries")]
                except zipfile.BadZipFile as bad:
                    rows.append((path, None, None, None, str(bad)))
                if len(rows) >= 10_000:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)

    return found.select("path", "content").mapInArrow(run, ENTRIES)


PIXELS = "img string, x int, y int, r int, g int, b int, a int, error string"
#: Channels of the colour kinds of PNG, and the largest image read.
CHANNELS, LARGEST = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}, 50_000_000


def _png(content: bytes) -> np.ndarray:
    """Height x width x RGBA of a PNG of 8 bits a channel that is not interlaced."""
    import struct
    import zlib

    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a png")
    at, parts, palette, clear, head = 8, [], None, b"", None
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        data = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"PLTE":
            palette = np.frombuffer(data, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = data
        elif kind == b"IDAT":
            parts.append(data)
        at += 12 + size
    if head is None or head[2] != 8 or head[6] or head[3] not in CHANNELS or head[0] * head[1] > LARGEST:
        raise ValueError("unsupported")
    width, height, n = head[0], head[1], CHANNELS[head[3]]
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)[: height * (width * n + 1)].reshape(height, width * n + 1)
    out, above = np.zeros((height, width * n), np.uint8), np.zeros(width * n, np.int64)
    for y in range(height):
        how, line = rows[y, 0], rows[y, 1:].astype(np.int64)
        if how == 2:
            line = (line + above) & 255
        elif how == 1:
            line = (np.cumsum(line.reshape(width, n), axis=0) & 255).ravel()
        elif how in (3, 4):
            left = np.zeros(n, np.int64)
            upper, corner = above.reshape(width, n), np.zeros(n, np.int64)
            made = line.reshape(width, n).copy()
            for x in range(width):
                if how == 3:
                    guess = (left + upper[x]) // 2
                else:
                    p = left + upper[x] - corner
                    a, b, c = abs(p - left), abs(p - upper[x]), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, upper[x], corner))
                left = made[x] = (made[x] + guess) & 255
                corner = upper[x]
            line = made.ravel()
        out[y], above = line, line
    cells = out.reshape(height, width, n)
    full = np.full((height, width, 1), 255, np.uint8)
    if head[3] == 3:
        alpha = np.full(256, 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
        return np.concatenate([palette[cells[..., 0]], alpha[cells]], 2)
    grey = n < 3
    colour = np.repeat(cells[..., :1], 3, 2) if grey else cells[..., :3]
    return np.concatenate([colour, cells[..., -1:] if n in (2, 4) else full], 2)


def png_pixels(spark: SparkSession, root: str) -> DataFrame:
    """``img, x, y, r, g, b, a`` of PNG files; one row with ``error`` for a file that can't be read."""
    import zlib

    found = tree.contents(spark, root, r"[.]png$")
    names = PIXELS.replace(",", "").split()[::2]

    def run(parts):
        for part in parts:
            for path, content in zip(part.column("path").to_pylist(), part.column("content").to_pylist()):
                try:
                    cells = _png(content)
                except (ValueError, zlib.error) as bad:
                    row = [pa.array([path]), *(pa.array([None], pa.int32()) for _ in range(6)), pa.array([str(bad)])]
                    yield pa.RecordBatch.from_arrays(row, names=names)
                    continue
                height, width = cells.shape[:2]
                for y in range(0, height, max(1, 100_000 // width)):
                    some = cells[y : y + max(1, 100_000 // width)].reshape(-1, 4).astype(np.int32)
                    k = np.arange(len(some), dtype=np.int32)
                    columns = [pa.array([path] * len(some)), pa.array(k % width), pa.array(k // width + y), *(pa.array(some[:, i]) for i in range(4)), pa.array([None] * len(some), pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return found.select("path", "content").mapInArrow(run, PIXELS)
