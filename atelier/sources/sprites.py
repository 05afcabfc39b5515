"""Layered sprite files as tables: frames with their tags and layers, and the pixels of each frame, layers laid over each other.

A file is read by one task; its chunks are told apart by their lengths, each of which is checked against what is there. Cels are whole arrays:
decoding and blending work on them at once, pixel by pixel nowhere. Blend modes other than the normal one are taken as normal, tile maps are left out; ``notes`` say
so. Hidden layers and groups don't show. A file that is none or is damaged gives one row with ``error``; one that ends early gives the frames that it has.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Fixed values of the format.
FILE_MAGIC, FRAME_MAGIC, HEADER, FRAME_HEADER = 0xA5E0, 0xF1FA, 128, 16
LAYER, CEL, TAGS, PALETTE, OLD_PALETTES, TILESET = 0x2004, 0x2005, 0x2018, 0x2019, (0x0004, 0x0011), 0x2023
RAW, LINKED, PACKED = 0, 1, 2
#: Pixels of a canvas or cel, at most; rows of a batch.
MOST_PIXELS, ROWS = 50_000_000, 100_000

FRAMES = "img string, frame int, width int, height int, depth int, duration_ms int, layers array<string>, tags array<struct<name:string,first:int,last:int>>, notes array<string>, error string"
PIXELS = "img string, frame int, x int, y int, r int, g int, b int, a int, error string"


class Damaged(ValueError):
    """The file is no sprite, or its parts don't fit together."""


@dataclass
class Cel:
    layer: int
    x: int
    y: int
    opacity: int
    pixels: np.ndarray | None = None
    link: int | None = None


@dataclass
class Sprite:
    width: int
    height: int
    depth: int
    layers: list[tuple[str, bool, int, int]] = field(default_factory=list)  # name, shown, kind, opacity
    tags: list[dict] = field(default_factory=list)
    durations: list[int] = field(default_factory=list)
    cels: list[list[Cel]] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)

    def frame(self, number: int) -> np.ndarray:
        """Height, width, rgba: the shown cels from the bottom up."""
        out = np.zeros((self.height, self.width, 4), np.int64)
        for cel in self.cels[number]:
            if cel.layer >= len(self.layers):
                raise Damaged(f"a cel is of layer {cel.layer} of {len(self.layers)}")
            _, shown, kind, opacity = self.layers[cel.layer]
            pixels = cel.pixels
            if cel.link is not None:
                if cel.link > number:
                    raise Damaged(f"frame {number} links to frame {cel.link}")
                pixels = next((c.pixels for c in self.cels[cel.link] if c.layer == cel.layer and c.pixels is not None), None)
            if shown and kind == 0 and pixels is not None:
                lay(out, pixels, cel.x, cel.y, int(scaled(np.array(opacity), cel.opacity)))
        return out


def scaled(a: np.ndarray, b) -> np.ndarray:
    """a * b / 255, rounded, in integers."""
    t = a * b + 128
    return ((t >> 8) + t) >> 8


def lay(under: np.ndarray, over: np.ndarray, x: int, y: int, opacity: int) -> None:
    """Blend a cel over a frame at a place that may lie partly outside."""
    height, width = under.shape[:2]
    top, left, bottom, right = max(0, y), max(0, x), min(height, y + over.shape[0]), min(width, x + over.shape[1])
    if top >= bottom or left >= right:
        return
    below, above = under[top:bottom, left:right], over[top - y : bottom - y, left - x : right - x].astype(np.int64)
    alpha = scaled(above[..., 3], opacity)
    base = below[..., 3]
    both = base + alpha - scaled(base, alpha)
    step = (above[..., :3] - below[..., :3]) * alpha[..., None]
    colour = below[..., :3] + np.sign(step) * (np.abs(step) // np.maximum(both, 1)[..., None])  # towards zero
    bare = base == 0
    colour[bare] = above[..., :3][bare]
    drawn = alpha > 0
    below[..., :3][drawn], below[..., 3][drawn] = colour[drawn], np.where(bare, alpha, both)[drawn]


def _text(data: bytes, at: int) -> tuple[str, int]:
    (size,) = struct.unpack_from("<H", data, at)
    if at + 2 + size > len(data):
        raise Damaged("a name is cut short")
    return data[at + 2 : at + 2 + size].decode("utf-8", "replace"), at + 2 + size


def _palette(data: bytes, palette: np.ndarray) -> None:
    _, first, last = struct.unpack_from("<III", data)
    at = 20
    for k in range(first, min(last, 255) + 1):
        (named,) = struct.unpack_from("<H", data, at)
        palette[k] = struct.unpack_from("4B", data, at + 2)
        at += 6
        if named & 1:
            at = _text(data, at)[1]


def _old_palette(data: bytes, palette: np.ndarray, deep: bool) -> None:
    (packets,), at, k = struct.unpack_from("<H", data), 2, 0
    for _ in range(packets):
        skip, n = struct.unpack_from("2B", data, at)
        at, k = at + 2, k + skip
        for _ in range(n or 256):
            if k < 256:
                rgb = struct.unpack_from("3B", data, at)
                palette[k] = (*(c if deep else (c & 63) * 255 // 63 for c in rgb), 255)
            at, k = at + 3, k + 1


def _cel(data: bytes, depth: int, palette: np.ndarray, clear: int) -> Cel | None:
    """None for a tile map."""
    layer, x, y, opacity, kind = struct.unpack_from("<HhhBH", data)
    if kind == LINKED:
        return Cel(layer, x, y, opacity, link=struct.unpack_from("<H", data, 16)[0])
    if kind not in (RAW, PACKED):
        return None
    width, height = struct.unpack_from("<HH", data, 16)
    if width * height > MOST_PIXELS:
        raise Damaged(f"a cel of {width} x {height} pixels")
    size = width * height * depth // 8
    raw = data[20 : 20 + size] if kind == RAW else zlib.decompressobj().decompress(data[20:], max(size, 1))
    if len(raw) < size:
        raise Damaged("a cel is cut short")
    cells = np.frombuffer(raw[:size], np.uint8).reshape(height, width, depth // 8)
    if depth == 16:
        cells = np.concatenate([np.repeat(cells[..., :1], 3, 2), cells[..., 1:]], 2)
    elif depth == 8:
        cells = np.where(cells == clear, 0, palette[cells[..., 0]])
    return Cel(layer, x, y, opacity, pixels=cells.astype(np.uint8))


def parse(data: bytes) -> Sprite:
    """All frames of a file."""
    if len(data) < HEADER or struct.unpack_from("<H", data, 4)[0] != FILE_MAGIC:
        raise Damaged("no sprite file")
    frames, width, height, depth = struct.unpack_from("<4H", data, 6)
    if not width or not height or depth not in (8, 16, 32) or width * height > MOST_PIXELS:
        raise Damaged(f"a canvas of {width} x {height} pixels of {depth} bits")
    out, palette, known = Sprite(width, height, depth), np.tile(np.array([0, 0, 0, 255], np.uint8), (256, 1)), False
    modes, left_out, at = set(), 0, HEADER
    for number in range(frames):
        if at >= len(data):
            if not number:
                raise Damaged("no frame")
            out.notes.append(f"ends after {number} of {frames} frames")
            break
        size, magic, few, duration, _, many = struct.unpack_from("<IHHHHI", data, at)
        if magic != FRAME_MAGIC:
            raise Damaged(f"frame {number} has no head")
        end = at + size if FRAME_HEADER <= size <= len(data) - at else len(data)
        place, cels = at + FRAME_HEADER, []
        for _ in range(many or few):
            if place + 6 > end:
                break
            length, kind = struct.unpack_from("<IH", data, place)
            if length < 6:
                raise Damaged(f"a chunk of {length} bytes")
            body, place = data[place + 6 : min(place + length, end)], min(place + length, end)
            if kind == LAYER:
                flags, layer_kind, _, _, _, mode, opacity = struct.unpack_from("<6HB", body)
                out.layers.append((_text(body, 16)[0], bool(flags & 1), layer_kind, opacity))
                left_out += layer_kind == 2
                modes |= {mode} - {0}
            elif kind == CEL:
                cel = _cel(body, depth, palette, data[28])
                left_out += cel is None
                cels += [cel] if cel is not None else []
            elif kind == PALETTE:
                _palette(body, palette)
                known = True
            elif kind in OLD_PALETTES and not known:
                _old_palette(body, palette, kind == OLD_PALETTES[0])
            elif kind == TAGS:
                (n,), spot = struct.unpack_from("<H", body), 10
                for _ in range(n):
                    first, last = struct.unpack_from("<HH", body, spot)
                    name, spot = _text(body, spot + 17)
                    out.tags.append({"name": name, "first": first, "last": last})
            left_out += kind == TILESET
        out.cels.append(cels)
        out.durations.append(duration or 100)
        at = end
    if not out.cels:
        raise Damaged("no frame")
    out.notes += [f"blend mode {m} is taken as normal" for m in sorted(modes)] + ([f"{left_out} tile maps are left out"] if left_out else [])
    return out


def _decoded(spark: SparkSession, root: str, ddl: str, rows: Callable[[str, Sprite], Iterator[dict]]) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{ase,aseprite}").load(root)
    layout = to_arrow_schema(StructType.fromDDL(ddl))

    def run(parts):
        for part in parts:
            for path, content in zip(part.column("path").to_pylist(), part.column("content").to_pylist()):
                made = []
                try:
                    for batch in rows(path, parse(content)):
                        made.append(pa.RecordBatch.from_pydict(batch, schema=layout))
                        if len(made) > 1:
                            yield made.pop(0)
                except (Damaged, struct.error, zlib.error) as bad:
                    made = [pa.RecordBatch.from_pylist([{"img": path, "error": f"{bad}"}], schema=layout)]
                yield from made

    return found.select("path", "content").mapInArrow(run, ddl)


def sprite_frames(spark: SparkSession, root: str) -> DataFrame:
    """A row for each frame: size, duration, and the file's layers from the bottom up, tags and notes."""

    def rows(path: str, s: Sprite) -> Iterator[dict]:
        n = len(s.cels)
        names = [name for name, *_ in s.layers if name]
        yield {"img": [path] * n, "frame": list(range(n)), "width": [s.width] * n, "height": [s.height] * n, "depth": [s.depth] * n, "duration_ms": s.durations, "layers": [names] * n, "tags": [s.tags] * n, "notes": [s.notes] * n, "error": [None] * n}

    return _decoded(spark, root, FRAMES, rows)


def sprite_pixels(spark: SparkSession, root: str) -> DataFrame:
    """``img, frame, x, y, r, g, b, a`` of every frame; colours are not multiplied by their alpha. ``features`` takes one frame as an image."""

    def rows(path: str, s: Sprite) -> Iterator[dict]:
        for number in range(len(s.cels)):
            cells = s.frame(number).reshape(-1, 4)
            for begin in range(0, len(cells), ROWS):
                some = cells[begin : begin + ROWS]
                k, n = np.arange(begin, begin + len(some)), len(some)
                yield {"img": [path] * n, "frame": np.full(n, number, np.int32), "x": k % s.width, "y": k // s.width, **{c: some[:, i] for i, c in enumerate("rgba")}, "error": [None] * n}

    return _decoded(spark, root, PIXELS, rows)
