"""Pixels of image files: PNG of all depths and interlaced, GIF, TGA and the flat image of PSD files.

A file is decoded by one task, as arrays: PNG lines are restored along diagonals, all lines at once, and run-length codes by packets. A kind, a
compression or a depth that is not read gives one row with an ``error`` that begins with ``unsupported``; damage one with another. GIF files
give their first frame on its canvas. Colours of more than 8 bits keep the highest 8.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

PIXELS = "img string, x int, y int, r int, g int, b int, a int, error string"
NAMES = PIXELS.replace(",", "").split()[::2]
GLOB = "*.{png,PNG,gif,GIF,tga,TGA,psd,PSD}"
MOST_PIXELS, ROWS = 50_000_000, 100_000
# Fixed values of the formats: the passes of interlaced PNG (first x, first y, steps) and of interlaced GIF (first line, step), samples of each PNG colour kind.
PNG_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
GIF_PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))
PNG_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


class Unread(ValueError):
    """The file is damaged, or of a kind that is not read."""


def _size(width: int, height: int) -> None:
    if not width or not height or width * height > MOST_PIXELS:
        raise Unread(f"an image of {width} x {height}")


def _restored(lines: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Lines, places and bytes of a place, after each line's filter is undone. A byte needs those left of it, above, and above to the left,
    so all that lie on one diagonal are restored together."""
    height, width, n = lines.shape
    out = np.zeros((height + 1, width + 1, n), np.int16)
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height - 1, d) + 1)
        x = d - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        guess = left + up - corner
        a, b, c = np.abs(guess - left), np.abs(guess - up), np.abs(guess - corner)
        nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        add = np.choose(kinds[y][:, None], [np.zeros_like(left), left, up, (left + up) >> 1, nearest])
        out[y + 1, x + 1] = (lines[y, x] + add) & 255
    return out[1:, 1:].astype(np.uint8)


def _samples(raw: bytes, width: int, height: int, bits: int, n: int) -> tuple[np.ndarray, int]:
    """Height, width, samples at full depth, and the bytes used."""
    whole = (width * n * bits + 7) // 8
    used = height * (whole + 1)
    if len(raw) < used:
        raise Unread("the pixels are cut short")
    rows = np.frombuffer(raw[:used], np.uint8).reshape(height, whole + 1)
    if (rows[:, 0] > 4).any():
        raise Unread("an unknown filter")
    step = max(1, n * bits // 8)
    flat = _restored(rows[:, 1:].reshape(height, -1, step), rows[:, 0]).reshape(height, whole)
    if bits == 16:
        values = flat.reshape(height, width, n, 2).astype(np.int64)
        return values[..., 0] << 8 | values[..., 1], used
    if bits < 8:
        each = np.unpackbits(flat, axis=1).reshape(height, -1, bits)
        flat = (each << np.arange(bits - 1, -1, -1)).sum(2)[:, : width * n]
    return flat.reshape(height, width, n).astype(np.int64), used


def png(data: bytes) -> np.ndarray:
    at, parts, palette, clear, head = 8, [], None, b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int64)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            parts.append(body)
        at += size + 12
    if head is None:
        raise Unread("no header")
    width, height, bits, kind, _, _, laced = head
    _size(width, height)
    if kind not in PNG_SAMPLES or laced > 1 or bits not in (1, 2, 4, 8, 16):
        raise Unread(f"unsupported PNG: colours {kind}, {bits} bits")
    n = PNG_SAMPLES[kind]
    raw = zlib.decompress(b"".join(parts))
    values = np.zeros((height, width, n), np.int64)
    for x, y, dx, dy in PNG_PASSES if laced else ((0, 0, 1, 1),):
        w, h = -(-(width - x) // dx), -(-(height - y) // dy)
        if w > 0 and h > 0:
            values[y::dy, x::dx], used = _samples(raw, w, h, bits, n)
            raw = raw[used:]
    if kind == 3:
        if palette is None or values.max() >= len(palette):
            raise Unread("a colour beyond the palette")
        alpha = np.full(len(palette), 255)
        alpha[: len(clear)] = np.frombuffer(clear[: len(palette)], np.uint8)
        return np.concatenate([palette[values[..., 0]], alpha[values]], 2)
    eight = values >> 8 if bits == 16 else values * 255 // ((1 << bits) - 1)
    opaque = np.full((height, width, 1), 255)
    if n in (2, 4):
        opaque = eight[..., -1:]
    elif clear:
        opaque = np.where((values == np.frombuffer(clear, ">u2")[:n]).all(2, keepdims=True), 0, 255)
    return np.concatenate([np.repeat(eight[..., :1], 3, 2) if n < 3 else eight[..., :3], opaque], 2)


def _words(data: bytes, least: int, most: int) -> np.ndarray:
    """Values of GIF's code: a step a code, each of which is a string of values."""
    clear, stop = 1 << least, (1 << least) + 1
    fresh = [bytes([k]) for k in range(clear)] + [b"", b""]
    table, size, last, out, held, bits, done = list(fresh), least + 1, None, [], 0, 0, 0
    for byte in data:
        held |= byte << bits
        bits += 8
        while bits >= size:
            code = held & ((1 << size) - 1)
            held >>= size
            bits -= size
            if code == clear:
                table, size, last = list(fresh), least + 1, None
                continue
            if code == stop or done >= most:
                return np.frombuffer(b"".join(out)[:most], np.uint8)
            if code > len(table) or code == len(table) and last is None:
                raise Unread("a code beyond the table")
            word = table[code] if code < len(table) else last + last[:1]
            if last is not None and len(table) < 4096:
                table.append(last + word[:1])
                if len(table) == 1 << size and size < 12:
                    size += 1
            out.append(word)
            done += len(word)
            last = word
    return np.frombuffer(b"".join(out)[:most], np.uint8)


def gif(data: bytes) -> np.ndarray:
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    _size(width, height)
    colours = lambda flags, at: (np.frombuffer(data, np.uint8, 3 << (flags & 7) + 1, at).reshape(-1, 3), at + (3 << (flags & 7) + 1)) if flags & 128 else (None, at)
    palette, at = colours(flags, 13)
    clear = -1

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(data) and data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    while at < len(data):
        if data[at] == 0x21:
            body, end = blocks(at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4 and body[0] & 1:
                clear = body[3]
            at = end
        elif data[at] == 0x2C:
            left, top, w, h, flags = struct.unpack_from("<4HB", data, at + 1)
            own, at = colours(flags, at + 10)
            palette = palette if own is None else own
            body, _ = blocks(at + 1)
            values = _words(body, data[at], w * h)
            if palette is None or len(values) < w * h:
                raise Unread("the pixels are cut short" if palette is not None else "no palette")
            lines = values.reshape(h, w)
            if flags & 64:
                order = np.concatenate([np.arange(a, h, s) for a, s in GIF_PASSES])
                lines = lines[np.argsort(order)]
            full = np.zeros((256, 4), np.int64)
            full[:, 3] = 255
            full[: len(palette), :3] = palette
            if clear >= 0:
                full[clear] = 0
            out = np.zeros((height, width, 4), np.int64)
            out[top : top + h, left : left + w] = full[lines][: max(0, height - top), : max(0, width - left)]
            return out
        else:
            break
    raise Unread("no image")


def tga(data: bytes) -> np.ndarray:
    skip, mapped, kind, first, count, deep, _, _, width, height, bits, how = struct.unpack_from("<BBBHHBHHHHBB", data)
    _size(width, height)
    if kind & 7 not in (1, 2, 3) or kind & ~11 or bits not in (8, 15, 16, 24, 32):
        raise Unread(f"unsupported TGA: kind {kind}, {bits} bits")
    at = 18 + skip

    def colours(raw: np.ndarray, bits: int) -> np.ndarray:
        """Rows of bytes as rgba."""
        if bits == 8:
            return np.concatenate([np.repeat(raw, 3, 1), np.full((len(raw), 1), 255)], 1)
        if bits in (15, 16):
            v = raw[:, 0].astype(np.int64) | raw[:, 1].astype(np.int64) << 8
            return np.stack([*((v >> s & 31) * 255 // 31 for s in (10, 5, 0)), np.full(len(v), 255)], 1)
        alpha = raw[:, 3:] if bits == 32 and (how & 15 or mapped) else np.full((len(raw), 1), 255)
        return np.concatenate([raw[:, 2::-1], alpha], 1)

    table = None
    if mapped:
        size = (deep + 7) // 8
        table = colours(np.frombuffer(data, np.uint8, count * size, at).reshape(-1, size), deep)
        at += count * size
    n, size = width * height, (bits + 7) // 8
    if kind & 8:
        parts, done = [], 0
        while done < n:
            if at >= len(data):
                raise Unread("the pixels are cut short")
            k = (data[at] & 127) + 1
            if data[at] & 128:
                parts.append(data[at + 1 : at + 1 + size] * k)
                at += 1 + size
            else:
                parts.append(data[at + 1 : at + 1 + size * k])
                at += 1 + size * k
            done += k
        raw = b"".join(parts)
    else:
        raw = data[at : at + n * size]
    if len(raw) < n * size:
        raise Unread("the pixels are cut short")
    cells = np.frombuffer(raw[: n * size], np.uint8).reshape(n, size)
    if kind & 7 == 1:
        if table is None or cells[:, 0].max() - first >= len(table):
            raise Unread("a colour beyond the palette")
        made = table[cells[:, 0].astype(np.int64) - first]
    else:
        made = colours(cells, bits)
    made = made.reshape(height, width, 4).astype(np.int64)
    made = made if how & 32 else made[::-1]
    return made[:, ::-1] if how & 16 else made


def psd(data: bytes) -> np.ndarray:
    version, planes, height, width, bits, mode = struct.unpack_from(">H6xHIIHH", data, 4)
    _size(width, height)
    need = {1: 1, 3: 3}.get(mode)
    if version != 1 or bits != 8 or need is None or planes < need:
        raise Unread(f"unsupported PSD: mode {mode}, {bits} bits")
    at = 26
    for _ in range(3):  # colours, resources, layers
        at += 4 + struct.unpack_from(">I", data, at)[0]
    (packed,) = struct.unpack_from(">H", data, at)
    at, lines = at + 2, planes * height
    if packed == 0:
        raw = data[at : at + lines * width]
    elif packed == 1:
        sizes = struct.unpack_from(f">{lines}H", data, at)
        at, parts = at + 2 * lines, []
        for size in sizes:
            end, line = at + size, []
            while at < end:
                k = data[at]
                line.append(data[at + 1 : at + 2 + k] if k < 128 else data[at + 1 : at + 2] * (257 - k) if k > 128 else b"")
                at += 2 + k if k < 128 else 2 if k > 128 else 1
            parts.append(b"".join(line)[:width].ljust(width, b"\0"))
        raw = b"".join(parts)
    else:
        raise Unread(f"unsupported PSD: compression {packed}")
    if len(raw) < lines * width:
        raise Unread("the pixels are cut short")
    cells = np.frombuffer(raw, np.uint8).reshape(planes, height, width).transpose(1, 2, 0).astype(np.int64)
    alpha = cells[..., need : need + 1] if planes > need else np.full((height, width, 1), 255)
    return np.concatenate([np.repeat(cells[..., :1], 3, 2) if need == 1 else cells[..., :3], alpha], 2)


def decoded(path: str, data: bytes) -> np.ndarray:
    """Height, width, rgba; told by the content, or by the name for TGA, which has no mark."""
    for mark, read in ((b"\x89PNG\r\n\x1a\n", png), (b"GIF8", gif), (b"8BPS", psd)):
        if data.startswith(mark):
            return read(data)
    if path.lower().endswith(".tga"):
        return tga(data)
    raise Unread("unsupported: no known mark")


def image_pixels(spark: SparkSession, root: str) -> DataFrame:
    """``img, x, y, r, g, b, a`` of all image files below a folder, or one row with ``error`` for a file."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", GLOB).load(root)

    def run(parts):
        for part in parts:
            for path, content in zip(part.column("path").to_pylist(), part.column("content").to_pylist()):
                try:
                    cells = decoded(path, content)
                except (Unread, struct.error, zlib.error, ValueError, IndexError) as bad:
                    row = [pa.array([path]), *(pa.array([None], pa.int32()) for _ in range(6)), pa.array([f"{bad}"])]
                    yield pa.RecordBatch.from_arrays(row, names=NAMES)
                    continue
                width, flat = cells.shape[1], cells.reshape(-1, 4).astype(np.int32)
                for begin in range(0, len(flat), ROWS):
                    some = flat[begin : begin + ROWS]
                    k = np.arange(begin, begin + len(some), dtype=np.int32)
                    columns = [pa.array([path] * len(some)), pa.array(k % width), pa.array(k // width), *(pa.array(some[:, i]) for i in range(4)), pa.array([None] * len(some), pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=NAMES)

    return found.select("path", "content").mapInArrow(run, PIXELS)
