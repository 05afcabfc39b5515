"""Words, lines and windows of many texts at once, as numpy arrays.

Texts are laid end to end in one UTF-8 buffer, each closed by a newline, which is
no word byte in any of the word classes used here. All work is per byte, so the
cost of a batch is linear and no Python loop runs over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at a time; bounds the temporary arrays whatever a text's length.
SEGMENT = 1 << 19
#: Bytes of text worked on at a time, but for longer single texts.
SLICE = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MIX_A, MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def byte_class(outside: list[tuple[int, int]]) -> np.ndarray:
    """Which byte values belong to a word: all but the given inclusive ranges."""
    table = np.ones(256, bool)
    for low, high in outside:
        table[low : high + 1] = False
    return table


#: ``[^\x20\x09-\x0D]+``
SPACED = byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, after A-Z became a-z
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
LINE = byte_class([(0x0A, 0x0A)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all its bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * MIX_A
    h = h ^ (h >> np.uint64(29))
    h = h * MIX_B
    return h ^ (h >> np.uint64(32))


#: The C library's own call that returns freed memory, where it has one.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return what is no longer used to the system: Arrow and the C library keep it otherwise, so
    that each idle Python worker would stay as large as its largest slice made it."""
    pa.default_memory_pool().release_unused()
    if TRIM is not None:
        TRIM(0)


def batches(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about ``most`` bytes of text each, a single row at least. What the work on a slice
    leaves is given back before the next."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes, dtype=np.int64)
    begin = 0
    while begin < len(sizes):
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + most, "right")))
        yield batch.slice(begin, end - begin)
        give_back()
        begin = end


@dataclass
class Texts:
    """``start[i]`` to ``start[i + 1]`` are the bytes of text i with its closing newline."""

    bytes: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> "Texts":
        """Nulls count as empty texts."""
        raw = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
        line = pc.binary_join_element_wise(raw, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
        size = pc.binary_length(line).to_numpy(zero_copy_only=False)
        start = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        offset = np.frombuffer(line.buffers()[1], np.int64)[line.offset : line.offset + 1][0] if len(line) else 0
        data = line.buffers()[2] if len(line) else None
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        return cls(raw[offset : offset + start[-1]], start)

    def __len__(self) -> int:
        return len(self.start) - 1

    def lowered(self) -> "Texts":
        return Texts(LOWER[self.bytes], self.start)

    def count(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text the mask marks."""
        return np.add.reduceat(mask, self.start[:-1], dtype=np.int64) if len(self) else np.zeros(0, np.int64)

    def hashes(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The hash of each stretch of bytes; stretches are in order and don't overlap."""
        parts, begin = [], 0
        while begin < len(low):
            end = max(begin + 1, int(np.searchsorted(high, low[begin] + SEGMENT, "right")))
            first = low[begin]
            parts.append(_hashed(self.bytes[first : high[end - 1]], low[begin:end] - first, high[begin:end] - first))
            begin = end
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def runs(self, member: np.ndarray) -> "Runs":
        """The longest runs of bytes of a class."""
        step = np.flatnonzero(np.diff(member[self.bytes].view(np.int8), prepend=0, append=0))
        low, high = step[0::2], step[1::2]
        return Runs(low, high, self.hashes(low, high), np.searchsorted(self.start, low, "right") - 1, len(self))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        n = max(n, SEGMENT + 1)
        back = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, base in (("up", BASE), ("down", back)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def _hashed(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each run, from one running sum over the segment."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mixed((total[high] - total[low]) * down[low] + (high - low).astype(np.uint64) * MIX_B)


@dataclass
class Runs:
    """Words or lines in order: first byte, byte after the last, hash and text number."""

    low: np.ndarray
    high: np.ndarray
    code: np.ndarray
    text: np.ndarray
    texts: int

    def per_text(self, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.text, weights, self.texts).astype(np.int64)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each window of n words within one text."""
        if len(self.code) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        last = len(self.code) - n + 1
        first = np.flatnonzero(self.text[:last] == self.text[n - 1 :])
        code = np.zeros(last, np.uint64)
        for k in range(n):
            code = code * BASE + self.code[k : k + last]
        return first, mixed(code[first])
