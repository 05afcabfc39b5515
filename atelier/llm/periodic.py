"""Runs of words: the longest stretches of a text that repeat with a period, and the text without the repeats.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), of ``LEAST`` words and two periods at least, that
no neighbouring word extends. All runs of a text are found from its longest-previous-factor array:

1. Prefix doubling ranks all stretches of 1, 2, 4, ... words; the last ranks are the suffix array, and all of them
   tell how far two places agree, forwards and backwards, in a number of steps that is the logarithm of that length.
2. Suffix array and longest common prefixes give for each place its longest previous factor and where that began;
   these give the text's LZ blocks.
3. A run that touches a block's edge is found by extending agreement from there, for each period that the lengths of
   the blocks before and after allow (Main). There are at most three such periods for each word.
4. A run strictly inside a block is a copy of one inside the block's source; runs found so far are kept by their start, and each block copies
   those of its source, from left to right.

Words are told apart by their bytes, not by hashes. A text is looked at further only if six words of it occur twice, as
every run holds such words; hashes decide that, and equal words have equal hashes. Texts of one slice are worked on together;
words of different texts never agree.

A null text has no words, as an empty one; both give no runs and an empty collapsed text. Texts are taken whole, however long: memory
is some 30 bytes a word, and 4 more for each doubling of the longest repeat. Equal texts give equal results, repeated rows stay; an
empty table gives an empty result. Columns that bear the name of a new one are replaced.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._arrow import add
from ._words import SPACED, Texts, mixed

LEAST = 12
#: Words that any run holds twice: of length L and period q it repeats L - q, at least half of ``LEAST``.
TWICE = LEAST // 2
#: Pairs of places compared at a time.
CHUNK = 1 << 18
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])


class Ranks:
    """Stretches of 2**k words, ranked: ``level[k][i]`` is the place in order of the first stretch equal to that at i."""

    def __init__(self, words: np.ndarray, text: np.ndarray):
        """``text`` is the number of each word's text, ascending; shorter stretches at a text's end come first."""
        n = len(words)
        key = text.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
        order = np.argsort(key, kind="stable")
        rank = np.empty(n + 1, np.int32)
        rank[order], rank[n] = self._firsts(key[order]), -1
        last = np.flatnonzero(np.diff(text, append=-1))
        end = last[np.searchsorted(last, np.arange(n))] + 1
        self.level, step = [rank], 1
        live = order
        while True:
            place = rank[live]  # live is in order, so equal ranks lie together
            alone = np.diff(place, prepend=-1) != 0
            alone &= np.diff(place, append=-1) != 0
            live, place = live[~alone], place[~alone]
            if not len(live):
                break
            after = np.where(live + step < end[live], rank[np.minimum(live + step, n)], -1)
            by = np.lexsort((after, place))
            live, place, after = live[by], place[by], after[by]
            group = self._firsts(place)
            inner = self._firsts(place.astype(np.int64) * (n + 2) + after)
            rank = rank.copy()
            rank[live] = place + (inner - group)
            self.level.append(rank)
            step *= 2
        self.suffixes = np.empty(n, np.int32)
        self.suffixes[rank[:n]] = np.arange(n, dtype=np.int32)

    @staticmethod
    def _firsts(ordered: np.ndarray) -> np.ndarray:
        """For each of an ordered list the place of the first equal one."""
        new = np.diff(ordered, prepend=ordered[:1] - 1) != 0
        return np.maximum.accumulate(np.where(new, np.arange(len(ordered)), 0))

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree from places a and b on, which differ."""
        n = len(self.level[0]) - 1
        far = np.zeros(len(a), np.int64)
        for k in range(len(self.level) - 1, -1, -1):
            far += (self.level[k][np.minimum(a + far, n)] == self.level[k][np.minimum(b + far, n)]).astype(np.int64) << k
        return far

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree up to places a and b, which differ; -1 is before all words."""
        far = np.zeros(len(a), np.int64)
        for k in range(len(self.level) - 1, -1, -1):
            x, y = a - far - (1 << k) + 1, b - far - (1 << k) + 1
            agree = (np.minimum(x, y) >= 0) & (self.level[k][np.maximum(x, 0)] == self.level[k][np.maximum(y, 0)])
            far += agree.astype(np.int64) << k
        return far


def previous_factors(suffixes: list[int], common: list[int]) -> tuple[list[int], list[int]]:
    """For each place the length of the longest stretch from there that also begins earlier, and the earlier place (-1: none).
    ``common[r]`` is the longest common prefix of suffix r with the one before it in order.

    Of suffixes in order, the nearest that begins earlier on either side agrees longest. Places wait on a stack until one that
    begins earlier comes; each knows how far it agrees with that below."""
    longest, source = [0] * len(suffixes), [-1] * len(suffixes)
    stack: list[tuple[int, int]] = []
    for at, shared in zip([*suffixes, -1], [*common, 0]):
        while stack and stack[-1][0] > at:
            place, below = stack.pop()
            if below >= shared:
                longest[place], source[place] = below, stack[-1][0] if below else -1
                shared, below = below, shared
            else:
                longest[place], source[place] = shared, at
            shared = below
        stack.append((at, shared))
    return longest, source


def _touching(ranks: Ranks, edge: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs that touch a block's edge, as start, end, period. ``before`` and ``after`` are the lengths of the blocks on either side, 0 at a text's ends."""
    found = [np.zeros((0, 3), np.int64)]
    pairs = ranks.level[1] if len(ranks.level) > 1 else ranks.level[0]
    for later, most in ((True, after), (False, np.where(before > 0, before + after, 0))):  # the edge against places after and before it
        total = np.concatenate([[0], np.cumsum(most)])
        for at in range(0, int(total[-1]), CHUNK):
            flat = np.arange(at, min(at + CHUNK, int(total[-1])))
            of = np.searchsorted(total, flat, "right") - 1
            period = flat - total[of] + 1
            x = edge[of] if later else edge[of] - period
            inside = x >= 0
            x, period = x[inside], period[inside]
            y = x + period
            # of six words and more that agree about the edge three lie on one side
            near = (pairs[x] == pairs[y]) | (pairs[np.maximum(x - 2, 0)] == pairs[np.maximum(y - 2, 0)])
            x, y, period = x[near], y[near], period[near]
            start, end = x - ranks.backward(x - 1, y - 1), y + ranks.forward(x, y)
            held = end - start >= np.maximum(LEAST, 2 * period)
            found.append(np.unique(np.stack([start[held], end[held], period[held]], 1), axis=0))
    every = np.unique(np.concatenate(found), axis=0)  # by start, end and period
    least = np.any(np.diff(every[:, :2], axis=0, prepend=-1) != 0, axis=1)  # multiples of a period span the same stretch
    return [tuple(r) for r in every[least].tolist()]


def find(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Start, end and period of all runs, by start and period; ``words`` are codes, ``text`` the number of each word's text, ascending."""
    if not len(words):
        return np.zeros((0, 3), np.int64)
    ranks = Ranks(words, text)
    order = ranks.suffixes.astype(np.int64)
    common = np.zeros(len(order), np.int64)
    common[1:] = ranks.forward(order[1:], order[:-1])
    longest, source = previous_factors(order.tolist(), common.tolist())
    starts = np.flatnonzero(np.diff(text, prepend=-1)).tolist()
    edge, before, after = [], [], []
    for begin, end in zip(starts, [*starts[1:], len(words)]):
        last = 0
        while begin < end:
            size = longest[begin] or 1
            edge.append(begin)
            before.append(last)
            after.append(size)
            begin, last = begin + size, size
        edge.append(end)
        before.append(last)
        after.append(0)
    known = _touching(ranks, np.array(edge), np.array(before), np.array(after))
    if known:
        for begin, size in zip(edge, after):
            if size >= LEAST + 2:
                origin = source[begin]
                at = bisect_left(known, (origin + 1,))
                while at < len(known) and known[at][0] < origin + size - LEAST:
                    start, end, period = known[at]
                    if end < origin + size:
                        insort(known, (start + begin - origin, end + begin - origin, period))
                    at += 1
    runs = np.array(known, np.int64).reshape(-1, 3)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _codes(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Equal numbers for words of equal bytes."""
    size = high - low
    edge = np.concatenate([[0], np.cumsum(size)])
    taken = data[np.repeat(low - edge[:-1], size) + np.arange(edge[-1])]
    words = pa.Array.from_buffers(pa.large_binary(), len(low), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(taken)])
    return words.dictionary_encode().indices.to_numpy()


def _again(words, n: int) -> np.ndarray:
    """Which of n texts hold some ``TWICE`` words twice."""
    first, code = words.windows(TWICE)
    text = words.text[first]
    key = mixed(code + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    equal = key[order[1:]] == key[order[:-1]]
    out = np.zeros(n, bool)
    out[text[order[1:]][equal]] = True
    return out


def measure(texts: Texts) -> list:
    """The columns of ``FOUND``."""
    words, n = texts.runs(SPACED), len(texts)
    text = words.text
    chosen = np.flatnonzero(_again(words, n)[text])
    runs = find(_codes(texts.bytes, words.low[chosen], words.high[chosen]), text[chosen])
    runs[:, :2] = np.stack([chosen[runs[:, 0]], chosen[runs[:, 1] - 1] + 1], 1) if len(runs) else runs[:, :2]
    gone = np.zeros(len(text) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
    first = np.searchsorted(text, np.arange(n + 1))
    of = text[runs[:, 0]]
    relative = pa.StructArray.from_arrays([pa.array(x) for x in (runs[:, 0] - first[of], runs[:, 1] - runs[:, 0], runs[:, 2])], names=RUN.names)
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), relative)
    return [np.diff(first), lists, _joined(texts, words.low[kept], words.high[kept], text[kept])]


def _joined(texts: Texts, low: np.ndarray, high: np.ndarray, text: np.ndarray) -> pa.Array:
    """The given words of each text, joined by one space."""
    size = high - low + 1  # with the byte after the word, which becomes the space
    size[np.flatnonzero(np.diff(text, append=-1))] -= 1  # none after the last
    edge = np.concatenate([[0], np.cumsum(size)])
    out = texts.bytes[np.repeat(low - edge[:-1], size) + np.arange(edge[-1])]
    spaced = size > high - low
    out[edge[1:][spaced] - 1] = 0x20
    ends = edge[np.searchsorted(text, np.arange(len(texts) + 1))]
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)]).cast(pa.string())


def detect(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns, or those of ``keep``) with ``n_words``, ``runs`` (by start, then period; words are numbered from 0) and
    ``collapsed``: the words that no run holds after its first period, joined by one space."""
    return add(docs, text, FOUND, lambda: lambda part: measure(Texts.of(part.column(text))), keep)
