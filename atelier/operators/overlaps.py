"""Sets that share at least a part of their union, found class by class inside tasks.

The hash of a content puts it into a class, so sets fall into small parts. Of two sets that share at least a share of their union, some class does so as well: shared contents
and unions are sums over the classes. So sets meet on the first contents of their classes only, and there sketches of the classes tell most pairs apart before any pair is written."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Counts of contents by hash, which order them; contents of a set in one row, of whole classes if 80 at least; rows (and columns) of a cell; meetings looked at in one step.
BUCKETS, CHUNK, BLOCK, STEP = 1 << 17, 1 << 12, 2048, 1 << 19
#: Sizes from which on a set has 2, 8, 32 and so on classes: 10 to 40 contents in each.
LEVELS = 20 * 4 ** np.arange(29)
#: Contents by which a small set asks for those that may hold it.
ASKED = 8
_SURE = 1e-9


def up(x: np.ndarray) -> np.ndarray:
    return np.ceil(x - _SURE).astype(np.int64)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before, the first row included."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def whole(batches: Iterator[pa.RecordBatch], starts: Callable[[pa.Table], np.ndarray]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and where each group starts."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        at = starts(t)
        if len(at) > 1:
            yield t.slice(0, at[-1]).combine_chunks(), at[:-1]
            held = t.slice(at[-1]).to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, starts(t)


def _differ(t: pa.Table, name: str) -> np.ndarray:
    """Whether a row, from the second on, differs from the one before."""
    c = t.column(name)
    return pc.not_equal(c.slice(1), c.slice(0, max(len(c) - 1, 0))).to_numpy()


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow`` over ``p, c, h`` (set, content, its hash) sorted by ``p, c``: ``p, n, b, q, cs``: the n contents of a set, each once, in chunks q by the first b bits of their hash. A task holds one set whole."""
    starts = lambda t: np.flatnonzero(np.r_[True, _differ(t, "p")])
    for table, at in whole(batches, starts):
        once = np.flatnonzero(np.r_[True, _differ(table, "p") | _differ(table, "c")])
        own = np.searchsorted(at, once, "right") - 1
        n = np.bincount(own, minlength=len(at))
        b = np.maximum(np.ceil(np.log2(n / CHUNK)), 0).astype(np.int64)
        q = np.where(b[own] > 0, _column(table, "h")[once].view(np.uint64) >> np.minimum(64 - b[own], 63).astype(np.uint64), np.uint64(0)).astype(np.int64)
        by = np.lexsort((q, own)) if b.any() else np.arange(len(own))
        start = changes(own[by], q[by])
        pack = own[by][start]
        cs = pa.ListArray.from_arrays(pa.array(np.r_[start, len(by)].astype(np.int32)), table.column("c").take(pa.array(once[by])).combine_chunks())
        p = table.column("p").take(pa.array(at[pack])).combine_chunks()
        yield pa.RecordBatch.from_arrays([p, pa.array(n[pack]), pa.array(b[pack].astype(np.int32)), pa.array(q[by][start].astype(np.int32)), cs], ["p", "n", "b", "q", "cs"])


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _pieces(t: pa.Table) -> np.ndarray:
    return np.flatnonzero(_column(t, "pos") == 0)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def in_order(counts: np.ndarray, h: np.ndarray) -> np.ndarray:
    """How many rows share the bucket of a content: no fewer than hold it, so contents of very many sets come last."""
    return counts[h & (BUCKETS - 1)]


def posted(least: float, counts: np.ndarray) -> Callable:
    """For ``mapInArrow`` over contents of chunks (``p, n, pos, v, h``: set, its size, place in the chunk, key and hash of the content): ``c, p, w, s, t``, a row for each first content of each class.

    Of two classes that share the part, the smaller, of k contents, shares at least ``up(k * 2 * least / (1 + least))`` of them, the larger at least ``up(k * least)``: they have one of the first ``k - o + 1`` in common.
    Sets have classes by their size, and those that larger sets which may be alike have. ``w`` holds the level of the classes, k, the role in the cell (0: row and column, 1: column, 2: row) and whether the level is
    that of larger sets; ``c`` is a short hash of the content (rows of two contents that meet by it are told apart later); ``s, t`` are the sketch, 128 bits that the contents of the class set. A content of very many sets is dealt out in cells."""
    usual = 4 * float(counts.mean())

    def run(batches):
        for table, at in whole(batches, _pieces):
            n, v, h = (_column(table, name) for name in ("n", "v", "h"))
            chunk = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(n)]))
            own, most = (np.searchsorted(LEVELS, x, "right") for x in (n, np.floor(n / least + _SURE)))
            for more in range(int((most - own).max()) + 1):
                rows = np.flatnonzero(own + more <= most)
                level = own[rows] + more
                part = np.where(level > 0, h[rows].view(np.uint64) >> np.minimum(65 - 2 * level, 63).astype(np.uint64), np.uint64(0))
                by = np.lexsort((v[rows], h[rows], in_order(counts, h[rows]), part, chunk[rows]))
                rows, level, part = rows[by], level[by], part[by]
                start = changes(chunk[rows], part)
                size = np.diff(np.r_[start, len(rows)])
                k, rank = np.repeat(size, size), np.arange(len(rows)) - np.repeat(start, size)
                bit, second = np.uint64(1) << (h[rows] & 63).astype(np.uint64), (h[rows] >> 6 & 1).astype(bool)
                s, t = (np.repeat(np.bitwise_or.reduceat(np.where(which, bit, np.uint64(0)), start), size) for which in (~second, second))
                post = rank <= k - up(k * least)
                rows, level, k, rank, s, t = (x[post] for x in (rows, level, k, rank, s, t))
                across = rank <= k - up(k * (2 * least / (1 + least)))
                w = level << 48 | k << 8 | int(more > 0)
                parts = np.ceil(np.maximum(in_order(counts, h[rows]) - usual, 1) / BLOCK).astype(np.int64)
                one = parts == 1
                yield _out(table, rows[one], v[rows[one]], w[one] | np.where(across[one], 0, 2 << 1), s[one], t[one])
                many = np.flatnonzero(~one)
                if len(many):
                    yield from _cells(table, rows[many], v[rows[many]], w[many], s[many], t[many], parts[many], across[many])

    return run


def _out(table: pa.Table, rows: np.ndarray, c: np.ndarray, w: np.ndarray, s: np.ndarray, t: np.ndarray) -> pa.RecordBatch:
    p, c = table.column("p").take(pa.array(rows)).combine_chunks(), (c ^ c >> 32).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(c), p, pa.array(w), pa.array(s.view(np.int64)), pa.array(t.view(np.int64))], ["c", "p", "w", "s", "t"])


def _cells(table, rows, v, w, s, t, parts, across):
    """Rows of contents of very many sets: each is a row of the cells beside it and, if it is ``across``, a column of those below; a cell is named by a hash."""
    turn = (_mixed(s + _mixed(t)) >> np.uint64(20)).astype(np.int64) % parts
    for some in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(np.cumsum(parts) // STEP)) + 1):
        for chosen, role in ((some, 2), (some[across[some]], 1)):
            each = np.repeat(chosen, parts[chosen])
            if not len(each):
                continue
            other = np.arange(len(each)) - np.repeat(np.cumsum(parts[chosen]) - parts[chosen], parts[chosen])
            i, j = (turn[each], other) if role == 2 else (other, turn[each])
            c = _mixed(v[each].view(np.uint64) + _mixed((i << 32 | j).view(np.uint64) + np.uint64(1)))
            yield _out(table, rows[each], c.view(np.int64), w[each] | role << 1, s[each], t[each])


def alike(least: float) -> Callable:
    """For ``mapInArrow`` over rows of ``posted``, sorted by ``c, w``: ``a, b`` of sets whose classes may share the part, as far as their sketches tell. A bit that one class sets and the other doesn't is of a
    content that isn't shared. Of two rows the first has the smaller class; one at least is of the level of its own size. A pair may come more than once."""
    need = least / (1 + least)

    def starts(t):
        return changes(_column(t, "c"), _column(t, "w") >> 48)

    def run(batches):
        for table, at in whole(batches, starts):
            w, s, t = _column(table, "w"), _column(table, "s").view(np.uint64), _column(table, "t").view(np.uint64)
            k, role, finer = (w >> 8) & ((1 << 40) - 1), w >> 1 & 3, (w & 1).astype(bool)
            part = k * need - _SURE
            size = np.diff(np.r_[at, len(w)])
            x = np.flatnonzero(role != 2)
            left = np.repeat(at + size, size)[x] - x - 1
            for some in np.split(np.arange(len(x)), np.flatnonzero(np.diff(np.cumsum(left) // STEP)) + 1):
                first, times = x[some], left[some]
                y = np.arange(times.sum()) + np.repeat(first + 1 - np.cumsum(times) + times, times)
                alone = np.bitwise_count(np.repeat(s[first], times) & ~s[y]) + np.bitwise_count(np.repeat(t[first], times) & ~t[y])
                left_over = np.flatnonzero(np.repeat(k[first] - part[first], times) - alone >= part[y])
                x_, y_ = np.repeat(first, times)[left_over], y[left_over]
                alone = np.bitwise_count(s[y_] & ~s[x_]) + np.bitwise_count(t[y_] & ~t[x_])
                both = (k[y_] - part[y_] - alone >= part[x_]) & (role[y_] != 1) & ~(finer[x_] & finer[y_])
                a, b = (table.column("p").take(pa.array(z[both])).combine_chunks() for z in (x_, y_))
                yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])

    return run


def asking(counts: np.ndarray) -> Callable:
    """For ``mapInArrow`` over contents of chunks: ``p, n, c, h, g`` of the first few of each chunk, by the order ``g, h, c`` of contents."""

    def run(batches):
        for table, at in whole(batches, _pieces):
            n, v, h = (_column(table, name) for name in ("n", "v", "h"))
            g, size = in_order(counts, h), np.diff(np.r_[at, len(n)])
            by = np.lexsort((v, h, g, np.repeat(np.arange(len(at)), size)))
            by = by[np.arange(len(n)) - np.repeat(at, size) < np.minimum(1 + n // 20, ASKED)]
            p = table.column("p").take(pa.array(by)).combine_chunks()
            yield pa.RecordBatch.from_arrays([p, *(pa.array(x[by]) for x in (n, v, h, g))], ["p", "n", "c", "h", "g"])

    return run


def asked(least: float, sizes: np.ndarray) -> Callable:
    """For ``mapInArrow`` over contents of chunks: ``c, p, n`` of those by which a set may have asked that is small enough to be in this one: ``sizes`` has the least size of those that ask, by hash."""

    def run(batches):
        for batch in batches:
            n, h = batch.column("n").to_numpy(), batch.column("h").to_numpy()
            rows = pa.array(np.flatnonzero(sizes[h & (BUCKETS - 1)] < least * n))
            yield pa.RecordBatch.from_arrays([batch.column(name).take(rows) for name in ("v", "p", "n")], ["c", "p", "n"])

    return run
