"""Hashes that agree on some of their bands, compared block by block inside tasks.

Rows are posted under keys of equal bands and dealt by key; a task compares those of one key as arrays. A key of many rows is dealt out as cells of at most some ``BLOCK`` rows and
as many columns, so no task holds more, whatever the key."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows (and columns) of a cell, and rows of a key of which each two are taken without a look at what connects them.
BLOCK, SMALL = 2048, 24
#: Pairs that are looked at in one step, and postings that a task takes.
STEP, A_TASK = 1 << 21, 1 << 18


def signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def dealt(rows: DataFrame, sets: list[tuple[int, int]], n: int, turn: str, column: Column | None = None) -> DataFrame:
    """``rows`` (with a hash ``h``) under each key of ``sets``, sorted by ``bands, v, i, j``: a cell. ``role`` is 0 for a row of the cell, 1 for a column, 2 for both; all rows may be columns, or those of ``column``.
    ``n`` bounds the rows, ``turn`` is what cells of a large key are dealt by."""
    keys = F.array(*(F.struct(F.lit(chosen).alias("bands"), F.col("h").bitwiseAND(F.lit(signed(mask)).cast("long")).alias("v")) for chosen, mask in sets))
    across = F.lit(True) if column is None else column
    posted = rows.select("*", across.alias("_across"), F.inline(keys))
    large = posted.groupBy("bands", "v").agg(F.count(F.lit(1)).alias("_n"), F.count_if("_across").alias("_m")).filter(F.col("_n") > BLOCK)
    parts = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK), F.lit(1)).cast("int")
    cells = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.when(F.col("_across"), 2).otherwise(0).alias("role")))
    if large.limit(1).count():  # one in BLOCK postings at most
        own = lambda c: F.pmod(F.xxhash64(turn), parts(c)).cast("int")
        cell = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), F.lit(role).alias("role"))
        wide = F.transform(F.sequence(F.lit(0), parts("_m") - 1), lambda j: cell(own("_n"), j, 0))
        high = F.transform(F.sequence(F.lit(0), parts("_n") - 1), lambda i: cell(i, own("_m"), 1))
        posted = posted.join(F.broadcast(large), ["bands", "v"], "left")
        cells = F.when(F.col("_n").isNull(), cells).when(F.col("_across"), F.concat(wide, high)).otherwise(wide)
    posted = posted.select(*rows.columns, "bands", "v", F.inline(cells))
    spark = rows.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-n * len(sets) // A_TASK))
    return posted.repartition(tasks, "bands", "v", "i", "j").sortWithinPartitions("bands", "v", "i", "j")


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole cells, and where each cell starts (and the last ends)."""
    held: list[pa.RecordBatch] = []

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        for name in ("bands", "v", "i", "j"):
            c = t.column(name).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        return np.r_[0, np.flatnonzero(new), t.num_rows]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        at = starts(t)
        if len(at) > 2:
            yield t.slice(0, at[-2]).combine_chunks(), at[:-1]
            held = t.slice(at[-2]).to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, starts(t)


def each_two(at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of each two rows of a cell, the first before the second, for the cells from ``at[:, 0]`` to ``at[:, 1]``, some ``STEP`` at once."""
    rows = np.concatenate([np.arange(a, b) for a, b in at]) if len(at) else np.zeros(0, int)
    left = np.repeat(at[:, 1], at[:, 1] - at[:, 0]) - rows - 1
    for some in np.array_split(np.arange(len(rows)), max(1, int(left.sum()) // STEP)):
        x = np.repeat(rows[some], left[some])
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(left[some]) - left[some], left[some])
        yield x, y


def near_in_cells(sets: list[tuple[int, int]], distance: int, name: str | None = None) -> Callable:
    """For ``mapInArrow``: ``x, y, dist`` of hashes within the distance, x < y, under the first key that they share only; and ``_x, _y``, what they have in column ``name``."""
    count = max(chosen for chosen, _ in sets).bit_length()
    single = [np.uint64(functools.reduce(int.__and__, [mask for chosen, mask in sets if chosen >> i & 1])) for i in range(count)]
    upto = np.array([(1 << k.bit_length()) - 1 for k in range(1 << count)])

    def run(batches):
        for table, at in whole_cells(batches):
            h, role, bands = table.column("h").to_numpy(), table.column("role").to_numpy(), table.column("bands").to_numpy()
            bits = h.view(np.uint64)

            def out(x, y):
                differ = bits[x] ^ bits[y]
                equal = sum(((differ & m) == 0).astype(np.int64) << i for i, m in enumerate(single))
                first = equal & upto[bands[x]] == bands[x]
                x, y, dist = x[first], y[first], np.bitwise_count(differ[first]).astype(np.int32)
                x, y = np.where(h[x] < h[y], x, y), np.where(h[x] < h[y], y, x)
                names = [] if name is None else [table.column(name).take(pa.array(at)).combine_chunks() for at in (x, y)]
                return pa.RecordBatch.from_arrays([pa.array(h[x]), pa.array(h[y]), pa.array(dist), *names], ["x", "y", "dist", "_x", "_y"][: 3 + len(names)])

            ends, size = np.c_[at[:-1], at[1:]], np.diff(at)
            whole = role[at[:-1]] == 2
            for x, y in each_two(ends[(size > 1) & (size <= SMALL) & whole]):
                near = np.bitwise_count(bits[x] ^ bits[y]) <= distance
                yield out(x[near], y[near])
            for a, b in ends[(size > SMALL) | ~whole]:
                rows, cols = a + np.flatnonzero(role[a:b] != 1), a + np.flatnonzero(role[a:b] != 0)
                step = max(1, STEP // max(1, len(cols)))
                for k in range(0, len(rows), step):
                    some = rows[k : k + step]
                    x, y = np.nonzero(np.bitwise_count(bits[some, None] ^ bits[None, cols]) <= distance)
                    x, y = some[x], cols[y]
                    once = h[x] < h[y]
                    yield out(x[once], y[once])

    return run


def forest(near: np.ndarray, dist: np.ndarray) -> Iterator[tuple[int, int]]:
    """Of the links between rows and columns (``near``) some that connect the same: a tree for each part, each of its rows first in one of them at least, and its longest link."""
    far = np.where(near, dist + 1, 0)
    best, most = far.argmax(1), far.max(1)
    open_rows, open_cols = near.any(1), near.any(0)
    while open_cols.any():
        edge = np.array([open_cols.argmax()])
        open_cols[edge] = False
        part = []
        while len(edge):
            rows = np.flatnonzero(near[:, edge].any(1) & open_rows)
            if not len(rows):
                break
            open_rows[rows] = False
            part.append(rows)
            yield from zip(rows, edge[near[np.ix_(rows, edge)].argmax(1)])
            edge = np.flatnonzero(near[rows].any(0) & open_cols)
            open_cols[edge] = False
            yield from zip(rows[near[np.ix_(rows, edge)].argmax(0)], edge)
        rows = np.concatenate(part)
        x = rows[most[rows].argmax()]
        yield x, best[x]


def links_in_cells(distance: int) -> Callable:
    """For ``mapInArrow``: ``a, b, dist`` of links that connect what the near rows and columns of each cell connect. Rows have k, h, s, g, free (in no group), l and full: what is of one label ``l`` is
    connected already, and if that is full, its longest link is known as well."""

    def run(batches):
        for table, at in whole_cells(batches):
            bits, role = table.column("h").to_numpy().view(np.uint64), table.column("role").to_numpy()
            code = {c: pc.dictionary_encode(table.column(c).combine_chunks()).indices.to_numpy() for c in ("s", "g", "l")}
            s, g, label = code["s"], code["g"], code["l"]
            free, full, k = table.column("free").to_numpy(), table.column("full").to_numpy(), table.column("k")

            def near(x, y):
                dist = np.bitwise_count(bits[x] ^ bits[y])
                return (dist <= distance) & (s[x] != s[y]) & (free[x] | (g[x] != g[y])) & ((label[x] != label[y]) | ~full[x]), dist

            def out(x, y):
                return pa.RecordBatch.from_arrays([k.take(pa.array(x)).combine_chunks(), k.take(pa.array(y)).combine_chunks(), pa.array(np.bitwise_count(bits[x] ^ bits[y]).astype(np.int32))], ["a", "b", "dist"])

            ends, size = np.c_[at[:-1], at[1:]], np.diff(at)
            low, high = np.minimum.reduceat(label, at[:-1]), np.maximum.reduceat(label, at[:-1])
            some = (size > 1) & ~((low == high) & full[at[:-1]])
            for x, y in each_two(ends[some & (size <= SMALL)]):
                ok = near(x, y)[0] & ((role[x] != 1) & (role[y] != 0) | (role[y] != 1) & (role[x] != 0))
                x, y = x[ok], y[ok]
                turned = (role[x] == 1) | (role[y] == 0)
                yield out(np.where(turned, y, x), np.where(turned, x, y))
            for a, b in ends[some & (size > SMALL)]:
                rows, cols = a + np.flatnonzero(role[a:b] != 1), a + np.flatnonzero(role[a:b] != 0)
                common = np.bincount(label[a:b] - label[a:b].min()).argmax() + label[a:b].min()
                done = full[a:b][label[a:b] == common][0]
                ours, theirs = (label[rows] != common) | ~done, (label[cols] != common) | ~done
                blocks = [(rows[ours], cols), (rows[~ours], cols[theirs])]
                pairs = []
                for r, c in blocks:
                    if len(r) and len(c):
                        pairs += [(r[x], c[y]) for x, y in forest(*near(r[:, None], c[None, :]))]
                if pairs:
                    x, y = np.array(pairs).T
                    yield out(x, y)

    return run
