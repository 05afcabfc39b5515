"""Nearest vectors by cosine, from vantage-point trees over shards of the rows.

Every row goes to a shard by a hash, and each shard gets a tree of its own: vectors of length one,
split again and again by their distance to a vantage point. On such vectors the distance is a metric
and falls as the cosine rises, so the triangle inequality bounds what a branch can hold. A branch is left out if its bound,
times ``factor``, is beyond the k-th nearest so far: factor one is exact, larger factors look at less and may miss. Bounds
carry a margin for rounding. What remains is scored on the original vectors in double precision, component by component in order, so that equal
vectors have equal scores wherever they lie.

Vectors that are equal within a shard share a place in its tree, which lists all their rows, so a large group of copies costs one place.
Each query meets each shard: queries are dealt into parts of ``PART`` rows, and a task holds one part and one shard, both of bounded size.

Vectors that are null, zero, empty, or hold a null, NaN or infinite component take no part, nor do rows without an id; vectors of
different length are never near each other. Rows are told apart by their place, not by id: repeated rows are neighbours of each other, under the same id. Ties go to the smaller id. Fewer
candidates than ``k`` give all of them; an empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.scratch import cut

#: Rows of a shard: at most and at least; between them there are as many shards as cores.
MOST, LEAST = 65_536, 2_048
#: Queries that a task holds, that go through a tree together, and vectors of a leaf.
PART, BLOCK, LEAF = 16_384, 1024, 256
#: What rounding may do to distances and cosines of vectors of length one.
MARGIN, NOISE = 1e-7, 1e-12

INDEX = "dim int, shard int, vectors array<{0}>, owner array<int>, rows array<bigint>, ids array<bigint>, begin array<int>, end array<int>, pivot array<int>, inner array<int>, low array<double>, high array<double>"
FOUND = "query bigint, query_id bigint, vec_id bigint, row bigint, score double"


def valid(x: Column) -> Column:
    """Whether a vector takes part."""
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.coalesce(x.isNotNull() & F.forall(x, lambda v: good(v.cast("double"))) & F.exists(x, lambda v: v != 0), F.lit(False))


def numbered(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``row, id, dim, vector`` of the rows that take part, written to the shared folder so that a row's number stays."""
    x = F.col(f"`{vector}`")
    rows = table.filter(F.col(key).isNotNull() & valid(x))
    return cut(rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.size(x).alias("dim"), x.alias("vector")))


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In double precision, divided by a power of two each so that squares stay finite, and the sums of squares in order."""
    v = vectors.astype(np.float64)
    v = np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])
    return v, _dots(v, v)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows side by side: products summed component by component, whatever the size of the block."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def _distance(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosines))


class Tree:
    """Vectors in the order of the tree; node i holds those from ``begin[i]`` to ``end[i]``, its children are
    ``inner[i]`` and the node after that (0: a leaf), and ``low`` to ``high`` are the distances of its vectors to its parent's pivot."""

    def __init__(self, vectors: np.ndarray, begin, end, pivot, inner, low, high):
        self.vectors = vectors
        self.exact, self.squares = scaled(vectors)
        self.unit = self.exact / np.sqrt(self.squares)[:, None]
        self.begin, self.end, self.pivot, self.inner, self.low, self.high = begin, end, pivot, inner, low, high

    @classmethod
    def build(cls, vectors: np.ndarray, leaf: int = LEAF) -> tuple["Tree", np.ndarray]:
        """The tree, and the vectors' former places in its order."""
        exact, squares = scaled(vectors)
        unit = exact / np.sqrt(squares)[:, None]
        order = np.arange(len(vectors))
        nodes = [[0, len(vectors), 0, 0, 0.0, 2.0]]
        at = 0
        while at < len(nodes):
            a, b = nodes[at][:2]
            if b - a > leaf:
                own = order[a:b]
                pivot = own[np.argmin(unit[own] @ unit[own[0]])]  # the farthest from any one
                d = _distance(unit[own] @ unit[pivot])
                by = np.argsort(d, kind="stable")
                order[a:b], d = own[by], d[by]
                half = (b - a) // 2
                nodes[at][2:4] = [pivot, len(nodes)]
                nodes += [[a, a + half, 0, 0, d[0], d[half - 1]], [a + half, b, 0, 0, d[half], d[-1]]]
            at += 1
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        begin, end, pivot, inner, low, high = (np.array(x) for x in zip(*nodes))
        return cls(vectors[order], begin, end, np.where(inner > 0, place[pivot], 0), inner, low, high), order

    def search(self, queries: np.ndarray, names: np.ndarray, k: int, factor: float = 1.0) -> "Found":
        """The ``k`` nearest places of each query; ties go to the smaller of ``names``, one of each place."""
        found = Found(self, queries, names, k, factor)
        found.descend(0, np.arange(len(queries)))
        found.visit(0, np.arange(len(queries)), np.zeros(len(queries)))
        return found


class Found:
    """The nearest places of a block of queries: ``place`` (-1: none) and ``score``, nearest first."""

    def __init__(self, tree: Tree, queries: np.ndarray, names: np.ndarray, k: int, factor: float):
        self.tree, self.names, self.k, self.factor, self.looked = tree, names, k, factor, 0
        self.exact, self.squares = scaled(queries)
        self.unit = self.exact / np.sqrt(self.squares)[:, None]
        self.place, self.score = np.full((len(queries), k), -1), np.full((len(queries), k), -np.inf)
        self.home = np.full(len(queries), -1)

    def descend(self, node: int, rows: np.ndarray) -> None:
        """Each query looks first where it lies itself."""
        t = self.tree
        if not len(rows):
            return
        if not (inner := t.inner[node]):
            self.home[rows] = node
            return self.leaf(t.begin[node], t.end[node], rows)
        inside = 2 * _distance(self.unit[rows] @ t.unit[t.pivot[node]]) <= t.high[inner] + t.low[inner + 1]
        self.descend(inner, rows[inside])
        self.descend(inner + 1, rows[~inside])

    def visit(self, node: int, rows: np.ndarray, bound: np.ndarray) -> None:
        """All other leaves, but those that ``bound`` shows to be too far: how near at least the vectors of the node can be."""
        t = self.tree
        reach = self.factor * bound <= _distance(self.score[rows, -1]) + MARGIN
        rows, bound = rows[reach], bound[reach]
        if not (inner := t.inner[node]):
            rows = rows[self.home[rows] != node]
            return self.leaf(t.begin[node], t.end[node], rows) if len(rows) else None
        if len(rows):
            d = _distance(self.unit[rows] @ t.unit[t.pivot[node]])
            for child in (inner, inner + 1):
                nearer = np.maximum(d - t.high[child], t.low[child] - d) - MARGIN
                self.visit(child, rows, np.maximum(bound, nearer))

    def leaf(self, begin: int, end: int, rows: np.ndarray) -> None:
        """The products of a block tell which pairs can count; those are scored exactly."""
        t = self.tree
        self.looked += len(rows) * (end - begin)
        near = self.unit[rows] @ t.unit[begin:end].T
        least = self.score[rows, -1]
        if end - begin > self.k:
            least = np.maximum(least, np.partition(near, end - begin - self.k, 1)[:, -self.k])
        q, p = np.nonzero(near >= (least - NOISE)[:, None])
        p += begin
        exact = _dots(self.exact[rows[q]], t.exact[p]) / (np.sqrt(self.squares[rows[q]]) * np.sqrt(t.squares[p]))
        q = np.concatenate([np.repeat(np.arange(len(rows)), self.k), q])
        p = np.concatenate([self.place[rows].ravel(), p])
        s = np.concatenate([self.score[rows].ravel(), exact])
        order = np.lexsort((self.names[p], -s, q))
        q, p, s = q[order], p[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        held = rank < self.k
        self.place[rows], self.score[rows] = p[held].reshape(-1, self.k), s[held].reshape(-1, self.k)


def _rows(column) -> np.ndarray:
    """A matrix from lists of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def index(rows: DataFrame, most: int = MOST, least: int = LEAST) -> DataFrame:
    """A tree for each shard of a ``numbered`` table, all its rows in it. Written to the shared folder."""
    n = rows.count()
    shards = max(1, -(-n // most), min(n // least, rows.sparkSession.sparkContext.defaultParallelism))
    schema = INDEX.format(rows.schema["vector"].dataType.elementType.simpleString())

    def build(key, table):
        vectors = _rows(table["vector"]) + 0  # no negative zeros
        ids, row = table["id"].to_numpy(), table["row"].to_numpy()
        kinds, of = np.unique(np.ascontiguousarray(vectors).view(f"V{vectors.dtype.itemsize * vectors.shape[1]}").ravel(), return_inverse=True)
        first = np.zeros(len(kinds), np.int64)
        first[of[::-1]] = np.arange(len(of))[::-1]
        tree, order = Tree.build(vectors[first])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        owner = place[of]
        by = np.lexsort((row, ids, owner))
        lists = [tree.vectors.ravel(), owner[by], row[by], ids[by], tree.begin, tree.end, tree.pivot, tree.inner, tree.low, tree.high]
        types = [f.type.value_type for f in layout if pa.types.is_list(f.type)]
        columns = [pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32())]
        columns += [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x).cast(t)) for x, t in zip(lists, types)]
        return pa.Table.from_arrays(columns, names=layout.names)

    layout = to_arrow_schema(StructType.fromDDL(schema))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    return cut(dealt.groupBy("dim", "shard").applyInArrow(build, schema))


def search(queries: DataFrame, trees: DataFrame, k: int = 5, factor: float = 1.0, part: int = PART) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` (of a ``numbered`` table) the nearest rows of the index other than itself."""
    parts = max(1, -(-queries.count() // part))
    shards = 1 + (trees.agg(F.max("shard")).first()[0] or 0)
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")).withColumn("shard", upto(shards))
    held = trees.withColumn("part", upto(parts))

    def run(key, asked, held):
        if not asked.num_rows or not held.num_rows:
            return pa.Table.from_batches([], schema=out)
        array = lambda c: held[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        begin = array("begin")
        vectors = array("vectors").reshape(-1, key[0].as_py())
        tree = Tree(vectors, begin, *(array(c) for c in ("end", "pivot", "inner", "low", "high")))
        owner, rows, ids = array("owner"), array("rows"), array("ids")
        first = np.searchsorted(owner, np.arange(len(vectors) + 1))
        row, name, wanted = asked["row"].to_numpy(), asked["id"].to_numpy(), _rows(asked["vector"])
        made = []
        for at in range(0, len(row), BLOCK):
            found = tree.search(wanted[at : at + BLOCK], ids[first[:-1]], k + 1, factor)  # one more, as a query may find itself
            q, slot = np.nonzero(found.place >= 0)
            p, s = found.place[q, slot], found.score[q, slot]
            n = np.minimum(first[p + 1] - first[p], k + 1)  # of rows that share a place the first by id
            each = np.repeat(np.arange(len(p)), n)
            owned = first[p][each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            q, s = q[each] + at, s[each]
            other = rows[owned] != row[q]
            q, s, owned = q[other], s[other], owned[other]
            order = np.lexsort((rows[owned], ids[owned], -s, q))
            q, s, owned = q[order], s[order], owned[order]
            best = np.arange(len(q)) - np.searchsorted(q, q) < k
            q, s, owned = q[best], s[best], owned[best]
            made.append(pa.table([row[q], name[q], ids[owned], rows[owned], s], names=out.names))
        return pa.concat_tables(made)

    out = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.float64())])
    by = ("dim", "shard", "part")
    near = asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(run, FOUND)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
