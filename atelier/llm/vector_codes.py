"""Compression of vectors into one code a part, with exact nearest entries.

Components become integers, vectors are cut into equal parts, and each part position has a
codebook. The nearest entry of a part is found in a vantage-point tree over the entries of that position:
distances to a vantage entry bound those to the entries below it (triangle inequality). Radii are
rounded outwards and a branch is visited if its bound equals the best distance so far, so a branch is only left out
if no entry in it can win or tie; what decides is the squared distance in integers, ties to the lower index.

A round assigns every part and moves each entry to the floored mean of its parts. Tasks sum what they have
read, so a round shuffles as many rows as there are entries and tasks, and the driver gets the sums of the entries alone.

Rows whose vector is null or holds a null, NaN or infinite component are left out, as are vectors of another length than
the commonest (ties to the longer; of lengths that can be cut into equal parts, 0 excluded). A component past ``LARGEST`` is an error,
as sums of squares would leave 64 bits. Null ids come last in order; of rows with one id the smaller vector comes first, and each is a row of
its own. Fewer rows than entries give a smaller codebook; an empty table gives an empty result. A column that bears the name of a new one is replaced.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scratch import cut
from ._arrow import bounded

PARTS, ENTRIES, ROUNDS, SCALE, LEAF = 16, 64, 2, 256, 8
#: Largest component: squares of differences of 2**27, and sums of 500 of them, fit in 64 bits.
LARGEST = float(1 << 18)
#: Labels up to which their sums are broadcast; beyond, they are joined by a shuffle that Spark splits where one is hot.
BROADCAST_LABELS = 100_000
#: Rows worked on at a time.
BLOCK = 4096


class Tree:
    """A vantage-point tree over the entries of one part position."""

    def __init__(self, entries: np.ndarray, leaf: int = LEAF):
        self.entries, self.leaf = entries.astype(np.int64), leaf
        self.root = self._node(np.arange(len(entries)))

    def _node(self, members: np.ndarray) -> tuple:
        if len(members) <= self.leaf:
            return (np.sort(members),)
        from_first = self._squared(self.entries[members], self.entries[members[0]])
        pivot = self.entries[members[np.argmax(from_first)]]
        d = self._squared(self.entries[members], pivot)
        order = np.argsort(d, kind="stable")
        half = len(members) // 2
        sides = []
        for side in (order[:half], order[half:]):
            low, high = np.sqrt(d[side[0]].astype(float)), np.sqrt(d[side[-1]].astype(float))
            sides.append((np.nextafter(low, -1), np.nextafter(high, np.inf), self._node(members[side])))
        return pivot, sides

    @staticmethod
    def _squared(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
        return ((points - entry) ** 2).sum(-1)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each point, and the squared distance."""
        points = points.astype(np.int64)
        best, which = np.full(len(points), np.iinfo(np.int64).max), np.full(len(points), len(self.entries))
        self._visit(self.root, points, np.arange(len(points)), best, which)
        return which, best

    def _visit(self, node: tuple, points: np.ndarray, rows: np.ndarray, best: np.ndarray, which: np.ndarray) -> None:
        if not len(rows):
            return
        if len(node) == 1:
            d = ((points[rows, None, :] - self.entries[node[0]][None]) ** 2).sum(-1)
            at = d.argmin(1)  # the first of equals, and members are in order
            d, entry = d[np.arange(len(rows)), at], node[0][at]
            better = (d < best[rows]) | ((d == best[rows]) & (entry < which[rows]))
            best[rows[better]], which[rows[better]] = d[better], entry[better]
            return
        pivot, (inner, outer) = node
        d = np.sqrt(self._squared(points[rows], pivot).astype(float))
        inside = 2 * d <= inner[1] + outer[0]
        below, above = np.nextafter(d, -1), np.nextafter(d, np.inf)
        for first in (True, False):  # the side where each point lies, then the other
            for side, on in ((inner, inside), (outer, ~inside)):
                bound = np.maximum(side[0] - above, below - side[1])
                near = on if first else ~on
                reach = bound <= np.nextafter(np.sqrt(best[rows].astype(float)), np.inf)
                self._visit(side[2], points, rows[near & reach], best, which)


@dataclass
class Codebooks:
    """``entries[part, entry, position]``, integers."""

    entries: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(table: DataFrame, vector: str = "embedding", parts: int = PARTS) -> DataFrame:
    """The rows that take part, ``vector`` replaced by its integers; written to the shared folder, as each round reads it."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    x = F.col(f"`{vector}`")
    fit = table.filter(x.isNotNull() & (F.size(x) > 0) & (F.size(x) % parts == 0) & F.forall(x, lambda v: good(v.cast("double"))))
    length = fit.groupBy(F.size(x).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    whole = lambda v: F.when(F.abs(v) <= LARGEST, F.floor(v.cast("double") * SCALE).cast("int")).otherwise(F.raise_error(F.lit(f"a component is past {LARGEST:.0f}")).cast("int"))
    return cut(fit.filter(F.size(x) == (length["n"] if length else 0)).withColumn(vector, F.transform(x, whole)))


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    """Rows, parts, positions."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), parts, -1)


def _assigned(values: np.ndarray, trees: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
    codes, far = np.zeros(values.shape[:2], np.int64), np.zeros(values.shape[:2], np.int64)
    for p, tree in enumerate(trees):
        codes[:, p], far[:, p] = tree.nearest(values[:, p])
    return codes, far


def fit(numbers: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of the table that ``integers`` made; None if it is empty."""
    first = [r[0] for r in numbers.select(vector, key).orderBy(F.col(key).asc_nulls_last(), vector).limit(entries).collect()]
    if not first:
        return None
    books = np.array(first, np.int64).reshape(len(first), parts, -1).swapaxes(0, 1)
    width = books.shape[2]
    for _ in range(rounds):

        def summed(batches, books=books):
            trees = [Tree(b) for b in books]
            n, totals = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
            for batch in batches:
                for begin in range(0, batch.num_rows, BLOCK):
                    values = _matrix(batch.column(0).slice(begin, BLOCK), len(books)).astype(np.int64)
                    codes, _ = _assigned(values, trees)
                    for p in range(len(books)):
                        n[p] += np.bincount(codes[:, p], minlength=len(n[p]))
                        np.add.at(totals[p], codes[:, p], values[:, p])
            p, e = np.nonzero(n)
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(totals[p, e].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "totals"])

        made = bounded(numbers).select(vector).mapInArrow(summed, "part int, entry int, n bigint, totals array<bigint>")
        sums = made.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("totals")[i]) for i in range(width))).alias("totals"))
        books = books.copy()
        for r in sums.collect():  # a row an entry at most
            books[r["part"], r["entry"]] = [t // r["n"] for t in r["totals"]]
    return Codebooks(books)


def encode(numbers: DataFrame, books: Codebooks, vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all but the vector unless given), ``code`` (two hex digits a part) and ``error`` (sum of squared distances)."""
    kept = [c for c in (numbers.columns if keep is None else keep) if c not in (vector, "code", "error")]
    entries = books.entries
    schema = T.StructType([*(numbers.schema[c] for c in kept), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches):
        trees = [Tree(b) for b in entries]
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(begin, BLOCK)
                codes, far = _assigned(_matrix(piece.column(len(kept)), len(entries)), trees)
                text = [row.tobytes().hex() for row in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(kept)], pa.array(text, pa.string()), pa.array(far.sum(1))], [*kept, "code", "error"])

    return bounded(numbers).select(*(numbers[f"`{c}`"] for c in (*kept, vector))).mapInArrow(run, schema)


def decode(coded: DataFrame, books: Codebooks, code: str = "code", vector: str = "embedding") -> DataFrame:
    """``coded`` with the vector that each code stands for, in the original scale (the middle of its step)."""
    entries = books.entries
    schema = T.StructType([*(f for f in coded.schema if f.name != vector), T.StructField(vector, T.ArrayType(T.DoubleType()))])
    kept = [f.name for f in coded.schema if f.name != vector]

    def run(batches):
        for batch in batches:
            codes = np.array([list(bytes.fromhex(c)) for c in batch.column(kept.index(code)).to_pylist()], np.int64).reshape(batch.num_rows, len(entries))
            made = (entries[np.arange(len(entries)), codes].reshape(batch.num_rows, -1) + 0.5) / SCALE
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(made), pa.list_(pa.float64()))], [*kept, vector])

    return bounded(coded).select(*(coded[f"`{c}`"] for c in kept)).mapInArrow(run, schema)


def compress(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``key, label, code, error, label_error, codebooks_sha256`` of each row that takes part."""
    numbers = integers(table.select(key, label, vector), vector)
    books = fit(numbers, key, vector)
    empty = Codebooks(np.zeros((PARTS, 1, 1), np.int64))
    coded = cut(encode(numbers, books or empty, vector))
    sums = cut(coded.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error")))
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    out = coded.join(sums, F.col(label).eqNullSafe(F.col("_label")), "left")
    return out.select(key, label, "code", "error", "label_error", F.lit((books or empty).sha256()).alias("codebooks_sha256"))
