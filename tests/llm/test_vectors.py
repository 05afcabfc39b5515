"""Operators on vectors against plain Python: groups of copies, ties, odd rows, several shards and lengths."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from atelier.llm import neighbours, vector_codes

SCHEMA = "vec_id bigint, embedding array<double>, label int, code string, rank string"
nan, inf = math.nan, math.inf


def table(spark, rows):
    """Rows of id, vector and label, and two columns whose names the results use as well."""
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)


def some_vectors(seed, n, width):
    rng = random.Random(seed)
    one = [float(rng.randrange(-3, 4)) or 1.0 for _ in range(width)]
    out = []
    for i in range(n):
        kind = rng.randrange(6)
        v = one if kind < 2 else [2 * x for x in one] if kind == 2 else [x + rng.gauss(0, 0.01) for x in one] if kind == 3 else [rng.gauss(0, 1) for _ in range(width)]
        out.append((i if rng.random() < 0.97 else 50, v, rng.choice([None, 1, 1, 1, 2])))
    return out


ODD = [
    (1000, None, 1), (1050, [0.0] * 16, 1), (1051, [nan] + [1.0] * 15, 1), (1052, [inf] + [1.0] * 15, None), (1100, [None] + [1.0] * 15, 1), (1150, [], 1),
    (None, [1.0] * 16, 7), (1200, [-0.0] + [1.0] * 15, 7), (1201, [0.0] + [1.0] * 15, 7), (1250, [0.5] * 32, 2), (1251, [0.25] * 31 + [0.5], 2), (1300, [1.0], 3),
]


def nearest_by_hand(rows, k=5):
    """The k nearest of each row whose id 50 divides, sums taken in order."""
    held = [(i, v) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    dot = lambda a, b: math.fsum([]) + sum((x * y for x, y in zip(a, b)), 0.0)
    norm = [math.sqrt(dot(v, v)) for _, v in held]
    out = []
    for a, (i, v) in enumerate(held):
        if i % 50 == 0:
            near = sorted((-dot(v, w) / (norm[a] * norm[b]), j) for b, (j, w) in enumerate(held) if b != a and len(w) == len(v))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(near[:k], 1)]
    return out


def told(rows):
    return sorted((q, r, j, round(s, 12)) for q, r, j, s in rows)


def found(rows, **given):
    held = neighbours.numbered(rows)
    return told(map(tuple, neighbours.search(held.filter("id % 50 = 0"), neighbours.index(held, **given), k=5).collect()))


@pytest.mark.parametrize("most", [65_536, 60])
def test_search_is_exact(spark, monkeypatch, most):
    """Shards of 60 rows as well; leaves of four; blocks of three queries."""
    rows = some_vectors(3, 400, 16) + ODD
    monkeypatch.setattr(neighbours, "BLOCK", 3)
    monkeypatch.setattr(neighbours.Tree.build.__func__, "__defaults__", (4,))
    assert found(table(spark, rows), most=most) == told(nearest_by_hand(rows))


def test_one_vector_in_many_rows(spark):
    """All rows but a few hold one vector: each query's nearest are the copies with the least ids; few rows; no rows."""
    same = [(i, [1.0, 2.0, 2.0], None) for i in range(3000)] + [(3000, [1.0, 2.0, 2.1], None), (3001, [-1.0, 0.0, 0.0], None)]
    got = found(table(spark, same))
    assert got[:5] == [(0, r, r, 1.0) for r in range(1, 6)]
    assert [g[2] for g in got if g[0] == 2950] == [0, 1, 2, 3, 4] and [g[2] for g in got if g[0] == 3000] == [0, 1, 2, 3, 4]
    assert found(table(spark, same[:3])) == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    assert found(table(spark, same[:1])) == [] and found(table(spark, [])) == []


def test_large_and_small_components(spark):
    """Squares that would leave double precision."""
    rows = [(0, [3e300, 4e300], None), (1, [3e-300, 4e-300], None), (2, [1e300, 0.0], None)]
    assert found(table(spark, rows)) == [(0, 1, 1, 1.0), (0, 2, 2, 0.6)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 200), st.integers(1, 6))
def test_factor_one_loses_nothing(seed, n, k):
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-2, 3, (n, 3)).astype(float)
    vectors[~vectors.any(1)] = 1
    tree, order = neighbours.Tree.build(vectors, leaf=3)
    names = rng.permutation(n)
    got = tree.search(vectors[:7], names, k)
    v, s = neighbours.scaled(vectors[order])
    for q in range(min(7, n)):
        w, t = neighbours.scaled(vectors[[q] * n])
        score = neighbours._dots(w, v) / (np.sqrt(t) * np.sqrt(s))
        want = np.lexsort((names, -score))[:k]
        assert got.place[q][: len(want)].tolist() == want.tolist()


def test_larger_factors_look_at_less():
    """Recall and work of relaxed pruning on clusters."""
    rng = np.random.default_rng(1)
    vectors = np.repeat(rng.normal(size=(60, 24)), 100, 0) + rng.normal(size=(6000, 24)) * 0.2
    tree, order = neighbours.Tree.build(vectors, leaf=64)
    names = np.arange(6000)
    looked, recall = {}, {}
    exact = tree.search(vectors[::50], names, 5).place
    for factor in (1, 1.5, 3):
        got = tree.search(vectors[::50], names, 5, factor)
        looked[factor], recall[factor] = got.looked, np.mean([len(set(a) & set(b)) / 5 for a, b in zip(got.place, exact)])
    assert recall[1] == 1 and recall[1.5] >= 0.9 and looked[1] < 0.7 * 6000 * 120 and looked[1] > looked[1.5] > looked[3]


def codes_by_hand(rows, width):
    kept = [(i, [math.floor(256 * Fraction(x)) for x in v], y) for i, v, y in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = width // 16
    cuts = [[v[p * w : p * w + w] for p in range(16)] for _, v, _ in kept]
    books = [[c[p] for c in cuts[:64]] for p in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda c, p: min((far(c[p], e), k) for k, e in enumerate(books[p]))
    for _ in range(2):
        given = [[best(c, p)[1] for p in range(16)] for c in cuts]
        for p in range(16):
            for k in range(len(books[p])):
                if mine := [c[p] for c, g in zip(cuts, given) if g[p] == k]:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine)]
    ends = [[best(c, p) for p in range(16)] for c in cuts]
    errors = [sum(d for d, _ in e) for e in ends]
    total = {}
    for (_, _, y), e in zip(kept, errors):
        total[y] = total.get(y, 0) + e
    sha = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in e), d, total[y], sha) for (i, _, y), e, d in zip(kept, ends, errors)), key=repr)


@pytest.mark.parametrize("width", [16, 32])
@pytest.mark.parametrize("small", [True, False])
def test_codes(spark, monkeypatch, width, small):
    """Negative components, equal entries and ties, repeated ids; labels joined by a broadcast or not."""
    monkeypatch.setattr(vector_codes, "BLOCK", 37)
    if not small:
        monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    rows = some_vectors(9, 260, width) + [(5, [0.5] * 7, 1)] + ODD
    got = vector_codes.compress(table(spark, rows)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == codes_by_hand(rows, width)


def test_few_rows_and_none(spark):
    rows = some_vectors(2, 5, 16)
    got = vector_codes.compress(table(spark, rows)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == codes_by_hand(rows, 16)
    assert vector_codes.compress(table(spark, [])).count() == 0
    with pytest.raises(Exception, match="a component is past"):
        vector_codes.compress(table(spark, [(1, [1e9] * 16, 1)])).count()


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 70), st.integers(1, 5), st.sampled_from([2, 40, 2**26]))
def test_nearest_entries(seed, n, width, spread):
    """Ties, repeated entries and large numbers."""
    rng = np.random.default_rng(seed)
    entries, points = rng.integers(-spread, spread, (n, width)), rng.integers(-spread, spread, (50, width))
    which, far = vector_codes.Tree(entries, leaf=2).nearest(points)
    d = ((points[:, None] - entries[None]) ** 2).sum(-1)
    assert which.tolist() == d.argmin(1).tolist() and far.tolist() == d.min(1).tolist()


def test_codes_stand_for_vectors(spark):
    rows = some_vectors(4, 100, 16)
    numbers = vector_codes.integers(table(spark, rows))
    books = vector_codes.fit(numbers)
    back = vector_codes.decode(vector_codes.encode(numbers, books, keep=["vec_id"]), books).withColumnRenamed("embedding", "back")
    first = {r["vec_id"]: (r["back"], r["embedding"]) for r in back.join(table(spark, rows), "vec_id").filter(F.col("vec_id") != 50).collect()}
    assert len(first) >= 90 and np.mean([np.abs(np.subtract(a, b)).mean() for a, b in first.values()]) < 0.3
