"""Runs of words against a plain search of all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from atelier.llm import periodic, queries
from atelier.llm._words import Texts


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def runs_by_hand(w):
    """Start, length and period: every stretch that repeats with some period, the least period of each."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - start + q >= max(12, 2 * q):
                found.setdefault((start, i + q), q)
            i += i == start
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed_by_hand(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def measured(texts):
    n, runs, collapsed = periodic.measure(Texts.of(pa.array(texts, pa.string())))
    return [(int(a), [(r["start"], r["length"], r["period"]) for r in b], c) for a, b, c in zip(n, runs.to_pylist(), collapsed.to_pylist())]


def by_hand(text):
    w = words_of(text)
    return len(w), runs_by_hand(w), collapsed_by_hand(w, runs_by_hand(w))


def some_text(rng):
    kinds = rng.choice([1, 2, 3, 5, 50])
    w = [f"w{rng.randrange(kinds)}" for _ in range(rng.choice([0, 5, 12, 13, 30, 80, 200]))]
    for _ in range(rng.randrange(4)):
        if len(w) > 3:
            at = rng.randrange(len(w))
            size = rng.randrange(1, min(20, len(w) - at) + 1)
            w[at : at + size] = w[at : at + size] * rng.randrange(1, 6)
    for _ in range(rng.randrange(3)):
        if len(w) > 3:
            at = rng.randrange(len(w))
            w += w[at : rng.randrange(at, len(w))]
    for _ in range(rng.randrange(3)):
        if w:
            w[rng.randrange(len(w))] = "é中"
    return rng.choice([" ", "\n", " \t\n"]).join(w) + rng.choice(["", " ", "\n"])


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9))
def test_all_runs_are_found(seed):
    rng = random.Random(seed)
    texts = [some_text(rng) for _ in range(rng.randrange(1, 8))]
    assert measured(texts) == [by_hand(t) for t in texts]


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return " ".join(b[:n])


ODD = [
    None, "", " \n ", "one", "a " * 11, "a " * 12, "a b " * 6, "ab" * 100, "  " * 30, "x　y " * 14, fibonacci(600),
    " ".join(bin(i).count("1") % 2 and "a" or "b" for i in range(700)), "a b c d e f " * 2, "a b c d e f g " * 2, "A a " * 20, "é " * 40, "say it\n" * 50, "say it\n" * 50,
    "a " * 50 + "b " + "a " * 50, ("a " * 20 + "b ") * 20, ("p q r s t u v w x y z " * 3 + "stop ") * 4,
]


def test_odd_texts(monkeypatch):
    assert measured(ODD) == [by_hand(t) for t in ODD]
    monkeypatch.setattr(periodic, "CHUNK", 7)
    assert measured(ODD) == [by_hand(t) for t in ODD]
    assert measured([]) == []


def test_very_long_texts():
    """A million words: one word over and over, a long period, prose without a repeat."""
    n = 1_000_000
    size, runs, collapsed = measured(["a " * n])[0]
    assert (size, runs, collapsed) == (n, [(0, n, 1)], "a")
    period = " ".join(f"w{i}" for i in range(99_999))
    size, runs, collapsed = measured([" ".join([period] * 10)])[0]
    assert runs == [(0, 999_990, 99_999)] and collapsed == period
    assert measured([" ".join(f"w{i}" for i in range(n))])[0][1] == []


def test_operator_and_query(spark, tmp_path):
    """Real outputs with clashing columns, and the digests of the query against plain Python."""
    rng = random.Random(3)
    texts = ODD + [some_text(rng) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)] + [(None, "a " * 30, "x", 5), (7, "b " * 30, "x", 5)], "doc_id bigint, text string, runs string, n_words int").repartition(3)
    rows = {r["doc_id"]: r for r in periodic.detect(docs).collect() if r["doc_id"] != 7}
    assert [(rows[i]["n_words"], [tuple(x) for x in rows[i]["runs"]], rows[i]["collapsed"]) for i in range(len(texts)) if i != 7] == [by_hand(t) for i, t in enumerate(texts) if i != 7]
    docs.drop("runs", "n_words").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert len(got) == len(texts) + 2
    planted = 0
    for r in got:
        if r["doc_id"] in (None, 7):
            continue
        w = words_of(texts[r["doc_id"]])
        h = zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w, planted = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))], planted + 1
        runs = runs_by_hand(w)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want = (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed_by_hand(w, runs)))
        assert tuple(r[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) == want
    assert planted > 5
    nothing = str(tmp_path / "none")
    docs.drop("runs", "n_words").filter(F.lit(False)).write.parquet(f"{nothing}/documents.parquet")
    assert queries.op11_periodic_runs(spark, nothing).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_previous_factors(seed):
    rng = np.random.default_rng(seed)
    words = rng.integers(0, 3, 60)
    ranks = periodic.Ranks(words, np.zeros(60, np.int64))
    order = ranks.suffixes.tolist()
    assert order == sorted(range(60), key=lambda i: words[i:].tolist())
    agree = lambda i, j: next((k for k in range(60 - max(i, j)) if words[i + k] != words[j + k]), 60 - max(i, j))
    common = [0] + [agree(a, b) for a, b in zip(order, order[1:])]
    longest, source = periodic.previous_factors(order, common)
    for i in range(60):
        assert longest[i] == max((agree(i, j) for j in range(i)), default=0)
        assert source[i] == -1 if longest[i] == 0 and source[i] == -1 else source[i] < i and agree(i, source[i]) == longest[i]
