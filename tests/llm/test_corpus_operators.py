"""Operators over whole tables against plain Python, with hot groups and odd rows."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from atelier.llm import near_duplicates, sharding, url_filters
from atelier.llm.queries import QUERIES
from atelier.llm.sql import ORACLES

from ..compare import database, rows_of_spark, rows_of_sql


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, folder, name):
    names, rows = rows_of_spark(QUERIES[name](spark, folder))
    want_names, want = rows_of_sql(database(folder), ORACLES[name])
    assert names == want_names and rows == want


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups_by_hand(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if x == old else x for x in label]
    least = {}
    for (key, _), x in zip(rows, label):
        least[x] = min(filter(lambda v: v is not None, [least.get(x), key]), default=None)
    return sorted((key, len(s), least[x], key == least[x]) for (key, _), s, x in zip(rows, sets, label))


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates_lose_no_link(spark, monkeypatch, block):
    """A large group of near copies with one to twelve edits, exact copies, a passage in most texts."""
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    rng = random.Random(5)
    say = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(n)]
    base, passage, texts = say(120), say(50), []
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 5, 12])):
            copy[rng.randrange(len(copy))] = say(1)[0]
        texts.append(" ".join(copy))
    texts += [" ".join(base).upper()] * 5 + [" ".join(say(40) + passage + say(20)) for _ in range(40)] + [" ".join(say(n)) for n in (1, 2, 4, 5, 6)] * 2
    texts += ["a b", "a b", "a  B", None, "", " \n", "x " * 20_000]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 100))
    table = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("component_id", F.lit("clash"))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates.classes(table).collect())
    assert got == groups_by_hand(rows)


def test_near_duplicates_of_chains(spark):
    """Revisions in random order, each similar to the next only, and a centre whose copies are linked beside it as well."""
    rng = random.Random(6)
    text, texts = [f"w{i}" for i in range(120)], []
    for k in range(100):
        texts.append(" ".join(text))
        text[(8 * k) % 120] = f"x{k}"
    centre = [f"c{i}" for i in range(120)]
    for k in range(30):
        copy = list(centre)
        for i in range(k % 5):
            copy[(k // 5 * 20 + i * 23) % 120] = f"d{k // 2}{i}"
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    rows = list(enumerate(texts, 1))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == groups_by_hand(rows)


def test_near_duplicates_of_odd_tables(spark):
    table = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (7, None)], "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates.classes(table).collect()), key=repr)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, 1, False), (None, None, True), (7, 7, True)], key=repr)
    assert near_duplicates.classes(table.limit(0)).count() == 0


def test_near_duplicates_of_a_lower_threshold(spark):
    """Ten words in the place of the last ten of 104: 90 shingles are shared, of 110 in all, 0.818."""
    one = [f"w{i}" for i in range(104)]
    two = one[:94] + [f"x{i}" for i in range(10)]
    a, b = (shingles(" ".join(x)) for x in (one, two))
    assert (len(a & b), len(a | b)) == (90, 110)
    table = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two))], "doc_id bigint, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1)})
    assert near_duplicates.classes(table).filter("kept").count() == 2
    assert [r["component_id"] for r in near_duplicates.classes(table, percent=80).collect()] == [1, 1]
    assert [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, table, "").collect()] == [1]


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (3, 3)])
def test_curve_visits_neighbours(spark, dims, bits):
    cells = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=dims)), ", ".join(f"x{i} bigint" for i in range(dims)))
    for name, sql in sharding.hilbert([None] * dims, bits):
        cells = cells.withColumn(name, F.expr(sql))
    rows = sorted(((r["curve"], [r[f"x{i}"] for i in range(dims)]) for r in cells.collect()))
    assert [c for c, _ in rows] == list(range(1 << (bits * dims)))
    assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for (_, x), (_, y) in zip(rows, rows[1:]))


DIMS = [("source", "linear"), ("lang", "linear"), ("n_chars", "log")]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_shards(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "t" * rng.randrange(50), rng.choice(["en", "de", None]), "hot" if i % 3 else f"s{i % 9}", rng.choice([None, 5, 90, 4000])) for i in range(203)]
    rows += [(None, None, None, None, None), (5, "é", "en", "hot", 1), (5, "é", "en", "hot", 1)]
    table = spark.createDataFrame(rows, DOCS).withColumn("shard", F.lit("clash"))
    got = sharding.place(table, DIMS).collect()
    sizes = np.bincount([r["shard"] for r in got], minlength=8)
    assert sizes.sum() == len(rows) and sizes.max() - sizes.min() <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    line = sorted((r["shard"], r["slot"], r["curve"]) for r in got)
    assert [c for *_, c in line] == sorted(c for *_, c in line)
    want = sorted((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, *_ in rows if k is not None)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] is not None) == want
    assert sharding.place(table.limit(0), DIMS).count() == 0
    assert sorted({r["shard"] for r in sharding.place(table.limit(3), DIMS).collect()}) == [0, 1, 2]
    sharding.write(table.drop("shard"), str(tmp_path / "out"), DIMS, 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


@pytest.mark.parametrize("url, want", [
    ("http://a.Example.COM/en/1?x", ("a.example.com", "/en/1", "example.com/en/", "block")), ("http://www.example.com/en/", ("www.example.com", "/en/", "www.example.com/en/", "allow")),
    ("https://m.www.example.com/en/x#t", ("m.www.example.com", "/en/x", "www.example.com/en/", "allow")), ("http://x.com", ("x.com", "", None, "allow")), ("http://x.com/", ("x.com", "/", "com/", "allow")),
    ("http://b.net/fr/", ("b.net", "/fr/", "net/fr/", "block")), ("http://bnet/fr/", ("bnet", "/fr/", None, "allow")), ("no url", ("", "", None, "allow")), (None, ("", "", None, "allow")), ("http://x.org?a://b", ("x.org", "", None, "allow")),
])
def test_rules(spark, url, want):
    pages = spark.createDataFrame([(1, url, None)], "page_id bigint, url string, html string").withColumn("verdict", F.lit(1))
    r = url_filters.judge(pages).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == want


def test_distrust_flows_to_those_who_link(spark):
    link = lambda h: f'<a href="http://{h}/x">x</a>'
    pages = [(1, "http://bad.net/fr/1", ""), (2, "http://fan.org/a", link("bad.net") * 3), (3, "http://good.com/a", link("friend.org")), (4, "http://friend.org/b", ""), (5, "http://island.org/c", link("island.org")), (6, None, link("bad.net"))]
    got = {r["page_id"]: (r["verdict"], r["doubt"]) for r in url_filters.judge(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got[2] == ("block", 1.0) and got[4] == ("allow", 0.0) and got[5] == ("allow", 0.0) and got[1][0] == "block" and got[6][0] == "allow"
    empty = url_filters.judge(spark.createDataFrame([], "page_id bigint, url string, html string"))
    assert empty.count() == 0


def test_distrust_reaches_any_distance_from_a_small_seed(spark):
    hosts = [f"h{i}" for i in range(16)]
    links = spark.createDataFrame([*((a, b, 1) for a, b in zip(hosts, hosts[1:])), *(("h0", f"o{i}", 1) for i in range(99))], "x string, y string, n bigint")
    got = {r["host"]: r["rank"] for r in url_filters.spread(spark.createDataFrame([("far", 1 - 1e-9), ("h0", 1e-9)], "host string, weight double"), links).collect()}
    assert len(got) == 1 + 16 + 99 and got["h15"] == pytest.approx(0.15e-9 * 0.85**15 / 100, rel=1e-6)
    chain = [(0, "http://bad.net/fr/1", ""), *((i, f"http://h{i}.org/", f'<a href="http://{f"h{i - 1}.org" if i > 1 else "bad.net"}/">x</a>') for i in range(1, 15))]
    assert {r["verdict"] for r in url_filters.judge(spark.createDataFrame(chain, "page_id bigint, url string, html string")).collect()} == {"block"}


def test_ranks_by_hand(spark):
    links = spark.createDataFrame([("a", "b", 1), ("a", "c", 3), ("b", "a", 1)], "x string, y string, n bigint")
    got = {r["host"]: r["rank"] for r in url_filters.spread(spark.createDataFrame([("a", 1.0)], "host string, weight double"), links, 3).collect()}
    rank, step = {"a": 1.0}, {("a", "b"): 0.25, ("a", "c"): 0.75, ("b", "a"): 1.0}
    for _ in range(3):
        new = {"a": 0.15}
        for (x, y), share in step.items():
            if x in rank:
                new[y] = new.get(y, 0) + 0.85 * rank[x] * share
        rank = new
    assert got == pytest.approx(rank)
