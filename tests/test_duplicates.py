"""Near hashes and packs against plain Python, with hot hashes and contents."""

import itertools
import random
import re
import time
from decimal import ROUND_HALF_UP, Decimal

import pytest

from atelier.operators import duplicates


def signed(h):
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("n", [1, 1 << 16, 1 << 24, 1 << 30, 1 << 40])
def test_hash_pairs_lose_none_and_repeat_none(spark, n):
    """Keys of one to five equal bands; hashes that differ in few, neighbouring or spread bits."""
    rng = random.Random(n)
    base = [rng.getrandbits(64) for _ in range(8)] + [0, (1 << 64) - 1]
    hashes = set(base)
    for b in base:
        for _ in range(8):
            hashes.add(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 7))))
            hashes.add(b ^ ((1 << rng.randint(1, 6)) - 1) << rng.randrange(58))
    sets = duplicates.band_sets(n, 5)
    got = [tuple(r) for r in duplicates.hash_pairs(spark.createDataFrame([(signed(h),) for h in hashes], "h long"), 5, sets=sets).collect()]
    want = {(*sorted(map(signed, (a, b))), (a ^ b).bit_count()) for a, b in itertools.combinations(hashes, 2) if (a ^ b).bit_count() <= 5}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_keys_grow_more_selective():
    widths = [min(mask.bit_count() for _, mask in duplicates.band_sets(n, 5)) for n in (100, 1 << 15, 1 << 20, 1 << 25, 1 << 31)]
    assert widths == sorted(widths) and widths[0] >= 10 and widths[-1] >= 28


def parts(links):
    name = {}
    for a, b in links:
        for v in (a, b):
            name.setdefault(v, v)
        old, new = max(name[a], name[b]), min(name[a], name[b])
        name = {k: new if v == old else v for k, v in name.items()}
    return name


@pytest.mark.parametrize("seed", range(6))
def test_links_connect_what_near_images_connect(spark, seed):
    """Hashes with many contents and groups, grids of few, no groups; one component more or less would show."""
    rng = random.Random(seed)
    s, g = rng.choice([(2, 2), (2, 40), (40, 2), (6, 6), (60, 60), (1, 9)])
    hashes = [7, 7, 7, 7 ^ 1 << 40, 7 ^ 31 << 50, 1 << 62, -(1 << 63)]
    rows = [(i, rng.choice(hashes), f"s{rng.randrange(s)}", rng.choice([None, *range(g + 1)] if rng.random() < 0.8 else [1])) for i in range(250)]
    apart = lambda a, b: a[2] != b[2] and not (a[3] and a[3] == b[3]) and (a[1] % (1 << 64) ^ b[1] % (1 << 64)).bit_count() <= 5
    full = {(a[0], b[0]): (a[1] % (1 << 64) ^ b[1] % (1 << 64)).bit_count() for a, b in itertools.combinations(rows, 2) if apart(a, b)}
    got = duplicates.near_links(spark.createDataFrame(rows, "id int, phash long, sha256 string, group_id int")).collect()
    assert all(full[min(r["a"], r["b"]), max(r["a"], r["b"])] == r["dist"] for r in got)
    least = {}
    for i, *key in rows:
        least.setdefault((key[0], key[1], key[2] or 0), i)
    node = {i: least[h, c, p or 0] for i, h, c, p in rows}
    want, have = parts({(node[a], node[b]) for a, b in full}), parts({(r["a"], r["b"]) for r in got})
    assert have == want
    farthest = lambda pairs, name: {c: max(d for (a, _), d in pairs.items() if name[node[a]] == c) for c in set(name.values())}
    assert farthest({(r["a"], r["b"]): r["dist"] for r in got}, have) == farthest(full, want)


def test_a_hash_of_very_many_images(spark):
    """100,000 images of one hash: of one group, of no group, of one content each; none costs a pair of each two."""
    spark.range(10).count()
    began = time.time()
    one = spark.range(100_000).selectExpr("id", "5L AS phash", "concat('s', id) AS sha256", "1 AS group_id", "id % 7 AS size")
    assert duplicates.near_links(one).count() == 0
    free = one.selectExpr("id", "phash", "sha256", "0 AS group_id", "size")
    links = duplicates.near_links(free)
    assert links.count() <= 25 * 100_000 and links.select("a").distinct().count() == 100_000
    same = one.selectExpr("id", "phash", "'s' AS sha256", "cast(id AS int) AS group_id", "size")
    assert duplicates.near_links(same).count() == 0
    assert time.time() - began < 120


def overlaps_by_hand(held, least=0.5):
    sets = {}
    for p, c in held:
        if c is not None:
            sets.setdefault(p, set()).add(c)
    out = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        k = len(x & y)
        kind = "identical" if x == y else "a_in_b" if x <= y else "b_in_a" if y <= x else "overlap" if k and k / len(x | y) >= least else None
        if kind:
            out.add((a, b, kind, k, float(Decimal(k / len(x | y)).quantize(Decimal("1e-6"), ROUND_HALF_UP))))
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_pack_overlaps(spark, seed, least):
    """Small and large packs, subsets, copies with changes, contents that all packs hold, packs of nothing else."""
    rng = random.Random(seed)
    held = []
    for p in range(60):
        kind = rng.randrange(6)
        own = {f"c{rng.randrange(300)}" for _ in range(rng.choice([1, 2, 3, 8, 40, 120]))}
        if kind and held:
            other = {c for q, c in held if q == rng.choice(held)[0]}
            own = other if kind == 1 else set(rng.sample(sorted(other), rng.randint(1, len(other)))) if kind == 2 else other | own if kind == 3 else (other - set(sorted(other)[: len(other) // 3])) | own if kind == 4 else own
        held += [(p, c) for c in sorted(own | ({"all"} if rng.random() < 0.8 else set()))]
    held += [(100, "all"), (101, "all"), (102, None), (100, "all")]
    table = spark.createDataFrame(held, "pack_id int, sha256 string")
    got = {tuple(r) for r in duplicates.pack_overlaps(table, least).select("a", "b", "kind", "shared", "jaccard").collect()}
    assert got == overlaps_by_hand(held, least)
    assert duplicates.pack_overlaps(table.limit(0)).count() == 0


def test_a_content_in_every_pack(spark):
    """3,000 packs share one content and nothing else: no two of them are compared."""
    held = spark.range(3000).selectExpr("id AS pack_id", "explode(array('all', concat('x', id), concat('y', id))) AS sha256")
    began = time.time()
    assert duplicates.pack_overlaps(held).count() == 0
    assert time.time() - began < 60


@pytest.mark.parametrize("seed", range(3))
def test_dense_hashes_yield_few_links(spark, seed, monkeypatch):
    """1,500 hashes of 14 bits that differ, most pairs near, in cells of 100 and of any size, with narrow keys first and without: parts and longest links as by all pairs, and links
    that grow with the nodes, not with the pairs."""
    rng = random.Random(seed)
    spread = lambda v: sum((v >> i & 1) << 4 * i + 3 for i in range(14))
    rows = [(i, signed(spread(rng.getrandbits(14) if i % 10 else 5)), f"s{rng.randrange(3 + i % 40)}", rng.randrange(6)) for i in range(1500)]
    near = lambda x, y: x[2] != y[2] and not (x[3] and x[3] == y[3]) and (x[1] % (1 << 64) ^ y[1] % (1 << 64)).bit_count() <= 2
    least = {}
    for i, *key in rows:
        least.setdefault(tuple(key), i)
    nodes = [r for r in rows if least[tuple(r[1:])] == r[0]]
    full = {(x[0], y[0]): (x[1] % (1 << 64) ^ y[1] % (1 << 64)).bit_count() for x, y in itertools.combinations(nodes, 2) if near(x, y)}
    table = spark.createDataFrame(rows, "id int, phash long, sha256 string, group_id int")
    want = parts(full)
    farthest = lambda pairs, name: {c: max(d for (a, _), d in pairs.items() if name[a] == c) for c in set(name.values())}
    for block, large in ((100, 0), (2048, 0), (100, 1 << 14)):
        monkeypatch.setattr(duplicates.blocks, "BLOCK", block)
        got = {(r["a"], r["b"]): r["dist"] for r in duplicates.near_links(table, 2, large).collect()}
        assert all(full[min(k), max(k)] == d for k, d in got.items())
        assert parts(got) == want and farthest(got, parts(got)) == farthest(full, want)
        pairs = [tuple(r) for r in duplicates.near_pairs(table, 2).collect()]
        first = {}
        for r in rows:
            first.setdefault(r[1], r[0])
        apart = lambda a, b: (a % (1 << 64) ^ b % (1 << 64)).bit_count()
        every = [(*sorted((first[x], first[y])), apart(x, y)) for x, y in itertools.combinations(first, 2) if apart(x, y) <= 2]
        assert sorted(pairs) == sorted(every + [(first[r[1]], r[0], 0) for r in rows if first[r[1]] != r[0]])


def test_links_of_many_near_hashes(spark):
    """20,000 hashes of 20 bits that differ, 13 million pairs of them near: fewer links than some hundred a node."""
    h = "+".join(f"((id * 7919 % 1048576) >> {i} & 1) * (1L << {3 * i})" for i in range(20))
    images = spark.range(20_000).selectExpr("id", f"{h} AS phash", "id % 40 AS sha256", "id % 10 AS group_id")
    assert duplicates.near_links(images).count() < 100 * 20_000


def test_meetings_of_packs_are_dealt_by_their_number(spark, monkeypatch):
    """200 packs of twelve contents that all of them may hold: few rows, many meetings, as many tasks as those need."""
    rng = random.Random(1)
    held = [(p, f"c{c}") for p in range(200) for c in rng.sample(range(16), 12)]
    monkeypatch.setattr(duplicates, "MEETINGS", 2000)
    plans, write = [], duplicates.cut
    monkeypatch.setattr(duplicates, "cut", lambda df, *a: (plans.append(df._jdf.queryExecution().toString()), write(df, *a))[1])
    got = {tuple(r) for r in duplicates.pack_overlaps(spark.createDataFrame(held, "pack_id int, sha256 string")).select("a", "b", "kind", "shared", "jaccard").collect()}
    assert got == overlaps_by_hand(held) and len(got) > 1000
    dealt = [int(n) for plan in plans for n in re.findall(r"hashpartitioning\(c#\d+, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert dealt and max(dealt) >= 20


def rows_shuffled(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_packs_that_share_by_chance_write_no_pairs(spark):
    """1,500 packs of 100 of 3,000 contents, any two of which share some three, and a near copy of each tenth: what is shuffled grows with what packs hold, not with the 1.4 million pairs that meet."""
    rng = random.Random(2)
    held = [(p, c) for p in range(1500) for c in rng.sample(range(3000), 100)]
    held += [(p + 10_000, c if c % 5 else c + 5000) for p, c in held if p % 10 == 0]
    table = duplicates.cut(spark.createDataFrame(held, "pack_id long, sha256 long"))
    before = rows_shuffled(spark)
    got = {tuple(r) for r in duplicates.pack_overlaps(table).select("a", "b", "kind", "shared", "jaccard").collect()}
    assert got == overlaps_by_hand(held) and len(got) > 100
    assert rows_shuffled(spark) - before < 6 * len(held)


@pytest.mark.parametrize("least", [0.4, 0.5, 0.75])
def test_packs_of_many_classes_and_chunks(spark, least, monkeypatch):
    """Packs from one to some thousand contents, so of up to nine bits of classes, and subsets and copies of them of every size; chunks of 80, cells of 8 for contents of very many packs, keys that are text."""
    monkeypatch.setattr(duplicates.overlaps, "CHUNK", 80)
    monkeypatch.setattr(duplicates.overlaps, "BLOCK", 8)
    rng = random.Random(int(least * 100))
    sets = {}
    for p in range(240):
        if p % 3 == 0 or not sets:
            own = {f"c{c}" for c in rng.sample(range(30_000), int(1.5 ** rng.uniform(0, 19)))}
        else:
            other = sorted(rng.choice(list(sets.values())))
            own = set(rng.sample(other, max(1, int(len(other) * rng.uniform(0.2, 1)))))
            own |= {f"x{rng.randrange(1 << 40)}" for _ in range(int(len(own) * rng.choice([0, 0, 0.2, 0.6])))}
        sets[p] = own | {"all"} if p % 2 else own
    held = [(f"p{p}", c) for p, own in sets.items() for c in own]
    table = spark.createDataFrame(held, "pack_id string, sha256 string")
    got = {tuple(r) for r in duplicates.pack_overlaps(table, least).select("a", "b", "kind", "shared", "jaccard").collect()}
    want = overlaps_by_hand(held, least)
    assert got == want and {"a_in_b", "b_in_a", "overlap"} <= {r[2] for r in want}
