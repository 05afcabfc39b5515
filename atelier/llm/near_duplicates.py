"""MinHash near-duplicates by an inverted join over signature coordinates.

A document is the set of its five-word shingles. Equal sets are one node. A node's signature
has ``K`` coordinates; nodes of similarity ``s`` agree on about ``s * K`` of them, and a pair is
retained if it agrees on ``T`` at least. Nodes are posted under coordinate-value pairs, of which
the prefix filter needs only the ``K - T + 1`` rarest: two nodes that agree ``T`` times share one
of these. Frequent values (a passage that many documents hold) are skipped that way, and
their collisions are counted from the signatures of the pairs that the rare ones give. Pairs
retained are confirmed on the full sets.

No list of postings is turned into all its pairs, whatever its length. Of each list the most central
node is first paired with the others, which joins groups of copies. What a list then still holds in
different components is confirmed as a whole: the full sets of these nodes are joined on their own
rarest shingles, with the exact prefix, length and positional bounds of the threshold, and only
pairs of different components count, as others can't change anything. Long lists are
dealt to tasks in blocks of ``BLOCK`` nodes. No link between components is lost, but of those
that agree on too few coordinates (``MISSED``). Where very many nodes share nearly enough of a passage
and none is similar enough to another, the bounds can't tell them apart: their pairs are all confirmed, in blocks.

Rarity comes from exact counts of nodes. A value that one node alone holds counts in the order, but is
not posted: a node with enough of such has no posting at all.

Null and empty texts have no shingles and are linked with nothing. Texts of fewer words are
one shingle. Repeated rows are exact copies. A row without an id belongs to its group but
can't name it. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from ..operators.scratch import cut
from ._arrow import add
from ._words import SPACED, Texts, mixed

WORDS, K = 5, 64
#: Nodes of a posting list that a task compares with as many others at a time.
BLOCK = 512
#: Links: 100 * intersection >= percent * union; this one unless another is asked for.
PERCENT = 85
#: The chance at most that a pair of just this similarity agrees on too few coordinates.
MISSED = 3e-5
_RANDOM = np.random.default_rng(2024)
XOR, ODD = _RANDOM.integers(0, 1 << 63, K, np.uint64), _RANDOM.integers(0, 1 << 63, K, np.uint64) * np.uint64(2) + np.uint64(1)
LONGS, INTS = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())


def least_agreeing(percent: int) -> int:
    """Coordinates on which two nodes must agree: 42 for 85 %, 37 for 80 %."""
    s, missed = percent / 100, 0.0
    for n in range(K + 1):
        missed += math.comb(K, n) * s**n * (1 - s) ** (K - n)
        if missed > MISSED:
            return max(n, 1)
    return K


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    texts = Texts.of(column).lowered()
    words = texts.runs(SPACED)
    count = words.per_text()
    first, code = words.windows(WORDS)
    edge = np.searchsorted(words.text[first], np.arange(len(texts) + 1)).tolist()
    sets = [np.unique(code[a:b]) for a, b in zip(edge, edge[1:])]
    for n in range(1, WORDS):
        if (few := np.flatnonzero(count == n)).size:
            at, whole = words.windows(n)
            of = dict(zip(words.text[at].tolist(), whole.tolist()))
            for i in few.tolist():
                sets[i] = np.array([of[i]], np.uint64)
    return sets


def node_of(shingles: np.ndarray) -> bytes | None:
    """128 bits that name the set."""
    if not len(shingles):
        return None
    return np.array([mixed(shingles).sum(), mixed(shingles ^ XOR[0]).sum()], np.uint64).tobytes()


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """K coordinates of 32 bits of each non-empty set, a row each."""
    full = [s for s in sets if len(s)]
    if not full:
        return np.zeros((0, K), np.uint32)
    code = np.concatenate(full)
    first = np.concatenate([[0], np.cumsum([len(s) for s in full])[:-1]])
    return np.stack([np.minimum.reduceat(((code ^ x) * a) >> np.uint64(32), first) for x, a in zip(XOR, ODD)], 1).astype(np.uint32)


SIGNED = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("nid", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("sig", INTS)])
NODE_SET = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("nid", T.LongType()), T.StructField("shingles", LONGS)])


def _sign():
    def step(part):
        sets = shingle_sets(part.column("text"))
        nodes = [node_of(s) for s in sets]
        sig = signatures(sets).view(np.int32)
        has = np.array([len(s) > 0 for s in sets], bool)
        edge = np.concatenate([[0], np.cumsum(has * K)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(edge), pa.array(sig.ravel()))
        return [nodes, [None if x is None else int.from_bytes(x[:8], "little", signed=True) for x in nodes], [len(s) for s in sets], lists]

    return step


def rarest(each: DataFrame, need) -> DataFrame:
    """Of rows ``nid, size, key`` those of each node's prefix with ``pos``, their place in the order of rarity: nodes
    that share ``need`` of their ``size`` keys share one of these. Keys of one node alone are left out. Further columns stay."""
    held = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = cut(each.join(held, "key"))
    node = Window.partitionBy("nid")
    pos = F.col("size") - F.count(F.lit(1)).over(node) + F.row_number().over(node.orderBy("n", "key")) - 1
    return cut(shared.withColumn("pos", pos).filter(F.col("pos") <= F.col("size") - need).drop("n"), shared.count())


def _long_enough(a: str, b: str, percent: int):
    """The length bound."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _possible(percent: int):
    """Length and positional bounds of postings x and y: what two sets may share from this key on."""
    most = F.least(F.col("x.size") - F.col("x.pos"), F.col("y.size") - F.col("y.pos"))
    return _long_enough("x.size", "y.size", percent) & (most * (100 + percent) >= percent * (F.col("x.size") + F.col("y.size")))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of nodes ``a, b`` that are similar enough on their full sets."""
    side = lambda x: sets.select(F.col("nid").alias(f"nid_{x}"), F.col("node").alias(x), F.col("shingles").alias(f"set_{x}"))
    both = pairs.join(side("b"), "nid_b").join(side("a"), "nid_a")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.select("a", "b", shared.alias("shared"), F.size("set_a").alias("m"), F.size("set_b").alias("n")).filter(f"100 * shared >= {percent} * (m + n - shared) and a <> b").select("a", "b")


def _marked(docs: DataFrame, wanted: DataFrame, bits: int = 23) -> DataFrame:
    """Full sets of the nodes with a wanted nid. Which texts to hash is told by a bitmap of fixed
    size, so that not all sets are made; a chance hit is harmless."""
    place = F.shiftrightunsigned("nid", 64 - bits)
    words = wanted.select(F.floor(place / 64).alias("w"), F.expr("shiftleft(1L, cast(shiftrightunsigned(nid, %d) %% 64 as int))" % (64 - bits)).alias("v"))
    rows = words.groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    bitmap = np.zeros((1 << bits) // 64, np.int64)
    bitmap[rows["w"].to_numpy()] = rows["v"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(np.unpackbits(bitmap.view(np.uint8), bitorder="little").astype(bool))

    def start():
        seen: set[bytes] = set()

        def step(part):
            out = [[], [], []]
            for s in shingle_sets(part.column("text")):
                node = node_of(s)
                nid = None if node is None else int.from_bytes(node[:8], "little", signed=True)
                fresh = node is not None and node not in seen and bool(shared.value[(nid & 0xFFFFFFFFFFFFFFFF) >> (64 - bits)])
                if fresh:
                    seen.add(node)
                for column, x in zip(out, (node, nid, s.view(np.int64)) if fresh else (None,) * 3):
                    column.append(x)
            return out

        return step

    made = add(docs.select("text"), "text", NODE_SET, start, keep=[]).filter("node is not null")
    return made.groupBy("node", "nid").agg(F.first("shingles").alias("shingles"))


def _apart(posts: DataFrame, percent: int) -> DataFrame:
    """``nid_a, nid_b``: pairs on a common key, of different ``part``, that the bounds allow. A key's nodes are dealt
    to blocks, and each pair of blocks is a task's work, so no key is bound to one task."""
    lists = posts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high")
    blocks = F.ceil(F.col("n") / BLOCK)
    dealt = cut(posts.join(lists.select("key", blocks.alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("nid"), F.col("blocks"))))
    x = dealt.withColumn("other", F.explode(F.sequence("block", F.col("blocks") - 1))).withColumnsRenamed({"block": "i", "other": "j"}).alias("x")
    y = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "block"))).withColumnsRenamed({"other": "i", "block": "j"}).alias("y")
    once = (F.col("x.i") < F.col("x.j")) | (F.col("x.nid") < F.col("y.nid"))
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j")) & once & (F.col("x.part") != F.col("y.part")) & _possible(percent))
    return cut(met.select(F.least("x.nid", "y.nid").alias("nid_a"), F.greatest("x.nid", "y.nid").alias("nid_b")).distinct())


def joined(docs: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``node, component`` of all nodes that are linked with another: the least node of each component."""
    each = nodes.select("nid", F.posexplode("sig").alias("place", "value")).select("nid", F.lit(K).alias("size"), F.xxhash64("place", "value").alias("key"))
    posted = rarest(each, F.lit(least_agreeing(percent)))
    lists = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("pos", "nid"))["nid"].alias("hub")).filter("n > 1")
    shared = cut(posted.select("key", "nid").join(lists, "key").filter("nid <> hub"), posted.count())
    most, n = shared.count(), nodes.count()
    met = cut(shared.select(F.least("nid", "hub").alias("nid_a"), F.greatest("nid", "hub").alias("nid_b")).distinct(), most)
    side = lambda x: nodes.select(F.col("nid").alias(f"nid_{x}"), F.col("sig").alias(f"sig_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    agreeing = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    pairs = cut(met.join(side("a"), "nid_a").join(side("b"), "nid_b").filter(_long_enough("n_a", "n_b", percent) & (agreeing >= least_agreeing(percent))).select("nid_a", "nid_b"), 4 * most)
    # a list of two has no further pair
    wanted = pairs.select(F.col("nid_a").alias("nid")).union(pairs.select(F.col("nid_b").alias("nid"))).union(shared.filter("n > 2").select("nid"))
    sets = cut(_marked(docs, wanted))
    first = components(cut(_confirmed(pairs, sets, percent)), "a", "b")
    part = cut(first.join(sets.select("node", "nid"), "node").groupBy("nid").agg(F.min("component").alias("part")), n)
    rest = shared.filter("n > 2").select("key", "nid").join(part, "nid", "left").withColumn("part", F.coalesce("part", F.encode(F.col("nid").cast("string"), "utf-8")))
    rest = cut(rest, most)
    split = rest.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("key")
    open_ = cut(rest.join(split, "key", "left_semi").select("nid", "part").distinct(), most)
    if open_.isEmpty():
        return first
    whole = cut(sets.select("nid", "shingles").join(open_, "nid"))
    each = whole.select("nid", "part", F.size("shingles").alias("size"), F.explode("shingles").alias("key"))
    posts = rarest(each, F.ceil(F.col("size") * percent / 100))
    more = cut(_confirmed(_apart(posts, percent), sets, percent))
    if more.isEmpty():
        return first
    # the links found last join components of the first
    old = lambda x: first.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    ends = more.join(old("a"), "a", "left").join(old("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    second = components(ends, "a", "b", "old", "new")
    alone = second.select(F.col("old").alias("node"), F.col("old").alias("component")).join(first, "node", "left_anti")
    every = first.unionByName(alone).join(second, F.col("component") == F.col("old"), "left")
    return cut(every.select("node", F.coalesce("new", "component").alias("component")), n)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row a document: key, n_shingles, component_id, kept. Links need a similarity of ``percent`` at least."""
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = cut(add(texts, "text", SIGNED, _sign, keep=["key"]))
    nodes = cut(rows.filter("node is not null").groupBy("node", "nid", "n_shingles").agg(F.min("key").alias("least"), F.first("sig").alias("sig")), 4 * rows.count())
    least = nodes.select("node", "least").join(joined(texts, nodes, percent), "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = least.groupBy("component").agg(F.min("least").alias("component_id"))
    named = least.join(names, "component").select("node", "component_id")
    out = rows.filter("node is not null").select("key", "node", "n_shingles").join(named, "node").select("key", "n_shingles", "component_id")
    alone = rows.filter("node is null").select("key", "n_shingles", F.col("key").alias("component_id"))
    return out.unionByName(alone).select(F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
