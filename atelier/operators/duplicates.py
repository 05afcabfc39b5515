"""Exact and near copies of files, packs that hold one another, and what may be removed."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions import paths
from . import hashes as blocks
from . import overlaps
from .components import components
from .scratch import cut

NEAR_DISTANCE, PACK_JACCARD, LISTED = 5, 0.5, 500
#: Unlike hashes that may share a key by chance; of the narrowest keys, one in so many comes first.
PER_KEY, NARROW = 16, 63
#: Parts of a pack whose tags move.
SALT = 64
#: Meetings of packs that a task looks at, and rows of what packs hold that a task takes.
MEETINGS, HELD_A_TASK = 1 << 22, 1 << 20


def exact(assets: DataFrame) -> DataFrame:
    """``sha256, copies, bytes``: bytes that all but one copy take."""
    found = assets.filter("missing_since is null").groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.max("size").alias("_size"))
    return found.filter("copies > 1").select("sha256", "copies", ((F.col("copies") - 1) * F.col("_size")).alias("bytes"))


def favoured(copies: DataFrame) -> DataFrame:
    """``sha256, keep_id, score`` of each content with copies: used ones first, then those of known
    provenance, outside raw folders, primaries of a group, and in shallow folders; ties go to the oldest."""
    score = (  # fixed values: the weights
        F.when(F.col("used"), 1000).otherwise(0) + F.when(F.col("complete"), 100).otherwise(0) + F.when(paths.in_raw(F.col("path")), 0).otherwise(50)
        + F.when(F.col("is_primary") & (F.col("variants") > 1), 25).otherwise(0) - paths.depth(F.col("path"))
    )
    best = F.min_by(F.struct("id", score.alias("score")), F.struct(-score, "first_seen_at", "path", "id"))
    out = copies.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), best.alias("b")).filter("n > 1")
    return out.select("sha256", F.col("b.id").alias("keep_id"), F.col("b.score").cast("int").alias("score"))


def band_sets(n: int, distance: int, bits: int = 64) -> list[tuple[int, int]]:
    """(bands, mask) of each key that hashes are posted under, so that any two within the distance share one. Hashes are cut into distance + r bands,
    of which r are equal at least: a key is r of the bands. The more hashes (``n``), the larger r, so that some ``PER_KEY`` unlike hashes share a
    key by chance whatever their number; at r = 5 a key has 30 bits."""
    r = next((r for r in range(1, 5) if n <= PER_KEY << r * (bits // (distance + r))), 5)
    edges = [bits * k // (distance + r) for k in range(distance + r + 1)]
    mask = [(1 << high) - (1 << low) for low, high in zip(edges, edges[1:])]
    return [(sum(1 << i for i in chosen), sum(mask[i] for i in chosen)) for chosen in itertools.combinations(range(len(mask)), r)]


def chosen_sets(n: int, pairs: float, distance: int, mask: int = (1 << 64) - 1) -> list[tuple[int, int]]:
    """As ``band_sets``, of the bits of ``mask`` only (those in which the hashes differ at all), with the r of least work: posting ``n`` hashes under each key, and looking at those of
    ``pairs`` pairs that share one by chance, some ``PER_KEY`` in the time of a posting."""
    places = [k for k in range(64) if mask >> k & 1]

    def keys(r: int) -> list[tuple[int, int]]:
        edges = [len(places) * k // (distance + r) for k in range(distance + r + 1)]
        bits = [sum(1 << k for k in places[low:high]) for low, high in zip(edges, edges[1:])]
        return [(sum(1 << i for i in chosen), sum(bits[i] for i in chosen)) for chosen in itertools.combinations(range(len(bits)), r)]

    work = lambda r: math.comb(distance + r, r) * (n + pairs / PER_KEY / 2 ** (len(places) * r / (distance + r)))
    return keys(min(range(1, 6), key=work))


def _spread(hashes: DataFrame) -> tuple[int, int]:
    """How many hashes (each once), and the bits in which they differ."""
    n, every, some = hashes.agg(F.count(F.lit(1)), F.bit_and("h"), F.bit_or("h")).first()
    return n, ((every or 0) ^ (some or 0)) % (1 << 64)


def _hash_pairs(hashes: DataFrame, distance: int, sets: list[tuple[int, int]] | None, name: str | None = None) -> DataFrame:
    n, mask = _spread(hashes)
    sets = sets or chosen_sets(n, n * n / 2, distance, mask)
    named = "" if name is None else "".join(f", {c} {hashes.schema[name].dataType.simpleString()}" for c in ("_x", "_y"))
    return blocks.dealt(hashes, sets, n, "h").mapInArrow(blocks.near_in_cells(sets, distance, name), "x long, y long, dist int" + named)


def hash_pairs(hashes: DataFrame, distance: int = NEAR_DISTANCE, bits: int = 64, sets: list[tuple[int, int]] | None = None) -> DataFrame:
    """``x, y, dist`` of all pairs of hashes (column ``h``, each once) within the distance, each pair once: hashes meet on equal bands (none is
    lost) and are then compared in full, a block of arrays at once. Of the keys that two share, only that of their first equal bands gives the pair, so
    pairs need not be made distinct."""
    return _hash_pairs(hashes.select("h"), distance, sets)


def near_pairs(hashed: DataFrame, distance: int = NEAR_DISTANCE, key: str = "id", bits: str = "phash") -> DataFrame:
    """``a, b, dist`` of all pairs within a Hamming distance. Equal hashes are compared once: of each hash the least id stands
    for all, and the others are its pairs at distance 0."""
    rows = hashed.select(F.col(key).alias("k"), F.col(bits).alias("h")).filter("h is not null")
    first = cut(rows.groupBy("h").agg(F.min("k").alias("k")))
    same = rows.join(first.withColumnRenamed("k", "r"), "h").filter("k <> r").select(F.col("r").alias("a"), F.col("k").alias("b"), F.lit(0).alias("dist"))
    named = _hash_pairs(first, distance, None, "k")
    return named.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), "dist").unionByName(same)


def spokesmen(nodes: DataFrame) -> DataFrame:
    """Of the nodes (h, s, g, k) of each hash at most 25, so that for any two contents and any two groups: if some node
    of the hash has neither of them, one of these has neither.

    Three of one content and of different groups are enough for that content, as two groups at most are shunned; so are three of
    one group. Of the rest any 25 will do: no five of them that differ in both would mean that four contents and four groups
    at most, of three nodes each, cover them, which are 24."""
    first = lambda rows, by, order, n: rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")
    content = first(nodes, ("h", "s"), ("g",), 3)
    grouped = first(content.filter("g <> 0"), ("h", "g"), ("s",), 3).unionByName(content.filter("g = 0"))
    return first(grouped, ("h",), ("s", "g"), 25)


def near_links(images: DataFrame, distance: int = NEAR_DISTANCE, large: int = 1 << 14) -> DataFrame:
    """``a, b, dist``: links that connect what near images connect. Images (id, phash, sha256, group_id) are near if they are of different content, not in
    one group (group 0 or null is none), and within the distance. Those of equal hash, content and group are linked alike, and the least id stands for
    them: a node. Each node may be linked to the ``spokesmen`` of each near hash, and of its own, that it is near to.

    That connects any near nodes x and y: some spokesman k of x's hash is near y; y is near both x and k, so a spokesman of y's hash is near both as well, and
    x, that one, k and y are a way. Of these links a key of equal bands yields a tree for each part that it connects, and that part's longest, so distances are told
    as well and links grow with the nodes, however many pairs are near. Beyond ``large`` nodes a few narrow keys come first: what they connect is compared no more, once
    a link of the whole distance is known."""
    rows = images.filter("phash is not null and sha256 is not null").select(F.col("id").alias("k"), F.col("phash").alias("h"), F.col("sha256").alias("s"), F.coalesce("group_id", F.lit(0)).alias("g"))
    nodes = cut(rows.groupBy("h", "s", "g").agg(F.min("k").alias("k")))
    speak = cut(spokesmen(nodes).select("h", "s", "g", F.lit(True).alias("speaks")))
    nodes = cut(nodes.join(speak, ["h", "s", "g"], "left").select("k", "h", "s", "g", (F.col("g") == 0).alias("free"), F.coalesce("speaks", F.lit(False)).alias("speaks")))
    n, mask = _spread(nodes)
    kind = images.schema["id"].dataType.simpleString()
    made = lambda rows, sets: cut(blocks.dealt(rows, sets, n, "k", F.col("speaks")).mapInArrow(blocks.links_in_cells(distance), f"a {kind}, b {kind}, dist int"))
    alone = nodes.select("*", F.col("k").alias("l"), F.lit(False).alias("full"))
    if n <= large:
        return made(alone, chosen_sets(n, n * n / 2, distance, mask))
    first = made(alone, chosen_sets(n, n * 2.0**128, distance, mask)[::NARROW])
    part = components(first, "a", "b", "k", "l")
    full = first.filter(F.col("dist") == distance).join(part, F.col("a") == F.col("k")).select("l", F.lit(True).alias("full")).distinct()
    known = cut(nodes.join(part.join(full, "l", "left"), "k", "left").select(*nodes.columns, F.coalesce("l", "k").alias("l"), F.coalesce("full", F.lit(False)).alias("full")))
    done = known.filter("full").groupBy("l").count().agg(F.max("count")).first()[0] or 0
    return first.unionByName(made(known, chosen_sets(n, (n - done) * n, distance, mask)))


def near_findings(images: DataFrame, distance: int = NEAR_DISTANCE) -> DataFrame:
    """``cluster_id, members, bytes, max_distance`` of images that near links connect, named by the least id;
    ``bytes`` are those of all but the largest. ``images`` has id, phash, sha256, group_id and size."""
    links = cut(near_links(images, distance))
    part = components(links, "a", "b", "k", "cluster_id")
    same = ["phash", "sha256", "g"]
    rows = images.withColumn("g", F.coalesce("group_id", F.lit(0)))
    named = rows.groupBy(*same).agg(F.min("id").alias("k")).join(part, "k").select(*same, "cluster_id")
    size = rows.join(named, same).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members"), (F.sum("size") - F.max("size")).alias("bytes"))
    far = links.join(part, links["a"] == part["k"]).groupBy("cluster_id").agg(F.max("dist").alias("max_distance"))
    return size.join(far, "cluster_id")


def near_clusters(pairs: DataFrame) -> DataFrame:
    """``cluster_id, members, max_distance``: connected pairs, named by the least id; the distance is the
    longest link's."""
    part = components(pairs, "a", "b")
    size = part.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    far = pairs.join(part, pairs["a"] == part["node"]).groupBy("component").agg(F.max("dist").alias("max_distance"))
    return size.join(far, "component").select(F.col("component").alias("cluster_id"), "members", "max_distance")


def tasks_of(meetings: float, least: int) -> int:
    """Tasks for so many meetings of two rows, some ``MEETINGS`` a task; one for each of ``least`` cores at least."""
    return max(least, math.ceil(meetings / MEETINGS))


def _by_hash(rows: DataFrame, value: Column, empty: float) -> np.ndarray:
    """A value for each of the ``overlaps.BUCKETS`` hashes of contents; so many numbers go to the driver, however many rows there are."""
    got = rows.groupBy(F.col("h").bitwiseAND(F.lit(overlaps.BUCKETS - 1)).alias("k")).agg(value.cast("double").alias("v")).toArrow()
    out = np.full(overlaps.BUCKETS, float(empty))
    out[got.column("k").to_numpy()] = got.column("v").to_numpy()
    return out


def _chunk(h: Column, bits: Column) -> Column:
    return F.when(bits == 0, 0).otherwise(F.call_function("shiftrightunsigned", h, 64 - bits)).cast("int")


def chunked(held: DataFrame, pack: str = "pack_id", content: str = "sha256", rows: int | None = None) -> DataFrame:
    """``p, n, b, q, cs``: what each pack holds, written once: n contents, in chunks q of some ``overlaps.CHUNK``, by the first b bits of their hash. Repeated rows count once, null packs and contents as none.
    ``rows`` is a bound of the rows, if known, else they are counted: they are dealt to as many tasks as they need; bytes of long numbers don't tell."""
    found = held.select(F.col(pack).alias("p"), F.col(content).alias("c")).filter("p is not null and c is not null")
    tasks = max(held.sparkSession.sparkContext.defaultParallelism, math.ceil((found.count() if rows is None else rows) / HELD_A_TASK))
    kind, content_kind = (found.schema[c].dataType.simpleString() for c in ("p", "c"))
    sorted_ = found.repartition(tasks, "p").sortWithinPartitions("p", "c").select("p", "c", F.xxhash64("c").alias("h"))
    return cut(sorted_.mapInArrow(overlaps.chunks, f"p {kind}, n long, b int, q int, cs array<{content_kind}>"))


def pack_overlaps(held: DataFrame, least: float = PACK_JACCARD, pack: str = "pack_id", content: str = "sha256") -> DataFrame:
    """``a, b, kind, shared, jaccard`` of packs that are identical, one in the other, or share at least ``least`` of their union."""
    return chunk_overlaps(chunked(held, pack, content), least)


def chunk_overlaps(packs: DataFrame, least: float = PACK_JACCARD) -> DataFrame:
    """As ``pack_overlaps``, of ``chunked`` packs.

    Packs of alike size meet class by class (``overlaps``): of two that share the part, a class of contents does as well, so they
    meet on its first contents, and sketches of the classes drop nearly all that share a few contents by chance before a pair is written. Packs of more unlike size can only be one in the other, and the small one asks by
    its first contents, all of which the large one holds. First are contents that few packs hold, as far as counts by hash tell: a content of very many packs comes last, so it brings packs together only if they
    have little else; the order decides how much is compared, not what is found. Whole sets of those that are left are then compared, chunk by chunk. The meetings are counted before, and dealt to as many tasks as
    they need: bytes of the rows that meet don't tell."""
    spark, kind_of, content_of = packs.sparkSession, packs.schema["p"].dataType.simpleString(), packs.schema["cs"].dataType.elementType
    key = F.col("c").cast("long") if isinstance(content_of, IntegralType) else F.xxhash64("c")
    contents = packs.select("p", "n", F.posexplode("cs").alias("pos", "c")).select("p", "n", "pos", key.alias("v"), F.xxhash64("c").alias("h"))
    counts = _by_hash(contents.select("h"), F.count(F.lit(1)), 0)
    every, twice = counts.sum(), (counts**2).sum()
    # squares of how many packs hold a content, summed: those of the counts without what contents share by chance; a row and a column of a class post half and more of its contents
    tasks = tasks_of(max(twice - every**2 / overlaps.BUCKETS, every) / 4, spark.sparkContext.defaultParallelism)
    posted = contents.mapInArrow(overlaps.posted(least, counts), f"c int, p {kind_of}, w long, s long, t long")
    met = posted.repartition(tasks, "c").sortWithinPartitions("c", "w").mapInArrow(overlaps.alike(least), f"a {kind_of}, b {kind_of}").filter("a <> b")
    sizes = packs.select("p", "n", "b").distinct()
    low, high = sizes.agg(F.min("n"), F.max("n")).first()
    if low is not None and low < least * high:
        order = Window.partitionBy("p").orderBy("g", "h", "c")
        asks = contents.mapInArrow(overlaps.asking(counts), f"p {kind_of}, n long, c long, h long, g double").withColumn("r", F.row_number().over(order))
        asks = cut(asks.filter(F.col("r") <= F.least(1 + F.floor(F.col("n") / 20), F.lit(overlaps.ASKED))).select("p", "n", "c", "h"))
        holders = contents.mapInArrow(overlaps.asked(least, _by_hash(asks, F.min("n"), math.inf)), f"c long, p {kind_of}, n long")
        found = asks.alias("x").join(holders.alias("y"), (F.col("x.c") == F.col("y.c")) & (F.col("x.n") < least * F.col("y.n")))
        found = found.groupBy(F.col("x.p").alias("a"), F.col("y.p").alias("b"), F.col("x.n").alias("n")).agg(F.count(F.lit(1)).alias("k"))
        met = met.unionByName(found.filter(F.col("k") >= F.least(1 + F.floor(F.col("n") / 20), F.lit(overlaps.ASKED))).select("a", "b"))
    met = cut(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    sets = packs.select("p", "q", "cs")
    pairs = met.join(sizes.toDF("a", "na", "ba"), "a").join(sizes.toDF("b", "nb", "bb"), "b")
    pairs = pairs.select("*", F.greatest("ba", "bb").alias("fine")).select("*", F.explode(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.col("fine")) - 1)).alias("i"))
    of = lambda n: F.call_function("shiftright", F.col("i"), F.col("fine") - F.col(n))
    first = pairs.withColumn("qa", of("ba")).join(sets.alias("x"), (F.col("a") == F.col("x.p")) & (F.col("qa") == F.col("x.q")))
    ours = F.when(F.col("ba") == F.col("fine"), F.col("x.cs")).otherwise(F.filter("x.cs", lambda c: _chunk(F.xxhash64(c), F.col("fine")) == F.col("i")))
    first = first.select("a", "b", "na", "nb", of("bb").alias("qb"), ours.alias("ours"))
    both = first.join(sets.alias("y"), (F.col("b") == F.col("y.p")) & (F.col("qb") == F.col("y.q")))
    both = both.groupBy("a", "b", "na", "nb").agg(F.sum(F.size(F.array_intersect("ours", "y.cs"))).alias("shared"))
    jaccard = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    kind = (
        F.when((F.col("shared") == F.col("na")) & (F.col("shared") == F.col("nb")), "identical").when(F.col("shared") == F.col("na"), "a_in_b")
        .when(F.col("shared") == F.col("nb"), "b_in_a").when(jaccard >= least, "overlap")
    )
    return both.select("a", "b", kind.alias("kind"), "shared", F.round(jaccard, 6).alias("jaccard")).filter("kind is not null")


def transferred_tags(pack_tags: DataFrame, source: DataFrame) -> DataFrame:
    """``pack_id, tag`` that packs gain from others: ``source`` has (from_pack, to_pack); tags they have stay."""
    moved = pack_tags.join(source, pack_tags["pack_id"] == source["from_pack"]).filter("from_pack <> to_pack").select(F.col("to_pack").alias("pack_id"), "tag").distinct()
    return moved.join(pack_tags.select("pack_id", "tag"), ["pack_id", "tag"], "left_anti")


def removal_plan(copies: DataFrame, targets: DataFrame, used: DataFrame) -> DataFrame:
    """``id, decision`` of files marked for removal: blocked while a project uses them, and when all
    remaining copies of a content are marked, the first by path stays."""
    rows = copies.join(targets.select("id").distinct().withColumn("_t", F.lit(True)), "id", "left").join(used.select("id").distinct().withColumn("_u", F.lit(True)), "id", "left")
    rows = rows.withColumn("_leaving", F.coalesce(F.col("_t"), F.lit(False)) & ~F.coalesce(F.col("_u"), F.lit(False)))
    first = F.min_by("id", F.when(F.col("_leaving"), F.struct("path", "id")))
    whole = rows.groupBy("sha256").agg(F.count_if(~F.col("_leaving")).alias("_stays"), first.alias("_first"))
    decision = F.when(F.coalesce(F.col("_u"), F.lit(False)), "blocked: in use").when((F.col("_stays") == 0) & (F.col("id") == F.col("_first")), "kept: last copy").otherwise("remove")
    return rows.filter("_t").join(whole, "sha256").select("id", decision.alias("decision"))


def pack_findings(overlaps: DataFrame, packs: DataFrame, held: DataFrame) -> DataFrame:
    """``candidate, container, kind, bytes`` of each relation between packs. A pack within another is the candidate to
    go; of identical ones it is the one with less to keep it by: use by projects, known provenance, a place outside
    raw folders, tags. ``packs`` has pack_id, used, complete, path, tags; ``held`` pack_id, sha256, size."""
    # fixed values: the weights
    keep = F.when(F.col("used"), 1000).otherwise(0) + F.when(F.col("complete"), 100).otherwise(0) + F.when(paths.in_raw(F.col("path")), 0).otherwise(50) + F.col("tags")
    score = packs.select("pack_id", keep.alias("keep"))
    bytes_ = held.groupBy("pack_id").agg(F.sum("size").alias("bytes"))
    both = overlaps.join(score.toDF("a", "ka"), "a").join(score.toDF("b", "kb"), "b")
    swap = (F.col("kind") == "b_in_a") | ((F.col("kind") == "identical") & (F.col("ka") > F.col("kb")))
    named = both.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("candidate"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("container"), F.when(F.col("kind").isin("a_in_b", "b_in_a"), "subset").otherwise(F.col("kind")).alias("kind"))
    sized = named.join(bytes_.toDF("candidate", "_bytes"), "candidate")
    return sized.select("candidate", "container", "kind", F.when(F.col("kind") == "overlap", 0).otherwise(F.col("_bytes")).alias("bytes"))


def transferred_asset_tags(asset_tags: DataFrame, assets: DataFrame, moves: DataFrame) -> DataFrame:
    """``asset_id, tag`` that assets of ``to_pack`` gain from assets of ``from_pack`` with the same content: tags set by
    hand that they lack. The join is by pack and content, so equal contents in other packs don't meet. A pack's tags are made distinct before they
    move, and meet the moves in ``SALT`` parts, so a pack of very many assets is not one task's; no side with
    computed hashes or tags is broadcast."""
    by_hand = asset_tags.filter("source = 'manual'").select(F.col("asset_id").alias("id"), "tag")
    marks = assets.select("id", F.col("pack_id").alias("from_pack"), "sha256").join(by_hand.hint("merge"), "id").select("from_pack", "sha256", "tag").distinct()
    turn = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_t")
    salted = moves.filter("from_pack <> to_pack").select("from_pack", "to_pack", turn)
    both = marks.withColumn("_t", F.pmod(F.xxhash64("sha256", "tag"), F.lit(SALT)).cast("int")).join(salted, ["from_pack", "_t"])
    given = both.select(F.col("to_pack").alias("pack_id"), "sha256", "tag").distinct()
    gained = assets.select("pack_id", "sha256", F.col("id").alias("asset_id")).join(given.hint("merge"), ["pack_id", "sha256"]).select("asset_id", "tag")
    return gained.join(asset_tags.select("asset_id", "tag").hint("merge"), ["asset_id", "tag"], "left_anti")


def exact_findings(copies: DataFrame) -> DataFrame:
    """``sha256, copies, bytes, keep_id`` of present files with copies, the most bytes first, with the copy that is worth keeping."""
    there = copies.filter("missing_since is null")
    return exact(there).join(favoured(there).select("sha256", "keep_id"), "sha256").orderBy(F.desc("bytes"), "sha256")


def report(assets: DataFrame, found: DataFrame, near: DataFrame, packs: DataFrame) -> DataFrame:
    """One row: files, findings of each kind, the bytes that removal of files or packs frees, and the larger of these two,
    as both tell of the same bytes. From ``exact_findings``, ``near_findings`` and ``pack_findings``."""
    total = lambda t, name: t.agg(F.count(F.lit(1)).alias(f"{name}_findings"), F.coalesce(F.sum("bytes"), F.lit(0)).alias(f"{name}_bytes"))
    rows = assets.filter("missing_since is null").agg(F.count(F.lit(1)).alias("assets"))
    for part in (total(found, "exact"), total(near, "near").drop("near_bytes"), total(packs, "pack")):
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.agg(*(F.max(c).alias(c) for c in rows.columns)).withColumn("reclaimable", F.greatest("exact_bytes", "pack_bytes"))


def unmatched(asset_tags: DataFrame, assets: DataFrame, moves: DataFrame) -> DataFrame:
    """``from_pack, to_pack, n``: files with a tag set by hand whose content the other pack lacks, so that the tag would be lost."""
    by_hand = asset_tags.filter("source = 'manual'").select(F.col("asset_id").alias("id")).distinct()
    source = assets.join(by_hand, "id", "left_semi").select(F.col("pack_id").alias("from_pack"), "id", "sha256").join(moves.filter("from_pack <> to_pack"), "from_pack")
    target = assets.select(F.col("pack_id").alias("to_pack"), "sha256")
    return source.join(target, ["to_pack", "sha256"], "left_anti").groupBy("from_pack", "to_pack").agg(F.count(F.lit(1)).alias("n"))


def curated(packs: DataFrame, moves: DataFrame, fields: list[str]) -> DataFrame:
    """Packs after provenance is handed on (``moves``: from_pack, to_pack, one source a target): only empty ``fields`` are filled, the
    licence only where there is none; a pack that waited for its provenance is complete if its source was and it has a link and a licence now."""
    source = packs.select(F.col("id").alias("from_pack"), F.col("license_id").alias("_license"), F.col("provenance_state").alias("_state"), *(F.col(c).alias(f"_{c}") for c in fields))
    both = packs.join(moves.filter("from_pack <> to_pack").withColumnRenamed("to_pack", "id"), "id", "left").join(source, "from_pack", "left")
    filled = {c: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.coalesce(F.col(f"_{c}"), F.col(c))).otherwise(F.col(c)) for c in fields}
    out = both.withColumns(filled | {"license_id": F.coalesce("license_id", "_license")})
    done = (F.col("provenance_state") == "needs_provenance") & (F.col("_state") == "complete") & (F.col("source_url") != "") & F.col("license_id").isNotNull()
    return out.withColumn("provenance_state", F.when(done, "complete").otherwise(F.col("provenance_state"))).select(*packs.columns)
