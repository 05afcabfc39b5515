"""Operators over small tables, by the rules they follow."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from atelier.operators import activity, components, duplicates, facets, features, groups, listing, provenance, reconcile, search, tags


def test_search_end_to_end(spark):
    assets = spark.createDataFrame([(1, 1, "weapons/wooden_sword.png", "image", 32), (2, 1, "weapons/laser_gun.png", "image", None), (3, 2, "sfx/explosion.wav", "audio", None)], "id int, pack_id int, library_path string, kind string, width int")
    own = spark.createDataFrame([(1, "type:melee:sword"), (3, "type:sfx:impact")], "asset_id int, tag string")
    packs = spark.createDataFrame([(2, "license:cc0")], "pack_id int, tag string")
    text = ["library_path"]

    def ids(where):
        return sorted(r["id"] for r in search.matching(assets, where).collect())

    tagged = lambda t: search.tagged(t, assets, own, packs)
    assert ids(search.kind("audio")) == ids(tagged("type:sfx:impact")) == ids(tagged("license:cc0")) == [3]
    assert ids(search.word(text, "wood")) == ids(tagged("type:melee")) == [1]
    assert ids(~search.kind("audio")) == [1, 2]
    assert ids(search.kind("audio") | tagged("type:melee")) == [1, 3]
    assert ids(search.quoted(text, "laser")) == [2]
    assert ids(tagged("theme:none")) == ids(search.never()) == []
    assert ids(~search.compare("width", ">", 64)) == [1]  # an unknown width meets nothing
    for bad in ("..", ".", "", "/", "../.."):
        assert ids(search.in_folder(bad)) == [1, 2, 3]


def test_colours(spark):
    rows = {"rust": ["8b3a3a@.5", "4a3b2f@.3", "d9c7a1@.2"], "alike": ["8d3c3d@.4", "4c3d30@.35", "dbc9a3@.25"], "forest": ["2f6b35@.6", "173a1c@.4"], "undecided": ["112233@.999", "8b3a3a@.001"]}
    names = list(rows)
    swatches = spark.createDataFrame(
        [(i, k, *(int(s[j : j + 2], 16) for j in (0, 2, 4)), float(s.split("@")[1])) for i, n in enumerate(names) for k, s in enumerate(rows[n])], "asset_id int, rank int, r int, g int, b int, ratio double"
    )
    assets = spark.createDataFrame([(i,) for i in range(4)], "id int")
    got = lambda where: [names[r["id"]] for r in search.matching(assets, where).orderBy("id").collect()]
    assert got(search.colour(swatches, "#8b3a3a")) == ["rust", "alike"]
    assert got(search.colour(swatches, "#8b3a3a", 0)) == ["rust"]
    assert got(search.colour(swatches, "#8d3c3d", 1)) == ["alike"]
    assert got(search.colour(swatches, "#808080", 255)) == names
    assert got(~search.colour(swatches, "#8b3a3a")) == ["forest", "undecided"]
    assert got(search.palette_near(swatches, 0)) == ["rust", "alike"]
    assert got(search.palette_near(swatches, 2)) == ["forest"]
    assert got(search.palette_near(swatches, 99)) == []


def test_paging_covers_every_row_once(spark):
    assets = spark.createDataFrame([(i, f"f{i % 3}", 5, "k", None, None, None, i, i) for i in range(25)], "id int, filename string, size int, kind string, width int, height int, tri_count int, first_seen_at int, mtime int")
    for order in listing.orders():
        seen = [r["id"] for n in (1, 2, 3) for r in listing.page(assets, order, n, 10).collect()]
        assert sorted(seen) == list(range(25))
    seen, name, key = [], "", -1
    while True:
        rows = listing.after(assets, name, key, 10).collect()
        seen += [r["id"] for r in rows[:10]]
        if len(rows) <= 10:
            break
        name, key = rows[9]["filename"], rows[9]["id"]
    assert sorted(seen) == list(range(25))
    assert listing.page_numbers(6, 20) == [1, None, 5, 6, 7, None, 20]


def test_tree(spark):
    files = spark.createDataFrame([(p,) for p in ("2d/pack-a/PNG/hero.png", "2d/pack-a/PNG/tree.png", "2d/pack-a/PSD/hero.psd", "2d/pack-b/sprite.png", "audio/hit.wav", "loose.png")], "path string")
    got = {r["dir"]: (r["assets"], r["direct"]) for r in facets.tree(files, "path", 8).collect()}
    assert got == {"": (6, 1), "2d": (4, 0), "2d/pack-a": (3, 0), "2d/pack-a/PNG": (2, 2), "2d/pack-a/PSD": (1, 1), "2d/pack-b": (1, 1), "audio": (1, 1)}
    assert {r["dir"] for r in facets.visible(facets.tree(files, "path", 8), "2d").collect()} == {"", "2d", "2d/pack-a", "2d/pack-b", "audio"}


def test_groups(spark):
    rows = [(1, 1, "PSD/Plant1/idle.psd", "psd", None), (2, 1, "PNG/Plant1/idle.png", "png", None), (3, 1, "ASEPRITE/Plant1/idle.aseprite", "aseprite", None), (4, 1, "PNG/b.png", "png", 7), (5, 1, "PSD/b.psd", "psd", None)]
    got = {r["group_key"]: (r["primary_id"], r["variants"]) for r in groups.regroup(spark.createDataFrame(rows, "id int, pack_id int, rel_path string, ext string, missing_since int")).collect()}
    assert got == {"Plant1/idle": (2, 3), "b": (5, 2)}  # a missing png does not show its group


INDEX, LISTING = "id int, path string, size int, mtime int, sha256 string, missing_since int", "path string, size int, mtime int, sha256 string"


def test_reconcile(spark):
    index = spark.createDataFrame([
        (1, "same", 1, 1, "a", None), (2, "changed", 1, 1, "b", None), (3, "touched", 1, 1, "c", None), (4, "old/x", 1, 1, "d", None), (5, "lost", 1, 1, "e", None),
        (6, "back", 1, 1, "f", 9), (7, "long gone", 1, 1, "g", 9), (8, "x/.DS_Store", 1, 1, "h", None), (9, "old/y", 1, 1, "d", None),
    ], INDEX)
    files = spark.createDataFrame([("same", 1, 1, "a"), ("changed", 1, 2, "b2"), ("touched", 1, 2, "c"), ("new/x", 1, 1, "d"), ("back", 1, 1, "f"), ("fresh", 1, 1, "z")], LISTING)
    found = reconcile.resolved(index, files)
    got = {r["path"]: (r["status"], r["id"]) for r in found.collect()}
    assert got == {
        "same": ("unchanged", 1), "changed": ("content_changed", 2), "touched": ("metadata_only", 3), "new/x": ("moved", 4), "old/x": ("gone", 4), "old/y": ("missing", 9), "lost": ("missing", 5),
        "back": ("reappeared", 6), "long gone": ("still_missing", 7), "x/.DS_Store": ("purged", 8), "fresh": ("added", None),
    }
    after = {r["path"]: r for r in reconcile.snapshot(found, 50).collect()}
    assert set(after) == set(got) - {"old/x", "x/.DS_Store"} and after["lost"]["missing_since"] == 50 and after["back"]["missing_since"] is None and after["changed"]["content_changed_at"] == 50
    with pytest.raises(reconcile.EmptyListing):
        reconcile.resolved(index, files.limit(0))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 120)] + [(200, 200), (5, 5), (3, 2)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 120)}, 200: 200}
    assert components.components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_components_of_a_long_chain_in_random_order(spark):
    ids = random.Random(1).sample(range(10**6), 2_000)
    chain = spark.createDataFrame(list(zip(ids, ids[1:])), "a int, b int")
    got = {(r["node"], r["component"]) for r in components.components(chain, "a", "b").collect()}
    assert got == {(i, min(ids)) for i in ids}
    with pytest.raises(RuntimeError):
        components.components(chain, "a", "b", rounds=2)


def test_near_findings(spark):
    """Copies and variants are no near images; a hash that many share; the longest link and the bytes."""
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(6)]
    rows = [(i, rng.choice(base) ^ (1 << rng.randrange(12) if rng.random() < 0.6 else 0), f"s{rng.randrange(25)}", rng.choice([None, 0, 1, 2]), rng.randrange(1, 99)) for i in range(90)]
    rows += [(100 + i, 7, f"t{i % 9}", i % 4, 5) for i in range(30)] + [(200, None, "x", 0, 1), (201, 1 << 40, "y", 3, 1), (202, 1 << 40, "z", 3, 1), (203, 3 << 50, "w", 0, 1), (204, 3 << 50, "w", 0, 1)]
    links = [(a, b, (a[1] ^ b[1]).bit_count()) for a, b in itertools.combinations([r for r in rows if r[1] is not None], 2) if a[2] != b[2] and not (a[3] and a[3] == b[3]) and (a[1] ^ b[1]).bit_count() <= 5]
    name = {r[0]: r[0] for r in rows}
    for a, b, _ in links:
        old, new = max(name[a[0]], name[b[0]]), min(name[a[0]], name[b[0]])
        name = {k: new if v == old else v for k, v in name.items()}
    want = {}
    for c in {name[a[0]] for a, _, _ in links}:
        sizes = [r[4] for r in rows if name[r[0]] == c]
        want[c] = (len(sizes), sum(sizes) - max(sizes), max(d for a, _, d in links if name[a[0]] == c))
    table = spark.createDataFrame(rows, "id int, phash bigint, sha256 string, group_id int, size int")
    got = {r["cluster_id"]: (r["members"], r["bytes"], r["max_distance"]) for r in duplicates.near_findings(table).collect()}
    assert got == want and duplicates.near_findings(table.limit(0)).count() == 0


def test_near_pairs_lose_none(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(12)]
    hashes = base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 7))) for b in base for _ in range(6)]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    got = {(r["a"], r["b"], r["dist"]) for r in duplicates.near_pairs(spark.createDataFrame(list(enumerate(signed)), "id int, phash bigint")).collect()}
    first = {}
    for i, h in enumerate(hashes):
        first.setdefault(h, i)
    want = {(i, j, (hashes[i] ^ hashes[j]).bit_count()) for i, j in itertools.combinations(range(len(hashes)), 2) if (hashes[i] ^ hashes[j]).bit_count() <= 5 and (hashes[i] == hashes[j] and first[hashes[i]] == i or first[hashes[i]] == i and first[hashes[j]] == j)}
    assert got == want


def test_packs_and_transfer(spark):
    held = spark.createDataFrame([(1, c) for c in "abcd"] + [(2, c) for c in "abcd"] + [(3, c) for c in "ab"] + [(4, c) for c in "abcxy"] + [(5, c) for c in "qrsa"], "pack_id int, sha256 string")
    got = {(r["a"], r["b"]): (r["kind"], r["shared"]) for r in duplicates.pack_overlaps(held).collect()}
    assert got == {(1, 2): ("identical", 4), (1, 3): ("b_in_a", 2), (2, 3): ("b_in_a", 2), (1, 4): ("overlap", 3), (2, 4): ("overlap", 3), (3, 4): ("a_in_b", 2)}


def test_removal_keeps_the_last_copy(spark):
    copies = spark.createDataFrame([(1, "a", "x/1"), (2, "a", "x/2"), (3, "b", "y/3"), (4, "b", "y/4"), (5, "c", "z/5")], "id int, sha256 string, path string")
    plan = duplicates.removal_plan(copies, spark.createDataFrame([(i,) for i in (1, 2, 3, 5)], "id int"), spark.createDataFrame([(3,)], "id int"))
    assert {r["id"]: r["decision"] for r in plan.collect()} == {1: "kept: last copy", 2: "remove", 3: "blocked: in use", 5: "kept: last copy"}


def test_tags(spark):
    got = {(r["ancestor"], r["descendant"], r["depth"]) for r in tags.closure(spark.createDataFrame([("a:b:c",), ("x:y",)], "tag string")).collect()}
    assert got == {("a:b", "a:b", 0), ("a:b", "a:b:c", 1), ("a:b:c", "a:b:c", 0), ("x:y", "x:y", 0)}
    stored = spark.createDataFrame([(1, "folder:a", "auto_path"), (1, "kept", "manual"), (1, "folder:b", "auto_path")], "asset_id int, tag string, source string")
    derived = spark.createDataFrame([(1, "folder:b", "auto_path"), (1, "kept", "auto_type"), (1, "new", "auto_type")], "asset_id int, tag string, source string")
    assert {(r["tag"], r["source"], r["change"]) for r in tags.retag(stored, derived).collect()} == {("folder:a", "auto_path", "pruned"), ("kept", "manual", "kept"), ("folder:b", "auto_path", "kept"), ("new", "auto_type", "added")}


def test_uses(spark):
    uses = spark.createDataFrame([(1, 1, "r", "a", 5, 9)], "project_id int, asset_id int, res_path string, asset_sha256 string, added_at int, removed_at int")
    assets = spark.createDataFrame([(1, "a"), (2, "b")], "id int, sha256 string")
    new = spark.createDataFrame([(1, 1, "r", "a"), (1, 1, "s", "b"), (1, 7, "t", "zz")], "project_id int, asset_id int, res_path string, asset_sha256 string")
    got = {(r["asset_id"], r["res_path"]): (r["added_at"], r["removed_at"]) for r in provenance.recorded_use(uses, new, assets, 20).collect()}
    assert got == {(1, "r"): (5, None), (2, "s"): (20, None), (7, "t"): (20, None)}


def test_activity(spark):
    jobs = spark.createDataFrame([(1, "queued", "d"), (2, "running", "d"), (3, "done", "d"), (4, "queued", None), (5, "queued", None)], "id int, state string, dedupe_key string")
    assert sorted(r["id"] for r in activity.one_each(jobs).collect()) == [1, 3, 4, 5]
    with pytest.raises(ValueError):
        activity.retained(jobs, "id", 0)


def test_features(spark):
    flat = [(1, x, y, 10, 20, 30, 255) for x in range(18) for y in range(16)]
    ramp = [(2, x, y, 255 - 14 * x, 255 - 14 * x, 255 - 14 * x, 255 if x else 100) for x in range(18) for y in range(16)]
    pixels = spark.createDataFrame(flat + ramp, "img int, x int, y int, r int, g int, b int, a int")
    hashes = {r["img"]: r["phash"] for r in features.difference_hash(pixels).collect()}
    assert hashes[1] == 0 and hashes[2] == -1
    stats = {r["img"]: r for r in features.image_stats(pixels).collect()}
    assert not stats[1]["has_alpha"] and stats[2]["has_semitransparent"] and stats[1]["color_count"] == 1
    tone = spark.createDataFrame([(1, i, 0.5, 1000) for i in range(300)] + [(2, i, 0.0, 1000) for i in range(100)], "clip int, i int, v double, rate int")
    sound = {r["clip"]: r for r in features.sound(tone).collect()}
    assert sound[1]["is_loopable"] and sound[1]["duration_ms"] == 300 and not sound[2]["is_loopable"] and sound[2]["peak_dbfs"] == -120.0
    gltf = '{"accessors":[{"count":24,"type":"VEC3","min":[0,0,0],"max":[1,2,3]},{"count":36}],"meshes":[{"primitives":[{"attributes":{"POSITION":0},"indices":1}]}],"materials":[{"name":"m"}],"animations":[{"name":"walk"}]}'
    row = features.models(spark.createDataFrame([(1, gltf), (2, "bad")], "id int, text string")).filter("id = 1").first()
    assert (row["vert_count"], row["tri_count"], row["material_count"], row["animations"], row["bbox_z"]) == (24, 12, 1, ["walk"], 3.0)
    assert features.palette(pixels).filter("img = 1").first()["ratio"] == 1.0


def test_hues_spread(spark):
    rows = [(r, g, b, w, 1, r // 24, g // 24, b // 24) for r, g, b, w in [(5, 5, 5, 9.0), (8, 8, 8, 8.0), (200, 40, 40, 5.0), (210, 50, 40, 4.0), (40, 200, 40, 1.0), (40, 40, 200, 0.5), (200, 200, 40, 0.4)]]
    got = [(x["r"], x["g"], x["b"]) for x in facets.spread_hues(spark.createDataFrame(rows, "r int, g int, b int, weight double, assets int, br int, bg int, bb int"), 5).collect()]
    assert (40, 200, 40) in got and (40, 40, 200) in got and (8, 8, 8) not in got
    assert F is not None


def test_median_cut_and_exports(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    cells = [(1, x, y, *(int(v) for v in rng.integers(0, 256, 3)), 255) for x in range(40) for y in range(30)] + [(2, 0, 0, 9, 9, 9, 255), (2, 1, 0, 9, 9, 9, 0)]
    pixels = spark.createDataFrame(cells, "img int, x int, y int, r int, g int, b int, a int")
    rows = features.median_cut(pixels).collect()
    many = [r for r in rows if r["img"] == 1]
    assert len(many) == 16 and abs(sum(r["ratio"] for r in many) - 1) < 1e-9 and max(r["ratio"] for r in many) <= 8 * min(r["ratio"] for r in many)
    mean = np.array([sum(r[c] * r["ratio"] for r in many) for c in "rgb"])
    assert np.abs(mean - np.array([c[3:6] for c in cells[:1200]]).mean(0)).max() < 1
    assert [(r["r"], r["ratio"]) for r in rows if r["img"] == 2] == [(9, 1.0)]
    assert len({r["rank"] for r in features.median_cut(pixels, 16, 100).filter("img = 1").collect()}) == 16
    one = features.palette(pixels).filter("img = 2")
    assert features.palette_text(one, "gd").first()["text"] == "# palette\nconst PALETTE: Array[Color] = [\n\tColor(0.035, 0.035, 0.035),\n]\n"
    assert "PackedFloat32Array(0.000000)" in features.palette_text(one, "tres").first()["text"]


def test_obj_models(spark):
    text = "v 0 0 0\nv 1 0 0\nv 1 2 0\nv 0 2 3\nusemtl a\nf 1 2 3 4\nusemtl b\nf 1/1 2/2 3/3\n# end"
    row = features.obj_models(spark.createDataFrame([(1, text), (2, None)], "id int, text string")).filter("id = 1").first()
    assert (row["vert_count"], row["tri_count"], row["material_count"], row["bbox_x"], row["bbox_z"]) == (4, 3, 2, 1.0, 3.0)


def test_sheets(spark):
    """Four by two frames of 16 by 16 with clear gutters at their edges."""
    cells = [(1, x, y, 255 if 2 <= x % 16 < 14 and 2 <= y % 16 < 14 else 0) for x in range(64) for y in range(32)] + [(2, x, y, 255) for x in range(20) for y in range(7)]
    found = features.sheet_candidates(spark.createDataFrame(cells, "img int, x int, y int, a int")).cache()
    best = features.sheet_grid(found).collect()
    assert [(r["img"], r["cols"], r["rows"], r["confident"]) for r in best if r["img"] == 1] == [(1, 4, 2, True)]
    wide = found.filter("img = 1 and cols = 2 and rows = 1").first()
    assert wide["seam"] == 1.0 and wide["square"] == 1.0 and wide["content"] == 1.0
    names = spark.createDataFrame([("hero_sheet.png", 5, 5), ("walk-8f.png", 5, 5), ("rock.png", 64, 32), ("rock.png", 13, 13)], "f string, w int, h int")
    assert [r[0] for r in names.select(features.may_be_sheet(F.col("f"), F.col("w"), F.col("h"))).collect()] == [True, True, True, False]


def test_last_token():
    assert [facets.last_token(q) for q in ("type:model tur", "a ", "", '"open quo', '"a b" c')] == ["tur", "", "", "", "c"]


def test_assets_are_not_broadcast(spark, folder):
    """Hashes are made from short columns, so Spark takes assets for small tables."""
    from atelier.plans import more, registry  # noqa: F401

    plan = registry.QUERIES["project_outdated"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_tags_of_a_large_pack_are_dealt_out(spark, folder):
    from atelier.operators import duplicates
    from atelier.plans import more, registry  # noqa: F401

    plan = registry.QUERIES["asset_tag_transfer"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3
    assets = spark.range(1000).selectExpr("id", "id % 2 AS pack_id", "id div 4 AS sha256")
    tags = assets.selectExpr("id AS asset_id", "concat('t', id % 3) AS tag", "if(id % 5 = 0, 'auto', 'manual') AS source")
    moves = spark.createDataFrame([(0, 1), (1, 1)], "from_pack long, to_pack long")
    got = {tuple(r) for r in duplicates.transferred_asset_tags(tags, assets, moves).collect()}
    has = {i: f"t{i % 3}" for i in range(1000)}
    given = {(i // 4, has[i]) for i in range(0, 1000, 2) if i % 5}
    assert got == {(i, t) for i in range(1, 1000, 2) for s, t in given if s == i // 4 and t != has[i]} and len(got) > 300
