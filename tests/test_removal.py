"""Plans of removal against the rules in plain Python, target after target."""

import random

import pytest

from atelier.operators import removal

TARGETS = "root string, path string, action string, keep_path string"
ENTRIES = "root string, path string, kind string, size long"


def planned(spark, targets, entries, assets, uses):
    made = removal.plan(
        spark.createDataFrame(targets, TARGETS), spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(assets, "id long, path string, sha256 string"), spark.createDataFrame(uses, "asset_id long, project string"), trash="bin/old",
    )
    return {(r["root"], r["path"], r["action"]): r for r in made.collect()}


def test_each_refusal(spark):
    entries = [("library", p, "file", 10) for p in ("a/x.png", "a/y.png", "a/z.png", "b/x.png", "b/pack.asset.json", "bin/old/q.png", "_inbox/n.png", "loose.txt")]
    entries += [("library", p, "folder", 0) for p in ("a", "b", "bin", "bin/old", "_inbox")] + [("library", "a/l.png", "link", 1), ("library", "a/pipe", "other", 0), ("data", "a/x.png", "file", 3), ("data", "a", "folder", 0)]
    assets = [(1, "a/x.png", "s"), (2, "a/y.png", "s"), (3, "a/z.png", "t"), (4, "b/x.png", "t")]
    targets = [
        ("moon", "a", "trash", None), ("library", "a/x.png", "burn", None), ("", " / ", None, None), ("data", "a/x.png", "link", "a/y.png"), (None, "../etc/passwd", None, None), (None, "a/./x.png", None, None), (None, "none", "trash", None),
        (None, "bin/old/q.png", None, None), (None, "bin/old", None, None), (None, "_inbox", None, None), (None, "b/pack.asset.json", None, None), (None, "a/l.png", None, None), (None, "a/pipe", None, None), (None, "b", "trash", None),
        (None, "a/x.png", "link", None), (None, "a/y.png", "link", "a/y.png"), (None, "a", "link", "b"), (None, "loose.txt", "link", "a/x.png"), (None, "a/z.png", "link", "gone.png"), (None, "b/x.png", "link", "a/x.png"),
        ("library", "/a\\x.png/", "trash", ""), ("data", "a", "trash", None), (None, "loose.txt", "trash", None), (None, "a/x.png", "trash", ""),
    ]
    got = planned(spark, targets, entries, assets, [(4, "game"), (4, "demo"), (9, "none")])
    want = {
        ("moon", "a", "trash"): "unknown root", ("library", "a/x.png", "burn"): "unknown action", ("library", "", "trash"): "empty path", ("data", "a/x.png", "link"): "only library files can be linked",
        ("library", "../etc/passwd", "trash"): "the path leaves its root", ("library", "a/./x.png", "trash"): "the path leaves its root", ("library", "none", "trash"): "not there", ("library", "bin/old/q.png", "trash"): "inside the trash", ("library", "bin/old", "trash"): "inside the trash",
        ("library", "_inbox", "trash"): "a reserved folder", ("library", "b/pack.asset.json", "trash"): "it holds a pack's provenance", ("library", "a/l.png", "trash"): "links are not removed", ("library", "a/pipe", "trash"): "not a regular file",
        ("library", "b", "trash"): "in use by demo, game", ("library", "a/x.png", "link"): "linking needs the copy to keep", ("library", "a/y.png", "link"): "a file is not linked to itself", ("library", "a", "link"): "only files can be linked",
        ("library", "loose.txt", "link"): "not in the index", ("library", "a/z.png", "link"): "the copy to keep is not in the index", ("library", "b/x.png", "link"): "contents differ",
        ("library", "a/x.png", "trash"): None, ("data", "a", "trash"): None, ("library", "loose.txt", "trash"): None,
    }
    assert {k: r["reason"] for k, r in got.items()} == want
    assert got["library", "a/x.png", "trash"]["remaining"] == 1 and got["data", "a", "trash"]["bytes"] == 3 and got["library", "b", "trash"]["files"] == 2 and got["library", "b", "trash"]["assets"] == 1


def by_hand(targets, assets):
    """The paths that are refused: in order, those that would leave some content without a copy."""
    inside = {t: [a for a in assets if a[1] == t or a[1].startswith(t + "/")] for t in targets}
    stay = {}
    for _, _, s in assets:
        stay[s] = stay.get(s, 0) + 1
    for held in inside.values():
        for _, _, s in held:
            stay[s] -= 1
    refused = set()
    for t in sorted(targets):
        if any(stay[s] < 1 for _, _, s in inside[t]):
            refused.add(t)
            for _, _, s in inside[t]:
                stay[s] += 1
    return refused


@pytest.mark.parametrize("seed", range(4))
def test_no_content_loses_its_last_copy(spark, seed):
    """Folders within folders, files that are marked besides their folder, contents of one and of many copies, all copies marked."""
    rng = random.Random(seed)
    assets = [(i, f"d{rng.randrange(6)}/e{rng.randrange(4)}/f{i}.png", f"s{rng.randrange(30) if rng.random() < 0.6 else i}") for i in range(120)]
    folders = sorted({p.rsplit("/", k)[0] for _, p, _ in assets for k in (1, 2)})
    entries = [("library", p, "file", 5) for _, p, _ in assets] + [("library", f, "folder", 0) for f in folders]
    chosen = {p for _, p, _ in assets if rng.random() < 0.4} | {f for f in folders if rng.random() < 0.4}
    got = planned(spark, [("library", p, "trash", None) for p in chosen], entries, assets, [])
    refused = {k[1] for k, r in got.items() if r["decision"] == "refuse"}
    assert refused == by_hand(chosen, assets)
    left = {s for _, p, s in assets if not any(p == t or p.startswith(t + "/") for t in chosen - refused)}
    assert left == {s for _, _, s in assets}


def test_nothing_to_do(spark):
    assert planned(spark, [], [("library", "a", "file", 1)], [(1, "a", "s")], []) == {}
