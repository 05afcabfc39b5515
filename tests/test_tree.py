"""Walking and hashing of real trees, in tasks."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from atelier.operators import reconcile
from atelier.sources import library, tree


@pytest.fixture
def top(tmp_path):
    files = {
        "a/hero.png": b"1", "a/PNG/x [1]#%41?.png": b"22", "a/.gitkeep": b"", "a/_under.png": b"u", "b/.DS_Store": b"z", "_trash/q.png": b"q", "_loose.png": b"l", "c/d/e/f/g.wav": b"333",
        "__MACOSX/a/._x": b"12345", "c/__macosx/y": b"1", ".git/config": b"g", "@eaDir/t": b"t", "empty.png": b"", "pack.asset.json": b"", "日本/é.png": b"u",
    }
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "hollow/inner").mkdir(parents=True)
    os.symlink(tmp_path / "a", tmp_path / "linked")
    os.symlink(tmp_path / "a/hero.png", tmp_path / "c/link.png")
    return tmp_path


WANTED = {"a/hero.png", "a/PNG/x [1]#%41?.png", "a/.gitkeep", "a/_under.png", "_loose.png", "c/d/e/f/g.wav", "empty.png", "pack.asset.json", "日本/é.png"}


def test_files_and_folders(spark, top):
    rows = {(r["path"], r["kind"]): r for r in tree.walk(spark, f"file://{top}").collect()}
    assert {p for p, k in rows if k == "file"} == WANTED
    assert {p for p, k in rows if k == "folder"} == {"a", "a/PNG", "b", "c", "c/d", "c/d/e", "c/d/e/f", "hollow", "hollow/inner", "日本"}
    assert rows["hollow/inner", "folder"]["entries"] == 0 and rows["b", "folder"]["entries"] == 1 and rows["a/hero.png", "file"]["mtime"] == int((top / "a/hero.png").stat().st_mtime)
    assert {r["path"] for r in library.listing(spark, str(top)).collect()} == WANTED


@pytest.mark.parametrize("subtrees", [1, 2, 7, 1000])
@pytest.mark.parametrize("planned", [1, 3, 4096])
def test_any_plan_lists_the_same(top, monkeypatch, subtrees, planned):
    """However many folders the plan looks at and however many tasks share the rest."""
    monkeypatch.setattr(tree, "PLANNED", planned)
    monkeypatch.setattr(tree, "BATCH", 2)
    reader = tree.TreeReader({"root": str(top), "subtrees": str(subtrees)})
    found = [r["path"] for share in reader.partitions() for batch in reader.read(share) for r in batch.to_pylist() if r["kind"] == "file"]
    assert sorted(found) == sorted(WANTED)


def test_a_prefix_keeps_folders_from_being_entered(spark, top, monkeypatch):
    seen = []
    look = tree.look
    monkeypatch.setattr(tree, "look", lambda store, top, folder, rules: seen.append(folder) or look(store, top, folder, rules))
    reader = tree.TreeReader({"root": str(top)})
    assert len(list(reader.pushFilters([tree.StringStartsWith(("path",), "c/d/e")]))) == 1
    assert [r["path"] for s in reader.partitions() for b in reader.read(s) for r in b.to_pylist() if r["kind"] == "file"] == ["c/d/e/f/g.wav"]
    assert seen == ["", "c", "c/d", "c/d/e", "c/d/e/f"]
    found = tree.walk(spark, str(top)).filter(F.col("path").startswith("a/P") & (F.col("kind") == "file"))
    assert [r["path"] for r in found.collect()] == ["a/PNG/x [1]#%41?.png"]


def test_folders_that_cannot_be_read(spark, top, monkeypatch):
    def entries(store, folder, real=tree.entries):
        if folder.endswith("/c/d"):
            raise PermissionError("not yours")
        return real(store, folder)

    monkeypatch.setattr(tree, "entries", entries)
    reader = tree.TreeReader({"root": str(top)})
    rows = [r for s in reader.partitions() for b in reader.read(s) for r in b.to_pylist()]
    assert [(r["path"], r["error"]) for r in rows if r["kind"] == "error"] == [("c/d", "not yours")]
    assert {r["path"] for r in rows if r["kind"] == "file"} == WANTED - {"c/d/e/f/g.wav"}
    with pytest.raises(Exception, match="can't be read"):
        tree.walk(spark, f"{top}/none").collect()


def test_hashes_of_large_and_lost_files(spark, top, monkeypatch):
    """A file of many chunks, an empty one, one that is gone, one outside the tree."""
    with open(top / "big.bin", "wb") as f:
        f.truncate(300 << 20)
    sha = hashlib.sha256()
    for _ in range(300):
        sha.update(bytes(1 << 20))
    files = spark.createDataFrame([("big.bin", 300 << 20), ("empty.png", 0), ("gone", 1), (f"a/../../{top.name}/a/hero.png", 1), ("日本/é.png", 1), (None, None)], "path string, size long")
    got = {r["path"]: r["sha256"] for r in tree.hashed(files, f"file://{top}").collect()}
    assert got["big.bin"] == sha.hexdigest() and got["empty.png"] == hashlib.sha256().hexdigest() and got["日本/é.png"] == hashlib.sha256(b"u").hexdigest()
    assert got["gone"] is got[f"a/../../{top.name}/a/hero.png"] is got[None] is None and len(got) == 6


def test_work_is_shared_out_by_size(spark, monkeypatch):
    """Large files don't meet in one task, and no row is lost; more bytes give more tasks."""
    rows = [(f"f{i}", 1000 if i % 50 == 0 else 1) for i in range(2000)]
    files = spark.createDataFrame(rows, "path string, size long").coalesce(1)
    out = tree.dealt(files).withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in out) == 2000 and max(r["s"] for r in out) - min(r["s"] for r in out) <= 1000 and max(r["n"] for r in out) - min(r["n"] for r in out) <= 1
    monkeypatch.setattr(tree, "TASK_BYTES", 2000)
    assert tree.dealt(files).rdd.getNumPartitions() == -(-sum(s for _, s in rows) // 2000)


def test_rehashing_reads_what_changed(spark, top):
    """A file that can't be read keeps its row; a new one that can't is left out."""
    index = library.listing(spark, str(top), content=True).withColumn("sha256", F.concat(F.lit("old:"), "sha256"))
    stale = index.withColumn("size", F.when(F.col("path").isin("a/hero.png", "a/.gitkeep"), 99).otherwise(F.col("size"))).filter("path <> 'empty.png'")
    got = {r["path"]: r["sha256"] for r in library.rehashed(spark, str(top), stale).collect()}
    assert set(got) == WANTED and {p for p, h in got.items() if not h.startswith("old:")} == {"a/hero.png", "a/.gitkeep", "empty.png"}


def test_verification(spark, top):
    index = library.listing(spark, str(top), content=True).withColumn("missing_since", F.when(F.col("path") == "empty.png", 1))
    index = index.withColumn("sha256", F.when(F.col("path") == "a/hero.png", "rotten").otherwise(F.col("sha256")))
    index = spark.createDataFrame(index.collect(), index.schema)
    (top / "_loose.png").unlink()
    assert tuple(reconcile.verify(index, library.present_hashes(index, str(top))).first()) == (len(WANTED) - 1, 1, 1)


def test_clutter(spark, top):
    known = spark.createDataFrame([("a" * 64,)], "sha256 string")
    for digest in ("a" * 64, "b" * 64):
        (top / "data" / digest).mkdir(parents=True)
        (top / "data" / digest / "t.webp").write_bytes(b"123")
    got = {(r["path"], r["kind"], r["size"]) for r in library.clutter(spark, f"{top}", known, derived=f"{top}/data").collect()}
    assert got == {
        ("__MACOSX", "macos", 5), ("c/__macosx", "macos", 1), ("b/.DS_Store", "system", 1), ("a/.gitkeep", "empty", 0), ("empty.png", "empty", 0), ("hollow/inner", "empty_folder", 0), ("_derived/" + "b" * 64 + "/t.webp", "orphan", 3),
    }


def test_many_small_files_are_few_tasks(spark, tmp_path):
    """400 files and an archive of two: tasks go by files, not by a block a file; hidden ones are left out."""
    from atelier.sources import media, tree

    for k in range(400):
        (tmp_path / f"{k % 3}").mkdir(exist_ok=True)
        (tmp_path / f"{k % 3}" / f"{k} é%41.gltf").write_bytes(b"{%d}" % k)
    (tmp_path / "_h").mkdir()
    for name in ("_h/a.gltf", ".b.gltf", "c.txt"):
        (tmp_path / name).write_bytes(b"no")
    found = media.gltf_texts(spark, f"file://{tmp_path}")
    assert {(r["id"].rsplit("/", 1)[1], r["text"]) for r in found.collect()} == {(f"{k} é%41.gltf", "{%d}" % k) for k in range(400)}
    assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert tree.contents(spark, f"file://{tmp_path}", "[.]none$").count() == 0
