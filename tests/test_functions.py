"""Path, value and text functions, by cases."""

import pytest
from pyspark.sql import functions as F

from atelier.functions import fulltext, paths, values


def one(spark, column, **cells):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'bigint' if isinstance(v, int) else 'double'}" for k, v in cells.items())
    return spark.createDataFrame([tuple(cells.values())], schema).select(column().alias("x")).first()["x"]


@pytest.mark.parametrize("path, want", [
    ("PNG/Plant1/idle.png", "Plant1/idle"), ("PSD/Plant1/idle.psd", "Plant1/idle"), ("ASEPRITE/Plant1/idle.aseprite", "Plant1/idle"), ("fbx(unity)/x.fbx", "x"), ("FBX (Unity)/x.fbx", "x"),
    ("PNG_Animations/a/b.png", "a/b"), ("Objects/b.png", "Objects/b"), ("ai generated/b.png", "ai generated/b"), ("png", "png"), ("a/.hidden", "a/"),
])
def test_group_key(spark, path, want):
    assert one(spark, lambda: paths.group_key(F.col("p")), p=path) == want


@pytest.mark.parametrize("segment, want", [("2 Objects", "objects"), ("2d", "2d"), ("01_intro", "intro"), ("2", ""), ("PNG", ""), ("Épée & Co", "épée-co"), ("3ds", "3ds"), ("--", "")])
def test_token(spark, segment, want):
    assert one(spark, lambda: paths.token(F.col("s")), s=segment) == want


@pytest.mark.parametrize("path, want", [("a/.DS_Store", True), ("__MACOSX/a.png", True), (".Trash-1000/x", True), ("a/._b.png", True), ("a/b.png", False), ("a/git/b", False), ("x/@eaDir/y", True)])
def test_ignored(spark, path, want):
    assert one(spark, lambda: paths.is_ignored(F.col("p")), p=path) is want


@pytest.mark.parametrize("name, want", [("hero.png", True), (".gitkeep", False), ("README.md", False), ("a.zip", False), ("a.mtl", False), ("a.xyz", True), ("LICENSE", False)])
def test_is_asset(spark, name, want):
    assert one(spark, lambda: paths.is_asset(F.col("n")), n=name) is want


def test_small_functions(spark):
    assert one(spark, lambda: paths.kind(F.col("e")), e="GLB") == "model"
    assert one(spark, lambda: paths.kind(F.col("e")), e="zzz") == "other"
    assert one(spark, lambda: paths.slug(F.col("e")), e="  My  Pack!! ") == "my-pack"
    assert one(spark, lambda: paths.slug(F.col("e")), e="!!") == "pack"
    assert one(spark, lambda: paths.ancestors(F.col("p"), 2), p="a/b/c/d.png") == ["", "a", "a/b"]
    assert one(spark, lambda: paths.library_path(F.lit("."), F.col("p")), p="x.png") == "x.png"
    assert one(spark, lambda: paths.tag_valid(F.col("t")), t="a:b c") is False
    assert one(spark, lambda: values.hamming(values.hash_bits(F.col("h")), F.lit(0).cast("long")), h="ffffffffffffffff") == 64
    assert one(spark, lambda: values.similarity_pct(F.col("j")), j=0.6) == 60
    assert one(spark, lambda: values.backoff(F.col("n")), n=9) == 600
    assert one(spark, lambda: values.duration(F.col("n")), n=61_999) == "1:01"
    assert one(spark, lambda: values.percent(F.col("n"), F.lit(0)), n=3) == -1
    assert one(spark, lambda: values.human_bytes(F.col("n")), n=1536) == "1.5 KB"
    assert one(spark, lambda: values.hue_family(F.lit(255), F.lit(0), F.lit(0)), n=1) == 0
    assert one(spark, lambda: values.hue_family(F.lit(10), F.lit(10), F.lit(10)), n=1) == 12


@pytest.mark.parametrize("text, query, prefix, want", [
    ("Café Ambiance Hörn", "cafe horn", False, False), ("Café Ambiance Hörn", "CAFE amb", True, True), ("wooden_sword.png", "swo", True, True), ("wooden_sword.png", "word", True, False),
    ("a b", "a b", False, True), ("ab", "a", False, False), ("x", "!!", True, True), (None, "a", True, False),
])
def test_phrase(spark, text, query, prefix, want):
    assert one(spark, lambda: fulltext.phrase([F.col("t")], query, prefix), t=text) is want
