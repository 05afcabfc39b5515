"""Listings of real folders, published versions, and streams run to their end."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from atelier.sources import library
from atelier.streaming import watch


@pytest.fixture
def tree(tmp_path):
    files = {"a/hero.png": b"1", "a/PNG/x.png": b"22", "b/PSD/y.psd": b"y", "b/.DS_Store": b"z", "_reserved/q.png": b"q", "c/deep/z.wav": b"333", "c/pack.asset.json": json.dumps({"name": "C", "author": "me", "updated_at": 9}).encode()}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return tmp_path


def test_listing(spark, tree):
    got = {r["path"]: (r["size"], r["sha256"]) for r in library.listing(spark, f"file://{tree}", content=True).collect()}
    assert set(got) == {"a/hero.png", "a/PNG/x.png", "b/PSD/y.psd", "c/deep/z.wav", "c/pack.asset.json"}
    assert got["a/hero.png"] == (1, hashlib.sha256(b"1").hexdigest())
    assert {r["pack"] for r in library.packs(library.listing(spark, f"file://{tree}")).collect()} == {"a", "b", "c"}
    index = library.listing(spark, f"file://{tree}", content=True)
    index = spark.createDataFrame(index.collect(), index.schema)  # a listing is made anew each time
    assert sorted(map(tuple, library.rehashed(spark, f"file://{tree}", index).collect())) == sorted(map(tuple, index.collect()))
    # what is the same keeps the hash of the index, unread; what differs or is new is read
    kept, touched = sorted(r["path"] for r in index.collect())[:2]
    (tree / touched).write_bytes(b"other content")
    (tree / "a/odd [x]{1}*?.png").write_bytes(b"odd")
    stale = index.withColumn("sha256", F.when(F.col("path") == kept, "stored").otherwise(F.col("sha256")))
    now = {r["path"]: r["sha256"] for r in library.rehashed(spark, f"file://{tree}", stale).collect()}
    assert now[kept] == "stored" and now[touched] == hashlib.sha256(b"other content").hexdigest() and now["a/odd [x]{1}*?.png"] == hashlib.sha256(b"odd").hexdigest() and len(now) == index.count() + 1


def test_sidecars(spark, tree):
    found = library.sidecars(spark, f"file://{tree}")
    assert found.first()["author"] == "me"
    stored = spark.createDataFrame([(found.first()["pack"], True, None, "old", None, None, 5)], "pack string, has_metadata boolean, source_url string, author string, license string, notes string, updated_at long")
    assert library.imported(stored, found).first()["author"] == "me"
    assert not library.imported(stored.withColumn("updated_at", stored["updated_at"] + 4), found).first()["imported"]


def test_versions(spark, tmp_path):
    folder = f"file://{tmp_path}/table"
    library.publish(spark.range(3), folder)
    import time

    time.sleep(1.1)
    library.publish(spark.range(5), folder)
    assert library.latest(spark, folder).count() == 5


def test_junk(spark):
    files = spark.createDataFrame([("a/.DS_Store", 5), ("a/x.png", 0), ("__MACOSX/a", 3), ("_derived/" + "a" * 64 + "/t.webp", 3), ("_derived/" + "b" * 64 + "/t.webp", 3), ("ok.png", 1)], "path string, size int")
    got = {r["path"][:12]: r["kind"] for r in library.junk(files, spark.createDataFrame([("a" * 64,)], "sha256 string")).collect()}
    assert got == {"a/.DS_Store": "system", "a/x.png": "empty", "__MACOSX/a": "macos", "_derived/bbb": "orphan"}


def run(spark, tmp_path, rows, schema, make, name):
    watch.configure(spark)
    source = tmp_path / "in"
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_settled_files(spark, tmp_path):
    polls = [[(1, "a", 5, 1), (1, "b", 5, 1)], [(2, "a", 5, 1), (2, "b", 6, 1)], [(3, "a", 5, 1), (3, "b", 6, 1)]]
    got = run(spark, tmp_path, polls, "poll long, name string, size long, mtime long", watch.settled, "settled")
    assert sorted(r["name"] for r in got) == ["a", "b"]


def test_limits_start_with_the_first_failure(spark, tmp_path):
    got = run(spark, tmp_path, [[("u", t) for t in (55, 58, 61, 64, 130)]], "key string, at long", lambda s: watch.limits(s, 3, 60), "limits")
    assert {r["at"]: r["blocked"] for r in got} == {55: False, 58: False, 61: False, 64: True, 130: False}


def test_sessions_slide_late(spark, tmp_path):
    got = run(spark, tmp_path, [[("u", t) for t in (0, 10, 60, 155, 300)]], "key string, at long", lambda s: watch.slid_sessions(s, 100, 200), "slid")
    assert {r["at"]: (r["valid"], r["expires"]) for r in got} == {0: (True, 100), 10: (True, 100), 60: (True, 160), 155: (True, 200), 300: (False, 200)}


def test_throttled_progress(spark, tmp_path):
    got = run(spark, tmp_path, [[("j", t, d, 10) for t, d in ((0, 1), (100, 2), (450, 3), (500, 10))]], "job string, at_ms long, done long, total long", watch.throttled, "throttled")
    assert sorted(r["done"] for r in got) == [1, 3, 10]


def test_sounds_and_archives(spark, tmp_path):
    import math
    import struct
    import wave
    import zipfile

    from atelier.operators import features
    from atelier.sources import media

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(1000)
        w.writeframes(b"".join(struct.pack("<hh", v, v) for v in (int(20000 * math.sin(i / 5)) for i in range(500))))
    (tmp_path / "bad.wav").write_bytes(b"RIFFnothing")
    sound = features.sound(media.wav_samples(spark, f"file://{tmp_path}")).collect()
    assert len(sound) == 1 and sound[0]["duration_ms"] == 500 and -5 < sound[0]["peak_dbfs"] < -4
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("top/a.png", "aaa")
        z.writestr("top/b.png", "b")
    (tmp_path / "q.zip").write_bytes(b"no zip")
    rows = {(r["archive"][-5:], r["name"]): (r["size"], r["error"] is None) for r in media.zip_entries(spark, f"file://{tmp_path}").collect()}
    assert rows == {("p.zip", "top/a.png"): (3, True), ("p.zip", "top/b.png"): (1, True), ("q.zip", None): (None, False)}


def test_png(spark, tmp_path):
    import random
    import struct
    import zlib

    from atelier.sources import media

    rng = random.Random(6)
    width, height = 7, 6
    cells = [[[rng.randrange(256) for _ in range(4)] for _ in range(width)] for _ in range(height)]

    def filtered(y, how):
        line = []
        for x in range(width):
            for k in range(4):
                left, up = cells[y][x - 1][k] if x else 0, cells[y - 1][x][k] if y else 0
                corner = cells[y - 1][x - 1][k] if x and y else 0
                p = left + up - corner
                near = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                line.append((cells[y][x][k] - [0, left, up, (left + up) // 2, near][how]) % 256)
        return bytes([how, *line])

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    image = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(filtered(y, y % 5) for y in range(height)))) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(image)
    (tmp_path / "b.png").write_bytes(b"nothing")
    rows = media.png_pixels(spark, f"file://{tmp_path}").collect()
    assert {(r["x"], r["y"]): [r["r"], r["g"], r["b"], r["a"]] for r in rows if r["error"] is None} == {(x, y): cells[y][x] for y in range(height) for x in range(width)}
    assert [r["img"][-5:] for r in rows if r["error"]] == ["b.png"]


def test_reports_and_marked_folders(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x")], "n int, s string")
    library.write_report(rows, f"file://{tmp_path}/r")
    library.write_report(rows.union(rows), f"file://{tmp_path}/r")
    assert library.read_report(spark, f"file://{tmp_path}/r", "n int, s string").count() == 2
    files = spark.createDataFrame([("a/b/pack.asset.json",), ("c/x.png",)], "path string")
    assert sorted(r["dir"] for r in library.marked_folders(files).collect()) == ["a", "a/b"]


def test_windows_close_with_the_watermark(spark, tmp_path):
    import datetime

    at = lambda minute: datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=minute)
    parts = [[(at(1), "a"), (at(4), "b"), (at(11), "a")], [(at(40), "a"), (at(2), "a")], [(at(41), "a")], [(at(3), "late"), (at(90), "a")]]
    got = run(spark, tmp_path, parts, "ts timestamp, event_type string", lambda s: watch.windowed_counts(s, "ts", "10 minutes", "10 minutes"), "windows")
    rows = {(r["start"].minute, r["event_type"]): r["n"] for r in got}
    # what came within ten minutes of the latest time is counted, the row that came after its window closed is not
    assert rows[(10, "a")] == 1 and rows[(40, "a")] == 2 and rows[(0, "b")] == 1
    assert (0, "late") not in rows and rows[(0, "a")] in (1, 2)


def test_one_entry_a_key(spark, tmp_path):
    import datetime

    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    parts = [[(at(0), "k", 1), (at(1), "k", 2)], [(at(2), "k", 3), (at(3), "m", 4)]]
    got = run(spark, tmp_path, parts, "at timestamp, dedupe_key string, id int", lambda s: watch.last_states(s, "at", "1 hour"), "entries")
    assert sorted(r["dedupe_key"] for r in got) == ["k", "m"]
