"""State of streams ends: rows fall after expiry, and results are those of the rules over all rows."""

import random

import pytest

from atelier.streaming import watch


def run(spark, tmp_path, batches, schema, make):
    """Each batch is a trigger of its own. The rows put out, and the state rows after each trigger that had data."""
    watch.configure(spark)
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")
    query = make(stream).writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    return spark.read.parquet(f"{tmp_path}/out").collect(), [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_windows_of_failures_end(spark, tmp_path):
    """Hundreds of keys fail once each; later, others do: the counts of the first are gone."""
    rng = random.Random(1)
    batches = [[(f"k{b}-{i}", b * 1000 + rng.randrange(50)) for i in range(100)] + [("steady", b * 1000 + t) for t in (1, 2, 3, 70)] for b in range(4)]
    rows, held = run(spark, tmp_path, batches, "key string, at long", lambda s: watch.limits(s, 2, 60, late="10 seconds"))
    assert len(rows) == 4 * 104
    assert sorted((r["at"] % 1000, r["blocked"]) for r in rows if r["key"] == "steady") == sorted([(1, False), (2, False), (3, True), (70, False)] * 4)
    assert max(held) <= 2.2 * 2 * 101 and held[-1] < 4 * 101


def test_sessions_end(spark, tmp_path):
    batches = [[("a", 0), ("b", 0), ("a", 60)], [("a", 155), ("c", 200)], [("a", 290), ("c", 260)], [("d", 5000)], [("a", 5100), ("d", 5010)]]
    rows, held = run(spark, tmp_path, batches, "key string, at long", lambda s: watch.slid_sessions(s, 100, 200, late="5 seconds"))
    got = {(r["key"], r["at"]): (r["valid"], r["expires"]) for r in rows}
    assert got == {
        ("a", 0): (True, 100), ("b", 0): (True, 100), ("a", 60): (True, 160), ("a", 155): (True, 200), ("c", 200): (True, 300), ("a", 290): (False, 200), ("c", 260): (True, 360),
        ("d", 5000): (True, 5100), ("a", 5100): (True, 5200), ("d", 5010): (True, 5100),
    }
    assert held[-1] < max(held)


def test_progress_ends(spark, tmp_path):
    batches = [[(f"j{b}-{i}", b * 100_000 + t, t // 100, 10) for i in range(30) for t in (0, 100, 450, 500)] for b in range(3)]
    rows, held = run(spark, tmp_path, batches, "job string, at_ms long, done long, total long", lambda s: watch.throttled(s, late="1 second"))
    assert sorted(r["at_ms"] % 100_000 for r in rows) == sorted([0, 450] * 90)
    assert held[-1] < 3 * 2 * 30


@pytest.mark.parametrize(("forgotten", "told"), [(3, 2), (1000, 1)])
def test_files_are_forgotten(spark, tmp_path, forgotten, told):
    """A file that is gone for thirty polls and comes back as it was is told of again if it was forgotten meanwhile."""
    polls = [[(1, "a", 5, 1), (2, "a", 5, 1)], [(30, "b", 1, 1)], [(31, "b", 2, 1)], [(32, "a", 5, 1), (33, "a", 5, 1), (34, "a", 5, 1)]]
    rows, _ = run(spark, tmp_path, polls, "poll long, name string, size long, mtime long", lambda s: watch.settled(s, forgotten, late=1))
    assert [r["name"] for r in rows] == ["a"] * told


def test_the_store_is_asked_for(spark, tmp_path):
    spark.conf.unset(watch.PROVIDER[0])
    with pytest.raises(ValueError, match="RocksDB"):
        watch.limits(spark.range(1).selectExpr("'a' AS key", "id AS at"), 1, 1)
