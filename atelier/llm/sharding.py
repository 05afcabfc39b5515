"""Sharding along a Hilbert curve, so that files can be pruned in several dimensions.

Metadata columns are scaled to ``BITS`` bits each (numbers linearly or by their logarithm,
strings by their first bytes, each between the least and greatest value of the table), the
cell's place on the Hilbert curve is its index, rows are sorted by index and cut into runs.
Neighbours on the curve are neighbours in every dimension, so each run spans short ranges.

The law is ``rows``: counts of any two shards differ by one at most. Rows are dealt to tasks by
ranges of (index, key, digest), so that a hot cell is split by its keys; a task knows its first
row's number from the tasks' counts, and nothing else meets on the driver. Nulls in a
dimension take the least cell. Rows equal in index, key and text are interchangeable: any of
them may come first. An empty table gives an empty result, and empty shards if there are fewer rows
than shards. Other columns are ignored by ``place`` and kept by ``write``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import pinned

BITS = 5


def _number(kind: str, name: str, how: str) -> Column:
    value = F.col(f"`{name}`")
    if kind == "string":  # the first seven bytes as a number, in the order of strings
        return F.conv(F.rpad(F.hex(F.substring(value.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    return F.floor(F.log2(value.cast("double") + 1) * 1024).cast("long") if how == "log" else value.cast("long")


def scaled(value: Column, low, high, bits: int = BITS) -> Column:
    """A whole number from 0 to 2^bits - 1."""
    if low is None:
        return F.lit(0).cast("long")
    span = int(high) - int(low) + 1
    step = max(1, -(-span // (1 << bits)))
    return F.coalesce(F.floor((value - F.lit(int(low))) / F.lit(step)).cast("long"), F.lit(0).cast("long"))


def hilbert(axes: list[Column], bits: int = BITS) -> list[tuple[str, str]]:
    """Named SQL steps that turn columns x0, x1, ... into ``curve``: undo the excess rotations from
    the highest bit down, Gray-encode, and interleave the bits."""
    n, steps, now = len(axes), [], [f"x{i}" for i in range(len(axes))]
    serial = 0

    def name(sql: str) -> str:
        nonlocal serial
        serial += 1
        steps.append((f"h{serial}", sql))
        return f"h{serial}"

    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for i in range(n):
            set_ = f"({now[i]} & {q}) <> 0"
            swap = name(f"CASE WHEN {set_} THEN 0 ELSE ({now[0]} ^ {now[i]}) & {p} END")
            head = name(f"CASE WHEN {set_} THEN {now[0]} ^ {p} ELSE {now[0]} ^ {swap} END")
            if i:
                now[i] = name(f"{now[i]} ^ {swap}")
            now[0] = head
    for i in range(1, n):
        now[i] = name(f"{now[i]} ^ {now[i - 1]}")
    turn = "0L"
    for b in range(bits - 1, 0, -1):
        turn = name(f"CASE WHEN ({now[-1]} & {1 << b}) <> 0 THEN {turn} ^ {(1 << b) - 1} ELSE {turn} END")
    now = [name(f"{x} ^ {turn}") for x in now]
    bits_of = [f"(({now[i]} DIV {1 << b}) & 1) * {1 << (b * n + n - 1 - i)}" for b in range(bits) for i in range(n)]
    steps.append(("curve", " + ".join(bits_of)))
    return steps


def indexed(docs: DataFrame, dims: list[tuple[str, str]]) -> DataFrame:
    """``docs`` with ``curve``. A dimension is (column, "linear" or "log")."""
    kinds = dict(docs.dtypes)
    numbers = [_number(kinds[c], c, how) for c, how in dims]
    ends = docs.agg(*(f(x).alias(f"{e}{i}") for i, x in enumerate(numbers) for e, f in (("low", F.min), ("high", F.max)))).first()
    out = docs.withColumns({f"x{i}": scaled(x, ends[f"low{i}"], ends[f"high{i}"]) for i, x in enumerate(numbers)})
    steps = hilbert([F.col(f"x{i}") for i in range(len(dims))])
    for step, sql in steps:
        out = out.withColumn(step, F.expr(sql))
    return out.drop(*(s for s, _ in steps if s != "curve"))


def place(docs: DataFrame, dims: list[tuple[str, str]], shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, size, text_crc32, curve, shard, slot`` of each row."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = indexed(docs, dims).select(F.col(key).alias("key"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), "curve")
    spread = rows.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "curve", "key", "text_crc32").sortWithinPartitions("curve", "key", "text_crc32")
    held = pinned(spread.select("*", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).alias("nth")))
    counts = sorted((r["part"], r["n"]) for r in held.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a task
    before, total = {}, 0
    for part, n in counts:
        before[part], total = total, total + n
    first = F.create_map(*(F.lit(x).cast("long") for pair in before.items() for x in pair)) if before else F.lit(None).cast("map<bigint,bigint>")
    rank = first[F.col("part").cast("long")] + F.col("nth")
    small, more = divmod(total, shards)
    # the first `more` shards hold one row more
    big = more * (small + 1)
    shard = F.when(F.col("rank") < big, F.floor(F.col("rank") / (small + 1))).otherwise(F.floor((F.col("rank") - big) / max(1, small)) + more)
    begin = F.when(F.col("shard") < more, F.col("shard") * (small + 1)).otherwise(big + (F.col("shard") - more) * small)
    out = held.withColumn("rank", rank).withColumn("shard", shard.cast("int"))
    return out.select(F.col("key").alias(key), "size", "text_crc32", "curve", "shard", (F.col("rank") - begin).cast("long").alias("slot"))


def write(docs: DataFrame, path: str, dims: list[tuple[str, str]], shards: int = 8, key: str = "doc_id") -> None:
    """Write ``docs`` as Parquet in ``shards`` folders, each sorted along the curve, so that readers
    prune files and row groups by any of the dimensions. The ranges come from the range
    partitioner's sample, so counts are near equal here; ``place`` gives the exact cut."""
    rows = indexed(docs, dims).drop(*(f"x{i}" for i in range(len(dims))))
    ranged = rows.repartitionByRange(shards, "curve", key).sortWithinPartitions("curve", key)
    ranged.withColumn("shard", F.spark_partition_id()).drop("curve").write.partitionBy("shard").parquet(path)
