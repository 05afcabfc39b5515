"""Benchmark decontamination by a prefix-filtered join of shingles, verified exactly.

An item's windows are its runs of ``WINDOW`` words (an item of fewer words is one window). A
window is a set of five-word shingles (shorter windows are one shingle), and it occurs in a
document only where all of them do, so its prefix of necessary shingles is a single one: the
rarest. Rarity is counted over all documents, in a table of fixed size. Documents and windows are
joined on these prefix shingles alone; a candidate place must leave room for the whole window within the
document (length and positional bounds), and the words there must equal the window's words, byte for byte.

Documents are read twice whatever the benchmark's size: once to count shingles, once to look for places of prefix
shingles, which a Bloom filter of fixed size lets through. Windows are tables that Spark joins; nothing of either side is
gathered, but for what the findings of one text are. Places are told by the text they are in: equal texts have equal findings, and are joined back by two
hashes of the text (128 bits). A shingle's rows are salted, so that a passage that very many documents hold is dealt to several tasks.

A null text has no words; an item without an id marks words but can't be listed; repeated items count
once; repeated documents give repeated rows. Empty tables on either side give no hits. Extra
columns are kept unless an output column bears their name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scratch import cut
from ._arrow import add, bounded
from ._words import ALNUM, Runs, Texts, batches

WINDOW, SHINGLE = 10, 5
#: Bits of the hash by which shingles are counted and let through: a table of 2^COUNTED counters, a Bloom filter of 2^PASSED bits.
COUNTED, PASSED = 20, 25
#: Rows of one shingle are dealt to so many tasks.
SALTS = 16
#: Texts with findings up to which they are broadcast (16 bytes each); beyond, texts are joined by a shuffle.
BROADCAST_TEXTS = 500_000
FINDINGS = ("n_words", "n_hit", "_items", "_spans")
WINDOWS = T.StructType([T.StructField("window", T.BinaryType()), T.StructField("size", T.IntegerType()), T.StructField("shingles", T.ArrayType(T.LongType()))])
PLACES = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("places", T.ArrayType(T.StructType([T.StructField("shingle", T.LongType()), T.StructField("at", T.LongType()), T.StructField("left", T.ArrayType(T.BinaryType())), T.StructField("right", T.ArrayType(T.BinaryType()))]))),
])


def _edges(words: Runs, texts: int) -> np.ndarray:
    """The first word of each text, and the end."""
    return np.searchsorted(words.text, np.arange(texts + 1))


def windows_of(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """``window, size, shingles, item``: each item's distinct windows, their words joined by blanks, and the hashes
    of a window's shingles in order (all of as many words as the window has, five at most)."""

    def step(part):
        texts = Texts.of(part.column("text")).lowered()
        words = texts.runs(ALNUM)
        edge, out = _edges(words, len(texts)).tolist(), [[] for _ in range(part.num_rows)]
        by_size = {}
        for n in range(1, SHINGLE + 1):
            first, code = words.windows(n)
            by_size[n] = dict(zip(first.tolist(), code.view(np.int64).tolist()))
        for i, (a, b) in enumerate(zip(edge, edge[1:])):
            n, seen = min(SHINGLE, b - a), set()
            for k in range(a, max(a + 1, b - WINDOW + 1)) if b > a else ():
                end = min(b, k + WINDOW)
                window = b" ".join(texts.bytes[words.low[j] : words.high[j]].tobytes() for j in range(k, end))
                if window not in seen:
                    seen.add(window)
                    out[i].append({"window": window, "size": end - k, "shingles": [by_size[n][j] for j in range(k, end - n + 1)]})
        return [out]

    rows = items.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")).distinct()
    made = add(rows, "text", T.StructType([T.StructField("w", T.ArrayType(WINDOWS))]), lambda: step, ["item"])
    return made.select("item", F.inline("w"))


def _bits(values: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the values with two places each (high and low bits), aggregated as 64-bit words: of a size that
    the number of values does not change."""
    both = F.array(F.shiftrightunsigned("v", 64 - bits), F.col("v").bitwiseAND((1 << bits) - 1))
    place = F.col("place")
    words = values.select(F.explode(both).alias("place")).select(F.shiftrightunsigned(place, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int")).alias("b"))
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << bits - 6, np.int64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return out


def _passing(code: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which hashes the filter lets through."""
    table, size = bitmap.view(np.uint64), len(bitmap) * 64
    has = lambda place: (table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    some = np.flatnonzero(has(code >> np.uint64(65 - size.bit_length())))
    return some[has(code[some] & np.uint64(size - 1))]


def counted(docs: DataFrame, bitmap: np.ndarray, sizes: list[int], text: str) -> DataFrame:
    """``place, n``: how often shingles that the bitmap lets through occur in all documents, by the high bits of their hash."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(parts):
        total = np.zeros(1 << COUNTED, np.int64)
        for part in parts:
            for piece in batches(part, text):
                words = Texts.of(piece.column(text)).lowered().runs(ALNUM)
                for n in sizes:
                    code = words.windows(n)[1]
                    np.add.at(total, code[_passing(code, shared.value)] >> np.uint64(64 - COUNTED), 1)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(total[place])], names=["place", "n"])

    return bounded(docs).select(text).mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))


def prefixes(windows: DataFrame, often: DataFrame) -> DataFrame:
    """``window, size, shingle, offset``: each window's rarest shingle and where in the window it begins."""
    each = windows.select("window", "size", F.posexplode("shingles").alias("offset", "shingle"))
    with_n = each.join(often, F.shiftrightunsigned("shingle", 64 - COUNTED) == F.col("place"), "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset"))
    return with_n.groupBy("window", "size").agg(rarest.alias("r")).select("window", "size", "r.shingle", "r.offset")


def places(docs: DataFrame, bitmap: np.ndarray, sizes: list[int], text: str, keep: list[str]) -> DataFrame:
    """``docs`` with ``n_words`` and ``places``: where a shingle begins that the bitmap lets through, with the words before it
    (nearest last) and from it on, as many as a window may need."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def start():
        def step(part):
            texts = Texts.of(part.column(text)).lowered()
            words = texts.runs(ALNUM)
            edge, out = _edges(words, len(texts)), [[] for _ in range(part.num_rows)]
            word = lambda k: texts.bytes[words.low[k] : words.high[k]].tobytes()
            for n in sizes:
                first, code = words.windows(n)
                for i in _passing(code, shared.value).tolist():
                    k = int(first[i])
                    t = int(words.text[k])
                    a, b = int(edge[t]), int(edge[t + 1])
                    out[t].append({
                        "shingle": int(code[i].view(np.int64)), "at": k - a, "left": [word(j) for j in range(max(a, k - WINDOW + SHINGLE), k)], "right": [word(j) for j in range(k, min(b, k + WINDOW))],
                    })
            return [words.per_text(), out]

        return step

    return add(docs, text, PLACES, start, keep)


def _digest(text: str) -> Column:
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit(7), value).alias("b"))


def findings(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``_text, n_words`` and the columns of ``keep`` of each document, ``_text`` being two hashes of its text; and of
    each text with an occurrence ``_text, n_hit, _items, _spans`` (first word and word after the last of each)."""
    windows = cut(windows_of(items, item, item_text))
    sizes = sorted(r[0] for r in windows.select(F.least("size", F.lit(SHINGLE))).distinct().collect())  # five at most
    every = _bits(windows.select(F.explode("shingles").alias("v")), PASSED)
    prefix = cut(prefixes(windows.select("window", "size", "shingles").distinct(), counted(docs, every, sizes, text)))
    wanted = _bits(prefix.select(F.col("shingle").alias("v")), PASSED)
    rows = docs.withColumn("_text", _digest(text))
    seen = cut(places(rows, wanted, sizes, text, [*keep, "_text"]))
    once = seen.filter(F.size("places") > 0).groupBy("_text").agg(F.first("places").alias("places"))
    each = once.select("_text", F.inline("places")).withColumn("salt", F.pmod(F.xxhash64("_text", "at"), F.lit(SALTS)))
    dealt = prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    before = F.slice("left", F.greatest(F.size("left") - F.col("offset") + 1, F.lit(1)), F.col("offset"))
    words = F.concat(before, F.slice("right", F.lit(1), F.greatest(F.col("size") - F.col("offset"), F.lit(0))))
    met = each.join(dealt, ["shingle", "salt"]).filter("size(left) >= offset and size(right) >= size - offset")
    joined = F.aggregate(F.slice(words, 2, WINDOW), F.element_at(words, 1), lambda a, w: F.concat(a, F.lit(b" "), w))
    same = met.filter(joined == F.col("window")).select("_text", (F.col("at") - F.col("offset")).alias("first"), "size", "window").distinct()
    held = windows.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = cut(same.join(held, "window"))
    # words covered: of each occurrence those beyond all occurrences that begin before it
    line = Window.partitionBy("_text").orderBy("first", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("first") + F.col("size")
    fresh = F.greatest(end - F.greatest("first", F.coalesce(F.max(end).over(line), F.lit(0))), F.lit(0))
    spans = hits.withColumn("fresh", fresh).groupBy("_text").agg(F.sum("fresh").alias("n_hit"), F.flatten(F.array_sort(F.collect_list(F.array("first", end)))).alias("_spans"))
    names = hits.select("_text", F.explode("items").alias("i")).groupBy("_text").agg(F.array_sort(F.collect_set("i")).alias("_items"))
    return seen.drop("places"), cut(spans.join(names, "_text", "left"))


def find(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``_items`` (sorted) and ``_spans``. Columns of ``keep`` are written once (name only those you need)."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (*FINDINGS, "_text", "places")]
    seen, found = findings(docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*kept, text]))), items, text, item, item_text, tuple(kept))
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return _with(seen, found).select(*(F.col(f"`{c}`") for c in kept), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), empty("_items", "array<string>"), empty("_spans", "array<bigint>"))


def _with(rows: DataFrame, found: DataFrame, how: str = "left") -> DataFrame:
    return rows.join(F.broadcast(found) if found.count() <= BROADCAST_TEXTS else found, "_text", how)


def report(docs: DataFrame, items: DataFrame, keep: list[str]) -> DataFrame:
    """The findings, a row a document, with the digest of the sorted item ids."""
    found = find(docs, items, keep=keep)
    return found.select(
        *keep, "n_words", "n_hit", F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents without any window of the benchmark."""
    _, found = findings(docs.select(text), items, text)
    hold = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), _digest(text).alias("_text"))
    return _with(hold, found.select("_text"), "left_anti").select(*(F.col("_row")[c].alias(c) for c in docs.columns))


def digest(ids: list[str]) -> str:
    """What ``items_sha256`` is for these ids."""
    return hashlib.sha256(",".join(sorted(set(ids))).encode()).hexdigest()
