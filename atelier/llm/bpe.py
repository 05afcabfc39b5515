"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside Spark tasks.

Each task keeps an in-memory DuckDB with the vocabulary and its merge table (left id,
right id, merged id; a merge's rank is the merged id). A word is a row per token; one
recursive query joins neighbouring tokens with the merge table and contracts each word's
leftmost pair of the lowest rank, until no pair of any word can be merged. Words of ``LONG`` characters and more, of
which one pair a step would take as many steps as they have characters, are contracted by the same rule with all of
a step's equal pairs at once: the ids are the same, only the number of steps differs. An ordered
aggregation over token positions decodes. Every distinct word is contracted once and
remembered (at most ``remembered`` of them, and as many of the last generation), so a task's memory does not grow with its rows.

Nulls and empty texts have no tokens. Texts are encoded whole, whatever their length; a single word of some million characters that is no run of few
letters (unspaced script, sequence data) needs more memory than the queries have and ends in their error, and one of some hundred thousand takes minutes. Repeated
rows give repeated results; an empty table gives an empty result. Extra columns are kept
unless an output column bears their name.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._arrow import add, bounded
from ._words import SPACED, Texts

#: Bytes of text encoded at a time; each slice costs a few queries.
SLICE = 1 << 20
#: Words (and half the stretches of text) whose ids a task remembers before it starts anew.
REMEMBERED = 250_000
#: White space beyond ASCII; a text with such is split by the pattern as a whole.
WIDE_SPACE = regex.compile(r"[\s--\x20\x09-\x0D]", regex.V1)
CONTROL = regex.compile("[\x1c-\x1f]")
#: Of a byte: 0 white space, 1 punctuation and controls, 2 letters and digits, 3 beyond ASCII.
KIND = np.where(SPACED, 1, 0)
KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 2
KIND[128:] = 3
KIND = KIND.astype(np.int8)

CONTRACT = """
WITH RECURSIVE step(word, pos, id, changed) AS (
    SELECT word, pos, id, true FROM parts
  UNION ALL
    (WITH live AS (SELECT word, pos, id, lead(id) OVER line AS right_id, lead(pos) OVER line AS right_pos
                   FROM step WHERE changed WINDOW line AS (PARTITION BY word ORDER BY pos)),
          best AS (SELECT word, min((merged, pos, right_pos)) AS m
                   FROM live JOIN merges ON left_id = id AND merges.right_id = live.right_id GROUP BY word)
     SELECT live.word, pos, CASE WHEN pos = m[2] THEN m[1] ELSE id END, m IS NOT NULL
     FROM live LEFT JOIN best ON live.word = best.word WHERE m IS NULL OR pos <> m[3]))
SELECT word, id FROM step WHERE NOT changed ORDER BY word, pos
"""
#: The same, but with all of a word's equal lowest pairs (every other one of a run) at each step:
#: more windows a step, far fewer steps for long words. As a merged id is above the ids of its
#: parts, no new pair can come before the equal ones, so the result is the same.
CONTRACT_LONG = """
WITH RECURSIVE step(word, pos, id, changed) AS (
    SELECT word, pos, id, true FROM parts
  UNION ALL
    (WITH live AS (SELECT word, pos, id, lead(id) OVER line AS right_id
                   FROM step WHERE changed WINDOW line AS (PARTITION BY word ORDER BY pos)),
          ranked AS (SELECT live.word, pos, id, merged, min(merged) OVER (PARTITION BY live.word) AS best
                     FROM live LEFT JOIN merges ON left_id = id AND merges.right_id = live.right_id),
          hits AS (SELECT *, coalesce(merged = best, false) AS hit, row_number() OVER line AS n
                   FROM ranked WINDOW line AS (PARTITION BY word ORDER BY pos)),
          runs AS (SELECT *, n - coalesce(max(CASE WHEN NOT hit THEN n END) OVER (PARTITION BY word ORDER BY pos), 0) AS k FROM hits),
          taken AS (SELECT word, pos, id, best, hit AND k % 2 = 1 AS left_part FROM runs)
     SELECT word, pos, CASE WHEN left_part THEN best ELSE id END, best IS NOT NULL
     FROM (SELECT *, lag(left_part, 1, false) OVER (PARTITION BY word ORDER BY pos) AS right_part FROM taken)
     WHERE NOT right_part))
SELECT word, id FROM step WHERE NOT changed ORDER BY word, pos
"""
#: From this many characters on a word counts as long.
LONG = 24
DECODE = "SELECT text, string_agg(piece, '' ORDER BY pos) AS bytes FROM tokens JOIN vocab USING (id) GROUP BY text"


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _bounds(data: np.ndarray) -> np.ndarray:
    """Bytes at which a token surely begins: white space after black, and ASCII punctuation
    after a letter or digit (of ASCII, or Latin ones of two bytes)."""
    kind = KIND[data]
    before = np.concatenate([kind[:1], kind[:-1]])
    cut = (kind == 0) & (before != 0)
    lead = np.concatenate([data[:2], data[:-2]])
    tail = np.concatenate([data[:1], data[:-1]])
    latin = (before == 3) & (lead >= 0xC3) & (lead <= 0xC9) & ~((lead == 0xC3) & ((tail == 0x97) | (tail == 0xB7)))
    return cut | ((kind == 1) & ((before == 2) | latin))


def _among(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which codes a sorted table has."""
    if not len(table):
        return np.zeros(len(codes), bool)
    return table[np.minimum(np.searchsorted(table, codes), len(table) - 1)] == codes


class Lists:
    """Many short lists of ids end to end."""

    def __init__(self):
        self.ids, self.used = np.zeros(1 << 12, np.int32), 0
        self.ends, self.count = np.zeros(1 << 12, np.int64), 0  # ends[k] is where list k ends

    def __len__(self) -> int:
        return self.count

    def extend(self, ids: np.ndarray, size: np.ndarray) -> None:
        """Append lists of the given sizes."""
        for name, used, new in (("ids", self.used, ids), ("ends", self.count, self.used + np.cumsum(size))):
            held = getattr(self, name)
            if used + len(new) > len(held):
                held = np.concatenate([held[:used], np.zeros(len(held) + len(new), held.dtype)])
                setattr(self, name, held)
            held[used : used + len(new)] = new
        self.used, self.count = self.used + len(ids), self.count + len(size)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen lists end to end, and their sizes."""
        end = self.ends[which]
        size = end - np.where(which > 0, self.ends[which - 1], 0)
        stop = np.cumsum(size)
        return self.ids[np.arange(stop[-1] if len(stop) else 0) + np.repeat(end - stop, size)], size


class Codec:
    """The vocabulary in DuckDB, and what this task has encoded so far."""

    def __init__(self, path: str, pattern: str, remembered: int | None = None):
        self.remembered = remembered
        self.ranks = ranks = _ranks(path)
        self.words = regex.compile(pattern)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": "", "preserve_insertion_order": False})
        pairs = np.fromiter((x for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks for x in (ranks[t[:k]], ranks[t[k:]], r)), np.int32)
        self._table("merges", dict(zip(("left_id", "right_id", "merged"), pairs.reshape(-1, 3).T)))
        # a token's bytes as the code points 0 to 255: DuckDB joins text
        self._table("vocab", {"id": pa.array(ranks.values(), pa.int32()), "piece": pa.array([t.decode("latin-1") for t in ranks])})
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.forget()
        self.forget_words()

    def _table(self, name: str, columns: dict) -> None:
        rows = pa.table(columns)  # noqa: F841  read by the query
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM rows")

    def forget(self) -> None:
        """Start anew with stretches."""
        self.stretches, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.known = Lists()

    def forget_words(self) -> None:
        """Start anew with words, but for those of the last generation, which are taken over as they recur."""
        self.older, self.older_ids = getattr(self, "of_word", {}), getattr(self, "word_ids", None)
        self.of_word: dict[str, int] = {}
        self.word_ids = Lists()

    def contract(self, words: list[str]) -> None:
        """Learn the ids of words: those of the vocabulary by lookup, others by the recursive query."""
        whole = [(w, r) for w in words if (r := self.ranks.get(w.encode())) is not None]
        self._learned([w for w, _ in whole], np.array([r for _, r in whole], np.int32), np.ones(len(whole), np.int64))
        short = [w for w in words if len(w) < LONG and w.encode() not in self.ranks]
        rest = [w for w in words if len(w) >= LONG and w.encode() not in self.ranks]
        for some, query in [*((short[k : k + 10_000], CONTRACT) for k in range(0, len(short), 10_000)), *((rest[k : k + 1000], CONTRACT_LONG) for k in range(0, len(rest), 1000))]:
            raw = [w.encode() for w in some]
            size = np.array([len(r) for r in raw])
            first = np.repeat(np.cumsum(size) - size, size)
            parts = pa.table({  # noqa: F841  read by the query
                "word": np.repeat(np.arange(len(some), dtype=np.int32), size),
                "pos": (np.arange(size.sum()) - first).astype(np.int32),
                "id": self.byte_id[np.frombuffer(b"".join(raw), np.uint8)],
            })
            done = self.db.execute(query).fetchnumpy()
            self._learned(some, np.asarray(done["id"], np.int32), np.bincount(np.asarray(done["word"], np.int64), minlength=len(some)))

    def _learned(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        self.of_word.update(zip(words, range(len(self.word_ids), len(self.word_ids) + len(words))))
        self.word_ids.extend(ids, size)

    def learn(self, codes: np.ndarray, stretches: list[str]) -> None:
        """Learn stretches: their words' ids one after the other."""
        split = [self.words.findall(s) for s in stretches]
        fresh = {w for ws in split for w in ws if w not in self.of_word}
        again = [w for w in fresh if w in self.older]
        if again:
            ids, size = self.older_ids.take(np.array([self.older[w] for w in again], np.int64))
            self._learned(again, ids, size)
            fresh.difference_update(again)
        if fresh:
            self.contract(list(fresh))
        count = np.array([len(ws) for ws in split], np.int64)
        ids, size = self.word_ids.take(np.array([self.of_word[w] for ws in split for w in ws], np.int64))
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])]
        codes = np.concatenate([self.stretches, codes])
        places = np.concatenate([self.places, np.arange(len(self.known), len(self.known) + len(split))])
        self.known.extend(ids, np.diff(ends))
        order = np.argsort(codes, kind="stable")
        self.stretches, self.places = codes[order], places[order]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts end to end, and where each text's begin (and the last end)."""
        remembered = self.remembered or REMEMBERED
        if max(len(self.stretches) >> 1, self.known.used >> 3) > remembered:
            self.forget()
        if len(self.of_word) > remembered:
            self.forget_words()
        texts = Texts.of(column)
        data, count = texts.bytes, np.diff(texts.start) - 1
        cut = _bounds(data)
        if (data >= 0x80).any() or ((data >= 0x1C) & (data <= 0x1F)).any():
            for i, t in enumerate(column.to_pylist()):
                if t is not None and not t.isascii() and WIDE_SPACE.search(t) or t is not None and CONTROL.search(t):
                    cut[texts.start[i] : texts.start[i + 1]] = False
        cut[texts.start[:-1][count > 0]] = True
        cut[texts.start[1:] - 1] = False  # the closing newline is no part of a text
        low = np.flatnonzero(cut)
        of = np.searchsorted(texts.start, low, "right") - 1
        high = np.minimum(np.append(low[1:], len(data)), texts.start[of + 1] - 1)
        codes, at, back = np.unique(texts.hashes(low, high), return_index=True, return_inverse=True)
        fresh = np.flatnonzero(~_among(codes, self.stretches))
        if len(fresh):
            self.learn(codes[fresh], [data[low[i] : high[i]].tobytes().decode() for i in at[fresh].tolist()])
        ids, size = self.known.take(self.places[np.searchsorted(self.stretches, codes)][back])
        return ids, np.concatenate([[0], np.cumsum(np.bincount(of, size, len(texts)).astype(np.int64))])

    def decode(self, ids: np.ndarray, edge: np.ndarray) -> list[bytes]:
        """The bytes of each text: its tokens' pieces, aggregated in order of position."""
        out = [b""] * (len(edge) - 1)
        tokens = pa.table({"text": np.repeat(np.arange(len(edge) - 1, dtype=np.int32), np.diff(edge)), "pos": np.arange(len(ids), dtype=np.int64), "id": ids})  # noqa: F841
        for text, piece in self.db.execute(DECODE).fetchall():
            out[text] = piece.encode("latin-1")
        return out


_CODECS: dict[tuple[str, str, int | None], Codec] = {}


def codec(path: str, pattern: str, remembered: int | None = None) -> Codec:
    """One codec a worker process."""
    if (path, pattern, remembered) not in _CODECS:
        _CODECS[path, pattern, remembered] = Codec(path, pattern, remembered)
    return _CODECS[path, pattern, remembered]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text``, array<int>."""

    def start():
        def step(part):
            ids, edge = codec(path, pattern).encode(part.column(text))
            return [pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids))]

        return step

    return add(docs, text, T.StructType([T.StructField(out, T.ArrayType(T.IntegerType()))]), start, most=SLICE)


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``tokens`` with the bytes that the ids stand for; null ids give empty bytes."""
    kept = [c for c in tokens.columns if c != out]
    schema = T.StructType([*(tokens.schema[c] for c in kept), T.StructField(out, T.BinaryType())])

    def run(parts):
        for part in parts:
            for k in range(0, part.num_rows, 256):
                piece = part.slice(k, 256)
                some = [x or [] for x in piece.column(ids).to_pylist()]
                edge = np.concatenate([[0], np.cumsum([len(x) for x in some])]).astype(np.int64)
                made = codec(path, pattern).decode(np.array([i for x in some for i in x], np.int32), edge)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), pa.array(made, pa.binary())], names=[*kept, out])

    return bounded(tokens).select(*(tokens[f"`{c}`"] for c in kept)).mapInArrow(run, schema)


DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None, remembered: int | None = None) -> DataFrame:
    """Encode each text and decode its ids; return the number of ids, the digest of the ids as
    little-endian unsigned 32-bit integers and that of the decoded bytes. ``remembered`` (``REMEMBERED`` unless given) trades memory
    of each worker (some 200 bytes a word) for time; the results are the same."""

    def start():
        def step(part):
            held = codec(path, pattern, remembered)
            ids, edge = held.encode(part.column(text))
            raw = memoryview(ids.astype("<u4").tobytes())
            decoded = held.decode(ids, edge)
            bounds = (4 * edge).tolist()
            return [np.diff(edge), [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(bounds, bounds[1:])], [hashlib.sha256(x).hexdigest() for x in decoded]]

        return step

    return add(docs, text, DIGESTS, start, keep, SLICE)
