"""Toxicity by compression distance: is a window shorter after the toxic dictionary than
after the ordinary one?

Two dictionaries are made of labelled texts and given to zstandard as raw content; its trainer makes neither (the
README says why, with figures): the ordinary one is ordinary text, the toxic one the same text and after it the strings that stand
out in toxic texts by a test of their counts (what both share costs the same, so a window of common words differs
by nothing). Every text is cut into overlapping windows, each is compressed with both
dictionaries, and the savings of the windows are the text's evidence. A logistic calibration
on the labelled texts turns savings into a score, from which a threshold gives the verdict.

Training uses a bounded sample of the labelled rows (``most_each`` of each label, those with
the lowest hash of their id); scoring takes every whole text. A null or empty text has no
window with savings and gets the score that calibration gives to none. Ties and repeated
rows are scored alike; an empty table gives an empty result; without labels of both kinds
every text gets the share of toxic labels (0.0 with no labels). Extra columns are kept unless
an output column bears their name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrow import add
from ._words import ALNUM, LOWER, Texts

#: Bytes of a window and from one window to the next; lower-cased over A-Z and Latin-1 letters.
WINDOW, STRIDE = 32, 16
#: Bytes of ordinary text in either dictionary, and lengths of the strings of the toxic one.
ORDINARY, GRAMS = 60_000, (5, 6, 7, 8)
#: Savings in bytes whose windows are counted.
MUCH = (3, 4, 5, 6, 7, 8)
FEATURES = 4 + len(MUCH)
WORD = re.compile(r"\w+")
FOLD = np.where(ALNUM[LOWER], LOWER, 0x20).astype(np.uint8)
SCORE = T.StructType([T.StructField("score", T.DoubleType())])


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float


def _grams(text: str) -> set[str]:
    found = set()
    for word in set(WORD.findall(text)):
        word = f" {word} "
        for n in GRAMS:
            found.update(word[i : i + n] for i in range(len(word) - n + 1))
    return found


def _contrast(toxic: list[str], ordinary: list[str], least: int = 4) -> list[str]:
    """Strings in clearly more toxic than ordinary texts, the clearest last; not those that a longer one stands for."""
    a, b = Counter(), Counter()
    for texts, count in ((toxic, a), (ordinary, b)):
        for text in texts:
            count.update(_grams(text))
    na, nb = len(toxic), len(ordinary)
    z = 3.2 + 0.073 * math.sqrt(min(na, nb))  # a larger sample has more strings that differ a little by chance

    def away(g: str) -> float:
        share = (a[g] + b[g]) / (na + nb)
        return (a[g] / na - b[g] / nb) / math.sqrt(share * (1 - share) * (1 / na + 1 / nb) + 1e-12)

    found = sorted((g for g in a if a[g] >= least and away(g) > z), key=lambda g: (away(g), g))
    inside = {g[i : i + n] for g in found for n in GRAMS for i in range(len(g) - n + 1) if n < len(g) and a[g] >= 0.8 * a.get(g[i : i + n], 0)}
    return [g for g in found if g not in inside]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    way = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=0, write_checksum=0, write_dict_id=0, min_match=6, strategy=zstandard.STRATEGY_GREEDY, search_log=5, hash_log=16, chain_log=16)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=way)


def _lengths(how: zstandard.ZstdCompressor, data: bytes, low: np.ndarray, size: np.ndarray) -> np.ndarray:
    made = how.multi_compress_to_buffer(zstandard.BufferWithSegments(data, np.stack([low, size], 1).astype(np.uint64).tobytes()), threads=1)
    return np.fromiter((len(made[i]) for i in range(len(made))), np.int64, len(made))


def evidence(texts: Texts, ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor) -> np.ndarray:
    """Of each text: log of summed savings, savings a window, the largest, the number of windows, and of those
    that save at least so many bytes (all but the second and third as logarithms)."""
    data = _folded(texts.bytes)
    size = np.diff(texts.start) - 1
    count = np.maximum(1, np.ceil((size - WINDOW) / STRIDE).astype(np.int64) + 1) * (size > 0)
    of = np.repeat(np.arange(len(size)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    low = texts.start[of] + step * STRIDE
    long = np.minimum(WINDOW, texts.start[of + 1] - 1 - low)
    out = np.zeros((len(size), FEATURES))
    if len(of):
        raw = data.tobytes()
        saved = _lengths(ordinary, raw, low, long) - _lengths(toxic, raw, low, long)
        gain = np.bincount(of, np.maximum(saved - 1, 0), len(size))
        best = np.zeros(len(size))
        np.maximum.at(best, of, saved)
        much = [np.log1p(np.bincount(of, saved >= k, len(size))) for k in MUCH]
        out = np.stack([np.log1p(gain), np.sqrt(gain / np.maximum(count, 1)), best, np.log1p(count), *much], 1)
    return out


def _folded(data: np.ndarray) -> np.ndarray:
    """Lower case over A-Z and the two-byte letters U+00C0 to U+00DE; blanks for what is no letter or digit."""
    out = FOLD[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    upper = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    out[upper] += 0x20
    return out


def train(sample: list[tuple[str | None, int]], share: float | None = None, ordinary_texts: int = 200, ordinary_bytes: int = ORDINARY) -> Model:
    """Dictionaries and calibration from (text, label) rows, whose order does not matter. ``share`` is that of
    label 1 among all rows that the sample stands for, by which scores are set right. The ordinary dictionary holds
    the words of ``ordinary_texts`` of the sample's ordinary texts, at most ``ordinary_bytes`` of them."""
    toxic = sorted(t.lower() for t, y in sample if y and t)
    ordinary = sorted(t.lower() for t, y in sample if not y and t)
    own = sum(bool(y) for _, y in sample) / max(1, len(sample))
    odds = _odds(own if share is None else share)
    if not toxic or not ordinary:
        return Model(b" " * 64, b" " * 64, np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), odds)
    base = " ".join(w for t in sorted(ordinary, key=hash_of)[:ordinary_texts] for w in WORD.findall(t)).encode()[:ordinary_bytes]
    stands_out = "\n".join(_contrast(toxic, ordinary)).encode()
    model = Model(base, base + b"\n" + stands_out + b"\n", np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), odds)
    rows = sorted((t or "", int(bool(y))) for t, y in sample)
    x = evidence(Texts.of(pa.array([t for t, _ in rows])), _compressor(model.ordinary), _compressor(model.toxic))
    y = np.array([v for _, v in rows], float)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    model.weights, bias = _logistic((x - model.mean) / model.scale, y)
    model.bias = bias + odds - _odds(own)
    return model


def _odds(share: float) -> float:
    return math.log(max(share, 1e-6) / max(1 - share, 1e-6))


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode())


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Newton's method on the penalised log-likelihood."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([*[1.0] * (x.shape[1] - 1), 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (p - y) + penalty @ w)
    return w[:-1], float(w[-1])


def labelled(docs: DataFrame, labels: DataFrame, most_each: int, label: str = "toxic", key: str = "doc_id", text: str = "text", longest: int = 20_000) -> tuple[list[tuple[str | None, int]], float | None]:
    """At most ``most_each`` labelled texts of each label, by the lowest hash of their ids, and the share of label 1
    among all labels (None without labels). Texts of more than ``longest`` characters are no part of the sample, and of
    repeated rows of an id the least text is, so that the sample's size is bounded. Ids with both labels are left out."""
    marks = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).filter("_label is not null and _key is not null")
    marks = marks.groupBy("_key").agg(F.min("_label").alias("_label"), F.max("_label").alias("_other")).filter("_label = _other").drop("_other")
    found = []
    for value in (0, 1):
        some = marks.filter(F.col("_label") == value).orderBy(F.xxhash64("_key"), "_key").limit(most_each)
        texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter(F.coalesce(F.length("_text"), F.lit(0)) <= longest)
        found += texts.join(F.broadcast(some), "_key").groupBy("_key", "_label").agg(F.min("_text").alias("_text")).select("_text", "_label").collect()
    return [(r["_text"], r["_label"]) for r in found], marks.agg(F.avg("_label")).first()[0]


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the column ``score`` from 0 to 1."""

    def start():
        ordinary, toxic = _compressor(model.ordinary), _compressor(model.toxic)

        def step(part):
            x = (evidence(Texts.of(part.column(text)), ordinary, toxic) - model.mean) / model.scale
            return [1 / (1 + np.exp(-(x @ model.weights + model.bias)))]

        return step

    return add(docs, text, SCORE, start, keep)
