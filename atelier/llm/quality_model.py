"""Quality by hierarchical empirical Bayes: a document's own evidence, on what its site is like.

A logistic classifier over features of the text gives each document's evidence, the log of a
likelihood ratio. Grouped sums of the classifier's shares give each path and host a posterior of a
beta prior: hosts shrink toward the global share, paths toward their host, the more the fewer
documents they have. The strength of each prior is estimated from how much the groups really
differ (method of moments). A document's posterior adds its evidence to the log odds of its path.

Training uses a bounded sample of the labelled rows (``most_each`` of each label); every sum runs over
all documents. A null or empty text is judged as a text of no words. A null host or path is a
group of its own. Without labels of both kinds no evidence is given. Repeated rows count as often as they
occur; an empty table gives an empty result. Extra columns are kept unless an output column
bears their name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scratch import cut
from ._arrow import add
from ._words import Texts
from .quality_rules import IS_LOWER, IS_SYMBOL, IS_UPPER, MEASURES, Judged, measure
from .toxicity import _logistic

EVIDENCE = T.StructType([T.StructField("evidence", T.DoubleType())])
#: Documents below this posterior are rejected; evidence is held within these bounds.
THRESHOLD, BOUND = 0.5, 12.0
#: Rows of the site table up to which it is broadcast (some 100 bytes each).
BROADCAST_SITES = 200_000


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float


def features(column: pa.Array) -> np.ndarray:
    """Shares that tell prose from junk, a row a text."""
    texts = Texts.of(column)
    judged = Judged(texts)
    made = dict(zip(MEASURES.names, measure(judged)))
    words, n = judged.words, np.maximum(made["n_words"], 1)
    same = np.zeros(len(words.code), bool)
    same[1:] = (words.code[1:] == words.code[:-1]) & (words.text[1:] == words.text[:-1])
    upper, lower = texts.count(IS_UPPER[texts.bytes]), texts.count(IS_LOWER[texts.bytes])
    lines = np.maximum(made["n_lines"], 1)
    return np.stack([
        np.minimum(made["n_symbols"] / n, 1.0), np.bincount(words.text, same, len(texts)) / n, upper / np.maximum(upper + lower, 1),
        made["n_words_removed"] / n, made["n_repeat_words"] / n, made["n_lines_removed"] / lines, np.log1p(made["n_words"]), made["word_chars"] / n / 10,
    ], 1)


def train(sample: list[tuple[str | None, int]]) -> Model:
    """From (text, label) rows, label 1 for good; their order does not matter."""
    rows = sorted((t or "", int(y)) for t, y in sample)
    y = np.array([v for _, v in rows], float)
    if len(rows) == 0 or y.min() == y.max():
        return Model(np.zeros(8), np.ones(8), np.zeros(8), 0.0)
    x = np.concatenate([features(pa.array([t for t, _ in rows[k : k + 500]], pa.large_string())) for k in range(0, len(rows), 500)])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    weights, bias = _logistic((x - mean) / scale, y)
    odds = np.log(y.mean() / (1 - y.mean()))
    return Model(mean, scale, weights, bias - odds)  # evidence is beyond the sample's own odds


def evidence(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    def start():
        def step(part):
            x = (features(part.column(text)) - model.mean) / model.scale
            return [np.clip(x @ model.weights + model.bias, -BOUND, BOUND)]

        return step

    return add(docs, text, EVIDENCE, start, keep)


def share(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def log_odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(mean: float, between: float | None) -> float:
    """How many documents a beta prior counts for, from the variance between groups."""
    return round(min(max(mean * (1 - mean) / max(between or 0.0, 1e-6) - 1, 2.0), 1000.0), 6)


def site_posteriors(judged: DataFrame, prior: float) -> DataFrame:
    """``host, path, n, host_posterior, path_posterior`` from rows (host, path, evidence). Rows are
    summed to paths, paths to hosts, hosts to the whole."""
    start = float(np.log(prior / (1 - prior)))
    paths = cut(judged.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(share(F.col("evidence") + start)), 6).alias("good")))
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good")))
    mean = hosts.agg(F.sum("host_good") / F.sum("host_n")).first()[0]
    mean = min(max(prior if mean is None else mean, 0.01), 0.99)
    k_host = _strength(mean, hosts.agg(F.sum(F.col("host_n") * F.pow(F.col("host_good") / F.col("host_n") - mean, 2)) / F.sum("host_n")).first()[0])
    host = hosts.select(F.col("host").alias("_h"), ((k_host * mean + F.col("host_good")) / (k_host + F.col("host_n"))).alias("host_posterior"))
    both = paths.join(host, F.col("host").eqNullSafe(F.col("_h"))).drop("_h")
    k_path = _strength(mean, both.agg(F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("host_posterior"), 2)) / F.sum("n")).first()[0])
    return both.select("host", "path", "n", "host_posterior", ((k_path * F.col("host_posterior") + F.col("good")) / (k_path + F.col("n"))).alias("path_posterior"))


def judge(docs: DataFrame, model: Model, host: Column, path: Column, prior: float = 0.8, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``host, path, evidence, host_posterior, path_posterior, posterior, kept``. The
    texts are read once: evidence is written with the columns of ``keep`` (name only those you need), and both the sums
    and the verdicts come from there. ``prior`` is the share of good documents expected before any is seen."""
    named = docs.drop("host", "path").withColumns({"host": host.cast("string"), "path": path.cast("string")})
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("host", "path", "evidence")]
    again = cut(evidence(named, model, text, [*kept, "host", "path"]))
    sites = cut(site_posteriors(again.select("host", "path", "evidence"), prior))
    small = sites.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "host_posterior", "path_posterior")
    if sites.count() <= BROADCAST_SITES:
        joined = again.join(F.broadcast(small), F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")))
    else:  # a hot site is dealt to several tasks
        salts = 32
        dealt = again.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
        small = small.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
        joined = dealt.join(small, (F.col("_salt") == F.col("_s")) & F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p"))).drop("_salt", "_s")
    posterior = share(F.col("evidence") + log_odds(F.col("path_posterior")))
    return joined.drop("_h", "_p").withColumn("posterior", posterior).withColumn("kept", F.col("posterior") >= THRESHOLD)
