"""Exact token counts for every context limit, from a histogram of encoded lengths.

Documents are encoded whole and counted by length: one row for each length that occurs.
Suffix sums over the lengths then answer, for every context limit, how many documents are
longer, how many tokens those hold, and how many tokens are left when each is cut at the
limit. The sums run in two levels (within a block of lengths, and over block totals), so no
task gathers the histogram.

A null text has length 0. Texts are counted whole, however long. The library's own splitting overflows its stack on some million white spaces in a row, so
texts with a long run of them are split by the same pattern here, and the library encodes each piece. Repeated rows count as often as they occur; an empty table gives an
empty histogram. Other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scratch import cut
from ._arrow import add

#: A run of white space that the library's splitting is spared.
LONG_SPACE = re.compile(r"\s{10000}")
#: Lengths of a block of the two-level sums.
BLOCK = 256


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def lengths(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "n_tokens", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the number of tokens of each whole text."""

    def start():
        encoding, pieces = _encoding(path, pattern), regex.compile(pattern)

        def count(t: str | None) -> int:
            if not t:
                return 0
            if LONG_SPACE.search(t):
                return sum(len(encoding._encode_single_piece(m[0].encode())) for m in pieces.finditer(t))
            return len(encoding.encode_ordinary(t))

        def step(part):
            return [pa.array(map(count, part.column(text).to_pylist()), pa.int64())]

        return step

    return add(docs, text, T.StructType([T.StructField(out, T.LongType())]), start, keep)


def histogram(counted: DataFrame, length: str = "n_tokens") -> DataFrame:
    """One row for each length: n_tokens, n_docs."""
    return counted.groupBy(F.col(length).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """For each length L that occurs, as a context limit: documents and tokens up to L and beyond
    it, tokens left after cutting at L, and the share of documents no longer than L. ``counts`` is
    written once, as both levels read it."""
    rows = cut(counts).withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("mass", F.col("n_tokens") * F.col("n_docs"))
    totals = rows.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("mass").alias("mass"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # a row for each block of lengths: bounded by the longest document, not by the corpus
    after = totals.select("block", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_after") for c in ("docs", "mass")), *(F.sum(c).over(Window.partitionBy(F.lit(1))).alias(f"{c}_all") for c in ("docs", "mass")))
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    beyond = lambda c, total: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(total)
    out = rows.join(F.broadcast(after), "block").select(
        "n_tokens", "n_docs", beyond("n_docs", "docs_after").alias("docs_longer"), beyond("mass", "mass_after").alias("tokens_longer"), "docs_all", "mass_all"
    )
    return out.select(
        "n_tokens", "n_docs", "docs_longer", "tokens_longer",
        (F.col("mass_all") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")).alias("tokens_if_cut"),
        F.col("mass_all").alias("tokens_total"),
        ((F.col("docs_all") - F.col("docs_longer")) / F.col("docs_all")).alias("share_up_to"),
    )


def answers(sums: DataFrame, limits: list[int]) -> DataFrame:
    """``context, docs_longer, tokens_if_cut`` for any context limits, whether they occur as lengths or
    not: the last length up to the limit tells what lies beyond it, and a limit below every length
    cuts all documents. One pass answers all limits."""
    parts = [F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.coalesce(F.max("tokens_total"), F.lit(0)).alias("tokens")]
    for c in sorted(set(limits)):
        upto = F.when(F.col("n_tokens") <= c, F.col("n_tokens"))
        parts += [F.max_by("docs_longer", upto).alias(f"d{c}"), F.max_by("tokens_longer", upto).alias(f"t{c}")]
    rows = []
    for c in sorted(set(limits)):
        longer, held = F.coalesce(f"d{c}", "docs"), F.coalesce(f"t{c}", "tokens")
        rows.append(F.struct(F.lit(c).cast("long").alias("context"), longer.alias("docs_longer"), (F.col("tokens") - held + longer * c).alias("tokens_if_cut")))
    return sums.agg(*parts).select(F.inline(F.array(*rows)))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """The least length that at least each share of documents does not exceed."""
    pick = [F.min(F.when(F.col("share_up_to") >= q, F.col("n_tokens"))) for q in shares]
    return sums.agg(*(p.alias(f"q{q:g}") for p, q in zip(pick, shares)))
