"""Secret scans in SQL expressions alone: three patterns, and windows of high entropy.

Base kinds are patterns with a least length. The entropy kinds look at candidate strings of a
character class: a window slides over each, the count of the character that enters and of the
one that leaves are updated, and with them the sum of ``c * log2(c)`` from which the window's Shannon
entropy follows, and how many digits and letters of either case it holds. A window is reported at
or above the class's threshold, unless the allow-list knows it: it is all words or all
numbers (``mixed``), or touches a placeholder (``PLACEHOLDERS``). A candidate is reported from its first to its
last such window, unless a base span covers it. The work for a candidate grows with its length only.

Spans are in code points, end exclusive, leftmost and non-overlapping per kind. Nulls and empty
texts have none. Texts of any length are scanned whole. Repeated rows give repeated results, an
empty table an empty one. Extra columns are kept by ``redact`` and ignored by ``scan``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def either_case(word: str) -> str:
    """The pattern of an ASCII word in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: kind: pattern, the group that is measured, its least length. In the order in which kinds are listed.
BASE = {
    "assign": (rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
#: Patterns that find the same matches of sufficient length, and no others: a run of one class is
#: matched from its start to its end whatever length is asked for.
LONG_ONLY = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
#: kind: candidates, window, least entropy of a window in bits.
ENTROPY = {"hexent": (r"[0-9A-F]{24,}", 24, 2.905), "b64ent": (r"[A-Za-z0-9+/_=-]{20,}", 20, 3.705)}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Known strings that are no secrets, and as many blanks.
PLACEHOLDERS = [(either_case("example"), 7), (either_case("placeholder"), 11), ("[Xx]{5}", 5), ("012345678", 9)]
ORDER = [*BASE, *ENTROPY]


def _located(text: Column, pattern: str, chunk: int = 1024) -> Column:
    """array<struct<m, at>>: the matches and where they begin, from matches and the text between. Places are
    summed within chunks of matches and over chunks, so that no list grows match by match."""
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    rows = F.filter(rows, lambda r: r["m"].isNotNull())
    none = F.array().cast("array<struct<m:string,at:int>>")

    def placed(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        step = lambda s, r: F.struct(
            (s["at"] + F.length(r["gap"]) + F.length(r["m"])).alias("at"),
            F.concat(s["out"], F.array(F.struct(r["m"].alias("m"), (s["at"] + F.length(r["gap"])).alias("at")))).alias("out"),
        )
        return F.aggregate(part, start, step)

    def joined(parts: Column) -> Column:
        before = F.aggregate(parts, F.array(F.lit(0)), lambda s, p: F.concat(s, F.array(F.element_at(s, -1) + p["at"])))
        moved = F.zip_with(parts, before, lambda p, at: F.transform(p["out"], lambda m: F.struct(m["m"].alias("m"), (m["at"] + at).alias("at"))))
        return F.flatten(F.filter(moved, lambda m: m.isNotNull()))  # there is one sum more than parts

    several = lambda r: F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / chunk).cast("int")), lambda k: placed(F.slice(r, k * chunk + 1, F.lit(chunk))))
    found = F.flatten(F.transform(F.transform(F.array(rows), several), joined))
    return F.when(text.rlike(pattern), found).otherwise(none)


def _span(kind: str, begin: Column, end: Column) -> Column:
    return F.struct(begin.cast("int").alias("start"), F.lit(ORDER.index(kind)).alias("rank"), end.cast("int").alias("end"), F.lit(kind).alias("kind"))


def base_spans(text: Column, kind: str) -> Column:
    pattern, group, least = BASE[kind]
    matches = _located(text, LONG_ONLY.get(kind, pattern))
    if kind not in LONG_ONLY:
        matches = F.filter(matches, lambda m: F.length(F.regexp_extract(m["m"], pattern, group)) >= least)
    return F.transform(matches, lambda m: _span(kind, m["at"], m["at"] + F.length(m["m"])))


#: Symbols: 1 to 67 of the alphabet, a blank of a placeholder, and what fills the window before a candidate's first character.
BLANK, BEFORE = len(ALPHABET) + 1, len(ALPHABET) + 2
#: Counters have 5 bits (windows are below 32), 12 to a long.
BITS, PER_WORD = 5, 12
WORDS = -(-BEFORE // PER_WORD)
#: c * log2(c) in units of 2^-32 bits: sums of whole numbers don't drift.
UNIT = 1 << 32


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def mixed(digits: Column, upper: Column, lower: Column) -> Column:
    """Secrets are drawn from several classes: digits beside letters, of both cases or else with three digits."""
    return (digits >= 1) & (upper + lower >= 1) & ((digits >= 3) | ((upper >= 1) & (lower >= 1)))


def windows_above(candidate: Column, window: int, least: float) -> Column:
    """struct<first, last>: starts of the first and last reported window of a candidate (its bytes, with placeholders
    blanked), -1 if there is none."""
    table = lambda values: F.array(*map(F.lit, values))
    codes = table([ALPHABET.find(chr(b)) + 1 or BLANK for b in range(128)])
    weight = table([0, *(round(c * math.log2(c) * UNIT) for c in range(1, window + 1))])
    # what a symbol adds to the numbers of lower and upper case letters, digits, and symbols that no secret has, a byte each
    kinds = table([*(1 << (0 if c.islower() else 8 if c.isupper() else 16) if c.isalnum() else 0 for c in ALPHABET), 1 << 24, 1 << 24])
    units = table([1 << BITS * (k % PER_WORD) for k in range(BEFORE)])
    most = math.floor(window * (math.log2(window) - least) * UNIT)  # entropy = log2(window) - sum / window
    symbol = lambda i: F.element_at(codes, F.ascii(F.substring(candidate, i, F.lit(1)).cast("string")) + 1)
    word = lambda k: F.floor((k - 1) / PER_WORD).cast("int")
    count = lambda n, k: F.call_function("shiftright", F.element_at(n, word(k) + 1), (k - 1) % PER_WORD * BITS).bitwiseAND((1 << BITS) - 1)
    term = lambda c: F.element_at(weight, c.cast("int") + 1)
    byte = lambda k, shift: F.shiftright(k, shift).bitwiseAND(255)

    def step(s, i):
        moved = F.struct(symbol(i).alias("new"), F.when(i > window, symbol(F.greatest(i - window, F.lit(1)))).otherwise(BEFORE).alias("old"))
        return _with(moved, lambda m: counted(s, i, m))

    def counted(s, i, m):
        before = F.struct(count(s["n"], m["old"]).alias("old"), (count(s["n"], m["new"]) - (m["new"] == m["old"]).cast("int")).alias("new"))
        total = _with(before, lambda c: s["sum"] + term(c["old"] - 1) - term(c["old"]) + term(c["new"] + 1) - term(c["new"]))
        own = lambda k, j: F.when(word(k) == j, F.element_at(units, k)).otherwise(F.lit(0).cast("long"))
        counts = F.transform(s["n"], lambda x, j: x + own(m["new"], j) - own(m["old"], j))
        now = F.struct(total.alias("sum"), (s["kinds"] + F.element_at(kinds, m["new"]) - F.element_at(kinds, m["old"])).alias("kinds"))
        return _with(now, lambda x: moved_on(s, i, counts, x))

    def moved_on(s, i, counts, x):
        above = (x["sum"] <= most) & (x["kinds"] < 1 << 24) & mixed(byte(x["kinds"], 16), byte(x["kinds"], 8), byte(x["kinds"], 0))
        first = F.when(above & (s["first"] < 0), i - window).otherwise(s["first"])
        return F.struct(counts.alias("n"), x["sum"].alias("sum"), x["kinds"].alias("kinds"), first.alias("first"), F.when(above, i - window).otherwise(s["last"]).alias("last"))

    full = [0] * (WORDS - 1) + [window << BITS * ((BEFORE - 1) % PER_WORD)]
    start = F.struct(
        F.array(*(F.lit(x).cast("long") for x in full)).alias("n"), F.lit(round(window * math.log2(window) * UNIT)).alias("sum"),
        F.lit(window << 24).alias("kinds"), F.lit(-1).alias("first"), F.lit(-1).alias("last"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.length(candidate)), start, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def entropy_spans(text: Column, kind: str) -> Column:
    pattern, window, least = ENTROPY[kind]

    def blanked(m: Column) -> Column:
        for known, size in PLACEHOLDERS:
            m = F.regexp_replace(m, known, " " * size)
        return m.cast("binary")

    candidates = F.transform(_located(text, pattern), lambda m: F.struct(m["at"].alias("at"), blanked(m["m"]).alias("m")))
    judged = F.transform(candidates, lambda m: F.struct(m["at"].alias("at"), windows_above(m["m"], window, least).alias("w")))
    return F.transform(F.filter(judged, lambda j: j["w"]["first"] >= 0), lambda j: _span(kind, j["at"] + j["w"]["first"], j["at"] + j["w"]["last"] + window))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _running_max(values: Column) -> Column:
    """Of each number the greatest up to and with it, in as many rounds as their count has binary digits."""

    def further(m: Column, k: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(m, lambda x, i: F.when(i >= step, F.greatest(x, F.element_at(m, F.greatest(i - step, F.lit(0)) + 1))).otherwise(x))

    rounds = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")
    return F.aggregate(F.sequence(F.lit(0), rounds), values, further)


def _uncovered(every: Column) -> Column:
    """Of spans in order those that are base spans or inside none: at equal starts base spans come first, so the
    farthest end of the base spans so far tells."""
    base = lambda s: s["rank"] < len(BASE)
    farthest = _running_max(F.transform(every, lambda s: F.when(base(s), s["end"]).otherwise(-1)))
    kept = F.filter(F.arrays_zip(every.alias("span"), farthest.alias("far")), lambda z: base(z["span"]) | (z["far"] < z["span"]["end"]))
    return F.transform(kept, lambda z: z["span"])


def found(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_base`` and ``_all``, arrays of struct<start, rank, end, kind> in order."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.withColumns({f"_{k}": base_spans(value, k) for k in BASE} | {f"_{k}": entropy_spans(value, k) for k in ENTROPY})
    out = out.withColumns({"_base": F.array_sort(F.concat(*(f"_{k}" for k in BASE))), "_every": F.array_sort(F.concat(*(f"_{k}" for k in ORDER)))})
    return out.withColumn("_all", F.when(F.size("_every") > F.size("_base"), _uncovered(F.col("_every"))).otherwise(F.col("_base"))).drop("_every")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans."""
    rows = found(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text")
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE]
    return rows.select(F.col("_key").alias(key), *counts, F.sha2(_listed(F.col("_base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("_all")).alias("spans"))


#: Characters of the blocks that a text is cut into before pieces of it are taken: finding the n-th character of a string takes n steps.
BLOCK = 2048


def _piece(blocks: Column, begin: Column, end: Column) -> Column:
    """The characters of a text in blocks from ``begin`` up to ``end``."""
    block = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
    low, high = F.floor(begin / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    within = F.substr(block(low), begin - low * BLOCK + 1, end - begin)
    between = F.array_join(F.slice(blocks, low + 2, F.greatest(high - low - 1, F.lit(0))), "")
    across = F.concat(F.substr(block(low), begin - low * BLOCK + 1, F.lit(BLOCK)), between, F.substr(block(high), F.lit(1), end - high * BLOCK))
    return F.when(end <= begin, "").when(low == high, within).otherwise(across)


def redact(docs: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with each secret (overlapping spans as one) replaced by ``mask``; texts without are unchanged."""
    rows = found(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(text).alias("_text")), "_text")
    value, has = F.col("_text"), F.size("_all") > 0
    # of each span the farthest end before it; spans within earlier ones change nothing
    ends = F.when(has, _running_max(F.transform("_all", lambda s: s["end"])))
    rows = rows.withColumns({"_ends": ends, "_blocks": F.when(has, F.regexp_extract_all(value, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0)))})
    told = F.transform("_all", lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.coalesce(F.get("_ends", i - 1), F.lit(0)).alias("at")))
    rows = rows.withColumn("_told", F.when(has, F.filter(told, lambda s: s["end"] > s["at"])))
    blocks = F.col("_blocks")
    pieces = F.transform("_told", lambda s: F.concat(_piece(blocks, s["at"], s["start"]), F.when(s["start"] < s["at"], "").otherwise(mask)))
    masked = F.concat(F.array_join(pieces, ""), _piece(blocks, F.element_at("_ends", -1), F.length(value)))
    return rows.select(*(F.when(has, masked).otherwise(value).alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns))
