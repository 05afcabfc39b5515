"""Word matching in text columns: phrases, and phrases whose last word is a prefix."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks, and the letters they are matched as; made from their decompositions.
MARKED = "".join(c for c in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFD", c)) > 1 and unicodedata.normalize("NFD", c)[0].isascii())
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in MARKED)


def normalised(text: Column) -> Column:
    """``' word word '``: lower case, without marks, all else as blanks."""
    plain = F.translate(F.coalesce(text, F.lit("")), MARKED, PLAIN)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def words(query: str) -> list[str]:
    plain = "".join(c for c in unicodedata.normalize("NFD", query) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", plain.lower())


def phrase(columns: list[Column], query: str, prefix: bool = False) -> Column:
    """Adjacent whole words within one column (the last a prefix, if so asked). A query without
    words constrains nothing."""
    found = words(query)
    if not found:
        return F.lit(True)
    needle = " " + " ".join(found) + ("" if prefix else " ")
    out = F.lit(False)
    for column in columns:
        out = out | normalised(column).contains(needle)
    return out
