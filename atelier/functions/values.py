"""Column expressions over numbers, colours, hashes and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch(at: Column | str) -> Column:
    """Whole seconds since 1970 of a time, as it is written (UTC), whatever the session's zone."""
    at = F.col(at) if isinstance(at, str) else at
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def hash_bits(text: Column) -> Column:
    """A hash of 16 hexadecimal digits as a signed 64-bit number."""
    return F.conv(text, 16, -10).cast("long")


def dimensions(width: Column, height: Column) -> Column:
    return F.when((width > 0) & (height > 0), F.format_string("%d×%d", width, height)).otherwise("")


def duration(ms: Column) -> Column:
    seconds = F.floor(F.coalesce(ms, F.lit(0)) / 1000)
    return F.when(F.coalesce(ms, F.lit(0)) > 0, F.format_string("%d:%02d", F.floor(seconds / 60), seconds % 60)).otherwise("")


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r.cast("int"), g.cast("int"), b.cast("int"))


def hsl(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and lightness from 0 to 1, of channels from 0 to 255."""
    x, y, z = r / 255.0, g / 255.0, b / 255.0
    high, low = F.greatest(x, y, z), F.least(x, y, z)
    d, light = high - low, (high + low) / 2
    sat = F.when(d == 0, 0.0).when(light > 0.5, d / F.nullif(2 - high - low, F.lit(0.0))).otherwise(d / F.nullif(high + low, F.lit(0.0)))
    width = F.nullif(d, F.lit(0.0))
    sixth = F.when(high == x, (y - z) / width + F.when(y < z, 6.0).otherwise(0.0)).when(high == y, (z - x) / width + 2).otherwise((x - y) / width + 4)
    return F.coalesce(sixth * 60, F.lit(0.0)), F.coalesce(sat, F.lit(0.0)), light


def hue_family(r: Column, g: Column, b: Column) -> Column:
    """0 to 11 around the wheel, 12 for greys, near-blacks and near-whites."""
    hue, sat, light = hsl(r, g, b)
    return F.when((sat < 0.15) | (light < 0.12) | (light > 0.93), 12).otherwise(F.floor(hue / 30).cast("int") % 12)


def backoff(attempts: Column) -> Column:
    """Seconds to wait after a failed attempt: ten, doubled each time, ten minutes at most."""
    return F.least(F.lit(600).cast("long"), (F.lit(10) * F.pow(F.lit(2.0), F.least(attempts, F.lit(20)) - 1)).cast("long"))


def similarity_pct(jaccard: Column) -> Column:
    return F.floor(jaccard * 100 + 0.5).cast("int")


def percent(done: Column, total: Column) -> Column:
    """0 to 100, or -1 without a total."""
    return F.when(F.coalesce(total, F.lit(0)) <= 0, -1).otherwise(F.least(F.greatest(F.floor(done * 100 / total), F.lit(0)), F.lit(100))).cast("int")


def human_bytes(n: Column) -> Column:
    k = 1024.0
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < k**2, F.format_string("%.1f KB", n / k)).when(n < k**3, F.format_string("%.1f MB", n / k**2)).otherwise(F.format_string("%.1f GB", n / k**3))


def sniff_site(url: Column) -> tuple[Column, Column]:
    """(site, author) that a source address implies."""
    host = F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")
    # Sites by a part of their host.
    known = {"opengameart.org": "OpenGameArt", "polyhaven.com": "Poly Haven", "poly.pizza": "Poly Pizza", "kenney.nl": "Kenney", "freesound.org": "Freesound"}
    site = F.when(host.endswith(".itch.io") | (host == "itch.io"), "itch.io")
    for part, name in known.items():
        site = site.when(host.contains(part), name)
    author = F.when(host.endswith(".itch.io"), F.regexp_replace(host, r"\.itch\.io$", "")).when(host.contains("kenney.nl") & ~host.endswith("itch.io"), "Kenney").otherwise("")
    return site.otherwise(host), author


def ago(seconds: Column) -> Column:
    """How long ago, in the largest fitting unit."""
    unit = lambda n, name: F.concat(F.floor(seconds / n).cast("string"), F.lit(name))
    return F.when(seconds < 60, "just now").when(seconds < 3600, unit(60, " min ago")).when(seconds < 86400, unit(3600, " h ago")).otherwise(unit(86400, " d ago"))
