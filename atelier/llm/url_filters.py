"""URL filters: listed rules decide first; elsewhere trust and distrust that flow over host links.

Hosts are linked by the absolute links of their pages and by the owner that a page names in its
copyright line. Trust is a personalised PageRank that restarts at the hosts whose pages the rules
allow, along the links; distrust restarts at the hosts whose pages they block and flows against
the links, to those who link to them. Both are spread by joins and grouped sums, written to the shared folder
between rounds, until no rank changes by more than a tiny part of itself: neither the number of
pages nor the distance from a seed matters. A host whose share of distrust is above the
threshold is blocked; a host that neither reaches is allowed.

A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed.
Null pages have no links. Repeated pages count as often as they occur. Equally long rules that fit
are told apart by their text. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The host of an absolute link, or of the owner after a copyright sign; hosts have a dot.
LINK = r"""(?:href=["']?(?:https?:)?//|(?:&copy;|©)\x20?)([A-Za-z0-9][^/?#"'\s<>]*\.[^/?#"'\s<>]*)"""
#: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Rounds and decimals of the SQL, which stops early and rounds; the share that follows links, and the distrust above which a host is blocked.
ROUNDS, FOLLOW, DECIMALS, THRESHOLD = 12, 0.85, 12, 0.5
#: Rounds end when no rank changes by more than this part of itself.
TOLERANCE = 1e-8


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)).otherwise("")
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)).otherwise(""), F.lit(""))


def fitting(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct<size, rule, verdict> of the longest rule that fits, or null."""
    tests = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    return F.greatest(*tests, F.lit(None).cast("struct<size:int,rule:string,verdict:string>"))


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``x, y, n``: how often pages of host x link to another host y."""
    found = pages.select(host_of(F.col(url)).alias("x"), F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))).alias("y"))
    found = found.select("x", F.translate("y", UPPER, LOWER).alias("y"))
    return found.filter("x <> '' and y <> '' and x <> y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


def spread(seeds: DataFrame, links: DataFrame, rounds: int | None = None) -> DataFrame:
    """``host, rank``: PageRank that restarts at ``seeds`` (host, weight adding up to 1), after so many rounds or,
    if none are given, until the largest relative change is within ``TOLERANCE``."""
    out = links.groupBy("x").agg(F.sum("n").alias("total"))
    step = cut(links.join(out, "x").select("x", "y", (F.col("n") / F.col("total")).alias("share")))
    restart = cut(seeds.select("host", "weight"))
    now = restart.select("host", F.col("weight").alias("rank"))
    for turn in itertools.count():
        if turn == rounds:
            break
        sent = step.join(now, step["x"] == now["host"]).select(F.col("y").alias("host"), (FOLLOW * F.col("rank") * F.col("share")).alias("rank"), F.lit(0.0).alias("old"))
        back = restart.select("host", ((1 - FOLLOW) * F.col("weight")).alias("rank"), F.lit(0.0).alias("old"))
        before = now.select("host", F.lit(0.0).alias("rank"), F.col("rank").alias("old"))
        then = cut(sent.unionByName(back).unionByName(before).groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("old").alias("old")))
        now = then.select("host", "rank")
        if rounds is None and then.filter(F.abs(F.col("rank") - F.col("old")) > TOLERANCE * F.col("rank")).isEmpty():
            break
    return now


def host_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", html: str = "html") -> DataFrame:
    """``host, trust, distrust, doubt`` of every host that has a page."""
    rows = pages.select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    fit = fitting(F.col("host"), F.col("path"), rules)
    hosts = cut(rows.filter("host <> ''").withColumn("v", fit["verdict"]).groupBy("host").agg(F.count_if(F.col("v") == "allow").alias("allow"), F.count_if(F.col("v") == "block").alias("block")))
    links = cut(host_links(pages, url, html))
    total = hosts.agg(F.sum("allow"), F.sum("block")).first()
    out = hosts.select("host")
    for name, verdict, n, way in (("trust", "allow", total[0], links), ("distrust", "block", total[1], links.select(F.col("y").alias("x"), F.col("x").alias("y"), "n"))):
        seeds = hosts.filter(F.col(verdict) > 0).select("host", (F.col(verdict) / F.lit(n or 1)).alias("weight"))
        out = out.join(spread(seeds, way).withColumnRenamed("rank", name), "host", "left")
    out = out.fillna(0.0, ["trust", "distrust"])
    return out.withColumn("doubt", F.when(F.col("trust") + F.col("distrust") > 0, F.round(F.col("distrust") / (F.col("trust") + F.col("distrust")), 7)).otherwise(0.0))


#: Hosts up to which verdicts are broadcast (some 100 bytes each); beyond, the join is shuffled.
BROADCAST_HOSTS = 200_000


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key, host, path, rule, verdict`` and the host's ``doubt``."""
    hosts = cut(host_verdicts(pages, rules, url, html).select("host", "doubt"))
    rows = pages.select(F.col(key).alias(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if hosts.count() <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(hosts), "host", "left")
    else:  # rows of a hot host are dealt to several tasks
        salts = 32
        dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)))
        joined = dealt.join(hosts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))), ["host", "_salt"], "left")
    fit = fitting(F.col("host"), F.col("path"), rules)
    doubt = F.coalesce("doubt", F.lit(0.0))
    return joined.select(key, "host", "path", fit["rule"].alias("rule"), F.coalesce(fit["verdict"], F.when(doubt > THRESHOLD, "block").otherwise("allow")).alias("verdict"), F.round(doubt, 6).alias("doubt"))
