"""Every query by name, with the SQL that says the same.

Each query presents a driver folder as a catalogue and applies the package's operators to whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, values
from ..operators import activity, duplicates, facets, features, groups, listing, provenance, reconcile, search, tags
from .catalogue import T0, Catalogue, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, *tables: str):
    """Register a function of a catalogue under its name, with its SQL over the named tables."""

    def register(f: Callable[[Catalogue], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Catalogue(spark, folder))
        if oracle is not None:
            ORACLES[f.__name__] = sql(oracle, *tables) if tables else oracle
        return f

    return register


def counted() -> Column:
    return F.count(F.lit(1))

PLAIN_TEXT = r"' ' || trim(regexp_replace(lower(strip_accents({})), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"

# ---- search ---------------------------------------------------------------------------------


@query("SELECT id, filename, kind, width FROM assets WHERE missing_since IS NULL AND kind = 'image' AND contains(" + PLAIN_TEXT.format("filename") + ", ' red') ORDER BY first_seen_at DESC, id DESC LIMIT 100", "assets")
def dsl_list_page(c: Catalogue) -> DataFrame:
    where = search.word(["filename"], "red") & search.kind("image") & search.present()
    return listing.page(search.matching(c.assets(), where), "added", 1).select("id", "filename", "kind", "width")


@query("SELECT id FROM assets WHERE (kind = 'model' AND width > 20) OR (NOT (kind = 'image') AND size < 100000)", "assets")
def dsl_or_not(c: Catalogue) -> DataFrame:
    where = (search.kind("model") & search.compare("width", ">", 20)) | (~search.kind("image") & search.compare("size", "<", 100_000))
    return search.matching(c.assets(), where).select("id")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT (quality > 0)")
def dsl_null_negation(c: Catalogue) -> DataFrame:
    rows = c.table("documents").select("doc_id").join(c.table("labels"), "doc_id", "left")
    return search.matching(rows, ~search.compare("quality", ">", 0), "doc_id").select("doc_id")


@query("SELECT id FROM assets WHERE NOT coalesce(has_alpha, false)", "assets")
def dsl_flag_negation(c: Catalogue) -> DataFrame:
    return search.matching(c.assets(), ~search.has("has_alpha")).select("id")


@query("SELECT id FROM assets WHERE (width = 12 AND height = 13) OR (width = 32 AND height = 32)", "assets")
def dsl_dimensions(c: Catalogue) -> DataFrame:
    return search.matching(c.assets(), search.size(12, 13) | search.size(32, 32)).select("id")


@query("SELECT id, coalesce(has_alpha, false) AS alpha, coalesce(is_pixel_art, false) AS art FROM assets WHERE coalesce(frame_count, 0) > 1 AND (coalesce(has_alpha, false) OR coalesce(is_pixel_art, false))", "assets")
def dsl_has_style(c: Catalogue) -> DataFrame:
    where = search.animated() & (search.has("has_alpha") | search.has("is_pixel_art"))
    return search.matching(c.assets(), where).select("id", F.coalesce("has_alpha", F.lit(False)).alias("alpha"), F.coalesce("is_pixel_art", F.lit(False)).alias("art"))


@query(f"SELECT id FROM assets WHERE first_seen_at >= {T0 + 500 * 3600} AND first_seen_at < {T0 + 900 * 3600}", "assets")
def dsl_date(c: Catalogue) -> DataFrame:
    return search.matching(c.assets(), search.compare("first_seen_at", ">=", T0 + 500 * 3600) & search.compare("first_seen_at", "<", T0 + 900 * 3600)).select("id")


@query("SELECT assets.id FROM assets JOIN packs ON pack_id = packs.id WHERE provenance_state = 'complete'", "assets", "packs")
def dsl_provenance(c: Catalogue) -> DataFrame:
    return search.matching(c.assets(), search.provenance(c.packs(), c.assets())).select("id")


@query(f"SELECT doc_id FROM documents WHERE contains({PLAIN_TEXT.format('text')}, ' the and at')")
def fts_prefix(c: Catalogue) -> DataFrame:
    return search.matching(c.table("documents"), search.word(["text"], "The and at"), "doc_id").select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE contains({PLAIN_TEXT.format('text')}, ' en laleenéelle la ') OR contains({PLAIN_TEXT.format('text')}, ' en laleeneelle la ')")
def fts_phrase(c: Catalogue) -> DataFrame:
    return search.matching(c.table("documents"), search.quoted(["text"], "En laleenéelle la"), "doc_id").select("doc_id")


@query(f"SELECT p_partkey AS id FROM part WHERE contains({PLAIN_TEXT.format('p_name')}, ' red ') AND NOT contains({PLAIN_TEXT.format('p_name')}, ' bolt ')")
def fts_not(c: Catalogue) -> DataFrame:
    where = search.quoted(["p_name"], "red") & ~search.quoted(["p_name"], "bolt")
    return search.matching(c.table("part"), where, "p_partkey").select(F.col("p_partkey").alias("id"))


_BELOW = "tag = '{0}' OR starts_with(tag, '{0}:')"
_TAGGED = "id IN (SELECT asset_id FROM asset_tags WHERE " + _BELOW + ") OR pack_id IN (SELECT pack_id FROM pack_tags WHERE " + _BELOW + ")"


def _tagged(c: Catalogue, tag: str) -> search.Where:
    return search.tagged(tag, c.assets(), c.asset_tags(), c.pack_tags())


@query(f"SELECT id FROM assets WHERE {_TAGGED.format('object:bolt')}", "assets", "asset_tags", "pack_tags")
def tag_filter(c: Catalogue) -> DataFrame:
    return search.matching(c.assets(), _tagged(c, "object:bolt")).select("id")


@query(f"SELECT id FROM assets WHERE {_TAGGED.format('theme:red')}", "assets", "asset_tags", "pack_tags")
def tag_filter_inherited(c: Catalogue) -> DataFrame:
    return search.matching(c.assets(), _tagged(c, "theme:red")).select("id")


@query(f"SELECT id FROM assets WHERE NOT ({_TAGGED.format('theme:red')}) AND kind = 'image'", "assets", "asset_tags", "pack_tags")
def tag_negated(c: Catalogue) -> DataFrame:
    return search.matching(c.assets(), ~_tagged(c, "theme:red") & search.kind("image")).select("id")


@query("SELECT id FROM assets WHERE false", "assets")
def tag_unknown(c: Catalogue) -> DataFrame:
    return search.matching(c.assets(), _tagged(c, "no:such")).select("id")


@query("SELECT id FROM assets WHERE missing_since IS NULL AND id NOT IN (SELECT asset_id FROM asset_tags WHERE tag = 'disable:true')", "assets", "asset_tags")
def default_filters(c: Catalogue) -> DataFrame:
    return search.matching(c.assets(), search.present() & search.enabled(c.asset_tags())).select("id")


@query("SELECT page_id FROM files WHERE path = 'thther.example.org/en' OR starts_with(path, 'thther.example.org/en/')", "files")
def folder_filter(c: Catalogue) -> DataFrame:
    return search.matching(c.files(), search.in_folder("/thther.example.org/en/", "path"), "page_id").select("page_id")


@query("SELECT DISTINCT asset_id AS vec_id FROM swatches WHERE ratio >= 0.005 AND r BETWEEN 88 AND 168 AND g BETWEEN 60 AND 140 AND b BETWEEN 80 AND 160", "swatches")
def color_box(c: Catalogue) -> DataFrame:
    vectors = c.table("embeddings").select("vec_id")
    return search.matching(vectors, search.colour(c.swatches(), "#806478", 40), "vec_id").select("vec_id")


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT asset_id FROM swatches WHERE ratio >= 0.005 AND r BETWEEN 88 AND 168 AND g BETWEEN 60 AND 140 AND b BETWEEN 80 AND 160)", "swatches")
def color_box_negated(c: Catalogue) -> DataFrame:
    return search.matching(c.table("embeddings").select("vec_id"), ~search.colour(c.swatches(), "806478", 40), "vec_id").select("vec_id")


@query(
    """WITH main AS (SELECT r, g, b, row_number() OVER (ORDER BY rank) - 1 AS k FROM swatches WHERE asset_id = 3 AND ratio >= 0.005 ORDER BY rank LIMIT 6),
    near AS (SELECT s.asset_id, s.rank, min(k) AS k FROM swatches s JOIN main m ON s.r BETWEEN m.r - 45 AND m.r + 45 AND s.g BETWEEN m.g - 45 AND m.g + 45 AND s.b BETWEEN m.b - 45 AND m.b + 45 WHERE ratio >= 0.005 GROUP BY 1, 2)
    SELECT asset_id AS vec_id FROM near GROUP BY asset_id HAVING count(DISTINCT k) >= (SELECT count(*) FROM main) // 2 + 1""",
    "swatches",
)
def palette_near(c: Catalogue) -> DataFrame:
    return search.matching(c.table("embeddings").select("vec_id"), search.palette_near(c.swatches(), 3, 45), "vec_id").select("vec_id")


# ---- lists ----------------------------------------------------------------------------------

_ORDERS = {
    "added": "first_seen_at DESC, id DESC", "modified": "mtime DESC, id DESC", "name": "filename, id", "name-desc": "filename DESC, id DESC", "size": "size DESC, id", "kind": "kind, filename, id",
    "pixels": "coalesce(width, 0) * coalesce(height, 0) DESC, id", "tris": "tri_count ASC NULLS LAST, id", "tris-desc": "coalesce(tri_count, 0) DESC, id",
}


def _sorted(name: str) -> None:
    def page(c: Catalogue) -> DataFrame:
        return listing.page(c.assets(), name, 2, 200).select("id", "filename", "size")

    page.__name__ = f"sort_{name.replace('-', '_')}"
    query(f"SELECT id, filename, size FROM assets ORDER BY {_ORDERS[name]} LIMIT 200 OFFSET 200", "assets")(page)


for _name in _ORDERS:
    _sorted(_name)


@query("SELECT id, filename FROM assets WHERE filename > 'old_bolt.glb' OR (filename = 'old_bolt.glb' AND id > 100) ORDER BY filename, id LIMIT 101", "assets")
def keyset_page(c: Catalogue) -> DataFrame:
    return listing.after(c.assets(), "old_bolt.glb", 100).select("id", "filename")


@query("SELECT id, lag(id) OVER w AS prev, lead(id) OVER w AS next FROM assets WINDOW w AS (PARTITION BY kind ORDER BY filename, id)", "assets")
def neighbours(c: Catalogue) -> DataFrame:
    return listing.all_neighbours(c.assets(), ["kind"])


@query(
    """(SELECT id, 'prev' AS side FROM assets WHERE filename < 'red_gear.png' OR (filename = 'red_gear.png' AND id < 50) ORDER BY filename DESC, id DESC LIMIT 1)
    UNION ALL (SELECT id, 'next' FROM assets WHERE filename > 'red_gear.png' OR (filename = 'red_gear.png' AND id > 50) ORDER BY filename, id LIMIT 1)""",
    "assets",
)
def neighbours_of_one(c: Catalogue) -> DataFrame:
    before, later = listing.neighbours(c.assets(), "red_gear.png", 50)
    return before.select("id", F.lit("prev").alias("side")).unionByName(later.select("id", F.lit("next").alias("side")))


@query("SELECT count(*) AS n, sum(size)::BIGINT AS bytes, count(*) FILTER (WHERE has_alpha) AS with_alpha, count(*) FILTER (WHERE missing_since IS NOT NULL) AS missing, count(DISTINCT pack_id) AS packs FROM assets", "assets")
def stats_totals(c: Catalogue) -> DataFrame:
    return listing.stats(c.assets())


@query("SELECT kind, count(*) AS n FROM assets GROUP BY kind", "assets")
def stats_kind(c: Catalogue) -> DataFrame:
    return listing.kinds(c.assets())


@query("SELECT packs.id, packs.name, count(assets.id) AS n FROM packs LEFT JOIN assets ON pack_id = packs.id AND missing_since IS NULL GROUP BY ALL", "packs", "assets")
def pack_counts(c: Catalogue) -> DataFrame:
    held = c.assets().filter("missing_since is null").groupBy("pack_id").agg(counted().alias("n"))
    packs = c.packs().select("id", "name")
    return packs.join(held, packs["id"] == held["pack_id"], "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    """SELECT id, CASE WHEN width > 0 AND height > 0 THEN width || '×' || height ELSE '' END AS dimensions, coalesce(frame_count, 0) > 1 AS animated,
    greatest(coalesce(width, 0), coalesce(height, 0)) BETWEEN 1 AND 256 AS thumb_upscales, CASE WHEN size < 1024 THEN size || ' B' ELSE 'more' END AS human FROM assets""",
    "assets",
)
def presented(c: Catalogue) -> DataFrame:
    side = F.greatest(F.coalesce("width", F.lit(0)), F.coalesce("height", F.lit(0)))
    human = values.human_bytes(F.col("size"))
    return c.assets().select("id", values.dimensions(F.col("width"), F.col("height")).alias("dimensions"), (F.coalesce("frame_count", F.lit(0)) > 1).alias("animated"), side.between(1, 256).alias("thumb_upscales"), F.when(F.col("size") < 1024, human).otherwise("more").alias("human"))


# ---- facets ---------------------------------------------------------------------------------

_PAIRS = """pairs AS (SELECT asset_id, tag FROM asset_tags WHERE asset_id IN (SELECT id FROM chosen) UNION SELECT chosen.id, tag FROM chosen JOIN pack_tags USING (pack_id))
    SELECT tag, count(*) AS n, split_part(tag, ':', 1) AS namespace FROM pairs GROUP BY tag ORDER BY n DESC, tag LIMIT 40"""


@query("WITH chosen AS (SELECT * FROM assets), " + _PAIRS, "assets", "asset_tags", "pack_tags")
def tag_facets(c: Catalogue) -> DataFrame:
    return facets.tag_facets(c.assets(), c.asset_tags(), c.pack_tags())


@query("WITH chosen AS (SELECT * FROM assets WHERE kind = 'model' AND missing_since IS NULL), " + _PAIRS, "assets", "asset_tags", "pack_tags")
def tag_facets_filtered(c: Catalogue) -> DataFrame:
    return facets.tag_facets(search.matching(c.assets(), search.kind("model") & search.present()), c.asset_tags(), c.pack_tags())


@query(
    """WITH parts AS (SELECT page_id, string_split(path, '/') AS p FROM files), spread AS (SELECT page_id, array_to_string(p[1:n], '/') AS dir, n = least(len(p) - 1, 2) AS own FROM (SELECT *, unnest(range(0, least(len(p) - 1, 2) + 1)) AS n FROM parts))
    SELECT dir, count(*) AS assets, count(*) FILTER (WHERE own) AS direct FROM spread GROUP BY dir""",
    "files",
)
def tree_rollup(c: Catalogue) -> DataFrame:
    return facets.tree(c.files(), "path", 2)


_BUCKETS = "SELECT round(sum(r * ratio) / sum(ratio))::INTEGER AS r, round(sum(g * ratio) / sum(ratio))::INTEGER AS g, round(sum(b * ratio) / sum(ratio))::INTEGER AS b, round(sum(ratio), 6) AS weight, count(DISTINCT asset_id) AS assets, r // 24 AS br, g // 24 AS bg, b // 24 AS bb FROM swatches WHERE ratio >= 0.02 GROUP BY r // 24, g // 24, b // 24"


@query(_BUCKETS.replace("round(sum(r * ratio)", "round(sum(s.r * ratio)").replace("swatches", "swatches s"), "swatches")
def library_colours(c: Catalogue) -> DataFrame:
    return facets.colour_buckets(c.swatches())


@query(
    f"""WITH buckets AS ({_BUCKETS}), unit AS (SELECT *, r / 255.0::DOUBLE AS x, g / 255.0::DOUBLE AS y, b / 255.0::DOUBLE AS z FROM buckets), ends AS (SELECT *, greatest(x, y, z) AS hi, least(x, y, z) AS lo FROM unit),
    shades AS (SELECT *, (hi + lo) / 2 AS l, CASE WHEN hi = lo THEN 0 WHEN (hi + lo) / 2 > 0.5 THEN (hi - lo) / (2 - hi - lo) ELSE (hi - lo) / (hi + lo) END AS s,
        CASE WHEN hi = lo THEN 0 WHEN hi = x THEN (y - z) / (hi - lo) + CASE WHEN y < z THEN 6 ELSE 0 END WHEN hi = y THEN (z - x) / (hi - lo) + 2 ELSE (x - y) / (hi - lo) + 4 END * 60 AS h FROM ends),
    families AS (SELECT *, CASE WHEN s < 0.15 OR l < 0.12 OR l > 0.93 THEN 12 ELSE floor(h / 30)::INTEGER % 12 END AS family FROM shades)
    SELECT r, g, b, weight, assets, br, bg, bb, family, row_number() OVER (PARTITION BY family ORDER BY weight DESC, r, g, b, br, bg, bb)::INTEGER AS rn FROM families ORDER BY rn, weight DESC, family, r, g, b, br, bg, bb LIMIT 24""",
    "swatches",
)
def hue_round_robin(c: Catalogue) -> DataFrame:
    return facets.spread_hues(facets.colour_buckets(c.swatches()), 24)


_TOP6 = "(SELECT '{0}' AS grp, value, count(*) AS n FROM (SELECT {1} AS value FROM {2}) WHERE starts_with(lower(value), 're') GROUP BY value ORDER BY n DESC, value LIMIT 6)"


@query(" UNION ALL ".join([_TOP6.format("object", "split_part(tag, ':', -1)", "asset_tags"), _TOP6.format("theme", "split_part(tag, ':', 2)", "pack_tags"), _TOP6.format("file", "filename", "assets")]), "asset_tags", "pack_tags", "assets")
def suggest(c: Catalogue) -> DataFrame:
    return facets.completions([
        ("object", c.asset_tags(), F.substring_index("tag", ":", -1)), ("theme", c.pack_tags(), F.split_part("tag", F.lit(":"), F.lit(2))), ("file", c.assets(), F.col("filename")),
    ], "Re")


# ---- groups ---------------------------------------------------------------------------------

_GROUPS = "SELECT pack_id, group_key, arg_min(id, (missing_since IS NOT NULL, precedence, rel_path, id)) AS primary_id, count(*) AS variants FROM assets GROUP BY pack_id, group_key"


@query(_GROUPS, "assets")
def regroup(c: Catalogue) -> DataFrame:
    return groups.regroup(c.assets())


@query(f"WITH grouped AS ({_GROUPS}) SELECT * FROM grouped SEMI JOIN (SELECT * FROM assets WHERE width > 40) m USING (pack_id, group_key)", "assets")
def variant_match(c: Catalogue) -> DataFrame:
    return groups.with_any_variant(groups.regroup(c.assets()), c.assets(), search.matching(c.assets(), search.compare("width", ">", 40)))


@query(
    f"""WITH fresh AS ({_GROUPS}), before AS ({_GROUPS.replace("FROM assets", "FROM assets WHERE id % 7 <> 0")})
    SELECT pack_id, group_key, CASE WHEN b.variants IS NULL THEN 'created' WHEN f.variants IS NULL THEN 'emptied' WHEN f.primary_id = b.primary_id AND f.variants = b.variants THEN 'unchanged' ELSE 'updated' END AS change
    FROM fresh f FULL JOIN before b USING (pack_id, group_key)""",
    "assets",
)
def regroup_changes(c: Catalogue) -> DataFrame:
    return groups.changes(groups.regroup(c.assets()), groups.regroup(c.assets().filter("id % 7 <> 0")))


@query(f"WITH grouped AS ({_GROUPS}) SELECT grouped.group_key, primary_id, variants, a.filename, a.kind, packs.name AS pack FROM grouped JOIN assets a ON a.id = primary_id JOIN packs ON packs.id = grouped.pack_id", "assets", "packs")
def group_primaries(c: Catalogue) -> DataFrame:
    return groups.primaries(groups.regroup(c.assets()), c.assets(), c.packs()).select("group_key", "primary_id", "variants", "filename", "kind", "pack")


# ---- tags -----------------------------------------------------------------------------------


@query(
    """WITH own AS (SELECT DISTINCT asset_id, tag FROM asset_tags), packed AS (SELECT assets.id AS asset_id, tag FROM assets JOIN pack_tags USING (pack_id))
    SELECT asset_id, tag, false AS inherited FROM own UNION ALL SELECT DISTINCT asset_id, tag, true FROM packed ANTI JOIN own USING (asset_id, tag)""",
    "assets", "asset_tags", "pack_tags",
)
def asset_tags_view(c: Catalogue) -> DataFrame:
    return tags.view(c.asset_tags(), c.assets(), c.pack_tags())


_CLOSURE = """names AS (SELECT DISTINCT tag FROM asset_tags), prefixes AS (SELECT DISTINCT array_to_string(p[1:n], ':') AS tag FROM (SELECT string_split(tag, ':') AS p, unnest(range(2, len(string_split(tag, ':')) + 1)) AS n FROM names)),
    pairs AS (SELECT array_to_string(p[1:n], ':') AS ancestor, tag AS descendant, (len(p) - n)::INTEGER AS depth FROM (SELECT tag, string_split(tag, ':') AS p, unnest(range(2, len(string_split(tag, ':')) + 1)) AS n FROM prefixes))"""


@query(f"WITH {_CLOSURE} SELECT * FROM pairs", "asset_tags")
def tag_closure(c: Catalogue) -> DataFrame:
    return tags.closure(c.asset_tags().select("tag"))


@query(
    """WITH marks AS (SELECT asset_id, tag, source FROM asset_tags UNION ALL SELECT asset_id, tag, 'inherited' FROM asset_tags WHERE asset_id % 2 = 0 UNION ALL SELECT asset_id, tag, 'manual' FROM asset_tags WHERE asset_id % 5 = 0)
    SELECT asset_id, tag, arg_max(source, (CASE source WHEN 'manual' THEN 3 WHEN 'inherited' THEN 1 ELSE 2 END, source = 'auto_path')) AS source FROM marks GROUP BY ALL""",
    "asset_tags",
)
def tag_source_upgrade(c: Catalogue) -> DataFrame:
    t = c.asset_tags()
    return tags.strongest(t.unionByName(t.filter("asset_id % 2 = 0").withColumn("source", F.lit("inherited"))).unionByName(t.filter("asset_id % 5 = 0").withColumn("source", F.lit("manual"))))


@query(
    """WITH derived AS (SELECT asset_id, tag, source FROM asset_tags WHERE source <> 'manual' AND asset_id % 3 <> 1 UNION ALL SELECT id, 'type:' || kind, 'auto_type' FROM assets), stored AS (SELECT * FROM asset_tags),
    both_ AS (SELECT coalesce(s.asset_id, d.asset_id) AS asset_id, coalesce(s.tag, d.tag) AS tag, s.source AS old, d.source AS new FROM stored s FULL JOIN derived d ON s.asset_id = d.asset_id AND s.tag = d.tag)
    SELECT asset_id, tag, CASE WHEN old IS NULL OR (old <> 'manual' AND new IS NOT NULL) THEN new ELSE old END AS source, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL AND old <> 'manual' THEN 'pruned' ELSE 'kept' END AS change FROM both_""",
    "assets", "asset_tags",
)
def tag_retag(c: Catalogue) -> DataFrame:
    derived = c.asset_tags().filter("source <> 'manual' and asset_id % 3 <> 1").unionByName(c.assets().select(F.col("id").alias("asset_id"), F.concat(F.lit("type:"), "kind").alias("tag"), F.lit("auto_type").alias("source")))
    return tags.retag(c.asset_tags(), derived)


@query(
    f"""WITH {_CLOSURE}, aliases(alias, tag) AS (VALUES ('screw', 'object:bolt'), ('crimson', 'theme:red')), direct AS (SELECT asset_id, tag FROM asset_tags UNION SELECT assets.id, tag FROM assets JOIN pack_tags USING (pack_id)),
    up AS (SELECT DISTINCT asset_id, ancestor AS tag FROM direct JOIN pairs ON descendant = tag), named AS (SELECT asset_id, tag AS name FROM up UNION SELECT asset_id, alias FROM up JOIN aliases USING (tag))
    SELECT asset_id, string_agg(name, ' ' ORDER BY name) AS tag_text FROM named GROUP BY asset_id""",
    "assets", "asset_tags", "pack_tags",
)
def tag_search_text(c: Catalogue) -> DataFrame:
    aliases = c.spark.createDataFrame([("screw", "object:bolt"), ("crimson", "theme:red")], "alias string, tag string")
    return tags.search_text(c.asset_tags(), c.assets(), c.pack_tags(), tags.closure(c.asset_tags().select("tag")), aliases)


@query(
    """WITH derived AS (SELECT id AS asset_id, 'disable:true' AS tag, 'manual' AS source FROM assets WHERE kind = 'audio'), every AS (SELECT asset_id, tag, source FROM asset_tags UNION ALL SELECT * FROM derived)
    SELECT asset_id, tag, arg_max(source, (CASE source WHEN 'manual' THEN 3 ELSE 2 END, source = 'auto_path')) AS source FROM every GROUP BY ALL""",
    "assets", "asset_tags",
)
def tag_bulk(c: Catalogue) -> DataFrame:
    return tags.bulk_add(c.asset_tags(), search.matching(c.assets(), search.kind("audio")), "disable:true")


@query(
    r"""WITH parts AS (SELECT page_id, string_split(path, '/') AS p FROM files), segments AS (SELECT page_id, n, p[n] AS s FROM (SELECT *, unnest(range(1, len(p))) AS n FROM parts)),
    made AS (SELECT page_id, n, regexp_replace(regexp_replace(lower(regexp_replace(trim(s), '^[0-9]+[ _.-]+', '')), '[^\p{L}\p{Nd}]+', '-', 'g'), '^-+|-+$', '', 'g') AS t FROM segments)
    SELECT DISTINCT page_id, 'folder:' || t AS tag FROM made WHERE NOT regexp_matches(t, '^[0-9]*$')""",
    "files",
)
def autotag_paths(c: Catalogue) -> DataFrame:
    return c.files().select("page_id", F.explode(paths.path_tags(F.col("path"))).alias("tag"))


@query(
    """SELECT page_id, CASE WHEN host LIKE '%.itch.io' OR host = 'itch.io' THEN 'itch.io' WHEN contains(host, 'kenney.nl') THEN 'Kenney' ELSE host END AS site, CASE WHEN host LIKE '%.itch.io' THEN regexp_replace(host, '[.]itch[.]io$', '') WHEN contains(host, 'kenney.nl') THEN 'Kenney' ELSE '' END AS author
    FROM (SELECT page_id, regexp_replace(lower(regexp_extract(CASE WHEN page_id % 10 = 0 THEN 'https://me.itch.io/x' WHEN page_id % 10 = 1 THEN 'https://www.kenney.nl/a' ELSE url END, '://([^/?#]*)', 1)), '^www[.]', '') AS host FROM pages)"""
)
def sniff_url(c: Catalogue) -> DataFrame:
    url = F.when(F.col("page_id") % 10 == 0, "https://me.itch.io/x").when(F.col("page_id") % 10 == 1, "https://www.kenney.nl/a").otherwise(F.col("url"))
    site, author = values.sniff_site(url)
    return c.table("pages").select("page_id", site.alias("site"), author.alias("author"))


# ---- reconciliation -------------------------------------------------------------------------

_STATUS = """joined AS (SELECT coalesce(o.path, n.path) AS path, o.id, o.missing_since, o.size AS osize, o.mtime AS omtime, o.sha256 AS osha, n.size AS nsize, n.mtime AS nmtime, n.sha256 AS nsha, o.path IS NULL AS fresh, n.path IS NULL AS absent, o.content_changed_at AS changed_at FROM old o FULL JOIN new n ON o.path = n.path),
    gone AS (SELECT id, changed_at, path, osha AS sha, row_number() OVER (PARTITION BY osha ORDER BY path) AS k FROM joined WHERE absent AND missing_since IS NULL), come AS (SELECT path, nsha AS sha, row_number() OVER (PARTITION BY nsha ORDER BY path) AS k FROM joined WHERE fresh),
    moves AS (SELECT gone.id, gone.changed_at, gone.path AS old_path, come.path FROM gone JOIN come USING (sha, k)),
    found AS (SELECT j.path, coalesce(j.id, m.id) AS id, coalesce(j.changed_at, m.changed_at) AS changed_at, missing_since, osize, omtime, osha, nsize, nmtime, nsha, CASE WHEN fresh THEN CASE WHEN m.id IS NULL THEN 'added' ELSE 'moved' END
        WHEN absent THEN CASE WHEN g.id IS NOT NULL THEN 'gone' WHEN missing_since IS NOT NULL THEN 'still_missing' WHEN contains(j.path, '.Trash') THEN 'purged' ELSE 'missing' END
        WHEN nsize = osize AND nmtime = omtime THEN CASE WHEN missing_since IS NULL THEN 'unchanged' ELSE 'reappeared' END WHEN nsha <> osha THEN 'content_changed' ELSE 'metadata_only' END AS status
        FROM joined j LEFT JOIN moves m ON j.path = m.path AND fresh LEFT JOIN moves g ON g.old_path = j.path AND absent)"""


@query(f"WITH {_STATUS} SELECT status, count(*) AS n FROM found GROUP BY status", "old", "new")
def recon_status(c: Catalogue) -> DataFrame:
    return reconcile.counts(reconcile.resolved(*c.index()))


@query(f"WITH {_STATUS} SELECT id, old_path, path FROM moves", "old", "new")
def recon_moves(c: Catalogue) -> DataFrame:
    return reconcile.moves(reconcile.compared(*c.index())).select("id", "old_path", "path")


@query(
    f"""WITH {_STATUS} SELECT id, path, CASE WHEN status IN ('missing', 'still_missing') THEN osize ELSE nsize END AS size, CASE WHEN status IN ('missing', 'still_missing') THEN omtime ELSE nmtime END AS mtime, CASE WHEN status IN ('missing', 'still_missing') THEN osha ELSE nsha END AS sha256,
    CASE WHEN status = 'missing' THEN 1700000000 WHEN status = 'still_missing' THEN missing_since END AS missing_since, CASE WHEN status = 'content_changed' THEN 1700000000 ELSE changed_at END AS content_changed_at FROM found WHERE status NOT IN ('gone', 'purged')""",
    "old", "new",
)
def recon_snapshot(c: Catalogue) -> DataFrame:
    return reconcile.snapshot(reconcile.resolved(*c.index()), 1_700_000_000)


@query("SELECT count(*) AS checked, count(*) FILTER (WHERE n.sha256 <> o.sha256) AS mismatched, count(*) FILTER (WHERE n.path IS NULL) AS absent FROM old o LEFT JOIN new n ON o.path = n.path WHERE missing_since IS NULL", "old", "new")
def recon_verify(c: Catalogue) -> DataFrame:
    old, new = c.index()
    return reconcile.verify(old, new)


# ---- duplicates -----------------------------------------------------------------------------


@query("SELECT sha256, count(*) AS copies, ((count(*) - 1) * max(size))::BIGINT AS bytes FROM copies WHERE missing_since IS NULL GROUP BY sha256 HAVING count(*) > 1", "copies")
def dup_exact(c: Catalogue) -> DataFrame:
    return duplicates.exact(c.copies())


@query(
    """WITH scored AS (SELECT *, CASE WHEN used THEN 1000 ELSE 0 END + CASE WHEN complete THEN 100 ELSE 0 END + CASE WHEN in_raw THEN 0 ELSE 50 END + CASE WHEN is_primary AND variants > 1 THEN 25 ELSE 0 END - len(string_split(path, '/')) AS score, count(*) OVER (PARTITION BY sha256) AS n,
    row_number() OVER (PARTITION BY sha256 ORDER BY CASE WHEN used THEN 1000 ELSE 0 END + CASE WHEN complete THEN 100 ELSE 0 END + CASE WHEN in_raw THEN 0 ELSE 50 END + CASE WHEN is_primary AND variants > 1 THEN 25 ELSE 0 END - len(string_split(path, '/')) DESC, first_seen_at, path) AS turn FROM copies)
    SELECT sha256, id AS keep_id, score::INTEGER AS score FROM scored WHERE n > 1 AND turn = 1""",
    "copies",
)
def dup_favoured(c: Catalogue) -> DataFrame:
    return duplicates.favoured(c.copies())


_DIST = "len(list_filter(list_zip(x.signs, y.signs), lambda p: p[1] <> p[2]))::INTEGER"


@query(
    f"""WITH same AS (SELECT signs, min(id) AS r FROM hashes GROUP BY signs) SELECT x.r AS a, y.r AS b, {_DIST} AS dist FROM same x JOIN same y ON x.r < y.r WHERE {_DIST} <= 5
    UNION ALL SELECT r, id, 0 FROM hashes JOIN same USING (signs) WHERE id <> r""",
    "hashes",
)
def dup_near_pairs(c: Catalogue) -> DataFrame:
    return duplicates.near_pairs(c.hashes())


@query(
    f"""RECURSIVE WITH links AS (SELECT a, b, dist FROM (SELECT x.id AS a, y.id AS b, {_DIST} AS dist FROM hashes x JOIN hashes y ON x.id < y.id AND x.sha256 <> y.sha256 AND (x.group_id = 0 OR x.group_id <> y.group_id)) WHERE dist <= 5),
    both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach(n, l) AS (SELECT a, a FROM both_ UNION SELECT b, l FROM reach JOIN both_ ON a = n), part AS (SELECT n, min(l) AS c FROM reach GROUP BY n),
    far AS (SELECT c, max(dist) AS max_distance FROM part JOIN links ON a = n GROUP BY c)
    SELECT c AS cluster_id, count(*) AS members, (sum(size) - max(size))::BIGINT AS bytes, any_value(max_distance) AS max_distance FROM part JOIN hashes ON id = n JOIN far USING (c) GROUP BY c""",
    "hashes",
)
def dup_near_clusters(c: Catalogue) -> DataFrame:
    return duplicates.near_findings(c.hashes())


def _held(c: Catalogue) -> DataFrame:
    """What packs hold: suppliers' parts, and beside each pack those not divisible by four, and all again for every third. Chunks of packs, in which rows count once."""
    held = c.table("lineitem").select(F.col("l_suppkey").alias("pack_id"), F.col("l_partkey").alias("sha256"))
    beside = held.unionByName(held.filter("sha256 % 4 <> 0").withColumn("pack_id", F.col("pack_id") + 1_000_000)).unionByName(held.filter("pack_id % 3 = 0").withColumn("pack_id", F.col("pack_id") + 2_000_000))
    return duplicates.chunked(beside, rows=3 * held.count())


@query(
    """WITH base AS (SELECT DISTINCT l_suppkey AS p, l_partkey AS c FROM lineitem), held AS (SELECT * FROM (SELECT p, c FROM base UNION ALL SELECT p + 1000000, c FROM base WHERE c % 4 <> 0 UNION ALL SELECT p + 2000000, c FROM base WHERE p % 3 = 0)), sizes AS (SELECT p, count(*) AS n FROM held GROUP BY p),
    met AS (SELECT x.p AS a, y.p AS b, count(*) AS shared FROM held x JOIN held y ON x.c = y.c AND x.p < y.p GROUP BY ALL), judged AS (SELECT a, b, shared, shared / (m.n + k.n - shared)::DOUBLE AS j, m.n AS na, k.n AS nb FROM met JOIN sizes m ON m.p = a JOIN sizes k ON k.p = b)
    SELECT a, b, CASE WHEN shared = na AND shared = nb THEN 'identical' WHEN shared = na THEN 'a_in_b' WHEN shared = nb THEN 'b_in_a' ELSE 'overlap' END AS kind, shared, round(j, 6) AS jaccard FROM judged WHERE shared = na OR shared = nb OR j >= 0.5"""
)
def pack_containment(c: Catalogue) -> DataFrame:
    return duplicates.chunk_overlaps(_held(c))


@query("SELECT DISTINCT s.id + 1 AS pack_id, t.tag FROM packs s JOIN pack_tags t ON t.pack_id = s.id WHERE s.id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM pack_tags x WHERE x.pack_id = s.id + 1 AND x.tag = t.tag)", "packs", "pack_tags")
def pack_transfer(c: Catalogue) -> DataFrame:
    moves = c.packs().filter("id % 2 = 0").select(F.col("id").alias("from_pack"), (F.col("id") + 1).alias("to_pack"))
    return duplicates.transferred_tags(c.pack_tags(), moves)


@query(
    """WITH rows AS (SELECT *, size > 400 AS t FROM copies), judged AS (SELECT *, t AND NOT used AS leaving FROM rows), counted AS (SELECT *, sum(CASE WHEN leaving THEN 0 ELSE 1 END) OVER (PARTITION BY sha256) AS stays, row_number() OVER (PARTITION BY sha256 ORDER BY leaving DESC, path, id) AS turn FROM judged)
    SELECT id, CASE WHEN used THEN 'blocked: in use' WHEN stays = 0 AND turn = 1 THEN 'kept: last copy' ELSE 'remove' END AS decision FROM counted WHERE t""",
    "copies",
)
def removal_plan(c: Catalogue) -> DataFrame:
    copies = c.copies()
    return duplicates.removal_plan(copies.drop("used"), copies.filter("size > 400").select("id"), copies.filter("used").select("id"))


# ---- provenance and projects ----------------------------------------------------------------

_LICENCES = "table_(id, spdx, commercial, attribution) AS (VALUES " + ", ".join(f"({i + 1}, '{x[0]}', {str(x[2]).lower()}, {str(x[3]).lower()})" for i, x in enumerate(provenance.LICENCES)) + ")"


@query(
    f"""WITH {_LICENCES} SELECT packs.id, CASE WHEN spdx IS NULL THEN 'no licence' WHEN NOT commercial THEN 'not cleared for commercial use' WHEN attribution AND trim(attribution_text) = '' THEN 'attribution required, none written' ELSE '' END AS reason FROM packs LEFT JOIN table_ ON license_id = table_.id""",
    "packs",
)
def licence_risk(c: Catalogue) -> DataFrame:
    return provenance.risks(c.packs(), provenance.licences(c.spark)).select("id", "reason")


@query("SELECT id, name FROM packs WHERE provenance_state <> 'complete'", "packs")
def provenance_needed(c: Catalogue) -> DataFrame:
    return provenance.summaries(c.packs(), provenance.licences(c.spark), "needs").select("id", "name")


_CREDITS = "lines AS (SELECT DISTINCT project_id, spdx AS licence, author, name AS pack FROM uses JOIN packs ON packs.id = pack_id LEFT JOIN table_ ON table_.id = license_id WHERE removed_at IS NULL)"


@query(f"WITH {_LICENCES}, {_CREDITS} SELECT * FROM lines", "uses", "packs")
def credits(c: Catalogue) -> DataFrame:
    return provenance.credits(c.uses(), c.packs(), provenance.licences(c.spark))


@query(
    f"""WITH {_LICENCES}, {_CREDITS}, each AS (SELECT project_id, licence, string_agg('- ' || pack || ' by ' || author, chr(10) ORDER BY '- ' || pack || ' by ' || author) AS list FROM lines GROUP BY ALL)
    SELECT project_id, string_agg('## ' || coalesce(licence, 'Unknown licence') || chr(10) || list, chr(10) || chr(10) ORDER BY coalesce(licence, 'zzz')) AS text FROM each GROUP BY project_id""",
    "uses", "packs",
)
def credits_text(c: Catalogue) -> DataFrame:
    return provenance.credits_text(provenance.credits(c.uses(), c.packs(), provenance.licences(c.spark)))


@query("SELECT project_id, asset_id, status = 'O' AS outdated, missing_since IS NOT NULL AS missing FROM uses JOIN assets ON assets.id = asset_id WHERE removed_at IS NULL", "uses", "assets")
def project_outdated(c: Catalogue) -> DataFrame:
    shas = c.assets().select(F.col("id").alias("asset_id"), "sha256")
    uses = c.uses().join(shas.hint("merge"), "asset_id").withColumn("asset_sha256", F.when(F.col("status") == "O", F.reverse("sha256")).otherwise(F.col("sha256")))
    return provenance.outdated(uses.drop("sha256"), c.assets())


@query(
    """WITH manifest AS (SELECT o_orderkey AS asset_id, o_orderkey % 5 <> 0 AS on_disk FROM orders WHERE o_orderkey % 4 <> 0), recorded AS (SELECT o_orderkey AS asset_id, o_orderstatus = 'O' AS outdated, o_orderkey % 9 = 0 AS missing FROM orders WHERE o_orderkey % 3 <> 0)
    SELECT asset_id, CASE WHEN m.on_disk = false THEN 'file deleted' WHEN missing THEN 'missing on server' WHEN outdated THEN 'outdated' WHEN r.missing IS NULL THEN 'not recorded' WHEN m.on_disk IS NULL THEN 'not in manifest' ELSE '' END AS state FROM manifest m FULL JOIN recorded r USING (asset_id)"""
)
def manifest_merge(c: Catalogue) -> DataFrame:
    o, key = c.table("orders"), F.col("o_orderkey")
    manifest = o.filter(key % 4 != 0).select(key.alias("asset_id"), (key % 5 != 0).alias("on_disk"))
    return provenance.manifest_states(manifest, o.filter(key % 3 != 0).select(key.alias("asset_id"), (F.col("o_orderstatus") == "O").alias("outdated"), (key % 9 == 0).alias("missing")))


# ---- activity -------------------------------------------------------------------------------


@query("SELECT event_type AS state, count(*) AS n FROM events GROUP BY event_type")
def job_state_counts(c: Catalogue) -> DataFrame:
    return activity.state_counts(c.table("events"), "event_type")


@query("SELECT user_id AS job, arg_max(event_type, (ts, event_id)) AS state, count(*) AS events FROM events GROUP BY user_id")
def job_last_state(c: Catalogue) -> DataFrame:
    return activity.last_state(c.table("events"), "user_id", "ts", "event_id", "event_type")


@query("SELECT event_id AS id, least(600, (10 * 2 ** (event_id % 9))::BIGINT)::BIGINT AS delay FROM events")
def job_backoff(c: Catalogue) -> DataFrame:
    return c.table("events").select(F.col("event_id").alias("id"), values.backoff(F.col("event_id") % 9 + 1).alias("delay"))


def _jobs(c: Catalogue) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return c.table("events").select(
        F.col("event_id").alias("id"), F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "error", "failed_run").otherwise("done").alias("state"), (k % 4).alias("attempts"), (k % 3).alias("priority"),
        values.epoch("ts").alias("run_after"), F.when(k % 2 == 0, F.concat(F.lit("d"), "user_id")).alias("dedupe_key"),
    )


_JOBS = """jobs AS (SELECT event_id AS id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed_run' ELSE 'done' END AS state, json_extract(props, '$.k')::INTEGER AS k, floor(epoch(ts))::BIGINT AS run_after, user_id FROM events)"""


@query(f"WITH {_JOBS} SELECT id FROM jobs WHERE state = 'queued' AND run_after <= 1705000000 ORDER BY k % 3 DESC, id LIMIT 10")
def job_claim(c: Catalogue) -> DataFrame:
    return activity.next_jobs(_jobs(c), 1_705_000_000, 10).select("id")


@query(
    f"""WITH {_JOBS} SELECT id, CASE WHEN state = 'failed_run' THEN CASE WHEN k % 4 < 3 THEN 'queued' ELSE 'failed' END ELSE state END AS state,
    CASE WHEN state = 'failed_run' AND k % 4 < 3 THEN 1705000000 + trunc(10 * 2.0 ** (k % 4 - 1))::BIGINT ELSE run_after END AS run_after FROM jobs"""
)
def job_retry(c: Catalogue) -> DataFrame:
    return activity.retried(_jobs(c), 1_705_000_000).select("id", "state", "run_after")


@query(
    f"""WITH {_JOBS}, live AS (SELECT *, state IN ('queued', 'running') AND k % 2 = 0 AS l FROM jobs), turns AS (SELECT *, row_number() OVER (PARTITION BY l, user_id ORDER BY id) AS t FROM live) SELECT id FROM turns WHERE NOT l OR t = 1"""
)
def job_dedupe(c: Catalogue) -> DataFrame:
    return activity.one_each(_jobs(c)).select("id")


@query("SELECT user_id AS key, (floor(epoch(ts))::BIGINT - floor(epoch(ts))::BIGINT % 3600) AS window_start, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL")
def rate_window(c: Catalogue) -> DataFrame:
    return activity.fixed_windows(c.table("events").filter("event_type = 'error'"), "user_id", "ts", 3600)


@query(
    """WITH marked AS (SELECT *, CASE WHEN floor(epoch(ts))::BIGINT - floor(epoch(lag(ts) OVER w))::BIGINT <= 14400 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), runs AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM marked)
    SELECT user_id AS key, floor(epoch(min(ts)))::BIGINT AS started, floor(epoch(max(ts)))::BIGINT AS ended, count(*) AS n FROM runs GROUP BY user_id, r"""
)
def session_idle(c: Catalogue) -> DataFrame:
    return activity.sessions(c.table("events"), "user_id", "ts", 4 * 3600)


@query("SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'revoked' WHEN floor(epoch(ts))::BIGINT <= 1705000000 THEN 'expired' ELSE 'valid' END AS state FROM events")
def token_validity(c: Catalogue) -> DataFrame:
    revoked = F.when(F.col("event_type") == "error", values.epoch("ts"))
    return c.table("events").select(F.col("event_id").alias("id"), activity.token_state(values.epoch("ts"), revoked, 1_705_000_000).alias("state"))


@query("SELECT event_id FROM events WHERE floor(epoch(ts))::BIGINT >= 1705000000")
def retention(c: Catalogue) -> DataFrame:
    return activity.retained(c.table("events").withColumn("at", values.epoch("ts")), "at", 1_705_000_000).select("event_id")


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(c: Catalogue) -> DataFrame:
    return c.table("events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(counted().alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


# ---- features -------------------------------------------------------------------------------


def _palettes(c: Catalogue) -> DataFrame:
    one = F.struct(F.lit("#000000").alias("hex"), (F.col("id") % 256).cast("int").alias("r"), F.lit(7).alias("g"), F.lit(9).alias("b"), F.lit(5).cast("long").alias("count"), F.lit(0.25).cast("double").alias("ratio"))
    two = F.struct(F.lit("#ffffff").alias("hex"), F.lit(1).alias("r"), F.lit(2).alias("g"), (F.col("id") % 99).cast("int").alias("b"), F.lit(2).cast("long").alias("count"), F.lit(0.75).cast("double").alias("ratio"))
    return c.assets().select("id", F.when(F.col("id") % 6 == 0, "not json").otherwise(F.to_json(F.array(one, two))).alias("palette_json"))


@query("SELECT id AS asset_id, 0 AS rank, (id % 256)::INTEGER AS r, 7 AS g, 9 AS b, 0.25::DOUBLE AS ratio FROM assets WHERE id % 6 <> 0 UNION ALL SELECT id, 1, 1, 2, (id % 99)::INTEGER, 0.75 FROM assets WHERE id % 6 <> 0", "assets")
def palette_backfill(c: Catalogue) -> DataFrame:
    return features.swatches(_palettes(c))


@query("SELECT event_id, pos::INTEGER AS pos, v FROM (SELECT event_id, unnest(range(3)) AS pos, json_extract(props, '$.k')::INTEGER * (unnest(range(3)) + 1) AS v FROM events)")
def json_explode(c: Catalogue) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    made = F.to_json(F.array(k, k * 2, k * 3))
    return c.table("events").select("event_id", F.posexplode(F.from_json(made, "array<bigint>")).alias("pos", "v"))


@query("SELECT sha256, min(id) AS id FROM assets WHERE missing_since IS NULL AND (kind = 'model' OR id % 4 < 2) GROUP BY sha256", "assets")
def stale_features(c: Catalogue) -> DataFrame:
    marked = c.assets().withColumn("derive_state", F.when(F.col("kind") == "model", "pending").otherwise("done")).withColumn("derive_version", F.when(F.col("id") % 4 < 2, 5).otherwise(6))
    return features.stale(marked, 6)


def _pixels(c: Catalogue) -> DataFrame:
    """Vectors as images of 8 by 8 pixels, of few colours."""
    level = (F.floor((F.col("v").cast("double") + 1) * 8) * 16).cast("int")
    return c.table("embeddings").select(F.col("vec_id").alias("img"), F.posexplode("embedding").alias("i", "v")).select(
        "img", (F.col("i") % 8).alias("x"), F.expr("i div 8").cast("int").alias("y"), level.alias("r"), ((level * 2) % 256).alias("g"), (255 - F.least(level, F.lit(255))).alias("b"), F.when(F.col("i") % 7 == 0, 0).otherwise(255).alias("a")
    )


_PIXELS = """cells AS (SELECT vec_id AS img, i, (floor((embedding[i + 1]::DOUBLE + 1) * 8) * 16)::INTEGER AS l FROM embeddings, range(64) AS t(i)), pixels AS (SELECT img, i % 8 AS x, i // 8 AS y, l AS r, (l * 2) % 256 AS g, 255 - least(l, 255) AS b, CASE WHEN i % 7 = 0 THEN 0 ELSE 255 END AS a FROM cells)"""


@query(f"WITH {_PIXELS}, counts AS (SELECT img, r, g, b, count(*) AS count FROM pixels WHERE a > 0 GROUP BY ALL) SELECT * FROM (SELECT img, (row_number() OVER (PARTITION BY img ORDER BY count DESC, r, g, b) - 1)::INTEGER AS rank, r, g, b, count, count / (sum(count) OVER (PARTITION BY img))::DOUBLE AS ratio FROM counts) WHERE rank < 16")
def image_palette(c: Catalogue) -> DataFrame:
    return features.palette(_pixels(c))


@query(
    f"""WITH {_PIXELS}, steps AS (SELECT img, greatest(abs(r - lag(r) OVER w), abs(g - lag(g) OVER w), abs(b - lag(b) OVER w)) AS d FROM pixels WINDOW w AS (PARTITION BY img, y ORDER BY x)), turns AS (SELECT img, count(*) AS t, count(*) FILTER (WHERE d <= 48) AS s FROM steps WHERE d > 0 GROUP BY img),
    basic AS (SELECT img, (max(x) + 1)::INTEGER AS width, (max(y) + 1)::INTEGER AS height, min(a) < 255 AS has_alpha, count(*) FILTER (WHERE a > 0 AND a < 255) > 0 AS has_semitransparent, count(DISTINCT CASE WHEN a > 0 THEN r * 65536 + g * 256 + b END) AS color_count FROM pixels GROUP BY img)
    SELECT basic.*, CASE WHEN color_count > 256 THEN false WHEN color_count <= 96 OR coalesce(t, 0) < 32 THEN true ELSE s / t < 0.4 END AS is_pixel_art FROM basic LEFT JOIN turns USING (img)"""
)
def image_stats(c: Catalogue) -> DataFrame:
    return features.image_stats(_pixels(c))


@query("SELECT vec_id AS clip, b AS bucket, list_min(embedding[(b * 64 + 9) // 10 + 1 : ((b + 1) * 64 + 9) // 10]) AS low, list_max(embedding[(b * 64 + 9) // 10 + 1 : ((b + 1) * 64 + 9) // 10]) AS high FROM embeddings, range(10) AS t(b)")
def sound_peaks(c: Catalogue) -> DataFrame:
    samples = c.table("embeddings").select(F.col("vec_id").alias("clip"), F.posexplode("embedding").alias("i", "v"))
    return features.peaks(samples, 10)


