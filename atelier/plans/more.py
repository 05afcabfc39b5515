"""Further queries: small tables, path functions over many names, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, values
from ..operators import activity, duplicates, facets, features, groups, listing, provenance, reconcile, records, removal, search, tags
from ..sources import library
from .catalogue import T0, Catalogue
from .registry import _PIXELS, ORACLES, _held, _pixels, query

NAMES = ["hero.png", "README.md", ".gitkeep", "a.ZIP", "noext", "Pack.tar.GZ", "x.glb", "y.mtl", "Thumbs.db", "z.import", "LICENSE", "q.wav"]
FOLDS = ["PNG", "2 Objects", "fbx(unity)", "Objects", "__MACOSX", "01_intro", "2d", "raw", "PSD_parts", "@eaDir"]


def _named(c: Catalogue) -> DataFrame:
    """A made-up path for each customer."""
    key = F.col("c_custkey")
    pick = lambda items, k: F.element_at(F.array(*map(F.lit, items)), (k % len(items) + 1).cast("int"))
    return c.table("customer").select(key.alias("id"), F.concat_ws("/", pick(FOLDS, key), pick(FOLDS, key * 7 + 3), pick(NAMES, key * 5 + 1)).alias("path"))


def _items(items: list[str], k: str) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + f"][({k}) % {len(items)} + 1]"


_NAMED = f"named AS (SELECT c_custkey AS id, {_items(FOLDS, 'c_custkey')} AS f1, {_items(FOLDS, 'c_custkey * 7 + 3')} AS f2, {_items(NAMES, 'c_custkey * 5 + 1')} AS name FROM customer)"
_EXT = "lower(regexp_extract(name, '[.]([^.]*)$', 1))"


@query(
    f"""WITH {_NAMED} SELECT id, {_EXT} AS ext, CASE {_EXT} WHEN 'png' THEN 'image' WHEN 'glb' THEN 'model' WHEN 'mtl' THEN 'material' WHEN 'wav' THEN 'audio' ELSE 'other' END AS kind,
    NOT (starts_with(name, '.') OR lower(name) IN ('readme.md', 'license') OR {_EXT} IN ('md', 'zip', 'gz', 'mtl', 'import')) AS is_asset,
    f1 IN ('__MACOSX', '@eaDir') OR f2 IN ('__MACOSX', '@eaDir') OR name = 'Thumbs.db' AS ignored, f1 = 'raw' OR f2 = 'raw' AS in_raw, 3 AS depth FROM named"""
)
def classify_names(c: Catalogue) -> DataFrame:
    name, path = paths.base_name(F.col("path")), F.col("path")
    return _named(c).select("id", paths.ext(name).alias("ext"), paths.kind(paths.ext(name)).alias("kind"), paths.is_asset(name).alias("is_asset"), paths.is_ignored(path).alias("ignored"), paths.in_raw(path).alias("in_raw"), paths.depth(path).alias("depth"))


_FORMATS = "('PNG', 'fbx(unity)', 'PSD_parts')"


@query(
    f"""WITH {_NAMED} SELECT id, CASE WHEN f1 IN {_FORMATS} THEN '' ELSE f1 || '/' END || CASE WHEN f2 IN {_FORMATS} THEN '' ELSE f2 || '/' END || regexp_replace(name, '[.][^./]*$', '') AS group_key, regexp_replace(regexp_replace(lower(f1), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM named"""
)
def group_keys(c: Catalogue) -> DataFrame:
    return _named(c).select("id", paths.group_key(F.col("path")).alias("group_key"), paths.slug(F.substring_index("path", "/", 1)).alias("slug"))


@query(
    f"""WITH {_NAMED}, each AS (SELECT id, unnest([f1, f2]) AS f FROM named) SELECT DISTINCT id, 'folder:' || CASE f WHEN '2 Objects' THEN 'objects' WHEN 'Objects' THEN 'objects' WHEN '__MACOSX' THEN 'macosx' WHEN '01_intro' THEN 'intro' WHEN '@eaDir' THEN 'eadir' ELSE f END AS tag FROM each WHERE f NOT IN {_FORMATS}"""
)
def folder_tags(c: Catalogue) -> DataFrame:
    return _named(c).select("id", F.explode(paths.path_tags(F.col("path"))).alias("tag"))


@query(
    f"""SELECT id, tag FROM (SELECT id, unnest(list_filter(['type:' || kind, CASE WHEN is_pixel_art THEN 'style:pixel-art' END, CASE WHEN has_alpha THEN 'has:alpha' END, CASE WHEN frame_count > 1 THEN 'has:animation' END], lambda x: x IS NOT NULL)) AS tag FROM assets)""",
    "assets",
)
def type_tags(c: Catalogue) -> DataFrame:
    return c.assets().select("id", F.explode(paths.type_tags(F.col("kind"), F.col("is_pixel_art"), F.col("has_alpha"), F.col("frame_count"))).alias("tag"))


@query("WITH files AS (SELECT 'c' || (o_custkey % 20) AS dir, 'c' || (o_custkey % 20) || '/' || o_orderkey AS path FROM orders) SELECT dir AS target, path FROM files WHERE dir IN ('c3', 'c7')")
def files_below(c: Catalogue) -> DataFrame:
    folder = F.concat(F.lit("c"), F.col("o_custkey") % 20)
    files = c.table("orders").select(F.concat_ws("/", folder, F.col("o_orderkey").cast("string")).alias("path"))
    return records.below(files, c.spark.createDataFrame([("c3",), ("c7",), ("c9/none",)], "target string"))


@query("SELECT 'rm -- ''' || path || '''' AS line, path FROM copies WHERE size > 3000", "copies")
def removal_script(c: Catalogue) -> DataFrame:
    return records.removal_script(c.copies().filter("size > 3000").withColumn("decision", F.lit("remove"))).select("line", "path")


@query(
    """WITH fresh AS (SELECT id, CASE WHEN id % 3 = 0 THEN name ELSE name || ' (new)' END AS name FROM packs WHERE id % 2 = 0 UNION ALL SELECT id + 1000000, name FROM packs WHERE id < 5)
    SELECT coalesce(f.id, p.id) AS id, coalesce(f.name, p.name) AS name, CASE WHEN f.id IS NULL OR f.name = p.name THEN 7 ELSE 99 END AS updated_at FROM packs p FULL JOIN fresh f USING (id)""",
    "packs",
)
def pack_upsert(c: Catalogue) -> DataFrame:
    packs = c.packs().select("id", "name", F.lit(7).alias("updated_at"))
    new = packs.filter("id % 2 = 0").select("id", F.when(F.col("id") % 3 == 0, F.col("name")).otherwise(F.concat("name", F.lit(" (new)"))).alias("name")).unionByName(packs.filter("id < 5").select((F.col("id") + 1_000_000).alias("id"), "name"))
    return records.upserted(packs, new, "id", "updated_at", 99)


@query(
    f"""SELECT 'assets' AS measure, count(*) AS value FROM assets UNION ALL SELECT 'missing', count(missing_since) FROM assets UNION ALL SELECT 'last_seen', max(first_seen_at) FROM assets
    UNION ALL SELECT 'queued', count(*) FROM events WHERE event_type = 'signup' UNION ALL SELECT 'failed', count(*) FROM events WHERE event_type = 'error'""",
    "assets",
)
def health(c: Catalogue) -> DataFrame:
    state = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "error", "failed").otherwise("done")
    return records.health(c.assets(), c.table("events").withColumn("state", state))


@query("SELECT CASE id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'done' WHEN 2 THEN 'failed' ELSE 'unsupported' END AS derive_state, count(*) AS n FROM assets GROUP BY 1", "assets")
def derive_states(c: Catalogue) -> DataFrame:
    state = F.when(F.col("id") % 4 == 0, "pending").when(F.col("id") % 4 == 1, "done").when(F.col("id") % 4 == 2, "failed").otherwise("unsupported")
    return records.derive_states(c.assets().withColumn("derive_state", state))


@query("SELECT ext AS kind, count(*) AS items, sum(size)::BIGINT AS bytes FROM assets WHERE missing_since IS NOT NULL GROUP BY ext", "assets")
def junk_totals(c: Catalogue) -> DataFrame:
    return records.junk_totals(c.assets().filter("missing_since is not null").withColumn("kind", F.col("ext")))


@query("SELECT greatest((SELECT coalesce(sum(b), 0) FROM (SELECT (count(*) - 1) * max(size) AS b FROM copies WHERE missing_since IS NULL GROUP BY sha256 HAVING count(*) > 1)), (SELECT sum(size) FROM copies WHERE in_raw))::BIGINT AS bytes", "copies")
def dup_reclaimable(c: Catalogue) -> DataFrame:
    packs = c.copies().filter(paths.in_raw(F.col("path"))).select(F.col("size").alias("bytes"))
    return records.reclaimable(duplicates.exact(c.copies()), packs)


@query(
    """WITH aliases(alias, tag) AS (VALUES ('bolts', 'object:bolt:small'), ('other', 'theme:red'), ('BOLD', 'theme:hot')) SELECT DISTINCT tag FROM (SELECT tag FROM asset_tags WHERE starts_with(lower(tag), 'bo') UNION ALL SELECT tag FROM aliases WHERE starts_with(lower(alias), 'bo')) ORDER BY tag LIMIT 20""",
    "asset_tags",
)
def suggest_tags(c: Catalogue) -> DataFrame:
    aliases = c.spark.createDataFrame([("bolts", "object:bolt:small"), ("other", "theme:red"), ("BOLD", "theme:hot")], "alias string, tag string")
    return records.tag_completions(c.asset_tags().select("tag"), aliases, "Bo")


@query("SELECT asset_id, CASE tag WHEN 'theme:red' THEN 'theme:crimson' ELSE tag END AS tag FROM asset_tags", "asset_tags")
def tag_aliases(c: Catalogue) -> DataFrame:
    aliases = c.spark.createDataFrame([("theme:red", "theme:crimson")], "alias string, tag string")
    return tags.resolve(c.asset_tags().select("asset_id", "tag"), aliases)


@query(f"WITH {_PIXELS}, counts AS (SELECT img, r, g, b, count(*) AS n FROM pixels WHERE a > 0 GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY n DESC, r, g, b) AS k FROM counts) SELECT img, string_agg(printf('#%02x%02x%02x', r, g, b), ' ' ORDER BY k) AS hexes FROM ranked WHERE k <= 16 GROUP BY img")
def palette_export(c: Catalogue) -> DataFrame:
    return features.hex_codes(features.palette(_pixels(c)))


@query("SELECT id, width // 4 AS frame_w, height // 2 AS frame_h FROM assets WHERE width IS NOT NULL", "assets")
def sheet_frames(c: Catalogue) -> DataFrame:
    return features.frames(c.assets().filter("width is not null").select("id", "width", "height", F.lit(4).alias("cols"), F.lit(2).alias("rows"))).select("id", F.col("frame_w").cast("int").alias("frame_w"), F.col("frame_h").cast("int").alias("frame_h"))


@query("SELECT vec_id AS id, floor(label / 8.0 * 100 + 0.5)::INTEGER AS pct, CASE WHEN label = 0 THEN -1 ELSE least(greatest(floor(vec_id % 7 * 100 / label), 0), 100) END::INTEGER AS done FROM embeddings")
def percentages(c: Catalogue) -> DataFrame:
    return c.table("embeddings").select(F.col("vec_id").alias("id"), values.similarity_pct(F.col("label") / 8.0).alias("pct"), values.percent(F.col("vec_id") % 7, F.col("label")).alias("done"))


@query("SELECT id, a.kind = 'image' AND coalesce(frame_count, 0) > 1 AS sheet, bit_count(xor(id, id * 3))::INTEGER AS dist FROM assets a", "assets")
def hash_distance(c: Catalogue) -> DataFrame:
    return c.assets().select("id", ((F.col("kind") == "image") & (F.coalesce("frame_count", F.lit(0)) > 1)).alias("sheet"), values.hamming(F.col("id"), F.col("id") * 3).alias("dist"))


@query("SELECT pack_id, CASE WHEN count(DISTINCT split_part(rel_path, '/', 1)) = 1 THEN min(split_part(rel_path, '/', 1)) ELSE '' END AS prefix FROM assets GROUP BY pack_id", "assets")
def flatten_prefix(c: Catalogue) -> DataFrame:
    return c.assets().groupBy("pack_id").agg(paths.flatten_prefix(F.col("rel_path")).alias("prefix"))


@query(f"SELECT count(*) FILTER (WHERE provenance_state <> 'complete') AS needed, max({T0} + id) AS last FROM packs", "packs")
def provenance_count(c: Catalogue) -> DataFrame:
    return c.packs().agg(F.count_if(F.col("provenance_state") != "complete").alias("needed"), F.max(F.col("id") + T0).alias("last"))


@query("SELECT id, filename, ext FROM assets WHERE sha256 IN (SELECT sha256 FROM assets WHERE id = 7)", "assets")
def same_content(c: Catalogue) -> DataFrame:
    one = c.assets().filter("id = 7").select("sha256")
    return c.assets().join(one, "sha256", "left_semi").select("id", "filename", "ext")


@query("SELECT a.id, f.n AS copies FROM assets a LEFT JOIN (SELECT sha256, count(*) AS n FROM assets WHERE missing_since IS NULL GROUP BY sha256) f USING (sha256)", "assets")
def fan_by_content(c: Catalogue) -> DataFrame:
    found = c.assets().filter("missing_since is null").groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"))
    return features.by_content(c.assets(), found).select("id", "copies")


@query("SELECT user_id AS id, count(*) AS n FROM events WHERE floor(epoch(ts))::BIGINT >= 1704500000 GROUP BY user_id")
def audit_recent(c: Catalogue) -> DataFrame:
    log = records.logged(c.table("events").filter("event_id % 2 = 0"), c.table("events").filter("event_id % 2 <> 0"))
    kept = activity.retained(log.withColumn("at", values.epoch("ts")), "at", 1_704_500_000)
    return kept.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PIXELS}, counts AS (SELECT img, r, g, b, count(*) AS n FROM pixels WHERE a > 0 GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY n DESC, r, g, b) AS k FROM counts) SELECT img, 'GIMP Palette' || chr(10) || 'Name: test' || chr(10) || 'Columns: 0' || chr(10) || '#' || chr(10) || string_agg(printf('%3d %3d %3d', r, g, b) || chr(9) || printf('#%02x%02x%02x', r, g, b) || chr(10), '' ORDER BY k) AS text FROM ranked WHERE k <= 16 GROUP BY img")
def palette_gpl(c: Catalogue) -> DataFrame:
    return features.palette_text(features.palette(_pixels(c)), "gpl", "test\n")


@query(
    """WITH sources AS (SELECT DISTINCT pack_id, group_key FROM assets WHERE ext IN ('psd', 'svg')) SELECT id FROM assets SEMI JOIN sources USING (pack_id, group_key)""",
    "assets",
)
def source_files(c: Catalogue) -> DataFrame:
    return search.matching(c.assets(), search.source_file(c.assets())).select("id")


@query("SELECT p_partkey AS id FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda w: levenshtein(w, 'widgt') <= 2)) > 0")
def fuzzy_names(c: Catalogue) -> DataFrame:
    return search.matching(c.table("part"), search.fuzzy("p_name", "widgt"), "p_partkey").select(F.col("p_partkey").alias("id"))


@query("SELECT project_id, asset_id, res_path, CASE WHEN removed_at IS NOT NULL THEN removed_at WHEN project_id = 7 AND asset_id % 2 = 0 THEN 1700000000 END AS removed_at FROM uses", "uses")
def project_removal(c: Catalogue) -> DataFrame:
    gone = c.uses().filter("project_id = 7 and asset_id % 2 = 0").select("project_id", "asset_id")
    return provenance.removed(c.uses(), gone, 1_700_000_000).select("project_id", "asset_id", "res_path", "removed_at")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'pending' ELSE 'done' END AS derive_state, CASE WHEN id % 3 <> 0 THEN 'e' || id END AS derive_error FROM assets", "assets")
def reset_failed(c: Catalogue) -> DataFrame:
    state = F.when(F.col("id") % 3 == 0, "failed").otherwise("done")
    return features.reset(c.assets().select("id", state.alias("derive_state"), F.concat(F.lit("e"), F.col("id")).alias("derive_error")))


@query("SELECT event_id AS id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' min ago' WHEN s < 86400 THEN (s // 3600) || ' h ago' ELSE (s // 86400) || ' d ago' END AS ago FROM (SELECT event_id, (event_id * 37) % 200000 AS s FROM events)")
def ages(c: Catalogue) -> DataFrame:
    return c.table("events").select(F.col("event_id").alias("id"), values.ago((F.col("event_id") * 37) % 200_000).alias("ago"))


@query(
    """WITH moves AS (SELECT id AS from_pack, id + 1 AS to_pack FROM packs WHERE id % 2 = 0), given AS (SELECT DISTINCT m.to_pack AS pack_id, a.sha256, t.tag FROM assets a JOIN moves m ON m.from_pack = a.pack_id JOIN asset_tags t ON t.asset_id = a.id AND t.source = 'manual'),
    gained AS (SELECT a.id AS asset_id, g.tag FROM assets a JOIN given g ON g.pack_id = a.pack_id AND g.sha256 = a.sha256) SELECT * FROM gained ANTI JOIN asset_tags USING (asset_id, tag)""",
    "packs", "assets", "asset_tags",
)
def asset_tag_transfer(c: Catalogue) -> DataFrame:
    moves = c.packs().filter("id % 2 = 0").select(F.col("id").alias("from_pack"), (F.col("id") + 1).alias("to_pack"))
    return duplicates.transferred_asset_tags(c.asset_tags(), c.assets(), moves)


@query(
    """WITH base AS (SELECT DISTINCT l_suppkey AS p, l_partkey AS c FROM lineitem), held AS (SELECT * FROM (SELECT p, c FROM base UNION ALL SELECT p + 1000000, c FROM base WHERE c % 4 <> 0 UNION ALL SELECT p + 2000000, c FROM base WHERE p % 3 = 0)), sizes AS (SELECT p, count(*) AS n, sum(c % 100)::BIGINT AS bytes FROM held GROUP BY p),
    kept AS (SELECT p, CASE WHEN p % 5 = 0 THEN 1000 ELSE 0 END + CASE WHEN p % 2 = 0 THEN 100 ELSE 0 END + CASE WHEN p % 7 = 0 THEN 0 ELSE 50 END + p % 4 AS k FROM sizes),
    met AS (SELECT x.p AS a, y.p AS b, count(*) AS shared FROM held x JOIN held y ON x.c = y.c AND x.p < y.p GROUP BY ALL),
    judged AS (SELECT a, b, shared, m.n AS na, k.n AS nb, m.bytes AS ba, k.bytes AS bb, ka.k AS ka, kb.k AS kb FROM met JOIN sizes m ON m.p = a JOIN sizes k ON k.p = b JOIN kept ka ON ka.p = a JOIN kept kb ON kb.p = b WHERE shared = m.n OR shared = k.n OR shared / (m.n + k.n - shared)::DOUBLE >= 0.5),
    turned AS (SELECT *, CASE WHEN shared = na AND shared = nb THEN ka > kb ELSE shared = nb END AS swap FROM judged)
    SELECT CASE WHEN swap THEN b ELSE a END AS candidate, CASE WHEN swap THEN a ELSE b END AS container, CASE WHEN shared = na AND shared = nb THEN 'identical' WHEN shared = na OR shared = nb THEN 'subset' ELSE 'overlap' END AS kind,
    CASE WHEN shared <> na AND shared <> nb THEN 0 WHEN swap THEN bb ELSE ba END AS bytes FROM turned"""
)
def pack_findings(c: Catalogue) -> DataFrame:
    return _findings(_held(c))


def _findings(chunks: DataFrame) -> DataFrame:
    p = F.col("pack_id")
    packs = chunks.select(F.col("p").alias("pack_id")).distinct().select("pack_id", (p % 5 == 0).alias("used"), (p % 2 == 0).alias("complete"), F.when(p % 7 == 0, "raw/x").otherwise("x").alias("path"), (p % 4).alias("tags"))
    held = chunks.select(F.col("p").alias("pack_id"), F.explode("cs").alias("sha256"))
    return duplicates.pack_findings(duplicates.chunk_overlaps(chunks), packs, held.withColumn("size", F.col("sha256") % 100))


@query(f"WITH {_NAMED} SELECT 'c/' || id AS pack, f1 || '/' || f2 || '/' || name AS rel_path, {_EXT} AS ext, id % 100 AS size FROM named WHERE id % 2 = 0 AND NOT (starts_with(name, '.') OR lower(name) IN ('readme.md', 'license') OR {_EXT} IN ('md', 'zip', 'gz', 'mtl', 'import')) AND NOT (f1 IN ('__MACOSX', '@eaDir') OR f2 IN ('__MACOSX', '@eaDir') OR name = 'Thumbs.db')")
def index_rebuilt(c: Catalogue) -> DataFrame:
    files = _named(c).select(F.concat_ws("/", F.lit("c"), F.col("id").cast("string"), "path").alias("path"), (F.col("id") % 100).alias("size"), F.lit(1).alias("mtime"))
    packs = c.table("customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("c/"), F.col("c_custkey")).alias("pack"))
    return reconcile.rebuilt(files, packs).select("pack", "rel_path", "ext", "size")


# ---- findings, hand-overs and lists ----------------------------------------------------------


@query(
    f"""WITH words(value, shown, place) AS (VALUES {", ".join(f"('{k}', '{v}', {i})" for i, (k, v) in enumerate(facets.KEYWORDS))}), there AS (SELECT * FROM assets WHERE missing_since IS NULL),
    tag AS (SELECT tag AS value, count(*) AS n FROM asset_tags WHERE starts_with(lower(tag), 's') OR starts_with(lower(substr(tag, instr(tag, ':') + 1)), 's') GROUP BY tag ORDER BY n DESC, value LIMIT 6),
    pack AS (SELECT name AS value, count(there.id) AS n FROM packs LEFT JOIN there ON pack_id = packs.id WHERE starts_with(lower(name), 's') GROUP BY packs.id, name ORDER BY n DESC, value LIMIT 6),
    file AS (SELECT DISTINCT filename AS value, length(filename) AS len FROM there WHERE starts_with(lower(filename), 's') ORDER BY len, value LIMIT 6)
    SELECT 'keyword' AS grp, value, NULL::BIGINT AS n, (row_number() OVER (ORDER BY place) - 1)::INTEGER AS place FROM words WHERE starts_with(value, 's') OR starts_with(shown, 's')
    UNION ALL SELECT 'tag', value, n, (row_number() OVER (ORDER BY n DESC, value) - 1)::INTEGER FROM tag UNION ALL SELECT 'pack', value, n, (row_number() OVER (ORDER BY n DESC, value) - 1)::INTEGER FROM pack
    UNION ALL SELECT 'filename', value, NULL, (row_number() OVER (ORDER BY len, value) - 1)::INTEGER FROM file""",
    "assets", "asset_tags", "packs",
)
def suggest_search(c: Catalogue) -> DataFrame:
    return facets.suggestions(c.assets(), c.asset_tags(), c.packs(), "type:model S")


_KEEP = "CASE WHEN used THEN 1000 ELSE 0 END + CASE WHEN complete THEN 100 ELSE 0 END + CASE WHEN in_raw THEN 0 ELSE 50 END + CASE WHEN is_primary AND variants > 1 THEN 25 ELSE 0 END - len(string_split(path, '/'))"


@query(
    f"""WITH there AS (SELECT *, {_KEEP} AS score FROM copies WHERE missing_since IS NULL)
    SELECT sha256, count(*) AS copies, ((count(*) - 1) * max(size))::BIGINT AS bytes, arg_min(id, (-score, first_seen_at, path, id)) AS keep_id FROM there GROUP BY sha256 HAVING count(*) > 1 ORDER BY bytes DESC, sha256""",
    "copies",
)
def dup_exact_findings(c: Catalogue) -> DataFrame:
    return duplicates.exact_findings(c.copies())


@query(
    f"""SELECT (SELECT count(*) FROM documents WHERE doc_id % 31 <> 0) AS assets, e.n AS exact_findings, coalesce(e.b, 0) AS exact_bytes, n.n AS near_findings, p.n AS pack_findings, coalesce(p.b, 0) AS pack_bytes, greatest(coalesce(e.b, 0), coalesce(p.b, 0)) AS reclaimable
    FROM (SELECT count(*) AS n, sum(bytes)::BIGINT AS b FROM ({ORACLES["dup_exact_findings"]})) e, (SELECT count(*) AS n FROM ({ORACLES["dup_near_clusters"]})) n, (SELECT count(*) AS n, sum(bytes)::BIGINT AS b FROM ({ORACLES["pack_findings"]})) p"""
)
def dup_report(c: Catalogue) -> DataFrame:
    """Exact, near and pack findings, each by its own operator over its whole table."""
    return duplicates.report(c.copies(), duplicates.exact_findings(c.copies()), duplicates.near_findings(c.hashes()), _findings(_held(c)))


@query(
    """RECURSIVE WITH c AS (SELECT id, path, sha256, size FROM copies WHERE missing_since IS NULL), folders AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS path FROM c),
    targets AS (SELECT path AS t, false AS is_folder FROM c WHERE id % 3 = 0 UNION ALL SELECT path, true FROM folders WHERE NOT starts_with(path, 'raw/')), held AS (SELECT t, c.* FROM targets JOIN c ON c.path = t OR starts_with(c.path, t || '/')),
    sizes AS (SELECT t, sum(size)::BIGINT AS bytes, count(*) AS files FROM held GROUP BY t), blocked AS (SELECT t, string_agg(DISTINCT 'p' || (id % 2), ', ' ORDER BY 'p' || (id % 2)) AS projects FROM held WHERE id % 101 = 0 GROUP BY t),
    cover AS (SELECT t, sha256, count(*) AS n FROM held WHERE t NOT IN (SELECT t FROM blocked) GROUP BY ALL), every AS (SELECT sha256, count(*) AS n FROM c GROUP BY sha256),
    base AS (SELECT sha256, any_value(every.n) - sum(cover.n) AS stay FROM cover JOIN every USING (sha256) GROUP BY sha256 HAVING any_value(every.n) < 1 + sum(cover.n)), critical AS (SELECT cover.*, stay FROM cover JOIN base USING (sha256)),
    ranked AS (SELECT t, row_number() OVER (ORDER BY t) AS i FROM (SELECT DISTINCT t FROM critical)),
    turns(i, refused) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL
        SELECT i + 1, CASE WHEN bool_or(now < 1) THEN list_append(any_value(refused), any_value(t)) ELSE any_value(refused) END FROM (
            SELECT turns.i, any_value(turns.refused) AS refused, a.t, a.sha256, any_value(a.stay) + coalesce(sum(d.n) FILTER (WHERE list_contains(turns.refused, d.t)), 0) AS now
            FROM turns JOIN ranked o ON o.i = turns.i + 1 JOIN critical a ON a.t = o.t JOIN critical d ON d.sha256 = a.sha256 GROUP BY turns.i, a.t, a.sha256) GROUP BY i),
    last_ AS (SELECT unnest(arg_max(refused, i)) AS t FROM turns)
    SELECT t AS path, is_folder, bytes, files, CASE WHEN projects IS NOT NULL OR l.t IS NOT NULL THEN 'refuse' ELSE 'do' END AS decision, CASE WHEN projects IS NOT NULL THEN 'in use by ' || projects WHEN l.t IS NOT NULL THEN 'the last copy of its content' END AS reason
    FROM targets JOIN sizes USING (t) LEFT JOIN blocked USING (t) LEFT JOIN last_ l USING (t)""",
    "copies",
)
def removal_of_folders(c: Catalogue) -> DataFrame:
    """A third of all files and the folders that are not raw, marked at once: uses block, and each content keeps a copy."""
    assets = c.copies().filter("missing_since is null").select("id", "path", "sha256", "size")
    folders = assets.select(paths.parent_dir(F.col("path")).alias("path")).distinct()
    entry = lambda t, kind, size: t.select(F.lit("library").alias("root"), "path", F.lit(kind).alias("kind"), size.cast("long").alias("size"))
    targets = assets.filter("id % 3 = 0").select("path").unionByName(folders.filter(~F.col("path").startswith("raw/")))
    targets = targets.select(F.lit("library").alias("root"), "path", F.lit("trash").alias("action"), F.lit("").alias("keep_path"))
    uses = assets.filter("id % 101 = 0").select(F.col("id").alias("asset_id"), F.concat(F.lit("p"), F.col("id") % 2).alias("project"))
    made = removal.plan(targets, entry(assets, "file", F.col("size")).unionByName(entry(folders, "folder", F.lit(0))), assets, uses)
    return made.select("path", "is_folder", "bytes", "files", "decision", "reason")


@query(
    """WITH moves AS (SELECT id AS from_pack, id + 1 AS to_pack FROM packs WHERE id % 2 = 0), tagged AS (SELECT DISTINCT a.id, a.pack_id, a.sha256 FROM assets a JOIN asset_tags t ON t.asset_id = a.id WHERE t.source = 'manual')
    SELECT from_pack, to_pack, count(*) AS n FROM tagged JOIN moves ON pack_id = from_pack WHERE NOT EXISTS (SELECT 1 FROM assets x WHERE x.pack_id = to_pack AND x.sha256 = tagged.sha256) GROUP BY ALL""",
    "packs", "assets", "asset_tags",
)
def transfer_unmatched(c: Catalogue) -> DataFrame:
    moves = c.packs().filter("id % 2 = 0").select(F.col("id").alias("from_pack"), (F.col("id") + 1).alias("to_pack"))
    return duplicates.unmatched(c.asset_tags(), c.assets(), moves)


@query(
    """WITH p AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'u' || id ELSE '' END AS source_url, CASE WHEN id % 4 = 0 THEN '' ELSE 'a' || id END AS author, CASE WHEN id % 5 <> 0 THEN license_id END AS license_id, CASE WHEN id % 2 = 0 THEN 'complete' ELSE 'needs_provenance' END AS provenance_state FROM packs),
    filled AS (SELECT t.id, CASE WHEN t.source_url = '' THEN coalesce(s.source_url, t.source_url) ELSE t.source_url END AS source_url, CASE WHEN t.author = '' THEN coalesce(s.author, t.author) ELSE t.author END AS author, coalesce(t.license_id, s.license_id) AS license_id, t.provenance_state AS was, s.provenance_state AS theirs
        FROM p t LEFT JOIN p s ON s.id = t.id - 1 AND s.id % 2 = 0)
    SELECT id, source_url, author, license_id, CASE WHEN was = 'needs_provenance' AND theirs = 'complete' AND source_url <> '' AND license_id IS NOT NULL THEN 'complete' ELSE was END AS provenance_state FROM filled""",
    "packs",
)
def transfer_provenance(c: Catalogue) -> DataFrame:
    key = F.col("id")
    packs = c.packs().select(
        "id", F.when(key % 3 == 0, F.concat(F.lit("u"), key)).otherwise("").alias("source_url"), F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("a"), key)).alias("author"),
        F.when(key % 5 != 0, F.col("license_id")).alias("license_id"), F.when(key % 2 == 0, "complete").otherwise("needs_provenance").alias("provenance_state"),
    )
    moves = packs.filter("id % 2 = 0").select(key.alias("from_pack"), (key + 1).alias("to_pack"))
    return duplicates.curated(packs, moves, ["source_url", "author"])


@query("SELECT count(*) AS disabled FROM assets WHERE missing_since IS NULL AND id IN (SELECT asset_id FROM asset_tags WHERE tag = 'disable:true')", "assets", "asset_tags")
def stats_hidden(c: Catalogue) -> DataFrame:
    return listing.hidden(c.assets(), c.asset_tags())


@query(
    """WITH shown AS (SELECT pack_id, group_key, arg_min(id, (missing_since IS NOT NULL, precedence, rel_path, id)) AS primary_id, count(*) AS variants FROM assets GROUP BY pack_id, group_key)
    SELECT primary_id, filename, g.group_key FROM shown g JOIN assets a ON a.id = primary_id JOIN packs p ON p.id = g.pack_id WHERE filename > 'old_bolt.glb' OR filename = 'old_bolt.glb' AND primary_id > 100 ORDER BY filename, primary_id LIMIT 101""",
    "assets", "packs",
)
def keyset_groups(c: Catalogue) -> DataFrame:
    return listing.groups_after(groups.primaries(groups.regroup(c.assets()), c.assets(), c.packs()), "old_bolt.glb", 100).select("primary_id", "filename", "group_key")


@query("SELECT event_id AS id, user_id, c_name AS name, c_mktsegment AS role FROM events JOIN customer ON c_custkey = user_id WHERE floor(epoch(ts))::BIGINT + 86400 > 1705000000 AND floor(epoch(ts))::BIGINT + 3600 > 1705000000")
def sessions_of_users(c: Catalogue) -> DataFrame:
    at = values.epoch("ts")
    sessions = c.table("events").select(F.col("event_id").alias("id"), "user_id", (at + 86_400).alias("expires_at"), (at + 3600).alias("idle_expires_at"))
    users = c.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("role"))
    return activity.signed_in(sessions, users, 1_705_000_000).select("id", "user_id", "name", "role")


@query("SELECT id, name, id % 7 AS updated_at FROM packs ORDER BY updated_at DESC, name", "packs")
def saved_searches(c: Catalogue) -> DataFrame:
    return records.latest_first(c.packs().select("id", "name", (F.col("id") % 7).alias("updated_at")))


_LEFTOVERS = """CASE id % 6 WHEN 0 THEN 'p/__MACOSX/' || id WHEN 1 THEN 'p/' || id || '/.DS_Store' WHEN 2 THEN 'p/' || id || '.png' WHEN 3 THEN 'x/_derived/' || sha256 || '/t.webp' WHEN 4 THEN 'x/_derived/' || sha256(id::VARCHAR) || '/t.webp' ELSE 'p/pack.asset.json' END"""


@query(
    f"""WITH files_ AS (SELECT {_LEFTOVERS} AS path, CASE WHEN id % 4 = 0 THEN 0 ELSE id END AS size FROM assets)
    SELECT path, CASE WHEN contains(path, '__MACOSX/') THEN 'macos' WHEN ends_with(path, '.DS_Store') THEN 'system' WHEN size = 0 AND path <> 'p/pack.asset.json' THEN 'empty' ELSE 'orphan' END AS kind, size FROM files_
    WHERE contains(path, '__MACOSX/') OR ends_with(path, '.DS_Store') OR (size = 0 AND path <> 'p/pack.asset.json') OR (contains(path, '_derived/') AND split_part(path, '/', 3) NOT IN (SELECT sha256 FROM assets))""",
    "assets",
)
def junk_found(c: Catalogue) -> DataFrame:
    key, text = F.col("id"), F.col("id").cast("string")
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    path = (
        F.when(key % 6 == 0, join("p/__MACOSX/", text)).when(key % 6 == 1, join("p/", text, "/.DS_Store")).when(key % 6 == 2, join("p/", text, ".png"))
        .when(key % 6 == 3, join("x/_derived/", F.col("sha256"), "/t.webp")).when(key % 6 == 4, join("x/_derived/", F.sha2(text, 256), "/t.webp")).otherwise("p/pack.asset.json")
    )
    return library.junk(c.assets().select(path.alias("path"), F.when(key % 4 == 0, 0).otherwise(key).alias("size")), c.assets().select("sha256"))


@query("SELECT DISTINCT 'f/' || id AS path, 'empty_folder' AS kind, 0::BIGINT AS size FROM packs WHERE id % 3 <> 0 AND id % 5 <> 0", "packs")
def junk_empty_folders(c: Catalogue) -> DataFrame:
    """Every third folder holds a file, every fifth a folder with a file."""
    folder = F.concat(F.lit("f/"), F.col("id").cast("string"))
    inner = c.packs().filter("id % 5 = 0").select(F.concat(folder, F.lit("/in")).alias("dir"))
    folders = c.packs().select(folder.alias("dir")).unionByName(inner)
    files = c.packs().filter("id % 3 = 0").select(F.concat(folder, F.lit("/a.png")).alias("path")).unionByName(inner.select(F.concat("dir", F.lit("/b.png")).alias("path")))
    return library.empty_folders(folders, files)
