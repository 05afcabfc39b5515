"""Queries over what Spark writes below the shared folder: trees of files made of documents, versions of tables, the output of streams."""

from __future__ import annotations

import io
import struct
import wave
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values
from ..operators import features, reconcile, resample, search, textindex
from ..operators.scratch import cut, place
from ..sources import images, library, media, sprites, tree, versions
from ..streaming import watch
from .catalogue import Catalogue
from .registry import _PIXELS, ORACLES, PLAIN_TEXT, _pixels, query

#: Files of a folder, where one task lists it.
FOLDER = 1000
#: Where each document lies, and what it is called: hidden files, system files, reserved and ignored folders among them.
_PATH = """CASE WHEN doc_id % 41 = 0 THEN '_trash/' WHEN doc_id % 37 = 0 THEN '__MACOSX/' WHEN doc_id % 31 = 0 THEN 'a/.git/' ELSE 'd' || (doc_id % 7) || '/' || lang || '/' END
    || CASE WHEN doc_id % 29 = 0 THEN '._' WHEN doc_id % 23 = 0 THEN '.' WHEN doc_id % 19 = 0 THEN '_' ELSE '' END || doc_id || CASE WHEN doc_id % 17 = 0 THEN ' x#%41 [1]' ELSE '' END || '.txt'"""
_TEXT = "CASE WHEN doc_id % 13 = 0 THEN '' ELSE coalesce(text, '') END"
_FILES = f"files AS (SELECT doc_id, {_PATH} AS path, {_TEXT} AS content FROM documents)"
_KEPT = "kept AS (SELECT * FROM files WHERE doc_id % 41 <> 0 AND doc_id % 37 <> 0 AND doc_id % 31 <> 0 AND doc_id % 29 <> 0)"


def _tree(c: Catalogue) -> tuple[str, DataFrame]:
    """A new tree of all documents, and their ids, paths and contents."""
    root = place(c.spark, "tree")
    files = c.table("documents").select("doc_id", F.expr(_PATH).alias("path"), F.expr(_TEXT).alias("content"))
    tree.written(files, root).agg(F.sum("size")).first()
    return root, files


@query(f"WITH {_FILES}, {_KEPT} SELECT path, strlen(content) AS size FROM kept")
def tree_listed(c: Catalogue) -> DataFrame:
    """Empty, hidden and underscore files, without ignored names and reserved folders."""
    root, _ = _tree(c)
    return library.listing(c.spark, root).select("path", "size")


@query(f"WITH {_FILES}, {_KEPT} SELECT path, strlen(content) AS size FROM kept WHERE starts_with(path, 'd3/e')")
def tree_below_prefix(c: Catalogue) -> DataFrame:
    """A prefix of the path keeps other folders from being entered."""
    root, _ = _tree(c)
    return library.listing(c.spark, root).filter(F.col("path").startswith("d3/e")).select("path", "size")


@query(f"WITH {_FILES}, {_KEPT} SELECT path, strlen(content) AS size, sha256(content) AS sha256 FROM kept")
def tree_hashed(c: Catalogue) -> DataFrame:
    root, _ = _tree(c)
    return library.listing(c.spark, root, content=True).select("path", "size", "sha256")


@query(f"WITH {_FILES}, {_KEPT} SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'stored' ELSE sha256(content) END AS sha256 FROM kept")
def tree_rehashed(c: Catalogue) -> DataFrame:
    """A third is in the index as it is, and keeps the hash that is there; a third differs in size, a third is new."""
    root, files = _tree(c)
    rest = F.regexp_extract("path", r"(\d+)[^/\d]?[^/]*$", 1).cast("long") % 3
    index = cut(library.listing(c.spark, root)).filter(rest < 2).select("path", (F.col("size") + rest).alias("size"), "mtime", F.lit("stored").alias("sha256"))
    return library.rehashed(c.spark, root, index).select("path", "sha256")


@query(f"WITH {_FILES} SELECT count(*) AS checked, count(*) FILTER (WHERE doc_id % 5 = 0 AND doc_id % 11 <> 0) AS mismatched, count(*) FILTER (WHERE doc_id % 11 = 0) AS absent FROM files WHERE doc_id % 6 <> 0")
def tree_verified(c: Catalogue) -> DataFrame:
    """Every present file is read anew: some have other contents than the index says, some are gone."""
    root, files = _tree(c)
    key = F.col("doc_id")
    index = files.select(
        F.when(key % 11 == 0, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("path"), F.octet_length("content").alias("size"),
        F.when(key % 5 == 0, "rotten").otherwise(F.sha2(F.col("content").cast("binary"), 256)).alias("sha256"), F.when(key % 6 == 0, F.lit(1)).alias("missing_since"),
    )
    return reconcile.verify(index, library.present_hashes(index, root))


@query(
    f"""WITH {_FILES}, there AS (SELECT *, strlen(content) AS size FROM files WHERE doc_id % 41 <> 0), plain AS (SELECT * FROM there WHERE NOT starts_with(path, '__MACOSX/'))
    SELECT '__MACOSX' AS path, 'macos' AS kind, sum(size)::BIGINT AS size FROM there WHERE starts_with(path, '__MACOSX/') HAVING count(*) > 0
    UNION ALL SELECT path, CASE WHEN doc_id % 29 = 0 THEN 'system' ELSE 'empty' END, size FROM plain WHERE doc_id % 29 = 0 OR size = 0"""
)
def tree_clutter(c: Catalogue) -> DataFrame:
    root, _ = _tree(c)
    return library.clutter(c.spark, root, c.assets().select("sha256"))


@query(
    """WITH old_tags AS (SELECT * FROM asset_tags), present AS (SELECT id, kind, size FROM assets WHERE missing_since IS NULL),
    counts AS (SELECT asset_id AS id, count(*) AS n FROM asset_tags WHERE asset_id IN (SELECT id FROM present) GROUP BY asset_id)
    SELECT 2 AS version, kind, count(*) AS assets, sum(n)::BIGINT AS tags, sum(size)::BIGINT AS bytes FROM present JOIN counts USING (id) GROUP BY kind
    UNION ALL SELECT 1, kind, count(*), sum(n)::BIGINT, sum(size)::BIGINT FROM assets JOIN (SELECT asset_id AS id, count(*) AS n FROM old_tags GROUP BY asset_id) USING (id) GROUP BY kind""",
    "assets", "asset_tags",
)
def index_versions(c: Catalogue) -> DataFrame:
    """Assets and their tags, committed as one, then again without missing assets and their tags; both versions can be read."""
    root = place(c.spark, "index")
    first = versions.commit(versions.snapshot(c.spark, root), {"assets": c.assets(), "asset_tags": c.asset_tags()})

    def present(base: versions.Snapshot) -> dict[str, DataFrame]:
        kept = base.table("assets").filter("missing_since is null")
        return {"assets": kept, "asset_tags": base.table("asset_tags").join(kept.select(F.col("id").alias("asset_id")), "asset_id", "left_semi")}

    second = versions.update(c.spark, root, present)
    return _by_kind(second).unionByName(_by_kind(versions.snapshot(c.spark, root, first.version)))


# ---- models and images ----------------------------------------------------------------------------


@query("SELECT 'm' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.gltf' ELSE '.glb' END AS name, p_size::BIGINT AS vert_count, (p_partkey % 300 // 3)::BIGINT AS tri_count, 2 AS material_count, p_size / 2.0::DOUBLE AS bbox_y FROM part WHERE p_partkey % 5 <> 1 OR p_partkey % 3 = 0")
def models_in_containers(c: Catalogue) -> DataFrame:
    """Parts as models: two thirds in containers, some of which are cut short and have no rows."""
    key, root = F.col("p_partkey"), place(c.spark, "models")
    text = F.format_string(
        '{"accessors":[{"count":%d,"type":"VEC3","min":[0,0,0],"max":[1,%s,3]},{"count":%d}],"materials":[{"name":"a"},{"name":"é"}],"meshes":[{"primitives":[{"attributes":{"POSITION":0},"indices":1}]}]}',
        F.col("p_size"), (F.col("p_size") / 2).cast("string"), key % 300,
    )
    raw = F.encode(text, "utf-8")
    number = lambda n: F.unhex(F.concat(*(F.substring(F.lpad(F.hex(n.cast("long")), 8, "0"), at, 2) for at in (7, 5, 3, 1))))
    whole = F.concat(F.lit(b"glTF"), number(F.lit(2)), number(F.length(raw) + 20), number(F.length(raw)), F.lit(b"JSON"), raw)
    plain = key % 3 == 0
    content = F.when(plain, raw).when(key % 5 == 1, F.call_function("substring", whole, F.lit(1), F.length(whole) - 3)).otherwise(whole)
    rows = c.table("part").repartition(4 * c.spark.sparkContext.defaultParallelism)  # files take longer to make than their rows to read
    tree.written(rows.select(F.concat(F.floor(key / FOLDER), F.lit("/m"), key, F.when(plain, ".gltf").otherwise(".glb")).alias("path"), content.alias("content")), root).agg(F.sum("size")).first()
    read = features.models(media.gltf_texts(c.spark, root).filter("error is null"))
    return read.select(F.substring_index("id", "/", -1).alias("name"), "vert_count", "tri_count", "material_count", "bbox_y")


def _weights(name: str, to: int) -> str:
    """SQL of the filter's weights from 8 pixels to ``to``."""
    reach = max(1.0, 8 / to)
    t = f"abs((cell + 0.5) * {8 / to!r} - 0.5 - k) / {reach!r}"
    return f"""{name} AS (SELECT cell, k, w / sum(w) OVER (PARTITION BY cell) AS w FROM (SELECT cell, k, CASE WHEN t < 1 THEN (1.5 * t - 2.5) * t * t + 1 WHEN t < 2 THEN ((-0.5 * t + 2.5) * t - 4) * t + 2 ELSE 0 END AS w
        FROM (SELECT cell, k, ({t})::DOUBLE AS t FROM range({to}) AS a(cell), range(8) AS b(k))) WHERE w <> 0)"""


@query(
    f"""WITH {_PIXELS}, {_weights("wx", 9)}, {_weights("wy", 8)}, deep AS (SELECT img, x, y, {", ".join(f"({c} * 257 * a // 255) / 65535.0::DOUBLE AS {c}" for c in "rgb")}, a * 257 / 65535.0::DOUBLE AS a FROM pixels),
    across AS (SELECT img, y, cell AS cx, {", ".join(f"sum({c} * w) AS {c}" for c in "rgba")} FROM deep JOIN wx ON x = k GROUP BY ALL), down AS (SELECT img, cx, cell AS cy, {", ".join(f"sum({c} * w) AS {c}" for c in "rgba")} FROM across JOIN wy ON y = k GROUP BY ALL),
    bytes AS (SELECT img, cx, cy, {", ".join(f"floor(least(greatest(floor(65535 * least({c}, a) + 0.5), 0), 65535) / 256)::BIGINT AS {c}" for c in "rgb")} FROM down),
    grey AS (SELECT img, cx, cy, (299 * 257 * r + 587 * 257 * g + 114 * 257 * b) // 1000 AS v FROM bytes), turns AS (SELECT img, cx, cy, v > lead(v) OVER (PARTITION BY img, cy ORDER BY cx) AS bit FROM grey)
    SELECT img, lpad(lower(to_hex((sum(CASE WHEN bit THEN (1::HUGEINT << (63 - cy * 8 - cx)::INTEGER) ELSE 0 END))::UBIGINT)), 16, '0') AS phash FROM turns WHERE cx < 8 GROUP BY img"""
)
def image_hash_cubic(c: Catalogue) -> DataFrame:
    return resample.difference_hash(_pixels(c)).select("img", F.lower(F.lpad(F.hex("phash"), 16, "0")).alias("phash"))


def _sprite(low: bytes, high: bytes) -> bytes:
    """A sprite file of 8 by 8 pixels: two frames, two layers, the second frame linked and moved."""
    chunk = lambda kind, body: struct.pack("<IH", len(body) + 6, kind) + body
    layer = lambda opacity: chunk(sprites.LAYER, struct.pack("<6HB3xH", 1, 0, 0, 0, 0, 0, opacity, 0))
    cel = lambda at, x, how, body: chunk(sprites.CEL, struct.pack("<HhhBHh5x", at, x, 0, 255, how, 0) + body)
    full = lambda raw: struct.pack("<HH", 8, 8) + zlib.compress(raw)
    frames = [[layer(255), layer(130), cel(0, 0, sprites.PACKED, full(low)), cel(1, 0, sprites.PACKED, full(high))], [cel(0, 0, sprites.LINKED, struct.pack("<H", 0)), cel(1, 3, sprites.LINKED, struct.pack("<H", 0))]]
    bodies = [struct.pack("<IHHHHI", 16 + sum(map(len, f)), sprites.FRAME_MAGIC, len(f), 100, 0, len(f)) + b"".join(f) for f in frames]
    return struct.pack("<IHHHHH114x", 0, sprites.FILE_MAGIC, 2, 8, 8, 32) + b"".join(bodies)


_MUL = "((({0}) * ({1}) + 128 >> 8) + ({0}) * ({1}) + 128 >> 8)"


@query(
    f"""WITH {_PIXELS}, over_ AS (SELECT img, f, x + 3 * f AS x, y, g AS r2, b AS g2, r AS b2, {_MUL.format("(x * 37 + y * 11) % 256", "130")} AS a2 FROM pixels, range(2) AS t(f)),
    both_ AS (SELECT img, f AS frame, x, y, r, g, b, a, coalesce(r2, 0) AS r2, coalesce(g2, 0) AS g2, coalesce(b2, 0) AS b2, coalesce(a2, 0) AS a2 FROM (SELECT * FROM pixels, range(2) AS t(f)) LEFT JOIN over_ USING (img, f, x, y)),
    mixed AS (SELECT *, a + a2 - {_MUL.format("a", "a2")} AS m FROM both_)
    SELECT img, frame::INTEGER AS frame, x::INTEGER AS x, y::INTEGER AS y, {", ".join(f"(CASE WHEN a2 = 0 THEN CASE WHEN a = 0 THEN 0 ELSE {c} END WHEN a = 0 THEN {c}2 ELSE {c} + trunc(({c}2 - {c}) * a2 / m::DOUBLE)::BIGINT END)::INTEGER AS {c}" for c in "rgb")},
        (CASE WHEN a2 = 0 THEN a WHEN a = 0 THEN a2 ELSE m END)::INTEGER AS a FROM mixed"""
)
def sprite_layers(c: Catalogue) -> DataFrame:
    """Vectors as sprites of two layers, written as files; the pixels of their frames."""
    root = place(c.spark, "sprites")
    cell = lambda *v: F.array(*(F.coalesce(x, F.lit(0)).cast("int") for x in v))
    alpha = (F.col("x") * 37 + F.col("y") * 11) % 256
    rows = _pixels(c).groupBy("img").agg(F.array_sort(F.collect_list(F.struct("y", "x", cell(F.col("r"), F.col("g"), F.col("b"), F.col("a")).alias("low"), cell(F.col("g"), F.col("b"), F.col("r"), alpha).alias("high")))).alias("p"))
    flat = rows.select("img", F.flatten(F.transform("p", lambda s: s["low"])).alias("low"), F.flatten(F.transform("p", lambda s: s["high"])).alias("high"))

    def files(batches):
        for batch in batches:
            made = [_sprite(bytes(low), bytes(high)) for low, high in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([f"{img % 10}/v{img}.aseprite" for img in batch.column(0).to_pylist()]), pa.array(made, pa.binary())], ["path", "content"])

    tree.written(flat.mapInArrow(files, "path string, content binary"), root).agg(F.sum("size")).first()
    read = sprites.sprite_pixels(c.spark, root).filter("error is null")
    return read.select(F.regexp_extract("img", r"v(\d+)[.]aseprite$", 1).cast("long").alias("img"), "frame", "x", "y", "r", "g", "b", "a")


def _image(key: int, rgba: bytes) -> tuple[str, bytes]:
    """Name and content of an image file of 8 by 8 pixels, of one of three kinds."""
    cells = np.frombuffer(rgba, np.uint8).reshape(8, 8, 4)
    if key % 3 == 0:
        chunk = lambda kind, body: struct.pack(">I4s", len(body), kind) + body + struct.pack(">I", zlib.crc32(kind + body))
        up = np.diff(cells.reshape(8, 32), axis=0, prepend=np.zeros((1, 32), np.uint8))
        lines = zlib.compress(np.concatenate([np.full((8, 1), 2, np.uint8), up], 1).tobytes())
        return f"v{key}.png", b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 8, 8, 6, 0, 0, 0)) + chunk(b"IDAT", lines) + chunk(b"IEND", b"")
    if key % 3 == 1:
        return f"v{key}.tga", struct.pack("<BBBHHBHHHHBB", 0, 0, 10, 0, 0, 0, 0, 0, 8, 8, 32, 8) + b"".join(b"\x80" + cells[y, x, [2, 1, 0, 3]].tobytes() for y in range(7, -1, -1) for x in range(8))
    return f"v{key}.psd", b"8BPS" + struct.pack(">H6xHIIHH", 1, 4, 8, 8, 8, 3) + bytes(12) + struct.pack(">H", 0) + cells.transpose(2, 0, 1).tobytes()


@query(f"WITH {_PIXELS} SELECT img, x::INTEGER AS x, y::INTEGER AS y, r, g, b, a FROM pixels")
def image_files(c: Catalogue) -> DataFrame:
    """Vectors as image files of three kinds, written and read again."""
    root = place(c.spark, "images")
    cells = F.array_sort(F.collect_list(F.struct("y", "x", F.array(*(F.col(k).cast("int") for k in "rgba")).alias("c"))))
    flat = _pixels(c).groupBy("img").agg(F.flatten(F.transform(cells, lambda s: s["c"])).alias("c"))

    def files(batches):
        for batch in batches:
            made = [_image(img, bytes(cells)) for img, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([f"{len(name)}/{name}" for name, _ in made], pa.string()), pa.array([data for _, data in made], pa.binary())], ["path", "content"])

    tree.written(flat.mapInArrow(files, "path string, content binary"), root).agg(F.sum("size")).first()
    read = images.image_pixels(c.spark, root).filter("error is null")
    return read.select(F.regexp_extract("img", r"v(\d+)[.]\w+$", 1).cast("long").alias("img"), "x", "y", "r", "g", "b", "a")


# ---- sidecars, archives, sounds, reports ------------------------------------------------------------


@query(
    """WITH marks AS (SELECT pack_id AS id, tag FROM pack_tags WHERE tag LIKE 'theme:%'), listed AS (SELECT id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM marks GROUP BY id)
    SELECT packs.id AS pack, name, author, 'l' || license_id AS license, CASE WHEN attribution_text <> '' THEN attribution_text END AS notes, coalesce(tags, '') AS tags, packs.id * 3 AS updated_at FROM packs LEFT JOIN listed USING (id)""",
    "packs", "pack_tags",
)
def sidecars_read(c: Catalogue) -> DataFrame:
    """Packs' metadata and the tags set by hand, written as a sidecar file in each pack's folder and read again."""
    key = F.col("id")
    notes = F.when(F.col("attribution_text") != "", F.col("attribution_text"))
    packs = c.packs().select(key.cast("string").alias("pack"), "name", F.lit(None).cast("string").alias("source_url"), "author", F.concat(F.lit("l"), "license_id").alias("license"), notes.alias("notes"), (key * 3).alias("updated_at"))
    marks = c.pack_tags().select(F.col("pack_id").cast("string").alias("pack"), "tag", F.when(F.col("tag").startswith("theme:"), "manual").otherwise("auto_path").alias("source"))
    root = place(c.spark, "packs")
    tree.written(library.sidecar_text(packs, marks).select(F.concat("pack", F.lit("/pack.asset.json")).alias("path"), F.col("json").alias("content")), root).agg(F.sum("size")).first()
    found = library.sidecars(c.spark, root)
    return found.select(F.substring_index("pack", "/", -1).cast("long").alias("pack"), "name", "author", "license", "notes", F.array_join("tags", ",").alias("tags"), "updated_at")


def _archive(key: int, text: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(f"a/{key}.txt", text)
        z.writestr("é.bin", bytes(key % 50))
    return out.getvalue() if key % 9 else out.getvalue()[:40]


@query(
    """SELECT doc_id AS archive, 'a/' || doc_id || '.txt' AS name, strlen(coalesce(text, ''))::BIGINT AS size, false AS damaged FROM documents WHERE doc_id % 9 <> 0
    UNION ALL SELECT doc_id, 'é.bin', doc_id % 50, false FROM documents WHERE doc_id % 9 <> 0 UNION ALL SELECT doc_id, NULL, NULL, true FROM documents WHERE doc_id % 9 = 0"""
)
def archives_listed(c: Catalogue) -> DataFrame:
    """Documents in archives of two files each; one in nine is cut short."""

    def files(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            made = [_archive(key, text or "") for key, text in zip(keys, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([f"{key // FOLDER}/{key}.zip" for key in keys], pa.string()), pa.array(made, pa.binary())], ["path", "content"])

    root = place(c.spark, "archives")
    tree.written(c.table("documents").select("doc_id", "text").mapInArrow(files, "path string, content binary"), root).agg(F.sum("size")).first()
    found = media.zip_entries(c.spark, root)
    return found.select(F.regexp_extract("archive", r"(\d+)[.]zip$", 1).cast("long").alias("archive"), "name", "size", F.col("error").isNotNull().alias("damaged"))


@query("SELECT vec_id AS clip, i::BIGINT AS i, (floor(embedding[2 * i + 1]::DOUBLE * 9999) + floor(embedding[2 * i + 2]::DOUBLE * 9999)) / 2 / 32768 AS v, 8000 AS rate FROM embeddings, range(32) AS t(i)")
def sounds_read(c: Catalogue) -> DataFrame:
    """Vectors as sounds of two channels; the mean of both at each moment."""

    def files(batches):
        for batch in batches:
            made = []
            for values_ in batch.column(1).to_pylist():
                out = io.BytesIO()
                with wave.open(out, "wb") as w:
                    w.setnchannels(2)
                    w.setsampwidth(2)
                    w.setframerate(8000)
                    w.writeframes(struct.pack(f"<{len(values_)}h", *values_))
                made.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([f"{key % 7}/{key}.wav" for key in batch.column(0).to_pylist()], pa.string()), pa.array(made, pa.binary())], ["path", "content"])

    root = place(c.spark, "sounds")
    level = F.transform("embedding", lambda x: F.floor(x.cast("double") * 9999).cast("int"))
    tree.written(c.table("embeddings").select("vec_id", level.alias("v")).mapInArrow(files, "path string, content binary"), root).agg(F.sum("size")).first()
    return media.wav_samples(c.spark, root).select(F.regexp_extract("clip", r"(\d+)[.]wav$", 1).cast("long").alias("clip"), "i", "v", "rate")


@query("SELECT kind, count(*) AS n, sum(size)::BIGINT AS bytes FROM assets WHERE missing_since IS NULL GROUP BY kind", "assets")
def report_read(c: Catalogue) -> DataFrame:
    """A report, written twice, is the later one when it is read."""
    folder = place(c.spark, "report")
    made = c.assets().filter("missing_since is null").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    library.write_report(made.limit(1), folder)
    library.write_report(made, folder)
    return library.read_report(c.spark, folder, "kind string, n long, bytes long")


@query("SELECT id FROM assets WHERE missing_since IS NULL AND pack_id = 3", "assets")
def assets_of_a_pack(c: Catalogue) -> DataFrame:
    return search.matching(c.assets(), search.compare("pack_id", "=", 3) & search.present()).select("id")


# ---- a search index, built, changed and asked ---------------------------------------------------

_NOW = "now AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'The and at last' WHEN doc_id % 7 = 0 THEN reverse(text) ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0)"


def _index(c: Catalogue) -> str:
    root = place(c.spark, "words")
    textindex.build(c.spark, root, c.table("documents").select("doc_id", "text"), "doc_id", ["text"])
    return root


@query(ORACLES["fts_prefix"])
def fts_index_prefix(c: Catalogue) -> DataFrame:
    where = textindex.opened(versions.snapshot(c.spark, _index(c))).condition("The and at", prefix=True)
    return search.matching(c.table("documents").select("doc_id"), where, "doc_id")


@query(ORACLES["fts_phrase"])
def fts_index_phrase(c: Catalogue) -> DataFrame:
    where = textindex.opened(versions.snapshot(c.spark, _index(c))).condition("En laleenéelle la")
    return search.matching(c.table("documents").select("doc_id"), where, "doc_id")


@query(f"WITH {_NOW} SELECT doc_id FROM now WHERE contains({PLAIN_TEXT.format('text')}, ' the and at') AND NOT contains({PLAIN_TEXT.format('text')}, ' last ')")
def fts_index_refreshed(c: Catalogue) -> DataFrame:
    """Some texts change, twice for a few, some documents go; then all is made one table."""
    root, key = _index(c), F.col("doc_id")
    docs = c.table("documents").select("doc_id", "text")
    now = docs.filter(key % 11 != 0).withColumn("text", F.when(key % 5 == 0, "The and at last").when(key % 7 == 0, F.reverse("text")).otherwise(F.col("text")))
    none = docs.filter("false")
    textindex.refresh(c.spark, root, docs.filter(key % 5 == 0).withColumn("text", F.lit("the and at first")), none, "doc_id", ["text"])
    textindex.refresh(c.spark, root, now.filter((key % 5 == 0) | (key % 7 == 0)), docs.filter(key % 11 == 0), "doc_id", ["text"])
    index = textindex.opened(textindex.compact(c.spark, root))
    return search.matching(now.select("doc_id"), index.condition("the and at", prefix=True) & ~index.condition("last"), "doc_id")


# ---- streams, run over the whole table to its end -----------------------------------------------


def _streamed(c: Catalogue, table: str, make) -> DataFrame:
    """What a stream over a table has put out when it has read all of it."""
    folder = place(c.spark, "stream")
    watch.configure(c.spark)
    source = c.spark.readStream.schema(c.table(table).schema).parquet(f"{c.folder}/{table}[.]parquet")  # a pattern, as a table may be one file
    query = make(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return c.spark.read.parquet(f"{folder}/out")


_TOUCHES = "touches AS (SELECT user_id::VARCHAR AS key, epoch(date_trunc('second', ts))::BIGINT AS sec, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts), event_id) AS k FROM events{})"


def _fold(start: str, step: str, out: str, rows: str = "") -> str:
    """SQL that goes through each key's rows in order of time, a step a row."""
    return f"""WITH RECURSIVE {_TOUCHES.format(rows)}, turns AS (SELECT *, {start} FROM touches WHERE k = 1 UNION ALL SELECT * FROM (SELECT t.*, {step} FROM turns s JOIN touches t ON t.key = s.key AND t.k = s.k + 1)) SELECT {out} FROM turns"""


@query(
    _fold(
        "sec AS start, 1 AS n", "CASE WHEN t.sec >= s.start + 86400 THEN t.sec ELSE s.start END AS start, CASE WHEN t.sec >= s.start + 86400 THEN 1 ELSE s.n + 1 END AS n", "key, sec AS \"at\", n > 2 AS blocked", " WHERE event_type <> 'click'",
    )
)
def stream_limits(c: Catalogue) -> DataFrame:
    """A day begins with a user's first failure, not with the clock; the third in it and later ones are blocked."""
    failures = lambda events: events.filter("event_type <> 'click'").select(F.col("user_id").cast("string").alias("key"), values.epoch("ts").alias("at"))
    return _streamed(c, "events", lambda events: watch.limits(failures(events), 2, 86_400))


_OPEN, _END = "t.sec >= s.start + 518400", "(CASE WHEN t.sec >= s.start + 518400 THEN t.sec + 86400 ELSE s.finish END)"


@query(
    _fold(
        "sec AS start, true AS valid, sec + 86400 AS finish",
        f"CASE WHEN {_OPEN} THEN t.sec ELSE s.start END AS start, t.sec < {_END} AS valid, CASE WHEN t.sec < {_END} AND {_END} - t.sec < 43200 THEN least(t.sec + 86400, CASE WHEN {_OPEN} THEN t.sec ELSE s.start END + 259200) ELSE {_END} END AS finish",
        "key, sec AS \"at\", valid, finish AS expires",
    )
)
def stream_sessions(c: Catalogue) -> DataFrame:
    """Sessions of a day's idle time that slide when less than half of it is left, three days at most; the key is free after six."""
    touches = lambda events: events.select(F.col("user_id").cast("string").alias("key"), values.epoch("ts").alias("at"))
    return _streamed(c, "events", lambda events: watch.slid_sessions(touches(events), 86_400, 259_200))


@query(
    f"SELECT job, at_ms, done FROM ({_fold('true AS told, sec AS last', 't.sec - s.last >= 21600 OR t.sec % 50 = 0 AS told, CASE WHEN t.sec - s.last >= 21600 OR t.sec % 50 = 0 THEN t.sec ELSE s.last END AS last', 'key AS job, sec * 1000 AS at_ms, (CASE WHEN sec % 50 = 0 THEN 10 ELSE 1 END)::BIGINT AS done, told')}) WHERE told"
)
def stream_throttled(c: Catalogue) -> DataFrame:
    """Users as jobs that tell of their progress: six hours apart at least, and the end always."""
    at = values.epoch("ts")
    progress = lambda events: events.select(F.col("user_id").cast("string").alias("job"), (at * 1000).alias("at_ms"), F.when(at % 50 == 0, 10).otherwise(1).cast("long").alias("done"), F.lit(10).cast("long").alias("total"))
    return _streamed(c, "events", lambda events: watch.throttled(progress(events), 6 * 3_600_000)).select("job", "at_ms", "done")


@query(
    """WITH polls AS (SELECT row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS poll, user_id::VARCHAR AS name, (event_id % 3)::BIGINT AS size FROM events),
    marked AS (SELECT *, size = lag(size) OVER w AS alike, size IS DISTINCT FROM lag(size) OVER w AS fresh FROM polls WINDOW w AS (PARTITION BY name ORDER BY poll)),
    runs AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY name ORDER BY poll) AS r FROM marked)
    SELECT name, size, count(*) AS times FROM (SELECT DISTINCT name, size, r FROM runs WHERE alike) GROUP BY name, size"""
)
def stream_settled(c: Catalogue) -> DataFrame:
    """Users as files, their events as polls that find one of three sizes: each stretch of equal sizes is told of once."""
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    polls = cut(c.table("events").select(turn.cast("long").alias("poll"), F.col("user_id").cast("string").alias("name"), (F.col("event_id") % 3).alias("size"), F.lit(1).cast("long").alias("mtime")))
    folder = place(c.spark, "polls")
    polls.write.parquet(f"{folder}/polls.parquet")
    return _streamed(Catalogue(c.spark, folder), "polls", watch.settled).groupBy("name", "size").agg(F.count(F.lit(1)).alias("times"))


def _by_kind(version: versions.Snapshot) -> DataFrame:
    tags = version.table("asset_tags").groupBy(F.col("asset_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    found = version.table("assets").join(tags, "id").groupBy("kind").agg(F.count(F.lit(1)).alias("assets"), F.sum("n").alias("tags"), F.sum("size").alias("bytes"))
    return found.select(F.lit(version.version).alias("version"), "kind", "assets", "tags", "bytes")
