"""Column expressions over slash-separated asset paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds and the extensions that have them.
KINDS = {
    "image": "png jpg jpeg gif bmp tga webp tif tiff ico ppm pgm psd aseprite ase kra xcf svg eps ai",
    "hdri": "hdr exr",
    "model": "glb gltf obj fbx blend dae stl ply 3ds escn",
    "audio": "wav ogg mp3 flac aiff aif m4a opus mod xm it s3m",
    "video": "mp4 webm mov avi mkv ogv",
    "font": "ttf otf woff woff2 fnt bmfont",
    "script": "gd cs lua py js gdshader shader glsl hlsl frag vert",
    "material": "tres material mtl",
    "tilemap": "tmx tsx tiled-project",
    "rig": "scml scon",
}
# Folder names that tell a format, files that are no assets, names to ignore, and which format shows a group.
FORMAT_FOLDERS = "png psd aseprite ase kra xcf svg eps ai vector tiled_files tmx fbx obj gltf glb blend source sources sourcefiles".split()
PLAIN_NAMES = "readme readme.txt readme.md license license.txt licence licence.txt license.md copyright credits.txt".split()
PLAIN_EXTENSIONS = "txt md url nfo pdf rtf doc docx zip rar 7z tar gz bz2 xz tgz mtl bin import meta".split()
IGNORED = [
    "__MACOSX", ".DS_Store", "Thumbs.db", "desktop.ini", "._*", ".git", ".Trash-*", ".Trash", "@eaDir", "#recycle", "#snapshot", ".@__thumb",
    "$RECYCLE.BIN", "System Volume Information", ".Spotlight-V100", ".fseventsd", ".TemporaryItems", ".DocumentRevisions-V100",
]
PRECEDENCE = "png webp glb gltf fbx obj svg aseprite ase psd kra xcf".split()


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """Empty at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ext(name: Column) -> Column:
    """Lower case, without the dot; empty without one."""
    return F.lower(F.regexp_extract(base_name(name), r"\.([^.]*)$", 1))


def kind(extension: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, extensions in KINDS.items():
        out = out.when(F.lower(extension).isin(extensions.split()), name)
    return out.otherwise("other")


def library_path(pack_path: Column, rel_path: Column) -> Column:
    """A pack at the root adds nothing to the path, whether it is written '' or '.'."""
    return F.when(pack_path.isin("", "."), rel_path).otherwise(F.concat_ws("/", pack_path, rel_path))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def in_raw(path: Column) -> Column:
    return F.array_contains(F.split(F.lower(path), "/"), "raw")


def is_asset(name: Column) -> Column:
    return ~(name.startswith(".") | F.lower(name).isin(PLAIN_NAMES) | ext(name).isin(PLAIN_EXTENSIONS))


def glob(pattern: str) -> str:
    """The regular expression of a glob with * and ?."""
    special = {"*": "[^/]*", "?": "[^/]"}
    return "".join(special.get(c, "\\" + c if not c.isalnum() else c) for c in pattern)


def is_ignored(path: Column, globs: list[str] = IGNORED) -> Column:
    """Any part of the path matches a glob, in either case."""
    return F.lower(path).rlike("(^|/)(" + "|".join(glob(g.lower()) for g in globs) + ")(/|$)")


def is_reserved(path: Column) -> Column:
    return path.startswith("_")


FOLDER = "(" + "|".join(FORMAT_FOLDERS) + ")"
#: A name, or a name with something after - or _, or with a remark in parentheses.
FORMAT_PATTERN = rf"^\s*{FOLDER}([_-].+)?\s*(\(.*)?$"


def is_format_folder(segment: Column) -> Column:
    return F.lower(segment).rlike(FORMAT_PATTERN)


def strip_format(path: Column) -> Column:
    """Without format folders; the file name stays whatever it is."""
    parts = F.split(path, "/")
    folders = F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda s: ~is_format_folder(s))
    return F.array_join(F.concat(folders, F.slice(parts, -1, 1)), "/")


def group_key(rel_path: Column) -> Column:
    """What all variants of one asset share: no format folders, no extension."""
    return F.regexp_replace(strip_format(rel_path), r"\.[^./]*$", "")


def precedence(extension: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PRECEDENCE)), extension), F.lit(0)), F.lit(len(PRECEDENCE) + 1))


def token(segment: Column) -> Column:
    """A tag from a folder name, empty if it makes none: ordering numbers go, the rest is lower-cased
    and joined by dashes."""
    bare = F.regexp_replace(F.trim(segment), r"^[0-9]+[ _.-]+(?=\S)", "")
    made = F.regexp_replace(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{Nd}]+", "-"), r"^-+|-+$", "")
    return F.when(is_format_folder(segment) | made.rlike(r"^[0-9]*$"), "").otherwise(made)


def path_tags(path: Column) -> Column:
    """Distinct tags of the folders, in order."""
    parts = F.split(path, "/")
    made = F.transform(F.slice(parts, 1, F.size(parts) - 1), token)
    return F.transform(F.array_distinct(F.filter(made, lambda t: t != "")), lambda t: F.concat(F.lit("folder:"), t))


def type_tags(kind_: Column, pixel_art: Column, alpha: Column, frames: Column) -> Column:
    return F.array_compact(F.array(
        F.concat(F.lit("type:"), kind_), F.when(F.coalesce(pixel_art, F.lit(False)), "style:pixel-art"),
        F.when(F.coalesce(alpha, F.lit(False)), "has:alpha"), F.when(F.coalesce(frames, F.lit(0)) > 1, "has:animation"),
    ))


def slug(name: Column) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(made == "", "pack").otherwise(made)


def ancestors(path: Column, most: int | None = None) -> Column:
    """The folders above a file from the root ('') down: all, or ``most`` levels below the root."""
    parts = F.split(path, "/")
    deepest = F.size(parts) - 1
    levels = F.sequence(F.lit(0), deepest if most is None else F.least(deepest, F.lit(most)))
    return F.transform(levels, lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def tag_valid(tag: Column) -> Column:
    """At least two parts between colons, none empty or with white space."""
    return F.lower(F.trim(tag)).rlike(r"^[^\s:]+(:[^\s:]+)+$")


def flatten_prefix(path: Column) -> Column:
    """Aggregate: the only top folder of all paths, or ''."""
    top = F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise("")
    return F.when(F.min(top) == F.max(top), F.max(top)).otherwise("")
