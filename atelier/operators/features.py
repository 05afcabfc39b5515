"""Features of images, sounds and models from tables of pixels, samples and JSON headers.

Pixels are rows (img, x, y, r, g, b, a), samples rows (clip, i, v, rate): grouped aggregation does
the rest, and a large image is spread over tasks like any other table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values

#: Colours up to which art counts as pixel art at once, and above which it does not.
FEW, MANY, SOFT = 96, 256, 0.40
#: What seams, square frames and content count for.
SHEET_WEIGHTS = (0.6, 0.25, 0.15)


def image_stats(pixels: DataFrame) -> DataFrame:
    """``img, width, height, has_alpha, has_semitransparent, color_count, is_pixel_art``. Between the
    two colour counts the share of soft transitions between neighbours decides."""
    rgb = F.col("r") * 65536 + F.col("g") * 256 + F.col("b")
    basic = pixels.groupBy("img").agg(
        (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), (F.min("a") < 255).alias("has_alpha"),
        (F.count_if((F.col("a") > 0) & (F.col("a") < 255)) > 0).alias("has_semitransparent"), F.count_distinct(F.when(F.col("a") > 0, rgb)).alias("color_count"),
    )
    row = Window.partitionBy("img", "y").orderBy("x")
    step = F.greatest(*(F.abs(F.col(c) - F.lag(c).over(row)) for c in "rgb"))
    turns = pixels.withColumn("_d", step).filter("_d > 0").groupBy("img").agg(F.count(F.lit(1)).alias("_turns"), F.count_if(F.col("_d") <= 48).alias("_soft"))
    both = basic.join(turns, "img", "left").fillna(0, ["_turns", "_soft"])
    art = F.when(F.col("color_count") > MANY, False).when((F.col("color_count") <= FEW) | (F.col("_turns") < 32), True).otherwise(F.col("_soft") / F.col("_turns") < SOFT)
    return both.withColumn("is_pixel_art", art).drop("_turns", "_soft")


def palette(pixels: DataFrame, most: int = 16) -> DataFrame:
    """``img, rank, r, g, b, count, ratio`` of the most frequent visible colours; equal counts by colour."""
    counts = pixels.filter("a > 0").groupBy("img", "r", "g", "b").agg(F.count(F.lit(1)).alias("count"))
    whole = Window.partitionBy("img")
    ranked = counts.withColumn("ratio", F.col("count") / F.sum("count").over(whole)).withColumn("rank", F.row_number().over(whole.orderBy(F.desc("count"), "r", "g", "b")) - 1)
    return ranked.filter(F.col("rank") < most).select("img", "rank", "r", "g", "b", "count", "ratio")


def swatches(assets: DataFrame, json: str = "palette_json") -> DataFrame:
    """``asset_id, rank, r, g, b, ratio`` from palettes kept as JSON; bad JSON has none."""
    kind = "array<struct<hex:string,r:int,g:int,b:int,count:bigint,ratio:double>>"
    return assets.select(F.col("id").alias("asset_id"), F.posexplode(F.from_json(json, kind)).alias("rank", "s")).select("asset_id", "rank", "s.r", "s.g", "s.b", "s.ratio")


def difference_hash(pixels: DataFrame) -> DataFrame:
    """``img, phash``: images scaled to 9 x 8 means of grey, a bit for each pixel brighter than its right
    neighbour, first bit highest. Means over cells stand for a smoother scaling."""
    grey = (F.col("r") * 299 + F.col("g") * 587 + F.col("b") * 114) / 1000
    size = Window.partitionBy("img")
    cells = pixels.withColumn("_w", F.max("x").over(size) + 1).withColumn("_h", F.max("y").over(size) + 1)
    cells = cells.groupBy("img", F.floor(F.col("x") * 9 / F.col("_w")).alias("cx"), F.floor(F.col("y") * 8 / F.col("_h")).alias("cy")).agg(F.avg(grey).alias("v"))
    line = Window.partitionBy("img", "cy").orderBy("cx")
    bits = cells.withColumn("_next", F.lead("v").over(line)).filter("_next is not null and cx < 8")
    value = F.when(F.col("v") > F.col("_next"), F.expr("shiftleft(1L, cast(63 - (cy * 8 + cx) as int))")).otherwise(F.lit(0).cast("long"))
    return bits.groupBy("img").agg(F.bit_or(value).alias("phash"))


def sheet_grid(candidates: DataFrame) -> DataFrame:
    """``img, cols, rows, score``: the best grid of each image from candidates with seam, square and content
    shares; equal scores (to 0.01) go to more frames."""
    s, q, c = SHEET_WEIGHTS
    score = s * F.col("seam") + q * F.col("square") + c * F.col("content")
    fit = candidates.filter("content >= 0.5").withColumn("score", score)
    best = F.max_by(F.struct("cols", "rows", "score", ((F.col("seam") >= 0.9) & (F.col("content") >= 0.75)).alias("confident")), F.struct(F.round("score", 2), F.col("cols") * F.col("rows"), "cols"))
    return fit.groupBy("img").agg(best.alias("b")).select("img", "b.*")


def peaks(samples: DataFrame, buckets: int = 2000) -> DataFrame:
    """``clip, bucket, low, high`` of at most ``buckets`` equal stretches."""
    n = F.max("i").over(Window.partitionBy("clip")) + 1
    parts = F.least(F.lit(buckets), F.col("_n"))
    return samples.withColumn("_n", n).groupBy("clip", F.floor(F.col("i") * parts / F.col("_n")).alias("bucket")).agg(F.min("v").alias("low"), F.max("v").alias("high"))


def sound(samples: DataFrame) -> DataFrame:
    """``clip, duration_ms, peak_dbfs, is_loopable``: loops are a quarter second at least, loud at both edges
    (10 ms) and without a jump where they meet."""
    n = F.max("i").over(Window.partitionBy("clip")) + 1
    rows = samples.withColumn("_n", n).withColumn("_edge", F.greatest(F.floor(F.col("rate") / 100), F.lit(1)))
    rms = lambda where: F.sqrt(F.avg(F.when(where, F.col("v") * F.col("v"))))
    out = rows.groupBy("clip").agg(
        F.floor(F.max("_n") * 1000 / F.max("rate")).alias("duration_ms"), F.max(F.abs("v")).alias("_peak"), rms(F.col("i") < F.col("_edge")).alias("_in"), rms(F.col("i") >= F.col("_n") - F.col("_edge")).alias("_out"),
        F.abs(F.max(F.when(F.col("i") == 0, F.col("v"))) - F.max(F.when(F.col("i") == F.col("_n") - 1, F.col("v")))).alias("_jump"),
    )
    level = F.when(F.col("_peak") > 0, F.greatest(20 * F.log10("_peak"), F.lit(-120.0))).otherwise(-120.0)
    loops = (F.col("duration_ms") >= 250) & (F.least("_in", "_out") >= 0.02) & (F.col("_jump") < 0.1)
    return out.select("clip", "duration_ms", level.alias("peak_dbfs"), loops.alias("is_loopable"))


GLTF = (
    "accessors array<struct<count:bigint,type:string,min:array<double>,max:array<double>>>, materials array<struct<name:string>>, animations array<struct<name:string>>, "
    "meshes array<struct<primitives:array<struct<attributes:struct<POSITION:int>,indices:int,mode:int>>>>"
)


def models(texts: DataFrame, json: str = "text") -> DataFrame:
    """``id, vert_count, tri_count, material_count, animations, bbox_x, bbox_y, bbox_z`` from glTF headers."""
    doc = texts.select("id", F.from_json(json, GLTF).alias("d")).select("id", "d.*")
    parts = doc.select("id", "accessors", F.explode_outer(F.flatten(F.transform("meshes", lambda m: m["primitives"]))).alias("p"))
    place = F.get("accessors", F.col("p.attributes.POSITION"))
    drawn = F.coalesce(F.get("accessors", F.col("p.indices"))["count"], place["count"])
    span = [(F.max(place["max"][i]) - F.min(place["min"][i])).alias(f"bbox_{a}") for i, a in enumerate("xyz")]
    sums = parts.groupBy("id").agg(F.coalesce(F.sum(place["count"]), F.lit(0)).alias("vert_count"), F.coalesce(F.sum(F.when(F.coalesce(F.col("p.mode"), F.lit(4)) == 4, F.floor(drawn / 3))), F.lit(0)).alias("tri_count"), *span)
    extra = doc.select("id", F.coalesce(F.size("materials"), F.lit(0)).alias("_m"), F.filter(F.transform("animations", lambda a: a["name"]), lambda n: n.isNotNull()).alias("animations"))
    return sums.join(extra, "id").select("id", "vert_count", "tri_count", F.greatest("_m", F.lit(0)).alias("material_count"), F.coalesce("animations", F.array().cast("array<string>")).alias("animations"), "bbox_x", "bbox_y", "bbox_z")


def by_content(assets: DataFrame, features: DataFrame) -> DataFrame:
    """Features of each content (sha256) on every asset that has it."""
    return assets.join(features, "sha256", "left")


def stale(assets: DataFrame, version: int) -> DataFrame:
    """One asset of each content whose features are pending or of an older version."""
    due = F.coalesce("derive_version", F.lit(0)) < version
    rows = assets.filter(F.col("missing_since").isNull() & ((F.col("derive_state") == "pending") | due))
    return rows.groupBy("sha256").agg(F.min("id").alias("id"))


def frames(sheets: DataFrame) -> DataFrame:
    """``id, frame_w, frame_h`` of sheets cut by hand into cols x rows (1 to 256 each)."""
    return sheets.filter("cols between 1 and 256 and rows between 1 and 256").select("id", F.expr("width div cols").alias("frame_w"), F.expr("height div rows").alias("frame_h"))


def hex_codes(palette_rows: DataFrame) -> DataFrame:
    """``img, hexes``: the palette as text, in order of rank."""
    item = F.struct("rank", values.hex_colour(F.col("r"), F.col("g"), F.col("b")).alias("hex"))
    return palette_rows.groupBy("img").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["hex"]), " ").alias("hexes"))


#: Pixels of an image that the cut looks at, at most; colours up to which counts are exact.
CUT_SAMPLE, CUT_COLOURS = 65_536, 16


def median_cut(pixels: DataFrame, colours: int = CUT_COLOURS, most: int = CUT_SAMPLE) -> DataFrame:
    """``img, rank, r, g, b, ratio`` of images with many colours: visible pixels on a grid of at most ``most``
    points are split along the widest channel at its median until there are ``colours`` boxes, each
    shown by its mean. Ties within a channel are split in the order of the whole colour."""
    size = pixels.groupBy("img").agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    step = F.ceil(F.sqrt(F.greatest(F.lit(1.0), F.col("_w") * F.col("_h") / most)))
    grid = pixels.join(size, "img").filter((F.col("a") > 0) & (F.col("x") % step == 0) & (F.col("y") % step == 0))
    # a group holds one row a colour of a bounded sample
    counts = grid.groupBy("img", "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))

    def cut(frame):
        import numpy as np
        import pandas as pd

        points = np.repeat(frame[["r", "g", "b"]].to_numpy(np.int64), frame["n"], axis=0)
        boxes, whole = [points[np.lexsort(points.T[::-1])]], len(points)
        while len(boxes) < colours:
            spans = [np.ptp(box, axis=0) if len(box) > 1 else np.full(3, -1) for box in boxes]
            widest = max(range(len(boxes)), key=lambda k: (spans[k].max(), -k))
            if spans[widest].max() < 0:
                break
            box = boxes[widest]
            box = box[np.argsort(box[:, spans[widest].argmax()], kind="stable")]
            boxes[widest : widest + 1] = [box[: len(box) // 2], box[len(box) // 2 :]]
        rows = sorted((-len(box), *(box.sum(0) // len(box))) for box in boxes)
        made = pd.DataFrame([(k, *rgb, -n / whole) for k, (n, *rgb) in enumerate(rows)], columns=["rank", "r", "g", "b", "ratio"])
        made.insert(0, "img", frame["img"].iloc[0])
        return made

    kind = dict(pixels.dtypes)["img"]
    return counts.groupBy("img").applyInPandas(cut, f"img {kind}, rank int, r int, g int, b int, ratio double")


def palette_text(palette_rows: DataFrame, form: str, name: str = "palette") -> DataFrame:
    """``img, text``: palettes as a GIMP palette (``gpl``), a list of engine colours (``gd``) or a gradient resource (``tres``)."""
    rgb = [F.col(c).cast("int") for c in "rgb"]
    share = lambda c: F.format_string("%.3f", F.col(c) / 255.0)
    line = {
        "gpl": F.format_string("%3d %3d %3d\t%s\n", *rgb, values.hex_colour(*rgb)),
        "gd": F.concat(F.lit("\tColor("), F.concat_ws(", ", *map(share, "rgb")), F.lit("),\n")),
        "tres": F.concat(F.concat_ws(", ", *map(share, "rgb")), F.lit(", 1")),
    }[form]
    lines = palette_rows.groupBy("img").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("t")))).alias("l"))
    text = F.transform("l", lambda x: x["t"])
    clean = F.trim(F.regexp_replace(F.lit(name), r"[\r\n]", " "))
    if form == "gpl":
        out = F.concat(F.lit("GIMP Palette\nName: "), clean, F.lit("\nColumns: 0\n#\n"), F.array_join(text, ""))
    elif form == "gd":
        out = F.concat(F.lit("# "), clean, F.lit("\nconst PALETTE: Array[Color] = [\n"), F.array_join(text, ""), F.lit("]\n"))
    else:
        place = F.transform("l", lambda x, k: F.format_string("%.6f", F.when(F.size("l") > 1, k / F.greatest(F.size("l") - 1, F.lit(1))).otherwise(0.0)))
        out = F.concat(F.lit('[gd_resource type="Gradient" format=3]\n\n[resource]\noffsets = PackedFloat32Array('), F.array_join(place, ", "), F.lit(")\ncolors = PackedColorArray("), F.array_join(text, ", "), F.lit(")\n"))
    return lines.select("img", out.alias("text"))


def obj_models(texts: DataFrame, text: str = "text") -> DataFrame:
    """``id, vert_count, tri_count, material_count, bbox_x, bbox_y, bbox_z`` from Wavefront text: a face of n
    corners is n - 2 triangles."""
    lines = texts.select("id", F.explode_outer(F.split(text, r"\r?\n")).alias("l")).withColumn("p", F.split(F.trim("l"), r"\s+"))
    place = [F.when(F.col("p")[0] == "v", F.expr(f"try_cast(get(p, {i + 1}) as double)")) for i in range(3)]
    return lines.groupBy("id").agg(
        F.count_if(F.col("p")[0] == "v").alias("vert_count"), F.coalesce(F.sum(F.when(F.col("p")[0] == "f", F.greatest(F.size("p") - 3, F.lit(0)))), F.lit(0)).alias("tri_count"),
        F.count_distinct(F.when(F.col("p")[0] == "usemtl", F.get("p", F.lit(1)))).alias("material_count"), *((F.max(v) - F.min(v)).alias(f"bbox_{a}") for v, a in zip(place, "xyz")),
    )


def reset(assets: DataFrame, state: str = "failed") -> DataFrame:
    """Assets of a state go back to pending, their errors are forgotten."""
    due = F.col("derive_state") == state
    return assets.withColumn("derive_error", F.when(~due, F.col("derive_error"))).withColumn("derive_state", F.when(due, "pending").otherwise(F.col("derive_state")))


#: Sheets: the least side of a frame, and the most frames along an axis.
LEAST_FRAME, MOST_FRAMES = 8, 64


def sheet_candidates(pixels: DataFrame) -> DataFrame:
    """``img, cols, rows, seam, square, content`` of every even grid of an image: the share of seam pixels that
    are transparent, how square a frame is, and the share of frames with something visible. One image is one
    group, as its size is bounded where it is read; a table of running sums tells each frame's content."""

    def grids(frame):
        import numpy as np
        import pandas as pd

        height, width = int(frame["y"].max()) + 1, int(frame["x"].max()) + 1
        alpha = np.zeros((height, width), np.uint8)
        alpha[frame["y"], frame["x"]] = frame["a"]
        clear = alpha == 0
        down, across = clear.sum(0), clear.sum(1)
        seen = np.zeros((height + 1, width + 1), np.int64)
        seen[1:, 1:] = (alpha > 8).cumsum(0).cumsum(1)
        counts = [[n for n in range(1, MOST_FRAMES + 1) if side % n == 0 and side // n >= LEAST_FRAME] for side in (width, height)]
        out = []
        for cols in counts[0]:
            for rows in counts[1]:
                if cols * rows > 1:
                    w, h = width // cols, height // rows
                    seam = (down[w::w].sum() + across[h::h].sum()) / ((cols - 1) * height + (rows - 1) * width)
                    corner = seen[::h, ::w]
                    cells = corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]
                    out.append((frame["img"].iloc[0], cols, rows, float(seam), min(w, h) / max(w, h), float((cells > 0).mean())))
        return pd.DataFrame(out, columns=["img", "cols", "rows", "seam", "square", "content"])

    kind = dict(pixels.dtypes)["img"]
    return pixels.select("img", "x", "y", "a").groupBy("img").applyInPandas(grids, f"img {kind}, cols int, rows int, seam double, square double, content double")


def may_be_sheet(filename, width, height):
    """Column: the name speaks of a sheet or of frames, or the size divides into frames."""
    stem = F.lower(F.regexp_replace(filename, r"\.[^.]*$", ""))
    divides = lambda side: F.exists(F.sequence(F.lit(2), F.lit(MOST_FRAMES)), lambda n: (side % n == 0) & (side / n >= LEAST_FRAME))
    named = stem.rlike(r"sheet|atlas|anim|sprite|\d+x\d+|[_-]\d{1,3}(f|fps|frames)?$")
    return named | (divides(width) & divides(height))
