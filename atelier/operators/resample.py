"""Images brought to another size by a separable cubic filter, as joins with small tables of weights.

A pixel of the new image is a weighted sum of those about its place, first along rows, then along columns. The weights
depend on the old and new size alone, so there is a table of them for each size that occurs (some four rows for each old pixel of a line), and
the sums are grouped aggregates: an image is spread over tasks like any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reach of the filter, in pixels of the coarser image.
REACH = 2.0


def catmull_rom(t: Column) -> Column:
    """The filter's weight at a distance; 0 from ``REACH`` on."""
    near, far = (1.5 * t - 2.5) * t * t + 1.0, ((-0.5 * t + 2.5) * t - 4.0) * t + 2.0
    return F.when(t < 1, near).when(t < REACH, far).otherwise(0.0)


def weights(sizes: DataFrame, to: int) -> DataFrame:
    """``size, cell, at, w``: how much the old pixel ``at`` counts for the new pixel ``cell``, for each old ``size``; the weights of a cell add up to 1."""
    scale = F.col("size") / to
    rows = sizes.select("size", F.explode(F.sequence(F.lit(0), F.lit(to - 1))).alias("cell")).withColumn("_scale", scale).withColumn("_mid", (F.col("cell") + 0.5) * F.col("_scale") - 0.5)
    wide = F.greatest(F.lit(1.0), F.col("_scale"))
    first, last = F.greatest(F.floor(F.col("_mid") - REACH * wide), F.lit(0)), F.least(F.ceil(F.col("_mid") + REACH * wide), F.col("size")) - 1
    each = rows.withColumn("at", F.explode(F.sequence(first, last))).withColumn("w", catmull_rom(F.abs(F.col("_mid") - F.col("at")) / wide)).filter("w <> 0")
    total = each.groupBy("size", "cell").agg(F.sum("w").alias("_total"))
    return each.join(total, ["size", "cell"]).select("size", "cell", F.col("at").cast("int").alias("at"), (F.col("w") / F.col("_total")).alias("w"))


def resized(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """``img, x, y, r, g, b, a`` of images (``img, x, y, r, g, b, a``, 8 bits each) at a new size, colours multiplied by their alpha, 0 to 255."""
    size = pixels.groupBy("img").agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    deep = [(F.floor(F.col(c) * 257 * F.col("a") / 255) / 65535).alias(c) for c in "rgb"]
    source = pixels.join(size, "img").select("img", F.col("x").alias("_x"), F.col("y").alias("_y"), "_w", "_h", *deep, (F.col("a") * 257 / 65535).alias("a"))
    along = lambda name, to: weights(size.select(F.col(f"_{name}").alias("size")).distinct(), to)
    over = lambda rows, new, *keys: rows.groupBy("img", *keys, F.col("cell").alias(new)).agg(*(F.sum(F.col(c) * F.col("w")).alias(c) for c in "rgba"))
    rows = source.join(along("w", width), (F.col("_w") == F.col("size")) & (F.col("_x") == F.col("at")))
    rows = over(rows, "x", "_y", "_h")
    rows = rows.join(along("h", height), (F.col("_h") == F.col("size")) & (F.col("_y") == F.col("at")))
    rows = over(rows, "y", "x")
    byte = lambda c: F.floor(F.least(F.greatest(F.floor(65535 * (F.least(c, "a") if c != "a" else F.col(c)) + 0.5), F.lit(0)), F.lit(65535)) / 256).cast("int").alias(c)
    return rows.select("img", "x", "y", *(byte(c) for c in "rgba"))


def difference_hash(pixels: DataFrame) -> DataFrame:
    """``img, phash``: of the image at 9 x 8, a bit for each pixel that is brighter than its right neighbour, row by row, the first bit highest."""
    deep = lambda c: F.col(c) * 257
    grey = F.floor((299 * deep("r") + 587 * deep("g") + 114 * deep("b")) / 1000)
    small = resized(pixels, 9, 8).select("img", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), grey.alias("v"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda s: s["v"])
    rows = small.groupBy("img", "y").agg(line.alias("l"))
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("long"), lambda acc, i: acc * 2 + F.when(F.get("l", i) > F.get("l", i + 1), 1).otherwise(0))
    return rows.select("img", F.call_function("shiftleft", bits, (56 - 8 * F.col("y")).cast("int")).alias("v")).groupBy("img").agg(F.bit_or("v").alias("phash"))
