"""Resampling, framing and turning of pixel rows (image_id, width, height, y, x, r, g, b, a), all images at once.

Scaling is by area: along each axis a source pixel covers some targets, each by a whole number of parts, and a target's colour
is the mean over what covers it, weighed by those parts and by alpha. So a source pixel becomes one row a target, and one
aggregation with map-side sums makes the new image. All sums are whole numbers; halves are rounded up. Framing, flips and
turns only change coordinates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Pixels that are cut from an image at once.
PIECE = 4096
COLUMNS = ["image_id", "width", "height", "y", "x", "r", "g", "b", "a"]


def pixel_rows(images: DataFrame, id_col: str) -> DataFrame:
    """images (width, height, rgba) as pixel rows, four bytes read as one number. Images without pixels have no rows.

    An image is cut into pieces and each of them into pixels, so that no row of a pixel or piece ever carries the whole.
    """
    size = F.col("width").cast("long") * F.col("height")
    pieces = F.posexplode(F.regexp_extract_all(F.hex("rgba"), F.lit(f".{{1,{8 * PIECE}}}"), F.lit(0))).alias("piece", "digits")
    cut = images.where((F.col("width") > 0) & (F.col("height") > 0)).select(F.col(id_col).alias("image_id"), "width", "height", size.alias("size"), pieces)
    each = F.posexplode(F.regexp_extract_all("digits", F.lit(".{8}"), F.lit(0))).alias("pos", "four")
    at = cut.select("image_id", "width", "height", "size", "piece", each).withColumn("i", F.col("piece").cast("long") * PIECE + F.col("pos")).where("i < size")
    n = at.select("image_id", "width", "height", F.expr("CAST(i div width AS INT)").alias("y"), F.expr("CAST(i % width AS INT)").alias("x"), F.conv("four", 16, 10).cast("long").alias("four"))
    return n.select(*COLUMNS[:5], *(F.shiftright("four", s).bitwiseAND(F.lit(255)).cast("int").alias(c) for c, s in zip("rgba", (24, 16, 8, 0))))


def covered(at: Column, n_source: Column, n_target: Column) -> Column:
    """An array of the targets that a source position covers along one axis."""
    first = F.floor(at.cast("long") * n_target / n_source).cast("int")
    last = F.floor(((at.cast("long") + 1) * n_target - 1) / n_source).cast("int")
    return F.sequence(first, last)


def share(at: Column, target: Column, n_source: Column, n_target: Column) -> Column:
    """The parts of a target that a source position covers.

    The axis has n_source * n_target parts, n_target a source position and n_source a target.
    """
    at, target = at.cast("long"), target.cast("long")
    return F.least((at + 1) * n_target, (target + 1) * n_source) - F.greatest(at * n_target, target * n_source)


def scaled(pixels: DataFrame, to_width: Column, to_height: Column) -> DataFrame:
    """Pixel rows of the images at another size of at least one pixel a side; wholly transparent targets are black."""
    sized = pixels.withColumns({"to_w": F.greatest(to_width.cast("int"), F.lit(1)), "to_h": F.greatest(to_height.cast("int"), F.lit(1))})
    down = sized.withColumn("to_y", F.explode(covered(F.col("y"), F.col("height"), F.col("to_h"))))
    both = down.withColumn("to_x", F.explode(covered(F.col("x"), F.col("width"), F.col("to_w"))))
    weight = share(F.col("y"), F.col("to_y"), F.col("height"), F.col("to_h")) * share(F.col("x"), F.col("to_x"), F.col("width"), F.col("to_w")) * F.col("a")
    keys = [F.col("to_w").alias("width"), F.col("to_h").alias("height"), F.col("to_y").alias("y"), F.col("to_x").alias("x")]
    parts = (F.first("width").cast("long") * F.first("height")).alias("parts")
    sums = both.groupBy("image_id", *keys).agg(F.sum(weight).alias("sa"), *(F.sum(weight * F.col(c)).alias(f"s{c}") for c in "rgb"), parts)
    colours = [F.expr(f"CAST(coalesce((2 * s{c} + sa) div nullif(2 * sa, 0), 0) AS INT)") for c in "rgb"]
    return sums.select(*COLUMNS[:5], *(k.alias(c) for k, c in zip(colours, "rgb")), F.expr("CAST((2 * sa + parts) div (2 * parts) AS INT)").alias("a"))


def uniform(width: Column, height: Column, to_width: Column, to_height: Column, cover: bool = False) -> tuple[Column, Column]:
    """The size with the same proportions that just fits into a frame, or just covers it; halves up, one pixel a side at least."""
    by_width = (to_width * height <= to_height * width) if not cover else (to_width * height >= to_height * width)

    def side(n: Column, a: Column, b: Column) -> Column:
        return F.greatest(F.floor((2 * n.cast("long") * a + b) / (2 * b)), F.lit(1)).cast("int")

    return F.when(by_width, to_width).otherwise(side(width, to_height, height)).cast("int"), F.when(by_width, side(height, to_width, width)).otherwise(to_height).cast("int")


def framed(pixels: DataFrame, to_width: int, to_height: int, ground: tuple[int, int, int, int] = (0, 0, 0, 0)) -> DataFrame:
    """The images in the middle of a frame: what stands out is cut off, what is bare gets the ground.

    On an opaque ground pixels are laid over it. Where margins can't be even, the first one is smaller.
    """
    left, top = (F.floor((F.lit(n) - F.col(c)) / 2).cast("int") for n, c in ((to_width, "width"), (to_height, "height")))
    moved = pixels.withColumns({"x": F.col("x") + left, "y": F.col("y") + top}).where(F.col("x").between(0, to_width - 1) & F.col("y").between(0, to_height - 1))
    if ground[3] == 255:
        over = {c: F.expr(f"CAST((2 * (a * {c} + (255 - a) * {g}) + 255) div 510 AS INT)") for c, g in zip("rgb", ground)}
        moved = moved.withColumns(over).withColumn("a", F.lit(255))
    sizes = pixels.groupBy("image_id", "width", "height").agg(F.lit(0).alias("_"))
    spots = sizes.select("image_id", left.alias("left"), top.alias("top"), "width", "height", F.explode(F.sequence(F.lit(0), F.lit(to_width * to_height - 1))).alias("i"))
    spots = spots.withColumns({"y": F.floor(F.col("i") / to_width).cast("int"), "x": F.col("i") % to_width})
    bare = spots.where(~((F.col("x") >= F.col("left")) & (F.col("x") < F.col("left") + F.col("width")) & (F.col("y") >= F.col("top")) & (F.col("y") < F.col("top") + F.col("height"))))
    bare = bare.select("image_id", "y", "x", *(F.lit(g).alias(c) for c, g in zip("rgba", ground)))
    both = moved.select("image_id", *COLUMNS[3:]).unionByName(bare)
    return both.select("image_id", F.lit(to_width).alias("width"), F.lit(to_height).alias("height"), *COLUMNS[3:])


def turned(pixels: DataFrame, quarters: int = 0, flip_h: bool = False, flip_v: bool = False) -> DataFrame:
    """Flipped, then turned clockwise by quarters."""
    w, h = F.col("width"), F.col("height")
    x, y = w - 1 - F.col("x") if flip_h else F.col("x"), h - 1 - F.col("y") if flip_v else F.col("y")
    for _ in range(quarters % 4):
        x, y, w, h = h - 1 - y, x, h, w
    return pixels.select("image_id", w.alias("width"), h.alias("height"), y.alias("y"), x.alias("x"), *"rgba")


def fitted(pixels: DataFrame, to_width: int, to_height: int, mode: str = "contain", ground: tuple[int, int, int, int] = (0, 0, 0, 0)) -> DataFrame:
    """Scaled to a frame with the proportions kept: contain leaves margins of the ground, cover cuts what stands out."""
    w, h = uniform(F.col("width"), F.col("height"), F.lit(to_width), F.lit(to_height), mode == "cover")
    return framed(scaled(pixels, w, h), to_width, to_height, ground)


def ppm(pixels: DataFrame) -> DataFrame:
    """image_id, width, height, content: each image as a binary PPM, laid over white. A group is one image, which is one file."""
    over = [F.lpad(F.hex(F.expr(f"(2 * (a * {c} + (255 - a) * 255) + 255) div 510")), 2, "0") for c in "rgb"]
    body = F.array_sort(F.collect_list(F.struct("y", "x", F.concat(*over).alias("s"))))
    head = F.concat(F.lit("P6\n"), F.col("width").cast("string"), F.lit(" "), F.col("height").cast("string"), F.lit("\n255\n")).cast("binary")
    made = pixels.groupBy("image_id", "width", "height").agg(body.alias("body"))
    return made.select("image_id", "width", "height", F.concat(head, F.unhex(F.array_join(F.transform("body", lambda p: p["s"]), ""))).alias("content"))
