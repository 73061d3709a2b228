"""Pixel rows (image_id, y, x, r, g, b, a): histograms, palettes, nearest colours, luma, flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scale import cut_lineage

OPAQUE = 128


def rgb555(r: Column, g: Column, b: Column) -> Column:
    five = [F.shiftright(c.cast("int"), 3) for c in (r, g, b)]
    return F.shiftleft(five[0], 10).bitwiseOR(F.shiftleft(five[1], 5)).bitwiseOR(five[2])


def histogram(pixels: DataFrame) -> DataFrame:
    """image_id, color (15 bits), n over pixels that aren't transparent."""
    return pixels.where(F.col("a") >= OPAQUE).groupBy("image_id", rgb555(F.col("r"), F.col("g"), F.col("b")).alias("color")).agg(F.count(F.lit(1)).alias("n"))


def _wide(c: Column) -> Column:
    """Five bits as eight."""
    return F.shiftleft(c, 3).bitwiseOR(F.shiftright(c, 2))


def channels(color: Column) -> list[Column]:
    return [_wide(F.shiftright(color, s).bitwiseAND(F.lit(31))) for s in (10, 5, 0)]


def box_statistics(boxed: DataFrame) -> DataFrame:
    """By image_id and box: population, number of colours, per channel (five bits) min and max, axis (0 to 2, the widest, red before
    green before blue), span, and score: span times the root of the population."""
    five = [F.shiftright("color", s).bitwiseAND(F.lit(31)) for s in (10, 5, 0)]
    ends = [f(c).alias(f"{k}_{name}") for c, k in zip(five, "rgb") for f, name in ((F.min, "min"), (F.max, "max"))]
    out = boxed.groupBy("image_id", "box").agg(F.sum("n").alias("pop"), F.count(F.lit(1)).alias("n_colors"), *ends)
    r, g, b = (F.col(f"{k}_max") - F.col(f"{k}_min") for k in "rgb")
    axis = F.when((r >= g) & (r >= b), 0).when(g >= b, 1).otherwise(2)
    return out.withColumn("axis", axis).withColumn("span", F.greatest(r, g, b)).withColumn("score", F.col("span") * F.sqrt("pop"))


def boxes(hist: DataFrame, limits: DataFrame, deepest: int = 10_000) -> DataFrame:
    """hist (image_id, color, n) with box, the number of its box from left to right: median cut, best box first.

    limits has image_id and limit, the number of boxes. The box of the highest score is cut, the leftmost of equals, at the first
    colour that brings half of its population together; colours are in order of the widest channel, equal ones as they
    stood. A part scores less than what it was cut from, so the cuts made are those of the limit - 1 highest scores of all
    boxes that cutting can make. So all images and boxes are cut at once, level by level, less those that are too low
    already; cuts that turn out too low in the end are taken back. A level is one aggregation and one window over the colours
    that are still cut, at most 32,768 an image. Boxes are named by their way from the whole: 0 left, 1 right.
    """
    live = cut_lineage(hist.select("image_id", "color", "n", F.lit("").alias("box"), F.col("color").cast("long").alias("pos")))
    known, final = None, None
    for level in range(deepest):
        stats = box_statistics(live).where("span > 0").select("image_id", "box", "pop", "n_colors", "axis", "score")
        known = stats if known is None else known.unionByName(stats)
        rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.col("score").desc(), "box"))
        known = cut_lineage(known.withColumn("rank", rank).join(limits, "image_id").where("rank < limit").drop("rank", "limit"))
        to_cut = known.where(F.length("box") == level)
        if to_cut.isEmpty():
            final = live if final is None else final.unionByName(live)
            break
        at = live.join(to_cut, ["image_id", "box"], "left")
        settled = at.where("axis IS NULL").select(live.columns)
        final = settled if final is None else final.unionByName(settled)
        value = F.expr("shiftright(color, 10 - 5 * axis) & 31")
        w = Window.partitionBy("image_id", "box")
        ordered = w.orderBy(value, "pos")
        at = at.where("axis IS NOT NULL").withColumns({
            "r": F.row_number().over(ordered),
            "low": F.coalesce(F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * 2 < F.col("pop"),
        })
        cut = F.least(F.sum(F.col("low").cast("int")).over(w), F.col("n_colors") - 1)
        at = at.withColumn("cut", cut)
        right = F.col("r") > F.col("cut")
        live = cut_lineage(at.select("image_id", "color", "n", F.concat("box", F.when(right, "1").otherwise("0")).alias("box"), F.col("r").cast("long").alias("pos")))
    # ---- boxes that stay whole: parts of a cut that are not cut themselves
    parts = known.select("image_id", F.explode(F.array(F.concat("box", F.lit("0")), F.concat("box", F.lit("1")))).alias("box"))
    whole = final.select("image_id").distinct().select("image_id", F.lit("").alias("box")).unionByName(parts)
    whole = whole.join(known.select("image_id", "box"), ["image_id", "box"], "left_anti")
    whole = whole.withColumn("number", F.row_number().over(Window.partitionBy("image_id").orderBy("box")) - 1)
    none = F.lit(None)
    way = whole.select("image_id", "box", "number", none.cast("int").alias("color"), none.cast("long").alias("n"))
    way = way.unionByName(final.select("image_id", "box", none.cast("int").alias("number"), "color", "n"))
    w = Window.partitionBy("image_id").orderBy("box", F.col("number").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    return way.withColumn("number", F.last("number", True).over(w)).where("color IS NOT NULL").select("image_id", "color", "n", F.col("number").alias("box"))


def palette(boxed: DataFrame) -> DataFrame:
    """image_id, box, r, g, b: weighted means of a box's colours, and n."""
    means = [F.floor(F.sum(c * F.col("n")) / F.sum("n") + 0.5).cast("int").alias(k) for k, c in zip("rgb", channels(F.col("color")))]
    return boxed.groupBy("image_id", "box").agg(*means, F.sum("n").alias("n"))


def median_cut(pixels: DataFrame, colors: int) -> DataFrame:
    """image_id, idx, r, g, b, n: a palette of at most so many colours an image.

    An image with transparent pixels keeps idx 0 for them and has one colour less, but two at least; one without any other
    pixels has black alone.
    """
    per_image = pixels.groupBy("image_id").agg(F.max((F.col("a") < OPAQUE).cast("int")).alias("clear"), F.max((F.col("a") >= OPAQUE).cast("int")).alias("any"))
    per_image = cut_lineage(per_image)
    limits = per_image.select("image_id", F.greatest(F.lit(colors) - F.col("clear"), F.lit(2)).alias("limit"))
    found = palette(boxes(histogram(pixels), limits)).join(per_image, "image_id")
    found = found.select("image_id", (F.col("box") + F.col("clear")).alias("idx"), "r", "g", "b", "n")
    black = [F.lit(0).alias(c) for c in "rgb"]
    return found.unionByName(per_image.where(F.col("any") == 0).select("image_id", F.col("clear").alias("idx"), *black, F.lit(0).cast("long").alias("n")))


def nearest(colors: DataFrame, entries: DataFrame) -> DataFrame:
    """(image_id, color) to the entry (idx, pr, pg, pb) of least weighted distance; the first of equals.

    entries is one palette of at most 256 rows, so it goes along as one array.
    """
    listed = entries.agg(F.array_sort(F.collect_list(F.struct("idx", "pr", "pg", "pb"))).alias("entries"))
    r, g, b = channels(F.col("color"))

    def scored(e: Column) -> Column:
        d = 2 * F.pow(r - e["pr"], 2) + 4 * F.pow(g - e["pg"], 2) + 3 * F.pow(b - e["pb"], 2)
        return F.struct(d.cast("long").alias("d"), e["idx"].alias("idx"))

    best = F.array_min(F.transform("entries", scored))
    return colors.join(F.broadcast(listed)).select("image_id", "color", best["idx"].alias("idx"), best["d"].alias("distance"))


def luma(r: Column, g: Column, b: Column) -> Column:
    """Whole-number luma: 299, 587 and 114 parts of a thousand, halves up."""
    return F.floor((r * 299 + g * 587 + b * 114 + 500) / F.lit(1000)).cast("int")


def flattened(c: Column, a: Column, ground: Column) -> Column:
    """A channel over a ground, halves up."""
    return F.floor((a * c + (255 - a) * ground) * 2 / F.lit(510) + 0.5).cast("int")
