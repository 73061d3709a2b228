"""Catalogue lookups, batch checks, archive layout and names, as joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..functions.dimensions import rules
from .scale import before


def related_items(items: DataFrame, id_col: str, related_col: str) -> DataFrame:
    """Ordered keys to rows: id, pos, related (keys without a row are dropped)."""
    wanted = items.select(F.col(id_col), F.posexplode(related_col).alias("pos", "related"))
    return wanted.join(items.select(F.col(id_col).alias("related")), "related").select(id_col, "pos", "related")


def filled_related(items: DataFrame, related: DataFrame, id_col: str, group_col: str, most: int = 4) -> DataFrame:
    """The related rows first, then others of the group by key, without itself, ``most`` in all.

    Only the first ``most + 1`` keys of each group can fill, plus those taken already; so the fillers are cut to
    ``2 * most + 1`` a group before they meet the items.
    """
    first = Window.partitionBy(group_col).orderBy(id_col)
    fillers = items.select(group_col, F.col(id_col).alias("related"), F.row_number().over(first).alias("n")).where(F.col("n") <= 2 * most + 1)
    mine = items.select(id_col, group_col).join(fillers, group_col).where(F.col("related") != F.col(id_col))
    fill = mine.join(related.select(id_col, "related"), [id_col, "related"], "left_anti").select(id_col, F.lit(1).alias("tier"), F.col("related").alias("key"), "related")
    every = related.select(id_col, F.lit(0).alias("tier"), F.col("pos").cast("long").alias("key"), "related").unionByName(fill)
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy("tier", "key"))
    return every.withColumn("place", rank).where(F.col("place") <= most).select(id_col, "place", "related")


def requirement_check(images: DataFrame, spark) -> DataFrame:
    """images (image_id, format, width, height, n_bytes) by rule: reasons (comma-joined) and ok."""
    r = rules(spark)
    bad = F.array(
        F.when(~F.array_contains(F.split("formats", ","), F.col("format")), F.concat(F.lit("format "), F.col("format"))),
        F.when(F.col("width") < F.col("min_w"), F.concat(F.lit("width below "), F.col("min_w").cast("string"))),
        F.when(F.col("height") < F.col("min_h"), F.concat(F.lit("height below "), F.col("min_h").cast("string"))),
        F.when(F.col("width") > F.col("max_w"), F.concat(F.lit("width above "), F.col("max_w").cast("string"))),
        F.when(F.col("height") > F.col("max_h"), F.concat(F.lit("height above "), F.col("max_h").cast("string"))),
        F.when(
            F.abs(F.col("width") * F.col("ratio_h") - F.col("height") * F.col("ratio_w")) * 100 > F.col("height") * F.col("ratio_h"),
            F.concat(F.lit("ratio is not "), F.col("ratio_w").cast("string"), F.lit(":"), F.col("ratio_h").cast("string")),
        ),
        F.when(F.col("n_bytes") > F.col("max_bytes"), F.concat(F.lit("weight above "), T.limit_label(F.col("max_bytes")))),
    )
    checked = images.join(F.broadcast(r)).withColumn("reasons", F.array_join(F.array_compact(bad), ", "))
    return checked.select("image_id", "rule", "reasons", (F.col("reasons") == "").alias("ok"))


def unique_names(files: DataFrame, batch: str, order: str, name: str) -> DataFrame:
    """Adds unique_name: within a batch, case ignored, later files of one name get " (k)" before the extension.

    k runs from 2 over the numbers that no file of the batch bears already: the free numbers below each taken one are counted,
    and each file passes the taken ones that leave too few below them. Null and empty names count as "image".
    """
    given = F.when(F.coalesce(F.col(name), F.lit("")) == "", F.lit("image")).otherwise(F.col(name))
    base, ext = F.regexp_extract(given, r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(given, r"^.+?(\.[^.]*)$", 1)
    numbered = r"^(.+) \((\d{1,9})\)(\.[^.]*)?$"
    borne = files.select(F.col(batch), F.lower(given).alias("g")).where(F.rlike("g", F.lit(numbered)))
    key = F.concat(F.regexp_extract("g", numbered, 1), F.regexp_extract("g", numbered, 3))
    keys = [batch, "given_key"]
    number = F.regexp_extract("g", numbered, 2).cast("long")
    taken = borne.select(batch, key.alias("given_key"), number.alias("number")).where("number > 1").distinct()
    taken = before(taken, keys, "number", F.lit(1), "lower")
    # number - 2 - lower numbers are free below a taken one: files that need more of them go past it
    taken = taken.select(*keys, ((F.col("number") - 2 - F.col("lower")) * 2 + 1).alias("at"), F.lit(1).alias("one"))
    rows = before(files.withColumns({"given_key": F.lower(given), "base": base, "ext": ext}), keys, order, F.lit(1), "earlier")
    rows = rows.withColumns({"at": F.col("earlier") * 2, "one": F.lit(0)})
    rows = before(rows.unionByName(taken, allowMissingColumns=True), keys, "at", F.col("one"), "passed").where("one = 0")
    k = (F.col("earlier") + 1 + F.col("passed")).cast("string")
    unique = F.when(F.col("earlier") == 0, given).otherwise(F.concat("base", F.lit(" ("), k, F.lit(")"), "ext"))
    return rows.withColumn("unique_name", unique).select(*files.columns, "unique_name")


def byte_offsets(files: DataFrame, batch: str, order: str, size: Column) -> DataFrame:
    """files with at: the bytes before it in its batch, by a whole-number order."""
    return before(files, [batch], order, size, "at")


def zip_layout(files: DataFrame, batch: str, order: str, name: str, size: str) -> DataFrame:
    """Offsets of local headers (30 bytes and the name before each body) and of central entries (46 and the name)."""
    named = F.octet_length(F.encode(name, "UTF-8")).cast("long")
    out = byte_offsets(files, batch, order, F.lit(30) + named + F.col(size)).withColumnRenamed("at", "local_at")
    return byte_offsets(out, batch, order, F.lit(46) + named).withColumnRenamed("at", "central_at")


def totals(rows: DataFrame, by: list[str], size: str, done: Column) -> DataFrame:
    """Rows, their bytes, and the bytes of those done; whether all and whether any are."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(size).alias("total"), F.sum(F.when(done, F.col(size)).otherwise(0)).alias("total_done"),
        F.bool_and(done).alias("all_done"), F.bool_or(done).alias("any_done"),
    )


def kept_formats(files: DataFrame, formats: DataFrame, label_col: str = "label", fallback: str = "png") -> DataFrame:
    """files with out_format: the format they have if it can be written here, else the fallback."""
    able = F.broadcast(formats.where("supported").select(F.upper("label").alias("f_label"), F.col("id").alias("f_id")))
    same = F.upper(F.when(F.col(label_col) == "JPEG", "JPG").otherwise(F.col(label_col)))
    return files.join(able, same == F.col("f_label"), "left").withColumn("out_format", F.coalesce("f_id", F.lit(fallback))).drop("f_label", "f_id")


def first_supported(wishes: DataFrame, formats: DataFrame, id_col: str) -> DataFrame:
    """The first wish (id, pos, format) of each id that can be written here, else png."""
    able = F.broadcast(formats.where("supported").select(F.col("id").alias("format"), F.lit(True).alias("able")))
    best = wishes.join(able, "format", "left").groupBy(id_col).agg(F.min(F.when(F.col("able"), F.struct("pos", "format")))["format"].alias("format"))
    return best.select(id_col, F.coalesce("format", F.lit("png")).alias("format"))


def formats_table(formats: DataFrame) -> DataFrame:
    """Formats with their compression in words."""
    kind = F.when(F.col("lossy") & F.col("alpha"), "lossy or lossless").when(F.col("lossy"), "lossy").otherwise("lossless")
    return formats.select("id", "label", "alpha", kind.alias("compression"), "supported")


def moved(queue: DataFrame, pos_col: str, at: int, step: int) -> DataFrame:
    """queue with the rows at ``at`` and ``at + step`` changed over."""
    p = F.col(pos_col)
    return queue.withColumn(pos_col, F.when(p == at, at + step).when(p == at + step, at).otherwise(p))
