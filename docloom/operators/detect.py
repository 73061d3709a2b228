"""What a file is, by its first bytes and its name, and what it may be turned into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..functions.dimensions import capability

HEAD = 64
PROBE = 65_536


def _at(head: Column, start: int, latin: str) -> Column:
    return F.substring(head, start + 1, len(latin)) == F.lit(latin.encode("latin-1"))


def image_label(content: Column, name: Column) -> Column:
    """Image format by magic bytes; TGA and SVG also by name; else the extension in capitals."""
    head, ext = F.substring(content, 1, HEAD), T.extension(F.coalesce(name, F.lit("")))
    shown = F.decode(head, "ISO-8859-1")
    return (
        F.when(_at(head, 0, "\x89PNG"), "PNG").when(_at(head, 0, "\xff\xd8\xff"), "JPEG").when(_at(head, 0, "GIF8"), "GIF")
        .when(_at(head, 0, "RIFF") & _at(head, 8, "WEBP"), "WEBP").when(_at(head, 0, "II*\0") | _at(head, 0, "MM\0*"), "TIFF")
        .when(_at(head, 4, "ftyp") & (_at(head, 8, "avif") | _at(head, 8, "avis") | (ext == "avif")), "AVIF").when(_at(head, 4, "ftyp"), "HEIC")
        .when(_at(head, 0, "\0\0\1\0"), "ICO").when(_at(head, 0, "BM"), "BMP").when(F.rlike(shown, F.lit(r"^P[1-6][\x00-\x20]")), "PNM")
        .when(ext.isin("tga", "icb", "vda", "vst"), "TGA").when((ext == "svg") | F.rlike(shown, F.lit(r"(?i)<svg|<\?xml")), "SVG")
        .otherwise(F.upper(F.when(ext == "", "file").otherwise(ext)))
    )


def document_kind(content: Column, name: Column) -> Column:
    """Document kind: PDF and ZIP by magic bytes, old Office files by theirs, texts by extension; null if unknown."""
    ext = T.extension(F.coalesce(name, F.lit("")))
    probe = F.decode(F.substring(content, 1, PROBE), "ISO-8859-1")
    zipped = (
        F.when(ext.isin("xlsx", "xlsm"), "xlsx").when(ext == "ods", "ods").when(ext == "docx", "docx")
        .when(F.contains(probe, F.lit("word/")), "docx").when(F.contains(probe, F.lit("xl/")), "xlsx")
    )
    by_ext = (
        F.when(ext.isin("txt", "text", "log"), "txt").when(ext.isin("md", "markdown"), "md").when(ext.isin("html", "htm"), "html")
        .when(ext.isin("csv", "tsv"), "csv").when(ext.isin("json", "xlsx", "xls"), ext)
    )
    return (
        F.when(_at(content, 0, "%PDF"), "pdf").when(_at(content, 0, "PK"), zipped)
        .when(_at(content, 0, "\xd0\xcf\x11\xe0"), F.when(ext == "doc", "doc").otherwise("xls")).otherwise(by_ext)
    )


def gate(files: DataFrame) -> DataFrame:
    """files (with kind and target) with status and error, before any content is parsed."""
    able = F.broadcast(capability(files.sparkSession).select("kind", "target", F.lit(True).alias("able")))
    error = (
        F.when(F.col("kind").isNull(), "unknown kind").when(F.col("kind") == "doc", "old .doc is not supported")
        .when(F.col("able").isNull(), "no such conversion")
    )
    return files.join(able, ["kind", "target"], "left").withColumn("error", error).withColumn(
        "status", F.when(F.col("error").isNull(), "ready").otherwise("error")
    ).drop("able")
