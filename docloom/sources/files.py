"""Files as rows: intake by glob, page folders, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators.detect import document_kind, image_label

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _named(rows: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return rows.withColumns({"name": name, "ext": T.extension(name)})


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file_id, path, name, ext, length, modified, content of the files that aren't empty.

    file_id is a hash of the path: the same at every read, and no row has to wait for another's number.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    rows = _named(raw.where("length > 0"))
    return rows.select(F.xxhash64("path").alias("file_id"), "path", "name", "ext", "length", F.col("modificationTime").alias("modified"), "content")


def typed(files: DataFrame) -> DataFrame:
    """files with kind (document kind or null) and label (image format)."""
    return files.withColumns({"kind": document_kind(F.col("content"), F.col("name")), "label": image_label(F.col("content"), F.col("name"))})


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """path and html of the index pages below a folder, without its assets."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="index.html")
    path: Column = F.regexp_replace(F.col("_metadata.file_path"), r"^[a-z]+:/*", "/")
    below = F.regexp_replace(F.substring_index(path, root.rstrip("/"), -1), "index\\.html$", "")
    pages = raw.select(below.alias("path"), F.col("value").alias("html"))
    return pages.where(~F.contains("path", F.lit("/assets/")))


def ordered(files: DataFrame, batch: Column) -> DataFrame:
    """files with queue_pos, counted from 0 within each batch by name."""
    from pyspark.sql import Window

    return files.withColumn("batch", batch).withColumn("queue_pos", F.row_number().over(Window.partitionBy("batch").orderBy("name", "path")) - 1)
