"""Small fixed tables as DataFrames: image formats, what converts to what, and photo requirements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Image formats (id, label, extension, MIME, alpha, lossy, written here).
FORMATS = (
    ("png", "PNG", "png", "image/png", True, False, True),
    ("jpeg", "JPG", "jpg", "image/jpeg", False, True, False),
    ("webp", "WEBP", "webp", "image/webp", True, True, False),
    ("avif", "AVIF", "avif", "image/avif", True, True, False),
    ("gif", "GIF", "gif", "image/gif", True, False, False),
    ("bmp", "BMP", "bmp", "image/bmp", False, False, True),
    ("ico", "ICO", "ico", "image/x-icon", True, False, True),
    ("tiff", "TIFF", "tiff", "image/tiff", True, False, True),
    ("tga", "TGA", "tga", "image/x-tga", True, False, True),
    ("pdf", "PDF", "pdf", "application/pdf", False, True, False),
    ("svg", "SVG", "svg", "image/svg+xml", True, False, True),
    ("ppm", "PPM", "ppm", "image/x-portable-pixmap", False, False, True),
    ("pgm", "PGM", "pgm", "image/x-portable-graymap", False, False, True),
    ("datauri", "Data URI", "txt", "text/plain", True, False, True),
)

# Document kinds with their targets in order.
CAPABILITY = {
    "pdf": ("jpg", "png", "txt", "docx", "split"),
    "docx": ("pdf", "txt", "html", "md"),
    "txt": ("pdf", "docx", "html"),
    "md": ("html", "pdf", "docx"),
    "html": ("pdf", "docx", "txt", "md"),
    "xlsx": ("csv", "json", "pdf", "html"),
    "xls": ("xlsx", "csv", "json", "pdf"),
    "ods": ("xlsx", "csv", "json", "pdf"),
    "csv": ("xlsx", "json", "pdf", "html"),
    "json": ("xlsx", "csv"),
}

# Requirement rules (name, formats, least and most width and height, ratio, most bytes).
RULES = (
    ("passport", "jpeg", 600, 800, 1200, 1600, 3, 4, 500_000),
    ("square", "jpeg,png", 200, 200, 2000, 2000, 1, 1, 200_000),
    ("wide", "png,webp", 1280, 720, None, None, 16, 9, None),
)


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FORMATS), "id string, label string, ext string, mime string, alpha boolean, lossy boolean, supported boolean")


def capability(spark: SparkSession) -> DataFrame:
    rows = [(kind, target, i) for kind, targets in CAPABILITY.items() for i, target in enumerate(targets)]
    return spark.createDataFrame(rows, "kind string, target string, ord int")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(RULES), "rule string, formats string, min_w int, min_h int, max_w int, max_h int, ratio_w int, ratio_h int, max_bytes long"
    )
