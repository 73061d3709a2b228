"""From files to files: each kind is parsed into blocks once, and each target is rendered from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from . import archive, blocks, cells, detect
from .markdown import markdown_blocks

# MIME types of the targets written here.
MIME = {
    "txt": "text/plain;charset=utf-8", "html": "text/html;charset=utf-8", "md": "text/markdown;charset=utf-8", "json": "application/json",
    "csv": "text/csv;charset=utf-8", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}


def source_blocks(files: DataFrame) -> DataFrame:
    """files (file_id, kind, content) of kinds txt, md, html, docx, csv and xlsx to block rows, doc_id being the file_id."""
    text = F.decode("content", "UTF-8")

    def of(kind: str) -> DataFrame:
        return files.where(F.col("kind") == kind).select(F.col("file_id").alias("doc_id"), text.alias("text"))

    plain = blocks.text_blocks(of("txt"))
    marked = markdown_blocks(of("md"))
    pages = blocks.html_blocks(of("html").withColumnsRenamed({"doc_id": "page_id", "text": "html"}))
    words = archive.docx_paragraphs(files.where("kind = 'docx'")).where("error IS NULL")
    level = F.regexp_extract("style", r"^Heading(\d)$", 1)
    run = F.struct(F.col("text").alias("text"), (level != "").alias("bold"), F.lit(False).alias("italic"))
    row = F.col("style") == "row"
    docx = words.where(row | (F.col("text") != "")).select(
        F.col("file_id").alias("doc_id"), "ord", F.when(level != "", "h").when(row, "table").otherwise("p").alias("type"), F.when(level != "", level.cast("int")).alias("level"),
        F.lit(None).cast("boolean").alias("ordered"), F.lit(None).cast("int").alias("idx"), F.lit(None).cast("int").alias("depth"), F.when(~F.coalesce(row, F.lit(False)), F.array(run)).alias("runs"),
        F.when(row, F.array(F.split("text", "\t"))).alias("rows"), F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("text"),
    )
    return plain.unionByName(marked).unionByName(pages).unionByName(docx).unionByName(table_blocks(files))


def table_blocks(files: DataFrame) -> DataFrame:
    """Files of kinds csv and xlsx as one table block a sheet."""
    csv = cells.csv_cells(files.where("kind = 'csv'").select("file_id", F.decode("content", "UTF-8").alias("text"))).select("file_id", F.lit(0).alias("sheet_ord"), "row_ord", "cells")
    xlsx = archive.xlsx_cells(files.where("kind = 'xlsx'")).where("error IS NULL").select("file_id", "sheet_ord", "row_ord", "cells")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("row_ord", "cells"))), lambda x: x["cells"])
    sheets = csv.unionByName(xlsx).groupBy("file_id", "sheet_ord").agg(rows.alias("rows"))
    none = {"level": "int", "ordered": "boolean", "idx": "int", "depth": "int", "runs": f"array<{blocks.RUN}>", "src": "string", "text": "string"}
    made = sheets.select(F.col("file_id").alias("doc_id"), F.col("sheet_ord").alias("ord"), F.lit("table").alias("type"), "rows")
    return made.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})


def convert(files: DataFrame, target: str) -> DataFrame:
    """files (file_id, name, content) to file_id, out_name, mime, content, status, error, for txt, html, md and docx.

    The gate comes before any parsing; a file without text ends in an error of its own, and so does each file if nothing here
    writes the target.
    """
    if target not in ("txt", "html", "md", "docx"):
        nothing = F.lit(None).cast("binary")
        out_name = F.concat(T.stem(F.col("name"), "document"), F.lit(f".{target}"))
        return files.select("file_id", out_name.alias("out_name"), F.lit(MIME.get(target)).alias("mime"), nothing.alias("content"), F.lit("error").alias("status"), F.lit(f"no writer for {target}").alias("error"))
    typed = files.withColumns({"kind": detect.document_kind(F.col("content"), F.col("name")), "target": F.lit(target)})
    gated = detect.gate(typed)
    body = source_blocks(gated.where("status = 'ready'"))
    if target == "docx":
        made = archive.write_docx(body)
    else:
        render = {"txt": blocks.render_text, "html": blocks.render_html, "md": blocks.render_markdown}[target]
        made = render(body).withColumn("content", F.encode("content", "UTF-8"))
    made = made.select(F.col("doc_id").alias("made_id"), F.col("content").alias("made"))
    out = gated.join(made, F.col("file_id") == F.col("made_id"), "left")
    title = T.stem(F.col("name"), "document")
    content = blocks.html_page(title, F.decode("made", "UTF-8")).cast("binary") if target == "html" else F.col("made")
    error = F.coalesce("error", F.when(F.col("made").isNull(), "no text in the document"))
    return out.select(
        "file_id", F.concat(title, F.lit(f".{target}")).alias("out_name"), F.lit(MIME[target]).alias("mime"), F.when(error.isNull(), content).alias("content"),
        F.when(error.isNull(), "done").otherwise("error").alias("status"), error.alias("error"),
    )


def json_table(files: DataFrame) -> DataFrame:
    """JSON texts (file_id, text) to cells (file_id, row_ord, pos, key, value).

    An array is its elements; an object whose first value is an array is that array's elements, else one row; elements
    that aren't objects get the key "value".
    """
    head = F.regexp_extract("text", r"^\s*(.)", 1)
    first_key = F.get(F.json_object_keys("text"), F.lit(0))
    first = F.element_at(F.from_json("text", "map<string,string>"), first_key)
    elements = F.when(head == "[", F.col("text")).when(F.rlike(first, F.lit(r"^\s*\[")), first).otherwise(F.concat(F.lit("["), "text", F.lit("]")))
    each = files.select("file_id", F.posexplode(F.from_json(elements, "array<string>")).alias("row_ord", "e"))
    keyed = each.select("file_id", "row_ord", F.when(F.rlike("e", F.lit(r"^\s*\{")), F.col("e")).otherwise(cells.json_row({"value": F.col("e")})).alias("e"))
    held = F.from_json("e", "map<string,string>")
    return keyed.select("file_id", "row_ord", F.posexplode(F.json_object_keys("e")).alias("pos", "key"), held.alias("m")).select(
        "file_id", "row_ord", "pos", "key", F.coalesce(F.element_at("m", F.col("key")), F.lit("")).alias("value")
    )


def csv_files(rows: DataFrame, by: str, order: str, values: list[Column], sep: str = ";") -> DataFrame:
    """A CSV text per group (a sheet, or a part of one) with a byte order mark; rows without any value are left out."""
    full = rows.where(F.array_join(F.array(*(F.coalesce(v.cast("string"), F.lit("")) for v in values)), "") != "")
    return cells.gathered(full, [by], order, cells.csv_line(values, sep), "\n", "﻿")


def single_or_zip(outputs: DataFrame, batch: str) -> DataFrame:
    """outputs with route: the file itself where its batch has one output, else the batch's archive."""
    n = outputs.groupBy(batch).agg(F.count(F.lit(1)).alias("n_outputs"))
    return outputs.join(n, batch).withColumn("route", F.when(F.col("n_outputs") == 1, "file").otherwise("zip"))
