"""Tables as cell rows, and as CSV, JSON, HTML and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from .scale import STRETCH, before


def delimiter(first_line: Column) -> Column:
    """; if there are more of it than commas, else a tab if there is any, else a comma."""
    semicolons, commas = F.size(F.split(first_line, ";")), F.size(F.split(first_line, ","))
    return F.when(semicolons > commas, ";").when(F.contains(first_line, F.lit("\t")), "\t").otherwise(",")


def read_csv(spark, path: str, sep: str) -> DataFrame:
    """Every value stays text; quotes are doubled within quoted values, which may hold line breaks."""
    return spark.read.csv(path, sep=sep, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)


def csv_records(lines: DataFrame, by: list[str], order: str, stretch: int = STRETCH) -> DataFrame:
    """Lines (by, a whole-number order, line) to records: by, the order of the first line, n_lines, record.

    A line feed within quotes belongs to a value. A line begins a record if an even number of quotes stands before it in its
    file; so quotes and then beginnings are counted up, by stretches, and lines of a record meet under its number. No task reads a
    whole file. Quotes are to stand in quoted values only, doubled if they are part of one; a record that is open at
    the end is closed there. ``stretch`` is the range of the order that one window takes; sparse orders need a wider one. Null lines count as empty, a carriage return at a record's end is dropped.
    """
    line = F.coalesce("line", F.lit(""))
    rows = lines.select(*by, order, line.alias("line"), (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))).alias("_quotes"))
    rows = before(rows, by, order, F.col("_quotes"), "_open", stretch)
    rows = rows.withColumn("_begins", (F.col("_open") % 2 == 0).cast("long")).drop("_quotes", "_open")
    rows = before(rows, by, order, F.col("_begins"), "_record", stretch).withColumn("_record", F.col("_record") + F.col("_begins"))
    inside = F.array_sort(F.collect_list(F.struct(order, "line")))
    whole = F.regexp_replace(F.array_join(F.transform(inside, lambda x: x["line"]), "\n"), r"\r\z", "")
    return rows.groupBy(*by, "_record").agg(F.min(order).alias(order), F.count(F.lit(1)).alias("n_lines"), whole.alias("record")).drop("_record")


def csv_values(record: Column, sep: Column | str) -> Column:
    """The values of a record. Separators within quotes part nothing; a mark that no text can hold stands for the others meanwhile."""
    sep = F.lit(sep) if isinstance(sep, str) else sep
    safe = F.replace(record, F.lit("\x01"), F.lit("\x01\x02"))
    pieces = F.transform(F.split(safe, '"'), lambda x, i: F.when(i % 2 == 0, F.replace(x, sep, F.lit("\x01\x03"))).otherwise(x))
    raw = F.split(F.array_join(pieces, '"'), "\x01\x03")

    def value(c: Column) -> Column:
        bare = F.when(F.startswith(c, F.lit('"')), F.replace(F.regexp_replace(c, r'^"|"\z', ""), F.lit('""'), F.lit('"'))).otherwise(c)
        return F.replace(bare, F.lit("\x01\x02"), F.lit("\x01"))

    return F.transform(raw, value)


def csv_cells(files: DataFrame) -> DataFrame:
    """Files (file_id, text) to cell rows (file_id, row_ord, cells) by their own delimiter; row_ord is that of a row's first line."""
    bare = F.regexp_replace(F.regexp_replace("text", "^\ufeff", ""), r"\r\n?", "\n")
    lines = files.select("file_id", delimiter(F.element_at(F.split(bare, "\n"), 1)).alias("sep"), F.posexplode(F.split(bare, "\n")).alias("row_ord", "line"))
    return csv_records(lines, ["file_id", "sep"], "row_ord").where("record <> ''").select("file_id", "row_ord", csv_values(F.col("record"), F.col("sep")).alias("cells"))


def read_csv_lines(spark, path: str) -> DataFrame:
    """path, at, line of text files, cut anywhere into splits: at rises from line to line of a file.

    A line is one byte long at least, so the start of its split and its number there order all lines of a file.
    """
    raw = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    first = F.min("id").over(Window.partitionBy("path", "start"))
    at = F.col("start") + F.col("id") - first
    return raw.select("path", at.alias("at"), F.when(at == 0, F.regexp_replace("line", "^\ufeff", "")).otherwise(F.col("line")).alias("line"))


def read_csv_records(spark, path: str, sep: str) -> DataFrame:
    """path, at, cells of CSV files of any size, whose values may hold line breaks: every split is read by a task of its own."""
    records = csv_records(read_csv_lines(spark, path), ["path"], "at").where("record <> ''")
    return records.select("path", "at", csv_values(F.col("record"), sep).alias("cells"))


def csv_line(values: list[Column], sep: str = ";") -> Column:
    """A line of CSV; values are quoted where they hold the separator, a quote or a line break."""

    def one(c: Column) -> Column:
        v = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(F.rlike(v, F.lit(f'[{sep}"\n\r]')), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    return F.array_join(F.array(*map(one, values)), sep)


def json_text(v: Column) -> Column:
    """A JSON string of a text."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        v = F.replace(v, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), v, F.lit('"'))


def json_row(columns: dict[str, Column]) -> Column:
    """An object with keys in the given order; null becomes an empty text, numbers stay numbers if cast to string before."""
    parts = [F.concat(json_text(F.lit(k)), F.lit(": "), json_text(F.coalesce(v.cast("string"), F.lit("")))) for k, v in columns.items()]
    return F.concat(F.lit("{"), F.array_join(F.array(*parts), ", "), F.lit("}"))


def json_fields(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """id, pos, key, value of every object, keys in the order of the text."""
    keyed = rows.select(id_col, json_col, F.posexplode(F.json_object_keys(json_col)).alias("pos", "key"))
    held = F.from_json(json_col, "map<string,string>")
    return keyed.select(id_col, "pos", "key", F.element_at(held, F.col("key")).alias("value"))


def padded(rows: Column, width: Column) -> Column:
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))))


def widest(rows: Column) -> Column:
    return F.array_max(F.transform(rows, F.size))


def html_row(values: list[Column]) -> Column:
    cells = [F.concat(F.lit("<td>"), T.escape_html(F.coalesce(v.cast("string"), F.lit(""))), F.lit("</td>")) for v in values]
    return F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))


def markdown_row(values: list[Column]) -> Column:
    cells = F.array(*(F.replace(F.coalesce(v.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for v in values))
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def part(order: Column, most: int = 1000) -> Column:
    """The part of a table that a row with this whole-number order goes to."""
    return F.floor(order / F.lit(most)).cast("long")


def gathered(rows: DataFrame, by: list[str], order: str, line: Column, sep: str = "\n", before: str = "", after: str = "") -> DataFrame:
    """The lines of each group in order as one text. A group is one file, so callers cut large tables into parts (see ``part``)."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("s"))))
    return rows.groupBy(*by).agg(F.concat(F.lit(before), F.array_join(F.transform(lines, lambda x: x["s"]), sep), F.lit(after)).alias("content"))
