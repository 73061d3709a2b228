"""Documents as block rows, and block rows as text, HTML and Markdown.

A block row: doc_id, ord, type (h, p, li, table, img, code, pagebreak, hr), level, ordered, idx, depth,
runs array<struct<text,bold,italic>>, rows array<array<string>>, src, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from .html import html_blocks  # noqa: F401

RUN = "struct<text:string,bold:boolean,italic:boolean>"
BLOCK = (
    "type string, level int, ordered boolean, idx int, depth int, "
    f"runs array<{RUN}>, rows array<array<string>>, src string, text string"
)


def runs_text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: r["text"]), "")


def trim_runs(runs: Column) -> Column:
    """Without empty runs, the first trimmed at the left and the last at the right."""
    full = F.filter(runs, lambda r: F.coalesce(r["text"], F.lit("")) != "")

    def edge(r: Column, i: Column) -> Column:
        text = F.when(i == 0, F.regexp_replace(r["text"], f"^{T.WS}+", "")).otherwise(r["text"])
        text = F.when(i == F.size(full) - 1, F.regexp_replace(text, f"{T.WS}+$", "")).otherwise(text)
        return F.struct(text.alias("text"), r["bold"].alias("bold"), r["italic"].alias("italic"))

    return F.filter(F.transform(full, edge), lambda r: r["text"] != "")


# ---- parsing


def paragraphs_of(text: Column) -> Column:
    """Parts between blank lines, trimmed, form feeds removed, empty ones dropped."""
    unix = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    parts = F.transform(F.split(unix, rf"\n{T.WS}*\n"), lambda p: T.trimmed(F.replace(p, F.lit("\f"), F.lit(""))))
    return F.filter(parts, lambda p: p != "")


def paragraphs(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, ord, text of the paragraphs of each text."""
    return documents.select("doc_id", F.posexplode(paragraphs_of(F.col(text_col))).alias("ord", "text"))


def text_blocks(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """Paragraphs as block rows."""
    none = {"level": "int", "ordered": "boolean", "idx": "int", "depth": "int", "rows": "array<array<string>>", "src": "string"}
    run = F.struct(F.col("text").alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic"))
    p = paragraphs(documents, text_col).select("doc_id", "ord", F.lit("p").alias("type"), F.array(run).alias("runs"), F.lit(None).cast("string").alias("text"))
    p = p.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    return p.select("doc_id", "ord", *(x.split()[0] for x in BLOCK.replace(f"array<{RUN}>", "runs").split(", ")))


# ---- reflow of positioned lines


def reflow(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, ord, y, h, text) to paragraphs (doc_id, para, text).

    A paragraph begins after a blank line, after a gap above 1.7 line heights and where y jumps up. A hyphen at the end of
    a line is taken out if the next one goes on with a small letter.
    """
    w = Window.partitionBy("doc_id").orderBy("ord")
    t = lines.withColumn("t", T.collapsed(F.col("text")))
    gap = F.lag("y").over(w) - F.col("y")
    t = t.withColumn("starts", F.coalesce((F.lag("t").over(w) == "") | (gap > F.col("h") * 1.7) | (gap < 0), F.lit(True)))
    t = t.withColumn("before", F.lag("t").over(w)).withColumn("para", F.sum(F.col("starts").cast("int")).over(w)).where("t <> ''")
    glued = ~F.col("starts") & F.rlike("before", F.lit("(?i)[а-яёa-z]-$")) & F.rlike("t", F.lit("^[а-яёa-z]"))
    join = F.when(F.col("starts"), "").when(glued, "\u0000").otherwise(" ")
    merged = t.groupBy("doc_id", "para").agg(F.array_sort(F.collect_list(F.struct("ord", F.concat(join, "t").alias("t")))).alias("xs"))
    text = F.regexp_replace(F.array_join(F.transform("xs", lambda x: x["t"]), ""), "-\u0000", "")
    return merged.select("doc_id", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("para")).alias("para"), text.alias("text"))


# ---- rendering


def _joined(blocks: DataFrame, line: Column, sep: str, end: str = "") -> DataFrame:
    """The rendered blocks of each document in order; empty ones are left out."""
    one = blocks.select("doc_id", "ord", line.alias("s")).where("s <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("ord", "s")))
    return one.groupBy("doc_id").agg(F.concat(F.array_join(F.transform(ordered, lambda x: x["s"]), sep), F.lit(end)).alias("content"))


def _marker(bullet: str) -> Column:
    indent = F.repeat(F.lit("  "), F.coalesce(F.col("depth"), F.lit(0)))
    return F.concat(indent, F.when(F.col("ordered"), F.concat(F.col("idx").cast("string"), F.lit(". "))).otherwise(bullet))


def render_text(blocks: DataFrame) -> DataFrame:
    """doc_id, content: plain text with a blank line between blocks."""
    kind, table = F.col("type"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "\t")), "\n")
    line = (
        F.when(kind == "table", table).when(kind == "li", F.concat(_marker("• "), runs_text(F.col("runs")))).when(kind == "code", F.col("text"))
        .when(kind == "hr", "———").when(kind.isin("pagebreak", "img"), "").otherwise(runs_text(F.col("runs")))
    )
    return _joined(blocks, line, "\n\n", "\n")


def _html_runs(runs: Column) -> Column:
    def one(r: Column) -> Column:
        t = F.replace(T.escape_html(r["text"]), F.lit("\n"), F.lit("<br>"))
        t = F.when(r["bold"], F.concat(F.lit("<strong>"), t, F.lit("</strong>"))).otherwise(t)
        return F.when(r["italic"], F.concat(F.lit("<em>"), t, F.lit("</em>"))).otherwise(t)

    return F.array_join(F.transform(runs, one), "")


def render_html(blocks: DataFrame) -> DataFrame:
    """doc_id, content: HTML; items of one kind in a row make one list."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    kind = F.when(F.col("type") == "li", F.when(F.col("ordered"), "ol").otherwise("ul")).otherwise("")
    b = blocks.withColumn("list", kind)
    b = b.withColumn("was", F.coalesce(F.lag("list").over(w), F.lit(""))).withColumn("next", F.coalesce(F.lead("list").over(w), F.lit("")))
    runs = _html_runs(F.col("runs"))

    def cells(row: Column) -> Column:
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(row, lambda c: F.concat(F.lit("<td>"), T.escape_html(c), F.lit("</td>"))), ""), F.lit("</tr>"))

    def tag(name: Column, inner: Column) -> Column:
        return F.concat(F.lit("<"), name, F.lit(">"), inner, F.lit("</"), name, F.lit(">"))

    t = F.col("type")
    line = (
        F.when(t == "li", F.concat(
            F.when(F.col("was") != F.col("list"), F.concat(F.lit("<"), F.col("list"), F.lit(">\n"))).otherwise(""),
            tag(F.lit("li"), runs),
            F.when(F.col("next") != F.col("list"), F.concat(F.lit("\n</"), F.col("list"), F.lit(">"))).otherwise(""),
        ))
        .when(t == "h", tag(F.concat(F.lit("h"), F.col("level").cast("string")), runs))
        .when(t == "p", tag(F.lit("p"), runs))
        .when(t == "table", tag(F.lit("table"), F.array_join(F.transform("rows", cells), "")))
        .when(t == "code", tag(F.lit("pre"), T.escape_html(F.col("text"))))
        .when(t == "hr", "<hr>")
        .when((t == "img") & (F.coalesce("src", F.lit("")) != ""), F.concat(F.lit('<p><img src="'), T.escape_html(F.col("src")), F.lit('" alt=""></p>')))
        .otherwise("")
    )
    return _joined(b, line, "\n")


def html_page(title: Column, body: Column) -> Column:
    return F.concat(F.lit('<!doctype html>\n<html>\n<head>\n<meta charset="utf-8">\n<title>'), T.escape_html(title), F.lit("</title>\n</head>\n<body>\n"), body, F.lit("\n</body>\n</html>\n"))


def render_markdown(blocks: DataFrame) -> DataFrame:
    """doc_id, content: Markdown; a table's first row is its head."""

    def styled(r: Column) -> Column:
        t = F.replace(r["text"], F.lit("\n"), F.lit("  \n"))
        t = F.when(r["bold"] & (T.trimmed(t) != ""), F.concat(F.lit("**"), t, F.lit("**"))).otherwise(t)
        return F.when(r["italic"] & (T.trimmed(t) != ""), F.concat(F.lit("*"), t, F.lit("*"))).otherwise(t)

    def row(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))

    runs, t = F.array_join(F.transform("runs", styled), ""), F.col("type")
    head = F.get("rows", F.lit(0))
    rule = row(F.transform(head, lambda c: F.lit("---")))
    table = F.array_join(F.concat(F.array(row(head), rule), F.transform(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))), row)), "\n")
    line = (
        F.when(t == "h", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), runs_text(F.col("runs"))))
        .when(t == "li", F.concat(_marker("- "), runs))
        .when(t == "table", table)
        .when(t == "code", F.concat(F.lit("```\n"), F.col("text"), F.lit("\n```")))
        .when(t == "hr", "---").when(t == "p", runs).otherwise("")
    )
    return _joined(blocks, line, "\n\n", "\n")


# ---- placed text items


def lines_of_items(items: DataFrame) -> DataFrame:
    """Placed items (doc_id, ord, y, h, text, ends) to lines (doc_id, ord, y, h, text), a page being one document.

    A line goes on while items stay within half a line height of its first item's y; ``ends`` closes it. The anchor is the
    line's start, so the items of a page are folded in order.
    """
    ordered = F.array_sort(F.collect_list(F.struct("ord", F.col("y").cast("double").alias("y"), F.col("h").cast("double").alias("h"), "text", "ends")))
    line = "struct<y:double,h:double,text:string>"
    start = F.struct(F.array().cast(f"array<{line}>").alias("lines"), F.lit(False).alias("open"))

    def step(acc: Column, item: Column) -> Column:
        last = F.element_at(acc["lines"], -1)
        goes_on = acc["open"] & (F.abs(last["y"] - item["y"]) <= item["h"] * 0.5)
        longer = F.struct(last["y"].alias("y"), last["h"].alias("h"), F.concat(last["text"], item["text"]).alias("text"))
        fresh = F.struct(item["y"].alias("y"), item["h"].alias("h"), item["text"].alias("text"))
        done = F.slice(acc["lines"], F.lit(1), F.greatest(F.size(acc["lines"]) - 1, F.lit(0)))
        lines = F.when(goes_on, F.concat(done, F.array(longer))).otherwise(F.concat(acc["lines"], F.array(fresh)))
        return F.struct(lines.alias("lines"), (~item["ends"]).alias("open"))

    folded = items.groupBy("doc_id").agg(ordered.alias("xs")).select("doc_id", F.aggregate("xs", start, step)["lines"].alias("ls"))
    return folded.select("doc_id", F.posexplode("ls").alias("ord", "l")).select("doc_id", "ord", "l.*")


def pages_text(paragraphs_: DataFrame) -> DataFrame:
    """Paragraphs (doc_id, page, para, text) as one text a document; pages are parted by form feeds."""
    per_page = paragraphs_.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("para", "text"))).alias("xs"))
    texts = per_page.select("doc_id", "page", F.array_join(F.transform("xs", lambda x: x["text"]), "\n\n").alias("t"))
    whole = texts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "t"))).alias("xs"))
    return whole.select("doc_id", F.array_join(F.transform("xs", lambda x: x["t"]), "\n\n\f\n\n").alias("content"))
