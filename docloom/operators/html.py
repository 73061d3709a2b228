"""HTML pages to block rows, all in columns: a flat stream of tags and texts in which windows find what is open where.

The stream is cut by one regular expression. How deep headings, quotes, lists and tables are nested is a running sum of
openings and closings, held at zero where a closing has no opening. The outermost of them swallows what stands in it;
inside a list or a table, the last item, row or cell that opened at the present depth owns a text. Paragraphs, terms and
definitions end at the next tag of a block. Outside all of these, a text makes a paragraph only if it is all its
element holds; text beside other elements is lost, as are images in headings, items and cells.

One row a page_id. Null pages have no blocks; a page without any block gives the paragraphs of its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

#: What is never shown, and is gone before the stream is cut.
HIDDEN = ("script", "style", "noscript", "template", "title")
#: Tags without meaning for blocks.
PASSED = ("html", "head", "body", "meta", "link", "base", "thead", "tbody", "tfoot")
VOID = ("area", "br", "col", "embed", "hr", "img", "input", "param", "source", "track", "wbr")
HEADS = ("h1", "h2", "h3", "h4", "h5", "h6")
LISTS, CELLS, QUOTES, BRIEF = ("ul", "ol"), ("td", "th"), ("blockquote", "figcaption"), ("p", "dd", "dt")
DEEP = (*HEADS, *LISTS, *QUOTES, "table")
#: Tags that end a paragraph.
BLOCKS = (
    *DEEP, *BRIEF, *CELLS, "li", "tr", "pre", "hr", "address", "article", "aside", "details", "div", "dl", "fieldset", "figure", "footer", "form",
    "header", "main", "nav", "section",
)
#: Named characters.
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "middot": "·", "mdash": "—", "ndash": "–", "hellip": "…", "laquo": "«",
    "raquo": "»", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "times": "×", "bull": "•", "euro": "€", "trade": "™", "sect": "§", "deg": "°", "shy": "­",
}
_TOKEN = r"""(?is)<pre\b[^>]*+>.*?(?:</pre\s*>|\z)|</?[a-z](?:[^'">]++|"[^"]*+"|'[^']*+')*+>|[^<]++(?:<[^a-z/!][^<]*+)*+|<"""


def decoded(text: Column) -> Column:
    """Character references as characters; unknown names stay."""
    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"), F.lit(1)))

    def one(acc: Column, n: Column) -> Column:
        code = F.when(n.startswith("x") | n.startswith("X"), F.conv(F.substring(n, F.lit(2), F.lit(6)), 16, 10).cast("long")).otherwise(F.conv(n, 10, 10).cast("long"))
        bad = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(bad, 0xFFFD).otherwise(code)), 8, "0")), "UTF-32")
        return F.replace(acc, F.concat(F.lit("&#"), n, F.lit(";")), char)

    text = F.when(F.contains(text, F.lit("&#")), F.aggregate(numbers, text, one)).otherwise(text)
    named = F.array(*(F.struct(F.lit(f"&{name};").alias("name"), F.lit(char).alias("char")) for name, char in (*ENTITIES.items(), ("amp", "&"))))
    return F.when(F.contains(text, F.lit("&")), F.aggregate(named, text, lambda t, e: F.replace(t, e["name"], e["char"]))).otherwise(text)


def bare(html: Column) -> Column:
    """Without comments, scripts, styles, titles and templates."""
    html = F.regexp_replace(html, r"(?is)<!--.*?(?:-->|\z)|<![a-z][^>]*>", "")
    return F.regexp_replace(html, rf"(?is)<({'|'.join(HIDDEN)})\b[^>]*>.*?(?:</\1\s*>|\z)", "")


def tokens(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """doc_id, pos, tok, name (of a tag, in lower case; pre for a whole preformatted element), closes."""
    stream = F.regexp_extract_all(bare(F.coalesce(F.col(html_col), F.lit(""))), F.lit(_TOKEN), F.lit(0))
    stream = F.filter(stream, lambda t: ~F.rlike(t, F.lit(rf"(?i)^</?({'|'.join(PASSED)})\b")))
    out = pages.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(stream).alias("pos", "tok"))
    return out.withColumns({"name": F.lower(F.regexp_extract("tok", r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1)), "closes": F.startswith("tok", F.lit("</"))})


def _opened(t: DataFrame, w, **which: Column) -> DataFrame:
    """t with how many of each are open after a token: openings less closings, never below zero."""
    for name, is_it in which.items():
        t = t.withColumn(name, F.sum(F.when(is_it, F.when(F.col("closes"), -1).otherwise(1)).otherwise(0)).over(w))
    for name in which:
        t = t.withColumn(name, F.col(name) - F.least(F.min(name).over(w), F.lit(0)))
    return t


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Block rows of pages: doc_id, ord and the columns of blocks.BLOCK."""
    from .blocks import paragraphs_of, trim_runs

    by_page = Window.partitionBy("doc_id").orderBy("pos")
    w = by_page.rowsBetween(Window.unboundedPreceding, 0)
    name, closes, pos = F.col("name"), F.col("closes"), F.col("pos")
    opens = (name != "") & ~closes
    t = _opened(tokens(pages, id_col, html_col), w, deep=name.isin(*DEEP), lists=name.isin(*LISTS), tables=name == "table")
    begins = opens & name.isin(*DEEP) & (F.col("deep") == 1)
    last = lambda when, value, over: F.last(F.when(when, value), True).over(over)
    t = t.withColumns({
        "top": last(begins, pos, w), "kind": last(begins, name, w),  # the outermost that is open, or was
        "block": last(name.isin(*BLOCKS), pos, w), "brief": last(name.isin(*BLOCKS), name.isin(*BRIEF) & ~closes, w),
        "whole": F.lag(opens & ~name.isin(*VOID, "pre")).over(by_page) & F.lead(closes).over(by_page),  # all that its element holds
    })
    in_deep, in_brief = F.col("deep") > 0, (F.col("deep") == 0) & F.coalesce("brief", F.lit(False))
    in_list, in_table = in_deep & F.col("kind").isin(*LISTS), in_deep & (F.col("kind") == "table")
    strong, slanted = name.isin("b", "strong", *HEADS), name.isin("i", "em")
    t = _opened(t, w, bold=strong & (closes | in_deep | in_brief), italic=slanted & (closes | in_deep | in_brief))
    # ---- items, rows and cells, each at its own depth
    # what stands in a nested table is in the cells around it too
    is_text, shown = name == "", (name == "") | (name == "br") | ((name == "pre") & ~closes)
    level = F.when(F.col("kind").isin(*LISTS), F.col("lists")).otherwise(F.col("tables"))
    levels = F.when(in_table & shown & (F.col("tables") > 1), F.sequence(F.lit(1).cast("long"), F.col("tables"))).otherwise(F.array(level))
    v = Window.partitionBy("doc_id", "top", "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    starts = opens & F.when(F.col("kind").isin(*LISTS), name.isin(*LISTS)).otherwise(name == "table")
    item = F.when(name == "li", F.when(closes, -1).otherwise(pos)).when(starts, -1)
    cell = F.when(name.isin(*CELLS), F.when(closes, -1).otherwise(pos)).when((name == "tr") | starts, -1)
    t = t.withColumn("level", F.explode(levels)).withColumns({
        "item": F.last(item, True).over(v), "row": last(opens & (name.isin("tr", "table")), pos, v), "cell": F.last(cell, True).over(v),
        "list": last(starts, pos, v), "list_name": last(starts, name, v),
    })
    # ---- what each token gives to which block
    img = name == "img"
    whole = is_text & F.coalesce("whole", F.lit(False)) & ~in_deep & ~in_brief
    alone = ~in_deep & ~in_brief & ~closes & name.isin("img", "hr", "pre")
    quote = in_deep & F.col("kind").isin(*QUOTES)
    of_list = in_list & shown & (F.col("item") >= 0)
    of_table = in_table & ((shown & (F.col("cell") >= 0)) | (opens & name.isin("tr", *CELLS)))
    of_flow = (in_deep & F.col("kind").isin(*HEADS, *QUOTES) & shown) | (in_brief & shown)
    picture = img & (quote | in_brief)
    own = F.when(in_deep, F.col("top")).when(in_brief, F.col("block")).otherwise(pos)
    type_ = (
        F.when(picture, "img").when(alone, F.when(name == "pre", "code").otherwise(name)).when(of_list, "li").when(of_table, "table")
        .when(of_flow, F.when(in_deep & F.col("kind").isin(*HEADS), "h").otherwise("p")).when(whole, "p")
    )
    text = F.when(name == "pre", T.strip_tags(F.regexp_replace("tok", r"(?i)^<pre\b[^>]*>\n?", ""))).when(is_text, F.col("tok"))
    blank = r"[\t\n\x0B\f\r\x{00A0}\x{FEFF}]"  # a single space needs no replacing
    text = F.when(name == "br", "\n").otherwise(F.regexp_replace(decoded(text), f"{T.WS}{{2,}}|{blank}", " "))
    source = F.regexp_extract("tok", r"""(?i)\ssrc\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", 0)
    source = F.regexp_replace(F.regexp_replace(source, r"(?i)^\ssrc\s*=\s*", ""), "^[\"']|[\"']$", "")
    code = F.regexp_replace(decoded(T.strip_tags(F.regexp_replace("tok", r"(?i)^<pre\b[^>]*>\n?", ""))), r"\n\z", "")
    zero = F.lit(0)
    t = t.withColumns({"type": type_, "shown": F.when(shown, text)})
    solid = F.col("type").isin("img", "hr", "code", "table") | (F.col("type").isNotNull() & F.rlike("shown", F.lit(f"[^{T.WS[1:]}")))
    t = t.withColumn("n", F.sum(F.when(solid, 1).otherwise(0)).over(Window.partitionBy("doc_id")))
    rest = (F.col("n") == 0) & is_text  # of a page without blocks
    t = t.withColumn("type", F.when(F.col("n") > 0, F.col("type")).when(rest, "rest")).where("type IS NOT NULL")
    kind = F.col("type")
    text, own = F.when(kind == "rest", decoded(F.col("tok"))).otherwise(F.col("shown")), F.when(kind == "rest", zero).otherwise(own)
    run = F.struct("pos", text.alias("text"), (F.col("bold") > 0).alias("bold"), (F.col("italic") > 0).alias("italic"))
    t = t.select(
        "doc_id", own.alias("at"), (kind != "img").cast("int").alias("turn"), F.when(picture, pos).when(kind == "li", F.col("item")).otherwise(zero).alias("sub"),
        F.when(kind == "table", F.col("row")).otherwise(zero).alias("row"), F.when(kind == "table", F.col("cell")).otherwise(zero).alias("cell"),
        "type", F.when(kind == "h", F.substring("kind", 2, 1).cast("int")).alias("level"), F.when(kind == "li", F.col("list")).alias("list"),
        F.when(kind == "li", F.col("list_name") == "ol").alias("ordered"), F.when(kind == "li", F.col("lists") - 1).cast("int").alias("depth"),
        F.when(shown & kind.isin("h", "p", "li", "table", "rest"), run).alias("run"), F.when(img, decoded(source)).alias("src"), F.when(kind == "code", code).alias("text"),
    )
    key, same = ["doc_id", "at", "turn", "sub"], ["type", "level", "list", "ordered", "depth"]
    first = [F.first(c).alias(c) for c in same]
    t = t.groupBy(*key, "row", "cell").agg(*first, F.sort_array(F.collect_list("run")).alias("runs"), F.first("src", True).alias("src"), F.first("text", True).alias("text"))
    plain = F.transform("runs", lambda r: F.struct(r["text"].alias("text"), r["bold"].alias("bold"), r["italic"].alias("italic")))
    t = t.withColumn("runs", F.when(F.col("type") == "rest", plain).otherwise(trim_runs(plain)))
    shown_cell = F.struct("cell", F.replace(F.array_join(F.transform("runs", lambda r: r["text"]), ""), F.lit("\n"), F.lit(" ")).alias("text"))
    t = t.groupBy(*key, "row").agg(*first, F.first("runs").alias("runs"), F.first("src").alias("src"), F.first("text").alias("text"), F.sort_array(F.collect_list(F.when((F.col("type") == "table") & (F.col("cell") >= 0), shown_cell))).alias("cells"))
    line = F.struct("row", F.transform("cells", lambda c: c["text"]).alias("cells"))
    t = t.groupBy(*key).agg(*first, F.first("runs").alias("runs"), F.first("src").alias("src"), F.first("text").alias("text"), F.sort_array(F.collect_list(line)).alias("lines"))
    t = t.where(~F.col("type").isin("h", "p", "li") | (F.size("runs") > 0))
    part = lambda x: F.array(F.struct(x.alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic")))
    parts = F.transform(paragraphs_of(F.array_join(F.transform("runs", lambda r: r["text"]), "")), part)
    t = t.select("*", F.posexplode(F.when(F.col("type") == "rest", parts).otherwise(F.array("runs"))).alias("nth", "shown"))
    t = t.withColumn("type", F.when(F.col("type") == "rest", "p").otherwise(F.col("type")))
    order = Window.partitionBy("doc_id").orderBy("at", "turn", "sub", "nth")
    numbered = Window.partitionBy("doc_id", "list").orderBy("at", "turn", "sub")
    return t.select(
        "doc_id", (F.row_number().over(order) - 1).alias("ord"), "type", "level", "ordered", F.when(F.col("type") == "li", F.row_number().over(numbered)).alias("idx"), "depth",
        F.when(F.col("type").isin("h", "p", "li"), F.col("shown")).alias("runs"), F.when(F.col("type") == "table", F.transform("lines", lambda x: x["cells"])).alias("rows"), "src", "text",
    )
