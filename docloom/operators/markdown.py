"""Markdown to block rows by windows over lines: headings, paragraphs, items, tables, fences, rules, bold and italic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

_ITEM = r"^( *)([-*+]|\d+\.) +(.*)$"
_INLINE = r"\*\*[^*]+\*\*|\*[^*]+\*|[^*]+|\*"


def inline_runs(text: Column) -> Column:
    """Runs of a line: **bold**, *italic*, and the rest."""

    def run(t: Column) -> Column:
        bold, italic = F.rlike(t, F.lit(r"(?s)^\*\*.+\*\*$")), F.rlike(t, F.lit(r"(?s)^\*[^*].*\*$"))
        bare = F.when(bold, F.regexp_replace(t, r"^\*\*|\*\*$", "")).when(italic, F.regexp_replace(t, r"^\*|\*$", "")).otherwise(t)
        return F.struct(bare.alias("text"), bold.alias("bold"), italic.alias("italic"))

    return F.transform(F.regexp_extract_all(text, F.lit(_INLINE), F.lit(0)), run)


def markdown_blocks(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """documents (doc_id, text) to block rows; lines of one document are ordered in one window, as a document is one text."""
    w = Window.partitionBy("doc_id").orderBy("line")
    unix = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\r\n?", "\n")
    lines = documents.select("doc_id", F.posexplode(F.split(unix, "\n")).alias("line", "t"))
    fence = F.startswith("t", F.lit("```"))
    lines = lines.withColumn("fences", F.sum(F.when(fence, 1).otherwise(0)).over(w)).withColumn("fence", fence)
    t = F.col("t")
    kind = (
        F.when(F.col("fence"), "fence").when(F.col("fences") % 2 == 1, "code").when(F.trim(t) == "", "blank").when(F.rlike(t, F.lit("^#{1,6} ")), "h")
        .when(F.rlike(t, F.lit(r"^(---+|\*\*\*+|___+)\s*$")), "hr").when(F.rlike(t, F.lit(_ITEM)), "li").when(F.rlike(t, F.lit(r"^\|.*\|\s*$")), "table").otherwise("p")
    )
    lines = lines.withColumn("kind", kind)
    before = F.lag("kind").over(w)
    starts = before.isNull() | (before != F.col("kind")) | F.col("kind").isin("h", "hr", "li")
    blocks = lines.withColumn("block", F.sum(F.when(starts, 1).otherwise(0)).over(w)).where("kind NOT IN ('fence', 'blank')")
    grouped = blocks.groupBy("doc_id", "block", "kind").agg(F.array_sort(F.collect_list(F.struct("line", "t"))).alias("ls"))
    texts = F.transform("ls", lambda x: x["t"])
    joined, first = F.array_join(texts, "\n"), F.element_at(texts, 1)
    k = F.col("kind")
    level = F.when(k == "h", F.length(F.regexp_extract(first, "^(#+)", 1)))
    marker = F.regexp_extract(first, _ITEM, 2)
    inner = F.when(k == "h", F.regexp_replace(first, "^#+ +", "")).when(k == "li", F.regexp_extract(first, _ITEM, 3)).when(k == "p", F.regexp_replace(joined, r" *\n", "\n"))

    def cells(line: Column) -> Column:
        parts = F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"(?<!\\)\|")
        return F.transform(parts, lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))

    rows = F.filter(F.transform(texts, cells), lambda r: ~F.forall(r, lambda c: F.rlike(c, F.lit("^:?-+:?$"))))
    depth = F.floor(F.length(F.regexp_extract(first, _ITEM, 1)) / 2).cast("int")
    ordered = F.rlike(marker, F.lit(r"^\d"))
    none = F.lit(None)
    return grouped.select(
        "doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("block")) - 1).alias("ord"), k.alias("type"), level.alias("level"),
        F.when(k == "li", ordered).alias("ordered"), F.when((k == "li") & ordered, F.regexp_extract(first, r"(\d+)\.", 1).cast("int")).alias("idx"),
        F.when(k == "li", depth).alias("depth"), F.when(inner.isNotNull(), inline_runs(inner)).alias("runs"), F.when(k == "table", rows).alias("rows"),
        none.cast("string").alias("src"), F.when(k == "code", joined).alias("text"),
    )
