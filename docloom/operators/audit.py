"""Page audits: duplicate fragments, titles, weights, links, orphans, private data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from .scale import rejoined

# Patterns that point to private data.
PRIVATE = {"email": r"[A-Za-z0-9_.\-]+@[A-Za-z0-9_\-]+\.[A-Za-z]{2,}", "digits10": r"\b[0-9]{10}\b", "phone": r"\+?[0-9][0-9\-]{8,}[0-9]"}


def duplicate_fragments(pages: DataFrame, tags: tuple[str, ...] = ("p", "li"), least: int = 40) -> DataFrame:
    """Fragments that several pages share: fragment, n_pages, first_url, last_url."""
    found = pages.select("page_id", "url", F.explode(F.array_distinct(F.transform(T.fragments(T.main_content(F.col("html")), tags), T.clean_fragment))).alias("fragment"))
    return (
        found.where(F.length("fragment") >= least)
        .groupBy("fragment")
        .agg(F.count(F.lit(1)).alias("n_pages"), F.min("url").alias("first_url"), F.max("url").alias("last_url"))
        .where("n_pages > 1")
    )


def title_quality(pages: DataFrame, least: int = 15, most: int = 70) -> DataFrame:
    """Title, its length, whether the length is right and how many pages have the same.

    Titles are counted with partial sums and joined back spread out, so that a title on a third of all pages is no single task.
    """
    titled = pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    same = titled.groupBy("title").agg(F.count(F.lit(1)).alias("n_same"))
    return rejoined(titled, same, "title", "page_id").select(
        "page_id", "title", F.length("title").alias("title_length"), F.length("title").between(least, most).alias("length_ok"), "n_same"
    )


def page_facts(pages: DataFrame) -> DataFrame:
    """Words, headings, bytes and images without alt per page."""
    html = F.col("html")
    return pages.select(
        "page_id",
        T.word_count(T.visible_text(html)).alias("n_words"),
        F.regexp_count(html, F.lit(r"<h1[\s>]")).alias("n_h1"),
        F.regexp_count(html, F.lit(r"<h2[\s>]")).alias("n_h2"),
        F.octet_length(html).alias("n_bytes"),
        (F.octet_length(html) < 102_400).alias("light"),
        F.regexp_count(html, F.lit(r"<p\b")).alias("n_p"),
    )


def page_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/]+(/[^?#]*)", 1)


def links(pages: DataFrame) -> DataFrame:
    """Every href of an anchor: page_id, path, href, kind (external, relative or internal), target, anchor."""
    href = F.col("href")
    split = F.split(href, "#", 2)
    every = pages.select(
        "page_id", page_path(F.col("url")).alias("path"), F.explode(F.regexp_extract_all("html", F.lit(r'<a\b[^>]*\shref="([^"]+)"'), F.lit(1))).alias("href")
    )
    target = F.when(F.element_at(split, 1) == "", F.col("path")).otherwise(F.element_at(split, 1))
    kind = F.when(F.rlike(href, F.lit("^(https?:|mailto:|tel:)")), "external").when(~F.startswith(target, F.lit("/")), "relative").otherwise("internal")
    return every.select("page_id", "path", "href", kind.alias("kind"), target.alias("target"), F.get(split, F.lit(1)).alias("anchor"))


def broken_links(pages: DataFrame) -> DataFrame:
    """Internal targets that no page has, with the number of links and of pages that link there."""
    paths = pages.select(page_path(F.col("url")).alias("target")).distinct()
    wanted = links(pages).where("kind = 'internal'").groupBy("target", "page_id").agg(F.count(F.lit(1)).alias("n"))
    wanted = wanted.groupBy("target").agg(F.sum("n").alias("n_links"), F.count(F.lit(1)).alias("n_pages"))
    return wanted.join(paths, "target", "left_anti")


def orphan_pages(pages: DataFrame) -> DataFrame:
    """Pages that no other page links to."""
    linked = links(pages).where("kind = 'internal' AND target <> path").select(F.col("target").alias("path")).distinct()
    return pages.select("page_id", page_path(F.col("url")).alias("path")).join(linked, "path", "left_anti").select("page_id", "path")


def private_hits(rows: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """id, pattern, n_hits, first_hit for each pattern that occurs."""
    found = F.array(*(
        F.struct(F.lit(name).alias("pattern"), F.regexp_extract_all(F.col(text_col), F.lit(p), F.lit(0)).alias("hits")) for name, p in PRIVATE.items()
    ))
    each = rows.select(id_col, F.explode(found).alias("x")).where(F.size("x.hits") > 0)
    return each.select(id_col, "x.pattern", F.size("x.hits").alias("n_hits"), F.element_at("x.hits", 1).alias("first_hit"))


def redirects(pages: DataFrame) -> DataFrame:
    """(source, destination): each path with an end slash is reached without it too."""
    path = page_path(F.col("url"))
    return pages.where(path.endswith("/") & (path != "/")).select(T.without_end_slash(path).alias("source"), path.alias("destination")).distinct()


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, with the side's name in ``side``."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def sitemap(pages: DataFrame) -> DataFrame:
    """One sitemap entry per URL that may be indexed."""
    line = F.concat(F.lit("<url><loc>"), T.escape_html(F.regexp_replace("url", "#.*$", "")), F.lit("</loc></url>"))
    return pages.where(~F.contains("html", F.lit("noindex"))).select(line.alias("entry")).distinct()


def breadcrumbs(pages: DataFrame) -> DataFrame:
    """The folders on the way to a page: page_id, position from 1, name, item (path so far)."""
    parts = F.filter(F.split(page_path(F.col("url")), "/"), lambda p: p != "")
    each = pages.select("page_id", parts.alias("parts")).select("page_id", "parts", F.posexplode("parts").alias("i", "name"))
    return each.select(
        "page_id", (F.col("i") + 1).alias("position"), "name", F.concat(F.lit("/"), F.array_join(F.slice("parts", F.lit(1), F.col("i") + 1), "/")).alias("item")
    )


def breadcrumb_schema(pages: DataFrame) -> DataFrame:
    """Breadcrumbs as JSON-LD, one text per page."""
    item = F.struct(F.lit("ListItem").alias("@type"), "position", "name", "item")
    per_page = breadcrumbs(pages).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("position", item.alias("x")))).alias("xs"))
    listed = F.struct(F.lit("BreadcrumbList").alias("@type"), F.transform("xs", lambda x: x["x"]).alias("itemListElement"))
    return per_page.select("page_id", T.json_in_html(F.to_json(listed)).alias("schema"))


def broken_anchors(pages: DataFrame) -> DataFrame:
    """Internal links with an anchor that their target page has no id for: page_id, target, anchor."""
    ids = pages.select(page_path(F.col("url")).alias("target"), F.explode(F.regexp_extract_all("html", F.lit(r'\sid="([^"]+)"'), F.lit(1))).alias("anchor")).distinct()
    known = pages.select(page_path(F.col("url")).alias("target")).distinct()
    asked = links(pages).where("kind = 'internal' AND anchor <> ''").select("page_id", "target", "anchor").distinct()
    return asked.join(known, "target", "left_semi").join(ids, ["target", "anchor"], "left_anti").select("page_id", "target", "anchor")


def meta_content(html: Column, name: str) -> Column:
    """The content of the meta tag of a name or property; null without one."""
    pattern = f'<meta (?:name|property)="{name}" content="([^"]*)"'
    return F.when(F.rlike(html, F.lit(pattern)), F.regexp_extract(html, pattern, 1))


def head_tags(pages: DataFrame, properties: tuple[str, ...] = ("description", "og:title", "og:image", "robots")) -> DataFrame:
    """page_id, lang, and the number and names of the meta tags that a page has, without a tag for what is missing."""
    html = F.col("html")
    held = F.array_compact(F.array(*(F.when(meta_content(html, p).isNotNull(), F.lit(p)) for p in properties)))
    return pages.select("page_id", F.regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1).alias("lang"), F.size(held).alias("n_meta"), F.array_join(held, ",").alias("held"))


def unsafe_external_links(pages: DataFrame) -> DataFrame:
    """External links without target="_blank" or rel="noopener": page_id and their number."""
    tags = F.regexp_extract_all("html", F.lit(r'<a\b[^>]*href="https?:[^"]*"[^>]*>'), F.lit(0))
    unsafe = F.filter(tags, lambda t: ~F.contains(t, F.lit('target="_blank"')) | ~F.contains(t, F.lit('rel="noopener"')))
    return pages.select("page_id", F.size(unsafe).alias("n_unsafe")).where("n_unsafe > 0")


def robots(site: str) -> str:
    return f"User-agent: *\nAllow: /\n\nSitemap: {site.rstrip('/')}/sitemap.xml\n"


def faq_schema(faq: DataFrame) -> DataFrame:
    """Questions (page_id, ord, q, a) as JSON-LD, one text per page."""
    answer = F.struct(F.lit("Answer").alias("@type"), F.col("a").alias("text"))
    entry = F.struct(F.lit("Question").alias("@type"), F.col("q").alias("name"), answer.alias("acceptedAnswer"))
    listed = F.array_sort(F.collect_list(F.struct("ord", entry.alias("x"))))
    page = faq.groupBy("page_id").agg(listed.alias("xs"))
    return page.select("page_id", T.json_in_html(F.to_json(F.struct(F.lit("FAQPage").alias("@type"), F.transform("xs", lambda x: x["x"]).alias("mainEntity")))).alias("schema"))
