"""Text functions on columns: escaping, cleaning, names, sizes, page ranges."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space as browsers count it; stated in full, as regex engines differ on \s.
WS = r"[\t\n\x0B\f\r \x{00A0}\x{FEFF}]"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapsed(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def escape_html(c: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(mark), F.lit(entity))
    return c


def strip_tags(c: Column, by: str = "") -> Column:
    return F.regexp_replace(c, "<[^>]+>", by)


def clean_fragment(c: Column) -> Column:
    """Tags and named entities become blanks, then white space collapses."""
    return collapsed(F.regexp_replace(strip_tags(c, " "), "&[a-z]+;", " "))


def visible_text(html: Column) -> Column:
    """The text of a page without scripts and styles."""
    bare = F.regexp_replace(html, "(?s)<script.*?</script>", " ")
    return clean_fragment(F.regexp_replace(bare, "(?s)<style.*?</style>", " "))


def word_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def fragments(html: Column, tags: tuple[str, ...]) -> Column:
    """The inner HTML of the elements with these tags, up to the first end tag."""
    if len(tags) == 1:
        return F.regexp_extract_all(html, F.lit(rf"(?s)<{tags[0]}\b[^>]*>(.*?)</{tags[0]}>"), F.lit(1))
    return F.regexp_extract_all(html, F.lit(rf"(?s)<({'|'.join(tags)})\b[^>]*>(.*?)</\1>"), F.lit(2))


def main_content(html: Column) -> Column:
    """What stands in <main>, or all if there is none, without link lists and the app section."""
    inner = F.when(F.rlike(html, F.lit("(?s)<main\\b[^>]*>.*?</main>")), F.regexp_extract(html, "(?s)<main\\b[^>]*>(.*?)</main>", 1)).otherwise(html)
    bare = F.regexp_replace(inner, r'(?s)<ul class="(?:links|tools)">.*?</ul>', "")
    return F.regexp_replace(bare, r'(?s)<section class="app[^"]*".*?</section>', "")


def json_in_html(json: Column) -> Column:
    return F.replace(json, F.lit("<"), F.lit("\\u003c"))


def without_end_slash(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def latin1(c: Column) -> Column:
    return F.encode(c, "ISO-8859-1")


def fingerprint(content: Column, digits: int = 8) -> Column:
    return F.substring(F.sha1(content), 1, digits)


# ---- numbers


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def percent_change(new: Column, old: Column) -> Column:
    return half_up((new / old - 1) * 100)


def _tenths(n: Column, unit: int) -> Column:
    """n / unit to one decimal with a comma, halves up, in whole numbers."""
    t = F.floor((n * 20 + unit) / F.lit(2 * unit)).cast("long")
    return F.concat(F.floor(t / 10).cast("string"), F.lit(","), (t % 10).cast("string"))


def human_size(n: Column) -> Column:
    """Bytes, KB (one decimal below 10 KB) or MB, with a decimal comma."""
    kb = F.floor((n * 2 + 1024) / F.lit(2048)).cast("long").cast("string")
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" Б")))
        .when(n < 10240, F.concat(_tenths(n, 1024), F.lit(" КБ")))
        .when(n < 1048576, F.concat(kb, F.lit(" КБ")))
        .otherwise(F.concat(_tenths(n, 1048576), F.lit(" МБ")))
    )


def limit_label(n: Column) -> Column:
    """A limit in whole decimal MB, else in KB."""
    kb = n / 1000
    shown = F.when(n % 1000 == 0, F.floor(kb).cast("string")).otherwise(kb.cast("string"))
    return F.when((kb >= 1000) & (n % 1_000_000 == 0), F.concat(F.floor(kb / 1000).cast("string"), F.lit(" МБ"))).otherwise(
        F.concat(shown, F.lit(" КБ"))
    )


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The Russian form for a number."""
    m, h = n % 10, n % 100
    return F.when((m == 1) & (h != 11), one).when(m.between(2, 4) & ((h < 10) | (h >= 20)), few).otherwise(many)


def fitted_size(w: Column, h: Column, mode: Column, pw: Column, ph: Column, percent: Column) -> Column:
    """(width, height) after resizing: none, percent, width, height, fit, exact, cover or pad; 1 to 16,384 a side."""
    w, h, pw, ph, percent = (c.cast("double") for c in (w, h, pw, ph, percent))
    k = F.least(pw / w, ph / h)
    both = mode.isin("exact", "cover", "pad")
    to_w = F.when(mode == "percent", w * percent / 100).when(mode == "width", pw).when(mode == "height", w * ph / h).when(mode == "fit", w * k).when(both, pw).otherwise(w)
    to_h = F.when(mode == "percent", h * percent / 100).when(mode == "width", h * pw / w).when(mode == "height", ph).when(mode == "fit", h * k).when(both, ph).otherwise(h)

    def side(x: Column, source: Column) -> Column:
        usable = F.when(x.isNull() | F.isnan(x) | (x == 0), source).otherwise(x)
        return F.least(F.lit(16384), F.greatest(F.lit(1), half_up(usable))).cast("int")

    return F.struct(side(to_w, w).alias("width"), side(to_h, h).alias("height"))


# ---- names


def extension(name: Column) -> Column:
    return F.regexp_extract(F.lower(name), r"\.([a-z0-9]+)$", 1)


def stem(name: Column, empty: str = "image") -> Column:
    return F.regexp_replace(F.when(F.coalesce(name, F.lit("")) == "", F.lit(empty)).otherwise(name), r"\.[^./\\]+$", "")


def output_name(name: Column, ext: Column, suffix: Column | None = None) -> Column:
    return F.concat(stem(name), suffix if suffix is not None else F.lit(""), F.lit("."), ext)


def stripped_name(name: Column, ext: Column) -> Column:
    return output_name(name, ext, F.lit("-без-метаданных"))


def sheet_suffix(sheet: Column, sheets: Column) -> Column:
    return F.when(sheets > 1, F.concat(F.lit("-"), F.regexp_replace(sheet, r'[\\/:*?"<>|]', "_"))).otherwise("")


def dos_time(ts: Column) -> Column:
    return F.hour(ts) * 2048 + F.minute(ts) * 32 + F.floor(F.second(ts) / 2).cast("int")


def dos_date(ts: Column) -> Column:
    return (F.year(ts) - 1980) * 512 + F.month(ts) * 32 + F.day(ts)


def exif_date(c: Column) -> Column:
    return F.regexp_replace(c, r"^(\d{4}):(\d{2}):(\d{2})", "$3.$2.$1")


# ---- page ranges


def page_range(spec: Column, total: Column) -> Column:
    """``1-3, 5, 8-`` as sorted pages within 1..total. Blank means all; null where a part can't be read or none is left.

    White space parts too, so that ``1 - 3`` holds the part ``-``, which means all pages.
    """
    parts = F.filter(F.split(F.coalesce(spec, F.lit("")), r"[,;\s]+"), lambda p: p != "")
    span, number = r"^(\d*)[-–](\d*)$", r"^(\d+)$"

    def bound(p: Column, group: int, missing: Column) -> Column:
        found = F.regexp_extract(p, span, group)
        return F.when(found == "", missing).otherwise(found.cast("long"))

    def pages(p: Column) -> Column:
        single = F.rlike(p, F.lit(number))
        first = F.greatest(F.lit(1).cast("long"), F.when(single, p.cast("long")).otherwise(bound(p, 1, F.lit(1).cast("long"))))
        last = F.least(total.cast("long"), F.when(single, p.cast("long")).otherwise(bound(p, 2, total.cast("long"))))
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    readable = F.forall(parts, lambda p: F.rlike(p, F.lit(span)) | F.rlike(p, F.lit(number)))
    everything = F.when(total >= 1, F.sequence(F.lit(1).cast("long"), total.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    picked = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, pages))))
    found = F.when(F.size(parts) == 0, everything).when(readable, picked)
    return F.when(F.size(found) > 0, found)


def svg_size(svg: Column, default: int = 1024) -> Column:
    """(width, height) of an SVG: its sides in px or without a unit; a missing one by the viewBox; else the default."""
    root = F.regexp_extract(svg, r"(?s)<svg\b([^>]*)>", 1)

    def side(name: str) -> Column:
        found = F.regexp_extract(root, rf'\b{name}="\s*([0-9.]+)(?:px)?\s*"', 1)
        return F.when(found != "", found.cast("double"))

    box = F.split(F.trim(F.regexp_extract(root, r'\bviewBox="([^"]*)"', 1)), r"[\s,]+")
    vw, vh = F.get(box, F.lit(2)).cast("double"), F.get(box, F.lit(3)).cast("double")
    w, h = side("width"), side("height")
    width = F.coalesce(w, h * vw / vh, vw, F.lit(float(default)))
    height = F.coalesce(h, w * vh / vw, vh, width)
    return F.struct(half_up(width).cast("int").alias("width"), half_up(height).cast("int").alias("height"))
