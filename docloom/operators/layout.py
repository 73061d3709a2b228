"""Block rows on pages: greedy line wrap, and lines, items and table rows placed page by page.

Lines: the widths of all texts of a batch run up in one array. The word that opens the line after a given one is found by
binary search in it, for all words at once; a text's lines are the jumps from word to word, so their cost is that of the
lines, whatever the length of a text.

Pages are jumps over running heights in the same way: an item starts a page if it doesn't fit below the item that started
the last one. The heights run up in windows over a document's items, and the only fold is one step a page, which looks as
many items ahead as a page can hold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StringType

#: Advance widths of the characters from blank to tilde in thousandths of an em, of a plain and a bold sans serif face.
PLAIN = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
BOLD = (
    278, 333, 474, 556, 556, 889, 722, 238, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 333, 333, 584, 584, 584, 611,
    975, 722, 722, 722, 722, 667, 611, 778, 722, 278, 556, 722, 611, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 333, 278, 333, 584, 556,
    333, 556, 611, 556, 611, 556, 333, 611, 611, 278, 278, 556, 278, 889, 611, 611, 611, 611, 389, 556, 333, 611, 556, 778, 556, 556, 500, 389, 280, 389, 584,
)
#: Of letters and marks beyond, plain and bold; of what is set full width.
BEYOND, FULL = (556, 611), 1000
FULL_WIDTH = ((0x1100, 0x115F), (0x2E80, 0xA4CF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0xFF00, 0xFF60))
LINES = ArrayType(StringType())
#: Characters whose widths run up at once, about; a text is not cut.
CHUNK = 1 << 20
#: Points.
PAGES = {"a4": (595.28, 841.89), "letter": (612.0, 792.0)}
MARGIN, INDENT, MARK, PAD = 56.0, 18.0, 14.0, 4.0
#: Sizes of headings by level, in sizes of the text.
HEADINGS = (1.9, 1.5, 1.25, 1.1, 1.0, 1.0)


def advances(points: np.ndarray, bold: np.ndarray) -> np.ndarray:
    """Widths of code points in thousandths of an em; none for line feeds."""
    table = np.zeros((2, 128), np.int32)
    table[:, 32:127] = PLAIN, BOLD
    out = table[bold.astype(np.int8), np.minimum(points, 127)]
    beyond = np.flatnonzero(points > 126)
    full = np.zeros(len(beyond), bool)
    for low, high in FULL_WIDTH:
        full |= (points[beyond] >= low) & (points[beyond] <= high)
    out[beyond] = np.where(full, FULL, np.where(bold[beyond], BEYOND[1], BEYOND[0]))
    return out


def lines_of(pieces: list[str], bold: np.ndarray, n_pieces: np.ndarray, limits: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The lines of texts, each given as pieces with a style, and the number of each text's lines.

    A line holds the words that fit into its text's limit, in thousandths of an em; longer words are cut by letters. Blanks at
    its ends are dropped. A line feed ends a line, also an empty one; there is none after the last. What no font has (private
    use, beyond the basic plane, controls) becomes a question mark.
    """
    last = np.cumsum(n_pieces) - 1
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    points = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), "<u4").copy()
    points[(points < 32) & (points != 10) | (points == 127) | (points >= 0xD800) & (points < 0xF900) | (points > 0xFFFF)] = ord("?")
    ends = np.cumsum(lengths)[last]  # a line feed is put behind each text
    points = np.insert(points, ends, 10)
    width = np.concatenate(([0], np.cumsum(advances(points, np.insert(np.repeat(bold, lengths), ends, False)), dtype=np.int64)))
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    feed = points == 10
    inside = np.concatenate(([False], ~feed & (points != 32), [False]))
    starts, stops = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    feeds = np.flatnonzero(feed)
    row_of_feed = np.searchsorted(ends + np.arange(len(ends)), feeds)
    first = np.searchsorted(starts, np.concatenate(([0], feeds[:-1] + 1)))  # word of each stretch between line feeds
    beyond = np.searchsorted(starts, feeds)
    limit = np.repeat(limits[row_of_feed], beyond - first)
    stop_width = width[stops]
    jump = np.minimum(np.searchsorted(stop_width, width[starts] + limit, "right"), np.repeat(beyond, beyond - first)).tolist()
    out, counts = [], np.zeros(len(n_pieces), np.int64)
    is_last = np.concatenate((row_of_feed[1:] != row_of_feed[:-1], [True])).tolist()
    starts, stops = starts.tolist(), stops.tolist()
    for a, b, row, ends_row in zip(first.tolist(), beyond.tolist(), row_of_feed.tolist(), is_last):
        before, word = len(out), a
        while word < b:
            at, to = starts[word], jump[word]
            while to <= word:  # longer than a line
                most = int(limits[row]) + int(width[at])
                cut = max(at + 1, int(np.searchsorted(width[at : stops[word] + 1], most, "right")) + at - 1)
                if cut >= stops[word]:
                    to = word + 1
                    break
                out.append(text[at:cut])
                at = cut
                to = min(b, int(np.searchsorted(stop_width, width[at] + limits[row], "right")))
            out.append(text[at : stops[to - 1]])
            word = to
        if a == b and not ends_row:
            out.append("")
        counts[row] += len(out) - before
    return out, counts


def _lines(pieces: list[str], bold: np.ndarray, n_pieces: np.ndarray, limits: np.ndarray) -> tuple[list[str], np.ndarray]:
    """lines_of, some texts at a time."""
    to = np.cumsum(n_pieces)
    before = np.concatenate(([0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))))[to - n_pieces]
    cuts = [0, *(np.flatnonzero(np.diff(before // CHUNK)) + 1).tolist(), len(to)]
    lines, counts = [], []
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            part = slice(int(to[a] - n_pieces[a]), int(to[b - 1]))
            found, n = lines_of(pieces[part], bold[part], n_pieces[a:b], limits[a:b])
            lines += found
            counts.append(n)
    return lines, np.concatenate([np.empty(0, np.int64), *counts])


@F.arrow_udf(LINES)
def _wrap(pieces, bold, limit):
    import pyarrow as pa

    n = np.diff(pieces.offsets.to_numpy())
    styles = bold.flatten().fill_null(False).to_numpy(zero_copy_only=False)
    lines, counts = _lines([x or "" for x in pieces.flatten().to_pylist()], styles, n, limit.to_numpy())
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(lines, pa.string()))


@F.arrow_udf(ArrayType(LINES))
def _wrap_each(cells, bold, limit):
    import pyarrow as pa

    n = np.diff(cells.offsets.to_numpy())
    styles = bold.flatten().fill_null(False).to_numpy(zero_copy_only=False)
    texts = [x or "" for x in cells.flatten().to_pylist()]
    lines, counts = _lines(texts, styles, np.ones(len(texts), np.int64), np.repeat(limit.to_numpy(), n))
    inner = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(lines, pa.string()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), inner)


def limit(points: Column | float, size: Column | float) -> Column:
    """A width in thousandths of an em of this size."""
    points, size = (x if isinstance(x, Column) else F.lit(float(x)) for x in (points, size))
    return F.floor(points / size * 1000 + F.lit(1e-6)).cast("long")


def wrapped(text: Column, width: Column) -> Column:
    """Lines of a plain text."""
    return _wrap(F.array(F.coalesce(text, F.lit(""))), F.array(F.lit(False)), width)


def _mpt(points: Column | float) -> Column:
    """Thousandths of a point, whole, so that sums are exact."""
    return F.round((points if isinstance(points, Column) else F.lit(float(points))) * 1000).cast("long")


def items(blocks: DataFrame, page: str = "a4", size: float = 11.0) -> DataFrame:
    """Block rows to what is placed as a whole, lines and rows of tables: doc_id, seg, ord, line, and as ``it`` before, after,
    need, height, size, x (thousandths of a point), mark, text, and the parts of a row of a table (x, dy, text).

    seg counts the page breaks before. ``need`` is the height that must be left on a page, ``before`` and ``after`` are gaps.
    Rows of a table are filled up to the longest. Images have no place, as their size isn't known.
    """
    kind, inner = F.col("type"), PAGES[page][0] - 2 * MARGIN
    w = Window.partitionBy("doc_id").orderBy("ord")
    b = blocks.withColumn("seg", F.sum((kind == "pagebreak").cast("long")).over(w)).where(~kind.isin("pagebreak", "img"))
    level = F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(6))
    scale = F.when(kind == "h", F.element_at(F.array(*map(F.lit, HEADINGS)), level)).when(kind.isin("code", "table"), 0.9).otherwise(1.0)
    b = b.withColumn("size", scale * size)
    own, plain, no_text = F.col("size"), kind.isin("code", "hr"), F.array(F.lit(""))
    texts = F.when(plain, F.array(F.coalesce("text", F.lit("")))).when(kind != "table", F.transform("runs", lambda r: F.coalesce(r["text"], F.lit(""))))
    bold = F.when(~plain & (kind != "table"), F.transform("runs", lambda r: (kind == "h") | F.coalesce(r["bold"], F.lit(False))))
    left = F.when(kind == "li", INDENT * (F.coalesce("depth", F.lit(0)) + 1)).when(kind == "code", 12.0).otherwise(0.0)
    n_cols = F.when(kind == "table", F.greatest(F.array_max(F.transform("rows", F.size)), F.lit(1))).otherwise(1)
    filled = F.flatten(F.transform("rows", lambda r: F.concat(r, F.array_repeat(F.lit(""), F.col("n_cols") - F.size(r)))))
    b = b.select("*", F.coalesce(texts, no_text).alias("texts"), F.coalesce(bold, F.array(F.lit(False))).alias("bold"), left.alias("left"), n_cols.alias("n_cols"))
    cell = F.lit(inner) / F.col("n_cols")
    cells = F.when(kind == "table", filled).otherwise(F.array().cast("array<string>"))
    head = F.transform("cells", lambda _, i: (i < F.col("n_cols")) & (F.size("rows") > 1))
    b = b.withColumn("cells", cells)
    b = b.withColumns({"lines": _wrap("texts", "bold", limit(F.lit(inner) - F.col("left"), own)), "set": _wrap_each("cells", head, limit(cell - 2 * PAD, own))})
    # heights and gaps of a block's lines, rounded once a block
    lead = F.when(kind == "h", own * 1.3).when(kind == "code", size * 1.3).when(kind == "hr", size * 1.2).otherwise(size * 1.45)
    after = F.when(kind == "h", own * 0.35).when(kind == "li", size * 0.35).when(kind == "hr", 0.0).when(kind == "table", size * 0.8).otherwise(size * 0.7)
    need = F.when(kind == "hr", size).when(kind == "h", own * 2.4).otherwise(lead)
    measures = {"m_lead": lead, "m_after": after, "m_before": F.when(kind == "h", own * 0.6).otherwise(0.0), "m_need": need, "m_size": own, "m_x": F.lit(MARGIN) + F.col("left")}
    b = b.withColumns({name: _mpt(c) for name, c in measures.items()})
    b = b.withColumn("mark", F.when(kind == "li", F.when(F.col("ordered"), F.concat(F.col("idx").cast("string"), F.lit("."))).otherwise("•")))
    none, nobody, piece = F.lit(0).cast("long"), F.lit(None).cast("string"), "array<struct<x:bigint,dy:bigint,text:string>>"

    def item(first, last, need, height, mark, text, parts):
        before, after = F.when(first, F.col("m_before")).otherwise(none), F.when(last, F.col("m_after")).otherwise(none)
        named = (before, "before"), (after, "after"), (need, "need"), (height, "height"), (F.col("m_size"), "size"), (F.col("m_x"), "x"), (mark, "mark"), (text, "text"), (parts, "parts")
        return F.struct(*(c.alias(name) for c, name in named))

    def line(t: Column, i: Column) -> Column:
        need = F.when(i == 0, F.col("m_need")).otherwise(F.col("m_lead"))
        return item(i == 0, i == F.size("lines") - 1, need, F.col("m_lead"), F.when(i == 0, F.col("mark")), t, F.lit(None).cast(piece))

    def row(i: Column) -> Column:
        mine = F.slice("set", i * F.col("n_cols") + 1, F.col("n_cols"))
        height = _mpt(F.greatest(F.array_max(F.transform(mine, F.size)), F.lit(1)) * own * 1.35 + 2 * PAD)
        at = lambda j, k, t: F.struct(_mpt(F.lit(MARGIN + PAD) + cell * j).alias("x"), _mpt(F.lit(PAD) + own * 1.35 * k).alias("dy"), t.alias("text"))
        parts = F.flatten(F.transform(mine, lambda c, j: F.transform(c, lambda t, k: at(j, k, t))))
        return item(i == 0, i == F.size("rows") - 1, height, height, nobody, nobody, parts)

    lines = F.when(kind == "hr", no_text).otherwise(F.col("lines"))
    b = b.withColumn("lines", lines)
    every = F.when((kind == "table") & (F.size("rows") > 0), F.transform(F.sequence(F.lit(0), F.size("rows") - 1), row)).when(kind != "table", F.transform("lines", line))
    return b.select("doc_id", "seg", "ord", F.posexplode(every).alias("line", "it"))


def placed(items_: DataFrame, page: str = "a4") -> DataFrame:
    """Items to their pages: doc_id, page, ord, line, top (from the page's upper margin), it.

    A page goes on as long as an item's need is left on it; an item higher than a page has one for itself, and leaves the page
    before it empty if nothing is on it. The gap before an item that starts a page is dropped, but for the first after a break.
    """
    inner = int(round((PAGES[page][1] - 2 * MARGIN) * 1000))
    w = Window.partitionBy("doc_id", "seg").orderBy("ord", "line")
    run = items_.withColumn("gap", F.col("it.before") + F.coalesce(F.lag("it.after").over(w), F.lit(0)))
    run = run.withColumn("at", F.sum(F.col("gap") + F.col("it.height")).over(w) - F.col("it.height"))
    run = run.withColumn("reach", F.max(F.col("at") + F.col("it.need")).over(w))
    row = F.struct("ord", "line", "at", "reach", "it")
    whole = run.groupBy("doc_id", "seg").agg(F.sort_array(F.collect_list(row)).alias("xs"))
    whole = whole.withColumns({
        "ats": F.transform("xs", lambda x: x["at"]), "reaches": F.transform("xs", lambda x: x["reach"]),
        "ahead": (F.lit(inner) / F.greatest(F.array_min(F.transform("xs", lambda x: x["it"]["height"])), F.lit(1)) + 2).cast("int"),
    })
    whole = whole.withColumn("late", (F.get("reaches", F.lit(0)) > inner).cast("int"))
    origin = lambda s: F.when((s == 0) & (F.col("late") == 0), F.lit(0)).otherwise(F.get("ats", s))

    def jump(starts: Column, _: Column) -> Column:
        s = F.element_at(starts, -1)
        fits = F.filter(F.slice("reaches", s + 2, F.col("ahead")), lambda m: m <= origin(s) + inner)
        return F.when(s >= F.size("xs"), starts).otherwise(F.concat(starts, F.array(s + 1 + F.size(fits))))

    starts = F.aggregate(F.sequence(F.lit(1), F.size("xs")), F.array(F.lit(0)), jump)
    whole = whole.withColumn("starts", starts).withColumn("n", F.size("starts") - 1)
    order = Window.partitionBy("doc_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum(F.col("n") + F.col("late")).over(order), F.lit(0)) + F.col("seg") - F.count(F.lit(1)).over(order)  # an empty segment is one empty page
    part = F.transform(
        F.sequence(F.lit(1), F.col("n")),
        lambda i: F.struct(
            (earlier + F.col("late") + i).alias("page"),
            origin(F.get("starts", i - 1)).alias("from"),
            F.slice("xs", F.get("starts", i - 1) + 1, F.get("starts", i) - F.get("starts", i - 1)).alias("xs"),
        ),
    )
    pages = whole.select("doc_id", part.alias("pages")).select("doc_id", F.explode("pages").alias("p"))
    out = pages.select("doc_id", "p.page", "p.from", F.explode("p.xs").alias("x"))
    return out.select("doc_id", "page", "x.ord", "x.line", (F.col("x.at") - F.col("from")).alias("top"), "x.it")


def layout(blocks: DataFrame, page: str = "a4", size: float = 11.0) -> DataFrame:
    """Block rows to pieces of text on pages: doc_id, page (from 1), ord, line, part, x, y (of the baseline, from below), text."""
    on = placed(items(blocks, page, size), page)
    part = lambda x, text: F.struct(x.alias("x"), F.lit(0).cast("long").alias("dy"), text.alias("text"))
    one = part(F.col("it.x"), F.col("it.text"))
    parts = F.coalesce("it.parts", F.when(F.col("it.mark").isNotNull(), F.array(part(F.col("it.x") - _mpt(MARK), F.col("it.mark")), one)).otherwise(F.array(one)))
    on = on.select("doc_id", "page", "ord", "line", "top", "it.size", F.posexplode(parts).alias("part", "p"))
    y = F.lit(int(round((PAGES[page][1] - MARGIN) * 1000))) - F.col("top") - F.col("p.dy") - F.col("size")
    return on.select("doc_id", "page", "ord", "line", "part", (F.col("p.x") / 1000).alias("x"), (y / 1000).alias("y"), "p.text")
