"""Line wrap and pages against the definitions, step by step."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import layout
from docloom.operators.blocks import BLOCK
from docloom.shipping import ship


def width(text, bold=False):
    out = 0
    for c in text:
        if " " <= c <= "~":
            out += (layout.BOLD if bold else layout.PLAIN)[ord(c) - 32]
        else:
            out += 1000 if any(a <= ord(c) <= b for a, b in layout.FULL_WIDTH) else layout.BEYOND[bold]
    return out


def wrap(runs, limit):
    """One word after the other; runs are (text, bold)."""
    chars = [(c if c == "\n" or not (c < " " or c == "\x7f" or 0xE000 <= ord(c) < 0xF900 or ord(c) > 0xFFFF) else "?", b) for t, b in runs for c in t]
    size = lambda part: sum(width(c, b) for c, b in part)
    lines, line, word, i = [], [], [], 0
    stretches = [[]]
    for c in chars:
        stretches.append([]) if c[0] == "\n" else stretches[-1].append(c)
    for n, stretch in enumerate(stretches):
        words, gap, line = [], [], []
        for c in [*stretch, (" ", False)]:
            if c[0] != " ":
                words = words if words and words[-1][2] else [*words, (gap, [], True)]
                words[-1][1].append(c)
                gap = []
            else:
                if words:
                    words[-1] = (*words[-1][:2], False)
                gap = [*gap, c]
        begun = False
        for before, word, _ in words:
            if begun and size(line + before + word) > limit:
                lines.append(line)
                begun, line = False, []
            if not begun:
                while size(word) > limit:
                    k = max([1, *(k for k in range(1, len(word) + 1) if size(word[:k]) <= limit)])
                    if k == len(word):
                        break
                    lines.append(word[:k])
                    word = word[k:]
                line, begun = word, True
            else:
                line = line + before + word
        if begun or n < len(stretches) - 1:
            lines.append(line)
    return ["".join(c for c, _ in x) for x in lines]


def random_text(rng, n):
    return "".join(rng.choice(["i", "W", "a", "é", "中", " ", " ", "  ", "\n", "word ", "mmmm", "\t", "", "😀"]) for _ in range(n))


def test_texts_in_chunks(monkeypatch):
    import numpy as np

    rng = random.Random(3)
    texts = [random_text(rng, rng.randrange(40)) for _ in range(200)]
    args = np.zeros(200, bool), np.ones(200, np.int64), np.full(200, 2500)
    whole = layout.lines_of(texts, *args)
    monkeypatch.setattr(layout, "CHUNK", 50)
    parts = layout._lines(texts, *args)
    assert whole[0] == parts[0] and whole[1].tolist() == parts[1].tolist()
    none = np.empty(0, np.int64)
    assert layout._lines([], np.empty(0, bool), none, none)[0] == []


def test_wrap(spark):
    ship(spark)
    rng = random.Random(1)
    rows = [(i, random_text(rng, rng.randrange(60)), rng.choice([100, 999, 2500, 6000])) for i in range(400)] + [(900, None, 500), (901, "", 500), (902, "a" * 50, 1), (903, "  \n \n", 500)]
    got = spark.createDataFrame(rows, "id int, text string, limit long").repartition(3).select("id", layout.wrapped(F.col("text"), F.col("limit")).alias("l")).collect()
    assert {r["id"]: r["l"] for r in got} == {i: wrap([(t or "", False)], limit) for i, t, limit in rows}


def test_wrap_of_a_long_paragraph_is_linear(spark):
    import time

    words = "lorem ipsum dolor sit amet " * 40_000  # 1.1 MB
    import numpy as np

    t = time.time()
    lines, counts = layout.lines_of([words], np.array([False]), np.array([1]), np.array([43_934]))
    assert counts[0] == len(lines) > 9000 and time.time() - t < 5
    assert " ".join(lines) == words.strip()
    assert all(width(x) <= 43_934 < width(x + " " + y.split(" ")[0]) for x, y in zip(lines, lines[1:]))


def pages(blocks, page, size):
    """The cursor goes down from block to block."""
    wide, high = layout.PAGES[page]
    inner, mpt = wide - 112, lambda x: int(round(x * 1000))
    depth, top = mpt(high - 112), mpt(high - 56)
    out, at, no, segment_start = [], 0, 1, True

    def ensure(need):
        nonlocal at, no
        if at + need > depth:
            at, no = 0, no + 1

    limit = lambda points, s: int(points / s * 1000 + 1e-6)
    for b in blocks:
        kind, put = b["type"], lambda line, part, x, dy, text, s: out.append((no, b["ord"], line, part, mpt(x) / 1000, (top - at - dy - mpt(s)) / 1000, text))  # noqa: B023, E731
        if kind == "pagebreak":
            at, no = 0, no + 1
        elif kind == "hr":
            ensure(mpt(size))
            put(0, 0, 56, 0, "", size)
            at += mpt(size * 1.2)
        elif kind == "table":
            cols = max(1, max(len(r) for r in b["rows"]))
            for i, row in enumerate(b["rows"]):
                cells = [wrap([(c or "", i == 0 and len(b["rows"]) > 1)], limit(inner / cols - 8, size * 0.9)) for c in row]
                need = mpt(max([1, *map(len, cells)]) * size * 0.9 * 1.35 + 8)
                ensure(need)
                part = 0
                for j, c in enumerate(cells):
                    for k, t in enumerate(c):
                        put(i, part, 60 + inner / cols * j, mpt(4 + size * 0.9 * 1.35 * k), t, size * 0.9)
                        part += 1
                at += need
            at += mpt(size * 0.8)
        elif kind != "img":
            scale = layout.HEADINGS[min(max(b["level"] or 1, 1), 6) - 1] if kind == "h" else 0.9 if kind == "code" else 1
            s = size * scale
            lead = s * 1.3 if kind == "h" else size * 1.3 if kind == "code" else size * 1.45
            left = 18 * ((b["depth"] or 0) + 1) if kind == "li" else 12 if kind == "code" else 0
            runs = [(b["text"] or "", False)] if kind == "code" else [(r["text"], kind == "h" or r["bold"]) for r in b["runs"]]
            lines = wrap(runs, limit(inner - left, s))
            if lines:
                at += mpt(s * 0.6) if kind == "h" else 0
                for i, t in enumerate(lines):
                    ensure(mpt(s * 2.4) if kind == "h" and i == 0 else mpt(lead))
                    marked = kind == "li" and i == 0
                    if marked:
                        put(i, 0, 56 + left - 14, 0, f"{b['idx']}." if b["ordered"] else "•", s)
                    put(i, int(marked), 56 + left, 0, t, s)
                    at += mpt(lead)
                at += mpt(s * 0.35) if kind == "h" else mpt(size * (0.35 if kind == "li" else 0.7))
    return out


def random_blocks(rng, n):
    out = []
    for ord_ in range(n):
        kind = rng.choice(["p", "p", "h", "li", "table", "code", "hr", "pagebreak", "img"])
        runs = [{"text": random_text(rng, rng.randrange(150)), "bold": rng.random() < 0.3, "italic": False} for _ in range(rng.randrange(3))]
        b = dict.fromkeys(("level", "ordered", "idx", "depth", "runs", "rows", "src", "text")) | {"ord": ord_, "type": kind}
        if kind in ("p", "h", "li"):
            b |= {"runs": runs, "level": rng.randrange(1, 7), "ordered": rng.random() < 0.5, "idx": ord_, "depth": rng.randrange(3)}
        if kind == "table":
            b["rows"] = [[random_text(rng, rng.choice([3, 30, 400])) for _ in range(rng.randrange(4))] for _ in range(rng.randrange(1, 8))]
        if kind == "code":
            b["text"] = random_text(rng, 300)
        out.append(b)
    return out


@pytest.mark.parametrize("page,size", [("a4", 11.0), ("letter", 24.0)])
def test_layout(spark, page, size):
    ship(spark)
    rng = random.Random(7)
    docs = {i: random_blocks(rng, n) for i, n in enumerate([0, 1, 5, 30, 80, 80])}
    # only page breaks, a row higher than a page, and a heading at the foot of a page
    docs[10] = [b | {"type": "pagebreak"} for b in random_blocks(rng, 2)]
    docs[11] = [dict.fromkeys(("level", "ordered", "idx", "depth", "runs", "rows", "src", "text")) | {"ord": i, "type": "table", "rows": [["x"], ["mm " * 2000], ["y"]]} for i in range(2)]
    rows = [(d, *(b[c.split()[0]] for c in ("ord", "type", "level", "ordered", "idx", "depth", "runs", "rows", "src", "text"))) for d, bs in docs.items() for b in bs]
    df = spark.createDataFrame(rows, f"doc_id long, ord int, {BLOCK}").repartition(4)
    got = sorted(tuple(r) for r in layout.layout(df, page, size).collect())
    want = sorted((d, *r) for d, bs in docs.items() for r in pages(bs, page, size))
    assert [g[:5] + g[7:] for g in got] == [w[:5] + w[7:] for w in want]
    assert all(abs(g[5] - w[5]) < 0.01 and abs(g[6] - w[6]) < 0.01 for g, w in zip(got, want))
