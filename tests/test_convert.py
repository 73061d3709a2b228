from pyspark.sql import functions as F

from docloom.functions import dimensions as D
from docloom.functions import text as T
from docloom.operators import archive, audit, blocks, convert, relations
from docloom.operators.markdown import markdown_blocks

MD = """# Title *x*

First **bold** and *it*
second line

- a
- b
  1. c

| k | v\\|w |
| --- | --- |
| 1 | 2 |

```
code | x
- no item
```
---
end
"""


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_markdown(spark):
    docs = spark.createDataFrame([(1, MD), (2, None), (3, "")], "doc_id long, text string")
    b = markdown_blocks(docs).cache()
    got = [(r["type"], "".join(x["text"] for x in r["runs"] or []), r["depth"], r["rows"], r["text"]) for r in b.orderBy("doc_id", "ord").collect()]
    assert got == [
        ("h", "Title x", None, None, None), ("p", "First bold and it\nsecond line", None, None, None), ("li", "a", 0, None, None), ("li", "b", 0, None, None),
        ("li", "c", 1, None, None), ("table", "", None, [["k", "v|w"], ["1", "2"]], None), ("code", "", None, None, "code | x\n- no item"), ("hr", "", None, None, None), ("p", "end", None, None, None),
    ]
    html = blocks.render_html(b).first()["content"]
    assert "<h1>Title <em>x</em></h1>" in html and "First <strong>bold</strong> and <em>it</em><br>second line" in html


def test_convert_gates_and_renders(spark):
    docx = archive.write_docx(markdown_blocks(spark.createDataFrame([(7, MD)], "doc_id long, text string"))).first()["content"]
    files = spark.createDataFrame(
        [(1, "a.md", MD.encode()), (2, "b.txt", b"one\n\ntwo"), (3, "c.txt", b" \n "), (4, "d.bin", b"?"), (5, "e.csv", b"a,b"), (6, "f.html", b"<p>x</p>"), (7, "g.docx", bytes(docx))],
        "file_id long, name string, content binary",
    )
    got = {r["file_id"]: r for r in convert.convert(files, "html").collect()}
    assert {i: r["error"] for i, r in got.items()} == {
        1: None, 2: None, 3: "no text in the document", 4: "unknown kind", 5: None, 6: "no such conversion", 7: None,
    }
    assert b"<table><tr><td>a</td><td>b</td></tr></table>" in bytes(got[5]["content"])
    assert got[2]["out_name"] == "b.html" and b"<p>one</p>\n<p>two</p>" in bytes(got[2]["content"])
    assert b"<h1><strong>Title x</strong></h1>" in bytes(got[7]["content"])
    back = convert.convert(convert.convert(files.where("file_id = 2"), "docx").select("file_id", F.col("out_name").alias("name"), "content"), "txt")
    assert bytes(back.first()["content"]) == b"one\n\ntwo\n"


def test_tables(spark):
    files = spark.createDataFrame([(1, '[{"b":1,"a":null},{"c":"x"}]'), (2, '{"k":[{"z":1}],"m":2}'), (3, '{"p":1}'), (4, '[5,"y"]')], "file_id long, text string")
    assert rows_of(convert.json_table(files)) == [
        (1, 0, 0, "b", "1"), (1, 0, 1, "a", ""), (1, 1, 0, "c", "x"), (2, 0, 0, "z", "1"), (3, 0, 0, "p", "1"), (4, 0, 0, "value", "5"), (4, 1, 0, "value", "y"),
    ]
    rows = spark.createDataFrame([("s", 1, "Имя", "a;b"), ("s", 2, None, ""), ("t", 1, "x", "y")], "sheet string, n int, a string, b string")
    made = convert.csv_files(rows, "sheet", "n", [F.col("a"), F.col("b")])
    assert rows_of(made) == [("s", '﻿Имя;"a;b"'), ("t", "﻿x;y")]
    outs = spark.createDataFrame([("p", 1), ("q", 1), ("q", 2)], "batch string, out_ord int")
    assert {(r["batch"], r["route"]) for r in convert.single_or_zip(outs, "batch").collect()} == {("p", "file"), ("q", "zip")}


def test_formats(spark):
    f = D.formats(spark)
    files = spark.createDataFrame([(1, "PNG"), (2, "JPEG"), (3, "HEIC"), (4, "BMP")], "id long, label string")
    assert {r["id"]: r["out_format"] for r in relations.kept_formats(files, f).collect()} == {1: "png", 2: "png", 3: "png", 4: "bmp"}
    wishes = spark.createDataFrame([(1, 0, "webp"), (1, 1, "tiff"), (1, 2, "bmp"), (2, 0, "avif")], "id long, pos int, format string")
    assert rows_of(relations.first_supported(wishes, f, "id")) == [(1, "tiff"), (2, "png")]
    assert relations.formats_table(f).where("compression = 'lossless'").count() == 10
    queue = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "pos int, name string")
    assert rows_of(relations.moved(queue, "pos", 1, 1)) == [(0, "a"), (1, "c"), (2, "b")]


def test_lines_and_pages(spark):
    items = [(1, 0, 700.0, 10, "ab", False), (1, 1, 704.0, 10, "cd", False), (1, 2, 708.0, 10, "ef", True), (1, 3, 708.0, 10, "g", False), (1, 4, 709.0, 10, "h", False)]
    df = spark.createDataFrame(items, "doc_id long, ord int, y double, h int, text string, ends boolean")
    # the second stays near the first; the third is too far from the line's start
    assert [r[4] for r in rows_of(blocks.lines_of_items(df))] == ["abcd", "ef", "gh"]
    paras = spark.createDataFrame([(1, 1, 2, "b"), (1, 1, 1, "a"), (1, 2, 1, "c")], "doc_id long, page int, para int, text string")
    assert rows_of(blocks.pages_text(paras)) == [(1, "a\n\nb\n\n\f\n\nc")]


def test_svg_and_links(spark):
    cases = [('<svg viewBox="0 0 40 20">', (40, 20)), ('<svg width="100px" viewBox="0 0 40 20">', (100, 50)), ("<svg>", (1024, 1024)), ('<svg width="7" height="9">', (7, 9))]
    df = spark.createDataFrame([(c,) for c, _ in cases], "s string")
    assert [tuple(r["z"]) for r in df.select(T.svg_size(F.col("s")).alias("z")).collect()] == [w for _, w in cases]
    pages = spark.createDataFrame(
        [(1, "http://h/a", '<p id="x"></p><a href="#x">1</a><a href="/b#q">2</a><a href="/b#y">3</a><a href="https://o/">4</a>'),
         (2, "http://h/b", '<i id="y"></i><a href="https://o/" target="_blank" rel="noopener">5</a><meta name="description" content="d">')],
        "page_id long, url string, html string",
    )
    assert rows_of(audit.broken_anchors(pages)) == [(1, "/b", "q")]
    assert rows_of(audit.unsafe_external_links(pages)) == [(1, 1)]
    assert rows_of(audit.head_tags(pages).select("page_id", "held")) == [(1, ""), (2, "description")]
    faq = spark.createDataFrame([(1, 1, "q2", "a2"), (1, 0, "q<1", "a1")], "page_id long, ord int, q string, a string")
    assert audit.faq_schema(faq).first()["schema"].startswith('{"@type":"FAQPage","mainEntity":[{"@type":"Question","name":"q\\u003c1"')
    assert audit.robots("http://x/").endswith("Sitemap: http://x/sitemap.xml\n")


def test_targets_without_a_writer_are_errors_of_their_own(spark):
    files = spark.createDataFrame([(1, "a.json", b'[{"a": 1}]'), (2, "b.txt", b"x")], "file_id long, name string, content binary")
    for target in ("csv", "json", "xlsx", "pdf"):
        got = convert.convert(files, target).orderBy("file_id").collect()
        assert [(r["file_id"], r["status"], r["error"], r["content"]) for r in got] == [(1, "error", f"no writer for {target}", None), (2, "error", f"no writer for {target}", None)]
