import io
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import archive, audit, blocks, cells, detect, images, metadata, pixels, relations
from docloom.sources import files as sources
from docloom.streaming import intake


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- documents


HTML = """<html><head><title>t</title><style>x</style></head><body><h1>Head <i>it</i></h1><p>one <b>two</b><br>three<p>next
<ul><li>a<ol><li>x</li></ol></li><li>b</li></ul><table><tr><th>k</th><td>v|w</td></tr><tr><td>1</td></tr></table>
<pre>code
</pre><hr><img src="p.png"><div>bare</div><script>no</script></body></html>"""


def test_html_blocks_and_renderers(spark):
    pages = spark.createDataFrame([(1, HTML), (2, None), (3, "")], "page_id long, html string")
    b = blocks.html_blocks(pages).cache()
    kinds = [(r["type"], blocks_text(r)) for r in b.orderBy("doc_id", "ord").collect()]
    assert kinds == [
        ("h", "Head it"), ("p", "one two\nthree"), ("p", "next"), ("li", "a"), ("li", "x"), ("li", "b"), ("table", ""), ("code", ""), ("hr", ""), ("img", ""), ("p", "bare"),
    ]
    text = blocks.render_text(b).first()["content"]
    assert text == "Head it\n\none two\nthree\n\nnext\n\n• a\n\n  1. x\n\n• b\n\nk\tv|w\n1\n\ncode\n\n———\n\nbare\n"
    html = blocks.render_html(b).first()["content"]
    assert "<p>one <strong>two</strong><br>three</p>" in html and "<ul>\n<li>a</li>\n</ul>\n<ol>\n<li>x</li>\n</ol>\n<ul>\n<li>b</li>\n</ul>" in html
    assert '<table><tr><td>k</td><td>v|w</td></tr><tr><td>1</td></tr></table>' in html and '<img src="p.png" alt="">' in html
    md = blocks.render_markdown(b).first()["content"]
    assert md.startswith("# Head it\n\none **two**  \nthree\n\nnext\n\n- a\n\n  1. x\n\n- b\n\n| k | v\\|w |\n| --- | --- |\n| 1 |\n\n```\ncode\n```\n\n---\n\nbare")


def blocks_text(r):
    return "".join(x["text"] for x in r["runs"] or [])


def test_html_blocks_of_open_heads_and_nested_tables(spark):
    pages = spark.createDataFrame(
        [
            (1, "<html><head><title>x</title><body><p>hi</p></body></html>"),
            (2, "<table><tr><td>a<table><tr><td>in</td></tr></table></td><td>b</td></tr><tr><td>c</td></tr></table>"),
        ],
        "page_id int, html string",
    )
    got = blocks.html_blocks(pages).collect()
    assert [(r["type"], [x["text"] for x in r["runs"]]) for r in got if r["doc_id"] == 1] == [("p", ["hi"])]
    assert [r["rows"] for r in got if r["doc_id"] == 2] == [[["ain", "b"], ["in"], ["c"]]]


def test_trim_runs_and_paragraphs(spark):
    runs = F.array(*(F.struct(F.lit(t).alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic")) for t in (" ", "", " a", "b \n")))
    got = spark.range(1).select(blocks.trim_runs(runs).alias("r")).first()["r"]
    assert [x["text"] for x in got] == [" a", "b"]
    docs = spark.createDataFrame([(1, "a\r\n\r\n b \f\n \n\nc"), (2, None), (3, " \n\n ")], "doc_id long, text string")
    assert rows_of(blocks.paragraphs(docs)) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c")]


def test_reflow(spark):
    lines = [(700, "First line of a sen-"), (686, "tence goes on"), (672, "and Ends-"), (658, "Capital"), (600, "after a gap"), (586, ""), (572, "after blank"), (690, "next column")]
    df = spark.createDataFrame([(1, i, y, 14, t) for i, (y, t) in enumerate(lines)], "doc_id long, ord int, y int, h int, text string")
    got = [t for _, _, t in rows_of(blocks.reflow(df))]
    assert got == ["First line of a sentence goes on and Ends- Capital", "after a gap", "after blank", "next column"]


# ---- cells


def test_csv(spark, tmp_path):
    files = spark.createDataFrame([(1, '\ufeffИмя;Возраст\n"Анна; ""А""";30\n\nБорис;41'), (2, "a\tb,c\n1\t007"), (3, "x,y\n1,")], "file_id long, text string")
    got = {(r["file_id"], r["row_ord"]): r["cells"] for r in cells.csv_cells(files).collect()}
    assert got == {(1, 0): ["Имя", "Возраст"], (1, 1): ['Анна; "А"', "30"], (1, 3): ["Борис", "41"], (2, 0): ["a", "b,c"], (2, 1): ["1", "007"], (3, 0): ["x", "y"], (3, 1): ["1", ""]}
    line = spark.range(1).select(cells.csv_line([F.lit("a;b"), F.lit('q"q'), F.lit(None), F.lit(7)])).first()[0]
    assert line == '"a;b";"q""q";;7'
    path = tmp_path / "t.csv"
    path.write_text('a;b\n"x\ny";01\n')
    assert [tuple(r) for r in cells.read_csv(spark, str(path), ";").collect()] == [("x\ny", "01")]


def test_json(spark):
    rows = spark.createDataFrame([(1, '{"b": 1, "a": "x", "c": null}'), (2, None)], "id long, j string")
    assert rows_of(cells.json_fields(rows, "id", "j")) == [(1, 0, "b", "1"), (1, 1, "a", "x"), (1, 2, "c", None)]
    assert spark.range(1).select(cells.json_row({"k": F.lit('a"\n'), "n": F.lit(None)})).first()[0] == '{"k": "a\\"\\n", "n": ""}'


# ---- detection


def test_detection(spark):
    cases = [
        (b"\x89PNG\r\n", "x.jpg", "PNG", None), (b"\xff\xd8\xff\xe0", "x", "JPEG", None), (b"GIF89a", "d.txt", "GIF", "txt"), (b"RIFF0000WEBPVP8", "x", "WEBP", None),
        (b"II*\0....", "x", "TIFF", None), (b"....ftypavif", "x", "AVIF", None), (b"....ftypheic", "x", "HEIC", None), (b"\0\0\1\0", "x", "ICO", None), (b"BM..", "x", "BMP", None),
        (b"P6 1 1", "x", "PNM", None), (b"\0\0\2", "x.TGA", "TGA", None), (b"<?xml?>", "x", "SVG", None), (b"%PDF-1.4", "x.doc", "DOC", "pdf"),
        (b"PK\3\4 word/document.xml", "x.zip", "ZIP", "docx"), (b"PK\3\4 xl/", "x", "FILE", "xlsx"), (b"PK\3\4", "x.ods", "ODS", "ods"), (b"PK\3\4", "x.zip", "ZIP", None),
        (b"\xd0\xcf\x11\xe0", "a.doc", "DOC", "doc"), (b"\xd0\xcf\x11\xe0", "a.bin", "BIN", "xls"), (b"a,b", "a.tsv", "TSV", "csv"), (b"", "n.markdown", "MARKDOWN", "md"), (b"?", None, "FILE", None),
    ]
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, content binary, name string")
    got = df.select("i", detect.image_label(F.col("content"), F.col("name")), detect.document_kind(F.col("content"), F.col("name"))).orderBy("i").collect()
    assert [(r[1], r[2]) for r in got] == [c[2:] for c in cases]
    gated = detect.gate(spark.createDataFrame([("pdf", "txt"), ("pdf", "md"), (None, "txt"), ("doc", "pdf")], "kind string, target string"))
    assert {(r["kind"], r["target"]): r["status"] for r in gated.collect()} == {("pdf", "txt"): "ready", ("pdf", "md"): "error", (None, "txt"): "error", ("doc", "pdf"): "error"}


def test_sources_and_stream(spark, tmp_path):
    root = tmp_path / "in"
    (root / "sub" / "assets").mkdir(parents=True)
    (root / "a.txt").write_bytes(b"text")
    (root / "empty.txt").write_bytes(b"")
    (root / "sub" / "b.pdf").write_bytes(b"%PDF-1.7")
    got = {r["name"]: (r["kind"], r["length"]) for r in sources.typed(sources.read_files(spark, str(root))).collect()}
    assert got == {"a.txt": ("txt", 4), "b.pdf": ("pdf", 8)}
    queue = sources.ordered(sources.read_files(spark, str(root)), F.lit("all"))
    assert [(r["name"], r["queue_pos"]) for r in queue.orderBy("queue_pos").collect()] == [("a.txt", 0), ("b.pdf", 1)]
    flat = tmp_path / "flat"
    flat.mkdir()
    for name, data in (("a.txt", b"t"), ("b.pdf", b"%PDF"), ("c.bin", b"?"), ("d.txt", b"")):
        (flat / name).write_bytes(data)
    rows = intake.stream_gated(intake.stream_files(spark, str(flat)), F.lit("docx"))
    intake.run_once(rows.select("name", "kind", "status", "content"), str(tmp_path / "out"), str(tmp_path / "ck"))
    (flat / "e.txt").write_bytes(b"more")
    intake.run_once(rows.select("name", "kind", "status", "content"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {r["name"]: (r["kind"], r["status"], bytes(r["content"]) if r["content"] else None) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a.txt": ("txt", "ready", b"t"), "b.pdf": ("pdf", "ready", b"%PDF"), "c.bin": (None, "error", None), "e.txt": ("txt", "ready", b"more")}
    for path in ("index.html", "p/index.html", "assets/index.html"):
        (root / path).parent.mkdir(exist_ok=True)
        (root / path).write_text(path)
    assert sorted(r["path"] for r in sources.read_pages(spark, str(root)).collect()) == ["/", "/p/"]


# ---- images


@pytest.fixture(scope="module")
def probe():
    px = np.zeros((30, 40, 4), np.uint8)
    px[:, :20], px[:, 20:] = (255, 0, 0, 255), (0, 0, 255, 255)
    px[20:] = 0
    rng = np.random.default_rng(7)
    noise = rng.integers(0, 256, (9, 13, 4), np.uint8)
    noise[..., 3] = 255
    return {"probe": px, "noise": noise}


def _frame(spark, images_):
    rows = [(k, v.shape[1], v.shape[0], v.tobytes()) for k, v in images_.items()]
    return spark.createDataFrame(rows, "id string, width int, height int, rgba binary")


def _px(r):
    return np.frombuffer(r["rgba"], np.uint8).reshape(r["height"], r["width"], 4)


@pytest.mark.parametrize("fmt,label,alpha", [("png", "PNG", True), ("tga", "TGA", True), ("tiff", "TIFF", True), ("bmp", "BMP", False), ("ppm", "PNM", False), ("pgm", "PNM", False)])
def test_round_trips(spark, probe, fmt, label, alpha):
    written = images.encode(_frame(spark, probe), fmt)
    found = written.withColumn("label", detect.image_label(F.col("content"), F.lit(f"a.{fmt}"))).select("id", "label", "content")
    for r in images.decode(found).collect():
        want = probe[r["id"]] if alpha else images.flatten(probe[r["id"]])
        assert (r["label"], r["status"]) == (label, "done")
        got = _px(r)
        if fmt == "pgm":
            assert (got[..., 0] == got[..., 2]).all() and got.shape == want.shape
        else:
            assert (got == want).all()


def test_decoders_of_given_bytes(spark):
    tga = struct.pack("<BBBHHBHHHHBB", 0, 0, 10, 0, 0, 0, 0, 0, 3, 1, 32, 8) + b"\x81\1\2\3\4" + b"\x00\5\6\7\x08"
    filtered = b"".join(bytes([k]) + bytes(line) for k, line in ((0, [10, 20, 30, 5, 5, 5]), (1, [1, 1, 1, 1, 1, 1]), (2, [1] * 6), (3, [2] * 6), (4, [3] * 6)))
    png = b"\x89PNG\r\n\x1a\n" + images._chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 5, 8, 2, 0, 0, 0)) + images._chunk(b"IDAT", zlib.compress(filtered)) + images._chunk(b"IEND", b"")
    rows = [
        (1, "TGA", tga), (2, "PNM", b"P1 # c\n3 1\n101"), (3, "PNM", b"P4\n9 1\n\x80\x80"), (4, "PNM", b"P5 1 1 65535\n\xff\xff"), (5, "PNM", b"P3 1 1 10 10 5 0"),
        (11, "TIFF", b"MM\0*\0\0\0\x08\0\x07" + b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in ((256, 3, 2), (257, 3, 1), (259, 3, 32773), (262, 3, 2), (273, 4, 98), (277, 3, 3), (279, 4, 7))) + bytes(4) + b"\xfe\x09\x02\1\2\3"),
        (6, "PNM", b"P6 nonsense"), (7, "WEBP", b"RIFF"), (8, "PNG", b"\x89PNG"), (9, "PNG", png), (10, "BMP", None),
    ]
    got = {r["id"]: r for r in images.decode(spark.createDataFrame(rows, "id int, label string, content binary")).collect()}
    assert _px(got[1]).tolist() == [[[3, 2, 1, 4], [3, 2, 1, 4], [7, 6, 5, 8]]]
    assert _px(got[2])[0, :, 0].tolist() == [0, 255, 0] and _px(got[3])[0, :, 0].tolist() == [0] + [255] * 7 + [0]
    assert _px(got[4])[0, 0].tolist() == [255] * 4 and _px(got[5])[0, 0].tolist() == [255, 127, 0, 255]
    assert all(got[i]["status"] == "error" and got[i]["error"] for i in (6, 7, 8, 10))
    assert _px(got[11])[0, :, :3].tolist() == [[9, 9, 9], [1, 2, 3]]
    assert _px(got[9])[:, :, 0].tolist() == [[10, 5], [1, 2], [2, 3], [3, 5], [6, 9]]


def test_transforms(spark, probe):
    src = _frame(spark, {"probe": probe["probe"]})

    def run(w, h, **kw):
        return _px(images.transform(src, F.lit(w), F.lit(h), **kw).first())

    turned = run(40, 30, rotate=90)
    assert turned.shape == (40, 30, 4) and turned[0, -1].tolist() == [255, 0, 0, 255]
    assert run(40, 30, flip_h=True)[0, 0].tolist() == [0, 0, 255, 255] and run(40, 30, flip_v=True)[0, 0, 3] == 0
    assert run(20, 15)[0, 0].tolist() == [255, 0, 0, 255] and run(20, 15).shape == (15, 20, 4)
    assert run(10, 10, mode="cover").shape == (10, 10, 4)
    padded = run(40, 60, mode="pad")
    assert padded[0, 0].tolist() == [255] * 4 and padded[20, 2].tolist() == [255, 0, 0, 255]
    uri = bytes(images.encode(src, "datauri").first()["content"])
    svg = bytes(images.encode(src, "svg").first()["content"])
    assert uri.startswith(b"data:image/png;base64,iVBOR") and b"\n" not in uri and b'width="40"' in svg
    icon = images.encode(src, "ico").withColumn("label", F.lit("ICO")).select("label", "content")
    assert _px(images.decode(icon).first()).shape == (256, 256, 4) and struct.unpack_from("<HHH", bytes(icon.first()["content"])) == (0, 1, 4)
    assert images.encode(src, "webp").first()["error"] == "no writer for webp"


def test_pixels(spark, probe):
    p = images.explode_pixels(_frame(spark, {"probe": probe["probe"]}), "id").cache()
    assert p.count() == 1200 and p.where("r = 255 AND b = 0 AND a = 255").count() == 400
    hist = pixels.histogram(p)
    assert rows_of(hist) == [("probe", 31, 400), ("probe", 31 << 10, 400)]
    two = hist.select("image_id").distinct().withColumn("limit", F.lit(2))
    assert {(r["r"], r["g"], r["b"], r["n"]) for r in pixels.palette(pixels.boxes(hist, two)).collect()} == {(255, 0, 0, 400), (0, 0, 255, 400)}
    entries = spark.createDataFrame([(0, 0, 0, 0), (1, 250, 0, 0), (2, 250, 0, 0), (3, 0, 0, 250)], "idx int, pr int, pg int, pb int")
    assert {(r["color"], r["idx"]) for r in pixels.nearest(hist, entries).collect()} == {(31 << 10, 1), (31, 3)}


# ---- metadata


def _jpeg(orientation):
    e = "<"
    entries = [(0x10F, 2, 5, 74), (0x112, 3, 1, orientation), (0x8825, 4, 1, 80)]
    ifd = struct.pack("<H", 3) + b"".join(struct.pack("<HHII", *x) for x in entries) + bytes(4)
    tiff = b"II*\0" + struct.pack("<I", 8) + ifd
    tiff = tiff.ljust(74, b"\0") + b"Test\0\0"
    gps = [(1, 2, 2, int.from_bytes(b"N\0\0\0", "little")), (2, 5, 3, 140), (3, 2, 2, int.from_bytes(b"W\0\0\0", "little")), (4, 5, 3, 164)]
    tiff += struct.pack("<H", 4) + b"".join(struct.pack(e + "HHII", *x) for x in gps) + bytes(4)
    tiff = tiff.ljust(140, b"\0") + struct.pack("<6I", 55, 1, 45, 1, 0, 0) + struct.pack("<6I", 37, 1, 37, 1, 0, 1)
    app1 = b"Exif\0\0" + tiff
    seg = lambda m, body: b"\xff" + bytes([m]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + seg(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + seg(0xE1, app1) + seg(0xFE, b"note") + b"\xff\xda\0\2scan\xff\xd9"


def test_metadata(spark):
    png = b"\x89PNG\r\n\x1a\n" + images._chunk(b"IHDR", bytes(13)) + images._chunk(b"tEXt", b"a\0b") + images._chunk(b"IDAT", b"") + images._chunk(b"IEND", b"")
    rows = [(1, _jpeg(1)), (2, _jpeg(6)), (3, png), (4, b"junk"), (5, _jpeg(1)[:40]), (6, None)]
    files = spark.createDataFrame(rows, "file_id long, content binary")
    got = {r["file_id"]: r for r in metadata.read_metadata(files).collect()}
    assert set(got) == {1, 2, 3} and got[1]["found"] == ["EXIF", "comment"] and got[3]["found"] == ["text"]
    assert (got[1]["make"], got[2]["orientation"], got[1]["gps_present"], got[1]["lat"]) == ("Test", 6, True, 55.75) and got[1]["lon"] == pytest.approx(-37 - 37 / 60)
    clean = {r["file_id"]: bytes(r["content"]) for r in metadata.strip_metadata(files).collect()}
    assert clean[1] == _jpeg(1)[:20] + b"\xff\xda\0\2scan\xff\xd9"
    assert len(clean[2]) == len(clean[1]) + 36 and metadata.report(clean[2])["orientation"] == 6
    assert clean[3] == png.replace(images._chunk(b"tEXt", b"a\0b"), b"")
    assert rows_of(metadata.facets(metadata.read_metadata(files))) == [("JPEG", "EXIF", 2), ("JPEG", "comment", 2), ("PNG", "text", 1)]


# ---- archives


def test_zip(spark):
    files = spark.createDataFrame([(1, "a", i, n, b"x" * i) for i, n in enumerate(["a.png", "A.png", "b", "a (2).png", "a.png"])], "id long, batch string, pos long, name string, content binary")
    named = relations.unique_names(files, "batch", "pos", "name")
    assert [r["unique_name"] for r in named.orderBy("pos").collect()] == ["a.png", "A (3).png", "b", "a (2).png", "a (4).png"]
    packed = archive.pack_zip(named, ["batch"], most=3).withColumn("file_id", F.col("volume"))
    assert rows_of(packed.select("volume", "n_files")) == [(0, 3), (1, 2)]
    with zipfile.ZipFile(io.BytesIO(packed.where("volume = 0").first()["content"])) as z:
        assert z.testzip() is None and z.namelist() == ["a.png", "A (3).png", "b"]
        offsets = [i.header_offset for i in z.infolist()]
    layout = relations.zip_layout(named.where("pos < 3").withColumn("size", F.length("content").cast("long")), "batch", "pos", "unique_name", "size")
    assert [r["local_at"] for r in layout.orderBy("pos").collect()] == offsets
    bad = spark.createDataFrame([(9, b"no zip"), (10, None)], "file_id long, content binary")
    assert all(r["error"] for r in archive.unzip(bad).collect())


def test_unique_names_of_many_files(spark):
    """Numbers that are taken, in gaps and at the start, and one name on very many files."""
    from pyspark.sql import functions as F

    given = ["a.png"] * 4 + ["a (2).png", "A (4).PNG", "a (5).png", "a (9).png", "a (02).png", "a (0).png"] + ["a.png"] * 5 + ["b"] * 2 + [None, "", "image"]
    rows = [(1, i, g) for i, g in enumerate(given)] + [(2, 0, "a.png"), (2, 1, "a.png")]
    got = {(r["batch"], r["pos"]): r["unique_name"] for r in relations.unique_names(spark.createDataFrame(rows, "batch int, pos long, name string"), "batch", "pos", "name").collect()}
    taken = {int(g.split("(")[1].split(")")[0]) for g in given if g and "(" in g}
    free, seen = (k for k in range(2, 99) if k not in taken), 0
    for i, g in enumerate(given):
        if g == "a.png":
            assert got[1, i] == ("a.png" if seen == 0 else f"a ({next(free)}).png")
            seen += 1
        elif g and "(" in g:
            assert got[1, i] == g
    assert [got[1, i] for i in range(15, 20)] == ["b", "b (2)", "image", "image (2)", "image (3)"] and got[2, 1] == "a (2).png"
    many = spark.range(300_000).select(F.lit(1).alias("batch"), F.col("id").alias("pos"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("x ("), F.col("id").cast("string"), F.lit(")"))).otherwise("x").alias("name"))
    out = relations.unique_names(many, "batch", "pos", "name")
    assert out.select("unique_name").distinct().count() == 300_000


def test_office_round_trip(spark):
    pages = spark.createDataFrame([(1, HTML)], "page_id long, html string")
    docx = archive.write_docx(blocks.html_blocks(pages).where("type <> 'img'"))
    got = [(r["style"], r["text"]) for r in archive.docx_paragraphs(docx, "doc_id").orderBy("ord").collect()]
    assert got[:3] == [("Heading1", "Head it"), (None, "one two\nthree"), (None, "next")] and ("row", "k\tv|w") in got and ("row", "1\t") in got
    rows = spark.createDataFrame([(1, 0, ["Имя", "Город"]), (1, 1, ["Анна <&>", "007"])], "file_id long, row_ord int, cells array<string>")
    assert rows_of(archive.xlsx_cells(archive.write_xlsx(rows)).select("row_ord", "cells")) == [(0, ["Имя", "Город"]), (1, ["Анна <&>", "007"])]


# ---- pages and lookups


def test_page_audits(spark):
    long = "this is one fragment of text that several pages share by heart"
    rows = [
        (1, "http://h/a/", f'<title>x</title><h1>q</h1><p>{long}</p><a href="/b/#z">b</a><a href="c">r</a><a href="http://o/">o</a>'),
        (2, "http://h/b/", f"<p class='k'>{long}</p><li>{long}</li><a class=x href=\"/none/\">n</a>"),
        (3, "http://h/c", ""), (4, None, None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert rows_of(audit.duplicate_fragments(pages)) == [(long, 2, "http://h/a/", "http://h/b/")]
    assert rows_of(audit.broken_links(pages)) == [("/none/", 1, 1)]
    assert {r["page_id"] for r in audit.orphan_pages(pages.where("url IS NOT NULL")).collect()} == {1, 3}
    assert rows_of(audit.redirects(pages)) == [("/a", "/a/"), ("/b", "/b/")]
    kinds = sorted(r["kind"] for r in audit.links(pages).collect())
    assert kinds == ["external", "internal", "internal", "relative"]
    assert audit.page_facts(pages).where("n_h1 = 1").count() == 1
    assert rows_of(audit.breadcrumbs(pages.where("page_id = 1"))) == [(1, 1, "a", "/a")]
    assert audit.duplicate_fragments(pages.limit(0)).count() == 0


def test_lookups(spark):
    items = spark.createDataFrame([(i, "g", [i + 1, 99]) for i in range(1, 8)], "k long, grp string, related array<long>")
    related = relations.related_items(items, "k", "related")
    assert rows_of(related) == [(i, 0, i + 1) for i in range(1, 7)]
    got = relations.filled_related(items, related, "k", "grp")
    assert rows_of(got.where("k = 3")) == [(3, 1, 4), (3, 2, 1), (3, 3, 2), (3, 4, 5)]
    checked = spark.createDataFrame([(1, "jpeg", 600, 800, 1000), (2, "gif", 10, 10, 10**9)], "image_id long, format string, width int, height int, n_bytes long")
    ok = {(r["image_id"], r["rule"]): r["ok"] for r in relations.requirement_check(checked, spark).collect()}
    assert ok[1, "passport"] and not ok[2, "passport"]


def test_even_ranks_and_joins(spark):
    import random

    from docloom.operators import scale

    rng = random.Random(4)
    rows = [(rng.choice("ab") if i % 3 else "hot", i, rng.randrange(9)) for i in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = {(r["k"], r["o"]): r["s"] for r in scale.before(df, ["k"], "o", F.col("v"), "s", stretch=37).collect()}
    assert got == {(k, o): sum(w for j, p, w in rows if j == k and p < o) for k, o, _ in rows}
    facts = df.groupBy("k").agg(F.sum("v").alias("t"))
    joined = scale.rejoined(df, facts, "k", "o")
    assert joined.count() == len(rows) and {(r["k"], r["t"]) for r in joined.collect()} == {tuple(r) for r in facts.collect()}
