"""Archives and office files: ZIP packing and listing, DOCX and XLSX in and out."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_PLAIN_DATE = (2000, 1, 1, 0, 0, 0)

# The parts that every DOCX and XLSX has.
_DOCX = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
}
_XLSX = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
}


def _zip(parts: list[tuple[str, bytes | str]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in parts:
            z.writestr(zipfile.ZipInfo(name, _PLAIN_DATE), data)
    return out.getvalue()


def pack_zip(files: DataFrame, batch: list[str], most: int = 1000) -> DataFrame:
    """files (batch columns, pos, unique_name, content) to archives (batch columns, volume, n_files, content).

    An archive takes at most ``most`` files by pos, so that a batch of any size is never one task's.
    """
    volumes = files.withColumn("volume", F.floor(F.col("pos") / most).cast("long"))
    inner = F.array_sort(F.collect_list(F.struct("pos", "unique_name", "content")))
    grouped = volumes.groupBy(*batch, "volume").agg(inner.alias("files"), F.count(F.lit(1)).alias("n_files"))
    kept = [*batch, "volume", "n_files"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            content = [_zip([(f["unique_name"], f["content"] or b"") for f in fs]) for fs in b.column("files").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(content, pa.binary())], [*kept, "content"])

    schema = ", ".join(f"{c} {t}" for c, t in grouped.select(*kept).dtypes) + ", content binary"
    return grouped.mapInArrow(run, schema)


def _from_zip(files: DataFrame, id_col: str, rows_of, schema: str) -> DataFrame:
    """One file to many rows; a file that can't be opened gives one row with its error."""
    names = [id_col, *(x.split(" ", 1)[0] for x in schema.split(", ")), "error"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = []
            for i, content in zip(*(b.column(c).to_pylist() for c in (0, 1))):
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                        out += [(i, *row, None) for row in rows_of(z)]
                except Exception as e:  # one bad file must not end the batch
                    out.append((i, *(None,) * (len(names) - 2), str(e) or type(e).__name__))
            cols = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    import pyarrow as pa

    kinds = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
    types = [pa.int64(), *(kinds[x.split(" ", 1)[1]] for x in schema.split(", ")), pa.string()]
    return files.select(F.col(id_col).cast("long"), "content").mapInArrow(run, f"{id_col} long, {schema}, error string")


def unzip(files: DataFrame, id_col: str = "file_id") -> DataFrame:
    """Entries of archives: id, ord, name, size, content, error."""

    def rows(z):
        for i, info in enumerate(z.infolist()):
            yield i, info.filename, info.file_size, z.read(info)

    return _from_zip(files, id_col, rows, "ord int, name string, size long, content binary")


def docx_paragraphs(files: DataFrame, id_col: str = "file_id") -> DataFrame:
    """Paragraphs of DOCX files: id, ord, style, text, error; cells of a table row are parted by tabs."""

    def text(p) -> str:
        return "".join(t.text or "" if t.tag == _W + "t" else "\n" for t in p.iter() if t.tag in (_W + "t", _W + "br"))

    def rows(z):
        body, n = ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body"), 0
        for e in body:
            if e.tag == _W + "p":
                style = e.find(f"{_W}pPr/{_W}pStyle")
                yield n, style.get(_W + "val") if style is not None else None, text(e)
                n += 1
            elif e.tag == _W + "tbl":
                for tr in e.iter(_W + "tr"):
                    yield n, "row", "\t".join(" ".join(text(p) for p in tc.iter(_W + "p")) for tc in tr.iter(_W + "tc"))
                    n += 1

    return _from_zip(files, id_col, rows, "ord int, style string, text string")


def xlsx_cells(files: DataFrame, id_col: str = "file_id") -> DataFrame:
    """Rows of XLSX files: id, sheet_ord, row_ord, cells, error."""

    def column(ref: str) -> int:
        n = 0
        for ch in ref:
            if ch.isalpha():
                n = n * 26 + ord(ch) - 64
        return n

    def rows(z):
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(_S + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        sheets = sorted((n for n in z.namelist() if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n))
        for k, name in enumerate(sheets):
            for r, row in enumerate(ElementTree.fromstring(z.read(name)).iter(_S + "row")):
                cells: list[str] = []
                for c in row.iter(_S + "c"):
                    at = column(c.get("r", "")) or len(cells) + 1
                    cells += [""] * (at - len(cells))
                    value = "".join(t.text or "" for t in c.iter() if t.tag in (_S + "v", _S + "t"))
                    cells[at - 1] = shared[int(value)] if c.get("t") == "s" else value
                yield k, r, cells

    return _from_zip(files, id_col, rows, "sheet_ord int, row_ord int, cells array<string>")


def _write(grouped: DataFrame, by: str, make) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(by), pa.array([make(x) for x in b.column("xs").to_pylist()], pa.binary())], [by, "content"])

    return grouped.select(by, "xs").mapInArrow(run, f"{by} {dict(grouped.dtypes)[by]}, content binary")


def write_docx(blocks: DataFrame) -> DataFrame:
    """doc_id, content: a DOCX per document from block rows; headings, paragraphs, items, tables, page breaks."""

    def paragraph(runs, style=None, mark="") -> str:
        head = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        body = "".join(
            f'<w:r><w:rPr>{"<w:b/>" if r["bold"] else ""}{"<w:i/>" if r["italic"] else ""}</w:rPr><w:t xml:space="preserve">{escape(r["text"])}</w:t></w:r>' for r in runs
        )
        return f'<w:p>{head}{f"<w:r><w:t>{mark}</w:t></w:r>" if mark else ""}{body}</w:p>'

    def make(xs) -> bytes:
        out = []
        for b in xs:
            if b["type"] in ("h", "p"):
                out.append(paragraph(b["runs"], f"Heading{b['level']}" if b["type"] == "h" else None))
            elif b["type"] == "li":
                out.append(paragraph(b["runs"], None, "  " * (b["depth"] or 0) + (f"{b['idx']}. " if b["ordered"] else "• ")))
            elif b["type"] == "code":
                out.append(paragraph([{"text": b["text"], "bold": False, "italic": False}]))
            elif b["type"] == "pagebreak":
                out.append('<w:p><w:r><w:br w:type="page"/></w:r></w:p>')
            elif b["type"] == "table":
                width = max(map(len, b["rows"]))
                rows = ["".join(f"<w:tc>{paragraph([{'text': c, 'bold': False, 'italic': False}])}</w:tc>" for c in r + [""] * (width - len(r))) for r in b["rows"]]
                out.append("<w:tbl>" + "".join(f"<w:tr>{r}</w:tr>" for r in rows) + "</w:tbl>")
        body = f'<w:document xmlns:w="{_W[1:-1]}"><w:body>{"".join(out)}</w:body></w:document>'
        return _zip([*_DOCX.items(), ("word/document.xml", body)])

    fields = ["ord", "type", "level", "ordered", "idx", "depth", "runs", "rows", "text"]
    grouped = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("xs"))
    return _write(grouped, "doc_id", make)


def write_xlsx(cells: DataFrame) -> DataFrame:
    """file_id, content: a workbook of one sheet per file from cell rows (file_id, row_ord, cells); all cells are text."""

    def make(xs) -> bytes:
        rows = ["".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(c or "")}</t></is></c>' for c in x["cells"]) for x in xs]
        sheet = f'<worksheet xmlns="{_S[1:-1]}"><sheetData>{"".join(f"<row>{r}</row>" for r in rows)}</sheetData></worksheet>'
        book = f'<workbook xmlns="{_S[1:-1]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>'
        rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>'
        return _zip([*_XLSX.items(), ("xl/workbook.xml", book), ("xl/_rels/workbook.xml.rels", rels), ("xl/worksheets/sheet1.xml", sheet)])

    grouped = cells.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("row_ord", "cells"))).alias("xs"))
    return _write(grouped, "file_id", make)
