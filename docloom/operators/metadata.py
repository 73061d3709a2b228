"""What JPEG and PNG files tell besides their pixels, and files without it."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

REPORT = "format string, found array<string>, make string, model string, orientation int, gps_present boolean, lat double, lon double"
_TEXT = (b"tEXt", b"zTXt", b"iTXt")


def jpeg_segments(b: bytes) -> tuple[list[tuple[int, int, int]], int] | None:
    """((marker, start, end), ...) before the scan, and where that begins; None if the markers don't hold together."""
    if b[:2] != b"\xff\xd8":
        return None
    at, out = 2, []
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            return None
        marker = b[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker == 0xDA:
            return out, at
        elif 0xD0 <= marker <= 0xD8 or marker == 1:
            at += 2
        else:
            end = at + 2 + int.from_bytes(b[at + 2 : at + 4], "big")
            if end > len(b) or end < at + 4:
                return None
            out.append((marker, at, end))
            at = end
    return None


def png_chunks(b: bytes) -> list[tuple[bytes, int, int]]:
    at, out = 8, []
    while at + 12 <= len(b):
        end = at + 12 + int.from_bytes(b[at : at + 4], "big")
        if end > len(b):
            break
        out.append((b[at + 4 : at + 8], at, end))
        at = end
    return out


def read_exif(t: bytes) -> dict:
    """Make, model, orientation and place from a TIFF block; what can't be read is left out."""
    e, out = "<" if t[:2] == b"II" else ">", {}

    def entries(at: int) -> dict:
        if at + 2 > len(t):
            return {}
        n = struct.unpack_from(e + "H", t, at)[0]
        return {struct.unpack_from(e + "H", t, at + 2 + 12 * i)[0]: at + 2 + 12 * i for i in range(n) if at + 14 + 12 * i <= len(t)}

    def text(at: int) -> str:
        n, value = struct.unpack_from(e + "II", t, at + 4)
        start = at + 8 if n <= 4 else value
        return t[start : start + n].split(b"\0")[0].decode("latin-1").strip()

    def degrees(at: int) -> float | None:
        start = struct.unpack_from(e + "I", t, at + 8)[0]
        if start + 24 > len(t):
            return None
        parts = [struct.unpack_from(e + "II", t, start + 8 * i) for i in range(3)]
        return sum((a / b if b else 0.0) / 60**i for i, (a, b) in enumerate(parts))

    ifd = entries(struct.unpack_from(e + "I", t, 4)[0])
    for tag, name in ((0x10F, "make"), (0x110, "model")):
        if tag in ifd:
            out[name] = text(ifd[tag])
    if 0x112 in ifd:
        out["orientation"] = struct.unpack_from(e + "H", t, ifd[0x112] + 8)[0]
    if 0x8825 in ifd:
        out["gps_present"] = True
        gps = entries(struct.unpack_from(e + "I", t, ifd[0x8825] + 8)[0])
        for ref, tag, name, minus in ((1, 2, "lat", "S"), (3, 4, "lon", "W")):
            if ref in gps and tag in gps and (d := degrees(gps[tag])) is not None:
                out[name] = -d if text(gps[ref]) == minus else d
    return out


def _exif_of(b: bytes, start: int, end: int) -> dict:
    try:
        return read_exif(b[start + 10 : end])
    except struct.error:
        return {}


def report(b: bytes) -> dict | None:
    if (scan := jpeg_segments(b)) is not None:
        out: dict = {"format": "JPEG", "found": []}
        for marker, start, end in scan[0]:
            body = b[start + 4 : end]
            if marker == 0xE1 and body.startswith(b"Exif\0\0"):
                out["found"].append("EXIF")
                out |= _exif_of(b, start, end)
            elif marker == 0xE1:
                out["found"].append("XMP")
            elif marker == 0xED:
                out["found"].append("IPTC")
            elif marker == 0xFE:
                out["found"].append("comment")
        return out
    if b[:8] == b"\x89PNG\r\n\x1a\n":
        kinds = {k for k, _, _ in png_chunks(b)}
        names = [("text", _TEXT), ("EXIF", (b"eXIf",)), ("time", (b"tIME",))]
        return {"format": "PNG", "found": [n for n, ks in names if kinds & set(ks)]}
    return None


def strip(b: bytes) -> bytes | None:
    """The file without metadata, pixels untouched; a turned JPEG keeps an EXIF of its orientation alone."""
    if (scan := jpeg_segments(b)) is not None:
        kept, orientation, place = [b[:2]], 1, 1
        for marker, start, end in scan[0]:
            if marker == 0xE1 and b[start + 4 : start + 10] == b"Exif\0\0":
                orientation = _exif_of(b, start, end).get("orientation", orientation)
            if not (marker == 0xE1 or 0xE3 <= marker <= 0xED or marker == 0xFE):
                kept.append(b[start:end])
                place = len(kept) if marker == 0xE0 else place
        if 2 <= orientation <= 8:
            tiff = b"Exif\0\0MM\0*\0\0\0\x08\0\x01" + struct.pack(">HHIHH", 0x112, 3, 1, orientation, 0) + bytes(4)
            kept.insert(place, b"\xff\xe1" + struct.pack(">H", len(tiff) + 2) + tiff)
        return b"".join(kept) + b[scan[1] :]
    if b[:8] == b"\x89PNG\r\n\x1a\n":
        return b[:8] + b"".join(b[s:e] for k, s, e in png_chunks(b) if k not in (*_TEXT, b"eXIf", b"tIME"))
    return None


def read_metadata(files: DataFrame, id_col: str = "file_id") -> DataFrame:
    """id and the report; files of other formats are left out."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fields = [pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.float64(), pa.float64()]
        names = [x.split()[0] for x in REPORT.split(", ")]
        for batch in batches:
            got = [(i, r) for i, b in zip(*(batch.column(c).to_pylist() for c in (0, 1))) if (r := report(b or b"")) is not None]
            cols = [pa.array([r.get(n, False if n == "gps_present" else None) for _, r in got], t) for n, t in zip(names, fields)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in got], batch.column(0).type), *cols], [id_col, *names])

    return files.select(id_col, "content").mapInArrow(run, f"{id_col} {dict(files.dtypes)[id_col]}, {REPORT}")


def strip_metadata(files: DataFrame, id_col: str = "file_id") -> DataFrame:
    """id and content of JPEG and PNG files without their metadata."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            got = [(i, r) for i, b in zip(*(batch.column(c).to_pylist() for c in (0, 1))) if (r := strip(b or b"")) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in got], batch.column(0).type), pa.array([r for _, r in got], pa.binary())], [id_col, "content"])

    return files.select(id_col, "content").mapInArrow(run, f"{id_col} {dict(files.dtypes)[id_col]}, content binary")


def facets(reports: DataFrame) -> DataFrame:
    """How many files of each format hold each kind of metadata."""
    return reports.select("format", F.explode("found").alias("kind")).groupBy("format", "kind").agg(F.count(F.lit(1)).alias("n"))
