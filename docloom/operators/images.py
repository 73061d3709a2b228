"""Images as rows: reading, resizing, turning, flattening and writing, with a status per row.

An image is (width, height, rgba): pixels row by row, four bytes each, straight alpha. The formats are small containers
around such rows: PNG, BMP, PNM, TGA, TIFF and ICO. What has no codec here comes out as an error row, never as another format.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

IMAGE = "width int, height int, rgba binary"


# ---- readers: bytes to height x width x 4


def _read_png(data: bytes) -> np.ndarray:
    at, idat, palette, alpha = 8, b"", None, None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = np.frombuffer(body, np.uint8)
        elif kind == b"IDAT":
            idat += body
        at += 12 + n
    if depth != 8 or interlaced:
        raise ValueError("only 8-bit PNG without interlace")
    k = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    lines = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(h, 1 + w * k)
    out = np.zeros((h, w * k), np.uint8)
    for y in range(h):
        kind, line = lines[y, 0], lines[y, 1:].copy()
        up = out[y - 1] if y else np.zeros(w * k, np.uint8)
        if kind == 1:
            line = np.cumsum(line.reshape(w, k), 0, dtype=np.uint8).ravel()
        elif kind == 2:
            line = line + up
        elif kind in (3, 4):
            done = np.zeros(w * k + k, np.int32)
            above = np.concatenate((np.zeros(k, np.int32), up))
            for i in range(w * k):
                a, b, c = int(done[i]), int(above[i + k]), int(above[i])
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                done[i + k] = (int(line[i]) + guess) & 255
            line = done[k:].astype(np.uint8)
        out[y] = line
    px = out.reshape(h, w, k)
    full = np.full((h, w, 4), 255, np.uint8)
    if color == 3:
        full[..., :3] = palette[px[..., 0]]
        if alpha is not None:
            full[..., 3] = np.concatenate((alpha, np.full(256 - len(alpha), 255, np.uint8)))[px[..., 0]]
    elif k <= 2:
        full[..., :3] = px[..., :1]
    else:
        full[..., :3] = px[..., :3]
    if k in (2, 4):
        full[..., 3] = px[..., -1]
    return full


def _read_bmp(data: bytes) -> np.ndarray:
    start, w, h, bits = (struct.unpack_from(f, data, at)[0] for f, at in (("<I", 10), ("<i", 18), ("<i", 22), ("<H", 28)))
    if bits not in (24, 32):
        raise ValueError("only 24 and 32-bit BMP")
    k, rows = bits // 8, abs(h)
    line = (w * k + 3) // 4 * 4
    px = np.frombuffer(data, np.uint8, line * rows, start).reshape(rows, line)[:, : w * k].reshape(rows, w, k)
    full = np.full((rows, w, 4), 255, np.uint8)
    full[..., :3] = px[..., 2::-1]
    return full if h < 0 else full[::-1]


def _read_pnm(data: bytes) -> np.ndarray:
    import re

    kind, at, fields = data[1] - 48, 2, []
    while len(fields) < (2 if kind in (1, 4) else 3):
        m = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(data, at)
        if not m:
            raise ValueError("bad Netpbm header")
        fields.append(int(m[1]))
        at = m.end()
    w, h, top = fields[0], fields[1], (fields + [1])[2]
    k = 3 if kind in (3, 6) else 1
    if kind == 4:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, (w + 7) // 8 * h, at + 1).reshape(h, -1), axis=1)[:, :w]
        v = (1 - bits).reshape(h, w, 1) * 255
    elif kind == 1:
        bits = [c - 48 for c in re.sub(rb"#[^\n]*", b"", data[at:]) if c in b"01"][: w * h]
        v = (1 - np.array(bits)).reshape(h, w, 1) * 255
    elif kind in (2, 3):
        v = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[: w * h * k], np.int64).reshape(h, w, k) * 255 // top
    else:
        v = np.frombuffer(data, np.uint8 if top < 256 else ">u2", w * h * k, at + 1).reshape(h, w, k).astype(np.int64) * 255 // top
    full = np.full((h, w, 4), 255, np.uint8)
    full[..., :3] = v
    return full


def _read_tga(data: bytes) -> np.ndarray:
    skip, mapped, kind = data[0], data[1], data[2]
    w, h, bits, flags = struct.unpack_from("<HHBB", data, 12)
    if mapped or kind not in (2, 3, 10, 11) or bits not in (8, 24, 32):
        raise ValueError("TGA of another kind")
    k, body = bits // 8, data[18 + skip :]
    if kind >= 10:
        out, at = bytearray(), 0
        while len(out) < w * h * k:
            n = (body[at] & 127) + 1
            if body[at] & 128:
                out += body[at + 1 : at + 1 + k] * n
                at += 1 + k
            else:
                out += body[at + 1 : at + 1 + n * k]
                at += 1 + n * k
        body = bytes(out)
    px = np.frombuffer(body, np.uint8, w * h * k).reshape(h, w, k)
    full = np.full((h, w, 4), 255, np.uint8)
    full[..., :3] = px[..., 2::-1] if k > 1 else px
    if k == 4 and flags & 15:
        full[..., 3] = px[..., 3]
    full = full if flags & 32 else full[::-1]
    return full[:, ::-1] if flags & 16 else full


def _read_tiff(data: bytes) -> np.ndarray:
    e = "<" if data[:2] == b"II" else ">"
    at = struct.unpack_from(e + "I", data, 4)[0]
    sizes, tags = {1: "B", 3: "H", 4: "I"}, {}
    for i in range(struct.unpack_from(e + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(e + "HHI", data, at + 2 + 12 * i)
        if kind in sizes:
            one = sizes[kind]
            place = at + 10 + 12 * i
            if n * struct.calcsize(one) > 4:
                place = struct.unpack_from(e + "I", data, place)[0]
            tags[tag] = struct.unpack_from(f"{e}{n}{one}", data, place)
    w, h, k = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
    packing, photometric = tags.get(259, (1,))[0], tags.get(262, (1,))[0]
    if set(tags.get(258, (8,))) != {8} or packing not in (1, 32773) or photometric > 2 or tags.get(284, (1,))[0] != 1:
        raise ValueError("TIFF of another kind")
    body = b"".join(data[o : o + n] for o, n in zip(tags[273], tags[279]))
    if packing == 32773:
        body = _unpack_bits(body)
    px = np.frombuffer(body, np.uint8, w * h * k).reshape(h, w, k)
    full = np.full((h, w, 4), 255, np.uint8)
    full[..., :3] = px[..., :3] if k >= 3 else 255 - px[..., :1] if photometric == 0 else px[..., :1]
    if k in (2, 4):
        full[..., 3] = px[..., -1]
    return full


def _unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


# ---- writers: pixels to bytes


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _write_png(px: np.ndarray) -> bytes:
    h, w, _ = px.shape
    lines = np.concatenate((np.zeros((h, 1), np.uint8), px.reshape(h, w * 4)), 1)
    head = struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes())) + _chunk(b"IEND", b"")


def flatten(px: np.ndarray, ground: tuple[int, int, int] = (255, 255, 255)) -> np.ndarray:
    a = px[..., 3:].astype(np.int64)
    out = px.copy()
    out[..., :3] = ((a * px[..., :3] + (255 - a) * np.array(ground)) * 2 + 255) // 510
    out[..., 3] = 255
    return out


def _write_bmp(px: np.ndarray) -> bytes:
    h, w, _ = px.shape
    line = (w * 3 + 3) // 4 * 4
    rows = np.zeros((h, line), np.uint8)
    rows[:, : w * 3] = flatten(px)[::-1, :, 2::-1].reshape(h, w * 3)
    head = b"BM" + struct.pack("<IHHI", 54 + h * line, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, h * line, 2835, 2835, 0, 0)
    return head + rows.tobytes()


def _write_tga(px: np.ndarray) -> bytes:
    h, w, _ = px.shape
    return struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, w, h, 32, 0x28) + np.ascontiguousarray(px[..., [2, 1, 0, 3]]).tobytes()


def _write_ppm(px: np.ndarray) -> bytes:
    h, w, _ = px.shape
    return f"P6\n{w} {h}\n255\n".encode() + flatten(px)[..., :3].tobytes()


def _write_pgm(px: np.ndarray) -> bytes:
    h, w, _ = px.shape
    f = flatten(px).astype(np.int64)
    return f"P5\n{w} {h}\n255\n".encode() + ((f[..., 0] * 299 + f[..., 1] * 587 + f[..., 2] * 114 + 500) // 1000).astype(np.uint8).tobytes()


def _write_tiff(px: np.ndarray) -> bytes:
    h, w, _ = px.shape
    tags = [
        (256, 4, 1, w), (257, 4, 1, h), (258, 3, 4, 182), (259, 3, 1, 1), (262, 3, 1, 2), (273, 4, 1, 206), (277, 3, 1, 4), (278, 4, 1, h),
        (279, 4, 1, w * h * 4), (282, 5, 1, 190), (283, 5, 1, 198), (284, 3, 1, 1), (296, 3, 1, 2), (338, 3, 1, 2),
    ]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + bytes(4)
    return b"II*\0" + struct.pack("<I", 8) + ifd + struct.pack("<4H4I", 8, 8, 8, 8, 72, 1, 72, 1) + px.tobytes()


def _write_ico(px: np.ndarray, sides: tuple[int, ...] = (16, 32, 48, 256)) -> bytes:
    entries, bodies, at = b"", b"", 6 + 16 * len(sides)
    for side in sorted(sides):
        body = _write_png(contained(px, side))
        entries += struct.pack("<BBBBHHII", side % 256, side % 256, 0, 0, 1, 32, len(body), at)
        bodies += body
        at += len(body)
    return struct.pack("<HHH", 0, 1, len(sides)) + entries + bodies


def contained(px: np.ndarray, side: int) -> np.ndarray:
    """The image in the middle of a transparent square."""
    k = min(side / px.shape[1], side / px.shape[0])
    small = resample(px, max(1, round(px.shape[1] * k)), max(1, round(px.shape[0] * k)))[:side, :side]
    out = np.zeros((side, side, 4), np.uint8)
    y, x = (side - small.shape[0]) // 2, (side - small.shape[1]) // 2
    out[y : y + small.shape[0], x : x + small.shape[1]] = small
    return out


def _read_ico(data: bytes) -> np.ndarray:
    """The largest PNG entry."""
    n = struct.unpack_from("<H", data, 4)[0]
    entries = [struct.unpack_from("<BBBBHHII", data, 6 + 16 * i) for i in range(n)]
    for e in sorted(entries, key=lambda e: -(e[0] or 256)):
        body = data[e[7] : e[7] + e[6]]
        if body[:4] == b"\x89PNG":
            return _read_png(body)
    raise ValueError("ICO without a PNG entry")


READERS: dict[str, Callable[[bytes], np.ndarray]] = {"PNG": _read_png, "BMP": _read_bmp, "PNM": _read_pnm, "TGA": _read_tga, "TIFF": _read_tiff, "ICO": _read_ico}
WRITERS: dict[str, Callable[[np.ndarray], bytes]] = {"png": _write_png, "bmp": _write_bmp, "tga": _write_tga, "ppm": _write_ppm, "pgm": _write_pgm, "tiff": _write_tiff, "ico": _write_ico}


def register(kind: str, reader: Callable | None = None, writer: Callable | None = None) -> None:
    """Adds a reader by label or a writer by format id; a later one replaces an earlier."""
    if reader:
        READERS[kind] = reader
    if writer:
        WRITERS[kind] = writer


# ---- row operators


def _per_row(rows: DataFrame, make: Callable, out: str) -> DataFrame:
    """Keeps all columns and adds those of out, error and status; a row that fails is told why."""
    import pyarrow as pa

    names = [x.split()[0] for x in out.split(", ")]
    kinds = {"int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    types = [kinds[x.split()[1]] for x in out.split(", ")]
    kept = rows.columns

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            errors = []
            for i in range(batch.num_rows):
                try:
                    got, error = make({c: batch.column(c)[i].as_py() for c in kept}), None
                except Exception as e:  # one bad file must not end the batch
                    got, error = (None,) * len(names), str(e) or type(e).__name__
                for col, v in zip(cols, got):
                    col.append(v)
                errors.append(error)
            status = ["error" if e else "done" for e in errors]
            arrays = [*batch.columns, *(pa.array(c, t) for c, t in zip(cols, types)), pa.array(status), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, *names, "status", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {out}, status string, error string"
    return rows.mapInArrow(run, schema)


def _pixels(row: dict) -> np.ndarray:
    return np.frombuffer(row["rgba"], np.uint8).reshape(row["height"], row["width"], 4)


def decode(files: DataFrame) -> DataFrame:
    """files (label, content) with width, height, rgba, status, error."""
    readers = dict(READERS)

    def one(row: dict):
        if row["label"] not in readers:
            raise ValueError(f"no reader for {row['label']}")
        px = readers[row["label"]](row["content"])
        if not px.size:
            raise ValueError("empty image")
        return px.shape[1], px.shape[0], np.ascontiguousarray(px).tobytes()

    return _per_row(files, one, IMAGE)


def encode(images: DataFrame, fmt: str) -> DataFrame:
    """images (width, height, rgba) with content, status, error; svg and datauri are made of a PNG in Spark."""
    inner = "png" if fmt in ("svg", "datauri") else fmt
    writers = dict(WRITERS)

    def one(row: dict):
        if inner not in writers:
            raise ValueError(f"no writer for {fmt}")
        return (writers[inner](_pixels(row)),)

    done = _per_row(images.drop("content", "status", "error"), one, "content binary")
    if fmt == "datauri":
        return done.withColumn("content", data_uri(F.col("content")).cast("binary"))
    if fmt == "svg":
        size = [F.concat(F.lit(f' {k}="'), F.col(k).cast("string"), F.lit('"')) for k in ("width", "height")]
        return done.withColumn(
            "content",
            F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg"'), *size, F.lit("><image"), *size, F.lit(' href="'), data_uri(F.col("content")), F.lit('"/></svg>')).cast("binary"),
        )
    return done


def data_uri(png: Column) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64(png), r"\s", ""))


def resample(px: np.ndarray, w: int, h: int) -> np.ndarray:
    """Mean of the source over each target pixel when shrinking, nearest pixel when growing; alpha weighs colours."""
    for axis, n in ((0, h), (1, w)):
        m = px.shape[axis]
        if n >= m:
            px = np.take(px, np.minimum((np.arange(n) * 2 + 1) * m // (2 * n), m - 1), axis)
        else:
            edges = np.arange(n + 1) * m // n
            f = px.astype(np.float64)
            f[..., :3] *= f[..., 3:]
            total = np.add.reduceat(f, edges[:-1], axis)
            count = np.diff(edges).reshape((-1, 1, 1) if axis == 0 else (1, -1, 1))
            a = total[..., 3:]
            rgb = np.divide(total[..., :3], a, out=np.zeros_like(total[..., :3]), where=a > 0)
            px = np.floor(np.concatenate((rgb, a / count), -1) + 0.5).astype(np.uint8)
    return px


def transform(images: DataFrame, width: Column, height: Column, mode: str = "exact", rotate: int = 0, flip_h: bool = False, flip_v: bool = False) -> DataFrame:
    """images resized (exact, cover: the middle is cut out, pad: white margins), flipped and turned by quarters clockwise."""

    def one(row: dict):
        px, w, h = _pixels(row), row["to_width"], row["to_height"]
        if mode in ("cover", "pad"):
            k = (max if mode == "cover" else min)(w / px.shape[1], h / px.shape[0])
            px = resample(px, max(1, round(px.shape[1] * k)), max(1, round(px.shape[0] * k)))
            y, x = (px.shape[0] - h) // 2, (px.shape[1] - w) // 2
            if mode == "cover":
                px = px[max(y, 0) :, max(x, 0) :][:h, :w]
            else:
                ground = np.full((h, w, 4), 255, np.uint8)
                part = flatten(px)[:h, :w]
                ground[max(-y, 0) : max(-y, 0) + part.shape[0], max(-x, 0) : max(-x, 0) + part.shape[1]] = part
                px = ground
        else:
            px = resample(px, w, h)
        px = px[:, ::-1] if flip_h else px
        px = px[::-1] if flip_v else px
        px = np.rot90(px, -(rotate // 90) % 4)
        return px.shape[1], px.shape[0], np.ascontiguousarray(px).tobytes()

    sized = images.drop("status", "error").withColumns({"to_width": width.cast("int"), "to_height": height.cast("int")})
    done = _per_row(sized, one, "new_width int, new_height int, new_rgba binary")
    keep = [c for c in images.columns if c not in ("width", "height", "rgba", "status", "error")]
    return done.select(*keep, F.col("new_width").alias("width"), F.col("new_height").alias("height"), F.col("new_rgba").alias("rgba"), "status", "error")


def explode_pixels(images: DataFrame, id_col: str) -> DataFrame:
    """Pixel rows (image_id, y, x, r, g, b, a), without Python."""
    at = F.col("i")
    p = images.select(F.col(id_col).alias("image_id"), "width", "rgba", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i"))

    def byte(k: int) -> Column:
        return F.conv(F.hex(F.substring(F.col("rgba"), at * 4 + k + 1, F.lit(1))), 16, 10).cast("int")

    return p.select(
        "image_id", F.floor(at / F.col("width")).cast("int").alias("y"), (at % F.col("width")).alias("x"), *(byte(k).alias(c) for k, c in enumerate("rgba"))
    )
