"""WARC archives with a two-level capture index.

Captures are range-partitioned and sorted by reversed-host URL key. Each task writes one archive of gzip members, one a
record, and beside it one index file: the sorted entries in compressed blocks of BLOCK lines, then the sparse directory
(first key, place and length of each block) and a footer that tells where it lies. A lookup finds the index files whose
key ranges hold a URL, binary-searches the directory, range-reads the block, and range-reads the record. As archives are
in key order too, the records of a block lie side by side and a scan reads them in one sweep.

Files get names of their own per attempt; only those that Spark's committed table of blocks names exist for readers, so a
lost executor or a second attempt leaves at most a file that nobody reads. Files are opened through pyarrow.fs by URI.

Of captures with equal payloads the one with the smallest page_id is a response and the others revisit it; payloads below
``least_bytes`` are always responses. Null html is an empty payload, a null url an empty one. Null page_ids lose against
any id; where a group has no id, and where the smallest id is repeated, each such row is a response. Line breaks in URLs
are percent-encoded. Other columns are not read. An empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Scratch, read

BLOCK = 500
SWEEP = 4 << 20
#: Index blocks that one task reads back, about.
READ_BLOCKS = 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BLOCKS = "first_key string, index_file string, at long, length long, lines long, archive string"
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


@dataclass(frozen=True)
class Store:
    """A written set of archives: their folder, and the table of index blocks with a row each."""

    root: str
    blocks: DataFrame


def url_key(url: Column) -> Column:
    """com,example,www)/path?query: host reversed and lower-cased, without scheme, user, port and fragment."""
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^#]*)"
    host, rest = F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2)
    key = F.concat(F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    return F.when(F.rlike(url, F.lit(pattern)), key).otherwise(url)


def digest32(hex_sha1: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_sha1)).decode()


def record(page_id, url: str, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record, not compressed. A revisit has the HTTP header alone, which tells the payload's length."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    target = url.replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple:
    """The columns of _RECORD; raises if lengths or the payload's digest don't hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record length")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("payload and digest differ")

    def number(field: str) -> int | None:
        x = fields.get(field, "").removeprefix("<urn:page:").removesuffix(">")
        return int(x) if x else None

    return number("WARC-Record-ID"), size, digest, fields["WARC-Type"], number("WARC-Refers-To"), fields["WARC-Target-URI"]


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _gunzip(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


def _filesystem(uri: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(uri)


def _batch(rows: list, ddl: str):
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = [x.split() for x in ddl.split(", ")]
    cols = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)], [n for n, _ in fields])


def write_archives(pages: DataFrame, scratch: Scratch, least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> Store:
    """Writes pages (page_id, url, html) below the scratch folder; each page's html moves once."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    url = F.coalesce("url", F.lit(""))
    keys = [F.col("page_id").cast("long").alias("page_id"), url_key(url).alias("url_key"), F.sha1(payload).alias("digest")]
    narrow = scratch.write(pages.where(F.length(payload) >= least_bytes).select(*keys), "digests")
    firsts = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = narrow.join(scratch.write(firsts, "firsts"), "digest").where(~F.col("page_id").eqNullSafe(F.col("first")))
    revisits = scratch.write(again.select("url_key", "page_id", "digest", "first").distinct(), "revisits")
    # a page's mark as a revisit travels in front of it, so that no join has to move the html
    marks = revisits.withColumns({"mark": F.lit(0), "url": F.lit(None).cast("string"), "html": F.lit(None).cast("binary")})
    captures = pages.select(*keys, F.lit(None).cast("long").alias("first"), F.lit(1).alias("mark"), url.alias("url"), payload.alias("html"))
    order = ["url_key", "page_id", "digest"]
    dealt = captures.unionByName(marks).repartitionByRange(*order).sortWithinPartitions(*order, "mark")
    root = scratch.path("warc")

    def write(batches: Iterator) -> Iterator:
        import uuid

        from pyspark import TaskContext

        fs, base = _filesystem(root)
        fs.create_dir(base, recursive=True)
        name = f"{base}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        archive = index = None
        at, placed, directory, lines, marked, refers_to = 0, 0, [], [], None, None

        def close_block():
            nonlocal placed
            data = _gzip("\n".join(json.dumps(x) for x in lines).encode())
            index.write(data)
            directory.append((lines[0][0], placed, len(data), len(lines)))
            placed += len(data)
            lines.clear()

        columns = ["url_key", "page_id", "digest", "mark", "first", "url", "html"]
        for batch in batches:
            for key, page_id, digest, mark, first, url, html in zip(*(batch.column(c).to_pylist() for c in columns)):
                if not mark:
                    marked, refers_to = (key, page_id, digest), first
                    continue
                if archive is None:
                    archive, index = fs.open_output_stream(f"{name}.warc.gz", compression=None), fs.open_output_stream(f"{name}.idx", compression=None)
                to = refers_to if marked == (key, page_id, digest) else None
                data = _gzip(record(page_id, url, html, digest32(digest), to, date))
                archive.write(data)
                lines.append((key, page_id, at, len(data)))
                at += len(data)
                if len(lines) == BLOCK:
                    close_block()
        if archive is None:
            return
        if lines:
            close_block()
        listing = _gzip(json.dumps(directory).encode())
        index.write(listing + placed.to_bytes(8, "big") + len(listing).to_bytes(8, "big"))
        archive.close()
        index.close()
        yield _batch([(key, f"{name}.idx", a, n, k, f"{name}.warc.gz") for key, a, n, k in directory], _BLOCKS)

    return Store(root, scratch.write(dealt.mapInArrow(write, _BLOCKS), "blocks"))


def _entries(data: bytes) -> list[list]:
    return [json.loads(x) for x in _gunzip(data).decode().split("\n")]


def _sweep(source, spans: list[tuple[int, int]]) -> Iterator[bytes]:
    """Reads (place, length) in order; spans side by side go in reads of up to SWEEP bytes."""
    i = 0
    while i < len(spans):
        j, end = i, spans[i][0] + spans[i][1]
        while j + 1 < len(spans) and spans[j + 1][0] == end and end + spans[j + 1][1] - spans[i][0] <= SWEEP:
            j += 1
            end += spans[j][1]
        data = source.read_at(end - spans[i][0], spans[i][0])
        for at, n in spans[i : j + 1]:
            yield data[at - spans[i][0] : at - spans[i][0] + n]
        i = j + 1


def read_archives(store: Store) -> DataFrame:
    """Every record of the archives, by way of the index: _RECORD."""
    root = store.root

    def run(batches: Iterator) -> Iterator:
        fs, _ = _filesystem(root)
        for batch in batches:
            for index_file, at, n, archive in zip(*(batch.column(c).to_pylist() for c in ("index_file", "at", "length", "archive"))):
                with fs.open_input_file(index_file) as f:
                    entries = _entries(f.read_at(n, at))
                with fs.open_input_file(archive) as f:
                    yield _batch([parse_record(_gunzip(x)) for x in _sweep(f, [(e[2], e[3]) for e in entries])], _RECORD)

    # one block of the index is some BLOCK records; an explicit number of parts, as the rows of blocks are too few to be left apart
    n = store.blocks.count()
    return store.blocks.repartition(max(1, -(-n // READ_BLOCKS)), "archive", "at").mapInArrow(run, _RECORD)


def _holding(firsts: list[str], key: str) -> range:
    """The places of a sorted list of first keys whose stretches may hold the key."""
    return range(max(bisect.bisect_left(firsts, key) - 1, 0), bisect.bisect_right(firsts, key))


def lookup(urls: DataFrame, store: Store) -> DataFrame:
    """The records of each url (a column of that name): _RECORD, by binary search and range reads.

    The key ranges of the index files go to the tasks: one row per writing task, whatever the number of captures.
    """
    root = store.root
    files = sorted((r["k"], r["index_file"], r["archive"]) for r in store.blocks.groupBy("index_file", "archive").agg(F.min("first_key").alias("k")).collect())
    firsts = [k for k, _, _ in files]

    def run(batches: Iterator) -> Iterator:
        fs, _ = _filesystem(root)
        for batch in batches:
            for key in batch.column("url_key").to_pylist():
                rows = []
                for at in _holding(firsts, key):
                    with fs.open_input_file(files[at][1]) as f:
                        size = f.size()
                        tail = f.read_at(16, size - 16)
                        start, n = int.from_bytes(tail[:8], "big"), int.from_bytes(tail[8:], "big")
                        directory = json.loads(_gunzip(f.read_at(n, start)))
                        blocks = [directory[i] for i in _holding([d[0] for d in directory], key)]
                        found = [e for _, b, n, _ in blocks for e in _entries(f.read_at(n, b)) if e[0] == key]
                    if found:
                        with fs.open_input_file(files[at][2]) as f:
                            rows += [parse_record(_gunzip(x)) for x in _sweep(f, [(e[2], e[3]) for e in found])]
                yield _batch(rows, _RECORD)

    keys = urls.select(url_key(F.coalesce("url", F.lit(""))).alias("url_key")).distinct()
    return keys.mapInArrow(run, _RECORD)


def op1_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = write_archives(read(spark, sf_dir, "pages"), Scratch(spark, "warc"))
    return read_archives(store).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CHUNK = "CAST(('0x' || h[5 * i + 1 : 5 * i + 5]) AS INTEGER)"
_LETTERS = " || ".join(f"'{_BASE32}'[(({_CHUNK} >> {shift}) & 31) + 1]" for shift in (15, 10, 5, 0))
ORACLE = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(8), lambda i: {_LETTERS}), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
