"""Substring de-duplication by recompression: locally consistent symbols find repeats, window hashes verify them.

Every text is parsed in rounds. A round names maximal runs of a symbol and then pairs of neighbours, the left one from
one half of the alphabet and the right one from the other; names are hashes of what they stand for, so that all tasks
name alike without exchanging a dictionary. Each symbol knows its context: the words that decide it. A symbol whose
context lies within a window is an interior symbol of that window, and every occurrence of the window has it. Each
window of WINDOW words is filed under one interior symbol of the highest round that has any: that of least hash, so that
neighbouring windows mostly share it. (Without long runs three rounds always leave some: they cost at most 1 + 2 + 4 words
at either edge. Windows within a run fall back to earlier rounds and at last to single words.)

A window can only repeat if its symbol and that symbol's context do, so what occurs once is done with. For the others
Spark counts 96-bit hashes, first of whole stretches of windows that are filed together and then, where a stretch is no
copy, of its windows; it takes the earliest place of each, and marks every later one. Counting comes before meeting: a
passage held by a third of all documents reaches a task as one row per map task; joins back on such keys are skewed joins
between written tables, which Spark splits.

Null texts have no words. Null doc_ids count as smaller than any id. Rows that repeat a doc_id are told apart by their
texts, the order among them being that of a hash; rows equal in both are judged as one document each. Texts of less than
WINDOW words lose nothing. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, read, utf8
from .native import sized

WINDOW = 20
#: Bytes of text parsed at once in a Python worker; a longer document is parsed alone.
CHUNK_BYTES = 500_000
LONG_WORD = 32
ROUNDS = 3

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def salt(n: int) -> np.uint64:
    return np.uint64((n + 1) * _STEP % 2**64)


_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_BYTE = mix(np.arange(256, dtype=np.uint64) + salt(9))
_BASE = 0x9E3779B97F4A7C13
_NEXT_BLANK = re.compile(rb"[ \t\n\r\x0b\x0c]")


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, modulo 2**64."""
    return _power(_BASE, n), _power(pow(_BASE, -1, 2**64), n)


def _piece_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of a piece with a blank at either end."""
    from xxhash import xxh64_intdigest

    raw = np.frombuffer(data, np.uint8)
    blank = _BLANK[raw]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    up, down = _powers(1 << len(raw).bit_length())
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    out = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[i] = xxh64_intdigest(data[starts[i] : ends[i]])
    return out, starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words begin (and the last one's end).

    Words of up to LONG_WORD bytes are hashed at once, by prefix sums of a polynomial in their (mixed) bytes; longer ones
    one by one, as such polynomials can't tell some long words of a pattern apart.
    """
    data = b" ".join([b"", *texts, b""])
    hashes, starts, at = [], [], 0
    while at < len(data) - 1:
        cut = len(data) - 1
        if cut - at > 2 * CHUNK_BYTES:
            found = _NEXT_BLANK.search(data, at + CHUNK_BYTES)
            cut = found.start() if found else cut
        h, s = _piece_hashes(data[at : cut + 1])
        hashes.append(h)
        starts.append(s + at)
        at = cut
    begins = np.cumsum([1] + [len(t) + 1 for t in texts])
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), begins)


def _round(sym, cl, cr, doc, turn, first, last):
    """One round: runs, then pairs. first and last hold, by document, places just outside of it."""
    new = np.ones(len(sym), bool)
    new[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    base, d = sym[at], doc[at]
    length = np.diff(np.append(at, len(sym)))
    same = d[1:] == d[:-1]
    # a run is decided with the symbols beside it
    left, right = first[d], last[d]
    left[1:] = np.where(same, cl[at[1:] - 1], left[1:])
    right[:-1] = np.where(same, cr[at[1:]], right[:-1])
    name = np.where(length > 1, mix(base ^ mix(length.astype(np.uint64) + salt(0))), base)
    half = mix(base + salt(turn)) & np.uint64(1) == 0
    pair = half[:-1] & ~half[1:] & same
    keep = np.flatnonzero(~np.concatenate(([False], pair)))
    paired = np.append(pair, False)[keep]
    second = np.minimum(keep + 1, len(base) - 1)
    return (
        np.where(paired, mix(name[keep] * np.uint64(3) + mix(name[second])), name[keep]),
        left[keep],
        np.where(paired, right[second], right[keep]),
        d[keep],
    )


def _least(priority: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the smallest priority in each range lo..hi; the leftmost of equals."""
    table = [(priority.astype(np.int64) << np.int64(31)) | np.arange(len(priority))]
    while 2 ** len(table) <= WINDOW:
        step, t = 2 ** (len(table) - 1), table[-1]
        table.append(np.append(np.minimum(t[:-step], t[step:]), t[max(len(t) - step, 0) :]))
    depth = np.log2(hi - lo + 1).astype(np.int64)
    stacked = np.stack(table)
    return np.minimum(stacked[depth, lo], stacked[depth, hi + 1 - (1 << depth)]) & 0x7FFFFFFF


def _power(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def file_windows(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, n, key): stretches of n windows filed under one interior symbol; offsets part the words into documents."""
    lengths = np.diff(offsets)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.flatnonzero(np.arange(len(hashes)) + WINDOW <= offsets[1:][doc])
    if not len(starts):
        return starts, starts, np.empty(0, np.uint64)
    first, last = offsets[:-1] - 1, offsets[1:] + 1
    rounds = [(hashes, np.arange(len(hashes)), np.arange(1, len(hashes) + 1), doc)]
    for turn in range(1, ROUNDS + 1):
        rounds.append(_round(*rounds[-1], turn, first, last))
    symbol, left, right = (np.empty(len(starts), np.int64) for _ in range(3))
    open_ = np.arange(len(starts))
    for turn in range(ROUNDS, -1, -1):
        sym, cl, cr, _ = rounds[turn]
        s = starts[open_]
        lo, hi = np.searchsorted(cl, s), np.searchsorted(cr, s + WINDOW, "right") - 1
        has = hi >= lo
        now = open_[has]
        if len(now):
            j = _least(mix(sym + salt(turn)) >> np.uint64(32), lo[has], hi[has])
            symbol[now], left[now], right[now] = (turn << 40) + j, cl[j], cr[j]
        open_ = open_[~has]
    cut = np.flatnonzero(np.concatenate(([True], (symbol[1:] != symbol[:-1]) | (starts[1:] != starts[:-1] + 1))))
    # the key is a hash of the words in the symbol's context
    left, right = left[cut], right[cut]
    up, down = _powers(1 << len(hashes).bit_length())
    sums = np.concatenate(([np.uint64(0)], np.add.accumulate(hashes * up[: len(hashes)])))
    key = mix((sums[right] - sums[left]) * down[left] + (right - left).astype(np.uint64))
    return starts[cut], np.diff(np.append(cut, len(starts))), key


def window_hashes(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of the windows at starts."""
    a, b = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    mixed = mix(hashes + salt(7))
    for i in range(WINDOW):
        a += hashes[starts + i] * (mix(np.array([salt(200 + i)])) | np.uint64(1))
        b += mixed[starts + i] * (mix(np.array([salt(300 + i)])) | np.uint64(1))
    return mix(a).view(np.int64), (mix(b) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _chunks(batches: Iterator, names: list[str]) -> Iterator:
    """(columns of names, word hashes, offsets) of as many rows as make up a chunk of text."""
    held, texts, total = [], [], 0
    for batch in batches:
        for *row, text in zip(*(batch.column(n).to_pylist() for n in names), utf8(batch, "text")):
            if held and total + len(text) > CHUNK_BYTES:
                yield [list(c) for c in zip(*held)], *word_hashes(texts)
                held, texts, total = [], [], 0
            held.append(row)
            texts.append(text)
            total += len(text)
    if held:
        yield [list(c) for c in zip(*held)], *word_hashes(texts)


def _filed(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for (ids, tags), hashes, offsets in _chunks(batches, ["doc_id", "tag"]):
        start, n, key = file_windows(hashes, offsets)
        doc = np.searchsorted(offsets, start, "right") - 1
        row = pa.array(doc)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(key.view(np.int64)), pa.array(ids, pa.int64()).take(row), pa.array(tags, pa.int64()).take(row),
                pa.array((start - offsets[doc]).astype(np.int32)), pa.array(n.astype(np.int32)),
            ],
            ["key", "doc_id", "tag", "start", "n"],
        )


_STRETCHES = "h long, g int, doc_id long, tag long, start int, n int, windows binary"
_WINDOW = np.dtype([("a", "<i8"), ("b", "<i4")])


def _stretch_hashes(a: np.ndarray, b: np.ndarray, within: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of stretches from the hashes of their windows and the windows' places within."""
    if not len(first):
        return np.empty(0, np.int64), np.empty(0, np.int32)
    turn = mix(within.astype(np.uint64) + salt(8)) | np.uint64(1)
    h = np.add.reduceat(a.view(np.uint64) * turn, first)
    g = np.add.reduceat(mix(b.astype(np.uint64) + a.view(np.uint64)) * turn, first)
    return mix(h).view(np.int64), (mix(g) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _hashed(batches: Iterator) -> Iterator:
    """Each stretch with its hash and with those of its windows."""
    import pyarrow as pa

    for (ids, tags, parts), hashes, offsets in _chunks(batches, ["doc_id", "tag", "parts"]):
        doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        start = np.array([x["start"] for p in parts for x in p], np.int64)
        n = np.array([x["n"] for p in parts for x in p], np.int64)
        first = np.cumsum(n) - n
        within = np.arange(n.sum()) - np.repeat(first, n)
        a, b = window_hashes(hashes, np.repeat(offsets[doc] + start, n) + within)
        h, g = _stretch_hashes(a, b, within, first)
        held = np.empty(len(a), _WINDOW)
        held["a"], held["b"] = a, b
        bounds = (np.append(first, len(a)) * _WINDOW.itemsize).astype(np.int32)
        windows = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(held.tobytes())])
        row = pa.array(doc)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(h), pa.array(g), pa.array(ids, pa.int64()).take(row), pa.array(tags, pa.int64()).take(row),
                pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), windows,
            ],
            ["h", "g", "doc_id", "tag", "start", "n", "windows"],
        )


def _unpacked(batches: Iterator) -> Iterator:
    """A row for each window of a stretch."""
    import pyarrow as pa

    for batch in batches:
        n = batch.column("n").to_numpy().astype(np.int64)
        held = np.frombuffer(b"".join(batch.column("windows").to_pylist()), _WINDOW)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row = pa.array(np.repeat(np.arange(len(n)), n))
        start = np.repeat(batch.column("start").to_numpy(), n) + within
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(held["a"].copy()), pa.array(held["b"].copy()), batch.column("doc_id").take(row), batch.column("tag").take(row),
                pa.array(start.astype(np.int32)),
            ],
            ["a", "b", "doc_id", "tag", "start"],
        )


def _firsts(rows: DataFrame, by: list[str]) -> DataFrame:
    """The earliest place of what occurs more than once."""
    found = rows.groupBy(*by).agg(F.min(F.struct("doc_id", "tag", "start")).alias("first"), F.count(F.lit(1)).alias("c"))
    return found.where("c > 1").drop("c")


def cut_words(words: list[bytes], parts: list[dict]) -> list[bytes]:
    """The words outside of the windows of the stretches."""
    edge = np.zeros(len(words) + 1, np.int64)
    start, n = np.array([(p["start"], p["n"]) for p in parts]).T
    np.add.at(edge, start, 1)
    np.add.at(edge, start + n + (WINDOW - 1), -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]


def _texts(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, tag, text; the tag tells rows of one doc_id apart and is 0 for all other rows."""
    ids = documents.select(F.col("doc_id").cast("long"))
    twice = scratch.write(ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("twice"), F.lit(True).alias("more")), "twice")
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.join(sized(twice), F.col("doc_id").eqNullSafe(F.col("twice")), "left").select(
        "doc_id", F.when(F.col("more"), F.xxhash64("text")).otherwise(F.lit(0)).alias("tag"), "text"
    )


def repeated_windows(documents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, tag and the stretches (start, n) of windows whose word sequence also starts earlier, each window once."""
    scratch = scratch or Scratch(documents.sparkSession, "substrings")
    texts = _texts(documents, scratch)
    row = ["doc_id", "tag"]
    filed = scratch.write(texts.mapInArrow(_filed, "key long, doc_id long, tag long, start int, n int"), "filed")
    shared = scratch.write(filed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "shared")
    parts = filed.join(shared, "key").groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("start", "n"))).alias("parts"))
    asked = scratch.write(parts.select(F.col("doc_id").alias("p_id"), F.col("tag").alias("p_tag"), "parts"), "asked")
    scratch.drop("filed")
    scratch.drop("shared")
    same = F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("tag") == F.col("p_tag"))
    stretches = scratch.write(texts.join(asked, same).select(*row, "parts", "text").mapInArrow(_hashed, _STRETCHES), "stretches")
    scratch.drop("asked")
    place = F.struct("doc_id", "tag", "start")
    # whole stretches first: the windows of a later one all start earlier elsewhere
    by = ["h", "g", "n"]
    firsts = scratch.write(_firsts(stretches.select(*by, *row, "start"), by), "stretch_firsts")
    copy = F.coalesce(~place.eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    judged = stretches.join(firsts, by, "left").select(*row, "start", "n", copy.alias("copy"), F.when(~copy, F.col("windows")).alias("windows"))
    judged = scratch.write(judged, "judged")
    scratch.drop("stretches")
    # then window by window among the others
    windows = judged.where("NOT copy").drop("copy").mapInArrow(_unpacked, "a long, b int, doc_id long, tag long, start int")
    firsts = scratch.write(_firsts(windows, ["a", "b"]), "window_firsts")
    later = windows.join(firsts, ["a", "b"]).where(~place.eqNullSafe(F.col("first"))).select(*row, "start", F.lit(1).alias("n"))
    every = judged.where("copy").select(*row, "start", "n").union(later)
    found = scratch.write(every.groupBy(*row).agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("parts")), "repeated")
    scratch.drop("judged")
    return found


def deduplicate(documents: DataFrame, with_text: bool = False) -> DataFrame:
    """Per row of documents: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text."""
    scratch = Scratch(documents.sparkSession, "substrings")
    found = repeated_windows(documents, scratch).select(F.col("doc_id").alias("p_id"), F.col("tag").alias("p_tag"), "parts")
    same = F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("tag") == F.col("p_tag"))

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for doc_id, text, parts in zip(batch.column("doc_id").to_pylist(), utf8(batch, "text"), batch.column("parts").to_pylist()):
                words = text.split()
                kept = cut_words(words, parts) if parts else words
                joined = b" ".join(kept)
                out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), *([joined.decode()] if with_text else [])))
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = zip(*out) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    joined = _texts(documents, Scratch(documents.sparkSession, "substrings")).join(found, same, "left").select("doc_id", "text", "parts")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else ""))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, text, row_number() OVER () AS k, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT k, doc_id, s, md5(array_to_string(w[s : s + 19], ' ')) AS h
  FROM (SELECT k, doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
later AS (
  SELECT k, s FROM (SELECT k, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS rn FROM win) WHERE rn > 1),
gone AS (SELECT k, list(DISTINCT p) AS ps FROM (SELECT k, unnest(range(s, s + 20)) AS p FROM later) GROUP BY k),
kept AS (
  SELECT k, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n
  FROM (SELECT k, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) u
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT k, unnest(ps) AS p FROM gone) g WHERE g.k = u.k AND g.p = u.i) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (k)
"""
