"""SimHash near-duplicates by anchor-point covering.

Every text gets a 64-bit fingerprint; from there on each different fingerprint counts once. Fingerprints that differ in
at most two bits differ in at most one bit in one of their 32-bit halves. The first 31 bits of a half are covered by the
2**26 words of the perfect Hamming code: every point lies within one bit of a code word (covering radius 1). Each half is
replicated to every code word within radius plus threshold, 2 bits (16 words, or 1 if it is a code word itself). Of two
halves one bit apart, the code word nearest to one lies within two bits of the other, so each link meets at an anchor.

An anchor's fingerprints are compared as a sorted run. Runs above RUN don't stay together: their fingerprints go by
midpoints instead. Two fingerprints within two bits share a point within one bit of both, and at most 65 fingerprints lie
that close to a point. No group is capped or dropped. Links of a group go out as a forest, not as all pairs.

The pipeline's stage asks for texts whose shingle sets are similar, which stand further apart. It covers the quarters of a
fingerprint: of two within NEAR_DISTANCE (11) bits, one quarter differs in at most two, and there they meet at a word of the
Hamming code [15, 11]. A pair that meets at several words is made at the first of them only. Parities of the shingle sets rule out
at the anchor what cannot be similar, and of all its anchors a text keeps the few nearest texts, so that pairs grow with the texts
and not with a group's square. These are verified on whole shingle sets. Pairs beyond that radius, and those left out, come from
an exact join of the texts that are not tied by then (resemblance.untied).

Null texts count as empty and get fingerprint zero. Null doc_ids are last: a component without any other id has a null
component_id. Repeated rows get the same result each. An empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import resemblance
from .common import Scratch, read, row_key, utf8
from .components import connected_components
from .native import sized, without

SHINGLE = 3
DISTANCE = 2
SEED = 42
RUN = 1024
#: Replicated fingerprints (16 bytes each) that one task sorts and compares, about.
POINTS = 500_000
NEAR_DISTANCE = 11
#: At an anchor a text is paired with so many of the nearest ones that it first meets there and that come after it by number of
#: shingles, then tid; of those from all its anchors, with so many of the nearest. The exact join has the rest.
NEAREST = 4
#: Anchors with more texts than this first tie what lies around a few of them. It decides on cost only.
CROWD = 20_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the lower-cased text's word shingles."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[-n:].tolist()
    return majority(np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops)], "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the 64-bit hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, tag (a hash of the text that tells rows of one id apart) and fp (the fingerprint as a signed long)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in utf8(batch, "text")], "<u8")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(fps.view("<i8"))], ["doc_id", "tag", "fp"])

    rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"), "text")
    return rows.mapInArrow(run, "doc_id long, tag long, fp long")


def _syndrome_tables() -> np.ndarray:
    """Hamming syndromes of 31-bit points by byte: the xor of the places (1 to 31) of the bits set."""
    out = np.zeros((4, 256), np.int64)
    for byte in range(4):
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1 and 8 * byte + bit < 31:
                    out[byte, value] ^= 8 * byte + bit + 1
    return out


def _moves(bits: int = 31) -> np.ndarray:
    """For each syndrome the sets of at most two bits that lead to a code word, 16 of 31 bits; syndrome 0 repeats the empty set."""
    out = np.zeros((bits + 1, (bits + 1) // 2), np.int64)
    for s in range(1, bits + 1):
        pairs = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, bits + 1) if i ^ s > i]
        out[s] = [1 << (s - 1), *pairs]
    return out


def anchors_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, index of the fingerprint): the code words within two bits of either half."""
    tables, moves = _syndrome_tables(), _moves()
    keys, rows = [], []
    for half in (0, 1):
        points = (fps.view(np.uint64) >> np.uint64(32 * half)).astype(np.int64) & 0x7FFFFFFF
        s = tables[0][points & 255] ^ tables[1][points >> 8 & 255] ^ tables[2][points >> 16 & 255] ^ tables[3][points >> 24]
        words = points[:, None] ^ moves[s]
        first = np.ones(words.shape, bool)
        first[s == 0, 1:] = False
        keys.append((words | half << 32)[first])
        rows.append(np.nonzero(first)[0])
    return np.concatenate(keys), np.concatenate(rows)


@functools.cache
def _word_tables() -> tuple[np.ndarray, np.ndarray]:
    """The syndrome of each 15-bit point, and the moves to code words by syndrome."""
    every = np.arange(1 << 15)
    return np.bitwise_xor.reduce([(every >> bit & 1) * (bit + 1) for bit in range(15)]), _moves(15).astype(np.uint16)


def _quarter(fps: np.ndarray, quarter: int) -> np.ndarray:
    """The first 15 bits of a quarter."""
    return (fps.view(np.uint64) >> np.uint64(16 * quarter)).astype(np.uint16) & np.uint16(0x7FFF)


def quarter_anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, index of the fingerprint): the code words within two bits of the first 15 bits of each quarter."""
    syndromes, moves = _word_tables()
    keys, rows = [], []
    for quarter in range(4):
        points = _quarter(fps, quarter)
        s = syndromes[points]
        words = points[:, None] ^ moves[s]
        first = np.ones(words.shape, bool)
        first[s == 0, 1:] = False
        keys.append(words[first].astype(np.int64) | quarter << 15)
        rows.append(np.nonzero(first)[0])
    return np.concatenate(keys), np.concatenate(rows)


def first_met(a: np.ndarray, b: np.ndarray, anchor: int) -> np.ndarray:
    """Of pairs of fingerprints that meet at this anchor, whether they meet at no smaller one."""
    syndromes, moves = _word_tables()
    out = np.zeros(len(a), bool)
    for at in range(0, len(a), 50_000):
        first = np.arange(at, min(at + 50_000, len(a)))
        for quarter in range((anchor >> 15) + 1):
            points = _quarter(a[first], quarter)
            words = points[:, None] ^ moves[syndromes[points]]
            met = np.bitwise_count(words ^ _quarter(b[first], quarter)[:, None]) <= 2
            if quarter == anchor >> 15:
                met &= words < (anchor & 0x7FFF)
            first = first[~met.any(1)]
        out[first] = True
    return out


def _near(a, b) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= DISTANCE  # of signed numbers it would count those of the absolute value


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that tie together what is linked among these fingerprints, at most one fewer than there are."""
    label, out = np.arange(len(fps)), []
    for i in range(len(fps) - 1):
        near = i + 1 + np.flatnonzero(_near(fps[i + 1 :], fps[i]))
        for j in near[label[near] != label[i]].tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _compare(batches: Iterator) -> Iterator:
    """Sorted (anchor, fp) to links (a, b, true) and members of long runs (fp, fp, false). Holds a batch and a run."""
    import pyarrow as pa

    def emit(a, b, linked):
        a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), linked))], ["a", "b", "linked"])

    anchors, fps, spilling = np.empty(0, np.int64), np.empty(0, np.int64), None

    def settle(anchors, fps, spilling):
        starts = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
        lengths = np.diff(np.append(starts, len(anchors)))
        short = np.repeat(lengths <= 16, lengths)
        for k in range(1, 16):
            if len(anchors) <= k:
                break
            same = (anchors[k:] == anchors[:-k]) & short[k:]
            if not same.any():
                break
            hit = np.flatnonzero(same)
            hit = hit[_near(fps[hit], fps[hit + k])]
            if len(hit):
                yield emit(fps[hit], fps[hit + k], True)
        for at in np.flatnonzero(lengths > 16).tolist():
            run = fps[starts[at] : starts[at] + lengths[at]]
            if len(run) > RUN or anchors[starts[at]] == spilling:
                yield emit(run, run, False)
            elif links := forest(run):
                i, j = np.array(links).T
                yield emit(run[i], run[j], True)
        for at in np.flatnonzero((lengths <= 16) & (anchors[starts] == spilling)).tolist() if spilling is not None else []:
            run = fps[starts[at] : starts[at] + lengths[at]]
            yield emit(run, run, False)

    for batch in batches:
        anchors = np.concatenate((anchors, batch.column("anchor").to_numpy()))
        fps = np.concatenate((fps, batch.column("fp").to_numpy()))
        if not len(anchors):
            continue
        last = int(np.searchsorted(anchors, anchors[-1]))  # the last run may go on in the next batch
        if last:
            yield from settle(anchors[:last], fps[:last], spilling)
            anchors, fps = anchors[last:], fps[last:]
        if len(fps) > RUN:
            spilling = int(anchors[-1])
            yield emit(fps, fps, False)
            anchors, fps = anchors[:0], fps[:0]
    if len(fps):
        yield from settle(anchors, fps, spilling)


def fingerprint_links(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) that tie together the different fingerprints fp within DISTANCE bits."""

    def replicate(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fps = batch.column("fp").to_numpy()
            anchor, row = anchors_of(fps)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[row])], ["anchor", "fp"])

    def midpoints(batches: Iterator) -> Iterator:
        import pyarrow as pa

        flips = np.concatenate(([0], np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64)))).astype(np.uint64).view(np.int64)
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for i in range(0, len(fps), 2000):
                part = fps[i : i + 2000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((part[:, None] ^ flips).ravel()), pa.array(np.repeat(part, len(flips)))], ["anchor", "fp"]
                )

    def compared(points: DataFrame, rows: int) -> DataFrame:
        dealt = points.repartition(max(1, -(-rows // POINTS)), "anchor").sortWithinPartitions("anchor")
        return dealt.mapInArrow(_compare, "a long, b long, linked boolean")

    spread = classes.select("fp").mapInArrow(replicate, "anchor long, fp long")
    found = scratch.write(compared(spread, 31 * classes.count()), "compared")
    crowded = scratch.write(found.where("not linked").select(F.col("a").alias("fp")).distinct(), "crowded")
    by_midpoint = compared(crowded.mapInArrow(midpoints, "anchor long, fp long"), 65 * crowded.count())
    return found.where("linked").select("a", "b").union(by_midpoint.where("linked").select("a", "b"))


def _rooted(documents: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows' fingerprints, and of each fingerprint fp the first_id and the root (the least fingerprint reachable over links)."""
    prints = scratch.write(fingerprints(documents), "prints")
    classes = scratch.write(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = connected_components(fingerprint_links(classes, scratch), scratch)
    return prints, classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Per row of documents: doc_id, fingerprint, component_id (the smallest doc_id reachable over links), tag."""
    scratch = Scratch(documents.sparkSession, "simhash")
    prints, rooted = _rooted(documents, scratch)
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = scratch.write(rooted.join(least, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "tag")


def one_of_each(documents: DataFrame, labelled: DataFrame, scratch: Scratch) -> DataFrame:
    """One document of each label: the least doc_id (null last), then the least text hash, then the least by all columns.

    labelled has doc_id, tag and label per row of documents.
    """
    key = F.struct(F.col("doc_id").alias("id"), F.col("tag").alias("h")).alias("k")
    keys = scratch.write(labelled.groupBy(key, "label").agg(F.count(F.lit(1)).alias("n")), "keys")
    best = F.min(F.struct(F.col("k.id").isNull(), "k")).getField("k").alias("best")
    groups = scratch.write(keys.groupBy("label").agg(best, F.sum("n").alias("rows")).where("rows > 1"), "groups")
    met = scratch.write(keys.join(sized(groups), "label").select("k", "n", (F.col("k") == F.col("best")).alias("kept")), "met")
    return without(documents, met.where("NOT kept"), met.where("kept AND n > 1"), row_key)


def text_prints(documents: DataFrame, shingle: int) -> DataFrame:
    """Per different text: tid (its hash), n (different shingles), fp (SimHash of these) and m0, m1, ... (parity of these in longs)."""
    marks = resemblance.SHORT_NAMES

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for tids, texts in resemblance.chunks(batches, "tid"):
            found = resemblance.shingle_sets(texts, shingle)
            fps = np.array([majority(s) for s in found], "<u8").view("<i8")
            held = np.array([np.frombuffer(resemblance.parity(s, resemblance.SHORT_BITS), "<i8") for s in found])
            cols = [pa.array(tids, pa.int64()), pa.array([len(s) for s in found], pa.int32()), pa.array(fps), *map(pa.array, held.T.copy())]
            yield pa.RecordBatch.from_arrays(cols, ["tid", "n", "fp", *marks])

    rows = documents.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("tid"), "text")
    return rows.mapInArrow(run, "tid long, n int, fp long, " + ", ".join(f"{m} long" for m in marks)).dropDuplicates(["tid"])


def _runs(batches: Iterator, names: list[str]) -> Iterator[tuple[list[np.ndarray], int]]:
    """The named columns of each anchor's texts, and the anchor; rows come by anchor."""
    held, last = [], None
    for batch in batches:
        anchors, *cols = (batch.column(c).to_numpy() for c in ("anchor", *names))
        cuts = [0, *(np.flatnonzero(np.diff(anchors)) + 1).tolist(), len(anchors)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                if held and anchors[a] != last:
                    yield [np.concatenate(c) for c in zip(*held)], last
                    held = []
                last = int(anchors[a])
                held.append([c[a:b] for c in cols])
    if held:
        yield [np.concatenate(c) for c in zip(*held)], last


def _difference(fp: np.ndarray, n: np.ndarray, marks: np.ndarray | None, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """By how much pairs of texts differ: bits of their parities for each shingle of both, or bits of their fingerprints."""
    if marks is None:
        return np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)).astype(float)
    out = np.empty(len(i))
    for at in range(0, len(i), 50_000):
        a, b = i[at : at + 50_000], j[at : at + 50_000]
        out[at : at + 50_000] = np.bitwise_count((marks[a] ^ marks[b]).view(np.uint64)).sum(1, dtype=np.int64) / (n[a] + n[b])
    return out


def _pairs_of(
    tid: np.ndarray, fp: np.ndarray, n: np.ndarray, similarity: float, anchor: int | None = None, marks: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of an anchor's texts, sorted by n: within NEAR_DISTANCE bits, and of such lengths that they can be similar.

    Near texts meet at up to 32 anchors: with the anchor given, their pair is left to the smallest of these. With marks (a row of
    short parities for each text) pairs that cannot be similar by these are left out, and they tell which are nearest.
    """
    fp, most = fp.view(np.uint64), resemblance.most_differing(similarity)
    while len(tid) > CROWD:
        lead = len(tid) // 2
        near = (np.bitwise_count(fp ^ fp[lead]) <= NEAR_DISTANCE) & (np.minimum(n, n[lead]) >= similarity * np.maximum(n, n[lead]) - 1e-6)
        if marks is not None:
            at = np.flatnonzero(near)
            near[at] = _difference(fp, n, marks, at, np.full(len(at), lead)) <= most
        if 100 * near.sum() < len(tid):
            break
        near[lead] = False
        yield tid[near], np.full(near.sum(), tid[lead])
        near[lead] = True
        tid, fp, n, marks = tid[~near], fp[~near], n[~near], None if marks is None else marks[~near]
    ends = np.searchsorted(n, n / similarity + 1e-6, "right")
    at = 0
    while at < len(tid) - 1:
        to = at + max(1, min(512, 1_000_000 // int(ends[min(at + 512, len(tid)) - 1] - at)))
        end = int(ends[min(to, len(tid)) - 1])
        bits = np.bitwise_count(fp[at:to, None] ^ fp[None, at:end])
        i, j = np.nonzero(bits <= NEAR_DISTANCE)
        good = (j > i) & (at + j < ends[at + i])
        i, j = at + i[good], at + j[good]
        apart = _difference(fp, n, marks, i, j)
        if marks is not None:
            good = apart <= most
            i, j, apart = i[good], j[good], apart[good]
        if anchor is not None:
            first = first_met(fp[i], fp[j], anchor)
            i, j, apart = i[first], j[first], apart[first]
        order = np.lexsort((apart, i))
        i, j = i[order], j[order]
        among = np.arange(len(i)) - np.searchsorted(i, i)
        yield tid[i[among < NEAREST]], tid[j[among < NEAREST]]
        at = to


def near_pairs(prints: DataFrame, similarity: float, marks: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (a, b) of texts that meet at an anchor of a quarter within NEAR_DISTANCE bits: of each text with the NEAREST of those that
    its anchors pair it with, each pair made at the first anchor. Only what a crowd's leads tie may come again.

    marks are the columns of short parities that rule pairs out and tell which are nearest; without them fingerprints do.
    """
    names = ["tid", "fp", "n", *marks]

    def replicate(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in names]
            for i in range(0, len(cols[0]), 4000):
                anchor, row = quarter_anchors(cols[1][i : i + 4000])
                for k in range(0, len(row), 16_000):
                    part = [anchor[k : k + 16_000].astype(np.int32), *(c[i : i + 4000][row[k : k + 16_000]] for c in cols)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in part], ["anchor", *names])

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for (tid, fp, n, *held), anchor in _runs(batches, names):
            held = np.stack(held, 1) if held else None
            for i, j in _pairs_of(np.arange(len(tid)), fp, n, similarity, anchor, held):
                cols = [tid[i], tid[j], _difference(fp, n, held, i, j)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b", "apart"])

    typed = "anchor int, tid long, fp long, n int" + "".join(f", {m} long" for m in marks)
    points = prints.select(*names).mapInArrow(replicate, typed)
    held = POINTS * 3 // len(names)  # rows with marks are wider
    dealt = points.repartition(max(1, -(-32 * prints.count() // held)), "anchor").sortWithinPartitions("anchor", "n", "tid")
    made = dealt.mapInArrow(compare, "a long, b long, apart double").distinct()
    nearest = F.row_number().over(Window.partitionBy("a").orderBy("apart", "b"))
    kept = made.withColumn("nearest", nearest).where(F.col("nearest") <= NEAREST)
    return kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def keep_one_of_each(documents: DataFrame, shingle: int = resemblance.SHINGLE, similarity: float = resemblance.SIMILARITY) -> DataFrame:
    """One document of each group of near copies: word shingles with a Jaccard similarity of at least this, link by link.

    SimHash anchors bring the texts together and whole shingle sets decide; an exact join adds the pairs that these left out.
    """
    scratch = Scratch(documents.sparkSession, "near-copies")
    prints = scratch.write(text_prints(documents, shingle), "prints")
    pairs = near_pairs(prints, similarity, resemblance.SHORT_NAMES)
    tied = resemblance.verified(pairs, documents, shingle, similarity, scratch, "tied")
    labels = scratch.write(resemblance.completed(tied, prints, documents, scratch, shingle, similarity), "labels")
    scratch.drop("prints")
    rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"))
    labelled = rows.join(sized(labels), rows["tag"] == labels["tid"], "left").select("doc_id", "tag", F.coalesce("label", "tag").alias("label"))
    return one_of_each(documents, labelled, scratch)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("tag")
