"""Near copies by the Jaccard similarity of word shingles: verification of pairs, and an exact join for those SimHash leaves out.

SimHash anchors bring most near copies together (simhash.near_pairs); their pairs are verified here by whole shingle sets. The
join then adds the pairs of texts that are not tied by these.

Of a text's different shingles, in one order for all texts, those in its prefix (n - ceil(SIMILARITY * n) + 1) are its keys: two
texts that are similar enough share one of them, so no pair is missed (up to collisions of 64-bit hashes). Any common order is
right; here shingles that many texts hold come last, so that a common passage brings no texts together. Keys are counted, with
combination before the shuffle, and those of one text alone are done with.

Only pairs that are not tied by then are compared one by one: of a key's texts, those outside of its largest tied set with all.
The join makes a row of those only that pass the positional filter and that of short parities (512 bits); then longer parities
and whole shingle sets decide. No filter can lose a pair, and no group is capped or dropped.

Null texts count as empty; texts without words are near copies of each other. A text with fewer words than a shingle is one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, utf8
from .components import connected_components
from .native import sized
from .substrings import CHUNK_BYTES, mix, salt, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: A shingle is frequent if so many texts of a few chunks hold it; the order knows the most frequent ones. It decides on cost only.
FREQUENT_IN_CHUNKS, CHUNKS, FREQUENT = 2, 10, 200_000
MARK_BITS = 12
#: Parities that the join compares itself: 2**SHORT_BITS bits, in so many longs.
SHORT_BITS, SHORT_MARKS = 9, 8
SHORT_NAMES = tuple(f"m{i}" for i in range(SHORT_MARKS))


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Of each text the different hashes of its lower-cased word shingles, sorted."""
    hashes, offsets = word_hashes([t.lower() for t in texts])
    turns = [mix(np.array([salt(400 + i)])) | np.uint64(1) for i in range(shingle)]
    full = np.zeros(max(len(hashes) - shingle + 1, 0), np.uint64)
    for i in range(shingle):
        full += hashes[i : i + len(full)] * turns[i]
    full, out = mix(full), []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= shingle:
            out.append(np.unique(full[a : b - shingle + 1]))
        else:
            whole = sum((hashes[a + i] * turns[i] for i in range(b - a)), start=np.full(1, salt(b - a)))
            out.append(mix(whole))
    return out


def chunks(batches: Iterator, name: str) -> Iterator[tuple[list, list[bytes]]]:
    """A column's values and the texts of as many rows as make up a chunk of text."""
    held, texts, total = [], [], 0
    for batch in batches:
        for value, text in zip(batch.column(name).to_pylist(), utf8(batch, "text")):
            if held and total + len(text) > CHUNK_BYTES:
                yield held, texts
                held, texts, total = [], [], 0
            held.append(value)
            texts.append(text)
            total += len(text)
    if held:
        yield held, texts


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("tid"), "text")


def _share(n: int, similarity: float) -> int:
    """The least whole number that makes up the share of n."""
    return int(np.ceil(n * similarity - 1e-9))


def most_differing(similarity: float) -> float:
    """The most bits, for each shingle of both, that the parities of similar sets differ in."""
    return (1 - similarity) / (1 + similarity) + 1e-9


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


def frequent_shingles(documents: DataFrame, shingle: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that several texts of a few chunks hold, sorted, and by how many texts of such chunks they are held."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        dealt = chunks(batches, "tid")
        while some := [s for _, texts in islice(dealt, CHUNKS) for s in shingle_sets(texts, shingle)]:
            key, n = np.unique(np.concatenate(some), return_counts=True)
            many = n >= FREQUENT_IN_CHUNKS
            yield pa.RecordBatch.from_arrays([pa.array(key[many].view(np.int64)), pa.array(n[many].astype(np.int64))], ["key", "n"])

    counted = _texts(documents).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    got = scratch.write(counted, "frequent").orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
    keys = got.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], got.column("n").to_numpy()[order]


def prefix_entries(documents: DataFrame, shingle: int, similarity: float, scratch: Scratch) -> DataFrame:
    """key, tid, n and pos (the key's place in the text's order) of the prefixes."""
    sent = documents.sparkSession.sparkContext.broadcast(frequent_shingles(documents, shingle, scratch))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known, counts = sent.value
        for tids, texts in chunks(batches, "tid"):
            keys, lengths = [], []
            for s in shingle_sets(texts, shingle):
                lengths.append(len(s))
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    s = s[np.argsort(np.where(known[at] == s, counts[at], 0), kind="stable")]
                keys.append(s[: len(s) - _share(len(s), similarity) + 1])
            sizes = [len(k) for k in keys]
            cols = [
                pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(tids, np.int64), sizes)),
                pa.array(np.repeat(np.array(lengths, np.int32), sizes)), pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["key", "tid", "n", "pos"])

    return _texts(documents).mapInArrow(run, "key long, tid long, n int, pos int")


def shared_entries(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """The entries whose keys several texts have, each once."""
    counted = entries.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    met = entries.join(sized(scratch.write(counted, "shared-keys")), "key", "left_semi")
    return met.groupBy("key", "tid").agg(F.first("n").alias("n"), F.first("pos").alias("pos"))


def untied(entries: DataFrame, roots: DataFrame, prints: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) that share a key and pass the filters, of texts with different roots. One of each such pair is outside of the
    key's largest tied set, so only those meet all others. prints has the short parities m0, m1, ... by tid."""
    labelled = entries.join(sized(roots), "tid", "left").select("key", "tid", "n", "pos", F.coalesce("root", "tid").alias("root"))
    labelled = scratch.write(labelled, "labelled")
    largest = (
        labelled.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
        .groupBy("key").agg(F.max(F.struct("c", "root")).getField("root").alias("largest"), F.count(F.lit(1)).alias("roots"))
    )
    largest = scratch.write(largest.where("roots > 1").drop("roots"), "largest")
    marks = SHORT_NAMES
    met = labelled.join(largest, "key").withColumn("outside", F.col("root") != F.col("largest")).drop("largest")
    rest = scratch.write(met.join(prints.select("tid", *marks), "tid"), "rest")
    x = rest.where("outside").select("key", *(F.col(c).alias(f"{c}_a") for c in ("tid", "n", "pos", "root", *marks)))
    y = rest.select("key", "outside", *(F.col(c).alias(f"{c}_b") for c in ("tid", "n", "pos", "root", *marks)))
    best = 1 + F.least(F.col("n_a") - 1 - F.col("pos_a"), F.col("n_b") - 1 - F.col("pos_b"))
    room = best >= similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b")) - F.lit(1e-6)
    once = ~F.col("outside") | (F.col("tid_a") < F.col("tid_b"))
    differing = reduce(Column.__add__, (F.bit_count(F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b"))) for m in marks))
    alike = differing <= (1 - similarity) / (1 + similarity) * (F.col("n_a") + F.col("n_b")) + F.lit(1e-6)
    pairs = x.join(y, (x["key"] == y["key"]) & (F.col("root_a") != F.col("root_b")) & once & room & alike)
    return pairs.select(F.least("tid_a", "tid_b").alias("a"), F.greatest("tid_a", "tid_b").alias("b")).distinct()


def parity(s: np.ndarray, bits: int = MARK_BITS) -> bytes:
    """2**bits bits: how often, odd or even, a set's hashes fall on each bit. Two sets' parities differ in at most as many bits as
    one set has that the other lacks, both ways."""
    odd = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def verified(pairs: DataFrame, documents: DataFrame, shingle: int, similarity: float, scratch: Scratch, name: str) -> DataFrame:
    """The pairs whose whole shingle sets are similar enough."""

    def of_texts(batches: Iterator, column: str) -> Iterator:
        import pyarrow as pa

        for tids, texts in chunks(batches, "tid"):
            found = shingle_sets(texts, shingle)
            held = [parity(s) for s in found] if column == "mark" else [s.tobytes() for s in found]
            cols = [pa.array(tids, pa.int64()), pa.array([len(s) for s in found], pa.int64()), pa.array(held, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["tid", "n", column])

    def facts(pairs: DataFrame, column: str) -> DataFrame:
        """Of the texts in the pairs only: tid, n and the mark (parity) or the whole set."""
        asked = scratch.write(pairs.select(F.col("a").alias("tid")).union(pairs.select("b")).distinct(), f"{name}-{column}-asked")
        met = _texts(documents).join(sized(asked), "tid", "left_semi")
        got = met.mapInArrow(lambda batches: of_texts(batches, column), f"tid long, n long, {column} binary").dropDuplicates(["tid"])
        got = scratch.write(got, f"{name}-{column}")
        scratch.drop(f"{name}-{column}-asked")
        return got

    def roomy(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u8").reshape(-1, (1 << MARK_BITS) // 64) for c in ("mark_a", "mark_b"))
            n = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            good = np.bitwise_count(a ^ b).sum(1, dtype=np.int64) <= (1 - similarity) / (1 + similarity) * n + 1e-6
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(c).to_numpy()[good]) for c in ("a", "b")], ["a", "b"])

    def exact(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            both = zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist())
            good = np.array([similar(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), similarity) for x, y in both], bool)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(c).to_numpy()[good]) for c in ("a", "b")], ["a", "b"])

    def side(table: DataFrame, x: str, *names: str) -> DataFrame:
        return table.select(F.col("tid").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in names))

    pairs = scratch.write(pairs, f"{name}-pairs")
    marks = facts(pairs, "mark")
    near = pairs.join(side(marks, "a", "n", "mark"), "a").join(side(marks, "b", "n", "mark"), "b").mapInArrow(roomy, "a long, b long")
    near = scratch.write(near, f"{name}-near")
    for done in ("pairs", "mark"):
        scratch.drop(f"{name}-{done}")
    sets = facts(near, "set")
    links = near.join(side(sets, "a", "set"), "a").join(side(sets, "b", "set"), "b").select("a", "b", "set_a", "set_b").mapInArrow(exact, "a long, b long")
    links = scratch.write(links, f"{name}-links")
    for done in ("near", "set"):
        scratch.drop(f"{name}-{done}")
    return links


def completed(tied: DataFrame, prints: DataFrame, documents: DataFrame, scratch: Scratch, shingle: int, similarity: float) -> DataFrame:
    """tid (hash of the text), label of the texts with near copies: the least tid reachable over pairs of at least this similarity.

    tied has such pairs already; the join looks for those of texts that these don't connect.
    """
    entries = scratch.write(prefix_entries(documents, shingle, similarity, scratch), "entries")
    shared = scratch.write(shared_entries(entries, scratch), "shared")
    for done in ("entries", "shared-keys", "frequent"):
        scratch.drop(done)
    roots = scratch.write(connected_components(tied, Scratch(documents.sparkSession, "tied")).toDF("tid", "root"), "roots")
    rest = verified(untied(shared, roots, prints, similarity, scratch), documents, shingle, similarity, scratch, "rest")
    for done in ("shared", "labelled", "largest", "rest"):
        scratch.drop(done)
    return connected_components(roots.toDF("a", "b").union(rest), Scratch(documents.sparkSession, "near")).toDF("tid", "label")
