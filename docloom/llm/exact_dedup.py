"""Exact de-duplication over a sharded cuckoo-filter index of live digests.

Documents become SHA-256 digests. Copies are counted per (digest, salt) before anything meets, so that a digest
held by a third of all rows reaches its shard as SALTS rows at most. Each shard takes its entries one by one into a
cuckoo filter: a miss proves a digest new, a hit is verified against the shard's stored digests. Where no slot can
be freed, the filter is rebuilt at twice its size from the stored keys. Entries can be deleted again.

Null texts count as empty. Of equal texts the row with the largest doc_id stays; rows that repeat that doc_id too are
all marked kept, as nothing tells them apart. Null ids lose against any id. Other columns are not read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Scratch, read
from .native import without

SALTS = 32
SHARD_ROWS = 400_000
SLOTS = 4
KICKS = 200


class CuckooIndex:
    """Cuckoo filter (16-bit fingerprints, four slots a bucket) over a store of the live digests."""

    def __init__(self, buckets: int = 1024):
        self.store: dict[bytes, list] = {}
        self.resizes = 0
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.table = array("H", bytes(2 * SLOTS * buckets))

    def place(self, digest: bytes) -> tuple[int, int, int]:
        """Fingerprint (never 0, which marks a free slot) and the two buckets."""
        fp = int.from_bytes(digest[14:16], "little") or 1
        first = int.from_bytes(digest[8:14], "little") & self.mask  # the shard comes of the first bytes
        return fp, first, self._other(first, fp)

    def _other(self, bucket: int, fp: int) -> int:
        return bucket ^ ((fp * 0x5BD1E995) & self.mask)

    def might_hold(self, digest: bytes) -> bool:
        fp, a, b = self.place(digest)
        t = self.table
        return fp in t[a * SLOTS : a * SLOTS + SLOTS] or fp in t[b * SLOTS : b * SLOTS + SLOTS]

    def _put(self, fp: int, bucket: int) -> bool:
        t = self.table
        for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not t[i]:
                t[i] = fp
                return True
        return False

    def _seat(self, digest: bytes) -> bool:
        fp, a, b = self.place(digest)
        if self._put(fp, a) or self._put(fp, b):
            return True
        bucket = b
        for kick in range(KICKS):
            i = bucket * SLOTS + (kick + fp) % SLOTS
            fp, self.table[i] = self.table[i], fp
            bucket = self._other(bucket, fp)
            if self._put(fp, bucket):
                return True
        return False

    def _rebuild(self) -> None:
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self.resizes += 1
            self._empty(buckets)
            if all(self._seat(d) for d in self.store):
                return

    def insert(self, digest: bytes, doc_id, copies: int) -> None:
        if self.might_hold(digest):
            held = self.store.get(digest)  # the hit counts only if the stored digest is the same
            if held is not None:
                held[1] += copies
                if doc_id is not None and (held[0] is None or doc_id > held[0]):
                    held[0] = doc_id
                return
        self.store[digest] = [doc_id, copies]
        if not self._seat(digest):
            self._rebuild()

    def delete(self, digest: bytes, copies: int) -> bool:
        """Takes copies out; the digest leaves the filter with its last copy. False if it isn't live."""
        held = self.store.get(digest) if self.might_hold(digest) else None
        if held is None:
            return False
        held[1] -= copies
        if held[1] <= 0:
            del self.store[digest]
            fp, a, b = self.place(digest)
            for bucket in (a, b):
                for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                    if self.table[i] == fp:
                        self.table[i] = 0
                        return True
        return True


_INDEX = "shard int, kind string, bucket long, digest binary, keep_id long, copies long, filter binary"


def _shard_col(shards: int):
    return F.pmod(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")


def text_digests(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))


def build_index(changes: DataFrame, shards: int) -> DataFrame:
    """Applies changes (digest, doc_id, copies; negative copies delete) to an empty index; entries and filters by shard.

    The changes of a shard meet in one task; SHARD_ROWS bounds them, as changes are counted per digest and salt.
    Insertions come before deletions.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [x.split()[0] for x in _INDEX.split(", ")]
        types = [pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]

        def done(shard: int, index: CuckooIndex) -> Iterator:
            rows = [(shard, "entry", index.place(d)[1], d, k, n, None) for d, (k, n) in index.store.items()]
            rows.append((shard, "filter", index.mask + 1, None, None, len(index.store), index.table.tobytes()))
            for i in range(0, len(rows), 20_000):
                cols = zip(*rows[i : i + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        now, index = None, CuckooIndex()
        for batch in batches:
            for shard, digest, doc_id, copies in zip(*(batch.column(c).to_pylist() for c in ("shard", "digest", "doc_id", "copies"))):
                if shard != now:  # a shard's changes come together, so one index is held at a time
                    if now is not None:
                        yield from done(now, index)
                    now, index = shard, CuckooIndex()
                if copies > 0:
                    index.insert(digest, doc_id, copies)
                else:
                    index.delete(digest, -copies)
        if now is not None:
            yield from done(now, index)

    dealt = changes.select(_shard_col(shards).alias("shard"), "digest", "doc_id", "copies")
    return dealt.repartition(shards, "shard").sortWithinPartitions("shard", F.col("copies") < 0).mapInArrow(run, _INDEX)


def exact_duplicates(documents: DataFrame) -> DataFrame:
    """Per row of documents: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    digests = scratch.write(text_digests(documents), "digests")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-digests.count() // SHARD_ROWS))
    counted = (
        digests.groupBy("digest", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
        .agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
        .drop("salt")
    )
    index = scratch.write(build_index(counted, shards), "index")
    live = index.where("kind = 'entry'").select("digest", "keep_id", F.col("copies").alias("group_size"))
    return digests.join(live, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one_copy(documents: DataFrame) -> DataFrame:
    """One document of each text: the one with the largest doc_id (null loses), of rows that repeat it the least by all columns."""
    scratch = Scratch(documents.sparkSession, "copies")
    key = F.struct(F.col("doc_id").alias("id"), F.col("text_sha256").alias("h")).alias("k")
    met = exact_duplicates(documents).where("group_size > 1").groupBy(key).agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    met = scratch.write(met, "met")

    def key_of() -> Column:
        return F.struct(F.col("doc_id").alias("id"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("h"))

    return without(documents, met.where("NOT kept"), met.where("kept AND n > 1"), key_of)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
