"""Shared helpers: scratch tables in the shared folder, word splitting, row identity."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Held while a scratch table is written: shuffle files go when their job ends, and Python workers get small batches.
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is set only where the session names none and runs on one machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="docloom-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Scratch:
    """Written tables that cut lineage: an executor's loss costs a reread, not the work before.

    ``write`` also lets Spark delete the finished job's shuffle files at once and hands Python workers small batches.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        conf = self.spark.conf
        before = {key: conf.get(key, None) for key in _WRITING}
        try:
            for key, value in _WRITING.items():
                conf.set(key, value)
            df.write.option("compression", "zstd").parquet(self.path(name))
        finally:
            for key, value in before.items():
                conf.unset(key) if value is None else conf.set(key, value)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """Identity of a row by content, so that repeated ids with other texts stay apart."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))


#: Words of lower-cased text: runs of digits, a-z and everything beyond ASCII, as bytes of UTF-8.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def folded_words(data: bytes) -> list[bytes]:
    """``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return data.translate(_FOLD).split()


def spaced_words(data: bytes) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+``, unchanged: bytes.split() parts at just these six characters."""
    return data.split()


def utf8(batch, name: str) -> list[bytes]:
    """A string column of an Arrow batch as UTF-8; null becomes empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in batch.column(name).cast(pa.binary()).to_pylist()]


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text below U+0800: a fold over its bits, least significant first."""
    char = "unicode(x)"
    octets = f"CASE WHEN {char} < 128 THEN [{char}] ELSE [192 + ({char} >> 6), 128 + ({char} & 63)] END"
    bits = f"flatten(list_transform(string_split({text}, ''), lambda x: {octets}))"
    bits = f"flatten(list_transform({bits}, lambda x: list_transform(range(8), lambda i: (x >> i::INT) & 1)))::BIGINT[]"
    fold = "lambda c, d: xor(c >> 1, (xor(c, d) & 1) * 3988292384::BIGINT)"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {bits}), {fold}))"
