"""CRC-32 of files that are held in parts, and ZIP volumes written by columns and bounded by bytes.

Bytes that follow multiply a checksum by a power of x, modulo the polynomial and over the field of two elements. So the
checksum of a file is the exclusive or of its parts' checksums, each moved past the bytes behind it: an aggregation that
combines in any order, on the side of the map too, and no task reads a whole file.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, functions as F

from .scale import before

POLYNOMIAL = 0xEDB88320
#: Powers of two of bytes that a checksum can be moved by, one after the other: files up to 2 ** 48 bytes.
POWERS = 48
#: 1 January 2000, 0:00, as ZIP has it; flag of names in UTF-8; version of the format.
DAY, UTF8, VERSION = (20 << 9) | (1 << 5) | 1, 0x0800, 20

#: Files of one archive, about, whose number has 16 bits.
FILES = 60_000


def _times(a: int, b: int) -> int:
    """Product of two polynomials, lowest power in the highest bit."""
    out = 0
    for k in range(31, -1, -1):
        if b >> k & 1:
            out ^= a
        a = a >> 1 ^ (POLYNOMIAL if a & 1 else 0)
    return out


@cache
def _table() -> str:
    """By power of two of bytes, four bits' place and their value: the bits moved past so many bytes."""
    by, rows = 1 << 23, []  # x ** 8
    for _ in range(POWERS):
        rows += [_times(v << 4 * place, by) for place in range(8) for v in range(16)]
        by = _times(by, by)
    return ",".join(map(str, rows))


def moved_past(crc: Column, n_bytes: Column) -> Column:
    """The checksum's share in that of a file where so many bytes come behind its part."""
    table = F.split(F.lit(_table()), ",").cast("array<bigint>")  # folds to a constant

    def step(acc: Column, k: Column) -> Column:
        moved = None
        for place in range(8):
            at = k * 128 + (16 * place) + F.shiftright(acc["c"], 4 * place).bitwiseAND(F.lit(15))
            got = F.get(table, at.cast("int"))
            moved = got if moved is None else moved.bitwiseXOR(got)
        return F.struct(F.when(acc["n"] % 2 == 1, moved).otherwise(acc["c"]).alias("c"), F.floor(acc["n"] / 2).cast("long").alias("n"))

    n_steps = F.length(F.bin(n_bytes.cast("long")))
    start = F.struct(crc.cast("long").alias("c"), n_bytes.cast("long").alias("n"))
    return F.aggregate(F.sequence(F.lit(0), n_steps - 1), start, step)["c"]


def crc32_combined(parts: DataFrame, by: list[str], order: str, content: str) -> DataFrame:
    """by, n_parts, n_bytes, crc32: the checksum of each file, given its parts and their whole-number order.

    Null content has no bytes. Parts of equal order stand as they come, as running sums have them.
    """
    size = F.coalesce(F.octet_length(content), F.lit(0)).cast("long")
    sized = parts.select(*by, order, size.alias("size"), F.crc32(F.coalesce(F.col(content).cast("binary"), F.lit(b""))).alias("crc"))
    behind = before(sized.withColumn("back", -F.col(order)), by, "back", F.col("size"), "behind")
    return behind.withColumn("moved", moved_past(F.col("crc"), F.col("behind"))).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_parts"), F.sum("size").alias("n_bytes"), F.bit_xor("moved").alias("crc32")
    )


def _little(n: Column | int, n_bytes: int) -> Column:
    """A whole number as bytes, lowest first."""
    digits = F.lpad(F.hex((n if isinstance(n, Column) else F.lit(n)).cast("long")), 2 * n_bytes, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in range(n_bytes - 1, -1, -1))))


def volumes(files: DataFrame, by: list[str], order: str, size: Column, most: int) -> DataFrame:
    """files with volume, a number that is the same for files of one volume of at most so many bytes.

    Bytes run up over a batch and are cut into stretches of half the bound; files that begin in a stretch fill at most the
    bound, if none is larger than half. Larger files have volumes of their own. Numbers rise with the order, with gaps.
    """
    half = most // 2
    run = before(files.withColumn("_size", size.cast("long")), by, order, F.col("_size"), "_at")
    run = before(run.withColumn("_alone", (F.col("_size") > half).cast("long")), by, order, F.col("_alone") * 2, "_passed")
    number = F.floor(F.col("_at") / half) + F.col("_passed") + F.col("_alone")
    return run.withColumn("volume", number.cast("long")).drop("_size", "_at", "_alone", "_passed")


def zip_volumes(files: DataFrame, by: list[str], order: str, name: str, content: str, most: int = 1 << 28) -> DataFrame:
    """by, volume, n_files, n_bytes, content: archives of at most so many bytes and 65,535 files, but for single files that are larger.

    Small files count as the bound's share for FILES of them. Files are stored as they are. A volume is one task's, whatever the size of its batch; null content is empty. ``most`` is
    to stay below two gigabytes, as an archive is one value.
    """
    body, named = F.coalesce(F.col(content).cast("binary"), F.lit(b"")), F.encode(name, "UTF-8")
    n, m = F.octet_length(body).cast("long"), F.octet_length(named).cast("long")
    cost = F.greatest(n + 2 * m + 76, F.lit(-(-(most - 22) // (2 * FILES))))
    rows = volumes(files.select(*by, order, named.alias("named"), body.alias("body"), cost.alias("cost")), by, order, F.col("cost"), most - 22)
    n, m = F.octet_length("body").cast("long"), F.octet_length("named").cast("long")
    rows = before(rows, [*by, "volume"], order, F.lit(30) + m + n, "at")
    common = F.concat(_little(UTF8, 2), _little(0, 2), _little(0, 2), _little(DAY, 2), _little(F.crc32("body"), 4), _little(n, 4), _little(n, 4), _little(m, 2), _little(0, 2))
    local = F.concat(F.lit(b"PK\x03\x04"), _little(VERSION, 2), common, F.col("named"), F.col("body"))
    central = F.concat(F.lit(b"PK\x01\x02"), _little(VERSION, 2), _little(VERSION, 2), common, _little(0, 6), F.lit(bytes(4)), _little(F.col("at"), 4), F.col("named"))
    made = rows.select(*by, "volume", order, local.alias("local"), central.alias("central"))
    joined = [F.expr(f"listagg({c}) WITHIN GROUP (ORDER BY `{order}`)").alias(c) for c in ("local", "central")]
    out = made.groupBy(*by, "volume").agg(F.count(F.lit(1)).alias("n_files"), *joined)
    end = F.concat(F.lit(b"PK\x05\x06"), _little(0, 4), _little(F.col("n_files"), 2), _little(F.col("n_files"), 2), _little(F.octet_length("central"), 4), _little(F.octet_length("local"), 4), _little(0, 2))
    whole = F.concat("local", "central", end)
    return out.select(*by, "volume", "n_files", F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("content"))
