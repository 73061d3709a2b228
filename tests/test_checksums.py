"""Checksums of files in parts, and archives by columns, against zlib and zipfile."""

import io
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from docloom.operators import checksums


def test_checksums_of_random_splits(spark):
    dice = random.Random(3)
    rows, want = [], {}
    for f in range(12):
        whole = dice.randbytes(dice.choice((0, 1, 7, 1000, 70_000)))
        cuts = sorted(dice.randrange(len(whole) + 1) for _ in range(dice.randrange(9)))
        parts = [whole[a:b] for a, b in zip([0, *cuts], [*cuts, len(whole)])]
        rows += [(f, k * 3 - 5, p if p or k % 2 else None) for k, p in enumerate(parts)]
        want[f] = (len(parts), len(whole), zlib.crc32(whole))
    dice.shuffle(rows)
    got = checksums.crc32_combined(spark.createDataFrame(rows, "file long, pos long, body binary"), ["file"], "pos", "body").collect()
    assert {r["file"]: tuple(r[1:]) for r in got} == want


def test_checksums_moved_past_terabytes(spark):
    """Past n bytes twice is past 2 n bytes once, beyond what can be held here."""
    n = [0, 1, 255, 1 << 20, (1 << 40) + 12_345, (1 << 46) + 1]
    rows = spark.createDataFrame([(c, k) for c in (1, 0xDEADBEEF, 0xFFFFFFFF) for k in n], "c long, n long")
    once = checksums.moved_past(F.col("c"), F.col("n"))
    assert rows.where(checksums.moved_past(once, F.col("n")) != checksums.moved_past(F.col("c"), F.col("n") * 2)).count() == 0
    assert rows.where((F.col("n") == 0) & (once != F.col("c"))).count() == 0


@pytest.mark.parametrize("most", [400, 5_000, 1 << 28])
def test_volumes_hold_their_bound(spark, most):
    dice = random.Random(8)
    files = [("é", i, f"п{i}.txt", dice.randbytes(dice.choice((0, 3, 90, 170, 2_000)))) for i in range(40)] + [("b", 0, "x", None)]
    made = checksums.zip_volumes(spark.createDataFrame(files, "batch string, pos long, name string, body binary"), ["batch"], "pos", "name", "body", most).collect()
    got, last = [], {}
    for r in sorted(made, key=lambda r: (r["batch"], r["volume"])):
        with zipfile.ZipFile(io.BytesIO(bytes(r["content"]))) as z:
            assert z.testzip() is None and len(z.namelist()) == r["n_files"] and r["n_bytes"] == len(r["content"])
            assert all(i.date_time == (2000, 1, 1, 0, 0, 0) for i in z.infolist())
            got += [(r["batch"], n, z.read(n)) for n in z.namelist()]
            assert r["n_bytes"] <= most or r["n_files"] == 1
    assert got == sorted(((b, n, body or b"") for b, _, n, body in files), key=lambda x: x[0] == "é")
    if most == 1 << 28:
        assert len(made) == 2


def test_no_files(spark):
    none = spark.createDataFrame([], "batch string, pos long, name string, body binary")
    assert checksums.zip_volumes(none, ["batch"], "pos", "name", "body").count() == 0
    assert checksums.crc32_combined(none, ["batch"], "pos", "body").count() == 0


def test_archives_have_a_bound_of_files(spark):
    files = spark.range(140_000).select(F.lit("b").alias("batch"), F.col("id").alias("pos"), F.col("id").cast("string").alias("name"), F.lit(b"").alias("body"))
    made = checksums.zip_volumes(files, ["batch"], "pos", "name", "body").collect()
    assert sum(r["n_files"] for r in made) == 140_000 and all(r["n_files"] < 65_536 for r in made)
    with zipfile.ZipFile(io.BytesIO(bytes(made[0]["content"]))) as z:
        assert len(z.namelist()) == made[0]["n_files"]
