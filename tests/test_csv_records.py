"""Records of CSV files whose values hold line breaks, found in splits, against Python's csv."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import cells


@pytest.fixture(scope="module")
def table():
    dice = random.Random(4)
    value = lambda: "".join(dice.choice(('"', "\n", ",", "\r\n", "é", "a", "b", "\x01", "\x02", "\x01\x03", " ")) for _ in range(dice.randrange(7)))
    rows = [[value() for _ in range(dice.randrange(1, 5))] for _ in range(120)]
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n").writerows(rows)
    text = out.getvalue()
    return text, [r for r in csv.reader(io.StringIO(text, newline="")) if r]


@pytest.mark.parametrize("cut", [7, 64, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_files_cut_anywhere(spark, tmp_path, table, cut, end):
    text, want = table
    if end == "\r\n":
        out = io.StringIO(newline="")
        csv.writer(out, lineterminator=end).writerows(want)
        text = out.getvalue()
    (tmp_path / "x.csv").write_bytes(b"\xef\xbb\xbf" + text.encode())
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", str(cut))
    own.conf.set("spark.sql.files.openCostInBytes", "1")
    got = cells.read_csv_records(own, str(tmp_path / "x.csv"), ",")
    rows = [r["cells"] for r in got.orderBy("at").collect()]
    assert rows == want
    if cut < 1000:
        assert cells.read_csv_lines(own, str(tmp_path / "x.csv")).select(F.spark_partition_id()).distinct().count() > 5


def test_stretches_and_files(spark, table):
    text, want = table
    lines = [(f, k * 1000, line) for f in ("a", "b") for k, line in enumerate(text.removesuffix("\n").split("\n"))]
    random.Random(1).shuffle(lines)
    found = cells.csv_records(spark.createDataFrame(lines, "file string, at long, line string"), ["file"], "at", 5000).where("record <> ''")
    got = found.select("file", "at", cells.csv_values(F.col("record"), ",").alias("cells")).orderBy("file", "at").collect()
    assert [r["cells"] for r in got] == want * 2


def test_open_ends_nulls_and_long_values(spark):
    long = '""x' * 50_000
    files = [(1, 'a;"b\nc'), (2, None), (3, ""), (4, f'"{long}";2\n\n3;4'), (5, 'a,"x\ny";z,"\n')]
    got = {(r["file_id"], r["row_ord"]): r["cells"] for r in cells.csv_cells(spark.createDataFrame(files, "file_id long, text string")).collect()}
    assert got == {(1, 0): ["a", "b\nc"], (4, 0): ['"x' * 50_000, "2"], (4, 2): ["3", "4"], (5, 0): ["a", 'x\ny";z', "\n"]}
