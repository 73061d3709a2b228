"""Connected components by alternating large-star and small-star rounds over written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the smallest node near it."""
    both = edges.union(edges.select("b", "a").toDF("a", "b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them; edges come as (larger, smaller)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a")
    return tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (a long, b long) to (node, root), root the smallest node of the component; isolated nodes don't occur.

    Every round is written; the rounds end when none changes the edges, after about log2 of the longest path.
    """
    now = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges0")
    state, turn = None, 0
    while True:
        turn += 1
        new = scratch.write(_small_star(_large_star(now).distinct()).distinct(), f"edges{turn}")
        scratch.drop(f"edges{turn - 1}")
        now = new
        got = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == got:
            break
        state = got
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
