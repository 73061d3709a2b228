"""Ranks, running sums and joins back that stay even where one key holds much of a table."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Order values that share one window; a key's rows are split into stretches of so many.
STRETCH = 100_000
SALTS = 16


def before(rows: DataFrame, keys: list[str], order: str, value: Column, name: str, stretch: int = STRETCH) -> DataFrame:
    """rows with the sum of value over the key's rows that come earlier by a whole-number order.

    Each key is cut into stretches of the order. Their sums are small and run up in one window; within a stretch the rows
    run up in another.
    """
    cut = rows.withColumn("_stretch", F.floor(F.col(order) / F.lit(stretch)).cast("long")).withColumn("_value", value.cast("long"))
    sums = cut.groupBy(*keys, "_stretch").agg(F.sum("_value").alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(*keys, "_stretch", F.coalesce(earlier, F.lit(0)).alias("_start"))
    within = F.sum("_value").over(Window.partitionBy(*keys, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    out = cut.withColumn("_within", F.coalesce(within, F.lit(0))).join(starts, [*keys, "_stretch"])
    return out.select(*rows.columns, (F.col("_start") + F.col("_within")).alias(name))


def rejoined(rows: DataFrame, facts: DataFrame, key: str, spread: str) -> DataFrame:
    """rows joined with one fact row per key; rows of a key are spread over SALTS tasks by another column."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [key, "_salt"]).drop("_salt")


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder that driver and executors share; one is set only where none is and Spark runs on one machine."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(base or tempfile.mkdtemp(prefix="docloom-checkpoints-"))
    return df.checkpoint()
