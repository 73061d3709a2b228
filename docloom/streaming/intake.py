"""Files that arrive in a folder, detected and gated as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.detect import gate
from ..sources.files import SCHEMA, _named, typed


def stream_files(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Arriving files that aren't empty, with name, extension, kind and label."""
    raw = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).load(path)
    return typed(_named(raw.where("length > 0")))


def stream_gated(files: DataFrame, target: Column) -> DataFrame:
    """Each arriving file with its target, status and error; contents that can't be converted are left out at once."""
    gated = gate(files.withColumn("target", target))
    return gated.withColumn("content", F.when(F.col("status") == "ready", F.col("content")))


def run_once(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Works through all files there are and ends; rows land in Parquet exactly once."""
    done = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    done.awaitTermination()
