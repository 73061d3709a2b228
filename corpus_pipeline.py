"""A corpus pipeline of five stages: language, exact copies, near copies, benchmark passages, packing.

Each stage takes what its predecessor kept. The first four return documents with all their columns; the last returns the
packed pieces. Null texts count as empty in every stage; rows with null or repeated doc_ids are judged by id and text; of rows that
are equal in both, the copy stages keep one; extra columns come through whatever their names; an empty table gives none. Very long
texts are read whole. No SQL oracle: tokens, fingerprints and language posteriors have no SQL form; tests hold the rows against
brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import decontamination, exact_dedup, language, packing, simhash
from docloom.llm.common import Scratch, read
from docloom.shipping import ship


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return language.keep_accepted(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return exact_dedup.keep_one_copy(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.keep_one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", keep_language),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("best_fit_packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
