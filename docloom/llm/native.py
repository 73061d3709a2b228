"""Column helpers for the operators that stay within DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: Keys of about 16 bytes, so some 64 MB at most where they are broadcast; above it the join shuffles.
BROADCAST_ROWS = 2_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates value once and hands it to body, also within lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def loose_words(text: Column) -> Column:
    """Words in lower case beyond ASCII too: fast, with as many words as exact_words and equal where those are."""
    return F.array_remove(F.split(F.lower(text), NOT_WORD), "")


def exact_words(text: Column) -> Column:
    """Words of the text with A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), NOT_WORD), "")


def grams(words: Column, n: int, of: Callable[[Column], Column]) -> Column:
    """``of`` each n consecutive words, by start; empty if there are fewer words."""
    every = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: of(F.slice(words, i, n)))
    return F.when(F.size(words) >= n, every)


def without(documents: DataFrame, gone: DataFrame, repeated: DataFrame, key: Callable[[], Column]) -> DataFrame:
    """documents without the rows whose key is in gone, and with one row of each key in repeated; both have a column k.

    Rows of a repeated key are told apart by their columns: the least row stays. They are combined before the shuffle,
    so a key on many rows meets as one row a task.
    """
    name = free_name(documents, "k")
    gone, repeated = (x.select(F.col("k").alias(name)) for x in (gone, repeated))
    rest = documents.join(sized(gone), key() == F.col(name), "left_anti")
    if repeated.isEmpty():
        return rest
    once = rest.join(sized(repeated), key() == F.col(name), "left_anti")
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns))
    many = rest.join(sized(repeated), key() == F.col(name)).groupBy(name).agg(F.min(row).alias("row")).select("row")
    return once.unionByName(many.select("row.*"))


def free_name(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sized(small: DataFrame) -> DataFrame:
    """For broadcast if its rows, counted, are within the bound; as it is otherwise."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small
