"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is WINDOW consecutive words of a benchmark item, or the whole of a shorter item. Of the hashes of the GRAM-word
grams inside each window the smallest is its fingerprint. Both sides pick it by the same rule, so a document that holds a
window holds its fingerprint too: no shared window is missed. Documents are fingerprinted row by row without a shuffle
and joined with the benchmark's fingerprints. Where they meet, the hit is extended: the windows with a met fingerprint are
built word for word and joined with the benchmark's windows. The work per text is linear in its words.

The benchmark's tables are broadcast if their counted rows are within native.BROADCAST_ROWS, else shuffled; likewise the
keys of documents with hits. Null texts have no words. Items without words have no windows; a null item_id counts as no
item. Rows that repeat a doc_id keep results of their own. Empty tables give rows without hits, or none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Scratch, read, row_key
from .native import BROADCAST_ROWS, exact_words, free_name, grams, let, loose_words, sized, text_of

WINDOW = 10
GRAM = 5


def _gram_hashes(words: Column, n: int) -> Column:
    return grams(words, n, lambda w: F.xxhash64(F.lit(n), w))


def _winnowed(words: Column) -> Column:
    """The fingerprints of all full windows of the words, by start; null if there is none."""
    span = WINDOW - GRAM + 1
    return let(_gram_hashes(words, GRAM), lambda h: F.when(F.size(h) >= span, grams(h, span, F.array_min)))


def _fingerprints(words: Column, short: list[int]) -> Column:
    """Fingerprints of full windows, and the hashes of all grams as long as some short item."""
    parts = [F.array_distinct(_winnowed(words)), *(_gram_hashes(words, n) for n in short)]
    return F.flatten(F.array_compact(F.array(*parts))) if short else parts[0]


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, n (words of the window), window (its words joined by a blank), fps (its fingerprint, with loose words)."""
    items = benchmark.select("item_id", exact_words(text_of()).alias("w"), loose_words(text_of()).alias("v")).where("size(w) > 0")
    n = F.least(F.size("w"), F.lit(WINDOW))
    starts = items.select("item_id", "w", "v", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("s"))
    full = F.array_min(_gram_hashes(F.col("part"), GRAM))
    short = F.coalesce(*(F.when(F.col("n") == k, F.xxhash64(F.lit(k), F.col("part"))) for k in range(1, WINDOW)))
    return (
        starts.withColumn("part", F.slice("v", F.col("s"), F.col("n")))
        .select(
            "item_id", "n", F.array_join(F.slice("w", F.col("s"), F.col("n")), " ").alias("window"),
            F.when(F.col("n") == WINDOW, full).otherwise(short).alias("fp"),
        )
        .distinct()
    )


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of documents: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    facts = contaminated_keys(documents, benchmark)
    counted = documents.select("doc_id", row_key().alias("key"), F.size(loose_words(text_of())).cast("long").alias("n_words"))
    empty = F.array().cast("array<string>")
    return counted.join(facts, "key", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(F.coalesce("items", empty)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", empty), ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def contaminated_keys(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per contaminated row key: key, n_hit, items."""
    scratch = Scratch(documents.sparkSession, "decontamination")
    windows = scratch.write(benchmark_windows(benchmark), "windows")
    short = sorted(r["n"] for r in windows.where(F.col("n") < WINDOW).select("n").distinct().collect())
    keyed = documents.select(row_key().alias("key"), text_of().alias("text"))

    # 1. which documents hold a fingerprint of the benchmark
    fps = windows.select("n", "fp").distinct()
    prints = keyed.select("key", F.explode(let(loose_words(F.col("text")), lambda w: _fingerprints(w, short))).alias("fp"))
    hits = scratch.write(prints.join(sized(fps.select("fp").distinct()), "fp").select("key").distinct(), "hits")

    # 2. the places of their windows that have such a fingerprint, and these windows word for word
    found = keyed.join(sized(hits), "key").select("key", exact_words(F.col("text")).alias("w"), loose_words(F.col("text")).alias("v"))
    by_length = [_winnowed(F.col("v")), *(_gram_hashes(F.col("v"), n) for n in short)]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), f.alias("fps")) for n, f in zip([WINDOW, *short], by_length)))).alias("x")
    places = found.select("key", each).select("key", F.col("x.n").alias("n"), F.posexplode("x.fps").alias("at", "fp"))
    met = places.join(sized(fps), ["n", "fp"]).select("key", "n", (F.col("at") + 1).alias("s"))
    starts = scratch.write(met.groupBy(F.col("key").alias("k")).agg(F.collect_list(F.struct("s", "n")).alias("starts")), "starts")
    n_starts = starts.agg(F.sum(F.size("starts") + 2)).first()[0] or 0  # in longs, keys included
    some = found.join(F.broadcast(starts) if n_starts <= BROADCAST_ROWS else starts, F.col("key") == F.col("k"))
    built = some.select("key", F.explode(let(F.struct("w", "starts"), lambda x: F.transform(
        x["starts"], lambda a: F.struct(a["s"].alias("s"), a["n"].alias("n"), F.array_join(F.slice(x["w"], a["s"], a["n"]), " ").alias("window")),
    ))).alias("x")).select("key", "x.*")
    # the items of a window come as one array, so that a window of many items makes no more rows
    of_window = windows.groupBy("n", "window").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("held"))
    exact = scratch.write(built.join(sized(of_window), ["n", "window"]).drop("window"), "exact")

    # 3. per document: the words under windows, and the items
    words = F.size(F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("s", "n")), lambda x: F.sequence(x["s"], x["s"] + x["n"] - 1)))))
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_set("held"))))
    return scratch.write(exact.groupBy("key").agg(words.cast("long").alias("n_hit"), items.alias("items")), "facts")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without the rows that hold a window of the benchmark; other rows of the same doc_id stay."""
    name = free_name(documents, "bad")
    bad = contaminated_keys(documents, benchmark).select(F.col("key").alias(name))
    return documents.join(sized(bad), row_key() == F.col(name), "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT k, n, s, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT k, n, s, item_id FROM dw JOIN bw USING (n, win)),
cov AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(s, s + n)) AS p FROM hit) GROUP BY k),
its AS (SELECT k, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hit GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN cov USING (k) LEFT JOIN its USING (k)
"""
