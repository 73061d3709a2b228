"""Language identification by fusing evidence under Bayes' rule.

Four kinds of evidence speak about a row's language: its text (byte trigrams), the language its markup or metadata
declares, the suffix of its address, and the host that it is from. All tables come from grouped aggregation over all rows:

* trigram counts per declared language, in BUCKETS hashed buckets, with add-one smoothing; a text's likelihood is its mean
  per trigram times at most EFFECTIVE trigrams, as overlapping trigrams are no independent witnesses;
* how often each language (by text) is declared as each other one, and is served below each suffix;
* counts of languages by host, by its domain, by suffix and over all rows: each level is smoothed towards the one above
  with the weight of STRENGTH rows.

Every declared code of two or three letters takes part; the models go out in blocks of BLOCK languages. A background model
(trigrams evenly over the buckets) stands for all that no declared language explains: a text that it explains best, and a row
without any trigram and without a declaration, is "und". A row is accepted if its language is known and its posterior reaches
LEAST. Null texts count as empty; null, blank or malformed declarations, null or blank hosts, and missing columns, are no
evidence. Rows that repeat a doc_id get a row each. Texts are read whole, however long. An empty table gives no rows; where
nothing is declared at all, everything is "und".
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Scratch, read, row_key, utf8
from .native import free_name, sized

BLOCK = 64
BUCKETS = 1 << 16
EFFECTIVE = 200
STRENGTH = 20.0
LEAST = 0.5
#: Prior of the background model.
BACKGROUND = 0.01

_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def trigrams(text: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of a text's words, lower-cased and set in single blanks."""
    b = np.frombuffer(b" " + b" ".join(text.translate(_FOLD).split()) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.uint32)
    return ((b[:-2] * np.uint32(0x1F35) + b[1:-1] * np.uint32(0x9E5) + b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)


#: Language that an html tag declares, in any case.
MARKUP = r"""(?i)<html[^>]*\slang\s*=\s*["']?([A-Za-z]{2,3})\b"""


def evidence(rows: DataFrame, blind: Column | None = None) -> DataFrame:
    """key, declared, suffix, domain and host beside the text, as far as the columns lang, markup, url and source tell them.

    Markup, in a column of its own or in the text, declares a language before the column lang does; a host comes from url before
    source. Declarations of rows that blind holds for are not read.
    """
    none = F.lit(None).cast("string")

    def column(name: str) -> Column:
        return F.col(name).cast("string") if name in rows.columns else none

    def known(c: Column) -> Column:
        return F.when(F.trim(c) != "", F.lower(F.trim(c)))

    def code(c: Column) -> Column:
        return F.when(F.rlike(known(c), F.lit("^[a-z]{2,3}$")), known(c))

    text = F.coalesce("text", F.lit(""))
    markup = F.when(F.contains(text, F.lit("<")), F.regexp_extract(text, MARKUP, 1))
    host = known(F.regexp_extract(F.coalesce(column("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    parts = F.split(host, r"\.")
    declared = F.coalesce(code(column("markup")), code(markup), code(F.substring_index(column("lang"), "-", 1)))
    return rows.select(
        "doc_id",
        row_key().alias("key"),
        (declared if blind is None else F.when(~blind, declared)).alias("declared"),
        F.element_at(parts, -1).alias("suffix"),
        F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), F.lit(2)), ".").alias("domain"),
        F.coalesce(host, known(column("source"))).alias("host"),
        text.alias("text"),
    )


def page_rows(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) as rows for identify: doc_id, url, markup and the text that a reader sees."""
    html = F.coalesce("html", F.lit(""))
    seen = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return pages.select(F.col("page_id").alias("doc_id"), "url", F.regexp_extract(html, MARKUP, 1).alias("markup"), seen.alias("text"))


def trigram_counts(rows: DataFrame, languages: list[str]) -> DataFrame:
    """language, bucket, n over all rows that declare one of the languages."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        place = {x: i for i, x in enumerate(languages)}
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            for declared, text in zip(batch.column("declared").to_pylist(), utf8(batch, "text")):
                if (i := place.get(declared)) is not None:
                    np.add.at(counts[i], trigrams(text), 1)
        i, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[i, bucket])], ["language", "bucket", "n"]
        )

    found = rows.select("declared", "text").mapInArrow(run, "language int, bucket int, n long")
    return found.groupBy("language", "bucket").agg(F.sum("n").alias("n"))


def log_likelihoods(rows: DataFrame, tables: list[np.ndarray]) -> DataFrame:
    """rows with ll, the log-likelihood of the text by language, and heft, the trigrams that it counts for, instead of the text.

    One pass for each block of languages; each has its own table. All 0 without trigrams.
    """
    told = [c for c in rows.columns if c != "text"]
    for i, weights in enumerate(tables):
        rows = _with_block(rows, f"ll{i}", weights, "heft" if i == 0 else None)
    return rows.select(*told, F.concat(*(F.col(f"ll{i}") for i in range(len(tables)))).alias("ll"), "heft")


def _with_block(rows: DataFrame, name: str, weights: np.ndarray, heft: str | None) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(weights.T))
    kept = rows.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + f", {name} array<double>" + (f", {heft} int" if heft else "")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = sent.value
        for batch in batches:
            out, counts = np.zeros((batch.num_rows, table.shape[1])), np.zeros(batch.num_rows, np.int32)
            for i, text in enumerate(utf8(batch, "text")):
                grams = trigrams(text)
                counts[i] = min(len(grams), EFFECTIVE)
                if len(grams):
                    out[i] = sum(table[grams[j : j + 500_000]].sum(0) for j in range(0, len(grams), 500_000)) / len(grams) * counts[i]
            more = [pa.array(list(out), pa.list_(pa.float64())), *([pa.array(counts)] if heft else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*kept, name, *([heft] if heft else [])])

    return rows.mapInArrow(run, schema)


def _table(counts: DataFrame, n: int) -> np.ndarray:
    """Log-probabilities of the buckets by language, add-one smoothed; at most BLOCK x BUCKETS counts."""
    out = np.ones((n, BUCKETS))
    got = counts.toArrow()
    out[got.column("language").to_numpy(), got.column("bucket").to_numpy()] += got.column("n").to_numpy()
    return np.log(out / out.sum(1, keepdims=True))


def _counts(n: int) -> Column:
    """Rows by language as an array."""
    return F.array(*(F.sum(F.when(F.col("by_text") == i, 1).otherwise(0)) for i in range(n)))


def _smoothed(counts: Column, above: Column, strength: float = STRENGTH) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, above, lambda c, p: (c + F.lit(strength) * p) / (total + strength))


def identify(rows: DataFrame, scratch: Scratch | None = None, blind: Column | None = None) -> DataFrame:
    """Per row: doc_id, key, language, confidence, accepted, declared, text_language."""
    spark = rows.sparkSession
    scratch = scratch or Scratch(spark, "language")
    told = evidence(rows, blind)
    # at most 26 * 26 * 27 codes
    languages = sorted(r["declared"] for r in told.where("declared IS NOT NULL").select("declared").distinct().collect())
    if not languages:
        und = told.select("doc_id", "key", F.lit("und").alias("language"), F.lit(0.0).alias("confidence"), F.lit(False).alias("accepted"))
        return und.withColumns({"declared": F.lit(None).cast("string"), "text_language": F.lit(None).cast("string")})
    n = len(languages)
    blocks = [languages[i : i + BLOCK] for i in range(0, n, BLOCK)]
    tables = [_table(scratch.write(trigram_counts(told, block), f"trigrams{i}"), len(block)) for i, block in enumerate(blocks)]
    judged = log_likelihoods(told, tables).withColumn("spoken", F.col("heft") > 0)
    by_text = F.when(F.col("spoken"), F.array_position("ll", F.array_max("ll")).cast("int") - 1)
    judged = scratch.write(judged.withColumn("by_text", by_text), "judged")

    flat = F.array(*(F.lit(1.0 / n) for _ in range(n)))
    overall = judged.agg(_counts(n).alias("c")).select(_smoothed(F.col("c"), flat).alias("p")).first()["p"]

    def level(name: str) -> DataFrame:
        counted = judged.where(F.col(name).isNotNull() & F.col("by_text").isNotNull()).groupBy(name).agg(_counts(n).alias(f"n_{name}"))
        return scratch.write(counted.withColumnRenamed(name, f"of_{name}"), name)

    out = judged
    for name in ("declared", "suffix", "domain", "host"):
        table = level(name)
        out = out.join(sized(table), F.col(name) == F.col(f"of_{name}"), "left").drop(f"of_{name}")
    none = F.array(*(F.lit(0).cast("long") for _ in range(n)))
    prior = F.array(*(F.lit(float(p)) for p in overall))
    for name in ("suffix", "domain", "host"):
        prior = _smoothed(F.coalesce(F.col(f"n_{name}"), none), prior)
    # P(declared | language) by Bayes from the languages among rows that declare it
    overall_log = F.array(*(F.lit(float(np.log(p))) for p in overall))
    share = _smoothed(F.coalesce(F.col("n_declared"), none), F.array(*(F.lit(float(p)) for p in overall)), 1.0)
    said = F.zip_with(F.transform(share, lambda x: F.log(x)), overall_log, lambda a, b: a - b)
    out = out.withColumn("prior", F.transform(prior, lambda x: F.log(x))).withColumn("said", said)
    out = out.withColumn("sum", F.zip_with(F.zip_with("ll", "prior", lambda a, b: a + b), "said", lambda a, b: a + b))
    out = out.withColumn("top", F.array_max("sum"))
    strange = F.col("heft") * F.lit(-float(np.log(BUCKETS))) + F.lit(float(np.log(BACKGROUND)))
    told_by = F.when(F.col("spoken"), strange).otherwise(F.lit(float("-inf")))  # a declaration alone is taken at its word
    total = F.aggregate("sum", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))) + F.exp(F.least(told_by - F.col("top"), F.lit(700.0)))
    codes = F.array(*(F.lit(x) for x in languages))
    sure = (F.col("spoken") & (F.col("top") >= told_by)) | (~F.col("spoken") & F.col("n_declared").isNotNull())
    language = F.when(sure, F.element_at(codes, F.array_position("sum", F.col("top")).cast("int"))).otherwise("und")
    confidence = F.when(sure, 1 / total).otherwise(0.0)
    return out.select(
        "doc_id", "key", language.alias("language"), confidence.alias("confidence"), (sure & (confidence >= LEAST)).alias("accepted"),
        "declared", F.element_at(codes, F.col("by_text") + 1).alias("text_language"),
    )


def held_out_accuracy(rows: DataFrame, parts: int = 5) -> tuple[float, float]:
    """Shares of declared rows whose language is the declared one: over all rows, and over one in parts whose own declaration is
    read neither for the tables nor as evidence."""
    blind = F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == 0
    right = F.avg((F.col("language") == F.col("told")).cast("double"))
    told = evidence(rows).where("declared IS NOT NULL").select(F.col("key").alias("t_key"), F.col("declared").alias("told"))
    shares = []
    for hidden in (None, blind):
        got = identify(rows, blind=hidden).join(told, F.col("key") == F.col("t_key"))
        shares.append((got if hidden is None else got.where(hidden)).agg(right).first()[0])
    return shares[0], shares[1]


def keep_accepted(documents: DataFrame, languages: tuple[str, ...] | None = None) -> DataFrame:
    """The documents without those whose language is unknown, in doubt or, if languages are named, none of them."""
    scratch = Scratch(documents.sparkSession, "language")
    name = free_name(documents, "gone")
    refused = ~F.col("accepted") if languages is None else ~F.col("accepted") | ~F.col("language").isin(*languages)
    gone = scratch.write(identify(documents, scratch).where(refused).select(F.col("key").alias(name)).distinct(), "rejected")
    return documents.join(sized(gone), row_key() == F.col(name), "left_anti")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over documents (declared by lang, host from source) and over pages (declared by markup, address from url)."""
    none = F.lit(None).cast("long")
    documents = identify(read(spark, sf_dir, "documents")).drop("key").withColumn("page_id", none)
    pages = identify(page_rows(read(spark, sf_dir, "pages"))).drop("key").withColumns({"page_id": F.col("doc_id").cast("long"), "doc_id": none})
    return documents.unionByName(pages)
