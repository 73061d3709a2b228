"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier over hashed words learns from confirmed toxic texts (P) and from unlabelled ones (U), of which a
share, the class prior, is toxic too. The risk of the negative class is estimated as that of U less the prior times that
of P, and where that falls below zero its gradient is turned round, as the model is then fitting U's toxic texts as clean.
The prior is the share of toxic rows among all labelled rows of the training folds. Words weigh in by presence; an L1
step after each update keeps only words that pay. At last margins are turned into
probabilities by those of P and U under models that have not seen them (PARTS of them); labels of clean rows enter the prior alone.

Training takes a bounded sample: about MOST_POSITIVE and MOST_UNLABELLED rows at most, those whose hash is below a bound set by
the counted rows. Prior and scores cover all rows. Labels are read only for rows whose crc32(doc_id as text) mod 3 is not
1; doc_id, source and lang never enter a score.

Null texts count as empty; a text without known words scores as the bias alone says. A null doc_id counts as the text
"null" for the fold, and has no label. If several labels name a doc_id, it is toxic if any says so. With fewer
than four positive or unlabelled rows every score is the prior, and 0 without labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, read, utf8
from .native import sized

BUCKETS = 1 << 20
MOST_POSITIVE = 8_000
MOST_UNLABELLED = 16_000
#: A word needs so many positive texts of the sample: one in 60, within these bounds.
LEAST_TEXTS, MOST_TEXTS = 2, 5
PARTS = 4
HELD_OUT = 1
FOLDS = 3
THRESHOLD = 0.7
CACHE_WORDS = 300_000


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    knots: tuple[float, ...] = (0.0,)
    shares: tuple[float, ...] = (0.0,)


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary")) % FOLDS


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out = xxh64_intdigest(word, 8) & (BUCKETS - 1)
        return out


def word_set(text: bytes) -> set[bytes]:
    """The different words of the text in lower case, marks left out."""
    return set(text.decode().lower().encode().translate(_MARKS).split())


_MARKS = bytes(0x20 if c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))


def features(rows: DataFrame) -> DataFrame:
    """luck, label and the buckets of each text's words, as bytes of u32."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cache = _Buckets()
        for batch in batches:
            found = [np.array(sorted({cache[w] for w in word_set(t)}), np.uint32).tobytes() for t in utf8(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("luck"), batch.column("label"), pa.array(found, pa.binary())], ["luck", "label", "words"])

    return rows.select("luck", "label", "text").mapInArrow(run, "luck double, label int, words binary")


class _Sparse:
    """Rows of present features."""

    def __init__(self, rows: list[bytes]):
        parts = [np.frombuffer(r, np.uint32) for r in rows]
        self.n = len(parts)
        self.columns = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        self.rows = np.repeat(np.arange(self.n), [len(p) for p in parts])

    def only(self, allowed: np.ndarray) -> _Sparse:
        """With the allowed features alone, numbered anew."""
        out, kept = _Sparse([]), allowed[self.columns]
        out.n, out.columns, out.rows = self.n, (np.cumsum(allowed) - 1)[self.columns[kept]], self.rows[kept]
        return out

    def every(self, part: int, inside: bool) -> _Sparse:
        """Every PARTS-th row from part on, or all others."""
        here = (np.arange(self.n) % PARTS == part) == inside
        out, kept = _Sparse([]), here[self.rows]
        out.n, out.columns, out.rows = int(here.sum()), self.columns[kept], (np.cumsum(here) - 1)[self.rows[kept]]
        return out

    def margins(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.rows, w[self.columns], self.n) + b

    def pulled(self, per_row: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.columns, per_row[self.rows], n)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def train(positive: _Sparse, unlabelled: _Sparse, prior: float, n: int, rounds: int = 60, rate: float = 0.05, l1: float = 2e-3) -> Model:
    """Adam on the non-negative risk under the logistic loss, with a proximal L1 step; n features."""
    w, b = np.zeros(n), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for t in range(1, rounds + 1):
        p, u = positive.margins(w, b), unlabelled.margins(w, b)
        negative_risk = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        if negative_risk >= 0:
            gp = prior * (-_sigmoid(-p) - _sigmoid(p)) / positive.n
            gu = _sigmoid(u) / unlabelled.n
        else:
            gp, gu = prior * _sigmoid(p) / positive.n, -_sigmoid(u) / unlabelled.n
        g, gb = positive.pulled(gp, n) + unlabelled.pulled(gu, n), float(gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = rate / (1 - 0.9**t)
        scale = np.sqrt(v / (1 - 0.999**t)) + 1e-6
        w -= step * m / scale
        # the threshold is L1 over the curvature that Adam assumes, so rare words need a clear gradient
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1 / np.maximum(scale, l1) * 0.5, 0)
        b -= step * mb / (np.sqrt(vb / (1 - 0.999**t)) + 1e-6)
    return Model(w, b)


def calibrate(model: Model, p: np.ndarray, u: np.ndarray, prior: float) -> Model:
    """Adds knots, from margins of P and U of models that have not seen them. They turn margins into probabilities.

    The probability of a margin is the prior times P's density over U's there. As it rises with the margin, neighbours on the
    margins' line are pooled until their ratios rise (pool adjacent violators).
    """
    # above P's median, where rows are toxic beyond doubt, the ratio is 1; a sample's may fall short of it
    sure = prior * 0.5 / max(float((u >= np.median(p)).mean()), prior * 0.5)
    x = np.concatenate((p, u))
    of_p = np.append(np.full(len(p), prior / sure / len(p)), np.zeros(len(u)))
    of_u = np.append(np.zeros(len(p)), np.full(len(u), 1 / len(u)))
    pools: list[list[float]] = []  # weight of P, weight of U, sum of margins, how many
    for margin, a, b in sorted(zip(x.tolist(), of_p.tolist(), of_u.tolist())):
        pools.append([a, b, margin, 1])
        # a ratio against the one before it, by products, as the weight of U may be zero
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [y + z for y, z in zip(pools[-1], last)]
    at = [m / n for _, _, m, n in pools]
    share = [min(a / b, 1.0) if b else 1.0 for a, b, _, _ in pools]
    return Model(model.weights, model.bias, tuple(at), tuple(share))


def probability(model: Model, margins: np.ndarray) -> np.ndarray:
    """By the knots; a hundredth goes by the margin itself, so that higher margins score higher within a pool and beyond the knots."""
    return 0.99 * np.interp(margins, model.knots, model.shares) + 0.01 * _sigmoid(margins)


def fit(documents: DataFrame, labels: DataFrame) -> tuple[Model | None, float]:
    """The model (None where one class is missing) and the prior."""
    scratch = Scratch(documents.sparkSession, "toxicity")
    known = (
        labels.where(fold() != HELD_OUT).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").alias("toxic"))
    )
    known = scratch.write(known, "known")
    prior = known.agg(F.avg("toxic")).first()[0]
    if not prior or prior >= 1:
        return None, float(prior or 0.0)
    rows = documents.where(fold() != HELD_OUT).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"))
    toxic = known.where("toxic = 1").select("l_id")
    drawn = rows.join(sized(toxic), F.col("doc_id") == F.col("l_id"), "left").select("doc_id", "tag", F.col("l_id").isNotNull().alias("positive"))
    drawn = drawn.withColumn("luck", F.shiftrightunsigned(F.xxhash64("doc_id", "tag"), 33) / F.lit(float(1 << 31)))
    n_all, n_positive = drawn.agg(F.count(F.lit(1)), F.count(F.when(F.col("positive"), 1))).first()
    if not n_positive:
        return None, float(prior)
    picked = (drawn["luck"] * n_all < MOST_UNLABELLED).alias("as_unlabelled"), (drawn["positive"] & (drawn["luck"] * n_positive < MOST_POSITIVE)).alias("as_positive")
    sample = drawn.select(F.col("doc_id").alias("s_id"), F.col("tag").alias("s_tag"), "luck", *picked).where("as_unlabelled OR as_positive").distinct()
    sample = scratch.write(sample, "sample")
    texts = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"), "text")
    met = texts.join(F.broadcast(sample), F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("tag") == F.col("s_tag")))
    labelled = met.select("luck", F.explode(F.array_compact(F.array(F.when(F.col("as_positive"), 1), F.when(F.col("as_unlabelled"), 2)))).alias("label"), "text")
    got = sorted(features(labelled).distinct().collect(), key=lambda r: (r["luck"], r["label"], r["words"]))
    of = {k: [r["words"] for r in got if r["label"] == k] for k in (1, 2)}
    if min(map(len, of.values())) < 4:
        return None, float(prior)
    rows = {k: _Sparse(v) for k, v in of.items()}
    least_texts = min(max(rows[1].n // 60, LEAST_TEXTS), MOST_TEXTS)
    allowed = np.bincount(rows[1].columns, minlength=BUCKETS) >= least_texts
    rows = {k: x.only(allowed) for k, x in rows.items()}
    n = int(allowed.sum())
    p, u = [], []
    for part in range(PARTS):
        learnt, rest = ({k: x.every(part, late) for k, x in rows.items()} for late in (False, True))
        model = train(learnt[1], learnt[2], float(prior), n)
        p.append(rest[1].margins(model.weights, model.bias))
        u.append(rest[2].margins(model.weights, model.bias))
    model = calibrate(train(rows[1], rows[2], float(prior), n), np.concatenate(p), np.concatenate(u), float(prior))
    weights = np.zeros(BUCKETS)
    weights[allowed] = model.weights
    return Model(weights, model.bias, model.knots, model.shares), float(prior)


def score(documents: DataFrame, model: Model | None, prior: float) -> DataFrame:
    """doc_id, held_out, score, predicted. Only the weights that aren't zero go out to the tasks."""
    spark = documents.sparkSession
    if model is None:
        scored = documents.select("doc_id", F.lit(float(prior)).alias("score"))
    else:
        at = np.flatnonzero(model.weights)
        sent = spark.sparkContext.broadcast((at, model.weights[at], Model(model.weights[:0], model.bias, model.knots, model.shares)))

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            at, values, rest = sent.value
            weight_of, cache = dict(zip(at.tolist(), values.tolist())), _Buckets()
            for batch in batches:
                out = []
                for text in utf8(batch, "text"):
                    hit = {cache[w] for w in word_set(text)} & weight_of.keys()
                    out.append(rest.bias + sum(weight_of[k] for k in sorted(hit)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(probability(rest, np.array(out, float)))], ["doc_id", "score"])

        kind = dict(documents.dtypes)["doc_id"]
        scored = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score(documents, *fit(documents, labels))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
