"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Texts are tokenised where they lie; what moves is one narrow row per piece. Only the counts of the SEQUENCE possible
lengths decide the packing: on them the driver fills a bin greedily with the longest lengths that fit, then replaces the
bin's smallest document by the two unpacked ones that fill the widened gap best, and repeats that bin as often as the
counts allow. The plan has a few rows per length however many documents there are. Each piece finds its place by its
rank among the pieces of its length; ranks are dealt in salted groups, so that one frequent length is no single task.

Null texts count as empty: one piece with the end id alone. Repeated rows are packed once each. Ties between equal pieces
are broken by doc_id, piece and checksum; equal rows may swap places. An empty table gives no rows.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Scratch, read

SEQUENCE = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
#: Words, and runs of them, kept with their ids in each generation of a Python worker's cache, some 200 bytes each.
CACHE_WORDS = 100_000
#: Bytes of text that are looked up at once.
CHUNK_BYTES = 1_000_000
#: New runs in one call of the tokenizer.
CALL_RUNS = 2_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


# A simple word: letters that normalising only lower-cases, one by one, and ASCII marks behind them: one token run each. All other
# words (among them those with letters that normalising may take apart, so that a mark joins what follows) are encoded by themselves.
_MARKS = ".,;:!?%&*#$"
_SIMPLE = rf"\A[A-Za-z\x{{C0}}-\x{{D6}}\x{{D8}}-\x{{F6}}\x{{F8}}-\x{{12F}}\x{{131}}-\x{{17F}}]+[{_MARKS}]*\z"
_BLANK = re.compile(rb"[ \t\n\r\x0b\x0c]")


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level BPE shows each byte: itself if it prints in Latin-1, else the next from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown and b != 0x20]
    return {b: chr(256 + i + (b > 0x20)) for i, b in enumerate(rest)}


class _Kept:
    """Ids of words or runs, in two generations: when the younger is full, it becomes the older and what the older held goes."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, keys: list[str], learn: Callable[[list[str]], Iterable[bytes]]) -> list[bytes]:
        """Ids of the (different) keys; learn gives those of the keys that neither generation holds."""
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        out = list(map(self.young.get, keys))
        holes = [i for i, x in enumerate(out) if x is None]
        unknown = []
        for i in holes:
            key = keys[i]
            if (ids := self.old.get(key)) is None:
                unknown.append(i)
            else:
                out[i] = self.young[key] = ids
        if unknown:
            names = [keys[i] for i in unknown]
            found = list(learn(names))
            self.young.update(zip(names, found))
            for i, ids in zip(unknown, found):
                out[i] = ids
        return out


class WordTokenizer:
    """Ids of texts as bytes of little-endian u32, word by word.

    The tokenizer drops white space and never joins over it, so a text's ids are those of its blank-separated words; those of a
    simple word are those of its letters and of the marks behind them. Each different run of a chunk is looked up once.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        #: the model alone, for runs that are normalised and shown as byte letters already
        self.model_only = Tokenizer(self.tokenizer.model)
        self.model_only.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = _byte_letters()
        suffix = self.tokenizer.model.end_of_word_suffix
        #: by id, whether a token ends a run; tells the runs of a joined call apart
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self.runs, self.odd = _Kept(), _Kept()

    def _run_ids(self, runs: list[str]) -> Iterator[bytes]:
        for k in range(0, len(runs), CALL_RUNS):
            part = runs[k : k + CALL_RUNS]
            shown = " ".join(part)
            if not shown.isascii():
                shown = shown.encode().decode("latin-1").translate(self.letters)
            ids = np.array(self.model_only.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) != len(part):
                raise ValueError("the tokenizer parts runs in another way")
            data, at = ids.tobytes(), 0
            for stop in stops:
                yield data[at:stop]
                at = stop

    def _odd_ids(self, words: list[str]) -> Iterator[bytes]:
        for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False):
            yield array("I", e.ids).tobytes()

    def encode_chunk(self, texts) -> list[bytes]:
        """Of an Arrow array of strings without nulls: words, their letters and their marks are told apart by Arrow, and only
        different runs are looked up."""
        import pyarrow as pa
        import pyarrow.compute as pc

        parted = pc.ascii_split_whitespace(texts)
        coded = parted.flatten().dictionary_encode()
        words = coded.dictionary
        simple = pc.match_substring_regex(words, _SIMPLE)
        at, odd_at = np.flatnonzero(simple.to_numpy(False)), np.flatnonzero(~simple.to_numpy(False))
        lowered = pc.utf8_lower(words.filter(simple))
        letters = pc.ascii_rtrim(lowered, _MARKS)
        marked = pc.greater(pc.binary_length(lowered), pc.binary_length(letters))
        tails = pc.replace_substring_regex(lowered.filter(marked), rf"\A[^{_MARKS}]+", "")
        runs = pa.concat_arrays([letters, tails]).dictionary_encode()
        each = [*self.runs.of(_strings(runs.dictionary), self._run_ids), *self.odd.of(_strings(words.take(pa.array(odd_at))), self._odd_ids), b""]
        # of each different word, two parts of what was looked up
        parts = np.full((len(words), 2), len(each) - 1)
        of_run = runs.indices.to_numpy()
        parts[at, 0] = of_run[: len(at)]
        parts[at[marked.to_numpy(False)], 1] = of_run[len(at) :]
        parts[odd_at, 0] = len(runs.dictionary) + np.arange(len(odd_at))
        ids = np.frombuffer(b"".join(each), "<u4")
        n = np.fromiter(map(len, each), np.int64, len(each)) // 4
        places = parts[coded.indices.to_numpy()].ravel()
        lengths = n[places]
        stops = np.cumsum(lengths)
        flat = ids[np.arange(lengths.sum()) + np.repeat((np.cumsum(n) - n)[places] - stops + lengths, lengths)].tobytes()
        bounds = np.concatenate(([0], stops))[2 * (parted.offsets.to_numpy() - parted.offsets[0].as_py())] * 4
        return [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def encode_all(self, texts) -> Iterator[bytes]:
        """Of an Arrow array of strings without nulls, chunk by chunk; a text beyond a chunk is cut at blanks."""
        import pyarrow as pa
        import pyarrow.compute as pc

        sizes, start, held = pc.binary_length(texts).to_pylist(), 0, 0
        for i, size in enumerate([*sizes, CHUNK_BYTES + 1]):
            if held + size > CHUNK_BYTES:
                if i > start:
                    yield from self.encode_chunk(texts[start:i])
                if size > CHUNK_BYTES and i < len(sizes):
                    yield b"".join(self.encode_chunk(pa.array([part]))[0] for part in _cut(texts[i].as_py().encode()))
                    start, held = i + 1, 0
                    continue
                start, held = i, 0
            held += size

    def encode(self, text: str) -> bytes:
        import pyarrow as pa

        return next(self.encode_all(pa.array([text])))


def _strings(words) -> list[str]:
    """A list of an Arrow array of words, none of which holds a line break."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.binary_join(pa.array([words], pa.list_(words.type)), "\n")[0].as_py().split("\n") if len(words) else []


def _cut(text: bytes) -> Iterator[str]:
    """Parts of about CHUNK_BYTES that end at blanks."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + CHUNK_BYTES)
        stop = blank.end() if blank else len(text)
        yield text[at:stop].decode()
        at = stop


@lru_cache(1)
def word_tokenizer(vocabulary: str) -> WordTokenizer:
    """One for all tasks of a Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(vocabulary)


def token_pieces(documents: DataFrame, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids as bytes."""

    def run(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        tokenizer = word_tokenizer(vocabulary or default_vocabulary())  # a path of the worker's machine
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows, texts = [], batch.column("text").cast(pa.string()).fill_null("")
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokenizer.encode_all(texts)):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * SEQUENCE)):
                    part = ids[at : at + 4 * SEQUENCE]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            cols = zip(*rows) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return documents.select("doc_id", "text").mapInArrow(run, _PIECES + (", ids binary" if with_ids else ""))


def plan_bins(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-two-fit on counts by length: (bin, how often), a bin being (length, how many) from the longest on."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = []
    while True:
        filled: dict[int, int] = {}
        used, gap, top = left.copy(), size, size
        while gap > 0:
            fits = np.flatnonzero(used[1 : min(gap, top) + 1])
            if not len(fits):
                break
            top = int(fits[-1]) + 1
            k = min(int(used[top]), gap // top)
            filled[top] = filled.get(top, 0) + k
            used[top] -= k
            gap -= k * top
            top -= 1
        if not filled:
            return plan
        smallest = min(filled)
        if gap > 0 and (two := _two_that_fit(used, gap + smallest, smallest)):
            filled[smallest] -= 1
            if not filled[smallest]:
                del filled[smallest]
            for length in two:
                filled[length] = filled.get(length, 0) + 1
        times = min(int(left[length]) // k for length, k in filled.items())
        for length, k in filled.items():
            left[length] -= k * times
        plan.append((sorted(filled.items(), reverse=True), times))


def _two_that_fit(left: np.ndarray, room: int, more_than: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the greatest sum up to room, if it is above more_than."""
    lengths = np.flatnonzero(left)
    if not len(lengths):
        return None
    partner = np.searchsorted(lengths, room - lengths, "right") - 1
    # the pair of a length with itself needs two of them
    partner -= (partner >= 0) & (lengths[partner] == lengths) & (left[lengths] < 2)
    sums = np.where(partner >= 0, lengths + lengths[partner], 0)
    best = int(np.argmax(sums))
    return (int(lengths[best]), int(lengths[partner[best]])) if sums[best] > more_than else None


def _plan_rows(plan: list) -> list[tuple]:
    """(length, ranks from, to, first sequence, copies in a sequence, offset of the first copy)."""
    rows, ranked, sequence = [], {}, 0
    for filled, times in plan:
        offset = 0
        for length, k in filled:
            first = ranked.get(length, 0)
            ranked[length] = first + k * times
            rows.append((length, first, first + k * times, sequence, k, offset))
            offset += k * length
        sequence += times
    return rows


def _longs(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A small table of whole numbers, by Arrow: from a list of rows Spark would start Python workers of another kind for it, beside those
    that tokenise."""
    import pyarrow as pa

    cols = zip(*rows) if rows else [[] for _ in names.split()]
    return spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in cols], names=names.split()))


def pack(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ids_crc32 and others); reads them three times."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = _longs(spark, _plan_rows(plan_bins(counts, size)), "p_length rank_from rank_to first_sequence in_sequence first_offset")
    # at most size + 65,536 salted groups in all, of an even share each
    share = max(256, sum(counts.values()) // 65_536)
    salts = _longs(spark, [(k, 1 + n // share) for k, n in counts.items()], "length salts")
    salted = pieces.join(F.broadcast(salts), "length").withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))
    )
    groups = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = groups.select("length", "salt", F.coalesce(before, F.lit(0)).alias("ranked"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("row", F.row_number().over(within))
        .join(F.broadcast(starts), ["length", "salt"])
        .withColumn("rank", F.col("ranked") + F.col("row") - 1)
    )
    at = F.col("rank") - F.col("rank_from")
    placed = ranked.join(
        F.broadcast(plan),
        (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")),
    )
    return placed.select(
        *pieces.columns,
        (F.col("first_sequence") + F.floor(at / F.col("in_sequence"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + at % F.col("in_sequence") * F.col("length")).alias("offset"),
    )


def pack_documents(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    scratch = Scratch(documents.sparkSession, "packing")
    return pack(scratch.write(token_pieces(documents, vocabulary), "pieces"))


def sequences(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_ids, ids (array<int>)."""
    scratch = Scratch(documents.sparkSession, "sequences")
    packed = pack(scratch.write(token_pieces(documents, vocabulary, with_ids=True), "pieces"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids = [[int(x) for part in parts for x in np.frombuffer(part["ids"], "<u4")] for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("sequence_id"), pa.array([len(x) for x in ids], pa.int32()), pa.array(ids, pa.list_(pa.int32()))],
                ["sequence_id", "n_ids", "ids"],
            )

    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.mapInArrow(run, "sequence_id long, n_ids int, ids array<int>")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
