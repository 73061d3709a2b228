"""Spelling variants: k-d trees over letter-count vectors find all words one edit apart.

Words are counted in the tasks first, so a word on a third of all rows meets as one row a task. Each word is a point:
how often it has each letter (twice at most). One replaced letter moves the point by L1 distance 2, an inserted or
deleted one by 1. Words of one length share a k-d tree: its upper levels, planes taken from a bounded sample, cut a
frequent length into cells of about CELL words; its lower levels are built where a cell is searched. A word goes to its
own cell, and as a query to those of its length (later ones, so that each pair meets once) and of the next length whose
boxes lie within the distance. In a cell, tight boxes prune the search; what is left is verified letter by letter.

A cell far above CELL (words with the same letters in other orders can't be cut by planes) goes by joins on the words less
one letter, where no key can hold more words than there are letters.

Null texts have no words; a null doc_id counts as an empty one. Repeated rows count each. An empty table gives no rows.
Other columns are not read. Long texts are cut between words, and counted whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Scratch, crc32_sql, read

LETTERS = 7
COUNT = 2
FACTOR = 10
#: One run in so many loses a letter, by a hash of document and run.
SLIP = 31
CELL = 20_000
CROWDED = 4 * CELL
SAMPLE = 100_000
#: Different words that a task counts before it passes them on.
HELD = 100_000
CHUNK = 1 << 20
QUERIES = 20_000
POINTS = 64
BLOCK = 2048
#: a-z have an axis each, letters beyond share six.
AXES = 32

_RUN = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0xC0 else 0x20 for c in range(256)
)
_AXIS = np.array([c - 0x61 if 0x61 <= c <= 0x7A else 26 + c % 6 for c in range(256)])


def _slipped(run: bytes, start: int) -> bytes:
    """The lower-cased run (Latin-1), less a letter if its hash says so; start: the hash of what stands before it."""
    h = crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _own(text: str) -> Counter:
    """Runs of at least LETTERS letters; what Latin-1 lacks is no letter."""
    data, out, at = text.encode("latin-1", "replace").translate(_RUN), Counter(), 0
    while at < len(data):
        end = data.find(b" ", at + CHUNK)
        end = len(data) if end < 0 else end
        out.update(w for w in data[at:end].split() if len(w) >= LETTERS)
        at = end
    return out


def word_counts(documents: DataFrame) -> DataFrame:
    """word, n: the words of at least LETTERS letters and COUNT occurrences."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def passed(counts: Counter):
            return pa.RecordBatch.from_arrays(
                [pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
            )

        counts: Counter = Counter()
        for batch in batches:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text")):
                start = crc32(name.encode() + b":")
                for run, n in _own(text.as_py() or "").items():
                    word = _slipped(run, start)
                    if len(word) >= LETTERS:
                        counts[word] += n
                if len(counts) >= HELD:
                    yield passed(counts)
                    counts.clear()
        if counts:
            yield passed(counts)

    rows = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), "text")
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= COUNT)


def codes(words: list[bytes]) -> np.ndarray:
    """Letter counts as 64 bits: a bit for each axis with a letter, and one for each with two or more.

    Bits that differ are the L1 distance of the counts held at two, so never more than the distance itself.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    places = np.repeat(np.arange(len(words)) * AXES, lengths) + _AXIS[np.frombuffer(b"".join(words), np.uint8)]
    counts = np.bincount(places, minlength=len(words) * AXES).reshape(-1, AXES)
    return np.packbits(np.concatenate((counts > 0, counts > 1), 1), axis=1, bitorder="little").view("<u8").ravel()


def _bits(points: np.ndarray) -> np.ndarray:
    return np.unpackbits(points.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _plane(points: np.ndarray) -> int | None:
    """The plane (an axis at one or at two, as its bit) that parts the points most evenly; None if nothing does."""
    share = np.abs(_bits(points).mean(0, dtype=np.float32) - 0.5)
    bit = int(share.argmin())
    return bit if share[bit] < 0.5 else None


def _sides(points: np.ndarray, bit: int) -> np.ndarray:
    return (points >> np.uint64(bit) & np.uint64(1)).astype(bool)


def planes(points: np.ndarray, cells: int):
    """A tree of (bit, tree of the points without it, tree of those with it); a leaf is None."""
    if cells < 2 or len(points) < 2 or (bit := _plane(points)) is None:
        return None
    there = _sides(points, bit)
    more = round(cells * there.mean())
    return bit, planes(points[~there], cells - more), planes(points[there], more)


def _numbered(tree, first: int = 0):
    """The tree with its leaves numbered from first, and the next number."""
    if tree is None:
        return first, first + 1
    low, first = _numbered(tree[1], first)
    high, first = _numbered(tree[2], first)
    return (tree[0], low, high), first


def cells_within(tree, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the point, leaf) for the leaves whose boxes lie within the radius."""
    found = []

    def walk(node, rows, known, value):  # the node's box: the bits it settles, and how
        rows = rows[np.bitwise_count((points[rows] ^ value) & known) <= radius]
        if isinstance(node, int):
            found.append((rows, np.full(len(rows), node)))
        elif len(rows):
            bit = np.uint64(1) << np.uint64(node[0])
            walk(node[1], rows, known | bit, value)
            walk(node[2], rows, known | bit, value | bit)

    walk(tree, np.arange(len(points)), np.uint64(0), np.uint64(0))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def tree_of(points: np.ndarray, rows: np.ndarray):
    """(what all points have, what any has, rows of a leaf or None, lower tree, upper tree): boxes as tight as can be."""
    mine = points[rows]
    bit = _plane(mine) if len(rows) > POINTS else None
    box = np.bitwise_and.reduce(mine), np.bitwise_or.reduce(mine)
    if bit is None:
        return *box, rows, None, None
    there = _sides(mine, bit)
    return *box, None, tree_of(points, rows[~there]), tree_of(points, rows[there])


def within(tree, points: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, point) within the radius; boxes prune, so ever fewer queries go down."""
    stack = [(tree, np.arange(len(queries)))]
    while stack:
        (every, any_, rows, low, high), asked = stack.pop()
        mine = queries[asked]
        asked = asked[np.bitwise_count(every & ~mine | mine & ~any_) <= radius]
        if rows is None:
            stack += [(low, asked), (high, asked)] if len(asked) else []
            continue
        for at in range(0, len(rows), BLOCK):
            part = points[rows[at : at + BLOCK]]
            for begin in range(0, len(asked), BLOCK):
                some = asked[begin : begin + BLOCK]
                q, p = np.nonzero(np.bitwise_count(queries[some][:, None] ^ part) <= radius)
                yield some[q], rows[at + p]


def gathered(pairs: Iterator, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs in blocks of about so many."""
    held, size = [], 0
    for q, p in pairs:
        held.append((q, p))
        size += len(q)
        if size >= block:
            yield tuple(map(np.concatenate, zip(*held)))
            held, size = [], 0
    if size:
        yield tuple(map(np.concatenate, zip(*held)))


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Rows of letters that differ by exactly one replaced letter, or by one more in long."""
    n = short.shape[1]
    if n == long.shape[1]:
        return (short != long).sum(1) == 1
    ahead, behind = short != long[:, :n], short != long[:, 1:]
    prefix = np.where(ahead.any(1), ahead.argmax(1), n)
    suffix = np.where(behind.any(1), behind[:, ::-1].argmax(1), n)
    return prefix + suffix >= n


def _letters(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


_OWN, _SAME, _SHORTER = 0, 1, 2
_DEALT = "length int, leaf int, role int, word string, n long"


def _dealt(words: DataFrame, trees: dict) -> DataFrame:
    """Words in their own cells, and as queries in the cells that lie within the distance of one edit."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("word").to_pylist()
            if not texts:
                continue
            raw = [t.encode("latin-1") for t in texts]
            lengths, points = np.array(list(map(len, raw))), codes(raw)
            out = []
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                mine = points[rows]
                at, own = cells_within(trees.get(length, 0), mine, 0)
                home = np.empty(len(rows), np.int64)
                home[at] = own
                out.append((rows, length, home, _OWN))
                at, leaf = cells_within(trees.get(length, 0), mine, 2)
                later = leaf > home[at]
                out.append((rows[at[later]], length, leaf[later], _SAME))
                at, leaf = cells_within(trees.get(length + 1, 0), mine, 1)
                out.append((rows[at], length + 1, leaf, _SHORTER))
            rows = np.concatenate([x[0] for x in out])
            columns = [np.concatenate([np.full(len(x[0]), x[i]) if np.isscalar(x[i]) else x[i] for x in out]) for i in (1, 2, 3)]
            for at in range(0, len(rows), 50_000):
                some = rows[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c[at : at + 50_000], pa.int32()) for c in columns), batch.column("word").take(pa.array(some)), batch.column("n").take(pa.array(some))],
                    ["length", "leaf", "role", "word", "n"],
                )

    return words.mapInArrow(run, _DEALT)


_PAIRS = "a string, a_n long, b string, b_n long"


def _search(batches: Iterator) -> Iterator:
    """Rows sorted by cell and role to pairs. Holds a cell's own words and a block of queries."""
    import pyarrow as pa

    cell, own, counts, waiting = None, [], [], {_SAME: ([], []), _SHORTER: ([], [])}
    state: dict = {}

    def emit(a, a_n, b, b_n):
        text = lambda words: pa.array([w.decode("latin-1") for w in words], pa.string())
        return pa.RecordBatch.from_arrays([text(a), pa.array(a_n, pa.int64()), text(b), pa.array(b_n, pa.int64())], ["a", "a_n", "b", "b_n"])

    def matched(queries, query_n, radius, inside):
        if not state:
            state.update(points=codes(own), letters=_letters(own))
            state["tree"] = tree_of(state["points"], np.arange(len(own)))
        letters = _letters(queries)
        block = max(1, (1 << 23) // letters.shape[1])
        for q, p in gathered(within(state["tree"], state["points"], codes(queries), radius), block):
            x, y = (q[q < p], p[q < p]) if inside else (q, p)
            right = one_edit(letters[x], state["letters"][y])
            x, y = x[right].tolist(), y[right].tolist()
            yield emit([queries[i] for i in x], [query_n[i] for i in x], [own[i] for i in y], [counts[i] for i in y])

    def flushed(role):
        words, n = waiting[role]
        if words and own:
            yield from matched(words, n, 3 - role, False)
        waiting[role] = ([], [])

    def ended():
        if len(own) > 1:
            yield from matched(own, counts, 2, True)
        for role in (_SAME, _SHORTER):
            yield from flushed(role)

    for batch in batches:
        for length, leaf, role, word, n in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if cell != (length, leaf):
                yield from ended()
                cell, own, counts = (length, leaf), [], []
                state.clear()
            words, ns = (own, counts) if role == _OWN else waiting[role]
            words.append(word.encode("latin-1"))
            ns.append(n)
            if role != _OWN and len(words) >= QUERIES:
                yield from flushed(role)
    yield from ended()


def _less_one(word: Column) -> Column:
    """(at, rest) for each letter of the word."""
    return F.transform(
        F.sequence(F.lit(1), F.length(word)),
        lambda i: F.struct(i.alias("at"), F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))).alias("rest")),
    )


def _by_keys(dealt: DataFrame) -> DataFrame:
    """Pairs of crowded cells, by joins on the words less one letter."""
    cell = ["length", "leaf"]
    keyed = dealt.where(F.col("role") < _SHORTER).select(*cell, "role", "word", "n", F.explode(_less_one(F.col("word"))).alias("k"))
    keyed = keyed.select(*cell, "role", "word", "n", "k.at", "k.rest")
    own = keyed.where(F.col("role") == _OWN).select(*cell, "at", "rest", F.col("word").alias("b"), F.col("n").alias("b_n"))
    asked = keyed.select(*cell, "at", "rest", "role", F.col("word").alias("a"), F.col("n").alias("a_n"))
    same = asked.join(own, [*cell, "at", "rest"]).where((F.col("role") == _SAME) | (F.col("a") < F.col("b")))
    same = same.where("a <> b").select("a", "a_n", "b", "b_n")
    shorter = dealt.where(F.col("role") == _SHORTER).select(*cell, F.col("word").alias("rest"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    longer = shorter.join(own.drop("at").distinct(), [*cell, "rest"]).select("a", "a_n", "b", "b_n")
    return same.union(longer)


def _trees(words: DataFrame, cell: int, sample: int) -> dict:
    """For lengths of more than cell words: numbered planes from a bounded sample. At most words/cell lengths are collected."""
    frequent = {r["length"]: r["count"] for r in words.groupBy(F.length("word").alias("length")).count().where(F.col("count") > cell).collect()}
    if not frequent:
        return {}
    total = sum(frequent.values())
    hashed = F.pmod(F.xxhash64("word"), F.lit(1 << 40))
    drawn = words.where(F.length("word").isin(list(frequent)) & (hashed < int((1 << 40) * min(1.0, sample / total)))).select("word")
    by_length: dict[int, list[bytes]] = {}
    for r in drawn.toLocalIterator():
        by_length.setdefault(len(r["word"]), []).append(r["word"].encode("latin-1"))
    return {n: _numbered(planes(codes(ws), -(-frequent[n] // cell)))[0] for n, ws in by_length.items()}


def near_pairs(words: DataFrame, scratch: Scratch, cell: int = CELL, crowded: int = CROWDED, sample: int = SAMPLE) -> DataFrame:
    """words (word, n) to pairs (a, a_n, b, b_n) of words one edit apart, each pair once."""
    dealt = scratch.write(_dealt(words, _trees(words, cell, sample)), "dealt")
    full = dealt.where(F.col("role") == _OWN).groupBy("length", "leaf").count().where(F.col("count") > crowded).select("length", "leaf")
    full = scratch.write(full, "crowded")  # at most words/crowded cells
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-dealt.count() // cell))
    calm = dealt.join(F.broadcast(full), ["length", "leaf"], "left_anti").select("length", "leaf", "role", "word", "n")
    found = calm.repartition(tasks, "length", "leaf").sortWithinPartitions("length", "leaf", "role").mapInArrow(_search, _PAIRS)
    if not full.isEmpty():
        found = found.union(_by_keys(dealt.join(F.broadcast(full), ["length", "leaf"], "left_semi")))
    return found


def _rooted(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, form) to (word, root). n grows by FACTOR a step, so doubling ends after five rounds at most."""
    up, turn = scratch.write(forms.select("word", F.col("form").alias("root")), "up0"), 0
    while True:
        turn += 1
        next_up = up.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = scratch.write(up.join(next_up, "root", "left").select("word", "root", "beyond"), f"up{turn}")
        up = joined.select("word", F.coalesce("beyond", "root").alias("root"))
        if joined.where("beyond IS NOT NULL").isEmpty():
            return up


def spelling_variants(documents: DataFrame, cell: int = CELL, crowded: int = CROWDED, sample: int = SAMPLE) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    scratch = Scratch(documents.sparkSession, "spelling")
    words = scratch.write(word_counts(documents), "words")
    pairs = scratch.write(near_pairs(words, scratch, cell, crowded, sample), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n"))
    both = both.union(pairs.select("b", "a", "a_n"))
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form"))).alias("best")
    nearest = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    holds = -F.col("best.minus") >= FACTOR * F.col("n")
    named = words.join(nearest, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(holds, F.col("best.form")).alias("form"),
        F.when(holds, -F.col("best.minus")).alias("form_n"),
    )
    named = scratch.write(named, "named")
    roots = _rooted(named.where("form IS NOT NULL"), scratch)
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"))


ORACLE = f"""
WITH RECURSIVE runs AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents
), counted AS (
    SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS named, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
    SELECT run, n, {crc32_sql("named")} AS h FROM counted
), slipped AS (
    SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, n
    FROM hashed
), words AS (
    SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), less AS (
    SELECT word, n, i, substring(word, 1, i::INT - 1) || substring(word, i::INT + 1) AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT w.word, l.word, l.n FROM words w JOIN less l ON w.word = l.rest
    UNION SELECT l.word, w.word, w.n FROM words w JOIN less l ON w.word = l.rest
), best AS (
    SELECT word, count(*) AS n_near, min({{'minus': -other_n, 'form': other}}) AS b FROM near GROUP BY word
), named AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near,
           CASE WHEN -b.minus >= 10 * n THEN b.form END AS form, CASE WHEN -b.minus >= 10 * n THEN -b.minus END AS form_n
    FROM words LEFT JOIN best USING (word)
), steps AS (
    SELECT word, word AS root FROM named
    UNION ALL SELECT steps.word, named.form FROM steps JOIN named ON steps.root = named.word WHERE named.form IS NOT NULL
), ends AS (
    SELECT steps.word, steps.root FROM steps JOIN named ON steps.root = named.word WHERE named.form IS NULL
)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM named JOIN ends USING (word)
"""
