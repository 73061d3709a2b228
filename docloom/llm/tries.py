"""Conversation prefix trie by truncation peeling.

Turns become 128-bit hashes of role and text; a conversation becomes the chain of the hashes of its prefixes, and equal
conversations one path with a count. Sorted by chain, the paths that share a prefix stand together, so a range of them
can be peeled in one task: from the greatest depth down, the conversations that end at this depth join the nodes that
survive from the depth below, equal chains are grouped, each group is a node with its totals, and the last turn is
stripped. Only the nodes on the paths at both ends of a range can go on in another range. What is known of these stays
open, goes out as two paths, and the few paths are peeled again, until one range holds all. So no depth costs a round
in Spark, and a first turn that a third of all conversations share is cut wherever the ranges happen to end.

Turns are in order of turn (null first), then role, then a hash of role and text. A null role or text counts as empty;
rows with a null conv_id take no part. Repeated rows are turns of their own. An empty table gives no rows, not even a
root. Other columns are not read. Texts of any length are hashed whole; a conversation is one row of 24 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, crc32_sql, read
from .native import sized

BLOCK = 20
HEADS = 4
#: Turns that a task peels, about.
TURNS = 100_000
#: Ids that stand in one row while the ends of a node are hashed.
IDS = 64
NO_ENDS = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame, block: int = BLOCK, heads: int = HEADS) -> DataFrame:
    """conv_id and its rebuilt turns: array of (a, b, words), hashes of role and text and the number of words."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn = F.struct(
        F.col("turn").alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("a"), F.xxhash64(text, F.lit(1), role).alias("b"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    own = own.select("conv_id", F.transform("t", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["words"].alias("words"))).alias("own"))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    first = own.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, heads).alias("head"))
    own = own.withColumn("h", taken.cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % block)
    head = F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), F.col("h"))
    rest = F.slice("own", F.col("h") + 1, F.size("own"))
    return own.join(first, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PATH = "conv_id long, end_a long, end_b long, depth int, chain array<long>, words array<long>"


def chains(conversations: DataFrame) -> DataFrame:
    """conv_id, its depth, the two hashes of its whole sequence, and by depth the hashes of its prefixes and the words of turns."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            turns = batch.column("turns")
            offsets = turns.offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            flat = turns.flatten()
            a, b, words = (flat.field(i).to_numpy() for i in range(3))
            lengths, chain = np.diff(offsets), np.empty(2 * len(a), np.int64)
            ends = np.zeros((2, len(lengths)), np.uint64)
            for d in range(int(lengths.max(initial=0))):
                rows = np.flatnonzero(lengths > d)
                at = offsets[rows] + d
                for i, hashed in enumerate((a, b)):
                    ends[i, rows] = _mixed(ends[i, rows] * np.uint64(0x9E3779B97F4A7C15) + hashed[at].view(np.uint64) + np.uint64(i + 1))
                    chain[2 * at + i] = ends[i, rows].view(np.int64)
            lists = lambda values, each: pa.ListArray.from_arrays(pa.array(offsets * each, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *(pa.array(e.view(np.int64)) for e in ends), pa.array(lengths, pa.int32()), lists(chain, 2), lists(words, 1)],
                ["conv_id", "end_a", "end_b", "depth", "chain", "words"],
            )

    return conversations.mapInArrow(run, _PATH)


def ends_of(paths: DataFrame) -> DataFrame:
    """By sequence: end_a, end_b, depth, n (conversations), conv_id (the smallest) and the hash of all their ids.

    Ids are gathered in rows of at most IDS, and hashed row by row in order of their numbers.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def done():
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip((*now, n, least, digest.hexdigest()), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()))],
                ["end_a", "end_b", "depth", "n", "conv_id", "ends"],
            )

        now, n, least, digest, held = None, 0, None, None, []
        for batch in batches:
            for a, b, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("end_a", "end_b", "depth", "ids"))):
                if now != (a, b, depth):
                    if now is not None:
                        held.append(done())
                    now, n, least, digest = (a, b, depth), 0, ids[0], hashlib.sha256()
                digest.update(("," * (n > 0) + ",".join(map(str, ids))).encode())
                n += len(ids)
            if held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if now is not None:
            yield done()

    key = ["end_a", "end_b", "depth"]
    part = F.floor(F.col("conv_id") / IDS).alias("part")
    ids = paths.groupBy(*key, part).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    dealt = ids.repartition(*key).sortWithinPartitions(*key, "part")
    return dealt.mapInArrow(run, "end_a long, end_b long, depth int, n long, conv_id long, ends string")


_FACT = "d int, n long, conv long, kids long, leaves long, saved long, ends string"
_PEELED = (
    "depth int, conv_id long, parent long, parent_a long, parent_b long, own_a long, own_b long, n long, kids long, leaves long, saved long, ends string, "
    f"chain array<long>, words array<long>, facts array<struct<{', '.join(x.replace(' ', ':', 1) for x in _FACT.split(', '))}>>"
)


class _Range:
    """Paths in order of their chains, with what is known of their nodes, peeled from the greatest depth to the root."""

    def __init__(self, table, whole: bool):
        import pyarrow as pa

        self.whole = whole  # no other range: nothing stays open
        chain, words, facts = (table.column(c).combine_chunks() for c in ("chain", "words", "facts"))
        at = words.offsets.to_numpy().astype(np.int64)
        self.at, self.length = at[:-1] - at[0], np.diff(at)
        self.chain, self.words = chain.flatten().to_numpy().reshape(-1, 2), words.flatten().to_numpy()
        flat, row = facts.flatten(), np.repeat(np.arange(len(table)), np.diff(facts.offsets.to_numpy()))
        order = np.argsort(flat.field(0).to_numpy(), kind="stable")
        depth, *numbers = (flat.field(i).to_numpy()[order] for i in range(6))
        self.rows, self.numbers = row[order], numbers
        self.ends = flat.field(6).take(pa.array(order)).to_pylist()
        self.first = np.searchsorted(depth, np.arange(int(self.length.max()) + 2))
        self.last = len(table) - 1
        self.open: dict[int, list] = {0: [], self.last: []}

    def key(self, rows: np.ndarray, depth: int) -> np.ndarray:
        return self.chain[self.at[rows] + depth - 1] if depth else np.zeros((len(rows), 2), np.int64)

    def end_of(self, key: np.ndarray, depth: int) -> np.ndarray:
        """Which end of the range has a node on its path: its row, or -1."""
        out = np.full(len(key), -1)
        for row in () if self.whole else (self.last, 0):
            if self.length[row] >= depth:
                out[(key == self.key(np.array([row]), depth)).all(1)] = row
        return out

    def peel(self) -> Iterator[dict]:
        """Closed nodes by depth, greatest first. What is known of nodes that other ranges may share is kept in open."""
        nobody = np.empty(0, np.int64)
        row, given, closed = nobody, [nobody] * 5, None  # of the depth below: a path through each node, and what it gives its parent
        for depth in range(int(self.length.max()), -1, -1):
            a, b = self.first[depth], self.first[depth + 1]
            rows = np.concatenate([row, self.rows[a:b]])
            if not len(rows):
                continue
            order = np.argsort(rows, kind="stable")
            key = self.key(rows[order], depth)
            new = np.concatenate(([True], (key[1:] != key[:-1]).any(1)))
            starts = np.flatnonzero(new)
            group = np.empty(len(rows), np.int64)
            group[order] = np.cumsum(new) - 1
            n, conv, kids, leaves, saved = (
                (np.minimum if i == 1 else np.add).reduceat(np.concatenate([x, y[a:b]])[order], starts) for i, (x, y) in enumerate(zip(given, self.numbers))
            )
            ends = {int(g): e for g, e in zip(group[len(row) :], self.ends[a:b]) if e is not None}
            node, own = rows[order][starts], key[starts]
            end = self.end_of(own, depth)
            if closed is not None:  # the parents of the nodes below are known by now
                mine = group[: len(row)]
                yield closed | {"parent": conv[mine], "known": end[mine] < 0, "above": own[mine]}
            for g in np.flatnonzero(end >= 0).tolist():
                self.open[int(end[g])].append((depth, int(n[g]), int(conv[g]), int(kids[g]), int(leaves[g]), int(saved[g]), ends.get(g)))
            done = np.flatnonzero(end < 0)
            row, n, conv, kids = node[done], n[done], conv[done], kids[done]
            leaves = np.where(kids == 0, 1, leaves[done])
            saved = saved[done] + (n - 1) * (self.words[self.at[row] + depth - 1] if depth else 0)
            given = [n, conv, np.ones(len(row), np.int64), leaves, saved]
            closed = {"depth": depth, "own": own[done], "conv_id": conv, "n": n, "kids": kids, "leaves": leaves, "saved": saved}
            closed["ends"] = [ends.get(g, NO_ENDS) for g in done.tolist()]
        if self.whole:
            yield closed | {"parent": None}

    def paths(self) -> Iterator[dict]:
        for row, facts in self.open.items():
            if facts:
                part = slice(self.at[row], self.at[row] + self.length[row])
                yield {"chain": self.chain[part].ravel().tolist(), "words": self.words[part].tolist(), "facts": facts}


def _peeled(whole: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fact = pa.struct([(x.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[x.split()[1]]) for x in _FACT.split(", ")])
        kinds = [pa.int32(), *[pa.int64()] * 10, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(fact)]
        names = [x.split()[0] for x in _PEELED.split(" array<struct")[0].split(", ")]
        names = dict(zip(names, kinds))

        def emit(size: int, **columns):
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(size, t) for c, t in names.items()], list(names))

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        work = _Range(pa.Table.from_batches(batches), whole)
        del batches
        for x in work.peel():
            size = len(x["n"])
            same = {c: pa.array(x[c], pa.int64()) for c in ("conv_id", "n", "kids", "leaves", "saved")}
            if x["parent"] is not None:
                same["parent"] = pa.array(x["parent"], pa.int64(), mask=~x["known"])
                same |= {f"parent_{c}": pa.array(x["above"][:, i], pa.int64(), mask=x["known"]) for i, c in enumerate("ab")}
            same |= {f"own_{c}": pa.array(x["own"][:, i], pa.int64()) for i, c in enumerate("ab")}
            yield emit(size, depth=pa.array(np.full(size, x["depth"]), pa.int32()), ends=pa.array(x["ends"], pa.string()), **same)
        for path in work.paths():
            yield emit(1, **{c: pa.array([v], names[c]) for c, v in path.items()})

    return run


def prefix_trie(conversations: DataFrame, block: int = BLOCK, heads: int = HEADS, turns: int = TURNS) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    scratch = Scratch(conversations.sparkSession, "trie")
    every = scratch.write(chains(rebuilt(conversations, block, heads)), "chains")
    ends = ends_of(every).select("conv_id", "n", "ends")
    zero = F.lit(0).cast("long")
    fact = F.struct(
        F.col("depth").alias("d"), F.col("n"), F.col("conv_id").alias("conv"), zero.alias("kids"), zero.alias("leaves"), zero.alias("saved"), F.col("ends")
    )
    paths = scratch.write(every.join(ends, "conv_id").select("chain", "words", F.array(fact).alias("facts")), "paths")
    rounds: list[DataFrame] = []
    tasks = None
    while True:
        total = paths.agg(F.coalesce(F.sum(F.size("words") + 1), F.lit(0))).first()[0]
        tasks = -(-total // turns) if tasks is None else min(-(-total // turns), tasks // 2)
        whole = tasks <= 1
        dealt = paths.coalesce(1) if whole else paths.repartitionByRange(tasks, "chain")
        done = scratch.write(dealt.sortWithinPartitions("chain").mapInArrow(_peeled(whole), _PEELED), f"peeled{len(rounds)}")
        rounds.append(done.where("depth IS NOT NULL").drop("chain", "words", "facts"))
        if whole:
            break
        paths = done.where("depth IS NULL").select("chain", "words", "facts")
    nodes = rounds[0]
    if len(rounds) > 1:  # parents that were open when their children closed; two paths a task, so few
        later = rounds[1]
        for x in rounds[2:]:
            later = later.union(x)
        nodes = nodes.union(later)
        parents = later.select(F.col("own_a").alias("parent_a"), F.col("own_b").alias("parent_b"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("found"))
        nodes = nodes.join(sized(parents), ["parent_a", "parent_b", "depth"], "left").withColumn("parent", F.coalesce("parent", "found"))
    return nodes.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))


ORACLE = f"""
WITH t AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), text) AS i,
           coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
), c AS (
    SELECT conv_id, {crc32_sql("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
    SELECT c.conv_id, 0 AS part, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND i <= h
    UNION ALL SELECT c.conv_id, 1, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND i > h
), p AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS depth,
           sha256(length(role) || ':' || role || text) AS turn, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
    FROM r
), seq AS (
    SELECT conv_id, coalesce(turns, []) AS turns, len(coalesce(turns, [])) AS n_turns
    FROM c LEFT JOIN (SELECT conv_id, list(turn ORDER BY depth) AS turns FROM p GROUP BY conv_id) USING (conv_id)
), m AS (
    SELECT conv_id, depth, n_turns, sha256(array_to_string(turns[1:depth], ',')) AS node, sha256(array_to_string(turns[1:depth - 1], ',')) AS above
    FROM (SELECT *, unnest(range(n_turns + 1)) AS depth FROM seq)
), nodes AS (
    SELECT node, depth, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n,
           string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n_turns = depth) AS ends
    FROM m GROUP BY node, depth
), kids AS (
    SELECT above AS node, depth - 1 AS depth, count(*) AS kids FROM nodes WHERE depth > 0 GROUP BY ALL
), totals AS (
    SELECT m.node, m.depth, count(*) FILTER (kids.kids IS NULL) AS leaves, coalesce(sum((b.n - 1) * p.words), 0) AS saved
    FROM nodes b JOIN m ON m.conv_id = b.conv_id AND m.depth <= b.depth
    LEFT JOIN p ON p.conv_id = b.conv_id AND p.depth = b.depth LEFT JOIN kids ON kids.node = b.node AND kids.depth = b.depth
    GROUP BY ALL
)
SELECT a.conv_id, a.depth, u.conv_id AS parent_conv_id, a.n AS n_convs, coalesce(kids, 0) AS n_children, leaves AS n_leaves,
       saved::BIGINT AS saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
FROM nodes a JOIN totals USING (node, depth) LEFT JOIN kids USING (node, depth) LEFT JOIN nodes u ON u.node = a.above AND u.depth = a.depth - 1
"""
