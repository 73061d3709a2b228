"""Exact top-k by inner product: a Voronoi kNN join.

Each vector gets one more component that brings it to the largest length, queries a zero there; then the nearest points are
those of the highest inner products. Pivots from a bounded sample part queries and data into Voronoi cells. Summaries of
the data's cells (rows, radius, and the k+1 members nearest the pivot) give each query the score it reaches at least, and
so each cell of queries a distance from its pivot beyond which no point can be among the k best. Cells are joined into
groups; a data row goes to the groups that it might matter for, and is compared there, in parts of bounded size. There are
as few groups as queries fit into memory, or more as long as the bounds keep the copies few.

The bounds use floating point with room to spare; scores are whole numbers: exact products where floats hold them, integers
of any size elsewhere, held to the range of a long. Vectors of other lengths count as followed by zeros. Rows with a null
vec_id or a vector that is null or holds null or non-finite components take no part. Repeated rows are rows of their own: each
is asked for and found by itself. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Scratch, read

K = 5
EVERY = 50
SCALE = 256
#: Vectors that the pivots are fitted on, about.
SAMPLE = 8192
PIVOTS = 256
#: Queries that a task holds, and data rows that it compares them with.
QUERIES = 4096
ROWS = 20_000
#: Copies of the data, at most, for which there are more groups than the queries need.
COPIES = 2
EXACT = 1 << 53
NONE = np.iinfo(np.int64).min


def scaled(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and x, floor(scale * component) as doubles, of the rows that take part."""
    x = F.transform(F.col("embedding"), lambda v: v.cast("double") * F.lit(float(scale)))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return embeddings.select(F.col("vec_id").cast("long"), x.alias("x")).where(F.col("x").isNotNull() & F.col("vec_id").isNotNull() & ~bad)


def _matrix(column, width: int) -> np.ndarray:
    """A list column as rows of a matrix, floored; shorter lists are followed by zeros."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as longs; those beyond a long at its ends."""
    with np.errstate(all="ignore"):
        size = np.sqrt((queries**2).sum(1))[:, None] * np.sqrt((data**2).sum(1))
        out, large = queries @ data.T, ~(size < EXACT)
        out[large] = 0
    out = out.astype(np.int64)
    for i, j in zip(*np.nonzero(large)):
        product = sum(int(a) * int(b) for a, b in zip(queries[i].tolist(), data[j].tolist()))
        out[i, j] = max(-(2**63) + 1, min(2**63 - 1, product))
    return out


class Space:
    """Pivots among the lengthened vectors, and distances to them."""

    def __init__(self, sample: np.ndarray, longest: float, pivots: int, rounds: int = 6):
        self.longest, self.width = longest, sample.shape[1]
        points = self.lengthened(sample)
        self.pivots = points[np.random.default_rng(1).permutation(len(points))[:pivots]]
        for _ in range(rounds):
            cell = self.distances(points).argmin(1)
            n = np.bincount(cell, minlength=len(self.pivots))[:, None]
            sums = np.zeros_like(self.pivots)
            np.add.at(sums, cell, points)
            self.pivots = np.where(n > 0, sums / np.maximum(n, 1), self.pivots)

    def lengthened(self, data: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.column_stack([data, np.sqrt(np.maximum(self.longest - (data**2).sum(1), 0))])

    def distances(self, points: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            squares = (points**2).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * points @ self.pivots.T
            return np.sqrt(np.maximum(squares, 0))

    def of_queries(self, queries: np.ndarray) -> np.ndarray:
        return self.distances(np.column_stack([queries, np.zeros(len(queries))]))


def _ordered(pivots: np.ndarray) -> list[int]:
    """Pivots so that near ones stand together: halved along the axis of the most spread, again and again."""

    def halves(rows: np.ndarray) -> list[int]:
        if len(rows) < 3:
            return rows.tolist()
        axis = pivots[rows].var(0).argmax()
        rows = rows[np.argsort(pivots[rows, axis], kind="stable")]
        return halves(rows[: len(rows) // 2]) + halves(rows[len(rows) // 2 :])

    return halves(np.arange(len(pivots)))


def _summaries(points: DataFrame, space: Space, k: int, scratch: Scratch) -> tuple[dict, DataFrame]:
    """{cell: (rows, radius)} and the k+1 rows nearest each pivot."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, rid = _matrix(batch.column("x"), space.width), batch.column("rid").to_numpy()
            distance = space.distances(space.lengthened(x))
            cell = distance.argmin(1)
            r = distance[np.arange(len(x)), cell]
            for c in np.unique(cell).tolist():
                rows = np.flatnonzero(cell == c)
                n, radius, near = held.get(c, (0, 0.0, []))
                best = rows[np.argsort(r[rows], kind="stable")[: k + 1]]
                near = sorted(near + [(r[i], rid[i], x[i]) for i in best], key=lambda t: t[:2])[: k + 1]
                held[c] = n + len(rows), max(radius, r[rows].max()), near
        rows = [(c, n if i == 0 else 0, radius, r, rid, x.tolist()) for c, (n, radius, near) in held.items() for i, (r, rid, x) in enumerate(near)]
        for at in range(0, len(rows), 1000):
            some = zip(*rows[at : at + 1000])
            kinds = (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(some, kinds)], ["cell", "n", "radius", "r", "rid", "x"])

    found = scratch.write(points.mapInArrow(run, "cell int, n long, radius double, r double, rid long, x array<double>"), "summaries")
    cells = {c: (n, radius) for c, n, radius in found.groupBy("cell").agg(F.sum("n"), F.max("radius")).collect()}
    nth = F.row_number().over(Window.partitionBy("cell").orderBy("r", "rid"))
    return cells, found.withColumn("nth", nth).where(F.col("nth") <= k + 1).select("rid", "x")


def _bounds(queries: DataFrame, space: Space, rids: np.ndarray, near: np.ndarray, k: int) -> dict:
    """{cell: (queries, distance from the pivot beyond which no data row matters)}."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, rid = _matrix(batch.column("x"), space.width), batch.column("rid").to_numpy()
            distance = space.of_queries(x)
            cell = distance.argmin(1)
            with np.errstate(all="ignore"):
                least = np.full(len(x), -np.inf)
                for at in range(0, len(x) if len(rids) >= k else 0, 1024):
                    reached = x[at : at + 1024] @ near.T
                    reached[rid[at : at + 1024, None] == rids] = -np.inf
                    least[at : at + 1024] = np.partition(reached, -k, axis=1)[:, -k]
                theta = np.sqrt(np.maximum((x**2).sum(1) + space.longest - 2 * least, 0))
                reach = distance[np.arange(len(x)), cell] + theta
            reach[np.isnan(reach)] = np.inf
            for c in np.unique(cell).tolist():
                n, far = held.get(c, (0, 0.0))
                held[c] = n + int((cell == c).sum()), max(far, float(reach[cell == c].max()))
        if held:
            cells, facts = list(held), list(zip(*held.values()))
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(facts[0], pa.int64()), pa.array(facts[1], pa.float64())], ["cell", "n", "far"])

    found = queries.mapInArrow(run, "cell int, n long, far double").groupBy("cell").agg(F.sum("n"), F.max("far"))
    return {c: (n, far) for c, n, far in found.collect()}


def groups_of(space: Space, data: dict, asked: dict, most: int, copies: int) -> tuple[dict, list]:
    """{cell: (first group, number of groups that its queries are dealt over)} and per group (cells, data rows at most).

    Cells of queries stand in order and are cut into segments of at most ``most`` queries; then into finer ones as long as
    the data rows that the segments can need stay within ``copies`` times all rows.
    """
    order = [c for c in _ordered(np.nan_to_num(space.pivots)) if c in asked]
    rows, slack = sum(n for n, _ in data.values()), 1e-6 * np.sqrt(space.longest)
    between = space.distances(space.pivots)

    def needed(cells) -> set:
        return {j for j, (_, radius) in data.items() if any(not between[i, j] - radius > asked[i][1] + slack for i in cells)}

    def cut(size: int):
        starts, groups, now, held = {}, [], [], 0
        for c in [*order, None]:
            n = asked[c][0] if c is not None else 0
            if now and (c is None or held + n > size):
                groups.append(now)
                now, held = [], 0
            if c is None:
                break
            if n > size:
                parts = -(-n // size)
                starts[c] = len(groups), parts
                groups += [[c]] * parts
            else:
                starts[c] = len(groups), 1
                now, held = [*now, c], held + n
        return starts, [(g, sum(data[j][0] for j in needed(g))) for g in groups]

    best, size = cut(most), most
    while size > 32 and len(best[1]) < len(order):
        size //= 2
        finer = cut(size)
        if sum(n for _, n in finer[1]) > copies * rows:
            break
        best = finer
    return best


_DEALT = "grp int, salt int, data boolean, rid long, vec_id long, x array<double>"
_FOUND = "rid long, query_id long, vec_id long, score long"


def _solve(width: int, k: int):
    def run(batches: Iterator) -> Iterator:
        """Rows by group and salt, its queries first, then its data by vec_id. Holds the queries, their k best, and a block."""
        import pyarrow as pa

        now, parts, state = None, [], {}

        def begin():
            rid, ids, x = (np.concatenate(c) for c in zip(*parts))
            n = len(rid)
            order = np.argsort(rid, kind="stable")
            state.update(rid=rid[order], ids=ids[order], x=x[order], score=np.full((n, k), NONE), best=np.zeros((n, k), np.int64), step=64)

        def compare(rid, ids, x):
            got = scores(state["x"], x)
            at = np.searchsorted(state["rid"], rid)
            own = np.flatnonzero(state["rid"][np.minimum(at, len(state["rid"]) - 1)] == rid)
            got[at[own], own] = NONE
            q, c = np.nonzero(got > state["score"][:, -1:])  # ids ascend: a later row loses a tie
            if not len(q):
                return
            touched = np.unique(q)
            rows = np.concatenate([np.repeat(touched, k), q])
            value = np.concatenate([state["score"][touched].ravel(), got[q, c]])
            name = np.concatenate([state["best"][touched].ravel(), ids[c]])
            order = np.lexsort((np.arange(len(rows)), -value, value == NONE, rows))
            starts = np.searchsorted(rows[order], touched)
            take = order[(starts[:, None] + np.arange(k)).ravel()]
            state["score"][touched] = value[take].reshape(-1, k)
            state["best"][touched] = name[take].reshape(-1, k)

        def ended():
            if state:
                there = state["score"] != NONE
                n = there.sum(1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(state["rid"], n)), pa.array(np.repeat(state["ids"], n)), pa.array(state["best"][there]), pa.array(state["score"][there])],
                    ["rid", "query_id", "vec_id", "score"],
                )

        for batch in batches:
            if not batch.num_rows:
                continue
            group, salt = batch.column("grp").to_numpy().astype(np.int64), batch.column("salt").to_numpy()
            data = batch.column("data").to_numpy(zero_copy_only=False)
            rid, ids, x = batch.column("rid").to_numpy(), batch.column("vec_id").to_numpy(), _matrix(batch.column("x"), width)
            key = group << 32 | salt
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(data.astype(int)) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                if now != key[a]:
                    yield from ended()
                    now, parts = key[a], []
                    state.clear()
                if not data[a]:
                    parts.append((rid[a:b], ids[a:b], x[a:b]))
                    continue
                if not parts:  # no query of a cell dealt over several groups came here
                    continue
                if not state:
                    begin()
                while a < b:
                    to = min(b, a + state["step"])
                    compare(rid[a:to], ids[a:to], x[a:to])
                    a, state["step"] = to, min(2048, 2 * state["step"])
        yield from ended()

    return run


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, pivots: int = PIVOTS, queries_held: int = QUERIES, rows_held: int = ROWS, copies: int = COPIES) -> DataFrame:
    """Of each row whose vec_id is divisible by every: query_id, rank, vec_id, score of the k rows with the highest scores."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "nearest")
    points = scratch.write(scaled(embeddings, scale).select(F.monotonically_increasing_id().alias("rid"), "vec_id", "x"), "points")
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    # floor moves a component by less than one
    total, width, longest = points.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0)), F.max(F.sqrt(square) + F.sqrt(F.size("x").cast("double")))).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not total:
        return empty
    queries = points.where(F.col("vec_id") % every == 0)
    drawn = points.where(F.pmod(F.xxhash64("rid"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, SAMPLE / total))).select("x")
    sample = drawn.union(points.select("x").limit(1)).toArrow()
    space = Space(_matrix(sample.column("x"), width), longest**2, min(pivots, max(1, isqrt(total) // 2)))
    data, near = _summaries(points, space, k, scratch)
    near = near.toArrow()
    asked = _bounds(queries, space, near.column("rid").to_numpy(), _matrix(near.column("x"), width), k)
    if not asked:
        return empty
    starts, groups = groups_of(space, data, asked, queries_held, copies)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = [max(-(-n // rows_held), -(-tasks // len(groups)), 1) for _, n in groups]
    far = np.full(len(space.pivots), -np.inf)
    for c, (_, reach) in asked.items():
        far[c] = reach
    slack = 1e-6 * longest

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x, rid, ids = _matrix(batch.column("x"), width), batch.column("rid").to_numpy(), batch.column("vec_id").to_numpy()
            mixed = (rid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)

            def rows(at, group, salt, is_data):
                for a in range(0, len(at), 4096):
                    some = pa.array(at[a : a + 4096])
                    n = len(some)
                    column = [np.broadcast_to(c, len(at))[a : a + 4096] for c in (group, salt)]
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(c, pa.int32()) for c in column), pa.array(np.full(n, is_data)), *(batch.column(c).take(some) for c in ("rid", "vec_id", "x"))],
                        ["grp", "salt", "data", "rid", "vec_id", "x"],
                    )

            near_enough = ~(space.distances(space.lengthened(x)) > far + slack)
            for g, (cells, _) in enumerate(groups):
                at = np.flatnonzero(near_enough[:, cells].any(1))
                yield from rows(at, g, (mixed[at] % np.uint64(salts[g])).astype(np.int32), True)
            at = np.flatnonzero(ids % every == 0)
            if len(at):
                cell = space.of_queries(x[at]).argmin(1).tolist()
                mine = np.array([starts[c][0] + int(m) % starts[c][1] for c, m in zip(cell, mixed[at] >> np.uint64(8))])
                copies_of = np.array([salts[g] for g in mine])
                salt = np.concatenate([np.arange(n) for n in copies_of])
                yield from rows(np.repeat(at, copies_of), np.repeat(mine, copies_of), salt, False)

    dealt = points.mapInArrow(deal, _DEALT).repartition(max(tasks, 2 * sum(salts)), "grp", "salt")
    found = dealt.sortWithinPartitions("grp", "salt", "data", "vec_id").mapInArrow(_solve(width, k), _FOUND)
    found = scratch.write(found, "found")
    rank = F.row_number().over(Window.partitionBy("rid").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


ORACLE = """
WITH p AS (
    SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM p q JOIN p c ON q.rid <> c.rid WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
