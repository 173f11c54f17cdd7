"""Exact top-k search by columnar branch and bound.

Vectors become integer columns in blocks, dimension by dimension, in the narrowest
type that holds them. For a block of queries and a block of candidates the inner
products are accumulated one block of dimensions at a time. What the remaining
dimensions can add is at most the product of both remaining lengths; pairs that
cannot reach the query's k-th best score so far are dropped, and the survivors are
compacted into a list once they are few. A task keeps the best k of each query over
all blocks it sees, and one small shuffle merges the tasks' lists.

Blocks of queries are dealt in parts of bounded values, blocks of candidates in
lanes. A task takes the query blocks of a part first and then reads the lane's
candidate blocks one by one, so a query moves once per lane, a candidate once per
part, and no pair of blocks is ever a row. Compute grows with queries times rows,
as an exact answer needs.

Defined results: vectors that are null, have no vec_id, or hold a null or
non-finite component take no part; rows that repeat a vec_id are one vector,
which scores as its best row; a query never meets its own vec_id; only vectors
of equal dimension meet; fewer than k candidates give fewer rows; ties go to the
smaller vec_id; scores beyond a long are cut to its range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageforge.llm.common import settle

SCALE = 256
CANDIDATES, QUERIES, DIMS = 2048, 1024, 16
# Values of a block, queries and values of a part, tasks that search, pairs added at once, and candidates that make a first floor.
VALUES, PART_QUERIES, PART_VALUES = 1 << 20, 1 << 16, 1 << 22
TASKS, PAIRS, FIRST = 2048, 1 << 18, 64
SPARSE = 0.05
# What float32 may lose of a bound under 2 ** 25, and of a floor.
SLACK = 8

BLOCKS = "dim int, part long, block long, n int, kind string, ids binary, columns binary"


def integers(vectors: DataFrame, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """(vec_id, z array<double>): whole numbers floor(256 x), of valid vectors."""
    bad = F.exists(F.col(value), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    y = lambda x: x.cast("double") * SCALE
    # floor() as a double: Spark's own would leave the range of a long.
    z = F.transform(F.col(value), lambda x: y(x) - F.pmod(y(x), F.lit(1.0)))
    valid = F.col(key).isNotNull() & F.col(value).isNotNull() & ~F.coalesce(bad, F.lit(True))
    return vectors.filter(valid).select(F.col(key).cast("long").alias("vec_id"), z.alias("z"))


def _blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Rows ``BLOCKS``: up to ``rows`` vectors each, values dimension by dimension; a part's blocks hold a bounded number of values."""

    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 24
        number, waiting, values = first, {}, {}

        def out(dim, ids, z):
            nonlocal number
            number += 1
            part = first + values.get(dim, 0) // PART_VALUES
            values[dim] = values.get(dim, 0) + z.size
            most = np.abs(z).max(initial=0)
            kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
            row = (dim, part, number - 1, len(ids), kind, ids.astype("<i8").tobytes(), np.ascontiguousarray(z.T, kind).tobytes())
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            dims = np.diff(lists.offsets.to_numpy())
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(dims)
            for dim in np.unique(dims).tolist():
                at, most = np.flatnonzero(dims == dim), min(rows, max(1, VALUES // max(1, dim)))
                z = flat[(ends[at] - dim)[:, None] + np.arange(dim)] if dim else np.zeros((len(at), 0))
                have = waiting.pop(dim, None)
                i, z = (ids[at], z) if have is None else (np.concatenate([have[0], ids[at]]), np.concatenate([have[1], z]))
                while len(i) >= most:
                    yield out(dim, i[:most], z[:most])
                    i, z = i[most:], z[most:]
                if len(i):
                    waiting[dim] = (i, z)
        for dim, (i, z) in waiting.items():
            yield out(dim, i, z)

    return vectors.mapInArrow(run, BLOCKS)


class Block:
    """Vectors of one dimension; ``z`` has a row per dimension."""

    def __init__(self, ids: np.ndarray, z: np.ndarray):
        self.ids, self.z = ids, z
        self.most = float(np.abs(z).max(initial=0))
        squares = np.add.reduceat(np.square(z, dtype=float), np.arange(0, len(z), DIMS)) if len(z) else np.zeros((0, len(ids)))
        # What is left behind each block of dimensions.
        left = np.cumsum(np.r_[squares[1:], np.zeros((1, len(ids)))][::-1], axis=0)[::-1]
        self.tails = np.sqrt(left) * (1 + 1e-9) + 1e-6

    def as_kind(self, kind) -> np.ndarray:
        if kind is object:
            return np.array([[int(x) for x in r] for r in self.z], object).reshape(self.z.shape)
        return self.z.astype(kind)


class Best:
    """The best k (score, vec_id) of each query of one block."""

    def __init__(self, block: Block, k: int):
        self.block, self.ids, self.k = block, block.ids, k
        self.query = np.empty(0, np.int64)
        self.score = np.empty(0, np.int64)
        self.found = np.empty(0, np.int64)
        self.floor = np.full(len(block.ids), -np.inf)

    def add(self, query, found, score) -> None:
        query, found, score = (np.concatenate(x) for x in ((self.query, query), (self.found, found), (self.score, score)))
        # Objects (whole numbers beyond a long) are ordered by their ranks.
        by = np.unique(score, return_inverse=True)[1] if score.dtype == object else score
        order = np.lexsort((-by, found, query))
        query, found, score, by = query[order], found[order], score[order], by[order]
        once = np.r_[True, (query[1:] != query[:-1]) | (found[1:] != found[:-1])] if len(query) else np.empty(0, bool)
        query, found, score, by = query[once], found[once], score[once], by[once]
        order = np.lexsort((found, -by, query))
        query, found, score = query[order], found[order], score[order]
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.empty(0, int)
        rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        self.query, self.found, self.score = (x[rank < self.k] for x in (query, found, score))
        last = rank == self.k - 1
        self.floor[query[last]] = score[last].astype(float)


def _exact(q: Block, c: Block):
    """A type that holds every partial sum exactly."""
    reach = q.most * c.most * max(1, len(q.z))
    return np.float32 if reach < 2**24 else np.float64 if reach < 2**52 else np.int64 if reach < 2**62 else object


def search(best: Best, given: Block) -> None:
    """Add the candidates that can be among the best."""
    n = len(given.ids)
    # A few first: most of the others then meet a floor.
    for at, to in ((0, FIRST), (FIRST, n)) if np.isneginf(best.floor).any() and n > FIRST else ((0, n),):
        _search(best, given, at, to)


def _search(best: Best, given: Block, at: int, to: int) -> None:
    asked, kind = best.block, _exact(best.block, given)
    q, c = asked.as_kind(kind), given.as_kind(kind)[:, at:to]
    # Bounds are floats: of the sums' type where that is one, of its width.
    wide = np.float32 if kind is np.float32 else np.float64
    rests = (asked.tails.astype(wide), given.tails[:, at:to].astype(wide))
    floor = (best.floor - SLACK).astype(wide) if kind is np.float32 else best.floor
    part, pairs = np.zeros((len(asked.ids), to - at), kind), None
    for b, d in enumerate(range(0, len(q), DIMS)):
        x, y, rest_q, rest_c = q[d : d + DIMS], c[d : d + DIMS], rests[0][b], rests[1][b]
        if pairs is None:
            part += x.T @ y
            bound = np.multiply.outer(rest_q, rest_c)
            bound += part if kind is wide else part.astype(wide)
            stay = bound >= floor[:, None]
            if np.count_nonzero(stay) < SPARSE * stay.size:
                i, j = np.nonzero(stay)
                pairs = i, j, part[i, j]
        else:
            i, j, s = pairs
            s = s + (x[:, i] * y[:, j]).sum(axis=0)
            stay = s.astype(wide) + rest_q[i] * rest_c[j] >= floor[i]
            pairs = i[stay], j[stay], s[stay]
    if pairs is None:
        i, j = np.nonzero(part.astype(wide) >= floor[:, None])
        pairs = i, j, part[i, j]
    i, j, s = pairs
    s = s if kind is object else s.astype(np.int64)
    for k in range(0, len(i), PAIRS):
        query, found, score = i[k : k + PAIRS], given.ids[at:to][j[k : k + PAIRS]], s[k : k + PAIRS]
        stay = (score.astype(float) >= best.floor[query]) & (best.ids[query] != found)
        if stay.any():
            best.add(query[stay], found[stay], score[stay])


def top_k(vectors: DataFrame, is_query, k: int = 5, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of every row where ``is_query`` holds."""
    z = integers(vectors, key, value)
    asks = is_query(F.col("vec_id"))
    counted = z.agg(F.count("*").alias("n"), F.count(F.when(asks, 1)).alias("q"), F.sum(F.when(asks, F.size("z"))).alias("values")).first()
    parts = max(1, -(-counted["q"] // PART_QUERIES), -(-(counted["values"] or 0) // PART_VALUES))
    lanes = max(1, min(256, counted["n"] // (4 * CANDIDATES)))
    asked = settle(_blocks(z.filter(asks).repartition(parts, "vec_id"), QUERIES), "asked")
    # A few numbers per part of up to 65,536 queries, so they go to every task.
    held = F.broadcast(asked.select("dim", "part").distinct())
    given = _blocks(z, CANDIDATES).drop("part").join(held, "dim").withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int"))
    asked = asked.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    met = asked.withColumn("given", F.lit(False)).unionByName(given.withColumn("given", F.lit(True)))
    met = met.repartition(min(TASKS, lanes * parts), "dim", "part", "lane").sortWithinPartitions("dim", "part", "lane", "given", "block")

    def run(batches):
        now, bests = None, []

        def out():
            for best in bests:
                whole = [min(max(int(s), -(2**63)), 2**63 - 1) for s in best.score]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(best.ids[best.query]), pa.array(best.found), pa.array(whole, pa.int64())], names=["query_id", "vec_id", "score"]
                )

        for batch in batches:
            dim, part, lane, given, n, kind, ids, columns = batch.columns
            for r in range(batch.num_rows):
                place = (dim[r].as_py(), part[r].as_py(), lane[r].as_py())
                if place != now:
                    yield from out()
                    now, bests = place, []
                z = np.frombuffer(columns[r].as_buffer(), kind[r].as_py()).reshape(place[0], n[r].as_py())
                block = Block(np.frombuffer(ids[r].as_buffer(), "<i8"), z)
                if given[r].as_py():
                    for best in bests:
                        search(best, block)
                else:
                    # A batch's memory goes when it has been read.
                    bests.append(Best(Block(block.ids.copy(), z.copy()), k))
        yield from out()

    found = met.select("dim", "part", "lane", "given", "n", "kind", "ids", "columns").mapInArrow(run, "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
