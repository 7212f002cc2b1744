"""Nearest neighbours by a few stable projections in a kd-tree.

Every vector is projected on a few Gaussian directions. If two vectors lie D apart, the squared distance of their
projections over D squared has a chi-square distribution with as many degrees of freedom. So, once a question knows k
vectors within d, a vector nearer than d lies within d times the root of the chi-square quantile in the projection with
that probability: projected neighbours are visited from the nearest on and verified with their whole vectors, d shrinks
on the way, and the search stops where the test holds for all that is left.

The upper levels of the kd-tree are fitted on a bounded sample and deal all rows to cells; a task builds the levels below
for the block that it holds. The first round searches one block of the question's own cell and fixes d; the second one
visits every other cell whose box the test does not exclude.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors
from .vectors import field, finite, matrix, numbers

#: Directions, probability of the stopping test, rows of a leaf of a block's tree, seed of the directions.
DIRECTIONS, CONFIDENCE, LEAF_ROWS, SEED = 8, 0.97, 16, 20240229
FOUND = "query_id long, vec_id long, score double"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def chi_square_quantile(p: float, freedom: int) -> float:
    """Where the distribution function reaches ``p``; ``freedom`` is even, so the function is a finite sum."""
    if p >= 1:
        return math.inf

    def below(x: float) -> float:
        term = total = 1.0
        for i in range(1, freedom // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(80):
        low, high = ((low + high) / 2, high) if below((low + high) / 2) < p else (low, (low + high) / 2)
    return high


class KdTree:
    """Splits at the median of the widest direction until a leaf has few rows or one place."""

    def __init__(self, points: np.ndarray, leaf_rows: int, leaves: int = 1 << 30):
        self.axis, self.cut, self.kids, self.leaves = [-1], [0.0], [(0, 0)], 1
        todo, number = [(0, np.arange(len(points)))], {0: 0}
        while todo and self.leaves < leaves:
            node, rows = todo.pop(0)
            if len(rows) <= leaf_rows:
                continue
            own = points[rows]
            axis = int(np.argmax(own.max(0) - own.min(0)))
            values = own[:, axis]
            cut = np.partition(values, (len(values) - 1) // 2)[(len(values) - 1) // 2]
            if cut == values.max():
                if cut == values.min():
                    continue
                cut = values[values < cut].max()
            left = values <= cut
            self.axis[node], self.cut[node], self.kids[node] = axis, float(cut), (len(self.axis), len(self.axis) + 1)
            for part in (rows[left], rows[~left]):
                todo.append((len(self.axis), part))
                number[len(self.axis)] = 0
                self.axis.append(-1), self.cut.append(0.0), self.kids.append((0, 0))
            self.leaves += 1
        self.axis, self.cut, self.kids = np.array(self.axis), np.array(self.cut), np.array(self.kids)

    def leaf(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64)
        while len(inner := np.flatnonzero(self.axis[at] >= 0)):
            node = at[inner]
            at[inner] = self.kids[node, (points[inner, self.axis[node]] > self.cut[node]).astype(int)]
        return at


def directions(width: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width, DIRECTIONS))


def outside(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point (a row) from each box (a column)."""
    gap = np.maximum(np.maximum(low[None] - points[:, None], points[:, None] - high[None]), 0)
    return (gap * gap).sum(2)


def slack(points: np.ndarray) -> np.ndarray:
    """What rounding may add to a squared projected distance: equal vectors may come from products of another shape."""
    return 1e-9 * (points * points).sum(1)


def projected(tree: KdTree, width: int):
    """(vec_id, vector) to (cell, vec_id, vector, place)."""
    out = pa.schema([("cell", pa.int32()), ("vec_id", pa.int64()), ("vector", pa.list_(pa.float64())), ("place", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        across = directions(width)
        for batch in batches:
            places = matrix(batch.column("vector"), width) @ across
            offsets = pa.array(np.arange(len(places) + 1) * DIRECTIONS, pa.int32())
            listed = pa.ListArray.from_arrays(offsets, pa.array(places.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(tree.leaf(places), pa.int32()), batch.column("vec_id"), batch.column("vector").cast(pa.list_(pa.float64())), listed], schema=out)

    return run


def visits(cells: np.ndarray, low: np.ndarray, high: np.ndarray, stop: float):
    """A question's rows, one for each cell that its bound does not exclude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                places = matrix(part.column("place"), DIRECTIONS)
                bound = part.column("bound").to_numpy(zero_copy_only=False)
                reach = np.where(np.isfinite(bound), stop * bound * bound, np.inf) if math.isfinite(stop) else np.full(len(bound), np.inf)
                row, cell = np.nonzero(outside(places, low, high) <= (reach + slack(places))[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(cells[cell], pa.int32()), *(part.column(c).take(pa.array(row)) for c in part.schema.names)], names=["cell", *part.schema.names])

    return run


def searcher(width: int, k: int, stop: float):
    def search(asks: pa.StructArray, rows: pa.StructArray) -> pa.RecordBatch:
        ids, places = numbers(rows, "vec_id"), matrix(field(rows, "place"), DIRECTIONS)
        tree = KdTree(places, LEAF_ROWS)
        leaf = tree.leaf(places)
        order = np.lexsort((ids, leaf))
        ids, places, leaf, whole = ids[order], places[order], leaf[order], matrix(field(rows, "vector"), width)[order]
        first = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
        end = np.r_[first[1:], len(ids)]
        boxes = np.minimum.reduceat(places, first), np.maximum.reduceat(places, first)
        asked, bounds = numbers(asks, "query_id"), numbers(asks, "bound")
        at, own = matrix(field(asks, "place"), DIRECTIONS), matrix(field(asks, "vector"), width)
        far, near = outside(at, *boxes), slack(at)
        out: list[list[np.ndarray]] = [[], [], []]
        for i in range(len(asked)):
            bound, turn = bounds[i], np.argsort(far[i], kind="stable")
            best_d, best_id = np.empty(0), np.empty(0, np.int64)
            seen, step = 0, 1
            while seen < len(turn):
                reach = (stop * bound * bound if bound < math.inf and stop < math.inf else math.inf) + near[i]
                now = turn[seen : seen + step]
                now = now[far[i, now] <= reach]
                if not len(now):
                    break
                some = np.concatenate([np.arange(first[b], end[b]) for b in now])
                away = places[some] - at[i]
                some = some[((away * away).sum(1) <= reach) & (ids[some] != asked[i])]
                apart = whole[some] - own[i]
                best_d, best_id = np.r_[best_d, np.sqrt((apart * apart).sum(1))], np.r_[best_id, ids[some]]
                kept = np.lexsort((best_id, best_d))[:k]
                best_d, best_id = best_d[kept], best_id[kept]
                if len(best_d) == k:
                    bound = min(bound, best_d[-1])
                seen, step = seen + step, step * 2
            for x, y in zip(out, (np.full(len(best_d), asked[i]), best_id, best_d)):
                x.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], t) for x, t in zip(out, _FOUND.types)], schema=_FOUND)

    return search


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, confidence: float = CONFIDENCE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows nearest to each query, by Euclidean distance in doubles.

    ``queries`` is a table like ``rows`` (its rows need not be among them). A row found is missed with a probability of at
    most 1 - ``confidence``; with 1 the result is exact. Ties go to the smaller identifier; where there are fewer rows than
    ``k`` all are found. Vectors that are null, zero, empty or hold a null or non-finite component take no part, nor do
    rows without identifier. A shorter vector counts as filled up with zeros. Rows that repeat are candidates each on
    their own; those under the query's identifier are not, and of queries under one identifier that with the smallest
    vector asks. No other column is read.
    """
    def part(df: DataFrame) -> DataFrame:
        v = F.col(f"`{vector_col}`")
        rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("vector"))
        return rows.where(F.col("vec_id").isNotNull() & finite(F.col("vector")) & F.exists("vector", lambda x: x != 0))

    own, asking = part(rows), part(queries)
    n, width = vectors.shape(own, "vector")
    width = max(width, vectors.shape(asking, "vector")[1])
    points = vectors.sample(own, n, "vec_id", "vector", width) @ directions(width)
    tree = KdTree(points, 1, vectors.n_cells(n))
    deal, kind = projected(tree, width), "cell int, vec_id long, vector array<double>, place array<double>"
    indexed = vectors.stored(own.mapInArrow(deal, kind), "nearest-rows")
    sizes, blocks = vectors.blocks_of(indexed, ["vec_id", "vector", "place"])
    bounds = indexed.groupBy("cell").agg(*(f("place").alias(c) for f, c in ((_low, "low"), (_high, "high")))).orderBy("cell").collect()
    cells = np.array([r["cell"] for r in bounds], np.int32)
    low, high = (np.array([r[c] for r in bounds], float).reshape(-1, DIRECTIONS) for c in ("low", "high"))
    stop = chi_square_quantile(confidence, DIRECTIONS)
    first = asking.mapInArrow(deal, kind).groupBy("vec_id").agg(F.min(F.struct("vector", "place", "cell")).alias("q"))
    first = vectors.stored(first.select(F.col("vec_id").alias("query_id"), "q.*"), "nearest-queries")
    search = searcher(width, k, stop)
    home = first.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    home = home.select("cell", "block", "query_id", "vector", "place", F.lit(float("inf")).alias("bound"))
    met = vectors.asked(home, "query_id", blocks, search, FOUND, "nearest-first")
    bound = met.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).otherwise(F.lit(float("inf"))).alias("bound"))
    known = first.drop("cell").join(bound, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    to_cells = known.select("query_id", "vector", "place", "bound").mapInArrow(visits(cells, low, high, stop), "cell int, query_id long, vector array<double>, place array<double>, bound double")
    spread = to_cells.join(F.broadcast(sizes), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    found = vectors.asked(vectors.stored(spread, "nearest-visits"), "query_id", blocks, search, FOUND, "nearest-found")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _low(column: str):
    return F.array(*(F.min(F.col(column)[i]) for i in range(DIRECTIONS)))


def _high(column: str):
    return F.array(*(F.max(F.col(column)[i]) for i in range(DIRECTIONS)))
