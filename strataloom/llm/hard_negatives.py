"""Hard negatives from inverted lists of k-means cells, visited by Cauchy-Schwarz bounds.

Rows become vectors of whole numbers and go to the list of their nearest centroid; a list stores its centroid c and its
radius r, the largest distance of a row from it. For an anchor a no row of the list scores above <a, c> + |a| r or below
<a, c> - |a| r. A list is skipped where that range misses the window asked for, and the search stops where the upper bound
is strictly below the kth score known, so that ties are still met. The first round searches a block of the anchor's own
list, which gives a kth score; the second one visits, by falling bounds, every list that it does not exclude. Anchors ask
twice: for their positives, then for rows of other labels inside the window that each positive's score opens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors
from .common import BATCH_BYTES
from .vectors import field, finite, matrix, numbers

#: Turns of k-means on the sample; below this product of norms doubles hold every inner product exactly.
TURNS, EXACT = 12, 2.0**52
LEAST, MOST = -(1 << 63), (1 << 63) - 1
HIT = "anchor_id long, place int, vec_id long, score long"
_HIT = pa.schema([("anchor_id", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
DEALT = "cell int, away double, vec_id long, label long, vector array<bigint>"
_DEALT = pa.schema([("cell", pa.int32()), ("away", pa.float64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("vector", pa.list_(pa.int64()))])


def whole(v: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x); what a long cannot hold becomes its nearest one."""
    return np.clip(np.floor(scale * v), -(2.0**63), 2.0**63 - 1024).astype(np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows from centroids, never negative."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


def k_means(points: np.ndarray, k: int) -> np.ndarray:
    """Centroids of the sample; the first ones are spread over it, and an empty cell keeps its centroid."""
    if not len(points):
        return np.zeros((1, points.shape[1]))
    centres = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)]
    for _ in range(TURNS):
        own = squared(points, centres).argmin(1)
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def listed(centres: np.ndarray, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = centres.shape[1]
        for batch in batches:
            v = whole(matrix(batch.column("vector"), width), scale)
            cell = squared(v.astype(float), centres).argmin(1) if len(v) else np.empty(0, int)
            away = np.sqrt(((v - centres[cell]) ** 2).sum(1))
            vector = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * width, pa.int32()), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(away), batch.column("vec_id"), batch.column("label"), vector], schema=_DEALT)

    return run


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; those that a long cannot hold become its nearest one."""
    x, y = a.astype(float), b.astype(float)
    if np.sqrt((x * x).sum(1).max(initial=0) * (y * y).sum(1).max(initial=0)) < EXACT:
        return (x @ y.T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, LEAST, MOST).astype(np.int64)


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Scores s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def ranges(part: pa.RecordBatch | pa.StructArray, low: int, high: int) -> list[list[tuple[int, int, int]]]:
    """(lowest score, highest score, kth score) of each window of each anchor; a null positive asks without a window."""
    column = part.column("windows") if isinstance(part, pa.RecordBatch) else field(part, "windows")
    out = []
    for windows in column.to_pylist():
        own = []
        for w in windows:
            bottom, top = (LEAST, MOST) if w["score"] is None else window(w["score"], low, high)
            own.append((bottom, top, LEAST if w["kth"] is None else w["kth"]))
        out.append(own)
    return out


def visits(cells: np.ndarray, centres: np.ndarray, radii: np.ndarray, low: int, high: int):
    """An anchor's rows, one for each list that one of its windows has to visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = matrix(batch.column("vector"), centres.shape[1])
            norm = np.sqrt((a * a).sum(1))[:, None]
            middle, spread = a @ centres.T, norm * radii[None]
            room = 1e-9 * (np.abs(middle) + spread + norm * np.sqrt((centres * centres).sum(1))[None]) + 1e-6
            most, least = middle + spread + room, middle - spread - room
            asked = np.zeros(most.shape, bool)
            for i, own in enumerate(ranges(batch, low, high)):
                for bottom, top, kth in own:
                    asked[i] |= (most[i] >= max(bottom, kth)) & (least[i] <= top)
            row, cell = np.nonzero(asked)
            # an anchor comes out once for each list, so what goes out is many times what came in and has a bound of its own
            step = max(1, BATCH_BYTES * batch.num_rows // max(1, batch.nbytes))
            for i in range(0, max(1, len(row)), step):
                yield pa.RecordBatch.from_arrays([pa.array(cells[cell[i : i + step]], pa.int32()), *(batch.column(c).take(pa.array(row[i : i + step])) for c in batch.schema.names)], names=["cell", *batch.schema.names])

    return run


def searcher(width: int, k: int, same: bool, low: int, high: int):
    """The ``k`` best rows of a block for each window, of the anchor's label or of any other."""

    def search(asks: pa.StructArray, rows: pa.StructArray) -> pa.RecordBatch:
        ids = numbers(rows, "vec_id")
        order = np.argsort(ids, kind="stable")
        ids, labels, v = ids[order], numbers(rows, "label")[order], matrix(field(rows, "vector"), width, np.int64)[order]
        anchors, own_label = numbers(asks, "anchor_id"), numbers(asks, "label")
        found = scores(matrix(field(asks, "vector"), width, np.int64), v)
        out: list[list[np.ndarray]] = [[], [], [], []]
        for i, own in enumerate(ranges(asks, low, high)):
            fit = (labels == own_label[i]) == same
            fit &= ids != anchors[i]
            for place, (bottom, top, kth) in enumerate(own):
                some = np.flatnonzero(fit & (found[i] >= max(bottom, kth)) & (found[i] <= top))
                some = some[np.argsort(~found[i, some], kind="stable")[:k]]  # ~s falls as s rises, without overflow
                for x, y in zip(out, (np.full(len(some), anchors[i]), np.full(len(some), place), ids[some], found[i, some])):
                    x.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], t) for x, t in zip(out, _HIT.types)], schema=_HIT)

    return search


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), exact.

    Components become floor(``scale`` * x), a score is the inner product of those, higher first, ties by smaller
    identifier. An anchor's positives are its first rows of the same label; for each, the first rows of other labels with
    ``low`` * positive <= 100 * negative <= ``high`` * positive follow. A positive without any has no row. Rows with a
    null identifier, label or vector, or a null or non-finite component, take no part; a shorter vector counts as filled
    up with zeros. Rows that repeat are candidates each on their own, but none under the anchor's identifier; of anchors
    under one identifier the least label, then the smallest vector, asks. No other column is read.
    """
    own = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    own = own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vector")))
    n, width = vectors.shape(own, "vector")
    centres = k_means(whole(vectors.sample(own, n, "vec_id", "vector", width), scale).astype(float), vectors.n_cells(n))
    deal = listed(centres, scale)
    indexed = vectors.stored(own.select("vec_id", "label", "vector").mapInArrow(deal, DEALT), "negative-rows")
    sizes, blocks = vectors.blocks_of(indexed, ["vec_id", "label", "vector"])
    radii = {r["cell"]: r["far"] for r in indexed.groupBy("cell").agg(F.max("away").alias("far")).collect()}
    cells = np.array(sorted(radii), np.int32)
    stored_lists = (cells, centres[cells], np.array([radii[c] for c in cells]) * (1 + 1e-9))
    anchors = own.where("asks").select("vec_id", "label", "vector").mapInArrow(deal, DEALT)
    anchors = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "vector", "cell")).alias("a")).select(F.col("vec_id").alias("anchor_id"), "a.*")
    anchors = vectors.stored(anchors, "negative-anchors")

    def two_rounds(asking: DataFrame, k: int, same: bool, name: str) -> DataFrame:
        """``asking`` has anchor_id, label, vector, cell and windows (an array of score and kth); the best k of each window."""
        search = searcher(width, k, same, low, high)
        home = asking.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("anchor_id"), F.col("blocks")).cast("int")).drop("blocks")
        met = vectors.asked(home, "anchor_id", blocks, search, HIT, name + "-first")
        kth = met.groupBy("anchor_id", "place").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth")).where("kth is not null")
        kths = kth.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "kth"))).alias("kths"))
        windows = F.transform("windows", lambda w, i: F.struct(w["score"].alias("score"), F.try_element_at(F.col("kths"), i.cast("int")).alias("kth")))
        known = asking.drop("cell").join(kths, "anchor_id", "left").withColumn("windows", windows).drop("kths")
        kind = "cell int, anchor_id long, label long, vector array<bigint>, windows array<struct<score:bigint,kth:bigint>>"
        to_cells = known.select("anchor_id", "label", "vector", "windows").mapInArrow(visits(*stored_lists, low, high), kind)
        spread = to_cells.join(F.broadcast(sizes), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        found = vectors.asked(vectors.stored(spread, name + "-visits"), "anchor_id", blocks, search, HIT, name + "-found")
        best = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    nothing = F.lit(None).cast("long")
    free = anchors.withColumn("windows", F.array(F.struct(nothing.alias("score"), nothing.alias("kth"))))
    first = written_positives(two_rounds(free, positives, True, "positives"))
    per_anchor = first.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("p"))
    opened = F.transform("p", lambda p: F.struct(p["positive_score"].alias("score"), nothing.alias("kth")))
    windowed = anchors.join(per_anchor, "anchor_id").withColumn("windows", opened).drop("p")
    found = two_rounds(windowed, negatives, False, "negatives").withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    return found.join(first, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def written_positives(found: DataFrame) -> DataFrame:
    named = found.select("anchor_id", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return vectors.stored(named, "positives")
