"""Mixing sources to target weights by cube-method balanced sampling.

Each source's target divided by its size is what a document of it is taken on average: a whole number of copies,
and a fractional inclusion probability for one more. The flight phase moves the probabilities of three documents
at a time along the null-space of the two balancing equations (tokens and documents) until one of them is 0 or 1.
It runs over bounded blocks of a source; the at most two documents that a block leaves open fly on in blocks of
the next level. What a whole source leaves, and a few documents kept back, is landed: of all their roundings the
one whose totals come nearest is taken.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, carried, quoted, text_of, written

#: Units of a block, and blocks whose leftovers meet in one block of the next level.
BLOCK, MERGED = 1000, 500
#: Units that a source's last block keeps back from the flight for the landing.
LANDING = 13
#: Sources up to which their table is broadcast.
BROADCAST_SOURCES = 50_000
EPS = 1e-9
UNIT = "source string, doc_id long, size long, copies long, p double, block long, draw long"


def _null_vector(a: list[float], b: list[float]) -> tuple[float, float, float]:
    """A vector that both rows of the balancing equations send to 0."""
    u = (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    if max(map(abs, u)) < EPS * max(1.0, max(a)) * max(b):
        return (b[1], -b[0], 0.0)  # tokens are the same for each document: one equation is enough
    return u


def flight(p: list[float], tokens: list[float], rows: list[float], draws: list[float]) -> list[float]:
    """Move ``p`` until at most two entries are strictly between 0 and 1; ``draws`` in [0, 1) decide the turns."""
    p = list(p)
    at: list[int] = []
    for nxt in range(len(p)):
        if p[nxt] <= EPS or p[nxt] >= 1 - EPS:
            p[nxt] = round(p[nxt])
            continue
        at.append(nxt)
        while len(at) == 3:
            u = _null_vector([tokens[i] for i in at], [rows[i] for i in at])
            up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(at, u) if v)
            down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(at, u) if v)
            step = up if draws[at[0]] * (up + down) < down else -down
            for i, v in zip(at, u):
                p[i] += step * v
                if p[i] <= EPS or p[i] >= 1 - EPS:
                    p[i] = float(round(p[i]))
            left = [i for i in at if 0 < p[i] < 1]
            at = left if len(left) < 3 else left[1:]
    return p


def landed(p: list[float], tokens: list[float], rows: list[float]) -> list[float]:
    """Round the open entries, at most ``LANDING`` and two, so that the totals come nearest, tokens first."""
    open_at = [i for i, x in enumerate(p) if EPS < x < 1 - EPS]
    p = [x if EPS < x < 1 - EPS else float(round(x)) for x in p]
    if not open_at:
        return p
    bits = (np.arange(1 << len(open_at))[:, None] >> np.arange(len(open_at))) & 1
    off = bits - np.array([p[i] for i in open_at])
    by_tokens, by_rows = (np.round(np.abs(off @ np.array([w[i] for i in open_at])), 6) for w in (tokens, rows))
    best = np.lexsort((np.arange(len(bits)), by_rows, by_tokens))[0]
    for i, c in zip(open_at, bits[best]):
        p[i] = float(c)
    return p


def ladder(n: int) -> list[int]:
    """Ranks to keep back, by weight: the heaviest, ever fewer of the lighter ones, and the lightest."""
    ranks = [r for k in range(LANDING) if (r := (1 << k) - 1) < n]
    return sorted({*ranks, *range(max(0, n - (LANDING - len(ranks))), n)})


def _flown(land: bool):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["draw", "doc_id", "size"], kind="stable", na_position="first")
        p = block["p"].to_numpy(float)
        rows = block["copies"].to_numpy(float)
        tokens = block["size"].to_numpy(float) * rows
        # heavy documents fly first, so that what stays open is light
        order = np.argsort(-tokens, kind="stable")
        if land:
            still = order[((p > EPS) & (p < 1 - EPS))[order]]
            kept = still[ladder(len(still))]
            order = order[~np.isin(order, kept)]
        draws = ((block["draw"].to_numpy(np.int64) >> 11) & ((1 << 52) - 1)) / float(1 << 52)
        p[order] = flight(p[order].tolist(), tokens[order].tolist(), rows[order].tolist(), draws[order].tolist())
        return block.assign(p=landed(p.tolist(), tokens.tolist(), rows.tolist()) if land else p)

    return run


def targets(sources: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """``sources`` (source, source_size) with target: weights repeat over the sources by code point, null last.

    All targets add up to all sizes, none is above ``cap`` times its source; the excess goes to the others by
    weight. Sorted by the level at which each is full, the first that its share does not fill fixes the level.
    The window holds one row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("w", weight).withColumn("full", F.col("source_size") * F.lit(float(cap)))
    by_level = Window.orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("full").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("w").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = F.sum("source_size").over(Window.partitionBy())
    rows = rows.withColumn("level", (everything - before) / after)
    fits = F.when(F.col("level") <= F.col("full") / F.col("w") * (1 + 1e-12), F.col("level"))
    level = F.first(fits, ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("level", level).select("source", "source_size", "units", F.least(F.col("full"), F.col("level") * F.col("w")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (size times copies) beside its own columns.

    Every row is included; copies is 0 for one that the mix leaves out and at most ``cap`` rounded up. A row's
    size is its number of words (null text: 0). Rows that repeat source, identifier and size are one unit and
    get the same copies. Null sources are one source, the last. The draw is a hash of identifier and size, so
    reruns agree, however the rows are dealt. An empty table gives no rows. Columns of ``docs`` with these
    names are replaced.
    """
    names = ("size", "source_size", "target", "copies", "taken")
    own, back = carried(docs, *names)
    size = F.regexp_count(text_of(text_col), F.lit(NOT_SPACE)).cast("long")
    keyed = docs.select(F.col(quoted(source_col)).cast("string").alias("source"), F.col(quoted(id_col)).cast("long").alias("doc_id"), size.alias("size"))
    units = written(keyed.groupBy("source", "doc_id", "size").agg(F.count("*").alias("copies")), "mix-units")
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("units"))
    sources = written(targets(sources, weights, cap), "mix-sources")
    n_sources, most = sources.agg(F.count("*"), F.max("units")).collect()[0]
    small = F.broadcast if n_sources <= BROADCAST_SOURCES else (lambda x: x)
    same_source = lambda a, b: a["source"].eqNullSafe(b["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    blocks = F.ceil(F.col("units") / BLOCK)
    draw = F.xxhash64(F.lit("mix"), units["doc_id"], units["size"])
    flying = units.join(small(sources), same_source(units, sources)).select(
        units["source"], "doc_id", "size", "copies", (rate - F.floor(rate)).alias("p"), F.pmod(draw, blocks).cast("long").alias("block"), F.xxhash64(draw).alias("draw")
    )
    decided, levels = [], max(1, math.ceil((most or 0) / BLOCK))
    while True:
        last = levels <= 1
        flown = written(flying.groupBy("source", "block").applyInPandas(_flown(last), UNIT), "mix-flown")
        is_open = (F.col("p") > 0) & (F.col("p") < 1)
        decided.append(flown.where(~is_open))
        if last:
            break
        flying = flown.where(is_open).withColumn("block", F.floor(F.col("block") / MERGED).cast("long"))
        levels = math.ceil(levels / MERGED)
    extra = decided[0]
    for more in decided[1:]:
        extra = extra.unionByName(more)
    extra = extra.select(F.col("source").alias("source_b"), F.col("doc_id").alias("id_b"), F.col("size").alias("size_b"), F.col("p").cast("long").alias("extra__"))
    named = sources.select(F.col("source").alias("source_c"), "source_size", "target")
    rows = docs.select(*own, F.col(quoted(source_col)).cast("string").alias("source__"), F.col(quoted(id_col)).cast("long").alias("id__"), size.alias("size"))
    rows = rows.join(extra, F.col("source__").eqNullSafe(F.col("source_b")) & F.col("id__").eqNullSafe(F.col("id_b")) & (F.col("size") == F.col("size_b")))
    rows = rows.join(small(named), F.col("source__").eqNullSafe(F.col("source_c")))
    copies = (F.floor(rate) + F.col("extra__")).cast("long")
    return rows.select(*back, "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each row as often as it is taken."""
    return mixed.where("copies > 0").withColumn("copy__", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*(F.col(quoted(c)) for c in columns))
