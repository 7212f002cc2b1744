"""Which items meet through shared values, where nearly every two of them do.

A join through values makes a row for each value that two items share, and all of these are shuffled before the distinct pairs are
known. Here items are dealt to blocks, a block is packed by value, and a task takes two blocks and has a bit for each two of their
items. What is shuffled are packed blocks, each as often as the other side has blocks; pairs are only made where they are the answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators.bounds import small
from strataloom.operators.store import bounded_batches, cut

#: Items of a block, of one that is only counted, and below which a block is not cut for the sake of more tasks.
ROWS, COUNTED, LEAST = 8_192, 65_536, 256
#: Bytes of the rows of bits that a task holds for values of many places.
DENSE = 32 << 20
#: Pairs that a task hands on or spreads out at once, and tasks of a product.
AT_ONCE, TASKS = 1 << 17, 10_000


def value_ids(left: DataFrame, right: DataFrame, *values: str) -> DataFrame:
    """(values, value): a number for each that both sides have."""
    both = left.select(*values).distinct().join(right.select(*values).distinct(), list(values))
    return cut(both.withColumn("value", F.monotonically_increasing_id()), "product-values")


def dealt(items: DataFrame, key: str, rows: int = ROWS) -> DataFrame:
    """``items``, each once, with (block, at): about ``rows`` in a block, numbered in it from 0 on."""
    n = items.count()
    blocks = max(1, -(-n // rows), min(items.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST)))
    block = items.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks)).cast("int"))
    # one sorted list a block, no longer than a block is
    lists = block.groupBy("block").agg(F.array_sort(F.collect_list(F.struct(key, *(c for c in items.columns if c != key)))).alias("list"))
    return cut(lists.select("block", F.posexplode("list").alias("at", "item")).select("item.*", "block", "at"), "product-items")


def packed(items: DataFrame, key: str, shown: str, **relations: DataFrame) -> DataFrame:
    """(block, items, a column for each of ``relations``): what is ``shown`` of the dealt items in their order, and the places
    of a block's items for each value of a relation (key, value)."""
    of = F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(shown).alias("shown")))), lambda x: x["shown"])
    every = items.groupBy("block").agg(of.alias("items"))
    for name, rows in relations.items():
        places = rows.select(key, "value").distinct().join(items.select(key, "block", "at"), key).groupBy("block", "value").agg(F.collect_list("at").alias("ats"))
        every = every.join(places.groupBy("block").agg(F.collect_list(F.struct("value", "ats")).alias(name)), "block", "left")
    return cut(every, "product-blocks")


def each_two(left: DataFrame, right: DataFrame, run: Callable[[dict, dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``run`` gives for each block of ``left`` with each of ``right``, in tasks of their own."""
    a = left.select(F.col("block").alias("i"), F.struct("*").alias("l"))
    b = right.select(F.col("block").alias("j"), F.struct("*").alias("r"))
    n = min(TASKS, max(1, left.count() * right.count()))
    bounded_batches(left.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [dict(zip((f.name for f in c.type), c.flatten())) for c in (batch.column("l"), batch.column("r"))]
            for k in range(batch.num_rows):
                yield from run(*({name: column[k].values if pa.types.is_list(column.type) else column[k].as_py() for name, column in side.items()} for side in sides))

    return a.crossJoin(b).repartition(n, "i", "j").select("l", "r").mapInArrow(each, schema)


def _places(packs: pa.StructArray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values in order, where their places begin and end, and the places."""
    if packs is None or not len(packs):
        return np.empty(0, np.int64), np.empty((0, 2), np.int64), np.empty(0, np.int64)
    value, ats = packs.flatten()
    value, ends = value.to_numpy(), ats.offsets.to_numpy()
    order = np.argsort(value)
    return value[order], np.column_stack([ends[:-1], ends[1:]])[order].astype(np.int64), ats.values.to_numpy()


def bits(left: pa.StructArray | None, n_left: int, right: pa.StructArray | None, n_right: int) -> np.ndarray:
    """A row of bits for each left item: the right items with which it shares a value."""
    width = -(-n_right // 64) * 8
    met = np.zeros((n_left, width), np.uint8)
    (va, ea, a), (vb, eb, b) = _places(left), _places(right)
    _, ka, kb = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    ea, eb = ea[ka], eb[kb]
    na, nb = ea[:, 1] - ea[:, 0], eb[:, 1] - eb[:, 0]
    # about the nanoseconds that pairs cost by themselves and that a row of bits costs
    few = na * nb * 100 <= 20_000 + na * width // 10
    dense = np.flatnonzero(~few)
    step = max(1, DENSE // max(1, width))
    for begin in range(0, len(dense), step):
        of = dense[begin : begin + step]
        rows = np.zeros((len(of), width), np.uint8)
        for k, (x, y) in enumerate(eb[of]):
            row = np.zeros(width * 8, np.uint8)
            row[b[x:y]] = 1
            rows[k] = np.packbits(row, bitorder="little")
        rows = rows.view(np.uint64)
        # all values of a left item at once, so that what it has met is written once
        item, k = np.concatenate([a[x:y] for x, y in ea[of]]), np.repeat(np.arange(len(of)), na[of])
        order = np.argsort(item, kind="stable")
        item, k = item[order], k[order]
        starts = np.flatnonzero(np.diff(item, prepend=-1))
        for x, y in zip(starts, [*starts[1:], len(item)]):
            met.view(np.uint64)[item[x]] |= np.bitwise_or.reduce(rows[k[x:y]], axis=0)
    # of values with few places each pair is set by itself, a bounded number at once
    ea, eb, na, nb = ea[few], eb[few], na[few], nb[few]
    sizes = na * nb
    begin = 0
    while begin < len(sizes):
        end = max(begin + 1, begin + int(np.searchsorted(np.cumsum(sizes[begin:]), AT_ONCE, side="right")))
        n = sizes[begin:end]
        of = np.repeat(np.arange(begin, end), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        rows, cols = a[ea[of, 0] + k // nb[of]], b[eb[of, 0] + k % nb[of]]
        np.bitwise_or.at(met, (rows, cols >> 3), (1 << (cols & 7)).astype(np.uint8))
        begin = end
    return met


def set_places(met: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of the bits that are set, a bounded number at once."""
    step = max(1, AT_ONCE // max(1, met.shape[1] * 8))
    for begin in range(0, len(met), step):
        rows, cols = np.nonzero(np.unpackbits(met[begin : begin + step], axis=1, bitorder="little"))
        if len(rows):
            yield rows + begin, cols


def without_own(met: np.ndarray, l: dict, r: dict) -> np.ndarray:  # noqa: E741
    """``met`` without the bits of an item with itself, where both sides are one block."""
    if l["block"] == r["block"]:
        k = np.arange(len(met))
        met[k, k >> 3] &= ~(1 << (k & 7)).astype(np.uint8)
    return met


def pairs(left: DataFrame, right: DataFrame, value: str, a: str, b: str, apart: bool = True, unless: DataFrame | None = None) -> DataFrame:
    """(a, b): items of ``left`` (a, value) with those of ``right`` (b, value) that have a value in common, each pair once.

    If ``apart``, an item is no pair with itself. Two items that share a mark of ``unless`` (item, mark) are no pair.
    """
    ids = value_ids(left, right, value)
    uses, gives = (rows.join(small(ids), value).select(F.col(c).alias("item"), "value").distinct() for rows, c in ((left, a), (right, b)))
    uses, gives = cut(uses, "product-left"), cut(gives, "product-right")
    items = dealt(uses.select("item").union(gives.select("item")).distinct(), "item")
    marks = {} if unless is None else {"marks": unless.join(value_ids(unless, unless, "mark"), "mark")}
    every = packed(items, "item", "item", uses=uses, gives=gives, **marks)
    kind, marked = dict(left.dtypes)[a], bool(marks)

    def run(l: dict, r: dict) -> Iterator[pa.RecordBatch]:  # noqa: E741
        met = bits(l["uses"], len(l["items"]), r["gives"], len(r["items"]))
        if marked:
            met &= ~bits(l["marks"], len(l["items"]), r["marks"], len(r["items"]))
        for rows, cols in set_places(without_own(met, l, r) if apart else met):
            yield pa.RecordBatch.from_arrays([l["items"].take(pa.array(rows)), r["items"].take(pa.array(cols))], [a, b])

    return each_two(every.where("uses is not null").drop("gives"), every.where("gives is not null").drop("uses"), run, f"{a} {kind}, {b} {kind}")


def counts(left: DataFrame, right: DataFrame, values: list[str], a: str, b: str, n: str) -> DataFrame:
    """(a, n): for each item of ``left`` (a, values) how many of ``right`` (b, values) have values in common with it, if any."""
    ids = value_ids(left, right, *values)
    one, other = (cut(rows.join(small(ids), values).select(c, "value").distinct(), "product-side") for rows, c in ((left, a), (right, b)))
    mine = dealt(one.select(a).distinct(), a)
    blocks = packed(mine, a, "at", of=one), packed(dealt(other.select(b).distinct(), b, COUNTED), b, "at", of=other)

    def run(l: dict, r: dict) -> Iterator[pa.RecordBatch]:  # noqa: E741
        found = np.bitwise_count(bits(l["of"], len(l["items"]), r["of"], len(r["items"])).view(np.uint64)).sum(axis=1, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), l["block"], np.int32)), pa.array(np.arange(len(found), dtype=np.int32)), pa.array(found)], ["block", "at", n])

    met = each_two(*blocks, run, f"block int, at int, {n} long").groupBy("block", "at").agg(F.sum(n).alias(n))
    return mine.join(met.where(F.col(n) > 0), ["block", "at"]).select(a, n)


@dataclass
class Links:
    """Blocks of items with sizes, each item standing for so many alike, that ``uses`` and ``gives`` (key, values) link with each other."""

    items: DataFrame
    key: str
    blocks: DataFrame

    def mutual(self) -> DataFrame:
        """(key): items linked both ways with another one, or with one alike."""

        def run(l: dict, r: dict) -> Iterator[pa.RecordBatch]:  # noqa: E741
            n = len(l["items"]), len(r["items"])
            met = bits(l["uses"], n[0], r["gives"], n[1]) & bits(l["gives"], n[0], r["uses"], n[1])
            if l["block"] == r["block"]:
                k = np.flatnonzero(l["items"].to_numpy() == 1)
                met[k, k >> 3] &= ~(1 << (k & 7)).astype(np.uint8)
            at = np.flatnonzero(met.any(axis=1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), l["block"], np.int32)), pa.array(at)], ["block", "at"])

        found = each_two(self.blocks, self.blocks, run, "block int, at int").distinct()
        return self.items.join(found, ["block", "at"], "left_semi").select(self.key)

    def matrix(self) -> DataFrame:
        """(i, j, bits): a row of bits for each item of a block, the items of the other block that it is linked with either way."""

        def run(l: dict, r: dict) -> Iterator[pa.RecordBatch]:  # noqa: E741
            n = len(l["items"]), len(r["items"])
            met = bits(l["uses"], n[0], r["gives"], n[1]) | bits(l["gives"], n[0], r["uses"], n[1])
            yield pa.RecordBatch.from_arrays([pa.array([l["block"]], pa.int32()), pa.array([r["block"]], pa.int32()), pa.array([met.tobytes()], pa.binary())], ["i", "j", "bits"])

        return cut(each_two(self.blocks, self.blocks, run, "i int, j int, bits binary"), "product-matrix")

    def onward(self, matrix: DataFrame, sent: DataFrame) -> DataFrame:
        """(key, got): for each item the sum of what is ``sent`` (key, share) by all that it is linked with, but itself."""
        lists = F.array_sort(F.collect_list(F.struct("at", F.coalesce("share", F.lit(0.0)).alias("share"), "size")))
        each = self.items.join(sent, self.key, "left").groupBy(F.col("block").alias("j")).agg(lists.alias("l"))
        each = each.select("j", F.col("l.share").alias("share"), F.transform("l", lambda x: x["share"] * x["size"]).alias("whole"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    i, j, bits, own, whole = (batch.column(c)[k] for c in ("i", "j", "bits", "share", "whole"))
                    whole = whole.values.to_numpy()
                    width = -(-len(whole) // 64) * 8
                    met = np.frombuffer(bits.as_py(), np.uint8).reshape(-1, width)
                    # what a byte of bits stands for at each place
                    sums = np.pad(whole, (0, width * 8 - len(whole))).reshape(width, 8) @ BYTES
                    got, places = np.empty(len(met)), np.arange(width, dtype=np.int32) * 256
                    for begin in range(0, len(met), 512):
                        got[begin : begin + 512] = sums.ravel()[places + met[begin : begin + 512]].sum(axis=1)
                    if i == j:
                        at = np.arange(len(met))
                        got -= ((met[at, at >> 3] >> (at & 7)) & 1) * own.values.to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), i.as_py(), np.int32)), pa.array(np.arange(len(met), dtype=np.int32)), pa.array(got)], ["block", "at", "got"])

        got = matrix.join(F.broadcast(each), "j").select("i", "j", "bits", "share", "whole").mapInArrow(run, "block int, at int, got double")
        got = got.groupBy("block", "at").agg(F.sum("got").alias("got"))
        return self.items.join(got, ["block", "at"]).select(self.key, "got")


#: The bits of each byte.
BYTES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").T.astype(np.float64)


def links(sizes: DataFrame, key: str, uses: DataFrame, gives: DataFrame, value: str) -> Links:
    """Items (key, size) and what they use and give (key, value)."""
    ids = value_ids(uses, gives, value)
    items = dealt(sizes.select(key, "size"), key)
    sides = {name: rows.join(small(ids), value).select(key, "value") for name, rows in (("uses", uses), ("gives", gives))}
    return Links(items, key, packed(items, key, "size", **sides))
