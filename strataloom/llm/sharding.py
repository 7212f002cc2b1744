"""Shards of near equal bytes by a histogram sort.

The sort key is (hash of the text, identifier). Exact rows and bytes below candidate boundaries are counted over
all partitions; the cells between boundaries that hold a splitter, or more rows than one task should number, are
probed again between their own smallest and largest key, until every splitter meets the tolerance. Then the rows
are exchanged once, by cell, and numbered inside their cell; the counts below a cell give its first slot.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, quoted, text_of, written

#: Probes of the first round and of each refined cell; rows of a cell, and cells, that are aimed at.
PROBES, REFINED = 1024, 256
CELL_ROWS, CELLS = 256, 1 << 14
#: Hash of a text: this many hexadecimal digits of its digest.
HASH_DIGITS = 15


@dataclass
class Cell:
    number: int
    rows: int
    size: int
    h0: int
    h1: int
    d0: int
    d1: int
    below_rows: int = 0
    below_size: int = 0

    @property
    def whole(self) -> bool:
        """Cannot be split: all rows have one key."""
        return self.rows <= 1 or (self.h0 == self.h1 and self.d0 == self.d1)


#: Where a null identifier sorts: before all others.
NULL_ID = -(1 << 63)
ROUND = "cell long, on_hash boolean, start long, width decimal(20,0), base long"


def _probed(rows: DataFrame, rounds: list[DataFrame], key: tuple[Column, Column]) -> DataFrame:
    """``rows`` with the cell that each round sends them to. A round's table has a row for each cell it refines."""
    h, d = key
    rows = rows.withColumn("cell", F.lit(0).cast("long"))
    for refined in rounds:
        near = F.floor((F.when(F.col("on_hash"), h).otherwise(d).cast("decimal(20,0)") - F.col("start").cast("decimal(20,0)")) / F.col("width")).cast("long")
        rows = rows.join(F.broadcast(refined), "cell", "left").withColumn("cell", F.when(F.col("base").isNotNull(), F.col("base") + near).otherwise(F.col("cell")))
        rows = rows.drop("on_hash", "start", "width", "base")
    return rows


def _crossed(c: Cell, total: int, shards: int) -> bool:
    """Whether a boundary between two shards lies strictly inside the cell's bytes."""
    k = c.below_size * shards // total + 1
    return k < shards and k * total < (c.below_size + c.size) * shards


def splitters(keys: DataFrame, shards: int, tolerance: float) -> tuple[list[DataFrame], list[Cell], int]:
    """The rounds, the final cells in key order, and all bytes. ``keys`` has h, d and size.

    What the driver holds is bounded: at most about ``CELLS`` cells of the first round, and of those that are
    refined, each of which holds a splitter or the rows of at least one full cell, ``REFINED`` parts each.
    """
    spark = keys.sparkSession
    n = keys.agg(F.count("*")).collect()[0][0]
    if not n:
        return [], [], 0
    most = max(CELL_ROWS, -(-n // CELLS))
    probes = max(PROBES, 4 * -(-n // most))
    open_cells = [Cell(0, n, 0, 0, 16**HASH_DIGITS - 1, 0, 0)]
    cells: dict[int, Cell] = {}
    rounds: list[DataFrame] = []
    base = 1
    while open_cells:
        table = []
        for c in open_cells:
            by_hash = c.h0 < c.h1
            low, high = (c.h0, c.h1) if by_hash else (c.d0, c.d1)
            table.append((c.number, by_hash, low, Decimal(-(-(high - low + 1) // probes)), base))
            cells.pop(c.number, None)
            base += probes + 1
        first = table[0][4]
        rounds.append(spark.createDataFrame(table, ROUND))
        found = (
            _probed(keys, rounds, (F.col("h"), F.col("d")))
            .where(F.col("cell") >= first)
            .groupBy("cell")
            .agg(F.count("*"), F.sum("size"), F.min("h"), F.max("h"), F.min("d"), F.max("d"))
        )
        for r in found.collect():
            cells[r[0]] = Cell(*r)
        ordered = sorted(cells.values(), key=lambda c: (c.h0, c.d0 if c.h0 == c.h1 else NULL_ID))
        rows = size = 0
        for c in ordered:
            c.below_rows, c.below_size = rows, size
            rows, size = rows + c.rows, size + c.size
        open_cells = [c for c in ordered if not c.whole and (c.rows > 4 * most or (_crossed(c, size, shards) and c.size > tolerance * size / shards))]
        probes = REFINED
    return rounds, ordered, size


def shard_by_bytes(docs: DataFrame, shards: int = 8, tolerance: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with size, text_crc32, shard and slot beside its own columns, every row included.

    A row's size is the UTF-8 bytes of its text (null: none) plus 1. Rows are ordered by text hash and
    identifier, so equal texts lie together; a row belongs to the shard in which the middle of its bytes falls.
    With ``tolerance`` 0 that holds for every row, else a cell of at most that share of a shard stays whole.
    Slots are gapless from 0 in each shard. Repeated rows are alike and may fall on both sides of a boundary,
    null identifiers come first among equal texts, more shards than rows leave some empty. Columns of ``docs``
    with these names are replaced, all others stay as they are, whatever their names.
    """
    text = text_of(text_col)
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_DIGITS), 16, 10).cast("long")
    d = F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(NULL_ID))
    size = (F.octet_length(text) + 1).cast("long")
    crc = F.crc32(text.cast("binary"))
    own, back = carried(docs, "size", "text_crc32", "shard", "slot")
    keys = written(docs.select(h.alias("h"), d.alias("d"), size.alias("size")), "shard-keys")
    rounds, cells, total = splitters(keys, shards, tolerance)
    spark = docs.sparkSession
    starts = first_rows(cells, total, shards)
    table = F.broadcast(spark.createDataFrame([(c.number, c.below_rows) for c in cells], "cell long, below long"))
    rows = docs.select(*own, size.alias("size"), crc.alias("text_crc32"), h.alias("h"), d.alias("d"))
    rows = _probed(rows, rounds, (F.col("h"), F.col("d"))).join(table, "cell")
    rows = rows.withColumn("at", F.col("below") + F.row_number().over(Window.partitionBy("cell").orderBy("h", "d")) - 1)
    first = F.expr(f"array({', '.join(f'{x}L' for x in starts)})")
    shard = F.size(F.filter(first, lambda x: x <= F.col("at"))) - 1
    slot = F.col("at") - F.element_at(first, F.col("shard") + 1)
    return rows.withColumn("shard", shard.cast("int")).select(*back, "size", "text_crc32", "shard", slot.alias("slot"))


def first_rows(cells: list[Cell], total: int, shards: int) -> list[int]:
    """The place in the whole order of each shard's first row: the first whose middle byte lies in the shard.

    Rows of a cell with one key are alike, so a boundary may fall between any two of them; any other cell that a
    boundary still crosses stays whole and goes by its own middle.
    """
    starts = [0]
    for c in cells:
        n, each = (c.rows, c.size // c.rows) if c.whole else (1, c.size)
        while len(starts) < shards:
            lacking = 2 * total * len(starts) - (2 * c.below_size + each) * shards
            row = max(0, -(-lacking // (2 * each * shards)))
            if row >= n:
                break
            starts.append(c.below_rows + row)
    end = cells[-1].below_rows + cells[-1].rows if cells else 0
    return starts + [end] * (shards - len(starts))


def write_shards(docs: DataFrame, folder: str, shards: int = 8) -> None:
    """Write the sharded rows as Parquet, a folder for each shard, in slot order within each file."""
    placed = shard_by_bytes(docs, shards)
    placed.repartitionByRange(placed.sparkSession.sparkContext.defaultParallelism * 2, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
