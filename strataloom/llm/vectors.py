"""What the two vector searches share: packed blocks of rows dealt to cells, and questions dealt to blocks.

A cell may hold any share of all rows, so it is cut into blocks of a bounded number of rows. Questions go to blocks, in
bounded groups, by a join; a task then holds one group and one block at a time. What the driver gets is a bounded
sample and a row for each of a bounded number of cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, BYTES_CONF, written

#: Rows of a block, questions of a group, rows of the sample that cells are fitted on, most cells, rows aimed at in one.
BLOCK_ROWS, GROUP_ROWS = 1024, 256
SAMPLE_ROWS, CELLS, CELL_ROWS = 8192, 1024, 1024

#: Rows that a reader of written tables holds at once.
READ_ROWS, READ_CONF = 64, "spark.sql.parquet.columnarReaderBatchSize"


@contextmanager
def small_batches(spark: SparkSession):
    """Python workers get at most ``BATCH_BYTES`` at once while a table is written; then the session is as before.

    A row of a table of blocks is about half a megabyte, so its reader takes few of them at once as well.
    """
    own = {BYTES_CONF: str(BATCH_BYTES), READ_CONF: str(READ_ROWS)}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str) -> DataFrame:
    with small_batches(df.sparkSession):
        return written(df, name)


def finite(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(~odd, F.lit(False))


def matrix(column: pa.Array, width: int, kind=np.float64) -> np.ndarray:
    """The vectors of a list column as rows; shorter ones are filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), kind)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def shape(rows: DataFrame, vector: str) -> tuple[int, int]:
    """Number of rows, and components of the longest vector."""
    n, width = rows.agg(F.count("*"), F.max(F.size(vector))).collect()[0]
    return n, width or 0


def sample(rows: DataFrame, n: int, id_col: str, vector: str, width: int) -> np.ndarray:
    """About ``SAMPLE_ROWS`` vectors, chosen by a hash of their identifier, and never more than twice that."""
    share = F.lit(min(1 << 20, -(-SAMPLE_ROWS * (1 << 20) // max(n, 1))))
    chosen = rows.where(F.pmod(F.xxhash64(F.lit("sample"), id_col), F.lit(1 << 20)) < share).select(vector).limit(2 * SAMPLE_ROWS)
    return matrix(chosen.toArrow().column(0).combine_chunks(), width)


def n_cells(n: int) -> int:
    return max(1, min(CELLS, -(-n // CELL_ROWS)))


def blocks_of(indexed: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(cell, blocks) and the packed blocks (cell, block, rows). ``indexed`` is a written table with a cell a row.

    The rows of a cell are dealt evenly over its blocks by their place in the table.
    """
    counted = indexed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    sizes = written(counted, "cells")
    rows = indexed.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.monotonically_increasing_id(), F.col("blocks")).cast("int"))
    return sizes, written(rows.groupBy("cell", "block").agg(F.collect_list(F.struct(*columns)).alias("rows")), "blocks")


def asked(questions: DataFrame, key: str, blocks: DataFrame, search: Callable, schema: str, name: str) -> DataFrame:
    """What ``search`` finds for each question in the block that it is for. ``questions`` has a cell and a block a row.

    ``search(asks, rows)`` gets two struct arrays: at most about ``GROUP_ROWS`` questions, and the rows of their block.
    """
    columns = [c for c in questions.columns if c not in ("cell", "block")]
    counts = questions.groupBy("cell", "block").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("groups"))
    dealt = questions.join(counts, ["cell", "block"]).withColumn("group", F.pmod(F.xxhash64(F.lit("group"), key), F.col("groups")))
    packed = dealt.groupBy("cell", "block", "group").agg(F.collect_list(F.struct(*columns)).alias("asks"))
    pairs = packed.join(blocks, ["cell", "block"]).select("asks", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield search(batch.column("asks")[i].values, batch.column("rows")[i].values)

    return stored(pairs.mapInArrow(run, schema), name)


def field(rows: pa.StructArray, name: str) -> pa.Array:
    return rows.flatten()[rows.type.get_field_index(name)]


def numbers(rows: pa.StructArray, name: str) -> np.ndarray:
    return field(rows, name).to_numpy(zero_copy_only=False)
