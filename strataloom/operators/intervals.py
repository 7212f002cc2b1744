"""The innermost range around a place, without meeting every range of a file with every place in it.

A range of lines is a few blocks of a power of two lines (at most two of each size), and of all ranges that cover a whole block
only the innermost can matter to a place inside it. So each block keeps one range, and a place looks up the blocks that it
lies in, one of each size. The work is ranges and places times the logarithm of the lines, and a large file is spread over
its blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def innermost(ranges: DataFrame, places: DataFrame, key: str = "file_path") -> DataFrame:
    """(key, at, id): for each distinct place (key, at) the range (key, first, last, id) around it.

    Of several the one that starts last counts, then the one that ends first, then the smallest id. A place in no range has no
    row; ranges that end before they start hold nothing. Lines are not negative.
    """
    last = max(ranges.agg(F.max("last")).collect()[0][0] or 0, 1)
    levels = F.sequence(F.lit(0), F.lit(int(last).bit_length()))
    shifted = lambda value, k: F.call_function("shiftright", value, k)

    def blocks(k):
        lines = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        lo, hi = shifted(F.col("first").cast("long") + lines - 1, k), shifted(F.col("last").cast("long") + 1, k)
        open_ = lo < hi
        return F.array_compact(F.array(F.when(open_ & (lo % 2 == 1), F.struct(k.alias("level"), lo.alias("block"))), F.when(open_ & (hi % 2 == 1), F.struct(k.alias("level"), (hi - 1).alias("block")))))

    rank = F.struct(F.col("first").alias("a"), (-F.col("last")).alias("b"), (-F.col("id")).alias("c"))
    covers = ranges.where("first <= last").select(key, rank.alias("rank"), F.explode(F.flatten(F.transform(levels, blocks))).alias("b"))
    best = covers.groupBy(key, F.col("b.level").alias("level"), F.col("b.block").alias("block")).agg(F.max("rank").alias("rank"))
    asked = places.select(key, "at").distinct().select(key, "at", F.explode(levels).alias("level"))
    asked = asked.withColumn("block", F.expr("shiftright(cast(at as bigint), level)"))
    return asked.join(best, [key, "level", "block"]).groupBy(key, "at").agg(F.max("rank").alias("rank")).select(key, "at", (-F.col("rank.c")).alias("id"))
