"""Bounded answers: a page never passes for a whole answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows up to which a side of a join is broadcast.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most so many rows; else as it is, so that the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def page(rows: DataFrame, top: int, *order: Column | str, work_cap: int | None = None) -> DataFrame:
    """The first ``top`` rows by ``order`` with total, returned, truncated and truncation_reason on each.

    total is exact, or null where more than ``work_cap`` rows came in and counting was given up. The sort is a
    top-k of each partition, not a sort of all rows, and the count is a subquery of the same plan, so both share what
    is shuffled.
    """
    n = rows if work_cap is None else rows.limit(work_cap + 1)
    counted = n.agg(F.count("*")).scalar()
    first = rows.orderBy(*order).limit(top).withColumn("total", counted)
    over = F.lit(False) if work_cap is None else F.col("total") > work_cap
    reason = F.when(over, "raw_work_limit").when(F.col("total") > top, "top")
    first = first.withColumn("returned", F.least(F.lit(top), F.col("total"))).withColumn("truncated", over | (F.col("total") > top)).withColumn("truncation_reason", reason)
    return first.withColumn("total", F.when(~over, F.col("total")))


def counted(first: DataFrame, every: DataFrame) -> DataFrame:
    """``first``, rows chosen from ``every`` by more than one cap, with total, returned and truncated on each."""
    total, returned = every.agg(F.count("*")).scalar(), first.agg(F.count("*")).scalar()
    rows = first.withColumn("total", total).withColumn("returned", returned)
    return rows.withColumn("truncated", F.col("total") > F.col("returned"))
