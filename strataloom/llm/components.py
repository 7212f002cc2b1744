"""Connected components of a graph of links, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every end of ``links`` (a, b); root is the smallest node that is reached.

    Each round takes the smallest label of the neighbours and then the label of that label, so labels travel
    twice as far in every round; every round is a written table.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("at")).agg(F.min("root").alias("near"))
        step = labels.join(near, F.col("node") == F.col("at")).select("node", F.col("root").alias("before"), F.least("root", "near").alias("root"))
        over = labels.select(F.col("node").alias("via"), F.col("root").alias("far"))
        after = written(step.join(over, F.col("root") == F.col("via"), "left").select("node", "before", F.least("root", F.coalesce("far", "root")).alias("root")), "labels")
        labels = after.select("node", "root")
        if after.where("before <> root").isEmpty():
            return labels
