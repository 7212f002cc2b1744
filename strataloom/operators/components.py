"""Strong components of a directed graph of any size.

A round trims, contracts and searches. Trimming drops nodes where nothing ends or nothing starts. Contracting replaces paths
of nodes with one way in and one way out by an edge, their pointers doubling, so a chain of any length takes a few
steps; what lies on such a path belongs to the component of its ends if those share one. The search goes forward and
backward from many pivots at once: every node takes the smallest label that reaches it, by an edge or by the label of its
label, so labels double their reach; inside a label the same backwards, and nodes whose two labels agree are a
component. Each step is a join whose result is written. Once few pairs are left, one task ends the work.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators.store import cut

#: Pairs that one task may take over; it holds each once.
LOCAL_PAIRS = 1 << 18


def strong_nodes(pairs: DataFrame, local_pairs: int | None = None) -> DataFrame:
    """(root, node): nodes on a cycle of two or more of ``pairs`` (from_file, to_file), root the smallest of its component."""
    local_pairs = LOCAL_PAIRS if local_pairs is None else local_pairs
    left = cut(pairs.select(F.col("from_file").alias("a"), F.col("to_file").alias("b")).where("a <> b").distinct(), "strong-pairs")
    #: (root, node) found so far, roots being any node of the component; (node, a, b) of paths that an edge stands for
    found, paths = [], []
    while True:
        if left.count() <= local_pairs:
            found.append(cut(_local(left), "strong-found"))
            break
        left = trimmed(left)
        if left.isEmpty():
            break
        left, inner, rings = contracted(left)
        paths.append(inner)
        found.append(rings)
        labels = least_reaching(left)
        same = left.join(labels.select(F.col("node").alias("a"), F.col("label").alias("root")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("root_b")), "b").where("root = root_b")
        inside = cut(same.select("a", "b"), "strong-inside")
        back = least_reaching(inside.select(F.col("b").alias("a"), F.col("a").alias("b")))
        strong = labels.join(back.select("node", F.col("label").alias("back")), "node").where("label = back").select(F.col("label").alias("root"), "node")
        strong = cut(strong, "strong-found")
        found.append(strong)
        gone = strong.select("node")
        # an edge between two labels lies on no cycle, nor does one that touches a component which is whole
        left = cut(inside.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"), "strong-pairs")
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    nodes = cut(nodes.select("root", "node"), "strong-nodes")
    for inner in reversed(paths):
        # the ends of a path are nodes of its round; one that no search gave a component is its own
        ends = inner.join(nodes.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a", "left").join(nodes.select(F.col("node").alias("b"), F.col("root").alias("root_b")), "b", "left")
        ends = ends.withColumn("root_a", F.coalesce("root_a", "a")).withColumn("root_b", F.coalesce("root_b", "b")).where("root_a = root_b")
        on = ends.select(F.col("root_a").alias("root"), "node").unionByName(ends.select(F.col("root_a").alias("root"), F.col("a").alias("node")))
        nodes = cut(nodes.unionByName(on).distinct(), "strong-nodes")
    big = nodes.groupBy("root").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1").select("root", "least")
    return nodes.join(big, "root").select(F.col("least").alias("root"), "node")


def trimmed(left: DataFrame, rounds: int = 2) -> DataFrame:
    """``left`` without pairs that start where none ends or end where none starts, a few rounds deep."""
    for _ in range(rounds):
        before = left.count()
        starts, ends = left.select(F.col("a").alias("b")).distinct(), left.select(F.col("b").alias("a")).distinct()
        left = cut(left.join(starts, "b", "left_semi").join(ends, "a", "left_semi").select("a", "b"), "strong-pairs")
        if left.count() == before:
            break
    return left


def contracted(left: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, paths, rings): the graph without nodes that have one way in and one way out.

    ``paths`` (node, a, b) says between which nodes each of them lay; ``rings`` (root, node) are paths that close on
    themselves.
    """
    out = left.groupBy("a").agg(F.count("*").alias("n_out"), F.min("b").alias("onward")).where("n_out = 1").select(F.col("a").alias("node"), "onward")
    into = left.groupBy("b").agg(F.count("*").alias("n_in"), F.min("a").alias("back")).where("n_in = 1").select(F.col("b").alias("node"), "back")
    inner = cut(out.join(into, "node"), "strong-inner")
    n = inner.count()
    empty = left.select(F.col("a").alias("root"), F.col("a").alias("node")).where("false")
    if not n:
        return left, left.select(F.col("a").alias("node"), "a", "b").where("false"), empty
    # pointers to a node that is no inner one rest; the others double what they span
    at = inner.select("node", F.col("back").alias("a"), F.col("onward").alias("b"), F.least("node", "onward").alias("least"))
    for _ in range(max(1, n.bit_length())):
        to_a = at.select(F.col("node").alias("a"), F.col("a").alias("a2"))
        to_b = at.select(F.col("node").alias("b"), F.col("b").alias("b2"), F.col("least").alias("least2"))
        further = at.join(to_a, "a", "left").join(to_b, "b", "left")
        at = cut(further.select("node", F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"), F.least("least", F.coalesce("least2", "least")).alias("least"), F.coalesce(F.col("a2").isNotNull() | F.col("b2").isNotNull(), F.lit(False)).alias("moved")), "strong-paths")
        if at.where("moved").isEmpty():
            break
        at = at.drop("moved")
    names = inner.select(F.col("node").alias("b"), F.lit(True).alias("ring"))
    ends = at.select("node", "a", "b", "least").join(names, "b", "left")
    rings = cut(ends.where("ring").select(F.col("least").alias("root"), "node"), "strong-found")
    paths = cut(ends.where("ring is null").select("node", "a", "b"), "strong-paths")
    mine = inner.select("node")
    kept = left.join(mine.withColumnRenamed("node", "a"), "a", "left_anti").join(mine.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b")
    return cut(kept.unionByName(paths.select("a", "b")).where("a <> b").distinct(), "strong-pairs"), paths, rings


def least_reaching(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node from which edges (a, b) lead to each node, itself included."""
    labels = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct().withColumn("label", F.col("node"))
    while True:
        met = edges.join(labels.select(F.col("node").alias("a"), F.col("label").alias("met")), "a").groupBy(F.col("b").alias("node")).agg(F.min("met").alias("met"))
        # what reaches a node's label reaches the node
        of_label = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = labels.join(of_label, "label", "left").join(met, "node", "left")
        after = cut(after.select("node", F.col("label").alias("before"), F.least("label", F.coalesce("further", "label"), F.coalesce("met", "label")).alias("label")), "strong-labels")
        labels = after.select("node", "label")
        if after.where("before <> label").isEmpty():
            return labels


def _local(pairs: DataFrame) -> DataFrame:
    """The components of a graph whose size has been checked, in one task."""
    from strataloom.operators.graph import strong_components

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        graph: dict = {}
        for a, b in zip(rows["a"], rows["b"]):
            graph.setdefault(a, set()).add(b)
        found = strong_components(graph)
        return pd.DataFrame([(m[0], x) for m in found for x in m], columns=["root", "node"])

    kind = dict(pairs.dtypes)["a"]
    return pairs.groupBy(F.lit(1).alias("one")).applyInPandas(run, f"root {kind}, node {kind}")
