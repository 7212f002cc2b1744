"""Comparison of snapshots and the reach of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import paths
from strataloom.functions.hashing import fnv1a_hex
from strataloom.operators import graph, intervals, reach
from strataloom.operators.bounds import small
from strataloom.operators.store import bounded_batches, cut


def snapshot_diff(base: DataFrame, head: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """(key, change): added, removed or changed between two snapshots; equal rows are left out. Nulls equal nulls."""
    b = base.select(F.col(key).alias("b_key"), F.struct(*attributes).alias("b"), F.lit(True).alias("in_b"))
    h = head.select(F.col(key).alias("h_key"), F.struct(*attributes).alias("h"), F.lit(True).alias("in_h"))
    rows = b.join(h, F.col("b_key") == F.col("h_key"), "full_outer")
    change = F.when(F.col("in_b").isNull(), "added").when(F.col("in_h").isNull(), "removed").when(~F.col("b").eqNullSafe(F.col("h")), "changed")
    return rows.select(F.coalesce("b_key", "h_key").alias(key), change.alias("change")).where("change is not null")


def match_declarations(base: DataFrame, head: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, change, base_id, head_id, uncertain) for declarations of a scope (parent, name, kind).

    Equal signatures pair first in, first out by place; no signature equals no signature. Exactly one that is left on
    each side pairs as a change of signature; other leftovers are added or removed. What is there afterwards is
    uncertain where several of one signature could be each other, and what was added also where something that went
    could be it.
    """
    spelled = F.struct(F.col("signature").isNull().alias("none"), F.coalesce("signature", F.lit("")).alias("text")).alias("spelled")
    side = lambda df, tag: df.select(*scope, spelled, F.col("id").alias(f"{tag}_id"), F.row_number().over(Window.partitionBy(*scope, "signature").orderBy("line_start", "line_end", "id")).alias("n"))
    b, h = side(base, "base"), side(head, "head")
    pairs = b.join(h, [*scope, "spelled", "n"], "full_outer")
    alike = Window.partitionBy(*scope, "spelled")
    many = (F.count("base_id").over(alike) > 0) & (F.count("head_id").over(alike) > 0) & (F.count(F.lit(1)).over(alike) > 1)
    pairs = pairs.withColumn("many", many).withColumn("vague", F.max("many").over(Window.partitionBy(*scope)))
    left = pairs.where("base_id is null or head_id is null")
    w = Window.partitionBy(*scope)
    counted = left.withColumn("n_b", F.count("base_id").over(w)).withColumn("n_h", F.count("head_id").over(w))
    one = counted.where("n_b = 1 and n_h = 1").groupBy(*scope).agg(F.max("base_id").alias("base_id"), F.max("head_id").alias("head_id"), F.max("vague").alias("vague"))
    one = one.select(*scope, F.lit("signature_changed").alias("change"), "base_id", "head_id", F.col("vague").alias("uncertain"))
    rest = counted.where("not (n_b = 1 and n_h = 1)")
    rest = rest.select(*scope, F.when(F.col("base_id").isNull(), "added").otherwise("removed").alias("change"), "base_id", "head_id", (F.col("base_id").isNull() & (F.col("vague") | (F.col("n_b") > 0))).alias("uncertain"))
    same = pairs.where("base_id is not null and head_id is not null").select(*scope, F.lit("same").alias("change"), "base_id", "head_id", F.col("vague").alias("uncertain"))
    return one.unionByName(rest).unionByName(same)


def match_trees(base: DataFrame, head: DataFrame) -> DataFrame:
    """``match_declarations`` of (id, parent_id, file_path, name, kind, signature, lines) from the top of each file down.

    Children are compared only below parents that are the same declaration; below one that came or went all did.
    A matched pair goes by its head's identifier. One round of joins and a written table for each level.
    """
    columns = ["id", "parent_id", "file_path", "name", "kind", "signature", "line_start", "line_end"]

    def top(side: DataFrame) -> DataFrame:
        known = side.select(F.col("id").alias("parent_id"))
        return side.join(known, "parent_id", "left_anti").withColumn("under", F.lit(None).cast("long"))

    # every level reads both sides: what they were made from is not joined, and sent around, for each again
    base, head = cut(base.select(columns), "tree-base"), cut(head.select(columns), "tree-head")
    b, h = top(base), top(head)
    out = None
    while True:
        scope = [F.col("file_path"), F.coalesce("under", F.lit(-1)).alias("under"), F.col("name"), F.col("kind")]
        side = lambda df: df.select(*scope, "id", "signature", "line_start", "line_end")  # noqa: E731, B023
        level = cut(match_declarations(side(b), side(h), ["file_path", "under", "name", "kind"]), "matched-level")
        out = level if out is None else out.unionByName(level)
        if level.isEmpty():  # the first level stays, empty or not, for its columns
            break
        pair = level.select("base_id", "head_id", F.coalesce("head_id", "base_id").alias("under"))
        below = lambda df, end: df.select(columns).join(pair.where(f"{end} is not null").select(F.col(end).alias("parent_id"), "under", F.col("base_id").isNull().alias("new"), F.col("head_id").isNull().alias("gone")), "parent_id")  # noqa: E731, B023
        # what is below a removed parent must not meet what is below an added one of the same number
        b, h = (below(base, "base_id").withColumn("under", F.when(F.col("gone"), -2 - F.col("under")).otherwise(F.col("under"))), below(head, "head_id"))
    return out.drop("under")


def body_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """(path, first_line, last_line): hunks of the new text by a line diff of each file that is on both sides."""

    def run(rows):
        import difflib

        import pandas as pd

        out = []
        for path, old, new in zip(rows["path"], rows["old"], rows["new"]):
            for tag, _, _, j1, j2 in difflib.SequenceMatcher(None, (old or "").split("\n"), (new or "").split("\n"), autojunk=False).get_opcodes():
                if tag != "equal":
                    out.append((path, j1 + 1, max(j1 + 1, j2)))
        return pd.DataFrame(out, columns=["path", "first_line", "last_line"])

    both = base.select("path", F.col("text").alias("old")).join(head.select("path", F.col("text").alias("new")), "path").where("not (old <=> new)")
    return both.mapInPandas(lambda batches: map(run, batches), "path string, first_line long, last_line long")


def deepest(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """The declaration that starts last among those around a hunk's first line."""
    ranges = symbols.select("id", F.col("file_path").alias("path"), F.col("line_start").alias("first"), F.col("line_end").alias("last"))
    found = intervals.innermost(ranges, hunks.select("path", F.col("first_line").alias("at")), "path")
    return hunks.distinct().join(found.withColumnRenamed("at", "first_line"), ["path", "first_line"]).select("path", "first_line", "last_line", "id")


#: Seeds and reached rows beyond which a change's impact is not worked out.
SEED_CAP, ROW_CAP = 200, 5_000


def bounded_impact(symbols: DataFrame, edges: DataFrame, changed: DataFrame, max_depth: int = 3, seed_cap: int = SEED_CAP, row_cap: int = ROW_CAP) -> DataFrame:
    """One row: seeds, impacted (distinct symbols), components, deepest and truncation_reason of a change (id).

    More seeds than the cap, or more distinct symbols, are a limit of work: what was not counted is unknown and null.
    """
    spark = symbols.sparkSession
    schema = "seeds long, impacted long, components long, deepest int, truncation_reason string"
    seeds = changed.select("id").distinct()
    n = seeds.limit(seed_cap + 1).count()
    if n > seed_cap:
        return spark.createDataFrame([(None, None, None, None, "seed_work_limit")], schema)
    found = reach.others_of_all(reach.steps_of(symbols, edges, graph.IMPACT_KINDS), seeds, max_depth)
    nearest = found.join(seeds, "id", "left_anti")
    nearest = cut(nearest.limit(row_cap + 1), "nearest")
    if nearest.count() > row_cap:
        return spark.createDataFrame([(n, None, None, None, "graph_work_limit")], schema)
    rows = nearest.join(symbols.select("id", "file_path"), "id")
    out = rows.agg(F.lit(n).cast("long").alias("seeds"), F.count("*").alias("impacted"), F.count_distinct(paths.component(F.col("file_path"))).alias("components"), F.max("depth").alias("deepest"))
    return out.withColumn("truncation_reason", F.lit(None).cast("string"))


def crossings(reached: reach.Reach, symbols: DataFrame) -> DataFrame:
    """(from_component, to_component, symbols): impact that leaves the component of its seed."""
    part = paths.component(F.col("file_path"))
    return reach.crossings(reached, symbols.select(F.col("id").alias("seed"), part.alias("from_component")), symbols.select("id", part.alias("to_component")))


def crossings_of(steps: reach.Named, symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """The same from the changed symbols (id) themselves: a component's seeds travel together."""
    part = symbols.select("id", paths.component(F.col("file_path")).alias("part"))
    found = reach.others(steps, part.join(changed, "id", "left_semi").withColumnRenamed("part", "label"))
    rows = found.join(part, "id").where("part <> label")
    return rows.groupBy(F.col("label").alias("from_component"), F.col("part").alias("to_component")).agg(F.count("*").alias("symbols"))


def ranked_tests(steps: reach.Named, symbols: DataFrame, is_test: Column, seeds: DataFrame) -> DataFrame:
    """Tests by how a change reaches them: direct at depth 0 or 1, transitive beyond, heuristic in a changed component.

    What is reached and is itself one of the changed ``seeds`` (id) has depth 0, though nothing may be reached from it.
    """
    tests = symbols.where(is_test)
    depth = reach.others_of_all(steps, seeds)
    # anything is reached from a seed if another symbol refers to it
    changed = reach.others_of_all(steps.reversed(), symbols.select("id"), 1).join(seeds, "id", "left_semi").select("id")
    parts = symbols.join(changed, "id", "left_semi").select(paths.component(F.col("file_path")).alias("part")).distinct()
    own = seeds.select("id").join(depth, "id", "left_semi").unionByName(changed)
    depth = depth.unionByName(own.withColumn("depth", F.lit(0))).groupBy("id").agg(F.min("depth").alias("depth"))
    rows = tests.join(depth, "id", "left").join(small(parts), paths.component(F.col("file_path")) == F.col("part"), "left")
    rank = F.when(F.col("depth") <= 1, "direct").when(F.col("depth").isNotNull(), "transitive").when(F.col("part").isNotNull(), "heuristic")
    return rows.withColumn("class", rank).where("class is not null").select("id", "name", "file_path", "class", "depth")


def fingerprints(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_path, fingerprint): FNV-1a of a file's language, its symbols and their edges, each in sorted lines.

    An edge counts with the path, type and kind that it is bound to, as far as ``edges`` has them (to_path, to_type,
    target_kind), so a change of what a name means is one of structure.
    """
    bounded_batches(symbols.sparkSession)
    line = lambda tag, *columns: F.concat_ws("|", F.lit(tag), *(F.coalesce(c, F.lit("")) for c in columns)).alias("line")
    s = symbols.select("file_path", F.lit(1).alias("part"), line("S", "kind", "name", "signature"))
    e = edges.join(symbols.select(F.col("id").alias("from_id"), "file_path", F.col("name").alias("from_name")), "from_id")
    bound = [F.col(c) if c in edges.columns else F.lit("") for c in ("to_path", "to_type", "target_kind")]
    e = e.select("file_path", F.lit(2).alias("part"), line("E", "kind", "from_name", "to_name", *bound))
    head = symbols.select("file_path", F.lit(0).alias("part"), line("L", "language")).distinct()
    rows = head.unionByName(s).unionByName(e).groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("part", "line"))).alias("lines"))
    return rows.select("file_path", fnv1a_hex(F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("fingerprint"))


def change_class(stored: DataFrame, current: DataFrame, changed: DataFrame) -> DataFrame:
    """For changed files: first-seen, cosmetic (structure as stored) or structural."""
    was = stored.select("file_path", F.col("fingerprint").alias("was"))
    kind = F.when(F.col("was").isNull(), "first-seen").when(F.col("was") == F.col("fingerprint"), "cosmetic").otherwise("structural")
    return current.join(changed, "file_path", "left_semi").join(was, "file_path", "left").select("file_path", kind.alias("class"))


# Path patterns of the disciplines; a file may belong to several.
DISCIPLINES = {"frontend": r"\.(ts|tsx|js|vue|css|html)$", "migration": r"(^|/)migrations?/|\.sql$", "qa": r"(^|/)(tests?|qa)/|(^|/)test_"}


def disciplines(files: DataFrame, sample: int = 20) -> DataFrame:
    """(discipline, files, sample): files by discipline, and the unclassified rest."""
    tags = F.filter(F.array(*(F.when(F.col("file_path").rlike(p), n) for n, p in DISCIPLINES.items())), lambda t: t.isNotNull())
    rows = files.select("file_path", F.explode(F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("unclassified")))).alias("discipline"))
    return rows.groupBy("discipline").agg(F.count("*").alias("files"), F.array_join(F.slice(F.array_sort(F.collect_list("file_path")), 1, sample), ",").alias("sample"))


# Names of entry files and their priority.
ENTRY_POINTS = {1: "main.rs main.go main.py __main__.py", 2: "Program.cs Main.java index.php", 3: "app.py index.ts index.tsx index.js index.jsx", 4: "lib.rs mod.rs"}


def entry_points(files: DataFrame) -> DataFrame:
    """(file_path, priority) of files whose name is that of an entry file, letter case included."""
    table = [(name, priority) for priority, names in ENTRY_POINTS.items() for name in names.split()]
    known = F.broadcast(files.sparkSession.createDataFrame(table, "name string, priority int"))
    return files.select("file_path", paths.basename(F.col("file_path")).alias("name")).join(known, "name").select("file_path", "priority")


def cycle_delta(base: DataFrame, head: DataFrame) -> DataFrame:
    """(change, members): cycles (members array) that went, came or changed; exactly equal ones are left out.

    A base cycle and a head cycle with a member in common are one cycle that changed.
    """
    # a cycle may have very many members, so only a digest of them travels with each of them
    side = lambda df, name: cut(df.select(F.array_sort("members").alias("m")).withColumn("k", F.sha2(F.to_json("m"), 256)).dropDuplicates(["k"]), name)
    b, h = side(base, "base-cycles"), side(head, "head-cycles")
    only_b, only_h = b.join(h.select("k"), "k", "left_anti"), h.join(b.select("k"), "k", "left_anti")
    e_b = only_b.select("k", F.explode("m").alias("x"))
    e_h = only_h.select(F.col("k").alias("k2"), F.explode("m").alias("x"))
    linked = cut(e_b.join(e_h, "x").select("k", "k2").distinct(), "linked-cycles")
    moved = linked.select(F.col("k2").alias("k")).distinct()
    told = lambda df, how: df.select(F.lit(how).alias("change"), F.array_join("m", ",").alias("members"))
    gone, new = only_b.join(linked.select("k").distinct(), "k", "left_anti"), only_h.join(moved, "k", "left_anti")
    return told(gone, "removed").unionByName(told(new, "added")).unionByName(told(only_h.join(moved, "k", "left_semi"), "changed"))


def rank_delta(base: DataFrame, head: DataFrame, top: int = 50) -> DataFrame:
    """(name, file_path, change, delta) of hotspots that entered, left or moved between two rankings."""
    # windows over the first rows alone
    rank = lambda df, tag: df.withColumn("rank", F.row_number().over(Window.orderBy(F.col("in_degree").desc(), "file_path", "line_start", "name", "id"))).where(F.col("rank") <= top).select("id", F.col("rank").alias(f"{tag}_rank"), F.col("in_degree").alias(f"{tag}_degree"))
    first = lambda df: df.orderBy(F.col("in_degree").desc(), "file_path", "line_start", "name", "id").limit(top)
    rows = rank(first(base), "b").join(rank(first(head), "h"), "id", "full_outer")
    change = F.when(F.col("b_rank").isNull(), "entered").when(F.col("h_rank").isNull(), "exited").when(F.col("b_rank") != F.col("h_rank"), "moved")
    return rows.select("id", change.alias("change"), "b_rank", "h_rank", (F.coalesce("h_degree", F.lit(0)) - F.coalesce("b_degree", F.lit(0))).alias("delta")).where("change is not null")


def rewound(head: DataFrame, changed: DataFrame, baseline: DataFrame, key: str = "file_path") -> DataFrame:
    """The base side rebuilt: head without the changed files, and their baseline rows."""
    return head.join(changed, key, "left_anti").unionByName(baseline.join(changed, key, "left_semi"))


def fitting(items: DataFrame, budget: int, *order: Column | str) -> DataFrame:
    """The longest prefix by ``order`` whose texts, at four bytes a token rounded up, fit the budget."""
    w = Window.partitionBy("packet").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("bytes_so_far", F.sum(F.octet_length("text")).over(w)).where(F.ceil(F.col("bytes_so_far") / 4) <= budget)
