"""The rules of a policy file held against a change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators import graph, rollup
from strataloom.operators.store import cut
from strataloom.sources.policies import Rule


def evaluate(rules: list[Rule], imports: graph.Imports, base_imports: graph.Imports, surface: DataFrame, reached: Callable[[DataFrame], DataFrame], symbols: DataFrame, changed: DataFrame, tested: DataFrame, owned: DataFrame, held: DataFrame, cap: int = rollup.RESULT_CAP) -> DataFrame:
    """One bounded report. ``imports`` and ``base_imports`` the imports of both sides, ``surface``
    symbols that others use, ``reached`` gives what the changed ones among some symbols (id) reach, ``changed``, ``tested`` and ``held`` paths, ``owned`` (path, owners)."""
    found, open_ = [], []
    for rule in rules:
        hit = lambda column, field, rule=rule: F.col(column).rlike(rule.pattern(field))
        if rule.action == "deny_imports":
            inside = imports.where(hit("file", "from"), hit("file", "deny_imports"))
            inside = graph.Imports(inside.uses.join(changed.select(F.col("path").alias("file")), "file", "left_semi"), inside.gives)
            rows = graph.file_pairs(inside).select(F.concat_ws(" -> ", "from_file", "to_file").alias("subject"))
        elif rule.action == "max_new_cycles":
            mine = new_cycles(imports, base_imports, changed).where(hit("node", "scope")).select("root").distinct()
            fresh = mine.agg(F.count("*").alias("n"))
            rows = fresh.where(F.col("n") > rule.fields["max_new_cycles"]).select(F.concat(F.col("n").cast("string"), F.lit(" new cycles")).alias("subject"))
        elif rule.action == "require_owner":
            mine = owned.where(F.array_contains(F.split("owners", ","), str(rule.fields["require_owner"]))).select(F.col("path").alias("file_path"))
            rows = surface.where(hit("file_path", "scope")).join(mine, "file_path", "left_anti").select(F.concat_ws(" -> ", "file_path", "name").alias("subject"))
        elif rule.action == "max_blast_radius":
            seeds = symbols.where(hit("file_path", "scope")).select(F.col("id").alias("seed"))
            n = reached(seeds.select(F.col("seed").alias("id"))).join(symbols, "id").agg(F.count_distinct("file_path", "line_start", "name").alias("n"))
            rows = n.where(F.col("n") > rule.fields["max_blast_radius"]).select(F.concat(F.col("n").cast("string"), F.lit(" impacted")).alias("subject"))
        elif rule.action == "require_tests":
            rows = changed.where(hit("path", "scope")).join(tested, "path", "left_anti").select(F.col("path").alias("subject"))
        elif rule.action == "deny_ownership_crossings":
            inside = imports.where(hit("file", "scope"), F.lit(True))
            rows = rollup.boundary_rule(inside, owned).select("subject")
            open_.append(rollup.unowned_sides(inside, owned).withColumn("rule", F.lit(rule.id)))
        else:
            rows = changed.where(hit("path", "critical")).join(held, "path", "left_anti").select(F.col("path").alias("subject"))
        found.append(rows.select(F.lit(rule.id).alias("rule"), "subject"))
    return rollup.report(found, open_, cap)


def new_cycles(pairs: DataFrame | graph.Imports, base_pairs: DataFrame | graph.Imports, changed: DataFrame) -> DataFrame:
    """(root, node): members of the cycles of ``pairs`` with a ``changed`` (path) file that are no cycle of the base.

    A cycle is known if the base, among the files of all such cycles, has one of exactly the same members.
    """
    now = cut(graph.cycle_nodes(pairs), "cycles-now")
    touched = now.join(changed.select(F.col("path").alias("node")).distinct(), "node", "left_semi").select("root").distinct()
    now = cut(now.join(touched, "root", "left_semi"), "cycles-touched")
    members = now.select("node")
    if isinstance(base_pairs, graph.Imports):
        inside = base_pairs.inside(members.withColumnRenamed("node", "file"))
    else:
        inside = base_pairs.join(members.withColumnRenamed("node", "from_file"), "from_file", "left_semi").join(members.withColumnRenamed("node", "to_file"), "to_file", "left_semi").select("from_file", "to_file")
    was = graph.cycle_nodes(inside)
    sizes = was.groupBy("root").agg(F.count("*").alias("base_size")).withColumnRenamed("root", "base_root")
    met = now.join(was.select("node", F.col("root").alias("base_root")), "node", "left").groupBy("root").agg(F.count("*").alias("size"), F.count("base_root").alias("n_met"), F.count_distinct("base_root").alias("n_roots"), F.min("base_root").alias("base_root"))
    known = met.join(sizes, "base_root").where("n_roots = 1 and n_met = size and base_size = size").select("root")
    return now.join(known, "root", "left_anti").select("root", "node")
