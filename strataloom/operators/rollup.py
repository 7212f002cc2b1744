"""Evidence roll-ups: coverage, tests, traces, churn, ownership, policy rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import paths
from strataloom.operators import graph, reach
from strataloom.operators.bounds import small
from strataloom.operators.store import cut

#: Rules of an owners file.
RULES = 50_000


def coverage(rows: DataFrame) -> DataFrame:
    """(path, lines, hit): a line counts once, with the most hits that any source saw."""
    per_line = rows.groupBy("path", "line").agg(F.max("hits").alias("hits"))
    return per_line.groupBy("path").agg(F.count("*").alias("lines"), F.count_if(F.col("hits") > 0).alias("hit"))


def tests(rows: DataFrame) -> DataFrame:
    """(path, passed, failed, skipped, seconds) of test cases."""
    count = lambda s: F.count_if(F.col("status") == s)
    return rows.groupBy("path").agg(count("passed").alias("passed"), count("failed").alias("failed"), count("skipped").alias("skipped"), F.sum("seconds").alias("seconds"))


def churn(touches: DataFrame, tasks: int | None = None) -> DataFrame:
    """(path, commits, authors, added): a commit counts once for a path.

    If ``tasks`` are given, paths are dealt to them, and the first row of a commit and of an author stands for it.
    """
    if tasks is not None:
        first = lambda c: F.row_number().over(Window.partitionBy("path", c).orderBy(c)) == 1
        rows = touches.repartition(tasks, "path").select("path", "sha", "author", "added").withColumn("a", first("sha")).withColumn("b", first("author"))
        return rows.groupBy("path").agg(F.count_if(F.col("a") & F.col("sha").isNotNull()).alias("commits"), F.count_if(F.col("b") & F.col("author").isNotNull()).alias("authors"), F.sum("added").alias("added"))
    return touches.groupBy("path").agg(F.count_distinct("sha").alias("commits"), F.count_distinct("author").alias("authors"), F.sum("added").alias("added"))


def contributors(touches: DataFrame, top: int = 5, tasks: int | None = None) -> DataFrame:
    """(path, names): the first authors of a path by commits, then name. Authors of paths are dealt to ``tasks``, if given."""
    touches = touches if tasks is None else touches.repartition(tasks, "path", "author")
    n = touches.groupBy("path", "author").agg(F.count_distinct("sha").alias("commits"))
    order = Window.partitionBy("path").orderBy(F.col("commits").desc(), "author")
    kept = n.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top)
    return kept.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "author"))), lambda x: x["author"].cast("string")), ",").alias("names"))


def bus_factor(touches: DataFrame, components: DataFrame) -> DataFrame:
    """(component, authors, touches, top_author, top_percent): who knows a component; without history 0 authors."""
    each = touches.select(paths.component_at(F.col("path"), 2).alias("component"), "author", "sha").distinct()
    n = each.groupBy("component", "author").agg(F.count("*").alias("n"))
    top = n.groupBy("component").agg(F.count("*").alias("authors"), F.sum("n").alias("touches"), F.max(F.struct("n", (-F.col("author")).alias("a"))).alias("top"))
    rows = components.join(top, "component", "left")
    return rows.select("component", F.coalesce("authors", F.lit(0)).alias("authors"), F.coalesce("touches", F.lit(0)).alias("touches"), (-F.col("top.a")).alias("top_author"), F.expr("top.n * 100 div touches").alias("top_percent"))


def hotspots(churned: DataFrame, degrees: DataFrame) -> DataFrame:
    """Files by commits times callers, both above nothing."""
    rows = churned.join(degrees.withColumnRenamed("file_path", "path"), "path").where("commits > 0 and in_degree > 0")
    return rows.select("path", "commits", "in_degree", (F.col("commits") * F.col("in_degree")).alias("score"))


def capped_findings(findings: DataFrame, per_file: int = 100, total: int = 5_000) -> DataFrame:
    """The first findings of each file, and of those the first of all, by place. Ranks stay within a file; the total
    is a top-k."""
    k = F.row_number().over(Window.partitionBy("path").orderBy("line", "rule"))
    return findings.withColumn("k", k).where(F.col("k") <= per_file).drop("k").orderBy("path", "line", "rule").limit(total)


def owners(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, owners, rule_no): the last rule whose pattern matches; an empty list of owners is an answer as well.

    ``rules`` (rule_no, pattern as a regular expression, owners) come of one file of bounded size.
    """
    hit = files.join(small(rules, RULES), F.regexp_like("path", F.col("pattern")), "left")
    return hit.groupBy("path").agg(F.max_by("owners", "rule_no").alias("owners"), F.max("rule_no").alias("rule_no"))


def owner_delta(base: DataFrame, head: DataFrame) -> DataFrame:
    b, h = base.select("path", F.col("owners").alias("was")), head.select(F.col("path").alias("p"), F.col("owners").alias("now"))
    return b.join(h, F.col("path") == F.col("p"), "full_outer").where("not (was <=> now)").select(F.coalesce("path", "p").alias("path"), "was", "now")


def mentions(docs: DataFrame, names: DataFrame, per_file: int = 20) -> DataFrame:
    """(name, doc_id, place): the first place at which a document mentions a name as a word, the first documents of each.

    Words join with names, so no document is compared with every name.
    """
    words = docs.select("doc_id", F.posexplode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("place", "name"))
    first = words.join(small(names), "name").groupBy("name", "doc_id").agg(F.min("place").alias("place"))
    return first.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("doc_id"))).where(F.col("k") <= per_file).drop("k")


def first_names(rows: DataFrame, key: list[str], name: str, top: int = 5) -> DataFrame:
    return rows.groupBy(*key).agg(F.array_join(F.slice(F.array_sort(F.collect_set(name)), 1, top), ",").alias("names"))


def per_group(rows: DataFrame, group: str, order: list[Column | str], each: int, total: int) -> DataFrame:
    """The first ``each`` rows of every group, ``total`` in all."""
    k = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("k", k).where(F.col("k") <= each).drop("k").orderBy(group, *order).limit(total)


def violations(rule: str, rows: DataFrame, *columns: str) -> DataFrame:
    """Rows that break a rule in one shape: rule and subject."""
    return rows.select(F.lit(rule).alias("rule"), F.concat_ws(" -> ", *columns).alias("subject"))


def dependency_rule(imports: graph.Imports, source: str, forbidden: str) -> DataFrame:
    """Imports from files that match one glob to files that match another."""
    bad = graph.file_pairs(imports.where(F.col("file").rlike(paths.glob_regex(source)), F.col("file").rlike(paths.glob_regex(forbidden))))
    return violations("dependency", bad, "from_file", "to_file")


def owner_rule(surface: DataFrame, owned: DataFrame) -> DataFrame:
    """Symbols that others use in files without an owner."""
    known = owned.where("owners is not null and owners <> ''").select(F.col("path").alias("file_path"))
    return violations("api_owner", surface.join(known, "file_path", "left_anti"), "file_path", "name")


def radius_rule(reached: reach.Kin, symbols: DataFrame, most: int) -> DataFrame:
    """Symbols that more than ``most`` places lead to."""
    n = reach.kin_sizes(reached, symbols.select("id", "file_path", "line_start", "name"), "file_path", "line_start", "name")
    return violations("blast_radius", n.where(F.col("n") > most).select(F.col("seed").cast("string").alias("s"), F.col("n").cast("string").alias("n")), "s", "n")


def boundary_rule(imports: graph.Imports, owned: DataFrame) -> DataFrame:
    """Imports between files whose owners have nobody in common; a side without owners is left to another rule."""
    o = cut(owned.where("owners <> ''").select(F.col("path").alias("file"), F.explode(F.split("owners", ",")).alias("mark")), "owned")
    known = o.select("file").distinct()
    return violations("ownership_boundary", graph.file_pairs(imports.between(known, known), o.withColumnRenamed("file", "item")), "from_file", "to_file")


def strict_rule(changed: DataFrame, critical: str, held: DataFrame) -> DataFrame:
    """Changed files (path) that match a critical glob and have no held evidence (path)."""
    bad = changed.where(F.col("path").rlike(paths.glob_regex(critical))).join(held.select("path").distinct(), "path", "left_anti")
    return violations("strict_workflow", bad, "path")


def unowned_sides(imports: graph.Imports, owned: DataFrame) -> DataFrame:
    """(rule, code, subject): imports whose boundary cannot be judged as a side has no owners."""
    known = owned.where("owners <> ''").select("path")
    sides = graph.importers(imports).union(graph.imported(imports)).distinct().withColumnRenamed("file", "path")
    return sides.join(known, "path", "left_anti").select(F.lit("ownership_boundary").alias("rule"), F.lit("owner_unknown").alias("code"), F.col("path").alias("subject"))


#: Violations and diagnostics of a report.
RESULT_CAP = 1_000


def report(found: list[DataFrame], diagnostics: list[DataFrame], cap: int = RESULT_CAP) -> DataFrame:
    """(rule, code, subject, complete, passed): one bounded report of all rules, in order.

    Only a report without diagnostics is complete, and only a complete one without violations passes; beyond the cap a
    diagnostic takes the last row's place.
    """
    rows = [f.select("rule", F.lit("violation").alias("code"), "subject") for f in found] + [d.select("rule", "code", "subject") for d in diagnostics]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    first = cut(every.orderBy("rule", "code", "subject").limit(cap + 1), "report")
    n = first.count()
    if n > cap:
        limit = every.sparkSession.createDataFrame([("~report", "policy_result_limit", f"{cap} results")], "rule string, code string, subject string")
        first = first.orderBy("rule", "code", "subject").limit(cap - 1).unionByName(limit)
    complete = F.lit(first.where("code <> 'violation'").isEmpty())
    return first.select("rule", "code", "subject", complete.alias("complete"), F.lit(n == 0).alias("passed"))


#: Files that evidence is asked for.
RELEVANT_CAP = 1_000


def relevant_paths(trace: DataFrame, changed: DataFrame, cap: int = RELEVANT_CAP) -> DataFrame:
    """(path, origin, truncated): files that a change reaches, then the changed ones, as many as the cap leaves room for."""
    t = trace.select("path").distinct()
    c = changed.select("path").distinct().join(t, "path", "left_anti")
    rows = t.withColumn("origin", F.lit("trace")).unionByName(c.withColumn("origin", F.lit("changed")))
    rank = F.when(F.col("origin") == "trace", 0).otherwise(1)
    first = rows.orderBy(rank, "path").limit(cap)
    return first.withColumn("truncated", F.lit(rows.limit(cap + 1).count() > cap))


def acceptance(criteria: DataFrame, receipts: DataFrame) -> DataFrame:
    """(criterion, checks, satisfied): all checks of a criterion are current; a missing receipt is not."""
    rows = criteria.join(receipts, "check_id", "left")
    return rows.groupBy("criterion").agg(F.count("*").alias("checks"), F.bool_and(F.coalesce(F.col("status") == "current", F.lit(False))).alias("satisfied"))
