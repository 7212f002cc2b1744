"""Traversal and graph measures as joins over edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import paths
from strataloom.operators import components, product, reach
from strataloom.operators.bounds import small
from strataloom.operators.store import cut
from strataloom.plans.bind import compatible, resolved

#: Rows of an impact page, and pairs of an import graph, beyond which totals are unknown.
IMPACT_CAP, PAIR_CAP, MEMBER_BUDGET = 5_000, 50_000, 500
DAMPING, ROUNDS = 0.85, 24
# Kinds of edges by which an impact spreads.
IMPACT_KINDS = ("calls", "references")


def impact(symbols: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = 3, kinds: tuple[str, ...] = ("calls", "references")) -> DataFrame:
    """(seed, id, depth): symbols from which edges of ``kinds`` lead to a seed (seed, id), with the least depth.

    Breadth first over sets of seeds; a seed that has reached a symbol does not visit it again, so cycles end.
    """
    return reach.pairs(impact_sets(symbols, edges, seeds, max_depth, kinds))


def impact_sets(symbols: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = 3, kinds: tuple[str, ...] = ("calls", "references")) -> reach.Reach:
    """The same with the seeds of a symbol as bits, for callers that count."""
    return reach.reach(reach.steps_of(symbols, edges, kinds), seeds, max_depth)


def impact_of_all(symbols: DataFrame, edges: DataFrame, max_depth: int = 3, kinds: tuple[str, ...] = IMPACT_KINDS) -> DataFrame:
    """``impact`` with every symbol as a seed, by classes of symbols alike."""
    return reach.kin_pairs(reach.kin(reach.steps_of(symbols, edges, kinds), max_depth))


def import_pairs(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(from_file, to_file): files that import a name which another file defines."""
    return file_pairs(imports_of(symbols, edges))


def file_pairs(imports: Imports, unless: DataFrame | None = None) -> DataFrame:
    """``import_pairs`` of imports, without files that share a mark of ``unless`` (item, mark)."""
    gives = imports.gives.withColumnRenamed("file", "to_file")
    return product.pairs(imports.uses.withColumnRenamed("file", "from_file"), gives, "name", "from_file", "to_file", unless=unless)


@dataclass
class Imports:
    """Imports through names: ``uses`` (file, name) and ``gives`` (name, file), whose join is ``import_pairs``.

    A cycle of files is one of files and names, so cycles are found without the pairs.
    """

    uses: DataFrame
    gives: DataFrame

    def inside(self, files: DataFrame) -> Imports:
        """Imports between ``files`` (file) alone."""
        return self.between(files, files)

    def between(self, sources: DataFrame, targets: DataFrame) -> Imports:
        """Imports from files among ``sources`` (file) of ones among ``targets`` (file)."""
        return Imports(self.uses.join(sources, "file", "left_semi"), self.gives.join(targets, "file", "left_semi"))

    def where(self, source: Column, target: Column) -> Imports:
        """Imports from files (file) of which one condition holds of ones of which the other does."""
        return Imports(self.uses.where(source), self.gives.where(target))

    def links(self) -> DataFrame:
        """(from_file, to_file) between files and names; a name bears a mark of its own."""
        file, name = F.concat(F.lit(FILE), "file"), F.concat(F.lit(NAME), "name")
        used, given = self.uses.select("name").distinct(), self.gives.select("name").distinct()
        uses = self.uses.join(given, "name", "left_semi").select(file.alias("from_file"), name.alias("to_file"))
        return uses.unionByName(self.gives.join(used, "name", "left_semi").select(name.alias("from_file"), file.alias("to_file")))


# Marks of the two sorts of node.
FILE, NAME = "f", "n"


def imports_of(symbols: DataFrame, edges: DataFrame, inside_folders: bool = False) -> Imports:
    """The imports of ``edges``; with ``inside_folders`` those between files of one folder, where a name counts for each folder."""
    name = lambda n: F.concat(paths.parent(F.col("file")), F.lit("\0"), n) if inside_folders else F.col(n)
    own = symbols.select(F.col("id").alias("from_id"), F.col("file_path").alias("file"))
    uses = edges.where("kind = 'imports'").join(own, "from_id").select("file", name("to_name").alias("name")).distinct()
    gives = symbols.select(F.col("name").alias("own"), F.col("file_path").alias("file")).select(name("own").alias("name"), "file").distinct()
    return Imports(cut(uses, "imports-uses"), cut(gives, "imports-gives"))


def importers(imports: Imports) -> DataFrame:
    """(file): files that import another one."""
    return _with_another(imports.uses, imports.gives)


def imported(imports: Imports) -> DataFrame:
    """(file): files that another one imports."""
    return _with_another(imports.gives, imports.uses)


def _with_another(rows: DataFrame, others: DataFrame) -> DataFrame:
    ends = others.groupBy("name").agg(F.min("file").alias("least"), F.max("file").alias("most"))
    return rows.join(ends, "name").where("least <> file or most <> file").select("file").distinct()


@dataclass
class Alike:
    """Imports by classes of files: ``users`` (file, user) that use the same names, ``givers`` (file, giver) that define the same
    ones, and the ``uses`` (user, name) and ``gives`` (giver, name) of classes."""

    imports: Imports
    users: DataFrame
    givers: DataFrame
    uses: DataFrame
    gives: DataFrame

    @property
    def links(self) -> DataFrame:
        """(user, giver): classes of which one imports the other."""
        return product.pairs(self.uses, self.gives, "name", "user", "giver", apart=False)


def alike_files(imports: Imports) -> Alike:
    users, givers = reach.alike(imports.uses, "file", "name"), reach.alike(imports.gives, "file", "name")
    uses = imports.uses.join(users.select(F.col("like").alias("file")).distinct(), "file", "left_semi").withColumnRenamed("file", "user")
    gives = imports.gives.join(givers.select(F.col("like").alias("file")).distinct(), "file", "left_semi").withColumnRenamed("file", "giver")
    return Alike(imports, users.withColumnRenamed("like", "user"), givers.withColumnRenamed("like", "giver"), uses, gives)


def pairs_of(alike: Alike) -> DataFrame:
    """(from_file, to_file) of two files, each once."""
    return file_pairs(alike.imports)


def _parts(alike: Alike, extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(file, user, giver, ...) and (part, user, giver, ..., size): classes of files alike on both sides and in ``extra`` (file, ...)."""
    files = alike.users.join(alike.givers, "file", "full_outer")
    files = files if extra is None else files.join(extra, "file", "full_outer")
    files = cut(files, "imports-files")
    keys = [c for c in files.columns if c != "file"]
    return files, cut(files.groupBy(*keys).agg(F.count("*").alias("size")).withColumn("part", F.monotonically_increasing_id()), "imports-parts")


def _part_links(alike: Alike, parts: DataFrame) -> product.Links:
    """Imports between classes of files."""
    return product.links(parts, "part", parts.join(alike.uses, "user"), parts.join(alike.gives, "giver"), "name")


def mutual_files(alike: Alike) -> DataFrame:
    """(file_path): files that import one that imports them."""
    files, parts = _parts(alike)
    found = parts.join(_part_links(alike, parts).mutual(), "part", "left_semi")
    # a mutual part has both sides, so neither key is null
    return files.join(found.select("user", "giver"), ["user", "giver"], "left_semi").select(F.col("file").alias("file_path"))


def file_ranks(alike: Alike, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``personal_pagerank`` of the pairs of files: files alike on both sides and as seeds (node) have one score."""
    files, parts = _parts(alike, seeds.select(F.col("node").alias("file"), F.lit(1.0).alias("jump")).distinct())
    links = _part_links(alike, parts)
    matrix = links.matrix()
    onward = lambda sent: links.onward(matrix, sent.withColumnRenamed("a", "part")).withColumnRenamed("part", "node")
    degree = onward(parts.select(F.col("part").alias("a"), F.lit(1.0).alias("share"))).select("node", F.round("got").cast("long").alias("degree")).where("degree > 0")
    # a round reads the whole matrix, so each is written
    rank = _walk(cut(degree, "pagerank-degrees"), onward, parts.select(F.col("part").alias("node"), "size", "jump").where("jump is not null"), damping, rounds, 1).withColumnRenamed("node", "part")
    of = parts.join(rank, "part")
    same = F.lit(True)
    for c in ("user", "giver", "jump"):
        same = same & files[c].eqNullSafe(of[c])
    return files.join(of, same).select(files["file"].alias("node"), of["score"])


def pairs_up_to(imports: Imports, cap: int) -> int:
    """How many pairs of two files the imports make; of more than ``cap`` only that they are more.

    A file makes at least as many as its most common name has other files. Only where all these together stay within the
    cap are the pairs made, and then each name brings few.
    """
    sizes = imports.gives.groupBy("name").agg(F.count("*").alias("n"))
    least = imports.uses.join(sizes, "name").groupBy("file").agg((F.max("n") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    if least > cap:
        return least
    pairs = imports.uses.withColumnRenamed("file", "from_file").join(imports.gives, "name").where("from_file <> file")
    return pairs.select("from_file", "file").distinct().limit(cap + 1).count()


def strong_components(pairs: dict[str, set[str]]) -> list[list[str]]:
    """Sets of two nodes or more that all reach each other, members sorted; Tarjan's algorithm without recursion."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    on: set[str] = set()
    out: list[list[str]] = []
    for start in sorted(pairs):
        if start in index:
            continue
        work: list[tuple[str, Iterator[str]]] = []

        def enter(v: str) -> None:
            index[v] = low[v] = len(index)
            stack.append(v)
            on.add(v)
            work.append((v, iter(sorted(pairs.get(v, ())))))

        enter(start)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in index:
                    enter(w)
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        part.append(w)
                        if w == v:
                            break
                    if len(part) > 1:
                        out.append(sorted(part))
    return out


def cycles(pairs: DataFrame, cap: int = PAIR_CAP) -> DataFrame:
    """(size, members): cycles of the import graph. Beyond ``cap`` pairs one row with nulls says so.

    One task's work, so bounded; ``cycle_nodes`` and ``all_cycles`` have no cap.
    """
    spark = pairs.sparkSession
    schema = "size long, members array<string>, truncation_reason string"
    if pairs.limit(cap + 1).count() > cap:
        return spark.createDataFrame([(None, None, "graph_work_limit")], schema)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        graph: dict[str, set[str]] = {}
        for a, b in zip(rows["from_file"], rows["to_file"]):
            graph.setdefault(a, set()).add(b)
        found = strong_components(graph)
        return pd.DataFrame({"size": pd.Series([len(m) for m in found], dtype="int64"), "members": pd.Series(found, dtype=object), "truncation_reason": pd.Series([None] * len(found), dtype=object)})

    return pairs.groupBy(F.lit(1).alias("one")).applyInPandas(run, schema)


def cycle_nodes(pairs: DataFrame | Imports) -> DataFrame:
    """(root, node): nodes that lie on a cycle of two or more, root being the smallest node that each other reach."""
    if not isinstance(pairs, Imports):
        return components.strong_nodes(pairs)
    # a file that imports its own name is a cycle of one file and a name
    files = components.strong_nodes(pairs.links()).where(F.col("node").startswith(FILE)).select("root", F.substring("node", 2, 1 << 30).alias("node"))
    files = cut(files, "cycle-files")
    roots = files.groupBy("root").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    return files.join(roots, "root").select(F.col("least").alias("root"), "node")


def all_cycles(pairs: DataFrame | Imports) -> DataFrame:
    """(size, members): the cycles of a graph of any size; a row holds the members of its cycle."""
    rows = cycle_nodes(pairs).groupBy("root").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("node")).alias("members"))
    return rows.select("size", "members")


def within_budget(found: DataFrame, budget: int = MEMBER_BUDGET) -> DataFrame:
    """The largest cycles whole, up to ``budget`` members; it stops at the first that does not fit."""
    w = Window.orderBy(F.col("size").desc(), "members").rowsBetween(Window.unboundedPreceding, 0)
    # a cycle has two members or more, so no more cycles than half the budget can fit
    first = found.orderBy(F.col("size").desc(), "members").limit(budget // 2 + 1)
    return first.withColumn("so_far", F.sum("size").over(w)).where(F.col("so_far") <= budget).drop("so_far")


def cycles_answer(pairs: DataFrame | Imports, top: int | None = None, budget: int = MEMBER_BUDGET, cap: int | None = PAIR_CAP) -> DataFrame:
    """A page of whole cycles, the largest first: size, members, total, total_members, truncated, truncation_reason.

    It stops at ``top`` cycles or before the first that would pass ``budget`` members. Above ``cap`` pairs no cycle is
    looked for: one row without members has null totals and says so. Without cycles there is no row. ``Imports`` have no
    cap, nor have pairs if it is None.
    """
    schema = "size long, members array<string>, total long, total_members long, truncated boolean, truncation_reason string"
    if cap is not None and not isinstance(pairs, Imports) and pairs.limit(cap + 1).count() > cap:
        return pairs.sparkSession.createDataFrame([(None, None, None, None, True, "graph_work_limit")], schema)
    nodes = cut(cycle_nodes(pairs), "cycle-nodes")
    sizes = nodes.groupBy("root").agg(F.count("*").alias("size"))
    total, members = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).collect()[0]
    top = total if top is None else top
    w = Window.orderBy(F.col("size").desc(), "root")  # no more cycles than half the budget
    first = sizes.orderBy(F.col("size").desc(), "root").limit(min(top, budget // 2 + 1)).withColumn("so_far", F.sum("size").over(w))
    chosen = first.where(F.col("so_far") <= budget)
    n = chosen.count()
    reason = None if n == total else "top" if n == top else "member_limit"
    rows = nodes.join(F.broadcast(chosen.select("root", "size")), "root").groupBy("root", "size").agg(F.array_sort(F.collect_list("node")).alias("members"))
    return rows.select("size", "members", F.lit(total).alias("total"), F.lit(members).cast("long").alias("total_members"), F.lit(n < total).alias("truncated"), F.lit(reason).cast("string").alias("truncation_reason"))


def skipping_budget(found: DataFrame, budget: int = MEMBER_BUDGET, top: int = 50) -> list[tuple[int, list[str]]]:
    """The map's rule: a cycle that does not fit is skipped and later ones may still be taken."""
    out, left = [], budget
    for r in found.orderBy(F.col("size").desc(), "members").limit(top).collect():
        if r["size"] <= left:
            out.append((r["size"], r["members"]))
            left -= r["size"]
    return out


def in_degrees(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols with the number of distinct callers, those with none left out."""
    users = _users(edges.where("kind = 'calls'"))
    return _with_users(symbols.where("name <> '<module>'"), users).select("id", "name", "kind", "file_path", "line_start", "in_degree")


def _users(edges: DataFrame) -> DataFrame:
    """(name, method, in_degree): distinct sources of edges for each name and each sort of definition that an edge may mean (a method,
    another kind, an unknown one), before they meet the definitions: a common name costs its sources plus its definitions."""
    kinds = ((reach.METHOD, F.lit("method")), (reach.OTHER, F.lit("function")), (reach.ANY, F.lit(None).cast("string")))
    means = F.array_compact(F.array(*(F.when(compatible(F.col("target_kind"), kind), sort) for sort, kind in kinds)))
    calls = edges.select("from_id", "to_name", F.explode(means).alias("method"))
    return calls.groupBy(F.col("to_name").alias("name"), "method").agg(F.count_distinct("from_id").alias("in_degree"))


def _with_users(symbols: DataFrame, users: DataFrame) -> DataFrame:
    method = F.when(F.col("kind") == "method", reach.METHOD).when(F.col("kind").isNotNull(), reach.OTHER).otherwise(reach.ANY)
    return symbols.withColumn("method", method).join(users, ["name", "method"])


def boundary_counts(symbols: DataFrame, edges: DataFrame, part: Column) -> DataFrame:
    """(a, b, observations): edges with each of their meanings from one part to another, as of ``bind.resolved``.

    Both sides are counted for each name first, so a common name costs its references plus its definitions.
    """
    own = symbols.select(F.col("id").alias("from_id"), part.alias("a"))
    sent = edges.join(own, "from_id").groupBy("to_name", "target_kind", "a").agg(F.count("*").alias("sent"))
    met = symbols.groupBy(F.col("name").alias("to_name"), "kind", part.alias("b")).agg(F.count("*").alias("met"))
    rows = sent.join(met, "to_name").where(compatible(F.col("target_kind"), F.col("kind"))).where("a <> b")
    return rows.groupBy("a", "b").agg(F.sum(F.col("sent") * F.col("met")).alias("observations"))


def file_in_degrees(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_path, in_degree): distinct callers of anything in a file."""
    steps = reach.steps_of(symbols, edges, ("calls",))
    gives = steps.defs.join(symbols.select(F.col("id").alias("to_id"), "file_path"), "to_id").select("file_path", "to_name", "means").distinct()
    return product.counts(cut(gives, "file-names"), steps.refs, ["to_name", "means"], "file_path", "from_id", "in_degree")


def unreferenced(symbols: DataFrame, edges: DataFrame, kind: str | None = None) -> DataFrame:
    """Symbols that no edge may mean; entry points by name or decorator, and constants unless asked for, are left out."""
    targets = edges.select("to_name", "target_kind").distinct()
    s = symbols.where(F.col("kind") == kind) if kind else symbols.where("kind <> 'constant'")
    s = s.where("name <> 'main' and not name like 'test\\\\_%'").where(~F.coalesce(F.col("decorators").contains(",route,"), F.lit(False)))
    t = targets.select("to_name", "target_kind")
    return s.join(t, (s["name"] == t["to_name"]) & compatible(t["target_kind"], s["kind"]), "left_anti")


def api_surface(symbols: DataFrame, edges: DataFrame, prefix: str) -> DataFrame:
    """Symbols under a prefix that something outside it may reference, with the number of such symbols."""
    inside = symbols.where(F.col("file_path").startswith(prefix))
    outside = symbols.where(~F.col("file_path").startswith(prefix)).select(F.col("id").alias("from_id"))
    users = _users(edges.join(outside, "from_id", "left_semi")).withColumnRenamed("in_degree", "users")
    return _with_users(inside, users).select("id", "name", "file_path", "line_start", "users")


def personal_pagerank(pairs: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(node, score) by power iteration on the undirected graph of ``pairs`` (a, b); seeds (node) get the jumps.

    Mass of nodes without neighbours goes back to the seeds. A fixed number of rounds; written every six. Seeds may bring
    their weight (a share of the jumps) in a column ``weight``. Without seeds, or without a pair of two nodes, there is
    nothing to walk on, and the seeds' own shares are the answer.
    """
    links = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "pagerank-links")
    weight = F.col("weight").cast("double") if "weight" in seeds.columns else F.lit(1.0)
    jump = seeds.select("node", weight.alias("jump")).groupBy("node").agg(F.sum("jump").alias("jump"))
    degree = links.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("degree"))
    onward = lambda sent: sent.join(links, "a").groupBy(F.col("b").alias("node")).agg(F.sum("share").alias("got"))
    return _walk(degree, onward, jump.withColumn("size", F.lit(1)), damping, rounds)


def _walk(degree: DataFrame, onward: Callable[[DataFrame], DataFrame], jump: DataFrame, damping: float, rounds: int, often: int = 6) -> DataFrame:
    """(node, score): ``personal_pagerank`` where a node may stand for many alike: each of a node's has ``degree`` (node, degree)
    neighbours, ``onward`` gives what each gets (node, got) of what each of its neighbours sends (a, share), and jumps
    (node, size, jump) are for each of a node's. Written every ``often`` rounds."""
    jump = cut(jump, "pagerank-seeds")
    whole = jump.agg(F.coalesce(F.sum(F.col("size") * F.col("jump")), F.lit(0.0))).collect()[0][0]
    if whole <= 0 or degree.isEmpty():
        return jump.select("node", (F.col("jump") / (whole or 1.0)).alias("score"))
    jump = jump.select("node", "size", (F.col("jump") / whole).alias("jump"))
    nodes = cut(degree.join(jump, "node", "full_outer").select("node", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("jump", F.lit(0.0)).alias("jump"), F.coalesce("size", F.lit(1)).alias("size")), "pagerank-nodes")
    rank = nodes.select("node", F.col("jump").alias("score"))
    for k in range(rounds):
        held = rank.join(nodes, "node")
        sent = onward(held.where("degree > 0").select(F.col("node").alias("a"), (F.col("score") / F.col("degree")).alias("share")))
        # only seeds can be without neighbours, and their size is known
        lost = held.agg(F.coalesce(F.sum(F.when(F.col("degree") == 0, F.col("score") * F.col("size"))), F.lit(0.0)).alias("lost"))
        mass = nodes.join(sent, "node", "left").join(F.broadcast(lost))
        rank = mass.select("node", ((1 - damping) * F.col("jump") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("jump"))).alias("score"))
        if k % often == often - 1:
            rank = cut(rank, "pagerank")
    return rank


def keyword_scores(terms: DataFrame, weights: DataFrame) -> DataFrame:
    """(symbol, score): for asked terms (term, weight) weight times squared hits; rare terms weigh 1024 div (1 + files)."""
    df = terms.groupBy("term").agg(F.count_distinct("file_path").alias("n_files"))
    hits = terms.join(small(weights), "term").groupBy("id", "file_path", "term", "weight").agg(F.sum("tf").alias("hits")).join(df, "term")
    rarity = F.expr("1024 div (1 + n_files)")
    return hits.withColumn("part", F.col("weight") * rarity * F.col("hits") * F.col("hits")).groupBy("id", "file_path").agg(F.sum("part").alias("score"))


def chosen_symbols(scores: DataFrame, files: int = 3) -> DataFrame:
    """Per file what scores at least a third of its best; of files those with half of the best file's, three at most."""
    best = F.max("score").over(Window.partitionBy("file_path"))
    rows = scores.withColumn("best", best).where(F.col("score") * 3 >= F.col("best"))
    per_file = rows.select("file_path", "best").distinct()
    top = per_file.agg(F.max("best")).collect()[0][0] or 0
    kept = per_file.where(F.col("best") * 2 >= top).orderBy(F.col("best").desc(), "file_path").limit(files)
    return rows.join(F.broadcast(kept.select("file_path")), "file_path", "left_semi").drop("best")
