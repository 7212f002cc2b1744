"""Lookups and projections over symbols, edges and files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.operators import intervals
from strataloom.operators.bounds import small
from strataloom.operators.store import cut
from strataloom.plans.bind import compatible

# Seconds of each unit.
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
#: Rows of a search's page, and raw rows that partial declarations are grouped from at most.
SEARCH_TOP, RAW_WORK_LIMIT = 100, 500
#: Deepest level of an outline.
MAX_DEPTH = 64


def parse_duration(text: str) -> int:
    """Seconds of a number with s, m, h or d behind; anything else, or more than a long holds, is an error."""
    m = re.fullmatch(r"(\d+)([smhd])", text.strip())
    if not m or int(m[1]) * UNITS[m[2]] >= 1 << 63:
        raise ValueError(f"not a duration: {text!r}")
    return int(m[1]) * UNITS[m[2]]


def search(symbols: DataFrame, name: str, kind: str | None = None, language: str | None = None) -> DataFrame:
    out = symbols.where(F.col("name") == name)
    out = out.where(F.col("kind") == kind) if kind else out
    return out.where(F.col("language") == language) if language else out


def search_grouped(symbols: DataFrame, name: str, top: int | None = SEARCH_TOP, raw_limit: int | None = RAW_WORK_LIMIT, namespaces: DataFrame | None = None) -> DataFrame:
    """A search whose partial declarations count as one, grouped from the first ``raw_limit`` raw rows by place.

    With ``namespaces`` (id, namespace, as of ``enclosing_names``) a namespace is part of what is one, and locations is the
    list of places; without, for sources that have none, the folder stands for it and locations is a count.

    Without a ``raw_limit`` all raw rows are grouped, and without a ``top`` all groups are the answer. Each row tells how many raw rows there are and were looked at. Where not all were, groups may be incomplete, so
    neither the total nor the number of a group's locations is known.
    """
    raw = search(symbols, name)
    total = raw.count()
    whole = raw_limit is None or total <= raw_limit
    some = raw if whole else raw.orderBy("file_path", "line_start", "id").limit(raw_limit)
    rows = by_folder(some) if namespaces is None else by_namespace(some, namespaces)
    groups = rows.count()
    reason = "raw_work_limit" if not whole else "top" if top is not None and groups > top else None
    first = rows if top is None else rows.orderBy("file_path", "line_start", "id").limit(top)
    first = first.withColumn("locations", F.when(F.lit(whole), F.col("locations")))
    extra = {"raw_candidate_total": total, "raw_candidates_examined": total if whole else raw_limit, "total": groups if whole else None, "returned": groups if top is None else min(groups, top)}
    return first.select("*", *(F.lit(v).cast("long").alias(k) for k, v in extra.items()), F.lit(reason is not None).alias("truncated"), F.lit(reason).cast("string").alias("truncation_reason"))


def search_batch(symbols: DataFrame, names: list[str]) -> DataFrame:
    """The definitions of one to eight distinct names, with each name's place in the request."""
    if not 1 <= len(names) <= 8 or len(set(names)) != len(names):
        raise ValueError("one to eight distinct names")
    asked = symbols.sparkSession.createDataFrame(list(enumerate(names)), "ordinal int, name string")
    return symbols.join(F.broadcast(asked), "name")


# Kinds that are part of the identity of what they hold.
NAMESPACES = ("namespace", "module")


def enclosing_names(symbols: DataFrame, kinds: tuple[str, ...] = NAMESPACES) -> DataFrame:
    """(id, namespace): the names of a symbol's ancestors of some kinds, the outermost first; no row without any.

    Pointers to ancestors double with each join, so a chain of any depth takes a logarithm of steps.
    """
    rows = symbols.select("id", "parent_id", F.when(F.col("kind").isin(*kinds), F.col("name")).alias("own"))
    parents = rows.select(F.col("id").alias("parent_id"), F.array_compact(F.array("own")).alias("names"), F.col("parent_id").alias("up"))
    at = cut(rows.select("id", "parent_id").join(parents, "parent_id").select("id", "names", "up"), "namespaces")
    while not at.where("up is not null").isEmpty():
        # what spans up to an ancestor goes on with what that ancestor's own pointer spans
        further = at.select(F.col("id").alias("up"), F.col("names").alias("more"), F.col("up").alias("on"))
        roots = parents.select(F.col("parent_id").alias("up"), F.col("names").alias("root_names"))
        met = at.join(roots, "up", "left").join(further, "up", "left")
        after = F.concat(F.coalesce("more", F.array().cast("array<string>")), F.coalesce("root_names", F.array().cast("array<string>")), "names")
        at = cut(met.select("id", F.when(F.col("up").isNull(), F.col("names")).otherwise(after).alias("names"), F.col("on").alias("up")), "namespaces")
    return at.where("size(names) > 0").select("id", F.array_join("names", ".").alias("namespace"))


def by_folder(symbols: DataFrame) -> DataFrame:
    """Partial declarations of one name, kind and folder as one row: its first place, and how many there are."""
    place = F.struct("file_path", "line_start", "id")
    partial = F.coalesce(F.col("decorators").contains(",partial,"), F.lit(False))
    folder = F.regexp_replace("file_path", r"/[^/]*$", "")
    merged = symbols.where(partial).groupBy("name", "kind", folder.alias("scope")).agg(F.min(place).alias("first"), F.count("*").alias("locations"))
    merged = merged.select("name", "kind", "first.file_path", "first.line_start", "first.id", "locations")
    return merged.unionByName(symbols.where(~partial).select("name", "kind", "file_path", "line_start", "id", F.lit(1).cast("long").alias("locations")))


def collapse_partial(symbols: DataFrame, kinds: tuple[str, ...] = NAMESPACES) -> DataFrame:
    """``by_namespace`` of all ``symbols``, whose ancestors of some kinds are the namespaces."""
    return by_namespace(symbols, enclosing_names(symbols, kinds))


def by_namespace(symbols: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Partial declarations of one name, kind and namespace as one row, their first place, with the list of all places.

    Where the namespace is not known the file stands for it, so that a name alone never puts declarations together.
    """
    place = F.struct("file_path", "line_start", "id")
    is_partial = F.coalesce(F.col("decorators").contains(",partial,"), F.lit(False))
    some = symbols.where(is_partial).join(namespaces, "id", "left")
    known = F.coalesce("namespace", F.concat(F.lit("\0file:"), "file_path"))
    merged = some.groupBy("name", "kind", known.alias("scope")).agg(F.array_sort(F.collect_list(place)).alias("places"))
    first = F.col("places")[0]
    all_places = F.transform("places", lambda p: F.concat(p["file_path"], F.lit(":"), p["line_start"].cast("string")))
    merged = merged.select("name", "kind", *(first[c].alias(c) for c in ("file_path", "line_start", "id")), all_places.alias("locations"))
    return merged.unionByName(symbols.where(~is_partial).select("name", "kind", "file_path", "line_start", "id", F.array().cast("array<string>").alias("locations")))


def callers(symbols: DataFrame, edges: DataFrame, name: str, kind: str = "calls") -> DataFrame:
    """The distinct symbols with an edge of ``kind`` to ``name`` that one of its definitions is compatible with."""
    meant = symbols.where(F.col("name") == name).select(F.col("name").alias("to_name"), F.col("kind").alias("to_kind")).distinct()
    hits = edges.where((F.col("kind") == kind) & (F.col("to_name") == name)).select("from_id", "to_name", "target_kind").join(small(meant), "to_name")
    ids = hits.where(compatible(F.col("target_kind"), F.col("to_kind"))).select(F.col("from_id").alias("id")).distinct()
    return symbols.join(ids, "id", "left_semi")


def callees(symbols: DataFrame, edges: DataFrame, name: str, kind: str = "calls") -> DataFrame:
    """Distinct (to_name, line) of the one definition of ``name``; nothing where there are several."""
    own = symbols.where(F.col("name") == name).select("id", F.count("*").over(Window.partitionBy("name")).alias("n")).where("n = 1")
    return edges.where(F.col("kind") == kind).join(small(own), F.col("from_id") == F.col("id"), "left_semi").select("to_name", "line").distinct()


def explain(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """For each name: definitions, match status, callers, and callees where it has one definition."""
    defs = symbols.groupBy("name").agg(F.count("*").alias("definitions"), F.min("id").alias("one"))
    called = edges.where("kind = 'calls'")
    into = called.groupBy(F.col("to_name").alias("name")).agg(F.count_distinct("from_id").alias("callers"))
    out = called.select("from_id", "to_name", "line").distinct().groupBy("from_id").agg(F.count("*").alias("out"))
    rows = defs.join(into, "name", "left").join(out, (F.col("one") == F.col("from_id")) & (F.col("definitions") == 1), "left")
    status = F.when(F.col("definitions") == 1, "unique").otherwise("ambiguous")
    return rows.select("name", "definitions", status.alias("match_status"), F.coalesce("callers", F.lit(0)).alias("callers"), F.when(F.col("definitions") == 1, F.coalesce("out", F.lit(0))).alias("callees"))


def files(symbols: DataFrame, prefix: str = "", language: str | None = None) -> DataFrame:
    """Files under a literal prefix with their symbols' count."""
    out = symbols.where(F.col("file_path").startswith(prefix))
    out = out.where(F.col("language") == language) if language else out
    return out.groupBy("file_path", "language").agg(F.count("*").alias("symbol_count"))


def outline(symbols: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """id, root, depth and place of each symbol in its file's tree: one join for each level, none past the last.

    The place lists the lines and identifiers down from the root, so sorting by it gives source order. A symbol
    whose parent is not there hangs from its file and is marked as an orphan.
    """
    own = symbols.select("id", "name", "file_path", "line_start", "parent_id")
    ids = own.select(F.col("id").alias("p_id"))
    step = F.struct("line_start", "id")
    with_parent = own.join(ids, F.col("parent_id") == F.col("p_id"), "left")
    level = with_parent.where("p_id is null").select("id", "name", "file_path", F.lit(0).alias("depth"), F.array(step).alias("place"), F.col("parent_id").isNotNull().alias("orphan"))
    kids = with_parent.where("p_id is not null").select("id", "name", "file_path", "line_start", "parent_id").cache()
    out = level
    for depth in range(1, max_depth + 1):
        up = level.select(F.col("id").alias("up"), F.col("place").alias("above"), "orphan")
        level = kids.join(up, F.col("parent_id") == F.col("up")).select("id", "name", "file_path", F.lit(depth).alias("depth"), F.concat("above", F.array(F.struct("line_start", "id"))).alias("place"), "orphan")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def imports(symbols: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    own = symbols.where(F.col("file_path") == path).select("id")
    return edges.where("kind = 'imports'").join(small(own), F.col("from_id") == F.col("id"), "left_semi").select(F.col("to_name").alias("name"), "line").distinct()


def imported_by(symbols: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    hits = edges.where((F.col("kind") == "imports") & (F.col("to_name") == name)).select("from_id")
    return symbols.join(hits, F.col("id") == F.col("from_id"), "left_semi").select("file_path").distinct()


def recent_changes(files: DataFrame, as_of, window: str) -> DataFrame:
    """Files changed in the window that ends at ``as_of``; later times count as errors of the clock and are left out."""
    end = F.lit(as_of).cast("timestamp")
    return files.where(F.col("mtime").between(end - F.make_interval(secs=F.lit(parse_duration(window))), end))


def notes(rows: DataFrame, since=None, agent: str | None = None, kind: str | None = None) -> DataFrame:
    """Scratchpad rows from a time on, of an agent or a kind; newest first is the page's order."""
    out = rows.where(F.col("ts") >= F.lit(since)) if since is not None else rows
    out = out.where(F.col("agent") == agent) if agent else out
    return out.where(F.col("kind") == kind) if kind else out


def enclosing(references: DataFrame, ranges: DataFrame) -> DataFrame:
    """The innermost range of the same file around each reference: the latest start, then the earliest end."""
    r = ranges.select("id", "file_path", F.col("line_start").alias("first"), F.col("line_end").alias("last"))
    found = intervals.innermost(r, references.select("file_path", F.col("line").alias("at")))
    return references.select("ref_id", "file_path", "line").distinct().join(found.select("file_path", F.col("at").alias("line"), F.col("id").alias("owner_id")), ["file_path", "line"]).select("ref_id", "file_path", "line", "owner_id")


# For each language its file endings, how sure an edge is, how it was resolved, and what is not.
ANY = "name-based candidates only; compiler/type resolution absent"
PRECISION = [
    ("rs", "medium", "syntactic", "trait-object and function-pointer dispatch not resolved; macros not expanded; macro-body and function-value references do not prove invocation; "
     "unsupported or over-budget macro bodies may omit references; wildcard-imported function values not resolved"),
    ("go", "medium", "syntactic", "interface and function-value dispatch not resolved; reflection and generated code not tracked"),
    ("java", "medium", "syntactic", "reflection not tracked; generics and overloads not resolved at call sites"),
    ("cs", "medium", "syntactic", "reflection not tracked; delegates and overloads not resolved"),
    ("py pyi", "medium", "heuristic", "obj.method() matched by leaf name only — no type inference; dynamic attributes not tracked"),
    ("ts tsx", "medium", "syntactic", "no type-based dispatch resolution; dynamic imports not tracked"),
    ("js jsx mjs cjs", "medium", "heuristic", "no type resolution; dynamic calls not tracked"),
    ("vue", "medium", "syntactic", "template attribute expressions not parsed; auto-imported components produce no edge; no type-based dispatch resolution"),
    ("php phtml", "medium", "syntactic", "dynamic dispatch not tracked"),
    ("c cc cpp cxx h hpp hh hxx ipp tpp", "low", "syntactic", "macros not expanded; includes not followed; overload resolution absent"),
]
UNKNOWN = ("unknown", "unknown", "unknown", "unsupported or unrecognized language")


def edge_precision(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(extension, kind, confidence, resolution, target_resolution, limitations, edges) by the ending of the file that refers."""
    table = [(e, c, r, "name_based_candidates", f"{ANY}; {limits}") for endings, c, r, limits in PRECISION for e in endings.split()]
    known = F.broadcast(edges.sparkSession.createDataFrame(table, "extension string, confidence string, resolution string, target_resolution string, limitations string"))
    ending = F.lower(F.regexp_extract("file_path", r"[^/]\.([^./]*)$", 1))
    rows = edges.join(symbols.select("id", ending.alias("extension")), F.col("from_id") == F.col("id")).groupBy("extension", "kind").agg(F.count("*").alias("edges"))
    names = ("confidence", "resolution", "target_resolution", "limitations")
    return rows.join(known, "extension", "left").select("extension", "kind", *(F.coalesce(n, F.lit(u)).alias(n) for n, u in zip(names, UNKNOWN)), "edges")


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """Line ranges of each file merged where they overlap or touch."""
    w = Window.partitionBy("file_path").orderBy("line_start", "line_end")
    reach = F.max("line_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = ranges.withColumn("reach", reach)
    gap = F.when(F.col("reach").isNull() | (F.col("line_start") > F.col("reach") + 1), 1).otherwise(0)
    rows = rows.withColumn("island", F.sum(gap).over(w))
    return rows.groupBy("file_path", "island").agg(F.min("line_start").alias("first_line"), F.max("line_end").alias("last_line"), F.count("*").alias("ranges")).drop("island")


def status(indexed: DataFrame, disk: DataFrame) -> DataFrame:
    """Files by freshness: fresh, stale (other time), added (not indexed) or missing (not on disk)."""
    a, b = indexed.select("path", F.col("mtime").alias("was")), disk.select(F.col("path").alias("d_path"), F.col("mtime").alias("now"))
    state = F.when(F.col("path").isNull(), "added").when(F.col("d_path").isNull(), "missing").when(F.col("was").eqNullSafe(F.col("now")), "fresh").otherwise("stale")
    return a.join(b, F.col("path") == F.col("d_path"), "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("files"))


# Families of tasks that may be routed low.
LOW_FAMILIES = ("callees_trace", "source_read_reuse", "task_phase_trace")


def effort_route(tasks: DataFrame, prefix: str = "") -> DataFrame:
    """``tasks`` with effort and reason, by the first rule that holds.

    An effort that the user names counts; else anything but a low risk, another duty than research (``agent``, with or
    without ``prefix``), a family that is not listed, or an incomplete context is high; the rest is low. Names of more than
    80 bytes are invalid: effort is null.
    """
    agent = F.when(F.col("agent").startswith(prefix), F.substring("agent", len(prefix) + 1, 80)).otherwise(F.col("agent"))
    whole = F.col("read_only") & F.col("bounded_scope") & F.col("stable_inputs") & F.col("lexical_repo_map")
    invalid = (F.octet_length("agent") > 80) | (F.octet_length("task_family") > 80)
    reason = (
        F.when(invalid, "invalid_request")
        .when(F.col("user_effort").isNotNull(), "explicit_user_effort")
        .when(~F.col("risk").eqNullSafe("low"), "risk_high_or_unknown")
        .when(~agent.eqNullSafe("researcher"), "agent_not_allowlisted")
        .when(~F.coalesce(F.col("task_family").isin(*LOW_FAMILIES), F.lit(False)), "task_family_not_allowlisted")
        .when(~F.coalesce(whole, F.lit(False)), "research_context_incomplete")
        .otherwise("allowlisted_bounded_research_pilot")
    )
    effort = F.when(reason == "invalid_request", None).when(reason == "explicit_user_effort", F.col("user_effort")).when(reason == "allowlisted_bounded_research_pilot", "low").otherwise("high")
    return tasks.withColumn("effort", effort).withColumn("reason", reason)
