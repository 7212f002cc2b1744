"""Queries of evidence roll-ups, facts and policy rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import paths
from strataloom.operators import graph, mentions, policies, reach, rollup
from strataloom.operators.bounds import counted, page
from strataloom.plans.bind import edges, load, spans, suppliers, symbols, tasks_for, touches
from strataloom.plans.registry import paged, query

# Rules in the order of their file; the last match wins, the third has no owner on purpose.
RULES = [(0, "**", "core"), (1, "asia/**", "east,core"), (2, "asia/nation_2/*", ""), (3, "**/s*2.rs", "rustlers"), (4, "europe/**/s?.py", "west")]
RULES_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"({n}, '{paths.glob_regex(g)}', '{o}')" for n, g, o in RULES) + ") v(rule_no, pattern, owners))"
OWNED_SQL = "owned AS (SELECT file_path AS path, arg_max(owners, rule_no) AS owners, max(rule_no) AS rule_no FROM files JOIN rules ON regexp_matches(file_path, pattern) GROUP BY file_path)"
PAIRS_SQL = "pairs AS (SELECT DISTINCT a.file_path AS from_file, b.file_path AS to_file FROM edges e JOIN symbols a ON a.id = e.from_id JOIN symbols b ON b.name = e.to_name WHERE e.kind = 'imports' AND a.file_path <> b.file_path)"


def owned(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([(n, paths.glob_regex(g), o) for n, g, o in RULES], "rule_no int, pattern string, owners string")
    return rollup.owners(suppliers(spark, d).select(F.col("file_path").alias("path")), rules)


@query("files", "WITH m AS (SELECT f.file_path AS path, l_linenumber AS line, max(CASE WHEN l_quantity > 25 THEN l_quantity::BIGINT ELSE 0 END) AS hits FROM lineitem JOIN files f ON f.suppkey = l_suppkey GROUP BY ALL) SELECT path, count(*) AS lines, count(*) FILTER (hits > 0) AS hit FROM m GROUP BY path")
def coverage_rollup(spark: SparkSession, d: str) -> DataFrame:
    li, f = load(spark, d, "lineitem").select("l_suppkey", "l_linenumber", "l_quantity"), suppliers(spark, d)
    hits = F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("long")).otherwise(0)
    return rollup.coverage(li.join(f, F.col("l_suppkey") == F.col("suppkey")).select(F.col("file_path").alias("path"), F.col("l_linenumber").alias("line"), hits.alias("hits")))


@query(
    "spans",
    """SELECT file_path AS path, count(*) FILTER (name IN ('purchase', 'signup')) AS passed, count(*) FILTER (name = 'error') AS failed, count(*) FILTER (name IN ('view', 'click')) AS skipped, round(sum(value), 6) AS seconds FROM spans GROUP BY 1""",
)
def tests_rollup(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("name").isin("purchase", "signup"), "passed").when(F.col("name") == "error", "failed").otherwise("skipped")
    return rollup.tests(spans(spark, d).select(F.col("file_path").alias("path"), state.alias("status"), F.col("value").alias("seconds"))).withColumn("seconds", F.round("seconds", 6))


@query("spans", "SELECT file_path, count(*) AS spans, count(DISTINCT trace_id) AS traces, count(*) FILTER (name = 'error') AS errors, count(*) FILTER (parent_id IS NULL) AS roots FROM spans GROUP BY file_path")
def runtime_rollup(spark: SparkSession, d: str) -> DataFrame:
    return spans(spark, d).groupBy("file_path").agg(F.count("*").alias("spans"), F.count_distinct("trace_id").alias("traces"), F.count_if(F.col("name") == "error").alias("errors"), F.count_if(F.col("parent_id").isNull()).alias("roots"))


@query("touches", "SELECT path, count(DISTINCT sha) AS commits, count(DISTINCT author) AS authors, sum(added)::BIGINT AS added FROM touches GROUP BY path")
def churn(spark: SparkSession, d: str) -> DataFrame:
    return rollup.churn(touches(spark, d), tasks_for(load(spark, d, "lineitem")))


@query("touches", "WITH n AS (SELECT path, author, count(DISTINCT sha) AS c FROM touches GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY c DESC, author) AS k FROM n) SELECT path, string_agg(author::VARCHAR, ',' ORDER BY k) AS names FROM k WHERE k <= 5 GROUP BY path")
def contributors(spark: SparkSession, d: str) -> DataFrame:
    return rollup.contributors(touches(spark, d), tasks=tasks_for(load(spark, d, "lineitem")))


@query(
    "touches",
    """WITH c AS (SELECT DISTINCT split_part(file_path, '/', 1) || '/' || split_part(file_path, '/', 2) AS component FROM files), e AS (SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS component, author, sha FROM touches),
    n AS (SELECT component, author, count(*) AS n FROM e GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY n DESC, author) AS k FROM n),
    t AS (SELECT component, count(*) AS authors, sum(n)::BIGINT AS touches, max(author) FILTER (k = 1) AS top_author, max(n) AS best FROM k GROUP BY component)
    SELECT component, coalesce(authors, 0) AS authors, coalesce(touches, 0) AS touches, top_author, best * 100 // touches AS top_percent FROM c LEFT JOIN t USING (component)""",
)
def bus_factor(spark: SparkSession, d: str) -> DataFrame:
    return rollup.bus_factor(touches(spark, d), suppliers(spark, d).select(paths.component_at(F.col("file_path"), 2).alias("component")).distinct())


@query("touches resolved", paged("WITH c AS (SELECT path, count(DISTINCT sha) AS commits FROM touches GROUP BY path), g AS (SELECT to_file AS path, count(DISTINCT from_id) AS in_degree FROM resolved WHERE kind = 'calls' GROUP BY to_file) SELECT path, commits, in_degree, commits * in_degree AS score FROM c JOIN g USING (path)", 20, "score DESC, path"))
def change_hotspots(spark: SparkSession, d: str) -> DataFrame:
    found = rollup.hotspots(rollup.churn(touches(spark, d)), graph.file_in_degrees(symbols(spark, d), edges(spark, d)))
    return page(found, 20, F.col("score").desc(), "path")


@query("symbols", paged("SELECT file_path, count(*) AS symbols, max(line_end) AS last_line FROM symbols GROUP BY file_path", 10, "symbols DESC, file_path"))
def largest_files(spark: SparkSession, d: str) -> DataFrame:
    sizes = symbols(spark, d).groupBy("file_path").agg(F.count("*").alias("symbols"), F.max("line_end").alias("last_line"))
    return page(sizes, 10, F.col("symbols").desc(), "file_path")


@query("files", "WITH f AS (SELECT f.file_path AS path, l_linenumber AS line, l_orderkey || '/' || l_partkey AS rule, row_number() OVER (PARTITION BY f.file_path ORDER BY l_linenumber, l_orderkey || '/' || l_partkey) AS k, count(*) OVER () AS total FROM lineitem JOIN files f ON f.suppkey = l_suppkey), c AS (SELECT * FROM f WHERE k <= 100 ORDER BY path, line, rule LIMIT 5000) SELECT path, line, rule, total, (SELECT count(*) FROM c) AS returned, total > (SELECT count(*) FROM c) AS truncated FROM c")
def findings_cap(spark: SparkSession, d: str) -> DataFrame:
    li, f = load(spark, d, "lineitem"), suppliers(spark, d)
    rows = li.join(f, F.col("l_suppkey") == F.col("suppkey")).select(F.col("file_path").alias("path"), F.col("l_linenumber").alias("line"), F.concat(F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_partkey").cast("string")).alias("rule"))
    return counted(rollup.capped_findings(rows), rows)


@query("files", f"WITH {RULES_SQL}, {OWNED_SQL} SELECT path, owners, rule_no FROM owned")
def codeowners(spark: SparkSession, d: str) -> DataFrame:
    return owned(spark, d)


@query("files", f"WITH {RULES_SQL}, {OWNED_SQL}, b AS (SELECT file_path AS path, arg_max(owners, rule_no) AS owners FROM files JOIN rules ON rule_no < 3 AND regexp_matches(file_path, pattern) GROUP BY file_path) SELECT path, b.owners AS was, o.owners AS now FROM b JOIN owned o USING (path) WHERE b.owners IS DISTINCT FROM o.owners")
def ownership_delta(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([(n, paths.glob_regex(g), o) for n, g, o in RULES[:3]], "rule_no int, pattern string, owners string")
    return rollup.owner_delta(rollup.owners(suppliers(spark, d).select(F.col("file_path").alias("path")), rules), owned(spark, d))


@query(
    "",
    r"""WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS name, generate_subscripts(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), 1) - 1 AS place FROM documents),
    f AS (SELECT name, doc_id, min(place) AS place FROM w WHERE name IN ('idiot', 'worthless', 'licensed', 'apache') GROUP BY ALL)
    SELECT name, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS k FROM f) WHERE k <= 20""",
)
def knowledge_mentions(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([(n,) for n in ("idiot", "worthless", "licensed", "apache")], "name string")
    return rollup.mentions(load(spark, d, "documents").select("doc_id", "text"), names)


@query("symbols edges", "SELECT file_path, array_to_string(list_sort(list_distinct(list(e.to_name)))[1:5], ',') AS names FROM edges e JOIN symbols s ON s.id = e.from_id GROUP BY file_path")
def first_names(spark: SparkSession, d: str) -> DataFrame:
    rows = edges(spark, d).join(symbols(spark, d).select(F.col("id").alias("from_id"), "file_path"), "from_id")
    return rollup.first_names(rows, ["file_path"], "to_name")


@query("symbols", "WITH k AS (SELECT split_part(file_path, '/', 2) AS component, id, name, line_start, row_number() OVER (PARTITION BY split_part(file_path, '/', 2) ORDER BY line_start DESC, id) AS k, count(*) OVER () AS total FROM symbols), c AS (SELECT * FROM k WHERE k <= 20 ORDER BY component, line_start DESC, id LIMIT 400) SELECT component, id, name, line_start, total, (SELECT count(*) FROM c) AS returned, total > (SELECT count(*) FROM c) AS truncated FROM c")
def top_per_component(spark: SparkSession, d: str) -> DataFrame:
    rows = symbols(spark, d).select(F.split("file_path", "/")[1].alias("component"), "id", "name", "line_start")
    return counted(rollup.per_group(rows, "component", [F.col("line_start").desc(), "id"], 20, 400), rows)


@query("spans", "SELECT name AS source, CASE name WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' ELSE 'note' END AS severity, count(*) AS facts, count(DISTINCT file_path) AS files FROM spans GROUP BY name ORDER BY CASE name WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, name")
def fact_counts(spark: SparkSession, d: str) -> DataFrame:
    severity = F.when(F.col("name") == "error", "error").when(F.col("name") == "purchase", "warning").otherwise("note")
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return spans(spark, d).groupBy(F.col("name").alias("source"), severity.alias("severity")).agg(F.count("*").alias("facts"), F.count_distinct("file_path").alias("files")).orderBy(rank, "source")


@query("spans", paged("SELECT span_id, name, file_path, CASE name WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS severity FROM spans WHERE file_path NOT IN (SELECT file_path FROM files WHERE suppkey % 4 = 0)", 200, "severity, span_id").replace("SELECT *, (SELECT count(*) FROM every_row) AS total", "SELECT *, (SELECT count(*) > 0 FROM spans WHERE file_path IN (SELECT file_path FROM files WHERE suppkey % 4 = 0)) AS partial, (SELECT count(*) FROM every_row) AS total"))
def facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of current sources, the severest first; the answer is partial if a source was left out as stale."""
    stale = suppliers(spark, d).where("suppkey % 4 = 0").select("file_path")
    every = spans(spark, d)
    rank = F.when(F.col("name") == "error", 0).when(F.col("name") == "purchase", 1).otherwise(2)
    found = page(every.join(stale, "file_path", "left_anti").select("span_id", "name", "file_path", rank.alias("severity")), 200, "severity", "span_id")
    return found.withColumn("partial", every.join(stale, "file_path", "left_semi").agg(F.count("*") > 0).scalar())


@query("touches", "SELECT path, coalesce(n.commits, 0) AS commits, coalesce(s.spans, 0) AS spans FROM (SELECT path, count(DISTINCT sha) AS commits FROM touches GROUP BY path) n FULL JOIN (SELECT f.file_path AS path, count(*) AS spans FROM events e CROSS JOIN (SELECT count(*) AS k FROM supplier) c JOIN files f ON f.suppkey = e.event_id % c.k GROUP BY 1) s USING (path)")
def file_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Roll-ups of one file side by side, also where one of them has nothing."""
    a = touches(spark, d).repartition(tasks_for(load(spark, d, "lineitem")), "path").groupBy("path").agg(F.count_distinct("sha").alias("commits"))
    b = spans(spark, d).groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("spans"))
    return a.join(b, "path", "full_outer").select("path", F.coalesce("commits", F.lit(0)).alias("commits"), F.coalesce("spans", F.lit(0)).alias("spans"))


@query("symbols edges", f"WITH {PAIRS_SQL} SELECT 'dependency' AS rule, from_file || ' -> ' || to_file AS subject FROM pairs WHERE starts_with(from_file, 'asia/') AND regexp_matches(to_file, '^europe/[^/]+/s[^/]*\\.rs$')")
def policy_dependency(spark: SparkSession, d: str) -> DataFrame:
    return rollup.dependency_rule(graph.imports_of(symbols(spark, d), edges(spark, d)), "asia/**", "europe/*/s*.rs")


@query("symbols resolved", f"WITH {RULES_SQL}, {OWNED_SQL}, u AS (SELECT DISTINCT s.id, s.name, s.file_path FROM resolved r JOIN symbols s ON s.id = r.to_id JOIN symbols f ON f.id = r.from_id WHERE starts_with(s.file_path, 'asia/') AND NOT starts_with(f.file_path, 'asia/')) SELECT 'api_owner' AS rule, u.file_path || ' -> ' || name AS subject FROM u WHERE file_path NOT IN (SELECT path FROM owned WHERE owners <> '')")
def policy_api_owner(spark: SparkSession, d: str) -> DataFrame:
    return rollup.owner_rule(graph.api_surface(symbols(spark, d), edges(spark, d), "asia/"), owned(spark, d))


RADIUS_SQL = """WITH RECURSIVE st AS (SELECT DISTINCT from_id, to_id FROM resolved WHERE kind IN ('calls', 'references')),
    w AS (SELECT id AS seed, id, 0 AS depth FROM symbols UNION SELECT w.seed, st.from_id, w.depth + 1 FROM w JOIN st ON st.to_id = w.id WHERE w.depth < 2),
    n AS (SELECT seed, count(DISTINCT (s.file_path, s.line_start, s.name)) AS n FROM (SELECT DISTINCT seed, id FROM w WHERE depth > 0 AND id <> seed) x JOIN symbols s ON s.id = x.id GROUP BY seed)
    SELECT 'blast_radius' AS rule, seed || ' -> ' || n AS subject FROM n WHERE n > 5"""


@query("symbols resolved", RADIUS_SQL)
def policy_blast_radius(spark: SparkSession, d: str) -> DataFrame:
    s = symbols(spark, d)
    return rollup.radius_rule(reach.kin(reach.steps_of(s, edges(spark, d), graph.IMPACT_KINDS), 2), s, 5)


@query("symbols edges", f"WITH {RULES_SQL}, {OWNED_SQL}, {PAIRS_SQL} SELECT 'ownership_boundary' AS rule, from_file || ' -> ' || to_file AS subject FROM pairs JOIN owned a ON a.path = from_file JOIN owned b ON b.path = to_file WHERE a.owners <> '' AND b.owners <> '' AND NOT list_has_any(string_split(a.owners, ','), string_split(b.owners, ','))")
def policy_ownership_boundary(spark: SparkSession, d: str) -> DataFrame:
    return rollup.boundary_rule(graph.imports_of(symbols(spark, d), edges(spark, d)), owned(spark, d))


@query("symbols", "SELECT 'related_tests' AS rule, f.file_path AS subject FROM files f WHERE f.file_path IN (SELECT file_path FROM symbols) AND f.file_path NOT IN (SELECT file_path FROM symbols WHERE kind = 'trait' AND id % 3 = 0)")
def policy_related_tests(spark: SparkSession, d: str) -> DataFrame:
    s = symbols(spark, d)
    return rollup.violations("related_tests", s.select("file_path").distinct().join(s.where("kind = 'trait' and id % 3 = 0"), "file_path", "left_anti"), "file_path")


def components_sql(name: str, pairs: str) -> str:
    """CTEs: the components of two or more files of ``pairs`` as lists ``m`` of ``name``."""
    return f"""{name}_r AS (SELECT from_file AS f, to_file AS t FROM {pairs} UNION SELECT r.f, p.to_file FROM {name}_r r JOIN {pairs} p ON p.from_file = r.t),
    {name} AS (SELECT DISTINCT m FROM (SELECT a.f, list_sort(list(DISTINCT b.f)) AS m FROM {name}_r a JOIN {name}_r b ON a.t = b.f AND b.t = a.f GROUP BY a.f) WHERE len(m) > 1)"""


def new_cycles_sql(pairs: str, base: str, changed: str) -> str:
    """CTEs: ``fresh`` (m), the components of ``pairs`` with a file of ``changed`` (path) that the base does not have."""
    return f"""{components_sql('now_c', pairs)}, hit AS (SELECT m FROM now_c WHERE list_has_any(m, (SELECT list(path) FROM {changed}))), mem AS (SELECT DISTINCT unnest(m) AS p FROM hit),
    inside AS (SELECT from_file, to_file FROM {base} WHERE from_file IN (FROM mem) AND to_file IN (FROM mem)), {components_sql('was_c', 'inside')}, fresh AS (SELECT m FROM hit WHERE m NOT IN (SELECT m FROM was_c))"""


CYCLE_BUDGET_SQL = f"""WITH RECURSIVE {PAIRS_SQL}, fp AS (SELECT from_file, to_file FROM pairs WHERE regexp_replace(from_file, '/[^/]*$', '') = regexp_replace(to_file, '/[^/]*$', '')),
    bp AS (SELECT * FROM fp WHERE NOT ends_with(from_file, '.go')), cf AS (SELECT file_path AS path FROM files WHERE ends_with(file_path, '.go')), {new_cycles_sql('fp', 'bp', 'cf')}
    SELECT count(*) AS new_cycles, count(*) > 3 AS violated FROM fresh"""


@query("symbols edges", CYCLE_BUDGET_SQL)
def policy_cycle_budget(spark: SparkSession, d: str) -> DataFrame:
    """Cycles inside folders that a baseline without the imports of one language does not have, against a budget of three."""
    p = graph.imports_of(symbols(spark, d), edges(spark, d), inside_folders=True)
    go = suppliers(spark, d).where("file_path like '%.go'").select(F.col("file_path").alias("path"))
    found = policies.new_cycles(p, graph.Imports(p.uses.where("file not like '%.go'"), p.gives), go).select("root").distinct()
    return found.agg(F.count("*").alias("new_cycles")).withColumn("violated", F.col("new_cycles") > 3)


ACCEPTANCE_SQL = "SELECT o_orderpriority AS criterion, count(*) AS checks, bool_and(coalesce(s.status = 'current', false)) AS satisfied FROM (SELECT o_orderpriority, o_orderkey FROM orders) o LEFT JOIN (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'stale' ELSE 'current' END AS status FROM orders WHERE o_orderpriority <> '5-LOW') s USING (o_orderkey) GROUP BY 1"


@query("", ACCEPTANCE_SQL)
def acceptance(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    criteria = o.select(F.col("o_orderpriority").alias("criterion"), F.col("o_orderkey").alias("check_id"))
    receipts = o.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("check_id"), F.when(F.col("o_orderstatus") == "F", "stale").otherwise("current").alias("status"))
    return rollup.acceptance(criteria, receipts)


LINKS_SQL = """WITH was AS (SELECT file_path, count(*) AS n FROM symbols WHERE id % 13 <> 0 GROUP BY 1), now AS (SELECT file_path, count(*) AS n FROM symbols WHERE id % 17 <> 0 GROUP BY 1),
    st AS (SELECT coalesce(w.file_path, x.file_path) AS file_path, CASE WHEN w.file_path IS NULL THEN 'added' WHEN x.file_path IS NULL THEN 'missing' WHEN w.n <> x.n THEN 'content_changed' ELSE 'same' END AS state FROM was w FULL JOIN now x USING (file_path)),
    e AS (SELECT p.file_path AS a, c.file_path AS b FROM spans c JOIN spans p ON p.trace_id = c.trace_id AND p.span_id = c.parent_id)
    SELECT a AS from_file, b AS to_file, coalesce(x.state, 'missing') <> 'same' OR coalesce(y.state, 'missing') <> 'same' AS needs_review, 'unverified' AS verification, count(*) AS links FROM e LEFT JOIN st x ON x.file_path = a LEFT JOIN st y ON y.file_path = b GROUP BY ALL"""


@query("symbols spans", LINKS_SQL)
def document_graph_check(spark: SparkSession, d: str) -> DataFrame:
    """Links whose ends changed since they were recorded need review; a check never verifies them."""
    s, c = symbols(spark, d), spans(spark, d)
    was = s.where("id % 13 <> 0").groupBy("file_path").agg(F.count("*").alias("was"))
    now = s.where("id % 17 <> 0").groupBy("file_path").agg(F.count("*").alias("now"))
    state = was.join(now, "file_path", "full_outer").select("file_path", F.col("was").eqNullSafe(F.col("now")).alias("same"))
    p = c.select(F.col("trace_id").alias("t"), F.col("span_id").alias("s"), F.col("file_path").alias("from_file"))
    links = c.join(p, (F.col("trace_id") == F.col("t")) & (F.col("parent_id") == F.col("s"))).select("from_file", F.col("file_path").alias("to_file"))
    links = links.join(state.select(F.col("file_path").alias("from_file"), F.col("same").alias("same_a")), "from_file", "left").join(state.select(F.col("file_path").alias("to_file"), F.col("same").alias("same_b")), "to_file", "left")
    review = ~(F.coalesce("same_a", F.lit(False)) & F.coalesce("same_b", F.lit(False)))
    return links.groupBy("from_file", "to_file", review.alias("needs_review"), F.lit("unverified").alias("verification")).agg(F.count("*").alias("links"))


MENTIONS_SQL = """WITH m AS (SELECT DISTINCT sha AS doc, 'log/' || (sha % 10) || '/' || sha || '.md' AS artifact, subject AS kind, path FROM touches WHERE added % 3 > 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY artifact, kind, doc) AS k, (SELECT count(*) FROM m) AS total FROM m), c AS (SELECT * FROM k WHERE k <= 20 ORDER BY artifact, kind, doc, path LIMIT 500)
    SELECT artifact, kind, doc, path, total, (SELECT count(*) FROM c) AS returned, total > (SELECT count(*) FROM c) AS truncated FROM c"""


@query("touches", MENTIONS_SQL)
def path_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Commits as texts that name their files: as they are, with backslashes, or as part of a longer name, which is none."""
    t = touches(spark, d)
    spelt = F.when(F.col("added") % 3 == 0, F.concat(F.lit("not in "), "path", F.lit("x, "))).when(F.col("added") % 3 == 1, F.concat(F.lit("see ("), F.replace("path", F.lit("/"), F.lit("\\")), F.lit("); "))).otherwise(F.concat(F.lit("in "), "path", F.lit(". ")))
    docs = t.groupBy(F.col("sha").alias("doc"), F.col("subject").alias("kind")).agg(F.array_join(F.array_sort(F.collect_list(spelt)), "").alias("body"))
    names = docs.select("doc", "kind", F.concat(F.lit("log/"), (F.col("doc") % 10).cast("string"), F.lit("/"), F.col("doc").cast("string"), F.lit(".md")).alias("artifact"))
    found = mentions.path_mentions(docs, suppliers(spark, d).select(F.col("file_path").alias("path"))).join(names, "doc")
    return mentions.capped_mentions(found.select("artifact", "kind", "doc", "path"), ["artifact", "kind", "doc"])
