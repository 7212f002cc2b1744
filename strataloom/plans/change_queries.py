"""Queries over two snapshots: lines shipped before a date and all lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import paths
from strataloom.operators import change, graph, reach
from strataloom.operators.store import cut
from strataloom.plans.bind import edges, load, suppliers, symbols
from strataloom.plans.registry import query

BASE_SQL = "base AS (SELECT id, name, kind, file_path, line_start, line_end, CASE WHEN id % 11 = 0 THEN signature || '!' WHEN kind <> 'class' THEN signature END AS signature, language FROM symbols WHERE id % 13 <> 0)"
HEAD_SQL = "head AS (SELECT id, name, kind, file_path, line_start, line_end, CASE WHEN kind <> 'class' THEN signature END AS signature, language FROM symbols WHERE id % 17 <> 0)"
COLUMNS = ["id", "name", "kind", "file_path", "line_start", "line_end", "signature", "language"]


def base(spark: SparkSession, d: str) -> DataFrame:
    """A former state of the symbols: some are not there yet, some have another signature, classes mostly none."""
    s = symbols(spark, d).where("id % 13 <> 0")
    return s.withColumn("signature", F.when(F.col("id") % 11 == 0, F.concat("signature", F.lit("!"))).when(F.col("kind") != "class", F.col("signature"))).select(*COLUMNS)


def head(spark: SparkSession, d: str) -> DataFrame:
    return symbols(spark, d).where("id % 17 <> 0").withColumn("signature", F.when(F.col("kind") != "class", F.col("signature"))).select(*COLUMNS)


@query(
    "symbols",
    f"""WITH {BASE_SQL}, {HEAD_SQL} SELECT coalesce(b.id, h.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN h.id IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM base b FULL JOIN head h ON b.id = h.id WHERE b.id IS NULL OR h.id IS NULL OR b.signature IS DISTINCT FROM h.signature""",
)
def symbols_changed_since(spark: SparkSession, d: str) -> DataFrame:
    return change.snapshot_diff(base(spark, d), head(spark, d), "id", ["signature"])


@query(
    "symbols",
    f"""WITH {BASE_SQL}, {HEAD_SQL}, b AS (SELECT file_path, name, kind, signature, id, row_number() OVER (PARTITION BY file_path, name, kind, signature ORDER BY line_start, line_end, id) AS n FROM base),
    h AS (SELECT file_path, name, kind, signature, id, row_number() OVER (PARTITION BY file_path, name, kind, signature ORDER BY line_start, line_end, id) AS n FROM head),
    p0 AS (SELECT coalesce(b.file_path, h.file_path) AS file_path, coalesce(b.name, h.name) AS name, coalesce(b.kind, h.kind) AS kind, coalesce(b.signature, h.signature) AS signature, b.id AS base_id, h.id AS head_id
      FROM b FULL JOIN h ON b.file_path = h.file_path AND b.name = h.name AND b.kind = h.kind AND b.signature IS NOT DISTINCT FROM h.signature AND b.n = h.n),
    p1 AS (SELECT *, count(base_id) OVER w > 0 AND count(head_id) OVER w > 0 AND count(*) OVER w > 1 AS many FROM p0 WINDOW w AS (PARTITION BY file_path, name, kind, signature)),
    p AS (SELECT *, bool_or(many) OVER (PARTITION BY file_path, name, kind) AS vague FROM p1),
    l AS (SELECT *, count(base_id) OVER (PARTITION BY file_path, name, kind) AS nb, count(head_id) OVER (PARTITION BY file_path, name, kind) AS nh FROM p WHERE base_id IS NULL OR head_id IS NULL)
    SELECT file_path, name, kind, 'same' AS change, base_id, head_id, vague AS uncertain FROM p WHERE base_id IS NOT NULL AND head_id IS NOT NULL
    UNION ALL SELECT file_path, name, kind, 'signature_changed', max(base_id), max(head_id), bool_or(vague) FROM l WHERE nb = 1 AND nh = 1 GROUP BY ALL
    UNION ALL SELECT file_path, name, kind, CASE WHEN base_id IS NULL THEN 'added' ELSE 'removed' END, base_id, head_id, base_id IS NULL AND (vague OR nb > 0) FROM l WHERE NOT (nb = 1 AND nh = 1)""",
)
def declaration_matching(spark: SparkSession, d: str) -> DataFrame:
    return change.match_declarations(base(spark, d), head(spark, d), ["file_path", "name", "kind"])


@query()
def declaration_trees(spark: SparkSession, d: str) -> DataFrame:
    """The same from the top of each file down; a loop over levels has no SQL."""
    parents = symbols(spark, d).select("id", "parent_id")
    return change.match_trees(base(spark, d).join(parents, "id"), head(spark, d).join(parents, "id"))


@query()
def body_change(spark: SparkSession, d: str) -> DataFrame:
    """Line hunks of documents against themselves without every seventh line; a line diff has no SQL."""
    docs = load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: i % 7 != 3), "\n")
    return change.body_changes(docs.withColumn("text", kept), docs)


@query(
    "symbols",
    """WITH h AS (SELECT file_path AS path, line_start + 2 AS first_line, line_start + 3 AS last_line FROM symbols),
    u AS (SELECT DISTINCT * FROM h), c AS (SELECT u.*, s.id, row_number() OVER (PARTITION BY u.path, u.first_line, u.last_line ORDER BY s.line_start DESC, s.line_end, s.id) AS k
      FROM u JOIN symbols s ON s.file_path = u.path AND u.first_line BETWEEN s.line_start AND s.line_end) SELECT path, first_line, last_line, id FROM c WHERE k = 1""",
)
def deepest_changed_declaration(spark: SparkSession, d: str) -> DataFrame:
    s = symbols(spark, d)
    hunks = s.select(F.col("file_path").alias("path"), (F.col("line_start") + 2).alias("first_line"), (F.col("line_start") + 3).alias("last_line")).distinct()
    return change.deepest(hunks, s)


REACH_SQL = f"""WITH RECURSIVE {BASE_SQL}, {HEAD_SQL},
    changed AS (SELECT id FROM symbols LEFT JOIN base b USING (id) LEFT JOIN head h USING (id) WHERE (b.id IS NULL) <> (h.id IS NULL) OR b.signature IS DISTINCT FROM h.signature),
    st AS (SELECT DISTINCT from_id, to_id FROM resolved WHERE kind IN ('calls', 'references')),
    w AS (SELECT id AS seed, id, 0 AS depth FROM changed UNION SELECT w.seed, st.from_id, w.depth + 1 FROM w JOIN st ON st.to_id = w.id WHERE w.depth < 3),
    m AS (SELECT seed, id, min(depth) AS depth FROM w GROUP BY seed, id), reach AS (SELECT * FROM m WHERE depth > 0)"""


def changed(spark: SparkSession, d: str) -> DataFrame:
    """id of every symbol that is new, gone or has another signature."""
    return change.snapshot_diff(base(spark, d), head(spark, d), "id", ["signature"]).select("id")


def steps(spark: SparkSession, d: str) -> reach.Named:
    """By which a change spreads."""
    return reach.steps_of(symbols(spark, d), edges(spark, d), graph.IMPACT_KINDS)


CHANGE_IMPACT_SQL = REACH_SQL + " SELECT split_part(s.file_path, '/', 1) AS component, count(DISTINCT r.id) AS impacted, min(depth) AS nearest, count(DISTINCT seed) AS seeds FROM reach r JOIN symbols s ON s.id = r.id GROUP BY 1"


@query("symbols resolved", CHANGE_IMPACT_SQL)
def change_impact(spark: SparkSession, d: str) -> DataFrame:
    return reach.other_groups(steps(spark, d), cut(changed(spark, d), "changed"), symbols(spark, d).select("id", paths.component(F.col("file_path")).alias("component")), "component")


CROSSINGS_SQL = (
    REACH_SQL
    + """ SELECT split_part(a.file_path, '/', 1) AS from_component, split_part(b.file_path, '/', 1) AS to_component, count(DISTINCT r.id) AS symbols FROM reach r JOIN symbols a ON a.id = r.seed JOIN symbols b ON b.id = r.id
    WHERE split_part(a.file_path, '/', 1) <> split_part(b.file_path, '/', 1) GROUP BY ALL"""
)


@query("symbols resolved", CROSSINGS_SQL)
def api_crossings(spark: SparkSession, d: str) -> DataFrame:
    return change.crossings_of(steps(spark, d), symbols(spark, d), changed(spark, d))


TEST_IMPACT_SQL = (
    REACH_SQL
    + """, dp AS (SELECT id, min(depth) AS depth FROM m GROUP BY id), pt AS (SELECT DISTINCT split_part(s.file_path, '/', 1) AS part FROM reach r JOIN symbols s ON s.id = r.seed),
    t AS (SELECT s.id, s.name, s.file_path, dp.depth, CASE WHEN dp.depth <= 1 THEN 'direct' WHEN dp.depth IS NOT NULL THEN 'transitive' WHEN pt.part IS NOT NULL THEN 'heuristic' END AS class
      FROM symbols s LEFT JOIN (SELECT d.* FROM dp d WHERE d.id IN (SELECT id FROM reach) OR d.id IN (SELECT seed FROM reach)) dp ON dp.id = s.id LEFT JOIN pt ON pt.part = split_part(s.file_path, '/', 1) WHERE s.kind = 'trait')
    SELECT id, name, file_path, class, depth FROM t WHERE class IS NOT NULL"""
)


@query("symbols resolved", TEST_IMPACT_SQL)
def test_impact(spark: SparkSession, d: str) -> DataFrame:
    s = symbols(spark, d)
    return change.ranked_tests(steps(spark, d), s, F.col("kind") == "trait", cut(changed(spark, d), "changed"))


@query(
    "files",
    """WITH t AS (SELECT file_path, unnest(list_filter([CASE WHEN regexp_matches(file_path, '\\.(ts|tsx|js|vue|css|html)$') THEN 'frontend' END, CASE WHEN regexp_matches(file_path, '(^|/)migrations?/|\\.sql$') THEN 'migration' END,
      CASE WHEN regexp_matches(file_path, '(^|/)(tests?|qa)/|(^|/)test_') THEN 'qa' END], lambda x: x IS NOT NULL)) AS discipline FROM files),
    a AS (SELECT * FROM t UNION ALL SELECT file_path, 'unclassified' FROM files WHERE file_path NOT IN (SELECT file_path FROM t))
    SELECT discipline, count(*) AS files, array_to_string(list_sort(list(file_path))[1:20], ',') AS sample FROM a GROUP BY discipline""",
)
def disciplines(spark: SparkSession, d: str) -> DataFrame:
    return change.disciplines(suppliers(spark, d))


FNV_SQL = "printf('%016x', list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split({x}, ''), lambda c: ord(c)::HUGEINT)), lambda h, c: (xor(h, c) * 1099511628211) % 18446744073709551616)::UBIGINT)"
FP_SQL = """l AS (SELECT DISTINCT file_path, 0 AS part, 'L|' || language AS line FROM {t} UNION ALL SELECT file_path, 1, 'S|' || kind || '|' || name || '|' || coalesce(signature, '') FROM {t}
      UNION ALL SELECT s.file_path, 2, 'E|' || e.kind || '|' || s.name || '|' || e.to_name || '|||' || coalesce(e.target_kind, '') FROM edges e JOIN {t} s ON s.id = e.from_id),
    {n}0 AS (SELECT file_path, string_agg(line, chr(10) ORDER BY part, line) AS lines FROM l GROUP BY file_path),
    {n} AS (SELECT file_path, FNV AS fingerprint FROM {n}0)""".replace("FNV", FNV_SQL.format(x="lines").replace("{", "{{").replace("}", "}}"))


@query("symbols edges", "WITH " + FP_SQL.format(t="symbols", n="f") + " SELECT file_path, fingerprint FROM f")
def structural_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return change.fingerprints(symbols(spark, d), edges(spark, d))


@query(
    "symbols edges files",
    "WITH "
    + BASE_SQL
    + ", "
    + FP_SQL.format(t="base", n="fb")
    + ", "
    + FP_SQL.format(t="symbols", n="fh").replace("l AS (SELECT", "l2 AS (SELECT").replace("FROM l GROUP", "FROM l2 GROUP")
    + " SELECT h.file_path, CASE WHEN b.fingerprint IS NULL THEN 'first-seen' WHEN b.fingerprint = h.fingerprint THEN 'cosmetic' ELSE 'structural' END AS class FROM fh h JOIN files f ON f.file_path = h.file_path AND f.suppkey % 2 = 0 LEFT JOIN fb b ON b.file_path = h.file_path",
)
def change_class(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    changed = suppliers(spark, d).where("suppkey % 2 = 0").select("file_path")
    return change.change_class(change.fingerprints(base(spark, d), e), change.fingerprints(symbols(spark, d), e), changed)


@query("symbols", "SELECT split_part(file_path, '/', 1) AS component, language, count(DISTINCT file_path) AS files, count(*) AS symbols FROM symbols GROUP BY GROUPING SETS ((split_part(file_path, '/', 1)), (split_part(file_path, '/', 1), language), (language))")
def project_map(spark: SparkSession, d: str) -> DataFrame:
    rows = symbols(spark, d).select(paths.component(F.col("file_path")).alias("component"), "language", "file_path")
    c, g = F.col("component"), F.col("language")
    return rows.groupingSets([[c], [c, g], [g]], c, g).agg(F.count_distinct("file_path").alias("files"), F.count("*").alias("symbols"))


@query(
    "files",
    """WITH n AS (SELECT regexp_replace(file_path, '[^/]*$', '') || CASE suppkey % 9 WHEN 0 THEN 'main' WHEN 1 THEN 'lib' WHEN 2 THEN 'mod' WHEN 3 THEN 'app' WHEN 4 THEN 'index' WHEN 5 THEN 'Main' WHEN 6 THEN '__main__' ELSE 'other' END || '.' || regexp_extract(file_path, '[^.]*$') AS file_path FROM files),
    e AS (SELECT DISTINCT file_path, CASE regexp_extract(file_path, '[^/]*$') WHEN 'main.rs' THEN 1 WHEN 'main.go' THEN 1 WHEN 'main.py' THEN 1 WHEN '__main__.py' THEN 1 WHEN 'app.py' THEN 3 WHEN 'index.ts' THEN 3 WHEN 'lib.rs' THEN 4 WHEN 'mod.rs' THEN 4 END AS priority FROM n)
    SELECT file_path, priority FROM e WHERE priority IS NOT NULL""",
)
def entry_points(spark: SparkSession, d: str) -> DataFrame:
    """The files under other names, some of which are those of entry files of their language and some of another one's."""
    f = suppliers(spark, d)
    names = F.array(*map(F.lit, ("main", "lib", "mod", "app", "index", "Main", "__main__", "other", "other")))
    name = F.concat(paths.parent(F.col("file_path")), F.lit("/"), F.element_at(names, (F.col("suppkey") % 9 + 1).cast("int")), F.lit("."), F.regexp_extract("file_path", r"[^.]*$", 0))
    return change.entry_points(f.select(name.alias("file_path")).distinct())


COMPONENT_SQL = "SELECT split_part(file_path, '/', 1) || '/' || split_part(file_path, '/', 2) AS component, count(*) AS symbols, count(DISTINCT kind) AS kinds FROM {t} GROUP BY 1"


@query(
    "symbols",
    f"""WITH {BASE_SQL}, {HEAD_SQL}, b AS ({COMPONENT_SQL.format(t="base")}), h AS ({COMPONENT_SQL.format(t="head")})
    SELECT coalesce(b.component, h.component) AS component, CASE WHEN b.component IS NULL THEN 'added' WHEN h.component IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM b FULL JOIN h ON b.component = h.component WHERE b.component IS NULL OR h.component IS NULL OR b.symbols <> h.symbols OR b.kinds <> h.kinds""",
)
def temporal_components(spark: SparkSession, d: str) -> DataFrame:
    side = lambda df: df.groupBy(paths.component_at(F.col("file_path"), 2).alias("component")).agg(F.count("*").alias("symbols"), F.count_distinct("kind").alias("kinds"))
    return change.snapshot_diff(side(base(spark, d)), side(head(spark, d)), "component", ["symbols", "kinds"])


CYCLE_SQL = """p{k} AS (SELECT DISTINCT a.file_path AS f, b.file_path AS t FROM edges e JOIN {s} a ON a.id = e.from_id JOIN {s} b ON b.name = e.to_name WHERE e.kind = 'imports' AND a.file_path <> b.file_path),
    r{k} AS (SELECT f, t FROM p{k} UNION SELECT r{k}.f, p{k}.t FROM r{k} JOIN p{k} ON p{k}.f = r{k}.t),
    c{k} AS (SELECT DISTINCT members FROM (SELECT a.f, list_sort(list(DISTINCT b.f)) AS members FROM r{k} a JOIN r{k} b ON a.t = b.f AND b.t = a.f GROUP BY a.f) WHERE len(members) > 1)"""


@query(
    "symbols edges",
    f"""WITH RECURSIVE {BASE_SQL}, {HEAD_SQL}, {CYCLE_SQL.format(k=1, s="base")}, {CYCLE_SQL.format(k=2, s="head")},
    b AS (SELECT members FROM c1 EXCEPT SELECT members FROM c2), h AS (SELECT members FROM c2 EXCEPT SELECT members FROM c1),
    l AS (SELECT b.members AS m, h.members AS m2 FROM b JOIN h ON list_has_any(b.members, h.members))
    SELECT 'removed' AS change, array_to_string(members, ',') AS members FROM b WHERE members NOT IN (SELECT m FROM l)
    UNION ALL SELECT 'added', array_to_string(members, ',') FROM h WHERE members NOT IN (SELECT m2 FROM l) UNION ALL SELECT DISTINCT 'changed', array_to_string(m2, ',') FROM l""",
)
def cycle_delta(spark: SparkSession, d: str) -> DataFrame:
    """Cycles of the whole snapshots compared."""
    e = edges(spark, d)
    side = lambda df: graph.all_cycles(graph.imports_of(df, e))
    return change.cycle_delta(side(base(spark, d)), side(head(spark, d)))


DEGREE_SQL = """g{k} AS (SELECT s.id, s.file_path, s.line_start, s.name, count(DISTINCT r.from_id) AS in_degree FROM resolved r JOIN {s} s ON s.id = r.to_id WHERE r.kind = 'calls' GROUP BY ALL ORDER BY in_degree DESC, file_path, line_start, name, id LIMIT 50),
    q{k} AS (SELECT id, in_degree, row_number() OVER (ORDER BY in_degree DESC, file_path, line_start, name, id) AS rank FROM g{k})"""


@query(
    "symbols resolved",
    f"""WITH {BASE_SQL}, {HEAD_SQL}, {DEGREE_SQL.format(k=1, s="base")}, {DEGREE_SQL.format(k=2, s="head")}
    SELECT * FROM (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'entered' WHEN b.id IS NULL THEN 'exited' WHEN a.rank <> b.rank THEN 'moved' END AS change, a.rank AS b_rank, b.rank AS h_rank,
      coalesce(b.in_degree, 0) - coalesce(a.in_degree, 0) AS delta FROM q1 a FULL JOIN q2 b ON a.id = b.id) WHERE change IS NOT NULL""",
)
def centrality_delta(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return change.rank_delta(graph.in_degrees(base(spark, d), e), graph.in_degrees(head(spark, d), e))


@query(
    "symbols files",
    f"""WITH {BASE_SQL}, {HEAD_SQL}, ch AS (SELECT file_path FROM files WHERE suppkey % 3 = 0)
    SELECT file_path, count(*) AS symbols FROM (SELECT file_path FROM head WHERE file_path NOT IN (SELECT file_path FROM ch) UNION ALL SELECT file_path FROM base WHERE file_path IN (SELECT file_path FROM ch)) GROUP BY file_path""",
)
def baseline_rewind(spark: SparkSession, d: str) -> DataFrame:
    changed = suppliers(spark, d).where("suppkey % 3 = 0").select("file_path")
    return change.rewound(head(spark, d), changed, base(spark, d)).groupBy("file_path").agg(F.count("*").alias("symbols"))


@query("", "SELECT conv_id, turn, bytes_so_far FROM (SELECT conv_id, turn, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS bytes_so_far FROM conversations) WHERE ceil(bytes_so_far / 4) <= 120")
def brief_budget(spark: SparkSession, d: str) -> DataFrame:
    items = load(spark, d, "conversations").select(F.col("conv_id").alias("packet"), "turn", "text")
    return change.fitting(items, 120, "turn").select(F.col("packet").alias("conv_id"), "turn", "bytes_so_far")
