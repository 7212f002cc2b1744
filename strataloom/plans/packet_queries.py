"""Queries that assemble packets: context layers, reviews, risk, temporal boundaries, adapted facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.functions import paths
from strataloom.operators import change, graph, rollup, text
from strataloom.operators import search as fts
from strataloom.plans.bind import edges, load, spans, symbols, touches
from strataloom.plans.change_queries import BASE_SQL, HEAD_SQL, base, head
from strataloom.plans.registry import paged, query
from strataloom.sources.sinks import annotations

@query(
    "",
    """WITH l AS (SELECT conv_id, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS layer, role, count(*) AS items, ceil(sum(strlen(text)) / 4)::BIGINT AS tokens FROM conversations GROUP BY ALL),
    s AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY layer ROWS UNBOUNDED PRECEDING) AS upto FROM l)
    SELECT conv_id, layer, role, items, tokens, upto <= 120 AS kept, CASE WHEN upto > 120 THEN 'budget' END AS reason FROM s""",
)
def context_layers(spark: SparkSession, d: str) -> DataFrame:
    """Layers of each packet in their order; one that no longer fits is dropped whole, with the reason."""
    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    rows = load(spark, d, "conversations").groupBy("conv_id", rank.alias("layer"), "role").agg(F.count("*").alias("items"), F.ceil(F.sum(F.octet_length("text")) / 4).alias("tokens"))
    rows = rows.withColumn("upto", F.sum("tokens").over(Window.partitionBy("conv_id").orderBy("layer").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select("conv_id", "layer", "role", "items", "tokens", (F.col("upto") <= 120).alias("kept"), F.when(F.col("upto") > 120, "budget").alias("reason"))


WORDS = r"list_filter(string_split_regex(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
RECALL_SQL = paged(
    f"""WITH w AS (SELECT conv_id || '/' || turn AS id, 'role' AS field, unnest({WORDS.format(c='role')}) AS term FROM conversations UNION ALL SELECT conv_id || '/' || turn, 'body', unnest({WORDS.format(c='text')}) FROM conversations),
    ft AS (SELECT id, field, term, count(*) AS tf FROM w GROUP BY ALL), ln AS (SELECT id, sum(tf) AS length FROM ft GROUP BY id), st AS (SELECT count(*) AS docs, avg(length) AS mean FROM ln), t AS (SELECT DISTINCT term FROM w WHERE field = 'body' AND length(term) = 6 ORDER BY term LIMIT 12),
    h AS (SELECT id, term, sum(CASE field WHEN 'role' THEN 4 ELSE 1 END * tf) AS tf FROM ft WHERE term IN (SELECT term FROM t) OR term = 'user' GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM h GROUP BY term)
    SELECT id, count(*) AS hits, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM h JOIN df USING (term) JOIN ln USING (id), st GROUP BY id""",
    64,
    "score DESC, id",
)


@query("", RECALL_SQL)
def body_recall(spark: SparkSession, d: str) -> DataFrame:
    """Any of the terms is enough; who spoke weighs four times what was said, and 64 rows are a page."""
    c = load(spark, d, "conversations").withColumn("id", F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")))
    words = lambda field, column: c.select("id", F.lit(field).alias("field"), F.explode(text.tokens(F.col(column))).alias("term"))
    rows = words("role", "role").unionByName(words("body", "text")).groupBy("id", "field", "term").agg(F.count("*").alias("tf"))
    asked = [r["term"] for r in words("body", "text").where(F.char_length("term") == 6).select("term").distinct().orderBy("term").limit(12).collect()]
    fields = rows.join(rows.groupBy("id", "field").agg(F.sum("tf").alias("n")), ["id", "field"])
    return fts.recall(fields, [*asked, "user"], {"role": 4, "body": 1}, 64)


@query(
    "symbols",
    """WITH p AS (SELECT id, file_path, row_number() OVER (PARTITION BY file_path ORDER BY name, id) AS place, CASE id % 3 WHEN 0 THEN 'owner' WHEN 1 THEN 'support' ELSE 'unreviewed' END AS role FROM symbols)
    SELECT *, row_number() OVER (PARTITION BY file_path, role ORDER BY place) AS place_in_role FROM p""",
)
def concept_finish(spark: SparkSession, d: str) -> DataFrame:
    """Assessments joined to the packets (one a file) that they assess: a packet's order stays, within each role as well."""
    s = symbols(spark, d)
    packet = s.select("id", "file_path", F.row_number().over(Window.partitionBy("file_path").orderBy("name", "id")).alias("place"))
    assessed = s.where("id % 3 < 2").select("id", F.when(F.col("id") % 3 == 0, "owner").otherwise("support").alias("role"))
    rows = packet.join(assessed, "id", "left").withColumn("role", F.coalesce("role", F.lit("unreviewed")))
    return rows.withColumn("place_in_role", F.row_number().over(Window.partitionBy("file_path", "role").orderBy("place")))


@query(
    "touches resolved",
    """WITH c AS (SELECT path, count(DISTINCT sha) AS commits, count(DISTINCT author) AS authors FROM touches GROUP BY path), g AS (SELECT to_file AS path, count(DISTINCT from_id) AS in_degree FROM resolved WHERE kind = 'calls' GROUP BY 1),
    r AS (SELECT split_part(path, '/', 1) AS component, path, commits + coalesce(in_degree, 0) * 2 + CASE WHEN authors < 3 THEN 10 ELSE 0 END AS risk FROM c LEFT JOIN g USING (path)),
    k AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY risk DESC, path) AS k FROM r)
    SELECT component, sum(risk)::BIGINT AS risk, count(*) AS files, string_agg(path, ',' ORDER BY k) FILTER (k <= 3) AS top FROM k GROUP BY component""",
)
def risk_report(spark: SparkSession, d: str) -> DataFrame:
    """Weighted sums of a component's files and its three riskiest."""
    c = rollup.churn(touches(spark, d))
    g = graph.file_in_degrees(symbols(spark, d), edges(spark, d)).withColumnRenamed("file_path", "path")
    risk = F.col("commits") + F.coalesce("in_degree", F.lit(0)) * 2 + F.when(F.col("authors") < 3, 10).otherwise(0)
    rows = c.join(g, "path", "left").select(paths.component(F.col("path")).alias("component"), "path", risk.alias("risk"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("component").orderBy(F.col("risk").desc(), "path")))
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", "path")))), lambda x: x["path"]), ",")
    return rows.groupBy("component").agg(F.sum("risk").alias("risk"), F.count("*").alias("files"), top.alias("top"))


BOUNDARY_SQL = "SELECT split_part(a.file_path, '/', 1) || ' -> ' || split_part(r.to_file, '/', 1) AS boundary, count(*) AS observations FROM resolved r JOIN {t} a ON a.id = r.from_id JOIN {t} b ON b.id = r.to_id WHERE split_part(a.file_path, '/', 1) <> split_part(r.to_file, '/', 1) GROUP BY 1"


@query(
    "symbols resolved",
    f"""WITH {BASE_SQL}, {HEAD_SQL}, b AS ({BOUNDARY_SQL.format(t="base")}), h AS ({BOUNDARY_SQL.format(t="head")})
    SELECT coalesce(b.boundary, h.boundary) AS boundary, CASE WHEN b.boundary IS NULL THEN 'added' WHEN h.boundary IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM b FULL JOIN h ON b.boundary = h.boundary WHERE b.observations IS DISTINCT FROM h.observations""",
)
def temporal_boundaries(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)

    def side(s: DataFrame) -> DataFrame:
        rows = graph.boundary_counts(s, e, paths.component(F.col("file_path")))
        return rows.select(F.concat("a", F.lit(" -> "), "b").alias("boundary"), "observations")

    return change.snapshot_diff(side(base(spark, d)), side(head(spark, d)), "boundary", ["observations"])


@query(
    "symbols edges",
    """WITH RECURSIVE p AS (SELECT DISTINCT a.file_path AS f, b.file_path AS t FROM edges e JOIN symbols a ON a.id = e.from_id JOIN symbols b ON b.name = e.to_name
        WHERE e.kind = 'imports' AND a.file_path <> b.file_path),
    r AS (SELECT f, t FROM p UNION SELECT r.f, p.t FROM r JOIN p ON p.f = r.t) SELECT DISTINCT f AS file_path FROM r WHERE f = t""",
)
def cycle_members(spark: SparkSession, d: str) -> DataFrame:
    """Files that lie on a cycle, whatever the cycle's size."""
    return graph.cycle_nodes(graph.imports_of(symbols(spark, d), edges(spark, d))).select(F.col("node").alias("file_path"))


@query(
    "spans",
    """SELECT 'runtime' AS source_id, 'annotation' AS kind, CASE name WHEN 'error' THEN 'error' ELSE 'note' END AS severity, file_path AS path, count(*) AS facts, count(DISTINCT span_id) AS bodies FROM spans WHERE name IN ('error', 'purchase') GROUP BY ALL""",
)
def fact_adapt(spark: SparkSession, d: str) -> DataFrame:
    """Evidence as annotations with identifiers from their content."""
    rows = spans(spark, d).where("name in ('error', 'purchase')")
    rows = rows.select(F.when(F.col("name") == "error", "error").otherwise("note").alias("severity"), F.col("file_path").alias("path"), F.lit(0).alias("line"), F.col("name").alias("rule"), F.col("span_id").cast("string").alias("message"))
    return annotations(rows, "runtime").groupBy("source_id", "kind", "severity", "path").agg(F.count("*").alias("facts"), F.count_distinct("sha256").alias("bodies"))


@query("symbols", "SELECT file_path, id, row_number() OVER (PARTITION BY file_path ORDER BY line_start, id) AS place, sum(line_end - line_start + 1) OVER (PARTITION BY file_path ORDER BY line_start, id ROWS UNBOUNDED PRECEDING)::BIGINT AS lines_so_far FROM symbols")
def budgeted_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Places and running totals that prefixes are cut by."""
    w = Window.partitionBy("file_path").orderBy("line_start", "id")
    return symbols(spark, d).select("file_path", "id", F.row_number().over(w).alias("place"), F.sum(F.col("line_end") - F.col("line_start") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("lines_so_far"))


@query("symbols edges", "WITH d AS (SELECT DISTINCT from_id AS id FROM edges WHERE kind = 'calls'), g AS (SELECT DISTINCT from_id AS id FROM edges WHERE kind = 'imports') SELECT 'both' AS part, count(*) AS symbols FROM (SELECT id FROM d INTERSECT SELECT id FROM g) UNION ALL SELECT 'calls only', count(*) FROM (SELECT id FROM d EXCEPT SELECT id FROM g) UNION ALL SELECT 'imports only', count(*) FROM (SELECT id FROM g EXCEPT SELECT id FROM d)")
def key_partition(spark: SparkSession, d: str) -> DataFrame:
    """Keys on both sides and on one only."""
    e = edges(spark, d)
    a, b = (e.where(F.col("kind") == k).select(F.col("from_id").alias("id")).distinct() for k in ("calls", "imports"))
    count = lambda part, df: df.agg(F.count("*").alias("symbols")).select(F.lit(part).alias("part"), "symbols")
    return count("both", a.intersect(b)).unionByName(count("calls only", a.subtract(b))).unionByName(count("imports only", b.subtract(a)))
