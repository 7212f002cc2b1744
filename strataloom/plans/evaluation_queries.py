"""Queries of reviewed attempts, mined habits, bounded reports and exact tests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import paths, stats
from strataloom.operators import change, evaluation, graph, mining, policies, reach, rollup, trials
from strataloom.operators.store import cut, new_folder
from strataloom.plans.bind import edges, load, suppliers, symbols, touches
from strataloom.plans.change_queries import REACH_SQL, base, changed, steps
from strataloom.plans.evidence_queries import OWNED_SQL, PAIRS_SQL, RULES_SQL, new_cycles_sql, owned
from strataloom.plans.mining_queries import TRIAL_SQL, _trials
from strataloom.plans.registry import query
from strataloom.sources import policies as policy_files

REVIEW_SQL = f"{TRIAL_SQL}, rv AS (SELECT doc_id AS answer, condition, 'a' AS reviewer, 'outcome' AS dimension, quality AS verdict FROM tr WHERE quality IS NOT NULL UNION ALL SELECT doc_id, condition, 'b', 'outcome', 1 - toxic FROM tr WHERE toxic IS NOT NULL)"


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    rows = _trials(spark, d)
    side = lambda who, verdict: rows.select(F.col("doc_id").alias("answer"), "condition", F.lit(who).alias("reviewer"), F.lit("outcome").alias("dimension"), verdict.alias("verdict")).where("verdict is not null")
    return side("a", F.col("quality")).unionByName(side("b", 1 - F.col("toxic")))


@query("", f"WITH {REVIEW_SQL} SELECT condition, dimension, verdict, count(*) AS answers FROM rv GROUP BY ALL")
def reviewer_tallies(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.tallies(_reviews(spark, d))


@query("", f"WITH {REVIEW_SQL}, p AS (SELECT answer, dimension, count(DISTINCT verdict) AS v FROM rv GROUP BY ALL HAVING count(DISTINCT reviewer) >= 2) SELECT dimension, count(*) AS compared, count(*) FILTER (v > 1) AS disagree FROM p GROUP BY 1")
def reviewer_disagreement(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.disagreement(_reviews(spark, d))


@query("", f"WITH {TRIAL_SQL}, v AS (SELECT condition, 'chars' AS metric, chars AS value, status = 'ok' AS done FROM tr UNION ALL SELECT condition, 'quality', quality, true FROM tr WHERE quality IS NOT NULL) SELECT condition, metric, count(*) AS attempts, sum(value)::BIGINT AS observed_total, count(value) AS reported, count(*) FILTER (done AND value IS NOT NULL) AS complete, CASE WHEN count(*) FILTER (done AND value IS NOT NULL) = count(*) THEN sum(value)::BIGINT END AS total, count(*) - count(*) FILTER (done AND value IS NOT NULL) AS unknown FROM v GROUP BY ALL")
def read_ledgers(spark: SparkSession, d: str) -> DataFrame:
    t = _trials(spark, d)
    rows = t.select("condition", F.lit("chars").alias("metric"), F.col("chars").alias("value"), (F.col("status") == "ok").alias("complete"))
    return evaluation.ledgers(rows.unionByName(t.where("quality is not null").select("condition", F.lit("quality").alias("metric"), F.col("quality").cast("long").alias("value"), F.lit(True).alias("complete"))))


CONTRAST_SQL = """m AS (SELECT condition, 'chars' AS metric, sum(n)::DOUBLE AS total, sum(low)::DOUBLE AS low, sum(high)::DOUBLE AS high FROM s GROUP BY ALL UNION ALL SELECT condition, 'settled', count(*)::DOUBLE, sum(low)::DOUBLE, sum(low)::DOUBLE FROM s GROUP BY ALL),
    w AS (SELECT b.metric, b.total AS bt, c.total AS ct, b.low AS bl, b.high AS bh, c.low AS cl, c.high AS ch FROM m b JOIN m c USING (metric) WHERE b.condition = 'en' AND c.condition = 'fr')"""


@query(
    "",
    f"""WITH s AS (SELECT d.lang AS condition, d.n_chars AS n, coalesce(l.quality, 0) AS low, coalesce(l.quality, 1) AS high FROM documents d LEFT JOIN labels l USING (doc_id)), {CONTRAST_SQL}
    SELECT metric, round(1 - ct / nullif(bt, 0), 9) AS savings, round(CASE WHEN bl = bh AND cl = ch AND bl > 0 AND cl > 0 THEN 1 - (ct / cl) / (bt / bl) END, 9) AS per_success_savings,
      round(CASE WHEN bl = bh AND cl = ch AND bl > 0 THEN (cl / ct) / (bl / bt) - 1 END, 9) AS yield_gain, round(CASE WHEN bl = bh AND cl = ch THEN cl / ct - bl / bt END, 12) AS yield_delta,
      round((cl / ct) / nullif(bh / bt, 0) - 1, 9) AS gain_low, round((ch / ct) / nullif(bl / bt, 0) - 1, 9) AS gain_high FROM w""",
)
def resource_contrasts(spark: SparkSession, d: str) -> DataFrame:
    """What one condition uses against another, as far as outcomes are settled."""
    docs, labels = load(spark, d, "documents"), load(spark, d, "labels")
    s = docs.join(labels, "doc_id", "left").select(F.col("lang").alias("condition"), "n_chars", F.coalesce("quality", F.lit(0)).alias("low"), F.coalesce("quality", F.lit(1)).alias("high"))
    bounds = lambda metric, total, high: s.groupBy("condition").agg(F.lit(metric).alias("metric"), total.cast("double").alias("total"), F.sum("low").cast("double").alias("low"), F.sum(high).cast("double").alias("high"))
    totals = bounds("chars", F.sum("n_chars"), "high").unionByName(bounds("settled", F.count("*"), "low"))
    found = evaluation.contrasts(totals, "en", "fr")
    return found.select("metric", *(F.round(c, 12 if c == "yield_delta" else 9).alias(c) for c in found.columns[1:]))


@query(
    "",
    """WITH p AS (SELECT a.source, coalesce(b.quality, 0) AS bl, coalesce(b.quality, 1) AS bh, coalesce(c.quality, 0) AS cl, coalesce(c.quality, 1) AS ch FROM documents a LEFT JOIN labels b USING (doc_id) LEFT JOIN labels c ON c.doc_id = a.doc_id + 1),
    g AS (SELECT source, count(*) FILTER (ch < bl) AS losses, sum(bl) AS bl, sum(bh) AS bh, sum(cl) AS cl, sum(ch) AS ch FROM p GROUP BY source)
    SELECT source, CASE WHEN losses > 0 THEN 'quality_regression' WHEN bl <> bh OR cl <> ch THEN 'unresolved_quality' WHEN cl < bl THEN 'quality_regression' WHEN bl = 0 THEN 'no_successful_baseline' WHEN cl = 0 THEN 'no_successful_candidate' ELSE 'reviewed_outcomes_preserved' END AS status FROM g""",
)
def value_gate(spark: SparkSession, d: str) -> DataFrame:
    """Each document's outcome against its successor's, by source."""
    labels = load(spark, d, "labels")
    b = labels.select("doc_id", F.col("quality").alias("b"))
    c = labels.select((F.col("doc_id") - 1).alias("doc_id"), F.col("quality").alias("c"))
    rows = load(spark, d, "documents").select("doc_id", "source").join(b, "doc_id", "left").join(c, "doc_id", "left")
    low, high = (lambda x: F.coalesce(x, F.lit(0))), (lambda x: F.coalesce(x, F.lit(1)))
    return evaluation.value_gate(rows.select("source", low("b").alias("b_low"), high("b").alias("b_high"), low("c").alias("c_low"), high("c").alias("c_high")), "source")


@query("", f"WITH {TRIAL_SQL}, c AS (SELECT condition, doc_id // 10 AS k, count(*) AS attempts, avg(chars) AS mean, CASE WHEN count(chars) = count(*) THEN sum(chars) END AS total FROM tr GROUP BY ALL) SELECT condition, count(*) AS cases, sum(attempts)::BIGINT AS attempts, round(avg(mean), 6) AS mean, CASE WHEN count(total) = count(*) THEN sum(total)::BIGINT END AS total FROM c GROUP BY 1")
def pooled_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = _trials(spark, d).select("condition", F.floor(F.col("doc_id") / 10).alias("case"), F.col("chars").alias("value"))
    return evaluation.pooled(rows).withColumn("mean", F.round("mean", 6))


@query(
    "symbols edges",
    f"""WITH RECURSIVE {PAIRS_SQL}, st AS (SELECT min(from_file) AS s FROM pairs), w AS (SELECT s AS state, 0 AS depth FROM st UNION SELECT p.to_file, w.depth + 1 FROM w JOIN pairs p ON p.from_file = w.state WHERE w.depth < 12),
    m AS (SELECT state, min(depth) AS depth FROM w GROUP BY state)
    SELECT m.state, m.depth, min(q.state) AS parent, ends_with(m.state, '.go') AS bad FROM m LEFT JOIN pairs p ON p.to_file = m.state LEFT JOIN m q ON q.state = p.from_file AND q.depth = m.depth - 1 GROUP BY ALL""",
)
def state_search(spark: SparkSession, d: str) -> DataFrame:
    """States that imports lead to from the first file, each with the way back."""
    steps = graph.imports_of(symbols(spark, d), edges(spark, d))
    starts = graph.importers(steps).agg(F.min("file").alias("state"))
    return evaluation.reachable(starts, steps, suppliers(spark, d).where("file_path like '%.go'").select(F.col("file_path").alias("state")))


LINES_SQL = "l AS (SELECT doc_id AS sha, unnest(string_split(text, chr(10))) AS line FROM documents)"
STYLES_SQL = " UNION ALL ".join("SELECT sha, '" + k + "' AS predicate, " + ", ".join(f"count(*) FILTER (regexp_matches(line, '{p.replace(chr(39), chr(39) * 2)}')) AS {side}" for p, side in zip(pair, ("yes", "no"))) + " FROM l GROUP BY sha" for k, pair in mining.STYLE.items())
VOTED_SQL = "SELECT predicate, CASE WHEN count(*) FILTER (yes > no) >= count(*) FILTER (no > yes) THEN 'yes' ELSE 'no' END AS claims, count(*) AS eligible, greatest(count(*) FILTER (yes > no), count(*) FILTER (no > yes)) AS agree FROM v WHERE yes + no > 0 GROUP BY predicate"


@query("", f"WITH {LINES_SQL}, v AS ({STYLES_SQL}) {VOTED_SQL}")
def style_detectors(spark: SparkSession, d: str) -> DataFrame:
    """Seven claims on the style of lines, voted by commit."""
    lines = load(spark, d, "documents").select(F.col("doc_id").alias("sha"), F.explode(F.split("text", "\n")).alias("line"))
    return trials.commit_votes(mining.style_tallies(lines)).select("predicate", "claims", "eligible", "agree")


@query(
    "",
    f"""WITH s AS (SELECT conv_id || '/' || turn AS sha, split_part(text, '.', 1) || CASE WHEN turn % 2 = 0 THEN '.' ELSE '' END AS subject, CASE WHEN contains(text, '. ') THEN text ELSE '' END AS body FROM conversations),
    v AS (SELECT sha, 'subject_imperative' AS predicate, CASE WHEN regexp_matches(lower(string_split_regex(subject, '\\s+')[1]), '(ed|ing)$') THEN 0 ELSE 1 END AS yes, 1 - yes AS no FROM s
      UNION ALL SELECT sha, 'subject_plain', CASE WHEN NOT ends_with(subject, '.') AND length(subject) <= 72 THEN 1 ELSE 0 END AS y, 1 - y FROM s UNION ALL SELECT sha, 'body', CASE WHEN length(trim(body)) > 0 THEN 1 ELSE 0 END AS y, 1 - y FROM s) {VOTED_SQL}""",
)
def subject_detectors(spark: SparkSession, d: str) -> DataFrame:
    """Claims on subjects and bodies."""
    c = load(spark, d, "conversations")
    subject = F.concat(F.split_part("text", F.lit("."), F.lit(1)), F.when(F.col("turn") % 2 == 0, ".").otherwise(""))
    rows = c.select(F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("sha"), subject.alias("subject"), F.when(F.col("text").contains(". "), F.col("text")).otherwise("").alias("body"))
    return trials.commit_votes(mining.subject_tallies(rows)).select("predicate", "claims", "eligible", "agree")


@query(
    "touches",
    """WITH c AS (SELECT sha, max("at") AS "at", sum(added)::BIGINT AS added FROM touches GROUP BY sha), r AS (SELECT *, strftime("at", '%Y-%m') AS month FROM c WHERE added BETWEEN 1 AND 2000),
    t AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY "at" DESC, sha) AS turn FROM r) SELECT sha, month, turn, added FROM t ORDER BY turn, month DESC LIMIT 400""",
)
def commit_sample(spark: SparkSession, d: str) -> DataFrame:
    """The commits that style is read from."""
    commits = touches(spark, d).groupBy("sha").agg(F.max("at").alias("at"), F.sum("added").alias("added"))
    return mining.sample(commits).select("sha", "month", "turn", "added")


SAID = ["i prefer ", "I normally review ", "from now on, plan ", "the ", "My default is code ", "do you test ", "going forward, ", "i value answers and "]
SAID_SQL = f"[{', '.join(repr(x) for x in SAID)}]"


@query(
    "",
    f"""WITH s AS (SELECT conv_id, turn, {SAID_SQL}[(conv_id + turn) % {len(SAID)} + 1] || text AS said FROM conversations WHERE role = 'user'),
    k AS (SELECT conv_id, turn, said, lower(trim(said)) AS low FROM s WHERE length(trim(said)) BETWEEN 8 AND 300 AND NOT regexp_matches(said, '[\\p{{Cc}}?]') AND NOT regexp_matches(said, '(?i)\\b(password|passwd|secret|token|api_key)\\s*[=:]\\s*["''][^"''\\s]{{8,}}["'']'))
    SELECT * FROM (SELECT conv_id, turn, CASE {" ".join(f"WHEN regexp_matches(low, '^({'|'.join(c)})') THEN '{n}'" for n, c in mining.CUES.items())} END AS kind FROM k
      WHERE regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}])({'|'.join(mining.WORK)})')) WHERE kind IS NOT NULL""",
)
def statement_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Explicit statements among what users said, by kind; the beginnings are made, as the talk is."""
    begin = F.element_at(F.array(*map(F.lit, SAID)), ((F.col("conv_id") + F.col("turn")) % len(SAID) + 1).cast("int"))
    rows = load(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(begin, "text").alias("said"))
    return rows.select("conv_id", "turn", mining.statement_kind(F.col("said")).alias("kind")).where("kind is not null")


@query("", r"SELECT doc_id, regexp_replace(chr(8238) || source || chr(7) || lang || chr(8295), '[\p{Cc}\x{061c}\x{200e}\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}]', '', 'g') AS shown FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def display_safety(spark: SparkSession, d: str) -> DataFrame:
    """Names with characters that turn text around or ring a bell, as they are shown."""
    rows = load(spark, d, "documents").where("lang is not null and source is not null")
    return rows.select("doc_id", mining.shown(F.concat(F.lit("\u202e"), "source", F.lit("\x07"), "lang", F.lit("\u2067"))).alias("shown"))


@query("symbols", "SELECT kind, count(*) FILTER (id % 10 = 0) AS tests, count(*) FILTER (NOT starts_with(file_path, 'asia/')) AS production FROM symbols GROUP BY kind")
def test_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Tests by mark, and code that is none; what only surrounds tests does not count."""
    marks = F.when(F.col("id") % 10 == 0, ",test,").when(F.col("id") % 10 == 1, ",test,fixture,").otherwise("")
    path = F.regexp_replace("file_path", "^asia/", "tests/")
    rows = symbols(spark, d).select("kind", mining.test_symbol(F.col("name"), marks, paths.test_like(path)).alias("is_test"), paths.production(path).alias("production"))
    return rows.groupBy("kind").agg(F.count_if("is_test").alias("tests"), F.count_if("production").alias("production"))


@query("symbols resolved", REACH_SQL + ", n AS (SELECT id, min(depth) AS depth FROM reach WHERE id NOT IN (SELECT id FROM changed) GROUP BY id), c AS (SELECT count(*) AS k FROM changed) SELECT CASE WHEN k <= 100000 THEN k END AS seeds, (SELECT count(*) FROM n) AS impacted, (SELECT count(DISTINCT split_part(file_path, '/', 1)) FROM n JOIN symbols USING (id)) AS components, (SELECT max(depth) FROM n) AS deepest, NULL::VARCHAR AS truncation_reason FROM c")
def bounded_impact(spark: SparkSession, d: str) -> DataFrame:
    """A change's impact under caps that it stays below."""
    return change.bounded_impact(symbols(spark, d), edges(spark, d), changed(spark, d), seed_cap=100_000, row_cap=1_000_000)


@query("", "SELECT NULL::BIGINT AS seeds, NULL::BIGINT AS impacted, NULL::BIGINT AS components, NULL::INTEGER AS deepest, 'seed_work_limit' AS truncation_reason")
def seed_work_limit(spark: SparkSession, d: str) -> DataFrame:
    """A change of every symbol is beyond the cap: its totals are unknown, not partial."""
    s = symbols(spark, d)
    return change.bounded_impact(s, edges(spark, d), s, seed_cap=100)


@query(
    "symbols resolved",
    REACH_SQL
    + """, t AS (SELECT DISTINCT s.file_path AS path FROM reach r JOIN symbols s USING (id)), c AS (SELECT DISTINCT s.file_path AS path FROM changed JOIN symbols s USING (id)),
    a AS (SELECT path, 'trace' AS origin, 0 AS k FROM t UNION ALL SELECT path, 'changed', 1 FROM c WHERE path NOT IN (SELECT path FROM t)) SELECT path, origin, (SELECT count(*) FROM a) > 50 AS truncated FROM a ORDER BY k, path LIMIT 50""",
)
def relevant_paths(spark: SparkSession, d: str) -> DataFrame:
    """Files that evidence is asked for, the reached ones first, under a cap of fifty."""
    files = symbols(spark, d).select("id", F.col("file_path").alias("path"))
    return rollup.relevant_paths(reach.others_of_all(steps(spark, d), changed(spark, d)).join(files, "id"), changed(spark, d).join(files, "id"), 50)


@query(
    "symbols edges",
    f"""WITH {RULES_SQL}, {OWNED_SQL}, {PAIRS_SQL}, d AS (SELECT 'dependency' AS rule, 'violation' AS code, from_file || ' -> ' || to_file AS subject FROM pairs WHERE starts_with(from_file, 'asia/') AND regexp_matches(to_file, '^europe/[^/]+/s[^/]*\\.rs$')),
    s AS (SELECT 'strict_workflow' AS rule, 'violation' AS code, file_path AS subject FROM files WHERE regexp_matches(file_path, '^america/.*$') AND suppkey % 3 <> 0),
    b AS (SELECT 'ownership_boundary' AS rule, 'violation' AS code, from_file || ' -> ' || to_file AS subject FROM pairs JOIN owned a ON a.path = from_file JOIN owned b ON b.path = to_file WHERE a.owners <> '' AND b.owners <> '' AND NOT list_has_any(string_split(a.owners, ','), string_split(b.owners, ','))),
    u AS (SELECT DISTINCT 'ownership_boundary' AS rule, 'owner_unknown' AS code, path AS subject FROM (SELECT from_file AS path FROM pairs UNION SELECT to_file FROM pairs) WHERE path NOT IN (SELECT path FROM owned WHERE owners <> '')),
    e AS (SELECT * FROM d UNION ALL SELECT * FROM s UNION ALL SELECT * FROM b UNION ALL SELECT * FROM u), n AS (SELECT count(*) AS n FROM e),
    f AS (SELECT * FROM (SELECT * FROM e ORDER BY rule, code, subject LIMIT (SELECT CASE WHEN n > 1000 THEN 999 ELSE 1000 END FROM n)) UNION ALL SELECT '~report', 'policy_result_limit', '1000 results' FROM n WHERE n > 1000)
    SELECT rule, code, subject, NOT EXISTS (SELECT 1 FROM f WHERE code <> 'violation') AS complete, (SELECT n = 0 FROM n) AS passed FROM f""",
)
def policy_report(spark: SparkSession, d: str) -> DataFrame:
    """All rules in one bounded report; what cannot be judged is a diagnostic."""
    imports, own, files = graph.imports_of(symbols(spark, d), edges(spark, d)), owned(spark, d), suppliers(spark, d)
    held = files.where("suppkey % 3 = 0").select(F.col("file_path").alias("path"))
    found = [rollup.dependency_rule(imports, "asia/**", "europe/*/s*.rs"), rollup.strict_rule(files.select(F.col("file_path").alias("path")), "america/**", held), rollup.boundary_rule(imports, own)]
    return rollup.report(found, [rollup.unowned_sides(imports, own)])


POLICY = """
version: 1
rules:
  - id: east-west  # no way from one to the other
    from: "asia/**"
    deny_imports: "europe/*/s*.rs"
  - id: radius
    scope: "africa/**"
    max_blast_radius: 10
  - id: cycles
    scope: "america/**"
    max_new_cycles: 0
  - id: tests
    scope: "middle_east/**"
    require_tests: true
  - id: held
    critical: "europe/**"
    require_workflow: strict
  - id: owner
    when: api_surface_changed
    scope: "asia/nation_1?/*"
    require_owner: rustlers
"""


@query(
    "symbols edges resolved files",
    REACH_SQL
    + f""", {RULES_SQL}, {OWNED_SQL}, {PAIRS_SQL}, cf AS (SELECT DISTINCT s.file_path AS path FROM changed JOIN symbols s USING (id)),
    bp AS (SELECT DISTINCT a.file_path AS from_file, b.file_path AS to_file FROM edges e JOIN base a ON a.id = e.from_id JOIN base b ON b.name = e.to_name WHERE e.kind = 'imports' AND a.file_path <> b.file_path),
    {new_cycles_sql('pairs', 'bp', 'cf')}, nc AS (SELECT count(*) AS n FROM fresh WHERE len(list_filter(m, lambda x: starts_with(x, 'america/'))) > 0),
    br AS (SELECT count(DISTINCT (s.file_path, s.line_start, s.name)) AS n FROM reach r JOIN symbols f ON f.id = r.seed AND starts_with(f.file_path, 'africa/') JOIN symbols s ON s.id = r.id),
    su AS (SELECT DISTINCT s.file_path, s.name FROM resolved r JOIN symbols s ON s.id = r.to_id JOIN symbols f ON f.id = r.from_id WHERE starts_with(s.file_path, 'asia/') AND NOT starts_with(f.file_path, 'asia/')),
    e AS (SELECT 'east-west' AS rule, from_file || ' -> ' || to_file AS subject FROM pairs WHERE starts_with(from_file, 'asia/') AND regexp_matches(to_file, '^europe/[^/]+/s[^/]*\\.rs$') AND from_file IN (SELECT path FROM cf)
      UNION ALL SELECT 'cycles', n || ' new cycles' FROM nc WHERE n > 0 UNION ALL SELECT 'radius', n || ' impacted' FROM br WHERE n > 10
      UNION ALL SELECT 'tests', path FROM cf WHERE starts_with(path, 'middle_east/') AND path NOT IN (SELECT file_path FROM symbols WHERE kind = 'trait')
      UNION ALL SELECT 'held', path FROM cf WHERE starts_with(path, 'europe/') AND path NOT IN (SELECT file_path FROM files WHERE suppkey % 3 = 0)
      UNION ALL SELECT 'owner', file_path || ' -> ' || name FROM su WHERE regexp_matches(file_path, '^asia/nation_1[^/]/[^/]*$') AND file_path NOT IN (SELECT path FROM owned WHERE list_contains(string_split(owners, ','), 'rustlers'))),
    k AS (SELECT count(*) AS n FROM e), r AS (SELECT * FROM (SELECT rule, 'violation' AS code, subject FROM e ORDER BY rule, code, subject LIMIT (SELECT CASE WHEN n > 1000 THEN 999 ELSE 1000 END FROM k)) UNION ALL SELECT '~report', 'policy_result_limit', '1000 results' FROM k WHERE n > 1000)
    SELECT *, (SELECT n <= 1000 FROM k) AS complete, (SELECT n = 0 FROM k) AS passed FROM r""",
)
def policy_file(spark: SparkSession, d: str) -> DataFrame:
    """A policy file read and held against the change between two snapshots."""
    folder = new_folder(spark, "policy")
    spark.createDataFrame([(POLICY,)], "value string").coalesce(1).write.text(folder)
    s, e, files = symbols(spark, d), edges(spark, d), suppliers(spark, d)
    moved = s.select("id", F.col("file_path").alias("path")).join(changed(spark, d), "id", "left_semi").select("path").distinct()
    surface = graph.api_surface(s, e, "asia/").select("file_path", "name").distinct()
    tested = s.where("kind = 'trait'").select(F.col("file_path").alias("path")).distinct()
    held = files.where("suppkey % 3 = 0").select(F.col("file_path").alias("path"))
    seen, by = cut(changed(spark, d), "changed"), steps(spark, d)
    spread = lambda seeds: reach.others_of_all(by, seeds.join(seen, "id", "left_semi")).select("id")
    return policies.evaluate(policy_files.read(spark, folder), graph.imports_of(s, e), graph.imports_of(base(spark, d), e), surface, spread, s, moved, tested, owned(spark, d), held)


def _exact(rows: DataFrame, schema: str, run) -> DataFrame:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame([run(r) for r in part.itertuples(index=False)], columns=[c.split()[0] for c in schema.split(", ")])

    return rows.mapInPandas(each, schema)


@query(
    "",
    f"""WITH {TRIAL_SQL}, t AS (SELECT condition, count(*) FILTER (quality = 1 AND toxic = 1) AS a, count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c, count(*) FILTER (quality = 0 AND toxic = 0) AS d FROM tr GROUP BY 1),
    x AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS k FROM t), p AS (SELECT *, lgamma(a + b + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) + lgamma(c + d + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1) AS w FROM x),
    q AS (SELECT *, exp(w - max(w) OVER (PARTITION BY condition)) AS e FROM p), s AS (SELECT condition, max(e) FILTER (k = a) AS seen, sum(e) AS every FROM q GROUP BY 1)
    SELECT condition, round(least(1, sum(e) FILTER (e <= seen * (1 + 1e-7)) / max(every)), 7) AS p FROM q JOIN s USING (condition) GROUP BY condition""",
)
def fisher_exact(spark: SparkSession, d: str) -> DataFrame:
    """Whether two verdicts go together, by language."""
    hit = lambda q, t: F.count_if((F.col("quality") == q) & (F.col("toxic") == t))
    rows = _trials(spark, d).groupBy("condition").agg(hit(1, 1).alias("a"), hit(1, 0).alias("b"), hit(0, 1).alias("c"), hit(0, 0).alias("d"))
    return _exact(rows, "condition string, p double", lambda r: (r.condition, round(stats.fisher_two_sided(r.a, r.b, r.c, r.d), 7)))


@query(
    "",
    f"""WITH {TRIAL_SQL}, v AS (SELECT condition, doc_id % 8 AS k, sum(quality) - sum(toxic) AS x FROM tr WHERE quality IS NOT NULL GROUP BY ALL), l AS (SELECT condition, list(x::DOUBLE ORDER BY k) AS xs FROM v GROUP BY 1 HAVING count(*) BETWEEN 2 AND 16),
    m AS (SELECT condition, xs, unnest(range(0, (2 ** len(xs))::BIGINT)) AS mask FROM l), s AS (SELECT condition, abs(list_sum(xs)) AS seen, abs(list_sum(list_transform(range(1, len(xs) + 1), lambda i: CASE WHEN (mask >> (i - 1)::INTEGER) & 1 = 1 THEN xs[i] ELSE -xs[i] END))) AS flipped FROM m)
    SELECT condition, round(avg((flipped >= seen - 1e-9)::INT), 9) AS p FROM s GROUP BY 1""",
)
def sign_flips(spark: SparkSession, d: str) -> DataFrame:
    """Differences of eight groups under all changes of sign."""
    v = _trials(spark, d).where("quality is not null").groupBy("condition", (F.col("doc_id") % 8).alias("k")).agg((F.sum("quality") - F.sum("toxic")).cast("double").alias("x"))
    rows = v.groupBy("condition").agg(F.collect_list("x").alias("xs")).where("size(xs) between 2 and 16")
    return _exact(rows, "condition string, p double", lambda r: (r.condition, round(stats.sign_flip(list(r.xs)), 9)))


@query("symbols", "SELECT id, to_json({id: id, name: name, kind: kind, parent: parent_id}) AS line FROM symbols WHERE parent_id IS NOT NULL")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Rows as the lines of an export."""
    return symbols(spark, d).where("parent_id is not null").select("id", F.to_json(F.struct("id", "name", "kind", F.col("parent_id").alias("parent"))).alias("line"))


@query("files", "SELECT suppkey, file_path AS path, split_part(file_path, '/', 1) || '/' || split_part(file_path, '/', 2) AS component FROM files WHERE suppkey % 4 <> 3 UNION ALL SELECT suppkey, NULL, NULL FROM files WHERE suppkey % 4 = 3")
def normal_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths out of URIs, of other systems, with steps in place; one that climbs out is none."""
    k = F.col("suppkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("file:///"), F.regexp_replace("file_path", "/", "%2F"))).when(k == 1, F.concat(F.lit("C:\\"), F.regexp_replace("file_path", "/", "\\\\"))).when(k == 2, F.concat(F.lit("./"), F.regexp_replace("file_path", "/", "/./"))).otherwise(F.concat(F.lit("a/../"), "file_path"))
    rows = suppliers(spark, d).select("suppkey", paths.normal_path(raw).alias("path"))
    return rows.select("suppkey", "path", paths.component_at(F.col("path"), 2).alias("component"))
