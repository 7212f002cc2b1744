"""Queries of commit mining, statistics and trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import paths, stats
from strataloom.operators import trials
from strataloom.plans.bind import load, symbols, touches
from strataloom.plans.registry import query

WILSON = "(a / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((a / n * (1 - a / n) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n)"
VOTES_SQL = "t AS (SELECT l_orderkey AS sha, l_returnflag AS predicate, sum(CASE WHEN l_quantity > 20 THEN 1 ELSE 0 END) AS yes, sum(CASE WHEN l_quantity <= 20 THEN 1 ELSE 0 END) AS no FROM lineitem GROUP BY ALL), v AS (SELECT predicate, count(*)::DOUBLE AS n, greatest(count(*) FILTER (yes > no), count(*) FILTER (no > yes))::DOUBLE AS a, CASE WHEN count(*) FILTER (yes > no) >= count(*) FILTER (no > yes) THEN 'yes' ELSE 'no' END AS claims FROM t GROUP BY predicate)"


@query("", f"WITH {VOTES_SQL} SELECT predicate, claims, n::BIGINT AS eligible, a::BIGINT AS agree, round({WILSON}, 9) AS low, CASE WHEN n >= 8 AND {WILSON} >= 0.8 THEN 'high' WHEN n >= 8 AND {WILSON} >= 0.6 THEN 'medium' ELSE 'none' END AS gate FROM v")
def commit_votes(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem")
    yes = (F.col("l_quantity") > 20).cast("int")
    return trials.commit_votes(li.select(F.col("l_orderkey").alias("sha"), F.col("l_returnflag").alias("predicate"), yes.alias("yes"), (1 - yes).alias("no")))


@query("touches", "SELECT sha, count(DISTINCT path) AS files, sum(added)::BIGINT AS added, count(DISTINCT path) FILTER (path LIKE '%.py') AS python, count(DISTINCT path) FILTER (path NOT LIKE '%.py') AS other FROM touches GROUP BY sha")
def commit_shape(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path").endswith(".py")
    return touches(spark, d).groupBy("sha").agg(F.count_distinct("path").alias("files"), F.sum("added").alias("added"), F.count_distinct(F.when(p, F.col("path"))).alias("python"), F.count_distinct(F.when(~p, F.col("path"))).alias("other"))


@query("", r"SELECT o_orderkey, regexp_extract(s, '\(#(\d+)\)$', 1) AS squash, regexp_extract(s, '\b([A-Z]{2,}-\d+)\b', 1) AS tracker, starts_with(s, 'Revert ') AS reverted FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Revert ' ELSE '' END || o_orderpriority || ' KEY-' || o_custkey || CASE o_orderkey % 2 WHEN 0 THEN ' (#' || o_orderkey || ')' ELSE '' END AS s FROM orders)")
def subject_parse(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    s = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "Revert ").otherwise(""), F.col("o_orderpriority"), F.lit(" KEY-"), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" (#"), F.col("o_orderkey").cast("string"), F.lit(")"))).otherwise(""))
    return o.select("o_orderkey", F.regexp_extract(s, r"\(#(\d+)\)$", 1).alias("squash"), F.regexp_extract(s, r"\b([A-Z]{2,}-\d+)\b", 1).alias("tracker"), s.startswith("Revert ").alias("reverted"))


@query("", "SELECT o_orderpriority, quantile_disc(o_totalprice, 0.5) AS p50, quantile_disc(o_totalprice, 0.9) AS p90 FROM orders GROUP BY 1")
def percentile_nearest(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").groupBy("o_orderpriority").agg(F.expr("percentile_disc(0.5) within group (order by o_totalprice)").alias("p50"), F.expr("percentile_disc(0.9) within group (order by o_totalprice)").alias("p90"))


@query("", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(quantile_cont(o_totalprice, 0.95), 6) AS p95 FROM orders GROUP BY 1")
def quantile_linear(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.percentile("o_totalprice", 0.5), 6).alias("p50"), F.round(F.percentile("o_totalprice", 0.95), 6).alias("p95"))


@query(
    "touches",
    """WITH m AS (SELECT max("at") AS last FROM touches) SELECT regexp_extract(path, '\\.([a-z]+)$', 1) AS language, count(DISTINCT sha) AS commits,
    count(DISTINCT sha) FILTER (date_diff('day', "at"::DATE, last::DATE) <= 183) AS recent, strftime(max("at"), '%Y-%m-%d') AS last FROM touches, m GROUP BY 1""",
)
def language_range(spark: SparkSession, d: str) -> DataFrame:
    """Commits by language, and those in the 183 days before the newest."""
    t = touches(spark, d)
    newest = t.agg(F.max("at")).collect()[0][0]
    near = F.datediff(F.lit(newest).cast("date"), F.col("at").cast("date")) <= 183
    return t.groupBy(paths.extension(F.col("path")).alias("language")).agg(F.count_distinct("sha").alias("commits"), F.count_distinct(F.when(near, F.col("sha"))).alias("recent"), F.date_format(F.max("at"), "yyyy-MM-dd").alias("last"))


@query("touches", "WITH p AS (SELECT DISTINCT sha, split_part(path, '/', 1) AS area, regexp_extract(path, '\\.([a-z]+)$', 1) AS library FROM touches) SELECT area, library, count(DISTINCT sha) AS commits FROM p GROUP BY ALL")
def co_occurrence(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d).select("sha", paths.component(F.col("path")).alias("area"), paths.extension(F.col("path")).alias("library")).distinct()
    return t.groupBy("area", "library").agg(F.count_distinct("sha").alias("commits"))


TRIAL_SQL = "tr AS (SELECT d.doc_id, lang AS condition, l.quality, l.toxic, CASE WHEN d.doc_id % 9 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN d.doc_id % 7 <> 0 OR lang <> 'en' THEN n_chars END AS chars FROM documents d LEFT JOIN labels l USING (doc_id))"


def _trials(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = load(spark, d, "documents"), load(spark, d, "labels")
    chars = F.when((F.col("doc_id") % 7 != 0) | (F.col("lang") != "en"), F.col("n_chars"))
    return docs.join(labels, "doc_id", "left").select("doc_id", F.col("lang").alias("condition"), "quality", "toxic", F.when(F.col("doc_id") % 9 == 0, "error").otherwise("ok").alias("status"), chars.alias("chars"))


@query("", f"WITH {TRIAL_SQL} SELECT condition, count(*) AS attempts, CASE WHEN count(chars) = count(*) THEN sum(chars)::BIGINT END AS chars FROM tr GROUP BY condition")
def attempt_totals(spark: SparkSession, d: str) -> DataFrame:
    return trials.complete_totals(_trials(spark, d), "condition", ["chars"])


@query("", f"WITH {TRIAL_SQL} SELECT condition, count(*) AS attempts, sum(CASE WHEN status <> 'ok' THEN 0 ELSE coalesce(quality, 0) END)::BIGINT AS low, sum(CASE WHEN status <> 'ok' THEN 0 ELSE coalesce(quality, 1) END)::BIGINT AS high FROM tr GROUP BY condition")
def success_bounds(spark: SparkSession, d: str) -> DataFrame:
    return trials.outcome_bounds(_trials(spark, d).withColumn("success", F.col("quality")), "condition")


@query("", f"WITH {TRIAL_SQL}, r AS (SELECT doc_id // 4 AS repetition, max(quality) FILTER (condition = 'en') AS b, max(quality) FILTER (condition = 'fr') AS c FROM tr GROUP BY 1) SELECT count(*) FILTER (c > b) AS wins, count(*) FILTER (c = b) AS ties, count(*) FILTER (c < b) AS losses, count(*) FILTER (b IS NULL OR c IS NULL) AS unpaired FROM r")
def paired_outcomes(spark: SparkSession, d: str) -> DataFrame:
    rows = _trials(spark, d).select(F.floor(F.col("doc_id") / 4).alias("repetition"), "condition", F.col("quality").alias("outcome"))
    return trials.paired(rows, "en", "fr")


@query(
    "",
    f"""WITH {TRIAL_SQL}, k AS (SELECT doc_id % 50 AS query, condition AS split, row_number() OVER (PARTITION BY doc_id % 50, condition ORDER BY doc_id) AS rank, coalesce(toxic, 0) = 1 AS relevant FROM tr),
    p AS (SELECT query, split, max(CASE WHEN relevant AND rank <= 5 THEN 1 ELSE 0 END) AS hit, count(*) FILTER (relevant AND rank <= 5) AS found, count(*) FILTER (relevant) AS a, min(rank) FILTER (relevant) AS first FROM k GROUP BY ALL)
    SELECT split, count(*) AS queries, sum(hit)::BIGINT AS hit, round(avg(CASE WHEN a > 0 THEN found / a END), 9) AS recall, min(first) AS first_rank FROM p GROUP BY split""",
)
def hit_at_k(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = _trials(spark, d).select((F.col("doc_id") % 50).alias("query"), F.col("condition").alias("split"), "doc_id", (F.coalesce("toxic", F.lit(0)) == 1).alias("relevant"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query", "split").orderBy("doc_id")))
    return trials.hit_at(ranked, 5)


@query("", f"""WITH {TRIAL_SQL}, m AS (SELECT condition, doc_id % 20 AS c, avg(toxic) AS m FROM tr GROUP BY ALL) SELECT condition, count(m) AS clusters, round(avg(m), 9) AS mean, round(CASE WHEN count(m) >= 2 THEN stddev_samp(m) / sqrt(count(m)) END, 9) AS error,
    round(avg(m) - 2.093 * CASE WHEN count(m) >= 2 THEN stddev_samp(m) / sqrt(count(m)) END, 9) AS lower, round(avg(m) + 2.093 * CASE WHEN count(m) >= 2 THEN stddev_samp(m) / sqrt(count(m)) END, 9) AS upper FROM m WHERE m IS NOT NULL GROUP BY condition""")
def cluster_estimate(spark: SparkSession, d: str) -> DataFrame:
    rows = _trials(spark, d).where("toxic is not null").withColumn("c", F.col("doc_id") % 20)
    return trials.cluster_estimate(rows, ["condition"], "c", "toxic", 2.093).select("condition", "clusters", *(F.round(c, 9).alias(c) for c in ("mean", "error", "lower", "upper")))


@query(
    "",
    """WITH o AS (SELECT o_orderpriority, o_custkey % 40 AS task, o_custkey % 8 AS cluster, o_orderkey % 2 AS arm, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM orders),
    p AS (SELECT o_orderpriority, task, cluster, avg(ln(v)) FILTER (arm = 1 AND v > 0) - avg(ln(v)) FILTER (arm = 0 AND v > 0) AS r, count(*) FILTER (arm = 0 AND coalesce(v, 0) <= 0) AS ub, count(*) FILTER (arm = 1 AND coalesce(v, 0) <= 0) AS uc FROM o GROUP BY ALL),
    s AS (SELECT o_orderpriority, bool_and(r IS NOT NULL) AS whole, sum(ub)::BIGINT AS ub, sum(uc)::BIGINT AS uc FROM p GROUP BY 1),
    c AS (SELECT o_orderpriority, cluster, avg(r) AS m FROM p WHERE r IS NOT NULL GROUP BY ALL), e AS (SELECT o_orderpriority, avg(m) AS mean, stddev_samp(m) / sqrt(count(*)) AS error FROM c GROUP BY 1)
    SELECT o_orderpriority, CASE WHEN whole AND greatest(ub, uc) <= 1000000 THEN 'measured' ELSE 'unknown' END AS status, ub AS unknown_baseline, uc AS unknown_candidate,
      round(CASE WHEN whole THEN exp(mean) END, 9) AS ratio, round(CASE WHEN whole THEN exp(mean + 2.365 * error) END, 9) AS upper FROM s LEFT JOIN e USING (o_orderpriority)""",
)
def log_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Ratio of what two arms of each task use; an order still open has unknown usage."""
    o = load(spark, d, "orders")
    arm = F.when(F.col("o_orderkey") % 2 == 0, "baseline").otherwise("candidate")
    rows = o.select("o_orderpriority", (F.col("o_custkey") % 40).alias("task"), (F.col("o_custkey") % 8).alias("cluster"), arm.alias("arm"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("value"))
    found = trials.log_ratio(rows, "o_orderpriority", 2.365, 1_000_000)
    return found.withColumn("ratio", F.round("ratio", 9)).withColumn("upper", F.round("upper", 9))


@query(
    "",
    f"""WITH {TRIAL_SQL}, j AS (SELECT condition, quality = 1 AS control, CASE quality WHEN 1 THEN 'satisfied' ELSE 'unsatisfied' END AS e, CASE WHEN chars IS NULL THEN NULL WHEN status = 'error' THEN 'unknown' WHEN toxic = 0 THEN 'satisfied' ELSE 'unsatisfied' END AS v FROM tr WHERE quality IS NOT NULL),
    p AS (SELECT condition, o, (avg((v = o)::INT) + avg((e = o)::INT)) / 2 AS s FROM j, (VALUES ('satisfied'), ('unsatisfied'), ('unknown')) x(o) WHERE v IS NOT NULL GROUP BY ALL), c AS (SELECT condition, sum(s * (1 - s)) / 2 AS chance FROM p GROUP BY condition),
    a AS (SELECT condition, count(*) AS answers, count(*) FILTER (v IS NULL) AS unresolved, avg((v = e)::INT) AS same, count(*) FILTER (control AND v = 'satisfied') AS ok, count(*) FILTER (NOT control AND v = 'unsatisfied') AS got,
      count(*) FILTER (control) AS n1, count(*) FILTER (NOT control) AS n0, count(*) FILTER (control AND v IS NOT NULL) AS r1, count(*) FILTER (NOT control AND v IS NOT NULL) AS r0 FROM j GROUP BY condition)
    SELECT condition, answers, unresolved, round(ok / nullif(r1, 0), 9) AS sensitivity, round(got / nullif(r0, 0), 9) AS specificity, round(ok / nullif(n1, 0), 9) AS sensitivity_worst, round(got / nullif(n0, 0), 9) AS specificity_worst,
      round(CASE WHEN chance < 1 THEN (same - chance) / (1 - chance) END, 9) AS ac1, round(ok / nullif(r1, 0) + got / nullif(r0, 0) - 1, 9) AS youden, round(ok / nullif(n1, 0) + got / nullif(n0, 0) - 1, 9) AS youden_worst FROM a LEFT JOIN c USING (condition)""",
)
def judge_agreement(spark: SparkSession, d: str) -> DataFrame:
    verdict = F.when(F.col("chars").isNull(), None).when(F.col("status") == "error", "unknown").when(F.col("toxic") == 0, "satisfied").otherwise("unsatisfied")
    expected = F.when(F.col("quality") == 1, "satisfied").otherwise("unsatisfied")
    rows = _trials(spark, d).where("quality is not null").select("condition", (F.col("quality") == 1).alias("control"), expected.alias("expected"), verdict.alias("judged"))
    found = trials.agreement(rows, "condition")
    return found.select("condition", "answers", "unresolved", *(F.round(c, 9).alias(c) for c in ("sensitivity", "specificity", "sensitivity_worst", "specificity_worst", "ac1", "youden", "youden_worst")))


@query("", f"WITH {TRIAL_SQL} SELECT quality, count(*) FILTER (toxic = 0) AS toxic_0, count(*) FILTER (toxic = 1) AS toxic_1 FROM tr WHERE quality IS NOT NULL GROUP BY quality")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    wide = _trials(spark, d).where("quality is not null").groupBy("quality").pivot("toxic", [0, 1]).agg(F.count(F.lit(1)))
    return wide.select("quality", F.coalesce("0", F.lit(0)).alias("toxic_0"), F.coalesce("1", F.lit(0)).alias("toxic_1"))


@query("", f"WITH {VOTES_SQL} SELECT predicate, round({WILSON}, 9) AS low, round((a / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt((a / n * (1 - a / n) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n), 9) AS high FROM v")
def wilson_interval(spark: SparkSession, d: str) -> DataFrame:
    v = commit_votes(spark, d)
    return v.select("predicate", F.round(stats.wilson_low(F.col("agree"), F.col("eligible")), 9).alias("low"), F.round(stats.wilson_high(F.col("agree"), F.col("eligible")), 9).alias("high"))


def _exact_sql() -> str:
    """The tail as a sum of binomial terms, and the bound by halving an interval, one step of which is one relation."""
    term = "exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p}))"
    parts = ["h AS (SELECT condition, sum(toxic)::BIGINT AS hits, count(*) AS n FROM tr WHERE toxic IS NOT NULL GROUP BY condition)", "s0 AS (SELECT *, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM h)"]
    for k in range(1, 41):
        parts.append(f"s{k} AS MATERIALIZED (SELECT condition, hits, n, CASE WHEN sum({term.format(p='((lo + hi) / 2)')}) < 0.05 THEN (lo + hi) / 2 ELSE lo END AS lo, CASE WHEN sum({term.format(p='((lo + hi) / 2)')}) < 0.05 THEN hi ELSE (lo + hi) / 2 END AS hi FROM (SELECT *, unnest(range(hits, n + 1)) AS j FROM s{k - 1} WHERE hits > 0) GROUP BY condition, hits, n, lo, hi)")
    tail = f"SELECT condition, sum({term.format(p='0.5')}) AS tail FROM (SELECT *, unnest(range(hits, n + 1)) AS j FROM h) GROUP BY condition"
    return f"WITH {TRIAL_SQL}, {', '.join(parts)}, t AS ({tail}) SELECT h.condition, h.hits, h.n, round(coalesce((lo + hi) / 2, 0), 7) AS low, round(tail, 7) AS tail FROM h LEFT JOIN s40 USING (condition) LEFT JOIN t USING (condition)"


@query("", _exact_sql())
def exact_binomial(spark: SparkSession, d: str) -> DataFrame:
    """One-sided exact bounds of toxic shares by language, and the tail against a fair coin."""
    rows = _trials(spark, d).where("toxic is not null").groupBy("condition").agg(F.sum("toxic").alias("hits"), F.count("*").alias("n"))
    return trials.exact_tests(rows, "condition").withColumn("low", F.round("low", 7)).withColumn("tail", F.round("tail", 7))


@query("", "SELECT sha, repo, n FROM (SELECT l_orderkey AS sha, l_returnflag AS repo, count(*) AS n, bool_or(l_quantity > 45) AS sampled, row_number() OVER (PARTITION BY l_orderkey ORDER BY bool_or(l_quantity > 45) DESC, l_returnflag) AS k FROM lineitem GROUP BY l_orderkey, l_returnflag) WHERE k = 1")
def reconcile_commits(spark: SparkSession, d: str) -> DataFrame:
    copies = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sha"), F.col("l_returnflag").alias("repo")).agg(F.count("*").alias("n"), F.bool_or(F.col("l_quantity") > 45).alias("sampled"))
    return trials.reconciled(copies).select("sha", "repo", "n")


@query("", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def supersession(spark: SparkSession, d: str) -> DataFrame:
    return trials.latest(load(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query("", "SELECT l_orderkey AS sha, sum(l_quantity) FILTER (l_returnflag = 'A') AS a, sum(l_quantity) FILTER (l_returnflag = 'N') AS n, sum(l_quantity) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1")
def counter_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Counters by key, one row for each commit."""
    wide = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sha")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    return wide.select("sha", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


STYLE_SQL = r"l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"


@query("", f"WITH {STYLE_SQL}, t AS (SELECT doc_id, count(*) FILTER (length(line) <= 100) AS yes, count(*) FILTER (length(line) > 100) AS no FROM l WHERE line <> '' GROUP BY doc_id) SELECT 'line_length' AS predicate, count(*) AS eligible, greatest(count(*) FILTER (yes > no), count(*) FILTER (no > yes)) AS agree FROM t WHERE yes + no > 0")
def style_votes(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "documents").select(F.col("doc_id").alias("sha"), F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    short = (F.char_length("line") <= 100).cast("int")
    return trials.commit_votes(lines.select("sha", F.lit("line_length").alias("predicate"), short.alias("yes"), (1 - short).alias("no"))).select("predicate", "eligible", "agree")


@query("", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND length(text) BETWEEN 8 AND 300 AND NOT contains(text, chr(10)) AND NOT contains(text, '?') AND (starts_with(lower(text), 'the ') OR starts_with(lower(text), 'is ') OR starts_with(lower(text), 'to ') OR starts_with(lower(text), 'th'))")
def explicit_statements(spark: SparkSession, d: str) -> DataFrame:
    """Short one-line statements of a user that begin with a cue."""
    text = F.lower("text")
    cue = text.startswith("the ") | text.startswith("is ") | text.startswith("to ") | text.startswith("th")
    rows = load(spark, d, "conversations").where("role = 'user'").where(F.char_length("text").between(8, 300) & ~F.col("text").contains("\n") & ~F.col("text").contains("?") & cue)
    return rows.select("conv_id", "turn")


@query("", "SELECT window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, value FROM events) GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """An extension: tumbling windows, as the streaming plan computes them."""
    e = load(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return e.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


@query("symbols", "WITH h AS (SELECT id, kind, sum(CASE WHEN decorators IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY kind ORDER BY id ROWS UNBOUNDED PRECEDING) AS decorated FROM symbols) SELECT kind, max(decorated)::BIGINT AS decorated, count(*) AS symbols FROM h GROUP BY kind")
def decorator_counts(spark: SparkSession, d: str) -> DataFrame:
    return symbols(spark, d).groupBy("kind").agg(F.count("decorators").alias("decorated"), F.count("*").alias("symbols"))


BOUND_SQL = f"""WITH {TRIAL_SQL}, j AS (SELECT condition, doc_id // 20 AS kase, CASE quality WHEN 1 THEN 'satisfied' ELSE 'unsatisfied' END AS e, CASE WHEN status = 'error' THEN 'unknown' WHEN toxic = 0 THEN 'satisfied' ELSE 'unsatisfied' END AS v FROM tr WHERE quality IS NOT NULL AND chars IS NOT NULL),
    k AS (SELECT condition, kase, count(*) AS n, count(*) FILTER (v = e) AS same, count(*) FILTER (v = 'satisfied') + count(*) FILTER (e = 'satisfied') AS a, count(*) FILTER (v = 'unsatisfied') + count(*) FILTER (e = 'unsatisfied') AS b, count(*) FILTER (v = 'unknown') AS c FROM j GROUP BY ALL),
    x AS (SELECT k.*, draw, len(list_filter({trials.POISSON}::DOUBLE[], lambda p: p <= ('0x' || substr(md5(kase || '|' || draw), 1, 13))::BIGINT / 16::DOUBLE ** 13)) AS times FROM k, range(300) d(draw)),
    s AS (SELECT condition, draw, sum(n * times) AS n, sum(same * times) AS same, sum(a * times) AS a, sum(b * times) AS b, sum(c * times) AS c FROM x WHERE times > 0 GROUP BY ALL),
    h AS (SELECT condition, same / n AS same, (a / (2 * n) * (1 - a / (2 * n)) + b / (2 * n) * (1 - b / (2 * n)) + c / (2 * n) * (1 - c / (2 * n))) / 2 AS chance FROM s),
    o AS (SELECT condition, (same - chance) / (1 - chance) AS ac1 FROM h WHERE chance < 1), r AS (SELECT condition, ac1, row_number() OVER (PARTITION BY condition ORDER BY ac1) - 1 AS place, count(*) OVER (PARTITION BY condition) AS n FROM o),
    m AS (SELECT condition, count(*) AS cases FROM k GROUP BY condition) SELECT condition, cases, round(CASE WHEN cases >= 5 THEN ac1 END, 6) AS ac1_lower FROM m LEFT JOIN (SELECT condition, ac1 FROM r WHERE place = floor(0.05 * n)) USING (condition)"""


@query("", BOUND_SQL)
def judge_agreement_bound(spark: SparkSession, d: str) -> DataFrame:
    """A lower bound of agreement by 300 draws of cases, twenty neighbouring documents being one."""
    verdict = F.when(F.col("chars").isNull(), None).when(F.col("status") == "error", "unknown").when(F.col("toxic") == 0, "satisfied").otherwise("unsatisfied")
    expected = F.when(F.col("quality") == 1, "satisfied").otherwise("unsatisfied")
    rows = _trials(spark, d).where("quality is not null").select("condition", F.floor(F.col("doc_id") / 20).alias("case"), expected.alias("expected"), verdict.alias("judged"))
    return trials.agreement_bound(rows, "condition", draws=300).withColumn("ac1_lower", F.round("ac1_lower", 6))
