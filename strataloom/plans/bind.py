"""The graph model over the given tables; each relation has its DuckDB equivalent in ``CTE``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"ECONOMY": "function", "SMALL": "method", "LARGE": "class", "MEDIUM": "struct", "PROMO": "trait"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task joins and aggregates. Rows of few bytes are many in a shuffle of the advised size, so their number deals them.
TASK_ROWS = 500_000


def tasks_for(rows: DataFrame) -> int:
    """Tasks for as many rows as a table has, which its files tell."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    """(suppkey, file_path, language): one file for each supplier."""
    s, n, r = (load(spark, d, t) for t in ("supplier", "nation", "region"))
    place = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    m = F.col("s_suppkey") % 4
    ext = F.when(m == 0, ".rs").when(m == 1, ".py").when(m == 2, ".ts").otherwise(".go")
    lang = F.when(m == 0, "rust").when(m == 1, "python").when(m == 2, "typescript").otherwise("go")
    path = F.concat(F.lower(F.regexp_replace("r_name", " ", "_")), F.lit("/"), F.lower("n_name"), F.lit("/s"), F.col("s_suppkey").cast("string"), ext)
    return place.select(F.col("s_suppkey").alias("suppkey"), path.alias("file_path"), lang.alias("language"))


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """id, name, kind, file_path, line_start, line_end, signature, parent_id, decorators, language."""
    p, s = load(spark, d, "part"), suppliers(spark, d)
    k = F.lit(load(spark, d, "supplier").count())
    kind = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), F.col("p_type")), F.lit("constant"))
    p = p.join(s, F.col("p_partkey") % k == s["suppkey"])
    nested = (F.col("p_partkey") >= k) & (F.floor(F.col("p_partkey") / k) % 3 != 0)
    return p.select(
        F.col("p_partkey").alias("id"),
        F.concat("p_name", F.lit("#"), "p_brand").alias("name"),
        kind.alias("kind"),
        "file_path",
        F.col("p_size").alias("line_start"),
        (F.col("p_size") + 9).alias("line_end"),
        F.concat("p_type", F.lit("("), F.col("p_size").cast("string"), F.lit(")")).alias("signature"),
        F.when(nested, F.col("p_partkey") - k).alias("parent_id"),
        F.when(F.col("p_partkey") % 10 == 0, ",partial,").when(F.col("p_partkey") % 17 == 0, ",route,").alias("decorators"),
        "language",
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    """from_id, to_name, kind, line, target_kind: references between neighbouring lines of an order."""
    li = load(spark, d, "lineitem")
    a = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    b = li.select(F.col("l_orderkey").alias("o2"), (F.col("l_linenumber") - 1).alias("n2"), F.col("l_partkey").alias("to_part"))
    names = load(spark, d, "part").select(F.col("p_partkey").alias("to_part"), F.concat("p_name", F.lit("#"), "p_brand").alias("to_name"))
    pairs = a.join(b, (a["l_orderkey"] == b["o2"]) & (a["l_linenumber"] == b["n2"])).where("l_partkey <> to_part").join(names, "to_part")
    kind = F.when(F.col("l_returnflag") == "N", "calls").when(F.col("l_returnflag") == "R", "references").otherwise("imports")
    t = (F.col("l_partkey") + F.col("l_linenumber")) % 4
    target = F.when(t == 0, "function").when(t == 1, "method").when(t == 2, "scoped")
    return pairs.select(F.col("l_partkey").alias("from_id"), "to_name", kind.alias("kind"), F.col("l_linenumber").alias("line"), target.alias("target_kind")).distinct()


def compatible(target_kind, kind):
    """Whether an edge's target kind may mean a symbol of ``kind``; this project's reading of the rule.

    An edge without a target kind, or with a scoped one, may mean any; a method call means only methods and a
    function call anything but a method.
    """
    return target_kind.isNull() | (target_kind == "scoped") | ((target_kind == "function") & (kind != "method")) | ((target_kind == "method") & (kind == "method"))


def resolved(edge_rows: DataFrame, symbol_rows: DataFrame) -> DataFrame:
    """Edges with the symbols that each may mean: to_id, to_file, to_kind. Many to many on purpose."""
    to = symbol_rows.select(F.col("id").alias("to_id"), F.col("name").alias("to_name"), F.col("file_path").alias("to_file"), F.col("kind").alias("to_kind"), F.col("language").alias("to_language"))
    return edge_rows.join(to, "to_name").where(compatible(F.col("target_kind"), F.col("to_kind")))


def spans(spark: SparkSession, d: str) -> DataFrame:
    """trace_id, span_id, parent_id, name, ts, file_path: events of a user as a trace, each the child of the one before."""
    from pyspark.sql import Window

    e, s = load(spark, d, "events"), suppliers(spark, d)
    k = F.lit(load(spark, d, "supplier").count())
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = e.select("event_id", "user_id", "event_type", "ts", "value", before.alias("parent_id"))
    return e.join(s, e["event_id"] % k == s["suppkey"]).select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("span_id"), "parent_id", F.col("event_type").alias("name"), "ts", "value", "file_path")


def touches(spark: SparkSession, d: str) -> DataFrame:
    """sha, author, at, path, added: an order as a commit, its lines as the files that it touches."""
    o, li, s = load(spark, d, "orders"), load(spark, d, "lineitem"), suppliers(spark, d)
    tasks = tasks_for(li)
    orders = o.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").repartition(tasks, "o_orderkey")
    rows = li.select("l_orderkey", "l_suppkey", "l_quantity").repartition(tasks, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.join(s, F.col("l_suppkey") == s["suppkey"]).select(F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("subject"), F.col("file_path").alias("path"), F.col("l_quantity").cast("long").alias("added"))


CTE = {
    "files": """files AS (SELECT s.s_suppkey AS suppkey, lower(replace(r.r_name, ' ', '_')) || '/' || lower(n.n_name) || '/s' || s.s_suppkey ||
      CASE s.s_suppkey % 4 WHEN 0 THEN '.rs' WHEN 1 THEN '.py' WHEN 2 THEN '.ts' ELSE '.go' END AS file_path,
      CASE s.s_suppkey % 4 WHEN 0 THEN 'rust' WHEN 1 THEN 'python' WHEN 2 THEN 'typescript' ELSE 'go' END AS language
      FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey)""",
    "symbols": """symbols AS (SELECT p.p_partkey AS id, p.p_name || '#' || p.p_brand AS name,
      CASE p.p_type WHEN 'ECONOMY' THEN 'function' WHEN 'SMALL' THEN 'method' WHEN 'LARGE' THEN 'class' WHEN 'MEDIUM' THEN 'struct' WHEN 'PROMO' THEN 'trait' ELSE 'constant' END AS kind,
      f.file_path, p.p_size AS line_start, p.p_size + 9 AS line_end, p.p_type || '(' || p.p_size || ')' AS signature,
      CASE WHEN p.p_partkey >= c.k AND (p.p_partkey // c.k) % 3 <> 0 THEN p.p_partkey - c.k END AS parent_id,
      CASE WHEN p.p_partkey % 10 = 0 THEN ',partial,' WHEN p.p_partkey % 17 = 0 THEN ',route,' END AS decorators, f.language
      FROM part p CROSS JOIN (SELECT count(*) AS k FROM supplier) c JOIN files f ON f.suppkey = p.p_partkey % c.k)""",
    "edges": """edges AS (SELECT DISTINCT a.l_partkey AS from_id, t.p_name || '#' || t.p_brand AS to_name,
      CASE a.l_returnflag WHEN 'N' THEN 'calls' WHEN 'R' THEN 'references' ELSE 'imports' END AS kind, a.l_linenumber AS line,
      CASE (a.l_partkey + a.l_linenumber) % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'scoped' END AS target_kind
      FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 JOIN part t ON t.p_partkey = b.l_partkey
      WHERE a.l_partkey <> b.l_partkey)""",
    "resolved": """resolved AS (SELECT e.*, s.id AS to_id, s.file_path AS to_file, s.kind AS to_kind, s.language AS to_language FROM edges e JOIN symbols s ON s.name = e.to_name
      WHERE e.target_kind IS NULL OR e.target_kind = 'scoped' OR (e.target_kind = 'function' AND s.kind <> 'method') OR (e.target_kind = 'method' AND s.kind = 'method'))""",
    "spans": """spans AS (SELECT e.user_id AS trace_id, e.event_id AS span_id, lag(e.event_id) OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS parent_id,
      e.event_type AS name, e.ts, e.value, f.file_path FROM events e CROSS JOIN (SELECT count(*) AS k FROM supplier) c JOIN files f ON f.suppkey = e.event_id % c.k)""",
    "touches": """touches AS (SELECT o.o_orderkey AS sha, o.o_custkey AS author, o.o_orderdate AS at, o.o_orderpriority AS subject, f.file_path AS path, CAST(l.l_quantity AS BIGINT) AS added
      FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN files f ON f.suppkey = l.l_suppkey)""",
}
NEEDS = {"symbols": ["files"], "resolved": ["symbols", "edges"], "spans": ["files"], "touches": ["files"]}


def sql(tables: str, body: str) -> str:
    """A DuckDB query over the bound relations named in ``tables``."""
    names: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, ()):
            add(need)
        if name not in names:
            names.append(name)

    for name in tables.split():
        add(name)
    body = body.strip()
    head = ", ".join(CTE[n] for n in names)
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
