"""Queries of full-text retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators import inverted
from strataloom.operators import search as fts
from strataloom.operators import text
from strataloom.operators.bounds import small
from strataloom.plans.bind import load, symbols
from strataloom.plans.registry import paged, query

SPLIT = r"list_filter(string_split_regex(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
INDEX_SQL = f"w AS (SELECT doc_id, {SPLIT.format(c='text')} AS t FROM documents), ix AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM w) GROUP BY ALL), st AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM w)"
BM25_SQL = """a AS (SELECT * FROM ix WHERE term IN ({terms})), df AS (SELECT term, count(*) AS df FROM a GROUP BY term),
    sc AS (SELECT a.doc_id, count(DISTINCT a.term) AS hits, sum(ln(1 + (st.docs - df.df + 0.5) / (df.df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / st.mean))) AS score FROM a JOIN df USING (term), st GROUP BY a.doc_id)"""


def _scored(spark: SparkSession, d: str, terms: list[str], need: int | None = None) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "text")
    n, mean = docs.select(F.count("*"), F.avg(F.size(text.tokens(F.col("text"))))).collect()[0]
    return text.bm25(text.postings(docs, "doc_id", "text"), "doc_id", terms, n, mean, need)


@query("", f"WITH {INDEX_SQL}, {BM25_SQL.format(terms=repr('licensed') + ', ' + repr('apache'))} SELECT doc_id, hits, round(score, 6) AS score FROM sc WHERE hits = 2")
def history(spark: SparkSession, d: str) -> DataFrame:
    """All terms must occur; ranked by BM25."""
    return _scored(spark, d, ["licensed", "apache"]).select("doc_id", "hits", F.round("score", 6).alias("score"))


@query("", f"WITH {INDEX_SQL}, {BM25_SQL.format(terms=repr('licensed') + ', ' + repr('mit') + ', ' + repr('apache') + ', ' + repr('reserved'))} SELECT doc_id, hits, round(score, 6) AS score FROM sc WHERE hits >= 2")
def docs_partial(spark: SparkSession, d: str) -> DataFrame:
    """From three terms on, half of them are enough."""
    terms = ["licensed", "mit", "apache", "reserved"]
    return _scored(spark, d, terms, text.floors(len(terms))[0]).select("doc_id", "hits", F.round("score", 6).alias("score"))


def _leaf_sql(leaf: fts.Leaf) -> str:
    """How often a leaf occurs in the words ``t`` of a document."""
    one = lambda p, i: " AND ".join((f"starts_with(coalesce(t[{i} + {k}], ''), '{w}')" if p.prefix and k == len(p.words) - 1 else f"coalesce(t[{i} + {k}], '') = '{w}'") for k, w in enumerate(p.words))
    if leaf.within is None:
        return f"len(list_filter(range(1, len(t) + 1), lambda i: {one(leaf.phrases[0], 'i')}))"
    near = []
    for a in leaf.phrases:
        rest = " AND ".join(f"len(list_filter(range(i, least(i + {leaf.within + len(a.words)}, len(t)) + 1), lambda j{k}: {one(b, f'j{k}')})) > 0" for k, b in enumerate(leaf.phrases) if b is not a)
        near.append(f"len(list_filter(range(1, len(t) + 1), lambda i: {one(a, 'i')} AND {rest}))")
    return " + ".join(near)


def _tree_sql(tree: object) -> str:
    if isinstance(tree, int):
        return f"l{tree} > 0"
    how, left, right = tree
    return f"({_tree_sql(left)} {'AND NOT' if how == 'not' else how.upper()} {_tree_sql(right)})"


def search_sql(asked: str, top: int, kind: str | None = None) -> str:
    q = fts.parse(asked)
    words = ", ".join(repr(w) for w in sorted({w for leaf in q.leaves for p in leaf.phrases for w in p.words}))
    score = " + ".join(f"CASE WHEN l{i} > 0 THEN ln(1 + (docs - d{i} + 0.5) / (d{i} + 0.5)) * l{i} * 2.2 / (l{i} + 1.2 * (0.25 + 0.75 * len(t) / mean)) ELSE 0 END" for i in range(len(q.leaves)))
    found = f"""WITH w AS (SELECT doc_id, source, {SPLIT.format(c='text')} AS t FROM documents), f AS (SELECT *, {", ".join(f"{_leaf_sql(leaf)} AS l{i}" for i, leaf in enumerate(q.leaves))} FROM w),
    st AS (SELECT count(*) AS docs, avg(len(t)) AS mean, {", ".join(f"count(*) FILTER (l{i} > 0) AS d{i}" for i in range(len(q.leaves)))} FROM f)
    SELECT doc_id, round({score}, 6) AS score FROM f, st WHERE {_tree_sql(q.tree)}{f" AND source = '{kind}'" if kind else ""}"""
    lines = f"""ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
    best AS (SELECT doc_id, text AS excerpt FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, line) AS k FROM (SELECT *, len(list_intersect(list_distinct({SPLIT.format(c='text')}), [{words}])) AS hits FROM ln) WHERE hits > 0) WHERE k = 1)"""
    return f"WITH pg AS ({paged(found, top, 'score DESC, doc_id')}), {lines} SELECT pg.*, excerpt FROM pg LEFT JOIN best USING (doc_id)"


def _search(spark: SparkSession, d: str, asked: str, top: int, kind: str | None = None) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "text", F.col("source").alias("kind"))
    return fts.search(docs, "doc_id", "text", asked, top, kind)


ASKED = {
    "history_boolean": ("(apache OR mit) licen* NOT idiot", 20, None),
    "history_near": ('NEAR(apache version, 3) OR NEAR("all rights" reserved, 0)', 50, None),
    "docs_of_kind": ('"rights reserved" OR released', 10, "src2"),
    "tasks_hyphenated": ("all-rights reserv* NOT (clown OR trash)", 25, None),
}


@query("", search_sql(*ASKED["history_boolean"]))
def history_boolean(spark: SparkSession, d: str) -> DataFrame:
    """OR, NOT and a prefix, with total and excerpt."""
    return _search(spark, d, *ASKED["history_boolean"])


@query("", search_sql(*ASKED["history_near"]))
def history_near(spark: SparkSession, d: str) -> DataFrame:
    """Words and phrases near each other."""
    return _search(spark, d, *ASKED["history_near"])


@query("", search_sql(*ASKED["docs_of_kind"]))
def docs_of_kind(spark: SparkSession, d: str) -> DataFrame:
    """A phrase among the documents of one kind."""
    return _search(spark, d, *ASKED["docs_of_kind"])


@query("", search_sql(*ASKED["tasks_hyphenated"]))
def tasks_hyphenated(spark: SparkSession, d: str) -> DataFrame:
    """A hyphenated word is a phrase; NOT before a parenthesis."""
    return _search(spark, d, *ASKED["tasks_hyphenated"])


FIELDS_SQL = f"""f AS (SELECT id, 'name' AS field, unnest({SPLIT.format(c='name')}) AS term FROM symbols UNION ALL SELECT id, 'path', unnest({SPLIT.format(c='file_path')}) FROM symbols UNION ALL SELECT id, 'signature', unnest({SPLIT.format(c='signature')}) FROM symbols),
    ft AS (SELECT id, field, term, count(*) AS tf FROM f GROUP BY ALL)"""


def _fields(spark: SparkSession, d: str) -> DataFrame:
    s = symbols(spark, d)
    columns = {"name": "name", "path": "file_path", "signature": "signature"}
    each = [s.select("id", F.lit(f).alias("field"), F.explode(text.tokens(F.col(c))).alias("term")) for f, c in columns.items()]
    return each[0].unionByName(each[1]).unionByName(each[2]).groupBy("id", "field", "term").agg(F.count("*").alias("tf"))


@query("symbols", f"WITH {FIELDS_SQL} SELECT id, count(DISTINCT term) AS hits, sum(CASE field WHEN 'name' THEN 10 WHEN 'path' THEN 4 ELSE 2 END * tf)::BIGINT AS weight FROM ft WHERE term IN ('asia', 'promo', 'brand') GROUP BY id HAVING count(DISTINCT term) >= 2")
def concept(spark: SparkSession, d: str) -> DataFrame:
    return text.concept(_fields(spark, d), ["asia", "promo", "brand"]).select("id", "hits", F.col("weight").cast("long").alias("weight"))


QUESTION = "the promo brand of asia"
def _concept_sql(terms: list[str], need: int, least: int) -> str:
    ranked = "term IN ('promo', 'brand', 'asia')"
    body = f"""WITH {FIELDS_SQL}, ln AS (SELECT id, sum(tf) AS length FROM ft GROUP BY id), st AS (SELECT count(*) AS docs, avg(length) AS mean FROM ln),
    h AS (SELECT id, term, sum(CASE field WHEN 'name' THEN 10 WHEN 'path' THEN 4 ELSE 2 END * tf) AS tf FROM ft WHERE term IN ({', '.join(map(repr, terms))}) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM h GROUP BY term)
    SELECT id, count(*) AS hits, count(*) FILTER ({ranked}) AS ranked_hits,
      round(sum(CASE WHEN {ranked} THEN ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) ELSE 0 END), 6) AS score
    FROM h JOIN df USING (term) JOIN ln USING (id), st GROUP BY id HAVING count(*) >= {need} AND count(*) FILTER ({ranked}) >= {least}"""
    return paged(body, 20, "hits DESC, score DESC, id")


@query("symbols", _concept_sql(QUESTION.split(), 3, 3))
def concept_question(spark: SparkSession, d: str) -> DataFrame:
    """Two of the five terms are function words: half of all must occur, and three of those with weight."""
    return _asked(spark, d, QUESTION)


@query("symbols", _concept_sql(["promo", "brand", "asia"], 2, 2))
def concept_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Two of three terms; weighted fields in BM25."""
    return _asked(spark, d, "promo brand asia")


def _asked(spark: SparkSession, d: str, question: str) -> DataFrame:
    rows = _fields(spark, d)
    return fts.concept(rows.join(rows.groupBy("id", "field").agg(F.sum("tf").alias("n")), ["id", "field"]), question, 20)


@query("symbols", f"WITH {FIELDS_SQL} SELECT field, count(DISTINCT id) AS symbols, sum(tf)::BIGINT AS occurrences FROM ft WHERE term IN ('asia', 'promo') GROUP BY field")
def matched_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = _fields(spark, d).where("term in ('asia', 'promo')")
    return rows.groupBy("field").agg(F.count_distinct("id").alias("symbols"), F.sum("tf").alias("occurrences"))


@query("", "SELECT doc_id FROM documents WHERE contains(' ' || array_to_string(" + SPLIT.format(c="text") + ", ' ') || ' ', ' all rights reserved ')")
def phrase(spark: SparkSession, d: str) -> DataFrame:
    return text.phrase_docs(load(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", ["all", "rights", "reserved"])


STAND_INS = ", ".join(map(repr, [*text.PLACEHOLDERS, "example"]))
REAL_SQL = rf"""v <> '' AND v NOT IN ({STAND_INS}) AND NOT starts_with(v, '${{') AND NOT starts_with(v, '{{{{') AND v[1] <> '<' AND NOT regexp_matches(v, '^(example|your)[_-]') AND NOT regexp_full_match(v, '[x*_.-]*')"""
SECRET_SQL = rf"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), i AS (SELECT doc_id, line, unnest(range(1, length(line) + 1)) AS i FROM l WHERE regexp_matches(line, '[=:]')),
    a AS (SELECT doc_id, CASE line[i] WHEN ':' THEN left(line, i - 1) ELSE regexp_extract(regexp_replace(left(line, i - 1), '\s+$', ''), '[^\s,;(\x7B]*$') END AS l, regexp_replace(substr(line, i + 1), '^\s+', '') AS r FROM i WHERE line[i] IN ('=', ':')),
    k AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(l, '^\s+|\s+$', '', 'g'), '^[-*+>`]+', ''), '^\s+|\s+$', '', 'g'), '^["''`]+|["''`]+$', '', 'g') AS k, lower(regexp_extract(regexp_replace(r, '^["''`]+', ''), '^[^\s"''`,;)\]\x7D]*')) AS v FROM a),
    w AS (SELECT doc_id FROM k WHERE NOT regexp_matches(k, '\s') AND regexp_matches(lower(regexp_replace(k, '[^A-Za-z0-9]', '', 'g')), '(apikey|secret|token|password)$') AND {REAL_SQL}),
    b AS (SELECT doc_id, unnest(regexp_extract_all(lower(line), '(?:^|[^a-z0-9_])authorization\s*["''`]?\s*[:=]\s*["''`]*bearer\s+([^\s"''`,;)\]\x7D]*)', 1)) AS v FROM l),
    x AS (SELECT doc_id FROM w UNION SELECT doc_id FROM b WHERE {REAL_SQL} UNION SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^A-Za-z0-9])(AKIA|ASIA)[A-Z0-9]{{16}}([^A-Za-z0-9]|$)') OR (contains(lower(text), '-----begin ') AND contains(lower(text), 'private key-----')))
    SELECT doc_id, text IS NULL OR doc_id IN (FROM x) AS withheld FROM documents"""


@query("", SECRET_SQL)
def secret_redaction(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", text.redacted(F.col("text")).isNull().alias("withheld"))


@query(
    "",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
    h AS (SELECT doc_id, line, text, len(list_intersect(list_distinct({SPLIT.format(c='text')}), ['licensed', 'apache', 'license'])) AS hits FROM l)
    SELECT doc_id, line, text, hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, line) AS k FROM h WHERE hits > 0) WHERE k = 1""",
)
def snippet(spark: SparkSession, d: str) -> DataFrame:
    return text.best_lines(load(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", ["licensed", "apache", "license"])


@query()
def stem_groups(spark: SparkSession, d: str) -> DataFrame:
    """Words that share a Porter stem; the stemmer has no SQL."""
    words = load(spark, d, "documents").select(F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("word")).distinct()
    return words.withColumn("stem", text.stems(F.col("word"))).groupBy("stem").agg(F.count("*").alias("words"), F.min("word").alias("first")).where("words > 1")


@query("", "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'")
def human_turns(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")


@query("symbols", "WITH n AS (SELECT DISTINCT file_path FROM symbols WHERE id % 13 = 0), w AS (SELECT DISTINCT doc_id, unnest(" + SPLIT.format(c="text") + ") AS term FROM documents) SELECT term, count(*) AS documents FROM w WHERE term IN (SELECT split_part(file_path, '/', 1) FROM n UNION SELECT 'token' UNION SELECT 'license') GROUP BY term")
def history_review(spark: SparkSession, d: str) -> DataFrame:
    """Documents that mention names of removed places."""
    gone = symbols(spark, d).where("id % 13 = 0").select(F.split("file_path", "/")[0].alias("term")).distinct()
    names = gone.unionByName(spark.createDataFrame([("token",), ("license",)], "term string")).distinct()
    words = load(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term"))
    return words.join(small(names), "term").groupBy("term").agg(F.count("*").alias("documents"))


# The stemmer has no SQL, so its oracle names the words that share a stem: what is asked, and all of its forms.
FORMS = {"licens": r"licens(e|ed|es|ing)?", "apach": "apache", "mit": "mit", "reserv": r"reserv(e|ed|es|ing)", "right": "rights?", "releas": r"releas(e|ed|es|ing)", "asia": "asia", "promo": "promos?", "brand": r"brand(s|ed|ing)?"}
STEM_CASE = "CASE " + " ".join(f"WHEN regexp_full_match(term, '{form}') THEN '{stem}'" for stem, form in FORMS.items()) + " ELSE term END"


def _index(spark: SparkSession, d: str) -> inverted.Index:
    return inverted.build(load(spark, d, "documents").select(F.col("doc_id").alias("key"), F.lit("body").alias("field"), "text"))


def _stem_sql(terms: list[str]) -> str:
    return f"""w AS (SELECT doc_id, {SPLIT.format(c='text')} AS t FROM documents), st AS (SELECT count(*) AS docs, avg(coalesce(len(t), 0)) AS mean FROM w),
    ix AS (SELECT doc_id, n, {STEM_CASE} AS stem, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM w) GROUP BY ALL),
    a AS (SELECT * FROM ix WHERE stem IN ({", ".join(map(repr, terms))})), df AS (SELECT stem, count(*) AS df FROM a GROUP BY stem),
    sc AS (SELECT a.doc_id, count(*) AS hits, sum(ln(1 + (st.docs - df.df + 0.5) / (df.df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / st.mean))) AS score FROM a JOIN df USING (stem), st GROUP BY a.doc_id)"""


def _stem_page(terms: list[str], need: int, top: int, hits: bool = False) -> str:
    return paged(f"WITH {_stem_sql(terms)} SELECT doc_id AS key, {'hits, ' if hits else ''}round(score, 6) AS score FROM sc WHERE hits >= {need}", top, "score DESC, key")


@query("", _stem_page(["licens", "apach"], 2, 20))
def stemmed_history(spark: SparkSession, d: str) -> DataFrame:
    """Other forms of the words are found: "licensing" means "licensed"."""
    return inverted.search(_index(spark, d), "licensing apache", 20)


@query("", _stem_page(["licens", "mit", "apach", "reserv"], 1, 25, True))
def stemmed_recall(spark: SparkSession, d: str) -> DataFrame:
    """Any of the words, the best first; shards whose bound is too low are not scored."""
    return inverted.recall(_index(spark, d), ["licenses", "mit", "apache", "reserving"], 25)


@query("", paged(f"WITH w AS (SELECT doc_id, ' ' || array_to_string({SPLIT.format(c='text')}, ' ') || ' ' AS t, len({SPLIT.format(c='text')}) AS n FROM documents), f AS (SELECT *, len(regexp_extract_all(t, ' rights? (?=reserv(e|ed|es|ing) )')) AS tf FROM w), st AS (SELECT count(*) AS docs, avg(coalesce(n, 0)) AS mean, count(*) FILTER (tf > 0) AS df FROM f) SELECT doc_id AS key, round(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score FROM f, st WHERE tf > 0".replace("(?=reserv(e|ed|es|ing) )", "reserv(?:e|ed|es|ing) "), 30, "score DESC, key"))
def stemmed_phrase(spark: SparkSession, d: str) -> DataFrame:
    """Stems side by side, from the positions of the index."""
    return inverted.search(_index(spark, d), '"right reserves"', 30)


def _updated_sql() -> str:
    return _stem_page(["releas"], 1, 15).replace("FROM documents", "FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' Releasing' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0)")


@query("", _updated_sql())
def stemmed_update(spark: SparkSession, d: str) -> DataFrame:
    """The next generation of the index, after a third of the texts has changed and a seventh is gone."""
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("key"), F.lit("body").alias("field"), "text")
    now = docs.where("key % 7 <> 0").withColumn("text", F.when(F.col("key") % 3 == 0, F.concat("text", F.lit(" Releasing"))).otherwise(F.col("text")))
    return inverted.search(inverted.updated(inverted.build(docs), now), "released", 15)


STEM_FIELDS_SQL = FIELDS_SQL.replace("ft AS (SELECT id, field, term, count(*) AS tf FROM f GROUP BY ALL)", f"ft AS (SELECT id, field, {STEM_CASE} AS term, count(*) AS tf FROM f GROUP BY ALL)")


@query("symbols", _concept_sql(["promo", "brand", "asia"], 2, 2).replace(FIELDS_SQL, STEM_FIELDS_SQL).replace("SELECT id, count(*) AS hits", "SELECT id AS key, count(*) AS hits").replace("hits DESC, score DESC, id", "hits DESC, score DESC, key"))
def stemmed_concept(spark: SparkSession, d: str) -> DataFrame:
    """A question in other forms than the fields have, on an index of three fields."""
    s = symbols(spark, d)
    fields = [s.select(F.col("id").alias("key"), F.lit(f).alias("field"), F.col(c).alias("text")) for f, c in (("name", "name"), ("path", "file_path"), ("signature", "signature"))]
    return inverted.concept(inverted.build(fields[0].unionByName(fields[1]).unionByName(fields[2])), "promos branded asia", 20)
