"""Boolean full-text search over positions, ranked by BM25.

A query is an expression of phrases: words side by side must all occur, OR and NOT as usual (NOT binds closest, then AND,
then OR), parentheses, "quoted phrases", a star at the end for prefixes, and NEAR(a b "c d", n) for phrases with
at most n words between the first one's end and the last one's start (10 if left out). Hyphenated words are phrases.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.operators.bounds import page
from strataloom.operators.text import B, FIELD_WEIGHTS, FUNCTION_WORDS, K1, best_lines, floors, porter, question_terms, tokens

NEAR = 10
PIECE = re.compile(r'"[^"]*"\*?|NEAR\s*\(|[()]|,\s*\d+|[^\s()",]+|,')


@dataclass
class Phrase:
    words: list[str]
    prefix: bool = False


@dataclass
class Leaf:
    """One phrase, or several near each other."""

    phrases: list[Phrase]
    within: int | None = None


@dataclass
class Query:
    """``tree`` is a leaf's number or (operator, left, right)."""

    leaves: list[Leaf] = field(default_factory=list)
    tree: object = None


def parse(text: str) -> Query:
    """The query of a text; what has no word in it, or an operator without a side, is an error."""
    pieces, at, query = PIECE.findall(text), 0, Query()

    def phrase(piece: str) -> Phrase | None:
        words = [w for w in re.split(r"[^\w]+|_", piece.lower()) if w]
        return Phrase(words, piece.endswith("*")) if words else None

    def leaf() -> object:
        nonlocal at
        if at >= len(pieces) or pieces[at] in (")", "AND", "OR", "NOT"):
            raise ValueError(f"a term is missing in {text!r}")
        piece = pieces[at]
        at += 1
        if piece == "(":
            inner = either()
            if at >= len(pieces) or pieces[at] != ")":
                raise ValueError(f"a parenthesis is open in {text!r}")
            at += 1
            return inner
        if piece.startswith("NEAR") and piece.endswith("("):
            found, within = [], NEAR
            while at < len(pieces) and pieces[at] != ")":
                if number := re.fullmatch(r",\s*(\d+)", pieces[at]):
                    within = int(number[1])
                elif one := phrase(pieces[at]):
                    found.append(one)
                at += 1
            at += 1
            if not found:
                raise ValueError(f"nothing to be near in {text!r}")
            query.leaves.append(Leaf(found, within))
        else:
            one = phrase(piece)
            if one is None:
                return leaf() if at < len(pieces) else None
            query.leaves.append(Leaf([one]))
        return len(query.leaves) - 1

    def without() -> object:
        nonlocal at
        left = leaf()
        while at < len(pieces) and pieces[at] == "NOT":
            at += 1
            left = ("not", left, leaf())
        return left

    def both() -> object:
        nonlocal at
        left = without()
        while at < len(pieces) and pieces[at] not in ("OR", ")"):
            at += pieces[at] == "AND"
            right = without()
            left = ("and", left, right) if left is not None and right is not None else right if left is None else left
        return left

    def either() -> object:
        nonlocal at
        left = both()
        while at < len(pieces) and pieces[at] == "OR":
            at += 1
            left = ("or", left, both())
        return left

    query.tree = either()
    if query.tree is None or at < len(pieces):
        raise ValueError(f"not a query: {text!r}")
    return query


def holds(tree: object, flag) -> Column:
    """The expression as a column; ``flag`` gives the column of a leaf."""
    if isinstance(tree, int):
        return flag(tree)
    how, left, right = tree
    a, b = holds(left, flag), holds(right, flag)
    return a & b if how == "and" else a | b if how == "or" else a & ~b


def occurrences(docs: DataFrame, key: str, column: str, query: Query) -> DataFrame:
    """(key, n, leaf, tf): how often each leaf occurs, with the document's length.

    Every token is held against the query's words alone, which the plan carries as literals; phrases meet by shifted
    positions, NEAR by a window over starts.
    """
    wanted = [(i, j, k, w, p.prefix and k == len(p.words) - 1) for i, leaf in enumerate(query.leaves) for j, p in enumerate(leaf.phrases) for k, w in enumerate(p.words)]
    asked = F.array(*(F.struct(F.lit(i).alias("leaf"), F.lit(j).alias("phrase"), F.lit(k).alias("offset"), F.lit(w).alias("word"), F.lit(star).alias("star")) for i, j, k, w, star in wanted))
    each = docs.select(key, tokens(F.col(column)).alias("t")).select(key, F.size("t").alias("n"), F.posexplode("t").alias("pos", "term"))
    hits = each.select(key, "n", "pos", F.explode(F.filter(asked, lambda x: (F.col("term") == x["word"]) | (x["star"] & F.col("term").startswith(x["word"])))).alias("x"))
    sizes = F.create_map(*(F.lit(v) for i, leaf in enumerate(query.leaves) for j, p in enumerate(leaf.phrases) for v in (i * 1000 + j, len(p.words))))
    starts = hits.groupBy(key, "n", F.col("x.leaf").alias("leaf"), F.col("x.phrase").alias("phrase"), (F.col("pos") - F.col("x.offset")).alias("start")).agg(F.count_distinct("x.offset").alias("met"))
    starts = starts.withColumn("size", sizes[F.col("leaf") * 1000 + F.col("phrase")]).where("met = size")
    plain = [i for i, leaf in enumerate(query.leaves) if leaf.within is None]
    found = starts.where(F.col("leaf").isin(plain)).select(key, "n", "leaf")
    for i, leaf in enumerate(query.leaves):
        if leaf.within is None:
            continue
        found = found.unionByName(near_each_other(starts.where(F.col("leaf") == i), key, leaf).select(key, "n", "leaf"))
    return found.groupBy(key, "n", "leaf").agg(F.count("*").alias("tf"))


def near_each_other(starts: DataFrame, key: str, leaf: Leaf) -> DataFrame:
    """Of the ``starts`` (key, start, phrase, size) of a leaf's phrases those from which all are met in reach."""
    found = None
    for size in sorted({len(p.words) for p in leaf.phrases}):
        reach = Window.partitionBy(key).orderBy("start").rangeBetween(0, leaf.within + size)
        near = starts.withColumn("all", F.size(F.collect_set("phrase").over(reach))).where((F.col("all") == len(leaf.phrases)) & (F.col("size") == size))
        found = near if found is None else found.unionByName(near)
    return found


def search(docs: DataFrame, key: str, column: str, text: str, top: int, kind: str | None = None) -> DataFrame:
    """A page of the documents that a query admits, the best first, with score, excerpt and the exact total.

    ``kind`` keeps documents of one kind before counting; how rare a term is counts over all. The excerpt is the
    first of the lines with most of the query's words.
    """
    query = parse(text)
    size = docs.agg(F.count("*").alias("docs"), F.avg(F.size(tokens(F.col(column)))).alias("mean")).collect()[0]
    found = occurrences(docs, key, column, query)
    rare = F.broadcast(found.groupBy("leaf").agg(F.count("*").alias("df")))  # a row for each leaf of the query
    part = F.log(1 + (size["docs"] - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.lit(size["mean"] or 1.0)))
    rows = found.join(rare, "leaf").groupBy(key).agg(F.sum(part).alias("score"), *(F.max((F.col("leaf") == i).cast("int")).alias(f"leaf_{i}") for i in range(len(query.leaves))))
    rows = rows.where(holds(query.tree, lambda i: F.col(f"leaf_{i}") == 1)).select(key, F.round("score", 6).alias("score"))
    if kind is not None:
        rows = rows.join(docs.where(F.col("kind") == kind).select(key), key, "left_semi")
    first = page(rows, top, F.col("score").desc(), key)
    words = sorted({w for leaf in query.leaves for p in leaf.phrases for w in p.words})
    lines = best_lines(docs.join(first.select(key), key, "left_semi"), key, column, words).select(key, F.col("text").alias("excerpt"))
    return first.join(lines, key, "left").orderBy(F.col("score").desc(), key)


def concept(fields: DataFrame, question: str, top: int, tests: DataFrame | None = None) -> DataFrame:
    """A page of symbols for a question, (id, hits, ranked_hits, score) over ``fields`` (id, field, term, tf, n).

    Symbols of ``tests`` (id) are left out before anything is counted.

    Terms with one stem count once. All terms must occur; from three on half of them and two are enough, of which as
    many as that, but three at most, carry weight, as far as there are such. Function words have no weight unless there are no others. Term
    frequencies weigh by field before BM25 dampens them, and more hits come before a higher score.
    """
    if tests is not None:
        fields = fields.join(tests.select("id").distinct(), "id", "left_anti")
    asked: dict[str, str] = {}
    every = [w for w in re.split(r"[^\w]+|_", question.lower()) if w]
    for w in dict.fromkeys(every):
        asked.setdefault(porter(w), w)
    terms = list(asked.values())
    ranking = [t for t in terms if t in question_terms(question)] or terms
    n = len(terms)
    need, least = (n, 0) if n < 3 else (floors(n)[0], min(3, floors(n)[0], len(ranking)))
    weight = F.create_map(*(F.lit(x) for kv in FIELD_WEIGHTS.items() for x in kv))[F.col("field")]
    size = fields.select("id", "field", "n").distinct().groupBy("id").agg(F.sum("n").alias("n")).agg(F.count("*").alias("docs"), F.avg("n").alias("mean")).collect()[0]
    length = fields.select("id", "field", "n").distinct().groupBy("id").agg(F.sum("n").alias("length"))
    hits = fields.where(F.col("term").isin(terms)).groupBy("id", "term").agg(F.sum(weight * F.col("tf")).alias("tf"))
    rare = F.broadcast(hits.groupBy("term").agg(F.count("*").alias("df")))  # a row for each term of the question
    idf = F.log(1 + (size["docs"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(size["mean"] or 1.0)))
    ranked = F.col("term").isin(ranking)
    rows = hits.join(rare, "term").join(length, "id").groupBy("id").agg(F.count("*").alias("hits"), F.count_if(ranked).alias("ranked_hits"), F.round(F.sum(F.when(ranked, part).otherwise(0.0)), 6).alias("score"))
    rows = rows.where((F.col("hits") >= need) & (F.col("ranked_hits") >= least))
    return page(rows, top, F.col("hits").desc(), F.col("score").desc(), "id")


def recall(fields: DataFrame, terms: list[str], weights: dict[str, int], top: int) -> DataFrame:
    """A page of (id, hits, score) of ``fields`` (id, field, term, tf, n): any of the terms is enough, the best first.

    Term frequencies weigh by field before BM25 dampens them.
    """
    weight = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("field")]
    length = fields.select("id", "field", "n").distinct().groupBy("id").agg(F.sum("n").alias("length"))
    size = length.agg(F.count("*").alias("docs"), F.avg("length").alias("mean")).collect()[0]
    hits = fields.where(F.col("term").isin(terms)).groupBy("id", "term").agg(F.sum(weight * F.col("tf")).alias("tf"))
    rare = F.broadcast(hits.groupBy("term").agg(F.count("*").alias("df")))  # a row for each term asked
    idf = F.log(1 + (size["docs"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(size["mean"] or 1.0)))
    rows = hits.join(rare, "term").join(length, "id").groupBy("id").agg(F.count("*").alias("hits"), F.round(F.sum(part), 6).alias("score"))
    return page(rows, top, F.col("score").desc(), "id")


__all__ = ["FUNCTION_WORDS", "concept", "holds", "occurrences", "parse", "recall", "search"]
