"""Benchmark decontamination by a positional inverted index.

Every benchmark item is cut into windows of words. One pass over the corpus counts the items' terms; a window
with a term that the corpus lacks cannot occur. Of each other window the rarest places are chosen, and the postings
(term, document, position) of their terms make up the index, a table in the shared folder. Lists are shifted by the
place of their term in the item, so that a copy of the item lies on one diagonal however many windows it has; hits
without another one near their diagonal go, then the lists of each window are intersected: on one diagonal for
phrases, within some words of it for proximity. Only where all lists meet are the remaining terms looked up, in
these documents and at these positions, and runs of equal words as long as a window are its occurrences.
Built-in functions only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, text_of, written

#: Words of a window; rarest places of a window whose lists are intersected; words that a near match may be off.
WINDOW, RAREST, SLOP = 13, 3, 3
#: Rows of a benchmark table (terms, places) and keys of documents up to which they are broadcast.
BROADCAST_ROWS = 200_000
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), SEPARATOR), "")


def sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def items_of(benchmark: DataFrame, unnamed: bool = False) -> DataFrame:
    """(item, words, ids): each distinct text once, under a number of its own.

    Items without identifier count only if ``unnamed``; they are never among ``ids``.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), words_of(text_of()).alias("words")).where("size(words) > 0")
    if not unnamed:
        items = items.where("id is not null")
    return items.groupBy("words").agg(F.collect_set("id").alias("ids")).select(F.monotonically_increasing_id().alias("item"), "words", "ids")


def keyed(docs: DataFrame) -> DataFrame:
    """(id, hash, words) of each row; identifier and text hash together tell rows apart."""
    return docs.select(F.col("doc_id").alias("id"), F.xxhash64(text_of()).alias("hash"), words_of(text_of()).alias("words"))


def anchors(docs: DataFrame, items: DataFrame, n_terms: int, n: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """(item, s, length, at, term, rank, ranks): the rarest places of each window, at ``s``, that can occur."""
    spots = items.select("item", F.size("words").alias("size"), F.posexplode("words").alias("at", "term"))
    terms = spots.select("term").distinct()
    counts = keyed(docs).select(F.explode("words").alias("term")).join(sized(terms, n_terms), "term").groupBy("term").agg(F.count("*").alias("seen"))
    counts = written(counts, "term-counts")
    length = F.least("size", F.lit(n))
    spots = spots.join(counts, "term", "left").withColumn("length", length)
    inside = F.sequence(F.greatest(F.col("at") - F.col("length") + 1, F.lit(0)), F.least("at", F.col("size") - F.col("length")))
    each = spots.select("item", "length", "at", "term", "seen", F.explode(inside).alias("s"))
    per_window = Window.partitionBy("item", "s")
    ranked = each.withColumn("lacks", F.max(F.col("seen").isNull()).over(per_window)).where(~F.col("lacks"))
    ranked = ranked.withColumn("rank", F.row_number().over(per_window.orderBy("seen", "at"))).where(F.col("rank") <= rarest)
    return ranked.select("item", "s", "length", "at", "term", "rank", F.least("length", F.lit(rarest)).alias("ranks"))


def postings(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """The index: (term, id, hash, pos) of every place of these terms."""
    return keyed(docs).select("id", "hash", F.posexplode("words").alias("pos", "term")).join(sized(terms, n_terms), "term").select("term", "id", "hash", "pos")


def aligned(index: DataFrame, chosen: DataFrame, n_chosen: int, slop: int = SLOP) -> DataFrame:
    """The lists of each window, shifted: (id, hash, item, s, length, diagonal, rank, ranks).

    A posting joins the places of its term once for each item and not once for each window. What has no other hit
    of its item within ``slop`` diagonals meets no other list and goes before windows are looked at.
    """
    spots = chosen.groupBy("item", "at", "term").agg(F.min("ranks").alias("fewest"))
    hits = index.join(sized(spots, n_chosen), "term").select("id", "hash", "item", "at", (F.col("pos") - F.col("at")).alias("diagonal"), "fewest")
    along = Window.partitionBy("id", "hash", "item").orderBy("diagonal", "at")
    apart = F.least(F.col("diagonal") - F.lag("diagonal").over(along), F.lead("diagonal").over(along) - F.col("diagonal"))
    met = hits.withColumn("apart", apart).where((F.col("apart") <= slop) | (F.col("fewest") == 1)).drop("apart", "fewest")
    return met.join(sized(chosen.select("item", "at", "s", "length", "rank", "ranks"), n_chosen), ["item", "at"]).select("id", "hash", "item", "s", "length", "diagonal", "rank", "ranks")


def _all_met(lists: DataFrame, slop: int) -> DataFrame:
    around = Window.partitionBy("id", "hash", "item", "s").orderBy("diagonal").rangeBetween(-slop, slop)
    ranks = F.bit_or(F.expr("shiftleft(1, rank - 1)")).over(around)
    return lists.withColumn("met", ranks).where((F.col("met") == F.expr("shiftleft(1, ranks)") - 1) & (F.col("rank") == 1))


def phrases(lists: DataFrame) -> DataFrame:
    """(id, hash, item, s, length, diagonal): the intersection of each window's lists on one diagonal."""
    return _all_met(lists, 0).where(F.col("diagonal") + F.col("s") >= 0).select("id", "hash", "item", "s", "length", "diagonal").distinct()


def proximity(lists: DataFrame, slop: int = SLOP) -> DataFrame:
    """(id, hash, item, s, diagonal): places where all chosen terms of a window lie within ``slop`` of their offsets."""
    return _all_met(lists, slop).select("id", "hash", "item", "s", "diagonal").distinct()


def same_row(a: DataFrame, b: DataFrame, *more: Column) -> Column:
    out = a["id"].eqNullSafe(b["id"]) & (a["hash"] == b["hash"])
    for c in more:
        out = out & c
    return out


def occurrences(docs: DataFrame, items: DataFrame, met: DataFrame) -> DataFrame:
    """(id, hash, item, start, n): the stretches of words, as long as a window or longer, that are an item's as well.

    ``met`` are phrases; between their ends the remaining terms are compared, each place once.
    """
    line = Window.partitionBy("id", "hash", "item", "diagonal").orderBy("s")
    reach = F.max(F.col("s") + F.col("length")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    parts = met.withColumn("from_", F.greatest("s", F.coalesce(reach, F.lit(0)))).where(F.col("from_") < F.col("s") + F.col("length"))
    places = parts.select("id", "hash", "item", "length", "diagonal", F.explode(F.sequence("from_", F.col("s") + F.col("length") - 1)).alias("at"))
    terms = items.select("item", F.posexplode("words").alias("at", "term"))
    wanted = written(places.join(terms, ["item", "at"]).select("id", "hash", "item", "length", "diagonal", "at", (F.col("diagonal") + F.col("at")).alias("pos"), "term"), "wanted-places")
    rows = written(met.select(F.col("id").alias("id__"), F.col("hash").alias("hash__")).distinct(), "met-documents")
    words = keyed(docs).join(sized(rows, rows.count()), F.col("id").eqNullSafe(F.col("id__")) & (F.col("hash") == F.col("hash__")), "left_semi")
    words = words.select("id", "hash", F.posexplode("words").alias("pos", "term"))
    same = wanted.join(words, same_row(wanted, words, wanted["pos"] == words["pos"], wanted["term"] == words["term"]), "left_semi")
    run = F.col("at") - F.row_number().over(Window.partitionBy("id", "hash", "item", "diagonal").orderBy("at"))
    runs = same.withColumn("run", run).groupBy("id", "hash", "item", "length", "diagonal", "run").agg(F.min("pos").alias("start"), F.count("*").alias("n"))
    return runs.where("n >= length").select("id", "hash", "item", "start", "n")


def search(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, rarest: int = RAREST, unnamed: bool = False, slop: int = SLOP) -> tuple[DataFrame, DataFrame]:
    """The items and the aligned lists of their windows' rarest terms, both written to the shared folder."""
    items = written(items_of(benchmark, unnamed), "items")
    n_terms = items.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).collect()[0][0]
    chosen = written(anchors(docs, items, n_terms, n, rarest), "anchors")
    index = written(postings(docs, chosen.select("term").distinct(), n_terms), "postings")
    return items, written(aligned(index, chosen, chosen.count(), slop), "aligned")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, share: float = 0.05, unnamed: bool = False, slop: int = SLOP) -> DataFrame:
    """``docs`` (doc_id, text, more) with n_words, n_hit, n_items, items, n_near and contaminated, every row included.

    A word is hit if an exact occurrence of a window covers it; n_items counts the items with a window that
    occurs, items are their identifiers sorted as strings and joined by commas; an item without identifier hits
    words only if ``unnamed`` and is not among them. n_near counts the windows (of distinct item texts) whose rarest
    terms all lie within ``slop`` words of where the window has them, exact or not. contaminated: at least ``share``
    of the words are hit. Null and empty texts have no words, items without words no window; repeated rows get equal
    results, equal items all count. An empty benchmark leaves all clean. Columns of ``docs`` with these names are
    replaced.
    """
    items, lists = search(docs, benchmark, n, unnamed=unnamed, slop=slop)
    found = written(occurrences(docs, items, written(phrases(lists), "phrases")), "occurrences")
    reach = F.max(F.col("start") + F.col("n")).over(Window.partitionBy("id", "hash").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    spans = found.groupBy("id", "hash", "start").agg(F.max("n").alias("n")).withColumn("from_", F.greatest(F.col("start"), F.coalesce(reach, F.lit(0))))
    hits = spans.groupBy("id", "hash").agg(F.sum(F.greatest(F.col("start") + F.col("n") - F.col("from_"), F.lit(0))).cast("long").alias("n_hit"))
    named = found.select("id", "hash", "item").distinct().join(items.select("item", F.explode("ids").alias("name")), "item").select("id", "hash", "name").distinct()
    named = named.groupBy("id", "hash").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("items"))
    near = proximity(lists, slop).select("id", "hash", "item", "s").distinct().groupBy("id", "hash").agg(F.count("*").alias("n_near"))
    parts = hits.select("id", "hash", "n_hit", *(F.lit(None).cast(t).alias(c) for c, t in (("n_items", "long"), ("items", "string"), ("n_near", "long"))))
    parts = parts.unionByName(named, allowMissingColumns=True).unionByName(near, allowMissingColumns=True)
    per_row = parts.groupBy(F.col("id").alias("id__"), F.col("hash").alias("hash__")).agg(*(F.max(c).alias(c) for c in ("n_hit", "n_items", "items", "n_near")))
    own, back = carried(docs, "n_words", "n_hit", "n_items", "items", "n_near", "contaminated")
    rows = docs.select(*own, F.col("doc_id").alias("own_id__"), F.xxhash64(text_of()).alias("own_hash__"), F.size(words_of(text_of())).cast("long").alias("n_words"))
    joined = rows.join(per_row, F.col("own_id__").eqNullSafe(F.col("id__")) & (F.col("own_hash__") == F.col("hash__")), "left")
    zero = F.lit(0).cast("long")
    counted = joined.select(*back, "n_words", *(F.coalesce(c, F.lit("") if c == "items" else zero).alias(c) for c in ("n_hit", "n_items", "items", "n_near")))
    hit = (F.col("n_hit") > 0) & (F.col("n_hit") >= F.col("n_words") * F.lit(share) - 1e-9)
    return counted.withColumn("contaminated", hit)
