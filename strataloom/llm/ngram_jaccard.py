"""Exact Jaccard join of word n-grams by a token-group matrix.

1. Every text becomes the set of its hashed shingles; equal sets are one from here on.
2. Sets are read in the order of their numbers. Two that link share at least ``l`` of the first ``p`` tokens of
   the one whose p-th token is smaller, so a set with fewer tokens in common with any other links with nothing.
3. Families of similar sets are compared with a few representatives each, and links make them classes; tokens of
   a single class tell nothing of links across classes.
4. What may still link is partitioned into groups of one length band and one smallest hash. The token-group matrix
   has a column of rare tokens for each group and its union of all tokens; a set asks the groups that its own rare
   tokens name, what it shares with the union bounds its overlap with every member, and only groups whose
   bound reaches what a link needs are opened.
Classes and links end in connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, quoted, written
from .components import components
from .shingles import mixed, shingle_sets

#: Words of a shingle, and the Jaccard similarity of a link in hundredths.
SHINGLE, PERCENT = 4, 85
#: Leading tokens beyond the least, in hundredths of a set: as many must be shared.
MORE = 5
#: Members, and tokens of its members, that a group of the matrix has on average at most.
GROUP, GROUP_TOKENS = 64, 1 << 18
#: Identifiers of sets in question up to which they are broadcast to the texts.
BROADCAST_IDS = 200_000
#: Members of a family that meet its consensus in one place; of a larger family each part meets a copy of it.
FAMILY = 256
#: Rounds of verifying against representatives of families, two at most.
ROUNDS = 2
#: Growth of set sizes from one length band to the next.
BAND = 1.03

HEADS = "doc_id long, number long, n long, head array<long>"
SETS = "number long, n long, tokens array<long>, bits array<long>, keys array<long>"


def prefix_size(n: int, percent: int) -> int:
    """Leading tokens of a set of ``n``: those that a partner can lack at most, and as many as must be shared."""
    return n - -(-n * percent // 100) + 1 + n * MORE // 100


def must_share(n: Column, percent: int) -> Column:
    """Leading tokens shared with some partner of a linked set, by the smallest partner's size."""
    return F.floor(F.ceil(n * percent / 100) * MORE / 100) + 1


def set_number(tokens: np.ndarray) -> int:
    return int(mixed(mixed(tokens).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(tokens))).view(np.int64)[0])


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Bits of the tokens' low parts: four to eight for each token, a power of two of 64-bit words, eight at least."""
    words = 8
    while words * 16 < len(tokens):
        words *= 2
    at = tokens & np.uint64(64 * words - 1)
    out = np.zeros(words, np.uint64)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def smallest_hashes(tokens: np.ndarray) -> np.ndarray:
    """The smallest token under two orders; linked sets have the same one more often than not."""
    return np.array([tokens[0], mixed(tokens).min()], np.uint64) if len(tokens) else np.zeros(2, np.uint64)


def folded(a: Column, b: Column) -> Column:
    """Bitmap ``a`` at the size of ``b`` where that is half of its own."""
    half = F.zip_with(F.slice(a, F.lit(1), F.size(b)), F.slice(a, F.size(b) + 1, F.size(b)), lambda x, y: x.bitwiseOR(y))
    return F.when(F.size(a) > F.size(b), half).otherwise(a)


def lacking(a: Column, b: Column) -> Column:
    """At least so many tokens of ``a`` are not in ``b``, by their bitmaps, of which none is over twice the other."""
    beyond = F.zip_with(folded(a, b), folded(b, a), lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
    return F.aggregate(beyond, F.lit(0), lambda n, k: n + k)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)))


def _batches(batch: pa.RecordBatch, k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for at in range(0, batch.num_rows, 256):
        part = batch.slice(at, 256)
        yield part, list(shingle_sets(part.column("text").to_pylist(), k))


def heads_of(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _batches(batch, k):
                sizes = [len(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([set_number(s) if len(s) else 0 for s in sets], pa.int64()), pa.array(sizes, pa.int64()), _lists([s[: prefix_size(len(s), percent)] for s in sets])],
                    names=["doc_id", "number", "n", "head"],
                )

    return run


def whole_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _batches(batch, k):
                yield pa.RecordBatch.from_arrays([pa.array([set_number(s) if len(s) else 0 for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _lists(sets), _lists([bitmap(s) for s in sets]), _lists([smallest_hashes(s) for s in sets])], names=["number", "n", "tokens", "bits", "keys"])

    return run


def linked(both: Column, a: Column, b: Column, percent: int) -> Column:
    return both * 100 >= (a + b - both) * percent


def needed(a: Column, b: Column, percent: int) -> Column:
    """Tokens that linked sets of these sizes share at least."""
    return F.ceil((a + b) * percent / (100 + percent) - 1e-9)


def band(n: Column) -> Column:
    return F.floor(F.log(n) / float(np.log(BAND))).cast("int")


def near_sizes(a: Column, b: Column, percent: int) -> Column:
    return (a * 100 >= b * percent) & (b * 100 >= a * percent)


def in_question(heads: DataFrame, percent: int) -> DataFrame:
    """set_id of the sets that share enough leading tokens with others; ``heads`` has set_id, n and head."""
    each = heads.select("set_id", F.explode("head").alias("token"))
    shared = each.groupBy("token").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).where("low < high").select("token")
    counted = each.join(shared, "token").groupBy("set_id").agg(F.count("*").alias("shared"))
    return counted.join(heads.select("set_id", "n"), "set_id").where(F.col("shared") >= must_share(F.col("n"), percent)).select("set_id")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) of sets of near sizes those that link: first by bitmaps, then by all tokens."""
    side = lambda k, *more: sets.select(F.col("set_id").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in more))
    close = pairs.join(side("a", "n", "bits"), "a").join(side("b", "n", "bits"), "b")
    most = F.least(F.col("n_a") - lacking(F.col("bits_a"), F.col("bits_b")), F.col("n_b") - lacking(F.col("bits_b"), F.col("bits_a")))
    close = written(close.where(linked(most, F.col("n_a"), F.col("n_b"), percent)).select("a", "b", "n_a", "n_b"), "close")
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return close.join(side("a", "tokens"), "a").join(side("b", "tokens"), "b").where(linked(both, F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def classed(sets: DataFrame, links: list[DataFrame]) -> DataFrame:
    """(set_id, n, cls): the class of each set after these links."""
    base = sets.select("set_id", "n")
    if not links:
        return base.withColumn("cls", F.col("set_id"))
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    roots = components(every)
    return written(base.join(roots, F.col("set_id") == F.col("node"), "left").select("set_id", "n", F.coalesce("root", "set_id").alias("cls")), "classes")


def across(each: DataFrame, least: Column) -> DataFrame:
    """(set_id, n, cls) of the sets with at least ``least`` tokens that sets of other classes have as well."""
    shared = each.groupBy("token").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high").select("token")
    return each.join(shared, "token").groupBy("set_id", "n", "cls").agg(F.count("*").alias("shared")).where(F.col("shared") >= least).select("set_id", "n", "cls")


def by_representatives(k: int):
    """Links to the representatives of families, which are the sets with one ``k``-th smallest hash.

    A family's consensus is what over half of its members have. A member differs from it by the tokens it lacks and
    those it has besides. Two members that lack ``m`` tokens each share the consensus less both ``m``, plus the
    differences that they have in common: so of all links without a common difference the nearest member has one, and
    for any other link there is a difference, whose nearest member stands for it. A member is compared with these few
    only, so the pairs grow with the differences and not with the square of a family. What this leaves is for the
    matrix.
    """

    def find(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
        members = sets.select("set_id", F.col("keys")[k].alias("family"), "tokens").join(classes, "set_id")
        mixed_up = members.groupBy("family").agg(F.count("*").alias("members"), F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high").select("family", "members")
        members = written(members.join(mixed_up, "family"), "family-members")
        counts = members.select("family", "members", F.explode("tokens").alias("token")).groupBy("family", "token").agg(F.count("*").alias("have"), F.first("members").alias("members"))
        shares = F.ceil(F.col("members") / FAMILY)
        consensus = counts.where("2 * have > members").groupBy("family").agg(F.collect_list("token").alias("consensus"), F.first("members").alias("members"))
        consensus = consensus.select("family", "consensus", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share"))
        members = members.withColumn("share", F.pmod(F.xxhash64("set_id"), shares))
        lacks, besides = F.array_except("consensus", "tokens"), F.array_except("tokens", "consensus")
        apart = members.join(consensus, ["family", "share"]).select("set_id", "n", "cls", "family", F.size("consensus").alias("common"), lacks.alias("lacks"), besides.alias("besides"))
        m, unlike = F.size("lacks"), F.size("lacks") + F.size("besides")
        # of two that link, one within reach of the consensus has the other within twice that
        apart = apart.where((F.col("common") - m) * 100 >= (F.col("common") + F.size("besides")) * (2 * percent - 100))
        far = ((100 + percent) * m + percent * F.col("n")).alias("far")
        # the family itself comes first in each list of differences, so that its nearest member has a list as well
        difference = F.concat(F.array(F.lit(0).cast("long")), "besides", F.transform("lacks", lambda t: F.bitwise_not(t)))
        each = written(apart.select("set_id", "n", "cls", "family", "common", m.alias("m"), unlike.alias("unlike"), far, difference.alias("differences")), "differences")
        each = each.withColumn("difference", F.explode("differences")).drop("differences")
        first = each.groupBy("family", "difference").agg(F.min(F.struct("far", "set_id", "n", "m", "unlike", "cls")).alias("first"), F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high")
        pairs = each.join(first.select("family", "difference", "first"), ["family", "difference"])
        short = needed(F.col("n"), F.col("first.n"), percent) - F.col("common") + F.col("m") + F.col("first.m")
        pairs = pairs.where((F.col("cls") != F.col("first.cls")) & near_sizes(F.col("n"), F.col("first.n"), percent) & (short <= F.least("unlike", "first.unlike")))
        pairs = written(pairs.select(F.col("set_id").alias("a"), F.col("first.set_id").alias("b")).distinct(), "representative-pairs")
        return written(verified(pairs, sets, percent), "representative-links")

    return find


def by_groups(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across classes by the token-group matrix.

    All tokens are put in one order, those of a single class first, then by how many sets have them. Two sets that
    link have their first common token where both have at least as many tokens left as they must share; the smaller
    one's therefore lies among its first ``n`` less ``needed(n, n)``. Groups are of one length band and one smallest
    hash. A group's column of the matrix has these first tokens of its members; a set asks the groups that its own
    first tokens name, in the bands where its partners can be. Those whose union of tokens shares enough with
    the set are opened, and there it is compared with the members that have the token in question.
    """
    n = F.col("n")
    each = sets.select("set_id", F.explode("tokens").alias("token")).join(classes, "set_id")
    spread = each.groupBy("token").agg(F.count("*").alias("have"), F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high").select("token", "have")
    order = F.sort_array(F.collect_list(F.struct("have", "token")))
    ranked = each.join(spread, "token").groupBy("set_id", "n", "cls").agg(order.alias("order"))
    alone = n - F.size("order")
    leading = (n - F.ceil(n * percent / 100) + 1 - alone).cast("int")
    ranked = ranked.where(leading > 0).select("set_id", "n", "cls", alone.alias("alone"), F.slice("order", F.lit(1), leading).alias("order"))
    ranked = written(ranked, "open-sets")
    base = ranked.select("set_id", "n", "cls", band(n).alias("band")).join(sets.select("set_id", F.col("keys")[0].alias("key")), "set_id")
    alike = base.groupBy("band", "key").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n") / GROUP_TOKENS)).alias("groups"))
    part = F.struct("band", "key", F.pmod(F.xxhash64("set_id"), F.col("groups")).alias("k"))
    groups = written(base.join(alike, ["band", "key"]).select("set_id", part.alias("part")), "groups")
    first = ranked.select("set_id", "n", "cls", "alone", F.posexplode("order").alias("at", "next"))
    first = first.select("set_id", "n", "cls", F.col("next.token").alias("token"), (n - F.col("alone") - F.col("at")).alias("left"))
    inside = first.where(F.col("left") >= needed(n, n, percent)).join(groups, "set_id").withColumn("band", band(n))
    inside = written(inside, "columns")
    columns = inside.groupBy("token", "band", "part").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("left").alias("left_"), F.min("cls").alias("low"), F.max("cls").alias("high"))
    smallest = F.ceil(n * percent / 100)
    largest = F.least(n, F.floor(F.col("left") * (100 + percent) / percent) - n)
    asking = first.withColumn("smallest", smallest).withColumn("largest", largest).where("smallest <= largest")
    asking = asking.withColumn("band", F.explode(F.sequence(band(F.col("smallest")), band(F.col("largest")))))
    partner = F.greatest("least", "smallest")
    other = (F.col("low") != F.col("cls")) | (F.col("high") != F.col("cls"))
    asked = asking.join(columns, ["token", "band"]).where((F.col("least") <= F.col("largest")) & (F.col("most") >= F.col("smallest")) & other & (needed(n, partner, percent) <= F.col("left_")))
    asked = written(asked.select("set_id", "n", "cls", "token", "left", "part", partner.alias("partner")), "asked")
    wanted = asked.select("part").distinct()
    held = groups.join(wanted, "part", "left_semi").join(sets.select("set_id", "tokens"), "set_id")
    matrix = held.groupBy("part").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("union"))
    bounded = asked.groupBy("set_id", "n", "part").agg(F.min("partner").alias("partner")).join(sets.select("set_id", "tokens"), "set_id").join(matrix, "part")
    opened = written(bounded.where(F.size(F.array_intersect("tokens", "union")) >= needed(n, F.col("partner"), percent)).select("set_id", "part"), "opened")
    compared = asked.join(opened, ["set_id", "part"], "left_semi").select(F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.col("cls").alias("cls_a"), F.col("left").alias("left_a"), "token", "part")
    least = needed(F.col("n_a"), n, percent)
    smaller = F.struct("n", "set_id") < F.struct(F.col("n_a").alias("n"), F.col("a").alias("set_id"))
    pairs = compared.join(inside, ["token", "part"]).where(smaller & (F.col("cls") != F.col("cls_a")) & near_sizes(F.col("n_a"), n, percent) & (F.col("left_a") >= least) & (F.col("left") >= least))
    pairs = written(pairs.select("a", F.col("set_id").alias("b")).distinct(), "group-pairs")
    return written(verified(pairs, sets, percent), "group-links")


def jaccard_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of ``docs``.

    Texts link when ``percent`` hundredths of their shingles' union are shared; component_id is the smallest
    identifier that links reach, a document's own included. A text with fewer than ``k`` words is one shingle; null
    and empty ones have none and link with nothing. Rows that repeat an identifier belong to the sets of all
    their texts; a null identifier is smaller than none and stays null where a component has no other. Shingles
    are told apart by 64-bit hashes. Other columns of ``docs`` are not read, whatever their names. An empty table
    gives no rows.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    heads = written(texts.mapInArrow(heads_of(k, percent), HEADS).withColumn("row", F.monotonically_increasing_id()), "heads")
    full = heads.where("n > 0")
    # the first row of each set stands for it and numbers it
    reps = written(full.groupBy("number", "n").agg(F.min("row").alias("set_id"), F.min("doc_id").alias("rep"), F.min_by("doc_id", "row").alias("read_id")), "sets")
    chosen = full.join(reps.select("set_id").hint("shuffle_hash"), F.col("row") == F.col("set_id"), "left_semi").select(F.col("row").alias("set_id"), "n", "head")
    live = written(in_question(chosen, percent).join(reps, "set_id"), "in-question")
    # again among themselves, by the same leading tokens
    live = written(in_question(chosen.join(live.select("set_id"), "set_id", "left_semi"), percent).join(reps, "set_id"), "in-question")
    n_live = live.count()
    few = F.broadcast if n_live <= BROADCAST_IDS else (lambda x: x)
    in_doubt = texts.join(few(live.select(F.col("read_id").alias("id__")).distinct()), F.col("doc_id").eqNullSafe(F.col("id__")), "left_semi")
    sets = written(in_doubt.select("text").mapInArrow(whole_sets(k), SETS).join(few(live.select("number", "n", "set_id")), ["number", "n"]).select("set_id", "n", "tokens", "bits", "keys"), "token-sets")
    if sets.count() > n_live:  # identifiers repeat
        sets = written(sets.dropDuplicates(["set_id"]), "token-sets")
    # the coarsest bound: all other sets as one group
    whole = sets.select("set_id", "n", F.col("set_id").alias("cls"), F.explode("tokens").alias("token"))
    sets = written(sets.join(across(whole, F.ceil(F.col("n") * percent / 100)).select("set_id"), "set_id", "left_semi"), "open-sets")
    links: list[DataFrame] = []
    classes = classed(sets, links)
    for find in [*map(by_representatives, range(ROUNDS)), by_groups]:
        new = find(classes, sets, percent)
        if not new.isEmpty():
            links.append(new)
            classes = classed(sets, links)
    grouped = classes.join(reps.select("set_id", "rep"), "set_id").groupBy("cls").agg(F.min("rep").alias("component_id"))
    moved = classes.join(grouped, "cls").select("set_id", "component_id")
    info = written(reps.join(moved, "set_id", "left").select(F.col("number").alias("s__"), F.col("n").alias("n__"), F.coalesce("component_id", "rep").alias("component_id")), "set-components")
    named = heads.select("doc_id", "number", "n")
    linked_rows = named.where("n > 0").join(info, (F.col("number") == F.col("s__")) & (F.col("n") == F.col("n__")))
    alone = named.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked_rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)
