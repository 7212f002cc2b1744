"""A written inverted index of Porter stems with positions, and searches that read it.

``postings`` has a row for each stem of a field of a document (stem, key, field, tf, positions), in folders by a hash of
the stem, so a search reads the folders of its own stems only. A row of text becomes its postings inside its task; they are
shuffled once, into their folders. ``lengths`` has a row for each document with a digest of its text and the generation that holds its postings; an update writes a new generation with the
changed documents alone, and what an older one has of them is left out when it is read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from strataloom.operators import search as fts
from strataloom.operators.bounds import page
from strataloom.operators.store import bounded_batches, cut, new_folder
from strataloom.operators.text import B, FIELD_WEIGHTS, K1, floors, porter, question_terms, tokens

#: Folders of the postings; documents that a shard aims at; generations beyond which an update writes all postings anew.
BUCKETS, SHARD_DOCS, GENERATIONS = 64, 4096, 8
_STEMS: dict[str, str] = {}


def _stem(w: str) -> str:
    found = _STEMS.get(w)
    if found is None:
        if len(_STEMS) > 1 << 18:
            _STEMS.clear()
        found = _STEMS[w] = porter(w)
    return found


def _poster() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, field, words) to (stem, key, field, positions): a row for each stem of a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            sizes = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            coded = words.flatten().dictionary_encode()
            if not len(coded):
                continue
            stems: dict[str, int] = {}
            of_word = np.array([stems.setdefault(_stem(w), len(stems)) for w in coded.dictionary.to_pylist()], np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(coded)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            own = row * len(stems) + of_word[coded.indices.to_numpy(zero_copy_only=False)]
            order = np.argsort(own, kind="stable")
            own = own[order]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            rows = own[first] // len(stems)
            positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(own)), pa.int32()), pa.array(at[order], pa.int32()))
            columns = [pa.array(list(stems), pa.string()).take(pa.array(own[first] % len(stems))), batch.column("key").take(pa.array(rows)), batch.column("field").take(pa.array(rows)), positions]
            yield pa.RecordBatch.from_arrays(columns, names=["stem", "key", "field", "positions"])

    return run


@dataclass
class Index:
    """``folders`` are the generations, the newest last; its ``lengths`` tell which documents are there and where."""

    spark: SparkSession
    folders: tuple[str, ...]
    shards: int

    @property
    def lengths(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folders[-1]}/lengths")

    @property
    def postings(self) -> DataFrame:
        return self._live(self._stored())

    def _stored(self) -> DataFrame:
        schema = _schema(self.lengths.schema["key"].dataType, "tf long, positions array<int>, shard int, bucket int")
        every = None
        for g, folder in enumerate(self.folders):
            own = self.spark.read.schema(schema).parquet(f"{folder}/postings").withColumn("generation", F.lit(g))
            every = own if every is None else every.unionByName(own)
        return every

    def _live(self, rows: DataFrame) -> DataFrame:
        """``rows`` of the documents as they are now, with the document's length n."""
        return rows.join(self.lengths.select("key", "generation", "n"), ["key", "generation"]).drop("generation")

    def of_stems(self, stems: list[str], prefixes: list[str] = ()) -> DataFrame:
        """Postings of some stems; the folders of others are not read, unless there are prefixes, which may be anywhere."""
        rows = self._stored()
        if not prefixes:
            of = F.array(*map(F.lit, stems))
            buckets = self.spark.range(1).select(F.transform(of, lambda s: _bucket(s)).alias("b")).collect()[0]["b"]
            rows = rows.where(F.col("bucket").isin(*set(buckets)))
        hit = F.col("stem").isin(*stems) if stems else F.lit(False)
        for p in prefixes:
            hit = hit | F.col("stem").startswith(p)
        return self._live(rows.where(hit))


def _schema(key: DataType, more: str) -> StructType:
    of = StructType().add("stem", "string").add("key", key).add("field", "string")
    return StructType(of.fields + StructType.fromDDL(more).fields)


def _bucket(stem: Column) -> Column:
    return F.pmod(F.xxhash64(stem), F.lit(BUCKETS)).cast("int")


def _documents(rows: DataFrame, counted: bool = True) -> DataFrame:
    """(key, digest) of ``rows`` (key, field, text) and n, its words, if they are ``counted``; digests travel, not texts."""
    own = F.sha2(F.concat_ws("\x01", "field", F.coalesce("text", F.lit(""))), 256)
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list("own")), "\x02"), 256)
    n = F.size(tokens(F.coalesce("text", F.lit("")))) if counted else F.lit(0)
    every = rows.select("key", own.alias("own"), n.alias("n")).groupBy("key").agg(digest.alias("digest"), F.sum("n").alias("n"))
    return every if counted else every.drop("n")


def _posted(rows: DataFrame) -> DataFrame:
    """(stem, key, field, positions); rows that repeat key and field have postings of their own."""
    bounded_batches(rows.sparkSession)
    schema = _schema(rows.schema["key"].dataType, "positions array<int>")
    return rows.select("key", "field", tokens(F.coalesce("text", F.lit(""))).alias("words")).mapInArrow(_poster(), schema)


def _write(postings: DataFrame, documents: DataFrame, shards: int, before: tuple[str, ...] = ()) -> Index:
    """A generation of ``postings`` (stem, key, field, positions) and of all ``documents`` (key, digest, n, generation)."""
    spark = postings.sparkSession
    folder = new_folder(spark, "inverted-index")
    shard, bucket = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"), _bucket(F.col("stem"))
    # a common stem fills several tasks, by the shards of its documents; what follows from other columns is not shuffled
    rows = postings.repartition(bucket, shard % 16).select("stem", "key", "field", F.size("positions").cast("long").alias("tf"), "positions", shard.alias("shard"), bucket.alias("bucket"))
    rows.write.partitionBy("bucket").parquet(f"{folder}/postings")
    documents.select("key", "digest", "n", "generation").write.parquet(f"{folder}/lengths")
    return Index(spark, (*before, folder), shards)


def _weights(weights: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("field"))


def build(rows: DataFrame) -> Index:
    """The index of ``rows`` (key, field, text). A null text has no words; rows that repeat key and field add up."""
    documents = _documents(rows).withColumn("generation", F.lit(0))
    n = rows.select("key").distinct().count()
    shards = 1 << max(0, (max(1, n // SHARD_DOCS) - 1).bit_length())
    return _write(_posted(rows), documents, shards)


def updated(index: Index, rows: DataFrame) -> Index:
    """The next generation for the ``rows`` of now: only documents that are new or have another digest are tokenised.

    It holds the postings of those alone. With ``GENERATIONS`` before it, all postings that still count go into one.
    """
    now = _documents(rows, counted=False)
    same = cut(now.join(index.lengths.select("key", "digest", "n", "generation"), ["key", "digest"]), "unchanged")
    fresh = rows.join(same.select("key"), "key", "left_anti")
    last = len(index.folders)
    changed = _documents(fresh).withColumn("generation", F.lit(last))
    documents = same.select(*changed.columns).unionByName(changed)
    if last < GENERATIONS:
        return _write(_posted(fresh), documents, index.shards, index.folders)
    kept = index._stored().join(same.select("key", "generation"), ["key", "generation"], "left_semi").select("stem", "key", "field", "positions")
    return _write(kept.unionByName(_posted(fresh)), documents.withColumn("generation", F.lit(0)), index.shards)


def occurrences(index: Index, query: fts.Query) -> DataFrame:
    """(key, n, leaf, tf): how often each leaf of a query occurs; words are stems, a star asks for a beginning of stems.

    A leaf of one word takes its frequency from the posting; only phrases and nearness open positions.
    """
    last = lambda p, k: p.prefix and k == len(p.words) - 1
    wanted = [(i, j, k, w if last(p, k) else porter(w), last(p, k)) for i, leaf in enumerate(query.leaves) for j, p in enumerate(leaf.phrases) for k, w in enumerate(p.words)]
    rows = index.of_stems(sorted({w for *_, w, star in wanted if not star}), sorted({w for *_, w, star in wanted if star}))
    single = {i for i, leaf in enumerate(query.leaves) if leaf.within is None and len(leaf.phrases[0].words) == 1}
    asked = F.array(*(F.struct(F.lit(i).alias("leaf"), F.lit(j).alias("phrase"), F.lit(k).alias("offset"), F.lit(w).alias("word"), F.lit(star).alias("star")) for i, j, k, w, star in wanted))
    hits = rows.select("key", "n", "tf", "positions", F.explode(F.filter(asked, lambda x: (F.col("stem") == x["word"]) | (x["star"] & F.col("stem").startswith(x["word"])))).alias("x"))
    plain = hits.where(F.col("x.leaf").isin(*single)).groupBy("key", "n", F.col("x.leaf").alias("leaf")).agg(F.sum("tf").alias("tf")) if single else None
    found = plain
    if len(single) < len(query.leaves):
        each = hits.where(~F.col("x.leaf").isin(*single)) if single else hits
        each = each.select("key", "n", F.col("x.leaf").alias("leaf"), F.col("x.phrase").alias("phrase"), F.col("x.offset").alias("offset"), F.explode("positions").alias("pos"))
        sizes = F.create_map(*(F.lit(v) for i, leaf in enumerate(query.leaves) for j, p in enumerate(leaf.phrases) for v in (i * 1000 + j, len(p.words))))
        starts = each.groupBy("key", "n", "leaf", "phrase", (F.col("pos") - F.col("offset")).alias("start")).agg(F.count_distinct("offset").alias("met"))
        starts = starts.withColumn("size", sizes[F.col("leaf") * 1000 + F.col("phrase")]).where("met = size")
        for i, leaf in enumerate(query.leaves):
            if i in single:
                continue
            here = starts.where(F.col("leaf") == i)
            if leaf.within is not None:
                here = fts.near_each_other(here, "key", leaf)
            counted = here.groupBy("key", "n", "leaf").agg(F.count("*").alias("tf"))
            found = counted if found is None else found.unionByName(counted)
    return found


def search(index: Index, text: str, top: int, keys: DataFrame | None = None) -> DataFrame:
    """A page of (key, score) that a query admits, the best first, with the exact total; ``keys`` (key) are those counted."""
    query = fts.parse(text)
    docs, mean = index.lengths.agg(F.count("*"), F.avg("n")).collect()[0]
    found = cut(occurrences(index, query), "occurrences")
    rare = F.broadcast(found.groupBy("leaf").agg(F.count("*").alias("df")))  # a row for each leaf of the query
    rows = found.join(rare, "leaf").groupBy("key").agg(F.sum(part(F.col("tf"), F.col("n"), F.col("df"), docs, mean)).alias("score"), *(F.max((F.col("leaf") == i).cast("int")).alias(f"leaf_{i}") for i in range(len(query.leaves))))
    rows = rows.where(fts.holds(query.tree, lambda i: F.col(f"leaf_{i}") == 1)).select("key", F.round("score", 6).alias("score"))
    if keys is not None:
        rows = rows.join(keys.select("key").distinct(), "key", "left_semi")
    return page(rows, top, F.col("score").desc(), "key")


def part(tf: Column, n: Column, df: Column, docs: int, mean: float) -> Column:
    """What a term adds to a document's BM25 score; it rises with ``tf`` and falls with ``n``."""
    return F.log(1 + (docs - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / F.lit(mean or 1.0)))


def _asked(question: str) -> tuple[list[str], list[str]]:
    """(stems of all words, stems of those with weight), each once."""
    every = list(dict.fromkeys(porter(w) for w in re.split(r"[^\w]+|_", question.lower()) if w))
    weighty = {porter(w) for w in question_terms(question)}
    return every, [s for s in every if s in weighty] or every


def concept(index: Index, question: str, top: int) -> DataFrame:
    """A page of (key, hits, ranked_hits, score) for a question; terms are stems, floors as in ``search.concept``."""
    terms, ranking = _asked(question)
    n = len(terms)
    need, least = (n, 0) if n < 3 else (floors(n)[0], min(3, floors(n)[0], len(ranking)))
    rows = _scored(index, _weighted(index, terms)).groupBy("key").agg(F.count("*").alias("hits"), F.count_if(F.col("stem").isin(*ranking)).alias("ranked_hits"), F.round(F.sum(F.when(F.col("stem").isin(*ranking), F.col("part")).otherwise(0.0)), 6).alias("score"))
    return page(rows.where((F.col("hits") >= need) & (F.col("ranked_hits") >= least)), top, F.col("hits").desc(), F.col("score").desc(), "key")


def _weighted(index: Index, stems: list[str]) -> DataFrame:
    """(key, stem, shard, n, tf) of the postings of ``stems``, fields weighted."""
    weight = F.coalesce(_weights(FIELD_WEIGHTS), F.lit(1))
    return cut(index.of_stems(stems).groupBy("key", "stem", "shard", "n").agg(F.sum(weight * F.col("tf")).alias("tf")), "weighted")


def _rare(weighted: DataFrame) -> DataFrame:
    """(stem, df): a row for each term asked."""
    return F.broadcast(weighted.groupBy("stem").agg(F.count("*").alias("df")))


def _scored(index: Index, weighted: DataFrame, some: DataFrame | None = None) -> DataFrame:
    """(key, stem, part) of ``weighted``, or of ``some`` of its rows."""
    docs, mean = index.lengths.agg(F.count("*"), F.avg("n")).collect()[0]
    rows = weighted if some is None else some
    return rows.join(_rare(weighted), "stem").select("key", "stem", part(F.col("tf"), F.col("n"), F.col("df"), docs, mean).alias("part"))


def recall(index: Index, words: list[str], top: int) -> DataFrame:
    """A page of (key, hits, score): any of the words is enough, the best first, with the exact total.

    A shard's bound is the sum of its terms' bounds, from their largest weighted frequency and the least length. The shards of the highest bounds that hold ``top`` postings or more
    are scored first; their kth score leaves out every shard whose bound lies below it. The total comes from the keys of
    the postings alone.
    """
    stems = list(dict.fromkeys(porter(w.lower()) for w in words))
    docs, mean = index.lengths.agg(F.count("*"), F.avg("n")).collect()[0]
    rows = _weighted(index, stems)
    bounds = rows.groupBy("stem", "shard").agg(F.count("*").alias("postings"), F.max("tf").alias("most"), F.min("n").alias("shortest")).join(_rare(rows), "stem")
    bound = bounds.groupBy("shard").agg(F.sum(part(F.col("most"), F.col("shortest"), F.col("df"), docs, mean)).alias("bound"), F.sum("postings").alias("postings"))
    # shards are documents over SHARD_DOCS: their bounds stay a table, and only the first ones are named
    first = bound.orderBy(F.col("bound").desc(), "shard").limit(top).collect()
    chosen, held = [], 0
    for r in first:
        chosen.append(r["shard"])
        held += r["postings"]
        if held >= top * len(stems):
            break
    best = _scored(index, rows, rows.where(F.col("shard").isin(*chosen)) if chosen else rows.where("false"))
    kth = best.groupBy("key").agg(F.round(F.sum("part"), 6).alias("score")).orderBy(F.col("score").desc()).limit(top).agg(F.count("*"), F.min("score")).collect()[0]
    floor = kth[1] if kth[0] == top else 0.0
    left = rows.join(bound.where(F.col("bound") >= F.lit(floor) - 1e-6).select("shard"), "shard", "left_semi")
    scored = _scored(index, rows, left).groupBy("key").agg(F.count("*").alias("hits"), F.round(F.sum("part"), 6).alias("score"))
    total = rows.select("key").distinct().agg(F.count("*")).scalar()
    out = scored.orderBy(F.col("score").desc(), "key").limit(top).withColumn("total", total)
    returned = F.least(F.lit(top), F.col("total"))
    return out.withColumn("returned", returned).withColumn("truncated", F.col("total") > top).withColumn("truncation_reason", F.when(F.col("total") > top, "top"))
