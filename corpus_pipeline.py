"""A corpus pipeline of five stages over ``documents``; each stage works on all rows that the one before it kept.

Stages read the five columns of ``documents`` and return them (the last one with its own beside them); whatever other columns
come in, under any name, do not matter. Null columns never drop a row, texts of any length are read whole, and an empty
table stays empty. What a stage does with rows that repeat is said there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import toxicity as toxic
from strataloom.llm.common import table, text_of, written
from strataloom.llm.decontamination import contamination
from strataloom.llm.mixing import mix_sources, repeated
from strataloom.llm.ngram_jaccard import jaccard_components
from strataloom.llm.sharding import shard_by_bytes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: The learned grammar, the similarity join and the draw of the mix cannot be written in SQL.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, fitted on the labelled rows among them, scores from 0.7 on go.

    Rows that repeat a text share its score, so all of them stay or go. Null and empty texts stay.
    """
    model = toxic.learn(docs, table(spark, sf_dir, "labels"))
    return toxic.score_toxicity(docs, model).where("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the document with the smallest identifier stays; texts without words stay.

    A null identifier says nothing of its group's first and so stays as well. Of rows with one identifier (or none)
    and one text one stays. Words and share are those of op8's contract, which is taken to bind the stage.
    """
    found = jaccard_components(docs.select("doc_id", "text"))
    kept = written(found.where("n_shingles > 0 and doc_id = component_id").select(F.col("doc_id").alias("kept__")).distinct(), "kept")
    empty = F.length(F.regexp_replace(text_of(), r"[\x20\x09-\x0D]+", "")) == 0
    by_id = docs.join(kept.hint("shuffle_hash"), F.col("doc_id") == F.col("kept__"), "left_semi")
    rows = by_id.where(~empty).unionByName(docs.where(F.col("doc_id").isNull() & ~empty).select(*by_id.columns))
    # rows that repeat are put together inside the tasks first, under a digest and not their whole text
    first = F.min(F.struct(*COLUMNS[2:], "text")).alias("row")
    one = rows.groupBy("doc_id", F.sha2("text", 256).alias("digest")).agg(first).select("doc_id", "row.*")
    return one.select(*COLUMNS).unionByName(docs.where(empty).select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words repeat windows of the benchmark go.

    Rows that repeat a text share its fate. Null and empty texts, which repeat nothing, stay.
    """
    found = contamination(docs, table(spark, sf_dir, "benchmark"), unnamed=True)
    return found.where(~((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Rows that repeat identifier, source and size are taken equally often; a null source is one source, the last.
    """
    return repeated(mix_sources(docs), COLUMNS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard of eight and its slot there; rows that repeat have slots of their own."""
    placed = shard_by_bytes(docs, 8)
    return placed.select(*COLUMNS, "size", "text_crc32", "shard", "slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's rows are a table in the shared folder that the next one reads."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
