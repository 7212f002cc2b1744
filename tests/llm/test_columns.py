"""Every operator over a table whose other columns bear each name that any of them works with."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strataloom import llm
from strataloom.llm import decontamination, exact_dedup, hard_negatives, html_extraction, language_id, license_scan, mixing, nearest, ngram_jaccard, sharding, spelling, token_counts, toxicity

TEXTS = ["One two three four five six seven eight nine ten eleven twelve thirteen fourteen.", "Eins zwei drei, vier fünf!", None, "", "a", "You are a fool and an idiot."]


def working_names():
    """Names in quotes in the sources, among them all that columns of the work have."""
    found = set()
    for file in Path(llm.__file__).parent.glob("*.py"):
        found |= set(re.findall(r'"([a-z][a-z_0-9]*)"', file.read_text()))
    return sorted((found | {"best", "a.b", "x y", "ti`ck", "own_0", "own_1"}) - {"doc_id", "text", "source", "lang", "html", "page_id", "vec_id", "embedding", "label"})


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(i, t, f"s{i % 2}", "en") for i, t in enumerate(TEXTS + TEXTS[:2])], "doc_id long, text string, source string, lang string")
    return rows.select("*", *(F.lit(f"kept {n}").alias(n) for n in working_names()))


def held(df, added):
    """The caller's columns keep their values; those that the operator adds may replace theirs."""
    names = [n for n in working_names() if n not in added]
    assert [c for c in df.columns if c in set(names)] == names
    rows = df.select(*(F.col("`" + n.replace("`", "``") + "`") for n in names)).collect()
    assert len(rows) == len(TEXTS) + 2 and all(list(r) == [f"kept {n}" for n in names] for r in rows)


def test_names_are_many():
    assert {"best", "a.b", "ident", "hash", "id__", "own_id__", "content", "source_b", "extra__", "cell", "group"} <= set(working_names())


def test_documents(spark, docs, tmp_path):
    held(exact_dedup.exact_dedup(docs), ("keep_id", "group_size", "kept", "text_sha256"))
    held(html_extraction.extract_main_text(docs.withColumnRenamed("text", "html")), ("text", "n_chars"))
    held(license_scan.scan_licenses(docs), ("license", "dice", "licenses", "n_spans"))
    held(language_id.identify(docs, language_id.learn(docs)), ("lang_pred", "score", "rejected"))
    held(decontamination.contamination(docs, docs.select(F.col("doc_id").alias("item_id"), "text")), ("n_words", "n_hit", "n_items", "items", "n_near", "contaminated"))
    held(mixing.mix_sources(docs), ("size", "source_size", "target", "copies", "taken"))
    held(sharding.shard_by_bytes(docs, 3), ("size", "text_crc32", "shard", "slot"))
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    held(toxicity.score_toxicity(docs, toxicity.learn(docs, labels)), ("score", "predicted"))
    import public_tokenizers

    held(token_counts.token_counts(docs, str(public_tokenizers.path("byte_bpe_50k.json")), f"file://{tmp_path}/cache"), ("n_bytes", "n_tokens"))


def test_those_that_give_rows_of_their_own(spark, docs):
    assert ngram_jaccard.jaccard_components(docs).count() == len(TEXTS) + 2
    assert spelling.spelling_variants(docs, often=1).count() > 0
    vectors = docs.select("*", F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.col("doc_id").cast("double")).alias("embedding"), (F.col("doc_id") % 2).alias("label"))
    vectors = vectors.drop("rows", "vector").withColumns({"rows": F.lit(1), "vector": F.lit("x")})
    assert nearest.nearest(vectors, vectors.where("vec_id = 0"), 3).count() == 3
    assert hard_negatives.hard_negatives(vectors, F.col("vec_id") == 1).count() >= 0
