"""What must not grow with the tables: rows of a task, reads of a text, bytes that are written."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from strataloom.operators import change, mentions, rollup, text, trials
from strataloom.plans import bind, change_queries, source_queries


def test_touches_are_dealt_by_rows(spark, small, monkeypatch):
    monkeypatch.setattr(bind, "TASK_ROWS", 500)
    n = bind.tasks_for(bind.load(spark, small, "lineitem"))
    assert n > 4 and "hashpartitioning(l_orderkey#" in bind.touches(spark, small)._jdf.queryExecution().toString() and f", {n})" in bind.touches(spark, small)._jdf.queryExecution().toString()


def test_churn_by_tasks(spark):
    rows = [("p", 1, 7, 2), ("p", 1, 7, 3), ("p", 2, 7, 1), ("p", None, 8, 1), ("p", 3, None, 1), ("q", 1, 7, None), (None, 1, 1, 1), (None, 1, 2, 1)]
    df = spark.createDataFrame(rows, "path string, sha long, author long, added long")
    plain = lambda x: sorted(map(str, x.collect()))
    assert plain(rollup.churn(df, 3)) == plain(rollup.churn(df)) and plain(rollup.contributors(df, tasks=3)) == plain(rollup.contributors(df))


def test_plain_paths_need_no_automaton(spark, monkeypatch):
    def never(*_):
        raise AssertionError("an automaton was asked for")

    monkeypatch.setattr(mentions, "finder", never)
    docs = spark.createDataFrame([(1, "see a\\b.rs. and a/b.rs"), (2, "xa/b.rs"), (3, "a/b.rs..")], "doc long, body string")
    found = mentions.path_mentions(docs, spark.createDataFrame([("a/b.rs",)], "path string"), 1)
    assert [tuple(r) for r in found.collect()] == [(1, "a/b.rs", 4, "see a\\b.rs. and a/b.rs")]


def test_trees_read_their_sides_once(spark, small, monkeypatch):
    cuts = []
    kept = change.cut
    monkeypatch.setattr(change, "cut", lambda df, name: cuts.append(name) or kept(df, name))
    change_queries.declaration_trees(spark, small)
    assert cuts[:2] == ["tree-base", "tree-head"]


def test_packed_texts(spark):
    rows = spark.range(2000).select(F.format_string('{"runs":[%d]}', "id").alias("value"))
    size = {p: sum(os.path.getsize(f"{d}/{f}") for f in os.listdir(d) if f.startswith("part-")) for p in (False, True) for d in [source_queries._written(rows, "texts", packed=p).removeprefix("file://")]}
    assert size[True] * 2 < size[False]


def test_multiplicity(spark):
    got = spark.range(400).select("id", trials.multiplicity(F.col("id"), F.col("id") % 7).alias("n")).collect()
    want = lambda i: sum(p <= int(hashlib.md5(f"{i}|{i % 7}".encode()).hexdigest()[:13], 16) / 16**13 for p in trials.POISSON)
    assert [r["n"] for r in got] == [want(r["id"]) for r in got]


@pytest.mark.parametrize("seed", range(2))
def test_redacted_is_its_patterns(spark, seed):
    import random

    rng = random.Random(seed)
    parts = ["token", "to-ken", "Api Key", "api_key", "=", ":", " ", "\n", "\r", " ", "x1y2", "changeme", '"', "- ", "Authorization", "bearer ", "-----BEGIN RSA ", "PRIVATE KEY-----", "AKIA" + "A1" * 8, "secret", ";", "\t"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))),) for _ in range(4000)] + [(None,), ("",)]
    df = spark.createDataFrame(rows, "t string")
    plain = F.lit(False)
    for pattern in text._secret_patterns():
        plain = plain | F.col("t").rlike(pattern)
    wrong = df.where(~text.redacted(F.col("t")).eqNullSafe(F.when(~plain, F.col("t"))))
    assert wrong.collect() == [] and df.where(text.redacted(F.col("t")).isNull()).count() > 100
