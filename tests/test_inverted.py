"""The written index: what is shuffled, what an update writes, and searches of repeated rows."""

import pytest
from pyspark.sql import functions as F

from strataloom.operators import inverted

ROWS = [(1, "name", "Licensed brands"), (1, "name", "licensing of brands, licensed"), (1, "path", "brand/asia"), (2, "name", "asia"), (3, "path", None), (4, "name", "the licence of asia"), (5, "path", "")]


def rows(spark, of=ROWS):
    return spark.createDataFrame(of, "key long, field string, text string")


def plain(index):
    found = index.postings.groupBy("stem", "key", "field").agg(F.sum("tf").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("at"), F.max("n").alias("n"))
    return sorted(tuple(r) for r in found.collect())


def test_postings(spark):
    found = plain(inverted.build(rows(spark)))
    assert ("licens", 1, "name", 3, [0, 0, 3], 8) in found and ("asia", 4, "name", 1, [3], 4) in found
    assert {k for _, k, *_ in found} == {1, 2, 4}


def test_a_row_becomes_its_postings_without_a_shuffle(spark):
    plan = inverted._posted(rows(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_update_writes_changed_documents_only(spark):
    index = inverted.build(rows(spark))
    now = [r for r in ROWS if r[0] != 2 and r != ROWS[5]] + [(4, "name", "released in asia"), (6, "name", "asia")]
    again = inverted.updated(index, rows(spark, now))
    assert plain(again) == plain(inverted.build(rows(spark, now)))
    written = spark.read.parquet(f"{again.folders[-1]}/postings")
    assert {r["key"] for r in written.select("key").distinct().collect()} == {4, 6}
    assert sorted(tuple(r) for r in again.lengths.select("key", "n").collect()) == [(1, 8), (3, 0), (4, 3), (5, 0), (6, 1)]


@pytest.mark.parametrize("generations", [0, 1, 8])
def test_many_updates(spark, monkeypatch, generations):
    monkeypatch.setattr(inverted, "GENERATIONS", generations)
    index, now = inverted.build(rows(spark)), ROWS
    for step in range(3):
        now = [r for r in now if r[0] != step] + [(10 + step, "name", f"asia released {step}")]
        index = inverted.updated(index, rows(spark, now))
    index = inverted.updated(index, rows(spark, now))
    fresh = inverted.build(rows(spark, now))
    assert plain(index) == plain(fresh)
    for of in (lambda i: inverted.search(i, "asia OR brands", 3), lambda i: inverted.recall(i, ["asia", "brand", "released"], 2), lambda i: inverted.concept(i, "brands of asia", 5), lambda i: inverted.search(i, '"asia releases"', 5)):
        assert [tuple(r) for r in of(index).collect()] == [tuple(r) for r in of(fresh).collect()]
    assert len(index.folders) <= max(1, generations) + 1
