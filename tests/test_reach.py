"""Reach by bit sets and strong components against brute force on random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from strataloom.operators import components, graph, reach


def brute_reach(steps, seeds, depth):
    into = {}
    for a, b in steps:
        into.setdefault(b, set()).add(a)
    out = {}
    for seed, start in seeds:
        level, seen = {start}, {start}
        for k in range(1, depth + 1):
            level = {x for y in level for x in into.get(y, ())} - seen
            seen |= level
            for x in level:
                out[seed, x] = k
    return out


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(3)
    steps = sorted({(rng.randrange(90), rng.randrange(90)) for _ in range(160)})
    seeds = [(i, i) for i in range(85)]
    found = reach.reach(spark.createDataFrame(steps, "from_id long, to_id long"), spark.createDataFrame(seeds, "seed long, id long"), 3)
    return found, brute_reach(steps, seeds, 3)


def test_pairs(case):
    found, want = case
    assert {(r.seed, r.id): r.depth for r in reach.pairs(found).collect()} == want
    assert found.numbers.select("word", "bit").distinct().count() == 85


def test_levels_stay_at_symbols_times_words(case):
    found, want = case
    words = found.numbers.select("word").distinct().count()
    per_level = found.levels.groupBy("depth").count().collect()
    assert all(r["count"] <= 90 * words for r in per_level)
    assert found.levels.count() < len(want) / 2  # a sparse graph; a dense one comes near a 64th


def test_counts(spark, case):
    found, want = case
    part = F.col("id") % 7
    of_id = spark.range(90).select("id", part.alias("part"))
    got = {r.part: (r.impacted, r.nearest, r.seeds) for r in reach.groups(found, of_id, "part").collect()}
    assert got == {p: (len({x for (s, x) in want if x % 7 == p}), min(d for (s, x), d in want.items() if x % 7 == p), len({s for (s, x) in want if x % 7 == p})) for p in {x % 7 for _, x in want}}
    sizes = {r.seed: r.n for r in reach.sizes(found, of_id, "part").collect()}
    assert sizes == {s: len({x % 7 for (t, x) in want if t == s}) for s in {s for s, _ in want}}
    assert {r.seed for r in reach.reaching(found).collect()} == {s for s, _ in want}
    some = spark.createDataFrame([(3,), (5,), (999,)], "seed long")
    assert {r.id for r in reach.any_of(found, some).collect()} == {x for (s, x) in want if s in (3, 5)}
    crossed = {(r.from_component, r.to_component): r.symbols for r in reach.crossings(found, spark.range(90).select(F.col("id").alias("seed"), part.alias("from_component")), of_id.withColumnRenamed("part", "to_component")).collect()}
    assert crossed == {(a, b): len({x for (s, x) in want if s % 7 == a and x % 7 == b}) for a, b in {(s % 7, x % 7) for s, x in want} if a != b}


def test_no_seeds(spark, case):
    steps = spark.createDataFrame([(1, 2)], "from_id long, to_id long")
    empty = reach.reach(steps, spark.createDataFrame([], "seed long, id long"))
    assert reach.pairs(empty).count() == 0 and reach.sizes(empty, spark.range(3).withColumn("k", F.col("id")), "k").count() == 0


def brute_components(pairs):
    found = {}
    for a, b in pairs:
        found.setdefault(a, set()).add(b)
    return sorted((m[0], x) for m in graph.strong_components(found) for x in m)


@pytest.mark.parametrize(("seed", "nodes", "share"), [(1, 12, 1.2), (2, 40, 1.1), (3, 30, 2.0)])
@pytest.mark.parametrize("local", [0, 10])
def test_components(spark, seed, nodes, share, local):
    rng = random.Random(seed)
    pairs = sorted({(f"n{rng.randrange(nodes):02d}", f"n{rng.randrange(nodes):02d}") for _ in range(int(nodes * share))})
    df = spark.createDataFrame([*pairs, ("z1", "z2"), ("z2", "z3"), ("z3", "z1"), ("z9", "z9")], "from_file string, to_file string")
    got = sorted(map(tuple, components.strong_nodes(df, local).collect()))
    assert got == brute_components([p for p in [*pairs, ("z1", "z2"), ("z2", "z3"), ("z3", "z1")] if p[0] != p[1]])


def test_long_chain_into_a_cycle(spark, monkeypatch):
    written = []
    cut = components.cut
    monkeypatch.setattr(components, "cut", lambda df, name: written.append(name) or cut(df, name))
    n = 10_000
    chain = spark.range(n).select(F.format_string("c%05d", "id").alias("from_file"), F.format_string("c%05d", F.col("id") + 1).alias("to_file"))
    back = spark.createDataFrame([(f"c{n:05d}", f"c{n - 4:05d}")], chain.schema)
    got = components.strong_nodes(chain.unionByName(back), 0).collect()
    assert sorted(r.node for r in got) == [f"c{i:05d}" for i in range(n - 4, n + 1)] and {r.root for r in got} == {f"c{n - 4:05d}"}
    assert len(written) < 60


def test_cycles_answer(spark):
    ring = lambda name, k: [(f"{name}{i}", f"{name}{(i + 1) % k}") for i in range(k)]
    pairs = spark.createDataFrame(ring("a", 4) + ring("b", 3) + ring("c", 2), "from_file string, to_file string")
    rows = lambda **k: sorted((r["size"], r.total, r.total_members, r.truncated, r.truncation_reason) for r in graph.cycles_answer(pairs, **k).collect())
    assert rows() == [(2, 3, 9, False, None), (3, 3, 9, False, None), (4, 3, 9, False, None)]
    assert rows(top=2) == [(3, 3, 9, True, "top"), (4, 3, 9, True, "top")]
    assert rows(budget=8) == [(3, 3, 9, True, "member_limit"), (4, 3, 9, True, "member_limit")]
    assert rows(cap=8) == [(None, None, None, True, "graph_work_limit")]
    assert graph.cycles_answer(pairs.where("false")).count() == 0


def test_pairs_of_classes_are_not_shuffled(spark):
    steps = reach.Named(spark.range(200).selectExpr("id as from_id", "concat('n', id % 7) as to_name", "2 as means"), spark.range(200).selectExpr("concat('n', id % 5) as to_name", "2 as means", "id as to_id"))
    rows = reach.kin_pairs(reach.kin(steps, 2))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.count() > 20_000 and "sequence(" not in plan and "explode(filter" not in plan
