"""Products through shared values, in blocks, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataloom.operators import graph, product, rollup


@pytest.mark.parametrize("n", [1, 70, 700])
def test_bits(n):
    rng = random.Random(n)
    sides = [{v: sorted(rng.sample(range(m), rng.randrange(1, m + 1) if v % 3 else 1)) for v in rng.sample(range(60), 40)} for m in (50, n)]
    packs = [pa.array([{"value": v, "ats": ats} for v, ats in s.items()], pa.struct([("value", pa.int64()), ("ats", pa.list_(pa.int32()))])) for s in sides]
    met = product.bits(packs[0], 50, packs[1], n)
    assert {(int(r), int(c)) for rows, cols in product.set_places(met) for r, c in zip(rows, cols)} == {(r, c) for v in set(sides[0]) & set(sides[1]) for r in sides[0][v] for c in sides[1][v]}
    assert int(np.bitwise_count(product.bits(None, 50, packs[1], n)).sum()) == 0


@pytest.fixture
def rows(spark, monkeypatch):
    for name, k in (("ROWS", 7), ("LEAST", 3), ("COUNTED", 11)):
        monkeypatch.setattr(product, name, k)
    monkeypatch.setattr(product.dealt, "__defaults__", (7,))
    rng = random.Random(5)
    a, b = ([(f"f{rng.randrange(40)}", f"n{rng.randrange(60)}") for _ in range(k)] for k in (90, 80))
    return a, b, spark.createDataFrame([*a, ("alone", "none")], "file string, name string"), spark.createDataFrame([*b, ("apart", "one")], "giver string, name string")


def test_pairs_and_counts(rows):
    a, b, left, right = rows
    plain = {(x, y) for x, n in a for y, m in b if n == m}
    same = lambda apart: sorted(map(tuple, product.pairs(left, right, "name", "file", "giver", apart).collect()))
    assert same(False) == sorted(plain) and same(True) == sorted(p for p in plain if p[0] != p[1]) != same(False)
    got = {r.giver: r.n for r in product.counts(right, left, ["name"], "giver", "file", "n").collect()}
    assert got == {y: len({x for x, z in plain if z == y}) for _, y in plain}
    assert product.pairs(left.where("false"), right, "name", "file", "giver").count() == 0


def test_no_row_for_each_shared_value(spark, monkeypatch):
    """100 files that share 50 names are 9,900 pairs; a join through names made 500,000 rows of them."""
    written, cut = [], product.cut
    monkeypatch.setattr(product, "cut", lambda df, name: written.append((t := cut(df, name)).count()) or t)
    rows = spark.range(100).select(F.format_string("f%d", "id").alias("file"), F.explode(F.sequence(F.lit(0), F.lit(49))).alias("name"))
    assert product.pairs(rows, rows.withColumnRenamed("file", "giver"), "name", "file", "giver").count() == 9_900
    assert max(written) == 5_000


def unlike(spark, n=60):
    """Imports of files of which no two use or define the same names, and nearly every two are linked."""
    rows = spark.range(n).select(F.format_string("d%d/f%d", F.col("id") % 3, "id").alias("file"), F.explode(F.sequence(F.lit(0), F.lit(29))).alias("k"))
    name = lambda s: F.concat(F.lit("n"), F.pmod(F.xxhash64(F.lit(s), "file", "k"), F.lit(60)).cast("string"))
    return graph.Imports(rows.select("file", name("uses").alias("name")).distinct(), rows.where("k < 10").select(name("gives").alias("name"), "file").distinct())


def test_ranks_and_mutual_files_write_no_pairs(spark, monkeypatch):
    imports = unlike(spark)
    plain = {(r.from_file, r.to_file) for r in imports.uses.withColumnRenamed("file", "from_file").join(imports.gives.withColumnRenamed("file", "to_file"), "name").where("from_file <> to_file").collect()}
    written, cut = [], product.cut
    for module in (graph, product):
        monkeypatch.setattr(module, "cut", lambda df, name: written.append((t := cut(df, name)).count()) or t)
    by = graph.alike_files(imports)
    assert {r.file_path for r in graph.mutual_files(by).collect()} == {a for a, b in plain if (b, a) in plain} != set()
    graph.file_ranks(by, spark.createDataFrame([("d0/f0",)], "node string"), rounds=1).collect()
    assert max(written) < 2_000 < len(plain)


def test_boundary_of_owners_who_share_nobody(spark):
    imports = unlike(spark, 20)
    owned = {f"d{i % 3}/f{i}": ("a", "a,b", "b,c", "")[i % 4] for i in range(20)}
    pairs = {(r.from_file, r.to_file) for r in graph.file_pairs(imports).collect()}
    got = rollup.boundary_rule(imports, spark.createDataFrame(sorted(owned.items()), "path string, owners string")).collect()
    assert sorted(r.subject for r in got) == sorted(f"{x} -> {y}" for x, y in pairs if owned[x] and owned[y] and not set(owned[x].split(",")) & set(owned[y].split(","))) != []
