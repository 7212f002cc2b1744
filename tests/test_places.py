"""Innermost ranges and mentions of paths against brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F

from strataloom.operators import intervals, mentions


def test_innermost(spark):
    rng = random.Random(5)
    ranges = [(f"f{rng.randrange(3)}", a, a + rng.randrange(-1, 30), i) for i in range(120) for a in [rng.randrange(60)]]
    places = [(f"f{k}", x) for k in range(4) for x in range(95)]
    got = {(r.file_path, r.at): r.id for r in intervals.innermost(spark.createDataFrame(ranges, "file_path string, first int, last int, id long"), spark.createDataFrame(places * 2, "file_path string, at int")).collect()}
    want = {}
    for f, x in places:
        inside = [(a, -b, -i) for g, a, b, i in ranges if g == f and a <= x <= b]
        if inside:
            want[f, x] = -max(inside)[2]
    assert got == want and len(want) > 150
    none = spark.createDataFrame([], "file_path string, first int, last int, id long")
    assert intervals.innermost(none, spark.createDataFrame(places, "file_path string, at int")).count() == 0


def test_large_file_is_linear(spark):
    """100,000 declarations of one file, nested ten deep, and as many places: no pair of both is made."""
    n = 100_000
    ranges = spark.range(n).select(F.lit("f").alias("file_path"), (F.floor(F.col("id") / 10) * 40 + F.col("id") % 10).alias("first"), (F.floor(F.col("id") / 10) * 40 + 39 - F.col("id") % 10).alias("last"), "id")
    places = spark.range(n).select(F.lit("f").alias("file_path"), (F.col("id") * 4).alias("at"))
    began = time.time()
    got = intervals.innermost(ranges, places)
    wrong = got.withColumn("in", F.least(F.col("at") % 40, 39 - F.col("at") % 40, F.lit(9))).where("id <> floor(at / 40) * 10 + in")
    assert wrong.count() == 0 and got.count() == n
    assert time.time() - began < 120


PATHS = ["src/a.rs", "src/a.rs.bak", "a.rs", "src/b.rs", "x y/ü.md", "src"]
BODIES = ["see src/a.rs.", "src\\a.rs", "src/a.rs.bak and a.rs", "xsrc/a.rs src/a.rsx src/a.rs-", "(src/a.rs), src/b.rs", "the end is src/b.rs", "in x y/ü.md ok", "ésrc/b.rs src/b.rsé", None, "", "src. src.. src", "src/a.rs " * 3 + "src"]


@pytest.mark.parametrize("shard", [100, 2])
def test_path_mentions(spark, shard):
    docs = spark.createDataFrame(list(enumerate(BODIES)), "doc long, body string").repartition(3)
    got = {(r.doc, r.path): r.start for r in mentions.path_mentions(docs, spark.createDataFrame([(p,) for p in [*PATHS, "", PATHS[0], None]], "path string"), shard).collect()}
    want = {}
    for i, body in enumerate(BODIES):
        for path in PATHS:
            for spelt in (path, path.replace("/", "\\")):
                at = (body or "").find(spelt)
                while at >= 0:
                    if mentions.bounded(body, at, at + len(spelt)):
                        want[i, path] = min(want.get((i, path), at), at)
                        break
                    at = body.find(spelt, at + 1)
    assert got == want
    assert {(0, "src/a.rs"), (1, "src/a.rs"), (2, "src/a.rs.bak"), (2, "a.rs"), (6, "x y/ü.md"), (10, "src")} <= set(want) and not any(i in (3, 7) for i, _ in want)


def test_owner_trie_equals_patterns(spark, tmp_path):
    """Random rules and paths: the trie gives what the pattern of the last matching rule gives."""
    import re

    from strataloom.functions import paths
    from strataloom.operators import owner_trie

    rng = random.Random(9)
    parts = ["a", "b", "ab", "*", "a*", "?", "*b", "**", "x.rs", "*.rs"]
    for _ in range(150):
        rules = []
        for n in range(rng.randrange(1, 8)):
            glob = "/".join(rng.choice(parts) for _ in range(rng.randrange(1, 4)))
            rules.append((n, glob, not glob.endswith("*") and rng.random() < 0.5))
        trie = owner_trie.OwnerTrie(rules)
        patterns = [(n, re.compile(paths.glob_regex(g)[:-1] + ("(?:/.*)?$" if below else "$"))) for n, g, below in rules]
        for _ in range(30):
            path = "/".join(rng.choice(["a", "b", "ab", "c", "x.rs", "ba"]) for _ in range(rng.randrange(1, 5)))
            assert trie.match(path) == max((n for n, p in patterns if p.match(path)), default=-1), (rules, path)
    (tmp_path / "OWNERS").write_text("﻿# c\n* core\n/src/ a b\n*.rs r\n!no x\n/x[1] y\ndocs\n/\n")
    rules, diagnostics = owner_trie.owner_rules(spark, str(tmp_path / "OWNERS"))
    assert [(r.line, r.code) for r in diagnostics.collect()] == [(5, "invalid_codeowner_pattern"), (6, "invalid_codeowner_pattern"), (8, "invalid_codeowner_pattern")]
    files = spark.createDataFrame([(p,) for p in ("src/a.py", "src/a.rs", "z/docs/deep/x", "docs", None)], "path string")
    got = {r.path: (r.owners, r.rule_no) for r in owner_trie.resolve_owners(files, rules).collect()}
    assert got == {"src/a.py": ("a,b", 2), "src/a.rs": ("r", 3), "z/docs/deep/x": ("", 6), "docs": ("", 6), None: (None, None)}
