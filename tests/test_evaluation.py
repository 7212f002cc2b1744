"""Caps at and beyond their limit, style detectors, statements, reviewed attempts."""

import random

import pytest
from pyspark.sql import functions as F

from strataloom.operators import change, evaluation, mining, rollup, trials
from tests.test_operators import chain


def test_impact_at_and_beyond_its_caps(spark):
    s, e = chain(spark, 12)
    seeds = s.where("id < 2").select("id")
    got = change.bounded_impact(s, e, seeds, 3, seed_cap=2, row_cap=3).collect()
    assert [tuple(r) for r in got] == [(2, 3, 1, 3, None)]
    assert [r.truncation_reason for r in change.bounded_impact(s, e, seeds, 3, seed_cap=1).collect()] == ["seed_work_limit"]
    over = change.bounded_impact(s, e, seeds, 3, row_cap=2).collect()[0]
    assert (over.seeds, over.impacted, over.truncation_reason) == (2, None, "graph_work_limit")
    assert change.bounded_impact(s, e, seeds.where("false")).collect()[0].impacted == 0


def test_report_at_and_beyond_its_cap(spark):
    v = rollup.violations("r", spark.createDataFrame([(f"{i:02}",) for i in range(5)], "x string"), "x")
    none = spark.createDataFrame([], "rule string, code string, subject string")
    whole = rollup.report([v], [none], cap=5).collect()
    assert len(whole) == 5 and {(r.complete, r.passed) for r in whole} == {(True, False)}
    cut = rollup.report([v], [none], cap=4).collect()
    assert len(cut) == 4 and {(r.complete, r.passed) for r in cut} == {(False, False)} and [r.code for r in cut].count("policy_result_limit") == 1
    assert rollup.report([v.where("false")], [none]).count() == 0
    changed, held = spark.createDataFrame([("core/a",), ("core/b",), ("x",)], "path string"), spark.createDataFrame([("core/b",)], "path string")
    assert [r.subject for r in rollup.strict_rule(changed, "core/**", held).collect()] == ["core/a"]


def test_relevant_paths_at_and_beyond_their_cap(spark):
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    got = rollup.relevant_paths(paths("b", "c", "b"), paths("a", "c"), 3).collect()
    assert [(r.path, r.origin, r.truncated) for r in got] == [("b", "trace", False), ("c", "trace", False), ("a", "changed", False)]
    assert {(r.path, r.truncated) for r in rollup.relevant_paths(paths("b", "c"), paths("a"), 2).collect()} == {("b", True), ("c", True)}


@pytest.mark.parametrize(
    ("predicate", "yes", "no"),
    [
        ("indentation_spaces", "    x = 1", "\tx = 1"),
        ("double_quotes", 'say("hi")', "say('hello')"),
        ("short_lines", "x", "x" * 101),
        ("line_comments", "  // why", "  /* why"),
        ("braces_same_line", "if (x) {", "  {"),
        ("constants", "const x = 1", "var x = 1"),
        ("templates", "`a ${b}`", '"a" + b'),
    ],
)
def test_style_of_lines(spark, predicate, yes, no):
    lines = spark.createDataFrame([("y", yes), ("n", no), ("n", no)], "sha string, line string")
    got = {r.sha: (r.yes, r.no) for r in mining.style_tallies(lines).where(F.col("predicate") == predicate).collect()}
    assert got == {"y": (1, 0), "n": (0, 2)}
    vote = trials.commit_votes(mining.style_tallies(lines)).where(F.col("predicate") == predicate).collect()[0]
    assert (vote.claims, vote.eligible, vote.agree) == ("yes", 2, 1)


def test_statements(spark):
    said = {
        "I prefer small commits": "possible_stated_preference",
        "From now on, review tests first": "possible_correction",
        "i usually plan before coding": "possible_self_report",
        "I prefer tea": None,
        "do you prefer commits": None,
        "I prefer small commits?": None,
        "I prefer commits\nand tests": None,
        "i value": None,
        'I prefer commits with token = "abcdefgh1234"': None,
        "I prefer commits " + "x" * 300: None,
        None: None,
    }
    rows = spark.createDataFrame([(t,) for t in said], "t string").select("t", mining.statement_kind(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in rows} == said


def test_sample_takes_months_in_turn(spark):
    rows = [(f"{m}{i}", f"2024-0{m}-{10 + i} 00:00:00", 5) for m in (1, 2, 3) for i in range(m)] + [("bulk", "2024-03-30 00:00:00", 9999), ("none", "2024-03-30 00:00:00", 0)]
    commits = spark.createDataFrame(rows, "sha string, at string, added long").withColumn("at", F.col("at").cast("timestamp"))
    assert [r.sha for r in mining.sample(commits, cap=5).collect()] == ["32", "21", "10", "31", "20"]
    assert mining.sample(commits, cap=50).count() == 6


def test_tests_and_what_surrounds_them(spark):
    rows = [("test_a", None, True), ("test_a", None, False), ("setUp", ",test,", True), ("x", ",tokio::test,", False), ("x", ",test,pytest.fixture,", False), ("it", None, True), ("x", None, True)]
    got = [r[0] for r in spark.createDataFrame(rows, "n string, d string, p boolean").select(mining.test_symbol(F.col("n"), F.col("d"), F.col("p"))).collect()]
    assert got == [True, False, False, True, False, True, False]


def test_reachable_states_against_search(spark):
    rng = random.Random(1)
    steps = [(f"s{rng.randrange(30):02}", f"s{rng.randrange(30):02}") for _ in range(45)]
    want, front, depth = {"s00": (0, None)}, ["s00"], 0
    while front:
        depth += 1
        near = {}
        for a, b in steps:
            if a in front and b not in want:
                near[b] = min(near.get(b, a), a)
        want |= {b: (depth, a) for b, a in near.items()}
        front = list(near)
    got = evaluation.reachable(spark.createDataFrame([("s00",)], "state string"), spark.createDataFrame(steps, "state string, next string"), spark.createDataFrame([("s01",)], "state string")).collect()
    assert {r.state: (r.depth, r.parent) for r in got} == want and len(got) == len(want)
    assert {r.state for r in got if r.bad} == {"s01"} & set(want)


def test_contrasts_and_the_gate(spark):
    totals = spark.createDataFrame([("b", "t", 100.0, 4, 4), ("c", "t", 50.0, 5, 5), ("b", "u", 10.0, 1, 2), ("c", "u", None, 1, 2)], "condition string, metric string, total double, low int, high int")
    got = {r.metric: r for r in evaluation.contrasts(totals, "b", "c").collect()}
    assert (got["t"].savings, got["t"].per_success_savings) == (0.5, 0.6) and abs(got["t"].yield_gain - 1.5) < 1e-12
    assert got["u"].savings is None and got["u"].per_success_savings is None and got["u"].gain_low is None
    pairs = [("loss", 1, 1, 0, 0), ("open", 0, 1, 1, 1), ("none", 0, 0, 1, 1), ("kept", 1, 1, 1, 1)]
    gate = evaluation.value_gate(spark.createDataFrame(pairs, "k string, b_low int, b_high int, c_low int, c_high int"), "k")
    assert {r.k: r.status for r in gate.collect()} == {"loss": "quality_regression", "open": "unresolved_quality", "none": "no_successful_baseline", "kept": "reviewed_outcomes_preserved"}


def test_policy_files():
    from strataloom.plans.evaluation_queries import POLICY
    from strataloom.sources.policies import MAX_RULES, PolicyError, parse

    rules = parse(POLICY)
    assert [r.id for r in rules] == ["cycles", "east-west", "held", "owner", "radius", "tests"]
    assert rules[0].fields == {"scope": "america/**", "max_new_cycles": 0} and rules[3].pattern("scope") == "^asia/nation_1[^/]/[^/]*$"
    head = "version: 1\nrules:\n"
    one = "  - id: a{}\n    scope: x\n    max_blast_radius: 1\n"
    assert len(parse(head + "".join(one.format(i) for i in range(MAX_RULES)))) == MAX_RULES
    for bad in (
        "", "version: 2\nrules:\n" + one.format(1), head, head + one.format(1) * 2, head + "".join(one.format(i) for i in range(MAX_RULES + 1)),
        head + "  - id: -a\n    scope: x\n    max_blast_radius: 1\n", head + "  - id: a\n    scope: x\n", head + "  - id: a\n    max_blast_radius: 1\n",
        head + "  - id: a\n    scope: x\n    max_blast_radius: many\n", head + "  - id: a\n    scope: x\n    require_tests: false\n", head + "  - id: a\n    scope: x\n    from: y\n    require_tests: true\n",
        head + "  - id: a\n    scope: x\n    max_new_cycles: 1\n    require_tests: true\n", "other: 1\n" + head + one.format(1), head + "  what is this\n",
    ):
        with pytest.raises(PolicyError):
            parse(bad)
