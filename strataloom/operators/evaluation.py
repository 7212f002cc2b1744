"""Accounting of reviewed attempts: tallies, ledgers, contrasts of resources, the value gate, pooled cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators import graph
from strataloom.operators.store import cut


def tallies(reviews: DataFrame) -> DataFrame:
    """(condition, dimension, verdict, answers) of (answer, condition, reviewer, dimension, verdict)."""
    return reviews.groupBy("condition", "dimension", "verdict").agg(F.count("*").alias("answers"))


def disagreement(reviews: DataFrame) -> DataFrame:
    """(dimension, compared, disagree): answers on which two reviewers or more gave different verdicts."""
    per = reviews.groupBy("answer", "dimension").agg(F.count_distinct("reviewer").alias("reviewers"), F.count_distinct("verdict").alias("verdicts")).where("reviewers >= 2")
    return per.groupBy("dimension").agg(F.count("*").alias("compared"), F.count_if(F.col("verdicts") > 1).alias("disagree"))


def ledgers(rows: DataFrame) -> DataFrame:
    """(condition, metric, attempts, observed_total, total, reported, complete, unknown) of attempts (condition, metric,
    value, complete). What was observed is summed; a total is known only if every attempt is complete."""
    out = rows.groupBy("condition", "metric").agg(F.count("*").alias("attempts"), F.sum("value").alias("observed_total"), F.count("value").alias("reported"), F.count_if(F.col("complete") & F.col("value").isNotNull()).alias("complete"))
    return out.withColumn("total", F.when(F.col("complete") == F.col("attempts"), F.col("observed_total"))).withColumn("unknown", F.col("attempts") - F.col("complete"))


def contrasts(totals: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """(metric, savings, per_success_savings, yield_gain, yield_delta, gain_low, gain_high) of (condition, metric, total, low, high).

    low and high bound the successes. Where they differ what a success costs is unknown, and only bounds of the gain
    are; a denominator that is not above nothing makes a value unknown.
    """
    wide = totals.groupBy("metric").pivot("condition", [baseline, candidate]).agg(F.max("total").alias("total"), F.max("low").alias("low"), F.max("high").alias("high"))
    col = lambda side, c: F.col(f"{side}_{c}")
    share = lambda x, y: F.when(y > 0, x / y)
    settled = lambda s: F.when(col(s, "low") == col(s, "high"), col(s, "low"))
    a, b = (share(col(s, "total"), settled(s)) for s in (baseline, candidate))
    u, v = (share(settled(s), col(s, "total")) for s in (baseline, candidate))
    yields = lambda s, c: share(col(s, c), col(s, "total"))
    return wide.select(
        "metric",
        (1 - share(col(candidate, "total"), col(baseline, "total"))).alias("savings"),
        (1 - share(b, a)).alias("per_success_savings"),
        (share(v, u) - 1).alias("yield_gain"),
        (v - u).alias("yield_delta"),
        (share(yields(candidate, "low"), yields(baseline, "high")) - 1).alias("gain_low"),
        (share(yields(candidate, "high"), yields(baseline, "low")) - 1).alias("gain_high"),
    )


def value_gate(pairs: DataFrame, key: str) -> DataFrame:
    """(key, status): whether savings may be told, of pairs (key, b_low, b_high, c_low, c_high) of outcome bounds.

    Quality first: a known loss is a regression, open outcomes are unresolved, and without a success on a side there
    is nothing to save on.
    """
    out = pairs.groupBy(key).agg(F.count_if(F.col("c_high") < F.col("b_low")).alias("losses"), *(F.sum(c).alias(c) for c in ("b_low", "b_high", "c_low", "c_high")))
    status = (
        F.when(F.col("losses") > 0, "quality_regression")
        .when((F.col("b_low") != F.col("b_high")) | (F.col("c_low") != F.col("c_high")), "unresolved_quality")
        .when(F.col("c_low") < F.col("b_low"), "quality_regression")
        .when(F.col("b_low") == 0, "no_successful_baseline")
        .when(F.col("c_low") == 0, "no_successful_candidate")
        .otherwise("reviewed_outcomes_preserved")
    )
    return out.select(key, status.alias("status"))


def pooled(rows: DataFrame) -> DataFrame:
    """(condition, cases, attempts, mean, total) over cases (condition, case, value): each case weighs as much as another."""
    per = rows.groupBy("condition", "case").agg(F.count("*").alias("attempts"), F.avg("value").alias("mean"), F.when(F.count("value") == F.count("*"), F.sum("value")).alias("total"))
    return per.groupBy("condition").agg(F.count("*").alias("cases"), F.sum("attempts").alias("attempts"), F.avg("mean").alias("mean"), F.when(F.count("total") == F.count("*"), F.sum("total")).alias("total"))


def reachable(starts: DataFrame, steps: DataFrame | graph.Imports, bad: DataFrame | None = None) -> DataFrame:
    """(state, depth, parent, bad): every state that ``steps`` (state, next) lead to, the fewest steps and the smallest
    predecessor on such a path; from a bad state the parents lead back to a start, which is its counterexample.

    ``Imports`` are walked through their names, so no pair of files is made.
    """
    through = isinstance(steps, graph.Imports)
    steps = steps if through else cut(steps.distinct(), "steps")
    seen = cut(starts.select("state").distinct().withColumn("depth", F.lit(0)).withColumn("parent", F.lit(None).cast(starts.schema["state"].dataType)), "states")
    front, depth = seen, 0
    while not front.isEmpty():
        depth += 1
        if through:
            names = front.select(F.col("state").alias("file")).join(steps.uses, "file").groupBy("name").agg(F.min("file").alias("parent"))
            near = names.join(steps.gives, "name").groupBy(F.col("file").alias("next")).agg(F.min("parent").alias("parent"))
        else:
            near = front.select("state").join(steps, "state").groupBy("next").agg(F.min("state").alias("parent"))
        front = cut(near.join(seen.select(F.col("state").alias("next")), "next", "left_anti").select(F.col("next").alias("state"), F.lit(depth).alias("depth"), "parent"), "states")
        seen = seen.unionByName(front)
    return seen if bad is None else seen.join(bad.select("state").distinct().withColumn("bad", F.lit(True)), "state", "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
