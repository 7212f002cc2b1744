"""Votes of commits and accounting of paired trials."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import stats
from strataloom.operators.store import cut


def commit_votes(tallies: DataFrame) -> DataFrame:
    """(predicate, claims, eligible, agree, low, gate) of tallies (sha, predicate, yes, no): each commit votes once, a
    tie counts as eligible and does not agree. The side with more votes is claimed, yes where both have as many."""
    per_commit = tallies.groupBy("sha", "predicate").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).where("yes + no > 0")
    rows = per_commit.groupBy("predicate").agg(F.count("*").alias("eligible"), F.count_if(F.col("yes") > F.col("no")).alias("for"), F.count_if(F.col("no") > F.col("yes")).alias("against"))
    rows = rows.select("predicate", F.when(F.col("for") >= F.col("against"), "yes").otherwise("no").alias("claims"), "eligible", F.greatest("for", "against").alias("agree"))
    return rows.select("*", F.round(stats.wilson_low(F.col("agree"), F.col("eligible")), 9).alias("low"), stats.gate(F.col("agree"), F.col("eligible")).alias("gate"))


def complete_totals(rows: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """Sums that are null unless every attempt was measured."""
    return rows.groupBy(key).agg(F.count("*").alias("attempts"), *(F.when(F.count(m) == F.count("*"), F.sum(m)).alias(m) for m in measures))


def outcome_bounds(rows: DataFrame, key: str) -> DataFrame:
    """Sums of the outcome's interval: known ones count on both sides, failures on none, unknown ones above."""
    low = F.when(F.col("status") != "ok", 0).when(F.col("success").isNull(), 0).otherwise(F.col("success"))
    high = F.when(F.col("status") != "ok", 0).when(F.col("success").isNull(), 1).otherwise(F.col("success"))
    return rows.groupBy(key).agg(F.count("*").alias("attempts"), F.sum(low).alias("low"), F.sum(high).alias("high"))


def paired(rows: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """(wins, ties, losses, unpaired) of outcomes by repetition."""
    wide = rows.groupBy("repetition").pivot("condition", [baseline, candidate]).agg(F.max("outcome"))
    b, c = F.col(baseline), F.col(candidate)
    return wide.agg(F.count_if(c > b).alias("wins"), F.count_if(c == b).alias("ties"), F.count_if(c < b).alias("losses"), F.count_if(b.isNull() | c.isNull()).alias("unpaired"))


def hit_at(rows: DataFrame, k: int) -> DataFrame:
    """(split, queries, hit, recall, first_rank) of ranked answers (query, split, rank, relevant)."""
    per = rows.groupBy("query", "split").agg(
        F.max(F.when(F.col("relevant") & (F.col("rank") <= k), 1).otherwise(0)).alias("hit"),
        F.count_if(F.col("relevant") & (F.col("rank") <= k)).alias("found"),
        F.count_if(F.col("relevant")).alias("all"),
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"),
    )
    return per.groupBy("split").agg(F.count("*").alias("queries"), F.sum("hit").alias("hit"), F.round(F.avg(F.when(F.col("all") > 0, F.col("found") / F.col("all"))), 9).alias("recall"), F.min("first").alias("first_rank"))


def cluster_estimate(rows: DataFrame, key: list[str], cluster: str, value: str, t: float = 1.96) -> DataFrame:
    """(clusters, mean, error, lower, upper): mean of the clusters' means, its error and the bounds ``t`` errors away.

    With fewer than two clusters only the mean is known.
    """
    means = rows.groupBy(*key, cluster).agg(F.avg(value).alias("m"))
    out = means.groupBy(*key).agg(F.count("*").alias("clusters"), F.avg("m").alias("mean"), F.when(F.count("*") >= 2, F.stddev_samp("m") / F.sqrt(F.count("*"))).alias("error"))
    return out.withColumn("lower", F.col("mean") - t * F.col("error")).withColumn("upper", F.col("mean") + t * F.col("error"))


def log_ratio(rows: DataFrame, key: str, t: float, most_unknown: int, median: bool = False) -> DataFrame:
    """(key, status, unknown_baseline, unknown_candidate, ratio, upper) of rows (key, task, cluster, arm, value).

    Each task gives the mean (or median) of its candidate's logarithms less that of its baseline's; the ratio is
    e to the cluster estimate of these. A null value or one that is not positive is unknown usage: with more of it
    than allowed, or a task with none known on a side, the ratio is unknown.
    """
    known = F.col("value") > 0
    middle = F.log(F.percentile(F.when(known, F.col("value")), 0.5)) if median else F.avg(F.when(known, F.log("value")))
    per = rows.groupBy(key, "task", "cluster").pivot("arm", ["baseline", "candidate"]).agg(middle.alias("log"), F.count_if(~F.coalesce(known, F.lit(False))).alias("unknown"))
    per = per.withColumn("r", F.col("candidate_log") - F.col("baseline_log"))
    sums = per.groupBy(key).agg(F.bool_and(F.col("r").isNotNull()).alias("whole"), *(F.sum(F.coalesce(f"{a}_unknown", F.lit(0))).alias(f"unknown_{a}") for a in ("baseline", "candidate")))
    estimate = cluster_estimate(per.where("r is not null"), [key], "cluster", "r", t)
    out = sums.join(estimate, key, "left")
    measured = F.col("whole") & (F.greatest("unknown_baseline", "unknown_candidate") <= most_unknown)
    return out.select(key, F.when(measured, "measured").otherwise("unknown").alias("status"), "unknown_baseline", "unknown_candidate", F.when(measured, F.exp("mean")).alias("ratio"), F.when(measured, F.exp("upper")).alias("upper"))


#: Verdicts of a judge.
OUTCOMES = ("satisfied", "unsatisfied", "unknown")


def agreement(rows: DataFrame, key: str) -> DataFrame:
    """Gwet's AC1 over three outcomes, and how often controls are accepted and defects caught.

    ``rows`` (key, control, expected, judged): an answer without a verdict (null) is unresolved; it is left out of the
    resolved rates and of AC1 and counts as wrong in the worst case.
    """
    settled = F.col("judged").isNotNull()
    shares = [(F.avg(F.when(settled, (F.col("judged") == o).cast("double"))) + F.avg(F.when(settled, (F.col("expected") == o).cast("double")))) / 2 for o in OUTCOMES]
    accepted, caught = F.col("control") & (F.col("judged") == "satisfied"), ~F.col("control") & (F.col("judged") == "unsatisfied")
    out = rows.groupBy(key).agg(
        F.count("*").alias("answers"),
        F.count_if(~settled).alias("unresolved"),
        F.avg(F.when(settled, (F.col("judged") == F.col("expected")).cast("double"))).alias("same"),
        (sum((s * (1 - s) for s in shares), F.lit(0.0)) / (len(OUTCOMES) - 1)).alias("chance"),
        *(F.count_if(c).alias(n) for n, c in (("accepted", accepted), ("caught", caught), ("controls", F.col("control")), ("defects", ~F.col("control")), ("controls_settled", F.col("control") & settled), ("defects_settled", ~F.col("control") & settled))),
    )
    rate = lambda hits, n: F.when(F.col(n) > 0, F.col(hits) / F.col(n))
    out = out.select(
        key, "answers", "unresolved",
        rate("accepted", "controls_settled").alias("sensitivity"), rate("caught", "defects_settled").alias("specificity"),
        rate("accepted", "controls").alias("sensitivity_worst"), rate("caught", "defects").alias("specificity_worst"),
        F.when(F.col("chance") < 1, (F.col("same") - F.col("chance")) / (1 - F.col("chance"))).alias("ac1"),
    )
    return out.withColumn("youden", F.col("sensitivity") + F.col("specificity") - 1).withColumn("youden_worst", F.col("sensitivity_worst") + F.col("specificity_worst") - 1)


def exact_tests(rows: DataFrame, key: str) -> DataFrame:
    """Clopper-Pearson lower bound and binomial tail of counts (key, hits, n): few rows, exact arithmetic."""

    def run(batches):
        for part in batches:
            yield pd.DataFrame(
                {
                    key: part[key],
                    "hits": part["hits"],
                    "n": part["n"],
                    "low": [stats.clopper_pearson_low(int(k), int(n)) for k, n in zip(part["hits"], part["n"])],
                    "tail": [stats.binomial_tail(int(k), int(n), 0.5) for k, n in zip(part["hits"], part["n"])],
                }
            )

    return rows.select(key, "hits", "n").mapInPandas(run, f"{key} string, hits long, n long, low double, tail double")


def reconciled(copies: DataFrame) -> DataFrame:
    """One copy of each commit: a sampled one if there is, then the first repository."""
    w = Window.partitionBy("sha").orderBy(F.col("sampled").desc(), "repo")
    return copies.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def latest(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The last event of each key; what it replaces is superseded."""
    w = Window.partitionBy(*key).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


#: Draws of cases, cases that a bound needs, and the share of draws below it.
DRAWS, LEAST_CASES, BELOW = 2_000, 5, 0.05
#: Draws of cases that a task makes.
TASK_DRAWS = 2_000_000
# Chances of a Poisson count of mean 1 that is at most 0, 1, 2, ...: the sums of e^-1 / k!.
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(13)]


def multiplicity(*of: Column) -> Column:
    """How often a case counts in a draw: a Poisson number of mean 1 by a hash of both, so reruns agree."""
    share = F.substring(F.md5(F.concat_ws("|", *(c.cast("string") for c in of)).cast("binary")), 1, 13)
    # 13 hexadecimal digits are a share of 16^13, and digits of one length are in order as texts
    least = [math.ceil(p * 16**13) for p in POISSON]
    return F.transform(F.array(share), lambda x: sum(((x >= f"{n:013x}").cast("int") for n in least if n < 16**13), F.lit(0)))[0]


def agreement_bound(rows: DataFrame, key: str, draws: int = DRAWS, least_cases: int = LEAST_CASES) -> DataFrame:
    """(key, cases, ac1_lower): the 5 % point of AC1 over draws of whole cases; null with fewer cases than ``least_cases``.

    ``rows`` are (key, case, expected, judged); those without a verdict are left out. Cases are counted once each, and a draw
    weighs their counts, so the answers themselves are read once and no draw holds them.
    """
    settled = rows.where(F.col("judged").isNotNull())
    counts = [F.count("*").alias("n"), F.count_if(F.col("judged") == F.col("expected")).alias("same"), *((F.count_if(F.col("judged") == o) + F.count_if(F.col("expected") == o)).alias(f"of_{o}") for o in OUTCOMES)]
    cases = cut(settled.groupBy(key, "case").agg(*counts), "agreement-cases")
    enough = cases.groupBy(key).agg(F.count("*").alias("cases"))
    # cases are few bytes and many draws: they are dealt by the number of draws, as their bytes would fill a task or two
    each = cases.join(enough.where(F.col("cases") >= least_cases).select(key), key, "left_semi")
    tasks = max(cases.sparkSession.sparkContext.defaultParallelism, -(-cases.count() * draws // TASK_DRAWS))
    each = each.repartition(tasks, key, "case").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    each = each.withColumn("times", multiplicity(F.col("case"), F.col("draw"))).where("times > 0")
    sums = each.groupBy(key, "draw").agg(*(F.sum(F.col(c) * F.col("times")).alias(c) for c in ("n", "same", *(f"of_{o}" for o in OUTCOMES))))
    shares = [F.col(f"of_{o}") / (2 * F.col("n")) for o in OUTCOMES]
    chance = sum((s * (1 - s) for s in shares), F.lit(0.0)) / (len(OUTCOMES) - 1)
    drawn = sums.select(key, F.when(chance < 1, (F.col("same") / F.col("n") - chance) / (1 - chance)).alias("ac1")).where("ac1 is not null")
    place = F.row_number().over(Window.partitionBy(key).orderBy("ac1")) - 1
    n = F.count("*").over(Window.partitionBy(key))
    lower = drawn.withColumn("place", place).withColumn("n", n).where(F.col("place") == F.floor(F.lit(BELOW) * F.col("n"))).select(key, F.col("ac1").alias("ac1_lower"))
    return enough.join(lower, key, "left")
