"""Pairwise preference: verdict scores, rewards, win rates and order effects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.text import literal_map
from scoreloom.operators import reports as rp

# Score of a verdict from the view of B; a reversed spelling means the same.
VERDICTS = {"A<<B": 2, "B>>A": 2, "A<B": 1, "B>A": 1, "A=B": 0, "B=A": 0, "A>B": -1, "B<A": -1, "A>>B": -2, "B<<A": -2}


def verdict_score(verdict: Column, reversed_: Column | None = None, unknown: int | None = 0) -> Column:
    """-2 .. 2; unknown verdicts are ties (or null); the sign flips for reversed rows."""
    score = F.coalesce(F.try_element_at(literal_map(VERDICTS), verdict), F.lit(unknown))
    return score if reversed_ is None else F.when(reversed_, -score).otherwise(score)


def _distribution(score: str) -> dict[str, Column]:
    s = F.col(score)
    return {f"d{i}": F.count_if(s == i - 2) for i in range(5)}


def _reward(n: Column) -> Column:
    c = F.col
    return F.try_divide(100 * c("d4") + 50 * c("d3") - 50 * c("d1") - 100 * c("d0"), n)


def reward_and_winrate(df: DataFrame, score: str, kind: str) -> DataFrame:
    """Reward and win rate overall and per type."""
    sums = rp.scoped_sums(df, {"overall": None, "type": kind}, {**_distribution(score), "n": F.count("*")})
    return sums.select("scope", "group", F.round(_reward(F.col("n")), 6).alias("reward"),
                       F.round((F.col("d3") + F.col("d4")) / F.col("n"), 6).alias("win_rate"), "n")


def preference_sums(df: DataFrame, task: str, subjective: str, objective: str) -> DataFrame:
    """Per task: counts behind the preference report.

    ``objective`` is 'ref|score', 'NO_OBJECTIVE' or null (missing); ``subjective`` a verdict or null.
    """
    scored = df.select(
        task, verdict_score(F.col(subjective), unknown=None).alias("s"), F.col(objective).alias("o"), F.col(subjective).isNotNull().alias("ok"),
        F.split_part(objective, F.lit("|"), F.lit(1)).try_cast("double").alias("ref"), F.split_part(objective, F.lit("|"), F.lit(2)).try_cast("double").alias("own"))
    return scored.groupBy(task).agg(
        *[v.alias(k) for k, v in _distribution("s").items()], F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("missing"),
        F.count_if(F.col("o").isNull()).alias("obj_missing"), F.count("own").alias("obj_valid"), F.sum("own").alias("own"), F.sum("ref").alias("ref"))


SUMS = ["d0", "d1", "d2", "d3", "d4", "valid", "missing", "obj_missing", "obj_valid", "own", "ref"]


def preference_rates(sums: DataFrame, task: str) -> DataFrame:
    """Rates per task and overall from the summed counts."""
    overall = sums.agg(*[F.sum(c).alias(c) for c in SUMS]).withColumn(task, F.lit("overall"))
    both = sums.select(task, *SUMS).unionByName(overall)
    c = F.col
    share = lambda a, b: F.round(F.try_divide(a, b), 6)
    return both.select(
        c(task).alias("task"), share(c("valid"), c("valid") + c("missing")).alias("parse_ok"),
        *[share(c(f"d{i}"), c("valid")).alias(f"dist_{n}") for i, n in enumerate(("m2", "m1", "0", "p1", "p2"))],
        F.round(_reward(c("valid")), 6).alias("reward"), F.round(F.try_divide((c("d3") + c("d4")) * 100, c("valid")), 6).alias("win_rate"),
        share(c("obj_valid"), c("obj_valid") + c("obj_missing")).alias("obj_parse_ok"), share(c("own"), c("obj_valid")).alias("obj_score"),
        share(c("ref"), c("obj_valid")).alias("obj_ref_score"))


def preference_distribution(df: DataFrame, task: str, subjective: str, objective: str) -> DataFrame:
    return preference_rates(preference_sums(df, task, subjective, objective), task)


def merge_dual(df: DataFrame, reversed_: DataFrame, task: str, subjective: str, objective: str, categories: Mapping[str, str]) -> DataFrame:
    """Both orders pooled: reversed scores negated, objective and reference scores swapped.

    Rows for tasks, for the main categories they belong to, and overall.
    """
    straight = preference_sums(df, task, subjective, objective)
    back = preference_sums(reversed_, task, subjective, objective)
    mirror = {"d0": "d4", "d1": "d3", "d3": "d1", "d4": "d0", "own": "ref", "ref": "own"}
    turned = back.select(task, *[F.col(mirror.get(c, c)).alias(c) for c in SUMS])
    tasks = straight.select(task, *SUMS).unionByName(turned).groupBy(task).agg(*[F.sum(c).alias(c) for c in SUMS])
    named = tasks.withColumn("_main", F.try_element_at(literal_map(dict(categories)), F.col(task)))
    mains = named.filter(F.col("_main").isNotNull()).groupBy("_main").agg(*[F.sum(c).alias(c) for c in SUMS]).withColumnRenamed("_main", task)
    rated = preference_rates(tasks, task)
    # the overall row of the category table would repeat the pooled one
    return rated.unionByName(preference_rates(mains, task).filter(F.col("task") != "overall"))


def debiased_first(a: Column, b: Column) -> Column:
    """Which answer is shown first: swapped when the total length is odd."""
    return F.pmod(F.length(a) + F.length(b), F.lit(2))


def position_debias(df: DataFrame, first_better: str, a: str, b: str, choice: str, category: str) -> DataFrame:
    """Accuracy per category, macro (mean of categories) and overall, the truth following the swap."""
    swap = debiased_first(F.col(a), F.col(b))
    truth = F.when((swap == 0) == (F.col(first_better) == 1), 1).otherwise(2)
    sums = df.groupBy(category).agg(F.sum(F.when(F.col(choice) == truth, 1).otherwise(0)).alias("s"), F.count("*").alias("n"))
    each = sums.select(F.col(category).alias("group"), rp.mean("s", "n").alias("value"))
    macro = sums.agg(F.round(F.avg(F.col("s") / F.col("n")), 6).alias("value")).select(F.lit("Macro Accuracy").alias("group"), "value")
    overall = sums.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).select(F.lit("Overall Consistency").alias("group"), rp.mean("s", "n").alias("value"))
    return each.unionByName(macro).unionByName(overall)
