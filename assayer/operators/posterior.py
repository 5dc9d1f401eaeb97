"""Predictions and summaries over tables of posterior draws.

Draws: Process, Branch, Draw, Param, Entity, Value with parameters alpha, beta, u (worker),
v (group), worker_sd, group_sd and optionally wo_sd. The number of draws bounds what each
entity or row contributes to a percentile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.expressions import expit, sorted_percentile, standard_normal
from assayer.operators.contracts import assert_none
from assayer.operators.metrics import correlation
from assayer.operators.ordering import average_rank
from assayer.operators.production import GROUP
from assayer.session import cut_lineage

FIT = ["Process", "Branch"]


def _globals(draws: DataFrame) -> DataFrame:
    names = ["alpha", "beta", "worker_sd", "group_sd", "wo_sd"]
    return draws.filter(F.col("Param").isin(*names)).groupBy(*FIT, "Draw").agg(
        *[F.max(F.when(F.col("Param") == p, F.col("Value"))).alias(p) for p in names]
    )


def _effects(draws: DataFrame, param: str, entity: str) -> DataFrame:
    return draws.filter(F.col("Param") == param).select(*FIT, "Draw", F.col("Entity").alias(entity), F.col("Value").alias(param))


def _values(name: str) -> Column:
    """The values of a group in ascending order: one list for all of its percentiles."""
    return F.sort_array(F.collect_list(name)).alias(name)


def _bounds(name: str, **shares: float) -> list[Column]:
    return [sorted_percentile(F.col(name), share).alias(bound) for bound, share in shares.items()]


def predict_quality(draws: DataFrame, test: DataFrame, seed: int = 42, training: DataFrame | None = None) -> DataFrame:
    """Mean pass probability and 5/95 % bounds per round, marginalising unseen entities.

    Unseen workers and groups and each order's effect are drawn from their fitted spreads as
    a function of (seed, entity, draw), so rows of one entity share its draw.
    """
    if training is not None:
        assert_none(test.select("WO").join(training.select("WO"), "WO", "left_semi"), "Evaluation WO was used for fitting")
    # A round moves before its draws are made, so that where the draws are broadcast none of them moves. The number of parts
    # is given: by the size of the rounds alone they would be merged to few.
    parts = int(test.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = test.repartition(parts, "WO", "RoundNo", *FIT).join(_globals(draws), FIT)
    rows = rows.join(_effects(draws, "u", "Worker"), [*FIT, "Draw", "Worker"], "left")
    rows = rows.join(_effects(draws, "v", GROUP), [*FIT, "Draw", GROUP], "left")
    s, d = F.lit(seed), F.col("Draw")
    worker = F.coalesce("u", standard_normal(s, F.lit("worker"), F.col("Worker"), d) * F.col("worker_sd"))
    group = F.coalesce("v", standard_normal(s, F.lit("group"), F.col(GROUP), d) * F.col("group_sd"))
    order = F.coalesce(standard_normal(s, F.lit("order"), F.col("WO"), d) * F.col("wo_sd"), F.lit(0.0))
    eta = F.col("alpha") + F.col("beta") * F.coalesce("ScaledSkill", F.lit(0.0)) + worker + group + order
    staged = rows.select(*test.columns, expit(eta).alias("__p"), F.col("u").isNull().alias("__nu"), F.col("v").isNull().alias("__nv"))
    rounds = staged.groupBy("WO", "RoundNo", *FIT).agg(
        F.max("PassQty").alias("PassQty"), F.max("InspectedQty").alias("InspectedQty"), F.avg("__p").alias("Prediction"), _values("__p"),
        F.bool_and("__nu").alias("UnseenWorker"), F.bool_and("__nv").alias("UnseenGroup"),
    )
    kept = ["WO", "RoundNo", *FIT, "PassQty", "InspectedQty", "Prediction"]
    return rounds.select(*kept, *_bounds("__p", Lower05=0.05, Upper95=0.95), "UnseenWorker", "UnseenGroup")


def difficulty_draws(draws: DataFrame) -> DataFrame:
    return _effects(draws, "v", GROUP).select(*FIT, "Draw", GROUP, (10 * expit(-F.col("v"))).alias("Difficulty"))


def group_summary(draws: DataFrame) -> DataFrame:
    """Difficulty mean, 95 and 97.5 % bounds and rank bounds per group."""
    per_draw = average_rank(cut_lineage(difficulty_draws(draws)), [*FIT, "Draw"], "Difficulty", "Rank")
    groups = per_draw.groupBy(*FIT, GROUP).agg(F.avg("Difficulty").alias("Difficulty10"), _values("Difficulty"), _values("Rank"))
    bounds = _bounds("Difficulty", Lower95=0.025, Upper95=0.975, Lower975=0.0125, Upper975=0.9875)
    return groups.select(*FIT, GROUP, "Difficulty10", *bounds, *_bounds("Rank", RankLower95=0.025, RankUpper95=0.975))


def group_difficulty(draws: DataFrame) -> DataFrame:
    """Difficulty mean per group, without bounds or ranks."""
    return difficulty_draws(draws).groupBy(*FIT, GROUP).agg(F.avg("Difficulty").alias("Difficulty10"))


def worker_summary(draws: DataFrame) -> DataFrame:
    return _effects(draws, "u", "Worker").groupBy(*FIT, "Worker").agg(
        F.avg("u").alias("WorkerResidual"), F.percentile("u", F.lit(0.025)).alias("Lower95"), F.percentile("u", F.lit(0.975)).alias("Upper95")
    )


def rank_stability(draws: DataFrame) -> DataFrame:
    """Correlation of each draw's ranking with the mean ranking; blank below three groups."""
    table = cut_lineage(difficulty_draws(draws))
    means = average_rank(table.groupBy(*FIT, GROUP).agg(F.avg("Difficulty").alias("m")), FIT, "m", "__mean_rank")
    ranked = average_rank(table, [*FIT, "Draw"], "Difficulty", "__rank").join(means.select(*FIT, GROUP, "__mean_rank"), [*FIT, GROUP])
    per_draw = ranked.groupBy(*FIT, "Draw").agg(F.count("*").alias("n"), correlation("__rank", "__mean_rank").alias("c")).filter("n >= 3")
    return per_draw.groupBy(*FIT).agg(
        F.percentile("c", F.lit(0.025)).alias("RankCorrelationLower95"), F.percentile("c", F.lit(0.5)).alias("RankCorrelationMedian")
    )


def worker_anchors(draws: DataFrame, links: DataFrame) -> DataFrame:
    """Mean pass probability of the workers who actually produced each group, skill known."""
    rows = links.join(_globals(draws), FIT).join(_effects(draws, "u", "Worker"), [*FIT, "Draw", "Worker"])
    rows = rows.join(_effects(draws, "v", GROUP), [*FIT, "Draw", GROUP])
    eta = F.col("alpha") + F.col("beta") * F.col("ScaledSkill") + F.col("u") + F.col("v")
    return rows.groupBy(*FIT, GROUP, "Worker").agg(
        F.avg(F.when(F.col("ScaledSkill").isNotNull(), expit(eta))).alias("PassProbability"),
        F.when(F.max("ScaledSkill").isNotNull(), "VERIFIED_ACTUAL_WORKER").otherwise("MISSING_NOT_OFFICIAL_ANCHOR").alias("AnchorStatus"),
    )


def complete_branches(groups: DataFrame, evidence: DataFrame) -> DataFrame:
    """Add the missing (group, branch) rows with the reason no estimate exists."""
    key = ["Process", GROUP, "Branch"]
    both = F.explode(F.array(F.lit("FIRST_PASS"), F.lit("REWORK"))).alias("Branch")
    wanted = evidence.groupBy("Process", GROUP).agg(F.bool_and(F.col("Eligibility") == "EXCLUDED_SEMI_SCOPE").alias("__out")).select("Process", GROUP, "__out", both)
    counts = evidence.filter("Eligibility = 'ELIGIBLE'").groupBy(*key).agg(F.count_distinct("WO").alias("AvailableWOs"))
    absent = wanted.join(groups.select(*key), key, "left_anti").join(counts, key, "left")
    reason = (
        F.when(F.col("__out"), "EXCLUDED_SEMI_SCOPE")
        .when(F.coalesce("AvailableWOs", F.lit(0)) == 0, "NO_USABLE_BRANCH_DATA")
        .otherwise("INSUFFICIENT_MODEL_OR_TRAINING_EVIDENCE")
    )
    missing = absent.select(*key, F.coalesce("AvailableWOs", F.lit(0)).alias("AvailableWOs"), reason.alias("ValidationStatus"))
    return groups.withColumn("ValidationStatus", F.lit("ESTIMATED")).unionByName(missing, allowMissingColumns=True)
