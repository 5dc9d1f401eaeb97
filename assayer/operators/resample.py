"""Cluster bootstraps, conformal radii and conditional simulation.

Random draws are pure functions of (seed, key), so a retried task repeats them. Replicates
are rows made by a generator, folded by map-side aggregation before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.expressions import binomial_nll, expit, poisson_one, standard_normal
from assayer.operators.effects import fit_two_way_copies
from assayer.operators.ordering import quantiles, ranked
from assayer.session import cut_lineage


def _replicated(df: DataFrame, repetitions: int, seed: int, *cluster: str) -> DataFrame:
    """Each row once per replicate with its cluster's Poisson(1) weight, zero weights dropped."""
    reps = F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("Rep")
    return df.select("*", reps).withColumn(
        "k", poisson_one(F.lit(seed), F.col("Rep"), *[F.col(c) for c in cluster])
    ).filter("k > 0")


def paired_bootstrap(
    df: DataFrame, keys: list[str], candidate: str, baseline: str, repetitions: int = 500, seed: int = 42, min_orders: int = 10
) -> DataFrame:
    """Work-order cluster interval for the held-out loss difference of two predictions."""
    y, n = F.col("PassQty"), F.col("InspectedQty")
    gap = binomial_nll(y, n, F.col(candidate)) - binomial_nll(y, n, F.col(baseline))
    orders = cut_lineage(df.groupBy(*keys, "WO").agg(F.sum(gap).alias("d"), F.sum(n).alias("n")))
    point = orders.groupBy(*keys).agg(F.count("*").alias("WOs"), (F.sum("d") / F.sum("n")).alias("LossDifference"))
    draws = _replicated(orders, repetitions, seed, "WO").groupBy(*keys, "Rep").agg(
        (F.sum(F.col("k") * F.col("d")) / F.sum(F.col("k") * F.col("n"))).alias("x")
    )
    bounds = draws.groupBy(*keys).agg(
        F.percentile("x", F.lit(0.025)).alias("Lower95"), F.percentile("x", F.lit(0.975)).alias("Upper95")
    )
    enough = F.col("WOs") >= min_orders
    return point.join(bounds, keys, "left").withColumns(
        {c: F.when(enough, F.col(c)) for c in ("LossDifference", "Lower95", "Upper95")}
        | {"Status": F.when(enough, "CONDITIONAL_DIAGNOSTIC").otherwise("INSUFFICIENT_WOS")}
    )


def conformal_radius(df: DataFrame, branch: str, error: str, hit: str, min_rows: int = 30) -> DataFrame:
    """90 % conformal radius of the absolute log error per branch, never below the pooled one."""
    rows = cut_lineage(df.filter(F.col(error).isNotNull()).select(branch, error, F.col(hit).cast("double").alias("__hit")).withColumn("__all", F.lit(1)))

    def select_rank(keys: list[str], name: str) -> DataFrame:
        facts = ranked(rows, keys, error)
        n = F.col("n_total")
        level = F.least(F.lit(1.0), F.ceil((n + 1) * 0.90) / n)
        index = F.ceil(F.round((n - 1) * level, 9))
        chosen = (F.col("n_before") <= index) & (index < F.col("n_before") + F.col("n"))
        return facts.groupBy(*keys).agg(F.max(F.when(chosen, F.col(error))).alias(name), F.max("n_total").alias("CalibrationN"))

    pooled = select_rank(["__all"], "__pooled").drop("CalibrationN")
    pooled_rate = rows.groupBy("__all").agg(F.avg("__hit").alias("__rate"))
    own = select_rank(["__all", branch], "__own")
    hits = rows.groupBy(branch).agg(F.sum("__hit").alias("__hits"))
    enough = F.col("CalibrationN") >= min_rows
    return (
        own.join(pooled, "__all").join(pooled_rate, "__all").join(hits, branch)
        .select(
            branch, "CalibrationN",
            F.when(enough, F.greatest("__pooled", "__own")).otherwise(F.col("__pooled")).alias("LogRadius90"),
            ((F.col("__hits") + 20 * F.col("__rate")) / (F.col("CalibrationN") + 20)).alias("CalibrationWithin20Pct"),
            F.when(enough, "PROCESS_BRANCH_CONSERVATIVE").otherwise("POOLED").alias("IntervalSource"),
        )
    )


def branch_information(df: DataFrame, keys: list[str], probability: str = "Prediction") -> DataFrame:
    """Observed information of each group and of its fit's intercept."""
    info = F.col("InspectedQty") * F.col(probability) * (1 - F.col(probability))
    groups = df.groupBy(*keys, "SizeAdjustedGroup").agg(
        F.sum(info).alias("GroupInformation"), F.count("*").alias("ModelRounds"), F.sum("InspectedQty").alias("ModelPieces")
    )
    whole = groups.groupBy(*keys).agg((F.sum("GroupInformation") + 1e-6).alias("InterceptInformation"))
    return groups.join(whole, keys).filter("GroupInformation > 0").withColumn(
        "EtaSE", F.sqrt(1 / F.col("GroupInformation") + 1 / F.col("InterceptInformation"))
    )


def simulate_quality(branches: DataFrame, draws: int = 4096) -> DataFrame:
    """Combined difficulty per group from normal draws of both branches' linear predictors.

    ``branches``: Process, SizeAdjustedGroup, Branch, Eta, EtaSE. The draw count bounds the
    values each group contributes to the percentile.
    """
    key = ["Process", "SizeAdjustedGroup"]
    wide = branches.groupBy(*key).agg(
        *[
            F.max(F.when(F.col("Branch") == name, F.col(c))).alias(f"{short}_{c}")
            for name, short in (("First pass", "f"), ("Rework", "r"))
            for c in ("Eta", "EtaSE")
        ]
    ).dropna()

    def difficulty(eta: Column) -> Column:
        return 10 * (1 - expit(eta))

    point = 0.8 * difficulty(F.col("f_Eta")) + 0.2 * difficulty(F.col("r_Eta"))
    expanded = wide.withColumn("Draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    seed = [F.col("Draw"), *[F.col(c) for c in key]]
    first = F.col("f_Eta") + F.col("f_EtaSE") * standard_normal(F.lit("first"), *seed)
    rework = F.col("r_Eta") + F.col("r_EtaSE") * standard_normal(F.lit("rework"), *seed)
    sampled = expanded.select(*key, point.alias("p"), (0.8 * difficulty(first) + 0.2 * difficulty(rework)).alias("s"))
    return sampled.groupBy(*key).agg(
        F.max("p").alias("QualityFactor"),
        F.avg((F.abs(F.col("s") - F.col("p")) <= 1).cast("double")).alias("ConfidencePct"),
        F.percentile("s", F.lit(0.05)).alias("Interval90Lower"),
        F.percentile("s", F.lit(0.95)).alias("Interval90Upper"),
    )


def item_stability(df: DataFrame, keys: list[str], item: str, row_key: list[str], repetitions: int = 10, seed: int = 42) -> DataFrame:
    """0-100 stability of item effects over row resamples; rows move once with their weights in all replicates."""
    copies = [poisson_one(F.lit(seed), F.lit(rep), *[F.col(c) for c in row_key]) for rep in range(1, repetitions + 1)]
    fit = fit_two_way_copies(df, keys, item, copies, "Rep", first=1, workers=False)
    spread = cut_lineage(
        fit.items.groupBy(*keys, "ItemKey").agg(F.coalesce(F.stddev_samp("ItemEffect"), F.lit(0.0)).alias("BootstrapSD"))
    )
    scale = quantiles(spread, keys, "BootstrapSD", {"__p95": 0.95})
    index = 100 * (1 - F.col("BootstrapSD") / F.greatest(F.col("__p95"), F.lit(1e-8)))
    return spread.join(scale, keys).withColumn(
        "StabilityIndex", F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), index)), 2)
    ).drop("__p95")


def coefficient_intervals(draws: DataFrame, point: DataFrame) -> DataFrame:
    """90 % bounds of replicate coefficients and the share within 0.1 of the point estimate."""
    joined = draws.join(point.select("Term", F.col("Estimate").alias("b")), "Term")
    return joined.groupBy("Term").agg(
        F.max("b").alias("Estimate"),
        F.percentile("Estimate", F.lit(0.05)).alias("Lower90"),
        F.percentile("Estimate", F.lit(0.95)).alias("Upper90"),
        F.avg((F.abs(F.col("Estimate") - F.col("b")) <= 0.1).cast("double")).alias("PrecisionWithinLog01Pct"),
    )
