"""Learning observed in repeated first-round histories of a worker on an item."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.functions.expressions import is_close, micros, or_false, poisson_one
from assayer.operators.contracts import assert_none, assert_unique
from assayer.operators.ordering import midpoint_score, prefix_totals, quantiles, ranked, row_positions
from assayer.operators.production import GROUP, drop_other
from assayer.session import cut_lineage, settle

# Evidence gates and ratio limits.
MIN_PAIR_WOS, MIN_PAIR_DAYS, MIN_PAIR_DATES = 6, 30, 3
MIN_GROUP_PAIRS, MIN_GROUP_WOS, MIN_GROUP_WORKERS = 3, 18, 2
RATIO_MIN, RATIO_MAX = 0.1, 10.0
IMPROVEMENT = math.log(1.10)
# Half width, in root n, of the ranks searched for a resampled median: six of its standard deviations.
NEAR_MIDDLE = 3.0
PAIR = ["Process", GROUP, "Item", "Worker"]
STAGES = ["Early", "Middle", "Late"]


def learning_cohort(hours: DataFrame, orders: DataFrame, item_map: DataFrame, check: bool = True) -> DataFrame:
    """Complete single-worker first-round orders with their actual/standard effort ratio."""
    if check:
        assert_unique(orders, ["WO"], "work order")
        assert_unique(item_map, ["Item"], "learning item map")
    first = drop_other(hours).filter((F.col("RoundNo") == 1) & F.col("Worker").isNotNull())
    per_worker = first.groupBy("WO", "Worker").agg(F.sum("Final").alias("Final"))
    sole = per_worker.groupBy("WO").agg(F.count("*").alias("n"), F.min("Worker").alias("Worker"), F.max("Final").alias("Final"))
    frame = sole.filter("n = 1").drop("n").join(orders.filter("Status = 'Complete'"), "WO")
    frame = frame.filter("GoodPieces > 0 AND StandardRuntime > 0 AND Final > 0 AND MaxRafDate IS NOT NULL")
    expected = F.col("GoodPieces") * F.col("StandardRuntime") / 60
    if check:
        broken = F.col("EarnedHours").isNotNull() & ~or_false(is_close(F.col("EarnedHours"), expected, 1e-6, 1e-5))
        assert_none(frame.filter(broken), "Learning source has inconsistent EarnedHours rows")
    frame = frame.withColumn("EffortRatio", F.col("Final") / expected)
    frame = frame.filter(F.col("EffortRatio").between(RATIO_MIN, RATIO_MAX))
    mapped = item_map.select("Item", "Process", GROUP).filter(f"Process IS NOT NULL AND {GROUP} IS NOT NULL")
    return frame.join(mapped, "Item").withColumnRenamed("MaxRafDate", "WODate")


def learning_pairs(cohort: DataFrame, tie_breakers: list[str] | None = None) -> DataFrame:
    """Early, middle and late effort of every worker-item history that passes the gates."""
    order = [F.col("WODate"), *[F.col(c) for c in (tie_breakers or ["WO"])]]
    span = F.floor((micros(F.max("WODate")) - micros(F.min("WODate"))) / F.lit(86_400_000_000)).cast("bigint")
    facts = cohort.groupBy(*PAIR).agg(
        F.count("*").alias("WOCount"), span.alias("SpanDays"), F.count_distinct("WODate").alias("Dates"),
        F.min("WODate").alias("FirstWODate"), F.max("WODate").alias("LastWODate"),
    )
    gated = facts.filter((F.col("WOCount") >= MIN_PAIR_WOS) & (F.col("SpanDays") >= MIN_PAIR_DAYS) & (F.col("Dates") >= MIN_PAIR_DATES))
    rows = cohort.join(gated.select(*PAIR), PAIR, "left_semi").withColumn("y", F.ln("EffortRatio"))
    placed = row_positions(rows, PAIR, F.to_date("WODate"), order, "rn")
    n, rn, half = F.col("rnTotal"), F.col("rn"), F.floor(F.col("rnTotal") / 2)
    # Each stage holds exactly two orders, so its median is their mean.
    stages = placed.groupBy(*PAIR).agg(
        F.avg(F.when(rn <= 2, F.col("y"))).alias("e"),
        F.avg(F.when((rn == half) | (rn == half + 1), F.col("y"))).alias("m"),
        F.avg(F.when(rn >= n - 1, F.col("y"))).alias("l"),
    )
    return gated.drop("Dates").join(stages, PAIR).select(
        *PAIR, "WOCount", "SpanDays", "FirstWODate", "LastWODate",
        F.exp("e").alias("EarlyEffortRatio"), F.exp("m").alias("MiddleEffortRatio"), F.exp("l").alias("LateEffortRatio"),
        (F.col("e") - F.col("l")).alias("EarlyToLateLogDrop"), (F.col("m") - F.col("l")).alias("MiddleToLateLogDrop"),
        (F.col("e") - F.col("l") > IMPROVEMENT).alias("ImprovedAtLeast10Pct"),
    )


def group_evidence(pairs: DataFrame) -> DataFrame:
    span = F.floor((micros(F.max("LastWODate")) - micros(F.min("FirstWODate"))) / F.lit(86_400_000_000)).cast("bigint")
    facts = pairs.groupBy("Process", GROUP).agg(
        F.count("*").alias("LearningTrajectoryN"), F.sum("WOCount").alias("LearningWON"),
        F.count_distinct("Worker").alias("__workers"), span.alias("LearningSpanDays"),
    )
    passed = (
        (F.col("LearningTrajectoryN") >= MIN_GROUP_PAIRS) & (F.col("LearningWON") >= MIN_GROUP_WOS)
        & (F.col("__workers") >= MIN_GROUP_WORKERS) & (F.col("LearningSpanDays") >= MIN_PAIR_DAYS)
    )
    return facts.withColumn("Eligible", passed).drop("__workers")


def learning_scores(pairs: DataFrame) -> DataFrame:
    """Median stage effort per group ranked 0-10 within the process, averaged over stages."""
    pairs = cut_lineage(pairs)
    evidence = cut_lineage(group_evidence(pairs))
    scored = pairs.join(evidence.filter("Eligible").select("Process", GROUP), ["Process", GROUP], "left_semi")
    out = evidence
    ranks = evidence.filter("Eligible").select("Process", GROUP)
    for i, stage in enumerate(STAGES, 1):
        medians = quantiles(scored, ["Process", GROUP], f"{stage}EffortRatio", {f"Learning{stage}Ratio": 0.5})
        ranks = ranks.join(medians, ["Process", GROUP])
        ranks = midpoint_score(ranks, ["Process"], f"Learning{stage}Ratio", f"LearningL{i}")
    ranks = ranks.withColumn("LearningSourceScore", (F.col("LearningL1") + F.col("LearningL2") + F.col("LearningL3")) / 3)
    status = F.when(F.col("Eligible"), "OBSERVED_WINDOW_MODEL_ESTIMATE").otherwise("INSUFFICIENT_REPEATED_HISTORY")
    return out.join(ranks, ["Process", GROUP], "left").withColumn("LearningSourceStatus", status)


def _score_against(points: DataFrame, value: str, reference: DataFrame, ref_value: str, name: str) -> DataFrame:
    """Midpoint percentile of each point within its process's reference values."""
    marks = reference.select("Process", F.col(ref_value).alias("__v"), F.lit(1).alias("ref")).unionByName(
        points.select("Process", F.col(value).alias("__v"), F.lit(0).alias("ref"))
    )
    facts = prefix_totals(marks, ["Process"], "__v", {"ref": F.col("ref")})
    middle = (2 * F.col("ref_before") + F.col("ref") - 1) / 2
    score = F.when(F.col("ref_total") == 1, F.lit(5.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(10.0), 10 * middle / (F.col("ref_total") - 1)))
    )
    return points.join(facts.select("Process", F.col("__v").alias(value), score.alias(name)), ["Process", value])


def _resampled_medians(pairs: DataFrame, repetitions: int, seed: int) -> DataFrame:
    """(Process, group, Rep, Stage, v): exact medians of every stage over Poisson(1) resamples of the pairs.

    Nearly every resampled median has a rank within a few root n of the middle. Only pairs that close are repeated for each
    replicate; of the pairs below only the total weight counts, summed before any shuffle. A median that the window does not
    hold is taken from all pairs of its group.
    """
    group, spark = ["Process", GROUP], pairs.sparkSession
    stages = range(1, len(STAGES) + 1)
    reps = F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("Rep")
    weight = poisson_one(F.lit(seed), F.col("Rep"), *[F.col(c) for c in PAIR])
    wide = pairs.select(*PAIR, *[F.col(f"{s}EffortRatio").alias(f"v{i}") for i, s in zip(stages, STAGES)])
    # A fixed number of partitions here and below: few rows become many, so they are not to be merged by their size.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wide = settle(wide.repartition(tasks, *PAIR))
    rows = wide.select(*PAIR, F.inline(F.array(*[F.struct(F.lit(i).alias("Stage"), F.col(f"v{i}").alias("v")) for i in stages])))
    rows = rows.filter("v IS NOT NULL")

    facts = ranked(rows, [*group, "Stage"], "v")
    middle, reach = (F.col("n_total") - 1) / 2, NEAR_MIDDLE * (F.sqrt("n_total") + 1)
    near = (F.col("n_before") <= middle + reach) & (F.col("n_before") + F.col("n") - 1 >= middle - reach)
    windows = settle(facts.filter(near).groupBy(*group, "Stage").agg(F.min("v").alias("low"), F.max("v").alias("high")))
    bounds = windows.groupBy(*group).agg(*[F.max(F.when(F.col("Stage") == i, F.col("low"))).alias(f"low{i}") for i in stages])
    weighed = wide.join(settle(bounds), group).select("*", reps).withColumn("k", weight).filter("k > 0")
    totals = weighed.groupBy(*group, "Rep").agg(
        *[F.sum(F.when(F.col(f"v{i}").isNotNull(), F.col("k"))).alias(f"total{i}") for i in stages],
        *[F.sum(F.when(F.col(f"v{i}") < F.col(f"low{i}"), F.col("k")).otherwise(0)).alias(f"below{i}") for i in stages],
    )
    parts = [F.struct(F.lit(i).alias("Stage"), F.col(f"total{i}").alias("total"), F.col(f"below{i}").alias("below")) for i in stages]
    totals = settle(totals.select(*group, "Rep", F.inline(F.array(*parts))).filter("total IS NOT NULL"))

    # Dealt before the replicates are made; a window is about root n pairs, so its replicates are sorted in one task.
    close = rows.join(windows, [*group, "Stage"]).filter("v BETWEEN low AND high").repartition(tasks, *group, "Stage")
    close = close.select(*PAIR, "Stage", "v", reps).withColumn("k", weight).filter("k > 0").drop("Worker", "Item")
    key = [*group, "Stage", "Rep"]
    running = W.partitionBy(*key).orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    placed = close.withColumn("before", F.coalesce(F.sum("k").over(running), F.lit(0))).join(totals, key)
    first = F.col("below") + F.col("before")
    rank = (F.col("total") - 1) / 2

    def at(wanted: Column) -> Column:
        return F.max(F.when((wanted >= first) & (wanted < first + F.col("k")), F.col("v")))

    found = placed.groupBy(*key).agg(at(F.floor(rank)).alias("lower"), at(F.ceil(rank)).alias("upper"), F.max(rank - F.floor(rank)).alias("fraction"))
    found = settle(found.filter("lower IS NOT NULL AND upper IS NOT NULL").select(*key, (F.col("lower") + F.col("fraction") * (F.col("upper") - F.col("lower"))).alias("v")))
    missing = settle(totals.select(*key).join(found, key, "left_anti"))
    if missing.isEmpty():
        return found
    rest = rows.join(missing, [*group, "Stage"]).withColumn("k", weight).filter("k > 0")
    return found.unionByName(quantiles(rest, key, "v", {"v": 0.5}, weight=F.col("k")))


def learning_bootstrap(pairs: DataFrame, scores: DataFrame, repetitions: int = 200, seed: int = 42) -> DataFrame:
    """Share of resampled scores within one point, and a 90 % interval, per scored group."""
    reference = cut_lineage(scores.filter("Eligible"))
    scored = pairs.join(reference.select("Process", GROUP), ["Process", GROUP], "left_semi")
    medians = _resampled_medians(scored, repetitions, seed)
    key = ["Process", GROUP, "Rep"]
    merged = medians.select(*key).distinct()
    for i, stage in enumerate(STAGES, 1):
        points = medians.filter(F.col("Stage") == i).select(*key, F.col("v").alias(f"v{i}"))
        merged = merged.join(_score_against(points, f"v{i}", reference, f"Learning{stage}Ratio", f"s{i}").select(*key, f"s{i}"), key)
    point = reference.select("Process", GROUP, "LearningSourceScore")
    sampled = merged.withColumn("s", (F.col("s1") + F.col("s2") + F.col("s3")) / 3).join(point, ["Process", GROUP])
    near = (F.abs(F.col("s") - F.col("LearningSourceScore")) <= 1).cast("double")
    # At most ``repetitions`` values per group reach the percentile.
    return sampled.groupBy("Process", GROUP).agg(
        F.avg(near).alias("LearningConfidencePct"),
        F.percentile("s", F.lit(0.05)).alias("LearningInterval90Lower"),
        F.percentile("s", F.lit(0.95)).alias("LearningInterval90Upper"),
    ).withColumn("LearningConfidenceStatus", F.lit("CONDITIONAL_DIAGNOSTIC"))
