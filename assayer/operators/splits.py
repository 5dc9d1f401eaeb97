"""Leakage-free temporal cohorts and as-of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.expressions import micros
from assayer.operators.contracts import assert_none
from assayer.operators.ordering import ranked, row_positions


def split_by_fraction(
    df: DataFrame,
    entity: str,
    start: str,
    stop: str,
    fractions: list[float],
    labels: list[str],
    by: list[str] | None = None,
    unit: str = "day",
    clamp: bool = False,
    min_units: int = 2,
    too_few: str = "embargo",
    era_start: Column | None = None,
    name: str = "Split",
) -> DataFrame:
    """Label entities by window; those that cross a boundary are embargoed.

    Cutoffs are taken at fixed fractions of the distinct first dates (per ``by`` keys). Spans
    are aggregated per entity, so only distinct dates are ever ordered.
    """
    keys = by or []
    spans = df.groupBy(*keys, entity).agg(F.min(start).alias("__start"), F.max(stop).alias("__stop"))
    truncated = F.date_trunc("day", "__start") if unit == "day" else F.col("__start")
    dated = spans if era_start is None else spans.filter(F.col("__start") >= era_start)
    units = dated.select(*keys, F.lit(1).alias("__all"), micros(truncated).alias("__unit")).distinct()
    facts = ranked(units, [*keys, "__all"], "__unit")
    cuts = []
    for i, fraction in enumerate(fractions):
        index = F.floor(F.col("n_total") * F.lit(fraction))
        if clamp:
            index = F.greatest(F.least(index, F.col("n_total") - 1), F.lit(1))
        cuts.append(F.max(F.when(F.col("n_before") == index, F.col("__unit"))).alias(f"__cut{i}"))
    bounds = facts.groupBy(*keys, "__all").agg(*cuts, F.max("n_total").alias("__units"))
    placed = spans.withColumn("__all", F.lit(1)).join(bounds, [*keys, "__all"], "left")
    low, high = micros(F.col("__start")), micros(F.col("__stop"))
    chain = F.when(F.coalesce(F.col("__units"), F.lit(0)) < min_units, too_few)
    for i, label in enumerate(labels):
        inside = F.lit(True)
        if i > 0:
            inside = inside & (low >= F.col(f"__cut{i - 1}"))
        if i < len(fractions):
            inside = inside & (high < F.col(f"__cut{i}"))
        chain = chain.when(inside, label)
    labelled = placed.select(*keys, entity, chain.otherwise("embargo").alias(name))
    return df.join(labelled, [*keys, entity])


def chronological_split(df: DataFrame, date: str, entity: str, fraction: float = 0.8) -> DataFrame:
    return split_by_fraction(df, entity, date, date, [fraction], ["train", "test"], unit="instant", clamp=True)


def three_way_split(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return split_by_fraction(
        df, "WO", "QcStart", "QcStop", [0.6, 0.8], ["train", "validation", "test"], by=by, min_units=5,
        too_few="insufficient_dates",
    )


def four_windows(df: DataFrame, date: str, era_start: Column) -> DataFrame:
    return split_by_fraction(
        df, "WO", date, date, [0.50, 0.70, 0.85], ["train", "tune", "calibration", "test"], min_units=20, era_start=era_start
    )


def hold_out_groups(df: DataFrame, group: str, every: int = 5, by: list[str] | None = None) -> DataFrame:
    """Every k-th group in name order, starting with the first; none when there is only one."""
    keys = by or []
    groups = df.select(*keys, group).distinct().withColumn("__all", F.lit(1))
    placed = row_positions(groups, [*keys, "__all"], F.substring(group, 1, 6), [F.col(group)], "Position")
    held = (F.col("PositionTotal") > 1) & ((F.col("Position") - 1) % every == 0)
    return placed.select(*keys, group, held.alias("HeldOut"))


def fold_of(seed: int, folds: int, *key: str) -> Column:
    """Deterministic fold number from the row key."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in key]), F.lit(folds)).cast("bigint")


def flag_unseen(test: DataFrame, train: DataFrame, column: str, name: str) -> DataFrame:
    """Whether an entity of the held-out rows never occurs in training."""
    seen = train.select(column).distinct().withColumn("__seen", F.lit(True))
    return test.join(seen, column, "left").withColumn(name, F.col("__seen").isNull()).drop("__seen")


def skill_scaler(train: DataFrame) -> DataFrame:
    """Training-only sample deviation of skill per process; 5 is the fixed centre."""
    return train.filter("CertifiedSkill IS NOT NULL").groupBy("Process").agg(
        F.stddev_samp("CertifiedSkill").alias("SkillSd"), F.count("*").alias("TrainingRounds")
    )


def scale_skill(df: DataFrame, scaler: DataFrame) -> DataFrame:
    joined = df.join(scaler.select("Process", "SkillSd"), "Process", "left")
    return joined.withColumn("ScaledSkill", F.try_divide(F.col("CertifiedSkill") - 5.0, F.col("SkillSd")))


def through(df: DataFrame, moment: str, column: str = "QcStop") -> DataFrame:
    return df.filter(F.col(column) <= F.lit(moment).cast("timestamp_ntz"))


def leakage_audit(df: DataFrame, date: str, entity: str = "WO", split: str = "Split") -> DataFrame:
    """Entities in more than one window and the time range of each window."""
    shared = df.filter(F.col(split) != "embargo").groupBy(entity).agg(F.min(split).alias("a"), F.max(split).alias("b"))
    leaks = shared.filter("a <> b").agg(F.count("*").alias("SharedEntities")).withColumn("__k", F.lit(1))
    ranges = df.groupBy(split).agg(
        F.count_distinct(entity).alias("Entities"), F.min(date).alias("FirstDate"), F.max(date).alias("LastDate")
    )
    return ranges.withColumn("__k", F.lit(1)).join(leaks, "__k").drop("__k")


def assert_no_leakage(df: DataFrame, date: str, entity: str = "WO") -> DataFrame:
    audit = leakage_audit(df, date, entity)
    assert_none(audit.filter("SharedEntities > 0"), "An entity occurs in more than one window")
    return df


def overlap_of(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Sizes of the shared and one-sided parts of two entity sets."""
    a = left.select(column).distinct().withColumn("__l", F.lit(1))
    b = right.select(column).distinct().withColumn("__r", F.lit(1))
    where = F.when(F.col("__l").isNull(), "right only").when(F.col("__r").isNull(), "left only").otherwise("both")
    return a.join(b, column, "full_outer").groupBy(where.alias("Part")).agg(F.count("*").alias("Entities"))
