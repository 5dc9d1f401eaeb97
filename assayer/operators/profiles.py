"""Distribution profiles of semi-finished items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators.bom import USABLE
from assayer.operators.contracts import assert_none
from assayer.operators.ordering import quantiles
from assayer.session import cut_lineage

# Part-count bins as (label, upper bound).
PART_BINS = [("0", 0.0), ("1", 1.0), ("2", 2.0), ("3-4", 4.0), ("5-9", 9.0), ("10-19", 19.0), ("20-49", 49.0)]
PART_TOP = "50+"
MECHANICAL_GROUPS = ["SM_Casting", "SM_ACJ"]


def representative(rolled: DataFrame) -> DataFrame:
    """One context per item: usable first, then by file and finished good."""
    order = F.struct((F.col("Status") != USABLE).alias("u"), "SourceFile", "Fg")
    payload = [c for c in rolled.columns if c != "SemiBom"]
    picked = rolled.groupBy("SemiBom").agg(F.min_by(F.struct(*payload), order).alias("__row"), F.count("*").alias("ContextCount"))
    return picked.select("SemiBom", "__row.*", "ContextCount")


def part_bin(value: Column) -> Column:
    chain = F.when(value.isNull() | (value < -0.1), F.lit(None).cast("string"))
    for label, upper in PART_BINS:
        chain = chain.when(value <= upper, label)
    return chain.otherwise(PART_TOP)


def part_histogram(df: DataFrame, value: str) -> DataFrame:
    """All eight bins, empty ones included, with their share of the population."""
    labels = [label for label, _ in PART_BINS] + [PART_TOP]
    counts = df.groupBy(part_bin(F.col(value)).alias("PartCountBin")).agg(F.count("*").alias("n"))
    wide = counts.agg(
        F.sum("n").alias("Population"),
        *[F.coalesce(F.sum(F.when(F.col("PartCountBin") == l, F.col("n"))), F.lit(0)).alias(l) for l in labels],
    )
    long = wide.unpivot(["Population"], labels, "PartCountBin", "SemiCount")
    return long.select(
        "PartCountBin", "SemiCount", F.round(F.col("SemiCount") / F.col("Population") * 100, 2).alias("ShareOfPopulationPct")
    )


def profile(df: DataFrame, dimensions: list[str], measures: dict[str, dict[str, float]], stones: str) -> DataFrame:
    """Counts, exact quantiles per measure and the share with stones, per dimension combination."""
    labelled = cut_lineage(df.withColumns({d: F.coalesce(F.nullif(F.col(d), F.lit("")), F.lit("Unmapped")) for d in dimensions}))
    out = labelled.groupBy(*dimensions).agg(
        F.count("*").alias("SemiCount"),
        F.count_if(F.col(stones) > 0).alias("SemiWithStones"),
        F.round(F.count_if(F.col(stones) > 0) / F.count("*") * 100, 2).alias("SemiWithStonesPct"),
    )
    for measure, wanted in measures.items():
        out = out.join(quantiles(labelled, dimensions, measure, wanted), dimensions, "left")
    return out


def profile_each(df: DataFrame, dimensions: list[str], measures: dict[str, dict[str, float]], stones: str) -> DataFrame:
    """The same profile one dimension at a time, in long form."""
    entries = F.array(*[F.struct(F.lit(d).alias("Dimension"), F.col(d).alias("Value")) for d in dimensions])
    kept = [*measures, stones]
    long = df.select(*kept, F.inline(entries))
    total = df.agg(F.count("*").alias("__total")).withColumn("__k", F.lit(1))
    rows = profile(long, ["Dimension", "Value"], measures, stones).withColumn("__k", F.lit(1)).join(total, "__k")
    return rows.withColumn("ShareOfUsableSemiPct", F.round(F.col("SemiCount") / F.col("__total") * 100, 2)).drop("__k", "__total")


def mechanical_parts(lines: DataFrame, contexts: DataFrame, check: bool = True) -> DataFrame:
    """Direct mechanical part quantity and SKU count per selected context."""
    keys = ["SourceFile", "Fg", "SemiBom"]
    matched = lines.withColumnRenamed("Node", "SemiBom").join(contexts.select(*keys), keys)
    rows = matched.filter(F.col("ItemGroup").isin(*MECHANICAL_GROUPS) & (F.col("Unit") == "PCS"))
    if check:
        absent = contexts.select(*keys).join(matched.select(*keys).distinct(), keys, "left_anti")
        assert_none(absent, "Selected contexts are not found in the BOM lines", absent.columns)
        assert_none(rows.filter("Qty IS NULL OR Qty <= 0"), "Usable contexts contain invalid mechanical quantities")
    return rows.groupBy("SemiBom").agg(
        F.sum("Qty").alias("MechanicalPartCount"), F.count_distinct("Component").alias("MechanicalPartSkus")
    )


def group_presence(reach: DataFrame, lines: DataFrame, contexts: DataFrame) -> DataFrame:
    """Distinct item groups present below each selected item."""
    leaves = reach.join(lines.filter("ValidQty AND Supply = '' AND ItemGroup <> 'Services'"), ["SourceFile", "Fg", "Node"])
    rows = leaves.select("SourceFile", "Fg", F.col("Root").alias("SemiBom"), "ItemGroup").distinct()
    return rows.join(contexts.select("SourceFile", "Fg", "SemiBom"), ["SourceFile", "Fg", "SemiBom"], "left_semi")


def presence_distribution(presence: DataFrame, population: DataFrame) -> DataFrame:
    """Items per material group and the share of the population."""
    total = population.agg(F.count("*").alias("__total")).withColumn("__k", F.lit(1))
    rows = presence.groupBy("ItemGroup").agg(F.count_distinct("SemiBom").alias("SemiCount")).withColumn("__k", F.lit(1))
    return rows.join(total, "__k").select(
        "ItemGroup", "SemiCount", F.round(F.col("SemiCount") / F.col("__total") * 100, 2).alias("SharePct")
    )


def item_library(df: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """Records, distinct workers and a representative of each attribute per item."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("Records"), F.count_distinct("Worker").alias("Workers"), *[F.min(a).alias(a) for a in attributes]
    )
