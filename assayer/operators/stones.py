"""Stone composition and complexity per semi-finished item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.expressions import ladder, or_false
from assayer.operators.contracts import assert_functional

# Count ladder and component weights.
COUNT_LADDER = [(0, 0), (1, 1), (2, 2), (4, 3), (9, 4), (20, 5), (39, 6), (76, 7), (149, 8), (359, 9)]
WEIGHTS = {"MaterialScore": 0.25, "ShapeComponent": 0.20, "CountScore": 0.15, "SizeComponent": 0.40}
QUANTITY_COLUMNS = {
    "Diamond": "DiamondQty", "Natural stone": "NaturalQty", "Synthetic stone": "SyntheticQty", "Pearl": "PearlQty",
    "Old stone (unspecified)": "OldQty",
}


def composition_conflicts(paths: DataFrame) -> DataFrame:
    """Items whose stone composition differs between finished goods.

    Compositions are compared by an order-free fingerprint of (stone, count) pairs, so a
    large composition is never gathered into one array.
    """
    per_sku = paths.groupBy("SemiBom", "Fg", "StoneSku").agg(F.sum("EffectiveCount").alias("n"))
    pair = F.xxhash64("StoneSku", "n")
    per_fg = per_sku.groupBy("SemiBom", "Fg").agg(F.count("*").alias("k"), F.bit_xor(pair).alias("h"), F.sum("n").alias("t"))
    return per_fg.groupBy("SemiBom").agg(
        F.count("*").alias("FgUseCount"),
        ((F.min("k") != F.max("k")) | (F.min("h") != F.max("h")) | (F.min("t") != F.max("t"))).alias("CompositionConflict"),
    )


def representative_stones(paths: DataFrame) -> DataFrame:
    """Stone counts per item from its first finished good."""
    chosen = paths.groupBy("SemiBom").agg(F.min("Fg").alias("Fg"))
    return paths.join(chosen, ["SemiBom", "Fg"]).groupBy("SemiBom", "Fg", "StoneSku").agg(F.sum("EffectiveCount").alias("EffectiveCount"))


def stone_complexity(detail: DataFrame) -> DataFrame:
    """Strict score when everything is known, else the available parts renormalised.

    ``detail``: SemiBom, StoneSku, StoneType, EffectiveCount and the three stone scores.
    """
    n = F.col("EffectiveCount")
    sized = F.col("UnitSizeScore").isNotNull()
    sums = detail.groupBy("SemiBom").agg(
        F.sum(n).alias("TotalStoneCount"),
        F.count("*").alias("DistinctStoneSku"),
        *[F.sum(F.when(F.col("StoneType") == t, n).otherwise(0.0)).alias(c) for t, c in QUANTITY_COLUMNS.items()],
        F.array_join(F.array_sort(F.collect_set("StoneType")), "; ").alias("StoneTypeList"),
        F.max("MaterialScore").alias("MaterialScore"),
        F.max("ShapeScore").alias("MaxShapeScore"),
        (F.sum(F.col("ShapeScore") * n) / F.sum(n)).alias("AvgShapeScore"),
        F.max("UnitSizeScore").alias("LargestSizeScore"),
        (F.sum(F.when(sized, F.col("UnitSizeScore") * n)) / F.sum(F.when(sized, n))).alias("AvgSizeScore"),
        F.count_if(sized).alias("SizedSkus"),
    )
    parts = sums.withColumns(
        {
            "ShapeComponent": 0.70 * F.col("MaxShapeScore") + 0.30 * F.col("AvgShapeScore"),
            "SizeComponent": 0.75 * F.col("LargestSizeScore") + 0.25 * F.col("AvgSizeScore"),
            "CountScore": ladder(F.col("TotalStoneCount"), COUNT_LADDER, 10),
        }
    )
    whole = F.col("MaterialScore").isNotNull() & (F.col("SizedSkus") == F.col("DistinctStoneSku"))
    total = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in WEIGHTS.items()), F.lit(0.0))
    covered = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in WEIGHTS.items()), F.lit(0.0))
    missing = F.concat_ws(
        "; ",
        F.when(F.col("MaterialScore").isNull(), F.lit("Material score missing (unspecified stone)")),
        F.when(F.col("SizedSkus") == 0, F.lit("Size score missing for all stones")).when(
            F.col("SizedSkus") < F.col("DistinctStoneSku"),
            F.format_string("%d of %d SKUs missing size score", F.col("DistinctStoneSku") - F.col("SizedSkus"), F.col("DistinctStoneSku")),
        ),
    )
    return parts.withColumns(
        {
            "StrictScore": F.when(or_false(whole), F.bround(total, 2)),
            "ProvisionalScore": F.bround(total / covered, 2),
            "ScoreStatus": F.when(or_false(whole), "Complete").otherwise("Provisional"),
            "MissingNote": F.nullif(missing, F.lit("")),
        }
    )


def stone_summary(source: DataFrame, check: bool = True) -> DataFrame:
    """One stone score per item from a score table; conflicting scores are rejected."""
    rows = source.filter(F.col("SemiBom").startswith("2"))
    if check:
        assert_functional(rows, ["SemiBom"], "Score", "Stone scores conflict across finished goods")
    return rows.groupBy("SemiBom").agg(
        F.max("Score").alias("StoneSourceScore"), F.count_distinct("Fg").alias("StoneFgContexts"), F.count("*").alias("StoneSourceRows")
    )
