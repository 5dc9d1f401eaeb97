"""Bill-of-materials expansion, roll-up and audit over line tables.

Lines: SourceFile, Fg, Node, NodeItem, Component, Supply (child node or blank), Qty, Unit,
ItemGroup, Weight, and optionally Quantity, QuantityUnit, CwSize, ProductName.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.expressions import is_finite, or_false, or_true, to_double
from assayer.session import cut_lineage

CONTEXT = ["SourceFile", "Fg"]
USABLE = "BOM structure usable"
# Stone item groups and their names.
STONE_TYPES = {
    "RM_Diamond": "Diamond",
    "RM_Art ST": "Synthetic stone",
    "RM_Nat ST": "Natural stone",
    "RM_Pearl": "Pearl",
    "RM_Old ST": "Old stone (unspecified)",
}
CASTING = "SM_Casting"
# Steps that every level may broadcast; more of them are sorted and merged, so that levels send nothing to the driver.
BROADCAST_STEPS = 50_000
# Share of a total that the order of its summands may change.
ROUNDING = 1e-11
# Structural warnings.
DUPLICATE_ROWS = "Duplicate export rows: deduplicated scenario"
IDENTITY_CONFLICT = "Conflicting BOM item identity"
CW_SIZE = "BOM CW size is not 1: basis requires review"
BAD_QTY = "Nonpositive or invalid BOM quantity"
CHILD_UNIT = "Child BOM quantity unit is not PCS"
MISSING_CHILD = "Missing child BOM: "
UNEXPANDED = "Unexpanded assembly without Supply BOM"
BAD_STONE = "Invalid stone count/unit"
CIRCULAR = "Circular BOM"
MASS_CONFLICT = "Conflicting incoming declared Semi gram mass"


def stone_type() -> Column:
    chain = None
    for group, name in STONE_TYPES.items():
        chain = (F.when if chain is None else chain.when)(F.col("ItemGroup") == group, F.lit(name))
    return chain


def prepare_lines(raw: DataFrame) -> DataFrame:
    """Deduplicated, typed lines with the number of identical copies and validity facts."""
    for name, default in (("Quantity", None), ("CwSize", 1.0)):
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(default).cast("double"))
    for name in ("QuantityUnit", "ProductName"):
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast("string"))
    counted = raw.groupBy(*raw.columns).agg(F.count("*").alias("Copies"))
    qty = to_double("Qty")
    return counted.withColumns(
        {
            "Qty": qty,
            "Weight": to_double("Weight"),
            "Unit": F.upper(F.trim(F.coalesce("Unit", F.lit("")))),
            "QuantityUnit": F.upper(F.trim(F.coalesce("QuantityUnit", F.lit("")))),
            "Supply": F.trim(F.coalesce("Supply", F.lit(""))),
            "IsStone": F.col("ItemGroup").isin(*STONE_TYPES),
            "StoneType": stone_type(),
        }
    ).withColumn("ValidQty", or_false(is_finite(F.col("Qty")) & (F.col("Qty") > 0)))


def _steps(lines: DataFrame, through_castings: bool) -> DataFrame:
    """Usable parent-to-child steps with total quantity per pair."""
    usable = lines.filter("ValidQty AND Unit = 'PCS' AND Supply <> ''")
    if not through_castings:
        usable = usable.filter(F.col("ItemGroup") != CASTING)
    return usable.groupBy(*CONTEXT, "Node", "Supply").agg(F.sum("Qty").alias("StepQty"))


def closure(lines: DataFrame, through_castings: bool = True, look_after: int = 64) -> DataFrame:
    """(context, Root, Node, Multiplier): every node below a root with its total multiplicity.

    Multiplicities are summed per (root, node) at each level, so shared sub-assemblies never unfold into separate paths,
    and levels go on until nothing is left however deep a tree is. What still grows after ``look_after`` levels is looked
    through for cycles once: roots on or above a cycle leave and are re-expanded along guarded paths, with Cyclic set.
    The bound only says when to look; deep trees without a cycle simply go on.
    """
    nodes = lines.select(*CONTEXT, "Node").distinct()
    steps = cut_lineage(_steps(lines, through_castings).join(nodes.withColumnRenamed("Node", "Supply"), [*CONTEXT, "Supply"], "left_semi"))
    if steps.count() > BROADCAST_STEPS:
        steps = steps.hint("merge")
    frontier = nodes.select(*CONTEXT, F.col("Node").alias("Root"), "Node", F.lit(1.0).alias("Multiplier"))
    frontier = cut_lineage(frontier)
    levels, looping = [frontier], None
    while True:
        grown = frontier.join(steps, [*CONTEXT, "Node"]).groupBy(*CONTEXT, "Root", F.col("Supply").alias("Node")).agg(
            F.sum(F.col("Multiplier") * F.col("StepQty")).alias("Multiplier")
        )
        frontier = cut_lineage(grown)
        if not frontier.isEmpty() and looping is None and len(levels) >= look_after:
            looping = _above_cycles(steps).withColumnRenamed("Node", "Root")
            frontier = cut_lineage(frontier.join(looping, [*CONTEXT, "Root"], "left_anti"))
        if frontier.isEmpty():
            break
        levels.append(frontier)
    total = levels[0]
    for level in levels[1:]:
        total = total.unionByName(level)
    total = total.groupBy(*CONTEXT, "Root", "Node").agg(F.sum("Multiplier").alias("Multiplier"))
    if looping is None:
        return total.withColumn("Cyclic", F.lit(False))
    guarded = _guarded_closure(steps, looping)
    return (
        total.join(looping, [*CONTEXT, "Root"], "left_anti")
        .withColumn("Cyclic", F.lit(False))
        .unionByName(guarded.withColumn("Cyclic", F.lit(True)))
    )


def _above_cycles(steps: DataFrame) -> DataFrame:
    """Nodes on a cycle or above one: what is left when steps into nodes without steps are peeled off until none is."""
    left = cut_lineage(steps.select(*CONTEXT, "Node", "Supply"))
    rows = left.count()
    while True:
        heads = left.select(*CONTEXT, F.col("Node").alias("Supply")).distinct()
        left = cut_lineage(left.join(heads, [*CONTEXT, "Supply"], "left_semi"))
        before, rows = rows, left.count()
        if rows == before:
            return cut_lineage(left.select(*CONTEXT, "Node").distinct())


def _guarded_closure(steps: DataFrame, roots: DataFrame) -> DataFrame:
    """Closure of cyclic roots: a path never revisits a node it already contains."""
    paths = cut_lineage(
        roots.select(*CONTEXT, "Root", F.col("Root").alias("Node"), F.lit(1.0).alias("Multiplier"), F.array("Root").alias("Path"))
    )
    out = paths
    while not paths.isEmpty():
        paths = cut_lineage(
            paths.join(steps, [*CONTEXT, "Node"])
            .filter(~F.array_contains("Path", F.col("Supply")))
            .select(*CONTEXT, "Root", F.col("Supply").alias("Node"), (F.col("Multiplier") * F.col("StepQty")).alias("Multiplier"),
                    F.array_append("Path", F.col("Supply")).alias("Path"))
        )
        out = out.unionByName(paths)
    return out.groupBy(*CONTEXT, "Root", "Node").agg(F.sum("Multiplier").alias("Multiplier"))


def leaf_paths(lines: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """One row per path from a root to a leaf line, with the path text and multiplicity.

    Path output is inherently as large as the number of paths; pass ``roots`` to restrict it.
    """
    steps = lines.filter("ValidQty AND Unit = 'PCS' AND Supply <> ''").select(*CONTEXT, "Node", "Supply", F.col("Qty").alias("StepQty"))
    start = lines.select(*CONTEXT, "Node").distinct() if roots is None else roots.select(*CONTEXT, "Node")
    paths = cut_lineage(
        start.select(*CONTEXT, F.col("Node").alias("Root"), "Node", F.lit(1.0).alias("Multiplier"), F.array("Node").alias("Path"))
    )
    out = paths
    while True:
        grown = (
            paths.join(steps, [*CONTEXT, "Node"])
            .filter(~F.array_contains("Path", F.col("Supply")))
            .select(*CONTEXT, "Root", F.col("Supply").alias("Node"), (F.col("Multiplier") * F.col("StepQty")).alias("Multiplier"),
                    F.array_append("Path", F.col("Supply")).alias("Path"))
        )
        paths = cut_lineage(grown)
        if paths.isEmpty():
            break
        out = out.unionByName(paths)
    leaves = lines.filter("ValidQty AND Supply = ''")
    return out.join(leaves, [*CONTEXT, "Node"]).withColumns(
        {
            "PathText": F.concat(F.array_join("Path", " > "), F.lit(" > "), F.col("Component")),
            "EffectiveQty": F.col("Qty") * F.col("Multiplier"),
        }
    )


def node_flags(lines: DataFrame) -> DataFrame:
    """(context, Node, Flag): structural warnings that start at a node."""
    per_node = lines.groupBy(*CONTEXT, "Node").agg(
        (F.max("Copies") > 1).alias("d"),
        or_false(F.min("NodeItem") != F.max("NodeItem")).alias("i"),
        F.bool_or(or_true(F.col("CwSize") != 1)).alias("c"),
        F.bool_or(~F.col("ValidQty")).alias("q"),
        F.bool_or(F.col("ValidQty") & (F.col("Supply") != "") & (F.col("Unit") != "PCS")).alias("u"),
        F.bool_or(F.col("ValidQty") & (F.col("Supply") == "") & (F.col("ItemGroup") == "SM_FGs")).alias("x"),
        F.bool_or(F.col("IsStone") & F.col("ValidQty") & (F.col("Supply") == "") & ~valid_stone_count()).alias("s"),
    )
    texts = {"d": DUPLICATE_ROWS, "i": IDENTITY_CONFLICT, "c": CW_SIZE, "q": BAD_QTY, "u": CHILD_UNIT, "x": UNEXPANDED, "s": BAD_STONE}
    found = F.array_compact(F.array(*[F.when(F.col(k), F.lit(v)) for k, v in texts.items()]))
    own = per_node.select(*CONTEXT, "Node", F.explode(found).alias("Flag"))
    nodes = lines.select(*CONTEXT, F.col("Node").alias("Supply")).distinct()
    missing = (
        lines.filter("ValidQty AND Unit = 'PCS' AND Supply <> ''")
        .join(nodes, [*CONTEXT, "Supply"], "left_anti")
        .select(*CONTEXT, "Node", F.concat(F.lit(MISSING_CHILD), "Supply").alias("Flag"))
    )
    return own.unionByName(missing.distinct())


def valid_stone_count() -> Column:
    return (F.col("Unit") == "PCS") & (F.abs(F.col("Qty") - F.round("Qty")) < 1e-8)


def root_flags(lines: DataFrame, reach: DataFrame) -> DataFrame:
    """Sorted, joined warnings of a root and everything below it."""
    found = reach.join(node_flags(lines), [*CONTEXT, "Node"]).select(*CONTEXT, "Root", "Flag")
    loops = reach.filter("Cyclic").select(*CONTEXT, "Root", F.lit(CIRCULAR).alias("Flag"))
    flags = found.unionByName(loops).distinct()
    return flags.groupBy(*CONTEXT, "Root").agg(F.array_join(F.array_sort(F.collect_set("Flag")), "; ").alias("Flags"))


def declared_mass(lines: DataFrame) -> DataFrame:
    """Declared gram mass of a node from the lines that supply it; conflicting when distinct."""
    mass = F.round(F.col("Quantity") / F.col("Qty"), 8)
    sources = lines.filter((F.col("Supply") != "") & (F.col("QuantityUnit") == "GRAM") & F.col("ValidQty"))
    return sources.groupBy(*CONTEXT, F.col("Supply").alias("Root")).agg(
        F.when((F.min(mass) == F.max(mass)) & (F.min(mass) > 0), F.min(mass)).alias("DeclaredSemiMassGram"),
        or_false(F.min(mass) != F.max(mass)).alias("MassConflict"),
    )


def casting_totals(lines: DataFrame) -> DataFrame:
    """Castings per root, stopping at the first casting on every path."""
    reach = closure(lines, through_castings=False)
    hits = lines.filter((F.col("ItemGroup") == CASTING) & F.col("ValidQty") & (F.col("Unit") == "PCS"))
    return reach.join(hits, [*CONTEXT, "Node"]).groupBy(*CONTEXT, "Root").agg(
        F.sum(F.col("Qty") * F.col("Multiplier")).alias("CastingCountScenario"),
        F.count_distinct("Component").alias("CastingSkus"),
    )


def direct_counts(lines: DataFrame) -> DataFrame:
    """Counts on a node's own lines."""
    part = ~F.col("IsStone") & (F.col("ItemGroup") != "Services") & (F.col("Unit") == "PCS")
    casting = part & (F.col("ItemGroup") == CASTING)
    return lines.groupBy(*CONTEXT, F.col("Node").alias("Root")).agg(
        F.first("NodeItem", True).alias("SemiItem"),
        F.coalesce(F.sum(F.when(part, F.col("Qty"))), F.lit(0.0)).alias("DirectPartCountPCS"),
        F.count_distinct(F.when(part, F.col("Component"))).alias("DirectPartSKUCount"),
        F.coalesce(F.sum(F.when(casting, F.col("Qty"))), F.lit(0.0)).alias("DirectCastingCountPCS"),
        F.coalesce(F.sum(F.when(part & ~casting, F.col("Qty"))), F.lit(0.0)).alias("DirectOtherPartCountPCS"),
        F.coalesce(F.sum(F.when(F.col("IsStone"), F.col("Qty"))), F.lit(0.0)).alias("DirectStoneCount"),
    )


def leaf_totals(lines: DataFrame, reach: DataFrame) -> DataFrame:
    """Stone, weight and part totals over the leaves below each root."""
    leaves = reach.join(lines.filter("ValidQty AND Supply = ''"), [*CONTEXT, "Node"])
    n = F.col("Qty") * F.col("Multiplier")
    stone = F.col("IsStone")
    part = ~stone & (F.col("ItemGroup") != "Services") & (F.col("Unit") == "PCS")
    weighed = stone & valid_stone_count() & or_false(F.col("Weight") > 0)
    excluded = ~stone & (F.col("ItemGroup") != "Services") & (F.col("Unit") != "PCS")
    sums = leaves.groupBy(*CONTEXT, "Root").agg(
        F.sum(F.when(stone, n).otherwise(0.0)).alias("StoneCountScenario"),
        F.sum(F.when(weighed, F.col("Weight") * F.col("Multiplier")).otherwise(0.0)).alias("KnownStoneWeightGram"),
        F.bool_or(stone & ~weighed).alias("WeightMissing"),
        F.max(F.when(weighed, F.col("Weight") / F.col("Qty"))).alias("LargestStone"),
        F.sum(F.when(part, n).otherwise(0.0)).alias("LeafParts"),
        *[F.sum(F.when(F.col("StoneType") == t, n)).alias(f"__{t}") for t in STONE_TYPES.values()],
        F.array_join(
            F.array_sort(F.collect_set(F.when(excluded, F.concat_ws(":", "ItemGroup", "Unit")))), "; "
        ).alias("NonPCSExcludedFromPartCount"),
    )
    skus = leaves.filter(stone).groupBy(*CONTEXT, "Root").agg(
        F.count_distinct("Component").alias("StoneSkus"), F.count_distinct("StoneType").alias("StoneKinds")
    )
    entries = F.array_compact(
        F.array(*[F.when(F.col(f"__{t}").isNotNull(), F.struct(F.lit(t).alias("k"), F.col(f"__{t}").alias("v"))) for t in STONE_TYPES.values()])
    )
    return sums.join(skus, [*CONTEXT, "Root"], "left").withColumn("StoneCountByType", F.to_json(F.map_from_entries(entries))).drop(
        *[f"__{t}" for t in STONE_TYPES.values()]
    )


def roll_up(raw: DataFrame) -> DataFrame:
    """One row per context and semi-finished node with counts, weights, ratios and status.

    Structure-dependent measures are blank when any warning applies; scenario counts stay.
    """
    lines = cut_lineage(prepare_lines(raw))
    reach = cut_lineage(closure(lines))
    base = (
        direct_counts(lines)
        .filter(F.col("Root") != F.col("Fg"))
        .join(leaf_totals(lines, reach), [*CONTEXT, "Root"], "left")
        .join(casting_totals(lines), [*CONTEXT, "Root"], "left")
        .join(declared_mass(lines), [*CONTEXT, "Root"], "left")
        .join(root_flags(lines, reach), [*CONTEXT, "Root"], "left")
    )
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("StoneCountScenario", "KnownStoneWeightGram", "LeafParts", "CastingCountScenario")}
    zero |= {c: F.coalesce(c, F.lit(0)) for c in ("StoneSkus", "StoneKinds", "CastingSkus")}
    base = base.withColumns(zero | {"WeightMissing": or_false(F.col("WeightMissing")), "__ok": F.col("Flags").isNull()})
    ok = F.col("__ok")
    weights_ok = ok & ~F.col("WeightMissing")
    status = F.concat_ws("; ", "Flags", F.when(or_false(F.col("MassConflict")), F.lit(MASS_CONFLICT)))
    base = base.withColumns(
        {
            "Status": F.when(status == "", USABLE).otherwise(status),
            "CastingCountPCS": F.when(ok, F.col("CastingCountScenario")),
            "CastingSKUCount": F.when(ok, F.col("CastingSkus")),
            "LeafPartCountPCS": F.when(ok, F.col("LeafParts")),
            "StoneCount": F.when(ok, F.col("StoneCountScenario")),
            "StoneSKUCount": F.when(ok, F.col("StoneSkus")),
            "StoneTypeCount": F.when(ok, F.col("StoneKinds")),
            "TotalStoneWeightGram": F.when(weights_ok, F.col("KnownStoneWeightGram")),
            "MaxStoneWeightGram": F.when(weights_ok, F.col("LargestStone")),
            "WeightStatus": F.when(F.col("WeightMissing"), "Missing stone weights")
            .when(F.col("StoneCountScenario") == 0, "No stones observed")
            .otherwise("Observed line grams; Semi denominator needs inclusion policy"),
        }
    )
    total, largest, mass = F.col("TotalStoneWeightGram"), F.col("MaxStoneWeightGram"), F.col("DeclaredSemiMassGram")
    return base.withColumns(
        {
            "AvgStoneWeightGram": F.when(F.col("StoneCountScenario") > 0, total / F.col("StoneCountScenario")),
            "LargestSingleStonePctOfAllStones": F.when(total > 0, 100 * largest / total),
            "LargestSingleStonePctOfDeclaredSemiMass": F.when(mass > 0, 100 * largest / mass),
            "SemiMassIfDeclaredExcludesStonesGram": F.when(mass > 0, mass + total),
            "LargestSingleStonePctIfDeclaredExcludesStones": F.when((mass > 0) & (total > 0), 100 * largest / (mass + total)),
            "SemiMassBasisStatus": F.when(
                or_false(largest > mass),
                "Largest stone exceeds declared Semi mass; cannot treat declared mass as gross weight without review",
            ).otherwise("Confirm whether declared mass includes stones"),
        }
    ).drop("Flags", "MassConflict", "__ok", "LargestStone", "StoneSkus", "StoneKinds", "CastingSkus", "LeafParts").withColumnRenamed("Root", "SemiBom")


def context_conflicts(rolled: DataFrame) -> DataFrame:
    """Whether any structural metric differs between contexts of the same item."""
    metrics = ["DirectPartCountPCS", "CastingCountScenario", "StoneCountScenario", "KnownStoneWeightGram"]
    spread = rolled.groupBy("SourceFile", "SemiBom").agg(
        F.count("*").alias("Contexts"), *[(F.min(m) != F.max(m)).alias(f"__{m}") for m in metrics]
    )
    differs = F.lit(False)
    for m in metrics:
        differs = differs | or_false(F.col(f"__{m}"))
    return spread.select("SourceFile", "SemiBom", "Contexts", differs.alias("ContextConflict"))


def stone_master(lines: DataFrame) -> DataFrame:
    """Weight variants and known unit weight per stone component."""
    unit = F.when((F.col("Weight") > 0) & (F.col("Qty") > 0) & (F.col("Unit") == "PCS"), F.col("Weight") / F.col("Qty"))
    stones = lines.filter("IsStone").withColumn("UnitWeight", unit)
    return stones.groupBy("Component").agg(
        F.array_join(F.array_sort(F.collect_set("StoneType")), "; ").alias("StoneType"),
        F.count_distinct(F.round("UnitWeight", 8)).alias("PositiveWeightVariants"),
        F.min("UnitWeight").alias("KnownUnitWeightGram"),
        F.count("*").alias("SourceRows"),
        F.count_if(F.col("UnitWeight").isNull()).alias("MissingWeightRows"),
    )


def bottom_up_totals(lines: DataFrame) -> DataFrame:
    """Independent check: castings, stones and weight of each node from its children upward.

    Nodes on or above a cycle never have all children known and get no row; the audit counts them as failures.
    """
    q = F.col("Qty")
    pcs = F.col("Unit") == "PCS"
    casting = pcs & (F.col("ItemGroup") == CASTING)
    leaf_stone = (F.col("Supply") == "") & F.col("IsStone")
    own = lines.groupBy(*CONTEXT, "Node").agg(
        F.sum(F.when(F.col("ValidQty") & casting, q).otherwise(0.0)).alias("c"),
        F.sum(F.when(F.col("ValidQty") & leaf_stone, q).otherwise(0.0)).alias("s"),
        F.sum(F.when(F.col("ValidQty") & leaf_stone & valid_stone_count() & or_false(F.col("Weight") > 0), F.col("Weight")).otherwise(0.0)).alias("w"),
    )
    nodes = own.select(*CONTEXT, F.col("Node").alias("Supply"))
    links = cut_lineage(
        lines.filter("ValidQty AND Unit = 'PCS' AND Supply <> ''")
        .join(nodes, [*CONTEXT, "Supply"], "left_semi")
        .select(*CONTEXT, "Node", "Supply", "Qty", F.when(casting, 0.0).otherwise(1.0).alias("through"))
    )
    waiting = cut_lineage(own)
    done = cut_lineage(waiting.join(links.select(*CONTEXT, "Node").distinct(), [*CONTEXT, "Node"], "left_anti"))
    waiting = cut_lineage(waiting.join(done.select(*CONTEXT, "Node"), [*CONTEXT, "Node"], "left_anti"))
    while not waiting.isEmpty():
        known = done.select(*CONTEXT, F.col("Node").alias("Supply"), F.col("c").alias("kc"), F.col("s").alias("ks"), F.col("w").alias("kw"))
        sums = links.join(known, [*CONTEXT, "Supply"], "left").groupBy(*CONTEXT, "Node").agg(
            F.bool_and(F.col("kc").isNotNull()).alias("ready"),
            F.sum(F.col("through") * F.col("Qty") * F.col("kc")).alias("ac"),
            F.sum(F.col("Qty") * F.col("ks")).alias("as"),
            F.sum(F.col("Qty") * F.col("kw")).alias("aw"),
        )
        fresh = waiting.join(sums.filter("ready"), [*CONTEXT, "Node"]).select(
            *CONTEXT, "Node", (F.col("c") + F.col("ac")).alias("c"), (F.col("s") + F.col("as")).alias("s"), (F.col("w") + F.col("aw")).alias("w")
        )
        fresh = cut_lineage(fresh)
        if fresh.isEmpty():
            break
        done = cut_lineage(done.unionByName(fresh))
        waiting = cut_lineage(waiting.join(fresh.select(*CONTEXT, "Node"), [*CONTEXT, "Node"], "left_anti"))
    return done.select(
        *CONTEXT, F.col("Node").alias("SemiBom"), F.col("c").alias("Castings"), F.col("s").alias("Stones"), F.col("w").alias("Weight")
    )


def audit(rolled: DataFrame, bottom_up: DataFrame) -> DataFrame:
    """Largest disagreement per metric between the roll-up and the bottom-up totals, and broken invariants."""
    # A root that the check could not total, because it is cyclic, counts as checked and failed.
    both = rolled.join(bottom_up, [*CONTEXT, "SemiBom"], "left")
    pairs = {"CastingCountScenario": "Castings", "StoneCountScenario": "Stones", "KnownStoneWeightGram": "Weight"}

    def apart(a: Column, b: Column, least: float) -> Column:
        """Further apart than ``least`` and than rounding explains: totals of many terms differ by the order they are summed in."""
        return F.abs(a - b) > F.lit(least) + ROUNDING * F.greatest(F.abs(a), F.abs(b))

    average = apart(F.col("AvgStoneWeightGram") * F.col("StoneCount"), F.col("TotalStoneWeightGram"), 1e-8)
    differs = F.lit(False)
    for a, b in pairs.items():
        differs = differs | or_true(apart(F.col(a), F.col(b), 1e-7))
    share = ~F.col("LargestSingleStonePctOfAllStones").between(0, 100.0000001)
    return both.agg(
        F.count("*").alias("Checked"),
        F.count_if(differs).alias("Mismatches"),
        F.count_if(or_false(average) | or_false(share)).alias("InvariantErrors"),
    )
