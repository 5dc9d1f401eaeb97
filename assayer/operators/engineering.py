"""Engineering score and quote inputs reconciled to item grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.expressions import clean_text, first_reason, is_finite, or_false, or_true, ratio, to_double
from assayer.operators.contracts import assert_none, assert_unique, require_columns, with_group_stats

# Product-type spellings and their canonical names; candidate part weights.
TYPE_ALIASES = {"Neck": "Necklace", "Brace": "Bracelet", "Accesso": "Accessory", "Pin, Br": "Pin/Brooch"}
PART_WEIGHTS = (0.6, 0.7)


def product_type(value: Column) -> Column:
    text = F.coalesce(F.trim(value), F.lit(""))
    chain = None
    for source, target in TYPE_ALIASES.items():
        chain = (F.when if chain is None else chain.when)(text == source, F.lit(target))
    return chain.otherwise(text)


def classify_quotes(quotes: DataFrame, scope: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(normalised quote per item in scope, every source row with its status)."""
    rows = quotes.withColumns({"SemiBom": F.trim("SemiBom"), "QuoteItem": F.trim("QuoteItem"), "NumericMinutes": to_double("Minutes")})
    inside = rows.join(scope.select("SemiBom").distinct(), "SemiBom", "left_semi")
    minutes = F.col("NumericMinutes")
    status = (
        F.when(F.count("*") > F.count(minutes), "INVALID_VALUE")
        .when((F.min(minutes) != F.max(minutes)) | or_false(F.min("QuoteItem") != F.max("QuoteItem")) | (F.count("QuoteItem") == 0), "CONFLICTING_QUOTE")
        .when(F.min(minutes) <= 0, "NONPOSITIVE_QUOTE")
        .otherwise("SUPPLIED")
    )
    per_item = inside.groupBy("SemiBom").agg(
        status.alias("QuoteStatus"), F.min(minutes).alias("__m"), F.min("QuoteItem").alias("QuoteItem"), F.count("*").alias("QuoteRows")
    )
    normalised = per_item.select(
        "SemiBom", F.when(F.col("QuoteStatus") == "SUPPLIED", F.col("__m")).alias("QuotedMinutesPerSemi"), "QuoteStatus", "QuoteItem", "QuoteRows",
        F.lit("MINUTES").alias("QuoteInputUnit"), F.lit("PER_SEMI_UNIT").alias("QuoteBasis"),
    )
    audit = rows.join(per_item.select("SemiBom", "QuoteStatus"), "SemiBom", "left").withColumn(
        "QuoteStatus", F.coalesce("QuoteStatus", F.lit("OUTSIDE_SEMI_SCOPE"))
    )
    return normalised, audit


def quotes_in_minutes_or_hours(quotes: DataFrame, scope: DataFrame, check: bool = True) -> DataFrame:
    """Quotes given as minutes or hours, never both; duplicates and unknown items are rejected."""
    for name in ("QuotedMinutes", "QuotedHours"):
        if name not in quotes.columns:
            quotes = quotes.withColumn(name, F.lit(None).cast("string"))
    rows = quotes.withColumns(
        {"SemiBom": clean_text("SemiBom"), "__m": to_double("QuotedMinutes"), "__h": to_double("QuotedHours")}
    ).filter("SemiBom IS NOT NULL")
    if check:
        assert_unique(rows, ["SemiBom"], "quoted SemiBom")
        assert_none(rows.join(scope.select("SemiBom"), "SemiBom", "left_anti"), "Quote source has unknown SemiBoms")
        assert_none(rows.filter("__m IS NOT NULL AND __h IS NOT NULL"), "Each SemiBom must supply minutes or hours, not both")
        assert_none(rows.filter("__m < 0 OR __h < 0"), "Quoted time cannot be negative")
        unread = (F.col("QuotedMinutes").isNotNull() & F.col("__m").isNull()) | (F.col("QuotedHours").isNotNull() & F.col("__h").isNull())
        assert_none(rows.filter(unread), "Quoted time contains non-numeric values")
    unit = F.when(F.col("__h").isNotNull(), "HOURS_CONVERTED_X60").when(F.col("__m").isNotNull(), "MINUTES").otherwise("")
    return rows.select(
        "SemiBom", F.coalesce("__m", F.col("__h") * 60).alias("QuotedMinutesPerSemi"), unit.alias("QuoteInputUnit"), F.lit("PER_SEMI_UNIT").alias("QuoteBasis")
    )


def detect_part_weight(source: DataFrame) -> float:
    """The single candidate weight that reproduces the supplied composite."""
    composite = F.col("Composite")
    gaps = source.agg(
        *[
            F.max(
                F.abs(
                    F.least(
                        F.lit(10.0),
                        w * F.col("PartScore") + (1 - w) * F.coalesce("AssemblyScore", F.lit(0.0)) + F.coalesce("MechanismBonus", F.lit(0.0)),
                    )
                    - composite
                )
            ).alias(f"w{i}")
            for i, w in enumerate(PART_WEIGHTS)
        ]
    ).first()
    fits = [w for i, w in enumerate(PART_WEIGHTS) if gaps[f"w{i}"] is not None and gaps[f"w{i}"] <= 1e-7]
    if len(fits) != 1:
        raise ValueError("Part and mechanism composite does not identify one component weight")
    return fits[0]


def part_mechanism(source: DataFrame, scope: DataFrame, check: bool = True) -> DataFrame:
    """Scores with scope and evidence status; duplicates and out-of-range values rejected."""
    require_columns(source, ["SemiBom", "PartScore", "AssemblyScore", "MechanismBonus", "Composite", "AssemblyType"], "Part and mechanism")
    rows = source.withColumn("SemiBom", clean_text("SemiBom"))
    if check:
        assert_none(rows.filter("SemiBom IS NULL"), "Part and mechanism source has blank keys")
        assert_unique(rows, ["SemiBom"], "part and mechanism")
        bad = or_true(~F.col("PartScore").between(0, 10)) | or_true(~F.col("Composite").between(0, 10)) | or_false(~F.col("AssemblyScore").between(0, 10)) | or_false(~F.col("MechanismBonus").between(0, 10))
        assert_none(rows.filter(bad), "Part and mechanism source has missing scores or scores outside 0-10")
    marked = rows.join(scope.select("SemiBom").distinct().withColumn("__in", F.lit(True)), "SemiBom", "left")
    incomplete = F.col("AssemblyType").isNull() | F.col("AssemblyScore").isNull()
    return marked.withColumns(
        {
            "SelectionStatus": F.when(F.col("__in"), "MATCHED_SEMI_BOM").otherwise("OUTSIDE_BOM_SCOPE"),
            "EvidenceStatus": F.when(incomplete, "INCOMPLETE_COMPONENT_DETAIL").otherwise("SOURCE_COMPONENTS_PRESENT"),
        }
    ).drop("__in")


def material_design(source: DataFrame, semis: DataFrame, check: bool = True) -> DataFrame:
    """Selection status of every material/design row; exactly one matching context is chosen."""
    scores = ["MaterialScore", "DesignScore", "ProcessScore", "Composite"]
    if check:
        bad = F.lit(False)
        for c in scores:
            bad = bad | or_true(~F.col(c).between(0, 10))
        assert_none(source.filter(bad), "Material/design rows have invalid 0-10 scores")
        expected = 0.4 * F.col("MaterialScore") + 0.4 * F.col("DesignScore") + 0.2 * F.col("ProcessScore")
        assert_none(source.filter(F.abs(expected - F.col("Composite")) > 1e-7), "Composite disagrees with 40/40/20 components")
    side = semis.select(
        "SemiBom", F.col("SemiItem").alias("__item"), F.col("Process").alias("__process"), F.col("ProductType").alias("__type"), F.lit(True).alias("__in")
    )
    rows = source.join(side, "SemiBom", "left")
    valid = or_false((F.col("SourceItem") == F.col("__item")) & (F.col("SourceProcess") == F.col("__process")))
    typed = valid & (product_type(F.col("SourceProductType")) == product_type(F.col("__type")))
    rows = rows.withColumns({"__valid": valid, "__typed": typed})
    counted = with_group_stats(
        rows, ["SemiBom"], F.count("*").alias("__rows"), F.count_if("__valid").alias("__nvalid"), F.count_if("__typed").alias("__ntyped")
    )
    status = (
        F.when(F.col("__in").isNull(), "OUTSIDE_BOM_SCOPE")
        .when(F.col("__nvalid") == 0, "ITEM_OR_PROCESS_MISMATCH")
        .when(F.col("__ntyped") == 0, "PRODUCT_TYPE_MISMATCH")
        .when(F.col("__ntyped") > 1, "CONFLICTING_MATCHED_CONTEXTS")
        .when(F.col("__typed"), F.when(F.col("__rows") > 1, "SELECTED_PRODUCT_TYPE").otherwise("SELECTED_UNIQUE"))
        .otherwise("NOT_SELECTED_CONTEXT")
    )
    return counted.withColumn("SelectionStatus", status).drop(
        "__item", "__process", "__type", "__in", "__valid", "__typed", "__rows", "__nvalid", "__ntyped"
    )


def unambiguous_items(semis: DataFrame) -> DataFrame:
    """Items that name exactly one SemiBom."""
    single = semis.groupBy("SemiItem").agg(F.count("*").alias("n")).filter("n = 1").select("SemiItem")
    return semis.join(single, "SemiItem", "left_semi")


def flag_worker_rounds(hours: DataFrame) -> DataFrame:
    """Row-level defects of labour hours per order, round and worker."""
    counted = with_group_stats(hours, ["WO", "RoundNo", "Worker"], F.count("*").alias("__copies"))
    final, origin, idle, r = F.col("Final"), F.col("Origin"), F.col("Idle"), F.col("RoundNo")
    numbers = is_finite(final) & is_finite(origin) & is_finite(idle)
    return counted.withColumns(
        {
            "DuplicateWorkerRound": F.col("__copies") > 1,
            "InvalidHours": ~numbers | or_false((final < 0) | (origin < 0) | (idle < 0)),
            "InvalidRound": or_true((r < 1) | (r % 1 != 0)),
            "BranchMismatch": or_false((r == 1) & or_true(F.col("Attempt") != "1st Attempt"))
            | or_false((r > 1) & or_true(F.col("Attempt") != "Repair WorkOrder")),
            "MissingWorker": clean_text("Worker").isNull(),
            "HoursIdentityError": or_false(F.abs(final - origin - idle) > 1e-7),
        }
    ).drop("__copies")


ROW_FLAGS = ["DuplicateWorkerRound", "InvalidHours", "InvalidRound", "BranchMismatch", "MissingWorker", "HoursIdentityError"]


def collapse_worker_rounds(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("WO", "RoundNo").agg(
        F.sum("Final").alias("AllocatedHours"), F.sum("Origin").alias("OriginHours"), F.sum("Idle").alias("IdleHours"),
        F.min("Worker").alias("Worker"), F.count_distinct("Worker").alias("WorkerCount"), *[F.bool_or(c).alias(c) for c in ROW_FLAGS],
    )


def time_cohort(hours: DataFrame, orders: DataFrame, semis: DataFrame) -> DataFrame:
    """Every round with the first applicable of fourteen exclusion codes, blank when usable.

    ``semis``: SemiItem, SemiBom, Process, MasterProcess, SizeAdjustedGroup, ReportStatus.
    """
    rounds = collapse_worker_rounds(flag_worker_rounds(hours))
    joined = rounds.join(orders.withColumn("__order", F.lit(True)), "WO", "left")
    counts = semis.groupBy("SemiItem").agg(F.count("*").alias("__semis"))
    joined = joined.join(counts.withColumnRenamed("SemiItem", "Item"), "Item", "left")
    joined = joined.join(unambiguous_items(semis).withColumnRenamed("SemiItem", "Item"), "Item", "left")
    mismatch = or_true(F.col("Process") != F.col("MasterProcess")) | F.col("MasterProcess").isNull()
    checks = [
        (F.lower(F.trim("WO")) == "other", "OTHER_WO"),
        (F.col("__order").isNull(), "UNMATCHED_WO"),
        (or_true(F.col("Status") != "Complete"), "INCOMPLETE_WO"),
        (F.col("MaxRafDate").isNull(), "MISSING_DATE"),
        (F.col("InvalidRound"), "INVALID_ROUND"),
        (F.col("DuplicateWorkerRound"), "DUPLICATE_WORKER_ROUND"),
        (F.col("InvalidHours") | F.col("HoursIdentityError"), "INVALID_ALLOCATED_HOURS"),
        (F.col("BranchMismatch"), "BRANCH_ROUND_MISMATCH"),
        (F.col("MissingWorker") | (F.col("WorkerCount") != 1), "TEAM_OR_MISSING_WORKER"),
        (or_false(F.col("__semis") > 1), "AMBIGUOUS_SEMI_BOM"),
        (F.col("SemiBom").isNull(), "NO_UNIQUE_SEMI"),
        (or_false(F.col("ReportStatus") == "EXCLUDED_SEMI_SCOPE"), "EXCLUDED_SEMI_SCOPE"),
        (mismatch, "PROCESS_MAPPING_MISMATCH"),
        (or_true(F.col("GoodPieces") <= 0) | or_true(F.col("AllocatedHours") <= 0), "NONPOSITIVE_RESPONSE"),
    ]
    out = joined.withColumn("Exclusion", first_reason(checks)).drop("__order", "__semis")
    branch = F.when(F.col("RoundNo") == 1, "First pass").otherwise("Rework")
    pb = F.concat_ws(" / ", "Process", branch)
    return out.withColumns(
        {
            "Branch": branch, "PB": pb, "GroupKey": F.concat_ws(" / ", pb, "SizeAdjustedGroup"), "WorkerKey": F.concat_ws(" / ", pb, "Worker"),
            "ActualMinutes": ratio(60 * F.col("AllocatedHours"), F.col("GoodPieces")),
        }
    )


def legacy_cohort(rows: DataFrame, semis: DataFrame, year: int = 2025) -> DataFrame:
    """Aggregate-hours rows of one calendar year with the first of nine exclusion codes."""
    # A half-open range on the raw column, so that the predicate reaches the scan.
    low, high = (F.lit(f"{y}-01-01").cast("timestamp_ntz") for y in (year, year + 1))
    source = rows.filter((F.col("RafMonth") >= low) & (F.col("RafMonth") < high))
    counts = semis.groupBy("SemiItem").agg(F.count("*").alias("__semis")).withColumnRenamed("SemiItem", "Item")
    side = unambiguous_items(semis).withColumnsRenamed({"SemiItem": "Item", "Process": "CurrentProcess"})
    joined = source.join(counts, "Item", "left").join(side, "Item", "left")
    checks = [
        (or_false(F.col("__semis") > 1), "AMBIGUOUS_SEMI_ITEM"),
        (F.col("SemiBom").isNull(), "NO_UNIQUE_BOM_SEMI"),
        (or_false(F.col("ReportStatus") == "EXCLUDED_SEMI_SCOPE"), "EXCLUDED_SEMI_SCOPE"),
        (clean_text("Worker").isNull(), "MISSING_WORKER"),
        (F.col("CurrentProcess").isNull() | F.col("Process").isNull(), "MISSING_PROCESS"),
        (F.col("Process") != F.col("CurrentProcess"), "PROCESS_CHANGED_OR_CONFLICTING"),
        (or_true(F.col("Qty") <= 0), "INVALID_QTY"),
        (or_true(F.col("Hours") <= 0), "INVALID_HOURS"),
        (or_true(F.col("QuotedMinutesPerSemi") <= 0), "NO_POSITIVE_QUOTE"),
    ]
    return joined.withColumns(
        {"Exclusion": first_reason(checks), "ActualMinutes": ratio(60 * F.col("Hours"), F.when(F.col("Qty") > 0, F.col("Qty")))}
    ).drop("__semis")


def difficulty_features(df: DataFrame, quality: bool = True) -> DataFrame:
    """Availability pattern, weighted coverage and coverage-normalised difficulty."""
    weights = {"PartScore": 0.25, "MaterialScore": 0.2, "StoneScore": 0.1} | ({"QualityScore": 0.4} if quality else {})
    present = {c: F.col(c).isNotNull() for c in weights}
    covered = sum((F.when(present[c], F.lit(w)).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    total = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    marks = ([("q", "QualityScore")] if quality else []) + [("m", "MaterialScore"), ("s", "StoneScore")]
    pattern = F.concat_ws("_", *[F.concat(F.lit(k), F.col(c).isNotNull().cast("int")) for k, c in marks])
    return df.withColumns(
        {"DifficultyCoverage": covered, "DifficultyScore": F.when(covered > 0, total / covered), "Pattern": pattern}
    )


def target_expansion(semis: DataFrame, modeled: DataFrame) -> DataFrame:
    """Every item with both branches; the reason when no time model covers it."""
    branches = F.explode(F.array(F.lit("First pass"), F.lit("Rework"))).alias("Branch")
    targets = semis.select("*", branches).withColumn("PB", F.concat_ws(" / ", "Process", "Branch"))
    known = modeled.select("PB").distinct().withColumn("__known", F.lit(True))
    mismatch = or_true(F.col("Process") != F.col("MasterProcess"))
    status = (
        F.when(or_false(F.col("ReportStatus") == "EXCLUDED_SEMI_SCOPE"), "EXCLUDED_SEMI_SCOPE")
        .when(mismatch, "PROCESS_MAPPING_MISMATCH")
        .when(F.col("__known").isNull(), "NO_PROCESS_BRANCH_MODEL")
        .otherwise("DIAGNOSTIC_ALLOCATED_TIME")
    )
    return targets.join(known, "PB", "left").withColumn("TimeModelStatus", status).drop("__known")
