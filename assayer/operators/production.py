"""Production facts: cleaning, enrichment, mapping, allocation and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.functions.expressions import clean_text, folded, is_finite, or_false, ratio, to_double
from assayer.operators.contracts import (
    assert_functional,
    assert_none,
    assert_unique,
    checked_join,
    require_columns,
    with_group_stats,
)

PRODUCTION_KEY = ["WO", "Worker", "Item", "RafMonth", "RoundNo"]
GROUP = "SizeAdjustedGroup"
# Item-code prefixes and the process they imply when no mapping exists.
PREFIX_PROCESS = {"2DC": "Bright Cut", "2DX": "Polishing", "2HA": "Soldering", "2SN": "Sanding", "2VD": "Stone Setting"}
# Item-code prefixes and suffixes outside the semi-finished scope, in rule order.
SCOPE_PREFIXES = ["2GC", "2XI", "2WA", "2DU", "2EP", "2GD", "2GH", "2VS", "2TD", "2XD", "2DG", "2ME", "3", "9"]
SCOPE_SUFFIXES = ["-01", "-02"]


def rename_aliases(df: DataFrame, aliases: list[tuple[str, str]]) -> DataFrame:
    """Rename source columns to canonical names, first alias wins, never overwriting."""
    for source, target in aliases:
        if source in df.columns and target not in df.columns:
            df = df.withColumnRenamed(source, target)
    return df


def mirror_worker_name(df: DataFrame) -> DataFrame:
    if "Worker" not in df.columns and "WorkerName" in df.columns:
        return df.withColumn("Worker", F.col("WorkerName"))
    if "Worker" in df.columns and "WorkerName" not in df.columns:
        return df.withColumn("WorkerName", F.col("Worker"))
    return df


def clean_production(df: DataFrame, incomplete_month: str | None = None) -> DataFrame:
    """Keep rows usable for time per piece and derive the time features."""
    require_columns(df, ["Worker", "Item", "Qty", "Hours", "RafMonth"], "Production")
    for optional in ("Customer", "ProductType"):
        if optional not in df.columns:
            df = df.withColumn(optional, F.lit(None).cast("string"))
    keep = (
        (folded("Customer") != "training")
        & (folded("ProductType") != "training")
        & (F.col("Qty") > 0)
        & (F.col("Hours") > 0)
        & F.col("Worker").isNotNull()
        & F.col("Item").isNotNull()
        & F.col("RafMonth").isNotNull()
    )
    if incomplete_month:
        keep &= F.date_format("RafMonth", "yyyy-MM") != incomplete_month
    typed = df.withColumns(
        {
            "Qty": to_double("Qty"),
            "Hours": to_double("Hours"),
            "Worker": clean_text("Worker"),
            "Item": clean_text("Item"),
        }
    )
    return with_defaults(with_time_features(typed.filter(keep)), ["Material", "ProductType", "Process"])


def with_time_features(df: DataFrame) -> DataFrame:
    per_piece = ratio(F.col("Hours"), F.col("Qty"))
    return (
        df.withColumn("TimePerPiece", per_piece)
        .filter(is_finite(F.col("TimePerPiece")) & (F.col("TimePerPiece") > 0))
        .withColumns({"LogTime": F.ln("TimePerPiece"), "MinutesPerOk": 60 * F.col("TimePerPiece")})
    )


def with_defaults(df: DataFrame, columns: list[str], default: str = "Unknown") -> DataFrame:
    """Missing attributes become a visible default rather than a null."""
    return df.withColumns(
        {c: F.coalesce(F.trim(c), F.lit(default)) if c in df.columns else F.lit(default) for c in columns}
    )


def clean_skills(df: DataFrame, check: bool = True) -> DataFrame:
    """Verified skills: typed, non-null, in [0, 10], one per worker and process."""
    require_columns(df, ["Worker", "Process", "Skill"], "Planner skill")
    out = df.withColumns(
        {"Worker": F.trim("Worker"), "Process": F.trim("Process"), "Skill": to_double("Skill")}
    ).dropna(subset=["Worker", "Process", "Skill"])
    if check:
        assert_none(out.filter(~F.col("Skill").between(0, 10)), "Planner skill must be in [0, 10]")
        assert_unique(out, ["Worker", "Process"], "planner skill")
    return out


def order_status_audit(orders: DataFrame) -> DataFrame:
    """Label each order as eligible or excluded; anything but complete is excluded."""
    complete = or_false(folded("Status") == "complete")
    return orders.select(
        F.trim("WO").alias("WO"),
        F.trim("Status").alias("Status"),
        F.when(complete, "ELIGIBLE_COMPLETE").otherwise("EXCLUDED_NOT_COMPLETE").alias("AnalysisStatus"),
    )


def exclude_orders(df: DataFrame, audit: DataFrame) -> DataFrame:
    excluded = audit.filter("AnalysisStatus = 'EXCLUDED_NOT_COMPLETE'").select("WO").distinct()
    return df.join(excluded, "WO", "left_anti")


def inferred_cutoff(production: DataFrame, tickets: DataFrame) -> DataFrame:
    """Latest timestamp seen in production or inspection data, as a one-row table."""
    moments = production.agg(F.max("RafMonth").alias("t")).unionByName(
        tickets.agg(F.max(F.greatest("QcStart", "QcStop")).alias("t"))
    )
    return moments.agg(F.max("t").alias("Cutoff"))


def as_of(df: DataFrame, cutoff: str, column: str = "RafMonth") -> DataFrame:
    return df.filter(F.col(column) <= F.lit(cutoff).cast("timestamp_ntz"))


def valid_round(column: str = "RoundNo") -> Column:
    """Round number when it is a positive whole number, else null."""
    value = to_double(column)
    return F.when((value >= 1) & (value % 1 == 0), value).cast("bigint")


def item_mapping(raw: DataFrame, check: bool = True) -> DataFrame:
    """One process and one size group per item, with fallback and size-review flags."""
    require_columns(raw, ["Item", "Process"], "Item mapping")
    group = clean_text(GROUP) if GROUP in raw.columns else F.lit(None).cast("string")
    items = raw.select(clean_text("Item").alias("Item"), clean_text("Process").alias("Process"), group.alias(GROUP))
    items = items.filter("Item IS NOT NULL")
    if check:
        for value in ("Process", GROUP):
            assert_functional(items, ["Item"], value, f"Item maps to multiple {value} values")
    one = items.groupBy("Item").agg(F.max("Process").alias("Process"), F.max(GROUP).alias(GROUP))
    one = one.withColumns({"MappingFallback": F.col(GROUP).isNull(), GROUP: F.coalesce(GROUP, "Item")})
    if check:
        assert_functional(one, [GROUP], "Process", "Size group maps to multiple processes")
    sizes = one.groupBy(GROUP, "Process").agg(F.count("Item").alias("GroupItemCount"))
    return one.join(
        sizes.withColumnsRenamed({GROUP: "__g", "Process": "__p"}),
        F.col(GROUP).eqNullSafe(F.col("__g")) & F.col("Process").eqNullSafe(F.col("__p")),
    ).drop("__g", "__p").withColumn(
        "SizeEffectFlag",
        F.when(F.col("GroupItemCount") > 5, "Pending Engineering Review (>5 Items)").otherwise(
            "Pending Size Residual Validation"
        ),
    )


def attach_mapping(df: DataFrame, mapping: DataFrame, check: bool = True) -> DataFrame:
    """Attach process and group by exact item; a supplied process must agree."""
    require_columns(df, ["Item"], "Input")
    fields = [c for c in mapping.columns if c != "Item"]
    facts = df.withColumn("Item", F.trim("Item")).drop(*[c for c in fields if c != "Process"])
    supplied = F.trim("Process") if "Process" in df.columns else F.lit(None).cast("string")
    facts = facts.withColumn("__supplied", supplied).drop("Process")
    joined = (checked_join if check else DataFrame.join)(facts, mapping, ["Item"], "left")
    if check:
        known = F.col("__supplied").isNotNull() & (F.col("__supplied") != "Unknown")
        assert_none(
            joined.filter(known & (F.col("__supplied") != F.col("Process"))),
            "Input process conflicts with the exact item mapping",
        )
    return joined.withColumns(
        {"Process": F.coalesce("Process", "__supplied"), GROUP: F.coalesce(GROUP, "Item")}
    ).drop("__supplied")


def mapping_by_precedence(mapping: DataFrame, master: DataFrame) -> DataFrame:
    """Item master rows replace mapping rows for the same item."""
    fields = ["Item", "Process", GROUP]
    replaced = mapping.select(*fields).join(master.select("Item").distinct(), "Item", "left_anti")
    return replaced.unionByName(master.select(*fields).dropDuplicates(["Item"]))


def enrich_from_master(df: DataFrame, master: DataFrame, key: str, fields: list[str], check: bool = True) -> DataFrame:
    """Existing values win; the master fills nulls. Conflicting master rows are rejected."""
    side = master.select(key, *fields).withColumn(key, F.trim(key)).distinct()
    if check:
        assert_none(side.filter(clean_text(key).isNull()), f"Master has missing {key} keys")
        assert_unique(side, [key], f"{key} master")
    side = side.withColumnsRenamed({f: f"__{f}" for f in fields})
    joined = df.join(side, key, "left")
    filled = {f: F.coalesce(F.col(f), F.col(f"__{f}")) if f in df.columns else F.col(f"__{f}") for f in fields}
    return joined.withColumns(filled).drop(*[f"__{f}" for f in fields])


def process_from_prefix(item: Column, department: Column) -> Column:
    """Fallback process from the item code; one prefix is split by department."""
    prefix = F.upper(F.substring(item, 1, 3))
    chain = F.when(
        prefix == "2DB", F.when(or_false(F.upper(department).contains("SAN")), "Sanding").otherwise("Polishing")
    )
    for code, process in PREFIX_PROCESS.items():
        chain = chain.when(prefix == code, process)
    return chain


def fill_process(df: DataFrame, enabled: bool = True) -> DataFrame:
    if not enabled:
        return df
    department = F.col("Department") if "Department" in df.columns else F.lit(None).cast("string")
    return df.withColumn("Process", F.coalesce("Process", process_from_prefix(F.col("Item"), department)))


def scope_excluded(item: Column, bom: Column | None = None) -> Column:
    """Codes outside semi-finished scoring, by prefix or version suffix."""
    code = F.upper(F.trim(item))
    hit = code.rlike("^(" + "|".join(SCOPE_PREFIXES) + ")") | code.rlike("(" + "|".join(SCOPE_SUFFIXES) + ")$")
    if bom is not None:
        hit = or_false(hit) | or_false(F.upper(F.trim(bom)).rlike("(" + "|".join(SCOPE_SUFFIXES) + ")$"))
    return or_false(hit)


def scope_rule(item: Column, bom: Column | None = None) -> Column:
    """Name of the exclusion rule; a suffix rule overrides a prefix rule."""
    code = F.upper(F.trim(item))
    other = F.upper(F.trim(bom)) if bom is not None else code
    chain = None
    for suffix in reversed(SCOPE_SUFFIXES):
        hit = or_false(code.endswith(suffix)) | or_false(other.endswith(suffix))
        chain = (F.when if chain is None else chain.when)(hit, F.lit(f"BOM_SUFFIX_{suffix}"))
    for prefix in SCOPE_PREFIXES:
        chain = chain.when(or_false(code.startswith(prefix)), F.lit(f"PREFIX_{prefix}"))
    return chain.otherwise(F.lit(""))


def trajectory_key(reference: Column, row_id: Column) -> tuple[Column, Column]:
    """(key, eligible): placeholder references are kept but never act as an order identity."""
    ref = clean_text(reference)
    real = ref.isNotNull() & ~F.upper(ref).startswith("DUMMY")
    return F.when(real, ref).otherwise(F.concat(F.lit("unlinked-row:"), row_id.cast("string"))), real


def flag_quarantine(df: DataFrame) -> DataFrame:
    """Reason column: every copy of a duplicated key, or a row without an exact process."""
    counted = with_group_stats(df, PRODUCTION_KEY, F.count("*").alias("__copies"))
    unmapped = F.col("Process").isNull() | F.col("Process").isin("", "Unknown")
    reason = F.when(F.col("__copies") > 1, "Duplicate production key").when(unmapped, "Exact Item Process unavailable")
    return counted.withColumn("Reason", reason).drop("__copies")


def data_quality_counts(raw: DataFrame, cleaned: DataFrame, flagged: DataFrame, audit: DataFrame) -> DataFrame:
    """Long table of checks, one conditional aggregation per input."""
    unmapped = F.col("Process").isNull() | F.col("Process").isin("", "Unknown")
    parts = [
        raw.agg(F.count("*").alias("N")).withColumn("Check", F.lit("Production input rows")),
        audit.agg(F.count_if(F.col("AnalysisStatus") == "EXCLUDED_NOT_COMPLETE").alias("N")).withColumn(
            "Check", F.lit("Work orders excluded: not complete")
        ),
        cleaned.agg(F.count("*").alias("N")).withColumn("Check", F.lit("Production retained after basic filters")),
        flagged.agg(
            F.count_if(F.col("Reason") == "Duplicate production key").alias("Duplicate production rows quarantined"),
            F.count_if(unmapped).alias("Unmapped production rows quarantined"),
        ).unpivot([], ["Duplicate production rows quarantined", "Unmapped production rows quarantined"], "Check", "N"),
    ]
    out = parts[0].select("Check", "N")
    for part in parts[1:]:
        out = out.unionByName(part.select("Check", "N"))
    return out


def drop_other(df: DataFrame, key: str = "WO") -> DataFrame:
    return df.filter(F.col(key).isNotNull() & (F.upper(F.trim(key)) != "OTHER"))


def worker_round_hours(hours: DataFrame) -> DataFrame:
    """Hours per order, round and worker with the round's total hours and worker count."""
    rows = drop_other(hours).filter("Worker IS NOT NULL")
    per_worker = rows.groupBy("WO", "RoundNo", "Worker").agg(
        F.sum(F.coalesce("Final", F.lit(0.0))).alias("WorkerHours")
    )
    rounds = per_worker.groupBy("WO", "RoundNo").agg(
        F.sum("WorkerHours").alias("TotalRoundHours"), F.count("Worker").alias("RoundWorkerCount")
    )
    return per_worker.join(rounds, ["WO", "RoundNo"])


def allocate_quantity(worker_rounds: DataFrame, orders: DataFrame, by_hours: bool = False, check: bool = True) -> DataFrame:
    """Estimated pieces per worker: equal share of the order's good pieces, or by hours."""
    if check:
        assert_unique(orders, ["WO"], "work order")
    good = F.coalesce("GoodPieces", F.lit(0.0))
    if by_hours:
        share = F.when(F.col("TotalRoundHours") > 0, F.col("WorkerHours") / F.col("TotalRoundHours") * good)
        source = "Legacy hour allocation from good pieces (estimated)"
    else:
        share = F.when(F.col("RoundWorkerCount") > 0, good / F.col("RoundWorkerCount"))
        source = "Equal round allocation from good pieces (estimated)"
    marked = orders.withColumn("__matched", F.lit(True))
    return (
        worker_rounds.join(marked, "WO", "left")
        .withColumns(
            {
                "Qty": F.coalesce(share, F.lit(0.0)),
                "QtySource": F.lit(source),
                "OrderJoinStatus": F.when(F.col("__matched"), "both").otherwise("left_only"),
            }
        )
        .drop("__matched")
    )


def unmatched_rows(joined: DataFrame) -> DataFrame:
    return joined.filter("OrderJoinStatus <> 'both'")


def attach_skill(df: DataFrame, skills: DataFrame) -> DataFrame:
    side = skills.select("Worker", "Process", F.col("Skill").alias("CertifiedSkill"))
    return df.join(side, ["Worker", "Process"], "left")


def worker_report(effects: DataFrame, skills: DataFrame) -> DataFrame:
    """Keep every fitted worker and every official skill row."""
    return effects.join(skills.select("Worker", "Process", "Skill"), ["Worker", "Process"], "full_outer")


def stamp(df: DataFrame, version: str, cutoff: str, status: str = "Diagnostic Only") -> DataFrame:
    """Provenance columns; evidence comes from the first count column present."""
    out = df.withColumns(
        {"ModelVersion": F.lit(version), "SourceCutoff": F.lit(cutoff), "ApprovalStatus": F.lit(status)}
    )
    if "EvidenceN" not in df.columns:
        counts = [F.col(c) for c in ("QCEvidenceN", "WOs", "GroupEvidenceN", "WorkerRecords") if c in df.columns]
        out = out.withColumn("EvidenceN", counts[0] if counts else F.lit(None).cast("bigint"))
    defaults = {
        "ConfidenceInterval": F.lit("Unavailable / not validated"),
        "DataQualityStatus": F.lit("See data quality and gate tables"),
    }
    flag = F.col("ExtrapolationFlag").cast("string") if "ExtrapolationFlag" in df.columns else F.lit("Not assessed")
    defaults["Extrapolation"] = flag
    return out.withColumns({k: v for k, v in defaults.items() if k not in df.columns})


def missing_master_audit(semis: DataFrame, master: DataFrame, hints: DataFrame) -> DataFrame:
    """Semi-finished items absent from the master, with a suggested process and action."""
    absent = semis.join(master.select(F.col("Item").alias("SemiItem")).distinct(), "SemiItem", "left_anti")
    ignored = scope_excluded(F.col("SemiItem"), F.col("SemiBom"))
    suggestion = hints.select("SemiBom", F.col("Process").alias("ProcessReference")).dropDuplicates(["SemiBom"])
    return absent.join(suggestion, "SemiBom", "left").withColumns(
        {
            "Ignored": ignored,
            "RequiredAction": F.when(ignored, "No Item Master addition requested for this excluded code").otherwise(
                "Add SemiItem to Item Master and confirm Process"
            ),
        }
    )


def primary_row(df: DataFrame, keys: list[str], by: str, tie: str) -> DataFrame:
    """Keep the row with the largest value per key, ties by the smallest identifier.

    A grouped max_by keeps a hot key combinable on the map side, unlike a row-number window.
    """
    payload = [c for c in df.columns if c not in keys]
    largest = df.groupBy(*keys).agg(F.max(by).alias("__top"))
    at_top = df.join(largest, keys).filter(F.col(by).eqNullSafe(F.col("__top"))).drop("__top")
    best = at_top.groupBy(*keys).agg(F.min_by(F.struct(*payload), F.col(tie)).alias("__row"))
    return best.select(*keys, "__row.*")
