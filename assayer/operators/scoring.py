"""Gated difficulty scores, provenance, combinations and acceptance decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.expressions import clean_text, folded, is_close, is_finite, joined_reasons, or_false, or_true, to_double
from assayer.operators.contracts import assert_none, require_columns
from assayer.operators.metrics import correlation
from assayer.operators.ordering import average_rank
from assayer.operators.production import GROUP, scope_excluded, scope_rule

# Factor names and weights.
FACTOR_WEIGHTS = {"Quality": 0.40, "PartMechanism": 0.25, "MaterialDesignProcess": 0.20, "Stone": 0.10, "Learning": 0.05}
EXCLUDED = "EXCLUDED_SEMI_SCOPE"
# Acceptance thresholds.
POLICY = {
    "min_test_wos": 30, "calibration_gap_max": 0.02, "ece_max": 0.03, "planner_coverage_min": 0.8, "rank_correlation_lower_min": 0.7,
    "network_adequate_fraction_min": 0.9, "min_group_wos": 10, "min_segment_wos": 20, "retrospective_loss_tolerance": 0.01,
}


def _weight_of(factor: Column) -> Column:
    chain = None
    for name, weight in FACTOR_WEIGHTS.items():
        chain = (F.when if chain is None else chain.when)(factor == name, F.lit(weight))
    return chain


def technical_complexity(factors: DataFrame) -> DataFrame:
    """Approved five-factor score per item and process, blank with reasons when any gate fails."""
    required = ["Item", "Process", "Factor", "Score", "Evidence", "Scorer", "Approver", "Version", "Approved", "DataQualityStatus"]
    require_columns(factors, required, "Engineering factors")
    for name in ("Method", "ConfidencePct", "ConfidenceStatus"):
        if name not in factors.columns:
            factors = factors.withColumn(name, F.lit(None).cast("string"))
    score, confidence = to_double("Score"), to_double("ConfidencePct")
    modeled = or_false((F.col("Factor") == "Quality") | (F.upper(F.trim("Method")) == "MODEL_ESTIMATE"))
    trusted = or_false(confidence.between(0, 1) & (F.upper(F.trim("ConfidenceStatus")) == "ESTIMATED_VALIDATED"))
    weight = _weight_of(F.col("Factor"))
    # A bit for each known factor: five rows that set all bits are the five factors once each, without a distinct count.
    bit = F.coalesce(*[F.when(F.col("Factor") == name, 1 << k) for k, name in enumerate(FACTOR_WEIGHTS)])
    every = (1 << len(FACTOR_WEIGHTS)) - 1
    facts = factors.groupBy("Item", "Process").agg(
        ((F.count("*") == len(FACTOR_WEIGHTS)) & (F.coalesce(F.bit_or(bit), F.lit(0)) == every)).alias("whole"),
        F.bool_and(or_false(score.between(0, 10))).alias("scored"),
        *[F.bool_and(clean_text(c).isNotNull()).alias(f"has{c}") for c in ("Evidence", "Scorer", "Approver", "Version")],
        F.bool_and(folded("Approved") == "true").alias("approved"),
        F.bool_and(or_false(F.col("DataQualityStatus") == "Valid")).alias("clean"),
        F.bool_and(~modeled | trusted).alias("trusted"),
        F.sum(score * weight).alias("total"),
    )
    reasons = [
        (~F.col("whole"), "Missing or duplicate factors"),
        (~F.col("scored"), "Missing or invalid factor score"),
        *[(~F.col(f"has{c}"), f"Missing {c}") for c in ("Evidence", "Scorer", "Approver", "Version")],
        (~F.col("approved"), "Pending factor approval"),
        (~F.col("clean"), "Data quality exception"),
        (~F.col("trusted"), "Model confidence missing or unvalidated"),
    ]
    gate = joined_reasons(reasons, "All five factors approved")
    return facts.select(
        "Item", "Process", F.when(gate == "All five factors approved", F.col("total")).alias("FinalTechnicalComplexity"), gate.alias("FactorGate")
    )


def quality_difficulty(fpy: Column, recovery: Column, usable: bool = False, calibrated: bool = False) -> Column:
    """0.8/0.2 blend, only once recovery is usable and its weighting calibrated."""
    allowed = F.lit(usable and calibrated) & is_finite(fpy) & is_finite(recovery)
    return F.when(allowed, 0.8 * fpy + 0.2 * recovery)


def branch_status(converged: Column) -> dict[str, Column]:
    fit = F.when(converged, "CONVERGED").when(~converged, "NONCONVERGED").otherwise("INSUFFICIENT_EVIDENCE")
    return {"FitStatus": fit, "CalibrationStatus": F.lit("NOT_VALIDATED"), "DecisionEligibility": F.lit("BLOCKED")}


SKU_SOURCES = {
    "Quality": "QualityDiagnostic", "PartMechanism": "PartMechanismSource", "MaterialDesignProcess": "MaterialDesignSource",
    "Stone": "StoneSource", "Learning": "LearningSource",
}


def sku_scores(df: DataFrame, check: bool = True) -> DataFrame:
    """Score from the factors available, weights renormalised, with coverage and confidence.

    Columns per factor f: ``f_Approved`` and its source estimate; confidences for the quality
    and learning models. Excluded items get no score.
    """
    factor = {f: F.coalesce(F.col(f"{f}_Approved"), F.col(src)) for f, src in SKU_SOURCES.items()}
    staged = df.withColumns(factor)
    total = sum((F.coalesce(F.col(f) * w, F.lit(0.0)) for f, w in FACTOR_WEIGHTS.items()), F.lit(0.0))
    covered = sum((F.when(F.col(f).isNotNull(), F.lit(w)).otherwise(0.0) for f, w in FACTOR_WEIGHTS.items()), F.lit(0.0))
    if check:
        outside = F.lit(False)
        for f in FACTOR_WEIGHTS:
            outside = outside | or_false(~F.col(f).between(0, 10))
        assert_none(staged.filter(outside), "Semi factor score outside 0-10")
        approved = sum((F.col(f"{f}_Approved") * w for f, w in FACTOR_WEIGHTS.items()), F.lit(0.0))
        published = F.col("FinalTechnicalComplexity")
        assert_none(
            staged.filter(published.isNotNull() & or_true(F.abs(published - approved) > 1e-7)),
            "Published score does not reconcile to five approved factors",
        )
    out = F.col("DifficultyStatus") == EXCLUDED
    live = ~or_false(out)
    quality_ok = F.when(
        F.col("Quality_Approved").isNotNull(), F.col("QualityConfidenceStatus") == "ESTIMATED_VALIDATED"
    ).otherwise(F.col("RaschConfidenceStatus").isin("CONDITIONAL_DIAGNOSTIC", "ESTIMATED_VALIDATED"))
    quality_conf = F.when(F.col("Quality_Approved").isNotNull(), F.col("QualityConfidencePct")).otherwise(F.col("RaschConfidencePct"))
    quality_conf = F.when(F.col("Quality").isNotNull() & or_false(quality_ok & quality_conf.between(0, 1)), quality_conf)
    modeled_learning = F.col("Learning_Approved").isNull() & F.col("Learning").isNotNull()
    learning_ok = F.col("LearningConfidenceStatus").isin("CONDITIONAL_DIAGNOSTIC", "ESTIMATED_VALIDATED") & F.col("LearningConfidencePct").between(0, 1)
    learning_conf = F.when(modeled_learning & or_false(learning_ok), F.col("LearningConfidencePct"))
    untrusted = (F.col("Quality").isNotNull() & quality_conf.isNull()) | (modeled_learning & learning_conf.isNull())
    overall = F.when(~untrusted, covered * F.coalesce(F.least(quality_conf, learning_conf), F.lit(1.0)))
    shown = {f: F.when(live, F.col(f)) for f in FACTOR_WEIGHTS}
    scored = staged.withColumns(
        {
            "Contribution": F.when(live & (covered > 0), total),
            "Coverage": F.when(live, covered).otherwise(0.0),
            "Score10": F.when(live & (covered > 0), total / covered),
            "QualityConfidence": F.when(live, quality_conf),
            "LearningConfidence": F.when(live, learning_conf),
            "OverallConfidence": F.when(live, overall),
            "ScopeStatus": F.when(live, F.lit("IN_SCOPE")).otherwise(EXCLUDED),
            "YieldSummary": F.when(live, yield_summary_text()).otherwise("Excluded from Semi scoring by code rule"),
        }
    )
    return scored.withColumns(shown)


def yield_summary_text() -> Column:
    """One line of first-pass evidence for a report."""
    observed = F.concat(F.format_number(F.col("ObservedFPY") * 100, 1), F.lit("% observed"))
    pieces = F.when(
        F.col("PassQty1").isNotNull() & F.col("InspectedQty1").isNotNull(),
        F.concat(F.lit(" ("), F.col("PassQty1").cast("bigint"), F.lit("/"), F.col("InspectedQty1").cast("bigint"), F.lit(" pieces)")),
    ).otherwise("")
    orders = F.when(F.col("QCEvidenceN").isNotNull(), F.concat(F.lit("; "), F.col("QCEvidenceN"), F.lit(" QC WOs"))).otherwise("")
    fit = F.when(F.col("FitConverged"), "; FIT_CONVERGED").when(~F.col("FitConverged"), "; FIT_NONCONVERGED").otherwise("; FIT_NOT_AVAILABLE")
    calibration = F.coalesce("CalibrationStatus", F.lit("NOT_VALIDATED"))
    note = F.when(
        (calibration == "NOT_VALIDATED") & F.col("Quality").isNotNull(), "; MODEL_SCORE_INCLUDED_IN_TOTAL; VALIDATION_PENDING"
    ).otherwise(F.concat(F.lit("; "), calibration))
    return F.when(F.col("ObservedFPY").isNotNull(), F.concat(observed, pieces, orders, fit, note)).otherwise("No eligible first-pass QC")


def factor_provenance(df: DataFrame) -> DataFrame:
    """One row per item and factor: weight, score, how it was obtained, confidence."""
    missing = {"Learning": "INSUFFICIENT_REPEATED_HISTORY"}
    estimated = {"Learning": "OBSERVED_RAMP_UP_MODEL_PROVISIONAL"}
    entries = []
    for f, weight in FACTOR_WEIGHTS.items():
        source, approved = F.col(SKU_SOURCES[f]), F.col(f"{f}_Approved")
        if f == "Quality":
            score = source
            method = F.when(source.isNotNull(), F.coalesce("QualityModelSource", F.lit("QC_RASCH_MODEL"))).otherwise("NOT_ESTIMATED")
            usable = source.isNotNull() & F.col("RaschConfidenceStatus").isin("CONDITIONAL_DIAGNOSTIC", "ESTIMATED_VALIDATED")
            confidence, status = F.when(usable, F.col("RaschConfidencePct")), F.col("RaschConfidenceStatus")
        else:
            score = F.coalesce(approved, source)
            method = (
                F.when(approved.isNotNull(), "APPROVED_ENGINEERING_INPUT")
                .when(source.isNotNull(), estimated.get(f, "SOURCE_RULE_CALCULATION_PROVISIONAL"))
                .otherwise(missing.get(f, "MISSING_SOURCE"))
            )
            confidence = F.col("LearningConfidencePct") if f == "Learning" else F.lit(None).cast("double")
            present = F.col("LearningConfidenceStatus") if f == "Learning" else F.lit("NOT_APPLICABLE_FIXED_INPUT")
            status = F.when(score.isNotNull(), present).otherwise("NOT_ESTIMATED")
        out = or_false(F.col("DifficultyStatus") == EXCLUDED)
        entries.append(
            F.struct(
                F.lit(f).alias("Factor"), F.lit(weight).alias("Weight"), F.when(~out, score).alias("Score10"),
                F.when(out, EXCLUDED).otherwise(method).alias("Method"), F.when(~out, confidence).alias("ConfidencePct"),
                F.when(out, EXCLUDED).otherwise(status).alias("ConfidenceStatus"),
            )
        )
    return df.select("SemiBom", "Process", F.inline(F.array(*entries)))


def combine_quality(branches: DataFrame, availability: DataFrame) -> DataFrame:
    """80/20 of first pass and rework, or first pass alone when no usable rework data exists.

    ``branches`` holds the selected estimate per process, group and branch.
    """
    key = ["Process", GROUP]
    fields = ["Difficulty10", "Lower95", "Upper95", "Lower975", "Upper975", "WOs", "EstimateEligible", "ValidationStatus"]
    chosen = branches.filter("SelectedOnValidation")
    wide = chosen.groupBy(*key).agg(
        *[F.max(F.when(F.col("Branch") == b, F.col(c))).alias(f"{p}_{c}") for b, p in (("FIRST_PASS", "F"), ("REWORK", "R")) for c in fields]
    )
    rework = availability.filter("Branch = 'REWORK'").groupBy(*key).agg(F.max("WOs").alias("__n"))
    wide = branches.select(*key).distinct().join(wide, key, "left").join(rework, key, "left")
    has_rework = F.coalesce("__n", F.lit(0)) > 0
    fw, rw = F.when(has_rework, 0.8).otherwise(1.0), F.when(has_rework, 0.2).otherwise(0.0)
    valid = or_false(F.col("F_EstimateEligible")) & (~has_rework | or_false(F.col("R_EstimateEligible")))
    passed = "PASSED_STATISTICAL_GATES"
    approved = or_false(F.col("F_ValidationStatus") == passed) & (~has_rework | or_false(F.col("R_ValidationStatus") == passed))

    def blend(a: str, b: str, single: str | None = None) -> Column:
        return F.when(has_rework, fw * F.col(f"F_{a}") + rw * F.col(f"R_{b}")).otherwise(F.col(f"F_{single or a}"))

    diagnostic = F.when(valid, blend("Difficulty10", "Difficulty10"))
    return wide.select(
        *key, fw.alias("FirstPassWeight"), rw.alias("ReworkWeight"),
        F.when(has_rework, "REWORK_DATA_AVAILABLE").otherwise("NO_USABLE_REWORK_DATA").alias("ReworkDataStatus"),
        diagnostic.alias("DiagnosticQuality"), F.when(valid & approved, diagnostic).alias("Quality"),
        # Each branch contributes its 97.5 % bounds, so the weighted ends cover at least 95 %.
        F.when(valid, blend("Lower975", "Lower975", "Lower95")).alias("QualityLower95"),
        F.when(valid, blend("Upper975", "Upper975", "Upper95")).alias("QualityUpper95"),
        F.when(valid & approved, passed).when(valid, "DIAGNOSTIC_ONLY").otherwise("MISSING_OR_INELIGIBLE_REQUIRED_BRANCH").alias("QualityStatus"),
    )


def blend_models(primary: DataFrame, older: DataFrame) -> DataFrame:
    """80 % anchored estimate and 20 % older effect, falling back to the older effect alone."""
    joined = primary.join(older.select("Process", GROUP, "OldFirstPass", "OldRework"), ["Process", GROUP], "left")
    old = F.when(F.col("ReworkWeight") == 0, F.col("OldFirstPass")).otherwise(
        F.col("FirstPassWeight") * F.col("OldFirstPass") + F.col("ReworkWeight") * F.col("OldRework")
    )
    anchored, excluded = F.col("PlannerQuality").isNotNull(), or_false(F.col("UseStatus") == EXCLUDED)
    quality = F.when(anchored, 0.8 * F.col("PlannerQuality") + 0.2 * old).otherwise(old)
    status = (
        F.when(excluded, EXCLUDED)
        .when(quality.isNull(), "UNAVAILABLE_REQUIRED_ESTIMATE")
        .when(anchored, "80_PERCENT_PLANNER_20_PERCENT_RASCH_PROVISIONAL")
        .otherwise("100_PERCENT_RASCH_FALLBACK")
    )
    bounds = {
        f"Quality{side}95Conditional": F.when(anchored, 0.8 * F.col(f"PlannerQuality{side}95") + 0.2 * old) for side in ("Lower", "Upper")
    }
    return joined.withColumns(
        {"OldQuality": F.when(~excluded, old), "Quality": F.when(~excluded, quality), "BlendStatus": status, **bounds}
    )


def overlay_blend(semis: DataFrame, blend: DataFrame) -> DataFrame:
    """Blended quality replaces the diagnostic one where present, with its source named."""
    side = blend.select("Process", GROUP, F.col("Quality").alias("__q"), F.col("BlendStatus").alias("__s"))
    joined = semis.join(side, ["Process", GROUP], "left")
    return joined.withColumns(
        {
            "QualityModelSource": F.when(F.col("__q").isNotNull(), F.format_string("PLANNER_RASCH_BLEND (%s)", "__s")).otherwise(
                F.col("QualityModelSource")
            ),
            "QualityDiagnostic": F.coalesce("__q", "QualityDiagnostic"),
        }
    ).drop("__q", "__s")


def acceptance(metrics: DataFrame) -> DataFrame:
    """Ten statistical gates per process and branch; all must pass to replace the baseline."""
    gates = {
        "Convergence": F.col("Converged"),
        "CommonHoldout": F.col("TestWOs") >= POLICY["min_test_wos"],
        "Improvement": F.col("ComparisonUpper95") < 0,
        "Calibration": (F.col("CalibrationGap") <= POLICY["calibration_gap_max"]) & (F.col("ECE") <= POLICY["ece_max"]),
        "Segments": F.col("WorstSegmentUpper95") <= POLICY["retrospective_loss_tolerance"],
        "RankStability": F.col("RankCorrelationLower95") >= POLICY["rank_correlation_lower_min"],
        "PlannerCoverage": F.col("SkillCoverage") >= POLICY["planner_coverage_min"],
        "Network": F.col("NetworkAdequateFraction") >= POLICY["network_adequate_fraction_min"],
        "RetrospectiveSensitivity": F.col("RetrospectiveOk"),
        "BeforeAfterEvidence": F.least("PreWOs", "PostWOs") >= POLICY["min_test_wos"],
    }
    decided = metrics.withColumns({name: or_false(cond) for name, cond in gates.items()})
    reason = F.concat_ws("; ", *[F.when(~F.col(name), F.lit(name)) for name in gates])
    return decided.withColumns(
        {"Reason": reason, "Decision": F.when(reason == "", "ELIGIBLE_FOR_REPLACEMENT").otherwise("KEEP_RASCH")}
    )


def simplest_unless_better(best: Column, simplest: Column, upper: Column) -> Column:
    """Fall back to the simplest candidate when the interval does not exclude equality."""
    return F.when((best != simplest) & or_true(upper >= 0), simplest).otherwise(best)


def coverage_status(train: DataFrame, keys: list[str], minimum: float = 0.6) -> DataFrame:
    """Candidate standing from the training share with a known skill."""
    share = F.avg(F.col("CertifiedSkill").isNotNull().cast("double"))
    return train.groupBy(*keys).agg(
        share.alias("SkillCoverage"),
        F.when(share < minimum, "Exploratory: skill coverage below 60%").otherwise("Candidate: validation required").alias("CandidateStatus"),
    )


def retrospective_gate(full: DataFrame, later: DataFrame, loss: DataFrame) -> DataFrame:
    """Rank agreement of two effect tables over shared groups, and the paired loss bound."""
    keys = ["Process", "Branch"]
    both = full.select(*keys, GROUP, F.col("Difficulty").alias("a")).join(later.select(*keys, GROUP, F.col("Difficulty").alias("b")), [*keys, GROUP])
    ranks = average_rank(average_rank(both, keys, "a", "ra"), keys, "b", "rb")
    corr = ranks.groupBy(*keys).agg(F.count("*").alias("CommonGroups"), F.when(F.count("*") >= 3, correlation("ra", "rb")).alias("RankCorrelation"))
    joined = corr.join(loss.select(*keys, "Upper95"), keys, "left")
    fine = (F.col("RankCorrelation") >= POLICY["rank_correlation_lower_min"]) & (F.col("Upper95") <= POLICY["retrospective_loss_tolerance"])
    return joined.withColumn("Status", F.when(or_false(fine), "PASS").otherwise("FAIL_OR_UNCERTAIN"))


def item_report(features: DataFrame, detail: DataFrame, model: DataFrame, usable: str) -> DataFrame:
    """One row per item: model evidence only where the process agrees, scope rule, approval gate."""
    borrowed = [c for c in model.columns if c not in ("Item", "Process")]
    side = model.select(F.col("Item").alias("SemiItem"), F.col("Process").alias("ModelProcess"), *borrowed, F.lit(True).alias("__has"))
    report = features.join(detail, "SemiBom", "left").join(side, "SemiItem", "left")
    has = or_false(F.col("__has"))
    process = F.when((F.col("BomStatus") != usable) & F.col("Process").isNull(), F.col("ModelProcess")).otherwise(F.col("Process"))
    report = report.withColumn("Process", process)
    match = has & or_false(F.col("Process") == F.col("ModelProcess"))
    report = report.withColumns({c: F.when(match, F.col(c)) for c in borrowed})
    excluded = scope_excluded(F.col("SemiItem"), F.col("SemiBom"))
    status = (
        F.when(excluded, EXCLUDED)
        .when(or_false(F.col("Process") == "Unmapped"), "ITEM_MASTER_UNMAPPED")
        .when(~has, "NO_MODEL_ITEM")
        .when(~match, "PROCESS_MISMATCH")
        .otherwise("DIAGNOSTIC_ONLY")
    )
    report = report.withColumns({"__status": status, "ModelLinkStatus": F.when(excluded, "NOT_EVALUATED_EXCLUDED_SCOPE").when(match, "MATCHED").when(has, "PROCESS_MISMATCH").otherwise("NO_MODEL_ITEM")})
    publish = or_false(
        (F.col("__status") == "DIAGNOSTIC_ONLY") & (F.col("ApprovalStatus") == "Approved")
        & (F.col("FirstPassDecisionEligibility") == "ELIGIBLE") & F.col("Complexity").isNotNull()
    )
    return report.withColumns(
        {
            "ReportStatus": F.when(publish, "APPROVED").otherwise(F.col("__status")),
            "FinalTechnicalComplexity": F.when(publish, F.col("Complexity")),
            "ScopeRule": scope_rule(F.col("SemiItem"), F.col("SemiBom")),
        }
    ).drop("__status", "__has")


def coverage_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with each value present, in one pass, as (Metric, Value)."""
    wide = df.agg(F.count("*").alias("rows"), *[F.count(c).alias(c) for c in columns])
    return wide.unpivot([], ["rows", *columns], "Metric", "Value")
