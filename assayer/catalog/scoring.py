"""Scoring, engineering-input, stone and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.catalog.attribution import PLAN_CTE, planned
from assayer.catalog.qc import TICKET_CTE
from assayer.catalog.registry import Inputs, query, shown
from assayer.functions import stonetext as X
from assayer.operators import bom as B
from assayer.operators import engineering as N
from assayer.operators import metrics as M
from assayer.operators import scoring as R
from assayer.operators import stones as T

NAMES = list(R.FACTOR_WEIGHTS)


def factors(inp: Inputs):
    """Five factor rows per item with deliberate defects."""
    entry = F.explode(F.array(*[F.struct(F.lit(f).alias("Factor"), F.lit(i).alias("i")) for i, f in enumerate(NAMES)])).alias("f")
    rows = inp.semis.select("Item", "Process", "n", entry).select("Item", "Process", "n", "f.*")
    rows = rows.filter("NOT (n % 17 = 0 AND i = 4)")
    n, i = F.col("n"), F.col("i")
    return rows.select(
        "Item", "Process", "Factor",
        F.when(~((n % 11 == 0) & (i == 1)), ((n * 3 + i * 7) % 101) / F.lit(10.0)).alias("Score"),
        F.when((n % 13 == 0) & (i == 2), " ").otherwise("doc").alias("Evidence"),
        F.lit("s").alias("Scorer"), F.lit("a").alias("Approver"), F.lit("v1").alias("Version"),
        F.when((n % 7 == 0) & (i == 3), "FALSE").otherwise(" True").alias("Approved"),
        F.when((n % 19 == 0) & (i == 0), "Review").otherwise("Valid").alias("DataQualityStatus"),
        F.lit(0.9).alias("ConfidencePct"),
        F.when(n % 5 == 0, "CONDITIONAL_DIAGNOSTIC").otherwise("estimated_validated").alias("ConfidenceStatus"),
    )


@query(
    """
WITH r AS (SELECT *, concat_ws('; ', CASE WHEN n % 17 = 0 THEN 'Missing or duplicate factors' END, CASE WHEN n % 11 = 0 THEN 'Missing or invalid factor score' WHEN (n * 3) % 101 > 100 THEN 'x' END,
  CASE WHEN n % 13 = 0 THEN 'Missing Evidence' END, CASE WHEN n % 7 = 0 THEN 'Pending factor approval' END, CASE WHEN n % 19 = 0 THEN 'Data quality exception' END,
  CASE WHEN n % 5 = 0 THEN 'Model confidence missing or unvalidated' END) AS why FROM semis)
SELECT Item, Process, CASE WHEN why = '' THEN 'All five factors approved' ELSE why END AS FactorGate, CASE WHEN why = '' THEN
  round(0.4 * ((n * 3) % 101) / 10 + 0.25 * ((n * 3 + 7) % 101) / 10 + 0.2 * ((n * 3 + 14) % 101) / 10 + 0.1 * ((n * 3 + 21) % 101) / 10 + 0.05 * ((n * 3 + 28) % 101) / 10, 6) END AS FinalTechnicalComplexity FROM r
""",
    ("semis",),
)
def five_factor_gate(inp: Inputs):
    return shown(R.technical_complexity(factors(inp)))


def sku_inputs(inp: Inputs):
    n = F.col("n")

    def val(k: int, every: int):
        return F.when(n % every != 0, ((n * k) % 101) / F.lit(10.0))

    none = F.lit(None).cast("double")
    return inp.semis.select(
        "SemiBom", "Process", F.when(n % 9 == 0, R.EXCLUDED).otherwise("DIAGNOSTIC_ONLY").alias("DifficultyStatus"),
        none.alias("Quality_Approved"), none.alias("MaterialDesignProcess_Approved"), none.alias("Stone_Approved"), none.alias("Learning_Approved"),
        F.when(n % 8 == 0, F.lit(7.0)).alias("PartMechanism_Approved"),
        val(3, 2).alias("QualityDiagnostic"), val(5, 3).alias("PartMechanismSource"), val(7, 4).alias("MaterialDesignSource"), val(11, 5).alias("StoneSource"),
        val(13, 6).alias("LearningSource"), none.alias("FinalTechnicalComplexity"), none.alias("QualityConfidencePct"),
        F.lit(None).cast("string").alias("QualityConfidenceStatus"), ((n % 10) / F.lit(10.0)).alias("RaschConfidencePct"),
        F.when(n % 7 == 0, "NOT_ESTIMATED").otherwise("CONDITIONAL_DIAGNOSTIC").alias("RaschConfidenceStatus"), F.lit(0.5).alias("LearningConfidencePct"),
        F.lit("CONDITIONAL_DIAGNOSTIC").alias("LearningConfidenceStatus"), F.lit("ridge").alias("QualityModelSource"),
        F.when(n % 3 == 0, (n % 20) / F.lit(20.0)).alias("ObservedFPY"), (n % 20).cast("double").alias("PassQty1"), F.lit(20.0).alias("InspectedQty1"),
        (n % 6).alias("QCEvidenceN"), F.when(n % 4 == 0, n % 8 == 0).alias("FitConverged"), F.lit(None).cast("string").alias("CalibrationStatus"),
    )


SKU_CTE = """v AS (SELECT *, n % 9 = 0 AS ex, CASE WHEN n % 2 <> 0 THEN ((n * 3) % 101) / CAST(10 AS DOUBLE) END AS q, CASE WHEN n % 8 = 0 THEN 7 WHEN n % 3 <> 0 THEN ((n * 5) % 101) / CAST(10 AS DOUBLE) END AS p,
  CASE WHEN n % 4 <> 0 THEN ((n * 7) % 101) / CAST(10 AS DOUBLE) END AS m, CASE WHEN n % 5 <> 0 THEN ((n * 11) % 101) / CAST(10 AS DOUBLE) END AS s, CASE WHEN n % 6 <> 0 THEN ((n * 13) % 101) / CAST(10 AS DOUBLE) END AS l FROM semis),
c AS (SELECT *, coalesce(0.4 * q, 0) + coalesce(0.25 * p, 0) + coalesce(0.2 * m, 0) + coalesce(0.1 * s, 0) + coalesce(0.05 * l, 0) AS tot,
  CASE WHEN q IS NULL THEN 0 ELSE 0.4 END + CASE WHEN p IS NULL THEN 0 ELSE 0.25 END + CASE WHEN m IS NULL THEN 0 ELSE 0.2 END + CASE WHEN s IS NULL THEN 0 ELSE 0.1 END + CASE WHEN l IS NULL THEN 0 ELSE 0.05 END AS cov,
  CASE WHEN q IS NOT NULL AND n % 7 <> 0 THEN (n % 10) / CAST(10 AS DOUBLE) END AS qc, CASE WHEN l IS NOT NULL THEN 0.5 END AS lc FROM v)"""


@query(
    f"""
WITH {SKU_CTE}
SELECT SemiBom, CAST(round(CASE WHEN NOT ex AND cov > 0 THEN tot / cov END, 6) AS DOUBLE) AS Score10, CAST(round(CASE WHEN NOT ex AND cov > 0 THEN tot END, 6) AS DOUBLE) AS Contribution, CAST(round(CASE WHEN ex THEN 0 ELSE cov END, 6) AS DOUBLE) AS Coverage,
  CAST(round(CASE WHEN NOT ex AND NOT (q IS NOT NULL AND qc IS NULL) THEN cov * coalesce(least(qc, lc), 1) END, 6) AS DOUBLE) AS OverallConfidence, CASE WHEN ex THEN 'EXCLUDED_SEMI_SCOPE' ELSE 'IN_SCOPE' END AS ScopeStatus FROM c
""",
    ("semis",),
)
def sku_score(inp: Inputs):
    return shown(R.sku_scores(sku_inputs(inp)), "SemiBom", "Score10", "Contribution", "Coverage", "OverallConfidence", "ScopeStatus")


@query(
    f"""
WITH {SKU_CTE}
SELECT SemiBom, CASE WHEN ex THEN 'Excluded from Semi scoring by code rule' WHEN n % 3 <> 0 THEN 'No eligible first-pass QC' ELSE
  printf('%.1f', (n % 20) * 5.0) || '% observed (' || (n % 20) || '/20 pieces); ' || (n % 6) || ' QC WOs' || CASE WHEN n % 8 = 0 THEN '; FIT_CONVERGED' WHEN n % 4 = 0 THEN '; FIT_NONCONVERGED' ELSE '; FIT_NOT_AVAILABLE' END
  || CASE WHEN q IS NOT NULL THEN '; MODEL_SCORE_INCLUDED_IN_TOTAL; VALIDATION_PENDING' ELSE '; NOT_VALIDATED' END END AS YieldSummary FROM c
""",
    ("semis",),
)
def yield_text(inp: Inputs):
    return shown(R.sku_scores(sku_inputs(inp)), "SemiBom", "YieldSummary")


@query(
    f"""
WITH {SKU_CTE}, f AS (SELECT SemiBom, ex, 'Quality' AS Factor, 0.4 AS Weight, q AS x, CASE WHEN q IS NULL THEN 'NOT_ESTIMATED' ELSE 'ridge' END AS me FROM c
 UNION ALL SELECT SemiBom, ex, 'PartMechanism', 0.25, p, CASE WHEN n % 8 = 0 THEN 'APPROVED_ENGINEERING_INPUT' WHEN p IS NULL THEN 'MISSING_SOURCE' ELSE 'SOURCE_RULE_CALCULATION_PROVISIONAL' END FROM c
 UNION ALL SELECT SemiBom, ex, 'MaterialDesignProcess', 0.2, m, CASE WHEN m IS NULL THEN 'MISSING_SOURCE' ELSE 'SOURCE_RULE_CALCULATION_PROVISIONAL' END FROM c
 UNION ALL SELECT SemiBom, ex, 'Stone', 0.1, s, CASE WHEN s IS NULL THEN 'MISSING_SOURCE' ELSE 'SOURCE_RULE_CALCULATION_PROVISIONAL' END FROM c
 UNION ALL SELECT SemiBom, ex, 'Learning', 0.05, l, CASE WHEN l IS NULL THEN 'INSUFFICIENT_REPEATED_HISTORY' ELSE 'OBSERVED_RAMP_UP_MODEL_PROVISIONAL' END FROM c)
SELECT SemiBom, Factor, CAST(Weight AS DOUBLE) AS Weight, CASE WHEN NOT ex THEN x END AS Score10, CASE WHEN ex THEN 'EXCLUDED_SEMI_SCOPE' ELSE me END AS Method FROM f
""",
    ("semis",),
)
def factor_provenance(inp: Inputs):
    return shown(R.factor_provenance(sku_inputs(inp)), "SemiBom", "Factor", "Weight", "Score10", "Method")


def branch_estimates(inp: Inputs):
    n = F.col("n")
    branches = F.explode(F.array(F.lit("FIRST_PASS"), F.lit("REWORK"))).alias("Branch")
    rows = inp.semis.select("Process", F.col("SemiBom").alias("SizeAdjustedGroup"), "n", branches)
    rework = F.col("Branch") == "REWORK"
    d = ((n * F.when(rework, 7).otherwise(3)) % 100) / F.lit(10.0)
    return rows.select(
        "Process", "SizeAdjustedGroup", "Branch", F.lit(True).alias("SelectedOnValidation"), d.alias("Difficulty10"), (d - 1).alias("Lower95"), (d + 1).alias("Upper95"),
        (d - 1.5).alias("Lower975"), (d + 1.5).alias("Upper975"), (n % 30).alias("WOs"),
        F.when(rework, n % 4 != 0).otherwise(n % 7 != 0).alias("EstimateEligible"),
        F.when(n % 2 == 0, "PASSED_STATISTICAL_GATES").otherwise("NOT_ACCEPTED_KEEP_RASCH").alias("ValidationStatus"), "n",
    )


@query(
    """
WITH b AS (SELECT *, (n * 3) % 100 / CAST(10 AS DOUBLE) AS f, (n * 7) % 100 / CAST(10 AS DOUBLE) AS r, n % 5 <> 0 AS hr FROM semis), v AS (SELECT *, n % 7 <> 0 AND (NOT hr OR n % 4 <> 0) AS ok FROM b)
SELECT Process, SemiBom AS SizeAdjustedGroup, CAST(CASE WHEN hr THEN 0.8 ELSE 1 END AS DOUBLE) AS FirstPassWeight, round(CASE WHEN ok THEN CASE WHEN hr THEN 0.8 * f + 0.2 * r ELSE f END END, 6) AS DiagnosticQuality,
  round(CASE WHEN ok AND n % 2 = 0 THEN CASE WHEN hr THEN 0.8 * f + 0.2 * r ELSE f END END, 6) AS Quality, round(CASE WHEN ok THEN CASE WHEN hr THEN 0.8 * (f - 1.5) + 0.2 * (r - 1.5) ELSE f - 1 END END, 6) AS QualityLower95,
  CASE WHEN ok AND n % 2 = 0 THEN 'PASSED_STATISTICAL_GATES' WHEN ok THEN 'DIAGNOSTIC_ONLY' ELSE 'MISSING_OR_INELIGIBLE_REQUIRED_BRANCH' END AS QualityStatus FROM v
""",
    ("semis",),
)
def quality_combine(inp: Inputs):
    rows = branch_estimates(inp)
    available = rows.filter("Branch = 'REWORK'").select("Process", "SizeAdjustedGroup", "Branch", F.when(F.col("n") % 5 != 0, 3).otherwise(0).alias("WOs"))
    return shown(
        R.combine_quality(rows, available), "Process", "SizeAdjustedGroup", "FirstPassWeight", "DiagnosticQuality", "Quality", "QualityLower95", "QualityStatus"
    )


@query(
    """
WITH b AS (SELECT *, CASE WHEN n % 3 <> 0 THEN (n % 100) / CAST(10 AS DOUBLE) END AS pq, CASE WHEN n % 4 <> 0 THEN (n * 7 % 100) / CAST(10 AS DOUBLE) END AS fp, (n * 11 % 100) / CAST(10 AS DOUBLE) AS rw, n % 9 = 0 AS ex FROM semis),
o AS (SELECT *, CASE WHEN n % 5 = 0 THEN fp ELSE 0.8 * fp + 0.2 * rw END AS old FROM b), q AS (SELECT *, CASE WHEN pq IS NOT NULL THEN 0.8 * pq + 0.2 * old ELSE old END AS qq FROM o)
SELECT SemiBom AS SizeAdjustedGroup, round(CASE WHEN NOT ex THEN qq END, 6) AS Quality, CASE WHEN ex THEN 'EXCLUDED_SEMI_SCOPE' WHEN qq IS NULL THEN 'UNAVAILABLE_REQUIRED_ESTIMATE' WHEN pq IS NOT NULL THEN '80_PERCENT_PLANNER_20_PERCENT_RASCH_PROVISIONAL'
  ELSE '100_PERCENT_RASCH_FALLBACK' END AS BlendStatus, round(CASE WHEN pq IS NOT NULL THEN 0.8 * (pq - 1) + 0.2 * old END, 6) AS QualityLower95Conditional FROM q
""",
    ("semis",),
)
def blend_policy(inp: Inputs):
    n = F.col("n")
    pq = F.when(n % 3 != 0, (n % 100) / F.lit(10.0))
    primary = inp.semis.select(
        "Process", F.col("SemiBom").alias("SizeAdjustedGroup"), pq.alias("PlannerQuality"), (pq - 1).alias("PlannerQualityLower95"), (pq + 1).alias("PlannerQualityUpper95"),
        F.when(n % 5 == 0, 1.0).otherwise(0.8).alias("FirstPassWeight"), F.when(n % 5 == 0, 0.0).otherwise(0.2).alias("ReworkWeight"),
        F.when(n % 9 == 0, R.EXCLUDED).otherwise("PROVISIONAL_USER_SELECTED").alias("UseStatus"),
    )
    older = inp.semis.select(
        "Process", F.col("SemiBom").alias("SizeAdjustedGroup"), F.when(n % 4 != 0, (n * 7 % 100) / F.lit(10.0)).alias("OldFirstPass"), ((n * 11 % 100) / F.lit(10.0)).alias("OldRework")
    )
    return shown(R.blend_models(primary, older), "SizeAdjustedGroup", "Quality", "BlendStatus", "QualityLower95Conditional")


@query(
    """
WITH g AS (SELECT l_partkey AS k, count(DISTINCT l_orderkey) AS t, round(avg(l_discount), 4) AS d, round(avg(l_tax), 4) AS x FROM lineitem GROUP BY 1),
r AS (SELECT *, concat_ws('; ', CASE WHEN NOT (k % 3 <> 0) THEN 'Convergence' END, CASE WHEN NOT (t >= 30) THEN 'CommonHoldout' END, CASE WHEN NOT (d - 0.05 < 0) THEN 'Improvement' END,
  CASE WHEN NOT (x - 0.03 <= 0.02 AND d - 0.03 <= 0.03) THEN 'Calibration' END, CASE WHEN NOT (x - 0.04 <= 0.01) THEN 'Segments' END, CASE WHEN NOT (d * 15 >= 0.7) THEN 'RankStability' END,
  CASE WHEN NOT (x * 20 >= 0.8) THEN 'PlannerCoverage' END, CASE WHEN NOT (d * 20 >= 0.9) THEN 'Network' END, CASE WHEN NOT (k % 2 = 0) THEN 'RetrospectiveSensitivity' END, CASE WHEN NOT (t >= 30) THEN 'BeforeAfterEvidence' END) AS why FROM g)
SELECT k AS Branch, why AS Reason, CASE WHEN why = '' THEN 'ELIGIBLE_FOR_REPLACEMENT' ELSE 'KEEP_RASCH' END AS Decision FROM r
"""
)
def acceptance_gates(inp: Inputs):
    g = inp.raw("lineitem").groupBy(F.col("l_partkey").alias("Branch")).agg(
        F.count_distinct("l_orderkey").alias("TestWOs"), F.round(F.avg("l_discount"), 4).alias("d"), F.round(F.avg("l_tax"), 4).alias("x")
    )
    metrics = g.withColumns(
        {
            "Converged": F.col("Branch") % 3 != 0, "ComparisonUpper95": F.col("d") - 0.05, "CalibrationGap": F.col("x") - 0.03, "ECE": F.col("d") - 0.03,
            "WorstSegmentUpper95": F.col("x") - 0.04, "RankCorrelationLower95": F.col("d") * 15, "SkillCoverage": F.col("x") * 20,
            "NetworkAdequateFraction": F.col("d") * 20, "RetrospectiveOk": F.col("Branch") % 2 == 0, "PreWOs": F.col("TestWOs"), "PostWOs": F.col("TestWOs"),
        }
    )
    return shown(R.acceptance(metrics), "Branch", "Reason", "Decision")


@query(
    f"""
WITH {TICKET_CTE}, {PLAN_CTE}
SELECT Process, Branch, round(avg(CASE WHEN CertifiedSkill IS NULL THEN 0.0 ELSE 1.0 END), 6) AS SkillCoverage,
  CASE WHEN avg(CASE WHEN CertifiedSkill IS NULL THEN 0.0 ELSE 1.0 END) < 0.6 THEN 'Exploratory: skill coverage below 60%' ELSE 'Candidate: validation required' END AS CandidateStatus FROM planned GROUP BY 1, 2
""",
    ("qc_tickets", "assignment", "skills"),
)
def candidate_status(inp: Inputs):
    return shown(R.coverage_status(planned(inp), ["Process", "Branch"]))


@query(
    """
SELECT SemiBom, CASE WHEN w <= 0.8 THEN 'High' WHEN w <= 1.8 THEN 'Medium' ELSE 'Low' END AS Tier, CASE WHEN w <= 0.8 THEN 'Eligible for review' WHEN w <= 1.8 THEN 'Uncertainty warning' ELSE 'Insufficient Evidence' END AS Advice
FROM (SELECT SemiBom, (n % 30) / CAST(10 AS DOUBLE) AS w FROM semis) x
""",
    ("semis",),
)
def interval_tier(inp: Inputs):
    width = (F.col("n") % 30) / F.lit(10.0)
    tier, advice = M.confidence_tier(F.lit(0.0), width)
    return shown(inp.semis.select("SemiBom", tier.alias("Tier"), advice.alias("Advice")))


@query(
    """
SELECT 'rows' AS Metric, CAST(count(*) AS BIGINT) AS Value FROM semis UNION ALL SELECT 'QualityDiagnostic', count(CASE WHEN n % 2 <> 0 THEN 1 END) FROM semis
UNION ALL SELECT 'StoneSource', count(CASE WHEN n % 5 <> 0 THEN 1 END) FROM semis UNION ALL SELECT 'ObservedFPY', count(CASE WHEN n % 3 = 0 THEN 1 END) FROM semis
""",
    ("semis",),
)
def coverage_summary(inp: Inputs):
    return shown(R.coverage_summary(sku_inputs(inp), ["QualityDiagnostic", "StoneSource", "ObservedFPY"]))


@query(
    """
WITH m AS (SELECT SemiItem, CASE WHEN n % 6 = 0 THEN 'OTHER' ELSE Process END AS mp, n FROM semis WHERE n % 5 <> 0),
r AS (SELECT s.*, m.SemiItem IS NOT NULL AS has, CASE WHEN s.n % 4 = 0 THEN NULL WHEN s.n % 31 = 0 THEN 'Unmapped' ELSE s.Process END AS p0, mp FROM semis s LEFT JOIN m ON s.SemiItem = m.SemiItem),
x AS (SELECT *, CASE WHEN n % 3 = 0 AND p0 IS NULL THEN mp ELSE p0 END AS p, n % 14 = 0 OR n % 9 IN (0, 2) AS ex FROM r),
y AS (SELECT *, has AND coalesce(p = mp, false) AS ok FROM x), z AS (SELECT *, CASE WHEN ex THEN 'EXCLUDED_SEMI_SCOPE' WHEN p = 'Unmapped' THEN 'ITEM_MASTER_UNMAPPED' WHEN NOT has THEN 'NO_MODEL_ITEM' WHEN NOT ok THEN 'PROCESS_MISMATCH' ELSE 'DIAGNOSTIC_ONLY' END AS st FROM y)
SELECT SemiBom, p AS Process, CASE WHEN st = 'DIAGNOSTIC_ONLY' AND n % 8 = 1 THEN 'APPROVED' ELSE st END AS ReportStatus, CASE WHEN st = 'DIAGNOSTIC_ONLY' AND n % 8 = 1 THEN CAST(n % 10 AS DOUBLE) END AS FinalTechnicalComplexity,
  CASE WHEN ex THEN 'NOT_EVALUATED_EXCLUDED_SCOPE' WHEN ok THEN 'MATCHED' WHEN has THEN 'PROCESS_MISMATCH' ELSE 'NO_MODEL_ITEM' END AS ModelLinkStatus FROM z
""",
    ("semis",),
)
def semi_item_report(inp: Inputs):
    n = F.col("n")
    features = inp.semis.select("SemiBom", "SemiItem", F.when(n % 3 == 0, "Circular BOM").otherwise(B.USABLE).alias("BomStatus"))
    detail = inp.semis.select("SemiBom", F.when(n % 4 == 0, None).when(n % 31 == 0, "Unmapped").otherwise(F.col("Process")).alias("Process"))
    model = inp.semis.filter("n % 5 <> 0").select(
        F.col("SemiItem").alias("Item"), F.when(n % 6 == 0, "OTHER").otherwise(F.col("Process")).alias("Process"),
        F.when(n % 2 == 1, "Approved").alias("ApprovalStatus"), F.when(n % 4 == 1, "ELIGIBLE").alias("FirstPassDecisionEligibility"),
        F.when(n % 8 == 1, (n % 10).cast("double")).alias("Complexity"),
    )
    return shown(R.item_report(features, detail, model, B.USABLE), "SemiBom", "Process", "ReportStatus", "FinalTechnicalComplexity", "ModelLinkStatus")


@query(
    """
WITH q AS (SELECT concat('S', l_partkey % 5000) AS b, CASE WHEN l_orderkey % 7 = 0 THEN NULL WHEN l_partkey % 3 = 0 THEN l_partkey % 5 ELSE l_linenumber END AS m FROM lineitem WHERE l_orderkey % 40 = 3),
s AS (SELECT b, count(*) AS n, count(m) AS k, min(m) AS lo, max(m) AS hi FROM q WHERE b IN (SELECT SemiBom FROM semis WHERE n % 2 = 0) GROUP BY 1)
SELECT b AS SemiBom, CASE WHEN k < n THEN 'INVALID_VALUE' WHEN lo <> hi THEN 'CONFLICTING_QUOTE' WHEN lo <= 0 THEN 'NONPOSITIVE_QUOTE' ELSE 'SUPPLIED' END AS QuoteStatus,
  CAST(CASE WHEN k = n AND lo = hi AND lo > 0 THEN lo END AS DOUBLE) AS QuotedMinutesPerSemi, CAST(n AS BIGINT) AS QuoteRows FROM s
""",
    ("semis",),
)
def quote_status(inp: Inputs):
    quotes = inp.raw("lineitem").filter("l_orderkey % 40 = 3").select(
        F.concat(F.lit("S"), F.col("l_partkey") % 5000).alias("SemiBom"), F.lit("X").alias("QuoteItem"),
        F.when(F.col("l_orderkey") % 7 == 0, "n/a").when(F.col("l_partkey") % 3 == 0, (F.col("l_partkey") % 5).cast("string")).otherwise(F.col("l_linenumber").cast("string")).alias("Minutes"),
    )
    normalised, _ = N.classify_quotes(quotes, inp.semis.filter("n % 2 = 0"))
    return shown(normalised, "SemiBom", "QuoteStatus", "QuotedMinutesPerSemi", "QuoteRows")


@query(
    """
SELECT SemiBom, CASE WHEN n % 5 = 0 THEN n % 50 * 60 ELSE n % 50 END + CAST(0 AS DOUBLE) AS QuotedMinutesPerSemi, CASE WHEN n % 5 = 0 THEN 'HOURS_CONVERTED_X60' ELSE 'MINUTES' END AS QuoteInputUnit FROM semis
""",
    ("semis",),
)
def quote_units(inp: Inputs):
    n = F.col("n")
    quotes = inp.semis.select("SemiBom", F.when(n % 5 != 0, (n % 50).cast("string")).alias("QuotedMinutes"), F.when(n % 5 == 0, (n % 50).cast("string")).alias("QuotedHours"))
    return shown(N.quotes_in_minutes_or_hours(quotes, inp.semis), "SemiBom", "QuotedMinutesPerSemi", "QuoteInputUnit")


def part_source(inp: Inputs):
    n = F.col("n")
    part, assembly, bonus = (n % 10).cast("double"), F.when(n % 7 != 0, (n % 9).cast("double")), F.when(n % 4 == 0, 0.5)
    composite = F.least(F.lit(10.0), 0.7 * part + 0.3 * F.coalesce(assembly, F.lit(0.0)) + F.coalesce(bonus, F.lit(0.0)))
    return inp.semis.select(
        "SemiBom", part.alias("PartScore"), assembly.alias("AssemblyScore"), bonus.alias("MechanismBonus"), composite.alias("Composite"),
        F.when(n % 11 != 0, "Hinged").alias("AssemblyType"),
    )


@query(
    """
SELECT CASE WHEN n % 2 = 0 THEN 'MATCHED_SEMI_BOM' ELSE 'OUTSIDE_BOM_SCOPE' END AS SelectionStatus, CASE WHEN n % 11 = 0 OR n % 7 = 0 THEN 'INCOMPLETE_COMPONENT_DETAIL' ELSE 'SOURCE_COMPONENTS_PRESENT' END AS EvidenceStatus,
  CAST(0.7 AS DOUBLE) AS PartWeight, CAST(count(*) AS BIGINT) AS N FROM semis GROUP BY 1, 2
""",
    ("semis",),
)
def part_mechanism_source(inp: Inputs):
    source = part_source(inp)
    weight = N.detect_part_weight(source)
    rows = N.part_mechanism(source, inp.semis.filter("n % 2 = 0"))
    return shown(rows.groupBy("SelectionStatus", "EvidenceStatus", F.lit(weight).alias("PartWeight")).agg(F.count("*").alias("N")))


@query(
    """
WITH src AS (SELECT n, c, concat('S', n) AS b FROM (SELECT n, unnest([1, 2]) AS c FROM semis) e WHERE c = 1 OR n % 3 = 0),
j AS (SELECT src.*, s.SemiBom IS NOT NULL AS inn, s.SemiBom IS NOT NULL AND src.n % 5 <> 0 AS val, s.SemiBom IS NOT NULL AND src.n % 5 <> 0 AND (c = 1 AND src.n % 7 <> 0 OR c = 2 AND src.n % 2 = 0) AS typ FROM src LEFT JOIN (SELECT * FROM semis WHERE n % 11 <> 0) s ON s.SemiBom = b),
k AS (SELECT *, count(*) OVER (PARTITION BY b) AS r, sum(CASE WHEN val THEN 1 ELSE 0 END) OVER (PARTITION BY b) AS v, sum(CASE WHEN typ THEN 1 ELSE 0 END) OVER (PARTITION BY b) AS t FROM j)
SELECT CASE WHEN NOT inn THEN 'OUTSIDE_BOM_SCOPE' WHEN v = 0 THEN 'ITEM_OR_PROCESS_MISMATCH' WHEN t = 0 THEN 'PRODUCT_TYPE_MISMATCH' WHEN t > 1 THEN 'CONFLICTING_MATCHED_CONTEXTS' WHEN typ AND r > 1 THEN 'SELECTED_PRODUCT_TYPE'
  WHEN typ THEN 'SELECTED_UNIQUE' ELSE 'NOT_SELECTED_CONTEXT' END AS SelectionStatus, CAST(count(*) AS BIGINT) AS N FROM k GROUP BY 1
""",
    ("semis",),
)
def material_design_selection(inp: Inputs):
    n, c = F.col("n"), F.col("c")
    rows = inp.semis.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("c")).filter("c = 1 OR n % 3 = 0")
    same = ((c == 1) & (n % 7 != 0)) | ((c == 2) & (n % 2 == 0))
    source = rows.select(
        "SemiBom", F.when(n % 5 != 0, F.col("SemiItem")).otherwise("X").alias("SourceItem"), F.col("Process").alias("SourceProcess"),
        F.when(same, F.trim("ProductType")).otherwise("Brooch").alias("SourceProductType"), F.lit(5.0).alias("MaterialScore"), F.lit(4.0).alias("DesignScore"),
        F.lit(3.0).alias("ProcessScore"), F.lit(4.2).alias("Composite"),
    )
    picked = N.material_design(source, inp.semis.filter("n % 11 <> 0"))
    return shown(picked.groupBy("SelectionStatus").agg(F.count("*").alias("N")))


def time_semis(inp: Inputs):
    n = F.col("n")
    return inp.semis.select(
        F.when(n % 29 == 0, "I0").otherwise(F.col("Item")).alias("SemiItem"), "SemiBom", "Process",
        F.when(n % 23 == 0, "OTHER").otherwise(F.col("Process")).alias("MasterProcess"), "SizeAdjustedGroup",
        F.when(n % 37 == 0, R.EXCLUDED).otherwise("DIAGNOSTIC_ONLY").alias("ReportStatus"), "n",
    ).filter("n % 17 <> 5")


TIME_CTE = """fl AS (SELECT *, count(*) OVER (PARTITION BY WO, RoundNo, Worker) > 1 AS dup, abs(Final - Origin - Idle) > 1e-7 AS ide, RoundNo < 1 AS ir,
  (RoundNo = 1 AND Attempt <> '1st Attempt') OR (RoundNo > 1 AND Attempt <> 'Repair WorkOrder') AS bm, Worker IS NULL AS mw FROM worker_hours),
rd AS (SELECT WO, RoundNo, sum(Final) AS h, count(DISTINCT Worker) AS k, bool_or(dup) AS dup, bool_or(ide) AS ide, bool_or(ir) AS ir, bool_or(bm) AS bm, bool_or(mw) AS mw FROM fl GROUP BY 1, 2),
se AS (SELECT CASE WHEN n % 29 = 0 THEN 'I0' ELSE Item END AS si, SemiBom, Process, CASE WHEN n % 23 = 0 THEN 'OTHER' ELSE Process END AS mp, n FROM semis WHERE n % 17 <> 5),
sc AS (SELECT si, count(*) AS c FROM se GROUP BY 1),
tj AS (SELECT rd.*, o.WO IS NOT NULL AS om, o.Status, o.GoodPieces, sc.c, se.* FROM rd LEFT JOIN work_orders o ON rd.WO = o.WO LEFT JOIN sc ON sc.si = o.Item LEFT JOIN se ON se.si = o.Item AND sc.c = 1)"""


@query(
    f"""
WITH {TIME_CTE}
SELECT CASE WHEN lower(trim(WO)) = 'other' THEN 'OTHER_WO' WHEN NOT om THEN 'UNMATCHED_WO' WHEN Status <> 'Complete' THEN 'INCOMPLETE_WO' WHEN ir THEN 'INVALID_ROUND' WHEN dup THEN 'DUPLICATE_WORKER_ROUND' WHEN ide THEN 'INVALID_ALLOCATED_HOURS'
  WHEN bm THEN 'BRANCH_ROUND_MISMATCH' WHEN mw OR k <> 1 THEN 'TEAM_OR_MISSING_WORKER' WHEN c > 1 THEN 'AMBIGUOUS_SEMI_BOM' WHEN SemiBom IS NULL THEN 'NO_UNIQUE_SEMI' WHEN n % 37 = 0 THEN 'EXCLUDED_SEMI_SCOPE' WHEN Process <> mp THEN 'PROCESS_MAPPING_MISMATCH'
  WHEN GoodPieces <= 0 OR h <= 0 THEN 'NONPOSITIVE_RESPONSE' ELSE '' END AS Exclusion, CAST(count(*) AS BIGINT) AS Rounds, round(sum(h), 1) AS Hours FROM tj GROUP BY 1
""",
    ("worker_hours", "work_orders", "semis"),
)
def time_cohort_exclusions(inp: Inputs):
    cohort = N.time_cohort(inp.worker_hours, inp.work_orders, time_semis(inp))
    return shown(cohort.groupBy("Exclusion").agg(F.count("*").alias("Rounds"), F.round(F.sum("AllocatedHours"), 1).alias("Hours")))


@query(
    """
WITH r AS (SELECT p.*, s.n FROM production p LEFT JOIN semis s ON s.Item = p.Item AND s.n % 6 <> 0 WHERE year(RafMonth) = 1999),
e AS (SELECT *, CASE WHEN n IS NULL THEN 'NO_UNIQUE_BOM_SEMI' WHEN n % 37 = 0 THEN 'EXCLUDED_SEMI_SCOPE' WHEN n % 23 = 0 THEN 'PROCESS_CHANGED_OR_CONFLICTING' WHEN n % 4 = 0 THEN 'NO_POSITIVE_QUOTE' ELSE '' END AS x FROM r)
SELECT x AS Exclusion, CAST(count(*) AS BIGINT) AS RowCount, round(avg(60 * Hours / Qty), 5) AS MeanMinutes FROM e GROUP BY 1
""",
    ("production", "semis"),
)
def legacy_cohort_exclusions(inp: Inputs):
    n = F.col("n")
    semis = inp.semis.filter("n % 6 <> 0").select(
        F.col("Item").alias("SemiItem"), "SemiBom", F.when(n % 23 == 0, "OTHER").otherwise(F.col("Process")).alias("Process"),
        F.when(n % 37 == 0, R.EXCLUDED).otherwise("DIAGNOSTIC_ONLY").alias("ReportStatus"), F.when(n % 4 != 0, 5.0).otherwise(0.0).alias("QuotedMinutesPerSemi"),
    )
    cohort = N.legacy_cohort(inp.production, semis, 1999)
    return shown(cohort.groupBy("Exclusion").agg(F.count("*").alias("RowCount"), F.round(F.avg("ActualMinutes"), 5).alias("MeanMinutes")))


@query(
    """
SELECT concat('q', CASE WHEN n % 2 <> 0 THEN 1 ELSE 0 END, '_m', CASE WHEN n % 3 <> 0 THEN 1 ELSE 0 END, '_s', CASE WHEN n % 5 <> 0 THEN 1 ELSE 0 END) AS Pattern, CAST(count(*) AS BIGINT) AS N,
  round(avg((CASE WHEN n % 2 <> 0 THEN 0.4 * (n % 10) ELSE 0 END + 0.25 * (n % 8) + CASE WHEN n % 3 <> 0 THEN 0.2 * (n % 7) ELSE 0 END + CASE WHEN n % 5 <> 0 THEN 0.1 * (n % 6) ELSE 0 END) /
   (CASE WHEN n % 2 <> 0 THEN 0.4 ELSE 0 END + 0.25 + CASE WHEN n % 3 <> 0 THEN 0.2 ELSE 0 END + CASE WHEN n % 5 <> 0 THEN 0.1 ELSE 0 END)), 6) AS MeanDifficulty FROM semis GROUP BY 1
""",
    ("semis",),
)
def difficulty_features(inp: Inputs):
    n = F.col("n")
    rows = inp.semis.select(
        F.when(n % 2 != 0, (n % 10).cast("double")).alias("QualityScore"), (n % 8).cast("double").alias("PartScore"),
        F.when(n % 3 != 0, (n % 7).cast("double")).alias("MaterialScore"), F.when(n % 5 != 0, (n % 6).cast("double")).alias("StoneScore"),
    )
    return shown(N.difficulty_features(rows).groupBy("Pattern").agg(F.count("*").alias("N"), F.avg("DifficultyScore").alias("MeanDifficulty")))


@query(
    """
WITH t AS (SELECT *, unnest(['First pass', 'Rework']) AS br FROM (SELECT * FROM semis WHERE n % 17 <> 5) s)
SELECT br AS Branch, CASE WHEN n % 37 = 0 THEN 'EXCLUDED_SEMI_SCOPE' WHEN n % 23 = 0 THEN 'PROCESS_MAPPING_MISMATCH' WHEN br = 'Rework' AND Process = 'PROMO' THEN 'NO_PROCESS_BRANCH_MODEL' ELSE 'DIAGNOSTIC_ALLOCATED_TIME' END AS TimeModelStatus, CAST(count(*) AS BIGINT) AS N FROM t GROUP BY 1, 2
""",
    ("semis",),
)
def time_target_expansion(inp: Inputs):
    semis = time_semis(inp)
    modeled = semis.select(F.explode(F.array(F.concat("Process", F.lit(" / First pass")), F.when(F.col("Process") != "PROMO", F.concat("Process", F.lit(" / Rework"))))).alias("PB"))
    return shown(N.target_expansion(semis, modeled).groupBy("Branch", "TimeModelStatus").agg(F.count("*").alias("N")))


@query(
    r"""
WITH t AS (SELECT *, lower(ProductName) AS x FROM stones), p AS (SELECT *, StoneType = 'Pearl' OR regexp_matches(x, '\bpearl\b') AS pr FROM t)
SELECT StoneSku, CASE WHEN pr THEN 'Pearl' ELSE 'Gemstone' END AS ShapeFamily, CASE WHEN pr THEN CASE WHEN regexp_matches(x, '\bbaroque\b') THEN 'Baroque' WHEN regexp_matches(x, '\bnear\s*round\b') THEN 'Near Round' WHEN regexp_matches(x, '\boval\b') THEN 'Oval' ELSE 'Round' END
  WHEN regexp_matches(x, '\bmaquire\b') THEN 'Marquise' WHEN regexp_matches(x, '\bemerald\s+cut\b') THEN 'Emerald Cut' WHEN regexp_matches(x, '\bheart\b') THEN 'Heart' WHEN regexp_matches(x, '\boctagon\b|\bsquare\b') THEN 'Rectangle' WHEN regexp_matches(x, '\boval\b') THEN 'Oval' ELSE 'Round' END AS StoneShape,
  CASE WHEN NOT pr AND regexp_matches(x, '\bmaquire\b') THEN 'Corrected' WHEN pr AND regexp_matches(x, '\bbaroque\b|\bnear\s*round\b|\boval\b|\bround\b') THEN 'Explicit'
   WHEN NOT pr AND regexp_matches(x, '\bemerald\s+cut\b|\bheart\b|\boctagon\b|\bsquare\b|\boval\b|\bround\b|\brd\b') THEN 'Explicit' ELSE 'Default' END AS ShapeSource,
  CASE WHEN regexp_matches(x, '\bhalf\s*drill\b') THEN 'Half Drill' WHEN regexp_matches(x, '\btop\s*drill\b') THEN 'Top Drill' WHEN regexp_matches(x, '\bno\s*drill\b') THEN 'No Drill' END AS PearlDrillType,
  CASE WHEN regexp_matches(x, 'octagon brill cab') THEN 'Brilliant; Cabochon' WHEN regexp_matches(x, '\bbrilliant\b|\bbrill\b') THEN 'Brilliant' WHEN regexp_matches(x, '\bcab\b') THEN 'Cabochon' WHEN regexp_matches(x, '\brose\s*cut\b') THEN 'Rose Cut'
   WHEN regexp_matches(x, '\bstep\s*cut\b') THEN 'Step Cut' WHEN regexp_matches(x, '\bfacet\b') THEN 'Faceted' END AS CutProfile FROM p
""",
    ("stones",),
)
def sku_text_attributes(inp: Inputs):
    return shown(X.with_shape(inp.stones), "StoneSku", "ShapeFamily", "StoneShape", "ShapeSource", "PearlDrillType", "CutProfile")


@query(
    """
SELECT StoneSku, CAST(CASE n % 8 WHEN 0 THEN greatest(z, n % 7 + 1) WHEN 1 THEN z + 2 WHEN 2 THEN greatest(z, n % 7 + 1) WHEN 3 THEN z WHEN 4 THEN greatest(z + 0.5, n % 7 + 1) WHEN 5 THEN z WHEN 6 THEN z END AS DOUBLE) AS MajorSizeMm
FROM (SELECT concat('K', p_partkey) AS StoneSku, p_partkey AS n, p_size AS z FROM part) s
"""
)
def sku_dimensions(inp: Inputs):
    return shown(X.with_size(inp.stones), "StoneSku", "MajorSizeMm")


@query(
    """
WITH s AS (SELECT *, UnitWeightGram * 5 AS ct, StoneType = 'Pearl' OR regexp_matches(lower(ProductName), '\\bpearl\\b') AS pr FROM stones)
SELECT StoneType, CAST(CASE StoneType WHEN 'Synthetic stone' THEN 5 WHEN 'Pearl' THEN 7 WHEN 'Natural stone' THEN 8 WHEN 'Diamond' THEN 10 END AS DOUBLE) AS MaterialScore,
  CAST(CASE WHEN ct <= 0.005 THEN 1 WHEN ct <= 0.015 THEN 2 WHEN ct <= 0.035 THEN 3 WHEN ct <= 0.085 THEN 4 WHEN ct <= 0.22 THEN 5 WHEN ct <= 0.55 THEN 6 WHEN ct <= 1.3 THEN 7 WHEN ct <= 3 THEN 8 WHEN ct <= 6 THEN 9 WHEN ct > 6 THEN 10 END AS DOUBLE) AS UnitSizeScore, CAST(count(*) AS BIGINT) AS N
FROM s WHERE NOT pr GROUP BY 1, 2, 3
""",
    ("stones",),
)
def stone_rule_scores(inp: Inputs):
    rows = X.stone_attributes(inp.stones).filter("NOT IsPearl")
    return shown(rows.groupBy("StoneType", "MaterialScore", "UnitSizeScore").agg(F.count("*").alias("N")))


@query(
    """
WITH k AS (SELECT SemiBom, Fg, StoneSku, sum(EffectiveCount) AS n FROM stone_paths GROUP BY 1, 2, 3), f AS (SELECT SemiBom, Fg, string_agg(concat(StoneSku, ':', n), '|' ORDER BY StoneSku) AS c FROM k GROUP BY 1, 2)
SELECT SemiBom, CAST(count(*) AS BIGINT) AS FgUseCount, count(DISTINCT c) > 1 AS CompositionConflict FROM f GROUP BY 1
""",
    ("stone_paths",),
)
def composition_conflicts(inp: Inputs):
    return shown(T.composition_conflicts(inp.stone_paths))


STONE_CTE = """rp AS (SELECT SemiBom, min(Fg) AS Fg FROM stone_paths GROUP BY 1), k AS (SELECT p.SemiBom, StoneSku, sum(EffectiveCount) AS n FROM stone_paths p JOIN rp ON p.SemiBom = rp.SemiBom AND p.Fg = rp.Fg GROUP BY 1, 2),
d AS (SELECT k.*, s.StoneType, CASE StoneType WHEN 'Synthetic stone' THEN 5 WHEN 'Pearl' THEN 7 WHEN 'Natural stone' THEN 8 WHEN 'Diamond' THEN 10 END AS ms, CAST(substr(k.StoneSku, 2) AS BIGINT) % 6 + 5 AS ss, CASE WHEN CAST(substr(k.StoneSku, 2) AS BIGINT) % 5 <> 0 THEN CAST(substr(k.StoneSku, 2) AS BIGINT) % 10 + 1 END AS us FROM k JOIN stones s ON k.StoneSku = s.StoneSku),
g AS (SELECT SemiBom, sum(n) AS t, count(*) AS c, max(ms) AS m, 0.7 * max(ss) + 0.3 * sum(ss * n) / sum(n) AS sh, 0.75 * max(us) + 0.25 * sum(us * n) / sum(CASE WHEN us IS NOT NULL THEN n END) AS sz, count(us) AS k FROM d GROUP BY 1),
h AS (SELECT *, CASE WHEN t <= 0 THEN 0 WHEN t <= 1 THEN 1 WHEN t <= 2 THEN 2 WHEN t <= 4 THEN 3 WHEN t <= 9 THEN 4 WHEN t <= 20 THEN 5 WHEN t <= 39 THEN 6 WHEN t <= 76 THEN 7 WHEN t <= 149 THEN 8 WHEN t <= 359 THEN 9 ELSE 10 END AS cs FROM g)"""


@query(
    f"""
WITH {STONE_CTE}
SELECT SemiBom, t AS TotalStoneCount, CAST(c AS BIGINT) AS DistinctStoneSku, CAST(m AS DOUBLE) AS MaterialScore, round(sh, 6) AS ShapeComponent, CAST(cs AS DOUBLE) AS CountScore, round(sz, 6) AS SizeComponent,
  CASE WHEN m IS NOT NULL AND k = c THEN 'Complete' ELSE 'Provisional' END AS ScoreStatus, round((coalesce(0.25 * m, 0) + 0.2 * sh + 0.15 * cs + coalesce(0.4 * sz, 0)) / (CASE WHEN m IS NULL THEN 0 ELSE 0.25 END + 0.35 + CASE WHEN sz IS NULL THEN 0 ELSE 0.4 END), 6) AS Exact FROM h
""",
    ("stone_paths", "stones"),
)
def stone_score(inp: Inputs):
    number = F.substring("StoneSku", 2, 20).cast("bigint")
    attributes = X.stone_attributes(inp.stones).select("StoneSku", "StoneType", "MaterialScore").withColumns(
        {"ShapeScore": (number % 6 + 5).cast("double"), "UnitSizeScore": F.when(number % 5 != 0, (number % 10 + 1).cast("double"))}
    )
    scored = T.stone_complexity(T.representative_stones(inp.stone_paths).join(attributes, "StoneSku"))
    total = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in T.WEIGHTS.items()), F.lit(0.0))
    covered = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in T.WEIGHTS.items()), F.lit(0.0))
    return shown(
        scored.withColumn("Exact", total / covered), "SemiBom", "TotalStoneCount", "DistinctStoneSku", "MaterialScore", "ShapeComponent", "CountScore",
        "SizeComponent", "ScoreStatus", "Exact",
    )
