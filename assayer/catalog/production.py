"""Production queries: cleaning, mapping, enrichment, allocation, quarantine."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.catalog.registry import Inputs, query, shown
from assayer.operators import production as P

CUTOFF = "2000-06-30 23:59:59"


def facts(inp: Inputs):
    """Bridge production with a few training customers, as cleaned facts."""
    return P.clean_production(inp.production.replace({"FURNITURE": "Training "}, subset=["Customer"]))


@query(
    """
SELECT WO, RoundNo, Worker, Item, round(Hours / Qty, 6) AS TimePerPiece, round(ln(Hours / Qty), 6) AS LogTime,
       round(60 * (Hours / Qty), 6) AS MinutesPerOk
FROM production WHERE Customer <> 'FURNITURE' AND Qty > 0 AND Hours > 0
""",
    ("production",),
)
def clean_production(inp: Inputs):
    return shown(facts(inp), "WO", "RoundNo", "Worker", "Item", "TimePerPiece", "LogTime", "MinutesPerOk")


@query(
    """
SELECT Process, strftime(RafMonth, '%Y-%m') AS Month, count(*) AS RowCount, round(avg(60 * (Hours / Qty)), 6) AS MeanMinutes,
       round(sum(Hours) / sum(Qty) * 60, 6) AS PooledMinutes
FROM production WHERE Qty > 0 AND Hours > 0 AND strftime(RafMonth, '%Y-%m') <> '2001-08' GROUP BY 1, 2
""",
    ("production",),
)
def time_per_piece(inp: Inputs):
    rows = P.clean_production(inp.production, incomplete_month="2001-08")
    return shown(
        rows.groupBy("Process", F.date_format("RafMonth", "yyyy-MM").alias("Month")).agg(
            F.count("*").alias("RowCount"),
            F.avg("MinutesPerOk").alias("MeanMinutes"),
            (F.sum("Hours") / F.sum("Qty") * 60).alias("PooledMinutes"),
        )
    )


@query(
    """
SELECT WO, CAST(count(*) AS BIGINT) AS Lines,
       CAST(count(CASE WHEN n > 1 THEN 1 END) AS BIGINT) AS Quarantined
FROM (SELECT WO, Worker, Item, count(*) OVER (PARTITION BY WO, Worker, Item, date_trunc('year', RafMonth), RoundNo % 2) AS n
      FROM production) t GROUP BY WO
""",
    ("production",),
)
def quarantine_duplicates(inp: Inputs):
    coarse = inp.production.withColumns({"RafMonth": F.date_trunc("year", "RafMonth"), "RoundNo": F.col("RoundNo") % 2})
    flagged = P.flag_quarantine(coarse)
    return shown(
        flagged.groupBy("WO").agg(
            F.count("*").alias("Lines"), F.count_if(F.col("Reason") == "Duplicate production key").alias("Quarantined")
        )
    )


@query(
    """
WITH coarse AS (SELECT p.*, CASE WHEN Item IN ('I3', 'I7') THEN NULL ELSE Process END AS Proc2 FROM production p),
audit AS (SELECT WO, lower(trim(Status)) = 'complete' AS ok FROM work_orders),
kept AS (SELECT * FROM coarse WHERE WO NOT IN (SELECT WO FROM audit WHERE NOT ok)),
clean AS (SELECT * FROM kept WHERE Customer <> 'FURNITURE'),
flag AS (SELECT *, count(*) OVER (PARTITION BY WO, Worker, Item, date_trunc('year', RafMonth), RoundNo % 2) AS n FROM clean)
SELECT 'Production input rows' AS "Check", CAST(count(*) AS BIGINT) AS N FROM kept
UNION ALL SELECT 'Work orders excluded: not complete', count(*) FROM audit WHERE NOT ok
UNION ALL SELECT 'Production retained after basic filters', count(*) FROM clean
UNION ALL SELECT 'Duplicate production rows quarantined', count(*) FROM flag WHERE n > 1
UNION ALL SELECT 'Unmapped production rows quarantined', count(*) FROM flag WHERE Proc2 IS NULL
""",
    ("production", "work_orders"),
)
def quality_counts(inp: Inputs):
    audit = P.order_status_audit(inp.work_orders)
    raw = inp.production.withColumns(
        {
            "Process": F.when(~F.col("Item").isin("I3", "I7"), F.col("Process")),
            "Customer": F.when(F.col("Customer") == "FURNITURE", "training").otherwise(F.col("Customer")),
        }
    )
    kept = P.exclude_orders(raw, audit)
    clean = P.clean_production(kept)
    coarse = clean.withColumns({"RafMonth": F.date_trunc("year", "RafMonth"), "RoundNo": F.col("RoundNo") % 2})
    return shown(P.data_quality_counts(kept, clean, P.flag_quarantine(coarse), audit))


@query(
    """
SELECT r AS Raw, CASE WHEN r >= 1 AND r = floor(r) THEN CAST(r AS BIGINT) END AS RoundNo, CAST(count(*) AS BIGINT) AS N
FROM (SELECT (l_linenumber - 2) / CAST(2 AS DOUBLE) AS r FROM lineitem) t GROUP BY 1, 2
"""
)
def valid_round(inp: Inputs):
    rows = inp.raw("lineitem").select(((F.col("l_linenumber") - 2) / F.lit(2.0)).alias("Raw"))
    return shown(rows.withColumn("RoundNo", P.valid_round("Raw")).groupBy("Raw", "RoundNo").agg(F.count("*").alias("N")))


@query(
    """
SELECT p.WO, CAST(count(*) AS BIGINT) AS Lines, round(sum(p.Hours), 6) AS Hours
FROM production p JOIN work_orders o ON p.WO = o.WO WHERE lower(trim(o.Status)) = 'complete' GROUP BY p.WO
""",
    ("production", "work_orders"),
)
def exclude_incomplete_orders(inp: Inputs):
    kept = P.exclude_orders(inp.production, P.order_status_audit(inp.work_orders))
    return shown(kept.groupBy("WO").agg(F.count("*").alias("Lines"), F.sum("Hours").alias("Hours")))


@query(
    """
SELECT WO, trim(Status) AS Status, CASE WHEN lower(trim(Status)) = 'complete' THEN 'ELIGIBLE_COMPLETE'
       ELSE 'EXCLUDED_NOT_COMPLETE' END AS AnalysisStatus FROM work_orders
""",
    ("work_orders",),
)
def order_status_audit(inp: Inputs):
    return shown(P.order_status_audit(inp.work_orders))


@query(
    f"""
SELECT (SELECT strftime(greatest((SELECT max(RafMonth) FROM production), (SELECT max(greatest(QcStart, QcStop)) FROM qc_tickets)),
        '%Y-%m-%d %H:%M:%S')) AS Cutoff,
       CAST((SELECT count(*) FROM production WHERE RafMonth <= TIMESTAMP '{CUTOFF}') AS BIGINT) AS AsOfRows
""",
    ("production", "qc_tickets"),
)
def asof_cutoff(inp: Inputs):
    asof = P.as_of(inp.production, CUTOFF).agg(F.count("*").alias("AsOfRows"))
    return shown(P.inferred_cutoff(inp.production, inp.qc_tickets).join(asof))


def item_master(inp: Inputs):
    """Part-derived master: some items without a size group."""
    return inp.semis.select(
        "Item",
        "Process",
        F.when(F.col("n") % 4 != 0, F.col("SizeAdjustedGroup")).alias("SizeAdjustedGroup"),
        "Material",
        "ProductType",
        "n",
    )


MASTER_CTE = "master AS (SELECT Item, Process, CASE WHEN n % 4 <> 0 THEN SizeAdjustedGroup END AS g, Material, ProductType, n FROM semis)"


@query(
    f"""
WITH {MASTER_CTE}, one AS (SELECT Item, Process, coalesce(g, Item) AS SizeAdjustedGroup, g IS NULL AS MappingFallback FROM master)
SELECT *, CAST(count(*) OVER (PARTITION BY SizeAdjustedGroup, Process) AS BIGINT) AS GroupItemCount,
       CASE WHEN count(*) OVER (PARTITION BY SizeAdjustedGroup, Process) > 5 THEN 'Pending Engineering Review (>5 Items)'
            ELSE 'Pending Size Residual Validation' END AS SizeEffectFlag FROM one
""",
    ("semis",),
)
def item_mapping(inp: Inputs):
    return shown(P.item_mapping(item_master(inp).unionByName(item_master(inp))))


@query(
    f"""
WITH {MASTER_CTE}
SELECT p.WO, p.Item, p.Process, coalesce(m.g, p.Item) AS SizeAdjustedGroup, CAST(count(*) AS BIGINT) AS N
FROM production p LEFT JOIN master m ON p.Item = m.Item AND m.n % 3 <> 0 GROUP BY 1, 2, 3, 4
""",
    ("production", "semis"),
)
def attach_mapping(inp: Inputs):
    mapping = P.item_mapping(item_master(inp).filter("n % 3 <> 0"))
    joined = P.attach_mapping(inp.production, mapping)
    return shown(joined.groupBy("WO", "Item", "Process", "SizeAdjustedGroup").agg(F.count("*").alias("N")))


@query(
    """
SELECT p.WO, p.Item, coalesce(CASE WHEN p.RoundNo % 2 = 0 THEN p.Material END, CASE WHEN s.n % 3 <> 0 THEN s.Material END, 'Unknown') AS Material,
       coalesce(CASE WHEN s.n % 3 <> 0 THEN trim(s.ProductType) END, 'Unknown') AS ProductType, CAST(count(*) AS BIGINT) AS N
FROM production p JOIN semis s ON p.Item = s.Item GROUP BY 1, 2, 3, 4
""",
    ("production", "semis"),
)
def master_enrichment(inp: Inputs):
    rows = inp.production.withColumn("Material", F.when(F.col("RoundNo") % 2 == 0, F.col("Material"))).drop("ProductType")
    filled = P.enrich_from_master(rows, inp.semis.filter("n % 3 <> 0"), "Item", ["Material", "ProductType"])
    filled = P.with_defaults(filled, ["Material", "ProductType"])
    return shown(filled.groupBy("WO", "Item", "Material", "ProductType").agg(F.count("*").alias("N")))


@query(
    """
SELECT Item, CASE WHEN n % 2 = 0 THEN Process ELSE 'MAPPED' END AS Process,
       CASE WHEN n % 2 = 0 THEN SizeAdjustedGroup ELSE 'G' END AS SizeAdjustedGroup FROM semis
""",
    ("semis",),
)
def mapping_precedence(inp: Inputs):
    mapping = inp.semis.withColumns({"Process": F.lit("MAPPED"), "SizeAdjustedGroup": F.lit("G")})
    return shown(P.mapping_by_precedence(mapping, inp.semis.filter("n % 2 = 0")))


@query(
    """
SELECT s.SemiBom, s.SemiItem, CASE WHEN n % 5 <> 0 THEN Process END AS ProcessReference, x.ig AS Ignored,
       CASE WHEN x.ig THEN 'No Item Master addition requested for this excluded code'
            ELSE 'Add SemiItem to Item Master and confirm Process' END AS RequiredAction
FROM semis s JOIN (SELECT SemiBom, regexp_matches(SemiItem, '^(2GC|2XI|2WA|2DU|2EP|2GD|2GH|2VS|2TD|2XD|2DG|2ME|3|9)')
                          OR regexp_matches(SemiItem, '(-01|-02)$') AS ig FROM semis) x ON s.SemiBom = x.SemiBom
WHERE n % 3 = 0
""",
    ("semis",),
)
def missing_master(inp: Inputs):
    semis = inp.semis.select("SemiBom", "SemiItem", "n", "Process")
    master = semis.filter("n % 3 <> 0").select(F.col("SemiItem").alias("Item"))
    audit = P.missing_master_audit(semis.drop("Process"), master, semis.filter("n % 5 <> 0"))
    return shown(audit, "SemiBom", "SemiItem", "ProcessReference", "Ignored", "RequiredAction")


@query(
    """
SELECT SemiBom, CASE WHEN n % 14 = 0 THEN 'BOM_SUFFIX_-01' WHEN n % 9 = 0 THEN 'PREFIX_2GC' WHEN n % 9 = 2 THEN 'PREFIX_3' ELSE '' END AS Rule,
       n % 14 = 0 OR n % 9 IN (0, 2) AS Excluded,
       CASE n % 9 WHEN 1 THEN 'Bright Cut' WHEN 0 THEN NULL WHEN 2 THEN NULL ELSE 'Sanding' END AS PrefixProcess
FROM semis
""",
    ("semis",),
)
def semi_scope(inp: Inputs):
    item = F.col("SemiItem")
    return shown(
        inp.semis.select(
            "SemiBom",
            P.scope_rule(item, F.col("SemiBom")).alias("Rule"),
            P.scope_excluded(item, F.col("SemiBom")).alias("Excluded"),
            P.process_from_prefix(item, F.lit(None).cast("string")).alias("PrefixProcess"),
        )
    )


HOURS_CTE = """per AS (SELECT WO, RoundNo, Worker, sum(Final) AS WorkerHours FROM worker_hours
  WHERE upper(trim(WO)) <> 'OTHER' AND Worker IS NOT NULL GROUP BY 1, 2, 3),
wr AS (SELECT *, sum(WorkerHours) OVER (PARTITION BY WO, RoundNo) AS TotalRoundHours,
       CAST(count(*) OVER (PARTITION BY WO, RoundNo) AS BIGINT) AS RoundWorkerCount FROM per)"""


@query(
    f"""
WITH {HOURS_CTE}
SELECT WO, RoundNo, Worker, round(WorkerHours, 6) AS WorkerHours, round(TotalRoundHours, 6) AS TotalRoundHours, RoundWorkerCount FROM wr
""",
    ("worker_hours",),
)
def worker_round_hours(inp: Inputs):
    return shown(P.worker_round_hours(inp.worker_hours))


@query(
    f"""
WITH {HOURS_CTE}
SELECT wr.WO, wr.RoundNo, wr.Worker, round(coalesce(GoodPieces, 0) / RoundWorkerCount, 6) AS EqualQty,
       round(WorkerHours / TotalRoundHours * coalesce(GoodPieces, 0), 6) AS HoursQty,
       CASE WHEN o.WO IS NULL THEN 'left_only' ELSE 'both' END AS OrderJoinStatus
FROM wr LEFT JOIN (SELECT * FROM work_orders WHERE Status <> 'Started') o ON wr.WO = o.WO
""",
    ("worker_hours", "work_orders"),
)
def allocate_quantity(inp: Inputs):
    rounds = P.worker_round_hours(inp.worker_hours)
    orders = inp.work_orders.filter("Status <> 'Started'")
    equal = P.allocate_quantity(rounds, orders).withColumnRenamed("Qty", "EqualQty")
    by_hours = P.allocate_quantity(rounds, orders, by_hours=True, check=False).select(
        "WO", "RoundNo", "Worker", F.col("Qty").alias("HoursQty")
    )
    both = equal.join(by_hours, ["WO", "RoundNo", "Worker"])
    return shown(both, "WO", "RoundNo", "Worker", "EqualQty", "HoursQty", "OrderJoinStatus")


@query(
    f"""
WITH {HOURS_CTE}
SELECT RoundNo, CAST(count(*) AS BIGINT) AS UnmatchedRows, CAST(count(DISTINCT wr.WO) AS BIGINT) AS Orders
FROM wr WHERE WO NOT IN (SELECT WO FROM work_orders WHERE Status <> 'Started') GROUP BY 1
""",
    ("worker_hours", "work_orders"),
)
def unmatched_orders(inp: Inputs):
    joined = P.allocate_quantity(P.worker_round_hours(inp.worker_hours), inp.work_orders.filter("Status <> 'Started'"))
    return shown(
        P.unmatched_rows(joined)
        .groupBy("RoundNo")
        .agg(F.count("*").alias("UnmatchedRows"), F.count_distinct("WO").alias("Orders"))
    )


@query(
    """
SELECT a.Process, CAST(count(*) AS BIGINT) AS RowCount, CAST(count(s.Skill) AS BIGINT) AS WithSkill, round(avg(s.Skill), 6) AS MeanSkill
FROM assignment a LEFT JOIN (SELECT * FROM skills WHERE Skill IS NOT NULL) s ON a.Worker = s.Worker AND a.Process = s.Process GROUP BY 1
""",
    ("assignment", "skills"),
)
def skill_attach(inp: Inputs):
    rows = P.attach_skill(inp.assignment, P.clean_skills(inp.skills))
    return shown(
        rows.groupBy("Process").agg(
            F.count("*").alias("RowCount"), F.count("CertifiedSkill").alias("WithSkill"), F.avg("CertifiedSkill").alias("MeanSkill")
        )
    )


@query(
    """
WITH e AS (SELECT Worker, Process, avg(ln(Hours / Qty)) AS Effect FROM assignment GROUP BY 1, 2)
SELECT coalesce(e.Worker, s.Worker) AS Worker, coalesce(e.Process, s.Process) AS Process, round(e.Effect, 6) AS Effect, s.Skill
FROM e FULL OUTER JOIN (SELECT * FROM skills WHERE Skill IS NOT NULL) s ON e.Worker = s.Worker AND e.Process = s.Process
""",
    ("assignment", "skills"),
)
def worker_report_outer(inp: Inputs):
    effects = P.with_time_features(inp.assignment).groupBy("Worker", "Process").agg(F.avg("LogTime").alias("Effect"))
    return shown(P.worker_report(effects, P.clean_skills(inp.skills)))


@query(
    """
SELECT WO, RoundNo, Worker, round(Hours, 6) AS Hours FROM (
  SELECT WO, RoundNo, Worker, Hours, row_number() OVER (PARTITION BY WO, RoundNo ORDER BY Hours DESC, Worker) AS rn FROM assignment) t
WHERE rn = 1
""",
    ("assignment",),
)
def primary_worker_row(inp: Inputs):
    rows = inp.assignment.select("WO", "RoundNo", "Worker", "Hours")
    return shown(P.primary_row(rows, ["WO", "RoundNo"], "Hours", "Worker"))


@query(
    """
SELECT CASE WHEN o_orderkey % 10 = 0 THEN concat('unlinked-row:', o_orderkey) ELSE concat('WO', o_orderkey) END AS TrajectoryKey,
       o_orderkey % 10 <> 0 AS WoEligible, 'v1' AS ModelVersion, '2001-08-01' AS SourceCutoff, 'Diagnostic Only' AS ApprovalStatus,
       'Not assessed' AS Extrapolation
FROM orders
"""
)
def stamped_trajectories(inp: Inputs):
    ref = F.when(F.col("o_orderkey") % 20 == 0, " dummy-7").when(F.col("o_orderkey") % 20 == 10, " ").otherwise(
        F.concat(F.lit("WO"), "o_orderkey")
    )
    key, real = P.trajectory_key(ref, F.col("o_orderkey"))
    rows = inp.raw("orders").select(key.alias("TrajectoryKey"), real.alias("WoEligible"))
    stamped = P.stamp(rows, "v1", "2001-08-01")
    return shown(stamped, "TrajectoryKey", "WoEligible", "ModelVersion", "SourceCutoff", "ApprovalStatus", "Extrapolation")
