"""Attribution, split and as-of queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.catalog.qc import TICKET_CTE, reconstruction
from assayer.catalog.qc import CUTOFF as QC_CUTOFF
from assayer.catalog.registry import Inputs, query, shown
from assayer.operators import attribution as A
from assayer.operators import production as P
from assayer.operators import splits as S

VERIFIED = "1999-01-01"


def rounds(inp: Inputs):
    return reconstruction(inp, cutoff=QC_CUTOFF).rounds


def rounds_once(inp: Inputs):
    """The rounds for a query that reads them once: not written, and only the columns it takes."""
    return reconstruction(inp, cutoff=QC_CUTOFF, once=True).rounds


WR_CTE = """
wr AS (SELECT WO, RoundNo, Worker, sum(Hours) AS Hours, sum(Qty) AS QtyDoing FROM assignment GROUP BY 1, 2, 3),
wrn AS (SELECT *, count(*) OVER (PARTITION BY WO, RoundNo) AS n FROM wr)"""


@query(
    f"""
WITH {TICKET_CTE}, {WR_CTE}
SELECT r.WO, r.RoundNo, Worker, round(Hours, 6) AS Hours, round(QtyDoing, 6) AS QtyDoing, CAST(n AS BIGINT) AS WorkersInRound,
  CASE WHEN Worker IS NULL THEN 'No production round match' WHEN n = 1 THEN 'Single worker in WO-round' ELSE 'Multiple workers in WO-round' END AS WorkerAttributionStatus
FROM rounds r LEFT JOIN wrn ON r.WO = wrn.WO AND r.RoundNo = wrn.RoundNo
""",
    ("qc_tickets", "assignment"),
)
def worker_round_attribution(inp: Inputs):
    linked = A.link_rounds(rounds(inp), inp.assignment)
    return shown(linked, "WO", "RoundNo", "Worker", "Hours", "QtyDoing", "WorkersInRound", "WorkerAttributionStatus")


@query(
    f"""
WITH {TICKET_CTE}, {WR_CTE}
SELECT f.WO, w.Worker, round(w.Hours, 6) AS Round1WorkerHours, s.Skill,
  CASE WHEN w.Worker IS NULL THEN 'Missing or multiple production workers in RoundNo=1' ELSE 'Single production worker in RoundNo=1' END AS AttributionStatus
FROM firsts f LEFT JOIN (SELECT * FROM wrn WHERE RoundNo = 1 AND n = 1) w ON f.WO = w.WO LEFT JOIN skills s ON s.Worker = w.Worker AND s.Process = f.Process
""",
    ("qc_tickets", "assignment", "skills"),
)
def first_round_worker(inp: Inputs):
    first = reconstruction(inp, cutoff=QC_CUTOFF).first
    joined = A.attach_first_worker(first, inp.assignment, inp.skills)
    return shown(joined, "WO", "Worker", "Round1WorkerHours", "Skill", "AttributionStatus")


TEAM_CTE = """
teams AS (SELECT DISTINCT WO, RoundNo, Item, Process, Worker FROM assignment),
att AS (SELECT r.*, coalesce(t.n, 0) AS TeamSize, CASE WHEN t.n = 1 THEN t.w END AS Worker, CASE WHEN t.n = 1 THEN 'single' WHEN t.n > 1 THEN 'team' ELSE 'unknown' END AS Attribution,
  CASE WHEN r.RoundNo = 1 THEN 'First pass' ELSE 'Rework' END AS Branch FROM rounds r LEFT JOIN
  (SELECT WO, RoundNo, Item, Process, count(*) AS n, min(Worker) AS w FROM teams GROUP BY 1, 2, 3, 4) t
  ON r.WO = t.WO AND r.RoundNo = t.RoundNo AND r.Item = t.Item AND r.Process = t.Process)"""


@query(
    f"""
WITH {TICKET_CTE}, {TEAM_CTE}
SELECT WO, RoundNo, Branch, CAST(TeamSize AS BIGINT) AS TeamSize, Worker, Attribution FROM att
""",
    ("qc_tickets", "assignment"),
)
def worker_sets(inp: Inputs):
    return shown(A.attribute_rounds(rounds(inp), inp.assignment), "WO", "RoundNo", "Branch", "TeamSize", "Worker", "Attribution")


PLAN_CTE = f"""
crew AS (SELECT WO, RoundNo, count(DISTINCT Worker) AS n, min(Worker) AS w, min(Process) AS p0, max(Process) AS p1 FROM assignment GROUP BY 1, 2),
pl AS (SELECT r.*, coalesce(n, 0) AS n, CASE WHEN n > 1 THEN 'team' WHEN n = 1 AND p0 = r.Process AND p1 = r.Process AND EXISTS (SELECT 1 FROM assignment a
   WHERE a.WO = r.WO AND a.RoundNo = r.RoundNo AND a.Item = r.Item) THEN 'single' ELSE 'unknown' END AS Attribution, w FROM rounds r LEFT JOIN crew c ON r.WO = c.WO AND r.RoundNo = c.RoundNo),
plan AS (SELECT pl.* EXCLUDE (w), CASE WHEN Attribution = 'single' THEN w END AS Worker, s.Skill AS CertifiedSkill FROM pl LEFT JOIN skills s
   ON s.Worker = CASE WHEN Attribution = 'single' THEN w END AND s.Process = pl.Process),
planned AS (SELECT *, CASE WHEN Attribution <> 'single' THEN 'NO_SINGLE_PRODUCTION_WORKER' WHEN CertifiedSkill IS NULL THEN 'MISSING_PLANNER_SKILL' ELSE 'VERIFIED_PLANNER_0_10' END AS PlannerSkillStatus,
  CASE WHEN QcStart < TIMESTAMP '{VERIFIED} 00:00:00' THEN 'PRE_VERIFICATION' ELSE 'POST_VERIFICATION' END AS Period, CASE WHEN RoundNo = 1 THEN 'FIRST_PASS' ELSE 'REWORK' END AS Branch,
  CASE Attribution WHEN 'team' THEN 'AUDIT_ONLY_MULTIPLE_WORKERS' WHEN 'unknown' THEN 'AUDIT_ONLY_NO_ROUND_WORKER' ELSE 'ELIGIBLE' END AS Eligibility FROM plan)"""


def planned(inp: Inputs, source=rounds):
    return A.planner_rounds(source(inp), inp.assignment, inp.skills, VERIFIED)


@query(
    f"""
WITH {TICKET_CTE}, {PLAN_CTE}
SELECT WO, RoundNo, CAST(n AS BIGINT) AS WorkersInRound, Attribution, Worker, CertifiedSkill, PlannerSkillStatus, Period,
  CertifiedSkill IS NOT NULL AND Period = 'PRE_VERIFICATION' AS RetrospectivePlanner, Eligibility FROM planned
""",
    ("qc_tickets", "assignment", "skills"),
)
def planner_round_eligibility(inp: Inputs):
    return shown(
        planned(inp), "WO", "RoundNo", "WorkersInRound", "Attribution", "Worker", "CertifiedSkill", "PlannerSkillStatus", "Period",
        "RetrospectivePlanner", "Eligibility",
    )


@query(
    f"""
WITH {TICKET_CTE}, {PLAN_CTE}
SELECT Process, Branch, Eligibility, PlannerSkillStatus, Period, CAST(count(DISTINCT WO) AS BIGINT) AS WOs, CAST(count(*) AS BIGINT) AS Rounds, sum(PassQty + FailQty) AS QCPieces
FROM planned GROUP BY 1, 2, 3, 4, 5
""",
    ("qc_tickets", "assignment", "skills"),
)
def planner_coverage(inp: Inputs):
    checked = A.check_observations(planned(inp))
    return shown(A.coverage_orders(checked, ["Process", "Branch", "Eligibility", "PlannerSkillStatus", "Period"]))


@query(
    f"""
WITH {TICKET_CTE}, {TEAM_CTE}
SELECT Process, Branch, Attribution, CAST(count(*) AS BIGINT) AS Rounds, sum(PassQty + FailQty) AS Pieces, CAST(count(DISTINCT SizeAdjustedGroup) AS BIGINT) AS Groups
FROM att GROUP BY 1, 2, 3
""",
    ("qc_tickets", "assignment"),
)
def attribution_coverage(inp: Inputs):
    return shown(A.coverage(A.attribute_rounds(rounds(inp), inp.assignment), ["Process", "Branch", "Attribution"]))


@query(
    f"""
WITH {TICKET_CTE}, {TEAM_CTE}
SELECT strftime(QcStop, '%Y-%m-%d') AS Day, CAST(count(CASE WHEN Attribution = 'single' THEN 1 END) AS BIGINT) AS single,
  CAST(count(CASE WHEN Attribution = 'team' THEN 1 END) AS BIGINT) AS team, CAST(count(CASE WHEN Attribution = 'unknown' THEN 1 END) AS BIGINT) AS unknown FROM att GROUP BY 1
""",
    ("qc_tickets", "assignment"),
)
def daily_attribution(inp: Inputs):
    return shown(A.daily_attribution(A.attribute_rounds(rounds(inp), inp.assignment)))


@query(
    f"""
WITH {TICKET_CTE}, bad AS (SELECT DISTINCT WO, RoundNo FROM qc_tickets WHERE CAST(substr(WO, 3) AS BIGINT) % 11 = 0)
SELECT CAST((SELECT count(*) FROM bad) AS BIGINT) AS SourceHardErrorRounds,
  CAST((SELECT count(*) FROM rounds r WHERE EXISTS (SELECT 1 FROM bad b WHERE b.WO = r.WO AND b.RoundNo = r.RoundNo)) AS BIGINT) AS RetainedHardErrorRounds
""",
    ("qc_tickets",),
)
def hard_error_rounds(inp: Inputs):
    flagged = inp.qc_tickets.filter("CAST(substr(WO, 3) AS BIGINT) % 11 = 0")
    return shown(A.hard_error_audit(flagged, rounds(inp)))


@query(
    """
WITH a AS (SELECT DISTINCT WO, RoundNo, Process, Worker, OrderDate AS QcStart FROM (SELECT WO, RoundNo, Process, Worker, RafMonth AS OrderDate,
    row_number() OVER (PARTITION BY WO, RoundNo ORDER BY Worker, RafMonth, Process) AS rn FROM assignment) x WHERE rn = 1),
j AS (SELECT a.*, h.Skill, h.EffectiveFrom FROM a LEFT JOIN skill_history h ON a.Worker = h.Worker AND a.Process = h.Process)
SELECT WO, RoundNo, round(coalesce(arg_max(Skill, EffectiveFrom) FILTER (WHERE EffectiveFrom <= QcStart), arg_min(Skill, EffectiveFrom)), 6) AS CertifiedSkill,
  CASE WHEN count(CASE WHEN EffectiveFrom <= QcStart THEN 1 END) > 0 THEN 'Dated snapshot available at QC start'
       WHEN count(Skill) > 0 THEN 'Baseline snapshot applied (prior to verification date)' ELSE 'Missing historical skill' END AS SkillAsOfStatus
FROM j GROUP BY 1, 2
""",
    ("assignment", "skill_history"),
)
def asof_skill(inp: Inputs):
    row = inp.assignment.groupBy("WO", "RoundNo").agg(F.min(F.struct("Worker", "RafMonth", "Process")).alias("x"))
    facts = row.select("WO", "RoundNo", "x.Worker", "x.Process", F.col("x.RafMonth").alias("QcStart"))
    return shown(A.attach_asof_skill(facts, inp.skill_history), "WO", "RoundNo", "CertifiedSkill", "SkillAsOfStatus")


@query(
    f"""
WITH {TICKET_CTE}, {PLAN_CTE}
SELECT Process, round(stddev_samp(CertifiedSkill), 6) AS SkillSd, CAST(count(*) AS BIGINT) AS TrainingRounds FROM planned WHERE CertifiedSkill IS NOT NULL GROUP BY 1
""",
    ("qc_tickets", "assignment", "skills"),
)
def skill_scaler(inp: Inputs):
    return shown(S.skill_scaler(planned(inp)))


@query(
    f"""
WITH {TICKET_CTE}, names AS (SELECT WO, string_agg(DISTINCT Worker, '; ' ORDER BY Worker) AS ProductionWorkers, count(DISTINCT Worker) AS n, min(Worker) AS w
  FROM assignment WHERE RoundNo = 1 GROUP BY 1)
SELECT f.WO, f.Item, ProductionWorkers, f.Process, strftime(QcStart, '%Y-%m-%d') AS FirstQcDate, PassQty, FailQty, PassQty + FailQty AS InspectedQty,
  round(PassQty / (PassQty + FailQty), 6) AS FPY, s.Skill AS VerifiedSkill
FROM firsts f LEFT JOIN names ON f.WO = names.WO LEFT JOIN skills s ON n = 1 AND s.Worker = w AND s.Process = f.Process
""",
    ("qc_tickets", "assignment", "skills"),
)
def order_summary(inp: Inputs):
    done = rounds(inp)
    links = A.link_rounds(done, inp.assignment)
    return shown(A.order_summary(done, links, inp.skills))


@query(
    f"""
WITH {TICKET_CTE}, {TEAM_CTE}, {PLAN_CTE}
SELECT att.Attribution AS OldAttribution, planned.Attribution AS NewAttribution, CAST(count(*) AS BIGINT) AS Rounds
FROM att JOIN planned ON att.WO = planned.WO AND att.RoundNo = planned.RoundNo GROUP BY 1, 2
""",
    ("qc_tickets", "assignment", "skills"),
)
def attribution_transitions(inp: Inputs):
    done = rounds(inp)
    old = A.attribute_rounds(done, inp.assignment)
    return shown(A.snapshot_transitions(old, A.planner_rounds(done, inp.assignment, inp.skills, VERIFIED)))


@query(
    """
WITH sp AS (SELECT WO, min(RafMonth) a, max(RafMonth) b, count(*) n FROM production GROUP BY 1),
d AS (SELECT a, row_number() OVER (ORDER BY a) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT a FROM sp) x),
c AS (SELECT max(CASE WHEN i = least(greatest(CAST(floor(m * 0.8) AS BIGINT), 1), m - 1) THEN a END) AS cut FROM d)
SELECT CASE WHEN b < cut THEN 'train' WHEN a >= cut THEN 'test' ELSE 'embargo' END AS Split, CAST(count(*) AS BIGINT) AS Orders, CAST(sum(n) AS BIGINT) AS Lines
FROM sp, c GROUP BY 1
""",
    ("production",),
)
def chronological_split(inp: Inputs):
    labelled = S.chronological_split(inp.production, "RafMonth", "WO")
    return shown(labelled.groupBy("Split").agg(F.count_distinct("WO").alias("Orders"), F.count("*").alias("Lines")))


@query(
    f"""
WITH {TICKET_CTE}, sp AS (SELECT Process, WO, date_trunc('day', min(QcStart)) AS dy, min(QcStart) a, max(QcStop) b FROM rounds GROUP BY 1, 2),
d AS (SELECT Process, dy, row_number() OVER (PARTITION BY Process ORDER BY dy) - 1 AS i, count(*) OVER (PARTITION BY Process) AS m FROM (SELECT DISTINCT Process, dy FROM sp) x),
c AS (SELECT Process, max(CASE WHEN i = floor(m * 0.6) THEN dy END) c1, max(CASE WHEN i = floor(m * 0.8) THEN dy END) c2, max(m) AS m FROM d GROUP BY 1)
SELECT WO, CASE WHEN m < 5 THEN 'insufficient_dates' WHEN b < c1 THEN 'train' WHEN a >= c1 AND b < c2 THEN 'validation' WHEN a >= c2 THEN 'test' ELSE 'embargo' END AS Split
FROM sp JOIN c ON sp.Process = c.Process
""",
    ("qc_tickets",),
)
def split_60_20_20(inp: Inputs):
    return shown(S.three_way_split(rounds(inp), by=["Process"]).select("WO", "Split").distinct())


@query(
    """
WITH sp AS (SELECT WO, min(RafMonth) a, max(RafMonth) b FROM production GROUP BY 1),
d AS (SELECT a, row_number() OVER (ORDER BY a) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT date_trunc('day', a) AS a FROM sp WHERE a >= TIMESTAMP '1996-01-01') x),
c AS (SELECT max(CASE WHEN i = floor(m * 0.5) THEN a END) c1, max(CASE WHEN i = floor(m * 0.7) THEN a END) c2, max(CASE WHEN i = floor(m * 0.85) THEN a END) c3 FROM d)
SELECT CASE WHEN b < c1 THEN 'train' WHEN a >= c1 AND b < c2 THEN 'tune' WHEN a >= c2 AND b < c3 THEN 'calibration' WHEN a >= c3 THEN 'test' ELSE 'embargo' END AS Split,
  CAST(count(*) AS BIGINT) AS Orders FROM sp, c GROUP BY 1
""",
    ("production",),
)
def split_four_windows(inp: Inputs):
    labelled = S.four_windows(inp.production, "RafMonth", F.lit("1996-01-01").cast("timestamp_ntz"))
    return shown(labelled.groupBy("Split").agg(F.count_distinct("WO").alias("Orders")))


@query(
    """
SELECT Process, SizeAdjustedGroup, (row_number() OVER (PARTITION BY Process ORDER BY SizeAdjustedGroup) - 1) % 5 = 0 AND count(*) OVER (PARTITION BY Process) > 1 AS HeldOut
FROM (SELECT DISTINCT Process, SizeAdjustedGroup FROM production) g
""",
    ("production",),
)
def group_holdout(inp: Inputs):
    return shown(S.hold_out_groups(inp.production, "SizeAdjustedGroup", by=["Process"]))


@query(
    """
WITH tr AS (SELECT * FROM network WHERE CAST(substr(WO, 3) AS BIGINT) % 5 = 0), te AS (SELECT * FROM network WHERE CAST(substr(WO, 3) AS BIGINT) % 5 = 1)
SELECT Process, CAST(count(*) AS BIGINT) AS RowCount, CAST(count(CASE WHEN Worker NOT IN (SELECT Worker FROM tr) THEN 1 END) AS BIGINT) AS UnseenWorker,
  CAST(count(CASE WHEN SizeAdjustedGroup NOT IN (SELECT SizeAdjustedGroup FROM tr) THEN 1 END) AS BIGINT) AS UnseenGroup FROM te GROUP BY 1
""",
    ("network",),
)
def unseen_entities(inp: Inputs):
    part = F.substring("WO", 3, 20).cast("bigint") % 5
    train, test = inp.network.filter(part == 0), inp.network.filter(part == 1)
    flagged = S.flag_unseen(S.flag_unseen(test, train, "Worker", "NewWorker"), train, "SizeAdjustedGroup", "NewGroup")
    return shown(
        flagged.groupBy("Process").agg(
            F.count("*").alias("RowCount"), F.count_if("NewWorker").alias("UnseenWorker"), F.count_if("NewGroup").alias("UnseenGroup")
        )
    )


@query(
    """
SELECT CASE WHEN a.Worker IS NULL THEN 'right only' WHEN b.Worker IS NULL THEN 'left only' ELSE 'both' END AS Part, CAST(count(*) AS BIGINT) AS Entities
FROM (SELECT DISTINCT Worker FROM production) a FULL OUTER JOIN (SELECT DISTINCT Worker FROM assignment) b ON a.Worker = b.Worker GROUP BY 1
""",
    ("production", "assignment"),
)
def entity_overlap(inp: Inputs):
    return shown(S.overlap_of(inp.production, inp.assignment, "Worker"))


@query(
    f"""
WITH {TICKET_CTE}, sp AS (SELECT WO, min(QcStart) a, max(QcStop) b FROM rounds GROUP BY 1),
d AS (SELECT dy, row_number() OVER (ORDER BY dy) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT date_trunc('day', a) AS dy FROM sp) x),
c AS (SELECT max(CASE WHEN i = floor(m * 0.6) THEN dy END) c1, max(CASE WHEN i = floor(m * 0.8) THEN dy END) c2 FROM d),
l AS (SELECT r.*, CASE WHEN sp.b < c1 THEN 'train' WHEN sp.a >= c1 AND sp.b < c2 THEN 'validation' WHEN sp.a >= c2 THEN 'test' ELSE 'embargo' END AS Split
  FROM rounds r JOIN sp ON r.WO = sp.WO, c)
SELECT Split, CAST(count(DISTINCT WO) AS BIGINT) AS Entities, strftime(min(QcStart), '%Y-%m-%d %H:%M:%S') AS FirstDate, strftime(max(QcStart), '%Y-%m-%d %H:%M:%S') AS LastDate,
  CAST(0 AS BIGINT) AS SharedEntities FROM l GROUP BY 1
""",
    ("qc_tickets",),
)
def split_leakage_audit(inp: Inputs):
    return shown(S.leakage_audit(S.three_way_split(rounds(inp)), "QcStart"))


@query(
    f"""
WITH {TICKET_CTE}
SELECT Process, CAST(count(*) AS BIGINT) AS Rounds, sum(PassQty) AS PassQty FROM rounds WHERE QcStop <= TIMESTAMP '1999-06-30 12:00:00' GROUP BY 1
""",
    ("qc_tickets",),
)
def synchronised_window(inp: Inputs):
    kept = S.through(rounds(inp), "1999-06-30 12:00:00")
    return shown(kept.groupBy("Process").agg(F.count("*").alias("Rounds"), F.sum("PassQty").alias("PassQty")))


@query()
def fold_assignment(inp: Inputs):
    """Rows per deterministic fold (hash folds have no counterpart in the checker)."""
    folds = inp.raw("lineitem").select(S.fold_of(42, 3, "l_orderkey", "l_linenumber", "l_partkey").alias("Fold"), "l_quantity")
    return shown(folds.groupBy("Fold").agg(F.count("*").alias("RowCount"), F.sum("l_quantity").alias("Qty")))
