"""Inspection queries: tickets, rounds, yield, recovery, dispositions, labour intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.catalog.registry import Inputs, query, shown
from assayer.operators import qc as Q
from assayer.operators import touch as T

CUTOFF = "2001-07-01 00:00:00"


def tickets(inp: Inputs):
    return Q.normalise_tickets(inp.qc_tickets)


def reconstruction(inp: Inputs, **options):
    return Q.reconstruct(tickets(inp), **options)


# Independent SQL twin of the whole reconstruction.
TICKET_CTE = f"""
typed AS (SELECT t.*, lower(trim(coalesce(Description, ''))) AS txt,
  CASE lower(trim(coalesce(Description, ''))) WHEN '' THEN lower(Status) WHEN 'đạt' THEN 'pass' WHEN 'sửa' THEN 'fail'
    WHEN 'hỏng' THEN 'fail' END AS st FROM qc_tickets t),
flagged AS (SELECT *, QcStop > TIMESTAMP '{CUTOFF}' AS fut, (QcStop < QcStart OR st IS NULL OR Qty < 0 OR ExpectedQty <= 0
  OR count(*) OVER (PARTITION BY TicketId) > 1) AS bad FROM typed),
reasoned AS (SELECT *, CASE WHEN fut THEN 'After source cutoff'
  WHEN bool_or(bad AND NOT fut) OVER (PARTITION BY WO) OR bad THEN 'Invalid ticket or WO; inspect source' END AS Reason FROM flagged),
clean AS (SELECT * FROM reasoned WHERE Reason IS NULL),
tot AS (SELECT WO, RoundNo, min(Item) AS Item, min(Process) AS Process, min(SizeAdjustedGroup) AS SizeAdjustedGroup,
  sum(CASE WHEN st = 'pass' THEN Qty ELSE 0 END) AS PassQty, sum(CASE WHEN st = 'fail' THEN Qty ELSE 0 END) AS FailQty,
  min(ExpectedQty) AS e0, max(ExpectedQty) AS e1, min(QcStart) AS QcStart, max(QcStop) AS QcStop FROM clean GROUP BY 1, 2),
prev AS (SELECT *, lag(QcStop) OVER w AS ps, lag(FailQty) OVER w AS pf, row_number() OVER w AS rn FROM tot
  WINDOW w AS (PARTITION BY WO ORDER BY RoundNo)),
flaw AS (SELECT *, CASE WHEN rn > 1 AND (QcStart <= ps OR PassQty + FailQty > pf + 1e-8)
    THEN 'Invalid round timing or reinspected quantity exceeds prior failures'
  WHEN e0 <> e1 OR abs(PassQty + FailQty - e0) > 1e-8 + 1e-5 * e0 THEN 'Round quantity reconciliation failure' END AS fl FROM prev),
traj AS (SELECT WO, CASE WHEN sum(CASE WHEN rn > 1 THEN PassQty ELSE 0 END) > min(CASE WHEN rn = 1 THEN FailQty END) + 1e-8
    THEN 'Recovered quantity exceeds first fail quantity'
  WHEN count(fl) > 0 THEN arg_max(fl, RoundNo) FILTER (WHERE fl IS NOT NULL)
  WHEN min(RoundNo) <> 1 OR max(RoundNo) <> count(*) THEN 'Round continuity failure' END AS tr FROM flaw GROUP BY WO),
rounds AS (SELECT tot.* FROM tot JOIN traj ON tot.WO = traj.WO WHERE tr IS NULL),
firsts AS (SELECT * FROM rounds WHERE RoundNo = 1)"""


@query(
    f"""
WITH {TICKET_CTE}
SELECT TicketId, Reason FROM reasoned
""",
    ("qc_tickets",),
)
def qc_valid_tickets(inp: Inputs):
    return shown(Q.flag_tickets(tickets(inp), CUTOFF), "TicketId", "Reason")


@query(
    f"""
WITH {TICKET_CTE}
SELECT WO, RoundNo, Item, Process, SizeAdjustedGroup, PassQty, FailQty, PassQty + FailQty AS InspectedQty,
  strftime(QcStart, '%Y-%m-%d %H:%M:%S') AS QcStart, strftime(QcStop, '%Y-%m-%d %H:%M:%S') AS QcStop FROM rounds
""",
    ("qc_tickets",),
)
def qc_rounds(inp: Inputs):
    return shown(
        reconstruction(inp, cutoff=CUTOFF).rounds,
        "WO", "RoundNo", "Item", "Process", "SizeAdjustedGroup", "PassQty", "FailQty", "InspectedQty", "QcStart", "QcStop",
    )


@query(
    f"""
WITH {TICKET_CTE}
SELECT Reason, CAST(count(*) AS BIGINT) AS Tickets, CAST(count(DISTINCT WO) AS BIGINT) AS Orders
FROM (SELECT WO, Reason FROM reasoned WHERE Reason IS NOT NULL
      UNION ALL SELECT clean.WO, tr FROM clean JOIN traj ON clean.WO = traj.WO WHERE tr IS NOT NULL) x GROUP BY 1
""",
    ("qc_tickets",),
)
def qc_rejections(inp: Inputs):
    rejected = reconstruction(inp, cutoff=CUTOFF).exceptions
    return shown(rejected.groupBy("Reason").agg(F.count("*").alias("Tickets"), F.count_distinct("WO").alias("Orders")))


@query(
    """
SELECT strftime(QcStart, '%Y-%m') = '1998-03' AS Excluded, CAST(count(*) AS BIGINT) AS Tickets, CAST(sum(Qty) AS DOUBLE) AS Qty
FROM qc_tickets GROUP BY 1
""",
    ("qc_tickets",),
)
def qc_month_exclusion(inp: Inputs):
    kept, policy = Q.split_month(tickets(inp), "1998-03")
    both = kept.select("Qty", F.lit(False).alias("Excluded")).unionByName(policy.select("Qty", F.lit(True).alias("Excluded")))
    return shown(both.groupBy("Excluded").agg(F.count("*").alias("Tickets"), F.sum("Qty").alias("Qty")))


@query(
    f"""
WITH {TICKET_CTE}, named AS (SELECT WO, CASE WHEN count(DISTINCT InitialWorker) = 1 THEN max(InitialWorker) END AS Worker FROM clean GROUP BY 1)
SELECT f.WO, f.Process, f.SizeAdjustedGroup, round(PassQty / (PassQty + FailQty), 6) AS FPY, Worker,
  CASE WHEN Worker IS NULL THEN 'Missing or ambiguous initial worker' ELSE 'Explicit initial worker' END AS AttributionStatus
FROM firsts f JOIN named ON f.WO = named.WO
""",
    ("qc_tickets",),
)
def qc_first_round(inp: Inputs):
    first = reconstruction(inp, cutoff=CUTOFF).first
    return shown(first, "WO", "Process", "SizeAdjustedGroup", "FPY", "Worker", "AttributionStatus")


@query(
    """
WITH s AS (SELECT *, coalesce(RoundReworkQty, 0) + coalesce(RoundScrapQty, 0) AS FailQty,
  row_number() OVER (PARTITION BY WO, Item, RoundNo ORDER BY RoundActualQty ASC NULLS LAST, QcStart ASC NULLS LAST, TicketId ASC NULLS LAST) AS rn FROM qc_snapshots)
SELECT WO, RoundNo, arg_max(RoundPassQty, rn) FILTER (WHERE RoundPassQty IS NOT NULL) AS SnapshotPass, arg_max(FailQty, rn) AS SnapshotFail,
  arg_max(RoundScrapQty, rn) FILTER (WHERE RoundScrapQty IS NOT NULL) AS SnapshotScrap,
  arg_max(RoundActualQty, rn) FILTER (WHERE RoundActualQty IS NOT NULL) AS Qty,
  arg_min(TicketId, rn) AS TicketId, arg_min(InitialWorker, rn) FILTER (WHERE InitialWorker IS NOT NULL) AS InitialWorker,
  coalesce(max(CASE WHEN Description = 'đạt' THEN 'Pass' END),
    CASE WHEN arg_max(RoundScrapQty, rn) FILTER (WHERE RoundScrapQty IS NOT NULL) > 0 THEN 'Scrap'
         WHEN arg_max(RoundReworkQty, rn) FILTER (WHERE RoundReworkQty IS NOT NULL) > 0 THEN 'Rework' ELSE 'Pass' END) AS Disposition
FROM s GROUP BY WO, Item, RoundNo
""",
    ("qc_snapshots",),
)
def qc_snapshot_collapse(inp: Inputs):
    rows = Q.collapse_snapshots(inp.qc_snapshots).withColumn("RoundNo", F.col("RoundNo").cast("bigint"))
    return shown(
        rows, "WO", "RoundNo", "SnapshotPass", "SnapshotFail", "SnapshotScrap", "Qty", "TicketId", "InitialWorker", "Disposition"
    )


@query(
    f"""
WITH {TICKET_CTE}, g AS (SELECT Process, SizeAdjustedGroup, NULL AS QcMonth, 'group' AS Level, sum(PassQty) p, sum(PassQty + FailQty) i, count(*) n FROM firsts GROUP BY 1, 2
  UNION ALL SELECT Process, NULL, NULL, 'process', sum(PassQty), sum(PassQty + FailQty), count(*) FROM firsts GROUP BY 1
  UNION ALL SELECT NULL, NULL, strftime(QcStart, '%Y-%m'), 'month', sum(PassQty), sum(PassQty + FailQty), count(*) FROM firsts GROUP BY 3)
SELECT Process, SizeAdjustedGroup, QcMonth, Level, p AS PassQty1, i AS InspectedQty1, CAST(n AS BIGINT) AS QCEvidenceN, round(p / i, 6) AS ObservedFPY FROM g
""",
    ("qc_tickets",),
)
def fpy_grouping_sets(inp: Inputs):
    return shown(Q.yield_summary(reconstruction(inp, cutoff=CUTOFF).first))


@query(
    f"""
WITH {TICKET_CTE}
SELECT Process, SizeAdjustedGroup, sum(PassQty) AS PassQty1, sum(PassQty + FailQty) AS InspectedQty1, CAST(count(*) AS BIGINT) AS QCEvidenceN,
  round(sum(PassQty) / sum(PassQty + FailQty), 6) AS ObservedFPY, round(10 * (1 - sum(PassQty) / sum(PassQty + FailQty)), 6) AS RawDifficulty,
  'Raw FPY fallback; uncalibrated assignment-conditional' AS QualityStatus
FROM firsts GROUP BY 1, 2
""",
    ("qc_tickets",),
)
def raw_difficulty(inp: Inputs):
    return shown(Q.raw_difficulty(Q.group_yield(reconstruction(inp, cutoff=CUTOFF).first)))


TRAJ_CTE = f"""
rec AS (SELECT WO, min(Process) AS Process, min(SizeAdjustedGroup) AS SizeAdjustedGroup, sum(CASE WHEN RoundNo = 1 THEN FailQty END) AS ff,
  sum(CASE WHEN RoundNo >= 2 THEN PassQty ELSE 0 END) AS rq, max(RoundNo) AS rr,
  sum(CASE RoundNo WHEN 2 THEN PassQty WHEN 3 THEN PassQty * 0.65 WHEN 4 THEN PassQty * 0.3 ELSE 0 END) AS num,
  min(CASE WHEN RoundNo = 1 THEN QcStart END) AS s0, arg_max(QcStop, RoundNo) AS s1 FROM rounds GROUP BY WO),
rec2 AS (SELECT *, greatest(0, ff - rq) AS rem, greatest(0, ff - rq) > 0 AND CAST(substr(WO, 3) AS BIGINT) % 4 <> 0 AS op FROM rec),
rec3 AS (SELECT *, CASE WHEN ff > 0 THEN num / ff END AS pe, CASE WHEN ff > 0 THEN CASE WHEN op THEN
  (num + rem * CASE rr + 1 WHEN 2 THEN 1.0 WHEN 3 THEN 0.65 WHEN 4 THEN 0.3 ELSE 0 END) / ff ELSE num / ff END END AS opt FROM rec2)"""


def trajectories(inp: Inputs):
    rounds = reconstruction(inp, cutoff=CUTOFF).rounds
    closed = inp.work_orders.filter("CAST(substr(WO, 3) AS BIGINT) % 4 = 0")
    return Q.recovery_trajectories(rounds, F.lit(CUTOFF).cast("timestamp_ntz"), closed)


@query(
    f"""
WITH {TICKET_CTE}, {TRAJ_CTE}
SELECT WO, ff AS FirstFailQty, rq AS RecoveredQty, rem AS RemainingFailQty, op AS OpenWO, rr AS RoundsReached, round(num, 6) AS RecoveryNumerator,
  round(CASE WHEN ff > 0 AND NOT op THEN 10 * (1 - pe) END, 6) AS ObservedRecoveryDifficulty, round(pe, 6) AS RecoveryIndexPessimistic,
  round(opt, 6) AS RecoveryIndexOptimistic, round(10 * (opt - pe), 6) AS RecoverySensitivityRange,
  round(epoch(TIMESTAMP '{CUTOFF}' - s0) / 86400, 6) AS AgeDays, round(epoch(TIMESTAMP '{CUTOFF}' - s1) / 86400, 6) AS DaysSinceLastQC,
  CASE WHEN ff = 0 THEN 'No rework evidence' WHEN op THEN 'Open / right-censored' ELSE 'Observed Recovery Only' END AS RecoveryStatus FROM rec3
""",
    ("qc_tickets",),
)
def recovery_trajectory(inp: Inputs):
    return shown(
        trajectories(inp), "WO", "FirstFailQty", "RecoveredQty", "RemainingFailQty", "OpenWO", "RoundsReached", "RecoveryNumerator",
        "ObservedRecoveryDifficulty", "RecoveryIndexPessimistic", "RecoveryIndexOptimistic", "RecoverySensitivityRange",
        "AgeDays", "DaysSinceLastQC", "RecoveryStatus",
    )


@query(
    f"""
WITH {TICKET_CTE}, {TRAJ_CTE}, g AS (SELECT Process, SizeAdjustedGroup,
  10 * (1 - sum(CASE WHEN NOT op AND ff > 0 THEN round(num * 100) END) / 100 / sum(CASE WHEN NOT op AND ff > 0 THEN ff END)) AS d, avg(CASE WHEN op THEN 1.0 ELSE 0.0 END) AS orate,
  count(CASE WHEN NOT op AND ff > 0 THEN 1 END) AS n, sum(ff) AS ff, CASE WHEN sum(ff) > 0 THEN sum(round(num * 100)) / 100 / sum(ff) END AS pe,
  CASE WHEN sum(ff) > 0 THEN coalesce(sum(round(opt * ff * 100)), 0) / 100 / sum(ff) END AS opt FROM rec3 GROUP BY 1, 2)
SELECT Process, SizeAdjustedGroup, round(d, 6) AS ObservedRecoveryDifficulty, round(orate, 6) AS OpenWORate, CAST(n AS BIGINT) AS ClosedRecoveryEvidenceN,
  ff AS FirstFailQty, round(pe, 6) AS RecoveryIndexPessimistic, round(opt, 6) AS RecoveryIndexOptimistic, round(10 * (opt - pe), 6) AS RecoverySensitivityRange,
  CASE WHEN 10 * (opt - pe) > 2 THEN 'RecoveryUnstable' WHEN orate <= 0.5 AND 10 * (opt - pe) <= 2 AND d IS NOT NULL THEN 'Pilot Provisional'
       ELSE 'RecoveryDiagnosticOnly' END AS RecoveryStabilityFlag FROM g
""",
    ("qc_tickets",),
)
def recovery_group(inp: Inputs):
    return shown(Q.recovery_groups(trajectories(inp), open_threshold=0.5, sensitivity_threshold=2.0, approvals=True))


CLASS_CTE = """
d AS (SELECT *, lower(trim(coalesce(Description, ''))) AS txt, CASE lower(trim(coalesce(Description, ''))) WHEN 'đạt' THEN 'Pass' WHEN 'sửa' THEN 'Rework'
  WHEN 'hỏng' THEN 'Scrap' WHEN '' THEN CASE lower(Status) WHEN 'pass' THEN 'Pass' WHEN 'fail' THEN 'Rework' END END AS Disposition FROM qc_tickets),
c AS (SELECT *, Disposition IS NOT NULL AND Qty >= 0 AS ok FROM d),
r AS (SELECT WO, Item, RoundNo, count(*) AS n, bool_and(ok) AS allok, coalesce(sum(CASE WHEN ok THEN CASE WHEN Disposition = 'Pass' THEN Qty ELSE 0 END END), 0) AS p,
  coalesce(sum(CASE WHEN ok THEN CASE WHEN Disposition = 'Rework' THEN Qty ELSE 0 END END), 0) AS w,
  coalesce(sum(CASE WHEN ok THEN CASE WHEN Disposition = 'Scrap' THEN Qty ELSE 0 END END), 0) AS s, min(ExpectedQty) AS e, count(DISTINCT ExpectedQty) AS ev FROM c GROUP BY 1, 2, 3)"""


@query(
    f"""
WITH {CLASS_CTE}
SELECT WO, RoundNo, CAST(n AS BIGINT) AS TicketCount, allok AS AllTicketsValid, CASE WHEN allok THEN p END AS PassQty, CASE WHEN allok THEN w END AS ReworkQty,
  CASE WHEN allok THEN s END AS ScrapQty, CASE WHEN allok THEN p + w + s END AS ActualQty, e AS ExpectedQty, ev = 1 AND p + w + s = e AND allok AS QuantityReconciled FROM r
""",
    ("qc_tickets",),
)
def disposition_review(inp: Inputs):
    rows = Q.disposition_rounds(Q.classify_dispositions(inp.qc_tickets))
    return shown(
        rows, "WO", "RoundNo", "TicketCount", "AllTicketsValid", "PassQty", "ReworkQty", "ScrapQty", "ActualQty", "ExpectedQty",
        "QuantityReconciled",
    )


@query(
    f"""
WITH {CLASS_CTE}
SELECT 'tickets' AS Metric, CAST(count(*) AS DOUBLE) AS Value FROM c
UNION ALL SELECT 'quantity ' || k, sum(CASE WHEN ok AND Disposition = k THEN Qty ELSE 0 END) FROM c, (VALUES ('Pass'), ('Rework'), ('Scrap')) v(k) GROUP BY k
UNION ALL SELECT 'invalid tickets', count(CASE WHEN NOT ok THEN 1 END) FROM c
UNION ALL SELECT 'duplicate ticket rows', count(*) - count(DISTINCT TicketId) FROM c
UNION ALL SELECT 'description status conflicts', count(CASE WHEN (txt = 'đạt' AND Status = 'Fail') OR (txt IN ('sửa', 'hỏng') AND Status = 'Pass') THEN 1 END) FROM c
UNION ALL SELECT 'rounds', count(*) FROM r
UNION ALL SELECT 'rounds not reconciled', count(CASE WHEN NOT (ev = 1 AND p + w + s = e AND allok) THEN 1 END) FROM r
""",
    ("qc_tickets",),
)
def disposition_statistics(inp: Inputs):
    classified = Q.classify_dispositions(inp.qc_tickets)
    return shown(Q.disposition_summary(classified, Q.disposition_rounds(classified)))


@query(
    """
SELECT e.EventId, e.WorkerStart <= e.WorkerStop AS Proper, (SELECT count(*) FROM touches o WHERE o.WO = e.WO AND o.Worker = e.Worker
  AND o.WorkerStart < e.WorkerStop AND o.WorkerStop > e.WorkerStart) > 1 AS Overlaps FROM touches e WHERE e.WorkerStart <= e.WorkerStop
""",
    ("touches",),
)
def touch_overlap(inp: Inputs):
    flagged = T.flag_overlaps(inp.touches).withColumn("Proper", F.col("WorkerStart") <= F.col("WorkerStop"))
    return shown(flagged.filter("Proper"), "EventId", "Proper", "Overlaps")


TOUCH_CTE = f"""{TICKET_CTE},
sp AS (SELECT *, lead(QcStart) OVER (PARTITION BY WO ORDER BY RoundNo) AS nx, lead(RoundNo) OVER (PARTITION BY WO ORDER BY RoundNo) AS nr FROM rounds),
op AS (SELECT WO, QcStart AS s0, Process AS pr FROM firsts),
ini AS (SELECT t.WO, count(DISTINCT Worker) AS k, min(Worker) AS w0 FROM touches t JOIN op ON t.WO = op.WO
  WHERE WorkerStart <= WorkerStop AND WorkerStop <= s0 AND Process = pr GROUP BY 1),
ph AS (SELECT t.*, s0, sp.nr, k, w0, CASE WHEN NOT (WorkerStart <= WorkerStop) THEN 'InvalidTouch' WHEN s0 IS NULL THEN 'Unclassified'
  WHEN (SELECT count(*) FROM touches o WHERE o.WO = t.WO AND o.Worker = t.Worker AND o.WorkerStart < t.WorkerStop AND o.WorkerStop > t.WorkerStart) > 1 THEN 'OverlappingTouch'
  WHEN t.Process <> pr THEN 'OtherProcess' WHEN WorkerStop <= s0 THEN 'FirstPass' WHEN sp.nr IS NOT NULL THEN 'Rework' ELSE 'Unclassified' END AS Phase
  FROM touches t LEFT JOIN op ON t.WO = op.WO LEFT JOIN ini ON t.WO = ini.WO
  LEFT JOIN sp ON t.WO = sp.WO AND sp.FailQty > 0 AND t.WorkerStart > sp.QcStop AND t.WorkerStop < sp.nx)"""


@query(
    f"""
WITH {TOUCH_CTE}
SELECT EventId, Phase, CASE Phase WHEN 'FirstPass' THEN 1 WHEN 'Rework' THEN nr END AS RoundNo,
  CASE WHEN Phase = 'FirstPass' THEN 'InitialProduction' WHEN Phase <> 'Rework' THEN 'Unavailable' WHEN k = 1 AND Worker = w0 THEN 'SelfRework'
       WHEN k = 1 THEN 'AssistedRescue' ELSE 'AmbiguousInitialWorker' END AS Attribution,
  CASE WHEN Phase IN ('FirstPass', 'Rework') THEN round(epoch(WorkerStop - WorkerStart) / 60, 6) END AS TouchMinutes FROM ph
""",
    ("qc_tickets", "touches"),
)
def touch_phase(inp: Inputs):
    rows = T.reconstruct_touch(inp.touches, reconstruction(inp, cutoff=CUTOFF, once=True).rounds)
    return shown(rows, "EventId", "Phase", "RoundNo", "Attribution", "TouchMinutes")


@query(
    f"""
WITH {TOUCH_CTE}
SELECT Process, Worker, CAST(count(*) AS BIGINT) AS ReworkTouches, CAST(count(CASE WHEN k = 1 AND Worker <> w0 THEN 1 END) AS BIGINT) AS AssistedTouches,
  round(sum(epoch(WorkerStop - WorkerStart) / 60), 6) AS ReworkMinutes FROM ph WHERE Phase = 'Rework' GROUP BY 1, 2
""",
    ("qc_tickets", "touches"),
)
def rescue_minutes(inp: Inputs):
    rows = T.reconstruct_touch(inp.touches, reconstruction(inp, cutoff=CUTOFF, once=True).rounds)
    return shown(T.rescue_summary(rows))
