"""Detail-table queries: tickets, their rounds and workers, ranked outliers, cross-validated effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.catalog.attribution import TEAM_CTE, WR_CTE, rounds
from assayer.catalog.models import times
from assayer.catalog.qc import TICKET_CTE
from assayer.catalog.registry import Inputs, query, shown
from assayer.operators import attribution as A
from assayer.operators import crossval as V
from assayer.operators import details as D
from assayer.operators import effects as E
from assayer.operators import metrics as M
from assayer.session import settle

LINK_CTE = """
tk AS (SELECT TicketId, WO, RoundNo, Item FROM qc_tickets),
lk AS (SELECT t.*, r.Item AS RoundItem, r.Process AS RoundProcess, r.PassQty, r.PassQty + r.FailQty AS n, r.WO IS NOT NULL AS found
  FROM tk t LEFT JOIN rounds r ON t.WO = r.WO AND t.RoundNo = r.RoundNo),
ln AS (SELECT *, CASE WHEN NOT found THEN 'NOT_LINKED' WHEN Item IS DISTINCT FROM RoundItem THEN 'ITEM_MISMATCH' ELSE 'MATCHED' END AS im FROM lk),
fp AS (SELECT *, CASE WHEN RoundNo = 1 AND n > 0 AND im = 'MATCHED' THEN PassQty / n END AS fpy FROM ln)"""


def linked(inp: Inputs):
    core = rounds(inp).withColumn("InspectedQty", F.col("PassQty") + F.col("FailQty"))
    return D.link_tickets(inp.qc_tickets.select("TicketId", "WO", "RoundNo", "Item"), core)


@query(
    f"""
WITH {TICKET_CTE}, {LINK_CTE}
SELECT TicketId, WO, RoundNo, CASE WHEN found THEN 'MATCHED_CORE_ROUND' ELSE 'NOT_IN_CORE_ROUNDS' END AS RoundLinkStatus, im AS ItemMatchStatus, round(fpy, 6) AS RoundFPY FROM fp
""",
    ("qc_tickets",),
)
def ticket_rounds(inp: Inputs):
    return shown(linked(inp), "TicketId", "WO", "RoundNo", "RoundLinkStatus", "ItemMatchStatus", "RoundFPY")


@query(
    f"""
WITH {TICKET_CTE}, {WR_CTE}, {TEAM_CTE}, {LINK_CTE},
sg AS (SELECT Process, CASE WHEN RoundNo = 1 THEN 'FIRST_PASS' ELSE 'REWORK' END AS Branch, Worker, SizeAdjustedGroup FROM att WHERE Attribution = 'single' AND SizeAdjustedGroup IS NOT NULL),
ok AS (SELECT Process, Branch FROM sg GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT Worker) >= 2 AND count(DISTINCT SizeAdjustedGroup) >= 2),
ef AS (SELECT DISTINCT sg.Process, sg.Branch, Worker, 1 AS e FROM sg JOIN ok ON sg.Process = ok.Process AND sg.Branch = ok.Branch)
SELECT f.TicketId, f.WO, f.RoundNo, CASE WHEN f.RoundNo = 1 THEN 'FIRST_PASS' ELSE 'REWORK' END AS Branch, w.Worker, CAST(w.n AS BIGINT) AS WorkersInRound,
  CASE WHEN w.Worker IS NULL THEN 'NO_ATTRIBUTED_PRODUCTION_WORKER' WHEN e IS NULL THEN 'NO_FITTED_EFFECT' ELSE 'DIAGNOSTIC_ONLY' END AS WorkerScoreStatus
FROM fp f LEFT JOIN wrn w ON f.WO = w.WO AND f.RoundNo = w.RoundNo
LEFT JOIN ef ON ef.Process = f.RoundProcess AND ef.Worker = w.Worker AND ef.Branch = CASE WHEN f.RoundNo = 1 THEN 'FIRST_PASS' ELSE 'REWORK' END
""",
    ("qc_tickets", "assignment"),
)
def ticket_worker_effects(inp: Inputs):
    """Which of a ticket's workers have a fitted effect of the round's branch."""
    return shown(with_effects(inp), "TicketId", "WO", "RoundNo", "Branch", "Worker", "WorkersInRound", "WorkerScoreStatus")


def with_effects(inp: Inputs):
    # The rounds are rebuilt once, in the few columns that the fit and the tickets read.
    core = settle(rounds(inp).select("WO", "RoundNo", "Item", "Process", "SizeAdjustedGroup", "PassQty", "FailQty", "InspectedQty"))
    branch = F.when(F.col("RoundNo") == 1, "FIRST_PASS").otherwise("REWORK")
    learned = A.attribute_rounds(core, inp.assignment).filter("Attribution = 'single'").withColumn("Branch", branch)
    fit = E.fit_crossed_logit(learned, ["Process", "Branch"])
    tickets = D.link_tickets(inp.qc_tickets.select("TicketId", "WO", "RoundNo", "Item"), core.withColumn("InspectedQty", F.col("PassQty") + F.col("FailQty")))
    return D.ticket_workers(tickets, A.worker_rounds(inp.assignment), fit.workers)


@query()
def ticket_worker_effect_values(inp: Inputs):
    """Tickets with the fitted first-pass and rework effects of their workers."""
    return shown(with_effects(inp), "TicketId", "WO", "RoundNo", "Branch", "Worker", "WorkersInRound", "WorkerEffect", "WorkerScoreStatus")


@query(
    """
WITH z AS (SELECT Process, concat(WO, '-', CAST(RoundNo AS VARCHAR)) AS Assignment, CASE WHEN stddev_samp(y) OVER w > 0 THEN (y - avg(y) OVER w) / stddev_samp(y) OVER w ELSE 0 END AS zz
  FROM (SELECT *, ln(Hours / Qty) AS y FROM production) p WINDOW w AS (PARTITION BY Process))
SELECT Process, Assignment, round(zz, 6) AS ZScore FROM z WHERE abs(zz) >= 2 ORDER BY abs(zz) DESC, Process, Assignment
""",
    ("production",),
)
def ranked_outliers(inp: Inputs):
    """Production records whose time per piece stands out in their process, in report order."""
    rows = times(inp).withColumn("Assignment", F.concat_ws("-", "WO", F.col("RoundNo").cast("bigint").cast("string")))
    return shown(M.ranked_outliers(rows, ["Process"], "LogTime", "Assignment"), "Process", "Assignment", "ZScore")


@query()
def cross_validated_effects(inp: Inputs):
    """Mean error of the two-way effect model over three folds, all fitted in one job."""
    scored, means = V.cross_validate(times(inp), ["Process"], "SizeAdjustedGroup", None, ["WO", "RoundNo", "Worker", "Hours"])
    return shown(means)
