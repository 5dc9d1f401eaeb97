"""Estimator, learning and resampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.catalog.attribution import TEAM_CTE, rounds, rounds_once
from assayer.catalog.metrics import PRED_CTE, predicted
from assayer.catalog.qc import TICKET_CTE
from assayer.catalog.registry import Inputs, query, shown
from assayer.operators import attribution as A
from assayer.operators import candidates as K
from assayer.operators import effects as E
from assayer.operators import learning as L
from assayer.operators import production as P
from assayer.operators import resample as S
from assayer.session import cut_lineage, settle


def times(inp: Inputs):
    return P.with_time_features(inp.production)


def single_rounds(inp: Inputs):
    return A.attribute_rounds(rounds(inp), inp.assignment)


def learned_rounds(inp: Inputs):
    """The attributed rounds, written once in the columns the candidates take."""
    rows = A.attribute_rounds(rounds_once(inp), inp.assignment)
    return settle(rows.select("WO", "RoundNo", "Process", "Branch", "SizeAdjustedGroup", "Worker", "Workers", "Attribution", "PassQty", "InspectedQty", "QcStart", "QcStop"))


@query()
def two_way_effects(inp: Inputs):
    """Intercept, iterations and effect spread of the alternating least-squares fit."""
    fit = E.fit_two_way(times(inp), ["Process"], "SizeAdjustedGroup")
    spread = fit.items.groupBy("Process").agg(F.min("ItemEffect").alias("LowestItem"), F.max("ItemEffect").alias("HighestItem"))
    return shown(fit.health.join(spread, "Process"))


@query()
def time_em(inp: Inputs):
    """Variance shares and likelihood of the random-worker time model."""
    fit = E.fit_time_em(times(inp), ["Process"], "SizeAdjustedGroup")
    return shown(fit.health)


@query()
def time_worker_effects(inp: Inputs):
    """Posterior worker ability with conditional intervals."""
    return shown(E.fit_time_em(times(inp), ["Process"], "SizeAdjustedGroup").workers)


@query()
def rasch_first_pass(inp: Inputs):
    """Group difficulty from first rounds with one matched production worker."""
    rows = single_rounds(inp).filter("Attribution = 'single' AND RoundNo = 1")
    return shown(E.fit_crossed_logit(rows, ["Process"]).items)


@query()
def rasch_rework(inp: Inputs):
    """Round effects and convergence of the rework branch."""
    rows = single_rounds(inp).filter("Attribution = 'single' AND RoundNo >= 2")
    fit = E.fit_crossed_logit(rows, ["Process"])
    return shown(fit.rounds.join(fit.health.select("Process", "Iterations", "Converged"), "Process"))


@query()
def ridge_candidates(inp: Inputs):
    """Convergence and intercept of every ridge candidate and penalty."""
    return shown(K.fit_candidates(learned_rounds(inp)).health)


@query(
    f"""
WITH {TICKET_CTE}, {TEAM_CTE},
ob AS (SELECT * FROM att WHERE SizeAdjustedGroup IS NOT NULL),
wt AS (SELECT o.Process, o.Branch, count(DISTINCT t.Worker) AS w FROM ob o JOIN teams t ON o.WO = t.WO AND o.RoundNo = t.RoundNo AND o.Item = t.Item AND o.Process = t.Process GROUP BY 1, 2),
ft AS (SELECT Process, Branch, count(*) AS n, count(DISTINCT SizeAdjustedGroup) + count(DISTINCT RoundNo) + max(CASE WHEN TeamSize > 1 THEN 1 ELSE 0 END) + max(CASE WHEN TeamSize = 0 THEN 1 ELSE 0 END) AS t FROM ob GROUP BY 1, 2)
SELECT f.Process, f.Branch, Variant, Penalty, CAST(f.n AS BIGINT) AS Observations, CAST(f.t + coalesce(wt.w, 0) AS BIGINT) AS Terms, CAST(0 AS BIGINT) AS TermsOffBalance, true AS Converged
FROM ft f LEFT JOIN wt ON wt.Process = f.Process AND wt.Branch = f.Branch,
(VALUES ('ridge_expanded_pieces'), ('ridge_expanded_equal_round')) v(Variant), (VALUES (CAST(0.1 AS DOUBLE)), (CAST(1 AS DOUBLE)), (CAST(10 AS DOUBLE))) q(Penalty)
""",
    ("qc_tickets", "assignment"),
)
def ridge_expanded(inp: Inputs):
    """Shared-team designs: every term's gradient vanishes at the fitted coefficients."""
    learned = learned_rounds(inp)
    balance = K.design_balance(learned, K.fit_expanded(learned))
    return shown(balance, "Process", "Branch", "Variant", "Penalty", "Observations", "Terms", "TermsOffBalance", "Converged")


@query()
def candidate_selection(inp: Inputs):
    """Validation-selected candidates and their test log-loss."""
    result = K.compare(learned_rounds(inp))
    test = result["comparison"].filter("Cohort = 'single'").select("Process", "Branch", "Variant", "Rounds", "PieceLogLoss")
    return shown(test.join(result["selection"], ["Process", "Branch"], "left"))


EFFECT_CTE = """m AS (SELECT Process, avg(ln(Hours / Qty)) AS mu FROM production GROUP BY 1),
wk AS (SELECT p.Process, Worker, avg(ln(Hours / Qty) - mu) AS we FROM production p JOIN m ON m.Process = p.Process WHERE CAST(substr(Worker, 2) AS BIGINT) % 4 <> 0 GROUP BY 1, 2),
it AS (SELECT p.Process, SizeAdjustedGroup, avg(ln(Hours / Qty) - mu) AS ie FROM production p JOIN m ON m.Process = p.Process WHERE RoundNo % 2 = 0 GROUP BY 1, 2),
fp AS (SELECT p.*, mu + coalesce(we, 0) + coalesce(ie, 0) AS pred FROM production p JOIN m ON m.Process = p.Process
  LEFT JOIN wk ON wk.Process = p.Process AND wk.Worker = p.Worker LEFT JOIN it ON it.Process = p.Process AND it.SizeAdjustedGroup = p.SizeAdjustedGroup)"""


def fixed_effects(inp: Inputs):
    """A deliberately simple effect table (means), to check frozen prediction."""
    rows = times(inp)
    # Tables of a few rows each, written once: known to be small, they are broadcast and no row moves to its process.
    mean = settle(rows.groupBy("Process").agg(F.avg("LogTime").alias("Intercept")))
    deviation = (F.col("LogTime") - F.col("Intercept")).alias("d")
    centred = settle(rows.join(mean, "Process").select("Process", "Worker", "SizeAdjustedGroup", "RoundNo", deviation))
    workers = settle(centred.filter("CAST(substr(Worker, 2) AS BIGINT) % 4 <> 0").groupBy("Process", "Worker").agg(F.avg("d").alias("WorkerEffect")))
    items = settle(centred.filter("RoundNo % 2 = 0").groupBy("Process", F.col("SizeAdjustedGroup").alias("ItemKey")).agg(F.avg("d").alias("ItemEffect")))
    return E.EffectFit(workers, items, mean.withColumn("Converged", F.lit(True)))


@query(
    f"""
WITH {EFFECT_CTE}
SELECT Process, SizeAdjustedGroup, CAST(count(*) AS BIGINT) AS RowCount, round(avg(pred), 6) AS MeanPrediction, round(avg(abs(ln(Hours / Qty) - pred)), 6) AS MeanAbsError FROM fp GROUP BY 1, 2
""",
    ("production",),
)
def frozen_prediction(inp: Inputs):
    rows = E.predict_log_time(times(inp), fixed_effects(inp), ["Process"], "SizeAdjustedGroup")
    return shown(
        rows.groupBy("Process", "SizeAdjustedGroup").agg(
            F.count("*").alias("RowCount"), F.avg("Prediction").alias("MeanPrediction"),
            F.avg(F.abs(F.col("LogTime") - F.col("Prediction"))).alias("MeanAbsError"),
        )
    )


@query(
    f"""
WITH {EFFECT_CTE}
SELECT Process, round(avg(exp(greatest(least(ln(Hours / Qty) - pred, 30), -30))), 6) AS Smearing FROM fp GROUP BY 1
""",
    ("production",),
)
def smearing(inp: Inputs):
    rows = E.predict_log_time(times(inp), fixed_effects(inp), ["Process"], "SizeAdjustedGroup")
    return shown(E.smearing(rows, ["Process"], F.col("LogTime") - F.col("Prediction")))


LEARN_CTE = """co AS (SELECT Process, SizeAdjustedGroup, SizeAdjustedGroup AS Item, Worker, WO, RoundNo, Hours, RafMonth AS WODate, ln(Hours / Qty) AS y FROM production WHERE Hours / Qty BETWEEN 0.1 AND 10),
nb AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY Process, SizeAdjustedGroup, Worker) AS n FROM co WINDOW w AS (PARTITION BY Process, SizeAdjustedGroup, Worker ORDER BY WODate, WO, RoundNo, Hours)),
pa AS (SELECT Process, SizeAdjustedGroup, Worker, max(n) AS n, date_diff('day', min(WODate), max(WODate)) AS sp, min(WODate) AS d0, max(WODate) AS d1, avg(CASE WHEN rn <= 2 THEN y END) AS e,
  avg(CASE WHEN rn = floor(n / CAST(2 AS DOUBLE)) OR rn = floor(n / CAST(2 AS DOUBLE)) + 1 THEN y END) AS m, avg(CASE WHEN rn >= n - 1 THEN y END) AS l FROM nb GROUP BY 1, 2, 3
  HAVING max(n) >= 6 AND date_diff('day', min(WODate), max(WODate)) >= 30 AND count(DISTINCT WODate) >= 3)"""


def learning_history(inp: Inputs):
    """Worker histories on size groups, effort ratio against one hour per piece."""
    rows = inp.production.withColumns({"EffortRatio": F.col("Hours") / F.col("Qty"), "Item": F.col("SizeAdjustedGroup"), "WODate": F.col("RafMonth")})
    return rows.filter(F.col("EffortRatio").between(L.RATIO_MIN, L.RATIO_MAX))


def pairs(inp: Inputs):
    return L.learning_pairs(learning_history(inp), ["WO", "RoundNo", "Hours"])


@query(
    f"""
WITH {LEARN_CTE}
SELECT Process, SizeAdjustedGroup, Worker, CAST(n AS BIGINT) AS WOCount, CAST(sp AS BIGINT) AS SpanDays, round(exp(e), 6) AS EarlyEffortRatio, round(exp(m), 6) AS MiddleEffortRatio,
  round(exp(l), 6) AS LateEffortRatio, round(e - l, 6) AS EarlyToLateLogDrop, e - l > ln(1.1) AS ImprovedAtLeast10Pct FROM pa
""",
    ("production",),
)
def learning_pairs(inp: Inputs):
    return shown(
        pairs(inp), "Process", "SizeAdjustedGroup", "Worker", "WOCount", "SpanDays", "EarlyEffortRatio", "MiddleEffortRatio", "LateEffortRatio",
        "EarlyToLateLogDrop", "ImprovedAtLeast10Pct",
    )


@query(
    f"""
WITH {LEARN_CTE}, g AS (SELECT Process, SizeAdjustedGroup, count(*) AS k, sum(n) AS won, date_diff('day', min(d0), max(d1)) AS sp, count(DISTINCT Worker) AS w, median(exp(e)) AS r1, median(exp(m)) AS r2, median(exp(l)) AS r3 FROM pa GROUP BY 1, 2),
el AS (SELECT * FROM g WHERE k >= 3 AND won >= 18 AND w >= 2 AND sp >= 30),
sc AS (SELECT *, count(*) OVER (PARTITION BY Process) AS nn, rank() OVER (PARTITION BY Process ORDER BY r1) - 1 + (count(*) OVER (PARTITION BY Process, r1) - 1) / CAST(2 AS DOUBLE) AS m1,
  rank() OVER (PARTITION BY Process ORDER BY r2) - 1 + (count(*) OVER (PARTITION BY Process, r2) - 1) / CAST(2 AS DOUBLE) AS m2, rank() OVER (PARTITION BY Process ORDER BY r3) - 1 + (count(*) OVER (PARTITION BY Process, r3) - 1) / CAST(2 AS DOUBLE) AS m3 FROM el)
SELECT g.Process, g.SizeAdjustedGroup, CAST(g.k AS BIGINT) AS LearningTrajectoryN, CAST(g.won AS BIGINT) AS LearningWON, round(sc.r1, 6) AS LearningEarlyRatio, round(sc.r3, 6) AS LearningLateRatio,
  round(CASE WHEN nn = 1 THEN 5 ELSE 10 * (m1 + m2 + m3) / 3 / (nn - 1) END, 6) AS LearningSourceScore,
  CASE WHEN sc.k IS NULL THEN 'INSUFFICIENT_REPEATED_HISTORY' ELSE 'OBSERVED_WINDOW_MODEL_ESTIMATE' END AS LearningSourceStatus
FROM g LEFT JOIN sc ON g.Process = sc.Process AND g.SizeAdjustedGroup = sc.SizeAdjustedGroup
""",
    ("production",),
)
def learning_scores(inp: Inputs):
    return shown(
        L.learning_scores(pairs(inp)), "Process", "SizeAdjustedGroup", "LearningTrajectoryN", "LearningWON", "LearningEarlyRatio", "LearningLateRatio",
        "LearningSourceScore", "LearningSourceStatus",
    )


@query(
    """
WITH f AS (SELECT WO, Worker, sum(Final) AS h FROM worker_hours WHERE RoundNo = 1 AND Worker IS NOT NULL AND WO <> 'OTHER' GROUP BY 1, 2),
s AS (SELECT WO, min(Worker) AS Worker, max(h) AS h FROM f GROUP BY 1 HAVING count(*) = 1),
c AS (SELECT s.*, o.Item, h / (GoodPieces * StandardRuntime / 60) AS r FROM s JOIN work_orders o ON s.WO = o.WO WHERE Status = 'Complete' AND GoodPieces > 0)
SELECT c.WO, c.Worker, c.Item, m.Process, round(r, 6) AS EffortRatio FROM c JOIN semis m ON c.Item = m.Item WHERE r BETWEEN 0.1 AND 10
""",
    ("worker_hours", "work_orders", "semis"),
)
def learning_cohort(inp: Inputs):
    cohort = L.learning_cohort(inp.worker_hours, inp.work_orders, inp.semis.select("Item", "Process", "SizeAdjustedGroup"))
    return shown(cohort, "WO", "Worker", "Item", "Process", "EffortRatio")


@query()
def learning_bootstrap(inp: Inputs):
    """Precision and interval of the learning score from resampled histories."""
    rows = cut_lineage(pairs(inp))
    return shown(L.learning_bootstrap(rows, L.learning_scores(rows), repetitions=200))


@query()
def paired_bootstrap(inp: Inputs):
    """Cluster interval of the loss difference between two fixed predictions."""
    rows = predicted(inp).withColumn("Other", F.lit(0.5))
    return shown(S.paired_bootstrap(rows, ["Process", "Branch"], "Prediction", "Other"))


@query(
    """
WITH e AS (SELECT concat(Process, ' / ', RoundNo % 2) AS PB, abs(ln(Hours / Qty)) AS x, abs(Hours / Qty - 1) <= 0.2 AS h FROM production),
r AS (SELECT *, row_number() OVER (ORDER BY x) - 1 AS gi, count(*) OVER () AS gn, row_number() OVER (PARTITION BY PB ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY PB) AS n FROM e),
g AS (SELECT max(CASE WHEN gi = ceil(round((gn - 1) * least(1, ceil((gn + 1) * 0.9) / CAST(gn AS DOUBLE)), 9)) THEN x END) AS gr, avg(CASE WHEN h THEN 1.0 ELSE 0.0 END) AS gh FROM r),
b AS (SELECT PB, max(n) AS n, max(CASE WHEN i = ceil(round((n - 1) * least(1, ceil((n + 1) * 0.9) / CAST(n AS DOUBLE)), 9)) THEN x END) AS br, sum(CASE WHEN h THEN 1 ELSE 0 END) AS hs FROM r GROUP BY 1)
SELECT PB, CAST(n AS BIGINT) AS CalibrationN, round(CASE WHEN n >= 30 THEN greatest(gr, br) ELSE gr END, 6) AS LogRadius90, round((hs + 20 * gh) / (n + 20), 6) AS CalibrationWithin20Pct,
  CASE WHEN n >= 30 THEN 'PROCESS_BRANCH_CONSERVATIVE' ELSE 'POOLED' END AS IntervalSource FROM b, g
""",
    ("production",),
)
def conformal_radius(inp: Inputs):
    rows = times(inp).select(
        F.concat("Process", F.lit(" / "), F.col("RoundNo") % 2).alias("PB"), F.abs("LogTime").alias("x"), (F.abs(F.col("TimePerPiece") - 1) <= 0.2).alias("h")
    )
    return shown(S.conformal_radius(rows, "PB", "x", "h"))


@query(
    f"""
WITH {PRED_CTE}, i AS (SELECT Process, Branch, SizeAdjustedGroup, sum(n * p * (1 - p)) AS gi, count(*) AS k, sum(n) AS np FROM pr GROUP BY 1, 2, 3)
SELECT Process, Branch, SizeAdjustedGroup, round(gi, 6) AS GroupInformation, CAST(k AS BIGINT) AS ModelRounds, np AS ModelPieces,
  round(sqrt(1 / gi + 1 / (sum(gi) OVER (PARTITION BY Process, Branch) + 1e-6)), 6) AS EtaSE FROM i
""",
    ("qc_tickets",),
)
def branch_information(inp: Inputs):
    rows = S.branch_information(predicted(inp), ["Process", "Branch"])
    return shown(rows, "Process", "Branch", "SizeAdjustedGroup", "GroupInformation", "ModelRounds", "ModelPieces", "EtaSE")


@query()
def normal_simulation(inp: Inputs):
    """Combined difficulty interval from simulated branch predictors."""
    info = S.branch_information(predicted(inp), ["Process", "Branch"])
    rate = predicted(inp).groupBy("Process", "Branch", "SizeAdjustedGroup").agg(
        F.ln((F.sum("PassQty") + 0.5) / (F.sum("FailQty") + 0.5)).alias("Eta")
    )
    return shown(S.simulate_quality(info.join(rate, ["Process", "Branch", "SizeAdjustedGroup"]), draws=4096))


@query()
def item_stability(inp: Inputs):
    """Stability of group effects over ten row resamples."""
    rows = times(inp)
    return shown(S.item_stability(rows, ["Process"], "SizeAdjustedGroup", ["WO", "RoundNo", "Worker", "Item", "Hours"]))
