"""Metric, rank and report queries over a fixed synthetic prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.catalog.attribution import TEAM_CTE, rounds
from assayer.catalog.qc import TICKET_CTE
from assayer.catalog.registry import Inputs, query, shown
from assayer.operators import attribution as A
from assayer.operators import metrics as M
from assayer.operators import ordering as O
from assayer.operators import production as P

VIEWS = ("qc_tickets",)
PRED_CTE = f"""{TICKET_CTE}, pr AS (SELECT *, PassQty + FailQty AS n, (CAST(substr(WO, 3) AS BIGINT) % 96 + 2) / CAST(100 AS DOUBLE) AS p,
  CASE WHEN RoundNo = 1 THEN 'First pass' ELSE 'Rework' END AS Branch FROM rounds)"""
NLL = "-(PassQty * ln(p) + FailQty * ln(1 - p))"


def predicted(inp: Inputs):
    """Rounds with a fixed prediction derived from the order number."""
    number = F.substring("WO", 3, 20).cast("bigint")
    return rounds(inp).withColumns(
        {"Prediction": (number % 96 + 2) / F.lit(100.0), "Branch": A.branch(F.col("RoundNo"))}
    )


def timed(inp: Inputs):
    """Production with a fixed time prediction."""
    return P.with_time_features(inp.production).withColumn(
        "PredictedMinutes", F.col("MinutesPerOk") * (0.8 + F.col("RoundNo") * 0.05)
    )


@query(
    """
WITH t AS (SELECT Process, ln(Hours / Qty) AS y, ln(Hours / Qty) * 0.9 + RoundNo * 0.01 AS p, sqrt(Qty) AS w FROM production),
m AS (SELECT Process, sum(w * y) / sum(w) AS mu FROM t GROUP BY 1)
SELECT t.Process, CAST(count(*) AS BIGINT) AS N, round(sqrt(sum(w * (y - p) * (y - p)) / sum(w)), 6) AS RMSE, round(sum(w * abs(y - p)) / sum(w), 6) AS MAE,
  round(1 - sum(w * (y - p) * (y - p)) / sum(w * (y - mu) * (y - mu)), 6) AS R2 FROM t JOIN m ON t.Process = m.Process GROUP BY 1
""",
    ("production",),
)
def regression_metrics(inp: Inputs):
    rows = P.with_time_features(inp.production).withColumns(
        {"p": F.col("LogTime") * 0.9 + F.col("RoundNo") * 0.01, "w": F.sqrt("Qty")}
    )
    return shown(M.regression_metrics(rows, ["Process"], "LogTime", "p", "w"))


@query(
    """
WITH t AS (SELECT Process, 60 * (Hours / Qty) AS a, 60 * (Hours / Qty) * (0.8 + RoundNo * 0.05) AS p FROM production)
SELECT Process, CAST(count(*) AS BIGINT) AS N, round(sqrt(avg(pow(ln(a / p), 2))), 6) AS LogRMSE, round(sum(abs(a - p)) / sum(a), 6) AS WAPE,
  round(avg(CASE WHEN abs(a / p - 1) <= 0.2 THEN 1.0 ELSE 0.0 END), 6) AS Within20Pct FROM t GROUP BY 1
""",
    ("production",),
)
def wape_metrics(inp: Inputs):
    return shown(M.time_metrics(timed(inp), ["Process"], "MinutesPerOk", "PredictedMinutes"))


@query(
    f"""
WITH {PRED_CTE}
SELECT Process, Branch, CAST(count(*) AS BIGINT) AS Rounds, sum(n) AS Pieces, round(sum({NLL}) / sum(n), 6) AS PieceLogLoss, round(avg({NLL} / n), 6) AS RoundLogLoss,
  round(sum(PassQty * (1 - p) * (1 - p) + FailQty * p * p) / sum(n), 6) AS PieceBrier, round(sqrt(avg((PassQty / n - p) * (PassQty / n - p))), 6) AS RoundRateRmse,
  round(sum(PassQty) / sum(n), 6) AS ObservedRate, round(sum(n * p) / sum(n), 6) AS PredictedRate FROM pr GROUP BY 1, 2
""",
    VIEWS,
)
def log_loss_brier(inp: Inputs):
    return shown(M.binomial_metrics(predicted(inp), ["Process", "Branch"]))


BINS = """bins AS (SELECT Process, CAST(least(floor(p * 10), 9) AS BIGINT) AS Bin, count(DISTINCT WO) AS w, sum(n) AS n, sum(PassQty) AS y, sum(n * p) AS e FROM pr GROUP BY 1, 2)"""


@query(
    f"""
WITH {PRED_CTE}, {BINS}
SELECT Process, Bin, CAST(w AS BIGINT) AS WOs, n AS Pieces, y AS Passed, round(e, 6) AS Expected, round(y / n, 6) AS Observed, round(e / n, 6) AS Predicted FROM bins
""",
    VIEWS,
)
def calibration_bins(inp: Inputs):
    return shown(M.calibration_bins(predicted(inp), ["Process"]))


@query(
    f"""
WITH {PRED_CTE}, {BINS}
SELECT Process, round(sum(abs(y / n - e / n) * n) / sum(n), 6) AS ECE, round(abs(sum(y) - sum(e)) / sum(n), 6) AS CalibrationGap, sum(n) AS Pieces FROM bins GROUP BY 1
""",
    VIEWS,
)
def ece(inp: Inputs):
    return shown(M.calibration_error(M.calibration_bins(predicted(inp), ["Process"]), ["Process"]))


@query(
    f"""
WITH {PRED_CTE}
SELECT Process, Branch, CAST(greatest(ceil(p * 10) - 1, 0) AS BIGINT) AS Bin, CAST(count(*) AS BIGINT) AS Rounds, sum(n) AS Pieces, sum(PassQty) AS Passed,
  round(sum(p * n), 6) AS PredictedPass, round(sum(PassQty) / sum(n), 6) AS ObservedRate, round(sum(p * n) / sum(n), 6) AS PredictedRate FROM pr GROUP BY 1, 2, 3
""",
    VIEWS,
)
def fixed_calibration(inp: Inputs):
    return shown(M.fixed_bin_table(predicted(inp), ["Process", "Branch"]))


@query(
    f"""
WITH {PRED_CTE}
SELECT Branch, round(sum({NLL}), 5) AS NLL, sum(n) AS Pieces, CAST(count(*) AS BIGINT) AS Rounds, round(sum({NLL}) / sum(n), 6) AS LogLoss FROM pr GROUP BY 1
""",
    VIEWS,
)
def pooled_loss(inp: Inputs):
    return shown(M.pooled_loss(predicted(inp), ["Branch"]).withColumn("NLL", F.round("NLL", 5)))


@query(
    f"""
WITH {PRED_CTE}, lng AS (SELECT 'ALL' AS Dimension, 'ALL' AS Segment, * FROM pr UNION ALL SELECT 'Branch', Branch, * FROM pr UNION ALL SELECT 'SizeAdjustedGroup', SizeAdjustedGroup, * FROM pr),
b AS (SELECT Dimension, Segment, least(floor(p * 10), 9) AS Bin, sum(n) AS n, sum(PassQty) AS y, sum(n * p) AS e FROM lng GROUP BY 1, 2, 3),
c AS (SELECT Dimension, Segment, sum(abs(y - e)) / sum(n) AS ECE, abs(sum(y) - sum(e)) / sum(n) AS gap FROM b GROUP BY 1, 2)
SELECT l.Dimension, l.Segment, CAST(count(*) AS BIGINT) AS Rounds, CAST(count(DISTINCT WO) AS BIGINT) AS WOs, round(sum({NLL}) / sum(n), 6) AS PieceLogLoss,
  round(max(ECE), 6) AS ECE, round(max(gap), 6) AS CalibrationGap FROM lng l JOIN c ON l.Dimension = c.Dimension AND l.Segment = c.Segment GROUP BY 1, 2
""",
    VIEWS,
)
def segment_metrics(inp: Inputs):
    rows = M.segment_metrics(predicted(inp), [], ["Branch", "SizeAdjustedGroup"])
    return shown(rows, "Dimension", "Segment", "Rounds", "WOs", "PieceLogLoss", "ECE", "CalibrationGap")


@query(
    """
WITH tr AS (SELECT SizeAdjustedGroup AS g, count(DISTINCT WO) AS n FROM network WHERE CAST(substr(WO, 3) AS BIGINT) % 7 = 0 GROUP BY 1)
SELECT CASE WHEN coalesce(n, 0) < 10 THEN 'LOW_WO' ELSE 'SUFFICIENT_WO' END AS SparseGroup, CAST(count(*) AS BIGINT) AS RowCount
FROM network LEFT JOIN tr ON SizeAdjustedGroup = g GROUP BY 1
""",
    ("network",),
)
def sparse_groups(inp: Inputs):
    train = inp.network.filter("CAST(substr(WO, 3) AS BIGINT) % 7 = 0")
    return shown(M.sparse_label(inp.network, train, "SizeAdjustedGroup").groupBy("SparseGroup").agg(F.count("*").alias("RowCount")))


# Worker scores against verified skills: the material of rank agreement reports.
SCORE_CTE = """sc AS (SELECT Worker, Process, round(avg(ln(Hours / Qty)), 1) AS Score FROM assignment GROUP BY 1, 2),
pair AS (SELECT sc.*, s.Skill FROM sc JOIN skills s ON sc.Worker = s.Worker AND sc.Process = s.Process WHERE s.Skill IS NOT NULL)"""


def scores(inp: Inputs):
    effect = P.with_time_features(inp.assignment).groupBy("Worker", "Process").agg(F.round(F.avg("LogTime"), 1).alias("Score"))
    return effect.join(inp.skills.filter("Skill IS NOT NULL").select("Worker", "Process", "Skill"), ["Worker", "Process"])


@query(
    f"""
WITH {SCORE_CTE}, k AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY Process, Score) - 1) / CAST(2 AS DOUBLE) AS AverageRank,
  rank() OVER w - 1 AS l, count(*) OVER (PARTITION BY Process, Score) AS t, count(*) OVER (PARTITION BY Process) AS n FROM pair WINDOW w AS (PARTITION BY Process ORDER BY Score))
SELECT Process, Worker, Score, AverageRank, round(CASE WHEN n = 1 THEN 5 ELSE greatest(0, least(10, 10 * (l + l + t - 1) / CAST(2 AS DOUBLE) / (n - 1))) END, 6) AS Midpoint FROM k
""",
    ("assignment", "skills"),
)
def rank_average(inp: Inputs):
    rows = O.average_rank(scores(inp), ["Process"], "Score", "AverageRank")
    return shown(O.midpoint_score(rows, ["Process"], "Score", "Midpoint"), "Process", "Worker", "Score", "AverageRank", "Midpoint")


AGREE_CTE = f"""{SCORE_CTE}, rk AS (SELECT *, rank() OVER (PARTITION BY Process ORDER BY Score) + (count(*) OVER (PARTITION BY Process, Score) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY Process ORDER BY Skill) + (count(*) OVER (PARTITION BY Process, Skill) - 1) / 2.0 AS ry FROM pair),
kd AS (SELECT a.Process, sum(sign(a.Score - b.Score) * sign(a.Skill - b.Skill)) AS s, sum(CASE WHEN a.Score <> b.Score THEN 1 ELSE 0 END) AS ux, sum(CASE WHEN a.Skill <> b.Skill THEN 1 ELSE 0 END) AS uy
  FROM pair a JOIN pair b ON a.Process = b.Process AND a.Worker < b.Worker GROUP BY 1)"""


@query(
    f"""
WITH {AGREE_CTE}
SELECT rk.Process, CAST(count(*) AS BIGINT) AS N, round(corr(Score, Skill), 6) AS Pearson, round(corr(rx, ry), 6) AS Spearman, round(max(s / sqrt(CAST(ux AS DOUBLE) * uy)), 6) AS Kendall,
  round(regr_slope(Skill, Score), 6) AS Slope, round(regr_intercept(Skill, Score), 6) AS Intercept, round(corr(Score, Skill) * corr(Score, Skill), 6) AS R2
FROM rk JOIN kd ON rk.Process = kd.Process GROUP BY 1
""",
    ("assignment", "skills"),
)
def planner_agreement(inp: Inputs):
    return shown(M.agreement(scores(inp), ["Process"], "Score", "Skill"))


@query(
    f"""
WITH {AGREE_CTE}
SELECT Process, round(s / sqrt(CAST(ux AS DOUBLE) * uy), 6) AS Kendall FROM kd
""",
    ("assignment", "skills"),
)
def kendall_tau_b(inp: Inputs):
    return shown(M.kendall_tau_b(scores(inp), ["Process"], "Score", "Skill"))


@query(
    f"""
WITH {SCORE_CTE}
SELECT Process, Worker, round(CASE WHEN max(Score) OVER w = min(Score) OVER w THEN 5 ELSE 10 * (Score - min(Score) OVER w) / (max(Score) OVER w - min(Score) OVER w) END, 6) AS Scaled,
  round(CASE WHEN max(Score) OVER w = min(Score) OVER w THEN 5 ELSE 10 - 10 * (Score - min(Score) OVER w) / (max(Score) OVER w - min(Score) OVER w) END, 6) AS Capability
FROM pair WINDOW w AS (PARTITION BY Process)
""",
    ("assignment", "skills"),
)
def minmax_score(inp: Inputs):
    rows = M.minmax_score(scores(inp), ["Process"], "Score", "Scaled")
    return shown(M.minmax_score(rows, ["Process"], "Score", "Capability", higher_is_better=False), "Process", "Worker", "Scaled", "Capability")


@query(
    f"""
WITH {SCORE_CTE}, z AS (SELECT *, CASE WHEN stddev_samp(d) OVER w > 0 THEN (d - avg(d) OVER w) / stddev_samp(d) OVER w ELSE 0 END AS zz
  FROM (SELECT *, Skill - Score AS d FROM pair) x WINDOW w AS (PARTITION BY Process))
SELECT Process, Worker, round(zz, 6) AS ZScore, abs(zz) >= 2 AS Flag FROM z
""",
    ("assignment", "skills"),
)
def z_outliers(inp: Inputs):
    rows = scores(inp).withColumn("Difference", F.col("Skill") - F.col("Score"))
    return shown(M.flag_outliers(rows, ["Process"], "Difference"), "Process", "Worker", "ZScore", "Flag")


@query(
    f"""
WITH {SCORE_CTE}, b AS (SELECT *, row_number() OVER (PARTITION BY Process ORDER BY Score DESC, Worker) AS hi, row_number() OVER (PARTITION BY Process ORDER BY Score, Worker) AS lo FROM pair)
SELECT Process, Worker, Score, 'top' AS "End", CAST(hi AS BIGINT) AS Position FROM b WHERE hi <= 50
UNION ALL SELECT Process, Worker, Score, 'bottom', CAST(lo AS BIGINT) FROM b WHERE lo <= 50
""",
    ("assignment", "skills"),
)
def top_bottom_workers(inp: Inputs):
    return shown(M.extremes(scores(inp), ["Process"], "Score", "Worker", 50), "Process", "Worker", "Score", "End", "Position")


@query(
    """
SELECT Process, CAST(count(*) AS BIGINT) AS N, round(avg(CASE WHEN 60 * (Hours / Qty) BETWEEN 60 * (Hours / Qty) * (0.8 + RoundNo * 0.05) * 0.9 AND 60 * (Hours / Qty) * (0.8 + RoundNo * 0.05) * 1.1 THEN 1.0 ELSE 0.0 END), 6) AS Coverage
FROM production GROUP BY 1
""",
    ("production",),
)
def interval_coverage(inp: Inputs):
    rows = timed(inp).withColumns({"Lo": F.col("PredictedMinutes") * 0.9, "Hi": F.col("PredictedMinutes") * 1.1})
    return shown(M.interval_coverage(rows, ["Process"], "MinutesPerOk", "Lo", "Hi"))


@query(
    """
WITH t AS (SELECT Process, round(ln(Hours / Qty), 4) AS y FROM production)
SELECT Process, round(median(y), 6) AS P50, round(quantile_cont(y, 0.9), 6) AS P90, round(quantile_cont(y, 0.025), 6) AS P2_5 FROM t GROUP BY 1
""",
    ("production",),
)
def exact_quantiles(inp: Inputs):
    rows = P.with_time_features(inp.production).withColumn("y", F.round("LogTime", 4))
    return shown(O.quantiles(rows, ["Process"], "y", {"P50": 0.5, "P90": 0.9, "P2_5": 0.025}))


@query(
    """
WITH t AS (SELECT Process, round(ln(Hours / Qty), 3) AS y FROM production), e AS (SELECT Process, min(y) lo, max(y) hi FROM t GROUP BY 1)
SELECT t.Process, CAST(least(floor((y - lo) / ((hi - lo) / 30)), 29) AS BIGINT) AS Bin, CAST(count(*) AS BIGINT) AS N,
  round(min(lo) + least(floor((y - lo) / ((hi - lo) / 30)), 29) * min((hi - lo) / 30), 6) AS LeftEdge FROM t JOIN e ON t.Process = e.Process GROUP BY t.Process, least(floor((y - lo) / ((hi - lo) / 30)), 29)
""",
    ("production",),
)
def residual_histogram(inp: Inputs):
    rows = P.with_time_features(inp.production).withColumn("y", F.round("LogTime", 3))
    return shown(M.histogram(rows, ["Process"], "y"))


@query(
    """
WITH t AS (SELECT Process, round(ln(Hours / Qty), 2) AS y FROM production), c AS (SELECT Process, y, count(*) AS n FROM t GROUP BY 1, 2)
SELECT Process, y, CAST(n AS BIGINT) AS Ties, round((sum(n) OVER (PARTITION BY Process ORDER BY y) - n + (n - 1) / CAST(2 AS DOUBLE) + 0.5) / sum(n) OVER (PARTITION BY Process), 6) AS PlotPosition FROM c
""",
    ("production",),
)
def qq_series(inp: Inputs):
    rows = P.with_time_features(inp.production).withColumn("y", F.round("LogTime", 2))
    return shown(M.qq_series(rows, ["Process"], "y"))


@query(
    f"""
WITH g AS (SELECT Process, Item, count(*) AS n, count(DISTINCT Worker) AS w, avg(ln(Hours / Qty)) AS mu FROM production GROUP BY 1, 2),
s AS (SELECT Process, stddev_samp(ln(Hours / Qty)) AS sd FROM production GROUP BY 1),
c AS (SELECT g.*, 100 * (0.45 * (1 - exp(-n / CAST(20 AS DOUBLE))) + 0.35 * (1 - exp(-w / CAST(5 AS DOUBLE))) + 0.2 * (1 / (1 + sd / sqrt(n) / sd))) AS sc FROM g JOIN s ON g.Process = s.Process)
SELECT Process, Item, CAST(n AS BIGINT) AS Records, CAST(w AS BIGINT) AS Workers, round(sc, 2) AS ConfidenceScore,
  CASE WHEN sc <= 40 THEN 'Low' WHEN sc <= 70 THEN 'Medium' ELSE 'High' END AS Confidence FROM c
""",
    ("production",),
)
def item_confidence(inp: Inputs):
    rows = P.with_time_features(inp.production)
    spread = rows.groupBy("Process").agg(F.stddev_samp("LogTime").alias("sd"))
    items = rows.groupBy("Process", "Item").agg(F.count("*").alias("Records"), F.count_distinct("Worker").alias("Workers"))
    scored = items.join(spread, "Process").withColumn(
        "ConfidenceScore",
        M.confidence_score(F.col("Records"), F.col("Workers"), F.col("sd") / F.sqrt("Records"), F.col("sd")),
    )
    scored = scored.withColumn("Confidence", M.confidence_label(F.col("ConfidenceScore")))
    return shown(
        scored, "Process", "Item", "Records", "Workers", "ConfidenceScore", "Confidence"
    )


@query(
    f"""
WITH {TICKET_CTE}, {TEAM_CTE}, f AS (SELECT Process, Branch, sum(PassQty) / sum(PassQty + FailQty) > 0.4 AS ok, count(*) AS n FROM att WHERE Attribution = 'single' GROUP BY 1, 2),
e AS (SELECT DISTINCT Process, b AS Branch FROM att, (VALUES ('First pass'), ('Rework'), ('Time')) v(b))
SELECT e.Process, e.Branch, CASE WHEN ok THEN 'CONVERGED' WHEN NOT ok THEN 'NONCONVERGED' ELSE 'INSUFFICIENT_EVIDENCE' END AS FitStatus, CAST(coalesce(n, 0) AS BIGINT) AS EvidenceN
FROM e LEFT JOIN f ON e.Process = f.Process AND e.Branch = f.Branch
""",
    ("qc_tickets", "assignment"),
)
def fit_health(inp: Inputs):
    rows = A.attribute_rounds(rounds(inp), inp.assignment)
    fits = rows.filter("Attribution = 'single'").groupBy("Process", "Branch").agg(
        (F.sum("PassQty") / F.sum("InspectedQty") > 0.4).alias("Converged"), F.count("*").alias("EvidenceN"), F.lit(1).alias("Iterations")
    )
    branches = F.explode(F.array(F.lit("First pass"), F.lit("Rework"), F.lit("Time"))).alias("Branch")
    expected = rows.select("Process").distinct().select("Process", branches)
    return shown(M.fit_health(fits, expected), "Process", "Branch", "FitStatus", "EvidenceN")
