"""Source, sink, streaming and run-report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.catalog.attribution import rounds
from assayer.catalog.qc import CUTOFF, TICKET_CTE, reconstruction
from assayer.catalog.registry import Inputs, query, shown
from assayer.functions.expressions import register_sql_functions
from assayer.operators import attribution as A
from assayer.operators import production as P
from assayer.operators import qc as Q
from assayer.operators import runs as U
from assayer.sources import readers as R
from assayer.sources import writers as W
from assayer.streaming import jobs as J


@query(
    """
SELECT 'lineitem.parquet' AS SourceFile, CAST(count(*) AS BIGINT) AS RowCount FROM lineitem
"""
)
def scan_lineage(inp: Inputs):
    path = f"{inp.sf_dir}/lineitem.parquet"
    rows = inp.spark.read.parquet(path).select(F.col("_metadata.file_name").alias("SourceFile"), "l_orderkey")
    return shown(rows.groupBy("SourceFile").agg(F.count("*").alias("RowCount")))


@query(
    """
SELECT 'orders' AS Name, CAST(count(*) AS BIGINT) AS RowCount FROM orders UNION ALL SELECT 'part', count(*) FROM part
"""
)
def source_fingerprint_counts(inp: Inputs):
    a, b = (R.table_fingerprint(inp.raw(t)).select(F.lit(t).alias("Name"), "RowCount") for t in ("orders", "part"))
    return shown(a.unionByName(b))


@query()
def source_fingerprints(inp: Inputs):
    """SHA-256 and size of the order and part files."""
    files = R.file_fingerprints(inp.spark, f"{inp.sf_dir}/orders.parquet").unionByName(R.file_fingerprints(inp.spark, f"{inp.sf_dir}/part.parquet"))
    return shown(files)


@query(
    """
WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT CAST(sum(n) AS BIGINT) AS RowCount, CAST(count(*) AS BIGINT) AS DistinctRows, CAST(sum(n - 1) AS BIGINT) AS ExtraRows FROM g
"""
)
def duplicate_extra_rows(inp: Inputs):
    return shown(R.distinct_extra_rows(inp.raw("lineitem").select("l_orderkey", "l_linenumber")))


@query(
    """
SELECT CAST(count(*) AS BIGINT) AS RowCount, round(sum(Qty), 4) AS Qty, round(sum(Hours), 4) AS Hours FROM production WHERE RafMonth >= TIMESTAMP '1999-01-01' AND RafMonth < TIMESTAMP '2000-01-01'
""",
    ("production",),
)
def calendar_year_scan(inp: Inputs):
    year = R.calendar_year(inp.production, 1999)
    return shown(year.agg(F.count("*").alias("RowCount"), F.round(F.sum("Qty"), 4).alias("Qty"), F.round(F.sum("Hours"), 4).alias("Hours")))


@query(
    """
SELECT concat(CASE WHEN c_custkey % 3 = 0 THEN '''=' WHEN c_custkey % 3 = 1 THEN '''@' ELSE '' END, c_name) AS Cell, CAST(count(*) AS BIGINT) AS N FROM customer GROUP BY 1
"""
)
def formula_guard(inp: Inputs):
    mark = F.when(F.col("c_custkey") % 3 == 0, "=").when(F.col("c_custkey") % 3 == 1, "@").otherwise("")
    rows = inp.raw("customer").select(F.concat(mark, "c_name").alias("Cell"))
    return shown(W.safe_csv(rows).groupBy("Cell").agg(F.count("*").alias("N")))


@query(
    """
SELECT WO, CAST(count(DISTINCT Worker) AS BIGINT) AS Crew FROM assignment GROUP BY 1
""",
    ("assignment",),
)
def team_json_round_trip(inp: Inputs):
    teams = inp.assignment.select("WO", "Worker").distinct().groupBy("WO").agg(F.array_sort(F.collect_set("Worker")).alias("Workers"))
    back = R.teams_from_json(R.teams_to_json(teams))
    return shown(back.select("WO", F.size("Workers").cast("bigint").alias("Crew")))


@query(
    """
SELECT o_orderkey % 400 AS n, CAST(count(*) AS BIGINT) AS Orders, CAST(CASE WHEN o_orderkey % 400 <= 2 THEN o_orderkey % 400 WHEN o_orderkey % 400 <= 4 THEN 3 WHEN o_orderkey % 400 <= 9 THEN 4 WHEN o_orderkey % 400 <= 20 THEN 5
  WHEN o_orderkey % 400 <= 39 THEN 6 WHEN o_orderkey % 400 <= 76 THEN 7 WHEN o_orderkey % 400 <= 149 THEN 8 WHEN o_orderkey % 400 <= 359 THEN 9 ELSE 10 END AS DOUBLE) AS CountScore, round(1 / (1 + exp(-(o_orderkey % 400) / CAST(100 AS DOUBLE))), 6) AS P FROM orders GROUP BY 1
"""
)
def sql_functions(inp: Inputs):
    register_sql_functions(inp.spark)
    rows = inp.raw("orders").selectExpr("o_orderkey % 400 AS n").groupBy("n").agg(F.count("*").alias("Orders"))
    return shown(rows.selectExpr("n", "Orders", "count_score(n) AS CountScore", "logistic(n / 100D) AS P"))


def events(inp: Inputs):
    """The events file as a stream of tickets: worker, time, outcome."""
    schema = inp.raw("events").schema
    stream = J.file_stream(inp.spark, inp.sf_dir, schema, "events.parquet")
    return stream.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("Worker"), "event_type",
        (F.col("event_type") != "error").cast("double").alias("Passed"), F.lit(1.0).alias("Inspected"),
    )


@query(
    """
SELECT event_type, CAST(count(DISTINCT event_id) AS BIGINT) AS Tickets FROM events GROUP BY 1
"""
)
def stream_dedup_equals_batch(inp: Inputs):
    twice = events(inp).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    table = J.drain(J.unique_tickets(twice, "event_id", "ts", "40 days").select("event_id", "event_type"), "append")
    return shown(table.groupBy("event_type").agg(F.count("*").alias("Tickets")))


@query(
    """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS Day, event_type, sum(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) + CAST(0 AS DOUBLE) AS PassQty, CAST(count(*) AS DOUBLE) AS InspectedQty FROM events GROUP BY 1, 2
"""
)
def stream_daily_fpy(inp: Inputs):
    table = J.drain(J.daily_yield(events(inp), "ts", "event_type", "Passed", "Inspected"), "complete")
    return shown(table.select(F.date_format("Day", "yyyy-MM-dd").alias("Day"), "event_type", "PassQty", "InspectedQty"))


@query(
    """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS brk FROM events),
s AS (SELECT user_id, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g), c AS (SELECT user_id, sid, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id AS Worker, CAST(count(*) AS BIGINT) AS Sessions, CAST(sum(n) AS BIGINT) AS Events, CAST(max(n) AS BIGINT) AS Longest FROM c GROUP BY 1
"""
)
def stream_sessions(inp: Inputs):
    table = J.drain(J.labour_sessions(events(inp), "ts", "Worker"), "complete")
    return shown(table.groupBy("Worker").agg(F.count("*").alias("Sessions"), F.sum("Events").alias("Events"), F.max("Events").alias("Longest")))


@query(
    """
SELECT 'late' AS Part, CAST(count(*) AS BIGINT) AS N FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00' UNION ALL SELECT 'on time', count(*) FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00'
"""
)
def stream_late_tickets(inp: Inputs):
    good, late = J.split_late(events(inp), "ts", "2024-01-15 00:00:00")
    a = J.drain(good.select("event_id"), "append").agg(F.lit("on time").alias("Part"), F.count("*").alias("N"))
    b = J.drain(late.select("event_id", "Reason"), "append").agg(F.lit("late").alias("Part"), F.count("*").alias("N"))
    return shown(a.unionByName(b))


def staged_stream(inp: Inputs, table):
    """Write a batch table to the shared workspace and read it back as a stream."""
    path = f"{J._workspace(inp.spark)}/in"
    table.write.parquet(path)
    return J.file_stream(inp.spark, path, inp.spark.read.parquet(path).schema)


@query(
    f"""
WITH {TICKET_CTE}, t AS (SELECT WO, sum(CASE WHEN RoundNo = 1 THEN FailQty ELSE 0 END) AS f, sum(CASE WHEN RoundNo >= 2 THEN PassQty ELSE 0 END) AS r, max(RoundNo) AS m FROM rounds GROUP BY 1)
SELECT WO, f AS FirstFailQty, r AS RecoveredQty, greatest(0, f - r) AS RemainingFailQty, m AS RoundsReached, f > r AS OpenWO FROM t
""",
    ("qc_tickets",),
)
def stream_open_trajectories(inp: Inputs):
    stream = staged_stream(inp, rounds(inp).select("WO", "RoundNo", "PassQty", "ReworkQty"))
    table = J.drain(J.open_trajectories(stream), "update")
    latest = table.groupBy("WO").agg(F.max_by(F.struct("FirstFailQty", "RecoveredQty", "RemainingFailQty", "RoundsReached", "OpenWO"), "BatchId").alias("s"))
    return shown(latest.select("WO", "s.*"))


@query(
    """
SELECT WO, Worker, CAST(count(*) AS BIGINT) AS Intervals, CAST(count(CASE WHEN WorkerStart < mx THEN 1 END) AS BIGINT) AS Alerts FROM (SELECT *, max(WorkerStop) OVER (PARTITION BY WO, Worker ORDER BY WorkerStart, EventId ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM touches) t GROUP BY 1, 2
""",
    ("touches",),
)
def stream_overlap_alerts(inp: Inputs):
    rows = inp.touches.withColumns({c: F.col(c).cast("timestamp") for c in ("WorkerStart", "WorkerStop")})
    table = J.overlap_alerts(staged_stream(inp, rows))
    return shown(table.groupBy("WO", "Worker").agg(F.count("*").alias("Intervals"), F.count_if("Late").alias("Alerts")))


@query(
    f"""
WITH {TICKET_CTE}
SELECT 'data' AS Section, 'input_production_rows' AS Metric, CAST(count(*) AS DOUBLE) AS Value FROM production UNION ALL SELECT 'data', 'after_basic_filters', count(*) FROM production
UNION ALL SELECT 'qc', 'eligible_rounds', count(*) FROM rounds UNION ALL SELECT 'qc', 'later_rounds', count(*) FROM rounds WHERE RoundNo >= 2
UNION ALL SELECT 'qc', 'first_round_wos', count(*) FROM firsts UNION ALL SELECT 'qc', 'observed_fpy', round(sum(PassQty) / sum(PassQty + FailQty), 6) FROM firsts
""",
    ("production", "qc_tickets"),
)
def run_summary(inp: Inputs):
    done = reconstruction(inp, cutoff=CUTOFF)
    clean = P.clean_production(inp.production)
    links = A.link_rounds(done.rounds, inp.assignment)
    trajectories = Q.recovery_trajectories(done.rounds, F.lit(CUTOFF).cast("timestamp_ntz"))
    summary = U.run_summary(inp.production, clean, clean, done.first, done.rounds, links, trajectories, done.exceptions)
    wanted = ["input_production_rows", "after_basic_filters", "eligible_rounds", "later_rounds", "first_round_wos", "observed_fpy"]
    return shown(summary.filter(F.col("Metric").isin(*wanted)))


@query(
    """
SELECT 'orders' AS Section, o_orderstatus AS Metric, CAST(count(*) AS DOUBLE) AS Previous, CAST(count(CASE WHEN o_orderkey % 2 = 0 THEN 1 END) AS DOUBLE) AS Current, CAST(NULL AS DOUBLE) AS Change, 'NOT_DIRECTLY_COMPARABLE' AS Status FROM orders GROUP BY 2
"""
)
def run_comparison(inp: Inputs):
    def summary(df):
        return df.groupBy(F.col("o_orderstatus").alias("Metric")).agg(F.count("*").cast("double").alias("Value")).withColumn("Section", F.lit("orders"))

    orders = inp.raw("orders")
    prints = R.file_fingerprints(inp.spark, f"{inp.sf_dir}/orders.parquet")
    changed = prints.withColumn("Sha256", F.reverse("Sha256"))
    return shown(U.compare_runs(summary(orders), summary(orders.filter("o_orderkey % 2 = 0")), prints, changed))
