"""Run summaries and comparison between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _metric(df: DataFrame, section: str, metric, value) -> DataFrame:
    return df.select(F.lit(section).alias("Section"), metric.alias("Metric"), value.cast("double").alias("Value"))


def run_summary(
    raw: DataFrame, cleaned: DataFrame, kept: DataFrame, first: DataFrame, rounds: DataFrame, links: DataFrame, trajectories: DataFrame, exceptions: DataFrame
) -> DataFrame:
    """Row reconciliation, yield, attribution and status counts as (Section, Metric, Value)."""

    def count(df: DataFrame, section: str, name: str) -> DataFrame:
        return _metric(df.agg(F.count("*").alias("n")), section, F.lit(name), F.col("n"))

    out = count(raw, "data", "input_production_rows")
    out = out.unionByName(count(cleaned, "data", "after_basic_filters")).unionByName(count(kept, "data", "retained_production_rows"))
    out = out.unionByName(count(rounds, "qc", "eligible_rounds")).unionByName(count(rounds.filter("RoundNo >= 2"), "qc", "later_rounds"))
    pooled = first.agg(F.count("*").alias("first_round_wos"), (F.sum("PassQty") / F.sum("InspectedQty")).alias("observed_fpy"))
    wide = pooled.select(F.col("first_round_wos").cast("double"), "observed_fpy")
    out = out.unionByName(wide.unpivot([], wide.columns, "Metric", "Value").select(F.lit("qc").alias("Section"), "Metric", "Value"))
    sole = links.filter("WorkerAttributionStatus = 'Single worker in WO-round'").select("WO", "RoundNo").distinct()
    out = out.unionByName(count(sole, "qc", "single_worker_rounds"))
    for df, column, section in ((trajectories, "RecoveryStatus", "trajectory_status"), (exceptions, "Reason", "exception_reason")):
        counted = df.groupBy(F.col(column).alias("m")).agg(F.count("*").alias("n"))
        out = out.unionByName(_metric(counted, section, F.col("m"), F.col("n")))
    return out


def compare_runs(previous: DataFrame, current: DataFrame, old_sources: DataFrame, new_sources: DataFrame) -> DataFrame:
    """Metric changes between runs, comparable only when the sources are identical."""
    keys = ["SourceFile", "Sha256"]
    gone = old_sources.select(*keys).exceptAll(new_sources.select(*keys))
    came = new_sources.select(*keys).exceptAll(old_sources.select(*keys))
    changed = gone.unionByName(came).agg(F.count("*").alias("Changed")).withColumn("__k", F.lit(1))
    a = previous.select("Section", "Metric", F.col("Value").alias("Previous"))
    b = current.select("Section", "Metric", F.col("Value").alias("Current"))
    joined = a.join(b, ["Section", "Metric"], "full_outer").withColumn("__k", F.lit(1)).join(changed, "__k").drop("__k")
    same = F.col("Changed") == 0
    return joined.select(
        "Section", "Metric", "Previous", "Current", F.when(same, F.col("Current") - F.col("Previous")).alias("Change"),
        F.when(same, "COMPARABLE").otherwise("NOT_DIRECTLY_COMPARABLE").alias("Status"),
    )


def warning_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Warnings that appeared or were resolved since the previous run."""
    new = current.select("Warning").distinct().exceptAll(previous.select("Warning").distinct()).withColumn("Change", F.lit("new"))
    old = previous.select("Warning").distinct().exceptAll(current.select("Warning").distinct()).withColumn("Change", F.lit("resolved"))
    return new.unionByName(old)


def process_summary(health: DataFrame, stability: DataFrame) -> DataFrame:
    """Variance shares and mean item stability per process."""
    mean = stability.groupBy("Process").agg(F.avg("StabilityIndex").alias("DifficultyStability"))
    return health.select("Process", "ItemShare", "WorkerShare", "ResidualShare", "Converged").join(mean, "Process", "left")


def model_comparison(parts: dict[str, DataFrame]) -> DataFrame:
    """Long table of metrics per process and model."""
    out = None
    for name, df in parts.items():
        rows = df.select("Process", F.lit(name).alias("Model"), "RMSE", "MAE", "R2")
        out = rows if out is None else out.unionByName(rows)
    return out
