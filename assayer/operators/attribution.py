"""Who produced each inspected round, and how that evidence may be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.expressions import is_finite, is_whole, or_false
from assayer.operators.contracts import assert_none
from assayer.operators.production import GROUP, clean_skills, scope_excluded

VERIFIED_ON = "2026-08-03"  # fixed value: date of the verified skill snapshot
ROUND = ["WO", "RoundNo"]


def worker_rounds(production: DataFrame) -> DataFrame:
    """Hours and pieces per order, round and worker with the size of the round's crew."""
    known = production.filter("WO IS NOT NULL AND RoundNo IS NOT NULL AND Worker IS NOT NULL")
    per_worker = known.groupBy(*ROUND, "Worker").agg(F.sum("Hours").alias("Hours"), F.sum("Qty").alias("QtyDoing"))
    crew = per_worker.groupBy(*ROUND).agg(F.count("Worker").alias("WorkersInRound"))
    return per_worker.join(crew, ROUND)


def link_rounds(rounds: DataFrame, production: DataFrame) -> DataFrame:
    """One row per round and producing worker, with a status for the link."""
    linked = rounds.join(worker_rounds(production), ROUND, "left")
    status = (
        F.when(F.col("Worker").isNull(), "No production round match")
        .when(F.col("WorkersInRound") == 1, "Single worker in WO-round")
        .otherwise("Multiple workers in WO-round")
    )
    return linked.withColumn("WorkerAttributionStatus", status)


def attach_first_worker(first: DataFrame, production: DataFrame, skills: DataFrame | None = None) -> DataFrame:
    """First rounds with their sole production worker, hours and verified skill."""
    sole = worker_rounds(production).filter("RoundNo = 1 AND WorkersInRound = 1")
    sole = sole.select("WO", F.col("Worker").alias("Worker"), F.col("Hours").alias("Round1WorkerHours"))
    out = first.drop("Worker", "AttributionStatus").join(sole, "WO", "left")
    out = out.withColumn(
        "AttributionStatus",
        F.when(F.col("Worker").isNotNull(), "Single production worker in RoundNo=1").otherwise(
            "Missing or multiple production workers in RoundNo=1"
        ),
    )
    return out if skills is None else out.join(skills.select("Worker", "Process", "Skill"), ["Worker", "Process"], "left")


def round_teams(production: DataFrame) -> DataFrame:
    """The distinct workers of every round's item and process, in order; one exchange."""
    valid = production.filter((F.col("RoundNo") >= 1) & is_whole(F.col("RoundNo")) & F.col("Worker").isNotNull())
    return valid.groupBy(*ROUND, "Item", "Process").agg(F.sort_array(F.collect_set("Worker")).alias("Workers"))


def attribute_rounds(rounds: DataFrame, production: DataFrame) -> DataFrame:
    """single / team / unknown by the workers that match the round's item and process."""
    joined = rounds.join(round_teams(production), [*ROUND, "Item", "Process"], "left")
    size = F.when(F.col("Workers").isNull(), 0).otherwise(F.size("Workers")).cast("bigint")
    return joined.withColumns(
        {
            "TeamSize": size,
            "Worker": F.when(size == 1, F.get("Workers", F.lit(0))),
            "Attribution": F.when(size == 1, "single").when(size > 1, "team").otherwise("unknown"),
            "Branch": branch(F.col("RoundNo")),
        }
    )


def branch(round_no: Column, first: str = "First pass", later: str = "Rework") -> Column:
    return F.when(round_no == 1, first).otherwise(later)


def period(start: Column) -> Column:
    return F.when(start < F.lit(VERIFIED_ON).cast("timestamp_ntz"), "PRE_VERIFICATION").otherwise("POST_VERIFICATION")


def planner_rounds(rounds: DataFrame, production: DataFrame, skills: DataFrame, verified_on: str = VERIFIED_ON) -> DataFrame:
    """Rounds with crew counted before item and process matching, skill, period, eligibility.

    Everyone recorded in the round counts, so a mismatching colleague can never make a
    shared round look like one person's work.
    """
    valid = production.filter(
        (F.col("RoundNo") >= 1) & is_whole(F.col("RoundNo")) & F.col("Worker").isNotNull() & F.col("WO").isNotNull()
    )
    # One exchange: the items and workers of a round are few, however many rows it has.
    crew = valid.groupBy(*ROUND).agg(
        F.size(F.collect_set("Worker")).cast("bigint").alias("WorkersInRound"),
        F.min("Worker").alias("__w"),
        F.min("Process").alias("__p0"),
        F.max("Process").alias("__p1"),
        F.collect_set("Item").alias("__items"),
    )
    q = rounds.drop("Worker").join(crew, ROUND, "left")
    size = F.coalesce("WorkersInRound", F.lit(0))
    agrees = (F.col("__p0") == F.col("Process")) & (F.col("__p1") == F.col("Process")) & F.array_contains("__items", F.col("Item"))
    attribution = F.when(size > 1, "team").when((size == 1) & or_false(agrees), "single").otherwise("unknown")
    q = q.withColumns({"WorkersInRound": size, "Attribution": attribution})
    q = q.withColumn("Worker", F.when(F.col("Attribution") == "single", F.col("__w"))).drop("__w", "__p0", "__p1", "__items")
    q = q.join(
        clean_skills(skills, check=False).select("Worker", "Process", F.col("Skill").alias("CertifiedSkill")),
        ["Worker", "Process"],
        "left",
    )
    early = F.col("QcStart") < F.lit(verified_on).cast("timestamp_ntz")
    excluded = scope_excluded(F.col("Item")) | scope_excluded(F.col(GROUP))
    return q.withColumns(
        {
            "PlannerSkillStatus": F.when(F.col("Attribution") != "single", "NO_SINGLE_PRODUCTION_WORKER")
            .when(F.col("CertifiedSkill").isNull(), "MISSING_PLANNER_SKILL")
            .otherwise("VERIFIED_PLANNER_0_10"),
            "RetrospectivePlanner": F.col("CertifiedSkill").isNotNull() & early,
            "Period": F.when(early, "PRE_VERIFICATION").otherwise("POST_VERIFICATION"),
            "Branch": branch(F.col("RoundNo"), "FIRST_PASS", "REWORK"),
            "Eligibility": F.when(excluded, "EXCLUDED_SEMI_SCOPE")
            .when(F.col("Attribution") == "team", "AUDIT_ONLY_MULTIPLE_WORKERS")
            .when(F.col("Attribution") == "unknown", "AUDIT_ONLY_NO_ROUND_WORKER")
            .otherwise("ELIGIBLE"),
        }
    )


def check_observations(df: DataFrame) -> DataFrame:
    """Reject rounds whose quantities cannot be a binomial outcome."""
    n, y = F.col("InspectedQty"), F.col("PassQty")
    fine = is_finite(n) & is_finite(y) & (n > 0) & (y >= 0) & (y <= n) & is_whole(n) & is_whole(y)
    assert_none(df.filter(~or_false(fine)), "QC requires valid reconciled integer quantities")
    return df


def coverage(df: DataFrame, dimensions: list[str]) -> DataFrame:
    return df.groupBy(*dimensions).agg(
        F.count("*").alias("Rounds"), F.sum("InspectedQty").alias("Pieces"), F.count_distinct(GROUP).alias("Groups")
    )


def coverage_orders(df: DataFrame, dimensions: list[str]) -> DataFrame:
    return df.groupBy(*dimensions).agg(
        F.count_distinct("WO").alias("WOs"), F.count("*").alias("Rounds"), F.sum("InspectedQty").alias("QCPieces")
    )


def daily_attribution(df: DataFrame) -> DataFrame:
    """Rounds per completion day, one column per attribution."""
    return (
        df.groupBy(F.to_date("QcStop").alias("Day"))
        .pivot("Attribution", ["single", "team", "unknown"])
        .count()
        .na.fill(0, ["single", "team", "unknown"])
    )


def hard_error_audit(flagged_tickets: DataFrame, cohort: DataFrame) -> DataFrame:
    """How many source rounds carry a hard error and how many of them remain in the cohort."""
    bad = flagged_tickets.select(*ROUND).distinct()
    kept = cohort.select(*ROUND).join(bad, ROUND, "left_semi")
    return bad.agg(F.count("*").alias("SourceHardErrorRounds")).withColumn("Key", F.lit(1)).join(
        kept.agg(F.count("*").alias("RetainedHardErrorRounds")).withColumn("Key", F.lit(1)), "Key"
    ).drop("Key")


def attach_asof_skill(rounds: DataFrame, history: DataFrame, allow_baseline: bool = True) -> DataFrame:
    """Latest skill snapshot effective at inspection start; otherwise a labelled baseline.

    Snapshots per worker and process are few, so the range condition rides on the equi-join
    and a grouped max_by picks the latest one.
    """
    snaps = history.select(
        "Worker", "Process", F.col("Skill").alias("__skill"), F.col("EffectiveFrom").cast("timestamp_ntz").alias("__from")
    )
    dated = F.col("__from").isNotNull() & (F.col("__from") <= F.col("QcStart"))
    picked = rounds.join(snaps, ["Worker", "Process"]).groupBy(*ROUND).agg(
        F.max_by("__skill", F.when(dated, F.col("__from"))).alias("__asof"),
        F.min_by("__skill", F.struct(F.col("__from").isNull(), F.col("__from"), F.col("__skill"))).alias("__base"),
    )
    out = rounds.join(picked, ROUND, "left")
    asof, base = F.col("__asof"), F.col("__base")
    skill = F.coalesce(asof, base) if allow_baseline else asof
    status = F.when(asof.isNotNull(), "Dated snapshot available at QC start")
    if allow_baseline:
        status = status.when(base.isNotNull(), "Baseline snapshot applied (prior to verification date)")
    return out.withColumns({"CertifiedSkill": skill, "SkillAsOfStatus": status.otherwise("Missing historical skill")}).drop(
        "__asof", "__base"
    )


def order_summary(rounds: DataFrame, links: DataFrame, skills: DataFrame) -> DataFrame:
    """One row per first-round order: quantities once, sorted worker list, skill if single."""
    named = links.filter("RoundNo = 1 AND Worker IS NOT NULL").select("WO", "Process", "Worker").distinct()
    workers = named.groupBy("WO", "Process").agg(
        F.array_join(F.array_sort(F.collect_set("Worker")), "; ").alias("ProductionWorkers"),
        F.count("*").alias("__n"),
        F.min("Worker").alias("__w"),
    )
    first = rounds.filter("RoundNo = 1").join(workers, ["WO", "Process"], "left")
    first = first.withColumn("Worker", F.when(F.col("__n") == 1, F.col("__w")))
    first = first.join(skills.select("Worker", "Process", F.col("Skill").alias("VerifiedSkill")), ["Worker", "Process"], "left")
    return first.select(
        "WO", "Item", "ProductionWorkers", "Process", F.to_date("QcStart").alias("FirstQcDate"), "PassQty", "FailQty",
        "InspectedQty", F.try_divide("PassQty", "InspectedQty").alias("FPY"), "VerifiedSkill",
    )


def snapshot_transitions(old: DataFrame, new: DataFrame) -> DataFrame:
    """How attribution changed between two refreshes of the same rounds."""
    before = old.select(*ROUND, F.col("Attribution").alias("OldAttribution"))
    after = new.select(*ROUND, F.col("Attribution").alias("NewAttribution"))
    return before.join(after, ROUND).groupBy("OldAttribution", "NewAttribution").agg(F.count("*").alias("Rounds"))
