"""The core run: validated facts, network, time models, inspection and quality models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators import attribution as A
from assayer.operators import effects as E
from assayer.operators import graph as G
from assayer.operators import metrics as M
from assayer.operators import production as P
from assayer.operators import qc as Q
from assayer.operators import scoring as R
from assayer.operators import splits as S
from assayer.operators import touch as T
from assayer.session import cut_lineage


@dataclass(frozen=True, kw_only=True)
class Settings:
    version: str
    cutoff: str | None = None
    incomplete_month: str | None = None
    qc_exclude_month: str | None = "2026-07"
    time_max_iter: int = 500
    time_tolerance: float = 1e-7
    rasch_max_iter: int = 1000
    rasch_tolerance: float = 1e-5


def run(inputs: dict[str, DataFrame], settings: Settings) -> dict[str, DataFrame]:
    """Result tables by name from canonical inputs.

    Inputs: production and planner_skill; optionally mes_work_orders, item_mapping,
    item_master, qc_ticket, touch_event, engineering_factor.
    """
    tables: dict[str, DataFrame] = {}
    raw = inputs["production"]
    audit = None
    if "mes_work_orders" in inputs:
        audit = P.order_status_audit(inputs["mes_work_orders"])
        raw = P.exclude_orders(raw, audit)
        tables["work_order_status_audit"] = audit
    raw = P.fill_process(raw if "Process" in raw.columns else raw.withColumn("Process", F.lit(None).cast("string")))
    source = _mapping_source(inputs, raw)
    mapping = cut_lineage(P.item_mapping(source))
    skills = P.clean_skills(inputs["planner_skill"])
    cleaned = P.clean_production(raw, settings.incomplete_month)
    facts = P.attach_mapping(cleaned, mapping).withColumn("RoundNo", P.valid_round() if "RoundNo" in cleaned.columns else F.lit(None).cast("bigint"))
    if settings.cutoff:
        facts = P.as_of(facts, settings.cutoff)
    flagged = cut_lineage(P.flag_quarantine(facts))
    data = flagged.filter("Reason IS NULL").drop("Reason")
    tables["production_exceptions"] = flagged.filter("Reason IS NOT NULL")
    if audit is not None:
        tables["data_quality"] = P.data_quality_counts(raw, cleaned, flagged, audit)

    skilled = P.attach_skill(data, skills)
    tables["connectivity"] = G.connectivity(skilled.withColumnRenamed("CertifiedSkill", "Skill"))
    tables |= _time_models(data, tables["connectivity"], skills, settings)
    items = mapping.join(tables["time_groups"].select("Process", P.GROUP, "EstimatedMinutes"), ["Process", P.GROUP], "left")
    if "qc_ticket" in inputs:
        quality, items = _quality(inputs, data, mapping, skills, items, audit, settings)
        tables |= quality
    if "touch_event" in inputs and "qc_rounds" in tables:
        touches = inputs["touch_event"] if audit is None else P.exclude_orders(inputs["touch_event"], audit)
        tables["touch_reconstruction"] = T.reconstruct_touch(touches, tables["qc_rounds"])
    if "engineering_factor" in inputs:
        # Complete approved rubrics still cannot bypass the quality-model gate.
        scored = R.technical_complexity(inputs["engineering_factor"]).withColumnRenamed("FinalTechnicalComplexity", "ApprovedFactorWeightedSum")
        items = items.join(scored, ["Item", "Process"], "left")
    tables["item_difficulty"] = P.stamp(items, settings.version, str(settings.cutoff))
    return tables


def _mapping_source(inputs: dict[str, DataFrame], raw: DataFrame) -> DataFrame:
    master, mapping = inputs.get("item_master"), inputs.get("item_mapping")
    if master is not None and mapping is not None:
        columns = ["Item", "Process", P.GROUP]
        P.item_mapping(mapping.select(*columns).unionByName(master.select(*columns)))  # rejects conflicts
        return P.mapping_by_precedence(mapping, master)
    if master is not None or mapping is not None:
        return master if master is not None else mapping
    return raw.filter("Process IS NOT NULL AND Process <> 'Unknown'")


def _time_models(data: DataFrame, network: DataFrame, skills: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    keys = ["Process"]
    fit = E.fit_time_em(data, keys, P.GROUP, settings.time_max_iter, settings.time_tolerance)
    predicted = E.predict_log_time(data, fit, keys, P.GROUP)
    smear = E.smearing(predicted, keys, F.col("LogTime") - F.col("Prediction"))
    groups = E.group_minutes(fit, smear, keys).withColumnRenamed("ItemKey", P.GROUP).join(network, ["Process", P.GROUP])
    # A weak network keeps its raw effect but publishes no time expectation.
    groups = groups.withColumn("EstimatedMinutes", F.when(F.col("ConnectivityStatus") != "WeakNetwork", F.col("EstimatedMinutes")))
    key, real = P.trajectory_key(F.col("WO"), F.xxhash64(*data.columns))
    eligible = data.withColumns({"TrajectoryKey": key, "WoEligible": real}).filter("WoEligible")
    split = cut_lineage(S.chronological_split(eligible, "RafMonth", "TrajectoryKey"))
    train, test = split.filter("Split = 'train'"), split.filter("Split = 'test'")
    tables = {"time_groups": groups, "time_workers": P.worker_report(fit.workers, skills), "time_health": fit.health}
    if not train.isEmpty() and not test.isEmpty():
        held = E.fit_time_em(train, keys, P.GROUP, settings.time_max_iter, settings.time_tolerance)
        fitted = E.predict_log_time(train, held, keys, P.GROUP)
        factor = E.smearing(fitted, keys, F.col("LogTime") - F.col("Prediction"))
        scored = E.predict_log_time(test, held, keys, P.GROUP).join(factor, keys)
        scored = scored.withColumn("PredictedMinutes", 60 * F.exp("Prediction") * F.col("Smearing"))
        tables["time_validation"] = M.regression_metrics(scored, keys, "LogTime", "Prediction").join(
            M.time_metrics(scored, keys, "MinutesPerOk", "PredictedMinutes").drop("N"), keys, "left"
        )
    return tables


def _quality(inputs, data, mapping, skills, items, audit, settings) -> tuple[dict[str, DataFrame], DataFrame]:
    tickets = Q.normalise_tickets(inputs["qc_ticket"])
    if audit is not None:
        tickets = P.exclude_orders(tickets, audit)
    tickets = P.attach_mapping(tickets, mapping.select("Item", "Process", P.GROUP))
    kept, policy = Q.split_month(tickets, settings.qc_exclude_month)
    done = Q.reconstruct(kept, settings.cutoff)
    first = cut_lineage(A.attach_first_worker(done.first, data, skills))
    latest = done.rounds.agg(F.max("QcStop").alias("t")).first()["t"]
    cutoff = F.lit(settings.cutoff or latest).cast("timestamp_ntz")
    trajectories = Q.recovery_trajectories(done.rounds, cutoff)
    pooled = Q.raw_difficulty(Q.group_yield(first))
    keys = ["Process"]
    attributed = first.filter("Worker IS NOT NULL")
    first_fit = E.fit_crossed_logit(attributed, keys, E.Shrinkage(), settings.rasch_max_iter, settings.rasch_tolerance)
    sole = A.worker_rounds(data).filter("WorkersInRound = 1").select("WO", "RoundNo", "Worker")
    later = done.rounds.filter("RoundNo >= 2").join(sole, ["WO", "RoundNo"])
    rework_fit = E.fit_crossed_logit(later, keys, E.Shrinkage(), settings.rasch_max_iter, settings.rasch_tolerance)
    tables = {
        "qc_exceptions": done.exceptions.unionByName(policy, allowMissingColumns=True),
        "qc_rounds": done.rounds,
        "qc_first_rounds": first,
        "qc_round_workers": A.link_rounds(done.rounds, data),
        "qc_trajectories": trajectories,
        "recovery_groups": Q.recovery_groups(trajectories),
        "yield": Q.yield_summary(first),
        "rasch_first_pass_groups": first_fit.items,
        "rasch_first_pass_workers": first_fit.workers,
        "rasch_rework_groups": rework_fit.items,
        "rasch_rework_rounds": rework_fit.rounds,
    }
    key = ["Process", P.GROUP]
    models = first_fit.items.select("Process", F.col("ItemKey").alias(P.GROUP), F.col("Difficulty").alias("RaschDifficulty"), F.col("Converged").alias("FirstPassConverged"))
    rework = rework_fit.items.select("Process", F.col("ItemKey").alias(P.GROUP), F.col("Difficulty").alias("ReworkDifficulty"), F.col("Converged").alias("ReworkConverged"))
    items = items.join(pooled.drop("QualityStatus"), key, "left").join(models, key, "left").join(rework, key, "left")
    items = items.withColumn(
        "QualityStatus", Q.quality_status(F.col("RaschDifficulty").isNotNull(), F.col("FirstPassConverged"), F.col("ObservedFPY").isNotNull())
    )
    for name in ("FirstPass", "Rework"):
        items = items.withColumns({f"{name}{k}": c for k, c in R.branch_status(F.col(f"{name}Converged")).items()})
    return tables, items
