"""Detail tables behind the reports: tickets, their rounds, their workers and the fitted effects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.expressions import or_true

ROUND = ["WO", "RoundNo"]


def link_tickets(tickets: DataFrame, rounds: DataFrame) -> DataFrame:
    """Tickets with the round they belong to, whether it exists and whether it is of the same item, in report order.

    ``rounds`` has one row per WO and RoundNo with Item, Process, PassQty and InspectedQty. RoundFPY is given for first
    rounds whose item agrees.
    """
    core = rounds.select(*ROUND, F.col("Item").alias("RoundItem"), F.col("Process").alias("RoundProcess"), "PassQty", "InspectedQty", F.lit(True).alias("__core"))
    linked = tickets.join(core, ROUND, "left")
    found = F.col("__core").isNotNull()
    item = F.when(~found, "NOT_LINKED").when(or_true(F.col("Item") != F.col("RoundItem")), "ITEM_MISMATCH").otherwise("MATCHED")
    out = linked.withColumns({"RoundLinkStatus": F.when(found, "MATCHED_CORE_ROUND").otherwise("NOT_IN_CORE_ROUNDS"), "ItemMatchStatus": item})
    fpy = F.when((F.col("RoundNo") == 1) & (F.col("InspectedQty") > 0) & (F.col("ItemMatchStatus") == "MATCHED"), F.col("PassQty") / F.col("InspectedQty"))
    return out.withColumn("RoundFPY", fpy).drop("__core").orderBy("WO", "RoundNo", "TicketId")


def ticket_workers(linked: DataFrame, crews: DataFrame, effects: DataFrame, validated: bool = False) -> DataFrame:
    """One row per ticket and producing worker with the worker's fitted effect of the round's branch, in report order.

    ``crews`` has WO, RoundNo, Worker, Hours and WorkersInRound; ``effects`` has Process, Branch, Worker and WorkerEffect.
    """
    branch = F.when(F.col("RoundNo") == 1, "FIRST_PASS").otherwise("REWORK")
    side = linked.select("TicketId", *ROUND, F.col("RoundProcess").alias("Process"), "RoundFPY", "RoundLinkStatus", branch.alias("Branch"))
    joined = side.join(crews.select(*ROUND, "Worker", "Hours", "WorkersInRound"), ROUND, "left")
    joined = joined.join(effects.select("Process", "Branch", "Worker", "WorkerEffect"), ["Process", "Branch", "Worker"], "left")
    status = (
        F.when(F.col("Worker").isNull(), "NO_ATTRIBUTED_PRODUCTION_WORKER")
        .when(F.col("WorkerEffect").isNull(), "NO_FITTED_EFFECT")
        .otherwise("USER_VALIDATED" if validated else "DIAGNOSTIC_ONLY")
    )
    return joined.withColumn("WorkerScoreStatus", status).orderBy("WO", "RoundNo", "TicketId", "Worker")
