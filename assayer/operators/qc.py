"""Inspection tickets to rounds, first-pass yield and recovery."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.functions.expressions import (
    TEXT_DISPOSITIONS,
    clean_text,
    first_reason,
    folded,
    is_close,
    is_whole,
    last_reason,
    or_false,
    or_true,
    ratio,
    seconds_between,
    to_double,
    to_timestamp,
)
from assayer.operators.contracts import require_columns, with_group_stats
from assayer.operators.production import GROUP, rename_aliases
from assayer.session import cut_lineage, settle

TICKET_COLUMNS = ["TicketId", "WO", "Item", "RoundNo", "Status", "Qty", "ExpectedQty", "QcStart", "QcStop"]
TICKET_ALIASES = [
    ("ItemId", "Item"),
    ("ExpectedInspectionQty", "ExpectedQty"),
    ("StartCW", "ExpectedQty"),
    ("CreatedDateTime", "QcStart"),
    ("QCWorkerWrkCtrId", "InitialWorker"),
]
SNAPSHOT_COLUMNS = ["RoundPassQty", "RoundReworkQty", "RoundScrapQty", "RoundActualQty", "ExpectedQty"]
# Exception texts, in the order the checks run.
BAD_TICKET = "Invalid ticket or WO; inspect source"
AFTER_CUTOFF = "After source cutoff"
MULTIPLE_ITEMS = "WO has multiple Items"
ROUND_GAP = "Round continuity failure"
NOT_RECONCILED = "Round quantity reconciliation failure"
BAD_TIMING = "Invalid round timing or reinspected quantity exceeds prior failures"
OVER_RECOVERED = "Recovered quantity exceeds first fail quantity"
# Share of a recovered piece that still counts, by the round it passed in.
# Credit of a recovered piece by round, in hundredths, so that totals are whole numbers in any order.
RECOVERY_WEIGHTS = {2: 100, 3: 65, 4: 30}


@dataclass(frozen=True)
class Reconstruction:
    rounds: DataFrame
    first: DataFrame
    exceptions: DataFrame


def disposition_of(description: Column, status: Column | None = None) -> Column:
    """Explicit text wins; a status is used only when the text is blank."""
    text = folded(description)
    chain = None
    for word, label in TEXT_DISPOSITIONS.items():
        chain = (F.when if chain is None else chain.when)(text == word, F.lit(label))
    if status is not None:
        chain = chain.when((text == "") & (folded(status) == "pass"), "Pass")
        chain = chain.when((text == "") & (folded(status) == "fail"), "Rework")
    return chain


def normalise_tickets(raw: DataFrame) -> DataFrame:
    """Canonical ticket columns; a missing stop comes from a plausible validation time."""
    df = rename_aliases(raw, TICKET_ALIASES)
    if "QcStop" not in df.columns:
        start = to_timestamp("QcStart")
        if "ValidatedDateTime" in df.columns:
            done = to_timestamp("ValidatedDateTime")
            sane = (done >= F.lit("2020-01-01").cast("timestamp_ntz")) & or_true(done >= start)
            df = df.withColumn("QcStop", F.when(or_false(sane), done).otherwise(start))
        else:
            df = df.withColumn("QcStop", start)
    for optional in ("InitialWorker", "Description"):
        if optional not in df.columns:
            df = df.withColumn(optional, F.lit(None).cast("string"))
    require_columns(df, TICKET_COLUMNS, "QC")
    text = folded("Description")
    explicit = F.when(text == "đạt", "pass").when(text.isin("sửa", "hỏng"), "fail")
    return df.withColumns(
        {
            "Disposition": disposition_of(F.col("Description")),
            "Status": folded(F.when(text != "", explicit).otherwise(F.col("Status"))),
            "WO": clean_text("WO"),
            "TicketId": clean_text("TicketId"),
            "Item": clean_text("Item"),
            "QcStart": to_timestamp("QcStart"),
            "QcStop": to_timestamp("QcStop"),
            "RoundNo": to_double("RoundNo"),
            "Qty": to_double("Qty"),
            "ExpectedQty": to_double("ExpectedQty"),
        }
    )


def split_month(df: DataFrame, month: str | None, column: str = "QcStart") -> tuple[DataFrame, DataFrame]:
    """(kept, excluded by policy) on the calendar month of a timestamp."""
    hit = or_false(F.date_format(column, "yyyy-MM") == month) if month else F.lit(False)
    return df.filter(~hit), df.filter(hit).withColumn("Reason", F.lit(f"QC excluded month: {month}"))


def collapse_snapshots(raw: DataFrame) -> DataFrame:
    """One row per order, item and round from cumulative snapshots.

    Each quantity is the last known value on its own, ordered by actual quantity, time and
    ticket with unknown keys last.
    """
    src = raw.withColumns(
        {c: to_double(c) for c in SNAPSHOT_COLUMNS}
        | {"QcStart": to_timestamp("QcStart"), "Item": clean_text("Item"), "Mark": disposition_of(F.col("Description"))}
    ).withColumn("FailQty", F.coalesce("RoundReworkQty", F.lit(0.0)) + F.coalesce("RoundScrapQty", F.lit(0.0)))
    sort_key = F.struct(
        *[part for c in ("RoundActualQty", "QcStart", "TicketId") for part in (F.col(c).isNull().alias(f"n{c}"), F.col(c))]
    )

    def last(c: str) -> Column:
        return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), sort_key)).alias(c)

    def first(c: str) -> Column:
        return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), sort_key)).alias(c)

    rows = src.groupBy("WO", "Item", "RoundNo").agg(
        *[last(c) for c in [*SNAPSHOT_COLUMNS, "FailQty", "Mark"]],
        first("TicketId"),
        first("InitialWorker"),
        F.min("QcStart").alias("__start"),
        F.max("QcStart").alias("__stop"),
    )
    derived = F.when(F.col("RoundScrapQty") > 0, "Scrap").when(F.col("RoundReworkQty") > 0, "Rework").otherwise("Pass")
    return rows.select(
        "TicketId",
        "WO",
        "Item",
        F.col("RoundNo").cast("double").alias("RoundNo"),
        F.lit("pass").alias("Status"),
        F.col("RoundActualQty").alias("Qty"),
        "ExpectedQty",
        F.col("__start").alias("QcStart"),
        F.col("__stop").alias("QcStop"),
        "InitialWorker",
        F.coalesce("Mark", derived).alias("Disposition"),
        F.col("RoundPassQty").alias("SnapshotPass"),
        F.col("FailQty").alias("SnapshotFail"),
        F.col("RoundScrapQty").alias("SnapshotScrap"),
    )


def flag_tickets(tickets: DataFrame, cutoff: str | None = None) -> DataFrame:
    """Reason per ticket: unusable itself, sharing an order with one, or after the cutoff."""
    counted = with_group_stats(tickets, ["TicketId"], F.count("*").alias("__copies"))
    bad, future = _faults(tickets, F.col("__copies") > 1, cutoff)
    marked = counted.withColumns({"__bad": bad, "__future": future}).drop("__copies")
    guilty = marked.filter("__bad AND NOT __future AND WO IS NOT NULL").select("WO").distinct().withColumn("__guilty", F.lit(True))
    return (
        marked.join(guilty, "WO", "left")
        .withColumn(
            "Reason",
            F.when(F.col("__future"), AFTER_CUTOFF).when(F.col("__bad") | F.col("__guilty").isNotNull(), BAD_TICKET),
        )
        .drop("__bad", "__future", "__guilty")
    )


def _faults(tickets: DataFrame, repeated: Column, cutoff: str | None) -> tuple[Column, Column]:
    """(unusable itself, after the cutoff) of a ticket."""
    required = ["WO", "TicketId", "Item", "Process", "QcStart", "QcStop"]
    null_key = F.greatest(*[F.col(c).isNull().cast("int") for c in required]) == 1
    broken = (
        null_key
        | (F.col("QcStop") < F.col("QcStart"))
        | ~F.col("Status").isin("pass", "fail")
        | ~((F.col("RoundNo") >= 1) & is_whole(F.col("RoundNo")))
        | ~((F.col("Qty") >= 0) & is_whole(F.col("Qty")))
        | ~((F.col("ExpectedQty") > 0) & is_whole(F.col("ExpectedQty")))
        | repeated
    )
    future = or_false(F.col("QcStop") > F.lit(cutoff).cast("timestamp_ntz")) if cutoff else F.lit(False)
    if "IsRoundValid" in tickets.columns:
        broken = broken | (F.coalesce(to_double("IsRoundValid"), F.lit(1.0)) == 0)
    return or_true(broken), future


def usable_totals(tickets: DataFrame, cutoff: str | None = None) -> DataFrame:
    """Totals per round of the orders none of whose tickets is unusable, as ``flag_tickets`` tells them.

    Unusable tickets go with their order under no round, and their order is told by that in the exchange that the judgement
    of the orders needs anyway: no ticket is joined with the tickets or orders that spoil it.
    """
    repeated = tickets.groupBy("TicketId").agg(F.count("*").alias("n")).filter("n > 1")
    repeated = settle(repeated.select("TicketId", F.lit(True).alias("__repeated")))  # few rows, known to be few once written
    bad, future = _faults(tickets, F.col("__repeated").isNotNull(), cutoff)
    marked = tickets.join(repeated, "TicketId", "left").withColumns({"__bad": bad, "__future": future})
    told = marked.filter("NOT __future AND (NOT __bad OR WO IS NOT NULL)").withColumn("RoundNo", F.when(~F.col("__bad"), F.col("RoundNo")))
    spoilt = F.max(F.col("RoundNo").isNull()).over(W.partitionBy("WO"))
    return round_totals(told).withColumn("__spoilt", spoilt).filter("NOT __spoilt").drop("__spoilt")


def round_totals(clean: DataFrame) -> DataFrame:
    """Quantities, window and expected size per order and round."""
    snapshot = "SnapshotPass" in clean.columns
    passing = F.when(F.col("Status") == "pass", F.col("Qty")).otherwise(0.0)
    failing = F.when(F.col("Status") == "fail", F.col("Qty")).otherwise(0.0)
    latest = F.struct("QcStart", "TicketId")
    worker = clean_text("InitialWorker")
    totals = clean.groupBy("WO", F.col("RoundNo").cast("bigint").alias("RoundNo")).agg(
        (F.max("SnapshotPass") if snapshot else F.sum(passing)).alias("PassQty"),
        (F.max("SnapshotFail") if snapshot else F.sum(failing)).alias("FailQty"),
        (F.max("SnapshotScrap") if snapshot else F.lit(0.0)).alias("ScrapQty"),
        (F.max("Qty") if snapshot else F.sum("Qty")).alias("InspectedQty"),
        F.min("Item").alias("Item"),
        F.max("Item").alias("__item_max"),
        F.min(GROUP).alias(GROUP),
        F.min("Process").alias("Process"),
        F.min("ExpectedQty").alias("__expected_min"),
        F.max("ExpectedQty").alias("__expected_max"),
        F.max_by("Disposition", latest).alias("Disposition"),
        F.min("QcStart").alias("QcStart"),
        F.max("QcStop").alias("QcStop"),
        F.min(worker).alias("__w0"),
        F.max(worker).alias("__w1"),
    )
    remaining = F.greatest(F.lit(0.0), F.col("FailQty") - F.col("ScrapQty"))
    return totals.withColumn("ReworkQty", F.coalesce(remaining, F.lit(0.0)))


def judged(rounds: DataFrame) -> DataFrame:
    """The rounds with the Reason of their order; checks that run later override earlier ones.

    The windows see one pre-aggregated row per round, so an order contributes its number of
    rework rounds no matter how many tickets it holds.
    """
    order = W.partitionBy("WO")
    by_round = order.orderBy("RoundNo")
    expected = F.col("__expected_min")
    unreconciled = (expected != F.col("__expected_max")) | ~or_false(
        is_close(F.col("PassQty") + F.col("FailQty"), expected)
    )
    mistimed = (F.col("QcStart") <= F.lag("QcStop").over(by_round)) | (
        F.col("InspectedQty") > F.lag("ReworkQty").over(by_round) + 1e-8
    )
    staged = rounds.withColumn("__flaw", last_reason([(unreconciled, NOT_RECONCILED), (or_false(mistimed), BAD_TIMING)]))
    staged = staged.withColumn("__later", F.col("RoundNo") > F.min("RoundNo").over(order))
    recovered = F.sum(F.when(F.col("__later"), F.col("PassQty"))).over(order)
    first_fail = F.min_by("FailQty", "RoundNo").over(order)
    flaw = F.max_by("__flaw", F.when(F.col("__flaw").isNotNull(), F.col("RoundNo"))).over(order)
    gap = (F.min("RoundNo").over(order) != 1) | (F.count("*").over(order) != F.max("RoundNo").over(order))
    reason = F.coalesce(
        F.when(recovered > first_fail + 1e-8, OVER_RECOVERED),
        flaw,
        F.when(gap, ROUND_GAP),
        F.when(F.min("Item").over(order) != F.max("__item_max").over(order), MULTIPLE_ITEMS),
    )
    return staged.withColumn("Reason", reason).drop("__flaw", "__later")


def reconstruct(tickets: DataFrame, cutoff: str | None = None, exclude_month: str | None = None, once: bool = False) -> Reconstruction:
    """Rounds, first rounds and exceptions from canonical tickets (with process and group).

    ``once``: the caller reads one of the results, once, so that nothing is written and only the columns it takes are made.
    """
    kept, policy = split_month(tickets, exclude_month)
    totals = judged(usable_totals(kept, cutoff))
    if not once:
        totals = settle(totals)  # one row per round; read by every result below
    accepted = totals.filter("Reason IS NULL").drop("Reason")
    rounds = accepted.select(
        "WO", "RoundNo", "Item", GROUP, "Process", "PassQty", "FailQty", "ReworkQty", "ScrapQty", "InspectedQty",
        "Disposition", "QcStart", "QcStop",
    )
    flagged = flag_tickets(kept, cutoff)
    rejected = totals.filter("Reason IS NOT NULL").select("WO", "Reason").distinct()
    exceptions = (
        flagged.filter("Reason IS NOT NULL")
        .unionByName(policy, allowMissingColumns=True)
        .unionByName(flagged.filter("Reason IS NULL").drop("Reason").join(rejected, "WO"), allowMissingColumns=True)
    )
    return Reconstruction(rounds, first_rounds(accepted), exceptions)


def first_rounds(rounds: DataFrame) -> DataFrame:
    """First-round outcome with yield and the explicit initial worker when it is unique."""
    per_order = rounds.groupBy("WO").agg(F.min("__w0").alias("lo"), F.max("__w1").alias("hi"))
    unique = F.when(F.col("lo") == F.col("hi"), F.col("lo"))
    first = rounds.filter("RoundNo = 1").join(per_order, "WO")
    return first.withColumns(
        {
            "FPY": ratio(F.col("PassQty"), F.col("InspectedQty")),
            "Worker": unique,
            "AttributionStatus": F.when(unique.isNotNull(), "Explicit initial worker").otherwise(
                "Missing or ambiguous initial worker"
            ),
        }
    ).drop("lo", "hi", *[c for c in rounds.columns if c.startswith("__")])


def yield_summary(first: DataFrame) -> DataFrame:
    """Pooled yield by (process, group), by process and by month in one scan; ratio of sums."""
    staged = first.withColumn("QcMonth", F.date_format("QcStart", "yyyy-MM"))
    cols = [F.col("Process"), F.col(GROUP), F.col("QcMonth")]
    sets = [[cols[0], cols[1]], [cols[0]], [cols[2]]]
    level = F.grouping_id()
    return (
        staged.groupingSets(sets, *cols)
        .agg(
            level.alias("__level"),
            F.sum("PassQty").alias("PassQty1"),
            F.sum("InspectedQty").alias("InspectedQty1"),
            F.count("*").alias("QCEvidenceN"),
        )
        .withColumns(
            {
                "Level": F.when(F.col("__level") == 1, "group").when(F.col("__level") == 3, "process").otherwise("month"),
                "ObservedFPY": ratio(F.col("PassQty1"), F.col("InspectedQty1")),
            }
        )
        .drop("__level")
    )


def group_yield(first: DataFrame) -> DataFrame:
    pooled = first.groupBy("Process", GROUP).agg(
        F.sum("PassQty").alias("PassQty1"), F.sum("InspectedQty").alias("InspectedQty1"), F.count("*").alias("QCEvidenceN")
    )
    return pooled.withColumn("ObservedFPY", ratio(F.col("PassQty1"), F.col("InspectedQty1")))


def raw_difficulty(pooled: DataFrame) -> DataFrame:
    """10 x (1 - yield) with a status that says how much it may be trusted."""
    status = F.when(F.col("ObservedFPY").isNotNull(), "Raw FPY fallback; uncalibrated assignment-conditional").otherwise(
        "Insufficient Evidence: no eligible QC"
    )
    return pooled.withColumns({"RawDifficulty": 10 * (1 - F.col("ObservedFPY")), "QualityStatus": status})


def quality_status(has_model: Column, converged: Column, has_raw: Column) -> Column:
    return (
        F.when(has_model & or_false(converged), "Rasch converged; unvalidated diagnostic")
        .when(has_model, "Rasch nonconverged; decision use blocked")
        .when(has_raw, "Raw FPY fallback; uncalibrated assignment-conditional")
        .otherwise("Insufficient Evidence: no eligible QC")
    )


def recovery_trajectories(rounds: DataFrame, cutoff: Column, closed: DataFrame | None = None) -> DataFrame:
    """Per-order recovery; unknown terminal outcomes stay open."""
    later = F.col("RoundNo") >= 2

    def weight_of(round_no: Column) -> Column:
        chain = None
        for r, w in RECOVERY_WEIGHTS.items():
            chain = (F.when if chain is None else chain.when)(round_no == r, F.lit(w))
        return chain.otherwise(0)

    head = [F.min_by(c, "RoundNo").alias(c) for c in ("Item", GROUP, "Process")]
    base = rounds.groupBy("WO").agg(
        *head,
        F.min_by("ReworkQty", "RoundNo").alias("FirstFailQty"),
        F.sum(F.when(later, F.col("PassQty")).otherwise(0.0)).alias("RecoveredQty"),
        (F.sum(F.when(later, F.col("PassQty") * weight_of(F.col("RoundNo"))).otherwise(0.0)) / 100).alias("RecoveryNumerator"),
        F.max("RoundNo").alias("RoundsReached"),
        F.min_by("QcStart", "RoundNo").alias("__start"),
        F.max_by("QcStop", "RoundNo").alias("__stop"),
    )
    if closed is not None:
        base = base.join(closed.select("WO").distinct().withColumn("__closed", F.lit(True)), "WO", "left")
    else:
        base = base.withColumn("__closed", F.lit(None).cast("boolean"))
    fail, numerator = F.col("FirstFailQty"), F.col("RecoveryNumerator")
    staged = base.withColumn("RemainingFailQty", F.greatest(F.lit(0.0), fail - F.col("RecoveredQty"))).withColumn(
        "OpenWO", (F.col("RemainingFailQty") > 0) & F.col("__closed").isNull()
    )
    pessimistic = F.when(fail > 0, numerator / fail)
    best = F.when(
        fail > 0, (numerator + F.col("RemainingFailQty") * weight_of(F.col("RoundsReached") + 1) / 100) / fail
    )
    staged = staged.withColumns(
        {
            "RecoveryIndexPessimistic": pessimistic,
            "RecoveryIndexOptimistic": F.when(F.col("OpenWO"), best).otherwise(pessimistic),
            "ObservedRecoveryDifficulty": F.when((fail > 0) & ~F.col("OpenWO"), 10 * (1 - pessimistic)),
            "AgeDays": seconds_between(F.col("__start"), cutoff) / 86400,
            "DaysSinceLastQC": seconds_between(F.col("__stop"), cutoff) / 86400,
            "RecoveryStatus": F.when(fail == 0, "No rework evidence")
            .when(F.col("OpenWO"), "Open / right-censored")
            .otherwise("Observed Recovery Only"),
        }
    )
    return staged.withColumn(
        "RecoverySensitivityRange", 10 * (F.col("RecoveryIndexOptimistic") - F.col("RecoveryIndexPessimistic"))
    ).drop("__start", "__stop", "__closed")


def recovery_groups(
    trajectories: DataFrame,
    open_threshold: float | None = None,
    sensitivity_threshold: float | None = None,
    approvals: bool = False,
) -> DataFrame:
    """Group recovery from closed orders, with open-order bounds and a stability flag."""
    fail = F.col("FirstFailQty")
    closed = ~F.col("OpenWO") & (fail > 0)
    # Whole hundredths again: their totals are exact and do not depend on the order of rows.
    earned, best = F.round(F.col("RecoveryNumerator") * 100), F.round(F.col("RecoveryIndexOptimistic") * fail * 100)
    sums = trajectories.groupBy("Process", GROUP).agg(
        (F.sum(F.when(closed, earned)) / 100).alias("__closed_num"),
        F.sum(F.when(closed, fail)).alias("__closed_den"),
        F.sum(fail).alias("FirstFailQty"),
        (F.sum(earned) / 100).alias("__num"),
        (F.sum(best) / 100).alias("__best"),
        F.avg(F.col("OpenWO").cast("double")).alias("OpenWORate"),
        F.count_if(closed).alias("ClosedRecoveryEvidenceN"),
    )
    total = F.when(F.col("FirstFailQty") > 0, F.col("FirstFailQty"))
    out = sums.withColumns(
        {
            "ObservedRecoveryDifficulty": 10 * (1 - F.col("__closed_num") / F.col("__closed_den")),
            "RecoveryIndexPessimistic": F.col("__num") / total,
            "RecoveryIndexOptimistic": F.coalesce("__best", F.lit(0.0)) / total,
        }
    ).withColumn("RecoverySensitivityRange", 10 * (F.col("RecoveryIndexOptimistic") - F.col("RecoveryIndexPessimistic")))
    span = F.col("RecoverySensitivityRange")
    unstable = or_false(span > F.lit(sensitivity_threshold)) if sensitivity_threshold is not None else F.lit(False)
    stable = (
        (F.col("OpenWORate") <= F.lit(open_threshold))
        & (span <= F.lit(sensitivity_threshold))
        & F.col("ObservedRecoveryDifficulty").isNotNull()
        if approvals and open_threshold is not None and sensitivity_threshold is not None
        else F.lit(False)
    )
    flag = F.when(unstable, "RecoveryUnstable").when(or_false(stable), "Pilot Provisional").otherwise("RecoveryDiagnosticOnly")
    return out.withColumn("RecoveryStabilityFlag", flag).drop("__closed_num", "__closed_den", "__num", "__best")


def classify_dispositions(tickets: DataFrame) -> DataFrame:
    """Disposition, its source, validity and quantity per class for every ticket."""
    text, status = folded("Description"), folded("Status")
    explicit = disposition_of(F.col("Description"))
    label = disposition_of(F.col("Description"), F.col("Status"))
    qty = to_double("Qty")
    valid = or_false((qty >= 0) & is_whole(qty)) & label.isNotNull()
    conflict = ((explicit == "Pass") & (status == "fail")) | (explicit.isin("Rework", "Scrap") & (status == "pass"))
    out = tickets.withColumns(
        {
            "Disposition": label,
            "DispositionSource": F.when(text == "", "Status fallback").otherwise("Description"),
            "DispositionValid": valid,
            "DescriptionStatusConflict": or_false(conflict),
        }
    )
    return out.withColumns(
        {
            f"Classified{kind}Qty": F.when(
                F.col("DispositionValid"), F.when(F.col("Disposition") == kind, qty).otherwise(0.0)
            )
            for kind in ("Pass", "Rework", "Scrap")
        }
    )


def disposition_rounds(classified: DataFrame) -> DataFrame:
    """Per-round quantities; supplied round totals override the ticket sums."""
    kinds = {"Pass": "RoundPassQty", "Rework": "RoundReworkQty", "Scrap": "RoundScrapQty"}
    for c in [*kinds.values(), "RoundActualQty"]:
        if c not in classified.columns:
            classified = classified.withColumn(c, F.lit(None).cast("double"))
    rows = classified.groupBy("WO", "Item", "RoundNo").agg(
        F.count("*").alias("TicketCount"),
        F.bool_and("DispositionValid").alias("AllTicketsValid"),
        *[F.coalesce(F.sum(f"Classified{k}Qty"), F.lit(0.0)).alias(f"__{k}") for k in kinds],
        *[F.max(c).alias(c) for c in [*kinds.values(), "RoundActualQty"]],
        F.min("QcStart").alias("FirstCreated"),
        F.max("QcStart").alias("LastCreated"),
        F.min("ExpectedQty").alias("ExpectedQty"),
        F.max("ExpectedQty").alias("__expected_max"),
    )
    authoritative = F.col("RoundActualQty").isNotNull()
    rows = rows.withColumns(
        {f"{k}Qty": F.when(authoritative, F.col(c)).otherwise(F.col(f"__{k}")) for k, c in kinds.items()}
    )
    actual = sum((F.coalesce(f"{k}Qty", F.lit(0.0)) for k in kinds), F.lit(0.0))
    rows = rows.withColumn("ActualQty", actual).withColumn(
        "QuantityReconciled",
        or_false(
            (F.col("ExpectedQty") == F.col("__expected_max"))
            & (F.col("ActualQty") == F.col("ExpectedQty"))
            & F.col("AllTicketsValid")
        ),
    )
    blank = {c: F.when(F.col("AllTicketsValid"), F.col(c)) for c in ("PassQty", "ReworkQty", "ScrapQty", "ActualQty")}
    return rows.withColumns(blank).drop("__expected_max", *[f"__{k}" for k in kinds], *kinds.values(), "RoundActualQty")


def disposition_summary(classified: DataFrame, rounds: DataFrame) -> DataFrame:
    """Single-pass statistics as (Metric, Value) rows."""
    counted = with_group_stats(classified, ["TicketId"], F.count("*").alias("__copies"))
    facts = counted.agg(
        F.count("*").cast("double").alias("tickets"),
        *[F.sum(f"Classified{k}Qty").alias(f"quantity {k}") for k in ("Pass", "Rework", "Scrap")],
        F.count_if(~F.col("DispositionValid")).cast("double").alias("invalid tickets"),
        F.count_if(F.col("__copies") > 1).cast("double").alias("duplicate ticket rows"),
        F.count_if(F.col("DescriptionStatusConflict")).cast("double").alias("description status conflicts"),
    )
    per_round = rounds.agg(
        F.count("*").cast("double").alias("rounds"),
        F.count_if(~F.col("QuantityReconciled")).cast("double").alias("rounds not reconciled"),
    )
    return facts.unpivot([], facts.columns, "Metric", "Value").unionByName(
        per_round.unpivot([], per_round.columns, "Metric", "Value")
    )


def ticket_exclusions(reasons: list[tuple[Column, str]]) -> Column:
    """Prioritised exclusion code; the first failing check names the row."""
    return first_reason(reasons)
