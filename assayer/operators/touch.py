"""Labour intervals placed against inspection boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.functions.expressions import micros, or_false, or_true, seconds_between
from assayer.operators.contracts import require_columns
from assayer.operators.ordering import prefix_totals
from assayer.session import cut_lineage, settle

WHO = ["WO", "Worker"]
# Intervals of an order that one task reads along.
CROWDED = 100_000


def flag_overlaps(events: DataFrame) -> DataFrame:
    """Overlaps: whether another interval of the same worker and order intersects this one.

    Counts, rather than pairs: intervals that start before this one stops, less those that
    have already stopped when it starts. Inverted intervals are matched by containment.
    """
    known = F.greatest(*[F.col(c).isNull().cast("int") for c in (*WHO, "WorkerStart", "WorkerStop")]) == 0
    keyed = events.withColumns({"a": micros(F.col("WorkerStart")), "b": micros(F.col("WorkerStop"))})
    timed = keyed.filter(known).select(*WHO, "a", "b")
    point = (F.col("a") == F.col("b")).cast("int")
    begin = F.struct(F.col("a").alias("t"), F.lit(1).alias("s"), F.lit(0).alias("e"), point.alias("p"))
    end = F.struct(F.col("b").alias("t"), F.lit(0).alias("s"), F.lit(1).alias("e"), F.lit(0).alias("p"))
    marks = timed.filter("a <= b").select(*WHO, F.inline(F.array(begin, end)))
    totals = cut_lineage(prefix_totals(marks, WHO, "t", {"s": F.col("s"), "e": F.col("e"), "p": F.col("p")}))
    at_stop = totals.select(*WHO, F.col("t").alias("b"), F.col("s_before").alias("__begun"))
    at_start = totals.select(*WHO, F.col("t").alias("a"), (F.col("e_before") + F.col("e")).alias("__ended"), F.col("p").alias("__points"))
    inside = _smallest_nested_start(timed)
    counted = keyed.join(at_stop, [*WHO, "b"], "left").join(at_start, [*WHO, "a"], "left").join(inside, [*WHO, "a"], "left")
    # A zero-length interval does not intersect itself, so it needs two others.
    points = F.when(F.col("a") == F.col("b"), F.col("__points")).otherwise(0)
    crossing = F.coalesce(F.col("__begun") - F.col("__ended") + points, F.lit(0))
    return counted.withColumn("Overlaps", (crossing > 1) | or_false(F.col("__nested") < F.col("b"))).drop(
        "a", "b", "__begun", "__ended", "__points", "__nested"
    )


def _smallest_nested_start(timed: DataFrame) -> DataFrame:
    """Per start a: the smallest start among inverted intervals that stop after a.

    A proper interval (a, b) strictly contains one of them when that start is below b. It is
    a running minimum over descending stops.
    """
    inverted = timed.filter("a > b")
    per_stop = inverted.select(*WHO, (-F.col("b")).alias("t"), F.col("a").alias("low"))
    wanted = timed.filter("a < b").select(*WHO, (-F.col("a")).alias("t"), F.lit(None).cast("bigint").alias("low"))
    points = per_stop.unionByName(wanted.join(inverted.select(*WHO).distinct(), WHO, "left_semi"))
    reach = prefix_totals(points, WHO, "t", {"low": F.col("low")}, minimum=True)
    return reach.select(*WHO, (-F.col("t")).alias("a"), F.col("low_before").alias("__nested"))


def _overlaps_in_order(events: DataFrame) -> DataFrame:
    """``flag_overlaps`` of intervals that lie together, by what runs along the starts of a worker's intervals.

    A proper interval meets another one if an earlier start stops after it begins, or the next one begins before it stops;
    a zero-length one needs two earlier starts that stop after it. Inverted intervals meet those that contain them.
    """
    a, b = micros(F.col("WorkerStart")), micros(F.col("WorkerStop"))
    proper, known = or_false(a <= b), F.col("WO").isNotNull() & F.col("Worker").isNotNull()
    along = W.partitionBy(*WHO).orderBy(proper.desc(), a, b)
    before = along.rowsBetween(W.unboundedPreceding, -1)
    stop = F.when(proper, b)
    backwards = W.partitionBy(*WHO).orderBy(F.when(proper, a).otherwise(b).desc_nulls_last(), proper.desc()).rowsBetween(W.unboundedPreceding, -1)
    staged = events.withColumns({"__last": F.max(stop).over(before), "__next": F.lead(F.when(proper, a)).over(along)})
    staged = staged.withColumn("__second", F.max(F.when(F.col("__last").isNotNull(), F.least(stop, F.col("__last")))).over(before))
    staged = staged.withColumn("__nested", F.min(F.when(or_false(a > b), a)).over(backwards))
    meets = or_false(F.col("__last") > a) | or_false(F.col("__next") < b) | or_false(F.col("__nested") < b)
    crossed = F.when(a == b, or_false(F.col("__second") > a)).otherwise(meets)
    return staged.withColumn("Overlaps", known & proper & crossed).drop("__last", "__next", "__second", "__nested")


def reconstruct_touch(events: DataFrame, rounds: DataFrame) -> DataFrame:
    """Phase, round, attribution and minutes of each labour interval.

    An order's intervals move once and meet its rounds as one row. Orders of more than ``CROWDED`` intervals, counted first,
    are taken apart from their aggregates instead of being read along by one task.
    """
    require_columns(events, ["EventId", "WO", "Worker", "Process", "WorkerStart", "WorkerStop"], "Touch events")
    in_order = W.partitionBy("WO").orderBy("RoundNo")
    spans = rounds.select(
        "WO", "RoundNo", "Process", "QcStart", "QcStop", "FailQty",
        F.lead("QcStart").over(in_order).alias("NextStart"),
        F.lead("RoundNo").over(in_order).alias("NextRound"),
    )
    gap = F.struct(F.col("QcStop").alias("After"), "NextStart", "NextRound")
    orders = spans.groupBy("WO").agg(
        F.min_by("QcStart", "RoundNo").alias("FirstStart"), F.min_by("Process", "RoundNo").alias("OrderProcess"),
        F.collect_list(F.when(F.expr("NextStart IS NOT NULL AND FailQty > 0"), gap)).alias("__gaps"),
    )
    crowded = settle(events.groupBy("WO").agg(F.count("*").alias("n")).filter(F.col("n") > CROWDED).select("WO"))
    if crowded.isEmpty():
        return _phases(_overlaps_in_order(events.repartition("WO")).join(orders, "WO", "left"), alone=True)
    few = events.join(F.broadcast(crowded.filter("WO IS NOT NULL")), "WO", "left_anti")
    many = events.join(F.broadcast(crowded), "WO", "left_semi")
    light = _phases(_overlaps_in_order(few.repartition("WO")).join(orders, "WO", "left"), alone=True)
    return light.unionByName(_phases(flag_overlaps(many).join(orders, "WO", "left"), alone=False))


def _phases(placed: DataFrame, alone: bool) -> DataFrame:
    """Phases of intervals that carry their order's rounds; ``alone``: an order's intervals lie together."""
    ordered = F.col("WorkerStart") <= F.col("WorkerStop")
    before_first = (F.col("WorkerStop") <= F.col("FirstStart")) & (F.col("Process") == F.col("OrderProcess"))
    first = F.when(ordered & before_first, F.col("Worker"))
    if alone:
        order = W.partitionBy("WO")
        placed = placed.withColumns({"__w0": F.min(first).over(order), "__w1": F.max(first).over(order)})
    else:
        placed = placed.join(placed.groupBy("WO").agg(F.min(first).alias("__w0"), F.max(first).alias("__w1")), "WO", "left")
    inside = F.filter("__gaps", lambda g: (F.col("WorkerStart") > g["After"]) & (F.col("WorkerStop") < g["NextStart"]))
    matched = placed.select("*", F.explode_outer(F.transform(inside, lambda g: g["NextRound"])).alias("NextRound"))
    invalid = or_true(~ordered) | F.col("Worker").isNull()
    phase = (
        F.when(invalid, "InvalidTouch")
        .when(F.col("FirstStart").isNull(), "Unclassified")
        .when(F.col("Overlaps"), "OverlappingTouch")
        .when(or_true(F.col("Process") != F.col("OrderProcess")), "OtherProcess")
        .when(F.col("WorkerStop") <= F.col("FirstStart"), "FirstPass")
        .when(F.col("NextRound").isNotNull(), "Rework")
        .otherwise("Unclassified")
    )
    own = F.col("Worker") == F.col("__w0")
    single = F.col("__w0") == F.col("__w1")
    worked = F.col("Phase").isin("FirstPass", "Rework")
    return (
        matched.withColumn("Phase", phase)
        .withColumns(
            {
                "RoundNo": F.when(F.col("Phase") == "FirstPass", 1).when(F.col("Phase") == "Rework", F.col("NextRound")),
                "Attribution": F.when(F.col("Phase") == "FirstPass", "InitialProduction")
                .when((F.col("Phase") == "Rework") & single & own, "SelfRework")
                .when((F.col("Phase") == "Rework") & single, "AssistedRescue")
                .when(F.col("Phase") == "Rework", "AmbiguousInitialWorker")
                .otherwise("Unavailable"),
                "TouchMinutes": F.when(worked, seconds_between(F.col("WorkerStart"), F.col("WorkerStop")) / 60),
            }
        )
        .drop("FirstStart", "OrderProcess", "__w0", "__w1", "__gaps", "NextRound")
    )


def rescue_summary(touches: DataFrame) -> DataFrame:
    """Rework minutes and assisted share by process and worker."""
    rework = touches.filter("Phase = 'Rework'")
    return rework.groupBy("Process", "Worker").agg(
        F.count("*").alias("ReworkTouches"),
        F.count_if(F.col("Attribution") == "AssistedRescue").alias("AssistedTouches"),
        F.sum("TouchMinutes").alias("ReworkMinutes"),
    )
