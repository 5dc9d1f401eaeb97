"""Structured Streaming jobs whose result on finite input equals their batch twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assayer.session import ensure_checkpoint_dir


def file_stream(spark: SparkSession, path: str, schema: StructType, pattern: str = "*.parquet", fmt: str = "parquet") -> DataFrame:
    """Incremental scan of files dropped into a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).format(fmt).load(path)


def _workspace(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint directory."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def ingest(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Append everything available to a bronze table; reruns pick up only new files."""
    query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    query.trigger(availableNow=True).start().awaitTermination()


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all available input into a table and return that table."""
    spark = stream.sparkSession
    root = _workspace(spark)
    writer = stream.writeStream.option("checkpointLocation", f"{root}/state").outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{root}/out").trigger(availableNow=True).start()
    else:

        def replace(batch: DataFrame, number: int) -> None:
            batch.withColumn("BatchId", F.lit(number)).write.mode("overwrite" if mode == "complete" else "append").parquet(f"{root}/out")

        query = writer.foreachBatch(replace).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out")


def unique_tickets(stream: DataFrame, key: str, time: str, delay: str = "10 days") -> DataFrame:
    """Each identifier once within the allowed lateness."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def split_late(stream: DataFrame, time: str, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """(on time, after the cutoff with a reason)."""
    late = F.col(time) > F.lit(cutoff).cast("timestamp")
    return stream.filter(~late), stream.filter(late).withColumn("Reason", F.lit("After source cutoff"))


def daily_yield(stream: DataFrame, time: str, key: str, passed: str, inspected: str, delay: str = "1 day") -> DataFrame:
    """Tumbling-day yield per key."""
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.window(time, "1 day").alias("w"), key)
        .agg(F.sum(passed).alias("PassQty"), F.sum(inspected).alias("InspectedQty"))
        .select(F.col("w.start").alias("Day"), key, "PassQty", "InspectedQty", (F.col("PassQty") / F.col("InspectedQty")).alias("FPY"))
    )


def labour_sessions(stream: DataFrame, time: str, worker: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Gap-based sessions per worker."""
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.session_window(time, gap).alias("s"), worker)
        .agg(F.count("*").alias("Events"))
        .select(worker, F.col("s.start").alias("SessionStart"), F.col("s.end").alias("SessionEnd"), "Events")
    )


def open_trajectories(rounds: DataFrame) -> DataFrame:
    """Running recovery state per order: three numbers, however many rounds arrive."""
    state = rounds.groupBy("WO").agg(
        F.sum(F.when(F.col("RoundNo") == 1, F.coalesce(F.col("ReworkQty").cast("double"), F.lit(0.0))).otherwise(0.0)).alias("FirstFailQty"),
        F.sum(F.when(F.col("RoundNo") >= 2, F.coalesce(F.col("PassQty").cast("double"), F.lit(0.0))).otherwise(0.0)).alias("RecoveredQty"),
        F.max(F.col("RoundNo").cast("bigint")).alias("RoundsReached"),
    )
    remaining = F.greatest(F.lit(0.0), F.col("FirstFailQty") - F.col("RecoveredQty"))
    return state.select("WO", "FirstFailQty", "RecoveredQty", remaining.alias("RemainingFailQty"), "RoundsReached", (remaining > 0).alias("OpenWO"))


def overlap_alerts(events: DataFrame) -> DataFrame:
    """Intervals that start before an earlier one of the same worker and order has stopped, over all available input.

    The state is one timestamp per worker, order and trigger that had rows of theirs, in a table next to the alerts; a
    trigger writes both under its number, so one that is run again replaces what it wrote.
    """
    spark, root, who = events.sparkSession, _workspace(events.sparkSession), ["WO", "Worker"]
    rows = events.select("EventId", *who, "WorkerStart", "WorkerStop")
    earlier = W.partitionBy(*who).orderBy(F.col("WorkerStart").asc_nulls_last(), "EventId").rowsBetween(W.unboundedPreceding, -1)

    def watch(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        placed = batch.withColumn("until", F.max("WorkerStop").over(earlier))
        if number:
            known = batch.sparkSession.read.parquet(f"{root}/until").filter(F.col("BatchId") < number)
            known = known.groupBy(*[F.col(c).alias(f"__{c}") for c in who]).agg(F.max("until").alias("__until"))
            same = F.col("WO").eqNullSafe(F.col("__WO")) & F.col("Worker").eqNullSafe(F.col("__Worker"))
            placed = placed.join(known, same, "left").withColumn("until", F.greatest("until", "__until"))
        late = F.coalesce(F.col("WorkerStart") < F.col("until"), F.lit(False))
        placed.select("EventId", *who, late.alias("Late")).write.mode("overwrite").parquet(f"{root}/out/BatchId={number}")
        batch.groupBy(*who).agg(F.max("WorkerStop").alias("until")).write.mode("overwrite").parquet(f"{root}/until/BatchId={number}")
        batch.unpersist()

    writer = rows.writeStream.option("checkpointLocation", f"{root}/state").foreachBatch(watch)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")
