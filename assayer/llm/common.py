"""Helpers the corpus operators share: settings, shared tables, checked broadcasts and shipping of the package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.session import configure, ensure_checkpoint_dir, ship

# Rows of an Arrow batch: keeps a batch of very long texts small in the Python worker.
BATCH_ROWS = 512
# A side that was counted and measured below this many bytes may be broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024


def prepare(spark: SparkSession) -> SparkSession:
    """Settings of the corpus operators, and the package on every executor."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write a table once into the shared checkpoint folder, in one folder per value of ``by`` if given, and read it back.

    Later steps start from files every executor can read, so a lost executor costs only the step it was in,
    and columns such as row numbers stay what they were at the time of writing.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def offer_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    """Hint a broadcast only where the counted rows at ``row_bytes`` each stay below BROADCAST_BYTES.

    Beyond it the hint is left out and the join shuffles; the rows are the same.
    """
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have; Spark takes names without regard to case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def binary(column: str):
    """UTF-8 bytes of a text column; null is empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(name)).to_pylist() for name in names]


def slices(rows: list[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(rows), size):
        part = rows[start : start + size]
        yield pa.RecordBatch.from_arrays([pa.array(col, type=field.type) for col, field in zip(zip(*part), schema)], schema=schema)
