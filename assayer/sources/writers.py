"""Result sinks: one folder per table, never overwritten, a pointer moved last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.expressions import guard_formula


def write_tables(tables: dict[str, DataFrame], root: str, fmt: str = "parquet") -> list[str]:
    """Each table under its own name; an existing table is an error."""
    paths = []
    for name, df in tables.items():
        path = f"{root}/{name.replace(' ', '_')}"
        if fmt == "csv":
            safe_csv(df).write.mode("errorifexists").option("header", True).csv(path)
        else:
            df.write.mode("errorifexists").format(fmt).save(path)
        paths.append(path)
    return paths


def safe_csv(df: DataFrame) -> DataFrame:
    """Text cells cannot start a spreadsheet formula; nested values become JSON."""
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        kind = field.dataType.typeName()
        if kind == "string":
            col = guard_formula(col)
        elif kind in ("array", "map", "struct"):
            col = F.to_json(col)
        out.append(col.alias(field.name))
    return df.select(*out)


def publish_run(spark: SparkSession, tables: dict[str, DataFrame], root: str, run_id: str) -> str:
    """Write a run's tables, then append the pointer; a failed run never becomes the latest."""
    path = f"{root}/run_id={run_id}"
    write_tables(tables, path)
    entry = spark.range(1).select(F.lit(run_id).alias("RunId"), F.lit(path).alias("Path"), F.current_timestamp().alias("PublishedAt"))
    entry.write.mode("append").parquet(f"{root}/_pointer")
    return path


def latest_run(spark: SparkSession, root: str) -> str:
    row = spark.read.parquet(f"{root}/_pointer").agg(F.max_by("Path", "PublishedAt").alias("p")).first()
    return row["p"]


def save_fit(fit, root: str, name: str) -> None:
    """Effect and health tables of a fit."""
    parts = {"workers": fit.workers, "items": fit.items, "health": fit.health} | ({"rounds": fit.rounds} if fit.rounds is not None else {})
    write_tables({f"{name}_{part}": df for part, df in parts.items()}, root)
