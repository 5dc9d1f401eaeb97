"""Registry of runnable queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.session import configure
from assayer.sources import bridge

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}
DIGITS = 6


class Inputs:
    """Lazy access to the bridge views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return bridge.view(self.spark, self.sf_dir, name)

    def raw(self, name: str) -> DataFrame:
        return bridge.table(self.spark, self.sf_dir, name)


def query(check: str | None = None, views: tuple[str, ...] = (), name: str | None = None):
    """Register a query; ``check`` is the body of its SQL twin over the named bridge views."""

    def add(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        key = name or fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(Inputs(spark, sf_dir))

        run.__name__ = key
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if check is not None:
            body = check.strip()
            if views:
                prefix = bridge.with_clause(*views)
                if body.startswith("WITH RECURSIVE "):
                    body = f"WITH RECURSIVE {prefix[5:]},\n{body[15:].lstrip()}"
                else:
                    body = f"{prefix},\n{body[5:].lstrip()}" if body.startswith("WITH ") else f"{prefix}\n{body}"
            CHECKS[key] = body
        return fn

    return add


def _half_away(value: Column) -> Column:
    """Binary rounding, half away from zero, as the checking engine rounds doubles."""
    scale = float(10**DIGITS)
    scaled = F.abs(value) * scale
    rounded = F.signum(value) * F.floor(scaled + 0.5) / scale + F.lit(0.0)
    return F.when(scaled < 9e15, rounded).otherwise(value)


def shown(df: DataFrame, *columns: str) -> DataFrame:
    """Portable output: doubles rounded, counts as bigint, timestamps as text."""
    df = df.select(*columns) if columns else df
    out = []
    for field in df.schema.fields:
        col, kind = F.col(f"`{field.name}`"), field.dataType.typeName()
        if kind in ("double", "float", "decimal"):
            col = _half_away(col.cast("double"))
        elif kind in ("integer", "short", "byte"):
            col = col.cast("bigint")
        elif kind in ("timestamp", "timestamp_ntz"):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            col = F.date_format(col, "yyyy-MM-dd")
        out.append(col.alias(field.name))
    return df.select(*out)
