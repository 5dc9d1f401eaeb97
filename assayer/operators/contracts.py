"""Schema, key and cardinality contracts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Input breaks a stated contract; nothing downstream may run on it."""


def require_columns(df: DataFrame, columns: Iterable[str], source: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ContractError(f"{source} missing columns: {missing}")
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def assert_unique(df: DataFrame, keys: list[str], source: str) -> DataFrame:
    if not duplicate_keys(df, keys).isEmpty():
        raise ContractError(f"Duplicate {source} key: {keys}")
    return df


def assert_none(violations: DataFrame, message: str, keys: list[str] | None = None) -> None:
    """Raise when there is a violation; with ``keys`` the text names the first five of them in order."""
    if violations.isEmpty():
        return
    if keys:
        first = violations.select(*keys).distinct().orderBy(*keys).limit(5).collect()
        message = f"{message}: " + "; ".join(" / ".join(str(v) for v in row) for row in first)
    raise ContractError(message)


def assert_functional(df: DataFrame, key: list[str], value: str, message: str) -> DataFrame:
    """Every key maps to at most one non-null value."""
    clash = df.groupBy(*key).agg(F.min(value).alias("lo"), F.max(value).alias("hi")).filter("lo <> hi")
    assert_none(clash, message)
    return df


def checked_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "left", validate: str = "many_to_one"
) -> DataFrame:
    """Join that rejects instead of multiplying rows."""
    if validate in ("one_to_one", "one_to_many"):
        assert_unique(left, on, "left join")
    if validate in ("one_to_one", "many_to_one"):
        assert_unique(right, on, "right join")
    return left.join(right, on, how)


def with_group_stats(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """Attach per-key aggregates to every row; null keys form their own group.

    An aggregate with map-side combine followed by a join keeps a hot key splittable
    (adaptive skew join), where a window over the key would pin it to one task.
    """
    stats = df.groupBy(*keys).agg(*aggs)
    for key in keys:
        stats = stats.withColumnRenamed(key, f"__{key}")
    cond = [df[key].eqNullSafe(stats[f"__{key}"]) for key in keys]
    return df.join(stats, cond, "left").drop(*[f"__{key}" for key in keys])


def split_clean(df: DataFrame, reason: str = "Reason") -> tuple[DataFrame, DataFrame]:
    """(clean, quarantined) by whether a reason is present."""
    return df.filter(F.col(reason).isNull()).drop(reason), df.filter(F.col(reason).isNotNull())


def reconcile(total: DataFrame, parts: list[DataFrame]) -> bool:
    """Row conservation: the input equals clean plus quarantined rows."""
    return total.count() == sum(part.count() for part in parts)
