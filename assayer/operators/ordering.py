"""Exact ranks, quantiles and prefix totals that never sort a whole group in one task.

Every helper collapses rows to distinct values, cuts each key's value range into
order-preserving blocks, totals the blocks, and only sorts inside a block. A key that owns
a third of all rows is therefore spread over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.session import cut_lineage

SLOTS = 1024


def _block(value: Column, low: Column, high: Column) -> Column:
    """Monotone block number: linear position between the extremes, refined by magnitude."""
    span = high - low
    linear = F.when(span > 0, F.floor((value - low) / span * SLOTS)).otherwise(F.lit(0))
    size = F.floor(F.log2(F.greatest(F.abs(value), F.lit(1e-300))) * 16)
    signed = F.when(value < 0, -size - 17000).when(value > 0, size + 17000).otherwise(F.lit(0))
    return linear.cast("bigint") * 131072 + signed.cast("bigint")


def prefix_totals(
    df: DataFrame, keys: list[str], value: str, measures: dict[str, Column], minimum: bool = False
) -> DataFrame:
    """One row per (keys, value): each measure's total at the value, below it, and overall.

    Columns per measure m: ``m``, ``m_before`` (strictly smaller values), ``m_total``. With
    ``minimum`` the running minimum replaces the running total.
    """
    names = list(measures)
    fold = F.min if minimum else F.sum

    def merge(base: Column, part: Column) -> Column:
        return F.least(base, part) if minimum else F.coalesce(base, F.lit(0)) + F.coalesce(part, F.lit(0))

    cells = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        *[fold(expr).alias(name) for name, expr in measures.items()]
    )
    cells = cut_lineage(cells)  # read three times below; the input is scanned once
    position = F.col(value).cast("double")
    extent = cells.groupBy(*keys).agg(
        F.min(position).alias("__from"),
        F.max(position).alias("__upto"),
        *[fold(name).alias(f"{name}_total") for name in names],
    )
    placed = _equi(cells, extent, keys).withColumn("__block", _block(position, F.col("__from"), F.col("__upto")))
    earlier_blocks = W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    blocks = placed.groupBy(*keys, "__block").agg(*[fold(name).alias(f"__base_{name}") for name in names])
    blocks = blocks.select(
        *keys, "__block", *[fold(f"__base_{name}").over(earlier_blocks).alias(f"__base_{name}") for name in names]
    )
    inside = W.partitionBy(*keys, "__block").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return placed.join(blocks, [*keys, "__block"]).select(
        *keys,
        value,
        *names,
        *[merge(F.col(f"__base_{name}"), fold(name).over(inside)).alias(f"{name}_before") for name in names],
        *[f"{name}_total" for name in names],
    )


def _equi(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    # A key-less aggregate is one row, so the keyless branch is a scalar attach.
    return left.join(right, keys) if keys else left.join(right)


def ranked(df: DataFrame, keys: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """Rank facts per distinct value: ``n`` (ties or total weight), ``n_before``, ``n_total``."""
    return prefix_totals(df, keys, value, {"n": F.lit(1) if weight is None else weight})


def average_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Attach the 1-based rank with ties averaged."""
    facts = ranked(df, keys, value).select(
        *keys, value, (F.col("n_before") + (F.col("n") + 1) / 2).alias(name)
    )
    return df.join(facts, [*keys, value], "left")


def midpoint_score(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Attach the 0-10 midpoint percentile of each value within its key; 5 for a lone value."""
    left, right = F.col("n_before"), F.col("n_before") + F.col("n")
    score = F.when(F.col("n_total") == 1, F.lit(5.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(10.0), 10 * (left + right - 1) / 2 / (F.col("n_total") - 1)))
    )
    return df.join(ranked(df, keys, value).select(*keys, value, score.alias(name)), [*keys, value], "left")


def quantiles(
    df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], method: str = "linear", weight: Column | None = None
) -> DataFrame:
    """Exact quantiles per key by rank selection (``linear`` interpolation or ``higher``).

    Whole-number weights count a value as often as its weight says.
    """
    facts = ranked(df, keys, value, weight)
    first, last = F.col("n_before"), F.col("n_before") + F.col("n") - 1

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= first) & (rank <= last), F.col(value).cast("double")))

    out = []
    for name, p in wanted.items():
        h = (F.col("n_total") - 1) * F.lit(float(p))
        if method == "higher":
            out.append(at(F.ceil(h)).alias(name))
        else:
            fraction = F.max(h - F.floor(h))
            out.append((at(F.floor(h)) + fraction * (at(F.ceil(h)) - at(F.floor(h)))).alias(name))
    return facts.groupBy(*keys).agg(*out)


def row_positions(df: DataFrame, keys: list[str], block: Column, order: list[Column], name: str = "Position") -> DataFrame:
    """1-based row number within keys, and the key's row count as ``<name>Total``.

    ``block`` must be a monotone function of the leading order column (a day, a prefix), so
    a long history is numbered block by block.
    """
    staged = df.withColumn("__block", block)
    blocks = staged.groupBy(*keys, "__block").agg(F.count("*").alias("__rows"))
    earlier = W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(
        *keys,
        "__block",
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__base"),
        F.sum("__rows").over(W.partitionBy(*keys)).alias(f"{name}Total"),
    )
    inside = W.partitionBy(*keys, "__block").orderBy(*order)
    return (
        staged.join(blocks, [*keys, "__block"])
        .withColumn(name, F.col("__base") + F.row_number().over(inside))
        .drop("__block", "__base")
    )
