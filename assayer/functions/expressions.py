"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

TEXT_DISPOSITIONS = {"đạt": "Pass", "sửa": "Rework", "hỏng": "Scrap"}  # fixed values: QC vocabulary


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_text(col: Column | str) -> Column:
    """Trimmed text; blank becomes null."""
    return F.nullif(F.trim(_c(col).cast("string")), F.lit(""))


def folded(col: Column | str) -> Column:
    """Trimmed, lower-cased text for vocabulary look-ups; null becomes blank."""
    return F.lower(F.trim(F.coalesce(_c(col).cast("string"), F.lit(""))))


def to_double(col: Column | str) -> Column:
    """Numeric coercion: unparsable, NaN and infinite values become null."""
    value = _c(col).try_cast("double")
    return F.when(is_finite(value), value)


def to_timestamp(col: Column | str) -> Column:
    return _c(col).try_cast("timestamp_ntz")


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def is_whole(value: Column) -> Column:
    return value % 1 == 0


def or_false(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def or_true(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(True))


def is_close(actual: Column, expected: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Asymmetric closeness: the tolerance scales with the expected side."""
    return F.abs(actual - expected) <= F.lit(atol) + F.lit(rtol) * F.abs(expected)


def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(x, -30.0, 30.0)))


def expit(x: Column) -> Column:
    """Logistic without clipping of the argument (safe for |x| < 700)."""
    return 1.0 / (1.0 + F.exp(-clip(x, -700.0, 700.0)))


def logit(p: Column) -> Column:
    return F.ln(p / (1.0 - p))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def binomial_nll(passed: Column, inspected: Column, p: Column) -> Column:
    return -(passed * F.ln(p) + (inspected - passed) * F.log1p(-p))


def left_closed_decile(p: Column) -> Column:
    """Bin 0..9 with [low, high) edges; 1.0 belongs to the last bin."""
    return F.least(F.floor(p * 10), F.lit(9)).cast("bigint")


def right_closed_decile(p: Column) -> Column:
    """Bin 0..9 with (low, high] edges; 0.0 belongs to the first bin."""
    return F.greatest(F.ceil(p * 10) - 1, F.lit(0)).cast("bigint")


def seconds_between(start: Column, stop: Column) -> Column:
    return (micros(stop) - micros(start)) / F.lit(1e6)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-free timestamp (session zone pinned to UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def first_reason(checks: list[tuple[Column, str]], default: Column | None = None) -> Column:
    """First failing check wins; an unknown predicate counts as failing."""
    chain = reduce(
        lambda acc, item: acc.when(or_true(item[0]), F.lit(item[1])),
        checks[1:],
        F.when(or_true(checks[0][0]), F.lit(checks[0][1])),
    )
    return chain.otherwise(default if default is not None else F.lit(""))


def last_reason(checks: list[tuple[Column, str]]) -> Column:
    """The latest failing check overrides the earlier ones; null when all pass."""
    return F.coalesce(*[F.when(cond, F.lit(text)) for cond, text in reversed(checks)])


def joined_reasons(checks: list[tuple[Column, str]], when_clear: str) -> Column:
    """All failing checks joined in order, or a fixed text when none fails."""
    found = F.concat_ws("; ", *[F.when(or_false(cond), F.lit(text)) for cond, text in checks])
    return F.when(found == "", F.lit(when_clear)).otherwise(found)


def ladder(value: Column, edges: list[tuple[float, float]], top: float) -> Column:
    """Score of the first (upper edge, score) whose edge is not below the value."""
    chain = F.when(value.isNull(), F.lit(None).cast("double"))
    for edge, score in edges:
        chain = chain.when(value <= F.lit(edge), F.lit(float(score)))
    return chain.otherwise(F.lit(float(top)))


def guard_formula(col: Column) -> Column:
    """Neutralise text that a spreadsheet would evaluate."""
    return F.when(col.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), col)).otherwise(col)


def unit_uniform(*parts: Column) -> Column:
    """Uniform (0, 1) draw that is a pure function of its key parts."""
    bits = F.pmod(F.xxhash64(*parts), F.lit(2**52))
    return (bits.cast("double") + 0.5) / F.lit(float(2**52))


def standard_normal(*parts: Column) -> Column:
    """Deterministic normal draw: Box-Muller over two keyed uniforms."""
    radius = F.sqrt(-2.0 * F.ln(unit_uniform(F.lit("radius"), *parts)))
    return radius * F.cos(2.0 * F.pi() * unit_uniform(F.lit("angle"), *parts))


def sorted_percentile(values: Column, share: float) -> Column:
    """Percentile of an ascending array, interpolated as ``percentile`` does; null of an empty one."""
    place = (F.size(values) - 1) * F.lit(share)
    low, high = F.floor(place), F.ceil(place)
    below, above = (F.get(values, k.cast("int")) for k in (low, high))
    return F.when(low == high, below).otherwise((high - place) * below + (place - low) * above)


def poisson_one(*parts: Column) -> Column:
    """Poisson(1) bootstrap weight from one keyed uniform (tail beyond 8 has mass 1e-6)."""
    u = unit_uniform(*parts)
    cumulative, term, chain = 0.0, 2.718281828459045**-1, None
    for k in range(9):
        term = term if k == 0 else term / k
        cumulative += term
        step = u < F.lit(cumulative)
        chain = F.when(step, F.lit(k)) if chain is None else chain.when(step, F.lit(k))
    return chain.otherwise(F.lit(9))


SQL_FUNCTIONS = {
    "logistic": "(x DOUBLE) RETURNS DOUBLE RETURN 1 / (1 + exp(-greatest(least(x, 30D), -30D)))",
    "count_score": (
        "(n DOUBLE) RETURNS DOUBLE RETURN CASE WHEN n IS NULL THEN NULL WHEN n <= 2 THEN n WHEN n <= 4 THEN 3 "
        "WHEN n <= 9 THEN 4 WHEN n <= 20 THEN 5 WHEN n <= 39 THEN 6 WHEN n <= 76 THEN 7 WHEN n <= 149 THEN 8 "
        "WHEN n <= 359 THEN 9 ELSE 10 END"
    ),
    "confidence_tier": (
        "(lo DOUBLE, hi DOUBLE) RETURNS STRING RETURN CASE WHEN lo IS NULL OR hi IS NULL OR hi < lo THEN 'Low' "
        "WHEN hi - lo <= 0.8 THEN 'High' WHEN hi - lo <= 1.8 THEN 'Medium' ELSE 'Low' END"
    ),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Expose the shared formulas to SQL users as temporary functions."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return sorted(SQL_FUNCTIONS)
