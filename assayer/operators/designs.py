"""Penalised models on sparse designs: Newton steps, one job each, or by conjugate gradients whose vectors are tables.

A design is long: rows (fit, row, term, value), so a row may belong to any number of terms, such as the workers of its
team at 1 / team size. Rows with the same terms are collapsed before. Fits of at most ``SOLVED_TERMS`` terms, however many
rows, sum their gradients and curvatures inside the tasks, and one task solves a fit's equations: a Newton step is one job
over all of them. Of fits with more terms the coefficients are one table (fit, term, ...); an iteration of conjugate
gradients is one job over all that are still open, and only a few sums per fit reach the driver.
Every fit says how far its steepest gradient is from zero.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.expressions import clip, logistic
from assayer.session import settle, ship

INTERCEPT = "Intercept"
# Terms of a fit whose equations one task solves; numbers of a dense slice of rows, and of the sums a task holds.
SOLVED_TERMS, DENSE_CELLS, HELD_NUMBERS = 400, 2_000_000, 8_000_000


@dataclass(frozen=True)
class DesignFit:
    """(keys, Term, Coefficient) and one health row per fit."""

    coefficients: DataFrame
    health: DataFrame


@dataclass
class _State:
    key: tuple
    fit: int
    steps: int = 0
    iterations: int = 0
    gradient: float = math.inf
    start: float = 0.0
    norm: float = 0.0
    product: float = 0.0
    loss: float = math.inf
    alpha: float = 0.0
    beta: float = 0.0
    searching: bool = True
    converged: bool = False


def _softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


# What a family makes of the linear predictor: (error, curvature, loss) of a row with outcome y and weight n.
FAMILIES = {
    "binomial": lambda eta, y, n: (n * logistic(eta) - y, n * logistic(eta) * (1 - logistic(eta)), n * _softplus(eta) - y * eta),
    "gaussian": lambda eta, y, n: (n * (eta - y), n + F.lit(0.0), 0.5 * n * (eta - y) * (eta - y)),
}


def solve(rows: DataFrame, entries: DataFrame, terms: DataFrame, keys: list[str], family: str = "binomial", tol: float = 1e-7, max_steps: int = 40, max_iterations: int = 400, shared: list[str] | None = None) -> DesignFit:
    """Minimise loss + 1/2 sum Ridge (x - Prior)**2 for every fit.

    ``rows``: keys, row, y, n. ``entries``: keys, row, Term, Value. ``terms``: keys, Term, Ridge, Prior and Start. Solved when
    no gradient of a fit exceeds ``tol`` times its number of rows; health tells it for each fit with its steps.
    ``shared``: the keys of rows and entries where fits that differ in the other keys have the same rows and terms, as fits of
    several penalties do; such rows are moved and kept once.
    """
    terms = settle(terms)
    widths = settle(terms.groupBy(*keys).agg(F.count("*").alias("__terms")))
    few, many = ([tuple(r) for r in widths.filter(which).select(*keys).collect()] for which in (F.col("__terms") <= SOLVED_TERMS, F.col("__terms") > SOLVED_TERMS))
    found = []
    data = shared or keys
    place = [keys.index(k) for k in data]
    if few or not many:
        sets = list(dict.fromkeys(tuple(key[i] for i in place) for key in few))
        found.append(_newton(*_of(sets, data, rows, entries, schema=terms), *_of(few, keys, terms), keys, data, family, tol, max_steps))
    if many:
        rows, entries = ((df if data == keys else df.join(F.broadcast(terms.select(*keys).distinct()), data)) for df in (rows, entries))
        found.append(_iterated(*_of(many, keys, rows, entries, terms), keys, family, tol, max_steps, max_iterations))
    if len(found) == 1:
        return found[0]
    return DesignFit(found[0].coefficients.unionByName(found[1].coefficients), found[0].health.unionByName(found[1].health))


def _of(chosen: list[tuple], keys: list[str], *tables: DataFrame, schema: DataFrame | None = None) -> list[DataFrame]:
    """The rows of the chosen fits."""
    schema = T.StructType([(schema or tables[-1]).schema[k] for k in keys])
    only = tables[-1].sparkSession.createDataFrame(chosen, schema)
    return [df.join(F.broadcast(only), keys, "left_semi") for df in tables]


# The same families on arrays, inside tasks.
_ON_ARRAYS = {
    "binomial": lambda eta, y, n, p: (n * p - y, n * p * (1 - p), n * np.logaddexp(0.0, eta) - y * eta),
    "gaussian": lambda eta, y, n, p: (n * (eta - y), n, 0.5 * n * (eta - y) * (eta - y)),
}


def _sums(family: str, at: dict[int, np.ndarray], members: dict[int, list[int]]):
    """(fit, loss, gradient and curvature as bytes) of the rows of a task at the coefficients ``at`` of the open fits, ``members`` of a set of rows."""
    parts = _ON_ARRAYS[family]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            packed = [total.tobytes() for total in held.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(packed, pa.binary())], names=["__fit", "sums"])

        for batch in batches:
            sets, y, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__set", "y", "n"))
            lists = batch.column("parts")
            flat, lengths = lists.flatten(), np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(len(sets)), lengths)
            place, value = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("place", "v"))
            for number in np.unique(sets):
                fits = [f for f in members[int(number)] if f in at]
                if not fits:
                    continue
                mine, p = np.flatnonzero(sets == number), len(at[fits[0]])
                for k in range(0, len(mine), max(1, DENSE_CELLS // p)):
                    some = mine[k : k + max(1, DENSE_CELLS // p)]
                    line = np.full(len(sets), -1)
                    line[some] = np.arange(len(some))
                    here = line[owner] >= 0
                    design = np.zeros((len(some), p))
                    np.add.at(design, (line[owner[here]], place[here]), value[here])
                    for fit in fits:
                        eta = design @ at[fit]
                        error, curve, loss = parts(eta, y[some], n[some], 0.5 * (1 + np.tanh(0.5 * eta)))
                        total = held.setdefault(fit, np.zeros(1 + p + p * p))
                        total[0] += loss.sum()
                        total[1 : 1 + p] += design.T @ error
                        total[1 + p :] += (design.T @ (design * curve[:, None])).ravel()
            if sum(map(len, held.values())) > HELD_NUMBERS:
                yield out()
                held.clear()
        yield out()

    return run


def _step(at: dict[int, np.ndarray], ridge: dict[int, np.ndarray], prior: dict[int, np.ndarray]):
    """(fit, objective, steepest gradient, Newton step as bytes) from the sums of all tasks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fit = int(pdf["__fit"].iloc[0])
        x, pen, off = at[fit], ridge[fit], at[fit] - prior[fit]
        p = len(x)
        total = np.zeros(1 + p + p * p)
        for part in pdf["sums"]:
            total += np.frombuffer(part)
        slope = total[1 : 1 + p] + pen * off
        curve = total[1 + p :].reshape(p, p) + np.diag(pen)
        curve[np.diag_indices(p)] = np.maximum(curve.diagonal(), 1e-12)
        try:
            step = np.linalg.solve(curve, -slope)
        except np.linalg.LinAlgError:
            step = np.linalg.lstsq(curve, -slope, rcond=None)[0]
        return pd.DataFrame({"__fit": [fit], "loss": [float(total[0] + 0.5 * (pen * off * off).sum())], "steepest": [float(np.abs(slope).max())], "step": [step.tobytes()]})

    return run


def _numbered(terms: DataFrame, keys: list[str]) -> tuple[list[_State], DataFrame]:
    """The fits in order, and a table of their keys and numbers."""
    listed = sorted((tuple(r) for r in terms.select(*keys).distinct().collect()), key=str)
    states = [_State(key, number) for number, key in enumerate(listed)]
    schema = T.StructType([*(terms.schema[k] for k in keys), T.StructField("__fit", T.IntegerType())])
    return states, terms.sparkSession.createDataFrame([(*s.key, s.fit) for s in states], schema)


def _newton(rows: DataFrame, entries: DataFrame, terms: DataFrame, keys: list[str], data: list[str], family: str, tol: float, max_steps: int) -> DesignFit:
    """All fits of few terms, one job a Newton step; a step that does not lower the objective is halved."""
    spark = ship(rows.sparkSession)
    states, numbers = _numbered(terms, keys)
    set_of: dict[tuple, int] = {}
    of_fit = {s.fit: set_of.setdefault(tuple(s.key[keys.index(k)] for k in data), len(set_of)) for s in states}
    members = {number: [f for f, of in of_fit.items() if of == number] for number in set_of.values()}
    sets = spark.createDataFrame([(*key, number) for key, number in set_of.items()], T.StructType([*(terms.schema[k] for k in data), T.StructField("__set", T.IntegerType())]))
    place = F.row_number().over(Window.partitionBy("__fit").orderBy("Term")) - 1
    vocabulary = settle(terms.join(F.broadcast(numbers), keys).select("__fit", *data, "Term", place.alias("place"), "Ridge", "Prior", "Start"))
    places = vocabulary.select(*data, "Term", "place").distinct().join(F.broadcast(sets), data).select("__set", "Term", "place")
    # One exchange takes the outcome of a row and its terms, which its task has already put together, to one place.
    part = F.struct("place", F.col("Value").cast("double").alias("v"))
    lists = entries.join(F.broadcast(sets), data).join(F.broadcast(places), ["__set", "Term"]).select("__set", "row", F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("n"), part.alias("part"))
    outcomes = rows.join(F.broadcast(sets), data).select("__set", "row", F.col("y").cast("double").alias("y"), F.col("n").cast("double").alias("n"), F.lit(None).cast("struct<place:int,v:double>").alias("part"))
    both = outcomes.unionByName(lists).groupBy("__set", "row").agg(F.max("y").alias("y"), F.max("n").alias("n"), F.collect_list("part").alias("parts"))
    packed = settle(both.filter("n IS NOT NULL").select("__set", "y", "n", "parts"))
    counts = {r["__set"]: r["c"] for r in packed.groupBy("__set").agg(F.count("*").alias("c")).collect()}
    sizes = {f: counts[of] for f, of in of_fit.items() if of in counts}
    known: dict[int, list] = {s.fit: [] for s in states}
    for row in vocabulary.orderBy("__fit", "place").collect():
        known[row["__fit"]].append((row["Ridge"], row["Prior"], row["Start"]))
    ridge, prior, at = ({f: np.array([t[k] for t in listed], float) for f, listed in known.items()} for k in range(3))
    before: dict[int, np.ndarray] = {}
    steps: dict[int, np.ndarray] = {}

    open_fits = list(states)
    for step in range(max_steps + 1):
        here = {s.fit: at[s.fit] for s in open_fits}
        sums = packed.filter(F.col("__set").isin(sorted({of_fit[f] for f in here}))).mapInArrow(_sums(family, here, members), "__fit int, sums binary")
        solved = sums.groupBy("__fit").applyInPandas(_step(here, ridge, prior), "__fit int, loss double, steepest double, step binary")
        found = {r["__fit"]: r for r in solved.collect()}
        for s in open_fits:
            row = found[s.fit]
            if s.fit in before and row["loss"] > s.loss + 1e-9 * (1 + abs(s.loss)) and s.alpha > 1e-6 and step < max_steps:
                s.alpha /= 2
                at[s.fit] = before[s.fit] + s.alpha * steps[s.fit]
                continue
            s.gradient, s.loss, s.steps, s.iterations, s.alpha = row["steepest"], row["loss"], step, step, 1.0
            s.converged = s.gradient <= tol * sizes.get(s.fit, 1)
            if not s.converged and step < max_steps:
                before[s.fit], steps[s.fit] = at[s.fit], np.frombuffer(row["step"])
                at[s.fit] = before[s.fit] + steps[s.fit]
        open_fits = [s for s in open_fits if not s.converged]
        if not open_fits:
            break

    values = spark.createDataFrame([(f, k, float(v)) for f, x in at.items() for k, v in enumerate(x)], "__fit int, place int, Coefficient double")
    result = vocabulary.select("__fit", "Term", "place").join(F.broadcast(values), ["__fit", "place"]).join(F.broadcast(numbers), "__fit").select(*keys, "Term", "Coefficient")
    return DesignFit(settle(result), _health(states, sizes, terms, keys))


def _health(states: list[_State], sizes: dict[int, int], terms: DataFrame, keys: list[str]) -> DataFrame:
    names = ["Rows", "Steps", "Iterations", "MaxGradient", "Objective", "Converged"]
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.BooleanType()]
    return terms.sparkSession.createDataFrame(
        [(*s.key, sizes.get(s.fit, 0), s.steps, s.iterations, s.gradient, s.loss, s.converged) for s in states],
        T.StructType([*(terms.schema[k] for k in keys), *(T.StructField(n, k) for n, k in zip(names, kinds))]),
    )


def _iterated(rows: DataFrame, entries: DataFrame, terms: DataFrame, keys: list[str], family: str, tol: float, max_steps: int, max_iterations: int) -> DesignFit:
    """Fits of any number of terms: Newton directions by conjugate gradients over tables."""
    spark = rows.sparkSession
    states, numbers = _numbered(terms, keys)
    rows = settle(rows.join(F.broadcast(numbers), keys).select("__fit", "row", F.col("y").cast("double").alias("y"), F.col("n").cast("double").alias("n")))
    entries = settle(entries.join(F.broadcast(numbers), keys).select("__fit", "row", "Term", F.col("Value").cast("double").alias("v")))
    sizes = {r["__fit"]: r["c"] for r in rows.groupBy("__fit").agg(F.count("*").alias("c")).collect()}
    zero = F.lit(0.0)
    vectors = terms.join(F.broadcast(numbers), keys).select("__fit", "Term", F.col("Ridge").alias("pen"), F.col("Prior").alias("prior"), F.col("Start").alias("x"), *[zero.alias(c) for c in ("d", "r", "p", "m", "q")])
    vectors = settle(vectors)
    parts = FAMILIES[family]

    def along(table: DataFrame, column: str, fits: DataFrame) -> DataFrame:
        """Row sums of the design times a vector."""
        chosen = entries.join(F.broadcast(fits.select("__fit")), "__fit")
        return chosen.join(table.select("__fit", "Term", F.col(column).alias("c")), ["__fit", "Term"]).groupBy("__fit", "row").agg(F.sum(F.col("v") * F.col("c")).alias("sum"))

    def given(open_fits: list[_State], **values: str) -> DataFrame:
        """The numbers of open fits as a small inline table: one row per fit."""
        listed = ", ".join("(" + ", ".join([str(s.fit), *(f"CAST('{getattr(s, a)!r}' AS DOUBLE)" for a in values.values())]) + ")" for s in open_fits)
        return spark.sql(f"SELECT * FROM VALUES {listed} AS t(`{'`, `'.join(['__fit', *values])}`)")

    def linearise(table: DataFrame, fits: DataFrame) -> tuple[DataFrame, DataFrame]:
        error, curve, loss = parts(F.coalesce("sum", zero), F.col("y"), F.col("n"))
        here = rows.join(F.broadcast(fits.select("__fit")), "__fit").join(along(table, "x", fits), ["__fit", "row"], "left")
        here = settle(here.select("__fit", "row", error.alias("e"), curve.alias("w"), loss.alias("loss")))
        sums = entries.join(here, ["__fit", "row"]).groupBy("__fit", "Term").agg(F.sum(F.col("v") * F.col("e")).alias("ge"), F.sum(F.col("v") * F.col("v") * F.col("w")).alias("h"))
        off = F.col("pen") * (F.col("x") - F.col("prior"))
        start = table.join(F.broadcast(fits.select("__fit")), "__fit").join(sums, ["__fit", "Term"], "left").withColumn("g", F.coalesce("ge", zero) + off)
        m = F.greatest(F.coalesce("h", zero) + F.col("pen"), F.lit(1e-12))
        start = start.select("__fit", "Term", "pen", "prior", "x", zero.alias("d"), (-F.col("g")).alias("r"), (-F.col("g") / m).alias("p"), m.alias("m"), zero.alias("q"))
        return here, settle(start)

    def measured(here: DataFrame, table: DataFrame) -> dict[int, tuple[float, float, float]]:
        losses = {r["__fit"]: r["l"] for r in here.groupBy("__fit").agg(F.sum("loss").alias("l")).collect()}
        off = F.col("x") - F.col("prior")
        found = table.groupBy("__fit").agg(F.max(F.abs("r")).alias("g"), F.sum(F.col("r") * F.col("p")).alias("rz"), F.sum(F.col("pen") * off * off / 2).alias("pen"))
        return {r["__fit"]: (r["g"], r["rz"], losses.get(r["__fit"], 0.0) + r["pen"]) for r in found.collect()}

    open_fits, finished = list(states), []
    previous: DataFrame | None = None
    for step in range(max_steps + 1):
        fits = given(open_fits)
        here, linear = linearise(vectors, fits)
        found = measured(here, linear)
        worse = [s for s in open_fits if found[s.fit][2] > s.loss + 1e-9 * (1 + abs(s.loss)) and s.alpha > 1e-6] if previous is not None else []
        good = [s for s in open_fits if s not in worse]
        for s in good:
            s.gradient, s.product, s.loss = found[s.fit]
            s.steps, s.converged, s.alpha = step, s.gradient <= tol * sizes.get(s.fit, 1), 1.0
        leaving = [s for s in good if s.converged] if step < max_steps else open_fits
        if leaving:
            finished.append(vectors.join(F.broadcast(given(leaving)), "__fit").select("__fit", "Term", "x"))
            open_fits = [s for s in open_fits if s not in leaving]
        if not open_fits:
            break
        moving = [s for s in open_fits if s not in worse]
        pieces = []
        if worse:  # half the last step of these
            for s in worse:
                s.alpha /= 2
            back = vectors.join(F.broadcast(given(worse)), "__fit").select("__fit", "Term", "pen", "prior", (F.col("x") - F.col("d") / 2).alias("x"), (F.col("d") / 2).alias("d"), "r", "p", "m", "q")
            pieces.append(back)
        if moving:
            pieces.append(_direction(linear.join(F.broadcast(given(moving)), "__fit"), here, entries, moving, along, given, max_iterations))
        whole = pieces[0] if len(pieces) == 1 else pieces[0].unionByName(pieces[1])
        previous, vectors = linear, settle(whole)

    result = finished[0]
    for part in finished[1:]:
        result = result.unionByName(part)
    coefficients = settle(result.join(F.broadcast(numbers), "__fit").select(*keys, "Term", F.col("x").alias("Coefficient")))
    return DesignFit(coefficients, _health(states, sizes, terms, keys))


def _direction(table: DataFrame, here: DataFrame, entries: DataFrame, fits: list[_State], along, given, max_iterations: int) -> DataFrame:
    """x moved along the Newton direction, found by conjugate gradients that are preconditioned with the diagonal.

    An iteration writes the curvature times the search direction and collects four sums per fit; from these the step, the
    next residual and the next direction follow, and are applied when the next iteration reads the table.
    """
    for s in fits:
        s.start = s.product
        s.searching = s.product > 0
        s.beta = s.norm = 0.0
    rest: list[DataFrame] = []
    searching = [s for s in fits if s.searching]
    if len(searching) < len(fits):
        rest.append(table.join(F.broadcast(given([s for s in fits if not s.searching])), "__fit"))
        table = table.join(F.broadcast(given(searching)), "__fit") if searching else table
    for _number in range(max_iterations):
        if not searching:
            break
        small = given(searching)
        rows = along(table, "p", small).join(here, ["__fit", "row"]).select("__fit", "row", (F.col("w") * F.col("sum")).alias("u"))
        back = entries.join(rows, ["__fit", "row"]).groupBy("__fit", "Term").agg(F.sum(F.col("v") * F.col("u")).alias("back"))
        table = settle(table.drop("q").join(back, ["__fit", "Term"], "left").withColumn("q", F.coalesce("back", F.lit(0.0)) + F.col("pen") * F.col("p")).drop("back"))
        sums = table.groupBy("__fit").agg(
            F.sum(F.col("p") * F.col("q")).alias("pq"), F.sum(F.col("r") * F.col("r") / F.col("m")).alias("rz"), F.sum(F.col("q") * F.col("r") / F.col("m")).alias("qz"), F.sum(F.col("q") * F.col("q") / F.col("m")).alias("qq")
        )
        for row in sums.collect():
            s = next(f for f in searching if f.fit == row["__fit"])
            s.iterations += 1
            s.norm = row["rz"] / row["pq"] if row["pq"] > 0 else 0.0
            after = max(row["rz"] - 2 * s.norm * row["qz"] + s.norm**2 * row["qq"], 0.0)
            s.beta = after / row["rz"] if row["rz"] > 0 else 0.0
            s.product = after
            # Solved more tightly the closer the fit is: the steps then converge faster than linearly.
            s.searching = row["pq"] > 0 and after > s.start * min(0.05, s.start)
        moved = given(searching, a="norm", b="beta")
        table = table.join(F.broadcast(moved), "__fit")
        table = table.withColumns({"d": F.col("d") + F.col("a") * F.col("p"), "r": F.col("r") - F.col("a") * F.col("q")})
        table = table.withColumn("p", F.col("r") / F.col("m") + F.col("b") * F.col("p")).drop("a", "b")
        still = [s for s in searching if s.searching]
        if len(still) < len(searching):
            rest.append(table.join(F.broadcast(given([s for s in searching if not s.searching])), "__fit"))
            table = table.join(F.broadcast(given(still)), "__fit") if still else table
        searching = still
    if searching:
        rest.append(table)
    whole = rest[0]
    for part in rest[1:]:
        whole = whole.unionByName(part)
    return whole.withColumn("x", F.col("x") + F.col("d"))


def outcome_entries(rows: DataFrame, mode: Column, first_round: Column) -> Column:
    """Terms of a quality round: intercept, group, later rounds, workers at 1 / team size, team and unknown indicators."""

    def term(name: Column, value: Column) -> Column:
        return F.struct(name.alias("Term"), value.cast("double").alias("Value"))

    none = F.array().cast("array<struct<Term:string,Value:double>>")
    team = F.coalesce("Workers", F.array().cast("array<string>"))
    base = F.array(term(F.lit(INTERCEPT), F.lit(1.0)), term(F.concat(F.lit("g:"), F.col("SizeAdjustedGroup")), F.lit(1.0)))
    later = F.when(F.col("RoundNo") != first_round, F.array(term(F.concat(F.lit("r:"), F.col("RoundNo").cast("bigint").cast("string")), F.lit(1.0)))).otherwise(none)
    members = F.when((mode != "group") & (F.size(team) > 0), F.transform(team, lambda w: term(F.concat(F.lit("w:"), w), 1 / F.size(team)))).otherwise(none)
    kind = F.when(F.size(team) > 0, "a:team").otherwise("a:unknown")
    open_ = F.when((mode == "expanded") & (F.size(team) != 1), F.array(term(kind, F.lit(1.0)))).otherwise(none)
    return F.concat(base, later, members, open_)


def fit_outcomes(df: DataFrame, keys: list[str], penalties: DataFrame, tol: float = 1e-7) -> DesignFit:
    """Ridge logits of quality rounds: keys, Mode (single, expanded or group), Workers, group, RoundNo, PassQty, InspectedQty.

    ``penalties``: keys and Penalty, a fit each; the fits of a key share its rows. Rows with the same terms are one row. The
    intercept carries a weak penalty of 1e-6, which also keeps fits finite whose rounds all pass or all fail. Rows without a
    group take no part.
    """
    known = df.filter(F.col("SizeAdjustedGroup").isNotNull())
    same = [*keys, "Mode", "SizeAdjustedGroup", "RoundNo", "Workers"]
    cells = known.groupBy(*same).agg(F.sum("PassQty").alias("y"), F.sum("InspectedQty").alias("n"))
    cells = settle(cells.withColumn("row", F.monotonically_increasing_id()))
    facts = settle(cells.groupBy(*keys).agg(F.min("RoundNo").alias("__first"), ((F.sum("y") + 0.5) / (F.sum("n") + 1)).alias("__rate")))
    entries = cells.join(facts.select(*keys, "__first"), keys).select(*keys, "row", F.explode(outcome_entries(cells, F.col("Mode"), F.col("__first"))).alias("t")).select(*keys, "row", "t.*")
    level = F.col("Term") == INTERCEPT
    terms = entries.select(*keys, "Term").distinct().join(facts, keys).join(penalties.select(*keys, F.col("Penalty")), keys).select(
        *keys, "Penalty", "Term", F.when(level, 1e-6).otherwise(F.col("Penalty").cast("double")).alias("Ridge"), F.lit(0.0).alias("Prior"),
        F.when(level, F.ln(F.col("__rate") / (1 - F.col("__rate")))).otherwise(0.0).alias("Start"),
    )
    return solve(cells, entries, terms, [*keys, "Penalty"], "binomial", tol, shared=keys)


def predict_outcomes(df: DataFrame, fit: DesignFit, keys: list[str]) -> DataFrame:
    """Pass probability of rounds (with keys and Mode); terms that training did not hold contribute nothing."""
    numbered = settle(df.withColumn("__id", F.monotonically_increasing_id()))
    entries = numbered.select("__id", *keys, F.explode(outcome_entries(numbered, F.col("Mode"), F.lit(-1))).alias("t")).select("__id", *keys, "t.*")
    eta = entries.join(fit.coefficients, [*keys, "Term"]).groupBy("__id").agg(F.sum(F.col("Value") * F.col("Coefficient")).alias("__eta"))
    return numbered.join(eta, "__id", "left").withColumn("Prediction", clip(logistic(F.coalesce("__eta", F.lit(0.0))), 1e-8, 1 - 1e-8)).drop("__id", "__eta")


def off_balance(df: DataFrame, fit: DesignFit, keys: list[str]) -> DataFrame:
    """(keys, Penalty, Term, Gradient) of the penalised likelihood at the fitted coefficients, from the rows themselves."""
    first = settle(df.groupBy(*keys).agg(F.min("RoundNo").alias("__first")))
    numbered = settle(df.filter(F.col("SizeAdjustedGroup").isNotNull()).join(first, keys).withColumn("__id", F.monotonically_increasing_id()))
    terms = F.explode(outcome_entries(numbered, F.col("Mode"), F.col("__first"))).alias("t")
    # The coefficients of all penalties of a term are one row, and so are a round's predictors; only these move.
    at = settle(fit.coefficients.groupBy(*keys, "Term").agg(F.sort_array(F.collect_list(F.struct("Penalty", "Coefficient"))).alias("at")))
    penalties = F.inline("at")
    eta = numbered.select("__id", *keys, terms).select("__id", *keys, "t.*").join(at, [*keys, "Term"]).select("__id", "Value", penalties)
    eta = eta.groupBy("__id", "Penalty").agg(F.sum(F.col("Value") * F.col("Coefficient")).alias("__eta"))
    error = F.col("InspectedQty") * logistic(F.col("__eta")) - F.col("PassQty")
    rows = numbered.join(eta, "__id").withColumn("__e", error)
    entries = rows.select(*keys, "Penalty", "__e", terms).select(*keys, "Penalty", "__e", "t.*")
    sums = entries.groupBy(*keys, "Penalty", "Term").agg(F.sum(F.col("Value") * F.col("__e")).alias("__g"))
    ridge = F.when(F.col("Term") == INTERCEPT, 1e-6).otherwise(F.col("Penalty"))
    return sums.join(fit.coefficients, [*keys, "Penalty", "Term"]).select(*keys, "Penalty", "Term", (F.col("__g") + ridge * F.col("Coefficient")).alias("Gradient"))
