"""Crossed worker and item effects fitted from distributed sufficient statistics.

Rows collapse once to (fit, worker, item[, round]) cells. A sweep updates one block of effects after the other as
grouped aggregations over the cells, for all fits at once, and is a single job that writes the new effects as one
table; the effects of any number of workers and items stay distributed. Only a few numbers per fit (intercept,
variances, largest moves) reach the driver. There the slow part of such fits, the variances, is extrapolated along its
geometric tail every few sweeps, so that tens of sweeps do. A fit that has converged leaves while the others go on.
Fits of few cells, counted first, are solved directly inside a task each (``localfits``). Time fits of more cells but few
items sum the items' equations inside the tasks (``eliminated``), whatever the workers. The optima are the same.

Rows without a worker or an item take no part in any fit.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.expressions import clip, logistic
from assayer.operators import eliminated as X
from assayer.operators import localfits as L
from assayer.operators.contracts import assert_none
from assayer.session import cut_lineage, settle

# Sweeps between two extrapolations, and the steepest tail that is believed.
EXTRAPOLATE_EVERY, STEEPEST = 6, 0.97


@dataclass(frozen=True)
class EffectFit:
    """Effect tables and one health row per fit key."""

    workers: DataFrame
    items: DataFrame
    health: DataFrame
    rounds: DataFrame | None = None


@dataclass
class Fit:
    """The numbers of one fit that the driver keeps."""

    key: tuple
    at: dict[str, float]
    sweeps: int = 0
    converged: bool = False
    trail: list[dict[str, float]] = field(default_factory=list)

    def extrapolate(self, names: tuple[str, ...]) -> None:
        """Jump along the geometric tail of the last three values of positive parameters."""
        self.trail = [*self.trail, {n: math.log(self.at[n]) for n in names}][-3:]
        if len(self.trail) < 3 or self.sweeps % EXTRAPOLATE_EVERY:
            return
        for n in names:
            first, second = self.trail[1][n] - self.trail[0][n], self.trail[2][n] - self.trail[1][n]
            if first and 0 < second / first < 1:
                ratio = min(second / first, STEEPEST)
                jump = second * ratio / (1 - ratio)
                self.at[n] = math.exp(self.trail[2][n] + max(-1.5, min(1.5, jump)))
        self.trail = []


def _known(df: DataFrame, item: str) -> DataFrame:
    return df.filter(F.col("Worker").isNotNull() & F.col(item).isNotNull())


def _numbers(fits: list[Fit], cells: DataFrame, keys: list[str]) -> DataFrame:
    """One row per fit with its numbers, for joining to the cells."""
    names = list(fits[0].at)
    schema = T.StructType([*(cells.schema[k] for k in keys), *(T.StructField(n, T.DoubleType()) for n in names)])
    return cells.sparkSession.createDataFrame([(*f.key, *(float(f.at[n]) for n in names)) for f in fits], schema)


def _block(table: DataFrame, keys: list[str], kind: str, name: str, **values: str) -> DataFrame:
    """One kind of effect out of the table of a sweep."""
    return table.filter(F.col("Kind") == kind).select(*keys, F.col("Name").alias(name), *[F.col(c).alias(v) for c, v in values.items()])


def _rows(df: DataFrame, keys: list[str], kind: str, name: str, **values: str) -> DataFrame:
    """The reverse of _block: rows (keys, Kind, Name, x, old, y, z) of one kind of effect."""
    columns = [(F.col(values[c]) if c in values else F.lit(None)).cast("double").alias(c) for c in ("x", "old", "y", "z")]
    return df.select(*keys, F.lit(kind).alias("Kind"), F.col(name).cast("string").alias("Name"), *columns)


def _swept(
    table: DataFrame,
    fits: list[Fit],
    cells: DataFrame,
    keys: list[str],
    step: Callable[[DataFrame, DataFrame], DataFrame],
    facts: Callable[[DataFrame, DataFrame], DataFrame],
    update: Callable[[Fit, list[Any]], bool],
    max_iter: int,
) -> tuple[DataFrame, list[Fit]]:
    """Sweep until every fit is done. ``step`` gives the next effects, ``facts`` their few numbers, ``update`` takes them in."""
    table = settle(table)
    alive, done = list(fits), []
    for number in range(1, max_iter + 1):
        if not alive:
            break
        numbers = _numbers(alive, cells, keys)
        table = settle(step(table, numbers))
        found: dict[tuple, list] = {}
        for row in facts(table, numbers).collect():
            found.setdefault(tuple(row[k] for k in keys), []).append(row)
        leaving = []
        for fit in alive:
            fit.sweeps = number
            fit.converged = update(fit, found[fit.key])
            if fit.converged or number == max_iter:
                leaving.append(fit)
        if leaving:
            done.append(table.join(_numbers(leaving, cells, keys).select(*keys), keys, "left_semi"))
            alive = [f for f in alive if f not in leaving]
    whole = done[0] if done else table.limit(0)
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole, fits


def _solved(
    table: DataFrame,
    fits: list[Fit],
    cells: DataFrame,
    keys: list[str],
    local: Callable[[Any], list[tuple]],
    step: Callable[[DataFrame, DataFrame], DataFrame],
    facts: Callable[[DataFrame, DataFrame], DataFrame],
    update: Callable[[Fit, list[Any]], bool],
    max_iter: int,
    local_cells: int | None,
    eliminated: Callable[[DataFrame, list[str], list[Fit]], DataFrame] | None = None,
) -> tuple[DataFrame, list[Fit]]:
    """Effects of all fits: of few cells solved directly, each inside a task; of few items without the workers; the others by distributed sweeps."""
    bound = L.LOCAL_CELLS if local_cells is None else local_cells
    counts = cells.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("ItemKey").alias("items"))
    sizes = {tuple(r[k] for k in keys): (r["n"], r["items"]) for r in counts.collect()}
    small, large = [f for f in fits if sizes[f.key][0] <= bound], [f for f in fits if sizes[f.key][0] > bound]
    reduced = [f for f in large if eliminated and sizes[f.key][1] <= X.SOLVED_ITEMS]
    large = [f for f in large if f not in reduced]
    parts = []
    if small:
        names = ["Kind", "Name", "x", "old", "y", "z"]
        schema = T.StructType([*(cells.schema[k] for k in keys), *(T.StructField(n, T.StringType()) for n in names[:2]), *(T.StructField(n, T.DoubleType()) for n in names[2:])])

        def solve(pdf):
            import pandas as pd

            out = pd.DataFrame(local(pdf), columns=names)
            for place, k in enumerate(keys):
                out.insert(place, k, pdf[k].iloc[0])
            return out

        chosen = cells.join(_numbers(small, cells, keys).select(*keys), keys, "left_semi")
        found = settle(chosen.groupBy(*keys).applyInPandas(solve, schema))
        by_key = {f.key: f for f in small}
        for row in found.filter("Kind = 'number'").collect():
            fit = by_key[tuple(row[k] for k in keys)]
            if row["Name"] == "sweeps":
                fit.sweeps = int(row["x"])
            elif row["Name"] == "converged":
                fit.converged = row["x"] > 0
            else:
                fit.at[row["Name"]] = row["x"]
        parts.append(found.filter("Kind <> 'number'"))
    if reduced:
        parts.append(eliminated(cells, keys, reduced))
    if large:
        chosen = table.join(_numbers(large, cells, keys).select(*keys), keys, "left_semi")
        parts.append(_swept(chosen, large, cells, keys, step, facts, update, max_iter)[0])
    whole = parts[0] if parts else table.limit(0)
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole, fits


def _health(fits: list[Fit], cells: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers of every fit with its sweeps and whether it converged."""
    names = list(fits[0].at) if fits else []
    schema = T.StructType(
        [*(cells.schema[k] for k in keys), *(T.StructField(n, T.DoubleType()) for n in names), T.StructField("Iterations", T.IntegerType()), T.StructField("Converged", T.BooleanType())]
    )
    return cells.sparkSession.createDataFrame([(*f.key, *(float(f.at[n]) for n in names), f.sweeps, f.converged) for f in fits], schema)


def _fits(rows: DataFrame, keys: list[str], names: list[str]) -> list[Fit]:
    return [Fit(tuple(r[k] for k in keys), {n: float(r[n]) for n in names}) for r in rows.collect()]


def time_cells(df: DataFrame, keys: list[str], weight: Column, item: str, copies: Column | None = None, *more: Column) -> DataFrame:
    """Sufficient statistics of weighted log time per fit, worker and item; ``copies`` counts a row several times; ``more`` sums."""
    y, k = F.col("LogTime"), F.lit(1) if copies is None else copies
    return df.withColumns({"__w": weight, "__k": k}).groupBy(*keys, "Worker", F.col(item).alias("ItemKey")).agg(
        F.sum("__k").alias("n"),
        F.sum(F.col("__k") * F.col("__w")).alias("w"),
        F.sum(F.col("__k") * F.col("__w") * y).alias("wy"),
        F.sum(F.col("__k") * F.col("__w") * y * y).alias("wyy"),
        F.sum(F.col("__k") * F.ln("__w")).alias("lnw"),
        F.sum(F.col("__k") * y).alias("y"),
        F.sum(F.col("__k") * y * y).alias("yy"), *more,
    )


def fit_two_way(
    df: DataFrame, keys: list[str], item: str = "Item", max_iter: int = 100, tol: float = 1e-8, copies: Column | None = None,
    local_cells: int | None = None,
) -> EffectFit:
    """Weighted least squares for intercept, worker and item effects; the effects of either kind have weighted mean zero."""
    quantity = F.greatest(F.coalesce("Qty", F.lit(1.0)), F.lit(1.0))
    cells = settle(time_cells(_known(df, item), keys, F.sqrt(quantity), item, copies))
    totals = cells.groupBy(*keys).agg((F.sum("y") / F.sum("n")).alias("mu"), F.sum("n").alias("Records"))
    fits = _fits(totals, keys, ["mu", "Records"])
    start = _rows(cells.select(*keys, "ItemKey").distinct().withColumn("v", F.lit(0.0)), keys, "item", "ItemKey", x="v")
    start = start.unionByName(_rows(cells.select(*keys, "Worker").distinct().withColumn("u", F.lit(0.0)), keys, "worker", "Worker", x="u"))

    def step(table: DataFrame, numbers: DataFrame) -> DataFrame:
        here = cells.join(numbers.select(*keys, "mu"), keys)
        level = here.join(_block(table, keys, "item", "ItemKey", x="v"), [*keys, "ItemKey"])
        workers = level.groupBy(*keys, "Worker").agg((F.sum(F.col("wy") - F.col("w") * (F.col("mu") + F.col("v"))) / F.sum("w")).alias("u"))
        workers = workers.join(_block(table, keys, "worker", "Worker", x="u_old"), [*keys, "Worker"])
        rest = here.join(workers, [*keys, "Worker"]).groupBy(*keys, "ItemKey").agg(
            F.sum(F.col("wy") - F.col("w") * F.col("u")).alias("left"), F.sum("w").alias("w"), F.max("mu").alias("mu")
        )
        items = rest.withColumn("v", F.col("left") / F.col("w") - F.col("mu")).join(_block(table, keys, "item", "ItemKey", x="v_old"), [*keys, "ItemKey"])
        middle = items.groupBy(*keys).agg((F.sum(F.col("left") - F.col("w") * F.col("v")) / F.sum("w")).alias("m")).withColumn("Name", F.lit(""))
        return (
            _rows(workers, keys, "worker", "Worker", x="u", old="u_old")
            .unionByName(_rows(items, keys, "item", "ItemKey", x="v", old="v_old"))
            .unionByName(_rows(middle, keys, "mu", "Name", x="m"))
        )

    def facts(table: DataFrame, numbers: DataFrame) -> DataFrame:
        return table.groupBy(*keys, "Kind").agg(F.max(F.abs(F.col("x") - F.col("old"))).alias("move"), F.max("x").alias("x"))

    def update(fit: Fit, rows: list[Any]) -> bool:
        by = {r["Kind"]: r for r in rows}
        moved = max(by["worker"]["move"], by["item"]["move"], abs(by["mu"]["x"] - fit.at["mu"]))
        fit.at["mu"] = by["mu"]["x"]
        return moved < tol

    final, fits = _solved(start, fits, cells, keys, L.least_squares, step, facts, update, max_iter, local_cells, X.least_squares)
    workers, items = _block(final, keys, "worker", "Worker", x="u"), _block(final, keys, "item", "ItemKey", x="v")
    # The data leave the level of either kind open: it goes into the intercept.
    of_worker, of_item = (cells.groupBy(*keys, e).agg(F.sum("w").alias("w")) for e in ("Worker", "ItemKey"))
    level_u = workers.join(of_worker, [*keys, "Worker"]).groupBy(*keys).agg((F.sum(F.col("w") * F.col("u")) / F.sum("w")).alias("mean_u"))
    level_v = items.join(of_item, [*keys, "ItemKey"]).groupBy(*keys).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("mean_v"))
    levels = cut_lineage(level_u.join(level_v, keys))
    health = _health(fits, cells, keys).join(levels, keys).withColumn("Intercept", F.col("mu") + F.col("mean_u") + F.col("mean_v"))
    health = health.withColumn("Records", F.col("Records").cast("bigint")).select(*keys, "Intercept", "Records", "Iterations", "Converged")
    return EffectFit(
        workers.join(levels, keys).select(*keys, "Worker", (F.col("u") - F.col("mean_u")).alias("WorkerEffect")),
        items.join(levels, keys).select(*keys, "ItemKey", (F.col("v") - F.col("mean_v")).alias("ItemEffect")),
        health,
    )


def fit_two_way_copies(df: DataFrame, keys: list[str], item: str, copies: list[Column], number: str, first: int = 0, workers: bool = True) -> EffectFit:
    """``fit_two_way`` of several weightings of the same rows at once; ``copies`` says how often a row counts in each, ``number`` names them.

    A row moves once with all its counts. Keys of more than ``SOLVED_ITEMS`` items repeat their rows for each weighting.
    Without ``workers`` only the items' effects are made.
    """
    weight, y = F.sqrt(F.greatest(F.coalesce("Qty", F.lit(1.0)), F.lit(1.0))), F.col("LogTime")
    counted = _known(df, item).withColumns({"__w": weight, **{f"__k{c}": k.cast("double") for c, k in enumerate(copies)}})
    sums = [F.sum(F.col(f"__k{c}") * x).alias(f"{name}{c}") for c in range(len(copies)) for name, x in (("w", F.col("__w")), ("wy", F.col("__w") * y))]
    cells = settle(counted.groupBy(*keys, "Worker", F.col(item).alias("ItemKey")).agg(*sums))
    sizes = cells.groupBy(*keys).agg(F.count_distinct("ItemKey").alias("items"))
    few, many = (cut_lineage(sizes.filter(F.col("items") <= X.SOLVED_ITEMS).select(*keys)), cut_lineage(sizes.filter(F.col("items") > X.SOLVED_ITEMS).select(*keys)))
    of_workers, items, health = X.copied_least_squares(cells, keys, len(copies), few, number, first, workers)
    if many.isEmpty():
        return EffectFit(of_workers, items, health.withColumn("Converged", F.lit(True)))
    pairs = F.array(*[F.struct(F.lit(first + c).cast("bigint").alias(number), k.cast("bigint").alias("__k")) for c, k in enumerate(copies)])
    repeated = df.join(F.broadcast(many), keys, "left_semi").select("*", F.inline(pairs)).filter("__k > 0")
    rest = fit_two_way(repeated, [*keys, number], item, copies=F.col("__k"))
    health = health.withColumn("Converged", F.lit(True)).unionByName(rest.health.select(*keys, number, "Intercept", "Converged"))
    return EffectFit(of_workers.unionByName(rest.workers) if workers else None, items.unionByName(rest.items), health)


def fit_time_em(
    df: DataFrame, keys: list[str], item: str = "Item", max_iter: int = 500, tol: float = 1e-7, local_cells: int | None = None
) -> EffectFit:
    """Gaussian random workers and fixed items on log time, fitted to the exact marginal likelihood."""
    # Counted with the cells, so that the rows are read once; cells of no worker or item only tell that.
    wrong = F.count_if(F.expr("LogTime IS NULL OR isnan(LogTime) OR Qty <= 0")).alias("wrong")
    read = settle(time_cells(df, keys, F.sqrt("Qty"), item, None, wrong))
    assert_none(read.filter("wrong > 0"), "Time model requires finite times and positive quantities")
    raw = _known(read.drop("wrong"), "ItemKey")
    mean_w = raw.groupBy(*keys).agg((F.sum("w") / F.sum("n")).alias("m"))
    cells = settle(
        raw.join(mean_w, keys).select(
            *keys, "Worker", "ItemKey", "n", (F.col("w") / F.col("m")).alias("w"), (F.col("wy") / F.col("m")).alias("wy"),
            (F.col("wyy") / F.col("m")).alias("wyy"), (F.col("lnw") - F.col("n") * F.ln("m")).alias("lnw"), "y", "yy",
        )
    )
    mean = F.sum("wy") / F.sum("w")
    sigma = F.greatest(F.sum("wyy") / F.sum("w") - mean * mean, F.lit(1e-8))
    totals = cells.groupBy(*keys).agg(
        mean.alias("mu"), sigma.alias("s2"), F.greatest(sigma * 0.1, F.lit(1e-8)).alias("t2"), F.lit(float("-inf")).alias("ll"),
        F.sum("n").alias("Records"), F.sum("lnw").alias("lnw"), F.count_distinct("ItemKey").alias("Items"),
    )
    fits = _fits(totals, keys, ["mu", "s2", "t2", "ll", "Records", "lnw", "Items"])
    centre = cells.groupBy(*keys).agg(mean.alias("mu"))
    by_worker = cells.join(centre, keys).groupBy(*keys, "Worker").agg(F.sum("w").alias("ww"), F.sum(F.col("wy") - F.col("w") * F.col("mu")).alias("a"), F.sum("n").alias("k"))
    records = cut_lineage(by_worker.select(*keys, "Worker", F.col("k").cast("bigint").alias("WorkerRecords")))
    start = _rows(by_worker, keys, "worker", "Worker", x="a", z="ww")

    def step(table: DataFrame, numbers: DataFrame) -> DataFrame:
        prior = numbers.select(*keys, "s2", "t2")
        expected = _block(table, keys, "worker", "Worker", x="a", z="ww").join(prior, keys)
        expected = expected.select(*keys, "Worker", "ww", (F.col("a") / F.col("s2") / (1 / F.col("t2") + F.col("ww") / F.col("s2"))).alias("u"))
        items = cells.join(expected, [*keys, "Worker"]).groupBy(*keys, "ItemKey").agg(
            (F.sum(F.col("wy") - F.col("w") * F.col("u")) / F.sum("w")).alias("level"), F.sum("w").alias("iw")
        )
        level = F.col("level")
        residual = cells.join(items.select(*keys, "ItemKey", "level"), [*keys, "ItemKey"]).groupBy(*keys, "Worker").agg(
            F.sum(F.col("wy") - F.col("w") * level).alias("a"), F.sum(F.col("wyy") - 2 * F.col("wy") * level + F.col("w") * level * level).alias("q")
        )
        workers = residual.join(expected, [*keys, "Worker"])
        return _rows(workers, keys, "worker", "Worker", x="a", old="u", y="q", z="ww").unionByName(_rows(items, keys, "item", "ItemKey", x="level", z="iw"))

    def facts(table: DataFrame, numbers: DataFrame) -> DataFrame:
        s2, t2, u, a, q, ww = (F.col(c) for c in ("s2", "t2", "old", "x", "y", "z"))
        pv = 1 / (1 / t2 + ww / s2)
        worker = F.col("Kind") == "worker"
        return table.join(numbers.select(*keys, "s2", "t2"), keys).groupBy(*keys).agg(
            F.sum(F.when(worker, q - 2 * u * a + u * u * ww + ww * pv)).alias("rss"),
            F.avg(F.when(worker, u * u + pv)).alias("tau"),
            F.sum(F.when(worker, F.log1p(t2 * ww / s2))).alias("ld"),
            F.sum(F.when(worker, q / s2 - t2 * a * a / (s2 * (s2 + t2 * ww)))).alias("quad"),
            (F.sum(F.when(~worker, ww * a)) / F.sum(F.when(~worker, ww))).alias("mu"),
        )

    def likelihood(at: dict[str, float], row: Any) -> float:
        logdet = at["Records"] * math.log(at["s2"]) - at["lnw"] + row["ld"]
        return -0.5 * (at["Records"] * math.log(2 * math.pi) + logdet + row["quad"])

    def update(fit: Fit, rows: list[Any]) -> bool:
        row = rows[0]
        old, fit.at["ll"] = fit.at["ll"], likelihood(fit.at, row)  # at the variances this sweep started from
        fit.at["mu"] = row["mu"]
        fit.at["s2"], fit.at["t2"] = max(row["rss"] / fit.at["Records"], 1e-10), max(row["tau"], 1e-10)
        if fit.sweeps > 2 and abs(fit.at["ll"] - old) <= tol * (1 + abs(old)):
            return True
        fit.extrapolate(("s2", "t2"))
        return False

    final, fits = _solved(start, fits, cells, keys, L.variance_profile, step, facts, update, max_iter, local_cells, X.variance_profile)
    for row in facts(final, _numbers(fits, cells, keys)).collect() if fits else []:
        fit = next(f for f in fits if f.key == tuple(row[k] for k in keys))
        fit.at["ll"] = likelihood(fit.at, row)
    health = _health(fits, cells, keys)
    levels = _block(final, keys, "item", "ItemKey", x="level", z="iw").join(health.select(*keys, "mu"), keys)
    results = {
        "workers": _block(final, keys, "worker", "Worker", x="a", z="ww").join(records, [*keys, "Worker"]),
        "items": levels.select(*keys, "ItemKey", (F.col("level") - F.col("mu")).alias("v"), "iw"),
        "scalars": health.withColumns({"Records": F.col("Records").cast("bigint"), "Items": F.col("Items").cast("bigint")}),
    }
    return EffectFit(*_time_results(results, keys))


def _time_results(final: dict[str, DataFrame], keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Posterior workers with conditional intervals, item effects, variance shares and criteria."""
    prior = final["scalars"].select(*keys, "s2", "t2")
    pv = 1 / (1 / F.col("t2") + F.col("ww") / F.col("s2"))
    effect, se = F.col("WorkerEffect"), F.col("AbilitySE")
    workers = (
        final["workers"].join(prior, keys)
        .select(*keys, "Worker", (pv * F.col("a") / F.col("s2")).alias("WorkerEffect"), F.sqrt(pv).alias("AbilitySE"), "WorkerRecords")
        .withColumns({"Ability": -effect, "AbilityLower95": -effect - 1.96 * se, "AbilityUpper95": -effect + 1.96 * se})
    )
    items = final["items"].select(*keys, "ItemKey", F.col("v").alias("ItemEffect"), "iw")
    spread = items.groupBy(*keys).agg((F.sum(F.col("iw") * F.col("ItemEffect") * F.col("ItemEffect")) / F.sum("iw")).alias("ItemVariance"))
    health = final["scalars"].join(spread, keys)
    total = F.col("t2") + F.col("ItemVariance") + F.col("s2")
    k = F.col("Items") + 2
    health = health.select(
        *keys, F.col("mu").alias("Intercept"), "Records", "Iterations", "Converged", F.col("ll").alias("LogLikelihood"),
        (-2 * F.col("ll") + 2 * k).alias("AIC"), (-2 * F.col("ll") + F.ln("Records") * k).alias("BIC"),
        F.col("t2").alias("WorkerVariance"), "ItemVariance", F.col("s2").alias("ResidualVariance"),
        (F.col("t2") / total).alias("WorkerShare"), (F.col("ItemVariance") / total).alias("ItemShare"), (F.col("s2") / total).alias("ResidualShare"),
    )
    return workers, items.drop("iw"), health


def predict_log_time(df: DataFrame, fit: EffectFit, keys: list[str], item: str = "Item") -> DataFrame:
    """Frozen prediction; unseen workers and items contribute nothing."""
    out = df.join(fit.health.select(*keys, "Intercept"), keys)
    out = out.join(fit.workers.select(*keys, "Worker", "WorkerEffect"), [*keys, "Worker"], "left")
    effects = fit.items.select(*keys, F.col("ItemKey").alias(item), "ItemEffect")
    out = out.join(effects, [*keys, item], "left")
    return out.withColumn(
        "Prediction", F.col("Intercept") + F.coalesce("WorkerEffect", F.lit(0.0)) + F.coalesce("ItemEffect", F.lit(0.0))
    ).drop("Intercept", "WorkerEffect", "ItemEffect")


def smearing(df: DataFrame, keys: list[str], residual: Column) -> DataFrame:
    """Mean exponentiated residual per key, residuals clipped at 30."""
    return df.groupBy(*keys).agg(F.avg(F.exp(clip(residual, -30.0, 30.0))).alias("Smearing"))


def group_minutes(fit: EffectFit, smear: DataFrame, keys: list[str]) -> DataFrame:
    """Expected minutes per piece of each item at the average worker."""
    return fit.items.join(fit.health.select(*keys, "Intercept", "Converged"), keys).join(smear, keys).withColumn(
        "EstimatedMinutes", 60 * F.exp(F.col("Intercept") + F.col("ItemEffect")) * F.col("Smearing")
    )


@dataclass(frozen=True)
class Shrinkage:
    """How a crossed logit is regularised: adaptive variances, or one fixed penalty per fit."""

    penalty: str | None = None  # column with the fixed ridge penalty; None adapts the variances
    intercept: float = 0.0
    use_workers: bool = True

    @property
    def adaptive(self) -> bool:
        return self.penalty is None


def logit_cells(df: DataFrame, keys: list[str]) -> DataFrame:
    """Passed and inspected pieces per fit, worker, group and round; rows may stand for several Rounds."""
    count = F.sum("Rounds") if "Rounds" in df.columns else F.count("*")
    return df.groupBy(*keys, "Worker", F.col("SizeAdjustedGroup").alias("ItemKey"), F.col("RoundNo").cast("bigint").alias("RoundNo")).agg(
        F.sum("PassQty").alias("y"), F.sum("InspectedQty").alias("n"), count.alias("obs")
    )


def fit_crossed_logit(
    df: DataFrame, keys: list[str], shrink: Shrinkage = Shrinkage(), max_iter: int = 1000, tol: float = 1e-5, local_cells: int | None = None
) -> EffectFit:
    """Binomial logit with worker, group and round effects.

    A sweep linearises the likelihood once and updates workers, groups, rounds and the intercept in turn. Adaptive
    shrinkage re-estimates the variances as mean squared effects. With a fixed penalty the result is the ridge optimum;
    shifting a block's mean into the intercept leaves the likelihood unchanged, so that direction is solved exactly.
    """
    extra = [shrink.penalty] if shrink.penalty else []
    source = _known(df if shrink.use_workers else df.withColumn("Worker", F.lit("*")), "SizeAdjustedGroup")
    cells = logit_cells(source, [*keys, *extra])
    if shrink.use_workers and shrink.adaptive:
        cells = settle(cells)
        size = cells.groupBy(*keys).agg(
            F.sum("obs").alias("rows"), F.count_distinct("Worker").alias("nw"), F.count_distinct("ItemKey").alias("ng")
        )
        cells = cells.join(size.filter("rows >= 2 AND nw >= 2 AND ng >= 2").select(*keys), keys, "left_semi")
    cells = settle(cells)
    evidence = {
        name: cut_lineage(cells.groupBy(*keys, entity).agg(F.sum("obs").alias("EvidenceN")))
        for name, entity in (("workers", "Worker"), ("items", "ItemKey"), ("rounds", "RoundNo"))
    }
    rate = clip(F.sum("y") / F.sum("n"), 1e-8, 1 - 1e-8) if shrink.adaptive else (F.sum("y") + 0.5) / (F.sum("n") + 1)
    spread = 1 / F.max(shrink.penalty) if extra else F.lit(0.5)
    totals = cells.groupBy(*keys).agg(
        F.ln(rate / (1 - rate)).alias("mu"), spread.alias("tw"), spread.alias("tg"), F.sum("obs").alias("Observations"), F.min("RoundNo").alias("r0"),
        F.lit(0.0).alias("cu"), F.lit(0.0).alias("cv"), F.lit(float("inf")).alias("Delta"),
    )
    fits = _fits(totals, keys, ["mu", "tw", "tg", "Observations", "r0", "cu", "cv", "Delta"])
    entities = (("worker", "Worker"), ("item", "ItemKey"), ("round", "RoundNo"))
    start = None
    for kind, entity in entities:
        block = _rows(cells.select(*keys, entity).distinct().withColumn("x", F.lit(0.0)), keys, kind, entity, x="x")
        start = block if start is None else start.unionByName(block)
    local = L.crossed_logit(shrink.adaptive, shrink.penalty, shrink.intercept, shrink.use_workers, max_iter, tol)
    step = _logit_step(cells.drop(*extra), keys, shrink)
    final, fits = _solved(start, fits, cells, keys, local, step, _logit_facts(keys), _logit_update(shrink, tol), max_iter, local_cells)
    return _logit_results(final, _health(fits, cells, keys) if fits else _health([], cells, keys).select(*keys, *[F.lit(0.0).alias(n) for n in ("mu", "tw", "tg", "Observations", "r0", "cu", "cv", "Delta")], "Iterations", "Converged"), keys, evidence)


def _logit_step(cells: DataFrame, keys: list[str], shrink: Shrinkage):
    def step(table: DataFrame, numbers: DataFrame) -> DataFrame:
        scalars = numbers.select(*keys, "mu", "tw", "tg", "r0", "cu", "cv")
        base = (
            cells.join(scalars, keys)
            .join(_block(table, keys, "worker", "Worker", x="u"), [*keys, "Worker"])
            .join(_block(table, keys, "item", "ItemKey", x="v"), [*keys, "ItemKey"])
            .join(_block(table, keys, "round", "RoundNo", x="r").withColumn("RoundNo", F.col("RoundNo").cast("bigint")), [*keys, "RoundNo"])
            .withColumns({"u": F.col("u") - F.col("cu"), "v": F.col("v") - F.col("cv")})
        )
        eta = F.col("mu") + F.col("u") + F.col("v") + F.col("r")
        p = logistic(eta)
        weight = F.greatest(F.col("n") * p * (1 - p), F.lit(1e-8))
        target = weight * eta + F.col("y") - F.col("n") * p
        base = base.select(*keys, "Worker", "ItemKey", "RoundNo", "mu", "tw", "tg", "r0", "u", "v", "r", weight.alias("w"), target.alias("s"))
        sums = base.groupBy(*keys, "Worker").agg(
            F.sum(F.col("s") - F.col("w") * (F.col("mu") + F.col("v") + F.col("r"))).alias("left"), F.sum("w").alias("w"),
            F.max("u").alias("u_old"), F.max("tw").alias("tw"),
        )
        fresh = F.col("left") / (F.col("w") + 1 / F.greatest("tw", F.lit(1e-8))) if shrink.use_workers else F.lit(0.0)
        workers = sums.select(*keys, "Worker", fresh.alias("u"), "u_old")
        grid = base.drop("u").join(workers.select(*keys, "Worker", "u"), [*keys, "Worker"]).groupBy(*keys, "ItemKey", "RoundNo").agg(
            F.sum(F.col("s") - F.col("w") * F.col("u")).alias("s"), F.sum("w").alias("w"), F.max("v").alias("v_old"), F.max("r").alias("r_old"),
            F.max("mu").alias("mu"), F.max("tg").alias("tg"), F.max("r0").alias("r0"),
        )
        items = grid.groupBy(*keys, "ItemKey").agg(
            (F.sum(F.col("s") - F.col("w") * (F.col("mu") + F.col("r_old"))) / (F.sum("w") + F.max(1 / F.greatest("tg", F.lit(1e-8))))).alias("v"), F.max("v_old").alias("v_old"),
        )
        ridge = F.max(1 / F.col("tg")) if not shrink.adaptive else F.lit(1.0)
        placed = grid.join(items.select(*keys, "ItemKey", "v"), [*keys, "ItemKey"])
        free = F.sum(F.col("s") - F.col("w") * (F.col("mu") + F.col("v"))) / (F.sum("w") + ridge)
        rounds = placed.groupBy(*keys, "RoundNo").agg(
            F.when(F.col("RoundNo") == F.max("r0"), 0.0).otherwise(free).alias("r"), F.max("r_old").alias("r_old"),
            F.sum(F.col("s") - F.col("w") * F.col("v")).alias("s"), F.sum("w").alias("w"), F.max("mu").alias("mu"),
        )
        middle = rounds.groupBy(*keys).agg(
            (F.sum(F.col("s") - F.col("w") * F.col("r")) / (F.sum("w") + shrink.intercept)).alias("m"), F.max("mu").alias("m_old")
        ).withColumn("Name", F.lit(""))
        return (
            _rows(workers, keys, "worker", "Worker", x="u", old="u_old")
            .unionByName(_rows(items, keys, "item", "ItemKey", x="v", old="v_old"))
            .unionByName(_rows(rounds, keys, "round", "RoundNo", x="r", old="r_old"))
            .unionByName(_rows(middle, keys, "mu", "Name", x="m", old="m_old"))
        )

    return step


def _logit_facts(keys: list[str]):
    def facts(table: DataFrame, numbers: DataFrame) -> DataFrame:
        return table.groupBy(*keys, "Kind").agg(
            F.max(F.abs(F.col("x") - F.col("old"))).alias("move"), F.avg(F.col("x") * F.col("x")).alias("square"), F.avg("x").alias("mean")
        )

    return facts


def _logit_update(shrink: Shrinkage, tol: float):
    def update(fit: Fit, rows: list[Any]) -> bool:
        by, at = {r["Kind"]: r for r in rows}, fit.at
        delta = sum(r["move"] for r in rows)
        at["mu"] = by["mu"]["mean"]
        if shrink.adaptive:
            tw, tg = max(by["worker"]["square"], 1e-8), max(by["item"]["square"], 1e-8)
            delta += abs(tw - at["tw"]) + abs(tg - at["tg"])
            at["tw"], at["tg"] = tw, tg
        else:
            # The next sweep, and the result, take the means off the effects.
            at["cu"], at["cv"] = by["worker"]["mean"] if shrink.use_workers else 0.0, by["item"]["mean"]
            at["mu"] += at["cu"] + at["cv"]
        at["Delta"] = delta
        if delta < tol:
            return True
        if shrink.adaptive:
            fit.extrapolate(("tw", "tg"))
        return False

    return update


def _logit_results(final: DataFrame, scalars: DataFrame, keys: list[str], evidence: dict[str, DataFrame]) -> EffectFit:
    p_ref = logistic(F.col("mu") + F.col("v"))
    known = scalars.select(*keys, "mu", "cu", "cv", "Converged")
    effects = _block(final, keys, "item", "ItemKey", x="v").join(known, keys).withColumn("v", F.col("v") - F.col("cv"))
    groups = effects.join(evidence["items"], [*keys, "ItemKey"]).select(
        *keys, "ItemKey", F.col("v").alias("ItemEffect"), p_ref.alias("ReferencePass"), (10 * (1 - p_ref)).alias("Difficulty"),
        "EvidenceN", "Converged",
    )
    workers = _block(final, keys, "worker", "Worker", x="u").join(known, keys).select(*keys, "Worker", (F.col("u") - F.col("cu")).alias("WorkerEffect"))
    rounds = _block(final, keys, "round", "RoundNo", x="RoundEffect").withColumn("RoundNo", F.col("RoundNo").cast("bigint"))
    health = scalars.select(
        *keys, F.col("mu").alias("Intercept"), F.col("Observations").cast("bigint").alias("Observations"), "Iterations", "Delta", "Converged",
        F.col("tw").alias("WorkerVariance"), F.col("tg").alias("GroupVariance"),
    )
    return EffectFit(workers.join(evidence["workers"], [*keys, "Worker"]), groups, health, rounds.join(evidence["rounds"], [*keys, "RoundNo"]))


def predict_logit(df: DataFrame, fit: EffectFit, keys: list[str]) -> DataFrame:
    """Frozen pass probability; unseen entities contribute nothing; clipped to (0, 1)."""
    out = df.join(fit.health.select(*keys, "Intercept"), keys)
    out = out.join(fit.workers.select(*keys, "Worker", "WorkerEffect"), [*keys, "Worker"], "left")
    out = out.join(fit.items.select(*keys, F.col("ItemKey").alias("SizeAdjustedGroup"), "ItemEffect"), [*keys, "SizeAdjustedGroup"], "left")
    out = out.join(fit.rounds.select(*keys, "RoundNo", "RoundEffect"), [*keys, "RoundNo"], "left")
    eta = F.col("Intercept")
    for c in ("WorkerEffect", "ItemEffect", "RoundEffect"):
        eta = eta + F.coalesce(c, F.lit(0.0))
    return out.withColumn("Prediction", clip(1 / (1 + F.exp(-clip(eta, -700.0, 700.0))), 1e-8, 1 - 1e-8)).drop(
        "Intercept", "WorkerEffect", "ItemEffect", "RoundEffect"
    )
