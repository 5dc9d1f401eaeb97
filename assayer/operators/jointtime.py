"""Joint log-time ridge over intercepts, slopes, item groups and workers.

Rows collapse to sums of products per (PB, group, worker). Each worker touches no other worker, so workers are
eliminated from the normal equations in the tasks that hold them; what is left, the equations of PBs, slopes and
groups, is solved on the driver, and the workers' estimates follow in one more pass. Designs with more PBs and groups
than one matrix holds are descended instead, penalties and prior centres entering as weighted pseudo-rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import Interaction, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from assayer.functions.expressions import poisson_one
from assayer.operators.metrics import time_metrics
from assayer.session import cut_lineage, settle, ship

NONE = "\u0000none"
CATEGORIES = {"intercept": "PB", "difficulty": "PB", "quote": "PB", "group": "GroupKey", "worker": "WorkerKey"}

# Kept terms as (block, key column, factor): the factor is 1 (o), the difficulty (d), the quote (q) or its absence (m).
TERMS = [
    ("intercept", "PB", "o"), ("d_global", None, "d"), ("difficulty", "PB", "d"), ("q_global", None, "q"), ("quote", "PB", "q"),
    ("q_missing", None, "m"), ("group", "GroupKey", "o"),
]
PRODUCTS = [(a, b) for i, a in enumerate("odqmy") for b in "odqmy"[i:]]
# Pairs of PB and group up to which one matrix holds the kept terms, and cells of a task's block of workers by terms.
SOLVED_TERMS, DENSE_CELLS = 2_000, 2_000_000


@dataclass(frozen=True)
class JointFit:
    """Coefficient table (Block, Key, Estimate), centring scalars, smearing per PB, health."""

    coefficients: DataFrame
    scalars: dict[str, float]
    smear: DataFrame
    health: dict[str, float]


def _centred(df: DataFrame, scalars: dict[str, float], use_quote: bool) -> DataFrame:
    quote = F.when(F.col("QuotedMinutesPerSemi") > 0, F.ln("QuotedMinutesPerSemi"))
    d = F.coalesce((F.col("DifficultyScore") - scalars["dmean"]) / 10, F.lit(0.0))
    q = F.coalesce((quote - scalars["qmean"]) / scalars["qscale"], F.lit(0.0)) if use_quote else F.lit(0.0)
    missing = quote.isNull().cast("double") if use_quote else F.lit(0.0)
    return df.withColumns({"__d": d, "__q": q, "__missing": missing})


def _scalars(df: DataFrame) -> dict[str, float]:
    quote = F.when(F.col("QuotedMinutesPerSemi") > 0, F.ln("QuotedMinutesPerSemi"))
    row = df.agg(F.avg(quote).alias("qmean"), F.stddev_samp(quote).alias("qscale"), F.avg("DifficultyScore").alias("dmean")).first()
    return {
        "qmean": row["qmean"] or 0.0,
        "qscale": max(row["qscale"] if row["qscale"] is not None else 1.0, 0.1),
        "dmean": row["dmean"] or 0.0,
    }


def _row(block: str, key: Column, penalty: Column, centre: Column) -> list[Column]:
    """A pseudo-row that touches exactly one coefficient."""
    keys = [F.when(F.lit(b == block), key).otherwise(F.lit(NONE)).alias(f"k_{b}") for b in CATEGORIES]
    one, zero = F.lit(1.0), F.lit(0.0)
    numbers = {
        "d_global": one if block == "d_global" else zero, "d_local": one if block == "difficulty" else zero,
        "q_global": one if block == "q_global" else zero, "q_local": one if block == "quote" else zero,
        "q_missing": one if block == "q_missing" else zero,
    }
    return [*keys, *[c.alias(n) for n, c in numbers.items()], centre.alias("label"), penalty.alias("weight")]


def _penalty_rows(train: DataFrame, strength: float, use_quote: bool, prior: DataFrame | None, prior_weight: float, scalars) -> DataFrame:
    def table(block: str, column: str | None, penalty: float) -> DataFrame:
        source = train.select(F.col(column).alias("key")).distinct() if column else train.select(F.lit(NONE).alias("key")).limit(1)
        return source.select(*_row(block, F.col("key"), F.lit(float(penalty)), F.lit(0.0)))

    rows = table("intercept", "PB", 1e-8)
    plan = [("d_global", None, 0.1), ("difficulty", "PB", strength * 10), ("group", "GroupKey", strength), ("worker", "WorkerKey", strength)]
    if use_quote:
        plan += [("q_global", None, 0.1), ("quote", "PB", strength * 10), ("q_missing", None, strength)]
    for block, column, penalty in plan:
        rows = rows.unionByName(table(block, column, penalty))
    if use_quote and prior is not None and prior_weight > 0:
        scale, weight = scalars["qscale"], F.lit(float(prior_weight))
        overall = prior.filter("Process IS NULL").select(F.col("Elasticity").alias("g"))
        rows = rows.unionByName(overall.select(*_row("q_global", F.lit(NONE), weight, F.col("g") * scale)))
        local = prior.filter("Process IS NOT NULL").withColumn("__k", F.lit(1)).join(overall.withColumn("__k", F.lit(1)), "__k")
        here = train.select("PB", "Process").distinct().join(local, "Process")
        rows = rows.unionByName(here.select(*_row("quote", F.col("PB"), weight, (F.col("Elasticity") - F.col("g")) * scale)))
    return rows


def _descend(rows: DataFrame, use_quote: bool, strength: float, prior: DataFrame | None, prior_weight: float, scalars, max_iter: int) -> tuple[DataFrame, dict[str, float]]:
    """The same optimum by gradient steps over the rows, for designs with more terms than one matrix holds."""
    data = rows.select(
        *[F.col(column).alias(f"k_{block}") for block, column in CATEGORIES.items()],
        F.col("__d").alias("d_global"), F.col("__d").alias("d_local"), F.col("__q").alias("q_global"), F.col("__q").alias("q_local"),
        F.col("__missing").alias("q_missing"), F.col("LogMinutes").alias("label"), F.col("__w").cast("double").alias("weight"),
    )
    # The indexer keeps one slot for unknown labels and the encoder drops that last slot, so
    # the pseudo-rows' blank category encodes to a zero vector.
    keys = [f"k_{b}" for b in CATEGORIES]
    indexer = StringIndexer(inputCols=keys, outputCols=[f"i_{b}" for b in CATEGORIES], handleInvalid="keep", stringOrderType="alphabetAsc")
    encoder = OneHotEncoder(inputCols=[f"i_{b}" for b in CATEGORIES], outputCols=[f"v_{b}" for b in CATEGORIES], dropLast=True)
    slopes = [
        Interaction(inputCols=["d_local", "v_difficulty"], outputCol="x_difficulty"),
        Interaction(inputCols=["q_local", "v_quote"], outputCol="x_quote"),
    ]
    columns = ["v_intercept", "d_global", "x_difficulty", "q_global", "x_quote", "q_missing", "v_group", "v_worker"]
    prepare = Pipeline(stages=[indexer, encoder, *slopes, VectorAssembler(inputCols=columns, outputCol="features")]).fit(data)
    stacked = data.unionByName(_penalty_rows(rows, strength, use_quote, prior, prior_weight, scalars))
    regression = LinearRegression(
        solver="l-bfgs", regParam=0.0, fitIntercept=False, weightCol="weight", maxIter=max_iter, tol=1e-12, standardization=True
    )
    model = regression.fit(prepare.transform(stacked).select("features", "label", "weight"))
    history = model.summary.objectiveHistory
    if model.summary.totalIterations >= max_iter and len(history) > 1 and abs(history[-2] - history[-1]) > 1e-8 * abs(history[-1]):
        raise ArithmeticError(f"The joint time fit is not solved after {max_iter} iterations")
    coefficients = _coefficient_table(rows, prepare.stages[0].labelsArray, model.coefficients.toArray())
    return coefficients, {"iterations": float(model.summary.totalIterations), "objective": history[-1]}


def _prior_terms(rows: DataFrame, prior: DataFrame, weight: float, scale: float) -> list[tuple[tuple[str, str], float, float]]:
    """((Block, Key), weight, centre) of the prior: the global elasticity and each PB's departure from it."""
    overall = [r["Elasticity"] for r in prior.filter("Process IS NULL").collect()]
    local = rows.select("PB", "Process").distinct().join(prior.filter("Process IS NOT NULL"), "Process").collect()
    return [(("q_global", NONE), weight, g * scale) for g in overall] + [
        (("quote", r["PB"]), weight, (r["Elasticity"] - g) * scale) for r in local for g in overall
    ]


def _cells(rows: DataFrame) -> DataFrame:
    """Weighted sums of products of 1 (o), d, q, missing (m) and the label (y) per PB, group and worker."""
    base = {"o": F.lit(1.0), "d": F.col("__d"), "q": F.col("__q"), "m": F.col("__missing"), "y": F.col("LogMinutes")}
    weight = F.col("__w").cast("double")
    return rows.groupBy("PB", "GroupKey", "WorkerKey").agg(*[F.sum(weight * base[a] * base[b]).alias(a + b) for a, b in PRODUCTS])


def _dense(batch: pa.RecordBatch, index: dict[tuple[str, str], int]) -> np.ndarray:
    """Workers by kept terms: the weighted sum of each term's values over the worker's rows."""
    parts = batch.column("parts")
    flat, owner = parts.flatten(), np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()))
    out = np.zeros((batch.num_rows, len(index)))
    for block, column, value in TERMS:
        if column is None:
            at = np.full(len(flat), index[block, NONE])
        else:
            codes = flat.field(column).dictionary_encode()
            known = np.array([index.get((block, key), -1) for key in codes.dictionary.to_pylist()] + [-1])
            at = known[codes.indices.fill_null(len(known) - 1).to_numpy(zero_copy_only=False)]
        here = at >= 0
        np.add.at(out, (owner[here], at[here]), flat.field("o" + value).to_numpy(zero_copy_only=False)[here])
    return out


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, DENSE_CELLS // max(width, 1))
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _eliminate(index: dict[tuple[str, str], int], penalty: float):
    """What the workers take from the kept equations, summed per task; the last row and column are the label's."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(index) + 1, len(index) + 1))
        for batch in _slices(batches, len(index)):
            n, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("oo", "oy"))
            c = np.column_stack([_dense(batch, index), y]) / np.sqrt(n + penalty)[:, None]
            total += c.T @ c
        i, j = np.nonzero(np.triu(total))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "x"])

    return fold


def _substitute(index: dict[tuple[str, str], int], values: np.ndarray, penalty: float):
    """Workers' estimates given the kept terms."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, len(index)):
            n, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("oo", "oy"))
            estimate = (y - _dense(batch, index) @ values) / (n + penalty)
            yield pa.RecordBatch.from_arrays([batch.column("WorkerKey"), pa.array(estimate)], names=["Key", "Estimate"])

    return fold


def _solve(cells: DataFrame, kept: list[Row], rows: DataFrame, use_quote: bool, strength: float, prior: DataFrame | None, prior_weight: float, scalars) -> tuple[DataFrame, dict[str, float]]:
    """Solve the normal equations: workers, any number, are eliminated where they are; the other terms' equations meet here."""
    pbs, groups = (sorted({r[c] for r in kept if r[c] is not None}) for c in ("PB", "GroupKey"))
    terms = [("intercept", p) for p in pbs] + [("d_global", NONE)] + [("difficulty", p) for p in pbs] + [("q_global", NONE)]
    terms += [("quote", p) for p in pbs] + [("q_missing", NONE)] + [("group", g) for g in groups]
    index, size = {t: k for k, t in enumerate(terms)}, len(terms)
    # Without quotes their terms have no rows; any penalty keeps them at zero.
    penalties = {"intercept": 1e-8, "d_global": 0.1, "difficulty": strength * 10, "q_global": 0.1, "quote": strength * 10, "q_missing": strength, "group": strength}
    a = np.zeros((size + 1, size + 1))
    a[np.arange(size), np.arange(size)] = [float(penalties[block]) for block, _ in terms]
    for r in kept:
        at = [(v, index.get((block, NONE if c is None else r[c]))) for block, c, v in TERMS] + [("y", size)]
        for u, i in at:
            for v, j in at:
                if i is not None and j is not None:
                    a[i, j] += r[min(u + v, v + u, key=lambda p: ["odqmy".index(x) for x in p])]
    if use_quote and prior is not None and prior_weight > 0:
        for term, weight, centre in _prior_terms(rows, prior, float(prior_weight), scalars["qscale"]):
            k = index[term]
            a[k, k] += weight
            a[k, size] += weight * centre
            a[size, size] += weight * centre * centre
    workers = cells.filter("WorkerKey IS NOT NULL").groupBy("WorkerKey").agg(
        F.sum("oo").alias("oo"), F.sum("oy").alias("oy"), F.collect_list(F.struct("PB", "GroupKey", *[F.col(c).alias(c) for c in ("oo", "od", "oq", "om")])).alias("parts")
    )
    workers = settle(workers)
    spark = ship(cells.sparkSession)
    taken = workers.mapInArrow(_eliminate(index, strength), "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x"))
    for i, j, x in taken.collect():
        a[i, j] -= x
        if i != j and j < size:
            a[j, i] -= x
    left, right = a[:size, :size], a[:size, size]
    values = np.linalg.solve(left, right)
    values = values + np.linalg.solve(left, right - left @ values)
    rest = float(np.abs(right - left @ values).max())
    if not rest <= 1e-8 * max(1.0, float(np.abs(right).max())):
        raise ArithmeticError(f"The joint time fit is not solved: a residual of {rest} is left")
    known = settle(spark.createDataFrame([(b, k, float(v)) for (b, k), v in zip(terms, values)], "Block string, Key string, Estimate double").coalesce(1))
    own = settle(workers.mapInArrow(_substitute(index, values, strength), "Key string, Estimate double"))
    # A table each: a filter on the block prunes the other one, and the short one stays short enough to be broadcast.
    table = known.unionByName(own.select(F.lit("worker").alias("Block"), "Key", "Estimate"))
    return table, {"iterations": 1.0, "objective": float(a[size, size] - right @ values)}


def fit_joint_time(
    train: DataFrame, use_quote: bool = True, strength: float = 10.0, prior: DataFrame | None = None, prior_weight: float = 0.0,
    weight: Column | None = None, max_iter: int = 300,
) -> JointFit:
    """Fit on rows with PB, Process, GroupKey, WorkerKey, DifficultyScore, QuotedMinutesPerSemi, LogMinutes.

    Up to ``SOLVED_TERMS`` PBs and groups the normal equations are solved directly, for any number of workers; beyond it
    they are descended in at most ``max_iter`` steps.
    """
    scalars = _scalars(train)
    rows = _centred(train, scalars, use_quote).withColumn("__w", weight if weight is not None else F.lit(1.0))
    cells = settle(_cells(rows))
    kept = settle(cells.groupBy("PB", "GroupKey").agg(*[F.sum(a + b).alias(a + b) for a, b in PRODUCTS]))
    if kept.count() <= SOLVED_TERMS:
        coefficients, health = _solve(cells, kept.collect(), train, use_quote, strength, prior, prior_weight, scalars)
    else:
        coefficients, health = _descend(cut_lineage(rows), use_quote, strength, prior, prior_weight, scalars, max_iter)
    fit = JointFit(coefficients, scalars, None, health)
    residual = F.col("LogMinutes") - F.col("__eta")
    w = weight if weight is not None else F.lit(1.0)
    scored = _linear_parts(train, fit, use_quote).withColumn("__eta", F.col("__base") + F.col("__tech") + F.col("__labor"))
    smear = scored.groupBy("PB").agg((F.sum(F.exp(residual) * w) / F.sum(w)).alias("Smear"))
    return JointFit(coefficients, scalars, settle(smear), fit.health)


def _coefficient_table(df: DataFrame, labels, values) -> DataFrame:
    """(Block, Key, Estimate) in the assembler's column order."""
    spark, position, rows = df.sparkSession, 0, []
    names = dict(zip(CATEGORIES, labels))
    for block in ("intercept", "d_global", "difficulty", "q_global", "quote", "q_missing", "group", "worker"):
        keys = list(names[block]) if block in names else [NONE]
        rows += [(block, key, float(values[position + i])) for i, key in enumerate(keys)]
        position += len(keys)
    return cut_lineage(spark.createDataFrame(rows, "Block string, Key string, Estimate double"))


def _linear_parts(df: DataFrame, fit: JointFit, use_quote: bool = True) -> DataFrame:
    """Work content, technical and worker parts of the linear predictor; unseen terms are zero."""
    table = fit.coefficients

    def attach(rows: DataFrame, block: str, column: str) -> DataFrame:
        side = table.filter(F.col("Block") == block).select(F.col("Key").alias(column), F.col("Estimate").alias(f"__c_{block}"))
        return rows.join(side, column, "left").withColumn(f"__c_{block}", F.coalesce(f"__c_{block}", F.lit(0.0)))

    overall = {r["Block"]: r["Estimate"] for r in table.filter(F.col("Block").isin("d_global", "q_global", "q_missing")).collect()}
    rows = _centred(df, fit.scalars, use_quote)
    for block, column in CATEGORIES.items():
        rows = attach(rows, block, column)
    base = (
        F.col("__c_intercept") + F.col("__q") * (F.lit(overall["q_global"]) + F.col("__c_quote"))
        + F.col("__missing") * F.lit(overall["q_missing"]) + F.col("__c_group")
    )
    tech = F.col("__d") * (F.lit(overall["d_global"]) + F.col("__c_difficulty"))
    return rows.withColumns({"__base": base, "__tech": tech, "__labor": F.col("__c_worker")}).drop(
        "__d", "__q", "__missing", *[f"__c_{b}" for b in CATEGORIES]
    )


def predict_parts(df: DataFrame, fit: JointFit, use_quote: bool = True) -> DataFrame:
    """Minutes split additively into work content, technical difficulty and worker effect."""
    rows = _linear_parts(df, fit, use_quote).join(fit.smear, "PB", "left")
    baseline = F.exp("__base") * F.col("Smear")
    effort = F.exp(F.col("__base") + F.col("__tech")) * F.col("Smear")
    predicted = F.exp(F.col("__base") + F.col("__tech") + F.col("__labor")) * F.col("Smear")
    return rows.withColumns(
        {
            "WorkContentMinutes": baseline, "TechnicalDifficultyMinutes": effort - baseline, "ProductionEffortMinutes": effort,
            "WorkerEffectMinutes": predicted - effort, "PredictedMinutes": predicted,
        }
    ).drop("__base", "__tech", "__labor", "Smear")


def quote_elasticity(fit: JointFit) -> DataFrame:
    """Elasticity per PB and, under a null key, the global one."""
    scale = fit.scalars["qscale"]
    overall = fit.coefficients.filter("Block = 'q_global'").select(F.col("Estimate").alias("g"), F.lit(1).alias("__k"))
    local = fit.coefficients.filter("Block = 'quote'").withColumn("__k", F.lit(1)).join(overall, "__k")
    per = local.select(F.col("Key").alias("PB"), ((F.col("g") + F.col("Estimate")) / scale).alias("Elasticity"))
    return per.unionByName(overall.select(F.lit(None).cast("string").alias("PB"), (F.col("g") / scale).alias("Elasticity")))


def legacy_prior(fit: JointFit) -> DataFrame:
    """Quote elasticities of a historical fit as (Process, Elasticity); null process is global."""
    return quote_elasticity(fit).select(F.regexp_replace("PB", " / [^/]*$", "").alias("Process"), "Elasticity")


def tune(train: DataFrame, window: DataFrame, prior: DataFrame | None = None, strengths=(1.0, 10.0, 100.0), prior_weights=(0.0, 100.0, 1000.0)) -> DataFrame:
    """Tuning-window error of every quote, pooling and prior-weight combination."""
    out = None
    for use_quote in (False, True):
        for strength in strengths:
            for prior_weight in prior_weights if use_quote and prior is not None else (0.0,):
                fit = fit_joint_time(train, use_quote, strength, prior, prior_weight)
                score = time_metrics(predict_parts(window, fit, use_quote), [], "ActualMinutes", "PredictedMinutes")
                row = score.select(
                    F.lit(use_quote).alias("UseQuote"), F.lit(strength).alias("PoolingPenalty"), F.lit(prior_weight).alias("PriorWeight"), "N", "LogRMSE", "WAPE"
                )
                row = cut_lineage(row)
                out = row if out is None else out.unionByName(row)
    return out


def replicate_coefficients(train: DataFrame, repetitions: int, seed: int = 20260923, **options) -> DataFrame:
    """Coefficients of refits on work-order resamples, stacked by replicate."""
    out = None
    for rep in range(repetitions):
        weight = poisson_one(F.lit(seed), F.lit(rep), F.col("WO")).cast("double")
        fit = fit_joint_time(train.withColumn("__k", weight).filter("__k > 0"), weight=F.col("__k"), **options)
        part = fit.coefficients.select(F.lit(rep).alias("Rep"), F.concat_ws(":", "Block", "Key").alias("Term"), "Estimate")
        out = part if out is None else out.unionByName(part)
    return out
