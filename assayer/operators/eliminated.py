"""Fits of any number of workers and few items: the workers leave the normal equations inside the tasks.

Cells are packed once, a row per worker. A pass reads them and sums each fit's equations of the items alone; nothing is
moved but these sums, and one task solves those of a fit. The optima are those of ``localfits`` and of the sweeps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.operators.localfits import _gradients
from assayer.session import settle, ship

# Items of a fit whose equations one task solves; numbers of a fit that a pass sums, that a task holds, and of a dense slice.
SOLVED_ITEMS, PASS_NUMBERS, HELD_NUMBERS, DENSE_CELLS = 128, 50_000, 8_000_000, 2_000_000

_PACKED = ["held", "own", "square"]
_SOLUTION = "__fit int, level binary, weight binary, target double"


class Packed:
    """The cells of some fits, a row per fit and worker, and the items of each fit in order."""

    def __init__(self, cells: DataFrame, keys: list[str], fits: list):
        self.spark, self.keys, self.fits = ship(cells.sparkSession), keys, fits
        self.schema = T.StructType([*(cells.schema[k] for k in keys), T.StructField("__fit", T.IntegerType())])
        self.numbers = self.spark.createDataFrame([(*f.key, number) for number, f in enumerate(fits)], self.schema)
        numbered = cells.join(F.broadcast(self.numbers), keys)
        place = F.row_number().over(Window.partitionBy("__fit").orderBy("ItemKey")) - 1
        items = settle(numbered.groupBy("__fit", "ItemKey").agg(F.sum("w").cast("double").alias("weight")).withColumn("place", place))
        placed = numbered.join(F.broadcast(items.drop("weight")), ["__fit", "ItemKey"])
        double = lambda c: F.col(c).cast("double").alias(c)
        self.rows = settle(
            placed.groupBy("__fit", "Worker").agg(
                F.collect_list(F.struct("place", double("w"), double("wy"))).alias("parts"),
                *[F.sum(c).cast("double").alias(name) for name, c in zip(_PACKED, ("w", "wy", "wyy"))],
            )
        )
        self.items: dict[int, list[tuple[str, float]]] = {number: [] for number in range(len(fits))}
        for row in items.orderBy("__fit", "place").collect():
            self.items[row["__fit"]].append((row["ItemKey"], row["weight"]))

    def sums(self, pulls: dict[int, np.ndarray]) -> DataFrame:
        """(__fit, sums): what a pass at ``pulls``, one or several a fit, makes of the workers in each task."""
        sizes = {fit: len(names) for fit, names in self.items.items()}
        chosen = self.rows.filter(F.col("__fit").isin(list(pulls)))
        return chosen.mapInArrow(_pass(pulls, sizes), "__fit int, sums binary")

    def solved(self, levels: dict[int, np.ndarray], workers: str) -> DataFrame:
        """Effect rows (keys, Kind, Name, x, old, y, z) of all workers, as ``workers`` says, and of the items at their levels."""
        names = ["Kind", "Name", "x", "old", "y", "z"]
        found = self.rows.mapInArrow(_workers(levels, workers == "effects"), "__fit int, Name string, x double, y double, z double")
        none = F.lit(None).cast("double").alias("old")
        out = found.select("__fit", F.lit("worker").alias("Kind"), "Name", "x", none, "y", "z")
        listed = [(fit, str(name), float(level), weight) for fit, of in self.items.items() for (name, weight), level in zip(of, levels[fit])]
        items = self.spark.createDataFrame(listed, "__fit int, Name string, x double, z double")
        out = out.unionByName(items.select("__fit", F.lit("item").alias("Kind"), "Name", "x", none, F.lit(None).cast("double").alias("y"), "z"))
        return settle(out.join(F.broadcast(self.numbers), "__fit").select(*self.keys, *names))


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, DENSE_CELLS // max(width, 1))
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Fit, totals (held, own, square) of the rows; owner, place, w and wy of their cells."""
    fits, *totals = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__fit", *_PACKED))
    parts = batch.column("parts")
    flat, owner = parts.flatten(), np.repeat(np.arange(len(fits)), np.diff(parts.offsets.to_numpy()))
    return (fits, *totals, owner, *(flat.field(c).to_numpy(zero_copy_only=False) for c in ("place", "w", "wy")))


def _pass(inverse: dict[int, np.ndarray], sizes: dict[int, int]):
    """Sums of a fit in one array: weight and target of each item, the sum of squares, then for every ridge its equations.

    ``inverse`` holds the ridges of a fit: a worker of weight ``held`` takes its share 1 / (ridge + held) of the products.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int32()), pa.array([t.tobytes() for t in kept.values()], pa.binary())], names=["__fit", "sums"])

        for batch in _slices(batches, max(sizes.values(), default=1)):
            fits, held, own, square, owner, place, w, wy = _read(batch)
            for fit in map(int, np.unique(fits)):
                m = sizes[fit]
                mine = fits == fit
                here = mine[owner]
                line = np.cumsum(mine) - 1
                dense = np.zeros((int(mine.sum()), m))
                np.add.at(dense, (line[owner[here]], place[here]), w[here])
                h, o = held[mine], own[mine]
                pieces = [dense.sum(axis=0), np.bincount(place[here], wy[here], m), [square[mine].sum()]]
                for ridge in inverse[fit]:
                    pull = np.divide(1.0, ridge + h, out=np.zeros_like(h), where=ridge + h > 0)
                    drawn = dense * pull[:, None]
                    spread = np.log1p(h / ridge).sum() if ridge > 0 else 0.0
                    pieces += [(drawn.T @ dense).ravel(), drawn.T @ o, [(pull * o * o).sum(), spread]]
                total = np.concatenate(pieces)
                kept[fit] = kept[fit] + total if fit in kept else total
            if sum(map(len, kept.values())) > HELD_NUMBERS:
                yield out()
                kept.clear()
        yield out()

    return run


def _workers(levels: dict[int, np.ndarray], effects: bool):
    """Per worker either its effect, or what it leaves (x), its sum of squares (y) and its weight (z), at the items' levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits, held, own, square, owner, place, w, wy = _read(batch)
            known, start = np.unique(fits), {}
            table = np.concatenate([levels[int(f)] for f in known]) if len(known) else np.zeros(0)
            at = 0
            for f in known:
                start[f] = at
                at += len(levels[int(f)])
            level = table[np.array([start[f] for f in known], int)[np.searchsorted(known, fits)][owner] + place] if len(owner) else np.zeros(0)
            n = len(fits)
            left = own - np.bincount(owner, w * level, n)
            if effects:
                x, y = np.divide(left, held, out=np.zeros_like(left), where=held > 0), np.zeros(n)
            else:
                x, y = left, square + np.bincount(owner, (w * level - 2 * wy) * level, n)
            columns = [pa.array(fits, pa.int32()), batch.column("Worker").cast(pa.string()), *[pa.array(c, pa.float64()) for c in (x, y, held)]]
            yield pa.RecordBatch.from_arrays(columns, names=["__fit", "Name", "x", "y", "z"])

    return run


def _total(pdf: pd.DataFrame) -> np.ndarray:
    total = np.frombuffer(pdf["sums"].iloc[0]).copy()
    for part in pdf["sums"].iloc[1:]:
        total += np.frombuffer(part)
    return total


def _items_least_squares(sizes: dict[int, int]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fit, total = int(pdf["__fit"].iloc[0]), _total(pdf)
        m = sizes[fit]
        weight, target, taken, drawn = total[:m], total[m : 2 * m], total[2 * m + 1 : 2 * m + 1 + m * m].reshape(m, m), total[2 * m + 1 + m * m :][:m]
        matrix = np.diag(weight) - taken
        # The level is open; a relative tolerance keeps rounding from being taken for a direction of its own.
        level = _gradients(lambda x: matrix @ x, target - drawn, np.maximum(matrix.diagonal(), 1e-12 * weight.max()), steps=20 * m)
        return pd.DataFrame({"__fit": [fit], "level": [level.tobytes()], "weight": [weight.tobytes()], "target": [target.sum()]})

    return run


def _likelihoods(sizes: dict[int, int], ridges: dict[int, np.ndarray], records: dict[int, float], lnw: dict[int, float]):
    """The best of the ridges of a fit by the profile likelihood: its number, the likelihood, both variances and the levels."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fit, total = int(pdf["__fit"].iloc[0]), _total(pdf)
        m, n = sizes[fit], records[fit]
        weight, target, squares = total[:m], total[m : 2 * m], total[2 * m]
        best = None
        for number, ridge in enumerate(ridges[fit]):
            of = total[2 * m + 1 + number * (m * m + m + 2) :][: m * m + m + 2]
            taken, drawn, own, spread = of[: m * m].reshape(m, m), of[m * m : m * m + m], of[-2], of[-1]
            matrix, rest = np.diag(weight) - taken, target - drawn
            matrix[np.diag_indices(m)] = np.maximum(matrix.diagonal(), 1e-12)
            level = _gradients(lambda x, matrix=matrix: matrix @ x, rest, matrix.diagonal(), steps=20 * m)
            square = max(squares - own - 2 * rest @ level + level @ matrix @ level, 1e-10 * n)
            s2 = square / n
            ll = -0.5 * (n * np.log(2 * np.pi * s2) - lnw[fit] + spread + n)
            if best is None or ll > best[1]:
                best = (number, float(ll), float(s2), float(s2 / ridge), level.tobytes(), float((weight * level).sum() / weight.sum()))
        return pd.DataFrame([(fit, *best)], columns=["__fit", "best", "ll", "s2", "t2", "level", "mu"])

    return run


def least_squares(cells: DataFrame, keys: list[str], fits: list) -> DataFrame:
    """Two-way weighted least squares: one pass for the items' equations, one for the workers' effects."""
    packed = Packed(cells, keys, fits)
    sizes = {fit: len(names) for fit, names in packed.items.items()}
    sums = packed.sums({fit: np.zeros(1) for fit in sizes})
    levels = {r["__fit"]: np.frombuffer(r["level"]) for r in sums.groupBy("__fit").applyInPandas(_items_least_squares(sizes), _SOLUTION).collect()}
    for fit in fits:
        fit.at["mu"], fit.sweeps, fit.converged = 0.0, 1, True
    return packed.solved(levels, "effects")


def variance_profile(cells: DataFrame, keys: list[str], fits: list) -> DataFrame:
    """Random workers and fixed items: every pass looks at several ratios of the variances and narrows their range."""
    packed = Packed(cells, keys, fits)
    sizes = {fit: len(names) for fit, names in packed.items.items()}
    records, lnw = ({number: f.at[c] for number, f in enumerate(fits)} for c in ("Records", "lnw"))
    ranges = {number: (np.log(1e-9), np.log(1e4)) for number in range(len(fits))}
    levels: dict[int, np.ndarray] = {}
    schema = "__fit int, best int, ll double, s2 double, t2 double, level binary, mu double"
    while ranges:
        grids = {fit: np.linspace(low, high, max(3, min(32, PASS_NUMBERS // (sizes[fit] ** 2 + sizes[fit]))) + 2)[1:-1] for fit, (low, high) in ranges.items()}
        ridges = {fit: np.exp(-grid) for fit, grid in grids.items()}
        found = packed.sums(ridges).groupBy("__fit").applyInPandas(_likelihoods(sizes, ridges, records, lnw), schema).collect()
        for row in found:
            number, fit = row["__fit"], fits[row["__fit"]]
            (low, high), grid, best = ranges[number], grids[number], row["best"]
            fit.sweeps += len(grid)
            fit.at.update(mu=row["mu"], s2=row["s2"], t2=max(row["t2"], 1e-10), ll=row["ll"])
            levels[number] = np.frombuffer(row["level"])
            low, high = grid[best - 1] if best else low, grid[best + 1] if best + 1 < len(grid) else high
            ranges[number] = (low, high)
            if high - low <= 1e-7:
                fit.converged = True
                del ranges[number]
    return packed.solved(levels, "left")


def _each(batches: Iterator[pa.RecordBatch], copies: int) -> Iterator[pa.RecordBatch]:
    """A batch per copy of packed rows whose cells hold the sums of all copies; the fits of copy c are numbered fit * copies + c."""
    for batch in batches:
        fits, parts = batch.column("__fit").to_numpy(), batch.column("parts")
        flat, offsets = parts.flatten(), np.concatenate([[0], np.cumsum(np.diff(parts.offsets.to_numpy()))])
        owner = np.repeat(np.arange(len(fits)), np.diff(offsets))
        for c in range(copies):
            w, wy = (flat.field(f"{name}{c}").to_numpy(zero_copy_only=False) for name in ("w", "wy"))
            cells = pa.StructArray.from_arrays([flat.field("place"), pa.array(w), pa.array(wy)], names=["place", "w", "wy"])
            held, own = (np.bincount(owner, x, len(fits)) for x in (w, wy))
            columns = [pa.array(fits * copies + c, pa.int32()), batch.column("Worker"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cells), *map(pa.array, (held, own, np.zeros(len(fits))))]
            yield pa.RecordBatch.from_arrays(columns, names=["__fit", "Worker", "parts", *_PACKED])


def copied_least_squares(cells: DataFrame, keys: list[str], copies: int, chosen: DataFrame, number: str, first: int, workers: bool) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """Two-way least squares of every copy of the rows of ``chosen`` keys: effects of workers (if asked for) and items, each of mean zero, and intercepts.

    ``cells`` hold for each worker and item the sums w0, wy0, w1, wy1 and so on, a pair a copy; a worker is packed once for
    all of them. Who has no weight in a copy has no effect in it.
    """
    spark = ship(cells.sparkSession)
    names: dict[tuple, list[str]] = {}
    for row in cells.join(F.broadcast(chosen), keys, "left_semi").select(*keys, "ItemKey").distinct().orderBy(*keys, "ItemKey").collect():
        names.setdefault(tuple(row[k] for k in keys), []).append(row["ItemKey"])
    listed = list(names)
    schema = [cells.schema[k] for k in keys]
    placed = T.StructType([*schema, cells.schema["ItemKey"], T.StructField("__fit", T.IntegerType()), T.StructField("place", T.IntegerType())])
    places = spark.createDataFrame([(*key, item, fit, at) for fit, key in enumerate(listed) for at, item in enumerate(names[key])], placed)
    sums = [F.col(f"{name}{c}") for c in range(copies) for name in ("w", "wy")]
    packed = cells.join(F.broadcast(places), [*keys, "ItemKey"]).groupBy("__fit", "Worker").agg(F.collect_list(F.struct("place", *sums)).alias("parts"))
    packed = settle(packed) if workers else packed
    sizes = {fit * copies + c: len(names[key]) for fit, key in enumerate(listed) for c in range(copies)}
    whole = _pass({fit: np.zeros(1) for fit in sizes}, sizes)
    passed = packed.mapInArrow(lambda batches: whole(_each(batches, copies)), "__fit int, sums binary")
    levels, items, means = {}, [], []
    for row in passed.groupBy("__fit").applyInPandas(_items_least_squares(sizes), _SOLUTION).collect():
        fit, c = divmod(row["__fit"], copies)
        level, weight = np.frombuffer(row["level"]), np.frombuffer(row["weight"])
        levels[row["__fit"]], total = level, weight.sum()
        if total > 0:
            mean, key = float(weight @ level / total), (*listed[fit], first + c)
            items += [(*key, name, float(x) - mean) for name, x, w in zip(names[listed[fit]], level, weight) if w > 0]
            means.append((*key, row["__fit"], float(row["target"] / total), float(row["target"] / total) - mean))
    kept = [*schema, T.StructField(number, T.LongType())]
    effects = spark.createDataFrame(items, T.StructType([*kept, cells.schema["ItemKey"], T.StructField("ItemEffect", T.DoubleType())]))
    numbers = [T.StructField("__fit", T.IntegerType()), T.StructField("Intercept", T.DoubleType()), T.StructField("level", T.DoubleType())]
    means = spark.createDataFrame(means, T.StructType([*kept, *numbers]))
    of_workers = None
    if workers:
        each = _workers(levels, True)
        found = packed.mapInArrow(lambda batches: each(_each(batches, copies)), "__fit int, Name string, x double, y double, z double").filter("z > 0")
        of_workers = found.join(F.broadcast(means), "__fit").select(*keys, number, F.col("Name").alias("Worker"), (F.col("x") - F.col("level")).alias("WorkerEffect"))
    return of_workers, effects, means.select(*keys, number, "Intercept")
