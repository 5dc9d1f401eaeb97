"""Cross-validation of effect models: every fold is a key of one distributed fit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators.effects import EffectFit, fit_two_way_copies, predict_log_time
from assayer.operators.metrics import adjusted_r2, regression_metrics


def portable_fold(folds: int, *key: str) -> Column:
    """Fold from the first hex digits of the md5 of a row key, the same in any engine that has md5."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % folds).alias("Fold")


def cross_validate(
    df: DataFrame, keys: list[str], item: str, fitter: Callable[[DataFrame, list[str]], EffectFit] | None, row_key: list[str], folds: int = 3, evaluated: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(metrics per fold, their means) of a model fitted on the other folds; ``evaluated`` limits the scored workers.

    All folds are fitted in one job: a row enters as training once for each fold it is not held out of. Without a
    ``fitter`` the model is the two-way fit, to which a row moves once with the folds it counts in.
    """
    placed = df.withColumn("Held", portable_fold(folds, *row_key))
    if fitter is None:
        fit = fit_two_way_copies(placed, keys, item, [(F.col("Held") != fold).cast("int") for fold in range(folds)], "Fold")
    else:
        others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)).cast("array<bigint>"), lambda f: f != F.col("Held"))
        fit = fitter(placed.withColumn("Fold", F.explode(others)).drop("Held"), [*keys, "Fold"])
    test = placed.withColumnRenamed("Held", "Fold")
    if evaluated is not None:
        test = test.join(evaluated.select("Worker").distinct(), "Worker", "left_semi")
    scored = regression_metrics(predict_log_time(test, fit, [*keys, "Fold"], item), [*keys, "Fold"], "LogTime", "Prediction")
    means = scored.groupBy(*keys).agg(F.count("*").alias("Folds"), F.sum("N").alias("N"), *[F.avg(c).alias(c) for c in ("RMSE", "MAE", "R2")])
    return scored, means.withColumn("AdjustedR2", adjusted_r2(F.col("R2"), F.col("N"), 2))
