"""Data-use candidates: same outcome, different cohorts, weights and penalties, one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.expressions import clip, logistic
from assayer.operators.attribution import coverage
from assayer.operators.designs import DesignFit, fit_outcomes, off_balance, predict_outcomes
from assayer.operators.effects import EffectFit, Shrinkage, fit_crossed_logit, predict_logit
from assayer.operators.metrics import binomial_metrics
from assayer.operators.ordering import quantiles
from assayer.operators.resample import paired_bootstrap
from assayer.operators.splits import three_way_split
from assayer.session import cut_lineage, settle

FIT = ["Process", "Branch"]
# Candidate name -> (cohort, weighting); penalties tried for each ridge candidate.
RIDGE = {
    "ridge_single_pieces": ("single", "pieces"),
    "ridge_single_capped": ("single", "capped"),
    "ridge_single_equal_round": ("single", "equal"),
    "group_only_all": ("group", "pieces"),
}
EXPANDED = {
    "ridge_expanded_pieces": ("expanded", "pieces"),
    "ridge_expanded_equal_round": ("expanded", "equal"),
}
LEGACY = {"legacy_1000": 1000, "legacy_5000": 5000}
PENALTIES = (0.1, 1.0, 10.0)


# What tells a round from others in any design.
TERMS = ["SizeAdjustedGroup", "RoundNo", "Worker", "Workers", "Attribution"]


def weighted_cohort(rounds: DataFrame, variants: dict[str, tuple[str, str]] = RIDGE) -> DataFrame:
    """Training rounds once per candidate with the candidate's exposure weights; rounds of the same terms are one row of Rounds.

    The rounds are read and moved once, with their sums under every weighting, and repeated for the candidates after that.
    """
    n, weightings = F.col("InspectedQty"), sorted({w for _mode, w in variants.values()})
    rows = rounds
    if "capped" in weightings:
        caps = quantiles(rounds.filter("Attribution = 'single'"), FIT, "InspectedQty", {"__cap": 0.9})
        rows = rounds.join(settle(caps), FIT, "left")
    exposures = {"pieces": n, "capped": F.least(n, F.col("__cap")) if "capped" in weightings else None, "equal": F.lit(1.0)}
    sums = [F.sum(x).alias(f"__{name}_{w}") for w in weightings for name, x in (("y", F.col("PassQty") / n * exposures[w]), ("n", exposures[w]))]
    cells = settle(rows.groupBy(*FIT, *[c for c in TERMS if c in rounds.columns]).agg(F.count("*").alias("Rounds"), *sums))
    choice = F.explode(F.array(*[F.struct(F.lit(v).alias("Variant"), F.lit(mode).alias("Mode"), F.lit(w).alias("Weighting")) for v, (mode, w) in variants.items()]))
    chosen = cells.select("*", choice.alias("c")).select("*", "c.*").drop("c").filter("Mode <> 'single' OR Attribution = 'single'")

    def sum_of(name: str) -> Column:
        return F.coalesce(*[F.when(F.col("Weighting") == w, F.col(f"__{name}_{w}")) for w in weightings])

    return chosen.withColumns({"PassQty": sum_of("y"), "InspectedQty": sum_of("n")}).drop(*[f"__{name}_{w}" for name in "yn" for w in weightings])


def penalties_of(rows: DataFrame, penalties=PENALTIES, chosen: DataFrame | None = None) -> DataFrame:
    """(process, branch, candidate, penalty) of the fits of a cohort; only those of ``chosen`` where it is given."""
    each = F.explode(F.array(*[F.lit(float(p)) for p in penalties])).alias("Penalty")
    grid = rows.select(*FIT, "Variant").distinct().select("*", each)
    return settle(grid if chosen is None else grid.join(chosen, [*FIT, "Variant", "Penalty"], "left_semi"))


def fit_candidates(rounds: DataFrame, variants=RIDGE, penalties=PENALTIES, max_iter: int = 2000, tol: float = 1e-7, chosen: DataFrame | None = None) -> EffectFit:
    """Every (process, branch, candidate, penalty) ridge fit in two jobs: with and without workers."""
    rows = weighted_cohort(rounds, variants)
    rows = rows.join(penalties_of(rows, penalties, chosen), [*FIT, "Variant"]).withColumn("lam", F.col("Penalty"))
    keys = [*FIT, "Variant", "Penalty"]
    with_workers = fit_crossed_logit(rows.filter("Mode = 'single'"), keys, Shrinkage("lam", 1e-6), max_iter, tol)
    group_only = fit_crossed_logit(rows.filter("Mode = 'group'"), keys, Shrinkage("lam", 1e-6, use_workers=False), max_iter, tol)
    return _both(with_workers, group_only)


def fit_expanded(rounds: DataFrame, variants=EXPANDED, penalties=PENALTIES, tol: float = 1e-6, chosen: DataFrame | None = None) -> DesignFit:
    """Ridge fits on sparse designs, all advanced together; ``rounds`` carry the array ``Workers`` of their team.

    Expanded candidates learn from all rounds: each worker of a team counts 1 / team size, and indicators tell rounds of teams
    and of unknown workers. Every variant of this module can be fitted this way.
    """
    rows = weighted_cohort(rounds, variants)
    return fit_outcomes(rows, [*FIT, "Variant"], penalties_of(rows, penalties, chosen), tol)


def predict_expanded(fit: DesignFit, rows: DataFrame, variants=EXPANDED) -> DataFrame:
    """Predictions of every fitted design for the same rows; a team counts as the mean of its workers."""
    modes = F.create_map(*[F.lit(part) for name, (mode, _w) in variants.items() for part in (name, mode)])
    grid = rows.join(fit.health.select(*FIT, "Variant", "Penalty", "Converged"), FIT).withColumn("Mode", modes[F.col("Variant")])
    return predict_outcomes(grid, fit, [*FIT, "Variant", "Penalty"]).drop("Mode")


def design_balance(rounds: DataFrame, fit: DesignFit, variants=EXPANDED, penalties=PENALTIES, bound: float = 1e-5) -> DataFrame:
    """Terms of every design fit, and those whose gradient per round exceeds ``bound``, recomputed from the rounds."""
    keys = [*FIT, "Variant", "Penalty"]
    cohort = weighted_cohort(rounds, variants)
    sizes = cohort.filter("SizeAdjustedGroup IS NOT NULL").groupBy(*FIT, "Variant").agg(F.sum("Rounds").alias("Observations"))
    steep = off_balance(cohort, fit, [*FIT, "Variant"]).filter(F.col("Penalty").isin([float(p) for p in penalties]))
    steep = steep.join(sizes, [*FIT, "Variant"]).groupBy(*keys, "Observations").agg(
        F.count("*").alias("Terms"), F.count_if(F.abs("Gradient") / F.col("Observations") > bound).alias("TermsOffBalance")
    )
    return steep.join(fit.health.select(*keys, "Converged"), keys)


def fit_legacy(rounds: DataFrame, variants: dict[str, int] = LEGACY) -> EffectFit:
    """The adaptive-variance benchmark at each iteration budget.

    A fit that converged within one budget is the same within every larger one, so only the others go on to it.
    """
    single = rounds.filter("Attribution = 'single'").withColumn("Penalty", F.lit(1.0))
    keys = [*FIT, "Penalty"]
    settled: EffectFit | None = None
    labelled: EffectFit | None = None
    for name, budget in sorted(variants.items(), key=lambda v: v[1]):
        if settled is None:
            settled = fit_crossed_logit(single, keys, Shrinkage(), budget)
        else:
            open_fits = settled.health.filter("NOT Converged").select(*keys)
            if not open_fits.isEmpty():
                again = fit_crossed_logit(single.join(open_fits, keys, "left_semi"), keys, Shrinkage(), budget)
                settled = _each(settled, lambda df: df.join(open_fits, keys, "left_anti"))
                settled = _both(settled, again)
        named = _each(settled, lambda df, name=name: df.withColumn("Variant", F.lit(name)))
        labelled = named if labelled is None else _both(labelled, named)
    return labelled


def _each(fit: EffectFit, change) -> EffectFit:
    return EffectFit(change(fit.workers), change(fit.items), change(fit.health), change(fit.rounds))


def _both(a: EffectFit, b: EffectFit) -> EffectFit:
    return EffectFit(
        a.workers.unionByName(b.workers), a.items.unionByName(b.items), a.health.unionByName(b.health), a.rounds.unionByName(b.rounds)
    )


def predict_candidates(fit: EffectFit, rows: DataFrame) -> DataFrame:
    """Predictions of every fitted candidate for the same rows; a team counts as the mean of its workers, unseen ones as zero."""
    keys = [*FIT, "Variant", "Penalty"]
    fits = fit.health.select(*keys, "Converged")
    teams = rows.filter(F.size("Workers") > 1).select(*FIT, "Workers").distinct().join(fits.select(*keys), FIT)
    members = teams.select(*keys, "Workers", F.explode("Workers").alias("Worker")).join(fit.workers.select(*keys, "Worker", "WorkerEffect"), [*keys, "Worker"])
    means = members.groupBy(*keys, "Workers").agg((F.sum("WorkerEffect") / F.size("Workers")).alias("__team"))
    predicted = predict_logit(rows.join(fits, FIT).join(means, [*keys, "Workers"], "left"), fit, keys)
    odds = F.ln(F.col("Prediction") / (1 - F.col("Prediction")))
    return predicted.withColumn("Prediction", F.when(F.col("__team").isNull(), F.col("Prediction")).otherwise(clip(logistic(odds + F.col("__team")), 1e-8, 1 - 1e-8))).drop("__team")


def select_penalty(scores: DataFrame) -> DataFrame:
    """Best penalty per candidate: converged fits first, then loss, then penalty."""
    order = F.struct((~F.col("Converged")).alias("bad"), F.col("PieceLogLoss"), F.col("Penalty"))
    return scores.groupBy(*FIT, "Variant").agg(
        F.min_by(F.struct("Penalty", "PieceLogLoss", "Converged"), order).alias("c")
    ).select(*FIT, "Variant", "c.*")


def select_variant(choices: DataFrame) -> DataFrame:
    """Winner among converged candidates: loss, then name."""
    viable = choices.filter("Converged")
    return viable.groupBy(*FIT).agg(F.min_by("Variant", F.struct("PieceLogLoss", "Variant")).alias("SelectedVariant"))


def predict_all(training: DataFrame, rows: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Predictions for ``rows`` by all eight candidates fitted to ``training``, at every penalty or only the ``chosen`` ones.

    Rounds of the same terms get the same predictions, which are made once and met by a round in one row.
    """
    alike = [*FIT, *TERMS]
    designs = settle(rows.select(*alike).distinct())
    found = predict_candidates(fit_candidates(training, chosen=chosen), designs).unionByName(predict_candidates(fit_legacy(training), designs))
    found = found.unionByName(predict_expanded(fit_expanded(training, chosen=chosen), designs))
    if chosen is not None:
        found = found.join(chosen, [*FIT, "Variant", "Penalty"], "left_semi")
    nested = found.groupBy(*alike).agg(F.collect_list(F.struct("Variant", "Penalty", "Converged", "Prediction")).alias("__found"))
    nested = nested.select(*[F.col(c).alias(f"__{c}") for c in alike], "__found")
    same = [rows[c].eqNullSafe(nested[f"__{c}"]) for c in alike]
    return rows.join(nested, same).select(*rows.columns, F.inline("__found"))


def compare(rounds: DataFrame, min_train: int = 10, min_validation: int = 5) -> dict[str, DataFrame]:
    """Tune on validation only, refit the chosen penalties on train and validation, score the test window once."""
    split = settle(three_way_split(rounds, by=["Process"]))
    sizes = split.groupBy(*FIT).agg(
        F.count_if(F.col("Split") == "train").alias("a"),
        F.count_if((F.col("Split") == "validation") & (F.col("Attribution") == "single")).alias("b"),
        F.count_if(F.col("Split") == "test").alias("c"),
    )
    enough = settle(sizes.filter((F.col("a") >= min_train) & (F.col("b") >= min_validation) & (F.col("c") > 0)).select(*FIT))
    usable = split.join(enough, FIT, "left_semi")
    train = usable.filter("Split = 'train'")
    validation = usable.filter("Split = 'validation' AND Attribution = 'single'")
    tuned = predict_all(train, validation)
    scores = settle(binomial_metrics(tuned, [*FIT, "Variant", "Penalty", "Converged"]))
    choices = cut_lineage(select_penalty(scores))
    winners = select_variant(choices)
    refit_rows = usable.filter("Split IN ('train', 'validation')")
    test = usable.filter("Split = 'test'")
    predictions = settle(predict_all(refit_rows, test, choices.select(*FIT, "Variant", "Penalty")))
    cohorts = predictions.withColumn("Cohort", F.explode(F.array(F.lit("all"), F.col("Attribution"))))
    single = predictions.filter("Attribution = 'single'")
    base = single.filter("Variant = 'legacy_1000'").select(*FIT, "WO", "RoundNo", F.col("Prediction").alias("Baseline"))
    paired = paired_bootstrap(single.join(base, [*FIT, "WO", "RoundNo"]), [*FIT, "Variant"], "Prediction", "Baseline")
    return {
        "coverage": coverage(split, [*FIT, "Split", "Attribution"]),
        "tuning": scores,
        "selection": winners,
        "comparison": binomial_metrics(cohorts, [*FIT, "Variant", "Cohort", "Converged"]),
        "intervals": paired,
        "predictions": predictions,
        "split_assignments": split.select("WO", "RoundNo", "Process", "Split"),
    }
