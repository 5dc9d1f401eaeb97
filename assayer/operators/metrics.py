"""Evaluation metrics as one grouped aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.functions.expressions import binomial_nll, clip, is_finite, left_closed_decile, ratio, right_closed_decile
from assayer.operators.ordering import average_rank, prefix_totals, ranked
from assayer.session import cut_lineage


def regression_metrics(df: DataFrame, keys: list[str], actual: str, predicted: str, weight: str | None = None) -> DataFrame:
    """RMSE, MAE and R2 with optional weights, from centred moments."""
    w = F.col(weight) if weight else F.lit(1.0)
    y, p = F.col(actual), F.col(predicted)
    sums = df.groupBy(*keys).agg(
        F.count("*").alias("N"),
        F.sum(w).alias("w"),
        F.sum(w * y).alias("wy"),
        F.sum(w * (y - p) * (y - p)).alias("res"),
        F.sum(w * F.abs(y - p)).alias("abs_res"),
        F.min(y).alias("lo"),
        F.max(y).alias("hi"),
    )
    means = sums.select(*keys, (F.col("wy") / F.col("w")).alias("__mean"))
    centred = df.join(means, keys).groupBy(*keys).agg(
        F.sum(w * (y - F.col("__mean")) * (y - F.col("__mean"))).alias("tot")
    )
    return sums.join(centred, keys).select(
        *keys,
        "N",
        F.sqrt(F.col("res") / F.col("w")).alias("RMSE"),
        (F.col("abs_res") / F.col("w")).alias("MAE"),
        F.when(F.col("lo") != F.col("hi"), 1 - F.col("res") / F.col("tot")).alias("R2"),
    )


def adjusted_r2(r2: Column, n: Column, parameters: int) -> Column:
    return F.when(n > parameters + 1, 1 - (1 - r2) * (n - 1) / (n - parameters - 1))


def time_metrics(df: DataFrame, keys: list[str], actual: str, predicted: str) -> DataFrame:
    a, p = F.col(actual), F.col(predicted)
    usable = df.filter(is_finite(a) & is_finite(p) & (a > 0) & (p > 0))
    return usable.groupBy(*keys).agg(
        F.count("*").alias("N"),
        F.sqrt(F.avg(F.pow(F.ln(a / p), 2))).alias("LogRMSE"),
        (F.sum(F.abs(a - p)) / F.sum(a)).alias("WAPE"),
        F.avg((F.abs(a / p - 1) <= 0.2).cast("double")).alias("Within20Pct"),
    )


def binomial_metrics(df: DataFrame, keys: list[str], probability: str = "Prediction") -> DataFrame:
    """Piece and round log-loss, Brier, rate RMSE and rates."""
    n, y, p = F.col("InspectedQty"), F.col("PassQty"), clip(F.col(probability), 1e-8, 1 - 1e-8)
    loss = binomial_nll(y, n, p)
    return df.groupBy(*keys).agg(
        F.count("*").alias("Rounds"),
        F.sum(n).alias("Pieces"),
        (F.sum(loss) / F.sum(n)).alias("PieceLogLoss"),
        F.avg(loss / n).alias("RoundLogLoss"),
        (F.sum(y * (1 - p) * (1 - p) + (n - y) * p * p) / F.sum(n)).alias("PieceBrier"),
        F.sqrt(F.avg((y / n - p) * (y / n - p))).alias("RoundRateRmse"),
        (F.sum(y) / F.sum(n)).alias("ObservedRate"),
        (F.sum(n * p) / F.sum(n)).alias("PredictedRate"),
    )


def calibration_bins(df: DataFrame, keys: list[str], probability: str = "Prediction") -> DataFrame:
    """Ten left-closed bins with observed and predicted rates."""
    p = F.col(probability)
    bins = df.groupBy(*keys, left_closed_decile(p).alias("Bin")).agg(
        F.count_distinct("WO").alias("WOs"),
        F.sum("InspectedQty").alias("Pieces"),
        F.sum("PassQty").alias("Passed"),
        F.sum(p * F.col("InspectedQty")).alias("Expected"),
    )
    return bins.withColumns(
        {"Observed": ratio(F.col("Passed"), F.col("Pieces")), "Predicted": ratio(F.col("Expected"), F.col("Pieces"))}
    )


def calibration_error(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Expected calibration error and overall gap from the bins."""
    return bins.groupBy(*keys).agg(
        (F.sum(F.abs(F.col("Observed") - F.col("Predicted")) * F.col("Pieces")) / F.sum("Pieces")).alias("ECE"),
        (F.abs(F.sum("Passed") - F.sum("Expected")) / F.sum("Pieces")).alias("CalibrationGap"),
        F.sum("Pieces").alias("Pieces"),
    )


def fixed_bin_table(df: DataFrame, keys: list[str], probability: str = "Prediction") -> DataFrame:
    """Ten right-closed bins fixed in advance."""
    p = F.col(probability)
    rows = df.groupBy(*keys, right_closed_decile(p).alias("Bin")).agg(
        F.count("*").alias("Rounds"),
        F.sum("InspectedQty").alias("Pieces"),
        F.sum("PassQty").alias("Passed"),
        F.sum(p * F.col("InspectedQty")).alias("PredictedPass"),
    )
    return rows.withColumns(
        {
            "ObservedRate": ratio(F.col("Passed"), F.col("Pieces")),
            "PredictedRate": ratio(F.col("PredictedPass"), F.col("Pieces")),
        }
    )


def correlation(x: str, y: str) -> Column:
    """Pearson correlation; null when either side is constant."""
    varies = (F.min(x) != F.max(x)) & (F.min(y) != F.max(y))
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def kendall_tau_b(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Tau-b per key without forming pairs.

    Discordant pairs are counted over the binary digits of y's rank: two values differ first
    at one digit, where the larger has 1 and the smaller 0, so at each digit a prefix count
    over x of the ones met before each zero adds up to the inversions. Rows grow by the
    number of digits (log2 of the key's size) instead of by its square.
    """
    joint = cut_lineage(
        df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
        .agg(F.count("*").alias("m"))
    )

    def tie_pairs(cols: list[str], name: str) -> DataFrame:
        sizes = joint.groupBy(*keys, *cols).agg(F.sum("m").alias("t"))
        return sizes.groupBy(*keys).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(name))

    whole = joint.groupBy(*keys).agg(F.sum("m").alias("N"))
    ties = (
        whole.join(tie_pairs(["__x"], "tx"), keys).join(tie_pairs(["__y"], "ty"), keys).join(tie_pairs(["__x", "__y"], "txy"), keys)
    )
    positions = ranked(joint.select(*keys, "__y").distinct(), keys, "__y").select(
        *keys, "__y", F.col("n_before").alias("__rank"), F.ceil(F.log2(F.col("n_total") + 1)).cast("int").alias("__digits")
    )
    spread = joint.join(positions, [*keys, "__y"]).withColumn("__level", F.explode(F.sequence(F.lit(0), F.col("__digits"))))
    digit = F.expr("shiftright(__rank, __level) & 1")
    spread = spread.select(
        *keys,
        "__level",
        F.expr("shiftright(__rank, __level + 1)").alias("__prefix"),
        "__x",
        F.when(digit == 1, F.col("m")).otherwise(0).alias("ones"),
        F.when(digit == 0, F.col("m")).otherwise(0).alias("zeros"),
    )
    counted = prefix_totals(spread, [*keys, "__level", "__prefix"], "__x", {"ones": F.col("ones"), "zeros": F.col("zeros")})
    discordant = counted.groupBy(*keys).agg(F.sum(F.col("zeros") * F.col("ones_before")).cast("double").alias("D"))
    pairs = F.col("N") * (F.col("N") - 1) / 2
    difference = pairs - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.col("D")
    scale = F.sqrt((pairs - F.col("ty")) * (pairs - F.col("tx")))
    return ties.join(discordant, keys).select(*keys, F.when(scale > 0, difference / scale).alias("Kendall"))


def agreement(df: DataFrame, keys: list[str], score: str, reference: str) -> DataFrame:
    """Pearson, Spearman, Kendall, OLS line and R2 of a score against a reference per key."""
    rows = cut_lineage(df.filter(F.col(score).isNotNull() & F.col(reference).isNotNull()).select(*keys, score, reference))
    slope = F.try_divide(F.covar_pop(score, reference), F.var_pop(score))
    linear = rows.groupBy(*keys).agg(
        F.count("*").alias("N"),
        correlation(score, reference).alias("Pearson"),
        F.when(F.min(score) != F.max(score), slope).alias("Slope"),
        F.when(F.min(score) != F.max(score), F.avg(reference) - slope * F.avg(score)).alias("Intercept"),
    )
    ranks = average_rank(average_rank(rows, keys, score, "__rx"), keys, reference, "__ry")
    spearman = ranks.groupBy(*keys).agg(correlation("__rx", "__ry").alias("Spearman"))
    return (
        linear.join(spearman, keys)
        .join(kendall_tau_b(rows, keys, score, reference), keys, "left")
        .withColumn("R2", F.col("Pearson") * F.col("Pearson"))
    )


def minmax_score(df: DataFrame, keys: list[str], value: str, name: str, higher_is_better: bool = True) -> DataFrame:
    """0-10 position between the key's extremes; 5 when they coincide."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    raw = 10 * (F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))
    score = F.when(F.col("__lo").isNull() | (F.col("__lo") == F.col("__hi")), F.lit(5.0)).otherwise(
        raw if higher_is_better else 10 - raw
    )
    return df.join(ends, keys).withColumn(name, score).drop("__lo", "__hi")


def flag_outliers(df: DataFrame, keys: list[str], value: str, threshold: float = 2.0) -> DataFrame:
    """z score with the sample deviation and a flag at the threshold."""
    moments = df.groupBy(*keys).agg(F.avg(value).alias("__mean"), F.stddev_samp(value).alias("__sd"))
    z = F.when(F.col("__sd") > 0, (F.col(value) - F.col("__mean")) / F.col("__sd")).otherwise(0.0)
    return (
        df.join(moments, keys)
        .withColumns({"ZScore": z, "Flag": F.coalesce(F.abs(z) >= threshold, F.lit(False))})
        .drop("__mean", "__sd")
    )


def ranked_outliers(df: DataFrame, keys: list[str], value: str, tie: str, threshold: float = 2.0) -> DataFrame:
    """Flagged rows in the order of a report: largest absolute z score first, then keys and tie column."""
    return flag_outliers(df, keys, value, threshold).filter("Flag").orderBy(F.abs("ZScore").desc(), *keys, tie)


def extremes(df: DataFrame, keys: list[str], value: str, tie: str, k: int = 50) -> DataFrame:
    """Top and bottom k per key; the rank limit prunes rows before they are shuffled."""
    top = W.partitionBy(*keys).orderBy(F.col(value).desc(), tie)
    bottom = W.partitionBy(*keys).orderBy(F.col(value).asc(), tie)
    best = df.withColumn("Position", F.row_number().over(top)).filter(F.col("Position") <= k).withColumn("End", F.lit("top"))
    worst = df.withColumn("Position", F.row_number().over(bottom)).filter(F.col("Position") <= k).withColumn("End", F.lit("bottom"))
    return best.unionByName(worst)


def segment_metrics(df: DataFrame, keys: list[str], dimensions: list[str], probability: str = "Prediction") -> DataFrame:
    """Metrics by (Dimension, Segment) with every dimension unpivoted into one grouping."""
    entry = F.array(
        F.struct(F.lit("ALL").alias("Dimension"), F.lit("ALL").alias("Segment")),
        *[F.struct(F.lit(d).alias("Dimension"), F.coalesce(F.col(d).cast("string"), F.lit("MISSING")).alias("Segment")) for d in dimensions],
    )
    kept = [*keys, "WO", "PassQty", "InspectedQty", probability]
    long = df.select(*kept, F.inline(entry))
    identity = [*keys, "Dimension", "Segment"]
    base = binomial_metrics(long, identity, probability)
    ece = calibration_error(calibration_bins(long, identity, probability), identity).drop("Pieces")
    orders = long.groupBy(*identity).agg(F.count_distinct("WO").alias("WOs"))
    return base.join(ece, identity).join(orders, identity)


def sparse_label(df: DataFrame, train: DataFrame, group: str, min_orders: int = 10) -> DataFrame:
    counts = train.groupBy(group).agg(F.count_distinct("WO").alias("__orders"))
    label = F.when(F.coalesce("__orders", F.lit(0)) < min_orders, "LOW_WO").otherwise("SUFFICIENT_WO")
    return df.join(counts, group, "left").withColumn("SparseGroup", label).drop("__orders")


def interval_coverage(df: DataFrame, keys: list[str], actual: str, low: str, high: str) -> DataFrame:
    hit = F.col(actual).between(F.col(low), F.col(high)).cast("double")
    return df.groupBy(*keys).agg(F.count("*").alias("N"), F.avg(hit).alias("Coverage"))


def pooled_loss(df: DataFrame, keys: list[str], probability: str = "Prediction") -> DataFrame:
    loss = binomial_nll(F.col("PassQty"), F.col("InspectedQty"), F.col(probability))
    return df.groupBy(*keys).agg(
        F.sum(loss).alias("NLL"),
        F.sum("InspectedQty").alias("Pieces"),
        F.count("*").alias("Rounds"),
        (F.sum(loss) / F.sum("InspectedQty")).alias("LogLoss"),
    )


def convergence_counts(health: DataFrame, keys: list[str]) -> DataFrame:
    return health.groupBy(*keys).agg(F.count_if("Converged").alias("Converged"), F.count("*").alias("Fits"))


def fit_health(fits: DataFrame, expected: DataFrame) -> DataFrame:
    """Status per process and branch, including branches that were never fitted."""
    per = fits.groupBy("Process", "Branch").agg(
        F.bool_and("Converged").alias("__ok"), F.sum("EvidenceN").alias("EvidenceN"), F.max("Iterations").alias("Iterations")
    )
    status = (
        F.when(F.col("__ok"), "CONVERGED").when(~F.col("__ok"), "NONCONVERGED").otherwise("INSUFFICIENT_EVIDENCE")
    )
    return expected.join(per, ["Process", "Branch"], "left").select(
        "Process", "Branch", status.alias("FitStatus"), F.coalesce("EvidenceN", F.lit(0)).alias("EvidenceN"), "Iterations",
        F.lit("NOT_VALIDATED").alias("CalibrationStatus"), F.lit("BLOCKED").alias("DecisionEligibility"),
    )


def max_gap(df: DataFrame, left: Column, right: Column) -> DataFrame:
    """Largest absolute difference, for additive reconciliation."""
    return df.agg(F.max(F.abs(left - right)).alias("MaxGap"), F.count("*").alias("N"))


def histogram(df: DataFrame, keys: list[str], value: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between the key's extremes; the last bin is closed."""
    ends = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    index = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    counted = df.filter(F.col(value).isNotNull()).join(ends, keys).groupBy(*keys, index.cast("bigint").alias("Bin")).agg(
        F.count("*").alias("N"), F.min(F.col("lo")).alias("__lo"), F.min(width).alias("__w")
    )
    return counted.withColumn("LeftEdge", F.col("__lo") + F.col("Bin") * F.col("__w")).drop("__lo", "__w")


def qq_series(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Residual quantiles with their plotting positions (i + 0.5) / n."""
    facts = ranked(df, keys, value)
    middle = F.col("n_before") + (F.col("n") - 1) / 2
    return facts.select(*keys, value, F.col("n").alias("Ties"), ((middle + 0.5) / F.col("n_total")).alias("PlotPosition"))


def confidence_score(n: Column, breadth: Column, uncertainty: Column, residual_sd: Column, item: bool = True) -> Column:
    """Evidence score 0-100 from records, breadth of coverage and uncertainty."""
    n_scale, b_scale = (20, 5) if item else (30, 8)
    spread = F.greatest(F.coalesce(uncertainty, residual_sd), F.lit(1e-8)) / F.greatest(residual_sd, F.lit(1e-8))
    raw = 100 * (
        0.45 * (1 - F.exp(-F.greatest(n, F.lit(1)) / n_scale))
        + 0.35 * (1 - F.exp(-F.greatest(breadth, F.lit(1)) / b_scale))
        + 0.20 * (1 / (1 + spread))
    )
    return F.bround(clip(raw, 0.0, 100.0), 2)


def confidence_label(score: Column) -> Column:
    return F.when(score <= 40, "Low").when(score <= 70, "Medium").when(score.isNotNull(), "High")


def confidence_tier(low: Column, high: Column) -> tuple[Column, Column]:
    """(tier, advice) from the width of a 90 % interval."""
    usable = is_finite(low) & is_finite(high) & (high >= low)
    width = high - low
    tier = F.when(~usable, "Low").when(width <= 0.8, "High").when(width <= 1.8, "Medium").otherwise("Low")
    advice = (
        F.when(tier == "High", "Eligible for review").when(tier == "Medium", "Uncertainty warning").otherwise("Insufficient Evidence")
    )
    return tier, advice
