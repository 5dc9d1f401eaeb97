"""Steps whose work must not outgrow their input."""

import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.catalog import models as C
from assayer.catalog.registry import Inputs
from assayer.functions.expressions import poisson_one, sorted_percentile
from assayer.operators import bom as B
from assayer.operators import crossval as V
from assayer.operators import effects as E
from assayer.operators import eliminated as X
from assayer.operators import jointtime as J
from assayer.operators import learning as L
from assayer.operators import posterior as D
from assayer.operators import resample as R
from assayer.streaming import jobs as S


def history(spark, n=400):
    rng = np.random.default_rng(8)
    rows = [("P", f"G{i % 2}", f"I{i}", f"W{i}", *np.round(rng.lognormal(size=3), 2).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "Process string, SizeAdjustedGroup string, Item string, Worker string, " + ", ".join(f"{s}EffortRatio double" for s in L.STAGES))


@pytest.mark.parametrize("reach", [L.NEAR_MIDDLE, 0.1])
def test_resampled_medians_are_exact_and_write_no_replicated_pairs(spark, monkeypatch, reach):
    pairs, sizes = history(spark).persist(), []
    scores = pairs.groupBy("Process", "SizeAdjustedGroup").agg(
        F.lit(True).alias("Eligible"), F.lit(5.0).alias("LearningSourceScore"), *[F.median(f"{s}EffortRatio").alias(f"Learning{s}Ratio") for s in L.STAGES]
    )

    def spied(cut):
        def run(df):
            out = cut(df)
            sizes.append(out.count())
            return out

        return run

    for name in ("cut_lineage", "settle"):
        if hasattr(L, name):
            monkeypatch.setattr(L, name, spied(getattr(L, name)))
    monkeypatch.setattr(L, "NEAR_MIDDLE", reach, raising=False)
    assert L.learning_bootstrap(pairs, scores, repetitions=40).count() == 2
    assert max(sizes) <= 400  # 40 replicates of 400 pairs would be some 10,000 rows
    got = {(r.SizeAdjustedGroup, r.Rep, r.Stage): r.v for r in L._resampled_medians(pairs, 40, 42).collect()}
    k = poisson_one(F.lit(42), F.col("Rep"), *[F.col(c) for c in L.PAIR])
    drawn = pairs.withColumn("Rep", F.explode(F.sequence(F.lit(1), F.lit(40)))).withColumn("k", k).toPandas()
    for (group, rep), rows in drawn.groupby(["SizeAdjustedGroup", "Rep"]):
        for i, s in enumerate(L.STAGES, 1):
            assert got[group, rep, i] == pytest.approx(np.median(np.repeat(rows[f"{s}EffortRatio"], rows.k)), abs=1e-12)
    assert len(got) == 2 * 40 * 3


def test_joint_time_is_solved_without_descent(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(150):
        pb, worker = f"P{i % 2} / First pass", None if i % 25 == 0 else f"W{rng.integers(9)}"
        d, q = (None if i % 9 == 0 else float(rng.integers(10))), (None if i % 7 == 0 else float(rng.integers(1, 12)))
        rows.append((pb.split(" / ")[0], pb, f"{pb} / G{rng.integers(4)}", worker, d, q, float(rng.normal() + (d or 0) * 0.05)))
    names = "Process string, PB string, GroupKey string, WorkerKey string, DifficultyScore double, QuotedMinutesPerSemi double, LogMinutes double"
    df = spark.createDataFrame(rows, names)
    prior = spark.createDataFrame([(None, 0.4), ("P0", 0.7)], "Process string, Elasticity double")

    def refuse(*args, **options):
        raise AssertionError("a Spark job per step")

    with monkeypatch.context() as patch:
        patch.setattr(J, "LinearRegression", refuse)
        solved = {(r.Block, r.Key): r.Estimate for r in J.fit_joint_time(df, prior=prior, prior_weight=50.0).coefficients.collect()}
    monkeypatch.setattr(J, "SOLVED_TERMS", 0, raising=False)
    descended = {(r.Block, r.Key): r.Estimate for r in J.fit_joint_time(df, prior=prior, prior_weight=50.0, max_iter=2000).coefficients.collect()}
    assert solved.keys() == descended.keys() and max(abs(solved[k] - v) for k, v in descended.items()) < 1e-3


def test_audit_tells_rounding_from_a_difference(spark):
    names = [*B.CONTEXT, "SemiBom"]
    rolled = ["CastingCountScenario", "StoneCountScenario", "KnownStoneWeightGram", "AvgStoneWeightGram", "StoneCount", "TotalStoneWeightGram", "LargestSingleStonePctOfAllStones"]
    w, n = 3e9 + 0.1, 7e8 + 1
    top = [("F", "FG", k, 5.0, n, w, w / n, n, total, 1.0) for k, total in (("same", w), ("order", w), ("apart", w), ("cyclic", w), ("average", w * (1 + 1e-9)))]
    up = [("F", "FG", k, 5.0, n, x) for k, x in (("same", w), ("order", w + 2e-6), ("apart", w * (1 + 1e-9)), ("average", w))]
    a = spark.createDataFrame(top, ", ".join(f"{c} string" for c in names) + ", " + ", ".join(f"{c} double" for c in rolled))
    b = spark.createDataFrame(up, ", ".join(f"{c} string" for c in names) + ", Castings double, Stones double, Weight double")
    assert B.audit(a, b).first()[:] == (5, 2, 1)


def stream_of(spark, folder, *files):
    """A stream that takes one file a trigger, in the given order."""
    for rows in files:
        rows.coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(files[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_trajectories_keep_their_state_without_python(spark, tmp_path):
    names = "WO string, RoundNo bigint, PassQty double, ReworkQty double"
    first = spark.createDataFrame([("A", 1, 5.0, 4.0), ("B", 1, 7.0, 0.0), ("C", 1, 1.0, None)], names)
    second = spark.createDataFrame([("A", 2, 3.0, 1.0), ("B", 2, 2.0, 0.0)], names)
    table = S.open_trajectories(stream_of(spark, tmp_path / "in", first, second))
    assert "Pandas" not in table._jdf.queryExecution().analyzed().toString()
    rows = S.drain(table, "update").groupBy("WO").agg(F.max_by(F.struct("FirstFailQty", "RecoveredQty", "RemainingFailQty", "RoundsReached", "OpenWO"), "BatchId").alias("s"))
    assert {r.WO: tuple(r.s) for r in rows.collect()} == {"A": (4.0, 3.0, 1.0, 2, True), "B": (0.0, 2.0, 0.0, 2, False), "C": (0.0, 0.0, 0.0, 1, False)}


def test_alerts_reach_across_triggers(spark, tmp_path):
    def rows(*given):
        return spark.createDataFrame([(e, "A", w, *[None if h is None else datetime(2024, 1, 1, h) for h in t]) for e, w, *t in given], "EventId string, WO string, Worker string, WorkerStart timestamp, WorkerStop timestamp")

    first = rows(("1", "X", 1, 5), ("2", "X", 2, 3), ("3", "X", 5, 6), ("4", None, 1, 9), ("5", "Y", 1, None))
    second = rows(("6", "X", 5, 7), ("7", "X", 7, 8), ("8", None, 2, 3), ("9", "Y", 2, 3), ("10", "X", None, 9))
    table = S.overlap_alerts(stream_of(spark, tmp_path / "in", first, second))
    assert {r.EventId for r in table.filter("Late").collect()} == {"2", "6", "8"} and table.count() == 10


def test_effects_are_attached_without_moving_rows_to_their_process(spark, sf):
    inp = Inputs(spark, sf)
    rows = C.times(inp).select("Process", "SizeAdjustedGroup", "Worker", "LogTime").localCheckpoint()
    plan = E.predict_log_time(rows, C.fixed_effects(inp), ["Process"], "SizeAdjustedGroup")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in plan


def weighed(spark):
    rng = np.random.default_rng(3)
    rows = [("P", f"W{rng.integers(7)}", f"G{rng.integers(5)}", float(rng.integers(1, 9)), float(rng.normal()), i) for i in range(300)]
    return spark.createDataFrame([*rows, ("P", "W0", "G9", 1.0, 0.5, 299)], "Process string, Worker string, SizeAdjustedGroup string, Qty double, LogTime double, WO int").persist()


@pytest.mark.parametrize("solved", [X.SOLVED_ITEMS, 0])
def test_copies_of_rows_are_fitted_without_repeating_them(spark, monkeypatch, solved):
    rows, sizes, cut = weighed(spark), [], E.settle
    copies = [(F.col("WO") % (c + 2) + F.when(F.col("WO") == 299, -(F.col("WO") % (c + 2))).otherwise(0)).cast("int") for c in range(4)]
    pairs = F.array(*[F.struct(F.lit(c).cast("bigint").alias("Rep"), k.alias("k")) for c, k in enumerate(copies)])
    whole = E.fit_two_way(rows.select("*", F.inline(pairs)).filter("k > 0"), ["Process", "Rep"], "SizeAdjustedGroup", copies=F.col("k"))

    def spied(df):
        out = cut(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(X, "SOLVED_ITEMS", solved)
    monkeypatch.setattr(E, "settle", spied)
    fit = E.fit_two_way_copies(rows, ["Process"], "SizeAdjustedGroup", copies, "Rep")
    assert sizes[0] <= 7 * 5 + 1  # four copies would hold four times as many cells
    for name, entity, value in (("workers", "Worker", "WorkerEffect"), ("items", "ItemKey", "ItemEffect")):
        want, got = ({(r.Rep, r[entity]): r[value] for r in getattr(f, name).collect()} for f in (whole, fit))
        assert want.keys() == got.keys() and (3, "G9") not in got and max(abs(want[k] - got[k]) for k in want) < 1e-8
    want, got = ({r.Rep: r.Intercept for r in f.health.collect()} for f in (whole, fit))
    assert got == pytest.approx(want, abs=1e-8)


def test_resamples_and_folds_move_a_row_once(spark, monkeypatch):
    def refuse(*args, **options):
        raise AssertionError("rows repeated for every copy")

    rows = weighed(spark)
    folds = lambda: V.cross_validate(rows, ["Process"], "SizeAdjustedGroup", fitter, ["WO", "Worker"])[1].first().asDict()
    fitter = lambda df, keys: E.fit_two_way(df, keys, "SizeAdjustedGroup")
    want, fitter = folds(), None
    monkeypatch.setattr(E, "fit_two_way", refuse)
    monkeypatch.setattr(R, "fit_two_way", refuse, raising=False)
    got = folds()
    assert {k: v for k, v in got.items() if k != "Process"} == pytest.approx({k: v for k, v in want.items() if k != "Process"}, abs=1e-8)
    assert R.item_stability(rows, ["Process"], "SizeAdjustedGroup", ["WO", "Worker"]).count() == 6


def test_levels_of_many_steps_are_not_broadcast(spark, monkeypatch):
    links = [(f"N{k}", f"N{k + 1}") for k in range(4)]
    rows = [("F", "FG", a, b, 2.0, "PCS", "SM_FGs", True) for a, b in links]
    lines = spark.createDataFrame(rows, "SourceFile string, Fg string, Node string, Supply string, Qty double, Unit string, ItemGroup string, ValidQty boolean").persist()
    plans, cut = [], B.cut_lineage

    def spied(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return cut(df)

    monkeypatch.setattr(B, "BROADCAST_STEPS", 2, raising=False)
    monkeypatch.setattr(B, "cut_lineage", spied)
    reach = {(r.Root, r.Node): r.Multiplier for r in B.closure(lines).collect()}
    assert reach == {(f"N{a}", f"N{b}"): 2.0 ** (b - a) for a in range(4) for b in range(a, 4)}
    grown = [p for p in plans if "StepQty" in p and "Multiplier" in p]
    assert len(grown) == 4 and not any("BroadcastHashJoin" in p for p in grown)


def test_bounds_of_draws_come_from_one_list(spark):
    rng = np.random.default_rng(5)
    draws = [("P", "B", d, "v", f"G{g}", float(rng.normal())) for d in range(1, 8 + 1) for g in range(3)]
    table = spark.createDataFrame(draws, "Process string, Branch string, Draw int, Param string, Entity string, Value double").persist()
    summary = D.group_summary(table)
    assert "percentile(" not in summary._jdf.queryExecution().optimizedPlan().toString()
    wanted = {"Lower95": 0.025, "Upper95": 0.975, "Lower975": 0.0125, "Upper975": 0.9875}
    each = D.difficulty_draws(table).groupBy("SizeAdjustedGroup").agg(*[F.percentile("Difficulty", F.lit(p)).alias(n) for n, p in wanted.items()])
    want = {r.SizeAdjustedGroup: [r[n] for n in wanted] for r in each.collect()}
    assert {r.SizeAdjustedGroup: [r[n] for n in wanted] for r in summary.collect()} == want


def test_percentile_of_a_sorted_list(spark):
    lists = spark.createDataFrame([(0, []), (1, [4.0]), (2, [1.0, 3.0]), (3, [1.0, 2.0, 2.0, 8.0, 9.5])], "k int, x array<double>")
    for share in (0.0, 0.05, 0.5, 0.975, 1.0):
        got = {r.k: r.p for r in lists.select("k", sorted_percentile(F.col("x"), share).alias("p")).collect()}
        want = {r.k: r.p for r in lists.select("k", F.explode_outer("x").alias("v")).groupBy("k").agg(F.percentile("v", F.lit(share)).alias("p")).collect()}
        assert got == want


def test_five_factors_are_told_without_a_distinct_count(spark):
    from assayer.operators import scoring as Q

    names = list(Q.FACTOR_WEIGHTS)
    sets = {"whole": names, "twice": [*names[:4], names[0]], "other": [*names[:4], "x"], "none": ["x"] * 5, "short": names[:4], "more": [*names, names[0]], "null": [*names[:4], None]}
    rows = [(item, "P", f, 5.0, "e", "s", "a", "v", "true", "Valid", 0.9, "ESTIMATED_VALIDATED") for item, found in sets.items() for f in found]
    columns = "Item string, Process string, Factor string, Score double, Evidence string, Scorer string, Approver string, Version string, Approved string, DataQualityStatus string, ConfidencePct double, ConfidenceStatus string"
    gated = Q.technical_complexity(spark.createDataFrame(rows, columns))
    assert "Expand" not in gated._jdf.queryExecution().optimizedPlan().toString()
    assert {r.Item for r in gated.collect() if "Missing or duplicate factors" not in r.FactorGate} == {"whole"}


def test_missing_branches_need_no_ranks(spark, monkeypatch):
    rows = [("P", "B", d, "v", f"G{g}", (d * 7 + g * 3) % 5 / 5.0) for d in range(6) for g in range(4)]
    draws = spark.createDataFrame(rows, "Process string, Branch string, Draw int, Param string, Entity string, Value double")
    full = {r.SizeAdjustedGroup: r.Difficulty10 for r in D.group_summary(draws).collect()}
    monkeypatch.setattr(D, "average_rank", None)
    assert {r.SizeAdjustedGroup: r.Difficulty10 for r in D.group_difficulty(draws).collect()} == pytest.approx(full)


def test_ticket_effects_rebuild_the_rounds_once(spark, monkeypatch):
    from assayer.catalog import attribution, details, models

    made, rounds = [], attribution.rounds
    for module in (attribution, details, models):
        if hasattr(module, "rounds"):
            monkeypatch.setattr(module, "rounds", lambda inp: made.append(1) or rounds(inp))
    details.with_effects(Inputs(spark, "/root/testdata/sf0.001"))
    assert len(made) == 1


def exchanges(df):
    """Tables that move between tasks, broadcasts apart."""
    return len(re.findall(r"(?<!Broadcast)Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_rounds_move_their_tickets_once_and_their_orders_once(spark, sf):
    from assayer.catalog import attribution

    assert exchanges(attribution.rounds_once(Inputs(spark, sf))) == 2


def test_draws_are_made_where_their_round_already_is(spark, sf):
    from assayer.catalog import bayes_time

    inp = Inputs(spark, sf)
    rows = bayes_time.cohort(inp)
    draws = spark.read.parquet(*bayes_time.settle(bayes_time.draws_of(rows)).inputFiles())
    assert "Unseen" in "".join((plan := D.predict_quality(draws, rows)).columns)
    moved = plan._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning(WO")[0]
    assert "collect_list" in moved and "Exchange hashpartitioning(WO" in plan._jdf.queryExecution().executedPlan().toString()
    assert moved.count("ObjectHashAggregate") == 2


@pytest.mark.parametrize("divisor", [200, 7])
def test_a_remainder_reaches_few_parts(spark, tmp_path, divisor):
    from assayer.sources import bridge

    spark.range(-300, 5_000).selectExpr("id AS p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    kept = bridge._reached(bridge.table(spark, str(tmp_path), "part"), divisor)
    assert sorted(r[0] for r in kept.collect()) == list(range(1 - divisor, divisor))


def test_crowded_orders_are_phased_as_the_others(spark, monkeypatch):
    from assayer.operators import touch as T

    rng, day = np.random.default_rng(2), datetime(2026, 1, 1)
    rounds, rows = [], []
    for o in range(12):
        start = 0
        for r in range(1, 4):
            start += int(rng.integers(20, 40))
            rounds.append((f"WO{o}", r, "P", day + timedelta(minutes=start), day + timedelta(minutes=start + 5), float(rng.integers(0, 3))))
        for e in range(14):
            a = int(rng.integers(0, 120))
            b = a + int(rng.integers(0, 9)) - (6 if e % 7 == 0 else 0)
            rows.append((f"{o}-{e}", f"WO{o}" if e else None, f"W{rng.integers(2)}" if e != 3 else None, "P" if e % 5 else "Q", day + timedelta(minutes=a), day + timedelta(minutes=b)))
    done = spark.createDataFrame(rounds, "WO string, RoundNo bigint, Process string, QcStart timestamp_ntz, QcStop timestamp_ntz, FailQty double").persist()
    events = spark.createDataFrame(rows, "EventId string, WO string, Worker string, Process string, WorkerStart timestamp_ntz, WorkerStop timestamp_ntz").persist()
    found = []
    for bound in (T.CROWDED, 0, 13):
        monkeypatch.setattr(T, "CROWDED", bound)
        out = T.reconstruct_touch(events, done).collect()
        found.append({r.EventId: (r.Phase, r.RoundNo, r.Attribution, r.TouchMinutes, r.Overlaps if r.WorkerStart <= r.WorkerStop else None) for r in out})
        assert len(out) == len(rows)
    assert found[0] == found[1] == found[2] and {p[0] for p in found[0].values()} > {"OverlappingTouch", "Rework", "FirstPass"}
