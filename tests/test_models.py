"""Iterative estimators against dense or single-machine computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import effects as E
from assayer.operators import eliminated as X
from assayer.operators import jointtime as J
from assayer.operators import metrics as M
from assayer.operators import ordering as O
from assayer.operators import resample as S


@pytest.fixture(scope="module")
def times(spark):
    rng = np.random.default_rng(1)
    rows = [(f"P{i % 2}", f"W{rng.integers(5)}", f"G{rng.integers(4)}", float(rng.normal()), float(rng.integers(1, 9))) for i in range(80)]
    return spark.createDataFrame(rows, "Process string, Worker string, Item string, LogTime double, Qty double"), rows


@pytest.fixture(scope="module")
def outcomes(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(90):
        n = int(rng.integers(3, 12))
        rows.append((f"P{i % 2}", f"W{rng.integers(4)}", f"G{rng.integers(3)}", int(rng.integers(1, 3)), float(rng.binomial(n, 0.6)), float(n), 1.0))
    return spark.createDataFrame(rows, "Process string, Worker string, SizeAdjustedGroup string, RoundNo bigint, PassQty double, InspectedQty double, lam double"), rows


def test_marginal_likelihood_is_dense_gaussian(times):
    df, rows = times
    fit = E.fit_time_em(df, ["Process"])
    for h in fit.health.collect():
        part = [r for r in rows if r[0] == h.Process]
        y, w = np.array([r[3] for r in part]), np.sqrt([r[4] for r in part])
        w = w / w.mean()
        items = {r.ItemKey: r.ItemEffect for r in fit.items.filter(F.col("Process") == h.Process).collect()}
        mean = np.array([h.Intercept + items[r[2]] for r in part])
        same = np.array([[a[1] == b[1] for b in part] for a in part])
        cov = np.diag(h.ResidualVariance / w) + h.WorkerVariance * same
        r = y - mean
        dense = -0.5 * (len(y) * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + r @ np.linalg.solve(cov, r))
        assert h.LogLikelihood == pytest.approx(dense, abs=1e-7)


def test_two_way_solves_the_normal_equations(times):
    df, rows = times
    fit = E.fit_two_way(df, ["Process"], max_iter=500, tol=1e-12)
    for h in fit.health.collect():
        part = [r for r in rows if r[0] == h.Process]
        names = ["1"] + sorted({"g" + r[2] for r in part}) + sorted({"w" + r[1] for r in part})
        x = np.array([[float(n in ("1", "g" + r[2], "w" + r[1])) for n in names] for r in part])
        w = np.sqrt([max(1.0, r[4]) for r in part])
        y = np.array([r[3] for r in part])
        dense = x @ np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        items = {r.ItemKey: r.ItemEffect for r in fit.items.filter(F.col("Process") == h.Process).collect()}
        workers = {r.Worker: r.WorkerEffect for r in fit.workers.filter(F.col("Process") == h.Process).collect()}
        assert h.Converged and max(abs(h.Intercept + items[r[2]] + workers[r[1]] - f) for r, f in zip(part, dense)) < 1e-8


def test_time_variances_are_stationary(times):
    """At the solution neither variance can be moved to a higher marginal likelihood."""
    df, rows = times
    fit = E.fit_time_em(df, ["Process"], max_iter=400, tol=1e-13)
    for h in fit.health.collect():
        part = [r for r in rows if r[0] == h.Process]
        w = np.sqrt([r[4] for r in part])
        w = w / w.mean()
        items = {r.ItemKey: r.ItemEffect for r in fit.items.filter(F.col("Process") == h.Process).collect()}
        e = np.array([r[3] - h.Intercept - items[r[2]] for r in part])
        same = np.array([[a[1] == b[1] for b in part] for a in part])

        def likelihood(s2, t2):
            cov = np.diag(s2 / w) + t2 * same
            return -0.5 * (np.linalg.slogdet(cov)[1] + e @ np.linalg.solve(cov, e))

        best = likelihood(h.ResidualVariance, h.WorkerVariance)
        for k in (0.97, 1.03):
            assert likelihood(h.ResidualVariance * k, h.WorkerVariance) <= best + 1e-6
            assert likelihood(h.ResidualVariance, h.WorkerVariance * k) <= best + 1e-4


def test_adaptive_logit_is_a_fixed_point(outcomes):
    df, rows = outcomes
    fit = E.fit_crossed_logit(df, ["Process"], max_iter=400, tol=1e-9)
    for h in fit.health.collect():
        u = {r.Worker: r.WorkerEffect for r in fit.workers.filter(F.col("Process") == h.Process).collect()}
        v = {r.ItemKey: r.ItemEffect for r in fit.items.filter(F.col("Process") == h.Process).collect()}
        r_ = {r.RoundNo: r.RoundEffect for r in fit.rounds.filter(F.col("Process") == h.Process).collect()}
        part = [r for r in rows if r[0] == h.Process]
        left = [r[4] - r[5] / (1 + np.exp(-(h.Intercept + u[r[1]] + v[r[2]] + r_[r[3]]))) for r in part]
        assert h.Converged and h.WorkerVariance == pytest.approx(max(1e-8, np.mean(np.square(list(u.values())))), rel=1e-4)
        assert abs(sum(left)) < 1e-4
        for name, effect in v.items():
            assert sum(e for e, r in zip(left, part) if r[2] == name) == pytest.approx(effect / h.GroupVariance, abs=1e-3)


def test_rows_without_worker_take_no_part(times):
    df, _ = times
    more = df.unionByName(df.limit(3).withColumn("Worker", F.lit(None).cast("string")))
    a, b = E.fit_two_way(df, ["Process"]), E.fit_two_way(more, ["Process"])
    gap = a.items.join(b.items.withColumnRenamed("ItemEffect", "o"), ["Process", "ItemKey"]).agg(F.max(F.abs(F.col("ItemEffect") - F.col("o")))).first()
    assert gap[0] < 1e-9


def test_sweeps_reach_the_direct_solutions(times, outcomes):
    df, _ = times
    a, b = (E.fit_two_way(df, ["Process"], tol=1e-9, local_cells=n) for n in (None, 0))
    gap = a.items.join(b.items.withColumnRenamed("ItemEffect", "o"), ["Process", "ItemKey"]).agg(F.max(F.abs(F.col("ItemEffect") - F.col("o")))).first()
    assert gap[0] < 1e-7
    df, _ = outcomes
    a, b = (E.fit_crossed_logit(df, ["Process"], E.Shrinkage("lam", 1e-6), tol=1e-4, local_cells=n) for n in (None, 0))
    gap = a.workers.join(b.workers.withColumnRenamed("WorkerEffect", "o"), ["Process", "Worker"]).agg(F.max(F.abs(F.col("WorkerEffect") - F.col("o")))).first()
    assert gap[0] < 1e-3


def test_ridge_is_the_penalised_optimum(outcomes):
    df, rows = outcomes
    fit = E.fit_crossed_logit(df, ["Process"], E.Shrinkage("lam", 1e-6), max_iter=3000, tol=1e-11)
    got = {(r.Process, r.ItemKey): r.ItemEffect for r in fit.items.collect()}
    for process in ("P0", "P1"):
        part = [r for r in rows if r[0] == process]
        names = ["1"] + sorted({"g" + r[2] for r in part}) + sorted({"w" + r[1] for r in part}) + ["r2"]
        x = np.array([[1.0 if n in ("1", "g" + r[2], "w" + r[1], f"r{r[3]}") else 0.0 for n in names] for r in part])
        y, n = np.array([r[4] for r in part]), np.array([r[5] for r in part])
        pen = np.ones(len(names))
        pen[0] = 1e-6
        beta = np.zeros(len(names))
        for _ in range(100):
            p = 1 / (1 + np.exp(-x @ beta))
            grad = x.T @ (n * p - y) + pen * beta
            beta -= np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + np.diag(pen), grad)
        for i, name in enumerate(names):
            if name.startswith("g"):
                assert got[(process, name[1:])] == pytest.approx(beta[i], abs=1e-6)


def test_single_outcome_cohort_stays_finite(spark):
    rows = [("P", f"W{i % 3}", f"G{i % 2}", 1, 5.0, 5.0, 1.0) for i in range(12)]
    df = spark.createDataFrame(rows, "Process string, Worker string, SizeAdjustedGroup string, RoundNo bigint, PassQty double, InspectedQty double, lam double")
    h = E.fit_crossed_logit(df, ["Process"], E.Shrinkage("lam", 1e-6), max_iter=200).health.first()
    assert np.isfinite(h.Intercept) and h.Intercept > 3


def test_joint_time_is_the_ridge_solution(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(120):
        pb, g, w = f"P{i % 2} / First pass", f"G{rng.integers(4)}", f"W{rng.integers(5)}"
        d = None if i % 9 == 0 else float(rng.integers(0, 10))
        q = None if i % 7 == 0 else float(rng.integers(1, 12))
        rows.append((f"WO{i}", pb.split(" / ")[0], pb, f"{pb} / {g}", f"{pb} / {w}", d, q, float(rng.normal() + (d or 0) * 0.05)))
    df = spark.createDataFrame(rows, "WO string, Process string, PB string, GroupKey string, WorkerKey string, DifficultyScore double, QuotedMinutesPerSemi double, LogMinutes double")
    fit = J.fit_joint_time(df, True, 10.0, max_iter=2000)
    s = fit.scalars
    names = sorted({("intercept", r[2]) for r in rows}) + [("d_global", J.NONE)] + sorted({("difficulty", r[2]) for r in rows}) + [("q_global", J.NONE)]
    names += sorted({("quote", r[2]) for r in rows}) + [("q_missing", J.NONE)] + sorted({("group", r[3]) for r in rows}) + sorted({("worker", r[4]) for r in rows})
    pen = {"intercept": 1e-8, "d_global": 0.1, "q_global": 0.1, "difficulty": 100, "quote": 100, "q_missing": 10, "group": 10, "worker": 10}
    x = []
    for r in rows:
        d = 0.0 if r[5] is None else (r[5] - s["dmean"]) / 10
        q = 0.0 if r[6] is None else (np.log(r[6]) - s["qmean"]) / s["qscale"]
        value = {("intercept", r[2]): 1.0, ("d_global", J.NONE): d, ("difficulty", r[2]): d, ("q_global", J.NONE): q, ("quote", r[2]): q,
                 ("q_missing", J.NONE): float(r[6] is None), ("group", r[3]): 1.0, ("worker", r[4]): 1.0}
        x.append([value.get(n, 0.0) for n in names])
    x, y = np.array(x), np.array([r[7] for r in rows])
    beta = np.linalg.solve(x.T @ x + np.diag([pen[n[0]] for n in names]), x.T @ y)
    got = {(r.Block, r.Key): r.Estimate for r in fit.coefficients.collect()}
    assert max(abs(got[n] - b) for n, b in zip(names, beta)) < 1e-3
    parts = J.predict_parts(df.withColumn("ActualMinutes", F.exp("LogMinutes")), fit)
    gap = F.col("WorkContentMinutes") + F.col("TechnicalDifficultyMinutes") + F.col("WorkerEffectMinutes") - F.col("PredictedMinutes")
    assert parts.agg(F.max(F.abs(gap))).first()[0] < 1e-9


def test_quantiles_and_kendall(spark):
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 30, 200), rng.integers(0, 20, 200)
    df = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(x, y)], "k string, x double, y double")
    q = O.quantiles(df, ["k"], "x", {"a": 0.5, "b": 0.9, "c": 0.025}).first()
    assert (q.a, q.b, q.c) == pytest.approx(tuple(np.quantile(x, [0.5, 0.9, 0.025])))
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(200) for j in range(i))
    ux = sum(x[i] != x[j] for i in range(200) for j in range(i))
    uy = sum(y[i] != y[j] for i in range(200) for j in range(i))
    assert M.kendall_tau_b(df, ["k"], "x", "y").first().Kendall == pytest.approx(s / np.sqrt(float(ux) * uy))


def test_bootstrap_interval_covers_the_point(spark):
    rng = np.random.default_rng(6)
    rows = [("P", f"WO{i}", float(rng.binomial(10, 0.7)), 10.0, 0.7, 0.5) for i in range(40)]
    df = spark.createDataFrame(rows, "Process string, WO string, PassQty double, InspectedQty double, a double, b double")
    r = S.paired_bootstrap(df, ["Process"], "a", "b", repetitions=200).first()
    assert r.Lower95 < r.LossDifference < r.Upper95 < 0
    assert S.paired_bootstrap(df.limit(5), ["Process"], "a", "b", repetitions=20).first().Status == "INSUFFICIENT_WOS"


def test_time_fits_without_their_workers_reach_the_direct_solutions(times, monkeypatch):
    df, _ = times

    def none(*_args):
        raise AssertionError("a time fit of few items needs no sweeps, whatever its cells")

    monkeypatch.setattr(E, "_swept", none)
    found = []
    for cells in (None, 0):
        two, em = E.fit_two_way(df, ["Process"], local_cells=cells), E.fit_time_em(df, ["Process"], local_cells=cells)
        effects = {(r.Process, r.ItemKey): r.ItemEffect for r in two.items.collect()} | {(r.Process, r.Worker): r.WorkerEffect for r in two.workers.collect()}
        health = {r.Process: (r.LogLikelihood, r.Intercept, r.ResidualVariance, r.WorkerVariance, r.ItemVariance, r.WorkerShare, r.AIC) for r in em.health.collect()}
        abilities = {(r.Process, r.Worker, k): r[k] for r in em.workers.collect() for k in ("Ability", "AbilitySE")}
        found.append((effects, health, abilities))
    for direct, without in zip(*found):
        assert direct.keys() == without.keys()
        assert all(without[k] == pytest.approx(v, abs=1e-6) for k, v in direct.items())


def test_time_fits_of_many_items_are_swept_to_the_same_solution(times, monkeypatch):
    df, _ = times
    monkeypatch.setattr(X, "SOLVED_ITEMS", 0)
    a, b = (E.fit_two_way(df, ["Process"], tol=1e-9, local_cells=n) for n in (None, 0))
    gap = a.items.join(b.items.withColumnRenamed("ItemEffect", "o"), ["Process", "ItemKey"]).agg(F.max(F.abs(F.col("ItemEffect") - F.col("o")))).first()
    assert gap[0] < 1e-7
