"""Sparse designs with shared teams against dense solutions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import candidates as K
from assayer.operators import designs as D


@pytest.fixture(scope="module")
def teams(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(240):
        size = int(rng.integers(0, 4))
        team = sorted({f"W{k}" for k in rng.integers(0, 6, size)})
        n = int(rng.integers(3, 20))
        kind = "single" if len(team) == 1 else "team" if team else "unknown"
        rows.append(("P", "First pass", f"WO{i}", team, kind, f"G{rng.integers(4)}", int(rng.integers(1, 4)), float(rng.binomial(n, 0.7)), float(n)))
    names = "Process string, Branch string, WO string, Workers array<string>, Attribution string, SizeAdjustedGroup string, RoundNo bigint, PassQty double, InspectedQty double"
    return spark.createDataFrame(rows, names), rows


def dense(rows, mode, weighting, penalty):
    """Newton's method on the dense design."""
    used = [r for r in rows if mode != "single" or r[4] == "single"]
    names = [D.INTERCEPT] + sorted({"g:" + r[5] for r in used}) + [f"r:{k}" for k in sorted({r[6] for r in used})[1:]]
    if mode != "group":
        names += sorted({"w:" + w for r in used for w in r[3]})
    names += ["a:team", "a:unknown"] if mode == "expanded" else []
    at = {n: i for i, n in enumerate(names)}
    x = np.zeros((len(used), len(names)))
    for i, r in enumerate(used):
        x[i, 0] = x[i, at["g:" + r[5]]] = 1
        if f"r:{r[6]}" in at:
            x[i, at[f"r:{r[6]}"]] = 1
        for w in r[3] if mode != "group" else []:
            x[i, at["w:" + w]] = 1 / len(r[3])
        if mode == "expanded" and len(r[3]) != 1:
            x[i, at["a:team" if r[3] else "a:unknown"]] = 1
    n = np.array([r[8] for r in used])
    cap = np.quantile(np.array([r[8] for r in rows if r[4] == "single"]), 0.9)
    weight = {"pieces": n, "capped": np.minimum(n, cap), "equal": np.ones(len(n))}[weighting]
    y = np.array([r[7] for r in used]) / n * weight
    pen = np.full(len(names), penalty)
    pen[0] = 1e-6
    beta = np.zeros(len(names))
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        gradient = x.T @ (weight * p - y) + pen * beta
        beta -= np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + np.diag(pen), gradient)
    return dict(zip(names, beta))


def test_every_variant_reaches_the_dense_optimum(teams):
    df, rows = teams
    every = K.RIDGE | K.EXPANDED
    fit = K.fit_expanded(df, every, (0.1, 10.0), 1e-9)
    found = {}
    for r in fit.coefficients.collect():
        found.setdefault((r["Variant"], r["Penalty"]), {})[r["Term"]] = r["Coefficient"]
    assert all(r["Converged"] for r in fit.health.collect())
    assert set(found) == {(v, p) for v in every for p in (0.1, 10.0)}
    for (variant, penalty), values in found.items():
        expected = dense(rows, *every[variant], penalty)
        assert set(values) == {t for t in expected if not t.startswith("a:") or any((len(r[3]) > 1) == (t == "a:team") and len(r[3]) != 1 for r in rows)}
        assert max(abs(values[t] - expected[t]) for t in values) < 1e-5, (variant, penalty)
    balance = K.design_balance(df, fit, every, (0.1, 10.0)).collect()
    assert len(balance) == len(found) and all(r["TermsOffBalance"] == 0 and r["Terms"] == len(found[r["Variant"], r["Penalty"]]) for r in balance)


def test_all_rounds_passed_stays_finite(spark):
    df = spark.createDataFrame([("P", "First pass", "A", ["W1"], "single", "G", 1, 5.0, 5.0), ("P", "First pass", "B", [], "unknown", "G", 1, 4.0, 4.0)],
                               "Process string, Branch string, WO string, Workers array<string>, Attribution string, SizeAdjustedGroup string, RoundNo bigint, PassQty double, InspectedQty double")
    fit = K.fit_expanded(df, {"ridge_expanded_pieces": ("expanded", "pieces")}, (1.0,), 1e-9)
    values = {r["Term"]: r["Coefficient"] for r in fit.coefficients.collect()}
    assert fit.health.first()["Converged"] and all(abs(v) < 20 for v in values.values())


def test_prediction_averages_a_team_and_ignores_unseen_terms(spark, teams):
    df, _rows = teams
    fit = K.fit_expanded(df, {"ridge_expanded_pieces": ("expanded", "pieces")}, (1.0,), 1e-9)
    c = {r["Term"]: r["Coefficient"] for r in fit.coefficients.collect()}
    new = spark.createDataFrame([("P", "First pass", "X", ["W1", "W9"], "team", "G0", 1, 1.0, 2.0), ("P", "First pass", "Y", [], "unknown", "G77", 2, 1.0, 2.0)], df.schema)
    got = {r["WO"]: r["Prediction"] for r in K.predict_expanded(fit, new).collect()}
    assert got["X"] == pytest.approx(1 / (1 + np.exp(-(c["Intercept"] + c["g:G0"] + c["w:W1"] / 2 + c["a:team"]))))
    assert got["Y"] == pytest.approx(1 / (1 + np.exp(-(c["Intercept"] + c["r:2"] + c["a:unknown"]))))


def test_gaussian_family_solves_the_normal_equations(spark):
    rng = np.random.default_rng(3)
    x, y, n = rng.normal(size=(40, 3)), rng.normal(size=40), rng.uniform(0.5, 3, 40)
    rows = spark.createDataFrame([("a", i, float(y[i]), float(n[i])) for i in range(40)], "Fit string, row long, y double, n double")
    entries = spark.createDataFrame([("a", i, f"t{k}", float(x[i, k])) for i in range(40) for k in range(3)], "Fit string, row long, Term string, Value double")
    terms = spark.createDataFrame([("a", f"t{k}", 0.5 * k, 0.3 * k, 0.0) for k in range(3)], "Fit string, Term string, Ridge double, Prior double, Start double")
    fit = D.solve(rows, entries, terms, ["Fit"], "gaussian", 1e-10)
    pen = np.array([0, 0.5, 1.0])
    expected = np.linalg.solve((x.T * n) @ x + np.diag(pen), x.T @ (n * y) + pen * np.array([0, 0.3, 0.6]))
    assert {r["Term"]: r["Coefficient"] for r in fit.coefficients.collect()} == pytest.approx({f"t{k}": expected[k] for k in range(3)}, abs=1e-7)


def test_many_terms_and_few_terms_reach_the_same_optimum(teams, monkeypatch):
    df, _ = teams
    found = []
    for bound in (400, 0):
        monkeypatch.setattr(D, "SOLVED_TERMS", bound)
        fit = K.fit_expanded(df, {"ridge_expanded_pieces": ("expanded", "pieces")}, (1.0,), 1e-9)
        assert all(r.Converged for r in fit.health.collect())
        found.append({r.Term: r.Coefficient for r in fit.coefficients.collect()})
    assert found[0].keys() == found[1].keys() and all(found[1][t] == pytest.approx(x, abs=1e-6) for t, x in found[0].items())


def test_a_newton_step_is_one_job(teams, monkeypatch):
    def none(*_args):
        raise AssertionError("fits of few terms need no conjugate gradients over tables")

    monkeypatch.setattr(D, "_direction", none)
    fit = K.fit_expanded(teams[0], {"ridge_expanded_pieces": ("expanded", "pieces")}, (0.1, 1.0), 1e-9)
    assert [r.Converged for r in fit.health.collect()] == [True, True]


def test_penalties_share_the_rows_of_a_candidate(teams, monkeypatch):
    written, settle = [], D.settle
    monkeypatch.setattr(D, "settle", lambda df: written.append(out := settle(df)) or out)
    K.fit_expanded(teams[0], {"ridge_expanded_pieces": ("expanded", "pieces")}, (0.1, 1.0, 10.0), 1e-9)
    packed = next(df for df in written if "parts" in df.columns)
    alike = teams[0].select("SizeAdjustedGroup", "RoundNo", "Workers").distinct().count()
    assert packed.count() == alike


def test_a_team_is_predicted_by_the_mean_of_its_workers(spark, teams):
    df = teams[0].withColumn("Worker", F.when(F.size("Workers") == 1, F.get("Workers", F.lit(0))))
    fit = K.fit_candidates(df, {"ridge_single_pieces": ("single", "pieces")}, (1.0,))
    effect = {r.Worker: r.WorkerEffect for r in fit.workers.collect()}
    group = {r.ItemKey: r.ItemEffect for r in fit.items.collect()}
    level = fit.health.first().Intercept
    new = [("P", "First pass", "X", ["W1", "W2"], "team", "G0", 1, 1.0, 2.0, None), ("P", "First pass", "Y", ["W3", "W9"], "team", "G0", 1, 1.0, 2.0, None), ("P", "First pass", "Z", ["W3"], "single", "G0", 1, 1.0, 2.0, "W3")]
    got = {r.WO: r.Prediction for r in K.predict_candidates(fit, spark.createDataFrame(new, df.schema)).collect()}
    for name, known in (("X", effect["W1"] / 2 + effect["W2"] / 2), ("Y", effect["W3"] / 2), ("Z", effect["W3"])):
        assert got[name] == pytest.approx(1 / (1 + np.exp(-(level + group["G0"] + known))))


def test_all_eight_candidates_are_compared(spark, teams):
    from datetime import datetime, timedelta

    days = [datetime(2026, 1, 1) + timedelta(days=i // 12) for i in range(240)]
    rows = [(*r, r[3][0] if len(r[3]) == 1 else None, d, d) for r, d in zip(teams[1], days)]
    names = "Process string, Branch string, WO string, Workers array<string>, Attribution string, SizeAdjustedGroup string, RoundNo bigint, PassQty double, InspectedQty double, Worker string, QcStart timestamp_ntz, QcStop timestamp_ntz"
    result = K.compare(spark.createDataFrame(rows, names).persist())
    every = set(K.RIDGE | K.EXPANDED | K.LEGACY)
    tuned = {(r.Variant, r.Penalty) for r in result["tuning"].collect()}
    assert tuned == {(v, p) for v in K.RIDGE | K.EXPANDED for p in K.PENALTIES} | {(v, 1.0) for v in K.LEGACY}
    assert {r.Variant for r in result["comparison"].collect()} == every
    test = result["split_assignments"].filter("Split = 'test'").count()
    assert result["predictions"].count() == test * len(every) and result["selection"].count() == 1
