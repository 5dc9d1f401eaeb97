"""Hand-computed answers on tiny fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from assayer.functions import stonetext as X
from assayer.operators import bom as B
from assayer.operators import contracts as C
from assayer.operators import engineering as N
from assayer.operators import graph as G
from assayer.operators import metrics as M
from assayer.operators import production as P
from assayer.operators import qc as Q
from assayer.operators import scoring as R
from assayer.operators import splits as S
from assayer.operators import touch as T

DAY = dt.datetime(2026, 8, 1)
TICKET = "TicketId string, WO string, Item string, Process string, SizeAdjustedGroup string, RoundNo double, Status string, Qty double, ExpectedQty double, QcStart timestamp_ntz, QcStop timestamp_ntz, InitialWorker string, Description string"


def ticket(name, r, status, qty, expected, day, hour=8, wo="WO1"):
    start = DAY + dt.timedelta(days=day, hours=hour)
    return (name, wo, "001", "Polish", "G1", float(r), status, float(qty), float(expected), start, start + dt.timedelta(hours=1), "W1", None)


BASE = [ticket("a", 1, "Pass", 6, 10, 0), ticket("b", 1, "Fail", 4, 10, 0), ticket("c", 2, "Pass", 4, 4, 1)]


def rebuild(spark, rows, **options):
    return Q.reconstruct(Q.normalise_tickets(spark.createDataFrame(rows, TICKET)), **options)


def test_first_pass_yield(spark):
    done = rebuild(spark, BASE)
    first = done.first.collect()
    assert [(r.FPY, r.InspectedQty, r.Worker) for r in first] == [(0.6, 10.0, "W1")]
    assert done.rounds.count() == 2 and done.exceptions.isEmpty()


def test_month_exclusion_is_row_level(spark):
    rows = [*BASE, ticket("j", 1, "Pass", 1, 1, -1)]
    done = rebuild(spark, rows, exclude_month="2026-07")
    assert done.exceptions.count() == 1 and done.rounds.count() == 2


@pytest.mark.parametrize(
    "rows",
    [
        [*BASE[:2], ticket("a", 2, "Pass", 4, 4, 1)],
        [*BASE[:2], ticket("c", 2, "Pass", 5, 5, 1)],
        [*BASE[:2], ticket("c", 3, "Pass", 4, 4, 1)],
    ],
)
def test_broken_trajectories_are_rejected(spark, rows):
    done = rebuild(spark, rows)
    assert done.rounds.isEmpty() and not done.exceptions.isEmpty()


def test_open_order_sensitivity(spark):
    done = rebuild(spark, BASE, cutoff="2026-08-01 23:59:59")
    t = Q.recovery_trajectories(done.rounds, F.lit("2026-08-01 23:59:59").cast("timestamp_ntz"))
    row = t.first()
    assert row.OpenWO and row.ObservedRecoveryDifficulty is None and row.RecoverySensitivityRange == 10
    assert Q.recovery_groups(t, sensitivity_threshold=2.0).first().RecoveryStabilityFlag == "RecoveryUnstable"


def test_recovery_scores(spark):
    cutoff = F.lit("2026-09-01").cast("timestamp_ntz")
    assert Q.recovery_trajectories(rebuild(spark, BASE).rounds, cutoff).first().ObservedRecoveryDifficulty == 0
    third = [*BASE[:2], ticket("c", 2, "Fail", 4, 4, 1), ticket("d", 3, "Pass", 4, 4, 2)]
    assert Q.recovery_trajectories(rebuild(spark, third).rounds, cutoff).first().ObservedRecoveryDifficulty == pytest.approx(3.5)
    clean = [ticket("a", 1, "Pass", 10, 10, 0)]
    assert Q.recovery_trajectories(rebuild(spark, clean).rounds, cutoff).first().ObservedRecoveryDifficulty is None


def test_touch_phases(spark):
    rounds = rebuild(spark, BASE).rounds

    def at(day, hour, minute=0):
        return DAY + dt.timedelta(days=day, hours=hour, minutes=minute)

    rows = [
        ("1", "WO1", "W1", "Polish", at(0, 6), at(0, 6, 55)),
        ("2", "WO1", "W1", "Polish", at(0, 10), at(0, 11)),
        ("3", "WO1", "W2", "Polish", at(0, 12), at(0, 13)),
        ("4", "WO1", "W3", "Sanding", at(0, 12), at(0, 13)),
        ("5", "WO1", "W4", "Polish", at(0, 12), at(0, 11)),
    ]
    events = spark.createDataFrame(rows, "EventId string, WO string, Worker string, Process string, WorkerStart timestamp_ntz, WorkerStop timestamp_ntz")
    out = {r.EventId: r for r in T.reconstruct_touch(events, rounds).collect()}
    assert [out[k].Phase for k in "12345"] == ["FirstPass", "Rework", "Rework", "OtherProcess", "InvalidTouch"]
    assert (out["2"].Attribution, out["3"].Attribution) == ("SelfRework", "AssistedRescue")
    assert out["1"].TouchMinutes == 55


def test_overlap_counts_match_brute_force(spark):
    import random

    random.seed(3)
    rows = []
    for i in range(120):
        a, b = random.randint(0, 60), random.randint(0, 60)
        if i % 10 == 0:
            b = a
        rows.append((str(i), f"WO{i % 3}", f"W{i % 2}", "P", DAY + dt.timedelta(minutes=a), DAY + dt.timedelta(minutes=b)))
    events = spark.createDataFrame(rows, "EventId string, WO string, Worker string, Process string, WorkerStart timestamp_ntz, WorkerStop timestamp_ntz")
    got = {r.EventId: r.Overlaps for r in T.flag_overlaps(events).collect()}
    for e in rows:
        if e[4] <= e[5]:
            hits = sum(o[1] == e[1] and o[2] == e[2] and o[4] < e[5] and o[5] > e[4] for o in rows)
            assert got[e[0]] == (hits > 1), e


def test_embargo(spark):
    rows = [("A", 1), ("B", 1), ("B", 9), ("C", 8), ("D", 9)]
    df = spark.createDataFrame([(w, DAY + dt.timedelta(days=d)) for w, d in rows], "WO string, t timestamp_ntz")
    out = S.chronological_split(df, "t", "WO", 0.5)
    assert {r.WO for r in out.filter("Split = 'embargo'").collect()} == {"B"}
    ends = out.groupBy("Split").agg(F.min("t"), F.max("t")).collect()
    span = {r[0]: (r[1], r[2]) for r in ends}
    assert span["train"][1] < span["test"][0]


def test_components_and_extrapolation(spark):
    rows = [("P", "A", "G1", 5.0), ("P", "B", "G1", None), ("P", "C", "G2", None)]
    out = {r.SizeAdjustedGroup: r for r in G.connectivity(spark.createDataFrame(rows, "Process string, Worker string, SizeAdjustedGroup string, Skill double")).collect()}
    assert out["G1"].ConnectedComponentID != out["G2"].ConnectedComponentID
    assert out["G2"].ExtrapolationFlag and not out["G1"].ExtrapolationFlag


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([("k", f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)], "k string, a string, b string")
    parts = G.connected_components(edges, ["k"], "a", "b")
    assert parts.select("Root").distinct().collect()[0].Root == "n000" and parts.count() == 61


def test_five_factors(spark):
    base = [("I", "P", f, 5.0, "e", "s", "a", "v", "true", "Valid", 0.9, "ESTIMATED_VALIDATED") for f in R.FACTOR_WEIGHTS]
    cols = "Item string, Process string, Factor string, Score double, Evidence string, Scorer string, Approver string, Version string, Approved string, DataQualityStatus string, ConfidencePct double, ConfidenceStatus string"
    assert R.technical_complexity(spark.createDataFrame(base, cols)).first().FinalTechnicalComplexity == pytest.approx(5)
    broken = [base[0][:3] + (None,) + base[0][4:], *base[1:]]
    assert R.technical_complexity(spark.createDataFrame(broken, cols)).first().FinalTechnicalComplexity is None
    tier, _ = M.confidence_tier(F.lit(3.0), F.lit(5.0))
    assert spark.range(1).select(tier).first()[0] == "Low"


def test_quantity_allocation(spark):
    hours = spark.createDataFrame([("WO100", 1, "W1", 3.0), ("WO100", 1, "W2", 1.0)], "WO string, RoundNo bigint, Worker string, Final double")
    orders = spark.createDataFrame([("WO100", 20.0)], "WO string, GoodPieces double")
    out = P.allocate_quantity(P.worker_round_hours(hours), orders, by_hours=True)
    assert {r.Worker: r.Qty for r in out.collect()} == {"W1": 15.0, "W2": 5.0}


LINE = "SourceFile string, Fg string, Node string, NodeItem string, Component string, Supply string, Qty double, Unit string, ItemGroup string, Weight double"


def line(node, component, supply, qty, group, weight=None, unit="PCS"):
    return ("f", "FG", node, f"i{node}", component, supply, float(qty), unit, group, weight)


SHARED = [
    line("S", "a", "A", 2, "SM_X"), line("S", "b", "B", 3, "SM_X"), line("A", "c", "C", 1, "SM_X"), line("B", "c", "C", 1, "SM_X"),
    line("C", "d", "", 2, "RM_Diamond", 4.0), line("C", "k", "", 1, "SM_Casting"),
]


def roll(spark, rows):
    return {r.SemiBom: r for r in B.roll_up(spark.createDataFrame(rows, LINE)).collect()}


def test_shared_descendant(spark):
    s = roll(spark, SHARED)["S"]
    assert (s.StoneCount, s.TotalStoneWeightGram, s.AvgStoneWeightGram, s.MaxStoneWeightGram) == (10, 20, 2, 2)
    assert s.LargestSingleStonePctOfAllStones == 10 and s.LeafPartCountPCS == 5


def test_bom_defects(spark):
    assert roll(spark, [*SHARED[:4], line("C", "d", "", 2, "RM_Diamond")])["S"].TotalStoneWeightGram is None
    twice = roll(spark, [line("S", "d", "", 1, "RM_Diamond", 1.0)] * 2)["S"]
    assert twice.StoneCountScenario == 1 and twice.StoneCount is None
    gone = roll(spark, [line("S", "a", "A", 1, "SM_X")])["S"]
    assert gone.StoneCount is None and gone.Status == "Missing child BOM: A"
    loop = roll(spark, [line("S", "a", "A", 1, "SM_X"), line("A", "s", "S", 1, "SM_X"), line("A", "d", "", 1, "RM_Diamond", 1.0)])
    assert "Circular BOM" in loop["S"].Status and loop["S"].StoneCountScenario == 1


def test_casting_recipe(spark):
    rows = [line("S", "k", "K", 2, "SM_Casting"), line("K", "d", "", 3, "RM_Diamond", 6.0)]
    s = roll(spark, rows)["S"]
    assert (s.CastingCountPCS, s.StoneCount, s.TotalStoneWeightGram) == (2, 6, 12)


def test_quotes(spark):
    rows = [("2A", "x", "5"), ("2B", "x", "5"), ("2B", "x", "0"), ("2C", "x", "0"), ("1X", "x", "4")]
    quotes = spark.createDataFrame(rows, "SemiBom string, QuoteItem string, Minutes string")
    scope = spark.createDataFrame([("2A",), ("2B",), ("2C",)], "SemiBom string")
    _, audit = N.classify_quotes(quotes, scope)
    assert {(r.SemiBom, r.QuoteStatus) for r in audit.collect()} == {
        ("2A", "SUPPLIED"), ("2B", "CONFLICTING_QUOTE"), ("2C", "NONPOSITIVE_QUOTE"), ("1X", "OUTSIDE_SEMI_SCOPE"),
    }


def test_calibration_gap(spark):
    rows = spark.createDataFrame([("a", 90.0, 100.0, 0.9), ("b", 0.0, 1.0, 0.1)], "WO string, PassQty double, InspectedQty double, Prediction double")
    out = M.calibration_error(M.calibration_bins(rows, []), []).first()
    assert out.CalibrationGap == pytest.approx(0.1 / 101) and out.Pieces == 101


def test_difficulty_without_learning(spark):
    rows = spark.createDataFrame([(4.0, 8.0, 6.0, 2.0)], "QualityScore double, PartScore double, MaterialScore double, StoneScore double")
    out = N.difficulty_features(rows).first()
    assert out.DifficultyCoverage == pytest.approx(0.95) and out.DifficultyScore == pytest.approx((1.6 + 2.0 + 1.2 + 0.2) / 0.95)


def test_rejections(spark):
    one = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(C.ContractError):
        C.checked_join(one, one, ["k"])
    with pytest.raises(C.ContractError):
        C.require_columns(one, ["missing"], "test")
    with pytest.raises(C.ContractError):
        P.item_mapping(spark.createDataFrame([("i", "P"), ("i", "Q")], "Item string, Process string"))
    with pytest.raises(C.ContractError):
        P.clean_skills(spark.createDataFrame([("w", "P", 11.0)], "Worker string, Process string, Skill double"))


def test_stone_sizes(spark):
    names = {"CZ 2,5 x 3 mm": 3.0, "3-4mm": 4.0, "5mm h=9mm": 5.0, "pearl top drill 1x2mm 6 mm": 6.0, "4 x": 4.0, "plain": None}
    df = spark.createDataFrame([(n, "Pearl", None) for n in names], "ProductName string, StoneType string, UnitWeightGram double")
    assert {r.ProductName: r.MajorSizeMm for r in X.with_size(df).collect()} == names
