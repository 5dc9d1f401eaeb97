"""Deep and cyclic structures, size texts and messages."""

import pytest
from pyspark.sql import functions as F

from assayer.functions import stonetext as X
from assayer.operators import bom as B
from assayer.operators import details as D
from assayer.operators.contracts import ContractError, assert_none
from assayer.operators.graph import connected_components
from assayer.plans.core_run import Settings


def lines_of(spark, links):
    """Lines node -> child of quantity 2; a child that is no node is a leaf stone."""
    nodes = {a for a, _ in links}
    rows = [("F", "FG", a, a, b, b if b in nodes else "", 2.0, "PCS", "SM_FGs" if b in nodes else "RM_Diamond", 0.5, 1.0, "PCS", 1.0, float(k)) for k, (a, b) in enumerate(links)]
    names = "SourceFile Fg Node NodeItem Component Supply Qty Unit ItemGroup Weight Quantity QuantityUnit CwSize Sequence".split()
    kinds = ["double" if n in ("Qty", "Weight", "Quantity", "CwSize", "Sequence") else "string" for n in names]
    return B.prepare_lines(spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))).persist()


def test_deep_chain_is_not_cyclic(spark):
    depth = 30
    lines = lines_of(spark, [(f"N{k}", f"N{k + 1}") for k in range(depth)])
    reach = B.closure(lines, look_after=8).collect()
    assert len(reach) == depth * (depth + 1) // 2 and not any(r.Cyclic for r in reach)
    top = {r.Node: r.Multiplier for r in reach if r.Root == "N0"}
    assert top[f"N{depth - 1}"] == 2.0 ** (depth - 1)
    assert B.bottom_up_totals(lines).count() == depth


def test_cycle_below_a_deep_root(spark):
    chain = [(f"N{k}", f"N{k + 1}") for k in range(12)]
    lines = lines_of(spark, [*chain, ("N12", "N10"), ("M0", "M1"), ("M1", "stone")])
    reach = B.closure(lines, look_after=4)
    cyclic = {r.Root for r in reach.filter("Cyclic").collect()}
    assert cyclic == {f"N{k}" for k in range(13)}
    assert {r.Root for r in reach.filter("NOT Cyclic").collect()} == {"M0", "M1"}
    assert {r.SemiBom for r in B.bottom_up_totals(lines).collect()} == {"M0", "M1"}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([("k", f"n{k:04d}", f"n{k + 1:04d}") for k in range(150)], "key string, a string, b string")
    assert {r.Root for r in connected_components(edges, ["key"], "a", "b").collect()} == {"n0000"}


@pytest.mark.parametrize(("name", "size"), [("ring h=10mm 8mm", 10.0), ("8mm h=10mm", 8.0), ("4x6mm thickness 9mm", 6.0), ("plain 5mm and 7mm", 7.0), ("no size", None)])
def test_sizes_announced_before_earlier_sizes(spark, name, size):
    df = spark.createDataFrame([(name,)], "ProductName string")
    assert X.with_size(df).first().MajorSizeMm == size


def test_message_names_the_first_five_keys(spark):
    df = spark.range(20).select(F.col("id").alias("k"))
    with pytest.raises(ContractError, match="bad: 0; 1; 2; 3; 4$"):
        assert_none(df, "bad", ["k"])


def test_ticket_statuses(spark):
    tickets = spark.createDataFrame([("a", "W1", 1, "I1"), ("b", "W1", 2, "I1"), ("c", "W2", 1, "I9"), ("d", "W3", 1, "I3")], "TicketId string, WO string, RoundNo long, Item string")
    rounds = spark.createDataFrame([("W1", 1, "I1", "P", 3.0, 4.0), ("W1", 2, "I1", "P", 1.0, 1.0), ("W2", 1, "I2", "P", 1.0, 2.0)], "WO string, RoundNo long, Item string, Process string, PassQty double, InspectedQty double")
    linked = D.link_tickets(tickets, rounds)
    found = {r.TicketId: (r.RoundLinkStatus, r.ItemMatchStatus, r.RoundFPY) for r in linked.collect()}
    assert found == {
        "a": ("MATCHED_CORE_ROUND", "MATCHED", 0.75), "b": ("MATCHED_CORE_ROUND", "MATCHED", None),
        "c": ("MATCHED_CORE_ROUND", "ITEM_MISMATCH", None), "d": ("NOT_IN_CORE_ROUNDS", "NOT_LINKED", None),
    }
    crews = spark.createDataFrame([("W1", 1, "x", 2.0, 1), ("W2", 1, "y", 1.0, 1)], "WO string, RoundNo long, Worker string, Hours double, WorkersInRound long")
    effects = spark.createDataFrame([("P", "FIRST_PASS", "x", 0.3)], "Process string, Branch string, Worker string, WorkerEffect double")
    status = {r.TicketId: r.WorkerScoreStatus for r in D.ticket_workers(linked, crews, effects).collect()}
    assert status == {"a": "DIAGNOSTIC_ONLY", "b": "NO_ATTRIBUTED_PRODUCTION_WORKER", "c": "NO_FITTED_EFFECT", "d": "NO_ATTRIBUTED_PRODUCTION_WORKER"}


def test_a_run_must_name_its_version():
    with pytest.raises(TypeError):
        Settings(cutoff="2026-09-14")
