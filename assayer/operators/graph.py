"""Worker-group networks: connected components and network evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.expressions import or_false
from assayer.operators.contracts import require_columns
from assayer.operators.ordering import row_positions
from assayer.operators.production import GROUP
from assayer.session import cut_lineage


def connected_components(edges: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """(keys, Node, Root): the smallest node label of each node's component.

    Alternates two star contractions (hook every larger neighbour, then every smaller one,
    to the local minimum), which needs a logarithmic number of rounds however long the paths
    are. Each step is a grouped minimum and an equi-join, both safe for hub nodes.
    """
    pair = edges.select(*keys, F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
    nodes = edges.select(*keys, F.explode(F.array(left, right)).alias("Node")).distinct()
    links = cut_lineage(pair.filter("a <> b").distinct())
    before = None
    while True:
        links = cut_lineage(_hook_smaller(_hook_larger(links, keys), keys))
        state = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*keys, "a", "b")).alias("h")).first()
        if before == (state["n"], state["h"]):
            break
        before = (state["n"], state["h"])
    roots = links.groupBy(*keys, F.col("a").alias("Node")).agg(F.min("b").alias("Root"))
    return nodes.join(roots, [*keys, "Node"], "left").withColumn("Root", F.coalesce("Root", "Node"))


def _hook_larger(links: DataFrame, keys: list[str]) -> DataFrame:
    both = links.select(*keys, F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))
    lowest = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(lowest, [*keys, "u"]).select(*keys, F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _hook_smaller(links: DataFrame, keys: list[str]) -> DataFrame:
    lowest = links.groupBy(*keys, "a").agg(F.min("b").alias("m"))
    joined = links.join(lowest, [*keys, "a"])
    sibling, own = F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b"))
    return joined.select(*keys, F.inline(F.array(sibling, own))).filter("a <> b").distinct()


def number_components(components: DataFrame, keys: list[str]) -> DataFrame:
    """Attach ComponentNo: the position of the component's label within its keys."""
    roots = components.select(*keys, "Root").distinct()
    numbered = row_positions(roots, keys, F.substring("Root", 1, 8), [F.col("Root")], "ComponentNo").drop("ComponentNoTotal")
    return components.join(numbered, [*keys, "Root"])


def connectivity(df: DataFrame, min_n: int = 30, anchor_tolerance: float = 1.0) -> DataFrame:
    """Network evidence per process and group, computed from distinct worker-group links."""
    require_columns(df, ["Worker", GROUP, "Process"], "Connectivity")
    if "Skill" not in df.columns:
        df = df.withColumn("Skill", F.lit(None).cast("double"))
    near = F.col("Skill").between(5 - anchor_tolerance, 5 + anchor_tolerance)
    cells = cut_lineage(
        df.filter("Process IS NOT NULL").groupBy("Process", GROUP, "Worker").agg(
            F.count("*").alias("n"),
            F.count("Skill").alias("skilled"),
            F.min("Skill").alias("lo"),
            F.max("Skill").alias("hi"),
            F.bool_or(or_false(near)).alias("anchor"),
        )
    )
    edges = cells.select("Process", F.concat(F.lit("w:"), "Worker").alias("w"), F.concat(F.lit("g:"), GROUP).alias("g"))
    parts = number_components(connected_components(edges, ["Process"], "w", "g"), ["Process"])
    of_group = parts.filter(F.col("Node").startswith("g:")).select(
        "Process", F.substring("Node", 3, 10_000).alias(GROUP), F.concat_ws(":", "Process", "ComponentNo").alias("ConnectedComponentID")
    )
    linked = cells.join(of_group, ["Process", GROUP])
    whole = linked.groupBy("ConnectedComponentID").agg(
        F.sum("n").alias("ComponentSize"),
        F.count("*").alias("WorkerGroupEdges"),
        F.count_if(F.col("n") > 1).alias("RepeatedLinks"),
        F.min("lo").alias("CertifiedSkillMin"),
        F.max("hi").alias("CertifiedSkillMax"),
        F.bool_or("anchor").alias("AnchorAvailability"),
    )
    breadth = linked.groupBy("ConnectedComponentID").agg(
        F.count_distinct("Worker").alias("ComponentWorkers"), F.count_distinct(GROUP).alias("ComponentGroups")
    )
    groups = linked.groupBy("Process", GROUP, "ConnectedComponentID").agg(
        F.count("*").alias("WorkersPerGroup"),
        F.sum("n").alias("GroupEvidenceN"),
        (F.sum("skilled") / F.sum("n")).alias("SkillCoverage"),
    )
    out = groups.join(whole, "ConnectedComponentID").join(breadth, "ConnectedComponentID")
    weak = (F.col("ComponentSize") < min_n) | ~F.col("AnchorAvailability") | (F.col("WorkersPerGroup") < 2)
    return out.withColumns(
        {
            "GroupsPerWorkerMean": F.col("WorkerGroupEdges") / F.col("ComponentWorkers"),
            "ExtrapolationFlag": ~F.col("AnchorAvailability"),
            "ConnectivityStatus": F.when(weak, "WeakNetwork").otherwise("Pilot Network Evidence"),
        }
    )


def anchored_network(df: DataFrame) -> DataFrame:
    """Variant whose anchors are verified workers who actually produced each group."""
    verified = df.filter("Skill IS NOT NULL").groupBy("Process", GROUP).agg(
        F.count_distinct("Worker").alias("VerifiedAnchorWorkers"),
        F.min("Skill").alias("ActualAnchorSkillMin"),
        F.max("Skill").alias("ActualAnchorSkillMax"),
    )
    base = connectivity(df).drop("AnchorAvailability", "ExtrapolationFlag", "ConnectivityStatus")
    anchors = F.coalesce("VerifiedAnchorWorkers", F.lit(0))
    strong = (
        (F.col("ComponentSize") >= 30)
        & (F.col("WorkersPerGroup") >= 2)
        & (anchors >= 2)
        & (F.col("GroupsPerWorkerMean") >= 2)
    )
    return base.join(verified, ["Process", GROUP], "left").withColumns(
        {
            "VerifiedAnchorWorkers": anchors,
            "AnchorAvailability": anchors > 0,
            "ExtrapolationFlag": anchors == 0,
            "ConnectivityStatus": F.when(strong, "Pilot Network Evidence").otherwise("WeakNetwork"),
        }
    )
