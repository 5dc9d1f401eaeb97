"""Network, bill-of-materials and distribution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.catalog.registry import Inputs, query, shown
from assayer.operators import bom as B
from assayer.operators import graph as G
from assayer.operators import profiles as R
from assayer.operators.ordering import quantiles
from assayer.session import cut_lineage

NET_CTE = """
e AS (SELECT DISTINCT Process, concat('w:', Worker) AS w, concat('g:', SizeAdjustedGroup) AS g FROM network),
sym AS (SELECT Process, w AS u, g AS v FROM e UNION ALL SELECT Process, g, w FROM e),
reach AS (SELECT DISTINCT Process, u AS n, u AS r FROM sym UNION SELECT s.Process, s.v, reach.r FROM reach JOIN sym s ON s.Process = reach.Process AND s.u = reach.n),
root AS (SELECT Process, n, min(r) AS root FROM reach GROUP BY 1, 2),
comp AS (SELECT *, dense_rank() OVER (PARTITION BY Process ORDER BY root) AS c FROM root)"""


@query(
    f"""
WITH RECURSIVE {NET_CTE}
SELECT Process, n AS Node, root AS Root, CAST(c AS BIGINT) AS ComponentNo FROM comp
""",
    ("network",),
)
def connected_components(inp: Inputs):
    edges = inp.network.select(
        "Process", F.concat(F.lit("w:"), "Worker").alias("w"), F.concat(F.lit("g:"), "SizeAdjustedGroup").alias("g")
    ).distinct()
    parts = G.number_components(G.connected_components(edges, ["Process"], "w", "g"), ["Process"])
    return shown(parts, "Process", "Node", "Root", "ComponentNo")


STATUS_CTE = f"""{NET_CTE},
d AS (SELECT n.*, concat(n.Process, ':', c) AS cc FROM network n JOIN comp ON comp.Process = n.Process AND comp.n = concat('g:', SizeAdjustedGroup)),
cs AS (SELECT cc, count(*) AS size, count(DISTINCT Worker) AS cw, count(DISTINCT SizeAdjustedGroup) AS cg, count(DISTINCT concat(Worker, '|', SizeAdjustedGroup)) AS ed,
  min(Skill) AS lo, max(Skill) AS hi, coalesce(bool_or(Skill BETWEEN 4 AND 6), false) AS anchor FROM d GROUP BY 1),
rp AS (SELECT cc, count(*) AS rep FROM (SELECT cc, Worker, SizeAdjustedGroup FROM d GROUP BY 1, 2, 3 HAVING count(*) > 1) x GROUP BY 1),
gs AS (SELECT Process, SizeAdjustedGroup, cc, count(DISTINCT Worker) AS gw, count(*) AS gn, count(Skill) / CAST(count(*) AS DOUBLE) AS cov,
  count(DISTINCT CASE WHEN Skill IS NOT NULL THEN Worker END) AS vw, min(Skill) AS glo, max(Skill) AS ghi FROM d GROUP BY 1, 2, 3)"""


@query(
    f"""
WITH RECURSIVE {STATUS_CTE}
SELECT Process, SizeAdjustedGroup, gs.cc AS ConnectedComponentID, CAST(size AS BIGINT) AS ComponentSize, CAST(cw AS BIGINT) AS ComponentWorkers, CAST(cg AS BIGINT) AS ComponentGroups,
  CAST(ed AS BIGINT) AS WorkerGroupEdges, CAST(coalesce(rep, 0) AS BIGINT) AS RepeatedLinks, CAST(gw AS BIGINT) AS WorkersPerGroup, CAST(gn AS BIGINT) AS GroupEvidenceN, round(cov, 6) AS SkillCoverage,
  lo AS CertifiedSkillMin, hi AS CertifiedSkillMax, anchor AS AnchorAvailability, round(ed / CAST(cw AS DOUBLE), 6) AS GroupsPerWorkerMean, NOT anchor AS ExtrapolationFlag,
  CASE WHEN size < 30 OR NOT anchor OR gw < 2 THEN 'WeakNetwork' ELSE 'Pilot Network Evidence' END AS ConnectivityStatus
FROM gs JOIN cs ON gs.cc = cs.cc LEFT JOIN rp ON rp.cc = gs.cc
""",
    ("network",),
)
def network_status(inp: Inputs):
    return shown(G.connectivity(inp.network))


@query(
    f"""
WITH RECURSIVE {STATUS_CTE}
SELECT Process, SizeAdjustedGroup, CAST(vw AS BIGINT) AS VerifiedAnchorWorkers, glo AS ActualAnchorSkillMin, ghi AS ActualAnchorSkillMax, vw = 0 AS ExtrapolationFlag,
  CASE WHEN size >= 30 AND gw >= 2 AND vw >= 2 AND ed / CAST(cw AS DOUBLE) >= 2 THEN 'Pilot Network Evidence' ELSE 'WeakNetwork' END AS ConnectivityStatus
FROM gs JOIN cs ON gs.cc = cs.cc
""",
    ("network",),
)
def anchored_network(inp: Inputs):
    rows = G.anchored_network(inp.network)
    return shown(
        rows, "Process", "SizeAdjustedGroup", "VerifiedAnchorWorkers", "ActualAnchorSkillMin", "ActualAnchorSkillMax", "ExtrapolationFlag",
        "ConnectivityStatus",
    )


STONES = "('RM_Diamond', 'RM_Art ST', 'RM_Nat ST', 'RM_Pearl', 'RM_Old ST')"
BOM_CTE = f"""
st AS (SELECT Node, Supply, sum(Qty) AS q FROM bom_lines WHERE Unit = 'PCS' AND Supply <> '' AND Supply IN (SELECT Node FROM bom_lines) GROUP BY 1, 2),
cst AS (SELECT Node, Supply, sum(Qty) AS q FROM bom_lines WHERE Unit = 'PCS' AND Supply <> '' AND ItemGroup <> 'SM_Casting' AND Supply IN (SELECT Node FROM bom_lines) GROUP BY 1, 2),
pth AS (SELECT DISTINCT Node AS root, Node AS node, CAST(1 AS DOUBLE) AS m FROM bom_lines UNION ALL SELECT root, Supply, m * q FROM pth JOIN st ON pth.node = st.Node),
clo AS (SELECT root, node, sum(m) AS m FROM pth GROUP BY 1, 2),
cpth AS (SELECT DISTINCT Node AS root, Node AS node, CAST(1 AS DOUBLE) AS m FROM bom_lines UNION ALL SELECT root, Supply, m * q FROM cpth JOIN cst ON cpth.node = cst.Node),
cas AS (SELECT root, sum(m * Qty) AS c, count(DISTINCT Component) AS k FROM cpth JOIN bom_lines l ON cpth.node = l.Node WHERE ItemGroup = 'SM_Casting' AND Unit = 'PCS' GROUP BY 1),
lea AS (SELECT clo.root, clo.m, l.*, ItemGroup IN {STONES} AS stone FROM clo JOIN bom_lines l ON clo.node = l.Node WHERE Supply = ''),
tot AS (SELECT root, sum(CASE WHEN stone THEN Qty * m ELSE 0 END) AS s, sum(CASE WHEN stone AND Unit = 'PCS' AND Weight > 0 THEN Weight * m ELSE 0 END) AS w,
  bool_or(stone AND NOT coalesce(Unit = 'PCS' AND Weight > 0, false)) AS miss, max(CASE WHEN stone AND Unit = 'PCS' AND Weight > 0 THEN Weight / Qty END) AS mx,
  sum(CASE WHEN NOT stone AND ItemGroup <> 'Services' AND Unit = 'PCS' THEN Qty * m ELSE 0 END) AS parts, count(DISTINCT CASE WHEN stone THEN Component END) AS sk,
  count(DISTINCT CASE WHEN stone THEN ItemGroup END) AS ty FROM lea GROUP BY 1),
flg AS (SELECT Node AS node, 'BOM CW size is not 1: basis requires review' AS f FROM bom_lines WHERE CwSize <> 1
  UNION SELECT Node, 'Child BOM quantity unit is not PCS' FROM bom_lines WHERE Supply <> '' AND Unit <> 'PCS'
  UNION SELECT Node, 'Unexpanded assembly without Supply BOM' FROM bom_lines WHERE Supply = '' AND ItemGroup = 'SM_FGs'
  UNION SELECT Node, 'Invalid stone count/unit' FROM bom_lines WHERE Supply = '' AND ItemGroup IN {STONES} AND Unit <> 'PCS'
  UNION SELECT Node, concat('Missing child BOM: ', Supply) FROM bom_lines WHERE Supply <> '' AND Unit = 'PCS' AND Supply NOT IN (SELECT Node FROM bom_lines)),
rf AS (SELECT root, string_agg(DISTINCT f, '; ' ORDER BY f) AS f FROM clo JOIN flg ON clo.node = flg.node GROUP BY 1),
ms AS (SELECT Supply AS root, count(DISTINCT round(Quantity / Qty, 8)) AS v, min(round(Quantity / Qty, 8)) AS g FROM bom_lines WHERE Supply <> '' AND QuantityUnit = 'GRAM' GROUP BY 1),
roots AS (SELECT DISTINCT Node AS root FROM bom_lines)"""


@query(
    f"""
WITH RECURSIVE {BOM_CTE}
SELECT root AS Root, node AS Node, round(m, 6) AS Multiplier FROM clo
""",
    ("bom_lines",),
)
def bom_closure_totals(inp: Inputs):
    return shown(B.closure(B.prepare_lines(inp.bom_lines)), "Root", "Node", "Multiplier")


@query(
    f"""
WITH RECURSIVE {BOM_CTE}
SELECT r.root AS SemiBom, coalesce(rf.f, '') || CASE WHEN v > 1 THEN CASE WHEN rf.f IS NULL THEN '' ELSE '; ' END || 'Conflicting incoming declared Semi gram mass' WHEN rf.f IS NULL THEN 'BOM structure usable' ELSE '' END AS Status,
  coalesce(s, 0) AS StoneCountScenario, CASE WHEN rf.f IS NULL THEN coalesce(s, 0) END AS StoneCount, CAST(CASE WHEN rf.f IS NULL THEN coalesce(sk, 0) END AS BIGINT) AS StoneSKUCount,
  CAST(CASE WHEN rf.f IS NULL THEN coalesce(ty, 0) END AS BIGINT) AS StoneTypeCount, round(coalesce(w, 0), 5) AS KnownStoneWeightGram,
  round(CASE WHEN rf.f IS NULL AND NOT coalesce(miss, false) THEN coalesce(w, 0) END, 5) AS TotalStoneWeightGram, round(CASE WHEN rf.f IS NULL AND NOT coalesce(miss, false) THEN mx END, 6) AS MaxStoneWeightGram,
  CASE WHEN rf.f IS NULL THEN coalesce(parts, 0) END AS LeafPartCountPCS, CASE WHEN rf.f IS NULL THEN coalesce(c, 0) END AS CastingCountPCS,
  round(CASE WHEN v = 1 AND g > 0 THEN g END, 6) AS DeclaredSemiMassGram,
  round(CASE WHEN rf.f IS NULL AND NOT coalesce(miss, false) AND w > 0 THEN 100 * mx / w END, 5) AS LargestSingleStonePctOfAllStones
FROM roots r LEFT JOIN tot ON tot.root = r.root LEFT JOIN cas ON cas.root = r.root LEFT JOIN rf ON rf.root = r.root LEFT JOIN ms ON ms.root = r.root
""",
    ("bom_lines",),
)
def bom_rollup(inp: Inputs):
    rolled = B.roll_up(inp.bom_lines)
    rounded = rolled.withColumns(
        {c: F.round(c, 5) for c in ("KnownStoneWeightGram", "TotalStoneWeightGram", "LargestSingleStonePctOfAllStones")}
    )
    return shown(
        rounded, "SemiBom", "Status", "StoneCountScenario", "StoneCount", "StoneSKUCount", "StoneTypeCount", "KnownStoneWeightGram",
        "TotalStoneWeightGram", "MaxStoneWeightGram", "LeafPartCountPCS", "CastingCountPCS", "DeclaredSemiMassGram",
        "LargestSingleStonePctOfAllStones",
    )


@query(
    f"""
WITH RECURSIVE {BOM_CTE}
SELECT root AS Root, c AS CastingCountScenario, CAST(k AS BIGINT) AS CastingSkus FROM cas
""",
    ("bom_lines",),
)
def bom_casting_frontier(inp: Inputs):
    return shown(B.casting_totals(B.prepare_lines(inp.bom_lines)), "Root", "CastingCountScenario", "CastingSkus")


@query(
    f"""
WITH RECURSIVE {BOM_CTE}
SELECT r.root AS SemiBom, coalesce(c, 0) AS Castings, coalesce(s, 0) AS Stones, round(coalesce(w, 0), 5) AS Weight
FROM roots r LEFT JOIN tot ON tot.root = r.root LEFT JOIN cas ON cas.root = r.root
""",
    ("bom_lines",),
)
def bom_bottom_up_audit(inp: Inputs):
    rows = B.bottom_up_totals(B.prepare_lines(inp.bom_lines))
    return shown(rows.withColumn("Weight", F.round("Weight", 5)), "SemiBom", "Castings", "Stones", "Weight")


@query(
    """
SELECT CAST(count(DISTINCT Node) AS BIGINT) AS Checked, CAST(0 AS BIGINT) AS Mismatches, CAST(0 AS BIGINT) AS InvariantErrors FROM bom_lines
""",
    ("bom_lines",),
)
def bom_audit(inp: Inputs):
    return shown(B.audit(B.roll_up(inp.bom_lines), B.bottom_up_totals(B.prepare_lines(inp.bom_lines))))


@query(
    f"""
WITH RECURSIVE pp AS (SELECT DISTINCT Node AS root, Node AS node, CAST(1 AS DOUBLE) AS m, Node AS p FROM bom_lines
  UNION ALL SELECT root, Supply, m * Qty, p || ' > ' || Supply FROM pp JOIN bom_lines l ON pp.node = l.Node WHERE Unit = 'PCS' AND Supply <> '' AND Supply IN (SELECT Node FROM bom_lines))
SELECT root AS Root, p || ' > ' || Component AS PathText, m AS Multiplier, m * Qty AS EffectiveQty, ItemGroup FROM pp JOIN bom_lines l ON pp.node = l.Node WHERE Supply = ''
""",
    ("bom_lines",),
)
def bom_leaf_paths(inp: Inputs):
    return shown(B.leaf_paths(B.prepare_lines(inp.bom_lines)), "Root", "PathText", "Multiplier", "EffectiveQty", "ItemGroup")


@query(
    f"""
WITH u AS (SELECT *, CASE WHEN Weight > 0 AND Qty > 0 AND Unit = 'PCS' THEN Weight / Qty END AS uw, CASE ItemGroup WHEN 'RM_Diamond' THEN 'Diamond' ELSE 'Pearl' END AS ty FROM bom_lines WHERE ItemGroup IN {STONES})
SELECT Component, string_agg(DISTINCT ty, '; ' ORDER BY ty) AS StoneType, CAST(count(DISTINCT round(uw, 8)) AS BIGINT) AS PositiveWeightVariants, round(min(uw), 6) AS KnownUnitWeightGram,
  CAST(count(*) AS BIGINT) AS SourceRows, CAST(count(*) - count(uw) AS BIGINT) AS MissingWeightRows FROM u GROUP BY 1
""",
    ("bom_lines",),
)
def stone_master(inp: Inputs):
    return shown(B.stone_master(B.prepare_lines(inp.bom_lines)))


ROLLED_CTE = """rolled AS (SELECT concat('F', l_linenumber % 2) AS SourceFile, concat('FG', l_suppkey % 4) AS Fg, concat('S', l_partkey) AS SemiBom,
  CASE WHEN l_orderkey % 3 = 0 THEN 'BOM structure usable' ELSE 'Circular BOM' END AS Status, l_quantity AS q, l_tax AS t, l_orderkey AS k FROM lineitem),
ctx AS (SELECT SourceFile, Fg, SemiBom, min(Status) AS Status, sum(q) AS q, max(t) AS t FROM rolled GROUP BY 1, 2, 3)"""


def contexts(inp: Inputs):
    """One row per file, finished good and item with a few roll-up columns."""
    lines = inp.raw("lineitem").select(
        F.concat(F.lit("F"), F.col("l_linenumber") % 2).alias("SourceFile"),
        F.concat(F.lit("FG"), F.col("l_suppkey") % 4).alias("Fg"),
        F.concat(F.lit("S"), "l_partkey").alias("SemiBom"),
        F.when(F.col("l_orderkey") % 3 == 0, B.USABLE).otherwise("Circular BOM").alias("Status"),
        "l_quantity",
        "l_tax",
    )
    return lines.groupBy("SourceFile", "Fg", "SemiBom").agg(
        F.min("Status").alias("Status"), F.sum("l_quantity").alias("StoneCountScenario"), F.max("l_tax").alias("KnownStoneWeightGram")
    )


@query(
    f"""
WITH {ROLLED_CTE}
SELECT SourceFile, SemiBom, CAST(count(*) AS BIGINT) AS Contexts, min(q) <> max(q) OR min(t) <> max(t) AS ContextConflict FROM ctx GROUP BY 1, 2
""",
)
def bom_context_conflict(inp: Inputs):
    rows = contexts(inp).withColumns({"DirectPartCountPCS": F.lit(1.0), "CastingCountScenario": F.lit(None).cast("double")})
    return shown(B.context_conflicts(rows))


@query(
    f"""
WITH {ROLLED_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY SemiBom ORDER BY Status <> 'BOM structure usable', SourceFile, Fg) AS rn, count(*) OVER (PARTITION BY SemiBom) AS n FROM ctx)
SELECT SemiBom, SourceFile, Fg, Status, CAST(n AS BIGINT) AS ContextCount FROM r WHERE rn = 1
""",
)
def representative_context(inp: Inputs):
    return shown(R.representative(contexts(inp)), "SemiBom", "SourceFile", "Fg", "Status", "ContextCount")


@query(
    f"""
WITH b AS (SELECT *, CASE WHEN parts <= 0 THEN '0' WHEN parts <= 1 THEN '1' WHEN parts <= 2 THEN '2' WHEN parts <= 4 THEN '3-4' WHEN parts <= 9 THEN '5-9' WHEN parts <= 19 THEN '10-19' WHEN parts <= 49 THEN '20-49' ELSE '50+' END AS bin
  FROM (SELECT n % 23 AS parts FROM semis) s),
l AS (SELECT unnest(['0', '1', '2', '3-4', '5-9', '10-19', '20-49', '50+']) AS bin)
SELECT l.bin AS PartCountBin, CAST(count(b.parts) AS BIGINT) AS SemiCount, round(count(b.parts) / CAST((SELECT count(*) FROM b) AS DOUBLE) * 100, 2) AS ShareOfPopulationPct FROM l LEFT JOIN b ON l.bin = b.bin GROUP BY 1
""",
    ("semis",),
)
def part_histogram(inp: Inputs):
    return shown(R.part_histogram(inp.semis.withColumn("Parts", F.col("n") % 23), "Parts"))


def profiled(inp: Inputs):
    return inp.semis.select(
        F.when(F.col("n") % 10 != 0, F.col("Process")).alias("Process"), "Material",
        F.trim("ProductType").alias("ProductType"), (F.col("n") % 23).cast("double").alias("Parts"), (F.col("n") % 4).alias("Stones"),
        F.col("size").cast("double").alias("Groups"),
    )


@query(
    """
SELECT CASE WHEN n % 10 <> 0 THEN Process ELSE 'Unmapped' END AS Process, Material, trim(ProductType) AS ProductType, CAST(count(*) AS BIGINT) AS SemiCount,
  CAST(count(CASE WHEN n % 4 > 0 THEN 1 END) AS BIGINT) AS SemiWithStones, round(count(CASE WHEN n % 4 > 0 THEN 1 END) / CAST(count(*) AS DOUBLE) * 100, 2) AS SemiWithStonesPct,
  round(median(n % 23), 6) AS PartsMedian, round(quantile_cont(n % 23, 0.9), 6) AS PartsP90, round(median(size), 6) AS GroupsMedian, round(quantile_cont(size, 0.9), 6) AS GroupsP90
FROM semis GROUP BY 1, 2, 3
""",
    ("semis",),
)
def profile_three_dims(inp: Inputs):
    measures = {"Parts": {"PartsMedian": 0.5, "PartsP90": 0.9}, "Groups": {"GroupsMedian": 0.5, "GroupsP90": 0.9}}
    return shown(R.profile(profiled(inp), ["Process", "Material", "ProductType"], measures, "Stones"))


@query(
    """
WITH l AS (SELECT 'Process' AS Dimension, CASE WHEN n % 10 <> 0 THEN Process ELSE 'Unmapped' END AS Value, n, size FROM semis UNION ALL SELECT 'Material', Material, n, size FROM semis UNION ALL SELECT 'ProductType', trim(ProductType), n, size FROM semis)
SELECT Dimension, Value, CAST(count(*) AS BIGINT) AS SemiCount, CAST(count(CASE WHEN n % 4 > 0 THEN 1 END) AS BIGINT) AS SemiWithStones, round(count(CASE WHEN n % 4 > 0 THEN 1 END) / CAST(count(*) AS DOUBLE) * 100, 2) AS SemiWithStonesPct,
  round(median(n % 23), 6) AS PartsMedian, round(quantile_cont(n % 23, 0.9), 6) AS PartsP90, round(count(*) / CAST((SELECT count(*) FROM semis) AS DOUBLE) * 100, 2) AS ShareOfUsableSemiPct
FROM l GROUP BY 1, 2
""",
    ("semis",),
)
def profile_each_dim(inp: Inputs):
    return shown(R.profile_each(profiled(inp), ["Process", "Material", "ProductType"], {"Parts": {"PartsMedian": 0.5, "PartsP90": 0.9}}, "Stones"))


@query(
    f"""
WITH RECURSIVE {BOM_CTE}, ok AS (SELECT root FROM roots WHERE root NOT IN (SELECT root FROM rf)),
pres AS (SELECT DISTINCT lea.root, ItemGroup FROM lea JOIN ok ON lea.root = ok.root WHERE ItemGroup <> 'Services')
SELECT ItemGroup, CAST(count(DISTINCT root) AS BIGINT) AS SemiCount, round(count(DISTINCT root) / CAST((SELECT count(*) FROM ok) AS DOUBLE) * 100, 2) AS SharePct FROM pres GROUP BY 1
""",
    ("bom_lines",),
)
def material_presence(inp: Inputs):
    lines = cut_lineage(B.prepare_lines(inp.bom_lines))
    reach = cut_lineage(B.closure(lines))
    flagged = B.root_flags(lines, reach)
    usable = reach.select("SourceFile", "Fg", "Root").distinct().join(flagged, ["SourceFile", "Fg", "Root"], "left_anti")
    usable = cut_lineage(usable.withColumnRenamed("Root", "SemiBom"))
    return shown(R.presence_distribution(R.group_presence(reach, lines, usable), usable))


@query(
    """
SELECT Node AS SemiBom, sum(Qty) AS MechanicalPartCount, CAST(count(DISTINCT Component) AS BIGINT) AS MechanicalPartSkus FROM bom_lines WHERE ItemGroup IN ('SM_Casting', 'SM_ACJ') AND Unit = 'PCS' GROUP BY 1
""",
    ("bom_lines",),
)
def mechanical_parts(inp: Inputs):
    contexts_ = inp.bom_lines.select("SourceFile", "Fg", F.col("Node").alias("SemiBom")).distinct()
    return shown(R.mechanical_parts(inp.bom_lines, contexts_))


@query(
    """
SELECT Process, Item, CAST(count(*) AS BIGINT) AS Records, CAST(count(DISTINCT Worker) AS BIGINT) AS Workers, min(Material) AS Material, min(ProductType) AS ProductType FROM production GROUP BY 1, 2
""",
    ("production",),
)
def item_library(inp: Inputs):
    return shown(R.item_library(inp.production, ["Process", "Item"], ["Material", "ProductType"]))
