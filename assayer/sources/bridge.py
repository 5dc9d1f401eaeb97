"""Factory-shaped views over the supplied order/line/part/event tables.

Each view is one SELECT that both Spark SQL and an independent SQL engine understand. In
Spark the table names are bound to DataFrames; the checker uses the same text as a CTE.
``EACH(1, 2)`` stands for the generator that repeats a row once per listed value.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events")

_VIEWS: dict[str, str] = {}

# One production row per line: who worked on which item of which order, quantity and hours.
_VIEWS["production"] = """
SELECT concat('WO', l_orderkey) AS WO, CAST(l_linenumber AS BIGINT) AS RoundNo,
       concat('W', l_suppkey) AS Worker, concat('I', l_partkey) AS Item, p_type AS Process,
       concat(p_type, '/', p_brand) AS SizeAdjustedGroup, l_quantity AS Qty,
       l_extendedprice / CAST(1000 AS DOUBLE) AS Hours, l_shipdate AS RafMonth,
       c_mktsegment AS Customer, p_name AS ProductType, p_brand AS Material, o_orderstatus AS OrderStatus,
       o_orderdate AS OrderDate
FROM lineitem JOIN part ON l_partkey = p_partkey
     JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
"""

# Labour hours per order, round and worker, with idle time and the attempt label.
_VIEWS["worker_hours"] = """
SELECT CASE WHEN l_orderkey % 97 = 0 THEN 'OTHER' ELSE concat('WO', l_orderkey) END AS WO,
       CASE WHEN l_orderkey % 41 = 0 THEN CAST(0 AS BIGINT)
            ELSE CAST((l_linenumber - 1) % 3 + 1 AS BIGINT) END AS RoundNo,
       CASE WHEN l_suppkey % 37 = 0 THEN NULL ELSE concat('W', l_suppkey % 40) END AS Worker,
       CASE WHEN l_suppkey % 2 = 0 THEN 'SANDING' ELSE 'POLISH' END AS Department,
       l_extendedprice / CAST(1000 AS DOUBLE) AS Final,
       l_extendedprice / CAST(1000 AS DOUBLE) * CAST(0.75 AS DOUBLE)
         + CASE WHEN l_orderkey % 53 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS Origin,
       l_extendedprice / CAST(1000 AS DOUBLE) * CAST(0.25 AS DOUBLE) AS Idle,
       CASE WHEN (l_linenumber - 1) % 3 = 0 OR l_orderkey % 59 = 0 THEN '1st Attempt'
            ELSE 'Repair WorkOrder' END AS Attempt
FROM lineitem
"""

# One master row per order: status, completion date, item, good pieces, standard runtime.
_VIEWS["work_orders"] = """
SELECT concat('WO', o_orderkey) AS WO,
       CASE o_orderstatus WHEN 'F' THEN 'Complete' WHEN 'O' THEN 'complete ' ELSE 'Started' END AS Status,
       o_orderdate AS MaxRafDate, concat('I', o_orderkey % 200) AS Item,
       CASE WHEN o_orderkey % 43 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(o_orderkey % 19 + 2 AS DOUBLE) END AS GoodPieces,
       CAST(o_orderkey % 7 + 3 AS DOUBLE) AS StandardRuntime,
       CAST(o_orderkey % 19 + 2 AS DOUBLE) * CAST(o_orderkey % 7 + 3 AS DOUBLE) / CAST(60 AS DOUBLE) AS EarnedHours
FROM orders
"""

# Who produced which round of the order's item, with item and process mismatches mixed in.
_VIEWS["assignment"] = """
SELECT concat('WO', l_orderkey) AS WO, CAST((l_linenumber - 1) % 3 + 1 AS BIGINT) AS RoundNo,
       concat('W', l_suppkey % 40) AS Worker,
       CASE WHEN l_partkey % 11 = 0 THEN concat('I', l_partkey) ELSE concat('I', l_orderkey % 200) END AS Item,
       CASE WHEN l_partkey % 13 = 0 THEN 'OTHER' ELSE p_type END AS Process,
       concat(p_type, '/', p_brand) AS SizeAdjustedGroup, l_quantity AS Qty,
       l_extendedprice / CAST(1000 AS DOUBLE) AS Hours, l_shipdate AS RafMonth
FROM lineitem JOIN part ON p_partkey = l_orderkey % 200
"""

# Inspection tickets: up to three rounds per order, pass and fail tickets per round.
_VIEWS["qc_tickets"] = """
SELECT concat('Q', k, '-', r, '-', st) AS TicketId, concat('WO', k) AS WO, concat('I', k % 200) AS Item,
       p_type AS Process, concat(p_type, '/', p_brand) AS SizeAdjustedGroup,
       CAST(r AS BIGINT) AS RoundNo, st AS Status, CAST(q AS DOUBLE) AS Qty,
       CAST(insp + CASE WHEN k % 23 = 0 AND r = 1 THEN 1 ELSE 0 END AS DOUBLE) AS ExpectedQty,
       d + (r - 1) * INTERVAL '1' DAY + INTERVAL '10' HOUR AS QcStart,
       d + (r - 1) * INTERVAL '1' DAY + INTERVAL '10' HOUR
         + CASE WHEN k % 31 = 0 THEN INTERVAL '-10' MINUTE ELSE INTERVAL '10' MINUTE END AS QcStop,
       CASE WHEN k % 3 = 0 THEN NULL ELSE concat('W', k % 40) END AS InitialWorker,
       CASE WHEN k % 5 = 0 THEN CASE WHEN st = 'Pass' THEN 'Đạt' WHEN k % 2 = 0 THEN 'Sửa' ELSE 'hỏng ' END END AS Description
FROM (SELECT k, d, r, insp, CASE WHEN ok = 1 THEN 'Pass' ELSE 'Fail' END AS st, CASE WHEN ok = 1 THEN insp - fail ELSE fail END AS q
      FROM (SELECT k, d, r, insp, fail, EACH(1, 0) AS ok FROM qc_rounds_raw) o) t
     JOIN part ON p_partkey = k % 200
WHERE q > 0
"""

_VIEWS["qc_rounds_raw"] = """
SELECT k, d, r, CASE r WHEN 1 THEN n1 WHEN 2 THEN f1 ELSE f2 END AS insp,
       CASE r WHEN 1 THEN f1 WHEN 2 THEN f2 ELSE CAST(0 AS BIGINT) END AS fail
FROM (SELECT k, d, n1, f1, f2, EACH(1, 2, 3) AS r FROM qc_counts) e
WHERE r = 1 OR (r = 2 AND f1 > 0 AND k % 5 <> 0 AND k % 29 <> 0) OR (r = 3 AND f2 > 0 AND k % 7 <> 0)
"""

_VIEWS["qc_counts"] = """
SELECT k, d, n1, f1, CASE WHEN k % 5 = 0 THEN CAST(0 AS BIGINT)
                          ELSE CAST(floor(f1 * (k % 3) / CAST(3 AS DOUBLE)) AS BIGINT) END AS f2
FROM (SELECT o_orderkey AS k, o_orderdate AS d, CAST(o_orderkey % 16 + 5 AS BIGINT) AS n1,
             CAST((o_orderkey * 7) % (o_orderkey % 16 + 6) AS BIGINT) AS f1 FROM orders) w
"""

# Cumulative snapshots: the same round reported several times with growing totals and gaps.
_VIEWS["qc_snapshots"] = """
SELECT concat('S', k, '-', r, '-', s) AS TicketId, concat('WO', k) AS WO, concat('I', k % 200) AS Item,
       CAST(r AS BIGINT) AS RoundNo, d + (r - 1) * INTERVAL '1' DAY + s * INTERVAL '1' HOUR AS QcStart,
       CASE WHEN s = 2 AND k % 6 = 0 THEN NULL ELSE CAST(insp - fail AS DOUBLE) - (2 - s) END AS RoundPassQty,
       CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(fail AS DOUBLE) END AS RoundReworkQty,
       CASE WHEN k % 8 = 0 THEN CAST(fail AS DOUBLE) WHEN k % 8 = 4 THEN CAST(0 AS DOUBLE) END AS RoundScrapQty,
       CASE WHEN s = 2 AND k % 9 = 0 THEN NULL ELSE CAST(insp AS DOUBLE) - (2 - s) END AS RoundActualQty,
       CAST(insp AS DOUBLE) AS ExpectedQty,
       CASE WHEN s = 1 AND k % 5 <> 0 THEN 'đạt' END AS Description,
       CASE WHEN s = 2 AND k % 3 = 0 THEN NULL ELSE concat('W', k % 40) END AS InitialWorker
FROM (SELECT k, d, r, insp, fail, EACH(1, 2) AS s FROM qc_rounds_raw) t
"""

# Verified skill of each worker on each process they work on (0-10, some unknown).
_VIEWS["skills"] = """
SELECT Worker, Process,
       CASE WHEN (n + length(Process)) % 6 = 0 THEN NULL
            ELSE ((n * 7 + length(Process)) % 101) / CAST(10 AS DOUBLE) END AS Skill,
       CASE WHEN n % 3 = 0 THEN NULL ELSE TIMESTAMP '1997-01-01 00:00:00' + (n % 900) * INTERVAL '1' DAY END AS EffectiveFrom
FROM (SELECT DISTINCT concat('W', l_suppkey % 40) AS Worker, l_suppkey % 40 AS n, p_type AS Process
      FROM lineitem JOIN part ON p_partkey = l_orderkey % 200) s
"""

# Several dated skill snapshots per worker and process.
_VIEWS["skill_history"] = """
SELECT Worker, Process, Skill AS Skill, TIMESTAMP '1995-06-01 00:00:00' AS EffectiveFrom FROM skills WHERE Skill IS NOT NULL
UNION ALL
SELECT Worker, Process, (Skill + 1) / CAST(2 AS DOUBLE) AS Skill, EffectiveFrom FROM skills
WHERE Skill IS NOT NULL AND EffectiveFrom IS NOT NULL
"""

# Worker-group links confined to five residue classes, so five components per process.
_VIEWS["network"] = """
SELECT p_type AS Process, concat('W', l_suppkey) AS Worker, concat(p_type, '/', l_partkey % 25) AS SizeAdjustedGroup,
       concat('WO', l_orderkey) AS WO,
       CASE WHEN (l_suppkey + length(p_type)) % 6 = 0 THEN NULL
            ELSE ((l_suppkey * 7 + length(p_type)) % 101) / CAST(10 AS DOUBLE) END AS Skill
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey % 5 = l_partkey % 5
"""

# Labour intervals around every raw inspection round, with deliberate defects.
_VIEWS["touches"] = """
SELECT concat('T', k, '-', r, CASE WHEN x = 1 THEN '-x' ELSE '' END) AS EventId, concat('WO', k) AS WO,
       concat('W', CASE WHEN r = 1 OR k % 3 = 0 THEN k % 40 ELSE (k + 1) % 40 END) AS Worker,
       CASE WHEN x = 0 AND k % 17 = 0 THEN 'OTHER' ELSE p_type END AS Process,
       d + (r - 1) * INTERVAL '1' DAY + INTERVAL '9' HOUR
         + CASE WHEN x = 1 THEN CASE WHEN k % 2 = 0 THEN 20 ELSE 50 END WHEN k % 19 = 0 THEN 30 ELSE 0 END * INTERVAL '1' MINUTE AS WorkerStart,
       d + (r - 1) * INTERVAL '1' DAY + INTERVAL '9' HOUR
         + CASE WHEN x = 1 THEN 55 WHEN k % 19 = 0 THEN 0 ELSE 50 END * INTERVAL '1' MINUTE AS WorkerStop
FROM (SELECT k, d, r, EACH(0, 1) AS x FROM qc_rounds_raw) e JOIN part ON p_partkey = k % 200
WHERE x = 0 OR k % 13 = 0
"""

# Bill-of-materials lines: a part hierarchy with shared children under one context.
_VIEWS["bom_lines"] = """
SELECT 'F1' AS SourceFile, 'FG0' AS Fg, concat('B', parent) AS Node, concat('P', parent) AS NodeItem,
       concat('P', child) AS Component,
       CASE WHEN child * 2 + 2 <= np THEN concat('B', child) ELSE '' END AS Supply,
       CAST(qty AS DOUBLE) AS Qty, CASE WHEN child % 47 = 0 THEN 'GRAM' ELSE 'PCS' END AS Unit,
       CASE WHEN child * 2 + 2 <= np THEN CASE WHEN child % 9 = 4 THEN 'SM_Casting' ELSE 'SM_FGs' END
            WHEN grp = 0 THEN 'RM_Diamond' WHEN grp = 1 THEN 'RM_Pearl' WHEN grp = 2 THEN 'SM_ACJ'
            WHEN grp = 3 THEN 'RM_Silver' ELSE 'SM_Casting' END AS ItemGroup,
       CASE WHEN child % 53 = 0 THEN NULL ELSE price / CAST(1000 AS DOUBLE) * qty END AS Weight,
       price / CAST(100 AS DOUBLE) * qty * (1 + extra) AS Quantity,
       CASE WHEN child % 3 = 0 THEN 'GRAM' ELSE 'PCS' END AS QuantityUnit,
       CASE WHEN child % 101 = 7 THEN CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS CwSize,
       CAST(child AS DOUBLE) AS Sequence
FROM bom_edges WHERE parent >= 7
"""

_VIEWS["bom_edges"] = """
SELECT CAST(floor((p_partkey - 1) / CAST(2 AS DOUBLE)) AS BIGINT) + extra AS parent, p_partkey AS child,
       CASE WHEN extra = 1 THEN 1 ELSE p_partkey % 3 + 1 END AS qty, p_partkey % 5 AS grp, p_retailprice AS price, np, extra
FROM (SELECT p_partkey, p_retailprice, EACH(0, 1) AS extra, (SELECT max(p_partkey) FROM part) AS np FROM part) e
WHERE p_partkey >= 1 AND (extra = 0 OR (p_partkey >= 10 AND p_partkey % 10 = 0))
"""

# One row per finished-good context of a semi-finished item.
_VIEWS["semis"] = """
SELECT concat('S', p_partkey) AS SemiBom, concat(CASE p_partkey % 9 WHEN 0 THEN '2GC' WHEN 1 THEN '2DC' WHEN 2 THEN '3AA'
       ELSE '2SN' END, p_partkey, CASE WHEN p_partkey % 14 = 0 THEN '-01' ELSE '' END) AS SemiItem,
       concat('I', p_partkey) AS Item, p_type AS Process, p_brand AS Material,
       CASE p_partkey % 4 WHEN 0 THEN ' Neck' WHEN 1 THEN 'Necklace' WHEN 2 THEN 'Ring' ELSE 'Bracelet' END AS ProductType,
       concat(p_type, '/', p_brand) AS SizeAdjustedGroup, p_partkey AS n, p_size AS size, p_name AS name
FROM part
"""

# Stone names rebuilt from part names so that both engines print the same text.
_VIEWS["stones"] = """
SELECT concat('K', p_partkey) AS StoneSku,
       CASE p_partkey % 5 WHEN 0 THEN 'Diamond' WHEN 1 THEN 'Synthetic stone' WHEN 2 THEN 'Pearl'
            WHEN 3 THEN 'Natural stone' ELSE 'Old stone (unspecified)' END AS StoneType,
       CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_size / CAST(400 AS DOUBLE) END AS UnitWeightGram,
       concat(p_name, ' ', CASE p_partkey % 12 WHEN 0 THEN 'brilliant round' WHEN 1 THEN 'Pearl half drill 1.5x2 mm'
         WHEN 2 THEN 'emerald cut' WHEN 3 THEN 'cab oval' WHEN 4 THEN 'baroque pearl no drill' WHEN 5 THEN 'maquire facet'
         WHEN 6 THEN 'rd step cut' WHEN 7 THEN 'square rose cut' WHEN 8 THEN 'heart' WHEN 9 THEN 'pearl near round (top drill) 1x2mm'
         WHEN 10 THEN 'octagon brill cab' ELSE 'plain' END, ' ',
         CASE p_partkey % 8 WHEN 0 THEN concat(p_size, ' x ', p_partkey % 7 + 1, ' mm') WHEN 1 THEN concat(p_size, '-', p_size + 2, 'mm')
         WHEN 2 THEN concat(p_size, ' X ', p_partkey % 7 + 1) WHEN 3 THEN concat(p_size, 'mm h=', p_size + 5, 'mm')
         WHEN 4 THEN concat(p_size, ',5*', p_partkey % 7 + 1, ' mm') WHEN 5 THEN concat(p_size, ' x ')
         WHEN 6 THEN concat(p_size, '-') ELSE '' END) AS ProductName
FROM part
"""

# Stones set into each order's item: one line per stone and finished-good context.
_VIEWS["stone_paths"] = """
SELECT concat('S', l_orderkey % 500) AS SemiBom, concat('FG', l_suppkey % 3) AS Fg, concat('K', l_partkey) AS StoneSku,
       CAST(l_linenumber AS DOUBLE) AS EffectiveCount
FROM lineitem
"""


def _closure(name: str) -> list[str]:
    """View names needed by ``name`` in dependency order."""
    order: list[str] = []

    def visit(view: str) -> None:
        for other in _VIEWS:
            if other != view and re.search(rf"\b(FROM|JOIN)\s+{other}\b", _VIEWS[view]):
                visit(other)
        if view not in order:
            order.append(view)

    visit(name)
    return order


def with_clause(*names: str) -> str:
    """CTE prefix that defines the named views (and what they read) for a SQL checker."""
    order: list[str] = []
    for name in names:
        order += [view for view in _closure(name) if view not in order]
    return "WITH " + ",\n".join(f"{view} AS ({_each(_VIEWS[view].strip(), 'unnest([{}])')})" for view in order)


def _each(sql: str, generator: str) -> str:
    return re.sub(r"EACH\(([^)]*)\)", lambda m: generator.format(m.group(1)), sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Joins of part that reach only the keys of a remainder.
_REMAINDER = re.compile(r"\bJOIN\s+part\s+ON\s+p_partkey\s*=\s*(\w+)\s*%\s*(\d+)")
FEW_ROWS = 100_000


def _reached(part: DataFrame, divisor: int) -> DataFrame:
    """The parts a remainder can name; counted, they are offered as a broadcast, so that no row moves to one of few keys."""
    few = part.filter(F.col("p_partkey").between(1 - divisor, divisor - 1))
    return F.broadcast(few) if few.count() <= FEW_ROWS else few


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named bridge view as a lazy DataFrame."""
    sql = re.sub(r"unnest\(\[([^\]]*)\]\)", r"explode(array(\1))", with_clause(name)) + f"\nSELECT * FROM {name}"
    divisors = {int(d) for _key, d in _REMAINDER.findall(sql)}
    sql = _REMAINDER.sub(r"JOIN {part_\2} ON p_partkey = \1 % \2", sql)
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN)\s+{t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN)(\s+){t}\b", rf"\1\2{{{t}}}", sql)
    few = {f"part_{d}": _reached(table(spark, sf_dir, "part"), d) for d in divisors}
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used}, **few)
