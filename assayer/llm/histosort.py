"""Sharding by histogram sort: probe key boundaries, count exact bytes below them, refine, then exchange once."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import settle

ROW_OVERHEAD = 16
# Probes put into the open interval of each splitter in every round.
PROBES = 8
# Share of a range's bytes by which a splitter may miss its target before it is refined further.
TOLERANCE = 0.001
# A splitter moves to the edge of its group of equal texts where that costs at most this share of a shard.
EDGE_SLACK = 0.005
# Rows of one sorted range; a shard of more rows is made of several ranges.
RANGE_ROWS = 4_000_000

_LOW = -(1 << 63)
_CELL = "cell int, bytes long, n long, low_h long, low_g long, high_h long, high_g long"


def _key(h: int, g: int) -> int:
    return ((h - _LOW) << 64) | (g - _LOW)


def _parts(key: int) -> tuple[int, int]:
    return (key >> 64) + _LOW, (key & ((1 << 64) - 1)) + _LOW


def _below(h: np.ndarray, g: np.ndarray, probes: list[tuple[int, int]]) -> np.ndarray:
    """How many of the rows sorted by (h, g) lie below each probe."""
    ph = np.array([p[0] for p in probes], dtype=np.int64)
    left, right = np.searchsorted(h, ph, "left"), np.searchsorted(h, ph, "right")
    for k in np.flatnonzero(left < right):
        left[k] += np.searchsorted(g[left[k] : right[k]], probes[k][1], "left")
    return left


def _histogram(probes: list[tuple[int, int]]):
    """Bytes, rows and extreme keys of every cell between neighbouring probes, for one partition."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)] for batch in batches]
        if not parts or not sum(len(p[0]) for p in parts):
            return
        h, g, size = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((g, h))
        h, g, size = h[order], g[order], size[order]
        edges = np.concatenate([[0], _below(h, g, probes), [len(h)]])
        total = np.concatenate([[0], np.cumsum(size)])
        cells = np.flatnonzero(edges[1:] > edges[:-1])
        first, last = edges[cells], edges[cells + 1] - 1
        values = [cells.astype(np.int32), total[last + 1] - total[first], last + 1 - first, h[first], g[first], h[last], g[last]]
        names = ["cell", "bytes", "n", "low_h", "low_g", "high_h", "high_g"]
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if n == "cell" else pa.int64()) for n, v in zip(names, values)], names=names)

    return count


def _cells(keyed: DataFrame, probes: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """Exact (bytes, rows, lowest key, highest key) of each cell; at most len(probes) + 1 rows reach the driver."""
    merged = (
        keyed.select("h", "g", "size")
        .mapInArrow(_histogram([_parts(p) for p in probes]), _CELL)
        .groupBy("cell")
        .agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min(F.struct("low_h", "low_g")).alias("low"), F.max(F.struct("high_h", "high_g")).alias("high"))
    )
    return {r["cell"]: (r["bytes"], r["n"], _key(*r["low"]), _key(*r["high"])) for r in merged.collect()}


@dataclass
class Known:
    """Keys whose exact totals below are known, in order, and the extreme rows between neighbours."""

    keys: list[int]
    bytes: list[int]
    rows: list[int]
    between: list[tuple[int, int]]

    def refine(self, keyed: DataFrame, probes: list[int]) -> None:
        cells = _cells(keyed, probes)
        bytes_, rows, between = [0], [0], []
        for k in range(len(probes) + 1):
            size, n, low, high = cells.get(k, (0, 0, 0, 0))
            bytes_.append(bytes_[-1] + size)
            rows.append(rows[-1] + n)
            between.append((low, high))
        self.keys, self.bytes, self.rows, self.between = [0, *probes, 1 << 128], bytes_, rows, between


def splitters(keyed: DataFrame, ranges: int, tolerance: float = TOLERANCE, edge_slack: float = EDGE_SLACK) -> tuple[list[int], list[int], int]:
    """Keys that cut (h, g, size) rows into ``ranges`` ranges of near equal bytes, the rows below each, and all rows.

    Every round is one pass that counts exact bytes below all probes. A splitter is settled when a known key lies
    within tolerance of its target, or when no row is left between the two known keys around it.
    """
    known = Known([0, 1 << 128], [0, 0], [0, 0], [(0, 0)])
    known.refine(keyed, [])
    total, n_rows = known.bytes[-1], known.rows[-1]
    targets = [total * k // ranges for k in range(1, ranges)]
    slack = total / ranges * tolerance
    chosen: dict[int, int] = {}
    while True:
        probes: set[int] = set()
        for target in targets:
            if target in chosen:
                continue
            at = max(1, bisect_left(known.bytes, target))
            near = min((at - 1, at), key=lambda k: abs(known.bytes[k] - target))
            low, high = known.between[at - 1]
            if abs(known.bytes[near] - target) <= slack or known.rows[at] - known.rows[at - 1] <= 1:
                chosen[target] = known.keys[near]
                continue
            # Rows exist from low to high; probing above low always parts them.
            step = max(1, (high - low) // (PROBES + 1))
            probes |= {low + step * k for k in range(1, PROBES + 1) if low < low + step * k <= high} | {low + 1, high}
        if not probes:
            break
        known.refine(keyed, sorted(probes | set(known.keys[1:-1]) & _needed(known, targets, chosen) | set(chosen.values()) - {0, 1 << 128}))
    keys = sorted(chosen[t] for t in targets)
    groups = sorted({k for key in keys for k in (_key(_parts(key)[0], _LOW), _key(_parts(key)[0], _LOW) + (1 << 64)) if 0 < k < 1 << 128} | {k for k in keys if 0 < k < 1 << 128})
    known.refine(keyed, groups)
    at = {k: (b, r) for k, b, r in zip(known.keys, known.bytes, known.rows)}
    final = []
    for target in sorted(targets):
        key = chosen[target]
        edge = _key(_parts(key)[0], _LOW) if key < 1 << 128 else key
        options = [k for k in (edge, edge + (1 << 64)) if k in at]
        best = min(options, key=lambda k: abs(at[k][0] - target), default=key)
        final.append(best if best in at and abs(at[best][0] - target) <= total / ranges * edge_slack else key)
    return final, [at[k][1] for k in final], n_rows


def _needed(known: Known, targets: list[int], chosen: dict[int, int]) -> set[int]:
    """Known keys around the targets that are still open."""
    out: set[int] = set()
    for target in targets:
        if target not in chosen:
            at = max(1, bisect_left(known.bytes, target))
            out |= {known.keys[at - 1], known.keys[at]}
    return out


def _assign(keys: list[tuple[int, int]]):
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, g = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("h", "g"))
            order = np.lexsort((g, h))
            edges = _below(h[order], g[order], keys)
            cell = np.empty(len(h), dtype=np.int32)
            cell[order] = np.searchsorted(edges, np.arange(len(h)), "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=[*batch.schema.names, "cell"])

    return put


def shard(docs: DataFrame, shards: int = 40, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Every row of ``docs`` with its shard and its place in it.

    Rows are sorted by (hash of text, hash of row number): equal texts are neighbours, and a shard boundary parts
    them only where keeping them together would make the sizes uneven. Size is the text's UTF-8 bytes plus 16; null
    text has none and counts as empty. Shards have near equal bytes. Repeated rows and null ids are rows like others;
    an empty table gives an empty result. A shard of more than ``range_rows`` rows is sorted in several tasks.
    Result: doc_id, size, text_crc32, law, shard, slot, grown_shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = settle(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.xxhash64(F.monotonically_increasing_id()).alias("g"),
        )
    )
    n_rows = keyed.count()
    pieces = max(1, -(-n_rows // (shards * range_rows)))
    keys, below, _ = splitters(keyed, shards * pieces) if n_rows else ([0] * (shards * pieces - 1), [0] * (shards * pieces - 1), 0)
    starts = [0, *below]
    cells = keyed.mapInArrow(_assign([_parts(min(k, (1 << 128) - 1)) for k in keys]), "doc_id long, size long, text_crc32 long, h long, g long, cell int")
    base = F.array(*[F.lit(starts[k] - starts[k - k % pieces]).cast("long") for k in range(shards * pieces)])
    place = F.row_number().over(Window.partitionBy("cell").orderBy("h", "g")) - 1
    return cells.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.floor(F.col("cell") / pieces).cast("int").alias("shard"),
        (F.get(base, F.col("cell")) + place).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
