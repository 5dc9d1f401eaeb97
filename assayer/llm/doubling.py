"""Repeated byte strings by distributed prefix doubling: rank pairs at growing offsets, sorted and reranked by Spark."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import binary, columns, settle

THRESHOLD = 400
# Bytes a task hashes at once; texts beyond it are worked off in overlapping stretches.
STRETCH = 32 * 1024 * 1024
# A block of windows falls into this many at every offset.
FAN = 4

_PLACE_BITS = 27  # of a stretch of bytes, in a sort key of hash and place
_ODD = np.uint64(0x9E3779B97F4A7C15)

_TEXTS = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("n", pa.int64()), ("packed", pa.binary())])
_TEXTS_DDL = "doc_id long, rid long, n long, packed binary"
_BLOCK = [("rid", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("first", pa.int64()), ("core", pa.int64()), ("whole", pa.int64()), ("whole2", pa.int64())]
_ANCHORS = pa.schema([*_BLOCK, ("anchor", pa.int64())])
_ANCHORS_DDL = "rid long, low long, high long, first long, core long, whole long, whole2 long, anchor long"
_CHILDREN = pa.schema([*_BLOCK, ("home", pa.int64()), ("rank", pa.int64()), ("asks", pa.bool_())])
_CHILDREN_DDL = "rid long, low long, high long, first long, core long, whole long, whole2 long, home long, rank long, asks boolean"
_CONTEXTS = pa.schema([("home", pa.int64()), ("rid", pa.int64()), ("anchor", pa.int64()), ("from", pa.int64()), ("until", pa.int64()), ("context", pa.binary())])
_CONTEXTS_DDL = "home long, rid long, anchor long, from long, until long, context binary"
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
_KEPT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _longs(data: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", hashlib.blake2b(data, digest_size=16).digest())


def width_of(threshold: int) -> int:
    """Places an anchor can have in a window: the largest power of FAN that leaves an anchor string of a third of it."""
    width = 1
    while width * FAN <= threshold * 2 // 3:
        width *= FAN
    return width


class Shape:
    """The strings of a block of windows.

    A window of ``threshold`` bytes holds its anchor ``d`` bytes after its start, 0 <= d < width. A block is the
    windows of one anchor with ``first`` <= d < first + wide. Its core is what all such windows share, whether they
    have this anchor or not; its whole is what those that have it cover together.
    """

    def __init__(self, threshold: int):
        self.threshold, self.width = threshold, width_of(threshold)

    def strings(self, text: bytes, shift: int, anchor: int, low: int, high: int, first: int, wide: int) -> tuple[int, ...] | None:
        """(low, high, first, core, whole, whole2) of a block whose anchor owns the windows that start in [low, high).

        ``text`` begins at ``shift``. None where the anchor owns no window of the block.
        """
        begin = anchor - first - wide + 1
        low, high = max(low, begin), min(high, begin + wide)
        if low >= high:
            return None
        core = _longs(text[anchor - first - shift : begin + self.threshold - shift])[0]
        cut = b"%d,%d;" % (low - begin, high - begin)
        return (low, high, first, core, *_longs(cut + text[low - shift : high - 1 + self.threshold - shift]))


def anchors(data: np.ndarray, threshold: int, width: int) -> np.ndarray:
    """Place of the anchor of every window: its leftmost string of least hash among ``width`` anchor strings.

    It depends on the bytes of the window alone, so equal windows hold their anchors at the same place.
    """
    length = threshold - width + 1
    mixed = (data.astype(np.uint64) + np.uint64(1)) * _ODD
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    # Hash of a string of bytes: a power series of an odd base modulo 2**64, as a difference of running sums.
    powers = np.empty(len(data), np.uint64)
    powers[0], powers[1:] = 1, 0xD6E8FEB86659FD93
    np.multiply.accumulate(powers, out=powers)
    inverse = np.empty(len(data), np.uint64)
    inverse[0], inverse[1:] = 1, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
    np.multiply.accumulate(inverse, out=inverse)
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * powers, dtype=np.uint64)])
    hashed = (running[length:] - running[:-length]) * inverse[: len(data) - length + 1]
    hashed ^= hashed >> np.uint64(32)
    hashed *= _ODD
    key = hashed >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS) | np.arange(len(hashed), dtype=np.uint64)
    # Least of every run of ``width``: the better of a block's minimum from the left and one from the right.
    windows = len(hashed) - width + 1
    padded = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows])
    return (least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)


def _owned(texts: list[bytes], threshold: int, width: int, stretch: int) -> list[list[tuple[int, int, int]]]:
    """(anchor, low, high) for each text: the windows starting in [low, high) have this anchor.

    Texts are hashed together up to ``stretch`` bytes, longer ones in stretches.
    """
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    group: list[tuple[int, int, bytes]] = []
    held = 0

    def flush() -> None:
        nonlocal group, held
        if group:
            at = anchors(np.frombuffer(b"".join(part for _k, _s, part in group), np.uint8), threshold, width)
            start = 0
            for k, shift, part in group:
                own = at[start : start + len(part) - threshold + 1]
                begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                ends = np.append(begins[1:], len(own))
                found[k].extend(zip((own[begins] - start + shift).tolist(), (begins + shift).tolist(), (ends + shift).tolist()))
                start += len(part)
        group, held = [], 0

    for k, text in enumerate(texts):
        for shift in range(0, len(text) - threshold + 1, stretch):
            part = text[shift : shift + stretch + threshold - 1]
            group.append((k, shift, part))
            held += len(part)
            if held >= stretch:
                flush()
    flush()
    return found


def _batched(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(col, type=field.type) for col, field in zip(zip(*rows), schema)], schema=schema)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, which every later exchange moves."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
    for batch in batches:
        doc_ids, rids, texts = columns(batch, "doc_id", "rid", "raw")
        yield _batched([(d, r, len(t), squeeze(t)) for d, r, t in zip(doc_ids, rids, texts)], _TEXTS)


def _unpacked(packed: list[bytes]) -> list[bytes]:
    import zstandard

    return list(map(zstandard.ZstdDecompressor().decompress, packed))


def _anchor_blocks(shape: Shape, stretch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, packed = columns(batch, "rid", "packed")
            texts = _unpacked(packed)
            out = []
            for rid, text, owned in zip(rids, texts, _owned(texts, shape.threshold, shape.width, stretch)):
                for anchor, low, high in owned:
                    out.append((rid, *shape.strings(text, 0, anchor, low, high, 0, shape.width), anchor))
                    if len(out) >= 20_000:
                        yield _batched(out, _ANCHORS)
                        out = []
            if out:
                yield _batched(out, _ANCHORS)

    return run


def _contexts(shape: Shape):
    """The bytes of anchors that go on: all that their windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, packed, places = columns(batch, "rid", "packed", "places")
            out = []
            for rid, text, wanted in zip(rids, _unpacked(packed), places):
                for p in wanted:
                    out.append((p["home"], rid, p["anchor"], p["low"], p["high"], text[p["low"] : p["high"] - 1 + shape.threshold]))
                    if len(out) >= 4_000:
                        yield _batched(out, _CONTEXTS)
                        out = []
            if out:
                yield _batched(out, _CONTEXTS)

    return run


def _children(shape: Shape, wide: int):
    """Blocks of ``wide`` windows inside blocks that go on, with their strings at the next offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rid, home, anchor, low, high, first, rank, asks, context in zip(*columns(batch, "rid", "home", "anchor", "from", "until", "first", "rank", "asks", "context")):
                for inner in range(first, first + wide * FAN, wide):
                    strings = shape.strings(context, low, anchor, low, high, inner, wide)
                    if strings is not None:
                        out.append((rid, *strings, home, rank, asks))
                if len(out) >= 20_000:
                    yield _batched(out, _CHILDREN)
                    out = []
            if out:
                yield _batched(out, _CHILDREN)

    return run


def _rerank(blocks: DataFrame) -> DataFrame:
    """Blocks (with pair, whole, whole2, asks and a number ``block``) that are decided to repeat or that go on.

    ``pair`` stands for a block's rank so far and the string at its new offset; equal pairs become one rank, the number
    of one of their members. A pair that occurs once is unique, so no window of the block repeats, and the block leaves.
    Blocks that are equal as a whole repeat in all their windows (``repeats``). Where a rank holds different wholes, one
    member of each goes on: those equal to others only so that the rest can be compared with them (``asks`` is false).
    """
    shared = settle(blocks.join(blocks.groupBy("pair").count().filter("count > 1").select("pair"), "pair", "left_semi"))
    wholes = shared.groupBy("pair", "whole", "whole2").agg(F.count("*").alias("size"), F.min("block").alias("one"))
    ranks = wholes.groupBy("pair").agg(F.count("*").alias("wholes"), F.min("one").alias("rank"))
    # A whole of its own in a pair goes on itself, its row need not be found again among equal ones.
    known = wholes.join(ranks, "pair")
    found = shared.drop("rank").join(known, ["pair", "whole", "whole2"])
    repeats = (F.col("size") > 1) & F.col("asks")
    goes_on = (F.col("wholes") > 1) & (F.col("block") == F.col("one"))
    decided = found.filter(repeats | goes_on).withColumn("repeats", repeats).withColumn("goes_on", goes_on)
    return decided.withColumn("asks", (F.col("size") == 1) & F.col("asks")).drop("pair", "whole", "whole2", "size", "wholes", "one", "block")


def _cut(threshold: int):
    """Take the bytes of all repeated windows out of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, packed, found = columns(batch, "doc_id", "packed", "found")
            out = []
            for doc_id, text, windows in zip(doc_ids, _unpacked(packed), found):
                kept, removed, spans, at = [], 0, 0, 0
                for start, until in _merged(threshold, windows or []):
                    kept.append(text[at:start])
                    removed += until - start
                    spans += 1
                    at = until
                body = b"".join([*kept, text[at:]])
                out.append((doc_id, len(text), removed, spans, hashlib.sha256(body).hexdigest(), body))
            yield _batched(out, _KEPT)

    return run


def _merged(threshold: int, windows: list[dict]) -> Iterator[tuple[int, int]]:
    """Maximal byte runs that windows starting in the given ranges cover."""
    begun, ended = None, None
    for low, high in sorted((w["low"], w["high"]) for w in windows):
        until = high - 1 + threshold
        if begun is None:
            begun, ended = low, until
        elif low <= ended:
            ended = max(ended, until)
        else:
            yield begun, ended
            begun, ended = low, until
    if begun is not None:
        yield begun, ended


def repeated_windows(texts: DataFrame, threshold: int = THRESHOLD, stretch: int = STRETCH) -> DataFrame:
    """(rid, low, high): the windows of ``threshold`` bytes starting in [low, high) all occur more than once.

    ``texts`` holds rid (a stored unique number), n (bytes) and packed (compressed bytes). Doubling starts from anchors,
    places that the bytes of a window choose themselves, one in about 100 bytes: equal windows have equal anchor strings
    at the same place in them. Ranks of anchor strings are refined by the strings at growing offsets, of 145, 337, 385,
    397 and 400 bytes for windows of 400, and blocks leave as soon as they are unique or repeat as a whole. Every window
    is decided.
    """
    shape = Shape(threshold)
    wide = shape.width
    own = F.monotonically_increasing_id()
    blocks = settle(texts.filter(F.col("n") >= threshold).select("rid", "packed").mapInArrow(_anchor_blocks(shape, stretch), _ANCHORS_DDL).withColumn("block", own))
    state = settle(_rerank(blocks.select("*", F.col("block").alias("home"), F.col("core").alias("pair"), F.lit(True).alias("asks")).drop("core")))
    repeats = state.filter("repeats").select("rid", "low", "high")
    contexts = None
    while wide > 1:
        wide //= FAN
        onward = state.filter("goes_on")
        if contexts is None:
            places = onward.groupBy("rid").agg(F.collect_list(F.struct("home", "anchor", "low", "high")).alias("places"))
            contexts = settle(texts.select("rid", "packed").join(places, "rid").mapInArrow(_contexts(shape), _CONTEXTS_DDL))
        children = onward.select("home", "first", "rank", "asks").join(contexts, "home").mapInArrow(_children(shape, wide), _CHILDREN_DDL)
        pair = F.xxhash64("rank", "first", "core")
        state = settle(_rerank(settle(children.withColumn("pair", pair).drop("core", "rank").withColumn("block", own))))
        repeats = repeats.unionByName(state.filter("repeats").select("rid", "low", "high"))
    return repeats


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, stretch: int = STRETCH) -> DataFrame:
    """Each text of ``docs`` without the bytes that a string of ``threshold`` bytes covers which also starts elsewhere.

    Texts are UTF-8 bytes (null is empty); strings do not cross texts and are judged on the input. Copies inside one
    text count, overlapping ones too. Texts shorter than ``threshold`` stay whole; repeated rows are copies of each other;
    other columns are ignored; an empty table gives an empty result. Strings are told apart by 128-bit digests.
    Result: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay).
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), binary("text").alias("raw"))
    texts = settle(read.mapInArrow(_pack, _TEXTS_DDL))
    found = repeated_windows(texts, threshold, stretch).groupBy("rid").agg(F.collect_list(F.struct("low", "high")).alias("found"))
    return texts.join(found, "rid", "left").select("doc_id", "packed", "found").mapInArrow(_cut(threshold), _KEPT_DDL)
