"""Exact deduplication as a Grace hash: partition by hash, fill one table per bucket, partition again what is too large."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import binary, columns, free_name, settle, slices

# White space that does not count in a comparison (fixed by the contract).
WHITE_SPACE = b" \t\n\x0b\x0c\r"
# Bytes of content one bucket's table may hold in a task.
TABLE_BYTES = 64 * 1024 * 1024
ENTRY_BYTES = 400
# Most buckets of one exchange.
FAN_OUT = 4096

_RECORD = pa.schema([("digest", pa.binary()), ("content", pa.binary()), ("size", pa.int64()), ("n_chars", pa.int64()), ("doc_id", pa.int64()), ("ties", pa.int64()), ("done", pa.bool_())])
_RECORD_DDL = "digest binary, content binary, size long, n_chars long, doc_id long, ties long, done boolean"


def _rank(n_chars: int, doc_id: int | None) -> tuple:
    return (-n_chars, doc_id is None, doc_id or 0)


def _merge(slot: list, size: int, n_chars: int, doc_id: int | None, ties: int) -> None:
    slot[0] += size
    here, there = _rank(slot[1], slot[2]), _rank(n_chars, doc_id)
    if there < here:
        slot[1:4] = [n_chars, doc_id, ties]
    elif there == here:
        slot[3] += ties


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [hashlib.sha256(raw.translate(None, WHITE_SPACE)).digest() for raw in columns(batch, "raw")[0]]
        names = ["doc_id", "n_chars", "rid"]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(digests, pa.binary())], names=[*names, "digest"])


def _local(table_bytes: int):
    """Fold equal contents of one scan task before the shuffle; a hot text leaves a task as a single record."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A dict is an open-addressing table: the hash finds the slot, equality compares the complete content.
        table: dict[bytes, list] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            yield from slices([(hashlib.sha256(body).digest(), body, *slot, False) for body, slot in table.items()], _RECORD, 256)

        for batch in batches:
            for raw, n_chars, doc_id in zip(*columns(batch, "raw", "n_chars", "doc_id")):
                body = raw.translate(None, WHITE_SPACE)
                slot = table.get(body)
                if slot is None:
                    table[body] = [1, n_chars, doc_id, 1]
                    held += len(body) + ENTRY_BYTES
                else:
                    _merge(slot, 1, n_chars, doc_id, 1)
            if held > table_bytes:
                yield from flush()
                table, held = {}, 0
        yield from flush()

    return fold


def _bucket(table_bytes: int):
    """Fill the bucket's table up to its bound; contents it has no room for go on to the next level untouched.

    A content is either in the table from its first record on or never, so no group is split between levels.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, list] = {}
        digests: dict[bytes, bytes] = {}
        held = 0
        for batch in batches:
            over = []
            for digest, body, size, n_chars, doc_id, ties in zip(*columns(batch, "digest", "content", "size", "n_chars", "doc_id", "ties")):
                slot = table.get(body)
                if slot is not None:
                    _merge(slot, size, n_chars, doc_id, ties)
                elif held <= table_bytes:
                    table[body] = [size, n_chars, doc_id, ties]
                    digests[body] = digest
                    held += len(body) + ENTRY_BYTES
                else:
                    over.append((digest, body, size, n_chars, doc_id, ties, False))
            yield from slices(over, _RECORD, 256)
        yield from slices([(digests[body], None, *slot, True) for body, slot in table.items()], _RECORD)

    return fill


def _extent(content: Column) -> list[Column]:
    """Bytes that tables of these records need at most, and records."""
    return [F.coalesce(F.sum(F.octet_length(content) + ENTRY_BYTES), F.lit(0)).alias("need"), F.count(content).alias("records")]


def groups_of_equal(rows: DataFrame, table_bytes: int = TABLE_BYTES, fan_out: int = FAN_OUT) -> DataFrame:
    """(digest, size, n_chars, doc_id, ties): one row per distinct content of ``rows``.

    ``rows`` has raw (bytes), n_chars and doc_id. Records are dealt out by a hash of their content to as many buckets as
    tables of ``table_bytes`` are needed. Where these are more than ``fan_out``, records go to spill files of fewer, larger
    buckets first, and each is partitioned in turn by another hash, so rewrites grow with the logarithm of the input.
    What finds no room in a bucket's table is measured and partitioned again; every bucket settles at least one
    content, so this ends.
    """
    spark = rows.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    need, records = rows.agg(*_extent(F.col("raw"))).first()
    pending = rows.select("raw", "n_chars", "doc_id").mapInArrow(_local(table_bytes), _RECORD_DDL)
    waiting, finished = [(pending, 0, need, records)], []
    while waiting:
        pending, level, need, records = waiting.pop()
        # Buckets differ in size by chance: a quarter more of them than full tables.
        tables = min(-(-need * 5 // (table_bytes * 4)), records)
        hashed = F.xxhash64("digest", F.lit(level))
        if tables > fan_out:
            wide = min(-(-tables // fan_out), fan_out)
            spilled = settle(pending.withColumn("bucket", F.pmod(hashed, F.lit(wide)).cast("int")), by="bucket")
            sizes = spilled.groupBy("bucket").agg(*_extent(F.col("content"))).collect()
            waiting += [(spilled.filter(F.col("bucket") == k).drop("bucket"), level + 1, *extent) for k, *extent in sizes]
            continue
        filled = settle(pending.repartition(max(least, tables), hashed).mapInArrow(_bucket(table_bytes), _RECORD_DDL))
        finished.append(filled.filter("done").drop("content", "done"))
        over = filled.filter("NOT done")
        need, records = over.agg(*_extent(F.col("content"))).first()
        if records:
            waiting.append((over, level + 1, need, records))
    return reduce(DataFrame.unionByName, finished)


def exact_duplicates(docs: DataFrame, table_bytes: int = TABLE_BYTES, row_id: str | None = None) -> DataFrame:
    """Each row of ``docs`` with the row of equal text that stays.

    Texts are equal when identical without white space (bytes 9-13 and 32). The row with the most code points stays,
    then the smallest doc_id (null last), then the smallest row number, so of repeated rows one is kept. Null text is
    empty; empty texts are one group; an empty table gives an empty result. Other columns are ignored.
    ``row_id`` names a stored unique number of the rows; without it rows are numbered as scanned.
    Result: doc_id, keep_id, group_size, kept, text_sha256, rid.
    """
    number = F.col(row_id) if row_id else F.monotonically_increasing_id()
    length = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), length.alias("n_chars"), number.alias("rid"), binary("text").alias("raw"))
    rows = settle(read.mapInArrow(_fingerprints, "doc_id long, n_chars long, rid long, digest binary"))
    groups = groups_of_equal(read, table_bytes).select("digest", F.col("size").alias("group_size"), F.col("n_chars").alias("most"), F.col("doc_id").alias("keep_id"), "ties")
    best = (F.col("n_chars") == F.col("most")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # Rows that tie in length and doc_id as well are told apart by their number.
    first = rows.join(groups.filter("ties > 1"), "digest").filter(best).groupBy("digest").agg(F.min("rid").alias("first"))
    # Settled, so that the last join has two plain sides and a hot text can be split.
    joined = rows.join(settle(groups.join(first, "digest", "left")), "digest")
    kept = best & ((F.col("ties") == 1) | (F.col("rid") == F.col("first")))
    return joined.select("doc_id", "keep_id", "group_size", F.coalesce(kept, F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "rid")


def drop_exact_duplicates(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, all their columns unchanged; see exact_duplicates for which stay."""
    row = free_name(docs, "__row")
    numbered = settle(docs.withColumn(row, F.monotonically_increasing_id()))
    stay = exact_duplicates(numbered, table_bytes, row_id=row).filter("kept").select(F.col("rid").alias(row))
    return numbered.join(stay, row, "left_semi").drop(row)
