"""Cross-tokenizer alignment in Arrow: ends by segmented sums, links by hash joins on document ends, counts merged by Spark."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import columns, settle

# A document and a place inside it share one 64-bit key; places take the lower bits.
PLACE_BITS = 40
# Distinct pairs a task counts before it hands its partial counts on.
PARTIAL_PAIRS = 2_000_000
# Links of one Arrow table; longer batches are worked off in parts.
PART_TOKENS = 400_000
# Pair counts are broadcast below this size, counted first; beyond it they are joined.
PAIR_BYTES = 96 * 1024 * 1024
_BYTES_A_PAIR = 17

_TOKENS = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])
_TOKENS_DDL = "doc_id long, rid long, a array<int>, b array<int>, n_groups long, n_links long, groups_sha256 string"
_PAIRS_DDL = "a int, b int, n long"
_SUMS = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])
_SUMS_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_OWN_DDL = "rid long, a int, b int, own long"

_vocabularies: dict[tuple, tuple] = {}


class ByteRanks:
    """Byte-level tokenizer of a rank file; strings of special tokens are ordinary text."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.spelling = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.spelling[rank] = token

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(" " + text) for text in texts]


class Pieces:
    """Piece tokenizer with byte fallback; it puts the space before a text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.spelling = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.model.id_to_piece(i)) for i in range(size))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _both(paths: tuple[str, str, str]) -> tuple[ByteRanks, Pieces]:
    if paths not in _vocabularies:
        _vocabularies[paths] = ByteRanks(paths[0], paths[1]), Pieces(paths[2])
    return _vocabularies[paths]


def _lengths(spelling: list[bytes]) -> pa.Array:
    return pa.array([len(token) for token in spelling], pa.int64())


def _ends(tokens: pa.ListArray, lengths: pa.Array, name: str) -> pa.Table:
    """(at, token): the key of document and byte offset where each token ends."""
    flat, document = pc.list_flatten(tokens), pc.list_parent_indices(tokens).cast(pa.int64())
    if not len(flat):
        return pa.table({"at": pa.array([], pa.int64()), name: pa.array([], pa.int32())})
    running = pc.cumulative_sum(pc.take(lengths, flat))
    # What ran up before a document's first token is taken off again.
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.concatenate([[0], running.to_numpy()])[np.cumsum(sizes) - sizes]
    end = pc.subtract(running, pc.take(pa.array(before), document))
    return pa.table({"at": pc.add(pc.shift_left(document, pa.scalar(PLACE_BITS, pa.int64())), end), name: flat})


def links(a: pa.ListArray, b: pa.ListArray, lengths_a: pa.Array, lengths_b: pa.Array) -> pa.Table:
    """(document, a, b, ends_a, ends_b): a row for every pair of tokens whose byte ranges overlap, in text order.

    The ends of both sides cut a document into segments, and each segment lies in one token of either side: so the rows
    of the outer join on document and end are the links, once a missing token is taken from the next end of its side.
    ``ends_a`` and ``ends_b`` say whether the side's token ends there; where both end, a group ends.
    """
    joined = _ends(a, lengths_a, "a").join(_ends(b, lengths_b, "b"), "at", join_type="full outer", use_threads=False)
    joined = joined.sort_by("at").combine_chunks()
    ends_a, ends_b = pc.is_valid(joined["a"]), pc.is_valid(joined["b"])
    document = pc.shift_right(joined["at"], pa.scalar(PLACE_BITS, pa.int64()))
    return pa.table({"document": document, "a": pc.fill_null_backward(joined["a"]), "b": pc.fill_null_backward(joined["b"]), "ends_a": ends_a, "ends_b": ends_b})


def _joined(strings: pa.Array, sizes: np.ndarray, by: str) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, strings), pa.scalar(by, strings.type))


def _group_texts(table: pa.Table, n_documents: int) -> tuple[np.ndarray, list[str]]:
    """Groups of each document, and their text ``a1,a2|b1;a3|b2,b3``."""
    ends_a, ends_b = table["ends_a"].to_numpy(), table["ends_b"].to_numpy()
    closes = ends_a & ends_b
    group = np.cumsum(closes) - closes
    n = int(closes.sum())
    sides = []
    for name, ends in (("a", ends_a), ("b", ends_b)):
        ids = table[name].filter(pa.array(ends)).combine_chunks().cast(pa.large_string())
        sides.append(_joined(ids, np.bincount(group[ends], minlength=n), ","))
    per_document = np.bincount(table["document"].to_numpy()[closes], minlength=n_documents)
    texts = _joined(pc.binary_join_element_wise(*sides, pa.scalar("|", pa.large_string())), per_document, ";")
    return per_document, texts.to_pylist()


def _parts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Row ranges of about PART_TOKENS tokens, so that the tables of a part stay small."""
    start, held = 0, 0
    for at, size in enumerate(sizes):
        held += size
        if held >= PART_TOKENS:
            yield start, at + 1
            start, held = at + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _tokenize(paths: tuple[str, str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = _both(paths)
        lengths = _lengths(first.spelling), _lengths(second.spelling)
        spell = first.spelling.__getitem__, second.spelling.__getitem__
        for batch in batches:
            doc_ids, rids, texts = columns(batch, "doc_id", "rid", "text")
            for low, high in _parts([len(t or "") // 2 for t in texts]):
                part = [t or "" for t in texts[low:high]]
                ids = [first.encode(part), second.encode(part)]
                for k, text in enumerate(part):
                    raw = b" " + text.encode()
                    if not text or any(b"".join(map(s, side[k])) != raw for s, side in zip(spell, ids)):
                        ids[0][k] = ids[1][k] = []
                a, b = (pa.array(side, pa.list_(pa.int32())) for side in ids)
                table = links(a, b, *lengths)
                n_groups, groups = _group_texts(table, len(part))
                n_links = np.bincount(table["document"].to_numpy(), minlength=len(part))
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[low:high], pa.int64()), pa.array(rids[low:high], pa.int64()), a, b, pa.array(n_groups, pa.int64()), pa.array(n_links, pa.int64()), pa.array(digests, pa.string())], schema=_TOKENS)

    return run


def _linked(batches: Iterator[pa.RecordBatch], paths: tuple[str, str, str]) -> Iterator[tuple[pa.RecordBatch, pa.Table]]:
    """Parts of settled token lists with their links."""
    first, second = _both(paths)
    lengths = _lengths(first.spelling), _lengths(second.spelling)
    for batch in batches:
        for low, high in _parts(pc.list_value_length(batch["a"]).to_pylist()):
            part = batch.slice(low, high - low)
            yield part, links(pa.concat_arrays([part["a"]]), pa.concat_arrays([part["b"]]), *lengths)


def _partial_counts(paths: tuple[str, str, str]):
    """Counts of id pairs of one task, grouped in Arrow; held while they are few, else handed on."""

    def total(tables: list[pa.Table]) -> pa.Table:
        grouped = pa.concat_tables(tables).group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")])
        return grouped.select(["a", "b", "n_sum"]).rename_columns(["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for _part, table in _linked(batches, paths):
            counts = table.group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")])
            held.append(counts.select(["a", "b", "count_all"]).rename_columns(["a", "b", "n"]))
            rows += counts.num_rows
            if rows > 2 * PARTIAL_PAIRS:
                held = [total(held)]
                rows = held[0].num_rows
                if rows > PARTIAL_PAIRS:
                    yield from held[0].to_batches(max_chunksize=50_000)
                    held, rows = [], 0
        if held:
            yield from total(held).to_batches(max_chunksize=50_000)

    return run


def _summed(shared, paths: tuple[str, str, str]):
    """Sums of the broadcast pair counts over the links of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = shared.value
        for part, table in _linked(batches, paths):
            place = np.searchsorted(keys, table["a"].to_numpy().astype(np.int64) << 32 | table["b"].to_numpy())
            until = np.searchsorted(table["document"].to_numpy(), np.arange(part.num_rows + 1))

            def by_document(values: np.ndarray) -> pa.Array:
                return pa.array(np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[until]))

            sizes = [pc.list_value_length(part[name]).cast(pa.int64()) for name in ("a", "b")]
            yield pa.RecordBatch.from_arrays([part["doc_id"], *sizes, part["n_groups"], part["n_links"], by_document(best[place]), by_document(counts[place]), part["groups_sha256"]], schema=_SUMS)

    return run


def _own_pairs(paths: tuple[str, str, str]):
    """(rid, a, b, own): how often each document links an id pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, table in _linked(batches, paths):
            own = table.group_by(["document", "a", "b"], use_threads=False).aggregate([([], "count_all")])
            rid = pc.take(part["rid"], own["document"])
            yield from pa.table({"rid": rid, "a": own["a"], "b": own["b"], "own": own["count_all"]}).to_batches(max_chunksize=50_000)

    return run


def pair_counts(tokens: DataFrame, paths: tuple[str, str, str]) -> DataFrame:
    """(a, b, n, best): links of every id pair in the corpus, and whether no pair of its B id has more.

    A task counts in Arrow, Spark adds the tasks' counts up. A window holds one B id, so at most A's vocabulary.
    """
    totals = tokens.select("doc_id", "rid", "a", "b").mapInArrow(_partial_counts(paths), _PAIRS_DDL).groupBy("a", "b").agg(F.sum("n").alias("n"))
    return settle(totals.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b"))))


def align(docs: DataFrame, ranks_path: str, pattern: str, pieces_path: str, pair_bytes: int = PAIR_BYTES) -> DataFrame:
    """How two tokenizers cut each text of ``docs``, and how usual its id pairs are in the corpus.

    Both sides encode a space and the text. Texts that are null, empty, or that one side's tokens do not spell byte for
    byte have no tokens: zeros and an empty digest. Whole texts are encoded; repeated rows count each; other columns are
    ignored; an empty table gives an empty result. Pair counts are broadcast where their number was counted to stay
    below ``pair_bytes``, and joined to the documents' pairs beyond it; the rows are the same.
    Result: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.
    """
    paths = (ranks_path, pattern, pieces_path)
    spark = docs.sparkSession
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), "text")
    tokens = settle(read.mapInArrow(_tokenize(paths), _TOKENS_DDL))
    pairs = pair_counts(tokens, paths)
    if pairs.count() * _BYTES_A_PAIR <= pair_bytes:
        found = pairs.select((F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("key"), "n", "best").toArrow()
        order = np.argsort(found["key"].to_numpy())
        shared = spark.sparkContext.broadcast(tuple(np.asarray(found[c].to_numpy())[order] for c in ("key", "n", "best")))
        return tokens.mapInArrow(_summed(shared, paths), _SUMS_DDL)
    own = tokens.select("doc_id", "rid", "a", "b").mapInArrow(_own_pairs(paths), _OWN_DDL)
    sums = own.join(pairs, ["a", "b"]).groupBy("rid").agg(F.sum(F.when(F.col("best"), F.col("own")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("own")).alias("count_sum"))
    rows = tokens.select("doc_id", "rid", F.size("a").cast("long").alias("n_a"), F.size("b").cast("long").alias("n_b"), "n_groups", "n_links", "groups_sha256")
    return rows.join(sums, "rid", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
