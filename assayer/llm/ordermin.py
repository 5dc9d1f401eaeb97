"""Near duplicates by Order MinHash: sampled k-mers in text order, candidates verified by banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import binary, columns, free_name, offer_broadcast, settle
from assayer.operators.graph import connected_components

SHINGLE = 5
SIMILARITY = 0.8
# Each of SKETCHES draws the PICKED smallest occurrence-labelled shingles. Two texts of similarity 0.8 agree in one
# with a chance of about 0.64, so they agree in none with one of 5e-6.
SKETCHES, PICKED = 12, 2
# Buckets up to this size are compared pair by pair; larger ones by leaders first, then by a join on rare shingles.
SMALL_BUCKET = 32
# A large bucket gets another leader while a round leaves at most this share of its classes. It settles cost, not results.
LEADING = 0.75
# Texts of a block in the join on rare shingles: those outside a shingle's main class, and all that hold it.
OUTSIDE_BLOCK, ALL_BLOCK = 256, 1024
# Counts of a text's labelled shingles by hash, which bound what two texts can have in common; longer texts go unbounded.
TALLIES, LONGEST_TALLIED = 256, 60_000
# First rare shingles of a text that tell whether a pair meets earlier; later meetings are repeats that are dropped after.
FIRST_LABELS = 64
# Slots that labelled shingles are counted in; their number is fixed, fuller slots only tell rare shingles apart less.
SLOTS = 1 << 21
# A shingle that occurs more often in a text is aligned by one mask of its places.
MANY_PLACES = 64

_RNG = np.random.default_rng(20240607)
_SEEDS = _RNG.integers(1, 1 << 63, SKETCHES, dtype=np.uint64)
_ODD = _RNG.integers(1, 1 << 63, SKETCHES, dtype=np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)

# Bytes that are no part of a word become blanks, A-Z become lower case.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    x ^= x >> np.uint64(32)
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the word shingles in text order; a text of fewer words is one shingle."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(words) - SHINGLE + 1)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(min(SHINGLE, len(words))):
        total += hashes[k : k + n] * _PLACE[k]
    return _mix(total)


def labels(grams: np.ndarray) -> np.ndarray:
    """Shingles told apart by their occurrence in the text. The first one has the same label in every text, repeated or not."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    occurrence = np.zeros(len(grams), dtype=np.uint64)
    if (ranked[1:] == ranked[:-1]).any():
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        occurrence[order] = np.arange(len(grams)) - np.repeat(first, np.diff(np.append(first, len(grams))))
    return _mix(grams + occurrence * _ODD[0])


def order_sketches(grams: np.ndarray) -> np.ndarray:
    """Order MinHash: for each sketch, the PICKED smallest labelled shingles, hashed in the order of the text."""
    labelled = labels(grams)
    values = (labelled[None, :] ^ _SEEDS[:, None]) * _ODD[:, None]
    values ^= values >> np.uint64(31)
    values *= _MIX
    picked = min(PICKED, len(grams))
    at = np.sort(np.argpartition(values, picked - 1, axis=1)[:, :picked], axis=1)
    sketch = _SEEDS.copy()
    for k in range(picked):
        sketch = _mix(sketch + grams[at[:, k]])
    return sketch.astype(np.int64)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, bodies, sketches, sizes = [], [], [], []
        for raw in columns(batch, "raw")[0]:
            words = raw.translate(_TO_WORDS).split()
            body = b" ".join(words)
            # A text without words is only ever equal to itself.
            digests.append(xxhash.xxh3_128_digest(body if words else b"\x00" + raw))
            grams = shingles(words) if words else None
            sketches.append(order_sketches(grams).tolist() if words else [])
            sizes.append(len(grams) if words else 0)
            bodies.append(body)
        keep = [batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "rid")]
        arrays = [*keep, pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.list_(pa.int64())), pa.array(bodies, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "rid", "digest", "n", "sketches", "body"])


_ROWS_DDL = "doc_id long, rid long, digest binary, n long, sketches array<long>, body binary"


def _mask(places: list[int], n: int) -> int:
    bits = np.zeros(n, np.uint8)
    bits[places] = 1
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def aligned(a: list, b: list, least: float) -> float:
    """Similarity by banded alignment: shingles matched in order over all shingles, 0 where it stays below ``least``.

    The alignment is a longest common subsequence kept as one bit per place of ``a`` and advanced a shingle of ``b`` at
    a time. Only places within the band can matter: a path that leaves it has lost more shingles than allowed.
    """
    n, m = len(a), len(b)
    need = least * (n + m) / (1 + least)
    if min(n, m) < need - 1e-9:
        return 0.0
    places: dict = {}
    for k, gram in enumerate(a):
        places.setdefault(gram, []).append(k)
    # A shingle of many places is matched at once; there are few of those, so their masks stay small.
    many = max(MANY_PLACES, n // 1024)
    masks = {gram: _mask(at, n) for gram, at in places.items() if len(at) > many}
    counts: dict = {}
    for gram in b:
        if gram in places:
            counts[gram] = counts.get(gram, 0) + 1
    if sum(min(c, len(places[g])) for g, c in counts.items()) < need - 1e-9:
        return 0.0
    band = int(n + m - 2 * need) + 1
    full = (1 << n) - 1
    row = full
    for j, gram in enumerate(b):
        if gram in masks:
            low = max(j - band, 0)
            match = masks[gram] >> low & (1 << j + band + 1 - low) - 1
            match <<= low
        else:
            match = 0
            for k in places.get(gram, ()):
                if abs(k - j) <= band:
                    match |= 1 << k
        if match:
            both = row & match
            row = ((row + both) | (row - both)) & full
    common = n - row.bit_count()
    return common / (n + m - common)


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [aligned(shingles(a.split(b" ")).tolist(), shingles(b.split(b" ")).tolist(), least) for a, b in zip(*columns(batch, "body_a", "body_b"))]
            keep = [batch.column(batch.schema.get_field_index(n)) for n in ("a", "b")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(score, pa.float64())], names=["a", "b", "similarity"])

    return run


def _near(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) whose lengths n and m allow the similarity."""
    near = pairs.filter((F.col("digest") != F.col("d")) & (F.least("n", "m") >= SIMILARITY * F.greatest("n", "m") - 1e-9))
    return near.select(F.least("digest", "d").alias("a"), F.greatest("digest", "d").alias("b")).distinct()


def _pairs_of_small(members: DataFrame) -> DataFrame:
    """Every pair of the buckets of at most SMALL_BUCKET texts; a bucket gives a bounded number of pairs."""
    lists = members.filter(F.col("size") <= SMALL_BUCKET).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("digest", "n"))).alias("x"))
    first = lists.select("x", F.posexplode("x").alias("i", "one"))
    both = first.select("one", F.explode(F.slice("x", F.col("i") + 2, F.size("x"))).alias("other"))
    return _near(both.select(F.col("one.digest").alias("digest"), F.col("one.n").alias("n"), F.col("other.digest").alias("d"), F.col("other.n").alias("m")))


def _stars(members: DataFrame) -> DataFrame:
    """Candidate pairs of the larger buckets: each text with the busiest of its bucket, fewer pairs than texts.

    A text that shares more of its buckets, and larger ones, with others is the likelier middle of a family of copies.
    """
    leaders = members.groupBy("bucket").agg(F.max(F.struct("busy", "digest", "n")).alias("hub"), F.count("*").alias("here")).filter("here > 1")
    met = members.join(leaders, "bucket")
    return _near(met.select("digest", "n", F.col("hub.digest").alias("d"), F.col("hub.n").alias("m")))


def _slots(labelled: np.ndarray, slots: int) -> np.ndarray:
    return (labelled % np.uint64(slots)).astype(np.int64)


def _slot_counts(slots: int):
    """Texts of each slot, and the least and greatest class number (``part``) among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, bodies = columns(batch, "part", "body")
            found = [_slots(labels(shingles(body.split(b" "))), slots) for body in bodies]
            slot = np.concatenate([np.zeros(0, np.int64), *found])
            part = np.repeat(np.array(parts, np.int64), [len(x) for x in found])
            order = np.lexsort((part, slot))
            slot, part = slot[order], part[order]
            first = np.flatnonzero(np.diff(slot, prepend=-1))
            last = np.append(first[1:], len(slot)) - 1 if len(slot) else first
            arrays = [pa.array(x, pa.int64()) for x in (slot[first], last - first + 1, part[first], part[last])]
            yield pa.RecordBatch.from_arrays(arrays, names=["slot", "f", "low", "high"])

    return run


def _rarest(shared):
    """(digest, root, n, rest, label): of the first shingles of each text in the order of (count of the slot, label), those
    whose slot holds several classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, mixed = shared.value
        for batch in batches:
            for digest, root, body in zip(*columns(batch, "digest", "root", "body")):
                found = labels(shingles(body.split(b" ")))
                slot, n = _slots(found, len(counts)), len(found)
                first = np.lexsort((found, counts[slot]))[: n - int(np.ceil(SIMILARITY * n - 1e-9)) + 1]
                at = np.flatnonzero(mixed[slot[first]])
                keys = [pa.array([x] * len(at), pa.binary()) for x in (digest, root)]
                numbers = [pa.array(x.astype(np.int64), pa.int64()) for x in (np.full(len(at), n), n - at - 1, found[first[at]])]
                yield pa.RecordBatch.from_arrays([*keys, *numbers], names=["digest", "root", "n", "rest", "label"])

    return run


def tally(labelled: np.ndarray) -> np.ndarray:
    """How many labelled shingles fall to each of TALLIES hashes: two texts share at most the sum of the lesser counts."""
    return np.minimum(np.bincount((labelled >> np.uint64(40)) % np.uint64(TALLIES), minlength=TALLIES), 65_535).astype(np.uint16)


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, bodies = columns(batch, "digest", "body")
        found = [tally(labels(shingles(body.split(b" ")))).tobytes() for body in bodies]
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(found, pa.binary())], names=["digest", "tally"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different classes, one text of a block outside a shingle's main class each, as far as lengths and places allow.

    Where texts carry tallies, those bound the labelled shingles in common: a near pair has ``need`` of them, so the bound
    drops no link. Where they carry their first rare shingles, a pair leaves at the first one its texts share and not again.
    """
    for batch in batches:
        first, second = [], []
        for label, group in zip(batch.column(0).to_pylist(), batch.column(1)):
            texts = group.as_py()
            digest = np.array([t["digest"] for t in texts], dtype=object)
            root = np.unique(np.array([t["root"].hex() for t in texts]), return_inverse=True)[1]
            n, rest, outside = (np.array([t[k] for t in texts]) for k in ("n", "rest", "outside"))
            here, there = np.flatnonzero(outside), np.flatnonzero(~outside)
            # The first common shingle in the order of rareness has all other common ones after it.
            need = SIMILARITY * (n[here, None] + n[there]) / (1 + SIMILARITY) - 1e-9
            fits = (root[here, None] != root[there]) & (np.minimum(rest[here, None], rest[there]) + 1 >= need)
            if "tally" in texts[0]:
                tallies = np.frombuffer(b"".join(t["tally"] for t in texts), np.uint16).reshape(len(texts), TALLIES)
                for a in np.flatnonzero(fits.any(axis=1)):
                    b = np.flatnonzero(fits[a])
                    common = np.minimum(tallies[there[b]], tallies[here[a]]).sum(axis=1, dtype=np.int64)
                    fits[a, b] = (common >= need[a, b]) | (np.minimum(n[here[a]], n[there[b]]) > LONGEST_TALLIED)
            earlier = [frozenset(t["first"][: t["first"].index(label)] if label in t["first"] else t["first"]) if "first" in t else frozenset() for t in texts]
            met = set()
            for a, b in zip(*np.nonzero(fits)):
                low, high = sorted((digest[here[a]], digest[there[b]]))
                if (low, high) not in met and earlier[here[a]].isdisjoint(earlier[there[b]]):
                    met.add((low, high))
                    first.append(low)
                    second.append(high)
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.binary()), pa.array(second, pa.binary())], names=["a", "b"])


def _rare_shingles(texts: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(digest, root, n, rest, label): the rare shingles of ``texts`` (digest, root), and how many others follow each.

    Texts of n and m shingles that are near have at least SIMILARITY * max(n, m) labelled shingles in common, so in any
    order of all shingles they share one among the first n - SIMILARITY * n + 1 and m - SIMILARITY * m + 1. The order is
    that of counts in a table of SLOTS hashes, so a text is cut to those in its own task and the others never move. Nor
    do shingles whose slot holds one class only; a slot shared by chance costs a row, never a link.
    """
    placed = nodes.select("digest", "rid").join(offer_broadcast(texts.select("digest", "root"), 100), "digest")
    bodies = rows.select("rid", "body").join(offer_broadcast(placed, 160), "rid").select("digest", "root", F.xxhash64("root").alias("part"), "body")
    tallied = bodies.mapInArrow(_slot_counts(SLOTS), "slot long, f long, low long, high long").groupBy("slot")
    found = tallied.agg(F.sum("f").alias("f"), (F.min("low") < F.max("high")).alias("mixed")).toArrow()
    counts, mixed = np.zeros(SLOTS, np.uint32), np.zeros(SLOTS, bool)
    slot = found["slot"].to_numpy()
    counts[slot] = np.minimum(found["f"].to_numpy(), 2**32 - 1)
    mixed[slot] = found["mixed"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast((counts, mixed))
    return settle(bodies.mapInArrow(_rarest(shared), "digest binary, root binary, n long, rest long, label long"))


def _parted(postings: DataFrame) -> DataFrame:
    """The ``postings`` (with root) of shingles that texts of several classes hold."""
    mixed = postings.groupBy("label").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("label")
    return postings.join(offer_broadcast(settle(mixed), 40), "label")


def _one_a_class(postings: DataFrame, round_: int) -> DataFrame:
    """Candidate pairs of each shingle: one text of each class with that of one class, fewer pairs than postings."""
    drawn = F.min(F.struct(F.xxhash64("digest", "label", F.lit(round_)).alias("busy"), "digest", "n"))
    return _stars(postings.groupBy(F.col("label").alias("bucket"), "root").agg(drawn.alias("x")).select("bucket", "x.digest", "x.n", "x.busy"))


def _main_classes(postings: DataFrame) -> DataFrame:
    """The largest class of each shingle of several, the blocks its texts are dealt to, and the rows of that."""
    sizes = postings.groupBy("label", "root").agg(F.count("*").alias("size"))
    main = sizes.groupBy("label").agg(F.max(F.struct("size", "root")).alias("main"), F.sum("size").alias("all"), F.count("*").alias("classes")).filter("classes > 1")
    outside = F.col("all") - F.col("main.size")
    blocks = main.withColumn("outsides", F.ceil(outside / OUTSIDE_BLOCK).cast("int")).withColumn("alls", F.ceil(F.col("all") / ALL_BLOCK).cast("int"))
    return blocks.select("label", F.col("main.root").alias("main"), "outsides", "alls", "all", (outside * F.col("alls") + F.col("all") * F.col("outsides")).alias("rows"))


def _many_rows(postings: DataFrame) -> bool:
    """Whether dealing would take more than two rows for each posting."""
    total = _main_classes(postings).agg(F.sum("rows").alias("rows"), F.sum("all").alias("all")).first()
    return (total["rows"] or 0) > 2 * (total["all"] or 0)


def outsiders_and_all(postings: DataFrame) -> DataFrame:
    """``postings`` (with root) dealt to groups (label, i, j) in which every two texts of different classes meet.

    One text of such a pair lies outside the largest class of the shingle. Those texts are dealt to blocks, and so are
    all texts of the shingle; a pair of blocks is a group of bounded size. A few texts beside a family of copies cost
    about one row for each copy.
    """
    dealt = postings.join(offer_broadcast(settle(_main_classes(postings).select("label", "main", "outsides", "alls")), 80), "label")
    block = lambda count, seed: F.pmod(F.xxhash64("digest", F.lit(seed)), F.col(count)).cast("int")
    kept = ["digest", "root", "n", "rest", *_marks(postings)]
    mine = dealt.filter(F.col("root") != F.col("main")).select("label", *kept, block("outsides", 1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("alls") - 1)).alias("j"), F.lit(True).alias("outside"))
    others = dealt.select("label", *kept, F.explode(F.sequence(F.lit(0), F.col("outsides") - 1)).alias("i"), block("alls", 2).alias("j"), F.lit(False).alias("outside"))
    return mine.unionByName(others)


def _pairs_by_rare_shingles(postings: DataFrame) -> DataFrame:
    """All pairs (a, b) of different classes in ``postings`` (with root) that can reach the similarity."""
    held = ["digest", "root", "n", "rest", "outside", *_marks(postings)]
    groups = outsiders_and_all(postings).groupBy("label", "i", "j").agg(F.collect_list(F.struct(*held)).alias("x"))
    return groups.select("label", "x").mapInArrow(_across, "a binary, b binary").distinct()


def _marks(postings: DataFrame) -> list[str]:
    return [c for c in ("tally", "first") if c in postings.columns]


def _marked(postings: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``postings`` with the tally and the first rare shingles of their texts."""
    order = F.sort_array(F.collect_list(F.struct("rest", "label")), asc=False)
    first = settle(postings.groupBy("digest").agg(F.slice(order, 1, FIRST_LABELS)["label"].alias("first")))
    placed = nodes.select("digest", "rid").join(offer_broadcast(first.select("digest"), 60), "digest")
    bodies = rows.select("rid", "body").join(offer_broadcast(placed, 120), "rid").select("digest", "body")
    marks = settle(bodies.mapInArrow(_tallied, "digest binary, tally binary").join(first, "digest"))
    return settle(postings.join(marks, "digest"))


def _classes(links: DataFrame) -> DataFrame:
    return settle(connected_components(links, [], "a", "b").select(F.col("Node").alias("digest"), F.col("Root").alias("root")))


def _rooted(texts: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Texts with the root of their class; a text without links is its own."""
    return texts.join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest")) if roots is not None else texts.withColumn("root", F.col("digest"))


def _links(pairs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that the alignment confirms. Only texts of candidates move where the candidates are few enough to broadcast."""
    wanted = settle(pairs.select(F.col("a").alias("digest")).unionByName(pairs.select(F.col("b").alias("digest"))).distinct())
    placed = settle(nodes.select("digest", "rid").join(offer_broadcast(wanted, 100), "digest"))
    texts = settle(rows.select("rid", "body").join(offer_broadcast(placed, 120), "rid").select("digest", "body"))
    both = pairs.join(texts.select(F.col("digest").alias("a"), F.col("body").alias("body_a")), "a").join(texts.select(F.col("digest").alias("b"), F.col("body").alias("body_b")), "b")
    return settle(both.mapInArrow(_verify(SIMILARITY), "a binary, b binary, similarity double").filter(F.col("similarity") >= SIMILARITY))


def near_duplicates(docs: DataFrame, row_id: str | None = None) -> DataFrame:
    """The class of near duplicates of every row.

    Texts are words (runs of letters, digits and non-ASCII characters, A-Z in lower case); two texts are linked when
    the banded alignment of their five-word shingles matches at least 0.8 of all shingles. Classes are what links
    connect; equal word sequences are one node from the start. Null text is empty; a text without words is near only
    to its exact equals; a text of fewer than five words is one shingle. Repeated rows share a class. An empty table
    gives an empty result; other columns are ignored. Small buckets of candidates are compared pair by pair. Larger
    ones are compared with their busiest text, then in rounds while these merge classes fast: one member of each class,
    under another leader. At last all texts of buckets that still hold several classes are joined on their rarest
    shingles: one text of each class first, in rounds, then every pair of different classes that can be
    near is aligned. So the classes are those of comparing all
    pairs of every bucket.
    Result: doc_id, class_id (smallest doc_id of the class), class_size, kept (one row of each class), rid.
    """
    number = F.col(row_id) if row_id else F.monotonically_increasing_id()
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), number.alias("rid"), binary("text").alias("raw"))
    rows = settle(read.mapInArrow(_read, _ROWS_DDL))
    # Sketches are a function of the digest, so any row of it will do.
    nodes = settle(rows.groupBy("digest").agg(F.min("rid").alias("rid"), F.first("n").alias("n"), F.first("sketches").alias("sketches")))
    flat = nodes.select("digest", "n", F.posexplode("sketches").alias("k", "v")).select("digest", "n", F.xxhash64("k", "v").alias("bucket"))
    shared = flat.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    crowded = settle(flat.join(shared, "bucket"))
    busy = crowded.groupBy("digest").agg(F.sum("size").alias("busy"))
    large = settle(crowded.filter(F.col("size") > SMALL_BUCKET).select("digest", "n", "bucket").join(busy, "digest"))

    tested = settle(_pairs_of_small(crowded).unionByName(_stars(large)).distinct())
    links = _links(tested, rows, nodes)
    roots = None if links.isEmpty() else _classes(links)
    parts, round_ = large.groupBy("bucket").agg(F.count("*").alias("before")), 0
    while True:
        placed = _rooted(large, roots)
        parts = settle(placed.groupBy("bucket").agg(F.countDistinct("root").alias("now")).join(parts, "bucket").filter("now > 1"))
        led = parts.filter(F.col("now") <= LEADING * F.col("before")).select("bucket", F.col("now").alias("before"))
        if led.isEmpty():
            break
        # One member of each class stands for it in a large bucket; another one, under another leader, in every round.
        round_ += 1
        drawn = F.min(F.struct(F.xxhash64("digest", "bucket", F.lit(round_)).alias("busy"), "digest", "n"))
        apart = placed.join(led, "bucket").groupBy("bucket", "root").agg(drawn.alias("x")).select("bucket", "x.digest", "x.n", "x.busy")
        fresh = settle(_stars(apart).join(tested, ["a", "b"], "left_anti"))
        found = _links(fresh, rows, nodes)
        tested, links, parts = tested.unionByName(fresh), links.unionByName(found), led
        if found.isEmpty():
            break
        roots = _classes(links)

    # What is still parted in a large bucket is compared across its classes, whatever the leaders found.
    placed = _rooted(large, roots)
    parted = placed.groupBy("bucket").agg(F.countDistinct("root").alias("now")).filter("now > 1").select("bucket")
    apart = settle(placed.join(parted, "bucket").select("digest", "root").distinct())
    if not apart.isEmpty():
        rare = settle(_parted(_rare_shingles(apart, rows, nodes)))
        # First one text of each class that holds a shingle: most stragglers go here. More rounds follow while classes
        # merge and what is left would still cost many rows; that settles cost, not results.
        while True:
            round_ += 1
            fresh = settle(_one_a_class(rare, round_).join(tested, ["a", "b"], "left_anti"))
            found = _links(fresh, rows, nodes)
            tested, links = tested.unionByName(fresh), links.unionByName(found)
            if found.isEmpty():
                break
            roots = _classes(links)
            rare = settle(_parted(_rooted(rare.drop("root"), roots)))
            if not _many_rows(rare):
                break
        fresh = settle(_pairs_by_rare_shingles(_marked(rare, rows, nodes)).join(tested, ["a", "b"], "left_anti"))
        found = _links(fresh, rows, nodes)
        if not found.isEmpty():
            roots = _classes(links.unionByName(found))

    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    by_digest = rows.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("copies"))
    rooted = settle(_rooted(by_digest, roots))
    classes = rooted.groupBy("root").agg(F.min("first").alias("keep"), F.sum("copies").alias("class_size"))
    answers = settle(rooted.select("digest", "root").join(classes, "root").select("digest", "keep", "class_size"))
    out = rows.select("doc_id", "rid", "digest").join(answers, "digest")
    return out.select("doc_id", F.col("keep.doc_id").alias("class_id"), "class_size", (F.col("rid") == F.col("keep.rid")).alias("kept"), "rid")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each class of near duplicates, all columns unchanged."""
    row = free_name(docs, "__row")
    numbered = settle(docs.withColumn(row, F.monotonically_increasing_id()))
    stay = near_duplicates(numbered, row_id=row).filter("kept").select(F.col("rid").alias(row))
    return numbered.join(stay, row, "left_semi").drop(row)
